"""Queries of the relational core, sync, analytics, recommendation and exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan.engine import Engine
from loomspan.functions.text import json_text, json_value, label_key, present, search_tokens
from loomspan.operators import analytics as A
from loomspan.operators import recommend as C
from loomspan.operators import sync as Y
from loomspan.operators.records import category_of, children, live, numbered, risk_of
from loomspan.operators.similarity import both_ways, exact_copies
from loomspan.operators.snapshot_diff import latest_records
from loomspan.plans.common import CV, RISK, SK, docs, json_sql, rounded, skills
from loomspan.plans.rules import scored
from loomspan.plans.similarity import similar
from loomspan.operators.parsing import declared_dependencies
from loomspan.session import cut_lineage, table
from loomspan.sources.export import catalogue_rows, markdown_lines


# --- relational core ---------------------------------------------------------


def scan_project_filter(spark, sf):
    return table(spark, sf, "part").where("p_size >= 25 AND p_retailprice < 1500").select("p_partkey", "p_name", "p_size")


def json_range_filter(spark, sf):
    e = table(spark, sf, "events", "event_id", "props")
    k = F.get_json_object("props", "$.k").try_cast("int")
    return e.select("event_id", k.alias("k")).where("k >= 50")


def risk_ordinal_filter(spark, sf):
    """Current versions of at most MEDIUM risk; an unknown risk never passes."""
    return docs(spark, sf, "security").select("skill_id", risk_of("security").alias("risk")).where(F.col("risk").isin("LOW", "MEDIUM"))


def semi_join_exists(spark, sf):
    o = table(spark, sf, "orders", "o_custkey", "o_orderpriority").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf, "customer", "c_custkey", "c_mktsegment").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


def anti_join_orphans(spark, sf):
    """Child rows whose version does not exist."""
    v = table(spark, sf, "versions", "id").withColumnRenamed("id", "v")
    one = lambda t: table(spark, sf, t, "id", "version_id_fk").join(v, F.col("version_id_fk") == F.col("v"), "left_anti").select(F.lit(t).alias("child"), "id")
    return one("capabilities").unionByName(one("tags"))


def left_join_coalesce(spark, sf):
    s = skills(spark, sf).select("id", F.col("name").alias("sname"))
    d = docs(spark, sf).select(F.col("skill_id").alias("id"), F.col("name").alias("vname"), "summary")
    return s.join(d, "id", "left").select("id", F.coalesce("vname", "sname", F.lit("")).alias("name"), F.length(F.coalesce("summary", F.lit(""))).alias("chars"))


def self_join_theta_pairs(spark, sf):
    """Repositories with one owner, every pair in order."""
    r = table(spark, sf, "repositories", "id", "owner")
    a, b = r.alias("a"), r.alias("b")
    return a.join(b, (F.col("a.owner") == F.col("b.owner")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def latest_version(spark, sf):
    return docs(spark, sf).select("skill_id", F.col("id").alias("version_row"), "name")


def version_numbering(spark, sf):
    v = table(spark, sf, "versions", "id", "skill_id", "imported_at").where("skill_id IS NOT NULL")
    quarter = F.floor(F.unix_micros(F.col("imported_at").cast("timestamp")) / F.lit(90 * 86_400_000_000))
    return numbered(v, "skill_id", [F.col("imported_at").asc_nulls_first(), F.col("id")], block=quarter).select("id", "skill_id", "n")


def point_lookup(spark, sf):
    """One skill with its children: the one with the least id."""
    d = docs(spark, sf).orderBy("skill_id").limit(1)
    caps = children(table(spark, sf, "capabilities", "version_id_fk", "name"), "name", "caps")
    tags = children(table(spark, sf, "tags", "version_id_fk", "name"), "name", "tags")
    j = d.join(caps, d["id"] == caps["version"], "left").drop("version").join(tags, d["id"] == tags["version"], "left")
    return j.select("skill_id", "name", F.coalesce(F.array_join("caps", "|"), F.lit("")).alias("caps"), F.coalesce(F.array_join("tags", "|"), F.lit("")).alias("tags"))


def list_page(spark, sf):
    """A filtered page of records and the total number of hits."""
    d = docs(spark, sf).where("domain = 'data'").select("skill_id", "name")
    return d.orderBy("skill_id").offset(5).limit(25).crossJoin(d.agg(F.count("*").alias("total")))


def records_filtered(spark, sf):
    """Records that are current, at least fair, and of a format."""
    return Engine(spark, sf).records(is_current=True, min_quality=0.5, format="markdown").select("skill_id", "domain")


def repos_list(spark, sf):
    r = table(spark, sf, "repositories", "id", "skill_count", "ecosystem")
    n = table(spark, sf, "versions", "source_repo", "skill_id").groupBy(F.col("source_repo").alias("id")).agg(F.count_distinct("skill_id").alias("found"))
    return r.join(n, "id", "left").select("id", "skill_count", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("ecosystem", F.lit("unknown")).alias("ecosystem"))


def registry_stats(spark, sf):
    one = lambda t: table(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("what"), "n")
    out = one("skills")
    for t in ("versions", "capabilities", "tags", "repositories"):
        out = out.unionByName(one(t))
    return out


def eager_children(spark, sf):
    """Each repository with the sorted names of its skills as one nested row."""
    d = docs(spark, sf).where("repo IS NOT NULL").groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("name", "skill_id"))).alias("s"))
    return d.select("repo", F.size("s").cast("long").alias("n"), F.array_join(F.slice(F.transform("s", lambda x: F.coalesce(x["name"], F.lit(""))), 1, 3), "|").alias("first_names"))


def version_as_of(spark, sf):
    """As-of join: the version of each skill that was current at a snapshot."""
    s = table(spark, sf, "version_snapshots", "snapshot_no", "snapshot_at").where("snapshot_no IS NOT NULL").groupBy("snapshot_no").agg(F.max("snapshot_at").alias("at"))
    v = table(spark, sf, "versions", "id", "skill_id", "imported_at").where("skill_id IS NOT NULL AND imported_at IS NOT NULL")
    j = v.join(F.broadcast(s), F.col("imported_at") <= F.col("at"))  # a row per delivery
    return j.groupBy("snapshot_no", "skill_id").agg(F.max(F.struct("imported_at", "id")).alias("m")).select("snapshot_no", "skill_id", F.col("m.id").alias("version_row"))


def dup_names(spark, sf):
    d = docs(spark, sf).where("name IS NOT NULL AND repo IS NOT NULL")
    return d.groupBy("repo", "name").agg(F.count("*").alias("n")).where("n > 1")


def repo_backfill(spark, sf):
    """Repositories that versions name but the list lacks."""
    r = table(spark, sf, "repositories", "id")
    return table(spark, sf, "versions", "source_repo").where("source_repo IS NOT NULL").distinct().join(r, F.col("source_repo") == F.col("id"), "left_anti")


def io_shape(spark, sf):
    """Input and output formats with defined values for absent ones."""
    f = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) == "", "unknown").otherwise(F.lower(F.trim(c)))
    return table(spark, sf, "versions", "input_format", "output_format").groupBy(f(F.col("input_format")).alias("input"), f(F.col("output_format")).alias("output")).agg(F.count("*").alias("n"))


# --- sync --------------------------------------------------------------------


def _deliveries(spark, sf):
    """(earlier, later): every delivery's records and those of the one before,
    both keyed by the later delivery's number and the skill."""
    s = table(spark, sf, "version_snapshots", "snapshot_no", "skill_id", "source_path", "source_commit_sha", "source_content_hash", "loaded_at")
    rec = latest_records(s).select("snapshot_no", "skill_id", "hash", "path")
    key = lambda df, no: df.select(F.struct(no.alias("no"), "skill_id").alias("k"), "hash", "path")
    nos = s.where("snapshot_no IS NOT NULL").select("snapshot_no").distinct()
    has_next = nos.select((F.col("snapshot_no") - 1).alias("snapshot_no"))
    has_last = nos.select((F.col("snapshot_no") + 1).alias("snapshot_no"))
    return key(rec.join(has_next, "snapshot_no", "left_semi"), F.col("snapshot_no") + 1), key(rec.join(has_last, "snapshot_no", "left_semi"), F.col("snapshot_no"))


FIELDS = {"hash": "MODIFIED", "path": "MOVED"}


def snapshot_diff_fields(spark, sf):
    """Changes by field between every two consecutive deliveries."""
    a, b = _deliveries(spark, sf)
    return Y.detect_changes(a, b, "k", FIELDS).select("k.no", "k.skill_id", "change", "field", "old_value", "new_value")


def snapshot_diff(spark, sf):
    a, b = _deliveries(spark, sf)
    ch = Y.detect_changes(a, b, "k", FIELDS)
    n = ch.groupBy("k.no", "change").agg(F.count_distinct("k").alias("n"))
    same = a.select("k").join(b.select("k"), "k", "left_semi").join(ch.select("k"), "k", "left_anti")
    return n.unionByName(same.groupBy("k.no").agg(F.count("*").alias("n")).select("no", F.lit("UNCHANGED").alias("change"), "n"))


def apply_sync_state(spark, sf):
    """The state after each delivery, from the records of the one before."""
    a, b = _deliveries(spark, sf)
    a = a.withColumn("n", F.lit(1))
    return Y.apply_changes(a, b, Y.detect_changes(a, b, "k", FIELDS), "k", "n").select("k.no", "k.skill_id", "hash", "path", "n", "lifecycle")


def sync_history_pivot(spark, sf):
    h = Y.sync_history(table(spark, sf, "sync_changelog", "sync_id", "change_type", "created_at"))
    n = lambda k: F.coalesce(F.try_element_at("counts", F.lit(k)), F.lit(0))
    return h.select("sync_id", "started", "total", *[n(k).alias(k.lower()) for k in ("ADDED", "MODIFIED", "REMOVED", "MOVED")])


def entity_history(spark, sf):
    log = table(spark, sf, "sync_changelog", "id", "entity_id", "change_type", "created_at")
    who = log.where("entity_id IS NOT NULL").groupBy("entity_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_id").limit(1)
    return log.join(F.broadcast(who.select("entity_id")), "entity_id").select("id", "entity_id", F.upper(F.trim("change_type")).alias("change"))  # one row


def roundtrip_diff(spark, sf):
    """Rows of all skills that do not come back from JSON text: none."""
    d = table(spark, sf, "skills")
    back = d.select(F.from_json(F.to_json(F.struct(*d.columns), {"ignoreNullFields": "false"}), d.schema).alias("r")).select("r.*")
    return d.exceptAll(back).unionByName(back.exceptAll(d)).select("id", "name")


# --- analytics ---------------------------------------------------------------


def coverage_report(spark, sf):
    v = docs(spark, sf, "security", "license", "compatibility", "runtime_requirements", "raw_content", "input_format")
    caps = table(spark, sf, "capabilities", "version_id_fk").groupBy(F.col("version_id_fk").alias("id")).agg(F.lit(1).alias("c"))
    tags = table(spark, sf, "tags", "version_id_fk").groupBy(F.col("version_id_fk").alias("id")).agg(F.lit(1).alias("t"))
    v = v.join(caps, "id", "left").join(tags, "id", "left")
    m = {c: present(c) for c in ("summary", "domain", "security", "license", "compatibility", "runtime_requirements", "raw_content", "input_format")}
    m |= {"capabilities": F.col("c").isNotNull(), "tags": F.col("t").isNotNull()}
    return A.coverage(v, m, skills(spark, sf).agg(F.count("*").alias("total")))


def _checks(spark, sf):
    """Nine checks; each table is read once and gives one row."""
    v = table(spark, sf, "versions", "id", "skill_id", "security", "imported_at", "raw_content")
    s = skills(spark, sf).select("id")
    orphans = v.where("skill_id IS NOT NULL").join(s.withColumnRenamed("id", "skill_id"), "skill_id", "left_anti").agg(F.count("*").alias("orphans"))
    a = v.agg(F.count("*").alias("versions"), F.count_if(risk_of("security").isin("HIGH", "CRITICAL")).alias("risky"), F.count_if(present("security")).alias("assessed"), F.count_if(F.col("imported_at").isNull()).alias("undated"), F.date_diff(F.max("imported_at"), F.lit("1970-01-01").cast("date")).alias("newest"))
    c = table(spark, sf, "capabilities", "taxonomy_path").agg(F.count("*").alias("caps"), F.count_if(F.coalesce(category_of("taxonomy_path"), F.lit("uncategorized")) == "uncategorized").alias("loose"))
    r = table(spark, sf, "repositories", "skill_count").agg(F.count_if(F.coalesce("skill_count", F.lit(0)) == 0).alias("empty_repos"))
    d = docs(spark, sf)
    indexed = d.agg(F.count_if(F.size(search_tokens(F.concat_ws(" ", "name", "summary", "domain", "repo"))) > 0).alias("indexed"))
    q = _quality(spark, sf).agg(F.count("overall").alias("scored"))
    copies = exact_copies(v).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("copies"))
    one = a.crossJoin(orphans).crossJoin(c).crossJoin(r).crossJoin(indexed).crossJoin(q).crossJoin(copies).crossJoin(s.agg(F.count("*").alias("skills")))  # one row each
    warn = lambda cond, other="ok": F.when(cond, other).otherwise("ok")
    rows = F.array(
        A.check("accessible", warn(F.col("skills") == 0, "warn"), F.col("skills")),
        A.check("orphans", warn(F.col("orphans") > 0, "fail"), F.col("orphans")),
        A.check("search_index", F.when(F.col("indexed") == 0, "fail").when(F.col("indexed") < F.col("skills"), "warn").otherwise("ok"), F.col("indexed")),
        A.check("taxonomy", warn(F.col("loose") * 2 > F.col("caps"), "warn"), F.col("loose")),
        A.check("quality", warn(F.col("scored") < F.col("skills"), "warn"), F.col("scored")),
        A.check("security", warn(F.col("assessed") < F.col("versions"), "warn"), F.col("risky")),
        A.check("repositories", warn(F.col("empty_repos") > 0, "warn"), F.col("empty_repos")),
        A.check("freshness", warn(F.col("newest").isNull(), "warn"), F.col("newest")),
        A.check("copies", F.lit("ok"), F.col("copies")),
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def health_checks(spark, sf):
    return _checks(spark, sf)


def full_report(spark, sf):
    """All of the analytics as (section, key, n): checks, coverage, gaps, quality,
    domains, categories, risks and platforms."""
    part = lambda df, section, key, n: df.select(F.lit(section).alias("section"), key.alias("key"), n.cast("long").alias("n"))
    out = part(_checks(spark, sf), "health", F.concat_ws(" ", "check", "status"), F.col("value"))
    for section, df, key in [("coverage", coverage_report(spark, sf), "measure"), ("gaps", gap_lists(spark, sf).groupBy("gap").agg(F.count("*").alias("n")), "gap"), ("quality", quality_bands(spark, sf), "band"), ("domains", domain_distribution(spark, sf), "domain"), ("categories", category_distribution(spark, sf), "category"), ("risks", risk_distribution(spark, sf), "risk")]:
        out = out.unionByName(part(df, section, F.col(key), F.col("n")))
    return out.unionByName(part(nested_map_counts(spark, sf), "platforms", F.concat_ws(" ", "agent", "level"), F.col("n")))


def overall_health(spark, sf):
    return A.overall_health(_checks(spark, sf))


def gap_lists(spark, sf):
    """Up to 50 records for each kind of gap, by id."""
    v = docs(spark, sf, "security", "license", "compatibility")
    caps = table(spark, sf, "capabilities", "version_id_fk").select(F.col("version_id_fk").alias("id")).distinct().withColumn("c", F.lit(1))
    tags = table(spark, sf, "tags", "version_id_fk").select(F.col("version_id_fk").alias("id")).distinct().withColumn("t", F.lit(1))
    v = v.join(caps, "id", "left").join(tags, "id", "left")
    gaps = {"compatibility": ~present("compatibility"), "tags": F.col("t").isNull(), "summary": ~present("summary"), "domain": ~present("domain"), "license": ~present("license"), "security": ~present("security"), "capabilities": F.col("c").isNull()}
    kinds = F.array_compact(F.array(*[F.when(g, F.lit(k)) for k, g in gaps.items()]))
    r = v.select("skill_id", F.explode(kinds).alias("gap"))
    return r.withColumn("n", F.row_number().over(Window.partitionBy("gap").orderBy("skill_id"))).where("n <= 50").select("gap", "skill_id")


def _quality(spark, sf):
    """(id, overall) of the current versions' quality; only their texts are scored."""
    d = docs(spark, sf).select("id", "skill_id", "repo")
    return d.join(scored(spark, sf, d).select("id", "overall"), "id")


def quality_order_stats(spark, sf):
    return A.order_stats(_quality(spark, sf), "overall")


def quality_histogram(spark, sf):
    return A.histogram(_quality(spark, sf), "overall")


def quality_bands(spark, sf):
    return A.group_counts(_quality(spark, sf), A.bands(F.col("overall")), "band")


def top_bottom(spark, sf):
    return A.extremes(_quality(spark, sf), "skill_id", "overall").select("end", "rank", "skill_id", F.col("overall").alias("score"))


def ecosystem_health(spark, sf):
    """Repositories with their records, their average quality in thousandths and
    what is wrong with them."""
    r = table(spark, sf, "repositories", "id", "license", "last_successful_sync", "sync_errors", "skill_count")
    n = docs(spark, sf).groupBy(F.col("repo").alias("id")).agg(F.count("*").alias("records"), F.count_if(present("summary")).alias("described"))
    q = _quality(spark, sf).groupBy(F.col("repo").alias("id")).agg(F.sum(F.round(F.col("overall") * 1000).cast("long")).alias("q"), F.count("*").alias("c"))
    q = q.select("id", F.floor(F.col("q") / F.col("c")).cast("long").alias("quality"))
    j = r.join(n, "id", "left").na.fill(0, ["records", "described"]).join(q, "id", "left")
    issues = F.array_compact(
        F.array(
            F.when(F.col("records") == 0, F.lit("no_records")),
            F.when(~present("license"), F.lit("no_license")),
            F.when(F.col("last_successful_sync").isNull(), F.lit("never_synced")),
            F.when(F.size(F.coalesce("sync_errors", F.array().cast("array<string>"))) > 0, F.lit("sync_errors")),
            F.when(F.col("quality") < 400, F.lit("low_quality")),
        )
    )
    return j.select("id", "records", "described", "quality", F.array_join(issues, "|").alias("issues"))


def domain_distribution(spark, sf):
    return A.group_counts(docs(spark, sf), F.coalesce("domain", F.lit("unknown")), "domain")


def category_distribution(spark, sf):
    return A.group_counts(table(spark, sf, "capabilities", "taxonomy_path").where("taxonomy_path IS NOT NULL"), category_of("taxonomy_path"), "category")


def risk_distribution(spark, sf):
    return A.group_counts(docs(spark, sf, "security"), risk_of("security"), "risk")


def nested_map_counts(spark, sf):
    """Levels of the `agents` maps inside the compatibility JSON."""
    m = F.try_variant_get(json_value("compatibility"), "$.agents", "map<string, variant>")
    d = table(spark, sf, "versions", "compatibility").select(F.explode(m).alias("agent", "v"))
    return d.groupBy("agent", F.try_variant_get("v", "$.level", "string").alias("level")).agg(F.count("*").alias("n"))


def dependency_summary(spark, sf):
    """The ten most wanted tools, with their rank."""
    each = F.explode(F.try_variant_get(json_value("runtime_requirements"), "$.tools", "array<variant>"))
    d = table(spark, sf, "versions", "runtime_requirements").select(each.alias("t"))
    name = F.coalesce(F.try_variant_get("t", "$.name", "string"), F.when(F.schema_of_variant("t") == "STRING", F.try_variant_get("t", "$", "string")))
    n = d.select(name.alias("tool")).where("tool IS NOT NULL").groupBy("tool").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "tool").limit(10)


def dependency_risks(spark, sf):
    """Versions with more than ten requirements, and those that need a service."""
    v = table(spark, sf, "versions", "id", "runtime_requirements").withColumn("j", json_value("runtime_requirements"))
    size = lambda k: F.greatest(F.coalesce(F.size(F.try_variant_get("j", f"$.{k}", "array<variant>")), F.lit(0)), F.lit(0))
    v = v.select("id", (size("tools") + size("packages") + size("apis") + size("env_vars") + size("runtimes")).alias("n"), size("apis").alias("apis"))
    kinds = F.array_compact(F.array(F.when(F.col("n") > 10, F.lit("high_coupling")), F.when(F.col("apis") > 0, F.lit("service_required"))))
    return v.select("id", F.explode(kinds).alias("risk"), "n")


def rate_limit_window(spark, sf):
    """Calls of each user in the hour up to each call."""
    e = table(spark, sf, "events", "event_id", "user_id", "ts").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("s").rangeBetween(-60_000_000 * 60, 0)
    return e.select("event_id", F.count("*").over(w).alias("calls"))


def ttl_cache_hits(spark, sf):
    """Calls that a cache of an hour's life would answer: those with an earlier
    call of the same user and kind within the hour."""
    e = table(spark, sf, "events", "event_id", "user_id", "event_type", "ts")
    prev = F.lag("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    hit = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(prev.cast("timestamp")) <= 3_600_000_000, F.lit(False))
    return e.withColumn("hit", hit).groupBy("event_type").agg(F.count("*").alias("calls"), F.count_if("hit").alias("hits"))


# --- recommendation ----------------------------------------------------------


def _rec_docs(spark, sf, scores: bool = False):
    """Records as the recommender reads them; their quality only where asked for,
    as it is told from all texts."""
    d = docs(spark, sf).select("id", "skill_id", "name", "summary", "domain", "repo")
    caps = children(table(spark, sf, "capabilities", "version_id_fk", "name"), "name", "caps")
    tags = children(table(spark, sf, "tags", "version_id_fk", "name"), "name", "tags")
    s = live(skills(spark, sf)).select(F.col("id").alias("skill_id"), "version_count")
    none = F.array().cast("array<string>")
    j = d.join(caps, d["id"] == caps["version"], "left").drop("version").join(tags, d["id"] == tags["version"], "left").join(s, "skill_id")
    if scores:
        j = j.join(_quality(spark, sf).select("skill_id", F.col("overall").alias("quality")), "skill_id", "left")
    else:
        j = j.withColumn("quality", F.lit(None).cast("double"))
    return j.select(F.col("skill_id").alias("id"), F.coalesce("caps", none).alias("caps"), F.coalesce("tags", none).alias("tags"), "summary", "domain", "repo", "version_count", "quality")


def _installed(records):
    """Records that stand for the installed ones: those of one repository."""
    return records.where(F.startswith("repo", F.lit("b"))).select("id")


def _recommended(spark, sf, task, limit):
    """All signals; records and pairs are read several times and written once.
    Only what is most similar to the installed records is asked for."""
    d = cut_lineage(_rec_docs(spark, sf, task is None))
    return C.recommend(d, task, _installed(d), cut_lineage(both_ways(similar(spark, sf, of=_installed(d), most=C.NEAREST))), limit)


TASK = "review the data"


def rec_task_match(spark, sf):
    return C.task_match(_rec_docs(spark, sf), C.task_keywords(TASK)).select("id", rounded(F.col("score")).alias("score"), "detail")


def rec_union_max(spark, sf):
    return _recommended(spark, sf, TASK, 40).select("id", rounded(F.col("score")).alias("score"), "reason")


def rec_facets(spark, sf):
    return _recommended(spark, sf, TASK, 40).groupBy("reason").agg(F.count("*").alias("n"))


def rec_popular(spark, sf):
    return _recommended(spark, sf, None, 20).select("id", rounded(F.col("score")).alias("score"), "reason")


def rec_for_record(spark, sf):
    """Recommendations for the record that has the most similar others."""
    pairs = cut_lineage(both_ways(similar(spark, sf)))
    most = pairs.groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(1).collect()  # one row
    return C.recommend_for(_rec_docs(spark, sf), pairs, most[0]["id"] if most else "", 10).select("id", rounded(F.col("score")).alias("score"), "reason")


def peer_same_domain(spark, sf):
    d = _rec_docs(spark, sf)
    return C.peers(d, _installed(d), "domain", 5).select("of", "id")


def _chosen(spark, sf):
    d = _rec_docs(spark, sf).where("size(caps) > 0").orderBy(F.desc(F.size("caps")), "id").limit(12)
    return d.withColumn("pos", F.row_number().over(Window.orderBy("id")))


def compose_overlap(spark, sf):
    return C.overlaps(_chosen(spark, sf))


def compose_conflicts(spark, sf):
    """Conflicts of a composition that names a record which does not exist."""
    ids = _chosen(spark, sf).select("pos", "id")
    ids = ids.unionByName(spark.createDataFrame([(99, "no such record")], "pos int, id string"))
    return C.conflicts(ids, _rec_docs(spark, sf), "prefer_first").select("kind", "a", "b", "severity", "resolution", "detail")


def compose_dependencies(spark, sf):
    """What a composition needs, by kind."""
    v = docs(spark, sf, "runtime_requirements")
    return C.merged_dependencies(declared_dependencies(v, "skill_id", "runtime_requirements"), _chosen(spark, sf)).select("kind", F.array_join("names", "|").alias("names"))


def compose_merge(spark, sf):
    return C.merged(_chosen(spark, sf)).select(F.array_join("caps", "|").alias("caps"), "components", "sources")


def suggest_pairs(spark, sf):
    d = _rec_docs(spark, sf)
    return C.suggest_pairs(C.task_match(d, C.task_keywords(TASK)).withColumn("score", rounded(F.col("score"))), d, 5)


# --- exports -----------------------------------------------------------------


def _export(spark, sf):
    return catalogue_rows(docs(spark, sf, "license", "security"), table(spark, sf, "capabilities", "version_id_fk", "name"), table(spark, sf, "tags", "version_id_fk", "name"), live(skills(spark, sf)).select("id"))


def export_rows_csv(spark, sf):
    return _export(spark, sf)


def export_markdown_lines(spark, sf):
    return markdown_lines(_export(spark, sf))


def export_stats(spark, sf):
    return _export(spark, sf).groupBy("domain").agg(F.count("*").alias("records"), F.count_if(F.col("capabilities") != "").alias("with_capabilities"))


NAMES = """scan_project_filter json_range_filter risk_ordinal_filter semi_join_exists anti_join_orphans left_join_coalesce self_join_theta_pairs latest_version version_numbering
point_lookup list_page records_filtered repos_list registry_stats eager_children version_as_of dup_names repo_backfill io_shape snapshot_diff_fields snapshot_diff apply_sync_state sync_history_pivot
entity_history roundtrip_diff coverage_report health_checks full_report overall_health gap_lists quality_order_stats quality_histogram quality_bands top_bottom ecosystem_health domain_distribution
category_distribution risk_distribution nested_map_counts dependency_summary dependency_risks rate_limit_window ttl_cache_hits rec_task_match rec_union_max rec_facets rec_popular
rec_for_record peer_same_domain compose_overlap compose_conflicts compose_dependencies compose_merge suggest_pairs export_rows_csv export_markdown_lines export_stats""".split()
QUERIES = {n: globals()[n] for n in NAMES}

from loomspan.plans.catalogue_sql import SQL  # noqa: E402, F401
