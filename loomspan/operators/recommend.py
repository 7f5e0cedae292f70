"""Recommendation and composition (RC-*, CM-*): signals as frames, one union."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import rules as R
from loomspan.functions.text import label_key

SIGNALS = ("task_match", "similar", "same_category", "same_ecosystem", "popular", "high_quality")
#: Similar records that each installed one brings in.
NEAREST = 5


def task_keywords(task: str) -> list[str]:
    """Capabilities that the task's words ask for, and its own longer words."""
    low = task.lower()
    asked = {c for word, caps in R.TASKS.items() if word in low for c in caps}
    return sorted(asked | {w for w in re.findall(r"[a-z]{5,}", low) if w not in R.COMMON})


def task_match(docs: DataFrame, keywords: list[str]) -> DataFrame:
    """(id, score, detail): per keyword the best place it occurs in: capabilities
    2, tags 1.5, summary 1, domain .5; their sum over twice the number of
    keywords.  docs(id, caps[], tags[], summary, domain)."""
    ks = F.array(*[F.lit(k) for k in keywords])
    norm = lambda c: label_key(F.coalesce(c, F.lit("")))
    caps, tags = F.transform("caps", norm), F.transform("tags", norm)
    summary, domain = F.lower(F.coalesce("summary", F.lit(""))), F.lower(F.coalesce("domain", F.lit("")))
    d = docs.select("id", caps.alias("c"), tags.alias("t"), summary.alias("s"), domain.alias("d"))

    def worth(k: Column) -> Column:
        n = F.regexp_replace(k, r"[-_\s]+", "")
        return F.when(F.exists("c", lambda x: F.contains(x, n)), 2.0).when(F.exists("t", lambda x: F.contains(x, n)), 1.5).when(F.contains("s", k), 1.0).when(F.contains("d", k), 0.5).otherwise(0.0)

    w = F.transform(ks, lambda k: F.struct(k.alias("k"), worth(k).alias("w")))
    d = d.select("id", F.filter(w, lambda x: x["w"] > 0).alias("hits"))
    total = F.aggregate("hits", F.lit(0.0), lambda a, x: a + x["w"])
    return d.where(F.size("hits") > 0).select("id", F.least(total / (2.0 * len(keywords)), F.lit(1.0)).alias("score"), F.array_join(F.slice(F.transform("hits", lambda x: x["k"]), 1, 5), ", ").alias("detail"))


def peers(docs: DataFrame, chosen: DataFrame, column: str, most: int) -> DataFrame:
    """(id, of): up to `most` records for each chosen one with the same `column`,
    by id.

    Each value keeps its `most` + 1 first records before the join (a group limit
    that Spark applies before the shuffle), so a value that a third of all records
    share costs no more than another."""
    first = docs.where(F.col(column).isNotNull()).select("id", column).withColumn("k", F.row_number().over(Window.partitionBy(column).orderBy("id")))
    first = first.where(F.col("k") <= most + 1).drop("k")
    c = chosen.select("id").join(docs.select("id", column), "id").select(F.col("id").alias("of"), column)
    p = c.join(first, column).where("id <> of")
    return p.withColumn("n", F.row_number().over(Window.partitionBy("of").orderBy("id"))).where(F.col("n") <= most).select("id", "of")


def merge_signals(signals: list[DataFrame], installed: DataFrame, limit: int) -> DataFrame:
    """(id, score, reason, detail): the best signal of each record, the earlier of
    equal ones; without the installed; the best limit * 3."""
    u = signals[0]
    for s in signals[1:]:
        u = u.unionByName(s)
    rank = F.array_position(F.array(*[F.lit(s) for s in SIGNALS]), F.col("reason"))
    best = u.join(installed.select("id"), "id", "left_anti").groupBy("id").agg(F.max(F.struct("score", (-rank).alias("r"), "reason", "detail")).alias("m"))
    return best.select("id", "m.score", "m.reason", "m.detail").orderBy(F.desc("score"), "id").limit(limit * 3)


def recommend(docs: DataFrame, task: str | None, installed: DataFrame, pairs: DataFrame | None = None, limit: int = 20, reasons: tuple[str, ...] | None = None) -> DataFrame:
    """Recommendations from all signals (see merge_signals), or only from those
    in `reasons`.

    docs(id, caps[], tags[], summary, domain, repo, version_count, quality);
    pairs(id, other, overall) are similar records from both ends.  The ten most
    versioned and the ten best records come in where there is no task."""
    parts = []
    lit = lambda df, score, reason, detail: df.select("id", score.alias("score"), F.lit(reason).alias("reason"), detail.alias("detail"))
    none = F.lit("").cast("string")
    if task:
        m = task_match(docs, task_keywords(task)).where("score > 0.1")
        parts.append(lit(m, F.col("score") * 0.85, "task_match", F.col("detail")))
    if pairs is not None:
        s = pairs.join(installed.select("id"), "id").withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("overall"), "other"))).where(F.col("n") <= NEAREST)
        parts.append(lit(s.select(F.col("other").alias("id"), "overall"), F.col("overall") * 0.25, "similar", none))
    parts.append(lit(peers(docs, installed, "domain", 5), F.lit(0.15), "same_category", none))
    parts.append(lit(peers(docs, installed, "repo", 3), F.lit(0.10), "same_ecosystem", none))
    if not task:
        top = docs.join(installed.select("id"), "id", "left_anti").orderBy(F.desc_nulls_last("version_count"), "id").limit(10)
        parts.append(lit(top, F.least(F.coalesce("version_count", F.lit(0)) / 10.0, F.lit(1.0)) * 0.15, "popular", none))
        best = docs.where("quality IS NOT NULL").join(installed.select("id"), "id", "left_anti").orderBy(F.desc("quality"), "id").limit(10)
        parts.append(lit(best, F.col("quality") * 0.20, "high_quality", none))
    if reasons is not None:
        parts = [p.where(F.col("reason").isin(*reasons)) for p in parts]
    return merge_signals(parts, installed, limit)


def recommend_for(docs: DataFrame, pairs: DataFrame, record: str, limit: int = 10) -> DataFrame:
    """(id, score, reason) for one record: similar ones by their likeness, then
    others of its domain at 0.15; without the record, the best `limit`."""
    one = docs.where(F.col("id") == record).select("id")
    near = pairs.where(F.col("id") == record).orderBy(F.desc("overall"), "other").limit(limit).select(F.col("other").alias("id"), F.col("overall").alias("score"), F.lit("similar").alias("reason"))
    same = peers(docs, one, "domain", limit).select("id", F.lit(0.15).alias("score"), F.lit("same_category").alias("reason"))
    best = near.unionByName(same.join(near.select("id"), "id", "left_anti")).where(F.col("id") != record)
    return best.orderBy(F.desc("score"), "id").limit(limit)


def overlaps(sets: DataFrame) -> DataFrame:
    """(a, b, shared, n) of chosen records(pos, id, caps[]): capabilities that two
    of them share, in their order."""
    e = sets.select("pos", "id", F.explode("caps").alias("c"))
    p = e.alias("x").join(e.alias("y"), (F.col("x.c") == F.col("y.c")) & (F.col("x.pos") < F.col("y.pos")))
    return p.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.array_join(F.array_sort(F.collect_set("x.c")), ", ").alias("shared"), F.count_distinct("x.c").alias("n"))


def conflicts(chosen: DataFrame, docs: DataFrame, resolution: str = "warn") -> DataFrame:
    """(kind, a, b, severity, resolution, detail) of a composition of chosen(pos,
    id): records that do not exist, and capabilities that two of them share.

    A missing record is an error.  Shared capabilities are a warning where the
    resolution is `warn` or `merge`, else an error; the detail names the first
    five.  The chosen records are a handful, so they are broadcast behind Spark's
    own size check."""
    c = chosen.join(docs.select("id", "caps"), "id", "left")
    none = F.lit("")
    missing = c.where("caps IS NULL").select(F.lit("missing_skill").alias("kind"), F.col("id").alias("a"), none.alias("b"), F.lit("error").alias("severity"), none.alias("resolution"), F.lit("not found").alias("detail"))
    soft = resolution in ("warn", "merge")
    shared = overlaps(c.where("caps IS NOT NULL"))
    first = F.array_join(F.slice(F.split("shared", ", "), 1, 5), ", ")
    both = shared.select(F.lit("capability_overlap").alias("kind"), "a", "b", F.lit("warning" if soft else "error").alias("severity"), F.lit(resolution if soft else "").alias("resolution"), first.alias("detail"))
    return missing.unionByName(both)


def merged_dependencies(deps: DataFrame, chosen: DataFrame) -> DataFrame:
    """(kind, names[]): the sorted distinct needs of the chosen records by kind."""
    d = deps.join(chosen.select("id"), "id", "left_semi")
    return d.groupBy(F.col("type").alias("kind")).agg(F.array_sort(F.collect_set("name")).alias("names"))


def composition(chosen: DataFrame, docs: DataFrame, deps: DataFrame, strategy: str = "sequential", resolution: str = "warn") -> DataFrame:
    """One row: the name, order, merged capabilities and needs, conflicts and
    validity of a composition of chosen(pos, id).

    The order is the given one for every strategy; a pipeline takes its input
    from the first record and gives the output of the last.  An empty choice is
    not valid."""
    c = chosen.join(docs, "id", "left")
    k = conflicts(chosen, docs, resolution).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    order = F.array_sort(F.collect_list(F.struct("pos", "id", F.coalesce("name", "id").alias("name"))))
    m = c.agg(order.alias("o"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("caps")))).alias("capabilities"), F.count_distinct("repo").alias("sources"))
    needs = merged_dependencies(deps, chosen).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "names")))).alias("needs"))
    name = F.concat(F.array_join(F.slice(F.transform("o", lambda x: x["name"]), 1, 3), " + "), F.when(F.size("o") > 3, "...").otherwise(""))
    return m.crossJoin(k).crossJoin(needs).select(
        name.alias("name"), F.lit(strategy).alias("strategy"), F.transform("o", lambda x: x["id"]).alias("order"), F.size("o").alias("components"), "sources", "capabilities", "needs", "errors", "warnings", ((F.col("errors") == 0) & (F.size("o") > 0)).alias("valid")
    )


def merged(sets: DataFrame, column: str = "caps") -> DataFrame:
    """One row: the sorted union of a set column and how many records gave it."""
    return sets.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(column)))).alias(column), F.count("*").alias("components"), F.count_distinct("repo").alias("sources"))


def suggest_pairs(recs: DataFrame, sets: DataFrame, limit: int = 5) -> DataFrame:
    """Pairs of the best `limit` records by fewest shared, then most capabilities."""
    top = recs.orderBy(F.desc("score"), "id").limit(limit).select("id").join(sets.select("id", "caps"), "id")
    p = top.alias("x").join(top.alias("y"), F.col("x.id") < F.col("y.id"))
    return p.select(
        F.col("x.id").alias("a"),
        F.col("y.id").alias("b"),
        F.size(F.array_intersect("x.caps", "y.caps")).alias("shared"),
        F.size(F.array_union("x.caps", "y.caps")).alias("total"),
    ).orderBy("shared", F.desc("total"), "a", "b").limit(limit)
