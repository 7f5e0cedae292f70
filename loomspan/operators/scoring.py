"""Licence names, security flags, quality scores, platform fit (SQ-*, CP-*).

`with_scan` makes the lower-case text and its set of words once per row; each
bank is then one lookup of whole words in that set, and a search only for the
patterns that are more than words, behind a test for their literal core."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import rules as R
from loomspan.functions.text import json_string, json_value

WORD = r"[\p{L}\p{N}_]+"


def with_scan(df: DataFrame, *columns: str) -> DataFrame:
    """df with `scan_text`, the columns joined by blanks in lower case (nulls
    left out), and `scan_words`, its distinct words.

    Spark does not merge a projection into one that uses its result several
    times, so both are computed once per row."""
    df = df.withColumn("scan_text", F.lower(F.concat_ws(" ", *columns)))
    return df.withColumn("scan_words", F.array_distinct(F.regexp_extract_all("scan_text", F.lit(WORD), F.lit(0))))


def alternatives(pattern: str) -> list[str]:
    """`\\b(a|b)\\b` as `\\ba\\b` and `\\bb\\b`; other patterns alone."""
    m = re.fullmatch(r"\\b\(([^()]+)\)\\b", pattern)
    return [rf"\b{p}\b" for p in m[1].split("|")] if m else [pattern]


def whole_word(pattern: str) -> str | None:
    m = re.fullmatch(r"\\b([a-z0-9]+)\\b", pattern)
    return m[1] if m else None


def literal_core(pattern: str) -> str:
    """The longest literal that every match of a pattern holds, '' if none."""
    bare = re.sub(r"\([^)]*\)\??|\[[^\]]*\][*+?]?|\\.[*+?]?|.[*?]", " ", pattern)
    return max(re.findall(r"[a-z]{2,}", bare), key=len, default="")


def matches(*patterns: str) -> Column:
    """Whether the scanned text (see with_scan) holds one of the patterns."""
    each = [a for p in patterns for a in alternatives(p)]
    words = sorted({w for p in each if (w := whole_word(p))})
    out = F.arrays_overlap("scan_words", F.array(*[F.lit(w) for w in words])) if words else F.lit(False)
    for p in each:
        if whole_word(p):
            continue
        hit = F.col("scan_text").rlike("(?dU)" + p)
        out = out | (F.contains("scan_text", F.lit(core)) & hit if (core := literal_core(p)) else hit)
    return out


def license_name() -> Column:
    """The first licence of the bank that the scanned text names, else `unknown`."""
    out = None
    for p, name in R.LICENSES:
        out = F.when(matches(p), name) if out is None else out.when(matches(p), name)
    return out.otherwise("unknown")


def permissions(kind: Column) -> Column:
    """struct of four flags: what a licence allows and asks for; null if unknown."""
    known = kind.isin(*R.PERMISSIVE, *R.COPYLEFT)
    yes = F.when(known, F.lit(True))
    return F.struct(yes.alias("redistributable"), yes.alias("allows_modification"), yes.alias("allows_commercial"), F.when(known, kind != "Unlicense").alias("requires_attribution"))


def license_of(repo: Column, declared: Column) -> Column:
    """struct(type, confidence, source): the repository's type, then the declared
    licence (JSON text: a string of the known names, or any `type` of an object),
    then the scanned text."""
    known = sorted({n for _, n in R.LICENSES})
    some = lambda c: (F.coalesce(c, F.lit("")) != "") & ~F.lower(c).isin("unknown", "none")
    bare, kind = F.trim(json_string(declared)), F.try_variant_get(json_value(declared), "$.type", "string")
    named = license_name()
    one = lambda t, n, s: F.struct(t.alias("type"), F.lit(n).alias("confidence"), F.lit(s).alias("source"))
    return (
        F.when(F.trim(repo).isin(known), one(F.trim(repo), 0.95, "repository"))
        .when(bare.isin(known), one(bare, 0.90, "declared"))
        .when(some(kind), one(kind, 0.90, "declared"))
        .when(named != "unknown", one(named, 0.70, "text"))
        .otherwise(one(F.lit("unknown"), 0.0, "none"))
    )


def security_flags() -> Column:
    """Sorted array of the flags that the scanned text raises; below ten
    characters none."""
    long = F.length(F.trim("scan_text")) >= 10
    return F.array_compact(F.array(*[F.when(long & matches(*p), F.lit(f)) for f, p in sorted(R.SECURITY.items())]))


def risk_level(flags: Column) -> Column:
    """UNKNOWN below ten characters; HIGH if destructive or with four flags;
    MEDIUM with two; else LOW."""
    n = F.size(flags)
    return (
        F.when(F.length(F.trim("scan_text")) < 10, "UNKNOWN")
        .when(F.array_contains(flags, "destructive_potential") | (n >= 4), "HIGH")
        .when(n >= 2, "MEDIUM")
        .otherwise("LOW")
    )


def filled(c: Column | str) -> Column:
    """Not null and none of '', `unknown`, `none`."""
    return ~F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")).isin("", "unknown", "none")


def points(*rules: tuple[Column, float]) -> Column:
    """Sum of the weights whose condition holds, added in order."""
    out = F.lit(0.0)
    for c, w in rules:
        out = out + F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    return out


def documentation_score(summary: Column, long_text: Column, caps: Column, has_in: Column, has_out: Column) -> Column:
    n = F.length(F.coalesce(summary, F.lit("")))
    base = F.when(n > 200, 0.3).when(n > 100, 0.2).when(n > 30, 0.1).when(n > 0, 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), base + points((F.length(F.coalesce(long_text, F.lit(""))) > 100, 0.3), (caps > 0, 0.2), (has_in, 0.1), (has_out, 0.1)))


def metadata_score(name: Column, summary: Column, domain: Column, has_in: Column, has_out: Column, caps: Column, tags: Column, installs: Column, declared: Column, inferred: Column) -> Column:
    """Ten weighted checks of presence."""
    return F.least(F.lit(1.0), points((filled(name), 0.1), (filled(summary), 0.1), (filled(domain), 0.1), (has_in, 0.1), (has_out, 0.1), (caps > 0, 0.15), (tags > 0, 0.1), (installs, 0.1), (declared, 0.075), (inferred, 0.075)))


def posture_score(risk: Column, flags: Column) -> Column:
    """LOW .9, MEDIUM .6, HIGH .3, CRITICAL .1; unknown by the number of flags."""
    known = F.when(risk == "LOW", 0.9).when(risk == "MEDIUM", 0.6).when(risk == "HIGH", 0.3).when(risk == "CRITICAL", 0.1)
    return known.when(F.size(flags) > 0, F.greatest(F.lit(0.2), F.lit(1.0) - F.lit(0.15) * F.size(flags))).otherwise(0.5)


def freshness_score(imported_at: Column) -> Column:
    return F.when(imported_at.isNull(), 0.3).otherwise(0.8)


def adoption_score(uses: Column) -> Column:
    return F.when(uses > 1000, 1.0).when(uses > 100, 0.7).when(uses > 10, 0.4).otherwise(0.2)


def dependency_score(declared: Column, inferred: Column) -> Column:
    return F.when(declared & inferred, 0.9).when(declared, 0.7).when(inferred, 0.5).otherwise(0.2)


def overall_score(doc: Column, meta: Column, fresh: Column, adoption: Column, deps: Column, posture: Column) -> Column:
    """Weighted sum; security is scored before, so that a second run gives the same."""
    return doc * 0.25 + meta * 0.20 + fresh * 0.10 + adoption * 0.10 + deps * 0.15 + posture * 0.20


def declares_needs(requirements: Column) -> Column:
    """Whether the requirements JSON lists a tool, API, package, variable or runtime."""
    v = json_value(requirements)
    lists = [F.coalesce(F.size(F.try_variant_get(v, f"$.{k}", "array<variant>")) > 0, F.lit(False)) for k in ("tools", "apis", "packages", "env_vars", "runtimes")]
    return lists[0] | lists[1] | lists[2] | lists[3] | lists[4]


#: An install command in lower-case text.
INSTALLS = r"(?m)(?:^|[\s`$(])(?:pip3?|npm|yarn|apt-get|apt|brew|cargo|go|gem) +(?:install|add|i) +[a-z0-9@]"


def infers_needs() -> Column:
    """Whether the scanned text names a runtime, a tool or an install command."""
    return matches(*R.RUNTIMES.values(), *[rf"\b{t}\b" for t in R.TOOLS]) | F.col("scan_text").rlike(INSTALLS)


def score_versions(versions: DataFrame, caps: DataFrame, tags: DataFrame, repositories: DataFrame) -> DataFrame:
    """Licence, security and quality of every version in one pass: (id,
    license_type, license_confidence, license_source, permissions, flags, risk,
    documentation, metadata, freshness, adoption, dependency, posture, overall);
    scores are rounded to 3 digits.

    versions(id, source_repo, name, summary, raw_content, domain_primary,
    input_format, output_format, runtime_requirements, license, imported_at,
    stars).  caps and tags (version_id_fk) are counted before the join;
    repositories (id, license) is joined by Spark's own size check.  The licence
    is told from the summary, as only it speaks of the work as a whole.  Nulls
    and blanks count as absent."""
    count = lambda t, n: t.where("version_id_fk IS NOT NULL").groupBy(F.col("version_id_fk").alias("id")).agg(F.count("*").alias(n))
    repo = repositories.where("id IS NOT NULL").select(F.col("id").alias("source_repo"), F.coalesce(F.try_variant_get(json_value("license"), "$.type", "string"), json_string("license")).alias("repo_license"))
    repo = repo.groupBy("source_repo").agg(F.min("repo_license").alias("repo_license"))
    d = versions.join(count(caps, "n_caps"), "id", "left").join(count(tags, "n_tags"), "id", "left").na.fill(0, ["n_caps", "n_tags"]).join(repo, "source_repo", "left")
    d = with_scan(d, "summary").withColumn("lic", license_of(F.col("repo_license"), F.col("license"))).drop("scan_text", "scan_words")
    d = with_scan(d, "summary", "raw_content")
    d = d.withColumn("flags", security_flags()).withColumn("risk", risk_level(F.col("flags"))).withColumn("declared", declares_needs(F.col("runtime_requirements"))).withColumn("inferred", infers_needs())
    has_in, has_out = filled("input_format"), filled("output_format")
    d = d.withColumns(
        {
            "documentation": documentation_score(F.col("summary"), F.col("raw_content"), F.col("n_caps"), has_in, has_out),
            "metadata": metadata_score(F.col("name"), F.col("summary"), F.col("domain_primary"), has_in, has_out, F.col("n_caps"), F.col("n_tags"), F.col("scan_text").rlike(INSTALLS), F.col("declared"), F.col("inferred")),
            "freshness": freshness_score(F.col("imported_at")),
            "adoption": adoption_score(F.col("stars")),
            "dependency": dependency_score(F.col("declared"), F.col("inferred")),
            "posture": posture_score(F.col("risk"), F.col("flags")),
        }
    )
    parts = ("documentation", "metadata", "freshness", "adoption", "dependency", "posture")
    return d.select(
        "id", F.col("lic.type").alias("license_type"), F.col("lic.confidence").alias("license_confidence"), F.col("lic.source").alias("license_source"), permissions(F.col("lic.type")).alias("permissions"), "flags", "risk",
        *[F.round(c, 3).alias(c) for c in parts], F.round(overall_score(*[F.col(c) for c in parts]), 3).alias("overall"),
    )


def scoring_summary(scored: DataFrame) -> DataFrame:
    """(kind, key, n) of all scored versions: quality bands, licences, risks, and
    the average of the quality in thousandths under (`average`, `quality`).

    One pass: each row gives three keys, combined before the shuffle."""
    q = F.col("overall")
    band = F.when(q >= 0.8, "excellent").when(q >= 0.6, "good").when(q >= 0.4, "fair").otherwise("poor")
    keys = F.array(F.struct(F.lit("quality").alias("kind"), band.alias("key")), F.struct(F.lit("license").alias("kind"), F.col("license_type").alias("key")), F.struct(F.lit("risk").alias("kind"), F.col("risk").alias("key")))
    counts = scored.select(F.explode(keys).alias("k")).groupBy("k.kind", "k.key").agg(F.count("*").alias("n"))
    mean = scored.agg(F.floor(F.coalesce(F.sum(F.round(q * 1000).cast("long")) / F.greatest(F.count("*"), F.lit(1)), F.lit(0.0))).cast("long").alias("n"))
    return counts.unionByName(mean.select(F.lit("average").alias("kind"), F.lit("quality").alias("key"), "n"))


def found(bank: dict[str, str]) -> Column:
    """The names of a bank whose pattern occurs in the scanned text, in the bank's order."""
    return F.array_compact(F.array(*[F.when(matches(p), F.lit(n)) for n, p in bank.items()]))


def invocation_type(path: Column) -> Column:
    """How a skill is called: prompt_only, mcp_tool, tool_call or cli_command;
    a text with an install command of npm, pip or npx is a tool call."""
    return (
        F.when(F.contains(F.lower(F.coalesce(path, F.lit(""))), F.lit("skill.md")), "prompt_only")
        .when(matches(R.SIGNALS["mcp"]), "mcp_tool")
        .when(matches(r"\b(npm|pip|npx)\b"), "tool_call")
        .when(matches(R.SIGNALS["shell"]), "cli_command")
        .otherwise("prompt_only")
    )


def platform_signals(docs: DataFrame, id_col: str, path: str, *texts: str) -> DataFrame:
    """One row per record with everything its text tells about platforms:
    (id, skill_file, agents_file, shell, browser, mcp, docker, api, runtimes[],
    systems[], invocation, says[])."""
    d = with_scan(docs, *texts)
    p = F.lower(F.coalesce(F.col(path), F.lit("")))
    return d.select(
        F.col(id_col).alias("id"),
        F.contains(p, F.lit("skill.md")).alias("skill_file"),
        F.contains(p, F.lit("agents.md")).alias("agents_file"),
        *[matches(R.SIGNALS[s]).alias(s) for s in R.SIGNALS],
        found(R.RUNTIMES).alias("runtimes"),
        found(R.SYSTEMS).alias("systems"),
        invocation_type(F.col(path)).alias("invocation"),
        found(R.MENTIONS).alias("says"),
    )


def agent_fit(signals: DataFrame, profiles: dict[str, list[str]] | None = None) -> DataFrame:
    """(id, agent, score, level, notes[], blockers[], enablers[]) of each record
    and platform, from platform_signals.

    The platforms are a handful of literals exploded beside the row, so there is
    no join; `profiles` gives other platforms and their features."""
    each = [F.struct(F.lit(a).alias("agent"), *[F.lit(f in fs).alias(f) for f in R.AGENT_FEATURES]) for a, fs in sorted((profiles or R.AGENTS).items())]
    e = signals.withColumn("a", F.explode(F.array(*each)))
    has = lambda f: F.col(f"a.{f}")
    heavy = F.filter("runtimes", lambda r: r.isin("rust", "go", "java", "deno"))
    light = F.filter("runtimes", lambda r: ((r == "python") & F.col("a.python")) | ((r == "node") & F.col("a.node")))
    shell = F.col("shell") & ~F.col("skill_file")
    own = F.array_contains("says", F.col("a.agent"))
    on = lambda c, yes, no=0.0: F.when(c, F.lit(yes)).otherwise(F.lit(no))
    # in this order, so that sums meet the borders of the levels alike
    score = F.lit(0.5) + F.when(F.col("skill_file"), on(has("skill_md"), 0.35, -0.1)).otherwise(F.lit(0.0))
    score = score + on(F.col("agents_file") & has("agents_md"), 0.15)
    score = score + F.when(F.col("mcp"), on(has("mcp"), 0.3, -0.3)).otherwise(F.lit(0.0))
    for r in ("rust", "go", "java", "deno"):
        score = score - on(F.array_contains("runtimes", r) & ~has("shell"), 0.2)
    score = score - on(F.col("browser") & ~has("browser"), 0.2)
    score = score - on(shell & ~has("shell"), 0.3)
    score = score + on(own, 0.15)
    score = score - on(F.col("docker") & ~has("shell"), 0.2)
    one = lambda c, text: F.when(c, F.array(text if isinstance(text, Column) else F.lit(text))).otherwise(F.array().cast("array<string>"))
    every = lambda items, c, before, after: F.when(c, F.transform(items, lambda r: F.concat(F.lit(before), r, F.lit(after)))).otherwise(F.array().cast("array<string>"))
    notes = F.concat(
        one(F.col("skill_file") & ~has("skill_md"), "skill file (not read natively)"),
        one(F.col("agents_file") & ~has("agents_md"), "agents file"),
        every(heavy, has("shell"), "needs ", " (to be installed)"),
        F.transform(F.filter("says", lambda s: s != F.col("a.agent")), lambda s: F.concat(F.lit("mentions "), s)),
        one(F.col("docker") & has("shell"), "needs docker (to be installed)"),
        one(F.col("api"), "needs API keys or tokens"),
    )
    blockers = F.concat(
        one(F.col("mcp") & ~has("mcp"), "needs mcp"),
        every(heavy, ~has("shell"), "needs ", " (no shell)"),
        one(F.col("browser") & ~has("browser"), "needs a browser"),
        one(shell & ~has("shell"), "needs a shell"),
        one(F.col("docker") & ~has("shell"), "needs docker"),
    )
    enablers = F.concat(
        one(F.col("skill_file") & has("skill_md"), "skill file"),
        one(F.col("agents_file") & has("agents_md"), "agents file"),
        one(F.col("mcp") & has("mcp"), "mcp"),
        every(light, F.lit(True), "", " supported"),
        one(F.col("browser") & has("browser"), "browser supported"),
        one(shell & has("shell"), "shell supported"),
        one(own, F.concat(F.lit("mentions "), F.col("a.agent"))),
    )
    s = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 3)
    at = F.col("score")
    level = F.when(at >= 0.8, "SUPPORTED").when(at >= 0.6, "LIKELY_SUPPORTED").when(at >= 0.35, "REQUIRES_ADAPTER").when(F.size("blockers") > 0, "NOT_SUPPORTED").otherwise("UNKNOWN")
    return e.select("id", F.col("a.agent").alias("agent"), s.alias("score"), notes.alias("notes"), blockers.alias("blockers"), enablers.alias("enablers")).withColumn("level", level)


def compatibility_records(signals: DataFrame, existing: DataFrame | None = None, profiles: dict[str, list[str]] | None = None) -> DataFrame:
    """(id, profile): the full profile of each record as one struct with a map by
    platform.  With `existing`(id, compatibility), only records without data
    (null, blank, `{}`, `[]` or `null`) are assessed: the incremental run."""
    if existing is not None:
        from loomspan.functions.text import absent

        signals = signals.join(existing.where(absent("compatibility")).select("id").distinct(), "id", "left_semi")
    fit = agent_fit(signals, profiles)
    # a handful of platforms per record: the group is bounded
    agents = fit.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("agent", F.struct("level", F.col("score").alias("confidence"), "notes", "blockers", "enablers").alias("v"))))).alias("agents"))
    return signals.join(agents, "id").select("id", F.struct(F.col("invocation").alias("invocation_type"), F.col("skill_file").alias("skill_md_format"), F.col("mcp").alias("mcp_compatible"), F.col("runtimes").alias("detected_runtimes"), F.col("systems").alias("detected_os"), "agents").alias("profile"))


def compatibility_summary(signals: DataFrame) -> DataFrame:
    """(kind, key, n): records by invocation, runtime, format and platform level."""
    keys = F.concat(
        F.array(F.struct(F.lit("invocation").alias("kind"), F.col("invocation").alias("key"))),
        F.transform("runtimes", lambda r: F.struct(F.lit("runtime").alias("kind"), r.alias("key"))),
        F.when(F.col("mcp"), F.array(F.struct(F.lit("format").alias("kind"), F.lit("mcp").alias("key")))).otherwise(F.array().cast("array<struct<kind:string,key:string>>")),
        F.when(F.col("skill_file"), F.array(F.struct(F.lit("format").alias("kind"), F.lit("skill_md").alias("key")))).otherwise(F.array().cast("array<struct<kind:string,key:string>>")),
    )
    counts = signals.select(F.explode(keys).alias("k")).groupBy("k.kind", "k.key").agg(F.count("*").alias("n"))
    levels = agent_fit(signals).groupBy(F.lit("level").alias("kind"), F.concat_ws(" ", "agent", "level").alias("key")).agg(F.count("*").alias("n"))
    return counts.unionByName(levels)
