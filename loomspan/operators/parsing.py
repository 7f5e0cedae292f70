"""Skill files, agent files and readmes as columns (PR-*), and what they need
(DP-1..8): packages, variables, tools, secrets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import rules as R
from loomspan.functions.text import json_value


#: The words by which a text names a runtime.
RUNTIME_WORDS = {name: p.removeprefix(r"\b(").removesuffix(r")\b").replace("python3?", "python|python3").split("|") for name, p in R.RUNTIMES.items()}


def unix_lines(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))


def body(text: Column) -> Column:
    """Text without front matter, line ends as \\n."""
    return F.regexp_replace(unix_lines(text), r"(?s)^---[ \t]*\n.*?\n---[ \t]*\n", "")


def title(text: Column) -> Column:
    """The first top heading, '' without one."""
    return F.trim(F.regexp_extract(text, r"(?dm)^#\s+(.+)", 1))


def after_title(text: Column) -> Column:
    head = F.regexp_extract(text, r"(?ds)\A(?:#\s+[^\n]+|.*?\n#\s+[^\n]+)", 0)
    return F.substring(text, F.length(head) + 1, F.length(text))


def first_paragraph(text: Column, quoted: bool = False) -> Column:
    """The first line after a blank one that is no heading, whole; with `quoted`
    without the sign of a quotation."""
    return F.trim(F.regexp_extract(text, r"\n\n(?:>\s*)?([^#\n][^\n]+)" if quoted else r"\n\n([^#\n][^\n]+)", 1))


def sections(text: Column) -> Column:
    """array of (heading, body) by second-level headings, headings lower case."""
    parts = F.split(F.concat(F.lit("\n"), text), r"\n[ \t]*##[ \t]+", -1)
    return F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))),
        lambda p: F.struct(F.lower(F.trim(F.substring_index(p, "\n", 1))).alias("heading"), F.trim(F.regexp_replace(p, r"^[^\n]*\n?", "")).alias("body")),
    )


def bullets(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?d)[-*]\s+(.+)"), F.lit(1)), lambda x: F.trim(x))


def bullets_of(parts: Column, headings: tuple[str, ...], each: int | None = None) -> Column:
    """The bullets of the named sections in the order of the names; of equal
    headings the last counts; of each section the first `each`."""
    out = []
    for h in headings:
        last = F.try_element_at(_named(parts, h), F.lit(-1))
        found = bullets(F.coalesce(last["body"], F.lit("")))
        out.append(found if each is None else F.slice(found, 1, each))
    return F.concat(*out)


def _named(parts: Column, heading: str) -> Column:
    return F.filter(parts, lambda s: s["heading"] == heading)


def infer_domain(text: Column) -> Column:
    """The domain with the most signals, the earlier of equal ones, else general."""
    t = F.lower(F.coalesce(text, F.lit("")))
    n = F.array(*[sum((F.contains(t, F.lit(s)).cast("int") for s in words), F.lit(0)) for words in R.DOMAINS.values()])
    best = F.array_max(n)
    names = F.array(*[F.lit(d) for d in R.DOMAINS])
    return F.when(best == 0, F.lit("general")).otherwise(F.element_at(names, F.array_position(n, best).cast("int")))


def technology_tags(text: Column, most: int = 15) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    words = F.array_distinct(F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    return F.slice(F.array_sort(F.array_intersect(words, F.array(*[F.lit(x) for x in R.TECHNOLOGIES]))), 1, most)


def packages(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, ecosystem, package) of install commands in a text, several per
    command; options and files are no packages."""
    rx = r"(?m)(?:^|[\s`$(])(pip3?|npm|yarn|apt-get|apt|brew|cargo|go|gem) +(?:install|add|i) +([^\n`;&|)]+)"
    cmd = F.explode(F.arrays_zip(F.regexp_extract_all(text, F.lit(rx), F.lit(1)).alias("m"), F.regexp_extract_all(text, F.lit(rx), F.lit(2)).alias("a")))
    eco = F.create_map(*[x for k, v in R.INSTALLERS.items() for x in (F.lit(k), F.lit(v))])
    d = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), cmd.alias("c"))
    d = d.select("id", eco[F.col("c.m")].alias("ecosystem"), F.explode(F.split(F.trim("c.a"), r"\s+")).alias("p"))
    name = F.regexp_extract("p", r"^([A-Za-z0-9@][A-Za-z0-9_./@-]*?)(?:\[.*\])?(?:[=<>~!].*)?$", 1)
    return d.select("id", "ecosystem", F.lower(name).alias("package")).where("package <> ''").distinct()


def env_vars(text: Column) -> Column:
    """Distinct UPPER_SNAKE names."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+"), F.lit(0))))


def tools(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    one = sorted(x for x in R.TOOLS if x.isalnum())
    words = F.array_distinct(F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    more = [F.when(F.contains(t, F.lit(x)) & t.rlike(rf"(?U)\b{x}\b"), F.lit(x)) for x in sorted(R.TOOLS) if not x.isalnum()]
    return F.array_sort(F.concat(F.array_intersect(words, F.array(*[F.lit(x) for x in one])), F.array_compact(F.array(*more))))


def secrets(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, kind, preview, position) of every match of the secret forms, repeats
    too; the position counts characters from 0, the preview is 40 characters.

    A match stands behind what is between the matches before it, so positions
    follow from the pieces and the matches; nothing leaves the JVM."""

    def places(i: int, p: str) -> Column:
        hits = F.regexp_extract_all(text, F.lit(p), F.lit(0))
        size = lambda a: F.transform(a, F.length)
        total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
        pieces = size(F.split(text, p, -1))
        each = F.transform(hits, lambda h, k: F.struct(F.lit(i).alias("kind"), F.concat(F.substring(h, 1, 40), F.lit("...")).alias("preview"), (total(F.slice(pieces, 1, k + 1)) + total(F.slice(size(hits), 1, k))).alias("position")))
        return F.when(F.col(text).rlike(p), each).otherwise(F.array().cast("array<struct<kind:int,preview:string,position:int>>"))

    d = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.explode(F.concat(*[places(i, p) for i, p in enumerate(R.SECRETS)])).alias("e"))
    return d.select("id", "e.*")


def api_keys(text: Column) -> Column:
    """Distinct services whose key, token or secret a text names as a variable."""
    rx = r"\b(?:" + "|".join(R.SERVICES) + r")(?:_[A-Z0-9]+)*_(?:KEY|TOKEN|SECRET|KEY_ID|PASSWORD|CREDENTIALS)\b"
    first = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rx), F.lit(0)), lambda x: F.substring_index(x, "_", 1)))
    names = F.create_map(*[F.lit(x) for kv in R.SERVICES.items() for x in kv])
    return F.array_sort(F.array_distinct(F.transform(first, lambda x: F.concat(names[x], F.lit(" API")))))


#: How sure a find of each type is.
CONFIDENCE = {"package": 0.95, "api": 0.90, "runtime": 0.85, "env_var": 0.80, "tool": 0.70}


def dependencies_in(docs: DataFrame, id_col: str, text: str, min_confidence: float = 0.0, variables: bool = True) -> DataFrame:
    """(id, type, name, ecosystem, confidence) of all that a text needs: packages
    of install commands, services, runtimes, tools and (if `variables`) other
    variables; distinct.  Null texts and those below ten characters need nothing."""
    d = docs.where(F.length(F.trim(text)) >= 10)
    none = F.lit(None).cast("string")
    one = lambda kind, names: F.transform(names, lambda n: F.struct(F.lit(kind).alias("type"), n.alias("name")))
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    runtimes = F.array_compact(F.array(*[F.when(F.arrays_overlap("__words", F.array(*[F.lit(w) for w in ws])), F.lit(r)) for r, ws in RUNTIME_WORDS.items()]))
    found = [one("api", api_keys(F.col(text))), one("runtime", runtimes), one("tool", tools(F.col(text)))]
    if variables:
        found.append(one("env_var", env_vars(F.col(text))))
    e = d.withColumn("__words", words).select(F.col(id_col).alias("id"), F.explode(F.concat(*found)).alias("f")).select("id", "f.type", "f.name", none.alias("ecosystem"))
    e = e.unionByName(packages(d, id_col, text).select("id", F.lit("package").alias("type"), F.col("package").alias("name"), "ecosystem"))
    sure = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    return e.distinct().withColumn("confidence", sure[F.col("type")]).where(F.col("confidence") >= min_confidence)


def declared_dependencies(docs: DataFrame, id_col: str, requirements: str) -> DataFrame:
    """The same columns for what the requirements JSON lists; an element is an
    object with a name or a plain string."""
    v = json_value(requirements)
    kinds = {"tools": "tool", "apis": "api", "packages": "package", "env_vars": "env_var", "runtimes": "runtime"}

    def listed(key: str, kind: str) -> Column:
        elements = F.coalesce(F.try_variant_get(v, f"$.{key}", "array<variant>"), F.array().cast("array<variant>"))
        return F.transform(elements, lambda x: F.struct(F.lit(kind).alias("type"), x.alias("x")))

    each = F.concat(*[listed(k, t) for k, t in kinds.items()])
    e = docs.select(F.col(id_col).alias("id"), F.explode(each).alias("e"))
    name = F.when(F.schema_of_variant("e.x") == "STRING", F.try_variant_get("e.x", "$", "string")).otherwise(F.try_variant_get("e.x", "$.name", "string"))
    return e.select("id", "e.type", name.alias("name"), F.try_variant_get("e.x", "$.ecosystem", "string").alias("ecosystem"), F.lit(1.0).alias("confidence")).where("coalesce(name, '') <> ''").distinct()


def version_dependencies(docs: DataFrame, id_col: str, text: str, requirements: str, min_confidence: float = 0.7) -> DataFrame:
    """Dependencies of texts and requirements with their source."""
    t = dependencies_in(docs, id_col, text, min_confidence).withColumn("source", F.lit("text"))
    return t.unionByName(declared_dependencies(docs, id_col, requirements).withColumn("source", F.lit("declared")))


def dependency_record(deps: DataFrame) -> DataFrame:
    """(id, tools[], apis[], packages[], env_vars[], runtimes[]): the dependencies
    of each record as one row; what one record names is bounded by its own text."""
    kinds = {"tool": "tools", "api": "apis", "package": "packages", "env_var": "env_vars", "runtime": "runtimes"}
    one = F.struct("name", "ecosystem", "confidence", "source")
    return deps.groupBy("id").agg(*[F.array_sort(F.collect_set(F.when(F.col("type") == t, one))).alias(k) for t, k in kinds.items()])


@dataclass(frozen=True)
class Parser:
    """A file parser: `accepts(name, text)` tells whether it takes a file (lower-case
    file name, text), `fields(text, domain)` gives its columns as FIELDS."""

    format: str
    accepts: Callable[[Column, Column], Column]
    fields: Callable[[Column, Column], dict[str, Column]]


FIELDS = ("name", "summary", "headings", "capabilities", "tags", "dependencies", "compatibility", "confidence")


def _none() -> Column:
    return F.array().cast("array<string>")


def _points(*rules: tuple[Column, float]) -> Column:
    out = F.lit(0.0)
    for c, w in rules:
        out = out + F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    return F.round(F.least(out, F.lit(1.0)), 2)


def _headings(parts: Column) -> Column:
    return F.transform(parts, lambda x: x["heading"])


def _skill(text: Column, domain: Column) -> dict[str, Column]:
    t = body(text)
    parts = sections(t)
    named = bullets_of(parts, ("triggers", "when to use", "capabilities", "features", "what it does"))
    first = F.filter(F.transform(parts, lambda x: bullets(x["body"])), lambda x: F.size(x) > 0)
    caps = F.slice(F.when(F.size(named) > 0, named).otherwise(F.slice(F.coalesce(F.get(first, F.lit(0)), _none()), 1, 5)), 1, 20)
    installs = F.regexp_extract_all(t, F.lit(r"```(?:bash|sh)?\n((?:npm|pip|cargo|brew|apt)\s+install[^\n]+)"), F.lit(1))
    needs = F.flatten(F.transform(F.regexp_extract_all(t, F.lit(r"(?i)(?:requires?|dependencies?):\s*([^\n]+)"), F.lit(1)), lambda x: F.transform(F.split(x, ","), lambda x: F.trim(x))))
    out = {"name": title(t), "summary": first_paragraph(after_title(t)), "headings": _headings(parts), "capabilities": caps, "tags": technology_tags(text), "dependencies": F.slice(F.concat(F.transform(installs, lambda x: F.trim(x)), needs), 1, 10), "compatibility": bullets_of(parts, ("compatibility", "supported", "platforms", "ecosystems"))}
    out["confidence"] = _points((out["name"] != "", 0.25), (out["summary"] != "", 0.2), (F.size(caps) > 0, 0.25), (domain != "general", 0.1), (F.size(out["tags"]) > 0, 0.1), (F.size(out["dependencies"]) > 0, 0.1))
    return out


def _agents(text: Column, domain: Column) -> dict[str, Column]:
    t = unix_lines(text)
    parts = sections(t)
    caps = bullets_of(parts, ("workflow", "capabilities", "what you can do", "features"), 10)
    words = F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    out = {"name": title(t), "summary": F.substring(first_paragraph(t), 1, 200), "headings": _headings(parts), "capabilities": caps, "tags": F.array_sort(F.array_intersect(words, F.array(*[F.lit(x) for x in R.AGENT_TECHNOLOGIES]))), "dependencies": _none(), "compatibility": _none()}
    out["confidence"] = _points((out["name"] != "", 0.3), (out["summary"] != "", 0.2), (F.size(caps) > 0, 0.3), (F.size(out["tags"]) > 0, 0.2))
    return out


def _readme(text: Column, domain: Column) -> dict[str, Column]:
    t = unix_lines(text)
    badges = F.transform(F.slice(F.regexp_extract_all(t, F.lit(r"(?d)!\[.*?\]\(https?://img\.shields\.io/badge/([^-]+)"), F.lit(1)), 1, 5), lambda x: F.lower(F.trim(x)))
    install = F.regexp_extract(t, r"(?is)##\s+(?:install|setup|getting\s+started)\s*\n(.*?)(?=##|\z)", 1)
    commands = F.slice(F.regexp_extract_all(install, F.lit(r"```(?:bash|sh)?\n((?:npm|pip|cargo|brew|apt|yarn|pnpm)\s+[^\n]+)"), F.lit(1)), 1, 5)
    caps = F.slice(bullets(F.regexp_extract(t, r"(?is)##\s+(?:features|what|capabilities)\s*\n(.*?)(?=##|\z)", 1)), 1, 10)
    out = {"name": title(t), "summary": F.substring(first_paragraph(t, quoted=True), 1, 200), "headings": _headings(sections(t)), "capabilities": caps, "tags": badges, "dependencies": commands, "compatibility": _none()}
    out["confidence"] = _points((out["name"] != "", 0.3), (out["summary"] != "", 0.2), (F.size(caps) > 0, 0.3), (F.size(badges) > 0, 0.1), (F.size(commands) > 0, 0.1))
    return out


PARSERS = (
    Parser("skill", lambda name, t: F.endswith(name, F.lit("skill.md")) | t.rlike(r"(?im)^##\s+(?:when to use|triggers|differentiator|voice triggers|what|description|usage)|\btrigger\s+phrases?\b"), _skill),
    Parser("agents", lambda name, t: F.endswith(name, F.lit("agents.md")) | F.lower(t).rlike(r"(?U)you are\b|agent\b|workflow\b|when (?:the )?user|## (?:rules|guidelines|tools|workflow)"), _agents),
    Parser("readme", lambda name, t: F.startswith(name, F.lit("readme")) & F.endswith(name, F.lit(".md")), _readme),
)


def parse_files(docs: DataFrame, id_col: str, path: str, text: str, parsers: tuple[Parser, ...] = PARSERS, fallback: Parser = PARSERS[2], given: str | None = None) -> DataFrame:
    """(id, format, domain, FIELDS): each file by the first parser that takes it,
    else by the fallback; own parsers go in front.

    With `given`, a column that names a format, that parser is taken where there
    is one.  Null and empty texts have no fields and confidence 0."""
    d = docs.select(F.col(id_col).alias("id"), F.lower(F.substring_index(F.coalesce(F.col(path), F.lit("")), "/", -1)).alias("__name"), F.coalesce(F.col(text), F.lit("")).alias("__text"), (F.col(given) if given else F.lit(None).cast("string")).alias("__given"))
    t, name = F.col("__text"), F.col("__name")
    fmt = F.when(F.col("__given").isin(*[p.format for p in parsers]), F.col("__given"))
    for p in parsers:
        fmt = fmt.when(p.accepts(name, t), F.lit(p.format))
    d = d.withColumn("format", fmt.otherwise(F.lit(fallback.format))).withColumn("domain", infer_domain(t))
    every = {p.format: p.fields(t, F.col("domain")) for p in (fallback, *reversed(parsers))}

    def pick(field: str) -> Column:
        out = None
        for f, columns in every.items():
            c = F.col("format") == f
            out = F.when(c, columns[field]) if out is None else out.when(c, columns[field])
        return out

    return d.select("id", "format", "domain", *[pick(f).alias(f) for f in FIELDS])
