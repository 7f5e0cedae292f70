"""One object over a set of tables: every command of the catalogue as a method
that returns a DataFrame (CLI-*, API-*), and a small command line."""

from __future__ import annotations

import argparse
import time
from collections import OrderedDict
from collections.abc import Callable
from statistics import mean

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.text import json_text, label_key
from loomspan.operators import analytics as A
from loomspan.operators import graph, parsing, recommend, scoring, search, similarity, taxonomy
from loomspan.operators.records import children, current_skills, current_versions, live, risk_of
from loomspan.sources import export as E


class Engine:
    """Tables are given as frames, or read from a folder of parquet files."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | str):
        self.spark = spark
        if isinstance(tables, str):
            folder = tables
            tables = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in ("skills", "versions", "capabilities", "tags", "repositories")}
        self.t = tables
        self.cache = ResultCache()

    # records
    def skills(self) -> DataFrame:
        return current_skills(self.t["skills"])

    def versions(self) -> DataFrame:
        v = current_versions(self.t["versions"])
        return v.withColumnRenamed("domain_primary", "domain").withColumnRenamed("source_repo", "repo")

    def records(
        self, domain: str | None = None, repo: str | None = None, max_risk: str | None = None, category: str | None = None, lifecycle: str | None = None,
        format: str | None = None, is_current: bool | None = None, has_mcp: bool | None = None, min_quality: float | None = None,
    ) -> DataFrame:
        """Current versions of live skills that pass all the filters given.

        A risk limit admits LOW up to the limit, never UNKNOWN.  Without
        `lifecycle` archived skills are left out; `format` is the input's or the
        output's; quality is scored only where `min_quality` asks for it."""
        s = self.skills()
        s = live(s) if lifecycle is None else s.where(F.col("lifecycle") == lifecycle)
        if is_current is not None:
            s = s.where(F.coalesce("is_current", F.lit(False)) == is_current)
        d = self.versions().join(s.select(F.col("id").alias("skill_id")), "skill_id", "left_semi")
        if format is not None:
            d = d.where((F.col("input_format") == format) | (F.col("output_format") == format))
        if has_mcp is not None:
            d = d.where(F.coalesce(json_text("compatibility", "$.mcp_compatible") == "true", F.lit(False)) == has_mcp)
        if min_quality is not None:
            d = d.join(self.scores().where(F.col("overall") >= min_quality).select("id"), "id", "left_semi")
        if domain is not None:
            d = d.where(F.col("domain") == domain)
        if repo is not None:
            d = d.where(F.col("repo") == repo)
        if max_risk is not None:
            order = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
            d = d.where(risk_of("security").isin(order[: order.index(max_risk) + 1] if max_risk in order else order))
        if category is not None:
            c = self.t["capabilities"].where(F.startswith("taxonomy_path", F.lit(category))).select(F.col("version_id_fk").alias("id"))
            d = d.join(c, "id", "left_semi")
        return d

    def list_records(self, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
        return self.records(**filters).orderBy("skill_id").offset(offset).limit(limit)

    def get_record(self, skill_id: str) -> DataFrame:
        d = self.versions().where(F.col("skill_id") == skill_id)
        for t in ("capabilities", "tags"):
            d = d.join(children(self.t[t], "name", t), d["id"] == F.col("version"), "left").drop("version")
        return d

    def compose(self, ids: list[str], strategy: str = "sequential", resolution: str = "warn") -> DataFrame:
        chosen = self.spark.createDataFrame(list(enumerate(ids)), "pos int, id string")
        deps = parsing.version_dependencies(self.versions().withColumn("t", F.concat_ws("\n", "summary", "raw_content")), "skill_id", "t", "runtime_requirements")
        docs = self.rec_docs().join(self.versions().select(F.col("skill_id").alias("id"), "name"), "id")
        return recommend.composition(chosen, docs, deps, strategy, resolution)

    def repos(self) -> DataFrame:
        return self.t["repositories"].orderBy(F.desc("skill_count"), "id")

    # search
    def build_index(self, stem: bool = True) -> search.Index:
        return search.build_index(self.versions(), "skill_id", ["name", "summary", "domain", "repo"], stem)

    def search(self, query: str, limit: int = 50, offset: int = 0, mode: str = "any", index: search.Index | None = None, **filters) -> DataFrame:
        hits = search.bm25(index or self.build_index(), query, mode)
        keep = self.records(**filters).select(F.col("skill_id").alias("id"))
        return search.page(hits.join(keep, "id", "left_semi"), limit, offset)

    def autocomplete(self, prefix: str, limit: int = 10) -> DataFrame:
        return search.autocomplete(self.versions(), "skill_id", "name", prefix, limit)

    def by_capability(self, text: str, limit: int = 50) -> DataFrame:
        key = label_key(F.lit(text))
        c = self.t["capabilities"].where(F.contains(label_key("name"), key) | F.contains(label_key("canonical"), key)).select(F.col("version_id_fk").alias("id"))
        return self.versions().join(c, "id", "left_semi").orderBy("skill_id").limit(limit)

    # similarity, recommendation
    def fingerprints(self) -> DataFrame:
        v = current_versions(self.t["versions"])
        return similarity.fingerprints(v, self.t["capabilities"])

    def detect_duplicates(self, least: float = 0.40, weights: dict[str, float] | None = None) -> DataFrame:
        return similarity.detect_duplicates(self.fingerprints(), least, weights)

    def rec_docs(self) -> DataFrame:
        none = F.array().cast("array<string>")
        d = self.records()
        for t, c in (("capabilities", "caps"), ("tags", "tags")):
            d = d.join(children(self.t[t], "name", c), d["id"] == F.col("version"), "left").drop("version")
        n = self.skills().select(F.col("id").alias("skill_id"), "version_count")
        d = d.join(self.scores().select("id", F.col("overall").alias("quality")), "id", "left")
        return d.drop("id").join(n, "skill_id").select(F.col("skill_id").alias("id"), F.coalesce("caps", none).alias("caps"), F.coalesce("tags", none).alias("tags"), "summary", "domain", "repo", "version_count", "quality")

    def pairs(self) -> DataFrame:
        return similarity.both_ways(self.detect_duplicates())

    def recommend(self, task: str | None = None, installed: list[str] | None = None, limit: int = 20, reasons: tuple[str, ...] | None = None) -> DataFrame:
        have = self.spark.createDataFrame([(i,) for i in installed or []], "id string")
        return recommend.recommend(self.rec_docs(), task, have, self.pairs() if installed else None, limit, reasons)

    def recommend_for(self, record: str, limit: int = 10) -> DataFrame:
        return recommend.recommend_for(self.rec_docs(), self.pairs(), record, limit)

    def scores(self) -> DataFrame:
        return scoring.score_versions(self.t["versions"].withColumn("stars", F.lit(0)), self.t["capabilities"], self.t["tags"], self.t["repositories"])

    # rules
    def classify(self, reference: DataFrame) -> DataFrame:
        return taxonomy.classify(self.t["capabilities"], reference)

    def agent_fit(self, profiles: dict[str, list[str]] | None = None) -> DataFrame:
        return scoring.agent_fit(scoring.platform_signals(self.versions(), "skill_id", "source_path", "summary", "raw_content"), profiles)

    def dependencies(self) -> DataFrame:
        return parsing.packages(self.versions(), "skill_id", "raw_content")

    def dependency_graph(self) -> DataFrame:
        deps = self.dependencies().select(F.col("id").alias("src"), F.col("package").alias("name"))
        return graph.resolve(deps, self.skills())[0]

    # reports
    def stats(self) -> DataFrame:
        out = None
        for name, df in self.t.items():
            one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
            out = one if out is None else out.unionByName(one)
        return out

    def domains(self) -> DataFrame:
        return A.group_counts(self.versions(), F.coalesce("domain", F.lit("unknown")), "domain")

    def export(self, **filters) -> DataFrame:
        return E.catalogue_rows(self.records(**filters), self.t["capabilities"], self.t["tags"])


class ResultCache:
    """Small results on the driver: least recently used first out, and a life.

    Reading makes an entry recent but not younger."""

    def __init__(self, most: int = 512, life: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.most, self.life, self.clock = most, life, clock
        self.rows: OrderedDict[str, tuple[float, object]] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: str):
        got = self.rows.get(key)
        if got is None or self.clock() - got[0] > self.life:
            self.rows.pop(key, None)
            self.misses += 1
            return None
        self.rows.move_to_end(key)
        self.hits += 1
        return got[1]

    def put(self, key: str, value) -> None:
        self.rows[key] = (self.clock(), value)
        self.rows.move_to_end(key)
        while len(self.rows) > self.most:
            self.rows.popitem(last=False)

    def drop(self, prefix: str) -> int:
        gone = [k for k in self.rows if k.startswith(prefix)]
        for k in gone:
            del self.rows[k]
        return len(gone)


class RateLimiter:
    """At most `most` admitted calls of a key in a sliding window."""

    def __init__(self, most: int = 100, window: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.most, self.window, self.clock = most, window, clock
        self.log: dict[str, list[float]] = {}

    def admit(self, key: str) -> bool:
        now = self.clock()
        kept = [t for t in self.log.get(key, []) if now - t < self.window]
        ok = len(kept) < self.most
        self.log[key] = [*kept, now] if ok else kept
        return ok


def benchmark(name: str, run: Callable[[], DataFrame], times: int = 5) -> dict[str, float | str]:
    """Milliseconds of running a frame to the end, into a sink without rows."""
    took = []
    for _ in range(times):
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        took.append((time.perf_counter() - began) * 1000)
    took.sort()
    n = len(took)
    return {"name": name, "avg": mean(took), "min": took[0], "max": took[-1], "p50": took[n // 2], "p95": took[int(0.95 * n)]}


def plan_lint(df: DataFrame) -> list[str]:
    """What a plan at scale should not hold."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    said = {"CartesianProduct": "a cross join", "BatchEvalPython": "a row-at-a-time Python function", "Exchange SinglePartition": "all rows in one task"}
    return [v for k, v in said.items() if k in plan]


def main(argv: list[str] | None = None) -> int:
    from loomspan.session import build_session

    p = argparse.ArgumentParser(prog="loomspan")
    p.add_argument("tables", help="folder of parquet tables")
    sub = p.add_subparsers(dest="command", required=True)
    for name, arg in (("search", "query"), ("autocomplete", "prefix"), ("recommend", "task"), ("get", "skill_id")):
        sub.add_parser(name).add_argument(arg)
    for name in ("list", "repos", "stats", "domains", "dedup", "export"):
        sub.add_parser(name)
    for s in sub.choices.values():
        s.add_argument("--limit", type=int, default=20)
    a = p.parse_args(argv)
    e = Engine(build_session(), a.tables)
    run = {
        "search": lambda: e.search(a.query, a.limit), "autocomplete": lambda: e.autocomplete(a.prefix, a.limit), "recommend": lambda: e.recommend(a.task), "get": lambda: e.get_record(a.skill_id),
        "list": lambda: e.list_records(a.limit), "repos": e.repos, "stats": e.stats, "domains": e.domains, "dedup": e.detect_duplicates, "export": e.export,
    }[a.command]
    run().show(a.limit, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
