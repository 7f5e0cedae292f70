"""Full-text search: inverted index, BM25, phrases, prefixes, facets (FT-*, FLT-*)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.text import ACCENTED, BARE, porter, porter_udf, search_tokens

K1, B, FLOOR = 1.2, 0.75, 1e-6
WEIGHTS = {"name": 5.0, "summary": 2.0, "domain": 1.0, "repo": 1.0}


@dataclass
class Index:
    """postings(term, id, field, tf, pos[]), lengths(id, dl); see write_index."""

    postings: DataFrame
    lengths: DataFrame
    stemmed: bool = False
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))

    def query_terms(self, query: str) -> list[str]:
        t = re.findall(r"[^\W_]+", query.lower().translate(str.maketrans(ACCENTED, BARE)))
        return [porter(x) for x in t] if self.stemmed else t


def build_index(docs: DataFrame, id_col: str, fields: list[str], stem: bool = False, weights: dict[str, float] | None = None) -> Index:
    """Terms and positions of every document.  Stemming runs on the distinct
    vocabulary only, not on the tokens."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), search_tokens(F.coalesce(f, F.lit(""))).alias("tokens")) for f in fields]))
    tokens = docs.select(F.col(id_col).alias("id"), each.alias("f")).select("id", "f.field", F.posexplode("f.tokens").alias("pos", "term"))
    if stem:
        stems = tokens.select("term").distinct().withColumn("stem", porter_udf("term"))
        tokens = tokens.join(stems, "term").select("id", "field", "pos", F.col("stem").alias("term"))
    postings = tokens.groupBy("term", "id", "field").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("pos"))
    sizes = sum((F.size(search_tokens(F.coalesce(f, F.lit("")))) for f in fields), F.lit(0))
    return Index(postings, docs.select(F.col(id_col).alias("id"), sizes.cast("long").alias("dl")), stem, weights or dict(WEIGHTS))


def write_index(index: Index, folder: str) -> None:
    """Writes an index as parquet, postings in ranges of terms and sorted by term.

    A search then reads only the row groups whose range holds its words or
    prefixes, as both conditions reach the scan.  A term that most documents hold
    is one range of its own or several, never one task's group."""
    index.postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{folder}/postings")
    index.lengths.write.mode("overwrite").parquet(f"{folder}/lengths")
    meta = index.postings.sparkSession.createDataFrame([(index.stemmed, index.weights)], "stemmed boolean, weights map<string, double>")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")


def read_index(spark: SparkSession, folder: str) -> Index:
    meta = spark.read.parquet(f"{folder}/meta").first()
    return Index(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/lengths"), meta["stemmed"], dict(meta["weights"]))


def _weight(weights: dict[str, float]) -> Column:
    w = F.lit(1.0)
    for f, x in weights.items():
        w = F.when(F.col("field") == f, F.lit(x)).otherwise(w)
    return w


def bm25(index: Index, query: str, mode: str = "any") -> DataFrame:
    """(id, score) of every document that matches.

    mode `any`: one of the words; `all`: all of them; `ref`: words w1..wk as
    "w1" OR (w1* AND "w2") OR ... OR wk*, where a part scores only in documents
    that satisfy it.  A query without a word has no hit.  Terms in more than half
    of the documents count almost nothing."""
    words = list(dict.fromkeys(index.query_terms(query))) if mode != "ref" else index.query_terms(query)
    spark = index.postings.sparkSession
    if not words:
        return spark.createDataFrame([], f"id {dict(index.lengths.dtypes)['id']}, score double")
    wtf = F.col("tf") * _weight(index.weights)
    if mode == "ref":
        parts = [("e", w) for w in words] + [("p", w) for w in words]
        hit = F.lit(False)
        for w in words:
            hit = hit | F.startswith("term", F.lit(w))
    else:
        parts = [("e", w) for w in words]
        hit = F.col("term").isin(words)
    is_part = [(F.col("term") == w) if k == "e" else F.startswith("term", F.lit(w)) for k, w in parts]
    f = index.postings.where(hit).groupBy("id").agg(*[F.sum(F.when(c, wtf)).alias(f"f{i}") for i, c in enumerate(is_part)])
    n = f.agg(*[F.count(f"f{i}").alias(f"n{i}") for i in range(len(parts))])  # one row
    total = index.lengths.agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"))  # one row
    d = f.join(index.lengths, "id").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(total))

    def part(i: int) -> Column:
        raw = F.log((F.col("N") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(raw <= 0, F.lit(FLOOR)).otherwise(raw)
        norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.col("avgdl"))
        return idf * F.col(f"f{i}") * F.lit(K1 + 1) / (F.col(f"f{i}") + norm)

    has = lambda i: F.col(f"f{i}").isNotNull()
    k = len(words)
    if mode == "ref":
        score = F.coalesce(part(0), F.lit(0.0))
        ok = has(0)
        for i in range(k - 1):
            both = has(k + i) & has(i + 1)
            score = score + F.when(both, part(k + i) + part(i + 1)).otherwise(F.lit(0.0))
            ok = ok | both
        score = score + F.coalesce(part(2 * k - 1), F.lit(0.0))
        ok = ok | has(2 * k - 1)
    else:
        score = sum((F.coalesce(part(i), F.lit(0.0)) for i in range(k)), F.lit(0.0))
        ok = has(0)
        for i in range(1, k):
            ok = (ok & has(i)) if mode == "all" else (ok | has(i))
    return d.where(ok).select("id", score.alias("score"))


def _back(i: int):
    return lambda x: x - i


def phrase(index: Index, query: str) -> DataFrame:
    """(id, field, hits): documents with the words next to each other."""
    words = index.query_terms(query)
    at = None
    for i, w in enumerate(words):
        p = index.postings.where(F.col("term") == w).select("id", "field", F.transform("pos", _back(i)).alias(f"p{i}"))
        at = p if at is None else at.join(p, ["id", "field"])
    if at is None:
        return index.postings.where("false").select("id", "field", F.lit(0).alias("hits"))
    meet = F.col("p0")
    for i in range(1, len(words)):
        meet = F.array_intersect(meet, F.col(f"p{i}"))
    return at.select("id", "field", F.size(meet).alias("hits")).where("hits > 0")


def without(hits: DataFrame, index: Index, query: str) -> DataFrame:
    """hits of documents that hold none of the query's words (NOT)."""
    bad = index.postings.where(F.col("term").isin(index.query_terms(query) or [""])).select("id").distinct()
    return hits.join(bad, "id", "left_anti")


def page(hits: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of hits by score, then id; a top-k without a full sort."""
    return hits.orderBy(F.desc("score"), "id").offset(offset).limit(limit)


def autocomplete(docs: DataFrame, id_col: str, name_col: str, prefix: str, limit: int = 10) -> DataFrame:
    """(id, name) of names with a word that starts with the prefix, shortest
    first; a prefix of fewer than two characters has none."""
    p = prefix.lower().strip()
    if len(p) < 2:
        return docs.where("false").select(F.col(id_col).alias("id"), F.col(name_col).alias("name"))
    hit = F.exists(search_tokens(F.coalesce(name_col, F.lit(""))), lambda t: F.startswith(t, F.lit(p)))
    return docs.where(hit).select(F.col(id_col).alias("id"), F.col(name_col).alias("name")).orderBy(F.length("name"), "name", "id").limit(limit)


def facets(rows: DataFrame, columns: list[str], id_col: str = "id", most: int = 20) -> DataFrame:
    """(facet, value, n): distinct ids of each value, the `most` frequent of each
    facet; all facets from one pass over the rows."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    n = rows.select(F.col(id_col).alias("id"), each.alias("f")).where("f.value IS NOT NULL AND f.value <> ''").groupBy("f.facet", "f.value").agg(F.count_distinct("id").alias("n"))
    from pyspark.sql import Window

    w = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    return n.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")
