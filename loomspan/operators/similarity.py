"""Similarity of records in five dimensions, with exact blocking (DD-*, ST-*).

overall = .30 name + .20 summary + .35 capabilities + .10 content + .05 source.
Pairs are found block by block (see allpairs); names are compared only where the
other dimensions and the letters that two names share leave the pair a chance,
and no pair of the cross join is lost.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomspan.functions.text import name_key, word_set
from loomspan.operators.allpairs import ALIKE, CONTENT, SOURCE, similar_records

WEIGHTS = {"name": 0.30, "summary": 0.20, "caps": 0.35, "content": 0.10, "source": 0.05}
CLASSES = ((0.95, "EXACT_DUPLICATE"), (0.80, "NEAR_DUPLICATE"), (0.60, "FUNCTIONAL_OVERLAP"), (0.40, "RELATED"))


def fingerprints(versions: DataFrame, capabilities: DataFrame, id_col: str = "skill_id") -> DataFrame:
    """(id, name_n, words[], caps[], hash, source) of each record; the capability
    is its canonical form, else its lower-case name."""
    caps = (
        capabilities.where("version_id_fk IS NOT NULL")
        .select(F.col("version_id_fk").alias("v"), F.coalesce("canonical", F.lower(F.trim("name"))).alias("c"))
        .where("c IS NOT NULL")
        .groupBy("v")
        .agg(F.array_sort(F.collect_set("c")).alias("caps"))
    )
    none = F.array().cast("array<string>")
    v = versions.join(caps, versions["id"] == caps["v"], "left")
    return v.select(
        F.col(id_col).alias("rid"),
        name_key(F.coalesce("name", F.lit(""))).alias("name_n"),
        F.array_sort(word_set(F.coalesce("summary", F.lit("")))).alias("words"),
        F.coalesce("caps", none).alias("caps"),
        F.col("source_content_hash").alias("hash"),
        F.lower(F.concat_ws("/", F.coalesce("source_repo", F.lit("")), F.coalesce("source_path", F.lit("")))).alias("source"),
    ).withColumnRenamed("rid", "id")


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b|; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; there is no built-in, so it runs on
    candidate pairs only, vectors of pairs at a time, once for equal pairs."""
    seen = {(x, y): SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in set(zip(a, b))}
    return pd.Series([seen[p] for p in zip(a, b)], dtype=float)


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, as a built-in stand-in for `ratio`."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def classify(score: Column) -> Column:
    out = F.lit("UNRELATED")
    for least, name in reversed(CLASSES):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return out


def score_pairs(f: DataFrame, pairs: DataFrame, weights: dict[str, float] | None = None, name_score=ratio) -> DataFrame:
    """(a, b, name, summary, caps, content, source, overall, class) of pairs(x, y)."""
    a = f.select(*[F.col(c).alias(f"a_{c}") for c in f.columns])
    b = f.select(*[F.col(c).alias(f"b_{c}") for c in f.columns])
    j = pairs.join(a, F.col("x") == F.col("a_id")).join(b, F.col("y") == F.col("b_id"))
    same = lambda c, *none: F.when((F.col(f"a_{c}") == F.col(f"b_{c}")) & ~F.col(f"a_{c}").isin(*none), 1.0).otherwise(0.0)
    d = j.select(
        F.col("x").alias("a"),
        F.col("y").alias("b"),
        "a_name_n",
        "b_name_n",
        jaccard(F.col("a_words"), F.col("b_words")).alias("summary"),
        jaccard(F.col("a_caps"), F.col("b_caps")).alias("caps"),
        same("hash", "").alias("content"),
        same("source", "", "/").alias("source"),
    )
    return _overall(d, weights or WEIGHTS, name_score)


def _overall(d: DataFrame, w: dict[str, float], name_score) -> DataFrame:
    """The name's score, the weighted sum with its two overrides, and the class."""
    d = d.withColumn("name", name_score(F.col("a_name_n"), F.col("b_name_n")))
    total = w["name"] * F.col("name") + w["summary"] * F.col("summary") + w["caps"] * F.col("caps") + w["content"] * F.col("content") + w["source"] * F.col("source")
    total = F.when(F.col("content") == 1, F.greatest(total, F.lit(CONTENT))).otherwise(total)
    total = F.when((F.col("source") == 1) & (F.col("name") > ALIKE), F.greatest(total, F.lit(SOURCE))).otherwise(total)
    return d.select("a", "b", "name", "summary", "caps", "content", "source", total.alias("overall")).withColumn("class", classify(F.col("overall")))


def detect_duplicates(f: DataFrame, least: float = 0.40, weights: dict[str, float] | None = None, name_score=ratio, most: int | None = None) -> DataFrame:
    """All pairs with overall >= least; with a column `end` in f, all of which one
    record at least is an end; with `most`, the `most` best of each end and maybe
    others (see nearest)."""
    w = weights or WEIGHTS
    return _overall(similar_records(f, least, w, most), w, name_score).where(F.col("overall") >= least)


def nearest(pairs: DataFrame, of: DataFrame, most: int) -> DataFrame:
    """(a, b, overall): the pairs that are among the `most` best of a record in
    of(id), by overall and then the lesser other id.  Each task keeps its best
    before the shuffle (a group limit), so few pairs are written."""
    w = Window.partitionBy("id").orderBy(F.desc("overall"), "other")
    n = both_ways(pairs).join(of, "id", "left_semi").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    return n.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "overall").distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    """(id, other, overall): each pair from both of its ends, in one pass."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other"))))
    return pairs.select("overall", ends.alias("e")).select("e.id", "e.other", "overall")


def exact_copies(versions: DataFrame, text: str = "raw_content") -> DataFrame:
    """(copy, n): groups of records with the same text, by its least id."""
    return versions.where(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("h")).agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("first_id", "n")
