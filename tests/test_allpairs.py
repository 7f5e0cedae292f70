import random
from difflib import SequenceMatcher

import pytest
from conftest import rows
from pyspark.sql import functions as F

from loomspan.operators import allpairs as B
from loomspan.operators import similarity as D
from loomspan.plans import catalogue, rules, similarity


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sets(seed, n, words, most):
    r = random.Random(seed)
    return [(f"{r.getrandbits(40):x}-{i}", sorted(set(r.choices(words, k=r.randint(0, most))))) for i in range(n)]


def near(x, y):
    """Jaccard index, rounded half up as in SQL."""
    both = len(set(x) & set(y))
    return int(both * 10**6 / (len(x) + len(y) - both) + 0.5) / 10**6 if both else 0.0


@pytest.mark.parametrize("most, letters", [(8, 12), (60, 70), (400, 500)])
def test_sets_over_several_blocks(spark, monkeypatch, most, letters):
    """Small, wide and very wide sets, some empty: the pairs of the cross join."""
    monkeypatch.setattr(B, "BLOCK", 40)
    data = sets(most, 130, [f"w{i}" for i in range(letters)], most)
    f = spark.createDataFrame(data, "id string, words array<string>")
    for least in (0.2, 0.5, 1.0):
        want = sorted((min(a, b), max(a, b), near(x, y)) for k, (a, x) in enumerate(data) for b, y in data[k + 1 :] if near(x, y) >= least)
        assert rows(B.similar_sets(f, "words", least, 6)) == want


def test_rounded_index_is_held_against_the_threshold(spark):
    f = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b", "c"])], "id long, words array<string>")
    assert rows(B.similar_sets(f, "words", 0.666667, 6)) == [(1, 2, 0.666667)] and not rows(B.similar_sets(f, "words", 0.666667))


def records(spark, n=150):
    r = random.Random(5)
    part = ["cost", "spot", "trace", "größe", "a b", "schedule" * 9, "x" * 70, "planning", "\U0001f600"]
    pick = lambda v, k: sorted(set(r.choices(v, k=r.randint(0, k))))
    words, caps = [f"w{i}" for i in range(25)], ["popular"] * 30 + [f"c{i}" for i in range(20)]
    data = [(f"{r.getrandbits(32):08x}{i}", "".join(r.choices(part, k=r.randint(0, 3))), pick(words, 12), pick(caps, 5), r.choice(["", None, "/", f"h{i // 2}"]), r.choice(["/", "", f"s{i // 3}", f"t{i}"])) for i in range(n)]
    return spark.createDataFrame(data, "id string, name_n string, words array<string>, caps array<string>, hash string, source string")


@pytest.mark.parametrize("score", [D.edit_ratio, D.ratio])
def test_records_over_several_blocks(spark, monkeypatch, score):
    """A capability that most records have, long and strange names, all kinds of
    missing keys, other weights: the pairs and scores of the cross join."""
    monkeypatch.setattr(B, "BLOCK", 50)
    f = records(spark).cache()
    cross = f.alias("a").join(f.alias("b"), F.col("a.id") < F.col("b.id")).select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))
    for least, w in ((0.4, None), (0.25, None), (0.6, {"name": 0.1, "summary": 0.0, "caps": 0.6, "content": 0.2, "source": 0.1})):
        want = D.score_pairs(f, cross, w, score).where(F.col("overall") >= least)
        assert rows(D.detect_duplicates(f, least, w, score)) == rows(want) and want.count() > 20


def test_hash_of_a_slash_is_a_hash(spark):
    """SQL leaves out `/` for the source only."""
    f = spark.createDataFrame([("a", "x", ["p"], [], "/", "/"), ("b", "y", ["k"], [], "/", "/")], "id string, name_n string, words array<string>, caps array<string>, hash string, source string")
    assert [(r["content"], r["source"], r["overall"]) for r in D.detect_duplicates(f).collect()] == [(1.0, 0.0, 0.99)]


def test_matching_blocks_of_equal_names_once(spark):
    f = spark.createDataFrame([("abcd", "bcde")] * 3 + [("", "x")], "a string, b string")
    assert [r[0] for r in f.select(D.ratio("a", "b")).collect()] == [SequenceMatcher(None, "abcd", "bcde").ratio()] * 3 + [0.0]


@pytest.mark.parametrize("name", ["dedup_jaccard", "dedup_classes", "dedup_full_edit", "dedup_full", "edges_bidirectional"])
def test_no_candidate_pair_is_shuffled(spark, small_dir, name):
    """pairs come from the blocks of the records, not from a join."""
    p = plan(similarity.QUERIES[name](spark, small_dir))
    assert "MapInArrow" in p and "Join" not in p


@pytest.mark.parametrize("name", ["rec_facets", "rec_popular", "rec_for_record", "rec_union_max"])
def test_no_candidate_pair_is_shuffled_to_recommend(spark, small_dir, monkeypatch, name):
    """F4, F5, F8, F9: likewise for what the recommendations are made of."""
    seen, cut = [], catalogue.cut_lineage
    monkeypatch.setattr(catalogue, "cut_lineage", lambda d: (seen.append((d.columns, plan(d))), cut(d))[1])
    catalogue.QUERIES[name](spark, small_dir)
    pairs = [p for c, p in seen if c == ["id", "other", "overall"]]
    assert pairs and all("MapInArrow" in p and "Join" not in p for p in pairs)


def test_repeated_names_over_several_blocks(spark, monkeypatch):
    """Names that many records have, near and far ones, so that names are compared
    first; with and without something in common: the pairs of the cross join."""
    monkeypatch.setattr(B, "BLOCK", 60)
    r = random.Random(9)
    names = ["tracesampling", "tracesamplings", "tracesampler", "trace", "darktheme", "themedark", "x" * 80, "x" * 79 + "y", "", None]
    words, caps = [f"w{i}" for i in range(9)], [f"c{i}" for i in range(40)]
    pick = lambda v, k: sorted(set(r.choices(v, k=r.randint(0, k))))
    data = [(f"{r.getrandbits(32):08x}{i}", r.choice(names), pick(words, 8), pick(caps, 3), f"h{i // 2}" if i % 9 == 0 else None, "/") for i in range(240)]
    f = spark.createDataFrame(data, "id string, name_n string, words array<string>, caps array<string>, hash string, source string").cache()
    cross = f.alias("a").join(f.alias("b"), F.col("a.id") < F.col("b.id")).select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))
    want = D.score_pairs(f.fillna("", "name_n"), cross, None, D.edit_ratio).where("overall >= 0.4")
    assert rows(D.detect_duplicates(f, 0.4, None, D.edit_ratio)) == rows(want) and want.where("caps = 0 AND content = 0").count() > 100


def of_blocks(p):
    """The plan reads two blocks for each task and writes no record once for each block."""
    return "CartesianProduct" in p and "sequence(" not in p


@pytest.mark.parametrize("name", ["dedup_classes", "edges_bidirectional", "dedup_full_edit"])
def test_records_are_shuffled_once(spark, small_dir, name):
    """F2, F3, F7"""
    assert of_blocks(plan(similarity.QUERIES[name](spark, small_dir)))


@pytest.mark.parametrize("name", ["rec_union_max", "rec_for_record", "rec_popular", "rec_facets"])
def test_records_are_shuffled_once_to_recommend(spark, small_dir, monkeypatch, name):
    """F4, F5, F8, F9: likewise for the pairs that a recommendation reads."""
    seen, cut = [], catalogue.cut_lineage
    monkeypatch.setattr(catalogue, "cut_lineage", lambda d: (seen.append((d.columns, plan(d))), cut(d))[1])
    catalogue.QUERIES[name](spark, small_dir)
    pairs = [p for c, p in seen if c == ["id", "other", "overall"]]
    assert pairs and all(of_blocks(p) for p in pairs)


@pytest.mark.parametrize("block", [50, 1000])
def test_pairs_of_ends(spark, monkeypatch, block):
    """with ends, all pairs that hold one and no other, also where a block has both kinds."""
    monkeypatch.setattr(B, "BLOCK", block)
    f = records(spark).cache()
    every = D.detect_duplicates(f, 0.4, None, D.edit_ratio).cache()
    for end in ("id LIKE '%7'", "id < '8'", "false", "true"):
        ends = f.withColumn("end", F.when(F.expr(end), True))  # null is no end
        want = every.where(f"{end.replace('id', 'a')} OR {end.replace('id', 'b')}")
        assert rows(D.detect_duplicates(ends, 0.4, None, D.edit_ratio)) == rows(want)


@pytest.mark.parametrize("name", ["rec_union_max", "rec_facets", "rec_popular"])
def test_only_pairs_of_installed_records_are_made(spark, monkeypatch, name):
    """the pairs of the installed records, all of them."""
    sf, seen, call = "/root/testdata/sf0.01", [], catalogue.C.recommend
    monkeypatch.setattr(catalogue.C, "recommend", lambda d, task, installed, pairs, *a: (seen.append((installed, pairs)), call(d, task, installed, pairs, *a))[1])
    catalogue.QUERIES[name](spark, sf)
    installed, pairs = seen[0]
    here = {r["id"] for r in installed.collect()}
    every = D.both_ways(similarity.similar(spark, sf))
    assert rows(pairs) == [r for r in rows(every) if here & set(r[:2])] and 0 < pairs.count() < every.count()


def test_only_current_texts_are_scored(spark, small_dir, monkeypatch):
    """the quality of a record is told from its current version alone."""
    seen, call = [], rules.Q.score_versions
    monkeypatch.setattr(rules.Q, "score_versions", lambda v, *a: (seen.append(v), call(v, *a))[1])
    found = rows(catalogue._quality(spark, small_dir).select("id", "overall"))
    current = catalogue.docs(spark, small_dir).select("id")
    assert seen[0].count() == current.count() == len(found)
    assert found == rows(rules.scored(spark, small_dir).join(current, "id").select("id", "overall"))


def best_of(pairs, ends, most):
    """The pairs(a, b, overall) that are among the best of an end, and their ends, by hand."""
    of = {}
    for a, b, x in pairs:
        for end, other in ((a, b), (b, a)):
            of.setdefault(end, []).append((-x, other, (a, b, x)))
    return sorted({p for end in ends for *_, p in sorted(of.get(end, []))[:most]})


@pytest.mark.parametrize("block, score", [(50, D.edit_ratio), (50, D.ratio), (1000, D.edit_ratio)])
def test_best_pairs_of_ends(spark, monkeypatch, block, score):
    """the best pairs of each end, ties by the lesser id; also where many
    records have one content, one source, one name, or one capability alone."""
    monkeypatch.setattr(B, "BLOCK", block)
    monkeypatch.setattr(B, "HELD", 2_000)
    f = records(spark)
    third = lambda c, v, k: F.when(F.crc32("id") % 3 == k, F.lit(v)).otherwise(F.col(c))
    kinds = {
        "as it is": f,
        "content": f.withColumn("hash", third("hash", "one", 0)),
        "source": f.withColumn("source", third("source", "one", 1)).withColumn("name_n", F.when(F.crc32("name_n") % 2 == 0, F.lit("planning")).otherwise(F.col("name_n"))),
        "capability": f.withColumn("caps", F.when(F.crc32("id") % 3 == 2, F.array(F.lit("popular"))).otherwise(F.col("caps"))),
    }
    for kind in kinds.values():
        kind = kind.cache()
        every = rows(D.detect_duplicates(kind, 0.4, None, score).select("a", "b", "overall"))
        for end, most in (("id LIKE '%7'", 1), ("id LIKE '%7'", 5), ("id < '8'", 5)):
            of, ends = kind.where(end).select("id"), kind.withColumn("end", F.when(F.expr(end), True))
            found = D.nearest(D.detect_duplicates(ends, 0.4, None, score, most), of, most)
            assert rows(found) == best_of(every, [r["id"] for r in of.collect()], most)


@pytest.fixture(scope="module")
def one_content(spark, tmp_path_factory, small_dir):
    """Tables of which all versions have the same content hash."""
    sf = tmp_path_factory.mktemp("one_content")
    for t in ("skills", "capabilities", "tags"):
        (sf / f"{t}.parquet").symlink_to(f"{small_dir}/{t}.parquet")
    spark.read.parquet(f"{small_dir}/versions.parquet").withColumn("source_content_hash", F.lit("one")).write.parquet(f"{sf}/versions.parquet")
    return str(sf)


@pytest.mark.parametrize("name", ["rec_facets", "rec_union_max"])
def test_pairs_of_one_content_are_not_written_one_by_one(spark, one_content, monkeypatch, name):
    """no more pairs than the recommender reads, and what all of them give."""
    seen, call = [], catalogue.C.recommend
    monkeypatch.setattr(catalogue.C, "recommend", lambda *a: (seen.append(a), call(*a))[1])
    found = catalogue.QUERIES[name](spark, one_content)
    d, task, installed, pairs, limit = seen[0]
    every, n = D.both_ways(similarity.similar(spark, one_content)), installed.count()
    here = every.join(installed, "id", "left_semi")
    assert n and pairs.count() <= 2 * catalogue.C.NEAREST * n < here.count()
    want = call(d, task, installed, every, limit)
    want = want.groupBy("reason").agg(F.count("*").alias("n")) if name == "rec_facets" else want.select("id", F.round("score", 6).alias("score"), "reason")
    assert rows(found) == rows(want) and want.where("reason = 'similar'").count()
