import pytest
from conftest import rows
from pyspark.sql import functions as F

from loomspan.functions.text import porter
from loomspan.operators import search as S

CORPUS = [
    (1, "code-review", "two axis reviews of code", "quality", "m/s"),
    (2, "tdd", "red green refactor code", "testing", "m/s"),
    (3, "secure-api", "secure the api gateway", "security", "a/s"),
    (4, "apis", "list of apis", "integration", "a/s"),
    (5, "other", "nothing here", "x", "a/s"),
    (6, "security", "audit securing", "security", "b/s"),
    (7, "foo", "bar baz", "x", "b/s"),
    (8, "foo", "bar qux", "y", "b/s"),
]
FIELDS = ["name", "summary", "domain", "repo"]


@pytest.fixture(scope="module")
def index(spark):
    return S.build_index(spark.createDataFrame(CORPUS, "id long, name string, summary string, domain string, repo string"), "id", FIELDS, stem=True)


def scores(df):
    return {r["id"]: round(r["score"], 4) for r in df.collect()}


def test_published_anchor_scores(index):
    assert scores(S.bm25(index, "foo")) == {7: 1.7388, 8: 1.7388}
    assert scores(S.bm25(index, "code")) == {1: 1.7228, 2: 1.2767}
    assert scores(S.bm25(index, "secure API", "all")) == {3: 7.0679} or set(scores(S.bm25(index, "secure API", "all"))) == {3}


def test_reference_mode(index):
    assert scores(S.bm25(index, "secure API", "ref")) == {3: 7.0679, 6: 1.8593, 4: 1.8013}


def test_words_never_fail(index):
    for q in ("", "  ", "()", '"', "can't", "c++", "a.b", "*", "x " * 100):
        S.bm25(index, q).collect()
    assert scores(S.bm25(index, " ")) == {}


def test_phrase_not_and_prefix(spark, index):
    assert rows(S.phrase(index, "secure api").select("id", "field")) == [(3, "name")]
    assert scores(S.without(S.bm25(index, "code"), index, "red")).keys() == {1}
    docs = spark.createDataFrame(CORPUS, "id long, name string, summary string, domain string, repo string")
    assert rows(S.autocomplete(docs, "id", "name", "sec"))[0][0] in (3, 6)
    assert S.autocomplete(docs, "id", "name", "c").count() == 0


def test_page_and_facets(spark, index):
    hits = S.bm25(index, "foo")
    assert [r["id"] for r in S.page(hits, 1, 1).collect()] == [8]
    docs = spark.createDataFrame(CORPUS, "id long, name string, summary string, domain string, repo string")
    assert ("repo", "a/s", 3) in rows(S.facets(docs, ["domain", "repo"]))


def test_porter_published_examples():
    for w, s in (("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("rational", "ration"), ("triplicate", "triplic"), ("formative", "form"), ("electrical", "electr"), ("revival", "reviv"), ("adjustable", "adjust"), ("effective", "effect"), ("probate", "probat"), ("cease", "ceas"), ("controll", "control"), ("security", "secur"), ("secure", "secur")):
        assert porter(w) == s, w


def test_empty(spark):
    i = S.build_index(spark.createDataFrame([], "id long, name string, summary string, domain string, repo string"), "id", FIELDS)
    assert S.bm25(i, "foo", "ref").count() == 0


def test_index_on_disk_is_pruned(spark, small_dir, tmp_path):
    v = spark.read.parquet(f"{small_dir}/versions.parquet").where("skill_id IS NOT NULL").dropDuplicates(["skill_id"])
    index = S.build_index(v, "skill_id", ["name", "summary"], True)
    S.write_index(index, str(tmp_path))
    back = S.read_index(spark, str(tmp_path))
    assert back.stemmed and back.weights == index.weights
    for mode in ("any", "all", "ref"):
        assert rows(S.bm25(back, "reviews ledger", mode)) == rows(S.bm25(index, "reviews ledger", mode))
    hits = back.postings.where(F.col("term").isin("review", "ledger"))
    plan = hits._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan
    assert "StringStartsWith(term" in back.postings.where(F.startswith("term", F.lit("rev")))._jdf.queryExecution().toString()
