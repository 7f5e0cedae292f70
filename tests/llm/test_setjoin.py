import random

import pytest
from conftest import rows

from loomspan.llm import setjoin
from loomspan.llm.setjoin import need, record_sets, similar_classes, similar_pairs


def brute(sets, t, least):
    s = [(i, set(x)) for i, x in sets if len(set(x)) >= least]
    return sorted((a, b) for n, (a, x) in enumerate(s) for b, y in s[n + 1 :] if len(x & y) / len(x | y) >= t - 1e-12)


def make(seed, n, biggest):
    """Sets around a few centres, with a hot value, copies and many sizes."""
    r = random.Random(seed)
    centres = [[f"v{r.randrange(400)}" for _ in range(r.randint(4, biggest))] for _ in range(12)]
    out = []
    for i in range(n):
        c = set(r.choice(centres)) | {"hot"}
        for _ in range(r.randint(0, 3)):
            c ^= {f"v{r.randrange(400)}"}
            if r.random() < 0.5:
                c.discard(next(iter(sorted(c))))
        out.append((i, sorted(c)))
    return out + [(n + i, out[0][1]) for i in range(15)]


@pytest.mark.parametrize("seed,biggest,budget", [(1, 8, 300), (2, 14, 300), (3, 40, 300), (4, 12, 5)])
def test_equals_brute_force(spark, seed, biggest, budget):
    data = make(seed, 150, biggest)
    sets = spark.createDataFrame(data, "id long, tokens array<string>").where("size(tokens) >= 4")
    members, links = similar_classes(sets, 0.7, 4, budget)
    m = dict(rows(members))
    got = {tuple(sorted(p)) for p in rows(links)}
    want = brute(data, 0.7, 4)
    assert {tuple(sorted((m[a], m[b]))) for a, b in want if m[a] != m[b]} == got
    assert sorted(rows(similar_pairs(sets))) == want


def test_need_is_tight():
    for n in range(4, 30):
        for m in range(n, 45):
            t = need(n, m, 0.7)
            assert t / (n + m - t) >= 0.7 - 1e-9 and (t - 1) / (n + m - t + 1) < 0.7


def test_values(spark):
    c = spark.createDataFrame([(1, " Data__Flow ", "x"), (1, "data flow", "x"), (1, None, "x"), (1, "  ", "x"), (None, "a", "x")], "fk long, v string, id string")
    t = spark.createDataFrame([(1, "data-flow"), (1, "b"), (1, "c"), (2, "c")], "fk long, v string")
    assert rows(record_sets([(c, "fk", "v"), (t, "fk", "v")], 2)) == [(1, ["0:data-flow", "1:b", "1:c", "1:data-flow"])]
    assert similar_pairs(record_sets([(c, "fk", "v")], 4)).count() == 0


def test_threshold_one_and_hot_sets(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "HOT", 5)
    data = make(6, 40, 8)
    sets = spark.createDataFrame(data, "id long, tokens array<string>").where("size(tokens) >= 4")
    assert sorted(rows(similar_pairs(sets, 1.0))) == brute(data, 1.0, 4)
    assert sorted(rows(similar_pairs(sets))) == brute(data, 0.7, 4)
