import numpy as np
from conftest import rows

from loomspan.llm.packing import best_fit, differencing, fewest, pack, pack_documents


def test_differencing_keeps_items_and_sums():
    rng = np.random.default_rng(0)
    for n, k in ((1, 1), (5, 2), (40, 7), (200, 13), (30, 40)):
        s = rng.integers(1, 500, n)
        sums, items = differencing(s, k)
        assert sorted(sum(items, [])) == list(range(n)) and len(items) <= k
        assert all(s[i].sum() == q for i, q in zip(items, sums))


def test_windows_are_near_equal():
    s = np.random.default_rng(1).integers(1, 300, 600)
    sums, _ = differencing(s, 20)
    assert sums.max() - sums.min() <= 5


def test_pack_is_valid_and_close_to_the_bound():
    rng = np.random.default_rng(2)
    for cap, hi in ((512, 511), (512, 120), (8192, 3000)):
        s = rng.integers(1, hi + 1, 1500)
        c = pack(s, cap)
        assert sorted(sum(c, [])) == list(range(1500)) and all(s[i].sum() <= cap for i in c)
        assert fewest(s, cap) <= len(c) <= len(best_fit(s, cap)) and len(c) <= 1.02 * fewest(s, cap) + 1
    assert pack(np.array([], int), 10) == [] and pack(np.array([10, 10]), 10) is not None


def test_documents(spark):
    long = "word " * 300
    data = [(1, None), (2, ""), (3, long), (4, "a b c"), (5, "a b c"), (5, "a b c")] + [(10 + i, "some words " * (i % 40 + 1)) for i in range(100)]
    d = spark.createDataFrame([(i, t, 9, "z") for i, t in data], "doc_id long, text string, n int, container string")
    targets = spark.createDataFrame([(1, "byte_bpe_50k", 128), (2, "byte_bpe_50k", 1000)], "target_id int, tokenizer string, capacity int")
    got = pack_documents(d, targets, shard_items=40).collect()
    size = {}
    for r in got:
        size[(r["target_id"], r["container"])] = size.get((r["target_id"], r["container"]), 0) + r["n_tokens"]
    cap = {1: 128, 2: 1000}
    assert all(v <= cap[t] for (t, _), v in size.items())
    for t in (1, 2):
        mine = [r for r in got if r["target_id"] == t]
        assert {r["doc_id"] for r in mine} == {i for i, _ in data} and sum(r["doc_id"] == 5 for r in mine) == 2
        three = sorted((r["piece"], r["token_from"], r["n_tokens"]) for r in mine if r["doc_id"] == 3)
        assert sum(n for _, _, n in three) == 301 and (len(three) == 3 if t == 1 else len(three) == 1)
    assert rows(pack_documents(d.where("false"), targets)) == []
    assert rows(pack_documents(d, targets.where("false"))) == []


def test_large_items_need_few_more_than_the_bound():
    """Items of about two fifths of the capacity, where near-equal windows exceed it."""
    rng = np.random.default_rng(5)
    s = np.concatenate([rng.integers(20, 200, 900), rng.integers(200, 512, 500), np.full(60, 340)])
    c = pack(s, 512)
    assert sorted(sum(c, [])) == list(range(len(s))) and all(s[i].sum() <= 512 for i in c)
    assert len(c) <= 1.01 * fewest(s, 512)


def test_containers_do_not_depend_on_the_order_of_rows(spark):
    data = [(i // 2, "some words " * (i % 37 + 1)) for i in range(200)]
    targets = spark.createDataFrame([(1, "byte_bpe_50k", 64)], "target_id int, tokenizer string, capacity int")
    one = pack_documents(spark.createDataFrame(data, "doc_id long, text string").coalesce(1), targets, shard_items=50)
    other = pack_documents(spark.createDataFrame(data[::-1], "doc_id long, text string").repartition(5), targets, shard_items=50)
    assert rows(one) == rows(other)
