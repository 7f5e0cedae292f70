import random
from datetime import datetime as T
from datetime import timedelta as D

import numpy as np
import pytest
from conftest import rows

from loomspan.operators.history import merge_runs, periods, skill_history


def test_merged_runs_equal_neighbour_compare():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 256, 1000):
        e, p = np.sort(rng.integers(0, 5, n)), rng.integers(0, 2, n)
        want = np.ones(n, bool)
        want[1:] = (e[1:] != e[:-1]) | (p[1:] != p[:-1])
        assert (merge_runs(e, p, p) == want).all()
    # runs that begin with one payload and end with another
    first, last = np.array(list("abbcaa")), np.array(list("bbcaab"))
    assert merge_runs(np.zeros(6, int), first, last).tolist() == [True, False, False, False, False, False]
    assert merge_runs(np.array([0, 0, 1, 1, 1, 2]), first, last).tolist() == [True, False, True, False, False, True]


@pytest.mark.parametrize("ranges", [1, 4, 40])
def test_periods_over_blocks_and_batches(spark, ranges):
    """A hot entity is spread over blocks; the result does not depend on them."""
    random.seed(ranges)
    units = [("hot", t, t * 10, random.choice("aab")) for t in range(0, 300)] + [(f"e{i}", t, i * 1000 + t, random.choice("xy")) for i in range(20) for t in random.sample(range(50), 4)]
    df = spark.createDataFrame(units, "entity string, at long, row long, payload string").repartition(3)
    want = []
    for e in {u[0] for u in units}:
        mine = sorted(u for u in units if u[0] == e)
        starts = [u for i, u in enumerate(mine) if i == 0 or u[3] != mine[i - 1][3]]
        want += [(e, u[2], u[1], starts[i + 1][1] if i + 1 < len(starts) else None) for i, u in enumerate(starts)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        assert rows(periods(df).select("entity", "row", "at", "next_at")) == sorted(want, key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


V = "id long, skill_id string, version_id string, imported_at timestamp_ntz, last_checked_at timestamp_ntz, name string, summary string, domain_primary string, entity string, row string"
S = "id string, is_current boolean, last_updated_at timestamp_ntz"


def day(n):
    return None if n is None else T(2025, 1, 1) + D(days=n)


def history(spark, versions, skills):
    v = spark.createDataFrame([(i, s, w, day(a), day(c), n, None, "d", "x", "y") for i, s, w, a, c, n in versions], V)
    s = spark.createDataFrame([(i, c, day(u)) for i, c, u in skills], S)
    return rows(skill_history(v, s))


def test_history_rules(spark):
    got = history(
        spark,
        [
            (1, "a", "v1", 0, 1, "n"), (2, "a", "v1", 3, 9, "m"),  # delivered again: the last checked counts
            (3, "a", "v2", 4, None, "m"), (4, "a", "v3", 5, None, None), (5, "a", "v4", None, 6, None),  # null equals null
            (6, "a", "v5", 7, 8, "n"), (7, "a", "v6", 7, 2, "k"),  # one instant: the greatest id
            (8, "b", None, 1, 20, "n"), (9, "b", None, 2, 3, "n"),
            (10, "c", "x", None, None, "n"), (11, None, "y", 1, 1, "n"),
        ],
        [("a", True, 1), ("a", False, None), ("b", True, 1), ("b", False, 2)],
    )
    f = lambda n: day(n).strftime("%Y-%m-%d %H:%M:%S")
    assert got == [("a", 2, f(3), f(5)), ("a", 4, f(5), f(7)), ("a", 7, f(7), "open"), ("b", 8, f(1), f(20))]


def test_last_period_never_ends_before_it_starts(spark):
    assert history(spark, [(1, "a", "v", 5, None, "n")], [])[0][2:] == (day(5).strftime("%Y-%m-%d %H:%M:%S"),) * 2
