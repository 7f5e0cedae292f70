from datetime import datetime as T

from conftest import rows

from loomspan.operators.snapshot_diff import latest_records, logged_changes, snapshot_changes

SCHEMA = "snapshot_no int, sync_id string, skill_id string, source_path string, source_commit_sha string, source_content_hash string, loaded_at timestamp, key string, r string"


def snaps(spark, data):
    """(no, skill, path, commit, hash, minute); with columns that clash."""
    return spark.createDataFrame([(n, f"s{n}", k, p, c, h, None if m is None else T(2025, 1, 1, 0, m), "x", "y") for n, k, p, c, h, m in data], SCHEMA)


def found(df):
    return rows(df.select("snapshot_no", "skill_id", "change_type"))


def test_kinds_of_change(spark):
    d = snaps(spark, [
        (1, "a", "p", "c1", "h1", 0), (2, "a", "p", "c2", "h1", 0),  # a new commit alone
        (1, "b", "p", "c1", "h1", 0), (2, "b", "q", "c1", " SHA256:H2\n", 0),  # both
        (1, "c", "p", "c1", "sha256:H1", 0), (2, "c", "p", "c1", "h1 ", 0),  # spelling only
        (1, "d", "p", "c1", "h1", 0),  # removed
        (2, "e", None, None, None, 0),  # added
        (1, "f", "p", "abc", None, 0), (2, "f", "p", "ABCDEF", "h", 0),  # same commit
        (1, "g", "p", "abc", None, 0), (2, "g", "p", "abd", "h", 0),
        (1, "h", None, None, None, 0), (2, "h", None, None, None, 0),  # unknown differs
        (3, "a", "p", "c2", "h1", 0),
    ])
    got = found(snapshot_changes(d).where("snapshot_no = 2"))
    assert got == sorted([(2, "b", "MODIFIED"), (2, "b", "MOVED"), (2, "d", "REMOVED"), (2, "e", "ADDED"), (2, "g", "MODIFIED"), (2, "h", "MODIFIED")], key=repr)
    assert (3, "b", "REMOVED") in found(snapshot_changes(d))


def test_latest_row_counts_and_ties(spark):
    d = snaps(spark, [(1, "a", "p", "c", "h1", 5), (1, "a", "q", "c", "h2", 1), (1, "a", "z", "c", "h9", None), (1, "b", "p", "c", "h1", 1), (1, "b", "p", "c", "h2", 1), (1, None, "p", "c", "h", 1)])
    assert rows(latest_records(d).select("skill_id", "hash", "path")) == [("a", "h1", "p"), ("b", "h2", "p")]


def test_gap_between_deliveries_and_repeats(spark):
    d = snaps(spark, [(1, "a", "p", "c", "h1", 0), (3, "a", "p", "c", "h2", 0)] * 3)
    assert found(snapshot_changes(d)) == []


def test_logged(spark):
    d = snaps(spark, [(1, "a", "p", "c", None, 0), (2, "a", "q", "d", "h2", 0), (2, "b", "p", "c", "h", 0)])
    log = spark.createDataFrame(
        [("s2", "a", " modified ", None), ("s2", "a", "MOVED", "other"), ("s2", "b", "added\n", "anything"), ("s2", "b", "ADDED", None), ("s9", "a", "MOVED", "p"), (None, None, None, None)],
        "sync_id string, entity_id string, change_type string, old_value string",
    )
    got = rows(logged_changes(snapshot_changes(d), log).select("skill_id", "change_type", "logged"))
    assert got == [("a", "MODIFIED", 1), ("a", "MOVED", 0), ("b", "ADDED", 1)]


def test_empty(spark):
    assert found(snapshot_changes(snaps(spark, []))) == []
