import pytest

from loomspan.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    q = queries.QUERIES[name](spark, empty_dir)
    n = q.count()
    assert n == 0 or name == "p3_found"


def test_columns(spark, small_dir):
    want = {"p1_found": "id kind element n", "p2_found": "version_a version_b", "p3_found": "scope entity license status", "p5_found": "id canonical", "p8_ids": "doc_id ids", "p10_found": "doc_id kind found"}
    for name, cols in want.items():
        assert queries.QUERIES[name](spark, small_dir).columns == cols.split(), name
