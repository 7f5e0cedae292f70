import importlib

import pytest

import __spark_entry__ as entry


def core_queries():
    out = {}
    for m in entry._MODULES:
        if ".llm." not in m:
            out.update(importlib.import_module(m).QUERIES)
    return out


def test_every_core_query_on_empty_tables(spark, empty_dir):
    """No query fails on tables without rows."""
    for name, q in core_queries().items():
        try:
            q(spark, empty_dir).collect()
        except Exception as e:  # noqa: BLE001
            pytest.fail(f"{name}: {str(e)[:500]}")


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark, small_dir):
    plan = core_queries()["scan_project_filter"](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(p_size" in plan and "p_brand" not in plan


def test_no_cross_join_without_a_bound(spark, small_dir):
    for name in ("dedup_full_edit", "p4_found", "facets_all"):
        plan = core_queries()[name](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
