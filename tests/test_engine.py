import pytest

from loomspan.engine import Engine, RateLimiter, ResultCache, benchmark, plan_lint


@pytest.fixture(scope="module")
def engine(spark, small_dir):
    return Engine(spark, small_dir)


def test_commands(engine, spark, small_dir):
    assert engine.stats().count() == 5 and engine.domains().count() > 1
    some = engine.list_records(3).collect()
    assert len(some) == 3 and engine.get_record(some[0]["skill_id"]).count() == 1 and engine.get_record("none").count() == 0
    dom = some[0]["domain"]
    assert all(r["domain"] == dom for r in engine.list_records(5, domain=dom).collect())
    assert {r["id"] for r in engine.search("ledger export", domain="data").collect()} <= {r["skill_id"] for r in engine.records(domain="data").collect()}
    assert engine.records(max_risk="LOW").count() <= engine.records(max_risk="HIGH").count() <= engine.records().count()
    assert engine.autocomplete("re").count() > 0 and engine.by_capability("review").count() >= 0
    assert engine.recommend("review the data").count() > 0 and engine.repos().count() == 240
    assert engine.export().count() == engine.records().count()
    assert engine.agent_fit().count() == 7 * engine.versions().count()
    assert engine.dependency_graph().count() >= 0


def test_filters_and_composition(engine):
    every = engine.records().count()
    assert engine.records(is_current=True).count() + engine.records(is_current=False).count() == every
    assert engine.records(has_mcp=True).count() + engine.records(has_mcp=False).count() == every
    assert engine.records(min_quality=0.0).count() == every and engine.records(min_quality=1.1).count() == 0
    assert engine.records(lifecycle="archived").join(engine.records(), "skill_id").count() == 0
    ids = [r["skill_id"] for r in engine.list_records(2).collect()]
    c = engine.compose([*ids, "none"]).first()
    assert c["order"] == [*ids, "none"] and c["errors"] == 1 and not c["valid"]
    assert engine.recommend_for(ids[0]).where(f"id = '{ids[0]}'").count() == 0


def test_plans(engine):
    assert plan_lint(engine.domains()) == []
    assert benchmark("x", engine.domains, 2)["min"] > 0


def test_cache_and_limits():
    now = [0.0]
    c = ResultCache(2, 10, lambda: now[0])
    c.put("a1", 1), c.put("a2", 2), c.get("a1"), c.put("b", 3)
    assert c.get("a2") is None and c.get("a1") == 1 and c.drop("a") == 1
    now[0] = 11
    assert c.get("b") is None and (c.hits, c.misses) == (2, 2)
    now[0] = 0
    r = RateLimiter(2, 60, lambda: now[0])
    assert [r.admit("k") for _ in range(3)] == [True, True, False] and r.admit("j")
    now[0] = 61
    assert r.admit("k")
