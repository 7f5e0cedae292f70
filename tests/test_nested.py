import json
import random

import pytest
from conftest import rows

from loomspan.operators.nested import EMPTY_LIST, EMPTY_OBJECT, nested_children, pivot, placed, scan


def children(spark, **cols):
    row = [(1, cols.get("r"), cols.get("c"), cols.get("s"), "x")]
    df = spark.createDataFrame(row, "id long, runtime_requirements string, compatibility string, security string, child string")
    return [tuple(r)[1:] for r in sorted(nested_children(df).collect())]


def test_requirements(spark):
    got = children(spark, r=json.dumps({"tools": ["a", None, {"name": "b"}, {}, {"name": ""}, {"name": None}], "apis": [{"name": "x", "credentials": {"env_vars": ["K", {"name": "L"}]}}, {"credentials": {"env_vars": ["M"]}}], "packages": [{"name": "p", "extras": ["e", "f"]}], "env_vars": None, "runtimes": ["jvm"]}))
    assert got == sorted([("tool", "", 0, "a"), ("tool", "", 2, "b"), ("api", "", 0, "x"), ("env_var", "x", 0, "K"), ("env_var", "x", 1, "L"), ("env_var", "", 0, "M"), ("package", "", 0, "p"), ("extra", "p", 0, "e"), ("extra", "p", 1, "f"), ("runtime", "", 0, "jvm")])


def test_compatibility_shapes(spark):
    assert children(spark, c='{"entries":[{"target":"a","blockers":["x"]},{"level":"L"},"c"],"agents":{"z":{}}}') == [("blocker", "a", 0, "x"), ("target", "", 0, "a"), ("target", "", 2, "c")]
    assert children(spark, c='{"agents":{"a":{"level":"L","blockers":["x","y"]},"b":{}}}') == [("blocker", "a", 0, "x"), ("blocker", "a", 1, "y"), ("target", "", -1, "a"), ("target", "", -1, "b")]
    assert children(spark, c='{"a":{"level":"L","blockers":["x"]},"by":"rules","b":{},"n":[{"q":1}]}') == [("blocker", "a", 0, "x"), ("target", "", -1, "a"), ("target", "", -1, "b")]


def test_security_and_json_in_json(spark):
    s = json.dumps({"risk_factors": ["r"], "credential_requirements": ["C"], "findings": [{"rule": "R1", "locations": [{"path": "a", "line": 1}, {"line": 2}, {"path": "b"}]}, {"locations": [{"path": "c"}]}]})
    want = sorted([("risk_factor", "", 0, "r"), ("credential", "", 0, "C"), ("finding", "", 0, "R1"), ("location", "R1", 0, "a"), ("location", "R1", 2, "b"), ("location", "", 0, "c")])
    assert children(spark, s=s) == want
    assert children(spark, s=json.dumps(json.dumps(s))) == want


def test_broken_and_absent(spark):
    for t in (None, "", "  ", "null", "{}", "[]", '"x"', '{"tools":["a"', "NaN", '{"tools":[NaN]}', "5"):
        assert children(spark, r=t, c=t, s=t) == []


def test_deep_records_do_not_overflow():
    assert len(scan('{"k": [' * 5000 + "1" + "]}" * 5000)) == 1
    for broken in ("[" * 100_000, "{" * 1000, '{"a": [' * 1000):
        with pytest.raises(ValueError):
            scan(broken)


def test_strings_in_strings_have_no_limit(spark):
    t = '{"tools": ["a"]}'
    for _ in range(14):
        t = json.dumps(t)
    assert children(spark, r=t) == [("tool", "", 0, "a")]


def test_elements_without_scalars(spark):
    assert children(spark, c='{"agents": {"a": {"blockers": ["x"]}, "b": {}}}') == [("blocker", "a", 0, "x"), ("target", "", -1, "a"), ("target", "", -1, "b")]
    assert children(spark, c='{"a": {"blockers": ["x"]}, "b": 1}') == [("blocker", "a", 0, "x"), ("target", "", -1, "a")]


def flat(v, path=()):
    if isinstance(v, (dict, list)):
        if not v:
            return [(path, EMPTY_OBJECT if isinstance(v, dict) else EMPTY_LIST)]
        return [x for k, w in (v.items() if isinstance(v, dict) else enumerate(v)) for x in flat(w, (*path, k))]
    return [(path, v)]


def test_scan_equals_the_library():
    """Valid texts give the library's values, broken ones are refused by both."""
    r = random.Random(11)

    def some(d):
        k = r.random()
        if d == 0 or k < 0.35:
            return r.choice([1, -2.5, 1e9, True, None, "", "x", 'q"\\\n', "ü\u2028\U0001f600", "{x", "a,b:c"])
        return [some(d - 1) for _ in range(r.randint(0, 3))] if k < 0.65 else {r.choice(["a", "b", "ü", 'k"']): some(d - 1) for _ in range(r.randint(0, 3))}

    for _ in range(300):
        t = json.dumps(some(4), indent=r.choice([None, 1]), ensure_ascii=r.random() < 0.5)
        assert scan(t) == flat(json.loads(t)), t
        cut = list(t)
        cut[r.randrange(len(cut))] = r.choice(list('{}[],:"x1 \\') + [""])
        t = "".join(cut)
        try:
            want = flat(json.loads(t, parse_constant=float))
        except ValueError:
            want = None
        try:
            got = scan(t)
        except ValueError:
            got = None
        assert got == want or "NaN" in t, t
    assert scan('{"a": {"b": 1}, "c": 2, "a": [3]}') == [(("c",), 2), (("a", 0), 3)]


def test_pivot_keeps_every_scalar():
    random.seed(3)

    def some(d):
        if d == 0 or random.random() < 0.3:
            return random.choice([1, "x", None, True])
        return [some(d - 1) for _ in range(random.randint(1, 3))] if random.random() < 0.5 else {f"k{i}": some(d - 1) for i in range(random.randint(1, 3))}

    for _ in range(200):
        t = list(placed(scan(json.dumps({"r": some(5)}))))
        assert sum(len(leaves) for g in pivot(t).values() for leaves in g.values()) == len({(p, a) for p, a, _ in t}) == len(t)
