import json

from conftest import rows
from pyspark.sql import functions as F

from loomspan import schema as K
from loomspan.functions import rules as R2
from loomspan.functions import text as X
from loomspan.operators import analytics as A
from loomspan.operators import graph as G
from loomspan.operators import parsing as P
from loomspan.operators import recommend as C
from loomspan.operators import scoring as Q
from loomspan.operators import similarity as D
from loomspan.operators import sync as Y
from loomspan.operators import taxonomy as N
from loomspan.sources import export as E
from loomspan.sources import registry as R


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(expr(F.col("t")).alias("o")).first()["o"]


# similarity -------------------------------------------------------------------


def test_jaccard(spark):
    d = spark.createDataFrame([(["a", "b", "c"], ["a", "b", "d"]), ([], ["a"]), (["x", "y"], ["x", "z"])], "a array<string>, b array<string>")
    assert [round(r[0], 4) for r in d.select(D.jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 0.3333]


def test_blocking_loses_no_pair(spark, small_dir):
    v = spark.read.parquet(f"{small_dir}/versions.parquet").where("skill_id IS NOT NULL").dropDuplicates(["skill_id"])
    f = D.fingerprints(v, spark.read.parquet(f"{small_dir}/capabilities.parquet")).cache()
    cross = f.alias("a").join(f.alias("b"), F.col("a.id") < F.col("b.id")).select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))
    for least in (0.35, 0.40, 0.60):
        want = D.score_pairs(f, cross, name_score=D.edit_ratio).where(F.col("overall") >= least)
        assert rows(D.detect_duplicates(f, least, name_score=D.edit_ratio).select("a", "b")) == rows(want.select("a", "b"))


def test_overrides_and_classes(spark):
    schema = "id string, name_n string, words array<string>, caps array<string>, hash string, source string"
    f = spark.createDataFrame([("a", "x y", ["p"], ["q"], "h", "s/1"), ("b", "zz", ["k"], ["m"], "h", "s/2"), ("c", "x y", ["n"], ["o"], "", "s/1"), ("d", "x y", ["n"], ["o"], "", "s/1")], schema)
    got = {(r["a"], r["b"]): (r["overall"], r["class"]) for r in D.detect_duplicates(f).collect()}
    assert got[("a", "b")] == (0.99, "EXACT_DUPLICATE") and got[("a", "c")][0] >= 0.90 and ("c", "d") in got
    assert D.both_ways(D.detect_duplicates(f)).where("id = 'b'").count() == 1


# rules ------------------------------------------------------------------------


def scan(spark, text, expr):
    return Q.with_scan(spark.createDataFrame([(text,)], "t string"), "t").select(expr.alias("o")).first()["o"]


def test_license_first_match(spark):
    cases = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "unknown", "Licensed under CC BY-NC 4.0.": "CC", "BSD-3-Clause": "BSD", "AGPL-3.0": "AGPL", "mitäer": "unknown", "mit der": "MIT", "": "unknown", None: "unknown"}
    for t, want in cases.items():
        assert scan(spark, t, Q.license_name()) == want, t


def test_license_sources(spark):
    d = spark.createDataFrame([("MIT", "ISC"), ("odd", '"ISC"'), (None, '{"type": "house rules"}'), (None, '{"type": "unknown"}'), (None, "odd")], "repo string, lic string").withColumn("t", F.lit("under gpl v3"))
    got = Q.with_scan(d, "t").select(Q.license_of(F.col("repo"), F.col("lic")).alias("l")).collect()
    assert [(r["l"]["type"], r["l"]["confidence"]) for r in got] == [("MIT", 0.95), ("ISC", 0.9), ("house rules", 0.9), ("GPL", 0.7), ("GPL", 0.7)]
    p = spark.createDataFrame([("MIT",), ("Unlicense",), ("house rules",), (None,)], "k string").select(Q.permissions(F.col("k")).alias("p")).collect()
    assert [(r["p"]["allows_commercial"], r["p"]["requires_attribution"]) for r in p] == [(True, True), (True, False), (None, None), (None, None)]


def test_risk(spark):
    f = lambda t: scan(spark, t, Q.risk_level(Q.security_flags()))
    assert f("") == f(None) == "UNKNOWN"
    assert f("Delete files and remove directories from disk") == "HIGH"
    assert f("A simple code formatting skill for Python files") == "LOW"
    assert f("calls the api request with a token over https") == "MEDIUM"


def test_flags_of_neighbouring_words(spark):
    for t, flag in {
        "drop table users": "destructive_potential",
        "then drop the old table": "destructive_potential",
        "please kill process 7": "destructive_potential",
        "it will format disk two": "destructive_potential",
        "the path read by it": "filesystem_access",
        "navigate url of the page": "browser_automation",
        "run a command there": "shell_execution",
        "use the command line": "shell_execution",
    }.items():
        assert flag in scan(spark, t, Q.security_flags()), t
    for t in ("drop\ntable users", "raindrop tables here", "the übershell works", "dropped table data"):
        assert scan(spark, t, Q.security_flags()) == [], t


def test_spellings_of_signals(spark):
    for t, bank, name in [("claude_code here", R2.MENTIONS, "claude"), ("claude-desktop", R2.MENTIONS, "claude"), ("openai_codex", R2.MENTIONS, "codex"), ("docker_compose up", R2.SIGNALS, "docker"), ("an mcp_server", R2.SIGNALS, "mcp"), ("model context protocol", R2.SIGNALS, None), ("api_token", R2.SIGNALS, "api"), ("python3", R2.RUNTIMES, "python")]:
        assert scan(spark, t, Q.found(bank)) == ([name] if name else []), t


def test_agent_fit(spark):
    d = spark.createDataFrame([(1, "skills/a/SKILL.md", "review code", "x"), (2, "a/README.md", "an mcp server in rust", "x"), (3, None, None, "x")], "id long, p string, t string, agent string")
    s = Q.platform_signals(d, "id", "p", "t")
    got = {(r["id"], r["agent"]): r for r in Q.agent_fit(s).collect()}
    level = lambda i, a: got[(i, a)]["level"]
    assert level(1, "claude") == "SUPPORTED" and level(1, "gemini") == "REQUIRES_ADAPTER"
    assert level(2, "codex") == "NOT_SUPPORTED" and level(2, "mcp_client") == "LIKELY_SUPPORTED" and level(3, "claude") == "REQUIRES_ADAPTER"
    assert got[(2, "codex")]["blockers"] == ["needs mcp"] and "needs rust (no shell)" in got[(2, "mcp_client")]["blockers"] and got[(1, "claude")]["enablers"] == ["skill file"]
    old = spark.createDataFrame([(1, None), (2, '{"agents": {}}'), (3, "null")], "id long, compatibility string")
    r = {x["id"]: x["profile"] for x in Q.compatibility_records(s, old).collect()}
    assert sorted(r) == [1, 3] and sorted(r[1]["agents"]) == sorted(R2.AGENTS)
    assert ("runtime", "rust", 1) in rows(Q.compatibility_summary(s))


def test_scores(spark):
    v = spark.createDataFrame([(1, "r", "n", "s" * 150, "pip install ruff, then drop table", "d", "text", "none", '{"tools": ["git"]}', None, None, 0), (2, None, None, None, None, None, None, None, None, None, None, None)], "id long, source_repo string, name string, summary string, raw_content string, domain_primary string, input_format string, output_format string, runtime_requirements string, license string, imported_at timestamp, stars int")
    c = spark.createDataFrame([(1,), (None,)], "version_id_fk long")
    r = {x["id"]: x for x in Q.score_versions(v, c, c, spark.createDataFrame([("r", '{"type": "MIT"}'), ("r", None), (None, "ISC")], "id string, license string")).collect()}
    one = r[1]
    assert (one["license_type"], one["risk"], one["documentation"], one["metadata"], one["dependency"]) == ("MIT", "HIGH", 0.5, 0.9, 0.9)
    assert one["overall"] == round(0.5 * 0.25 + 0.9 * 0.2 + 0.03 + 0.02 + 0.9 * 0.15 + 0.3 * 0.2, 3)
    assert (r[2]["license_type"], r[2]["risk"], r[2]["metadata"]) == ("unknown", "UNKNOWN", 0.0)
    assert ("average", "quality", int((one["overall"] + r[2]["overall"]) * 500)) in rows(Q.scoring_summary(Q.score_versions(v, c, c, spark.createDataFrame([], "id string, license string"))))


def test_taxonomy(spark):
    ref = spark.createDataFrame([(1, "reverse_engineering", "security/reverse_engineering", ["binary analysis"], "q"), (2, "penetration_testing", "security/penetration_testing", ["pentest"], "q")], "ref_id int, canonical string, taxonomy_path string, aliases array<string>, how string")
    names = spark.createDataFrame([("reverse-engineering",), ("PenTest",), ("advanced pentest suite",), ("some-random-thing",), (None,), ("",), ("PenTest",)], "name string")
    got = {r["name"]: (r["canonical"], r["how"]) for r in N.classify(names, ref).collect()}
    assert got == {"reverse-engineering": ("reverse_engineering", "exact"), "PenTest": ("penetration_testing", "exact"), "advanced pentest suite": ("penetration_testing", "fuzzy"), "some-random-thing": ("some_random_thing", "none"), "": ("unknown", "none")}


# parsing ----------------------------------------------------------------------

SKILL = "---\nname: x\n---\n# Code Review\n\nReview code quality with pytest and docker.\n\n## When to use\n- before a merge\n* after a fix\n\n```bash\npip install ruff==0.4 black[jupyter]\n```\nSet API_KEY_ONE first. token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"\n"


def test_parse_file(spark):
    d = spark.createDataFrame([(1, "a/SKILL.md", SKILL), (2, "b/README.md", None), (3, "AGENTS.md", "")], "id long, path string, text string")
    r = {x["id"]: x for x in P.parse_files(d, "id", "path", "text").collect()}
    assert r[1]["name"] == "Code Review" and r[1]["format"] == "skill" and r[1]["headings"] == ["when to use"] and r[1]["capabilities"] == ["before a merge", "after a fix"] and r[1]["tags"] == ["docker", "pytest"]
    assert r[2]["name"] == "" and r[2]["confidence"] == 0.0 and r[3]["format"] == "agents"
    assert rows(P.packages(d, "id", "text").select("ecosystem", "package")) == [("pip", "black"), ("pip", "ruff")]
    s = P.secrets(d, "id", "text").collect()
    assert len(s) == 1 and len(s[0]["preview"]) == 43 and SKILL[s[0]["position"] :].startswith("token")
    assert one(spark, SKILL, P.env_vars) == ["API_KEY_ONE"]
    twice = "a token = " + "x" * 24 + " and again token = " + "x" * 24
    s = P.secrets(spark.createDataFrame([(1, twice), (2, None), (3, "")], "id long, text string"), "id", "text").collect()
    assert [r["position"] for r in s] == [2, twice.rindex("token")]
    assert one(spark, "a pentest finds a vulnerability and an exploit", P.infer_domain) == "security"


def test_parsers_by_format(spark):
    skill = "# A\n\nFirst line.\n\n## Triggers\n- t1\n\n## Other\n- no\n\n## Platforms\n* linux\n\nRequires: git, jq\n```bash\npip install ruff\n```\n"
    agents = "# B\n\n" + "x" * 300 + "\n\n## Workflow\n" + "".join(f"- w{i}\n" for i in range(12))
    readme = "# C\n\n> Quoted start\n\n![b](https://img.shields.io/badge/Python-3.x)\n\n## Install\n```\nnpm install x\n```\n\n## Features\n- f1\n"
    d = spark.createDataFrame([(1, "SKILL.md", skill), (2, "x/AGENTS.md", agents), (3, "README.md", readme), (4, "notes.txt", "you are here"), (5, "notes.txt", "nothing"), (6, "a.md", "## Usage\n\nSay it\n- only\n")], "id long, path string, text string").withColumn("f", F.lit("agents"))
    r = {x["id"]: x for x in P.parse_files(d, "id", "path", "text").collect()}
    assert [r[i]["format"] for i in range(1, 7)] == ["skill", "agents", "readme", "agents", "readme", "skill"]
    assert (r[1]["name"], r[1]["summary"], r[1]["capabilities"], r[1]["compatibility"]) == ("A", "First line.", ["t1"], ["linux"])
    assert r[1]["dependencies"] == ["pip install ruff", "git", "jq"] and r[6]["capabilities"] == ["only"]
    assert len(r[2]["summary"]) == 200 and len(r[2]["capabilities"]) == 10 and r[2]["confidence"] == 0.8
    assert (r[3]["summary"], r[3]["tags"], r[3]["dependencies"], r[3]["capabilities"], r[3]["confidence"]) == ("Quoted start", ["python"], ["npm install x"], ["f1"], 1.0)
    assert all(x["format"] == "agents" for x in P.parse_files(d, "id", "path", "text", given="f").collect())
    mine = P.Parser("txt", lambda name, t: F.endswith(name, F.lit(".txt")), P.PARSERS[2].fields)
    assert {x["id"] for x in P.parse_files(d, "id", "path", "text", (mine, *P.PARSERS)).collect() if x["format"] == "txt"} == {4, 5}


def test_composition(spark):
    docs = spark.createDataFrame([("a", "A", ["x", "y"], "r"), ("b", "B", ["y", "z"], "r"), ("c", "C", [], "q")], "id string, name string, caps array<string>, repo string")
    deps = spark.createDataFrame([("a", "tool", "git"), ("b", "tool", "git"), ("b", "package", "p"), ("c", "tool", "no")], "id string, type string, name string")
    pick = lambda *ids: spark.createDataFrame(list(enumerate(ids)), "pos int, id string")
    one = C.composition(pick("b", "a"), docs, deps, "pipeline").first()
    assert (one["name"], one["order"], one["capabilities"], one["needs"], one["errors"], one["warnings"], one["valid"], one["sources"]) == ("B + A", ["b", "a"], ["x", "y", "z"], {"tool": ["git"], "package": ["p"]}, 0, 1, True, 1)
    assert rows(C.conflicts(pick("a", "b", "none"), docs, "prefer_last")) == [("capability_overlap", "a", "b", "error", "", "y"), ("missing_skill", "none", "", "error", "", "not found")]
    assert not C.composition(pick("a", "none"), docs, deps).first()["valid"]
    assert not C.composition(pick("a").where("false"), docs, deps).first()["valid"]


def test_recommend_for(spark):
    docs = spark.createDataFrame([("a", "d"), ("b", "d"), ("c", "d"), ("e", "o")], "id string, domain string")
    pairs = spark.createDataFrame([("a", "e", 0.6), ("a", "c", 0.05), ("e", "a", 0.6)], "id string, other string, overall double")
    assert [tuple(r) for r in C.recommend_for(docs, pairs, "a").collect()] == [("e", 0.6, "similar"), ("b", 0.15, "same_category"), ("c", 0.05, "similar")]
    assert C.recommend_for(docs, pairs, "nobody").count() == 0


def test_closure_has_no_limit(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(80)], "src int, dst int")
    got = G.closure(e)
    assert got.count() == 80 * 81 // 2 and got.agg(F.max("depth")).first()[0] == 80


def test_dependencies(spark):
    d = spark.createDataFrame([(1, "It requires python 3.10 and pip install requests flask.\nSet OPENAI_API_KEY. Uses docker.", None), (2, "short", '{"tools": ["docker", {"name": "kubectl"}], "apis": [{"name": "x", "version": 1}, {}]}'), (3, None, "{broken"), (4, "Uses git for version control", "[]")], "id long, t string, req string")
    got = rows(P.version_dependencies(d, "id", "t", "req").select("id", "type", "name", "source"))
    assert got == sorted([(1, "api", "OpenAI API", "text"), (1, "env_var", "OPENAI_API_KEY", "text"), (1, "package", "flask.", "text"), (1, "package", "requests", "text"), (1, "runtime", "python", "text"), (1, "tool", "docker", "text"), (2, "api", "x", "declared"), (2, "tool", "docker", "declared"), (2, "tool", "kubectl", "declared"), (4, "tool", "git", "text")], key=repr)
    assert P.dependencies_in(d, "id", "t", 0.9).where("id = 4").count() == 0
    r = {x["id"]: x for x in P.dependency_record(P.version_dependencies(d, "id", "t", "req")).collect()}
    assert [x["name"] for x in r[2]["tools"]] == ["docker", "kubectl"] and r[2]["packages"] == []


# graph ------------------------------------------------------------------------


def test_graph(spark):
    rec = spark.createDataFrame([("a", "skill-a"), ("b", "skill-b"), ("c", "skill-c")], "id string, name string")
    deps = spark.createDataFrame([("c", "Skill-B"), ("b", "skill-a"), ("c", "requests"), ("c", "requests"), (None, None)], "src string, name string")
    edges, ext = G.resolve(deps, rec)
    assert rows(edges) == [("b", "a"), ("c", "b")] and rows(ext) == [("c", "requests")]
    assert rows(G.closure(edges)) == [("b", "a", 1), ("c", "a", 2), ("c", "b", 1)]
    loop = edges.union(spark.createDataFrame([("a", "b")], "src string, dst string"))
    assert rows(G.cycles(G.closure(loop))) == [("a", "a"), ("a", "b")]
    con = spark.createDataFrame([("requests", ">=2.0"), ("requests", "<2.0"), ("x", "1"), ("x", None)], "n string, v string")
    assert rows(G.conflicts(con, "n", "v").select("n")) == [("requests",)]
    assert G.closure(edges.where("false")).count() == 0


# sync -------------------------------------------------------------------------


def test_changes_and_state(spark):
    s = "k string, hash string, path string"
    old = spark.createDataFrame([("a", "1", "p"), ("b", "1", "p"), ("c", None, "p"), ("d", "1", "p")], s)
    new = spark.createDataFrame([("a", "1", "p"), ("b", "2", "q"), ("c", None, "p"), ("e", "1", "p")], s)
    ch = Y.detect_changes(old, new, "k", {"hash": "MODIFIED", "path": "MOVED"})
    assert rows(ch.select("k", "change")) == [("b", "MODIFIED"), ("b", "MOVED"), ("d", "REMOVED"), ("e", "ADDED")]
    assert dict(rows(Y.change_counts(ch, old, new, "k")))["UNCHANGED"] == 2
    st = {r["k"]: r for r in Y.apply_changes(old.withColumn("n", F.lit(1)), new, ch, "k", "n").collect()}
    assert st["b"]["n"] == 2 and st["b"]["hash"] == "2" and st["d"]["lifecycle"] == "archived" and st["a"]["n"] == 1 and st["e"]["n"] == 1
    assert Y.detect_changes(new, new, "k", {"hash": "MODIFIED"}).count() == 0


# analytics, recommendation ------------------------------------------------------


def test_order_stats_and_histogram(spark):
    d = spark.createDataFrame([(0.5,), (0.65,), (0.8,), (None,)], "s double")
    assert tuple(A.order_stats(d, "s").first()) == (0.5, 0.5, 0.65, 0.8, 0.8, 0.65, 3)
    h = dict(rows(A.histogram(spark.createDataFrame([(0.0,), (1.0,), (0.95,)], "s double"), "s")))
    assert h[0] == 1 and h[9] == 2 and h[5] == 0 and len(h) == 10


def test_recommend(spark):
    s = "id string, caps array<string>, tags array<string>, summary string, domain string, repo string, version_count int, quality double"
    d = spark.createDataFrame([("a", ["data-analysis"], [], "x", "data", "r", 5, 0.5), ("b", [], ["etl_pipeline"], "data-visualization", "data", "r", 50, None), ("c", None, None, None, None, None, None, None)], s)
    d = d.withColumn("caps", F.coalesce("caps", F.array().cast("array<string>"))).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    none = spark.createDataFrame([], "id string")
    r = {x["id"]: x for x in C.recommend(d, "look at the data", none).collect()}
    assert r["a"]["reason"] == "task_match" and set(r) == {"a", "b"}
    r = {x["id"]: x for x in C.recommend(d, None, spark.createDataFrame([("a",)], "id string")).collect()}
    assert "a" not in r and r["b"]["reason"] in ("same_category", "popular") and "c" in r


# text, sources, sinks, schema -----------------------------------------------------


def test_text_functions(spark):
    assert one(spark, " A-b_C  d ", X.label_key) == "abcd"
    assert one(spark, "<a b='\"&'>", X.escape_html) == "&lt;a b=&#x27;&quot;&amp;&#x27;&gt;"
    assert one(spark, "ok_id-1.2", lambda c: X.identifier_check(c)["valid"]) and not one(spark, "no id", lambda c: X.identifier_check(c)["valid"])
    assert one(spark, "x; DROP table", X.dangerous_query) and not one(spark, "dropped", X.dangerous_query)
    for t, want in ((None, True), ("", True), ("null", True), (" { } ", True), ("x", False)):
        assert one(spark, t, X.absent) is want
    assert one(spark, json.dumps(json.dumps({"a": {"b": "c"}})), lambda c: X.json_text(c, "$.a.b")) == "c"
    assert one(spark, '{"a": ', lambda c: X.json_text(c, "$.a")) is None
    h = lambda raw: spark.createDataFrame([("n", "s", "p", raw)], "n string, s string, p string, r string").select(X.record_hash(F.col("n"), F.col("s"), F.col("p"), F.col("r"))).first()[0]
    assert h(None) == h("") != h("x")
    assert one(spark, "ﬁle", X.nfkc) == "file"


def test_registry_round_trip(spark, tmp_path):
    doc = {
        "skills": [{"id": "1", "name": {"value": "n", "confidence": 0.5}, "canonical_key": "k", "last_updated_at": "2025-01-02T03:04:05Z"}, {"id": "1", "name": "old", "last_updated_at": "2024-01-01T00:00:00Z"}],
        "versions": [{"skill_id": "1", "version_id": "v", "name": "n", "source": {"repo": "r", "path": "p"}, "imported_at": "bad", "capabilities": ["a", {"name": "b", "canonical": "B"}, None], "tags": ["t", "t"], "security": {"risk_level": "LOW"}}],
        "repositories": [{"id": "r", "skill_count": 2}],
    }
    (tmp_path / "r.json").write_text(json.dumps(doc))
    (tmp_path / "broken.json").write_text('{"skills": [')
    t = R.read_registry(spark, str(tmp_path / "*.json"))
    assert rows(t["skills"].select("id", "name")) == [("1", "n")]
    v = t["versions"].first()
    assert v["imported_at"] is None and v["source_repo"] == "r" and json.loads(v["security"]) == {"risk_level": "LOW"}
    assert rows(t["capabilities"].select("name", "canonical")) == [("a", None), ("b", "B")] and t["tags"].count() == 1
    assert K.orphans(t["capabilities"], "version_id_fk", t["versions"], "id").count() == 0
    assert K.conform(t["versions"], "versions").columns[:3] == ["id", "skill_id", "version_id"]
    assert K.duplicate_keys(t["skills"], "id").count() == 0


def test_flat_registry(spark, tmp_path):
    doc = {"sources": {"o/a": 1, "o/z": 0}, "skills": [{"name": "x", "repo": "o/a", "skill_path": "p", "summary": "| table", "input_shape": None, "output_shape": {"format": "json"}, "capabilities": ["c"]}, {"name": "y", "repo": "o/b", "skill_path": "q", "summary": "A long enough summary", "input_shape": "natural_language", "output_shape": ""}]}
    (tmp_path / "v2.json").write_text(json.dumps(doc))
    t = R.read_flat_registry(spark, str(tmp_path / "v2.json"))
    assert rows(t["versions"].select("name", "summary", "input_format", "output_format")) == [("x", None, "unknown", "json"), ("y", "A long enough summary", "natural_language", "unknown")]
    assert rows(t["repositories"].select("id", "skill_count", "backfilled")) == [("o/a", 1, False), ("o/b", 1, True), ("o/z", 0, False)]


def test_exports(spark, tmp_path):
    r = spark.createDataFrame([("1", "n", "web_dev", "r", "a|b", "", "MIT", "LOW")], "skill_id string, name string, domain string, repo string, capabilities string, tags string, license_type string, security_risk string")
    assert E.markdown_lines(r).first()["block"] == "## Web Dev\n- **n** (r): a, b"
    E.write_csv(r, str(tmp_path / "c"))
    E.write_json(r, str(tmp_path / "j"), {"domain": "x"})
    E.write_markdown(r, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["capabilities"] == "a|b"
    assert spark.read.json(str(tmp_path / "j")).first()["schema_version"] == "3.0"


def test_numbering_in_blocks_equals_one_window(spark):
    from loomspan.operators.records import numbered

    d = spark.createDataFrame([("a", i * 37 % 101, i) for i in range(200)] + [("b", None, 1), ("b", 5, 2), ("c", None, 3)], "k string, t int, id int")
    o = [F.col("t").asc_nulls_first(), F.col("id")]
    assert rows(numbered(d, "k", o)) == rows(numbered(d, "k", o, block=F.floor(F.col("t") / 10)))


def test_broadcast_only_if_small(spark):
    from loomspan.session import broadcast_if_small

    hint = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hint(broadcast_if_small(spark.range(10), 10)) and not hint(broadcast_if_small(spark.range(11), 10))


def test_summary_is_cut_for_agents_and_readme_only(spark):
    para = "A long sentence of the first paragraph. " * 8
    d = spark.createDataFrame([(i, p, f"# T\n\n{para}\n\nmore") for i, p in enumerate(("a/SKILL.md", "a/AGENTS.md", "README.md"))], "id long, path string, text string")
    got = {r["id"]: r["summary"] for r in P.parse_files(d, "id", "path", "text").collect()}
    assert got == {0: para.strip(), 1: para[:200], 2: para[:200]}
