import random

import numpy as np
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm.matching import BKTree, Forest, Matcher, damerau, levenshtein, map_to_reference, match_names

WORDS = st.text("abcde", max_size=9)


def plain(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d = d, [i]
        for j, y in enumerate(b, 1):
            d.append(min(p[j - 1] + (x != y), p[j] + 1, d[-1] + 1))
    return d[-1]


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS, WORDS)
def test_metrics(a, b, c):
    assert levenshtein(a, b) == plain(a, b)
    assert damerau(a, b) <= levenshtein(a, b) <= 2 * damerau(a, b)
    assert damerau(a, c) <= damerau(a, b) + damerau(b, c)


def test_tree_returns_all_within_radius():
    r = random.Random(1)
    keys = {"".join(r.choices("abcd", k=r.randint(2, 8))) for _ in range(300)}
    t = BKTree()
    for k in sorted(keys):
        t.add(k)
    for _ in range(60):
        q = "".join(r.choices("abcd", k=r.randint(1, 9)))
        for rad in (0, 1, 2, 4):
            assert {k for k, _ in t.within(q, rad)} == {k for k in keys if levenshtein(k, q) <= rad}


REF = [("release_notes", ["whats new page"]), ("time_series_smoothing", []), ("mail_merge", []), ("particle_tracking", []), ("oauth_setup", ["sso onboarding"])]


def test_spellings():
    m = Matcher(REF)
    for text, want in {
        "releaes_notes": "release_notes", "Whats-New Page": "release_notes", "notes of release": "release_notes", "noteslof release": "release_notes", "rele. notes": "release_notes",
        "timeSeriesSmoothing": "time_series_smoothing", "smoothing time series (beta)": "time_series_smoothing", "my mail merge v2": "mail_merge", "  MAIL-MERGE! ": "mail_merge", "mãil mérge": "mail_merge",
        "particel trackign": "particle_tracking", "ssoonboarding": "oauth_setup",
    }.items():
        assert m.best(text)[1] == want, text
    for text in ("", None, "skill", "n/a", "parrot tracking", "sail mending", "x"):
        assert m.best(text) is None, text


def test_brute_force():
    """Every name's answer is the nearest by comparing with all spellings."""
    m = Matcher(REF)
    r = random.Random(5)
    keys = list(m.exact)
    for _ in range(300):
        k = list(r.choice(keys))
        for _ in range(r.randint(0, 4)):
            k[r.randrange(len(k))] = r.choice("abcxyz")
        q = "".join(k)
        if q in m.short or q in m.exact or "of" in q:
            continue
        near = sorted((damerau(x, q), m.exact[x]) for x in keys)
        got = m.best(q)
        assert (got is None) == (near[0][0] > 2) and (got is None or got[0] == near[0][0] + 1)


def test_rows_and_shards(spark):
    ref = spark.createDataFrame([(c, a, "q") for c, a in REF], "canonical string, aliases array<string>, name string")
    data = [(1, "mail merg", None), (2, "x", "mail_merge"), (3, "Mail Merge", "Mail_Merge"), (4, None, None), (5, "sail mending", "uncategorized"), (5, "sail mending", "uncategorized")]
    d = spark.createDataFrame([(*x, "k", 0) for x in data], "id long, name string, canonical string, known string, d int")
    want = [(1, "mail_merge"), (3, "mail_merge"), (4, "unmatched"), (5, "unmatched"), (5, "unmatched")]
    assert rows(map_to_reference(d, ref)) == want
    assert rows(match_names(d, ref, shard_entries=2)) == rows(match_names(d, ref))
    assert rows(map_to_reference(d, ref.where("false"))) == sorted([(i, "unmatched") for i in (1, 2, 3, 4, 5, 5)])
    assert map_to_reference(d.where("false"), ref).count() == 0


def test_forest_finds_what_the_tree_finds():
    r = random.Random(3)
    keys = sorted({"".join(r.choices("abcd", k=7)) for _ in range(200)})
    t = BKTree()
    for k in keys:
        t.add(k)
    code = {c: i + 1 for i, c in enumerate("abcd")}
    forest = Forest(t, code)
    asked = ["".join(r.choices("abcde", k=6)) for _ in range(50)]
    query = np.array([[code.get(c, 0) for c in q] for q in asked])
    for rad in (1, 2, 4):
        got = {(int(q), forest.keys[n], int(d)) for qs, ns, ds in forest.within(query, rad) for q, n, d in zip(qs, ns, ds)}
        assert got == {(i, k, levenshtein(k, q)) for i, q in enumerate(asked) for k in keys if levenshtein(k, q) <= rad}


def test_shards_answer_as_one(spark):
    """Cut words that two entries share, spellings two entries share, and ties."""
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(4, 8)))
    entries = [("alpha_review", ["shared name"]), ("alpha_revenue", ["shared name"]), ("beta_tides", None), ("beta_tiles", [])] + [(f"{word()}_{word()}", [word()]) for _ in range(60)]
    entries.append(entries[-1])
    ref = spark.createDataFrame(entries, "canonical string, aliases array<string>")
    names = ["alpha rev", "alpha revi", "shared name", "sharde name", "beta tibes", "tides beta", None, "", "x"]
    for c, _ in entries:
        for _ in range(2):
            t = list(c.replace("_", " "))
            t[r.randrange(len(t))] = r.choice("abcdefgh ")
            names.append("".join(t))
    d = spark.createDataFrame([(n,) for n in names], "name string")
    whole = rows(match_names(d, ref))
    assert ("alpha rev", "unmatched", None) in whole and ("alpha revi", "alpha_review", 1) in whole and ("shared name", "alpha_revenue", 0) in whole
    for size, group in ((7, 20), (20, 1000), (1, 50)):
        assert rows(match_names(d, ref, shard_entries=size, group_names=group)) == whole
