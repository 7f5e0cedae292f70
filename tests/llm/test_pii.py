import pytest
from conftest import rows

from loomspan.llm.pii import candidates, personal_data, redact


def emails(t):
    return [c[4] for c in candidates(t, frozenset(), frozenset()) if c[0] == "email"]


def test_emails():
    assert emails("see mailto:a.b+c@x-y.example for") == ["a.b+c@x-y.example"]
    assert emails("<A_B@X.EXAMPLE.NET>.") == ["A_B@X.EXAMPLE.NET"]
    assert emails("to a [at] b [dot] test now, or c(at)d.example. And e dot f at g dot example dot org!") == ["a [at] b [dot] test", "c(at)d.example", "e dot f at g dot example dot org"]
    for t in ("git@code.x.test:tools/a.git", "pin rowkit@4.1.0 and b@2.0", "@cached", "@author X", "meet at noon dot", ""):
        assert emails(t) == [], t


GIVEN, FAMILY = ["Maelin", "Calix", "Derwina", "Joslan"], ["Quillon", "Vexley", "Stanwick", "Drumlock"]
NEW_G, NEW_F = ["Telvian", "Brenveth", "Zelor"], ["Thornquist", "Mowbane", "O'Darrow"]


@pytest.fixture(scope="module")
def docs(spark):
    out = []
    for i, (g, f) in enumerate((g, f) for g in GIVEN + NEW_G for f in FAMILY + NEW_F):
        t = [f"Paired with {g} {f} on the rollback.", f"I talked to {f}, {g} about the step.", f"Maintained by {g[0]}. {f}."][i % 3]
        phone = ["+1 415 555 01%02d", "(212) 555-01%02d", "617 555 01%02d", "07700 9002%02d"][i % 4] % i
        num = ["9%02d-50-8276", "QQ 10 22 %02d B", "9%02d 77 8975"][i % 3] % i
        street = ["Osier Street", "Tallow Hill Road", "Gorsemead", "Fern Lane", "Pike & Anchor Way"][i % 5]
        out.append((i, f"Run it first. {t} Ask North Harbor mode for details.\nCall {phone} during office hours. Range 100-200-3000 is valid.\nID on the form: {num}\nShip-to: {i + 1} {street}, Unit 4, Pellham 00{i + 100}\nSection 12 Main Loop explains it. 2025-03-14 07:30:00 started", "x", "y"))
    out += [(900, None, "x", "y"), (901, "", "x", "y"), (902, "word " * 100_000, "x", "y"), (903, out[0][1], "x", "y")]
    return spark.createDataFrame(out, "doc_id long, text string, kind string, found string")


@pytest.fixture(scope="module")
def hints(spark):
    return spark.createDataFrame([(n, "given", "en") for n in GIVEN] + [(n, "family", "en") for n in FAMILY], "name string, role string, lang string")


def test_patterns_find_unseen_pieces(docs, hints):
    got = {}
    for i, k, f in rows(personal_data(docs, hints)):
        got.setdefault(k, {}).setdefault(i, []).append(f)
    n = len(GIVEN + NEW_G) * len(FAMILY + NEW_F)
    assert sum(len(x) for x in got["name"].values()) == n + 1 and "Harbor" not in str(got["name"]) and "Main Loop" not in str(got["name"])
    assert "Telvian Thornquist" in str(got["name"]) and "Mowbane, Zelor" in str(got["name"]) or "Z. Mowbane" in str(got["name"])
    assert len(got["phone"]) == n + 1 and "100-200-3000" not in str(got["phone"]) and all(len(x) == 1 for x in got["phone"].values())
    assert len(got["id_number"]) == n + 1 and all(len(x) == 1 for x in got["id_number"].values())
    assert got["address"][1] == ["2 Tallow Hill Road, Unit 4, Pellham 00101"] and got["address"][2] == ["3 Gorsemead, Unit 4, Pellham 00102"]
    assert got["name"][0] == got["name"][903]  # equal texts each have theirs


def test_redaction(docs, hints):
    t = dict(rows(redact(docs, hints)))
    assert t[900] is None and t[901] == "" and t[902] == "word " * 100_000
    assert t[0].startswith("Run it first. Paired with [NAME] on the rollback.") and "Call [PHONE] during" in t[0] and "form: [ID_NUMBER]\nShip-to: [ADDRESS]\n" in t[0]


def test_empty(docs, hints):
    assert personal_data(docs.where("false"), hints).count() == 0
    assert personal_data(docs.where("doc_id >= 900"), hints.where("false")).count() >= 0


def test_copies_keep_what_form_decides(spark, hints):
    phone = [f"Zeq {i} wub +44 20 7946 {1000 + i} vax {i} jorn." for i in range(2)]
    data = [(i, phone[0]) for i in range(6)] + [(6, phone[1])] + [(10 + i, f"Ik {w} 123-45-6789 {w} ol.") for i, w in enumerate(("ab", "cd", "ef", "gh", "ij"))]
    got = rows(personal_data(spark.createDataFrame(data, "doc_id long, text string"), hints))
    assert [i for i, k, f in got if k == "phone" and f == "+44 20 7946 1000"] == list(range(6))
    assert sorted(i for i, k, f in got if k == "id_number") == list(range(10, 15))


def test_copies_of_a_text_are_one_place(spark, hints):
    line = "Paired with {} on the rollback."
    names = [f"{g} {f}" for g in GIVEN for f in FAMILY] + ["Orwen Tasker"]
    data = [(i, line.format(n)) for i, n in enumerate(names)] + [(100 + i, "Blue zorp Orwen Tasker quib nal.") for i in range(12)]
    got = rows(personal_data(spark.createDataFrame(data, "doc_id long, text string"), hints))
    assert (len(names) - 1, "name", "Orwen Tasker") in got
