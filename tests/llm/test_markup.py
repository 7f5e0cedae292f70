import random

import pytest
from conftest import rows

from loomspan.llm.markup import markup, parse_page, subtrees


def counts(text, path="a/SKILL.md"):
    out = {}
    for kind, element, _ in parse_page(text, path):
        if kind:
            k = out.setdefault(kind, {})
            if element:
                k[element] = k.get(element, 0) + 1
    return out


CASES = [
    ("plain text, a < b and c > d, 5 * 3 * 2, docs/__init__/x, it costs $5, set $HOME", {}),
    ("", {}), ("  \n", {}),
    ("a *word* and `code`", {"markdown": {}}),
    ("# A\n\nB\n---\n\nC\n===\n\n- x\n  - y\n1. z\n\n```py\n# no\n- no\n```\n\n$$\nx = 1\n$$\n\nso $a_1$ is", {"markdown": {"heading": 3, "list_item": 3, "code_block": 1, "formula": 2}}),
    ("---\nname: x\n# no: 1\n---\n~~~\n# no\n~~~\n\n    code\n    # no\n\n***\n\ntext", {"markdown": {"code_block": 2}}),
    ("# A\n\n```\nnever closed\n# no", {"markdown": {"heading": 1, "code_block": 1}}),
    ("text `<li>` and `# no`", {"markdown": {}}),
    ("# A\n\n<H3>B</H3>\n\n<ul>\n<LI>x\n<li>y</li>\n</ul>\n\n<PRE>\n<li>no\n# no\n</PRE>", {"markdown": {"heading": 1}, "html": {"heading": 1, "list_item": 2, "code_block": 1}}),
    ("<!DOCTYPE html>\n<html><head><title>T</title></head>\n<body>\nx <b>y</b>\n</body></html>", {"html": {}}),
    ("<p><math><mi>s</mi></math></p>\n<span class=\"math\">\\(x = 1\\)</span>\n<pre><code>&lt;li&gt;</code></pre>", {"html": {"formula": 2, "code_block": 1}}),
    ("&lt;h1 id=\"s\"&gt;\n T\n&lt;/h1&gt;\n&lt;ol&gt;\n&lt;li&gt;x\n&lt;/ol&gt;\n&lt;pre&gt;&amp;lt;li&amp;gt;&lt;/pre&gt;", {"html": {"heading": 1, "list_item": 1, "code_block": 1}}),
    ("==A==\n\n* x\n**y\n#z\n\n<source lang=\"py\">\n== no ==\n* no\n</source>\n\n:<math>x</math>\n\nso <math>y</math>, ''it'' [[A|b]]<ref>u</ref>", {"wiki": {"heading": 1, "list_item": 3, "code_block": 1, "formula": 2}}),
    ("a '''word''' and [[Link|text]]", {"wiki": {}}),
    ("# First sentence here.\n#Second one here.\n## Third one here.\n", {"wiki": {"list_item": 3}}),
    ("\\section*{A}\n\\subsection{B}\n% \\section{no}\n\\begin{itemize}\n \\item x\n \\item y\n\\end{itemize}\n\\begin{lstlisting}\n\\item no $x$\n\\end{lstlisting}\n\\[ x \\]\n\\begin{align*}\ny\n\\end{align*}\nso $z$, \\texttt{a\\_b}", {"latex": {"heading": 2, "list_item": 2, "code_block": 1, "formula": 3}}),
    ("some \\emph{word} here", {"latex": {}}),
]


@pytest.mark.parametrize("text,want", CASES)
def test_counts(text, want):
    assert counts(text) == want
    assert counts(text.replace("\n", "\r\n")) == want


def test_source_files_are_not_markup():
    assert counts("# a comment\n- x\n<li>", "lib/run.py") == {}


def test_long_text():
    assert counts("- item\n" * 50_000)["markdown"]["list_item"] == 50_000
    counts("<" * 20_000 + "*" * 20_000 + "`" * 20_000 + "$" * 20_000)


def test_found_and_clean(spark):
    foot = "<footer>All rights of this site belong to the site</footer>"
    page = lambda i: f"<h1>Page {i}</h1>\n<ul><li>This line stands on every page of it</li></ul>\n<p>Body {i}</p>\n{foot}"
    data = [(i, "h", "a/p.html", page(i), "x") for i in range(12)] + [(50, "g", "a/p.html", page(50), "x"), (60, None, None, None, "x"), (61, "h", "a", "", "x"), (62, None, "a/SKILL.md", "**x** y", "x"), (62, None, "a/SKILL.md", "**x** y", "x")]
    d = spark.createDataFrame(data, "id long, source_repo string, source_path string, raw_content string, kind string")
    found, clean = markup(d)
    got = rows(found)
    assert (3, "html", "heading", 1) in got and (3, "html", "list_item", 1) in got  # counted though template
    assert (62, "markdown", "none", 0) in got and len(got) == 13 * 2 + 1
    text = dict(rows(clean))
    assert "every page" not in text[3] and "# Page 3" in text[3] and "Body 3" in text[3] and "every page" in text[50]
    assert markup(d.where("false"))[0].count() == 0


def test_template_of_a_mixed_host(spark):
    menu = "<ul><li>Home</li><li>Docs</li><li>Source</li><li>Contact</li></ul>"
    data = [(i, f"{menu}\n<h1>Page {i}</h1>\n<h2>Usage</h2>\n<p>Body {i}</p>\n<footer>All rights of this site belong to the site</footer>", "a/p.html") for i in range(12)]
    data += [(100 + i, f"# Note {i}\n\nplain markdown {i}", "a/SKILL.md") for i in range(60)] + [(200 + i, f"x = {i}", "a/run.py") for i in range(60)]
    data += [(300 + i, "<h1>One page that is copied whole</h1>\n<p>It has a body of its own</p>", "a/p.html") for i in range(20)]
    d = spark.createDataFrame([(i, "h", p, t) for i, t, p in data], "id long, source_repo string, source_path string, raw_content string")
    text = dict(rows(markup(d)[1]))
    assert text[3] == "# Page 3\n\n# Usage\n\nBody 3"
    assert text[100] == "# Note 0\n\nplain markdown 0" and text[205] == "x = 5"
    assert text[305] == "# One page that is copied whole\n\nIt has a body of its own"


def test_subtrees_are_nested():
    events = []
    leaves = parse_page("<nav><ul><li>A</li><li>B</li></ul></nav>\n<div>\n<h2>T</h2>\n<p>x</p>\n<footer>f</footer>\n<p>y", "a/p.html", events)
    assert [x[2] for x in leaves] == ["A", "B", "T", "x", "f", "y"]
    assert subtrees(leaves, events) == [("list", 0, 2), ("nav", 0, 2), ("ul", 0, 2), ("div", 2, 6), ("section", 2, 6)]
    assert subtrees(parse_page("# A\n\n- x\n- y\n\nz\n\n# B\n\nw", "a.md"), []) == [("section", 0, 4), ("list", 1, 3), ("section", 4, 6)]
    assert subtrees([], []) == []


def test_planted_templates_leave_and_all_else_stays(spark):
    """Menus, banners and footers in html, Markdown and wiki pages of three hosts
    against the texts they were planted in."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    sentence = lambda: " ".join(word() for _ in range(6)) + "."
    plant = {
        "p.html": ("<nav>\n<ul>\n<li>Home</li>\n<li>Docs<ul>\n<li>Guide</li>\n<li>API</li>\n</ul></li>\n</ul>\n</nav>\n", "\n<footer>\n<p>About</p>\n<div><p>Made by the people of this host</p></div>\n</footer>"),
        "p.md": ("- Home\n- Docs\n- Source code\n- Contact us\n\n## Before you start\n\nRead the rules of this host.\n\n", "\n\n# About\n\nMade by the people of this host.\n"),
        "p.wiki": ("* Home page\n* Docs of the host\n* Contact us\n\n", "\n\n== About ==\n\nMade by the people of this host.\n"),
    }
    heading = {"p.html": "<h1>{}</h1>\n<p>{}</p>\n<p>{}</p>", "p.md": "# {}\n\n{}\n\n**{}**", "p.wiki": "== {} ==\n\n{}\n\n'''{}'''"}
    data, want = [], {}
    for h in range(3):
        for path, (before, after) in plant.items():
            for _ in range(12):
                i = len(data)
                a, b, c = word(), sentence(), sentence()
                data.append((i, f"host{h}", f"x/{path}", before.replace("host", f"host{h}") + heading[path].format(a, b, c) + after.replace("host", f"host{h}")))
                want[i] = f"# {a}\n\n{b}\n\n{c}"
    once = len(data)
    data.append((once, "other", "x/p.html", plant["p.html"][0] + "<p>body</p>" + plant["p.html"][1]))
    got = dict(rows(markup(spark.createDataFrame(data, "id long, source_repo string, source_path string, raw_content string"))[1]))
    assert "- Guide" in got.pop(once)
    assert got == want
