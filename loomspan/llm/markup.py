"""Markup residue (problem 1): element trees, hashes of their subtrees, site templates.

A page is parsed into its leaf elements in order, each with its markup kind
(html, markdown, wiki, latex), what it is (heading, list_item, code_block,
formula, or text) and its clean text; and into the subtrees that hold them: the
containers of html (menus, lists, footers, boxes, tables, nested as they are),
lists and sections of every kind.  A subtree's hash is made from its leaves'.  The
hashes are counted per host in Spark, and subtrees that recur on many pages of a
host are its template: whatever they hold leaves the clean text.  What a page
holds of each element is counted over all leaves, the template's too, as the
markup is there whether or not the text is kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.session import broadcast_if_small, cut_lineage

#: File endings of program source.
SOURCE_ENDINGS = frozenset("py rs sh js ts go c h cpp java rb pl lua sql r jl php cs kt swift toml ini cfg bat ps1".split())
_FRONT = re.compile(r"\A---[ \t]*\n.*?\n(?:---|\.\.\.)[ \t]*(?:\n|\Z)", re.S)
_TAG = r"</?(?:a|abbr|article|aside|b|blockquote|body|br|button|caption|cite|code|dd|del|details|div|dl|dt|em|figure|font|footer|form|h[1-6]|head|header|hr|html|i|img|input|ins|kbd|label|li|link|main|mark|math|meta|mfrac|mi|mn|mo|msub|msup|nav|ol|p|pre|q|s|samp|script|section|small|source|span|strong|style|sub|summary|sup|table|tbody|td|th|thead|title|tr|tt|u|ul|var|video)\b[^<>]*>"
_REAL = re.compile(_TAG + r"|<!--|<!doctype", re.I)
_ESCAPED = re.compile(r"&lt;(?:/?[a-z][a-z0-9]*\b[^<>]{0,300}?&gt;|!--|!doctype)", re.I)
_ENTITY = re.compile(r"&(?:nbsp|amp|lt|gt|quot|apos|copy|mdash|ndash|hellip|#\d{1,6}|#x[0-9a-f]{1,5});", re.I)
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})([^\n]*)$")
_LATEX = re.compile(r"\\(?:(?:sub){0,2}section\*?\{|chapter\*?\{|paragraph\*?\{|begin\{(?!aligned|array|p?matrix|cases)|end\{(?!aligned|array|p?matrix|cases)|item\b|emph\{|text(?:bf|it|tt|sc|sf)\{|href\{|cite\{|url\{|verb\b|documentclass|usepackage|itshape\b|bfseries\b|noindent\b|maketitle|label\{|ref\{|footnote\{)|(?<=\w)\\[_&%#]")
_WIKI_HEAD = re.compile(r"^(={1,6})[ \t]*([^=\n](?:[^\n]*?[^=\n])?)[ \t]*\1[ \t]*$", re.M)
_WIKI = re.compile(r"'{2,5}(?=\S)[^'\n]+'{2,5}|\[\[[^\[\]\n]+\]\]|\{\{[^{}]+\}\}|^\{\|[^\n]*$|<ref\b|<(?:source|syntaxhighlight|nowiki|references)\b|__[A-Z]{3,}__|(?<![\]\w!])\[https?://[^\s\]]+ [^\]\n]+\](?!\()|<math>(?!\s*<m)|^[*#]+[^\s*#!\w]?[A-Z][a-z]|^\*{2,} +\S|^(?:# .*\n){1,}##? ?[A-Z].*\.$", re.M)
_WIKI_CODE = re.compile(r"<(source|syntaxhighlight|pre)\b[^>]*>(.*?)(?:</\1\s*>|\Z)", re.I | re.S)
_MD_LINE = re.compile(r"^ {0,3}(?:#{1,6}[ \t]+\S|[-+*][ \t]+\S|\d{1,9}[.)][ \t]+\S|>[ \t]?\S|\|.*\|[ \t]*$|(?:[-*_][ \t]*){3,}$)", re.M)
_MD_INLINE = re.compile(r"(?<![\w/*\\])(\*{1,3})(?=[^\s*])[^*\n]*[^\s*]\1(?![\w*])|(?<![\w/_\\])(_{1,3})(?=[^\s_])[^_\n]*[^\s_]\2(?![\w_/])|~~(?=\S)[^~\n]+~~|!?\[[^\[\]\n]*\]\([^()\s]+\)|(?<!`)`[^`\n]+`(?!`)|<https?://[^>\s]+>")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*#*[ \t]*$")
_BULLET = re.compile(r"^(\s*)([-+*]|\d{1,9}[.)])(?:[ \t]+(\S.*)?|$)")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_SPAN_OR_PRE = re.compile(r"(?s)<pre\b.*?(?:</pre\s*>|\Z)|(?<!`)(`+)(?!`)([^\n]+?)(?<!`)\1(?!`)", re.I)
_DOLLAR = re.compile(r"(?<![\\$\w])\$(?![\s$])([^$\n]*?[^\s$\\])\$(?![\w$])")
_MATHY = re.compile(r"[\\^_=+<>|{}]|^[A-Za-z]$|[A-Za-z0-9)] ?[*/-] ?[A-Za-z0-9(]")
_PAREN = re.compile(r"\\\((.+?)\\\)|\\\[(.+?)\\\]", re.S)
_HTML_PART = re.compile(
    r"(?P<comment><!--.*?(?:-->|\Z))|(?P<pre><pre\b[^>]*>(?P<prein>.*?)(?:</pre\s*>|\Z))|(?P<skip><(?P<sk>script|style|head)\b[^>]*>.*?</(?P=sk)\s*>)"
    r"|(?P<math><math\b[^>]*>.*?(?:</math\s*>|\Z))|(?P<span><(?P<sp>span|div)\b[^>]*class\s*=\s*[\"']?[^\"'>]*\bmath\b[^>]*>.*?</(?P=sp)\s*>)"
    r"|(?P<code><code\b[^>]*>.*?(?:</code\s*>|\Z))|(?P<h><h(?P<level>[1-6])\b[^>]*>(?P<hin>(?:(?!<h[1-6]\b).)*?)(?:</h(?P=level)\s*>|(?=<h[1-6]\b)|\Z))|(?P<li><li\b[^>]*>(?P<liin>[^<]*(?:<(?!/?(?:li|ul|ol|pre|h[1-6])\b)[^<]*)*)(?:</li\s*>)?)|(?P<tag>" + _TAG + r"|<!doctype[^>]*>)",
    re.I | re.S,
)
_MATH_SCRIPT = re.compile(r"<script\b[^>]*math/tex", re.I)

#: A leaf: (kind, element, clean text); kind is None for text without markup.
Block = tuple[str | None, str | None, str]
#: Where a container opens or closes: (number of leaves before, opens, tag).
Event = tuple[int, bool, str]
_LEAVES = pa.list_(pa.struct([("kind", pa.string()), ("element", pa.string()), ("text", pa.string()), ("over", pa.list_(pa.int64()))]))
_NODES = pa.list_(pa.struct([("kind", pa.string()), ("hash", pa.int64())]))
_CONTAINERS = frozenset("article aside details div dl figure footer form header main menu nav ol section table ul".split())
_BREAKS = frozenset("p div ul ol table tr body html br hr footer header section".split())
_MARK = re.compile(r"([\x03\x04])(\w+)[\x03\x04]")
_LEADING = re.compile(r"(?:[ \t]*[\x03\x04]\w+[\x03\x04])*")


def _plain(t: str) -> str:
    """Clean text of an inline run: no tags, entities, emphasis or link syntax."""
    t = re.sub(r"<[^<>]*>", "", t)
    t = re.sub(r"!?\[([^\[\]\n]*)\]\([^()\s]*\)", r"\1", t)
    t = re.sub(r"\[\[(?:[^|\[\]\n]*\|)?([^|\[\]\n]*)\]\]", r"\1", t)
    t = re.sub(r"\[https?://\S+ ([^\]\n]+)\]", r"\1", t)
    t = re.sub(r"(?<![\w*])(\*{1,3}|_{1,3}|~~|'{2,5})(?=\S)(.+?)(?<=\S)\1(?!\w)", r"\2", t)
    return html.unescape(t.replace("`", "")).strip()


def _latex(text: str) -> list[Block]:
    out: list[Block] = []
    text = re.sub(r"(?<!\\)%[^\n]*", "", text)
    part = re.compile(
        r"\\begin\{(?P<code>verbatim\*?|Verbatim|lstlisting|minted|alltt)\}(?P<codein>.*?)(?:\\end\{(?P=code)\}|\Z)"
        r"|\\begin\{(?P<eq>equation|align|gather|multline|eqnarray|displaymath|math|flalign|alignat)(?P<star>\*?)\}(?P<eqin>.*?)(?:\\end\{(?P=eq)(?P=star)\}|\Z)"
        r"|(?<!\\)\$\$(?P<dd>.+?)(?:\$\$|\Z)|(?<!\\)\$(?P<d>[^$]+?)(?<!\\)\$|\\\[(?P<br>.+?)(?:\\\]|\Z)|\\\((?P<pa>.+?)\\\)"
        r"|\\verb\*?(?P<vd>[^a-zA-Z\s])(?P<verb>.*?)(?P=vd)|\\texttt\{(?P<tt>[^{}]*)\}"
        r"|\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?(?:\[[^\]]*\])?\{(?P<head>(?:[^{}]|\{[^{}]*\})*)(?:\}|\Z)|(?P<item>\\item\b(?:\[[^\]]*\])?)",
        re.S,
    )
    last = 0

    def words(t: str) -> str:
        t = re.sub(r"\\(?:begin|end)\{[^}]*\}(?:\{[^}]*\})?|\\(?:documentclass|usepackage|label|cite|bibliography)\*?(?:\[[^\]]*\])?\{[^}]*\}|\\href\{[^}]*\}", " ", t)
        t = re.sub(r"\\([_&%#$])", r"\1", re.sub(r"\\[a-zA-Z]+\*?", " ", t)).replace("~", " ")
        return re.sub(r"\s+", " ", re.sub(r"[{}]", "", t)).strip()

    def text_to(end: int) -> None:
        t = words(text[last:end])
        if t:
            if out and out[-1][1] in ("list_item", None) and out[-1][0] == "latex":
                out[-1] = (out[-1][0], out[-1][1], (out[-1][2] + " " + t).strip())
            else:
                out.append(("latex", None, t))

    for m in part.finditer(text):
        text_to(m.start())
        last = m.end()
        if m["codein"] is not None:
            out.append(("latex", "code_block", m["codein"].strip("\n")))
        elif m["head"] is not None:
            out.append(("latex", "heading", words(m["head"])))
        elif m["item"]:
            out.append(("latex", "list_item", ""))
        elif m["verb"] is None and m["tt"] is None:
            out.append(("latex", "formula", next(m[k] for k in ("eqin", "dd", "d", "br", "pa") if m[k] is not None).strip()))
        else:
            out.append(("latex", None, m["verb"] or m["tt"] or ""))
    text_to(len(text))
    return out or [("latex", None, "")]


def _wiki(text: str) -> list[Block]:
    out: list[Block] = []
    spot: list[Block] = []

    def code(m: re.Match) -> str:
        spot.append(("wiki", "code_block", html.unescape(m[2]).strip("\n")))
        return f"\n\x00{len(spot) - 1}\x00\n" if "\n" in m[0] else f"\x00{len(spot) - 1}\x00"

    def formula(m: re.Match) -> str:
        spot.append(("wiki", "formula", html.unescape(m[1] or "").strip()))
        return f"\x00{len(spot) - 1}\x00"

    text = re.sub(r"<!--.*?(?:-->|\Z)", "", text, flags=re.S)
    text = _WIKI_CODE.sub(code, text)
    text = re.sub(r"<(nowiki|code|tt)>.*?</\1>", lambda m: html.escape(m[0]).replace("=", "&#61;"), text, flags=re.I | re.S)
    text = re.sub(r"<(?:math|chem)\b[^>]*>(.*?)(?:</(?:math|chem)>|\Z)", formula, text, flags=re.I | re.S)
    text = re.sub(r"\{\{\s*math\s*\|([^{}]*)\}\}", formula, text)
    text = re.sub(r"<ref\b[^>/]*/>|<ref\b[^>]*>.*?</ref>", "", text, flags=re.I | re.S)
    for line in text.split("\n"):
        if not line.strip():
            continue
        held = [int(x) for x in re.findall(r"\x00(\d+)\x00", line)]
        bare = re.sub(r"\x00\d+\x00", lambda m: spot[int(m[0][1:-1])][2], line)
        if h := _WIKI_HEAD.match(line):
            out.append(("wiki", "heading", _plain(h[2])))
        elif re.match(r"[:;]*[*#][*#:;]*", line):
            out.append(("wiki", "list_item", _plain(re.sub(r"^[*#:;]+", "", bare))))
        elif not re.fullmatch(r"[:;\s]*(?:\x00\d+\x00\s*)+", line):
            clean = _plain(re.sub(r"\{\{[^{}]*\}\}|^\{\|.*|^\|[-}].*|__[A-Z]+__|\[\[Category:[^\]]*\]\]", "", bare))
            out.append(("wiki", None, clean))
        out.extend(spot[i] for i in held)
    return out or [("wiki", None, "")]


def _html(text: str, marked: bool) -> tuple[list[Block], str, bool]:
    """(html subtrees, the text with them as placeholders, whether html occurs)."""
    out: list[Block] = []

    def part(m: re.Match) -> str:
        if m["comment"]:
            return " "
        if m["pre"]:
            out.append(("html", "code_block", html.unescape(re.sub(r"</?code\b[^>]*>", "", m["prein"], flags=re.I)).strip("\n")))
        elif m["math"] or m["span"]:
            out.append(("html", "formula", html.unescape(re.sub(r"<[^>]*>|\\[()\[\]]", "", m[0])).strip()))
        elif m["skip"]:
            if not _MATH_SCRIPT.match(m[0]):
                return " "
            out.append(("html", "formula", re.sub(r"<[^>]*>", "", m[0]).strip()))
        elif m["code"]:
            return html.escape(re.sub(r"<[^>]*>", "", m[0])).replace("$", "&#36;").replace("`", "'").replace("*", "&#42;").replace("_", "&#95;").replace("[", "&#91;")
        elif m["h"] or m["li"]:
            body = m["hin"] if m["h"] else m["liin"]
            at = len(out)
            out.append(("html", "heading" if m["h"] else "list_item", _plain(body)))
            nested = ""
            if "<math" in body.lower() or "<pre" in body.lower() or "math" in body:
                more, _, _ = _html(body, False)
                out.extend(x for x in more if x[1] in ("formula", "code_block"))
                nested = "".join(f"\x01{i}\x01" for i in range(at + 1, len(out)))
            return f"\n\x01{at}\x01{nested}\n"
        else:
            name = re.match(r"<[/!]?(\w*)", m[0])[1].lower()
            mark = "" if name not in _CONTAINERS else f"\x04{name}\x04" if m[0][1] == "/" else f"\x03{name}\x03"
            return ("\n" if name in _BREAKS else "") + mark
        return f"\x01{len(out) - 1}\x01"

    low = text.lower()
    has = bool(_REAL.search(text)) or bool(marked and _ENTITY.search(text))
    return out, (_HTML_PART.sub(part, text) if "<" in low else text), has


def _markdown(text: str, events: list[Event]) -> list[Block]:
    """Markdown with html in it; either may be absent.  Containers of html are
    appended to `events`."""
    out: list[Block] = []
    seen_md = False
    front = _FRONT.match(text)
    if front:
        text, seen_md = text[front.end() :], True
    # code blocks first: what stands in them is not markup
    spot: list[Block] = []
    lines: list[str] = []
    fence, held = None, []
    pre = False
    for line in text.split("\n"):
        if fence:
            if re.match(rf"^ {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*$", line):
                spot.append(("markdown", "code_block", "\n".join(held)))
                lines += ["", f"\x00{len(spot) - 1}\x00", ""]
                fence = None
            else:
                held.append(line)
            continue
        if not pre and (m := _FENCE.match(line)) and "`" not in m[2] and not (m[1][0] == "~" and re.search(r"~\S", m[2])):
            fence, held, seen_md = m[1], [], True
            continue
        low = line.lower()
        if "<pre" in low or "</pre" in low:
            pre = low.rfind("<pre") > low.rfind("</pre")
        lines.append(line)
    if fence:
        spot.append(("markdown", "code_block", "\n".join(held)))
        lines += ["", f"\x00{len(spot) - 1}\x00"]
    text = "\n".join(lines)

    def spans(m: re.Match) -> str:
        nonlocal seen_md
        seen_md = True
        spot.append(("markdown", None, m[2]))
        return f"\x02{len(spot) - 1}\x02"

    page = bool(re.search(r"<(?:html|body|!doctype)\b", text, re.I))
    if "`" in text and not page:
        text = _SPAN_OR_PRE.sub(lambda m: spans(m) if m[1] else m[0], text)
    if "&" in text and _ESCAPED.search(re.sub(r"(?is)<(pre|code)\b.*?(?:</\1\s*>|\Z)", "", text)):
        text = re.sub(r"(?is)<(?:pre|code)\b.*?(?:</(?:pre|code)\s*>|\Z)|&lt;|&gt;|&quot;", lambda m: m[0] if m[0][0] == "<" else html.unescape(m[0]), text)
    tags, text, has_html = _html(text, True)

    def formula(t: str) -> str:
        nonlocal seen_md

        def put(m: re.Match) -> str:
            nonlocal seen_md
            body = next(x for x in m.groups() if x is not None)
            if m.re is _DOLLAR and not _MATHY.search(body):
                return m[0]
            seen_md = True
            spot.append(("markdown", "formula", _MARK.sub("", body).strip()))
            return f"\x00{len(spot) - 1}\x00"

        if "$$" in t:
            t = re.sub(r"(?s)\$\$(?!\$)(.+?)(?:\$\$|\Z)", put, t)
        if "$" in t:
            t = _DOLLAR.sub(put, t)
        if "\\(" in t or "\\[" in t:
            t = _PAREN.sub(put, t)
        return t

    text = formula(text)
    back = lambda t: re.sub(r"[\x00\x01\x02](\d+)[\x00\x01\x02]", lambda m: (tags if m[0][0] == "\x01" else spot)[int(m[1])][2], t)
    para: list[str] = []
    in_list = code_open = False
    indented: list[str] = []
    blank = True

    def flush() -> None:
        if para:
            t = " ".join(para)
            kind = "markdown" if seen_md else "html" if has_html else None
            out.append((kind, None, _plain(back(t))))
            para.clear()

    def flush_code() -> None:
        nonlocal code_open
        if code_open:
            out.append(("markdown", "code_block", "\n".join(indented)))
            indented.clear()
            code_open = False

    def inner(line: str) -> None:
        for mark, no in re.findall(r"([\x00\x01])(\d+)[\x00\x01]", line):
            b = (tags if mark == "\x01" else spot)[int(no)]
            if b[1]:
                out.append(b)

    for line, marks in _with_marks(text):
        if marks:
            flush()
            events.extend((len(out), m[0] == "\x03", m[1]) for m in marks)
            continue
        if not page and line.startswith(">"):
            seen_md = True
            line = line.lstrip("> ")
        if not line.strip():
            flush()
            if code_open:
                indented.append("")
            blank = True
            continue
        if not page and not in_list and (code_open or blank) and re.match(r"(?: {4}|\t)\s*\S", line) and "\x01" not in line:
            flush()
            code_open = seen_md = True
            indented.append(line[4:])
            continue
        flush_code()
        if page:
            clean = line.strip()
            if not re.fullmatch(r"\s*(?:[\x00\x01]\d+[\x00\x01]\s*)+", line):
                para.append(clean)
            inner(line)
        elif (m := _ATX.match(line)) and m[2]:
            flush()
            seen_md = True
            out.append(("markdown", "heading", _plain(back(m[2]))))
            inner(line)
            in_list = False
        elif para and not in_list and re.match(r"^ {0,3}(?:=+|-{2,})[ \t]*$", line):
            t = " ".join(para)
            para.clear()
            seen_md = True
            out.append(("markdown", "heading", _plain(back(t))))
        elif _RULE.match(line):
            flush()
            seen_md = True
        elif (m := _BULLET.match(line)) and (m[3] or in_list) and (in_list or len(m[1].expandtabs(4)) < 4) and not (para and m[2][0].isdigit() and m[2][:-1] != "1"):
            flush()
            seen_md = in_list = True
            out.append(("markdown", "list_item", _plain(back(re.sub(r"^\[[ xX]\] ", "", m[3] or "")))))
            inner(line)
        else:
            if blank and not line.startswith(" "):
                in_list = False
            only = re.fullmatch(r"\s*(?:[\x00\x01]\d+[\x00\x01]\s*)+", line)
            if only:
                flush()
            elif not re.fullmatch(r"\s*\|?[-:| ]+\|?\s*", line):
                para.append(line.strip())
            if not seen_md and (_MD_INLINE.search(line) or re.match(r"^\s*\|.*\|\s*$", line)):
                seen_md = True
            inner(line)
        if not seen_md and _MD_INLINE.search(line) and not page:
            seen_md = True
        blank = False
    flush()
    flush_code()
    kinds = {b[0] for b in out if b[1]}
    if has_html and "html" not in kinds:
        out.append(("html", None, ""))
    if seen_md and not any(b[0] == "markdown" for b in out):
        out.append(("markdown", None, ""))
    return out


def _with_marks(text: str) -> Iterator[tuple[str, list]]:
    """(line without container marks, []) or ('', marks), in order."""
    for line in text.split("\n"):
        if "\x03" not in line and "\x04" not in line:
            yield line, []
            continue
        lead = _LEADING.match(line)[0]
        if lead:
            yield "", [(m[1], m[2]) for m in _MARK.finditer(lead)]
        yield _MARK.sub("", line), []
        if rest := [(m[1], m[2]) for m in _MARK.finditer(line, len(lead))]:
            yield "", rest


def _outside_code(text: str) -> str:
    """Text without fenced and tagged code, for telling the dialect."""
    if "```" in text or "~~~" in text:
        text = re.sub(r"(?ms)^ {0,3}(`{3,}|~{3,})[^\n]*$.*?(?:^ {0,3}\1[`~]*[ \t]*$|\Z)", "", text)
    if "<" in text:
        text = re.sub(r"(?is)<(pre|code|nowiki)\b[^>]*>.*?(?:</\1\s*>|\Z)", "", text)
        text = re.sub(r"(?is)(<(source|syntaxhighlight)\b[^>]*>).*?(?:</\2\s*>|\Z)", r"\1", text)
    if "\\begin{" in text:
        text = re.sub(r"(?s)(\\begin\{(verbatim|lstlisting|minted)\}).*?(?:\\end\{\2\}|\Z)", r"\1", text)
    if "    " in text:
        text = re.sub(r"(?m)^(?: {4}|\t).*$", "", text)
    return text


def parse_page(raw: str | None, path: str | None = None, events: list[Event] | None = None) -> list[Block]:
    """The leaves of a page in order; containers are appended to `events`.  Null
    and blank texts have none; program source is one leaf without markup."""
    if raw is None or not raw.strip():
        return []
    text = re.sub(r"[\x00-\x04]", "", raw.replace("\r\n", "\n").replace("\r", "\n"))
    name = (path or "").rsplit("/", 1)[-1].lower()
    if "." in name and name.rsplit(".", 1)[-1] in SOURCE_ENDINGS:
        return [(None, None, text.strip())]
    if "&lt;" in text and not _REAL.search(text) and _ESCAPED.search(re.sub(r"`[^`\n]*`", "", _outside_code(text))):
        text = html.unescape(text)
    front = _FRONT.match(text)
    shell = _outside_code(text[front.end() :] if front else text)
    no_math = re.sub(r"(?s)\$\$.*?\$\$", "", shell) if "$$" in shell else shell
    if "\\" in no_math and _LATEX.search(no_math) and not re.search(r"^#{1,6} |^[-*+] ", no_math, re.M):
        return _latex(text)
    if "\\begin{" in no_math and _LATEX.search(no_math):
        return _latex(text)
    if name.endswith(".tex") and re.search(r"\$[^$\n]*[\\^_=][^$\n]*\$|^[ \t]*%", no_math, re.M):
        return _latex(text)
    wiki = len(_WIKI_HEAD.findall(shell)) + len(_WIKI.findall(shell))
    if wiki and not front:
        md = len(re.findall(r"(?m)^ {0,3}(?:#{2,6} [A-Z]|- |\+ |\d+[.)] |```|~~~)|\]\(|^[^\n=#*|\s][^\n]*\n(?:={3,}|-{3,})$|(?<![\w*])\*\*(?=\S)[^*\n]+\*\*", text))
        tags = 0 if name.endswith(".wiki") or "/wiki/" in (path or "") else len(re.findall(r"<(?:h[1-6]|li|p|ul|ol|div)\b", shell, re.I))
        if wiki >= max(md, tags):
            return _wiki(text)
    if name.endswith(".wiki") or "/wiki/" in (path or ""):
        if re.search(r"^[*#]|^=+.*=+\s*$|<|\[|''|\{\{", shell, re.M):
            return _wiki(text)
        return [(None, None, text.strip())]
    return _markdown(text, [] if events is None else events)


def subtrees(leaves: list[Block], events: list[Event]) -> list[tuple[str, int, int]]:
    """(tag, from, to) of every subtree with more than one leaf: containers,
    lists (list items side by side) and sections (a heading and what follows up
    to the next).  A container that is never closed ends with the page."""
    spans: set[tuple[str, int, int]] = set()
    stack: list[tuple[str, int]] = []
    for at, opens, tag in events:
        if opens:
            stack.append((tag, at))
        elif any(t == tag for t, _ in stack):
            while True:
                t, start = stack.pop()
                spans.add((t, start, at))
                if t == tag:
                    break
    spans |= {(t, start, len(leaves)) for t, start in stack}
    start = 0
    for i in range(1, len(leaves) + 1):
        if i == len(leaves) or (leaves[i][1] == "list_item") != (leaves[i - 1][1] == "list_item"):
            if leaves[start][1] == "list_item":
                spans.add(("list", start, i))
            start = i
    heads = [i for i, x in enumerate(leaves) if x[1] == "heading"] + [len(leaves)]
    spans |= {("section", i, j) for i, j in zip(heads, heads[1:])}
    return sorted((s for s in spans if s[2] - s[1] > 1), key=lambda s: (s[1], -s[2], s[0]))


def _digest(*parts: bytes) -> bytes:
    h = blake2b(digest_size=8)
    for p in parts:
        h.update(p)
    return h.digest()


def page_trees(pages: DataFrame, id_col: str, host_col: str, text_col: str, path_col: str, least_chars: int) -> DataFrame:
    """One row per page: (id, host, page, leaves[], nodes[]).

    `page` is a hash of the whole text; a leaf has its kind, element, text and
    the hashes of the subtrees that hold it (`over`, itself included); `nodes` are
    the distinct (kind, hash) of the page's subtrees.  Subtrees whose clean text
    has less than `least_chars` characters are too short to be told from one
    another and have no hash."""

    def one(raw: str | None, path: str | None) -> tuple[list, list]:
        events: list[Event] = []
        leaves = parse_page(raw, path, events)
        own = [_digest(f"{k}\x00{e}\x00{t}".encode("utf-8", "replace")) for k, e, t in leaves]
        size = [0]
        for _, _, t in leaves:
            size.append(size[-1] + len(t))
        over: list[list[int]] = [[] for _ in leaves]
        nodes: set[tuple[str, int]] = set()
        for tag, lo, hi in [("", i, i + 1) for i in range(len(leaves))] + subtrees(leaves, events):
            kind = next((k for k, _, _ in leaves[lo:hi] if k), None)
            if kind is None or size[hi] - size[lo] + 4 * (hi - lo - 1) < least_chars:  # a line end and a mark between leaves
                continue
            h = int.from_bytes(own[lo] if hi - lo == 1 else _digest(tag.encode(), *own[lo:hi]), "little", signed=True)
            nodes.add((kind, h))
            for i in range(lo, hi):
                over[i].append(h)
        return [{"kind": k, "element": e, "text": t, "over": o} for (k, e, t), o in zip(leaves, over)], [{"kind": k, "hash": h} for k, h in sorted(nodes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, path = b.column("raw").to_pylist(), b.column("path").to_pylist()
            trees = [one(r, p) for r, p in zip(raw, path)]
            page = [int.from_bytes(_digest((r or "").encode("utf-8", "replace")), "little", signed=True) for r in raw]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("host"), pa.array(page, pa.int64()), pa.array([t[0] for t in trees], _LEAVES), pa.array([t[1] for t in trees], _NODES)], ["id", "host", "page", "leaves", "nodes"])

    p = pages.select(pages[id_col].cast("long").alias("id"), pages[host_col].alias("host"), pages[text_col].alias("raw"), pages[path_col].alias("path"))
    return p.mapInArrow(run, "id long, host string, page long, leaves array<struct<kind:string,element:string,text:string,over:array<long>>>, nodes array<struct<kind:string,hash:long>>")


def templates(trees: DataFrame, least_pages: int, share: float) -> DataFrame:
    """(host, often[]): hashes of the subtrees that stand on at least
    `least_pages` pages and `share` of the host's pages with markup of their kind.

    Pages count once for all copies of a text, and pairs are combined before the
    shuffle, so a host that holds a third of all pages is pre-aggregated.  A page
    has few subtrees, so at most its number over `share` can be that frequent: the
    array of a host is bounded by the length of its pages."""
    n = trees.where("host IS NOT NULL").select("host", "page", F.explode("nodes").alias("n")).select("host", "page", "n.kind", "n.hash").distinct()
    per = n.groupBy("host", "kind", "hash").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    kinds = F.array_compact(F.array_distinct(F.transform("leaves", lambda x: x["kind"])))
    hosts = trees.where("host IS NOT NULL").select("host", "page", F.explode(kinds).alias("kind")).distinct().groupBy("host", "kind").agg(F.count("*").alias("all_pages"))
    often = per.join(hosts, ["host", "kind"]).where(F.col("pages") >= F.lit(share) * F.col("all_pages"))
    return often.groupBy("host").agg(F.collect_set("hash").alias("often"))


ELEMENTS = ("heading", "list_item", "code_block", "formula")


def markup(pages: DataFrame, id_col: str = "id", host_col: str = "source_repo", text_col: str = "raw_content", path_col: str = "source_path", least_pages: int = 10, share: float = 0.3, least_chars: int = 20) -> tuple[DataFrame, DataFrame]:
    """(found, clean): found(id, kind, element, n) as stated for the problem: the
    leaves of all subtrees, template or not; clean(id, text): the text without
    markup and template, with `#` before headings, `-` before list items, code
    fenced and formulas between `$`.  A null host has no template; rows with the
    same id are counted together and each cleaned."""
    trees = cut_lineage(page_trees(pages, id_col, host_col, text_col, path_col, least_chars))
    leaf = trees.select("id", F.explode("leaves").alias("x")).where("x.kind IS NOT NULL").groupBy("id", "x.kind")
    n = leaf.agg(*[F.count_if(F.col("x.element") == e).cast("int").alias(e) for e in ELEMENTS])
    each = F.array(*[F.struct(F.lit(e).alias("element"), F.col(e).alias("n")) for e in ELEMENTS])
    some = F.filter(each, lambda s: s["n"] >= 1)
    rows = F.when(F.size(some) > 0, some).otherwise(F.array(F.struct(F.lit("none").alias("element"), F.lit(0).alias("n"))))
    found = n.select("id", "kind", F.explode(rows).alias("r")).select("id", "kind", "r.element", "r.n")
    return found, cleaned(trees, templates(trees, least_pages, share))


def cleaned(trees: DataFrame, often: DataFrame) -> DataFrame:
    """(id, text) of pages without the leaves that a template subtree holds; the
    page is one row, so nothing is grouped."""
    often = broadcast_if_small(often)
    kept = F.filter("leaves", lambda x: (x["text"] != "") & ~F.coalesce(F.arrays_overlap(x["over"], F.col("often")), F.lit(False)))
    tick = "```"

    def line(x):
        return (
            F.when(x["element"] == "heading", F.concat(F.lit("# "), x["text"]))
            .when(x["element"] == "list_item", F.concat(F.lit("- "), x["text"]))
            .when(x["element"] == "code_block", F.concat(F.lit(tick + "\n"), x["text"], F.lit("\n" + tick)))
            .when(x["element"] == "formula", F.concat(F.lit("$"), x["text"], F.lit("$")))
            .otherwise(x["text"])
        )

    return trees.where(F.size("leaves") > 0).join(often, "host", "left").select("id", F.array_join(F.transform(kept, line), "\n\n").alias("text"))
