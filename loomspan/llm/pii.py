"""Personal data in free text (problem 10): bootstrapped contextual extraction.

One pass finds everything that could be a name, a number or an address by its
form, with the lexical patterns around it (words to the left and right).  Seed
entities (hinted names, strongly typed numbers, known street words) give the
patterns their first evidence.  Spark scores the graph of patterns and instances
over several rounds: a pattern is trusted if enough different instances around it
are known and they are a large enough share of all different instances there; the
instances of trusted patterns are known in the next round, and so unseen names,
numbers and streets are found.  A phrase that is repeated word for word is one
instance, so boilerplate earns no trust.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.session import broadcast_if_small, cut_lineage

#: Titles, street words and unit words of the four languages.
TITLES = "Dr Prof Mr Mrs Ms Miss Mme Mlle Mgr Me Herr Frau Sr Sra Srta Don Doña Señor Señora Monsieur Madame Ing Lic".split()
STREET_EN = "Street Road Lane Avenue Ave Court Way Drive Place Terrace Boulevard".split()
STREET_DE = "straße strasse gasse weg platz allee ufer".split()
STREET_FR = "rue avenue quai impasse boulevard place chemin allée cours route square sentier".split()
STREET_ES = "Calle Plaza Avenida Avda Camino Paseo Carrera Ronda Travesía".split()
UNITS = "Apt Unit Suite Flat Apartment Floor Room".split()

_UP, _LO = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
_CAP = rf"(?:[{_UP}]['’][{_UP}][{_LO}]+|[{_UP}][{_LO}]+(?:['’-][{_UP}]?[{_LO}]+)*)"
_ALL = rf"[{_UP}](?:['’]?[{_UP}]{{2,}})(?:['’-][{_UP}]+)*"
_NOT_TITLE = rf"(?!(?:{'|'.join(TITLES)})\b)"
_NAME = re.compile(
    rf"(?=[{_UP}])(?<![\w.'’@/-])(?:(?=(?P<b>[{_UP}]\.(?: ?[{_UP}]\.)? (?:{_CAP}|{_ALL}))(?![\w@]|['’-]\w))|{_NOT_TITLE}(?=(?P<a>(?:{_CAP}(?: [{_UP}]\.)? {_CAP}|{_ALL}(?: [{_UP}]\.)? {_ALL}))(?![\w@]|['’-]\w))"
    rf"|{_NOT_TITLE}(?=(?P<c>(?:{_CAP}, (?:{_CAP}(?: [{_UP}]\.(?!\w))?|[{_UP}]\.)|{_ALL}, (?:{_ALL}(?: [{_UP}]\.(?!\w))?|[{_UP}]\.)))(?!\w|['’-]\w)))"
)
_EMAIL = re.compile(r"(?<![\w.+@/-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![\w@-]|\.\w|:\S)", re.A)
_DOT = r"(?: ?[\[({] ?dot ?[\])}] ?| dot )"
_AT = r"(?: ?[\[({] ?at ?[\])}] ?| at )"
_SPELLED = re.compile(
    rf"(?<![\w.+@-])[A-Za-z0-9][\w.+-]*(?:{_DOT}[\w+-]+)*(?:(?: ?[\[({{] ?at ?[\])}}] ?)[\w-]+(?:(?:{_DOT}|\.)[\w-]+)*(?:{_DOT}|\.)[A-Za-z]{{2,24}}| at [\w-]+(?:{_DOT}[\w-]+)*{_DOT}[A-Za-z]{{2,24}}|@[\w-]+(?:(?:{_DOT}|\.)[\w-]+)*{_DOT}[A-Za-z]{{2,24}})(?![\w@])",
    re.I | re.A,
)
_NUMBER = re.compile(r"(?<![\w@./:+#$€-])(?:[+(]\d(?:[\d ()/-]|\.(?=\d)){5,22}\d|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-Z]|\d(?:[\d ()/-]|\.(?=\d)){5,22}\d(?:[ -]?[A-Z])?|\d{7,15}[A-Z]?|\d{2}[A-Z]{2}\d{5}|[A-Z]\d{6,9}(?:-?[A-Z])?|(?=[A-Z0-9]*[A-Z])(?=(?:[A-Z]*\d){4})[A-Z0-9]{8,12})(?![\w]|[.:/-]\d|:\d)")
_STREET = {
    "en": rf"\d{{1,5}}[a-z]? (?:(?!(?:{'|'.join(UNITS)})\b)(?:{_CAP}|&) )*(?!(?:{'|'.join(UNITS)})\b){_CAP}(?:,? (?:{'|'.join(UNITS)})\.? ?\w+)?(?:, {_CAP}(?: {_CAP})* \d{{4,6}})?",
    "fr": rf"\d{{1,4}}(?: (?:bis|ter|quater))?,? (?:{'|'.join(STREET_FR)}) (?:(?:du|des|de la|de|aux|au|à la|d['’]|l['’]|le|la|les) ?)?(?:{_CAP} ?)+(?<! )(?:, \d{{5}} {_CAP}(?:[ -](?:(?:sur|en|la|le|les|du|de|des)[ -])?{_CAP})*)?",
    "eu": rf"(?:(?:Am|An der|An den|Im|In der|Zum|Zur|Auf der|Auf dem|Unter den) )?{_CAP}(?:(?: (?:del|de la|de los|de las|de|la|el))? {_CAP})*,? \d{{1,4}}(?: ?[a-z](?!\w))?(?:, \d{{5}} {_CAP}(?: (?:(?:am|an der|im|in der|ob der|del|de la|de los|de) )?{_CAP})*)?",
}
_ADDRESS = [(k, re.compile(rf"(?<![\w@./-])(?:{v})(?!\w)")) for k, v in _STREET.items()]
_TYPED_STREET = re.compile(rf"\b(?:{'|'.join(STREET_EN + STREET_FR + STREET_ES)})\b|(?:{'|'.join(STREET_DE)})\b|\b(?:{'|'.join(x.capitalize() for x in STREET_DE)})\b")
_WORD = re.compile(r"\S+")


def _side(text: str, start: int, end: int) -> list[str]:
    """The patterns around a span: one and two words to each side, within the
    line, digits as 0; the line's border is a word of its own."""
    lo = text.rfind("\n", max(0, start - 60), start)
    left = text[lo + 1 if lo >= 0 else max(0, start - 60) : start]
    words = _WORD.findall(left)
    if lo >= 0 or start < 60:
        words = ["^", *words]
    glued = "" if not left or left[-1] in " \t" else "~"
    left2 = [re.sub(r"\d+", "0", w) for w in words[-2:]]
    if left2 and not glued and left2[-1][-1] in ".?!;" and len(left2[-1]) > 4 and left2[-1][:-1] not in TITLES:
        left2 = ["^"]  # a sentence starts here, as a line would
    hi = text.find("\n", end, end + 60)
    right = text[end : hi if hi >= 0 else end + 60]
    rw = _WORD.findall(right)
    if hi >= 0 or end + 60 >= len(text):
        rw.append("$")
    glue = "" if not right or right[0] in " \t" else "~"
    right2 = [re.sub(r"\d+", "0", w) for w in rw[:2]]
    if right2 and re.fullmatch(r"[.!?]+", right2[0]):
        right2 = ["."]  # the sentence ends; what follows says nothing
    out = []
    if left2:
        if left2[-1] != "^":
            out.append("l" + glued + left2[-1])
        if len(left2) > 1:
            out.append("L" + glued + " ".join(left2))
    if right2:
        if len(right2) > 1:
            out.append("R" + glue + " ".join(right2))
        if left2 and left2 != ["^"]:
            out.append("B" + glued + left2[-1] + " _ " + glue + right2[0])
    return out


def _shape(t: str) -> str:
    return re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", t))


#: Number forms that are enough by themselves.
_STRONG_PHONE = re.compile(r"\+\d{1,3}[ -]?(?:\(\d{1,4}\)[ -]?)?\d[\d ()./-]{5,}\d$|\(\d{3}\) \d{3}-\d{4}$|00(?:1|3[0-9]|4[0-9]) \d[\d ]{6,}\d$")
_STRONG_ID = re.compile(r"[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]$|\d{3}-\d\d-\d{4}$|\d{8}-?[A-Z]$|[XYZ]\d{7}-?[A-Z]$|\d \d\d \d\d \d\d \d{3} \d{3} \d\d$|\d\d \d{3} \d{3} \d{3}$|[A-Z]\d{8}$")


def _name_parts(form: str, found: str) -> tuple[str, str]:
    """(given, family) as written; an initial stands for a given name."""
    if form == "c":
        family, given = found.split(", ", 1)
        return given.split(" ")[0], family
    p = found.split(" ")
    return p[0], p[-1]


def candidates(text: str, given: frozenset[str], family: frozenset[str]) -> Iterator[tuple]:
    """(group, kind, start, end, found, instance, a, b, patterns); kind is set where
    the form or a seed tells it."""
    for rx in (_EMAIL, _SPELLED):
        if rx is _EMAIL and "@" not in text:
            continue
        if rx is _SPELLED and not re.search(r"\bdot\b|[\[({] ?(?:at|dot) ?[\])}]", text, re.I):
            continue
        for m in rx.finditer(text):
            yield "email", "email", m.start(), m.end(), m.group(), m.group(), None, None, []
    for m in _NUMBER.finditer(text):
        s = m.group()
        digits = sum(c.isdigit() for c in s)
        if s[:1] == "(" and ")" not in s or not 5 <= digits <= 16:
            continue
        if re.match(r"\d{4}-\d\d-\d\d(?: \d\d)?$", s):
            continue
        kind = "phone" if _STRONG_PHONE.match(s) else "id_number" if _STRONG_ID.match(s) else None
        yield "number", kind, m.start(), m.end(), s, s, _shape(s), None, _side(text, m.start(), m.end())
    for k, rx in _ADDRESS:
        for m in rx.finditer(text):
            s = m.group()
            seed = "address" if _TYPED_STREET.search(s) else None
            if seed or k != "eu" or re.search(r", \d{5} ", s) or len(re.findall(_CAP, s)) <= 3:
                yield "address", seed, m.start(), m.end(), s, re.sub(r"\d+", "0", s), k, None, _side(text, m.start(), m.end())
    for m in _NAME.finditer(text):
        for form in "abc":
            if m[form] is None:
                continue
            s = m[form]
            g, f = _name_parts(form, s)
            g, f = g.casefold(), f.casefold()
            seed = f in family or (g in given and form != "c")
            yield "name", "name" if seed and g not in family else None, m.start(), m.start() + len(s), s, f"{g}|{f}", g, f, _side(text, m.start(), m.start() + len(s))


_FOUND = "doc_id long, text_id long, grp string, kind string, start int, stop int, found string, inst string, a string, b string, pats array<string>"


def _occurrences(documents: DataFrame, hints: DataFrame) -> DataFrame:
    rows = hints.select("name", "role").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("name_hints is a hint list of at most 100,000 names")
    given = frozenset(r["name"].casefold() for r in rows if r["role"] == "given" and r["name"])
    family = frozenset(r["name"].casefold() for r in rows if r["role"] == "family" and r["name"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, h, *c) for i, h, t in zip(b["doc_id"], b["text_id"], b["text"]) if t for c in candidates(t, given, family)]
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "text_id", "grp", "kind", "start", "stop", "found", "inst", "a", "b", "pats"])

    return documents.select(documents["doc_id"].cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), "text").where("text IS NOT NULL").mapInPandas(run, _FOUND)


def _trusted(edges: DataFrame, totals: DataFrame, known: DataFrame, least: int, share: float) -> DataFrame:
    """(grp, pat, kind, score) of the patterns trusted with the known instances."""
    pos = edges.join(known, ["grp", "inst"]).groupBy("grp", "pat", "kind").agg(F.count("*").alias("pos"))
    score = F.col("pos") / F.col("n")
    # numbers hardly repeat, so fewer of a pattern's are known at first
    enough = F.when(F.col("grp") == "number", F.lit(share / 2)).otherwise(F.lit(share))
    good = pos.join(totals, ["grp", "pat"]).where((F.col("pos") >= least) & (score >= enough))
    return good.where((F.col("grp") != "number") | (F.col("forms") >= 2)).select("grp", "pat", "kind", score.alias("score"))


def score_graph(occ: DataFrame, rounds: int = 3, least: int = 3, share: float = 0.3) -> DataFrame:
    """Trusted patterns after the given rounds.

    Edges are distinct (group, pattern, instance), so what is repeated counts
    once; all counts are combined before the shuffle."""
    edges = cut_lineage(occ.where("grp <> 'email'").select("grp", "inst", "a", F.explode("pats").alias("pat")).distinct())
    totals = cut_lineage(edges.groupBy("grp", "pat").agg(F.count("*").alias("n"), F.count_distinct("a").alias("forms")).where(F.col("n") >= least))
    seeds = occ.where("kind IS NOT NULL AND grp <> 'email'").select("grp", "inst", "kind").distinct()
    known = cut_lineage(seeds)
    for r in range(rounds):
        trusted = cut_lineage(_trusted(edges, totals, known, least, share))
        if r == rounds - 1:
            break
        new = edges.join(broadcast_if_small(trusted, written=True), ["grp", "pat"]).where("score >= 0.5 OR grp = 'number'").groupBy("grp", "inst").agg(F.max_by("kind", "score").alias("kind"))
        new = new.join(seeds.select("grp", "inst"), ["grp", "inst"], "left_anti")
        known = cut_lineage(seeds.unionByName(new.select("grp", "inst", "kind")))
    return trusted


def _apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of overlapping findings of a document the best: by rank, then score, then
    the earlier one."""
    for b in batches:
        out = []
        for doc, rows in zip(b["doc_id"], b["rows"]):
            keep: list[dict] = []
            for r in sorted(rows, key=lambda r: (-r["rank"], -r["score"], r["start"])):
                if all(r["stop"] <= k["start"] or r["start"] >= k["stop"] for k in keep):
                    keep.append(r)
            out += [(doc, k["kind"], k["start"], k["stop"], k["found"]) for k in keep]
        yield pd.DataFrame(out, columns=["doc_id", "kind", "start", "stop", "found"])


def find_personal_data(documents: DataFrame, hints: DataFrame) -> DataFrame:
    """(doc_id, kind, start, stop, found) of every piece, none overlapping.

    Null and empty texts have none; equal texts each have theirs."""
    occ = cut_lineage(_occurrences(documents, hints))
    trusted = score_graph(occ)
    rest = occ.where("grp <> 'email'").withColumn("oid", F.monotonically_increasing_id())
    # an instance is trusted if enough of the places where it stands are
    hits = rest.select("oid", "grp", "start", F.explode("pats").alias("pat")).join(broadcast_if_small(trusted, written=True), ["grp", "pat"])
    best = hits.groupBy("oid").agg(F.max("score").alias("score"), F.max_by("kind", "score").alias("by"), F.count("*").alias("votes"))
    best = best.withColumn("votes", F.least("votes", F.lit(4)))
    scored = cut_lineage(rest.join(best, "oid", "left"))
    # equal texts are one, so a place counts once in all copies of a text
    places = scored.select("grp", "inst", "text_id", "start", "score").distinct()
    solid = places.groupBy("grp", "inst").agg(F.count("*").alias("all_n"), F.sum(F.when(F.col("score") >= 0.3, 1).otherwise(0)).alias("good_n"))
    hollow = solid.where("all_n >= 4 AND good_n < 0.25 * all_n").select("grp", "inst", F.lit(True).alias("hollow"))
    scored = cut_lineage(scored.join(broadcast_if_small(hollow), ["grp", "inst"], "left"))
    # a name is known by its parts if both stand in trusted names with others
    named = scored.where("grp = 'name' AND score >= 0.5 AND hollow IS NULL").select("a", "b").distinct()
    lex_g = named.groupBy("a").agg(F.count("*").alias("n")).where("n >= 2 AND length(a) > 2").select("a", F.lit(1).alias("ga"))
    lex_f = named.groupBy("b").agg(F.count("*").alias("n")).where("n >= 2").select("b", F.lit(1).alias("fb"))
    scored = scored.join(broadcast_if_small(lex_g), "a", "left").join(broadcast_if_small(lex_f), "b", "left")
    s = F.coalesce("score", F.lit(0.0))
    by_parts = (F.col("grp") == "name") & F.col("fb").isNotNull() & (F.col("ga").isNotNull() | ((F.length("a") == 2) & (s > 0)))
    # what form, seed or parts decide needs no trusted place
    full = F.col("hollow").isNull()
    ok = (
        F.when(F.col("grp") == "name", ((s >= 0.5) & full) | by_parts | (F.col("kind").isNotNull() & (s >= 0.3)))
        .when(F.col("grp") == "number", ((s >= 0.3) & full) | F.col("kind").isNotNull())
        .otherwise((F.col("kind").isNotNull() & F.col("a").isin("fr")) | ((s >= 0.3) & full))
    )
    rank = s + F.coalesce("votes", F.lit(0)) * 0.2 + F.when(F.col("grp") == "address", 2.0).otherwise(0.0) + F.when(by_parts, F.when(F.col("ga").isNotNull(), 1.3).otherwise(1.0)).otherwise(0.0) + F.when(F.col("kind").isNotNull(), 0.3).otherwise(0.0) + F.length("found") / 10_000.0
    kind = F.when(F.col("grp") == "number", F.coalesce("by", "kind")).otherwise(F.col("grp"))
    kept = scored.where(ok).select("doc_id", kind.alias("kind"), "start", "stop", "found", s.alias("score"), rank.alias("rank"))
    mail = occ.where("grp = 'email'").select("doc_id", "kind", "start", "stop", "found", F.lit(1.0).alias("score"), F.lit(9.0).alias("rank"))
    each = kept.unionByName(mail).groupBy("doc_id").agg(F.collect_list(F.struct("kind", "start", "stop", "found", "score", "rank")).alias("rows"))
    return each.mapInPandas(_apart, "doc_id long, kind string, start int, stop int, found string")


def personal_data(documents: DataFrame, hints: DataFrame) -> DataFrame:
    """(doc_id, kind, found): distinct pieces of each document."""
    return find_personal_data(documents, hints).select("doc_id", "kind", "found").distinct()


def redact(documents: DataFrame, hints: DataFrame) -> DataFrame:
    """(doc_id, text) with each piece replaced by [EMAIL], [PHONE], [ID_NUMBER],
    [ADDRESS] or [NAME]; the rest stays, null texts stay null."""
    spans = find_personal_data(documents, hints).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "kind"))).alias("spans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for t, spans in zip(b["text"], b["spans"]):
                if t and spans is not None:
                    at, out = 0, []
                    for s in spans:
                        out += [t[at : s["start"]], f"[{s['kind'].upper()}]"]
                        at = s["stop"]
                    t = "".join(out) + t[at:]
                texts.append(t)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": texts})

    d = documents.select(documents["doc_id"].cast("long").alias("doc_id"), "text").join(spans, "doc_id", "left")
    return d.mapInPandas(run, "doc_id long, text string")
