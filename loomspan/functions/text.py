"""Column functions on text: keys, tokens, hashes, sanitising, checks (SC-*, HL-*)."""

from __future__ import annotations

import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Latin letters with a mark, and the letters without it.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
BARE = "aaaaaaceeeeiiiinooooouuuuyy"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def name_key(c: Column | str) -> Column:
    """Lower case, only a-z, 0-9 and white space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(_c(c)), r"[^a-z0-9\s]", ""))


def label_key(c: Column | str) -> Column:
    """Lower case without blanks, hyphens and underscores."""
    return F.regexp_replace(F.lower(F.trim(_c(c))), r"[-_\s]+", "")


def word_set(c: Column | str) -> Column:
    """Distinct lower-case words of letters, digits and `_`."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def search_tokens(c: Column | str) -> Column:
    """Lower-case tokens of letters and digits without marks, in order."""
    return F.regexp_extract_all(F.translate(F.lower(_c(c)), ACCENTED, BARE), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def content_hash(c: Column | str) -> Column:
    return F.sha2(F.coalesce(_c(c), F.lit("")), 256)


def record_hash(name: Column, summary: Column, path: Column, raw: Column | None = None) -> Column:
    """sha256 of name|summary|path, with |raw only if raw is not empty."""
    parts = [F.coalesce(x, F.lit("")) for x in (name, summary, path)]
    base = F.concat_ws("|", *parts)
    if raw is not None:
        base = F.concat(base, F.when(F.coalesce(raw, F.lit("")) != "", F.concat(F.lit("|"), raw)).otherwise(F.lit("")))
    return F.sha2(base, 256)


def escape_html(c: Column | str) -> Column:
    out = _c(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def sanitize_query(c: Column | str) -> Column:
    """Without brackets, carets and tildes; double quotes doubled; trimmed."""
    return F.trim(F.replace(F.regexp_replace(_c(c), r"[{}()\[\]^~]", ""), F.lit('"'), F.lit('""')))


def identifier_check(c: Column | str) -> Column:
    """struct(valid, errors[]): not empty, at most 256 of letters, digits, `_-.`."""
    c = F.coalesce(_c(c), F.lit(""))
    errors = F.array_compact(
        F.array(
            F.when(c == "", F.lit("empty")),
            F.when(F.length(c) > 256, F.lit("too long")),
            F.when((c != "") & ~c.rlike(r"^[a-zA-Z0-9_.-]+$"), F.lit("bad character")),
        )
    )
    return F.struct((F.size(errors) == 0).alias("valid"), errors.alias("errors"))


def dangerous_query(c: Column | str) -> Column:
    """Longer than 500 characters, or with an SQL verb or comment sign."""
    return (F.length(_c(c)) > 500) | _c(c).rlike(r"(?i)(^|[^a-z0-9_])(drop|delete|insert|update|alter|create|exec|execute|union|truncate)([^a-z0-9_]|$)|--|;|/\*|\*/")


def broken_summary(c: Column | str) -> Column:
    """Blank, shorter than ten characters, or a leftover of markup."""
    t = F.trim(F.coalesce(_c(c), F.lit("")))
    return t.rlike(r"^(\||---|```|>\s*\[!|\*\*One-Time)") | (F.length(t) < 10)


def absent(c: Column | str) -> Column:
    """Null, '', '{}', '[]' or 'null', blanks aside."""
    t = F.regexp_replace(_c(c), r"\s+", "")
    return _c(c).isNull() | t.isin("", "{}", "[]", "null")


def present(c: Column | str) -> Column:
    return ~absent(c)


def json_value(c: Column | str) -> Column:
    """A variant of JSON text; JSON inside a JSON string is unwrapped; broken
    text is null."""
    v = F.try_parse_json(_c(c))
    inner = F.try_parse_json(F.try_variant_get(v, "$", "string"))
    return F.when(F.schema_of_variant(v) == "STRING", inner).otherwise(v)


def json_string(c: Column | str) -> Column:
    """The text of a JSON string, or of a value that is no JSON; else null."""
    v = F.try_parse_json(_c(c))
    return F.when(v.isNull(), _c(c)).when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def json_text(c: Column | str, path: str) -> Column:
    return F.try_variant_get(json_value(c), path, "string")


@F.pandas_udf(StringType())
def uuid5_url(url: pd.Series) -> pd.Series:
    """The name-based id of a URL (there is no built-in)."""
    return url.map(lambda u: None if u is None else str(uuid.uuid5(uuid.NAMESPACE_URL, u)))


@F.pandas_udf(StringType())
def nfkc(t: pd.Series) -> pd.Series:
    return t.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def _measure(stem: str) -> int:
    """Number of vowel-consonant changes, Porter's m."""
    m, before = 0, False
    for i, _ in enumerate(stem):
        v = _vowel(stem, i)
        m += before and not v
        before = v
    return m


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def porter(w: str) -> str:
    """Porter's stemmer (1980), from its published rules."""
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    has = lambda s: any(_vowel(s, i) for i in range(len(s)))
    cvc = lambda s: len(s) > 2 and not _vowel(s, len(s) - 1) and _vowel(s, len(s) - 2) and not _vowel(s, len(s) - 3) and s[-1] not in "wxy"
    double = lambda s: len(s) > 1 and s[-1] == s[-2] and not _vowel(s, len(s) - 1)
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and has(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and has(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        w = cut
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and cvc(w):
            w += "e"
    if w.endswith("y") and has(w[:-1]):
        w = w[:-1] + "i"
    #: Porter's steps 2 and 3, suffix and what replaces it.
    two = "ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble".split()
    three = "icate ic ative - alize al iciti ic ical ic ful - ness -".split()
    for table in (two, three):
        for suffix, to in sorted(zip(table[::2], table[1::2]), key=lambda p: -len(p[0])):
            if w.endswith(suffix):
                if _measure(w[: -len(suffix)]) > 0:
                    w = w[: -len(suffix)] + to.replace("-", "")
                break
    for suffix in sorted("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), key=lambda s: -len(s)):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    if _measure(w) > 1 and double(w) and w[-1] == "l":
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def porter_udf(t: pd.Series) -> pd.Series:
    return t.map(lambda x: None if x is None else porter(x))
