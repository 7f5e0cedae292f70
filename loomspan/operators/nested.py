"""Nested records into flat tables that keep the parent link (problem 7).

Each record is read once as a stream of tokens and leaves (path, ordinals, value)
triples; the nested value itself is never built, and neither depth nor JSON
wrapped in strings has a limit.  Paths are grouped by their repeated ancestor (a
list element ``[]`` or an object key ``*``), and each group is pivoted into the
rows of one table.  A record never leaves its row, so no shuffle is needed
however deep it is.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Child:
    """A table of children: the repeated ancestor's path, the leaf that names an
    element, and the ancestor path of the parent table (None: the record)."""

    name: str
    path: tuple[str, ...]
    leaf: str = "name"
    above: tuple[str, ...] | None = None


#: Values of a triple for containers without content.
EMPTY_OBJECT, EMPTY_LIST = object(), object()
_WS = re.compile(r"[ \t\n\r]*")
_STRING = re.compile(r'"((?:[^"\\\x00-\x1f]|\\.)*)"')
_KEY = re.compile(r'[ \t\n\r]*"((?:[^"\\\x00-\x1f]|\\.)*)"[ \t\n\r]*:[ \t\n\r]*')
_ATOM = re.compile(r"(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|true|false|null")
_AFTER = re.compile(r"[ \t\n\r]*([,\]}])[ \t\n\r]*")
_NO_MORE = re.compile(r"[ \t\n\r]*[\]}]")
#: A triple: keys and list positions down to the value, and the value.
Triple = tuple[tuple[str | int, ...], object]


def _text(raw: str) -> str:
    """The text of a JSON string without its quotes; half a surrogate pair
    becomes the replacement character."""
    if "\\" not in raw:
        return raw
    return json.loads(f'"{raw}"').encode("utf-8", "surrogatepass").decode("utf-8", "replace")


def scan(text: str) -> list[Triple]:
    """The triples of a JSON text in order; ValueError if it is not valid.

    One pass over the tokens with a stack of open containers.  JSON text inside a
    JSON string counts as that JSON.  Of a key that occurs twice in one object the
    last value counts."""
    out: list[Triple | None] = []
    steps: list[str | int] = []
    stack: list[dict | None] = []  # per open container: where the values of an object's keys lie, None for a list
    pos = _WS.match(text).end()
    while True:
        c = text[pos : pos + 1]
        if c == "{":
            if m := _KEY.match(text, pos + 1):
                key = _text(m[1])
                stack.append({key: len(out)})
                steps.append(key)
                pos = m.end()
                continue
            m = _NO_MORE.match(text, pos + 1)
            if not m or m[0][-1] != "}":
                raise ValueError(pos)
            out.append((tuple(steps), EMPTY_OBJECT))
        elif c == "[":
            m = _NO_MORE.match(text, pos + 1)
            if not m:
                stack.append(None)
                steps.append(0)
                pos = _WS.match(text, pos + 1).end()
                continue
            if m[0][-1] != "]":
                raise ValueError(pos)
            out.append((tuple(steps), EMPTY_LIST))
        elif c == '"':
            if not (m := _STRING.match(text, pos)):
                raise ValueError(pos)
            value = _text(m[1])
            inner = unwrapped(value)
            if inner is None:
                out.append((tuple(steps), value))
            else:
                at = tuple(steps)
                out.extend((at + p, v) for p, v in inner)
        else:
            if not (m := _ATOM.match(text, pos)):
                raise ValueError(pos)
            out.append((tuple(steps), float(m[1]) if m[1] else {"true": True, "false": False}.get(m[0])))
        pos = m.end()
        while True:  # after a value
            if not stack:
                if _WS.match(text, pos).end() != len(text):
                    raise ValueError(pos)
                return [x for x in out if x is not None]
            if not (m := _AFTER.match(text, pos)):
                raise ValueError(pos)
            pos, top = m.end(), stack[-1]
            if m[1] == ",":
                if top is None:
                    steps[-1] += 1
                else:
                    if not (m := _KEY.match(text, pos)):
                        raise ValueError(pos)
                    key, pos = _text(m[1]), m.end()
                    if key in top:
                        _forget(out, tuple(steps[:-1]) + (key,), top[key])
                    top[key] = len(out)
                    steps[-1] = key
                break
            if (m[1] == "]") != (top is None):
                raise ValueError(pos)
            stack.pop()
            steps.pop()


def _forget(out: list, path: tuple, start: int) -> None:
    """Takes the triples below a path away, from where they start."""
    i = start
    while i < len(out) and out[i] is not None and out[i][0][: len(path)] == path:
        out[i] = None
        i += 1


def unwrapped(value: str) -> list[Triple] | None:
    """The triples of the object or list that a string holds as JSON, however
    often it is wrapped (each time at least its quotes more); else None."""
    if value[:1] not in ("{", "[", '"') or value[-1:] not in ("}", "]", '"') or len(value) < 2:
        return None
    try:
        found = scan(value)
    except ValueError:
        return None
    return found if found and (found[0][0] or found[0][1] in (EMPTY_OBJECT, EMPTY_LIST)) else None


def placed(found: Iterable[Triple], keyed: frozenset[tuple[str, ...]] = frozenset()) -> Iterator[tuple[tuple[str, ...], tuple, object]]:
    """(path, ordinals, value): list positions become ordinals and the path gets
    ``[]``; objects at a path in `keyed` are maps, their keys are ordinals and the
    path gets ``*``."""
    for steps, value in found:
        path: tuple[str, ...] = ()
        at: tuple = ()
        for s in steps:
            if isinstance(s, int):
                path, at = path + ("[]",), at + (s,)
            elif path in keyed:
                path, at = path + ("*",), at + (s,)
            else:
                path += (s,)
        yield path, at, value


def _ancestor(path: tuple[str, ...]) -> int:
    for i in range(len(path) - 1, -1, -1):
        if path[i] in ("[]", "*"):
            return i + 1
    return 0


def pivot(found: Iterable[tuple[tuple[str, ...], tuple, object]]) -> dict[tuple[str, ...], dict[tuple, dict[str, object]]]:
    """Groups of triples by repeated ancestor: {ancestor: {ordinals: {leaf: value}}}.

    An element is present in the groups of all its repeated ancestors, so that it
    and the parent of a child are found even without a scalar of their own."""
    groups: dict = {}
    for path, at, value in found:
        n = _ancestor(path)
        groups.setdefault(path[:n], {}).setdefault(at, {})[".".join(path[n:])] = value
        k = len(at) - 1
        for i in range(n - 2, -1, -1):
            if path[i] in ("[]", "*"):
                groups.setdefault(path[: i + 1], {}).setdefault(at[:k], {})
                k -= 1
    return groups


def child_rows(groups: dict, children: tuple[Child, ...]) -> Iterator[tuple[str, str, int, str]]:
    """(child, parent, pos, item); elements without a name give no row."""
    for c in children:
        above = groups.get(c.above, {}) if c.above else {}
        leaf_above = next((x.leaf for x in children if x.path == c.above), "name")
        depth = sum(s in ("[]", "*") for s in c.above) if c.above else 0
        for at, leaves in groups.get(c.path, {}).items():
            item = at[-1] if c.path[-1] == "*" else leaves.get(c.leaf, leaves.get(""))
            if not isinstance(item, str) or item == "":
                continue
            parent = ""
            if c.above:
                parent = at[depth - 1] if c.above[-1] == "*" else above.get(at[:depth], {}).get(leaf_above, above.get(at[:depth], {}).get(""))
                parent = parent if isinstance(parent, str) else ""
            yield c.name, parent, (-1 if c.path[-1] == "*" else at[-1]), item


L = "[]"
REQUIREMENTS = (
    Child("tool", ("tools", L)),
    Child("api", ("apis", L)),
    Child("package", ("packages", L)),
    Child("env_var", ("env_vars", L)),
    Child("runtime", ("runtimes", L)),
    Child("env_var", ("apis", L, "credentials", "env_vars", L), above=("apis", L)),
    Child("extra", ("packages", L, "extras", L), above=("packages", L)),
)
SECURITY = (
    Child("risk_factor", ("risk_factors", L)),
    Child("credential", ("credential_requirements", L)),
    Child("finding", ("findings", L), leaf="rule"),
    Child("location", ("findings", L, "locations", L), leaf="path", above=("findings", L)),
)
ENTRIES = (Child("target", ("entries", L), leaf="target"), Child("blocker", ("entries", L, "blockers", L), above=("entries", L)))
AGENTS = (Child("target", ("agents", "*")), Child("blocker", ("agents", "*", "blockers", L), above=("agents", "*")))
TOP = (Child("target", ("*",)), Child("blocker", ("*", "blockers", L), above=("*",)))


def _is_object(found: list[Triple], key: str) -> bool:
    return any(p[0] == key and (v is EMPTY_OBJECT if len(p) == 1 else isinstance(p[1], str)) for p, v in found)


def _rows(column: str, text: str | None) -> Iterator[tuple[str, str, int, str]]:
    if text is None or not text.strip():
        return
    try:
        found = scan(text)
    except ValueError:
        return
    if not found or not found[0][0] or not isinstance(found[0][0][0], str):  # no object, or an empty one
        return
    if column == "runtime_requirements":
        yield from child_rows(pivot(placed(found)), REQUIREMENTS)
    elif column == "security":
        yield from child_rows(pivot(placed(found)), SECURITY)
    elif any(p[0] == "entries" and (v is EMPTY_LIST if len(p) == 1 else isinstance(p[1], int)) for p, v in found):
        yield from child_rows(pivot(placed(found)), ENTRIES)
    elif _is_object(found, "agents"):
        yield from child_rows(pivot(placed(found, frozenset({("agents",)}))), AGENTS)
    else:
        maps = {k for k in {p[0] for p, _ in found} if _is_object(found, k)}
        yield from child_rows(pivot(placed([x for x in found if x[0][0] in maps], frozenset({()}))), TOP)


def nested_children(records: DataFrame, id_col: str = "id", columns: tuple[str, ...] = ("runtime_requirements", "compatibility", "security")) -> DataFrame:
    """(id, child, parent, pos, item) of the named elements of the JSON columns.

    Null, blank, broken and scalar JSON gives no rows; repeated rows give their
    rows again; other columns of `records` are not read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, *r) for c in columns for i, text in zip(b["id"], b[c]) for r in _rows(c, text)]
            if out:
                yield pd.DataFrame(out, columns=["id", "child", "parent", "pos", "item"])

    picked = records.select(records[id_col].cast("long").alias("id"), *columns)
    return picked.mapInPandas(run, "id long, child string, parent string, pos int, item string")
