"""Mapping typed values to a reference list (problem 5): BK-trees.

The reference's spellings (canonical values and aliases, words joined) stand in
BK-trees under the Levenshtein metric, one tree for each length.  A query visits
the trees of lengths it can reach, and the triangle inequality prunes them.  The
radius is twice the edits allowed, as a swap of neighbours is one edit in the
final distance (Damerau-Levenshtein, unrestricted) and two in the trees' metric;
so every entry within the threshold is returned.  The trees are searched for many
names at a time: the pairs of name and node that are still open are a frontier,
whose distances are computed together.  A short reference is broadcast; a long one
is split into shards, each shard answers all names, and the shards' answers merge
into what one tree over all entries would give.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.session import shuffle_width

#: Words around a name that do not belong to it.
FILLERS = frozenset("my the a an basic advanced simple auto skill skills helper helpers tool tools agent agents for and more beta alpha pack plugin new".split())
_VERSION = re.compile(r"v?\d+(?:\.\d+)*$")


def levenshtein(a: str, b: str) -> int:
    """Bit-parallel edit distance; a true metric."""
    if not a or not b:
        return len(a) + len(b)
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | (1 << i)
    m = len(a)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    for c in b:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ((ph << 1) | 1) & mask
        mh = (mh << 1) & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
    return score


def damerau(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance; a true metric."""
    far = len(a) + len(b)
    seen: dict[str, int] = {}
    h = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        h[i + 1][1] = i
    for j in range(len(b) + 1):
        h[1][j + 1] = j
    for i in range(1, len(a) + 1):
        left = 0
        for j in range(1, len(b) + 1):
            k, x = seen.get(b[j - 1], 0), left
            cost = a[i - 1] != b[j - 1]
            if not cost:
                left = j
            h[i + 1][j + 1] = min(h[i][j] + cost, h[i + 1][j] + 1, h[i][j + 1] + 1, h[k][x] + (i - k - 1) + 1 + (j - x - 1))
        seen[a[i - 1]] = i
    return h[len(a) + 1][len(b) + 1]


class BKTree:
    """Entries within a radius, pruned by the triangle inequality."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, key: str) -> None:
        if self.root is None:
            self.root = [key, {}]
            return
        node = self.root
        while True:
            d = levenshtein(node[0], key)
            if d == 0:
                return
            if d not in node[1]:
                node[1][d] = [key, {}]
                return
            node = node[1][d]

    def within(self, query: str, radius: int) -> Iterator[tuple[str, int]]:
        todo = [self.root] if self.root else []
        while todo:
            key, children = todo.pop()
            d = levenshtein(key, query)
            if d <= radius:
                yield key, d
            todo.extend(c for e, c in children.items() if d - radius <= e <= d + radius)


class Forest:
    """A BK-tree laid out in arrays, for keys of one length of at most 64."""

    def __init__(self, tree: BKTree, code: dict[str, int]):
        self.keys: list[str] = []
        kids: list[list[tuple[int, int]]] = []
        todo = [(tree.root, -1, 0)]
        while todo:
            (key, children), above, edge = todo.pop()
            if above >= 0:
                kids[above].append((len(self.keys), edge))
            todo.extend((c, len(self.keys), e) for e, c in children.items())
            self.keys.append(key)
            kids.append([])
        self.first = np.cumsum([0, *map(len, kids)])
        flat = np.array([x for k in kids for x in k], np.int64).reshape(-1, 2)
        self.child, self.edge = flat[:, 0], flat[:, 1]
        self.size = len(self.keys[0])
        self.at = np.zeros((len(self.keys), len(code) + 1), np.uint64)  # where a key has a letter, as bits
        for i, key in enumerate(self.keys):
            for j, c in enumerate(key):
                self.at[i, code[c]] |= np.uint64(1 << j)

    def distances(self, node: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Levenshtein distance of each pair of node and query (rows of letter
        codes, all of one length), bit-parallel."""
        one = np.uint64(1)
        mask = np.uint64((1 << self.size) - 1)
        top = np.uint64(self.size - 1)
        up, down = np.full(len(node), mask), np.zeros(len(node), np.uint64)
        score = np.full(len(node), self.size, np.int64)
        for j in range(query.shape[1]):
            eq = self.at[node, query[:, j]]
            x = eq | down
            h = (((eq & up) + up) ^ up) | eq
            rise, fall = down | (~(h | up) & mask), up & h
            score += ((rise >> top) & one).astype(np.int64) - ((fall >> top) & one).astype(np.int64)
            rise, fall = ((rise << one) | one) & mask, (fall << one) & mask
            up, down = fall | (~(x | rise) & mask), rise & x
        return score

    def within(self, query: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query numbers, nodes, distances) within the radius, level by level."""
        q = np.arange(len(query))
        node = np.zeros(len(query), np.int64)
        while len(q):
            d = self.distances(node, query[q])
            near = d <= radius
            yield q[near], node[near], d[near]
            n = self.first[node + 1] - self.first[node]
            pair = np.repeat(np.arange(len(q)), n)
            slot = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + self.first[node[pair]]
            open_ = np.abs(self.edge[slot] - d[pair]) <= radius
            q, node = q[pair[open_]], self.child[slot[open_]]


def words(text: str) -> list[str]:
    """Words without accents, case, separators and the fillers around them."""
    text = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text)
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    w = re.sub(r"[^a-z0-9.]+", " ", text).split()
    filler = lambda x: x.strip(".") in FILLERS or _VERSION.match(x.strip(".")) is not None or x == "."
    lo, hi = 0, len(w)
    while lo < hi and filler(w[lo]):
        lo += 1
    while hi > lo and filler(w[hi - 1]):
        hi -= 1
    return w[lo:hi]


class Matcher:
    """The reference's spellings, and the nearest entry of a typed value."""

    def __init__(self, entries: list[tuple[str, list[str]]], edits: int = 2):
        self.edits = edits
        self.exact: dict[str, str] = {}
        self.trees: dict[int, BKTree] = {}
        self.short: dict[str, set[str]] = {}
        self.forest: tuple[dict[int, Forest], dict[str, int]] | None = None
        for canonical, aliases in sorted(entries):
            for spelling in [canonical.replace("_", " "), *(aliases or [])]:
                w = words(spelling) or spelling.lower().split()
                for order in permutations(w) if len(w) <= 4 else [tuple(w), tuple(reversed(w))]:
                    joined = "".join(order)
                    if self.exact.setdefault(joined, canonical) == canonical:
                        self.trees.setdefault(len(joined), BKTree()).add(joined)
                for i, x in enumerate(w):  # one word cut off
                    for n in range(3, len(x)):
                        self.short.setdefault("".join([*w[:i], x[:n], *w[i + 1 :]]), set()).add(canonical)

    def _forms(self, text: str) -> list[str]:
        w = [x.strip(".") for x in words(text)]
        joined = "".join(w)
        out = [joined]
        whole = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
        whole = re.sub(r"[^a-z0-9]+", "", whole)
        if whole != joined:
            out.append(whole)
        for m in re.finditer("(?=of)", joined):  # `review of outlier`, wherever the blanks went
            if 2 < m.start() < len(joined) - 4:
                out.append(joined[m.start() + 2 :] + joined[: m.start()])
        return out

    def _forest(self) -> tuple[dict[int, Forest], dict[str, int]]:
        if self.forest is None:
            code = {c: i + 1 for i, c in enumerate(sorted({c for k in self.exact for c in k}))}
            self.forest = {n: Forest(t, code) for n, t in self.trees.items() if 0 < n <= 64}, code
        return self.forest

    def answers(self, texts: list[str | None]) -> list[tuple[int, int, int, int, str, str]]:
        """(number of the text, stage, form, distance, least and greatest
        canonical) of what this reference says to each text.

        Stage 0: a form of the text is a spelling; 1: it is one with a word cut
        off; 2: the nearest spelling within the edits allowed (`edits`, but one
        for each four letters).  Answers of several shards merge: see `winners`."""
        out: list[tuple[int, int, int, int, str, str]] = []
        ask: dict[int, list[tuple[int, str]]] = {}
        for i, text in enumerate(texts):
            if not text:
                continue
            forms = self._forms(text)
            sure = False
            for k, f in enumerate(forms):
                if f in self.exact:
                    out.append((i, 0, k, 0, self.exact[f], self.exact[f]))
                    sure = True
                if f in self.short:
                    out.append((i, 1, k, 1, min(self.short[f]), max(self.short[f])))
            if not sure:
                for f in set(forms):
                    ask.setdefault(len(f), []).append((i, f))
        forest, code = self._forest()
        for size, some in ask.items():
            most = min(self.edits, size // 4)
            if most < 1:
                continue
            query = np.array([[code.get(c, 0) for c in f] for _, f in some], np.int64)
            for n in range(size - most, size + most + 1):
                if n in forest:
                    t = forest[n]
                    for qs, nodes, ds in t.within(query, 2 * most):
                        for q, node, d in zip(qs.tolist(), nodes.tolist(), ds.tolist()):
                            key, f = t.keys[node], some[q][1]
                            if d <= 1 or (d := damerau(key, f)) <= most:
                                out.append((some[q][0], 2, 0, d + 1, self.exact[key], self.exact[key]))
                elif n in self.trees:
                    for i, f in some:
                        for key, d in self.trees[n].within(f, 2 * most):
                            if d <= 1 or (d := damerau(key, f)) <= most:
                                out.append((i, 2, 0, d + 1, self.exact[key], self.exact[key]))
        best: dict[tuple[int, int], tuple[int, str]] = {}
        for i, stage, _, d, c, _ in out:
            if stage == 2:
                best[(i, 2)] = min(best.get((i, 2), (d, c)), (d, c))
        return [x for x in out if x[1] < 2] + [(i, 2, 0, d, c, c) for (i, _), (d, c) in best.items()]

    def best(self, text: str | None) -> tuple[int, str] | None:
        """(distance, canonical) of the entry meant, None if the list has none."""
        rows = [(s, k, d, lo) for _, s, k, d, lo, hi in self.answers([text]) if lo == hi]
        return min(rows)[2:] if rows else None


def winners(answers: DataFrame) -> DataFrame:
    """(name, d, canonical) from the answers of all shards.

    A spelling with a word cut off counts only if all shards together know one
    entry for it; of equal ranks the first canonical counts.  Both steps are
    combined before the shuffle."""
    a = answers.groupBy("name", "stage", "form", "d").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    a = a.where("stage <> 1 OR lo = hi")
    return a.groupBy("name").agg(F.min(F.struct("stage", "form", "d", "lo")).alias("b")).select("name", "b.d", F.col("b.lo").alias("canonical"))


def match_names(names: DataFrame, reference: DataFrame, edits: int = 2, shard_entries: int = 5000, group_names: int = 20_000) -> DataFrame:
    """(name, canonical, distance): for each distinct typed name the entry meant,
    or `unmatched` with a null distance.

    Null, blank and filler-only names are unmatched.  Up to `shard_entries`
    reference rows go to every task; beyond that the reference is split into
    shards of about that size, and the names into groups of about `group_names`,
    so that no task holds more than one of each; the answers are the same."""
    # few bytes but much work per name: spread by number, which AQE keeps
    # (by another expression than distinct's, or the exchange is dropped as redundant)
    asked = names.select("name").distinct().repartition(shuffle_width(names.sparkSession), F.xxhash64("name"))
    ref = reference.select("canonical", "aliases").where("canonical IS NOT NULL")
    first = ref.limit(shard_entries + 1).collect()  # bounded by shard_entries
    out = "name string, stage int, form int, d int, lo string, hi string"

    def answer(m: Matcher, typed: pd.Series) -> pd.DataFrame:
        t = typed.tolist()
        return pd.DataFrame([(t[i], *x) for i, *x in m.answers(t)], columns=["name", "stage", "form", "d", "lo", "hi"])

    if len(first) <= shard_entries:
        entries = [(r[0], list(r[1] or [])) for r in first]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = Matcher(entries, edits)
            for b in batches:
                yield answer(m, b["name"])

        said = asked.mapInPandas(run, out)
    else:
        shards, salts = -(-ref.count() // shard_entries), max(1, -(-asked.count() // group_names))
        r = ref.withColumn("shard", F.pmod(F.xxhash64("canonical", F.array_join("aliases", "|")), F.lit(shards))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        q = asked.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(salts)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        q = q.withColumn("shard", F.col("shard").cast("long"))

        def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return answer(Matcher([(c, list(x) if x is not None else []) for c, x in zip(b["canonical"], b["aliases"])], edits), a["name"])

        said = q.groupBy("shard", "salt").cogroup(r.groupBy("shard", "salt")).applyInPandas(both, out)
    a, b = asked.alias("a"), winners(said).alias("b")
    return a.join(b, F.col("a.name").eqNullSafe(F.col("b.name")), "left").select("a.name", F.coalesce("b.canonical", F.lit("unmatched")).alias("canonical"), F.col("b.d").alias("distance"))


def map_to_reference(rows: DataFrame, reference: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, canonical) of each row(id, name, canonical) whose canonical is null
    or not in the reference's canonical (exactly compared)."""
    known = reference.select(F.col("canonical").alias("known")).where("known IS NOT NULL").distinct()
    todo = rows.select(rows[id_col].alias("id"), "name", "canonical").join(known, F.col("canonical") == F.col("known"), "left_anti").select("id", "name")
    named = match_names(todo, reference).withColumnRenamed("name", "typed")
    return todo.join(named, F.col("name").eqNullSafe(F.col("typed")), "left").select("id", F.coalesce("canonical", F.lit("unmatched")).alias("canonical"))
