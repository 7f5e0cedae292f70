"""All similar pairs of records, a pair of blocks in each task (DD-*).

Records fall into blocks of about equal size by their order, each block is one
row of the checkpoint folder, and each pair of blocks is one task that reads its
two rows there.  So the records are shuffled once, however many blocks there are,
and never a candidate pair.  Inside a task no pair is left out unseen: the parity
sketches of two sets differ in at most as many bits as the sets have elements
that are not common, so one xor and one population count bound the Jaccard
index from above, and what the bound leaves is counted exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.session import cut_lineage

#: Records of a block; there are more blocks only where one would have MOST records, and FEW blocks where the records allow it.
BLOCK, BLOCKS, MOST, FEW = 8_000, 32, 50_000, 4
#: Pairs held at once, rows of a batch, elements of a set that stand in one matrix.
HELD, BATCH, WIDE = 2_000_000, 50_000, 32
#: A pair of rows as one number: the left one from this bit on.
SHIFT, LOW = 32, (1 << 32) - 1
#: Names are compared first where there are so many times more pairs of rows.
FEWER = 3
#: What the overall score of a pair of equal content is at least, and that of equal source where the name's score is above ALIKE.
CONTENT, SOURCE, ALIKE = 0.99, 0.90, 0.7
ONE = np.uint64(1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition as one row: its number, whether it holds an end (see
    similar_records), and its records as an Arrow file."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
        w.write_table(t := pa.Table.from_batches(parts).combine_chunks())
    ends = "end" not in t.column_names or bool(pc.any(t["end"]).as_py())
    yield pa.RecordBatch.from_pydict({"block": pa.array([TaskContext.get().partitionId()], pa.int32()), "ends": pa.array([ends]), "records": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _in_blocks(f: DataFrame, run: Callable, schema: str, order: tuple[str | Column, ...]) -> DataFrame:
    """`run` over each pair of blocks of f(id, ...), which are ranges of `order`;
    where f tells ends, over the pairs of which a block holds one."""
    f = cut_lineage(f)
    n = f.count()
    k = max(1, min(BLOCKS, math.ceil(n / BLOCK)), min(FEW, n // 250), math.ceil(n / MOST))
    d = cut_lineage(f.repartitionByRange(k, *order).mapInArrow(_pack, "block int, ends boolean, records binary"))
    # a Cartesian product reads the checkpoint's partitions where they are
    left, right = (d.select(F.col("block").alias(f"{x}_block"), F.col("ends").alias(f"{x}_ends"), F.col("records").alias(x)) for x in ("left", "right"))
    both = (F.col("left_block") <= F.col("right_block")) & (F.col("left_ends") | F.col("right_ends"))
    return left.hint("shuffle_replicate_nl").join(right, both).mapInArrow(run, schema)


def _sides(batches: Iterator[pa.RecordBatch], size_of: str) -> Iterator[tuple[pa.Table, pa.Table, bool]]:
    """Both blocks of each pair, by the size of a set, and whether they are the
    same.  Against a block without ends, only the ends of the other are given."""

    def block(at: pa.Scalar, only: bool) -> pa.Table:
        t = pa.ipc.open_file(at.as_buffer()).read_all()
        t = t.filter(t["end"]) if only else t
        return t.take(pc.sort_indices(pc.list_value_length(t[size_of])))

    for b in batches:
        for r in range(b.num_rows):
            left, same = block(b["left"][r], not b["right_ends"][r].as_py()), b["left_block"][r] == b["right_block"][r]
            yield left, left if same else block(b["right"][r], not b["left_ends"][r].as_py()), same


def _flat(c: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    c = c.combine_chunks()
    c = c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)
    return c.flatten(), c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _bits(sets: list[Sets], values: int) -> int:
    """Words of 64 bits for a sketch of sets of this size."""
    return min(8, max(1, math.ceil(values / max(1, sum(len(s.size) for s in sets)) / 16)))


class Sets:
    """Sets as whole numbers, one after the other."""

    def __init__(self, at: np.ndarray, size: np.ndarray):
        self.at, self.size, self.start = at, size, np.concatenate([[0], np.cumsum(size)])
        self.row = np.repeat(np.arange(len(size)), size)

    def sketch(self, words: int) -> list[np.ndarray]:
        """The parity of the elements of each bit."""
        out, has = [], self.size > 0
        for w in range(words):
            one = np.where(self.at // 64 % words == w, ONE << (self.at % 64).astype(np.uint64), np.uint64(0))
            s = np.zeros(len(self.size), np.uint64)
            if has.any():
                s[has] = np.bitwise_xor.reduceat(one, self.start[:-1][has])
            out.append(s)
        return out


def _numbered(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """The values of both as numbers, the most frequent first, and their count."""
    d = pa.concat_arrays([a, b]).dictionary_encode()
    at = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    rank = np.empty(n := len(d.dictionary), np.int64)
    rank[np.argsort(-np.bincount(at, minlength=n), kind="stable")] = np.arange(n)
    at = rank[at]
    return at[: len(a)], at[len(a) :], n


def _sets(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[Sets, Sets, int]:
    (a, na), (b, nb) = _flat(left), _flat(right)
    x, y, n = _numbered(a, b)
    return Sets(x, na), Sets(y, nb), n


class Overlap:
    """How many elements a left set has in common with right ones; the right sets
    are in the order of their size and stand in matrices of similar width."""

    def __init__(self, left: Sets, right: Sets, values: int):
        self.left, most = left, int(right.size.max(initial=0))
        kind = np.uint8 if most < 256 else np.int32
        self.mark, self.parts, lo, wide = np.zeros(values + 1, kind), [], 0, WIDE
        while lo < len(right.size):
            hi = int(np.searchsorted(right.size, wide, "right"))
            if hi > lo:
                n = right.size[lo:hi]
                m = np.full((int(n.max(initial=0)), hi - lo), values, np.int32)
                own = slice(right.start[lo], right.start[hi])
                m[np.arange(right.start[lo], right.start[hi]) - np.repeat(right.start[lo:hi], n), right.row[own] - lo] = right.at[own]
                self.parts.append((lo, hi, m))
                lo = hi
            wide *= 2

    def count(self, i: int, js: np.ndarray) -> np.ndarray:
        own = self.left.at[self.left.start[i] : self.left.start[i + 1]]
        self.mark[own] = 1
        out = []
        for lo, hi, m in self.parts:
            at = js if len(self.parts) == 1 else js[np.searchsorted(js, lo) : np.searchsorted(js, hi)]
            if len(at):
                out.append(np.add.reduce(self.mark[m[:, at - lo]], axis=0, dtype=self.mark.dtype))
        self.mark[own] = 0
        return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


class Near:
    """Right sets whose sketch allows a Jaccard index of `least`."""

    def __init__(self, left: Sets, right: Sets, least: float, same: bool, words: int):
        self.a, self.b = left.sketch(words), right.sketch(words)
        self.left, self.right, self.least, self.same = left, right, least, same
        self.most: dict[int, tuple[int, int, np.ndarray]] = {}

    def of(self, i: int) -> np.ndarray:
        n, begin = int(self.left.size[i]), i + 1 if self.same else 0
        if self.least <= 0:
            return np.arange(begin, len(self.right.size))
        if not n:
            return np.zeros(0, np.int64)
        if n not in self.most:
            s, t = self.right.size, self.least
            lo, hi = np.searchsorted(s, max(1, math.ceil(t * n - 1e-9))), np.searchsorted(s, math.floor(n / t + 1e-9), "right")
            self.most[n] = int(lo), int(hi), np.minimum((n + s) * ((1 - t) / (1 + t)) + 1e-9, 64 * len(self.a)).astype(np.int16 if len(self.a) > 3 else np.uint8)
        lo, hi, most = self.most[n]
        lo = max(lo, begin)
        if lo >= hi:
            return np.zeros(0, np.int64)
        apart = np.bitwise_count(self.b[0][lo:hi] ^ self.a[0][i])
        if len(self.a) > 3:
            apart = apart.astype(np.int16)
        for x, y in zip(self.a[1:], self.b[1:]):
            apart += np.bitwise_count(y[lo:hi] ^ x[i])
        return np.flatnonzero(apart <= most[lo:hi]) + lo

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(x[i] ^ y[j]).astype(np.int64) for x, y in zip(self.a, self.b))


def _index(both: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """both / all, 0 where nothing is common."""
    return np.divide(both, all_, out=np.zeros(len(both)), where=both > 0)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each is there."""
    if not len(keys):
        return keys, keys
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.diff(np.append(at, len(keys)))


def _among(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which keys are among the ordered ones."""
    if not len(ordered):
        return np.zeros(len(keys), bool)
    return ordered[np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)] == keys


def _leading(of: np.ndarray, other: np.ndarray, low: np.ndarray, high: np.ndarray, most: int) -> np.ndarray:
    """Which pairs may be among the `most` best of `of`, by score and then the
    least `other`, where a score is between low and high.  A pair is not if `most`
    others of `of` are better even by their low."""
    order = np.lexsort((other, -low, of))
    n = np.bincount(of)
    last = order[(np.cumsum(n) - n + most - 1)[n >= most]]
    least, at = np.full(len(n), -np.inf), np.zeros(len(n), other.dtype)
    least[of[last]], at[of[last]] = low[last], other[last]
    return (high > least[of]) | ((high == least[of]) & (other <= at[of]))


class Ids:
    """The ids of two blocks and their order."""

    def __init__(self, left: pa.Table, right: pa.Table):
        self.ids = pa.concat_arrays([c for x in (left, right) for c in x["id"].chunks])
        self.rank = np.empty(len(self.ids), np.int64)
        self.rank[pc.sort_indices(self.ids).to_numpy()] = np.arange(len(self.ids))
        self.n = left.num_rows

    def ordered(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the lesser and the greater id."""
        j = j + self.n
        less = self.rank[i] < self.rank[j]
        return np.where(less, i, j), np.where(less, j, i)


def _batches(**columns) -> Iterator[pa.RecordBatch]:
    t = pa.table(columns)
    yield from t.to_batches(max_chunksize=BATCH)


def similar_sets(f: DataFrame, column: str, threshold: float, digits: int | None = None) -> DataFrame:
    """(a, b, jaccard), a < b: all pairs of f(id, column) whose sets reach the
    Jaccard threshold; with `digits`, the rounded index is held against it.  An
    empty set is like no other."""

    def run(batches):
        for sides in _sides(batches, column):
            yield from pairs(*sides)

    def pairs(left, right, same):
        ids = Ids(left, right)
        a, b, values = _sets(left[column], right[column])
        slack = 0.0 if digits is None else 10.0**-digits
        near, over = Near(a, b, threshold - slack, same, _bits([a, b], len(a.at) + len(b.at))), Overlap(a, b, values)
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        n = 0

        def out():
            i = np.repeat([h[0] for h in held], [len(h[1]) for h in held])
            x, y = ids.ordered(i, np.concatenate([h[1] for h in held]))
            yield from _batches(a=ids.ids.take(x), b=ids.ids.take(y), jaccard=np.concatenate([h[2] for h in held]))

        for i in range(left.num_rows):
            js = near.of(i)
            if not len(js):
                continue
            c = over.count(i, js)
            score = _index(c, a.size[i] + b.size[js] - c)
            if digits is not None:
                score = np.floor(score * 10**digits + 0.5) / 10**digits
            keep = score >= threshold
            held.append((i, js[keep], score[keep]))
            n += len(held[-1][1])
            if n >= BATCH:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()

    kind = f.schema["id"].dataType.simpleString()
    return _in_blocks(f.select("id", column), run, f"a {kind}, b {kind}, jaccard double", ("id",))


class Names:
    """Upper bounds of the similarity of names: by their letters, and by their
    longest common subsequence.  Equal names of a side are held once; `left` and
    `right` tell the name of each row."""

    def __init__(self, left: pa.ChunkedArray, right: pa.ChunkedArray):
        (self.left, first), (self.right, second) = (self._distinct(c) for c in (left, right))
        self.texts = texts = [first, second]
        self.la, self.lb = (np.array([len(x) for x in t], np.int64) for t in texts)
        flat = [np.frombuffer("".join(t).encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        letters, at = np.unique(np.concatenate(flat), return_inverse=True)
        at = at.reshape(-1)
        rank = np.empty(len(letters), np.int64)
        rank[np.argsort(-np.bincount(at, minlength=len(letters)), kind="stable")] = np.arange(len(letters))
        at = rank[at] if len(at) else at
        parts = at[: len(flat[0])], at[len(flat[0]) :]
        self.a, self.b = (self._letters(p, n) for p, n in zip(parts, (self.la, self.lb)))
        where, code = self._first(parts[0], self.la)
        self.masks = np.zeros((len(self.la), 65), np.uint64)
        np.bitwise_or.at(self.masks, (where[0], code), ONE << where[1].astype(np.uint64))
        where, code = self._first(parts[1], self.lb)
        self.text = np.full((int(np.minimum(self.lb, 64).max(initial=0)), len(self.lb)), 64, np.uint8)
        self.text[where[1], where[0]] = code

    @staticmethod
    def _distinct(c: pa.ChunkedArray) -> tuple[np.ndarray, list[str]]:
        d = pc.fill_null(c, "").combine_chunks().dictionary_encode()
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()

    @staticmethod
    def _letters(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The parity sketch of (letter, its how manieth)."""
        row = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((at, row))
        key = (row[order] << 32) | at[order]
        nth = np.arange(len(key)) - np.searchsorted(key, key)
        s = Sets((at[order] + 29 * nth) % 64, n)
        return s.sketch(1)[0]

    @staticmethod
    def _first(at: np.ndarray, n: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """(row, position) and letter of the first 64 letters; letters beyond 64
        share a code, which only raises the bound."""
        row = np.repeat(np.arange(len(n)), n)
        pos = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        k = pos < 64
        return (row[k], pos[k]), (at[k] % 64).astype(np.uint8)

    def _score(self, common: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.la[i], self.lb[j]
        return np.where((a > 0) & (b > 0), 2 * np.minimum(common, np.minimum(a, b)) / np.maximum(a + b, 1), 0.0)

    def by_letters(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self._score((self.la[i] + self.lb[j] - np.bitwise_count(self.a[i] ^ self.b[j])) / 2, i, j)

    def by_order(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        s = np.full(len(i), ~np.uint64(0))
        masks, base = self.masks.ravel(), i * 65
        for t in range(int(np.minimum(self.lb[j], 64).max(initial=0))):
            u = s & masks[base + self.text[t, j]]
            s = (s + u) | (s - u)
        common = np.bitwise_count(~s).astype(np.int64)
        return self._score(common + np.maximum(self.la[i] - 64, 0) + np.maximum(self.lb[j] - 64, 0), i, j)


class Alike:
    """Pairs of rows whose names and word sets together allow `least`, told by
    the distinct names first: these are fewer than the rows, and few are alike."""

    def __init__(self, names: Names, near: Near, name: float, summary: float, least: float):
        self.names, self.near, self.name, self.summary, self.least = names, near, name, summary, least
        order = np.argsort(names.right, kind="stable")
        begin = np.concatenate([[0], np.cumsum(np.bincount(names.right, minlength=len(names.lb)))])
        self.rows, self.score, every = [], [], np.arange(len(names.lb))
        held: list[np.ndarray] = []

        def take():
            """The right rows of the names held."""
            at, g = np.concatenate(held), np.repeat(np.arange(len(held)), [len(x) for x in held])
            score = names.by_order(g + len(self.rows), at)
            keep = name * score + summary >= least - 1e-9
            at, g, score = at[keep], g[keep], score[keep]
            n = begin[at + 1] - begin[at]
            rows = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin[at], n)]
            ends = np.cumsum(np.bincount(g, weights=n, minlength=len(held)).astype(np.int64))[:-1]
            self.rows += np.split(rows, ends)
            self.score += np.split(np.repeat(score, n), ends)
            held.clear()

        for g in range(len(names.la)):
            held.append(np.flatnonzero(name * names.by_letters(np.int64(g), every) + summary >= least - 1e-9))
            if sum(len(x) for x in held) >= BATCH or len(held) == 64:
                take()
        if held:
            take()
        self.size = np.array([len(x) for x in self.rows], np.int64)

    def of(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        g, near = self.names.left[lo:hi], self.near
        i, j = np.repeat(np.arange(lo, hi), self.size[g]), np.concatenate([self.rows[x] for x in g])
        score = np.concatenate([self.score[x] for x in g])
        if near.same:
            keep = j > i
            i, j, score = i[keep], j[keep], score[keep]
        a, b = near.left.size[i], near.right.size[j]
        both = np.minimum((a + b - near.apart(i, j)) // 2, np.minimum(a, b))
        keep = self.name * score + self.summary * _index(both, a + b - both) >= self.least - 1e-9
        return i[keep], j[keep]


class Shared:
    """Pairs of rows that share an element, once for each that they share."""

    def __init__(self, left: Sets, right: Sets, values: int, same: bool):
        self.left, self.same = left, same
        self.rows = right.row[np.argsort(right.at, kind="stable")]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(right.at, minlength=values))])
        many = np.zeros(len(left.size) + 1, np.int64)
        np.add.at(many, left.row + 1, self.begin[left.at + 1] - self.begin[left.at])
        self.many = np.cumsum(many)

    def keys(self, lo: int, hi: int) -> np.ndarray:
        own = slice(self.left.start[lo], self.left.start[hi])
        at, row = self.left.at[own], self.left.row[own]
        n = self.begin[at + 1] - self.begin[at]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.begin[at], n)
        i, j = np.repeat(row, n), self.rows[place]
        if self.same:
            i, j = i[j > i], j[j > i]
        return (i << SHIFT) | j


def _equal(left: pa.ChunkedArray, right: pa.ChunkedArray, none: tuple[str, ...]) -> tuple[Sets, Sets, int]:
    """Values as sets of one, or of none where nothing is told."""
    told = [pc.and_(pc.is_valid(c), pc.invert(pc.is_in(c, value_set=pa.array(none, c.type)))) for c in (left, right)]
    flat = [c.filter(t).combine_chunks() for c, t in zip((left, right), told)]
    flat = [pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in flat]
    told = [t.to_numpy().astype(bool) for t in told]
    x, y, n = _numbered(*flat)
    return Sets(x, told[0].astype(np.int64)), Sets(y, told[1].astype(np.int64)), n


def similar_records(f: DataFrame, least: float, w: dict[str, float], most: int | None = None) -> DataFrame:
    """(a, b, a_name_n, b_name_n, summary, caps, content, source), a < b: the pairs
    of f(id, name_n, words, caps, hash, source) that can reach `least`, and all of
    equal content or source; every score but the name's is exact.  With a boolean
    column `end` in f, the pairs of which one record at least is an end; with
    `most` too, a pair is left out where its ends have `most` better pairs each,
    whatever the names' scores are, and equal names that are told score 1.

    The name's score is taken to be at most twice the longest common subsequence
    over both lengths, which holds for the edit distance and for matching blocks.
    A pair that shares no capability, content or source needs a summary of
    (least - name) / summary.  Such pairs are found by their names, which the
    order of the blocks keeps together, or by the sketches alone where the names
    of two blocks are mostly distinct or rule out little; the other pairs are told
    by what they share."""
    alone = (least - w["name"]) / w["summary"] - 1e-9 if w["summary"] > 0 else (0.0 if w["name"] >= least else 2.0)

    def run(batches):
        for sides in _sides(batches, "words"):
            yield from pairs(*sides)

    def pairs(left, right, same):
        ids = Ids(left, right)
        a, b, values = _sets(left["words"], right["words"])
        near, over = Near(a, b, alone, same, _bits([a, b], len(a.at) + len(b.at))), Overlap(a, b, values)
        ca, cb, no = _sets(left["caps"], right["caps"])
        by_caps, *links = [Shared(ca, cb, no, same)] + [Shared(*_equal(left[c], right[c], none), same) for c, none in (("hash", ("",)), ("source", ("", "/")))]
        names = Names(left["name_n"], right["name_n"])
        texts = pa.concat_arrays([x for c in (left, right) for x in pc.fill_null(c["name_n"], "").chunks])
        end = [x["end"].to_numpy() for x in (left, right)] if "end" in left.column_names else None
        m, many = right.num_rows, by_caps.many + sum(x.many for x in links)
        alike = None
        if 0 < alone <= 1 and w["summary"] < least and FEWER * len(names.la) * len(names.lb) <= left.num_rows * m:
            alike = Alike(names, near, w["name"], w["summary"], least)

        def own(lo, hi):
            """The pairs that may have nothing in common but words."""
            if alike:
                return alike.of(lo, hi)
            js = [near.of(i) for i in range(lo, hi)] if alone <= 1 else [np.zeros(0, np.int64)] * (hi - lo)
            return np.repeat(np.arange(lo, hi), [len(x) for x in js]), np.concatenate(js)

        if most and end:
            number: dict[str, int] = {}
            told_names = [np.array([number.setdefault(x, len(number)) if x else -1 - side for x in t], np.int64) for side, t in enumerate(names.texts)]  # a blank equals none

        def leading(i, j, name, value, content, source):
            """Pairs that may be among the best of an end; name: at most its score."""
            equal, value = told_names[0][names.left[i]] == told_names[1][names.right[j]], value + least - 1e-9
            low, high = value + w["name"] * equal - 1e-9, value + w["name"] * name + 1e-9
            low, high = (np.where(source & alike, np.maximum(x, SOURCE), x) for x, alike in ((low, equal), (high, name > ALIKE - 1e-9)))
            low, high = (np.where(content, np.maximum(x, CONTENT), x) for x in (low, high))
            keep = np.zeros(len(i), bool)
            for side, of, other in ((0, i, ids.rank[j + ids.n]), (1, j, ids.rank[i])):
                own = np.flatnonzero(end[side][of])
                if len(own):
                    keep[own] |= _leading(of[own], other[own], low[own], high[own], most)
            return np.flatnonzero(keep)

        def bound(i, j, value):
            """What sketches of words, and letters, allow."""
            n, least_n = a.size[i] + b.size[j], np.minimum(a.size[i], b.size[j])
            both = np.minimum((n - near.apart(i, j)) // 2, least_n)
            value = value + w["summary"] * _index(both, n - both)
            keep = np.flatnonzero(w["name"] + value >= 0)
            return keep[w["name"] * names.by_letters(names.left[i[keep]], names.right[j[keep]]) + value[keep] >= 0]

        lo = 0
        while lo < left.num_rows:
            hi = min(lo + max(1, min(512, HELD // m)), max(lo + 1, int(np.searchsorted(many, many[lo] + HELD, "right")) - 1), left.num_rows)
            # pairs of equal content or source, and how many capabilities the others share
            content, source = (np.unique(x.keys(lo, hi)) for x in links)
            sure = np.union1d(content, source)
            k, c = _counted(by_caps.keys(lo, hi))
            at = np.minimum(np.searchsorted(k, sure), max(0, len(k) - 1))
            both = np.where(k[at] == sure, c[at], 0) if len(k) else np.zeros(len(sure), np.int64)
            i, j = k >> SHIFT, k & LOW
            caps = _index(c, ca.size[i] + cb.size[j] - c)
            keep = bound(i, j, w["caps"] * caps - least + 1e-9)
            i2, j2 = own(lo, hi)
            more = (i2 << SHIFT) | j2
            if not alike:
                kept = bound(i2, j2, np.full(len(i2), 1e-9 - least))
                more = more[kept]
            more = more[~_among(more, k)]
            key, caps = np.concatenate([k[keep], more]), np.concatenate([caps[keep], np.zeros(len(more))])
            other = ~_among(key, sure)
            i, j = sure >> SHIFT, sure & LOW
            key, caps = np.concatenate([key[other], sure]), np.concatenate([caps[other], _index(both, ca.size[i] + cb.size[j] - both)])
            if end:
                keep = end[0][key >> SHIFT] | end[1][key & LOW]
                key, caps = key[keep], caps[keep]
            order = np.argsort(key, kind="stable")
            key, caps = key[order], caps[order]
            i, j, content, source = key >> SHIFT, key & LOW, _among(key, content), _among(key, source)
            # words counted
            at = np.searchsorted(i, np.arange(lo, hi + 1))
            c = np.concatenate([np.zeros(0, np.int64)] + [over.count(lo + x, j[at[x] : at[x + 1]]) for x in np.flatnonzero(np.diff(at))])
            summary = _index(c, a.size[i] + b.size[j] - c)
            value = w["summary"] * summary + w["caps"] * caps + w["content"] * content + w["source"] * source - least + 1e-9
            told = content | source
            for limit in (names.by_letters, names.by_order):
                name = limit(names.left[i], names.right[j])
                keep = np.flatnonzero((w["name"] * name + value >= 0) | told)
                if most and end:
                    keep = keep[leading(*(x[keep] for x in (i, j, name, value, content, source)))]
                i, j, caps, content, source, value, summary, told = (x[keep] for x in (i, j, caps, content, source, value, summary, told))
            if len(i):
                x, y = ids.ordered(i, j)
                yield from _batches(a=ids.ids.take(x), b=ids.ids.take(y), a_name_n=texts.take(x), b_name_n=texts.take(y), summary=summary, caps=caps, content=content.astype(float), source=source.astype(float))
            lo = hi

    kind = f.schema["id"].dataType.simpleString()
    ends = ["end"] if "end" in f.columns else []  # ends stand together, in the first few blocks
    f = f.select("id", "name_n", "words", "caps", "hash", "source", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ends])
    return _in_blocks(f, run, f"a {kind}, b {kind}, a_name_n string, b_name_n string, summary double, caps double, content double, source double", (*map(F.desc, ends), "name_n", "id"))
