"""Filling containers of fixed capacity (problem 9) by multiway differencing.

Items are spread over shards of bounded size; in a shard, Karmarkar-Karp
differencing merges the two partial partitions with the largest imbalance, so
that the largest windows of one meet the smallest of the other.  That gives
near-equal windows.  Where one exceeds the capacity, items leave it and pass
into windows with room, by exchange for smaller ones if need be; if an item
finds no place, the number of windows rises and the shard is partitioned again.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.bpe import TOKENIZER_DIR, token_counts
from loomspan.session import cut_lineage, shuffle_width


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, list[list[int]]]:
    """k windows of near-equal sum: (sums, items of each window).

    A partial partition holds its non-empty windows only, largest first."""
    heap: list[tuple[int, int, np.ndarray, list]] = [(-int(s), i, np.array([s], np.int64), [(i, None)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        _, _, a, ta = heapq.heappop(heap)
        _, _, b, tb = heapq.heappop(heap)
        free = k - len(a)
        m = max(0, len(b) - free)  # windows of b that must share: its smallest meet the largest... of a in reverse
        if m == 0:
            sums = np.concatenate([a, b])
            trees = ta + tb
        else:
            # of k places, b reversed: its largest go to the empty places of a, the rest to a's smallest
            sums = np.concatenate([a, b[:free]])
            trees = ta + tb[:free]
            at = np.arange(len(a) - 1, len(a) - 1 - m, -1)
            sums[at] += b[free:]
            for i, t in zip(at, tb[free:]):
                trees[i] = (trees[i], t)
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        trees = [trees[i] for i in order]
        low = sums[-1] if len(sums) == k else 0
        heapq.heappush(heap, (-int(sums[0] - low), tick, sums, trees))
        tick += 1
    _, _, sums, trees = heap[0]
    out = []
    for t in trees:
        items, todo = [], [t]
        while todo:
            x = todo.pop()
            if x is None:
                continue
            if x[1] is None and isinstance(x[0], int):
                items.append(x[0])
            else:
                todo.extend(x)
        out.append(items)
    return sums, out


def fewest(sizes: np.ndarray, capacity: int) -> int:
    """A lower bound of the number of containers: the sum, and the items that
    cannot share with one another."""
    best = -(-int(sizes.sum()) // capacity)
    s = np.sort(sizes)[::-1]
    total = np.concatenate([[0], np.cumsum(s)])
    alpha = np.unique(s[s <= capacity // 2])
    if len(alpha):
        big = np.searchsorted(-s, -(capacity - alpha), "left")  # > capacity - alpha
        half = int(np.searchsorted(-s, -(capacity // 2), "left"))
        small = np.searchsorted(-s, -alpha, "right")
        room = (half - big) * capacity - (total[half] - total[big])
        best = max(best, int(half + np.maximum(0, -(-(total[small] - total[half] - room) // capacity)).max()))
    return max(best, int((s > capacity // 2).sum()))


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit decreasing, to compare with."""
    room: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        j = bisect_left(room, (s, -1))
        if j < len(room):
            r, b = room.pop(j)
            bins[b].append(int(i))
            insort(room, (r - s, b))
        else:
            bins.append([int(i)])
            insort(room, (capacity - s, len(bins) - 1))
    return bins


@lru_cache(maxsize=None)
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the subsets of at most two of n items; n stands for none."""
    i, j = np.triu_indices(n, 1)
    return np.concatenate([[n], np.arange(n), i]), np.concatenate([np.full(n + 1, n), j])


def _parts(items: np.ndarray, sizes: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The subsets of at most two items of a window: (sums, windows, pairs)."""
    i, j = _pairs(len(items))
    s, named = np.append(sizes[items], 0), np.append(items, -1)
    return s[i] + s[j], np.full(len(i), w), np.stack([named[i], named[j]], 1)


def exchange(sizes: np.ndarray, home: np.ndarray, sums: np.ndarray, capacity: int) -> None:
    """Swaps at most two items of a window for at most two (or none) of another,
    in place, while that lessens what exceeds the capacity; the fullest first.

    Of the swaps that lessen it most, the one that leaves the other window
    fullest is taken.  The excess is a whole number that falls with each step,
    so this ends."""
    all_parts = [_parts(np.flatnonzero(home == w), sizes, w) for w in range(len(sums))]
    psum, phome, ppair = (np.concatenate(x) for x in zip(*all_parts))
    stuck = np.zeros(len(sums), bool)
    changed = False
    while True:
        over = np.where(stuck, 0, sums - capacity)
        w = int(over.argmax())
        excess = int(over[w])
        if excess <= 0:
            if not changed:
                return
            stuck[:] = changed = False  # others have changed since these found nothing
            continue
        mine = phome == w
        room = capacity - sums[phome]
        free = np.flatnonzero((room > 0) & ~mine)
        room, value = room[free], psum[free]
        rows = np.flatnonzero(mine & (psum > 0))
        d = psum[rows, None] - value
        np.maximum(d, 0, out=d)
        over_there = np.maximum(d - room, 0)
        gain = np.minimum(d, excess) - over_there
        rank = gain * (capacity + 1) - np.maximum(room - d, 0)  # the gain, then the other window's fullness
        at = int(rank.argmax()) if rank.size else -1
        if at < 0 or gain.flat[at] <= 0:
            stuck[w] = True
            continue
        give, y = ppair[rows[at // len(free)]], int(free[at % len(free)])
        to, take = int(phome[y]), ppair[y]
        home[give[give >= 0]] = to
        home[take[take >= 0]] = w
        keep = ~mine & (phome != to)
        psum, phome, ppair = (np.concatenate([x[keep], *new]) for x, new in zip((psum, phome, ppair), zip(*(_parts(np.flatnonzero(home == x), sizes, x) for x in (w, to)))))
        for x in (w, to):
            sums[x] = sizes[home == x].sum()
        stuck[[w, to]], changed = False, True


def settle(sizes: np.ndarray, home: np.ndarray, sums: np.ndarray, capacity: int) -> bool:
    """Whether all windows can be made to fit by single items, in place.

    A window that exceeds gives up its smallest sufficient item.  That goes where
    it fits best, else takes the place of the smallest item that leaves room for
    it, which then looks for a place itself; sizes fall with every such step."""
    heap: list[tuple[int, int]] = []
    while sums[w := int(sums.argmax())] > capacity:
        mine = np.flatnonzero(home == w)
        enough = mine[sizes[mine] >= sums[w] - capacity]
        x = int(enough[sizes[enough].argmin()]) if len(enough) else int(mine[sizes[mine].argmax()])
        home[x] = -1
        sums[w] -= sizes[x]
        heapq.heappush(heap, (-int(sizes[x]), x))
    while heap:
        _, x = heapq.heappop(heap)
        fits = np.flatnonzero(capacity - sums >= sizes[x])
        if len(fits):
            w = int(fits[sums[fits].argmax()])
        else:
            inside = np.flatnonzero((home >= 0) & (sizes < sizes[x]))
            inside = inside[sizes[inside] >= sizes[x] - capacity + sums[home[inside]]]
            if not len(inside):
                return False
            y = int(inside[sizes[inside].argmin()])
            w = int(home[y])
            home[y] = -1
            sums[w] -= sizes[y]
            heapq.heappush(heap, (-int(sizes[y]), y))
        home[x] = w
        sums[w] += sizes[x]
    return True


def pack(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers (lists of item numbers) for sizes <= capacity.

    k starts from the lower bound.  If near-equal windows exceed the capacity at
    k, differencing fills seven eighths of the windows, and the empty ones take up
    what these exceed; while an item is left without a place, one more is added."""
    if not len(sizes):
        return []
    sizes = sizes.astype(np.int64)
    k = fewest(sizes, capacity)
    sums, windows = differencing(sizes, k)
    if sums.max() <= capacity:
        return windows
    _, windows = differencing(sizes, max(1, k - k // 8))
    home = np.empty(len(sizes), np.int64)
    for w, items in enumerate(windows):
        home[items] = w
    sums = np.bincount(home, sizes, k).astype(np.int64)
    while True:
        exchange(sizes, home, sums, capacity)
        h, s = home.copy(), sums.copy()
        if settle(sizes, h, s, capacity):
            break
        sums = np.append(sums, 0)
    order = np.argsort(h, kind="stable")
    return [list(map(int, w)) for w in np.split(order, np.flatnonzero(np.diff(h[order])) + 1)]


def _fill(g: pd.DataFrame) -> pd.DataFrame:
    """Containers of one shard of one target."""
    capacity = int(g["capacity"].iloc[0])
    g = g.sort_values(["n_tokens", "doc_id", "piece"], kind="stable", ignore_index=True)  # the same containers in any order of arrival
    n = g["n_tokens"].to_numpy(np.int64)
    no = np.zeros(len(g), np.int64)
    rest = np.flatnonzero((n > 0) & (n < capacity))
    used = 0
    for items in pack(n[rest], capacity):
        no[rest[items]] = used
        used += 1
    full = np.flatnonzero(n == capacity)
    no[full] = used + np.arange(len(full))
    name = f"{g['target_id'].iloc[0]}-{g['shard'].iloc[0]}-"
    return pd.DataFrame({"target_id": g["target_id"], "doc_id": g["doc_id"], "piece": g["piece"], "token_from": g["token_from"], "n_tokens": n, "container": [name + str(i) for i in no]})


#: More container sizes than this are refused: their list is held by every task.
MOST_TARGETS = 1000


def pack_documents(documents: DataFrame, targets: DataFrame, shard_items: int = 2000, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(target_id, doc_id, piece, token_from, n_tokens, container) of every
    document or piece, for each row of targets(target_id, tokenizer, capacity).

    A document is split only if it exceeds the capacity alone: into full pieces
    and a rest.  Null and empty texts are items of size 0 and go to the first
    container of their shard.  Shards hold about `shard_items` items, so the work
    of a task does not grow with the corpus; each shard can leave one container
    partly filled.  Equal rows are packed each for itself: they are counted and
    numbered, so that copies spread over shards and the containers depend on the
    rows alone, not on where they are stored."""
    kinds = [r for r in targets.where("capacity > 0").limit(MOST_TARGETS + 1).collect() if r["tokenizer"]]
    if len(kinds) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} container sizes")
    out = "target_id int, doc_id long, piece int, token_from long, n_tokens long, container string"
    sized = None
    for name in sorted({r["tokenizer"] for r in kinds}):
        c = token_counts(documents, name, folder).withColumn("tokenizer", F.lit(name))
        sized = c if sized is None else sized.unionByName(c)
    if sized is None:
        return documents.sparkSession.createDataFrame([], out)
    sized = cut_lineage(sized.groupBy("tokenizer", "doc_id", "n").agg(F.count("*").alias("copies")))
    of = F.array(*[F.struct(F.lit(r["tokenizer"]).alias("tokenizer"), F.lit(r["target_id"]).cast("int").alias("target_id"), F.lit(int(r["capacity"])).cast("long").alias("capacity")) for r in kinds])
    items = sized.withColumn("t", F.explode(of)).where("t.tokenizer = tokenizer").select("t.target_id", "t.capacity", "doc_id", "n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    pieces = F.greatest(F.ceil(F.col("n") / F.col("capacity")).cast("int"), F.lit(1))
    items = items.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    start = F.col("piece").cast("long") * F.col("capacity")
    items = items.withColumns({"token_from": start, "n_tokens": F.least(F.col("n") - start, F.col("capacity"))})
    count = items.groupBy("target_id").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    shards = max(1, -(-count // shard_items))
    items = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "copy"), F.lit(shards)))
    items = items.select("target_id", "capacity", "doc_id", "piece", "token_from", "n_tokens", "shard")
    # few bytes and much work a shard: the width is given, so that small partitions are not joined
    return items.repartition(shuffle_width(documents.sparkSession), "target_id", "shard").groupBy("target_id", "shard").applyInPandas(_fill, out)
