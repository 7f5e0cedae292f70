"""Byte-level BPE as a bounded-lookahead streaming transducer (problem 8).

For every prefix of a piece the encoder knows the *last* token of the prefix's
encoding.  A token may follow another only if encoding the two together gives
just those two, so the last token of a prefix follows from the last tokens of at
most ``lookahead`` earlier prefixes (the longest entry of the merge list).  A
token is emitted as soon as all prefixes that can still matter agree on it, so
the state has a size that does not grow with the text.  Every piece of a text goes
through it; what it gave for a piece is remembered in a bounded table.  Merging
by rank only answers, once for each pair of tokens, whether one may follow the
other.  Decoding is an incremental byte-to-text state machine.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

#: Fixed value: the pattern that splits text before the merges.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER_DIR = "/opt/tokenizers"
_CACHE = 200_000


class Transducer:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        #: The merge list's sufficient lookahead in bytes.
        self.lookahead = max(map(len, self.ranks))
        self.split = regex.compile(PIECES)
        self._known: dict[str, tuple[int, ...]] = {}
        self._follows: dict[tuple[int, int], bool] = {}

    # encoding of one piece ------------------------------------------------
    def _merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost first; for the bytes of two tokens."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            pair = parts[at] + parts[at + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] + parts[i + 1] == pair and ranks[pair] == best:
                    out.append(pair)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [ranks[p] for p in parts]

    def follows(self, a: int, b: int) -> bool:
        """Whether token b can stand right after token a."""
        key = (a, b)
        got = self._follows.get(key)
        if got is None:
            if len(self._follows) > 4 * _CACHE:
                self._follows.clear()
            got = self._follows[key] = self._merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return got

    def stream(self, piece: Iterator[bytes]) -> Iterator[int]:
        """Tokens of one piece given as chunks of bytes, emitted once stable."""
        look, ranks = self.lookahead, self.ranks
        buf = b""  # bytes from the last stable border on
        last: list[tuple[int, int]] = [(-1, -1)]  # per border: (token that ends here, border before it)
        for chunk in piece:
            for k in range(len(chunk)):
                buf += chunk[k : k + 1]
                end = len(buf)
                for start in range(max(0, end - look), end):
                    t = ranks.get(buf[start:end])
                    if t is not None and last[start] is not None and (start == 0 and last[0][0] == -1 or self.follows(last[start][0], t)):
                        last.append((t, start))
                        break
                else:
                    raise ValueError("no token ends here")
                if end >= 4 * look:
                    cut, out = self._stable(last, end)
                    if cut:
                        yield from out
                        buf = buf[cut:]
                        base = last[cut][0]
                        last = [(base, -1), *((t, s - cut) if s >= cut else None for t, s in (x if x else (0, -1) for x in last[cut + 1 :]))]
        out, at = [], len(last) - 1
        while at > 0:
            out.append(last[at][0])
            at = last[at][1]
        yield from reversed(out)

    def _stable(self, last: list, end: int) -> tuple[int, list[int]]:
        """The furthest border that all live prefixes' encodings pass."""
        paths = None
        for at in range(max(1, end - self.lookahead), end + 1):
            if last[at] is None:
                continue
            seen = set()
            while at > 0:
                seen.add(at)
                at = last[at][1]
            paths = seen if paths is None else paths & seen
            if not paths:
                return 0, []
        cut = max(paths)
        out, at = [], cut
        while at > 0:
            out.append(last[at][0])
            at = last[at][1]
        return cut, out[::-1]

    def piece(self, text: str) -> tuple[int, ...]:
        got = self._known.get(text)
        if got is None:
            raw = text.encode("utf-8", "surrogatepass")
            got = tuple(self.stream(iter((raw,))))
            if len(text) <= 64:
                if len(self._known) >= _CACHE:
                    self._known.clear()
                self._known[text] = got
        return got

    # whole texts ----------------------------------------------------------
    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; [] for null and empty."""
        out: list[int] = []
        if text:
            known, add = self._known, out.extend
            for p in self.split.findall(text):
                got = known.get(p)
                add(got if got is not None else self.piece(p))
        return out

    def encode_chunks(self, chunks: Iterator[str]) -> Iterator[int]:
        """As encode, of a text that arrives in chunks.  The last two pieces of
        what has arrived may still change and wait."""
        rest = ""
        for c in chunks:
            rest += c
            found = list(self.split.finditer(rest))
            if len(found) > 2:
                for m in found[:-2]:
                    yield from self.piece(m.group())
                rest = rest[found[-2].start() :]
        for m in self.split.finditer(rest):
            yield from self.piece(m.group())

    def decode_stream(self, ids: Iterator[int]) -> Iterator[str]:
        """Text as soon as its bytes are complete; bad bytes become U+FFFD."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if s := state.decode(self.bytes_of[i]):
                yield s
        if s := state.decode(b"", True):
            yield s

    def decode(self, ids: Iterator[int]) -> str:
        return "".join(self.decode_stream(iter(ids)))


@lru_cache(maxsize=2)
def transducer(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> Transducer:
    """One encoder per worker process."""
    return Transducer(os.path.join(folder, f"{name}.tiktoken"))


def token_ids(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): each row's text encoded whole.

    Null and empty texts give an empty list; repeated rows are encoded again; a
    narrow map without a shuffle, other columns are not read."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(name, folder)
        for b in batches:
            ids = [t.encode(x) for x in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"])

    d = documents.select(documents[id_col].alias("doc_id"), documents[text_col].alias("text"))
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, ids array<int>")


def token_counts(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n): number of tokens of each row's text; 0 for null and empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer(name, folder)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n": np.array([len(t.encode(x)) for x in b["text"]], np.int64)})

    d = documents.select(documents[id_col].alias("doc_id"), documents[text_col].alias("text"))
    return d.mapInPandas(run, f"doc_id {dict(d.dtypes)['doc_id']}, n long")
