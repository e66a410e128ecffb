"""Byte-level BPE by ranks, merged with a segment tree over byte positions.

Each pre-token is a row of leaves, one per byte.  A leaf holds (rank, position) of the pair that starts there, or a
sentinel; an inner node holds the least of its children, so the root names the leftmost pair of least rank.  A merge
joins a live position with its live right neighbour and updates three leaves (the merged one, the neighbour that died,
the left neighbour whose pair changed), each with its path to the root: O(log n) per merge.  Many pre-tokens of like length
are merged side by side, one step each, with numpy.

Texts: null is treated as empty; an empty text has no ids and decodes to empty bytes.  Repeated rows give repeated results;
other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attesta.llm.common import slices, worker_state
from attesta.llm.pretokens import Slab, ragged, slabs

NONE = np.int64(1) << 60
#: Words kept per worker before the cache starts anew; bounds memory, not results.
CACHE_WORDS = 120_000


class Ranks:
    """Rank file of a byte-level BPE: token bytes with their ranks; the rank is the id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for t, r in self.rank.items():
            self.token[r] = t
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        pairs = [
            (left << 20 | right, r)
            for t, r in self.rank.items() if len(t) > 1
            for k in range(1, len(t))
            if (left := self.rank.get(t[:k])) is not None and (right := self.rank.get(t[k:])) is not None
        ]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.bits = max(4, int(len(table) * 4).bit_length())
        self._index(table)

    def _index(self, table: np.ndarray) -> None:
        """Open addressing with linear probing, filled round by round."""
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        left, slot = table, self._slot(table[:, 0])
        while len(left):
            free = self.keys[slot] < 0
            chosen, at = np.unique(np.where(free, slot, -1), return_index=True)
            at = at[chosen >= 0]
            self.keys[slot[at]], self.values[slot[at]] = left[at, 0], left[at, 1]
            rest = np.ones(len(left), bool)
            rest[at] = False
            left, slot = left[rest], slot[rest]
            slot = np.where(self.keys[slot] >= 0, (slot + 1) & (size - 1), slot)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the pair of two ids, or -1; ids below 0 stand for no symbol."""
        key = left << 20 | right
        out = np.full(len(key), -1, np.int64)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        slot = self._slot(key[open_])
        mask = len(self.keys) - 1
        while len(open_):
            held = self.keys[slot]
            hit = held == key[open_]
            out[open_[hit]] = self.values[slot[hit]]
            more = ~hit & (held >= 0)
            open_, slot = open_[more], (slot[more] + 1) & mask
        return out


def ranks_of(path: str) -> Ranks:
    return worker_state(f"ranks_{path}", lambda: Ranks(path))


def merge_words(words: list[bytes], ranks: Ranks) -> list[bytes]:
    """Ids of each word (not empty), packed as 32-bit integers."""
    out = [b""] * len(words)
    by_size: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        whole = ranks.rank.get(w)
        if whole is not None:
            out[i] = whole.to_bytes(4, "little")
        else:
            by_size.setdefault(max(1, (len(w) - 1).bit_length()), []).append(i)
    for depth, members in by_size.items():
        step = max(1, (1 << 19) >> depth)
        for a in range(0, len(members), step):
            part = members[a:a + step]
            for i, ids in zip(part, _merge([words[i] for i in part], depth, ranks), strict=True):
                out[i] = ids
    return out


def _merge(words: list[bytes], depth: int, ranks: Ranks) -> list[bytes]:
    n, width = len(words), 1 << depth
    lengths = np.array([len(w) for w in words])
    flat = np.frombuffer(b"".join(words), np.uint8)
    row, col = np.repeat(np.arange(n), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    symbol = np.full((n, width + 2), -1, np.int64)  # column 0 and the one after the last byte are no symbols
    symbol[row, col + 1] = ranks.byte[flat]
    after = np.minimum(np.arange(width + 2) + 1, width + 1)[None, :].repeat(n, 0)
    before = np.maximum(np.arange(width + 2) - 1, 0)[None, :].repeat(n, 0)
    pair = ranks.of(symbol[:, 1:-1].ravel(), symbol[:, 2:].ravel()).reshape(n, width)
    tree = np.empty((n, 2 * width), np.int64)
    tree[:, width:] = np.where(pair >= 0, pair << 32 | np.arange(width), NONE)
    for level in range(depth - 1, -1, -1):
        a, b = 1 << level, 2 << level
        below = tree[:, b:2 * b]
        tree[:, a:b] = np.minimum(below[:, 0::2], below[:, 1::2])
    live = np.arange(n)
    while True:
        root = tree[live, 1]
        live = live[root < NONE]
        if not len(live):
            break
        root = tree[live, 1]
        at = (root & 0xFFFFFFFF) + 1
        dead = after[live, at]
        nxt, prev = after[live, dead], before[live, at]
        merged = root >> 32
        symbol[live, at] = merged
        symbol[live, dead] = -1
        after[live, at] = nxt
        before[live, nxt] = at
        new = np.concatenate((ranks.of(merged, symbol[live, nxt]), ranks.of(symbol[live, prev], merged)))
        rows = np.concatenate((live, live, live))
        node = np.concatenate((at, np.maximum(prev, 1), dead)) - 1 + width
        m = len(live)
        value = np.full(3 * m, NONE, np.int64)
        found = np.flatnonzero(new >= 0)
        value[found] = new[found] << 32 | (node[found] - width)
        skip = prev == 0  # no left neighbour: repeat the merged leaf
        value[m:2 * m][skip], node[m:2 * m][skip] = value[:m][skip], node[:m][skip]
        tree[rows, node] = value
        for _ in range(depth):
            node >>= 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
    keep = symbol[:, 1:-1] >= 0
    packed = symbol[:, 1:-1][keep].astype(np.uint32).tobytes()
    ends = (np.cumsum(keep.sum(1)) * 4).tolist()
    return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class WordIds:
    """Ids of pre-tokens, kept per worker up to a number of words."""

    def __init__(self, path: str):
        self.ranks, self.held = ranks_of(path), {}

    def table(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids of the words, start and length of each."""
        held = self.held
        missing = [w for w in words if w not in held]
        if missing:
            if len(held) > CACHE_WORDS:
                held.clear()
                missing = words
            for w, ids in zip(missing, merge_words(missing, self.ranks), strict=True):
                held[w] = ids
        coded = [held[w] for w in words]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded)) >> 2
        return np.frombuffer(b"".join(coded), np.uint32), np.cumsum(lengths) - lengths, lengths


def encode_texts(texts: list[str], path: str, pattern: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    words = worker_state(f"bpe_words_{path}", lambda: WordIds(path))
    out: list[list[bytes]] = [[] for _ in texts]
    for part in slabs(texts, "gpt"):
        if isinstance(part, Slab):
            flat, starts, lengths = words.table(part.words)
            n = lengths[part.index]
            ids = ragged(flat, starts[part.index], n)
            ends = np.concatenate(([0], np.cumsum(n)))[part.bounds]
            for k, row in enumerate(part.rows):
                out[row].append(ids[ends[k]:ends[k + 1]].tobytes())
        else:
            import regex

            row, text = part
            found = [m.encode() for m in regex.findall(pattern, text)]
            order = list(dict.fromkeys(found))
            flat, starts, lengths = words.table(order)
            place = {w: i for i, w in enumerate(order)}
            index = np.fromiter((place[w] for w in found), np.int64, len(found))
            out[row] = [ragged(flat, starts[index], lengths[index]).tobytes()]
    return [b"".join(x) for x in out]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of each whole text, packed as little-endian unsigned 32-bit integers.

    ``pattern`` splits a text before the merges.  Null texts count as empty, null ids stay null, repeated rows stay.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = encode_texts(batch.column(1).to_pylist(), path, pattern)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=[id_col, "ids"])

    return df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids binary")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_text, decoded): decoded bytes of packed ids, and the ids in decimal joined by a blank."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield _decoded(batch.column(0), batch.column(1).to_pylist(), path, id_col)

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, {DECODED}")


DECODED = "n_tokens long, ids_text string, decoded binary"


def _decoded(ids: pa.Array, packed: list[bytes], path: str, id_col: str) -> pa.RecordBatch:
    token = ranks_of(path).token
    decimal = worker_state(f"decimal_{path}", lambda: [str(i) for i in range(len(token))])
    rows = [np.frombuffer(x, np.uint32).tolist() for x in packed]
    return pa.RecordBatch.from_arrays([
        ids, pa.array([len(x) for x in rows], pa.int64()),
        pa.array([" ".join([decimal[i] for i in x]) for x in rows], pa.string()),
        pa.array([b"".join([token[i] for i in x]) for x in rows], pa.binary()),
    ], names=[id_col, "n_tokens", "ids_text", "decoded"])


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode(encode(df))`` in one pass, so that the ids don't travel in between."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield _decoded(batch.column(0), encode_texts(batch.column(1).to_pylist(), path, pattern), path, id_col)

    return df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, {DECODED}")
