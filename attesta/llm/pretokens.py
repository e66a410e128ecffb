"""Vectorised pre-tokenising: whole batches of texts are cut into pre-tokens with numpy and counted as a dictionary.

Two patterns of the public tokenizers are known: ``gpt`` (`public_tokenizers.PATTERN`: contractions, an optional blank
before letters, digits or other signs, runs of white space) and ``word`` (lower case, white space dropped, single digits).
Character classes come from the ``regex`` library for code points on which it and the tokenizer libraries agree; a text
with any other code point is left to the caller's slow path, whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from attesta.llm.common import in_slabs, worker_state

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 255
#: Code points with one reading in all libraries; checked against them in the tests.
GPT_RANGES = ((0x0, 0x530), (0x2010, 0x2028), (0x20A0, 0x20C0), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4))
#: The same, and unchanged by NFC as well as lower-cased alike.
WORD_RANGES = ((0x0, 0x300), (0x410, 0x450), (0x2010, 0x2028), (0x4E00, 0x9FA6))
SLAB_CHARS = 1 << 20


def class_table(ranges) -> np.ndarray:
    import regex

    table = np.full(0x10001, UNKNOWN, np.uint8)
    for a, b in ranges:
        chars = "".join(map(chr, range(a, b)))
        table[a:b] = OTHER
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            for m in regex.finditer(f"{pattern}+", chars):
                table[a + m.start():a + m.end()] = kind
    table[0x130] = UNKNOWN  # lower case makes two characters of it
    return table


def gpt_breaks(cp: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a pre-token starts.  ``first`` marks the first character of each text."""
    n = len(cp)
    brk = first.copy()
    brk[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(brk[1:] & (kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:]) + 1
    brk[after - 1] = True  # the last white space before a word leaves its run ...
    brk[after[cp[after - 1] == 32]] = False  # ... and a blank joins the word
    return _contractions(cp, kind, first, brk, n)


def word_breaks(cp: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    brk = first | (kind == NUMBER)
    brk[1:] |= kind[1:] != kind[:-1]
    return _contractions(cp, kind, first, brk, len(cp))


def _contractions(cp, kind, first, brk, n) -> np.ndarray:
    at = np.flatnonzero((cp[:-1] == 39) & brk[:-1] & (kind[1:] == LETTER) & ~first[1:]) if n > 1 else np.empty(0, np.int64)
    if len(at):
        c1 = cp[at + 1]
        one = at[np.isin(c1, [ord(c) for c in "stmd"])]
        brk[one + 1] = False
        brk[one[one + 2 < n] + 2] = True
        two = at[at + 2 < n]
        c1, c2 = cp[two + 1], cp[two + 2]
        fits = (((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        two = two[fits & ~first[two + 2]]
        brk[two + 1] = False
        brk[two[two + 3 < n] + 3] = True
    return brk


@dataclass
class Slab:
    """Pre-tokens of some texts: ``index[bounds[i]:bounds[i+1]]`` are the numbers in ``words`` of text ``rows[i]``'s."""

    rows: list[int]
    words: list[bytes]
    index: np.ndarray
    bounds: np.ndarray


def long_pieces(text: str, limit: int) -> Iterator[str]:
    """Cut a very long text before white space that follows another sign; no pre-token crosses such a place."""
    start, cut = 0, re.compile(r"(?<=\S)\s")
    while len(text) - start > limit:
        m = cut.search(text, start + limit)
        if not m:
            break
        yield text[start:m.start()]
        start = m.start()
    yield text[start:]


def slabs(texts: list[str], pattern: str, slow_marks: tuple[str, ...] = ()) -> Iterator[Slab | tuple[int, str]]:
    """Slabs of the texts that the fast path reads, and (row, text) for each of the rest (once per text).

    A text longer than a slab comes in several pieces, in order; a row may so occur in several slabs.
    """
    ranges, breaks = (WORD_RANGES, word_breaks) if pattern == "word" else (GPT_RANGES, gpt_breaks)
    table = worker_state(f"classes_{pattern}", lambda: class_table(ranges))
    rows, parts = [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        if any(m in text for m in slow_marks) or (len(text) > SLAB_CHARS and not known(text, table)):
            yield i, text
            continue
        for piece in long_pieces(text, SLAB_CHARS):
            rows.append(i)
            parts.append(piece.lower() if pattern == "word" else piece)
    for a, b in in_slabs([len(p) for p in parts], SLAB_CHARS):
        yield from _slab(rows[a:b], parts[a:b], texts, table, breaks, pattern)


def known(text: str, table: np.ndarray) -> bool:
    step = SLAB_CHARS
    return all((table[np.minimum(np.frombuffer(text[a:a + step].encode("utf-32-le"), np.uint32), 0x10000)] != UNKNOWN).all() for a in range(0, len(text), step))


def _slab(rows, parts, texts, table, breaks, pattern):
    joined = "".join(parts)
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = table[cp if len(cp) and cp.max() <= 0x10000 else np.minimum(cp, 0x10000)]
    lengths = np.array([len(p) for p in parts])
    ends = np.cumsum(lengths)
    if (kind == UNKNOWN).any():
        bad = set(np.searchsorted(ends, np.flatnonzero(kind == UNKNOWN), "right").tolist())
        for i in sorted(bad):
            yield rows[i], texts[rows[i]]
        keep = [i for i in range(len(rows)) if i not in bad]
        if keep:
            yield from _slab([rows[i] for i in keep], [parts[i] for i in keep], texts, table, breaks, pattern)
        return
    first = np.zeros(len(cp), bool)
    first[ends - lengths] = True
    starts = np.flatnonzero(breaks(cp, kind, first))
    data = joined.encode()
    if len(data) == len(cp):
        offsets = starts
    else:
        width = np.concatenate(([0], np.cumsum(1 + (cp >= 0x80) + (cp >= 0x800).astype(np.int64))))
        offsets = width[starts]
    offsets = np.append(offsets, len(data)).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    index = coded.indices.to_numpy()
    bounds = np.searchsorted(starts, np.append(ends - lengths, len(cp)))
    if pattern == "word":
        kept = kind[starts] != SPACE
        index = index[kept]
        bounds = np.concatenate(([0], np.cumsum(kept)))[bounds]
        used, index = np.unique(index, return_inverse=True)
        yield Slab(rows, coded.dictionary.take(pa.array(used)).to_pylist(), index, bounds)
        return
    yield Slab(rows, coded.dictionary.to_pylist(), index, bounds)


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[s:s+n] for each start and length, end to end."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return values[np.arange(total) + shift]
