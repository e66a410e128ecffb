"""Secrets in texts, by a trigram index.

Every rule is a regular expression.  `trigram_query` derives from it a Boolean query over trigrams of bytes that any match must
satisfy: literal runs give conjunctions, alternatives give disjunctions, open parts (wide classes, unbounded repeats) give
nothing.  A rule from which nothing mandatory follows has the query ``None``.

Tasks index their documents in blocks of a few megabytes: one table lookup per byte position yields the postings (sorted
document numbers) of all trigrams that any rule asks for.  Postings of a query are intersected and united, and a rule's
expression runs on the candidates alone; a rule without a query scans every text.  Candidates depend on a document's
own trigrams only, so an index of a block answers for the block and nothing is shuffled; memory is one block, whatever the
corpus.  The index folds A-Z, and a window across two neighbouring texts only adds a candidate, so no match is lost.

Null texts count as empty and have no hits; null ids stay null; repeated rows are judged each by itself; an empty table gives none.
Only the two named columns are read, so extra columns can't clash.  A text far longer than a block is a block of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from re import _constants as C, _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from attesta.llm.common import slices, worker_state

#: Literal alternatives followed at once, and the widest character class that counts as literal.
MOST_STRINGS, MOST_CHARACTERS = 64, 8
HITS = "array<struct<kind:string,start:int,end:int,value:string>>"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and non-overlapping; those whose ``group`` has fewer than ``least`` characters drop out."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: The patterns of the three base kinds, in their order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Further kinds with published prefixes; their spans come on top.
FURTHER = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE + FURTHER


# --- queries from expressions --------------------------------------------------------------------

#: A query is None (anything), a trigram, or ("and" | "or", queries).


def trigram_query(pattern: str):
    """The Boolean query over folded byte trigrams that every match of ``pattern`` satisfies; None if nothing is mandatory."""
    exact, query = _sequence(_parser.parse(pattern))
    return _both(query, _of_strings(exact))


def _of_strings(strings):
    """Any of the strings occurs: each is the conjunction of its trigrams, and one that asks for more than another goes."""
    if strings is None:
        return None
    sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
    least = [s for s in sets if not any(t < s for t in sets)]
    parts = [sorted(s) for s in sorted(least, key=sorted)]
    return _any([None if not p else p[0] if len(p) == 1 else ("and", tuple(p)) for p in parts])


def _any(parts):
    if not parts or any(p is None for p in parts):
        return None
    parts = tuple(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", parts)


def _both(a, b):
    if a is None or b is None:
        return b if a is None else a
    return a if a == b else ("and", (a, b))


def _sequence(items):
    """(exact strings or None, query) of a concatenation."""
    held, query, whole = {b""}, None, True
    for item in items:
        strings, also = _item(item)
        query = _both(query, also)
        if strings is not None and len(held) * len(strings) <= MOST_STRINGS:
            held = {a + b for a in held for b in strings}
            continue
        query = _both(query, _of_strings(held))  # the run of literals ends here
        whole, held = False, {b""}
        if strings is not None:
            held = strings
    if whole:
        return held, query
    return None, _both(query, _of_strings(held))


def _item(item):
    op, value = item
    if op is C.LITERAL:
        text = chr(value)
        return ({text.lower().encode()} if text.isascii() else None), None
    if op is C.IN:
        found = _characters(value)
        return found, None
    if op is C.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MOST_STRINGS:
            return set().union(*(s for s, _ in parts)), None
        return None, _any([_both(q, _of_strings(s)) for s, q in parts])
    if op is C.SUBPATTERN:
        return _sequence(value[3])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, inner = value
        strings, query = _sequence(inner)
        if strings is not None and low == 0 and high == 1:
            return strings | {b""}, None
        if strings is not None and low == high and 0 < low <= 8 and len(strings) ** low <= MOST_STRINGS:
            out = {b""}
            for _ in range(low):
                out = {a + b for a in out for b in strings}
            return out, None
        return None, None if low == 0 else _both(query, _of_strings(strings))
    if op is C.AT:
        return {b""}, None
    return None, None


def _characters(parts):
    found: set[bytes] = set()
    for op, value in parts:
        if op is C.LITERAL:
            codes = [value]
        elif op is C.RANGE and value[1] - value[0] < 2 * MOST_CHARACTERS:
            codes = range(value[0], value[1] + 1)
        else:
            return None
        if any(c > 127 for c in codes):
            return None
        found |= {chr(c).lower().encode() for c in codes}
    return found if len(found) <= MOST_CHARACTERS else None


def grams_of(query) -> set[bytes]:
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*(grams_of(q) for q in query[1]))


# --- the index of a block ------------------------------------------------------------------------


class Index:
    """Finds the documents of a block that can match each rule."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = [(r, r.compiled(), trigram_query(r.pattern)) for r in rules]
        self.grams = sorted(set().union(*(grams_of(q) for _, _, q in self.rules)))
        self.number = {g: i for i, g in enumerate(self.grams)}
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        self.fold = fold
        # trigrams are filed under 16 bits of their code, so the lookup table stays in the processor's cache
        codes = np.array([int.from_bytes(g, "big") for g in self.grams], np.int64)
        self.slot = np.full(1 << 16, -1, np.int32)
        self.codes, self.next = codes, np.full(len(codes), -1, np.int32)
        for i, c in enumerate(_mixed(codes).tolist()):
            self.next[i], self.slot[c] = self.slot[c], i

    def postings(self, data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Sorted numbers of the documents that hold each trigram; ``ends`` are the documents' ends in ``data``."""
        none = [np.empty(0, np.int64)] * len(self.grams)
        if len(data) < 3 or not self.grams:
            return none
        low = self.fold[data].astype(np.uint32)
        code = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
        at = np.flatnonzero(self.slot[_mixed(code)] >= 0)
        code = code[at]
        entry = self.slot[_mixed(code)]
        pairs = []
        while len(at):
            same = self.codes[entry] == code
            doc = np.searchsorted(ends, at[same], "right")
            pairs.append(np.unique(entry[same].astype(np.int64) * len(ends) + doc))
            entry = self.next[entry]
            more = (entry >= 0) & ~same
            at, code, entry = at[more], code[more], entry[more]
        gram, doc = np.divmod(np.sort(np.concatenate(pairs)) if pairs else np.empty(0, np.int64), max(1, len(ends)))
        cuts = np.searchsorted(gram, np.arange(len(self.grams) + 1))
        return [doc[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def candidates(self, query, postings: list[np.ndarray], n: int) -> np.ndarray:
        if query is None:
            return np.arange(n)
        if isinstance(query, bytes):
            return postings[self.number[query]]
        parts = sorted((self.candidates(q, postings, n) for q in query[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, True) if query[0] == "and" else np.union1d(out, p)
        return out

    def hits(self, batch: pa.Array) -> list[list[tuple]]:
        """(kind, start, end, value) of every text, by start and then by the order of the rules."""
        offsets = np.frombuffer(batch.buffers()[1], np.int32)[batch.offset:batch.offset + len(batch) + 1].astype(np.int64)
        held = batch.buffers()[2]
        data = np.frombuffer(held, np.uint8)[offsets[0]:offsets[-1]] if held is not None else np.empty(0, np.uint8)
        postings = self.postings(data, offsets[1:] - offsets[0])
        texts: dict[int, str] = {}
        found: list[list[tuple]] = [[] for _ in range(len(batch))]
        for k, (rule, pattern, query) in enumerate(self.rules):
            for i in self.candidates(query, postings, len(batch)).tolist():
                text = texts.get(i)
                if text is None:
                    text = texts[i] = batch[i].as_py()
                for m in pattern.finditer(text):
                    a, b = m.span(rule.group)
                    if b - a >= rule.least:
                        found[i].append((m.start(), k, rule.kind, m.end(), m.group(rule.group)))
        return [[(kind, a, b, value) for a, _, kind, b, value in sorted(f)] for f in found]


def _mixed(code: np.ndarray) -> np.ndarray:
    return (code ^ (code >> 8)) & 0xFFFF


def find_secrets(df: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hits): every match of every rule in each whole text, ``start`` and ``end`` in code points, ``end`` exclusive.

    ``start`` and ``end`` are those of the whole match, ``value`` is the rule's group, the secret itself.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rules = tuple(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = worker_state(f"secrets_{hash(rules)}", lambda: Index(rules))
        for batch in slices(batches):
            rows = [[dict(zip(("kind", "start", "end", "value"), h, strict=True)) for h in hits] for hits in index.hits(batch.column(1).cast(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _ARROW_HITS)], names=[id_col, "hits"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(id_col, text.alias("text")).mapInArrow(run, f"`{id_col}` {kind}, hits {HITS}")


_ARROW_HITS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))


def spans_of(hits: Column, kinds: Sequence[str] | None = None) -> Column:
    """``kind:start:end`` of the hits (of some kinds), comma-joined in their order."""
    chosen = hits if kinds is None else F.filter(hits, lambda h: h["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda h: F.concat_ws(":", h["kind"], h["start"].cast("string"), h["end"].cast("string"))), ",")


def count_of(hits: Column, kind: str) -> Column:
    return F.size(F.filter(hits, lambda h: h["kind"] == kind)).cast("long")
