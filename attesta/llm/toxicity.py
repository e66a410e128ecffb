"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, and a linear classifier.

Voters fire or abstain.  Lexicon voters share out the terms that a bounded sample of labelled rows ties to the label (a
likelihood-ratio test against the number of terms tested), one more holds a fixed list of insults, pattern voters look at
shouting, piled-up marks, masked letters and insults beside a second person; one voter for the clean side fires where no term occurs.

The label model sees no labels but the share of positives: from the firing rates and covariances of the voters over all documents
it estimates how often each fires on either side.  Off the diagonal the covariance is of rank one for voters that are independent
given the label; pairs that stand out from this are dependent, are left out of the fit, and discount each other's vote.
Its posterior is the label that a logistic regression over terms and patterns learns from, on a bounded sample of rows.

The score reads the text alone; labels, language, source and id are never features.  Null texts count as empty and get a score
like any text; rows without an id are scored (and are no training rows); repeated rows stay.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from attesta.llm.common import slices, written
from attesta.llm.pretokens import Slab, slabs

#: Labelled rows of each class for the terms, rows for the classifier, lexicon voters.
LABELLED, FITTED, LEXICONS = 10_000, 20_000, 24
#: Fixed lists.
INSULTS = ("idiot moron stupid dumb fool loser scum trash garbage pathetic worthless disgusting clown imbecile cretin "
           "jerk bastard bitch asshole dickhead shithead idioten dummkopf arschloch abschaum schwachkopf versager "
           "imbécile connard connasse salaud ordure abruti crétin idiota estúpido imbécil gilipollas cabrón basura payaso").split()
SECOND_PERSON = "you your yours du dich dein ihr tu toi vous vos tú usted vosotros".split()
PATTERNS = ("shouting", "piled_marks", "masked_letters", "addressed_insult")
_MASKED = re.compile(r"[A-Za-z][*#@$]{2,}[A-Za-z]?")
_UPPER = bytes(range(65, 91))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def words_of(texts: list[str]) -> list[Counter]:
    """Lower-case words of each text with their numbers."""
    out = [Counter() for _ in texts]
    for part in slabs(texts, "word"):
        if isinstance(part, Slab):
            for k, row in enumerate(part.rows):
                index, n = np.unique(part.index[part.bounds[k]:part.bounds[k + 1]], return_counts=True)
                for i, c in zip(index.tolist(), n.tolist(), strict=True):
                    out[row][part.words[i].decode()] += c
        else:
            out[part[0]].update(re.findall(r"\w+", part[1].lower()))
    return out


def sample_labels(labels: DataFrame, id_col: str, label_col: str, bound: int) -> DataFrame:
    """At most ``bound`` labelled training rows of each class, chosen by a hash of the id."""
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    order = F.xxhash64("_id"), F.col("_id")
    return rows.where("_y = 1").orderBy(*order).limit(bound).union(rows.where("_y = 0").orderBy(*order).limit(bound))


def one_of_like_texts(sample: DataFrame) -> DataFrame:
    """(text, _y): of sampled texts (_id, text, _y) with the same least shingle hash and label, one.

    Words that a label's many near copies share would otherwise pass for signs of the label.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in slices(batches):
            keys = []
            for text in batch.column(1).to_pylist():
                words = (text or "").lower().split()
                keys.append(min((digest(" ".join(words[i:i + 3])) for i in range(max(1, len(words) - 2))), default=0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(keys, np.uint64).view(np.int64))], names=["_id", "_y", "_key"])

    kind = sample.schema["_id"].dataType.simpleString()
    keyed = sample.select("_id", "text", "_y").mapInArrow(run, f"_id {kind}, _y int, _key long")
    first = keyed.groupBy("_key", "_y").agg(F.min("_id").alias("_id"))  # ids only: the texts are not shuffled
    return sample.join(F.broadcast(first.select("_id")), "_id", "left_semi").select("text", "_y")  # as bounded as the sample


def mine_terms(sample: DataFrame) -> list[str]:
    """All words of the sample (text, _y) that go with label 1, strongest first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):  # counts of a slice go on, so a task holds one slice's words
            held = (Counter(), Counter())
            for words, y in zip(words_of([x or "" for x in batch.column(0).to_pylist()]), batch.column(1).to_pylist(), strict=True):
                held[y].update(words.keys())
                held[y][""] += 1
            w = list(held[0].keys() | held[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), *(pa.array([held[y][x] for x in w], pa.int64()) for y in (1, 0))], names=["w", "p", "n"])

    counts = written(sample.mapInArrow(count, "w string, p long, n long").groupBy("w").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), "term-counts")
    size = counts.where("w = ''").first()
    if not size or not size.p or not size.n:
        return []
    total, share = size.p + size.n, size.p / (size.p + size.n)
    tested = counts.where("w <> '' AND p + n >= 3")
    limit = 2 * math.log(max(tested.count(), 2)) + 4
    p, n = F.col("p").cast("double"), F.col("n").cast("double")

    def part(x: Column, e: Column) -> Column:
        return F.when(x > 0, x * F.log(x / e)).otherwise(0.0)

    seen = p + n
    ratio = 2 * (part(p, seen * share) + part(n, seen * (1 - share)) + part(size.p - p, (total - seen) * share) + part(size.n - n, (total - seen) * (1 - share)))
    strong = tested.where(p * (1 - share) > 4 * n * share).select("w", ratio.alias("g")).where(F.col("g") > limit)
    return [r.w for r in strong.orderBy(F.desc("g"), "w").collect()]  # every term that passes: as bounded as the sample


def features(docs: DataFrame, terms: list[str], id_col: str, text_col: str, carry: list[str] = ()) -> DataFrame:
    """(doc_id, hits, marks): numbers of the terms and insults that occur, and of the patterns that do; with ``carry`` also the text and these columns."""
    kind = docs.schema[id_col].dataType.simpleString()
    place = {w: i for i, w in enumerate(dict.fromkeys([*terms, *INSULTS]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second = set(SECOND_PERSON)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            hits: list[set[int]] = [set() for _ in texts]
            spoken = [False] * len(texts)
            for part in slabs(texts, "word"):
                if isinstance(part, Slab):
                    words = [w.decode() for w in part.words]
                    code = np.fromiter((place.get(w, -2 if w in second else -1) for w in words), np.int64, len(words))[part.index]
                    found = np.flatnonzero(code != -1)
                    owner = np.searchsorted(part.bounds, found, "right") - 1
                    for k, c in zip(owner.tolist(), code[found].tolist(), strict=True):
                        row = part.rows[k]
                        if c < 0:
                            spoken[row] = True
                        else:
                            hits[row].add(c)
                else:
                    own = set(re.findall(r"\w+", part[1].lower()))
                    hits[part[0]] = {place[w] for w in own if w in place}
                    spoken[part[0]] = bool(own & second)
            marks = [[i for i, x in enumerate((shouts(t), "!!!" in t or "?!?" in t, _MASKED.search(t) is not None, s and bool(h))) if x] for t, s, h in zip(texts, spoken, hits, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(h) for h in hits], pa.list_(pa.int32())), pa.array(marks, pa.list_(pa.int32())), *batch.columns[1:][:2 * bool(carry)]], names=names)

    schema = T.StructType.fromDDL(f"doc_id {kind}, hits array<int>, marks array<int>")
    given = docs.select(id_col, F.col(text_col).alias("text"), *([F.struct(*(F.col(f"`{c}`") for c in carry)).alias("rest")] if carry else []))
    if carry:
        schema = schema.add("text", "string").add("rest", given.schema["rest"].dataType)
    names = schema.names
    return given.mapInArrow(run, schema)


def shouts(text: str) -> bool:
    raw = text.encode()
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return upper > 10 and upper * 2 > len(raw)


def voters(hits: list[list[int]], marks: list[list[int]], terms: int, insults: frozenset[int]) -> np.ndarray:
    """Which voters fire: lexicons, the fixed list, patterns, and last the one for the clean side."""
    out = np.zeros((len(hits), LEXICONS + 2 + len(PATTERNS)), bool)
    for i, (h, m) in enumerate(zip(hits, marks, strict=True)):
        for t in h:
            if t < terms:
                out[i, t % LEXICONS] = True
        out[i, LEXICONS] = not insults.isdisjoint(h)
        out[i, [LEXICONS + 1 + x for x in m]] = True
        out[i, -1] = not h
    return out


def moments(rows: DataFrame, terms: int, insults: frozenset[int]) -> tuple[int, np.ndarray]:
    """Number of documents, and for each two voters how often both fire, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            fired = voters(batch.column(0).to_pylist(), batch.column(1).to_pylist(), terms, insults).astype(np.float64)
            total = fired.T @ fired + (0 if total is None else total)
            n += len(fired)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, total.size)), pa.array(np.append(n, total.ravel()).astype(np.int64))], names=["cell", "n"])

    cells = {r.cell: r.n for r in rows.select("hits", "marks").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    size = LEXICONS + 2 + len(PATTERNS)
    return cells.get(-1, 0), np.array([cells.get(i, 0) for i in range(size * size)], float).reshape(size, size)


class LabelModel:
    """How often each voter fires on either side, and how much its vote counts, from rates and covariances alone."""

    def __init__(self, n: int, both: np.ndarray, positive: float):
        rate = np.diag(both) / max(n, 1)
        cov = both / max(n, 1) - np.outer(rate, rate)
        spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-12))
        used = ~np.eye(len(rate), dtype=bool)
        pull = self._rank_one(cov, used)
        rest = (cov - np.outer(pull, pull)) / np.outer(spread, spread)
        off = rest[used]
        wide = 4 * 1.4826 * np.median(np.abs(off - np.median(off))) + 0.02
        dependent = (np.abs(rest) > wide) & used & (np.outer(rate, rate) > 0)
        keep = used & ~dependent
        keep[keep.sum(1) < len(rate) // 2] = used[keep.sum(1) < len(rate) // 2]
        pull = self._rank_one(cov, keep & keep.T)
        gap = pull / math.sqrt(max(positive * (1 - positive), 1e-6))
        floor = 0.5 / max(n, 1)
        self.on_negative = np.clip(rate - positive * gap, floor, 1 - floor)
        self.on_positive = np.clip(rate + (1 - positive) * gap, floor, 1 - floor)
        rest = np.abs(cov - np.outer(pull, pull)) / np.outer(spread, spread)
        self.discount = 1 / (1 + np.minimum(np.where(dependent, rest, 0), 1).sum(1))
        self.weight = np.where(rate > 0, self.discount * np.log(self.on_positive / self.on_negative), 0.0)
        self.prior = math.log(max(positive, 1e-6) / max(1 - positive, 1e-6))

    @staticmethod
    def _rank_one(cov: np.ndarray, used: np.ndarray) -> np.ndarray:
        target = np.where(used, cov, 0)
        c = np.sqrt(np.maximum(np.abs(target).max(1), 1e-12))
        c[-1] = -c[-1]  # the clean side's voter
        for _ in range(200):
            below = used @ (c * c)
            c = 0.5 * c + 0.5 * np.where(below > 1e-15, target @ c / np.maximum(below, 1e-15), 0)
        return c if c[:LEXICONS + 1].sum() >= 0 else -c

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(fired @ self.weight + self.prior, -30, 30)))


class Design:
    """Features: each term or insult, each pattern, how many terms occur (logarithm), that any does, and a constant.

    The ones are kept by place, so neither fit nor scores grow with rows times terms.
    """

    def __init__(self, hits: list[list[int]], marks: list[list[int]], size: int):
        found = np.fromiter(map(len, hits), np.int64, len(hits))
        places = [[*h, *(size + k for k in m)] for h, m in zip(hits, marks, strict=True)]
        self.at = np.fromiter(itertools.chain.from_iterable(places), np.int64)
        self.row = np.arange(len(hits)).repeat(np.fromiter(map(len, places), np.int64, len(hits)))
        self.dense = np.stack((np.log1p(found), found > 0, np.ones(len(hits))), 1)
        self.ones = size + len(PATTERNS)

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], len(self.dense)) + self.dense @ w[-3:]

    def back(self, u: np.ndarray, power: int = 1) -> np.ndarray:
        """Sums of ``u`` over the rows of each feature, weighted by the feature's value to this power."""
        return np.concatenate((np.bincount(self.at, u[self.row], self.ones), u @ self.dense ** power))

    def chances(self, w: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self @ w, -30, 30)))


def fit(x: Design, y: np.ndarray, start: np.ndarray, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps, each by conjugate gradients; the penalty draws the weights to ``start``."""
    w = start.copy()
    ridge = np.full(len(start), penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = x.chances(w)
        spread = p * (1 - p) + 1e-9
        step = solve(lambda v: x.back(spread * (x @ v)) + ridge * v, x.back(spread, 2) + ridge, x.back(p - y) + ridge * (w - start))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def solve(times: Callable[[np.ndarray], np.ndarray], diagonal: np.ndarray, right: np.ndarray, precision: float = 1e-10) -> np.ndarray:
    """Conjugate gradients for a symmetric positive matrix, given by its product with a vector and by its diagonal."""
    out, rest = np.zeros_like(right), right.copy()
    way = eased = rest / diagonal
    size = rest @ eased
    limit = precision ** 2 * size
    for _ in range(4 * len(right)):
        if size <= limit or not size:
            break
        turned = times(way)
        far = size / (way @ turned)
        out, rest = out + far * way, rest - far * turned
        eased = rest / diagonal
        size, before = rest @ eased, size
        way = eased + size / before * way
    return out


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          labelled: int = LABELLED, fitted: int = FITTED, carry: list[str] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; learns from labels of rows that aren't held out.

    ``carry`` names columns to hand on beside the scores, as fields of a column ``rest``; the text comes with them as ``text``.  So whole rows can be
    judged without a join by id.
    """
    known = labels.select(id_col, label_col)
    chosen = sample_labels(known, id_col, label_col, labelled)
    joined = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col(id_col) == F.col("_id"))  # at most 2 x labelled rows
    found = mine_terms(one_of_like_texts(joined))
    place = {w: i for i, w in enumerate(dict.fromkeys([*found, *INSULTS]))}
    insults = frozenset(place[w] for w in INSULTS)
    rows = written(features(docs, found, id_col, text_col, carry), "toxicity-features")
    share = known.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).agg(F.avg(F.col(label_col).cast("double")).alias("p")).first().p
    model = LabelModel(*moments(rows, len(found), insults), min(max(share or 0.05, 0.001), 0.5))
    # the classifier's rows: half where some term occurs, half at large, by a hash of the id
    train = rows.where(F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    some = train.where(F.size("hits") > 0).orderBy(*order).limit(fitted // 2).union(train.where(F.size("hits") == 0).orderBy(*order).limit(fitted // 2)).select("hits", "marks").collect()
    hits, marks = [r.hits for r in some], [r.marks for r in some]
    size = len(place)
    # with next to no rows to learn from, any term at all speaks for the label
    weights = np.concatenate((np.zeros(size + len(PATTERNS) + 1), [-2 * model.prior, model.prior]))
    if some:
        weights = fit(Design(hits, marks, size), model.posterior(voters(hits, marks, len(found), insults)), weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = Design(batch.column(1).to_pylist(), batch.column(2).to_pylist(), size).chances(weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value, pa.float64()), *batch.columns[3:]], names=schema.names)

    schema = T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType()), *rows.schema.fields[3:]])
    scored = rows.mapInArrow(run, schema)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *scored.columns[2:])
