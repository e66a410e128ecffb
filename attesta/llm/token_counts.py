"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of frequent pre-tokens with their token counts, gathered from per-task counts and broadcast;
it has at most ``table_words`` entries of at most ``WORD_BYTES`` bytes, whatever the corpus.  Tier two is a cache
in each Python worker: a pre-token that the table lacks is encoded once by the library and kept.  No pre-token is ever shuffled.
Texts the fast splitter doesn't cover (rare code points, special strings) are encoded whole by the library.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attesta.llm.common import slices, worker_state
from attesta.llm.pretokens import Slab, slabs

#: Frequent words in the broadcast table, and bytes of a word in it: at most 2 MB.
TABLE_WORDS, WORD_BYTES = 32_768, 60
#: Words that a task counts at once to find the frequent ones: beyond that the rarest half of them is forgotten.
COUNTED_WORDS = 8 * TABLE_WORDS
CACHE_WORDS = 500_000


def library(path: str):
    from tokenizers import Tokenizer

    return worker_state(f"tokenizer_{path}", lambda: Tokenizer.from_file(path))


def special_strings(path: str) -> tuple[str, ...]:
    import json

    with open(path, encoding="utf-8") as f:
        return tuple(x["content"] for x in json.load(f)["added_tokens"])


def word_lengths(words: list[bytes], tokenizer) -> list[int]:
    """Tokens of each pre-token.  Words with a leading blank are encoded many at a time; each is a pre-token of its own."""
    out = [0] * len(words)
    texts = [w.decode() for w in words]
    joined = [i for i, t in enumerate(texts) if len(t) > 1 and t[0] == " " and t[1:].isalpha()]
    for a in range(0, len(joined), 512):
        part = joined[a:a + 512]
        counts = np.bincount(np.array(tokenizer.encode("".join(texts[i] for i in part), add_special_tokens=False).word_ids, np.int64))
        if len(counts) == len(part):
            for i, n in zip(part, counts.tolist(), strict=True):
                out[i] = n
    alone = [i for i, n in enumerate(out) if n == 0]
    for a in range(0, len(alone), 512):
        part = alone[a:a + 512]
        for i, e in zip(part, tokenizer.encode_batch([texts[i] for i in part], add_special_tokens=False), strict=True):
            out[i] = len(e.ids)
    return out


def frequent_words(df: DataFrame, text_col: str = "text", table_words: int = TABLE_WORDS) -> list[bytes]:
    """The most frequent pre-tokens of all rows: each task keeps a bounded summary of its own and sends the most frequent of them.

    A word that a summary forgets may miss the table, which costs time and changes no count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in slices(batches, 0):
            for part in slabs([x or "" for x in batch.column(0).to_pylist()], "gpt"):
                if isinstance(part, Slab):
                    n = np.bincount(part.index, minlength=len(part.words)).tolist()
                    for w, c in zip(part.words, n, strict=True):
                        if len(w) <= WORD_BYTES:
                            total[w] += c
            if len(total) > COUNTED_WORDS:
                total = Counter(dict(total.most_common(COUNTED_WORDS // 2)))
        best = total.most_common(table_words)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.binary()), pa.array([c for _, c in best], pa.int64())], names=["word", "n"])

    counted = df.select(text_col).where(F.col(text_col).isNotNull()).mapInArrow(run, "word binary, n long")
    best = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(table_words)
    return [bytes(r.word) for r in best.collect()]


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, table_words: int = TABLE_WORDS) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each whole text, as the tokenizers library counts.

    Null texts count as empty (0 bytes, 0 tokens), null ids stay null, repeated rows stay, an empty table gives none.
    Only the two named columns are read, so extra columns can't clash.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    words = frequent_words(df, text_col, table_words)
    counts = word_lengths(words, library(path)) if words else []
    packed = spark.sparkContext.broadcast((b"".join(words), np.array([len(w) for w in words], np.uint8).tobytes(), np.array(counts, np.uint8).tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, marks = library(path), worker_state(f"special_{path}", lambda: special_strings(path))
        data, sizes, numbers = packed.value
        ends = np.cumsum(np.frombuffer(sizes, np.uint8).astype(np.int64)).tolist()
        frequent = {data[a:b]: n for a, b, n in zip([0, *ends], ends, numbers, strict=False)}
        cache: dict[bytes, int] = worker_state(f"counts_{path}", dict)
        for batch in slices(batches):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            out = np.zeros(len(texts), np.int64)
            for part in slabs(texts, "gpt", marks):
                if not isinstance(part, Slab):
                    out[part[0]] = len(tokenizer.encode(part[1], add_special_tokens=False).ids)
                    continue
                get = frequent.get
                n = [get(w) or cache.get(w, 0) for w in part.words]
                missing = [i for i, x in enumerate(n) if x == 0]
                if missing:
                    if len(cache) > CACHE_WORDS:
                        cache.clear()
                    for i, x in zip(missing, word_lengths([part.words[i] for i in missing], tokenizer), strict=True):
                        n[i] = cache[part.words[i]] = x
                sums = np.concatenate(([0], np.cumsum(np.array(n, np.int64)[part.index])))[part.bounds]
                np.add.at(out, np.array(part.rows), np.diff(sums))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out), pa.array(out > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(id_col, text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
