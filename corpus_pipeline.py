"""Training-data pipeline: each stage applies one operator to all documents that the stage before has kept.

A stage's input is a written table, so what earlier stages have left in the shared folder is removed when the next one starts: write a
stage's result before the next stage is called.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from attesta.llm import bpe, mixing, repeats, simhash, toxicity
from attesta.llm.common import new_path, tidy, written
from attesta.llm.queries import digests

#: SQL can't express the classifier, the hashes of shingles or the byte-pair merges.
ORACLE_SQL = None


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` hasn't got."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def matches(docs: DataFrame, chosen: DataFrame, how: str, name: str) -> DataFrame:
    """``docs`` joined with a written table (doc_id, digest, ...) of texts: by id, missing ids included, and xxhash64 of the text (null as empty)."""
    id_, digest = unused(docs, "_id"), unused(docs, "_digest")
    chosen = written(chosen.withColumnsRenamed({"doc_id": id_, "digest": digest}), name)
    return docs.join(chosen, docs["doc_id"].eqNullSafe(chosen[id_]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == chosen[digest]), how)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: rejected rows go, all others stay.  Learns from the labels of rows that aren't held out.

    A row is judged by its own text: a rejected row goes with or without an id, and a clean one stays though it shares its id with a rejected one.
    """
    tidy(spark)
    others = [c for c in docs.columns if c != "text"]
    scored = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=others)
    return scored.where("predicted = 0").select(*(F.col("text" if c == "text" else f"rest.`{c}`").alias(c) for c in docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup over five-word shingles, similarity 0.8: of each group the text with the smallest id stays, once.

    Rows without an id come after all others; of rows equal in id and text one stays.
    """
    tidy(spark)
    found = simhash.similar_texts(docs, shingle=5, similarity=0.8)
    texts = written(found.groupBy("doc_id", "digest").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n")).where("NOT first OR n > 1"), "not-first-or-repeated")
    again = texts.where("first").select("doc_id", "digest")
    digest = unused(docs, "_digest")
    repeated = matches(docs, again, "inner", "repeated").select(*docs.columns, digest).dropDuplicates(["doc_id", digest]).drop(digest)
    return matches(docs, texts.select("doc_id", "digest"), "left_anti", "left-out").union(repeated)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages: what earlier documents have already said goes; a text of which nothing is left goes with it.

    Where a span ends inside a character, what is left of that character goes too.  ``n_chars`` follows the text.
    """
    tidy(spark)
    others = [c for c in docs.columns if c != "text"]
    cut = repeats.remove_repeats(docs, carry=[*others, "text"]).where((F.octet_length("kept") > 0) | (F.size("spans") == 0))
    changed = F.size("spans") > 0
    text = F.when(changed, repeats.whole_characters("kept")).otherwise(F.col("rest.text"))
    cut = cut.select(changed.alias("_changed"), text.alias("_left"), "rest")
    columns = {"text": F.col("_left"), "n_chars": F.when(F.col("_changed"), F.char_length("_left").cast("long")).otherwise(F.col("rest.n_chars"))}
    return cut.select(*(columns.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document stays, in the order of the schedule's slots; what a dry source leaves free goes to the others."""
    tidy(spark)
    source, id_, slot = (unused(docs, c) for c in ("_source", "_id", "_slot"))
    slots = mixing.schedule_all(docs).select(F.col("source").alias(source), F.col("id").alias(id_), F.col("slot").alias(slot))
    placed = docs.join(written(slots, "slots"), F.col("source").eqNullSafe(F.col(source)) & F.col("doc_id").eqNullSafe(F.col(id_)))
    return placed.orderBy(slot, id_).select(docs.columns)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ids of every text, decoded again."""
    tidy(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digests(bpe.round_trip(docs, path, public_tokenizers.PATTERN))


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", one_of_each_group),
    ("suffix_array_dedup", without_repeats),
    ("mixing", mix_sources),
    ("byte_bpe", encode_bytes),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
