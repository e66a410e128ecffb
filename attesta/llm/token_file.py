"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Documents are dealt to shards by ranges of their id and encoded in ascending order; ids are replaced by their rank of
descending frequency over the whole corpus (ties: smaller id first), so frequent ids take one byte.  Four 2-bit length codes share a
control byte; control bytes and data bytes are stored apart, and a reader turns them back with numpy table lookup.

A file (``shard-<n>.tok``, little-endian): magic, documents (u32), tokens before the first (u64), tokens (u64), data bytes (u64); ids
of the documents (i64), whether each id is null (u8), tokens of each (u32); control bytes; data bytes.  ``ranks.bin`` beside them
holds the id of each rank (u32).  Every file is written under a temporary name and moved into place, so a task that runs
again after a lost executor only replaces it by the same bytes.

Null texts are encoded as empty, documents without an id come first, repeated ids stay together in one shard, an empty table
gives no file.  Only the two named columns are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from attesta.llm.common import new_path, remove, slices, worker_state, written
from attesta.llm.pretokens import Slab, ragged, slabs
from attesta.llm.token_counts import library

MAGIC = b"TOKSVB1\n"
HEAD = "<8sIQQQ"
#: Text of a shard, so that a file is one row of bounded size for whoever reads it.
SHARD_BYTES = 8 << 20
CACHE_WORDS = 250_000
#: A text with this goes to the library whole: it may hold special strings.
MARKS = ("<|",)


class LibraryWords:
    """Ids of pre-tokens by the library, kept per worker up to a number of words."""

    def __init__(self, path: str):
        self.tokenizer, self.held = library(path), {}

    def table(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        held = self.held
        missing = [w for w in words if w not in held]
        if missing and len(held) > CACHE_WORDS:
            held.clear()
            missing = words
        for a in range(0, len(missing), 512):  # white space parts words and is dropped
            part = missing[a:a + 512]
            coded = self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False)
            ids, counts = np.array(coded.ids, np.uint32), np.bincount(np.array(coded.word_ids, np.int64))
            if len(counts) != len(part):
                raise ValueError("a pre-token was split")
            packed, ends = ids.tobytes(), (np.cumsum(counts) * 4).tolist()
            held.update((w, packed[x:y]) for w, x, y in zip(part, [0, *ends], ends, strict=False))
        coded = [held[w] for w in words]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded)) >> 2
        return np.frombuffer(b"".join(coded), np.uint32), np.cumsum(lengths) - lengths, lengths


def encode_texts(texts: list[str], path: str, end_id: int | None) -> list[np.ndarray]:
    """Ids of each text, with the end id."""
    words = worker_state(f"library_words_{path}", lambda: LibraryWords(path))
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for part in slabs(texts, "word", MARKS):
        if isinstance(part, Slab):
            flat, starts, lengths = words.table(part.words)
            n = lengths[part.index]
            ids = ragged(flat, starts[part.index], n)
            ends = np.concatenate(([0], np.cumsum(n)))[part.bounds]
            for k, row in enumerate(part.rows):
                out[row].append(ids[ends[k]:ends[k + 1]])
        else:
            out[part[0]] = [np.array(words.tokenizer.encode(part[1], add_special_tokens=False).ids, np.uint32)]
    end = [] if end_id is None else [np.array([end_id], np.uint32)]
    return [np.concatenate(x + end) if x or end else np.empty(0, np.uint32) for x in out]


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    ranks = ranks.astype("<u4")
    size = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= size[:, None]]
    codes = np.zeros(-(-len(size) // 4) * 4, np.uint8)
    codes[:len(size)] = size
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return control.tobytes(), data.tobytes()


#: Bytes of each of the four values, by control byte.
def length_table() -> np.ndarray:
    c = np.arange(256)
    return np.stack([(c >> s & 3) + 1 for s in (0, 2, 4, 6)], 1).astype(np.uint8)


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values, by table lookup: lengths from the control bytes, then a mask over four bytes at each offset."""
    lengths = length_table()[np.frombuffer(control, np.uint8)].ravel()[:n].astype(np.int64)
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    offsets = np.cumsum(lengths) - lengths
    words = np.lib.stride_tricks.as_strided(padded, (max(0, len(padded) - 3), 4), (1, 1))
    values = words[offsets].reshape(-1).view("<u4") if n else np.empty(0, np.uint32)
    return values & np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)[lengths]


def _put(folder: str, name: str, data: bytes) -> None:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    aside = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(aside) as out:
        out.write(data)
    store.move(aside, f"{path}/{name}")


def _get(folder: str, name: str) -> bytes:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{path}/{name}") as f:
        return f.read()


def _make(spark: SparkSession, folder: str) -> str:
    """The folder, made, as a URI."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(target)
    uri = store.makeQualified(target).toString()
    return f"file://{uri.removeprefix('file:')}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


def shard_bounds(df: DataFrame, id_col: str, text_col: str, shard_bytes: int) -> list[int]:
    """First ids of the shards after the first, from quantiles of the ids over all rows."""
    total = df.agg(F.sum(F.octet_length(text_col)).alias("b"), F.count(id_col).alias("n")).first()
    shards = min(max(1, -(-(total.b or 0) // shard_bytes)), max(1, total.n))
    if shards == 1:
        return []
    marks = df.agg(F.percentile_approx(id_col, [i / shards for i in range(1, shards)], 10 * shards).alias("q")).first().q
    return sorted(set(marks))


def write_token_files(df: DataFrame, folder: str, path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every text with the tokenizer at ``path`` and write the files of this format into ``folder``."""
    spark = df.sparkSession
    folder = _make(spark, folder)
    raw = _make(spark, new_path(spark, "raw-ids"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = shard_bounds(rows, "id", "text", shard_bytes)
    shard = F.lit(0)
    if bounds:
        shard = F.coalesce(F.expr(f"aggregate(array({','.join(map(str, bounds))}), 0, (n, b) -> n + int(id >= b))") if len(bounds) < 16 else _bucket(bounds)(F.col("id")), F.lit(0))
    dealt = rows.withColumn("shard", shard.cast("int")).repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "id")

    def encode_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        docs, missing, sizes, parts, number = [], [], [], [], None
        counts = np.zeros(1 << 16, np.int64)
        packer = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            number = batch.column(2)[0].as_py()
            ids = encode_texts(batch.column(1).to_pylist(), path, end_id)
            flat = np.concatenate(ids)
            if len(flat) and int(flat.max()) >= len(counts):
                counts = np.concatenate((counts, np.zeros(int(flat.max()) + 1 - len(counts), np.int64)))
            counts += np.bincount(flat, minlength=len(counts))
            docs.append(batch.column(0).fill_null(0).to_numpy())
            missing.append(batch.column(0).is_null().to_numpy(zero_copy_only=False))
            sizes.append(np.array([len(x) for x in ids], np.uint32))
            parts.append(packer.compress((flat.astype(np.uint16) if len(counts) <= 1 << 16 else flat).tobytes()))
        if number is None:
            return
        import pickle

        _put(raw, f"{number}.raw", pickle.dumps((number, np.concatenate(docs), np.concatenate(missing), np.concatenate(sizes), parts, 2 if len(counts) <= 1 << 16 else 4)))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1 - number)), pa.array(np.append(counts[used], counts.sum()))], names=["token", "n"])

    stats = written(dealt.select("id", "text", "shard").mapInArrow(encode_shard, "token long, n long"), "token-stats")
    # the vocabulary bounds this collect, the number of shards the next
    order = [r.token for r in stats.where("token >= 0").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").collect()]
    before, offsets = 0, {}
    for number, n in sorted((-1 - r.token, r.n) for r in stats.where("token < 0").collect()):
        offsets[number], before = before, before + n
    ranks = np.array(order, np.uint32)
    _put(folder, "ranks.bin", ranks.tobytes())
    rank_of = np.zeros(int(ranks.max()) + 1 if len(ranks) else 1, np.uint32)
    rank_of[ranks] = np.arange(len(ranks), dtype=np.uint32)
    shared = spark.sparkContext.broadcast((rank_of, offsets))

    def recode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        import zstandard

        ranked, starts = shared.value
        for batch in batches:
            for content in batch.column(0):
                number, docs, missing, sizes, parts, width = pickle.loads(content.as_py())
                unpacker = zstandard.ZstdDecompressor()
                control, data = pack(np.concatenate([ranked[np.frombuffer(unpacker.decompress(p), np.uint16 if width == 2 else np.uint32)] for p in parts]))
                head = struct.pack(HEAD, MAGIC, len(docs), starts[number], int(sizes.sum(dtype=np.int64)), len(data))
                _put(folder, f"shard-{number:08d}.tok", b"".join((head, docs.astype("<i8").tobytes(), missing.astype(np.uint8).tobytes(), sizes.astype("<u4").tobytes(), control, data)))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32())], names=["shard"])

    if offsets:
        spark.read.format("binaryFile").option("pathGlobFilter", "*.raw").load(raw).select("content").mapInArrow(recode, "shard int").write.format("noop").mode("overwrite").save()
    remove(spark, raw)


def _bucket(bounds: list[int]):
    """Number of bounds at or below an id."""
    marks = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def bucket(ids):
        return ids.map(lambda x: 0 if x != x else int(np.searchsorted(marks, x, "right"))).astype("int32")

    return bucket


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the files; ids are packed unsigned 32-bit integers."""
    folder = _make(spark, folder)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = np.frombuffer(_get(folder, "ranks.bin"), np.uint32)
        for batch in batches:
            for content in batch.column(0):
                docs, starts, sizes, ids = read_shard(content.as_py(), ranks)
                packed, ends = ids.tobytes(), np.cumsum(sizes) * 4
                for a in range(0, len(sizes), 4096):
                    b = min(a + 4096, len(sizes))
                    yield pa.RecordBatch.from_arrays([
                        docs.slice(a, b - a), pa.array(starts[a:b]), pa.array(sizes[a:b]),
                        pa.array([packed[y - 4 * n:y] for y, n in zip(ends[a:b].tolist(), sizes[a:b].tolist(), strict=True)], pa.binary()),
                    ], names=["doc_id", "start", "n_tokens", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder)
    return files.select("content").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def read_shard(content: bytes, ranks: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the documents, where each starts, its tokens, and all ids of one file."""
    magic, n, start, tokens, data_bytes = struct.unpack_from(HEAD, content)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = struct.calcsize(HEAD)
    docs = np.frombuffer(content, "<i8", n, at)
    missing = np.frombuffer(content, np.uint8, n, at + 8 * n).astype(bool)
    sizes = np.frombuffer(content, "<u4", n, at + 9 * n).astype(np.int64)
    at += 13 * n
    data_at = at + -(-tokens // 4)
    values = unpack(content[at:data_at], content[data_at:data_at + data_bytes], tokens)
    return pa.array(docs, mask=missing), start + np.cumsum(sizes) - sizes, sizes, ranks[values]


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of documents read from the files."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32_of(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
