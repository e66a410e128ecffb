"""Token operators against the libraries they follow."""

import base64
import hashlib
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attesta.llm import bpe, common, pretokens, token_counts, token_file

RANKS, COUNTED, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ALPHABET = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", "a", "B", "é", "1", "²", "!", "'s", "中", "“", "x", "́", "İ", "\x1c", "\x85", "\xa0"]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["a" * 3000, "ab" * 4000, "the " * 9000, "no end" * 900]


def test_known_code_points_read_alike_everywhere():
    counted, words = Tokenizer.from_file(COUNTED), Tokenizer.from_file(WORDS)
    for ranges, tokenizer, pattern in ((pretokens.GPT_RANGES, counted, P.PATTERN), (pretokens.WORD_RANGES, words, r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")):
        table = pretokens.class_table(ranges)
        for c in map(chr, np.flatnonzero(table != pretokens.UNKNOWN).tolist()):
            probe = f"a{c}1{c}!{c}!{c} {c}"
            assert [o for _, o in tokenizer.pre_tokenizer.pre_tokenize_str(probe)] == [m.span() for m in regex.finditer(pattern, probe)], hex(ord(c))
            if ranges is pretokens.WORD_RANGES:
                assert unicodedata.normalize("NFC", probe) == probe
                assert words.normalizer.normalize_str(f"a{c}b") == regex.sub(r"\s+", " ", f"a{c}b").lower()


def test_pieces_of_long_texts_keep_their_pre_tokens(monkeypatch, texts):
    monkeypatch.setattr(pretokens, "SLAB_CHARS", 64)
    long = [" ".join(texts[:200]), "the  cat's\n\nhat " * 50]
    got = [[] for _ in long]
    for part in pretokens.slabs(long, "gpt"):
        if isinstance(part, pretokens.Slab):
            for k, row in enumerate(part.rows):
                got[row] += [part.words[i].decode() for i in part.index[part.bounds[k]:part.bounds[k + 1]]]
        else:
            got[part[0]] = regex.findall(P.PATTERN, part[1])
    assert got == [regex.findall(P.PATTERN, t) for t in long]


def test_bpe_equals_library(library, texts):
    got = [np.frombuffer(x, np.uint32).tolist() for x in bpe.encode_texts(texts, RANKS, P.PATTERN)]
    assert got == [library.encode_ordinary(t) for t in texts]


def test_bpe_cache_starts_anew_without_loss(monkeypatch, library, texts):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    words = bpe.WordIds(RANKS)
    for a in range(0, 600, 100):
        for w in ([t.encode() for t in texts[a:a + 100] if t]):
            flat, starts, lengths = words.table([w, b"the"])
            assert library.decode_bytes(flat[starts[0]:starts[0] + lengths[0]].tolist()) == w


def test_bpe_on_awkward_rows(awkward, nothing, library):
    rows = bpe.round_trip(awkward, RANKS, P.PATTERN).collect()
    both = bpe.decode(bpe.encode(awkward, RANKS, P.PATTERN), RANKS).collect()
    assert sorted(map(str, rows)) == sorted(map(str, both)) and len(rows) == awkward.count()
    want = sorted((r.doc_id or 0, " ".join(map(str, library.encode_ordinary(r.text or ""))), (r.text or "").encode()) for r in awkward.collect())
    assert sorted((r.doc_id or 0, r.ids_text, bytes(r.decoded)) for r in rows) == want
    assert bpe.round_trip(nothing, RANKS, P.PATTERN).count() == 0


def test_token_counts_on_awkward_rows(awkward, nothing):
    tokenizer = Tokenizer.from_file(COUNTED)
    for table_words in (3, token_counts.TABLE_WORDS):
        rows = token_counts.count_tokens(awkward, COUNTED, table_words=table_words).collect()
        want = sorted((r.doc_id or 0, len((r.text or "").encode()), n := len(tokenizer.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in awkward.collect())
        assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want
    assert token_counts.count_tokens(nothing, COUNTED).count() == 0


def test_variable_length_code():
    values = np.concatenate((np.arange(600), np.array([1 << 16, (1 << 16) - 1, 1 << 24, (1 << 32) - 1, 0]))).astype(np.uint32)
    for n in range(0, len(values) + 1, 7):
        control, data = token_file.pack(values[:n])
        assert (token_file.unpack(control, data, n) == values[:n]).all() and len(control) == -(-n // 4)


def test_token_files(spark, awkward, nothing):
    tokenizer = Tokenizer.from_file(WORDS)
    for shard_bytes in (token_file.SHARD_BYTES, 20_000):
        folder = common.new_path(spark, "files")
        token_file.write_token_files(awkward, folder, WORDS, shard_bytes=shard_bytes)
        rows = token_file.checksums(token_file.read_token_files(spark, folder)).collect()
        at, want = 0, []
        ordered = sorted(awkward.collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id)
        for r in ordered:
            ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
            want.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows))) == sorted(map(str, want))
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
        assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == [r.doc_id for r in ordered]
    folder = common.new_path(spark, "files")
    token_file.write_token_files(nothing, folder, WORDS)
    assert token_file.read_token_files(spark, folder).count() == 0


def test_queries_against_libraries(spark, library):
    from attesta.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    counted, words = Tokenizer.from_file(COUNTED), Tokenizer.from_file(WORDS)
    for r in QUERIES["op9_token_counts"](spark, folder).collect():
        assert r.n_tokens == len(counted.encode(docs[r.doc_id], add_special_tokens=False).ids)
    rows = QUERIES["op10_bpe"](spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    at = 0
    for r in QUERIES["op2_token_file"](spark, folder).orderBy("doc_id").collect():
        ids = words.encode(docs[r.doc_id], add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
