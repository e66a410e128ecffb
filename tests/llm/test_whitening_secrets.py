"""Whitening against exact sums and a dense eigensolver; secrets against plain scans with each expression."""

import hashlib
import re

import numpy as np
import pytest

import __spark_entry__ as entry
from attesta.llm import secrets, whitening

SF = "/root/testdata/sf0.01"


def exact_whitening(vectors, keep=16):
    x = [tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    values, turned = np.linalg.eigh(centred.T @ centred / n)
    values, turned = values[::-1], turned[:, ::-1]
    out = []
    for v in x:
        z = np.array([(n * c - s) / n for c, s in zip(v, sums)]) @ turned
        out.append((sum((n * c - s) ** 2 for c, s in zip(v, sums)), z[:keep], values[:keep], values.sum()))
    return n, out


def held_against(rows, ids, vectors, keep=16):
    n, want = exact_whitening(vectors, keep)
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, {})[r.component] = r
    signs = {}
    assert set(by) == set(ids)
    for i, (deviation, z, values, total) in zip(ids, want):
        assert sorted(by[i]) == list(range(1, min(keep, len(vectors[0])) + 1))
        for c, r in by[i].items():
            assert (r.n, r.deviation) == (n, deviation)
            assert r.explained == pytest.approx(values[c - 1] / total, rel=1e-9, abs=1e-14)
            assert r.identity_error <= 1e-9
            if values[c - 1] > 1e-9 * total:
                w = z[c - 1] / np.sqrt(values[c - 1])
                if abs(w) > 1e-3:
                    assert signs.setdefault(c, np.sign(w * r.whitened)) == np.sign(w * r.whitened)
                assert abs(abs(w) - abs(r.whitened)) < 1e-7
            else:
                assert r.whitened is None and r.explained == 0.0


def test_whitening_of_the_table(spark):
    rows = entry.queries()["op11_whitening"](spark, SF).collect()
    given = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    held_against(rows, [r.vec_id for r in given], [r.embedding for r in given])


def test_whitening_keeps_small_variances(spark):
    """Scales from 1 to a ten-millionth: a Gram matrix alone would lose the small ones."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6)) * np.array([3e7, 1e6, 2e4, 300.0, 20.0, 3.0]) / 64 @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    whole = np.floor(x * 64)
    centred = whole - whole.mean(0)
    sigma = np.linalg.svd(centred)[1]
    got = {r.component: r for r in whitening.whiten(df).where("vec_id = 0").collect()}
    assert [got[c].explained for c in range(1, 7)] == pytest.approx((sigma ** 2 / (sigma ** 2).sum()).tolist(), rel=1e-6)
    assert got[1].identity_error <= 1e-6


def test_whitening_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 5.0], 7), (2, [3.0, 1.0, 5.0], 7), (2, [3.0, 1.0, 5.0], 7), (None, [0.5, 0.25, 5.0], 7), (4, None, 7), (5, [1.0, None, 2.0], 7), (6, [nan, 1.0, 1.0], 7),
            (7, [inf, 0.0, 0.0], 7), (8, [], 7), (9, [1e30, 0.0, 0.0], 7), (10, [2.0, 7.0, 5.0], 7), (11, [1.0, -1.0], 7), (12, [2.0, -4.0], 7), (13, [2.0, 9.0], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x int").withColumnRenamed("x", "component")
    got = whitening.whiten(df).collect()
    three = [r for r in got if r.vec_id is None or r.vec_id in (1, 2, 10)]
    assert len(three) == 5 * 3 and len(got) == 5 * 3 + 3 * 2 and all(r.n == (3 if r.vec_id in (11, 12, 13) else 4) for r in got)
    held_against([r for r in got if r.vec_id in (11, 12, 13)], [11, 12, 13], [r[1] for r in rows[-3:]])
    # the third dimension is constant, so the third component has no variance
    assert all((r.whitened is None and r.explained == 0) if r.component == 3 else r.whitened is not None for r in three)
    assert whitening.whiten(df.where("vec_id = 99")).count() == 0
    alone = whitening.whiten(df.where("vec_id = 1")).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(1, 0, None, 0.0, 0.0)] * 3


def test_deviations_are_exact():
    big = np.array([[3_000_000_000, 5], [0, 0]], np.int64)
    assert whitening.deviations(big, 1, np.array([0, 0])).to_pylist() == [9_000_000_000_000_000_025, 0]
    assert whitening.deviations(big * 2, 1, np.array([0, 0])).to_pylist() == [None, 0]


def plain_spans(text, rules=secrets.RULES):
    found = []
    for k, r in enumerate(rules):
        for m in re.finditer(r.pattern, text, re.ASCII | (re.IGNORECASE if r.any_case else 0)):
            if len(m.group(r.group)) >= r.least:
                found.append((m.start(), k, m.end()))
    return [f"{rules[k].kind}:{a}:{b}" for a, k, b in sorted(found)]


def test_secrets_of_the_table(spark):
    rows = entry.queries()["op13_secrets"](spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts) and sum(r.n_assign + r.n_access + r.n_hex for r in rows) > 0
    for r in rows:
        want = plain_spans(texts[r.doc_id])
        base = [s for s in want if s.split(":")[0] in ("assign", "access", "hex")]
        assert r.spans == ",".join(want) and r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]


SECRETS = [
    'é\U0001f600 PassWord = "hunter2!" token:abc secret:token:abcdef', "api_key=abcdef APIKEY: 'a/b+c.d=e-f_' apikey=12345", "AKIA" + "Z" * 16 + " AKIA" + "Z" * 15 + " AKIAAKIA" + "9" * 12 + " akia" + "Z" * 16,
    "0" * 23 + " " + "0123456789abcdef" * 2 + "ABCDEF" + "f" * 24, "toKen=abcdefgh ſecret=abcdefgh", "ghp_" + "a" * 36 + " xoxb-1234567890-abc AIza" + "b" * 35, "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl",
    "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "pass", "pas", "", "token" * 50_000 + "=abcdef", "\x00secret=\x00", "password\n=\n'secret99'", "passwd = abcdef api-key=abcdef api_keyy=abcdef",
]


def test_secrets_of_awkward_texts(spark, awkward, nothing):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(SECRETS)], "doc_id int, text string, hits string").repartition(2)
    got = {r.doc_id: r for r in secrets.find_secrets(df).collect()}
    for i, t in enumerate(SECRETS):
        assert [f"{h.kind}:{h.start}:{h.end}" for h in got[i].hits] == plain_spans(t), t[:80]
        assert all(h.value in t for h in got[i].hits)
    assert [h.value for h in got[0].hits] == ["hunter2"]
    odd = secrets.find_secrets(awkward).collect()
    assert len(odd) == awkward.count() and {r.doc_id for r in odd if r.hits} == {11}  # "ab" forty times over is a run of hex digits
    assert secrets.find_secrets(nothing).count() == 0


def test_trigram_queries_are_necessary():
    """No match may be missed by its query; rules without mandatory trigrams have none."""
    q = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert q["hex"] is None and q["access"] == ("and", (b"aki", b"kia")) and secrets.trigram_query("a?b|c+") is None
    assert secrets.trigram_query("(abc|xyz)+q") == ("or", (b"abc", b"xyz"))
    assert secrets.trigram_query("ab[cd]e") == ("or", (("and", (b"abc", b"bce")), ("and", (b"abd", b"bde"))))
    assert secrets.trigram_query("(ab){2}c.*hello") == ("and", (("and", (b"aba", b"abc", b"bab")), ("and", (b"ell", b"hel", b"llo"))))
    index = secrets.Index(secrets.RULES)

    def holds(query, text):
        if query is None:
            return True
        return query in text if isinstance(query, bytes) else (all if query[0] == "and" else any)(holds(p, text) for p in query[1])

    for t in SECRETS:
        for rule, pattern, query in index.rules:
            assert holds(query, t.lower().encode()) or not pattern.search(t)
    # postings are those of a plain search, whatever shares a slot of the lookup table
    texts = [t.encode() for t in SECRETS]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    for gram, found in zip(index.grams, index.postings(data, ends)):
        plain = {i for i, t in enumerate(texts) if gram in bytes(index.fold[np.frombuffer(t, np.uint8)])}
        assert plain <= set(found.tolist()) and list(found) == sorted(set(found))
