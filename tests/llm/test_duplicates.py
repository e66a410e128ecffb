"""Near-duplicate operators, repeated passages and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from attesta.llm import caps, common, repeats, runindex, simhash
from attesta.llm.components import components
from conftest_brute import linked_components


def test_components(spark):
    rng = random.Random(2)
    for n, m in ((60, 40), (60, 90), (200, 199)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if m != 199 else [(i, i + 1) for i in range(199)]
        got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        want = linked_components({x for p in pairs if p[0] != p[1] for x in p}, pairs)
        assert got == want
    star = [(0, i) for i in range(1, 300)]
    assert {r.component for r in components(spark.createDataFrame(star, "a long, b long")).collect()} == {0}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def naive_fingerprint(text, shingle=3):
    import re

    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    parts = [b" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_on_awkward_rows(awkward, nothing):
    rows = simhash.near_duplicates(awkward).select("doc_id", simhash.hex_of(F.col("fp")).alias("f"), "component_id").collect()
    texts = [(r.doc_id, r.text) for r in awkward.collect()]
    assert sorted((r.doc_id or 0, r.f) for r in rows) == sorted((i or 0, f"{naive_fingerprint(t):016x}") for i, t in texts)
    named = {i: naive_fingerprint(t) for i, t in texts if i is not None}
    want = linked_components(named, [(a, b) for a in named for b in named if (named[a] ^ named[b]).bit_count() <= 3])
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == want
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("block", [8, 1024])
def test_near_links_miss_nothing(spark, block):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(40)]
    points = set(base)
    for b in base[:20]:
        for _ in range(12):
            points.add(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 4))))
    points = sorted(points)
    frame = spark.createDataFrame([(i, simhash.signed(p)) for i, p in enumerate(points)], "id long, fp long")
    got = components(simhash.near_links(frame, 3, block))
    want = linked_components(range(len(points)), [(i, j) for i in range(len(points)) for j in range(i) if (points[i] ^ points[j]).bit_count() <= 3])
    assert {r.node: r.component for r in got.collect()} == {k: v for k, v in want.items() if list(want.values()).count(v) > 1}


def test_plan_keys_cover_every_pattern_of_differences():
    rng = random.Random(4)
    for n in (10, 300_000, 50_000_000):
        p = np.full(64, 0.5)
        p[:8] = 0.9
        both = np.outer(p, p) * n
        np.fill_diagonal(both, p * n)
        masks = simhash.plan_keys(n, both, 3)
        for _ in range(300):
            gap = sum(1 << k for k in rng.sample(range(64), 3))
            assert any(gap & m == 0 for m in masks)


def test_similar_texts(spark, awkward, nothing):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts, group = [], []
    for g in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([60, 200, 600]))]
        for share in (0, 0, 0.01, 0.015, 0.3):
            texts.append(" ".join(rng.choice(vocabulary) if rng.random() < share else w for w in words))
            group.append(g)
    sets = [{" ".join(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    for block in (3, 1024):
        got = {r.doc_id: r.component_id for r in simhash.similar_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=block).collect()}
        near = [(i, j) for i in got for j in range(i) if group[i] == group[j] and alike(i, j) >= 0.87]
        assert len(near) > 100 and sum(got[i] == got[j] for i, j in near) >= 0.97 * len(near)
        assert all(group[got[i]] == group[i] for i in got)  # no link between strangers
        far = [i for i in got if i % 5 == 4 and all(alike(i, j) < 0.7 for j in got if j != i)]
        assert far and all(got[i] == i for i in far)
    rows = simhash.similar_texts(awkward).collect()
    assert len(rows) == awkward.count() and {r.doc_id: r.component_id for r in rows}[2] == 1
    assert simhash.similar_texts(nothing).count() == 0


def near_pairs(first, shares, n):
    """Texts 2 i and 2 i + 1 whose shingle sets share one of ``shares`` of 250 shingles."""
    texts = []
    for i in range(first, first + n):
        inter = shares[i % len(shares)]
        common = [f"c{i}_{k}" for k in range(inter + 4)]
        texts += [" ".join(common + [f"{x}{i}_{k}" for k in range((250 - inter) // 2)]) for x in "ab"]
    return texts


def test_similar_texts_decide_by_the_exact_similarity(spark):
    texts = near_pairs(0, (200,), 300) + near_pairs(300, (204, 212), 100) + near_pairs(400, (196, 198), 300)
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    linked = [got[i] == got[i + 1] for i in range(0, len(texts), 2)]
    assert sum(linked[:300]) >= 0.98 * 300 and sum(linked[300:400]) >= 99  # at 0.8, and somewhat above
    assert not any(linked[400:])  # somewhat below


@pytest.mark.parametrize("n", [1_000, 500_000, 20_000_000, 1_000_000_000])
def test_wide_keys_recall_at_any_size(n):
    rng = np.random.default_rng(3)
    keys = simhash.wide_keys(n, 0.8)
    own = 30  # sets of 270 with a similarity of 0.8
    apart = np.zeros((2000, simhash.WIDE), bool)
    for bit in range(simhash.WIDE):
        c = rng.binomial(240, 0.5, 2000)
        apart[:, bit] = (2 * (c + rng.binomial(own, 0.5, 2000)) > 270) != (2 * (c + rng.binomial(own, 0.5, 2000)) > 270)
    assert (~apart[:, keys].any(2)).any(1).mean() >= 0.985


def brute_vectors(rows):
    ok = {i: (np.array(v, float), l) for i, v, l in rows if i is not None and v and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = []
    for i, (a, l) in ok.items():
        for j, (b, m) in ok.items():
            if i < j and l == m and len(a) == len(b) and (a @ b) / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                links.append((i, j))
    return links


def test_caps(spark):
    rng = np.random.default_rng(6)
    rows = []
    for c in range(60):
        centre = rng.normal(size=16)
        for _ in range(8):
            rows.append((len(rows), [float(np.float32(x)) for x in centre + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.12, 0.3])], c % 4))
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, [None] * 16, 1), (n + 5, rows[0][1], None), (n + 6, [float("inf")] * 16, 1),
             (n + 7, [1.0, 2.0], 1), (n + 8, [2.0, 4.0], 1), (n + 9, [-0.0, 1.0], 2), (n + 10, [0.0, 1.0], 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    links = brute_vectors(rows)
    for block in (4, 1024):
        got = {r.vec_id: r for r in caps.near_vectors(frame, block=block).collect()}
        assert len(got) == len(rows)
        degree = {i: sum(i in p for p in links) for i, _, _ in rows}
        assert all(got[i].n_links <= degree[i] for i in got)
        assert sum(r.n_links for r in got.values()) >= 0.97 * sum(degree.values())
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
        alone = [i for i in degree if not degree[i]]
        assert all(got[i].component_id == i for i in alone)
    empty = caps.near_vectors(frame.where("vec_id < 0"))
    assert empty.count() == 0 and empty.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert caps.near_vectors(frame.where(f"vec_id in ({n}, {n + 2})")).count() == 2


def test_caps_recall_on_the_table(spark):
    folder = "/root/testdata/sf0.1"
    frame = spark.read.parquet(f"{folder}/embeddings.parquet")
    e = frame.toPandas()
    x = np.array(e.embedding.tolist(), float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    label = e.label.to_numpy()
    want = np.array([((x @ x[i] >= 0.98) & (label == label[i])).sum() - 1 for i in range(len(x))])
    got = {r.vec_id: r.n_links for r in caps.near_vectors(frame).collect()}
    found = np.array([got[i] for i in e.vec_id])
    assert (found <= want).all() and found.sum() >= 0.97 * want.sum()


def planted(rng, n, dims, cosine=0.98):
    a, w = rng.normal(size=(n, dims)), rng.normal(size=(n, dims))
    a /= np.sqrt((a * a).sum(1))[:, None]
    w -= (w * a).sum(1)[:, None] * a
    w /= np.sqrt((w * w).sum(1))[:, None]
    return a, cosine * a + np.sqrt(1 - cosine * cosine) * w


@pytest.mark.parametrize("n", [10, 200, 7_000, 100_000, 10_000_000])
def test_caps_recall_at_any_size(n):
    side = max(8, int(np.ceil(np.sqrt(n * caps.PER_VECTOR / caps.PER_FILTER))))
    code, found = caps.Code(64, side, caps.PER_VECTOR), []
    for unit in planted(np.random.default_rng(8), 400, 64):
        row, filters = code.filters(unit)
        assert (np.diff(row) >= 0).all() and np.bincount(row, minlength=400).min() >= 8
        assert np.bincount(row).mean() < 3 * caps.PER_VECTOR
        found.append([set(x) for x in np.split(filters, np.searchsorted(row, np.arange(1, 400)))])
    assert np.mean([bool(x & y) for x, y in zip(*found)]) >= 0.97


def test_caps_recall_with_a_large_label(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(9)
    a, b = planted(rng, 1_000, 64, 0.9801)
    vecs = np.concatenate((a, b, rng.normal(size=(100_000, 64)))).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(len(vecs)), "embedding": pa.array(list(vecs), pa.list_(pa.float32())), "label": np.ones(len(vecs), np.int32)}), tmp_path / "v.parquet")
    found = caps.near_vectors(spark.read.parquet(str(tmp_path / "v.parquet")).repartition(16)).where("n_links > 0").collect()
    assert all(r.n_links == 1 and r.component_id == r.vec_id % 1000 for r in found)
    assert len(found) >= 0.97 * 2_000


def brute_repeats(rows, width):
    first = {}
    for i, t in rows:
        for k in range(len(t) - width + 1) if i is not None else ():
            first[t[k:k + width]] = min(first.get(t[k:k + width], i), i)
    out = []
    for i, t in rows:
        mark = bytearray(len(t))
        for k in range(len(t) - width + 1) if i is not None else ():
            if first[t[k:k + width]] < i:
                mark[k:k + width] = b"\1" * width
        out.append((i if i is not None else -1, len(t), bytes(c for c, m in zip(t, mark) if not m)))
    return sorted(out)


def test_run_index_matches():
    rng = random.Random(3)
    for _ in range(8):
        strings = list({bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 20))) for _ in range(25)})
        index = runindex.RunIndex(strings, 20)
        suffixes = [strings[index.owner[p]][p - index.starts[index.owner[p]]:] for p in index.rows]
        assert suffixes == sorted(suffixes)
        probes = [bytes(rng.choice(b"abc\0") for _ in range(rng.randint(1, 30))) for _ in range(30)] + strings
        rows, lengths, bounds = index.matches(probes)
        for k, p in enumerate(probes):
            for i in range(len(p)):
                n = int(lengths[bounds[k] + i])
                assert n == max(n for n in range(len(p) - i + 1) if any(p[i:i + n] in s for s in strings))
                assert suffixes[rows[bounds[k] + i]][:n] == p[i:i + n]
        for width in (7, 8, 9, 13, 15):
            classes = index.same_prefix(width)
            assert [c < 0 for c in classes] == [len(s) < width for s in suffixes]
            assert all((classes[i] == classes[i - 1]) == (suffixes[i][:width] == suffixes[i - 1][:width]) for i in range(1, len(suffixes)) if min(len(suffixes[i]), len(suffixes[i - 1])) >= width)


@pytest.mark.parametrize("small", [False, True])
def test_repeats_on_awkward_rows(awkward, nothing, monkeypatch, small):
    if small:  # every bound within reach
        for name, value in (("SLAB", 20_000), ("PIECE", 700), ("INDEX", 2_000), ("COMMON", 2), ("COMMON_PART", 0)):
            monkeypatch.setattr(repeats, name, value)
    rows = awkward.where("doc_id IS NULL OR doc_id <> 8")
    got = repeats.remove_repeats(rows, carry=["source", "spans"]).collect()
    want = brute_repeats([(r.doc_id, (r.text or "").encode()) for r in rows.collect()], 50)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, bytes(r.kept)) for r in got) == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_bytes - len(r.kept) for r in got)
    assert repeats.remove_repeats(nothing).count() == 0


def test_repeats_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = repeats.remove_repeats(docs).collect()
    want = brute_repeats([(r.doc_id, r.text.encode()) for r in docs.collect()], 50)
    assert sorted((r.doc_id, r.n_bytes, bytes(r.kept)) for r in got) == want


def test_block_pairs_meet_once(spark):
    rows = spark.range(50).select((F.col("id") % 2).alias("g"), "id")
    laid = common.block_pairs(rows, ["g"], F.col("id"), 7)
    pairs = {}
    for r in laid.groupBy("g", "b1", "b2").agg(F.collect_list(F.struct("id", "block")).alias("m")).collect():
        for x in r.m:
            for y in r.m:
                if x.id < y.id and (r.b1 == r.b2 or x.block != y.block):
                    pairs[x.id, y.id] = pairs.get((x.id, y.id), 0) + 1
    assert pairs == {(a, b): 1 for a in range(50) for b in range(a + 1, 50) if a % 2 == b % 2}


@pytest.mark.parametrize("block", [4, 50])
def test_group_components_lose_no_link(spark, block):
    """Points on a line, linked when close: the components are those of all pairs of a group, whatever the blocks."""
    rng = random.Random(block)
    rows = [(g, n, rng.choice([rng.randint(0, 400), 100, 101])) for g in range(6) for n in range(g * 1000, g * 1000 + (300 if g == 0 else 20))]
    df = spark.createDataFrame(rows, "g int, id long, x int").repartition(3)

    def close(table, bounds):
        left, right = [], []
        x = table.column("x").to_numpy()
        for s, e in zip(bounds[:-1], bounds[1:]):
            i, j = np.nonzero(np.abs(x[s:e, None] - x[None, s:e]) <= 1)
            left.append(s + i[i != j])
            right.append(s + j[i != j])
        return np.concatenate(left), np.concatenate(right)

    def make(p, known):
        if known is None:
            return df.withColumn("_node", df.id)
        return df.join(known, df.id == known.node, "left").selectExpr("g", "id", "x", "coalesce(component, id) AS _node")

    for passes in (1, 2):
        got = {r.node: r.component for r in simhash.group_components(make, passes, ["g"], close, block).collect()}
        pairs = [(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and abs(a[2] - b[2]) <= 1]
        want = linked_components([r[1] for r in rows], pairs)
        assert all(got.get(n, n) == c for n, c in want.items())
