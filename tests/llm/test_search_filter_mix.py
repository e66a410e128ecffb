"""Top-k search, URL filters, mixing, toxicity and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import mixing, topk, toxicity, urls


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vecs = np.concatenate((rng.normal(size=(300, 12)), rng.normal(size=(60, 12)) * 5)).astype(np.float32)
    vecs[50:60] = vecs[40]  # ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    n = len(rows)
    rows += [(n * 10, None), (n * 10 + 10, [float("nan")] * 12), (n * 10 + 20, [None] * 12), (None, rows[0][1]), (n * 10 + 30, [0.0] * 12), (n * 10 + 40, [1.0, 2.0]), (n * 10 + 41, [1.5, -2.0]), (n * 10 + 50, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = [(i, np.floor(1024 * np.array(v, float)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in good:
        if q % 10 == 0:
            scored = sorted((-int(a @ b), i) for i, b in good if i != q and len(a) == len(b))[:7]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    for block, group in ((8192, 1024), (32, 5)):
        got = topk.search(frame, k=7, every=10, block=block, group=group, lead=4)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.search(frame.where("vec_id < 0")).count() == 0
    assert topk.search(frame.where("vec_id = 0")).count() == 0


def test_url_filter(spark):
    cases = [
        (1, "https://www.example.net/en/5?x", "www.example.net", "/en/5", "example.net/en/", "allow"), (2, "https://example.net/de/5", "example.net", "/de/5", "net/", "block"),
        (3, "http://Blog.EXAMPLE.com/de/", "blog.example.com", "/de/", "example.com/de/", "block"), (4, "http://badexample.com/de/x", "badexample.com", "/de/x", None, "allow"),
        (5, "http://a.org/fr/1#t", "a.org", "/fr/1", "org/fr/", "allow"), (6, "http://a.org/FR/1", "a.org", "/FR/1", None, "allow"), (7, None, "", "", None, "allow"), (8, "no scheme/x", "", "", None, "allow"),
        (9, "http://x.net", "x.net", "", None, "allow"), (10, "http://x.net?a/b", "x.net", "", None, "allow"), (11, "", "", "", None, "allow"), (12, "http://", "", "", None, "allow"),
        (13, "http://net/", "net", "/", "net/", "block"), (14, "http://x.net/a\nb", "x.net", "/a\nb", "net/", "block"), (None, "http://x.net/", "x.net", "/", "net/", "block"),
        (2, "https://example.net/de/5", "example.net", "/de/5", "net/", "block"), (15, "http://x\ny.net/" + "long/" * 5000, "x\ny.net", "/" + "long/" * 5000, "net/", "block"),
    ]
    frame = spark.createDataFrame([(i, u, "x") for i, u, *_ in cases], "page_id long, url string, host string")
    for slice_bytes in (1, urls.SLICE_BYTES):
        got = urls.judge(frame, slice_bytes=slice_bytes)
        assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((i, *rest)) for i, _, *rest in cases)
    assert urls.judge(frame.where("page_id > 99")).count() == 0
    assert {r.verdict for r in urls.judge(frame, rules=()).collect()} == {"allow"}


def test_rules_are_filed_under_their_rarest_token():
    index = urls.index_rules([("block", "example.net/en/x"), ("allow", "net/")], {"h:example": 9, "h:net": 4, "p:en": 7})
    assert [r for r, _, _ in index["h:net"]] == ["example.net/en/x", "net/"]
    assert urls.rule_tokens("example.net/en/x") == ["h:example", "h:net", "p:en"]  # x may go on


def test_one_period_is_less_than_a_block_off():
    share = mixing.whole_weights({"a": 0.5, "b": 0.333, None: 0.1, "c": 0.0001}, 100)
    assert sum(share.values()) == 100 and min(share.values()) == 1
    done = dict.fromkeys(share, 0)
    for source, k, slot, release, deadline in mixing.one_period(share):
        assert done[source] == k and release <= slot < deadline
        done[source] += 1
        assert all(abs(done[s] - share[s] * (slot + 1) / 100) < 1 for s in share)
    assert done == share


def test_schedule(spark, awkward, nothing):
    rows = [(i, "big" if i % 3 else "small" if i % 2 else None) for i in range(600)] + [(0, None), (None, "big")]
    frame = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.schedule(frame, block=2, period=50).collect()
    assert len(got) == 601 and len({(r.source, r.id) for r in got}) == 601
    slots = {}
    for r in got:
        slots.setdefault(r.slot, set()).add((r.source, r.block))
        assert r.release <= r.slot < r.deadline
    assert all(len(x) == 1 for x in slots.values())  # one block a slot
    mixed = sorted({r.slot for r in got if r.mixed})
    assert mixed == list(range(len(mixed)))  # no gap up to the end of the mix
    assert sum(r.mixed for r in got) > 300
    targets = mixing.schedule(frame, weights={"big": 1.0, "small": 1.0}, block=2, period=50).collect()
    assert all(not r.mixed for r in targets if r.source is None)
    taken = [sum(r.mixed for r in targets if r.source == s) for s in ("big", "small")]
    assert abs(taken[0] - taken[1]) <= 2
    assert mixing.schedule(awkward).count() == 14
    assert mixing.schedule(nothing).count() == 0


def test_schedule_all_places_every_block(spark, awkward, nothing):
    rows = [(i, "big" if i % 3 else "small" if i % 2 else None) for i in range(600)] + [(0, None), (None, "big"), (900, "rare")]
    got = mixing.schedule_all(spark.createDataFrame(rows, "doc_id long, source string"), block=2, period=50).collect()
    assert len(got) == 602 and len({(r.source, r.id) for r in got}) == 602
    held = {r.slot: (r.source, r.block) for r in got}
    assert len(set(held.values())) == len(held) and sorted(held) == list(range(len(held)))  # one block a slot, no gap
    assert all(r.release <= r.slot < r.deadline for r in got)
    rare = next(r for r in got if r.source == "rare")
    assert rare.phase == 0 and sum(r.phase > 0 for r in got) > 300
    assert mixing.schedule_all(awkward).count() == 14 and mixing.schedule_all(nothing).count() == 0


def test_phases_keep_the_shares_when_a_source_runs_dry():
    blocks = {"a": 4000, "b": 2000, None: 1}
    planned = mixing.phases(blocks, {"a": 2.0, "b": 1.0, None: 0.001}, 100)
    assert sum(size for _, size, *_ in planned) == 6001
    assert [sorted(map(str, share)) for _, _, _, share, _ in planned][:2] == [["None", "a", "b"], ["a", "b"]]
    assert all(abs(share["a"] - 2 * share["b"]) <= 3 for _, _, _, share, _ in planned if "b" in share and "a" in share)


def test_pipeline_mix_keeps_every_document(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, f"text {i}", "rare" if i == 7 else f"s{i % 3}") for i in range(40_000)] + [(None, "no id", None), (3, "again", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(map(str, corpus_pipeline.mix_sources(spark, docs, "").collect())) == sorted(map(str, docs.collect()))


def test_buckets_of_ranks_give_one_order(spark):
    frame = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(500)], "doc_id long, source string")
    one, many = (sorted(map(str, mixing.ranked(frame, "doc_id", "source", 3, n).collect())) for n in (10_000, 5))
    assert one == many


def test_label_model_finds_the_voters_rates():
    rng = np.random.default_rng(0)
    n, size = 200_000, toxicity.LEXICONS + 2 + len(toxicity.PATTERNS)
    y = rng.random(n) < 0.1
    on = np.where(y[:, None], np.linspace(0.2, 0.6, size), 0.0005)  # what fires is evidence, what abstains is none
    fired = rng.random((n, size)) < on
    fired[:, 1] = fired[:, 0]  # a copy
    fired[:, -1] = ~fired[:, :-1].any(1)
    x = fired.astype(float)
    model = toxicity.LabelModel(n, x.T @ x, 0.1)
    assert np.abs(model.on_positive[3:20] - np.linspace(0.2, 0.6, size)[3:20]).max() < 0.08
    assert model.discount[0] < 0.8 and model.discount[1] < 0.8
    assert ((model.posterior(fired) > 0.5) == y).mean() > 0.97


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.score(docs, labels).cache()
    assert got.count() == docs.count() and got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    judged = got.where("held_out").join(labels, "doc_id").select("predicted", "toxic").toPandas()
    hit = ((judged.predicted == 1) & (judged.toxic == 1)).sum()
    assert hit >= 0.85 * judged.toxic.sum() and hit >= 0.9 * judged.predicted.sum()


def test_toxicity_on_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(12, 1, 0), (1, 0, 1), (4, 0, None), (None, 1, 1), (6, None, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.score(awkward, labels).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[12].score > by_id[6].score and by_id[12].predicted == 1 and by_id[6].predicted == 0
    assert toxicity.score(awkward, labels.where("doc_id > 99")).count() == awkward.count()
    assert toxicity.score(nothing, labels).count() == 0


def test_pipeline_stages(spark, awkward, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = awkward
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "byte_bpe":
            assert out.columns == awkward.columns and dict(out.dtypes) == dict(awkward.dtypes)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert {r.doc_id for r in docs.collect()} >= {1, 6, 10} and 2 not in {r.doc_id for r in docs.collect()} and 12 not in {r.doc_id for r in docs.collect()}
    rows = corpus_pipeline.run(spark, folder)
    assert 0 < rows.count() < spark.read.parquet(f"{folder}/documents.parquet").count()


def test_pipeline_judges_rows_by_their_text(spark, tmp_path):
    """Rows without an id, ids that rows share, clashing names, an empty table."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    bad, long = "you IDIOT!!! you stupid worthless moron, shut up you idiot!!! " * 3, " ".join(f"w{i}" for i in range(80))
    rows = [(None, bad), (70, bad), (70, "A clean text that shares its id."), (None, "A clean text without an id."), (None, long), (81, long), (80, long + " more"),
            (90, "once again"), (90, "once again"), (None, "twice and again"), (None, "twice and again"), (91, None), (91, "")]
    names = "_toxic _kept _source _id _slot _digest _rows digest first rest component_id"
    docs = spark.createDataFrame([(*r, "s", 1, *names.split()) for r in rows], "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names.split()))
    out = {}
    for name, stage in corpus_pipeline.STAGES[:2]:
        out[name] = stage(spark, docs if not out else out["toxicity"], folder)
        assert out[name].columns == docs.columns
        out[name].write.parquet(str(tmp_path / name))
        out[name] = spark.read.parquet(str(tmp_path / name))
    as_rows = lambda frame: sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)
    assert as_rows(out["toxicity"]) == sorted([r for r in rows if r[1] != bad], key=str)
    kept = as_rows(out["simhash_near_dedup"])
    assert [r for r in kept if r[0] != 91] == sorted([(70, rows[2][1]), (None, rows[3][1]), (80, long + " more"), (90, "once again"), (None, "twice and again")], key=str)
    assert len([r for r in kept if r[0] == 91]) == 1
    mixed = corpus_pipeline.mix_sources(spark, out["simhash_near_dedup"], folder)
    assert mixed.columns == docs.columns and as_rows(mixed) == kept
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("doc_id < 0"), folder).count() == 0


def test_conjugate_gradients_fit_as_newton_does():
    rng = np.random.default_rng(2)
    hits = [sorted(set(rng.integers(0, 40, rng.integers(0, 6)).tolist())) for _ in range(500)]
    marks = [[0] if rng.random() < 0.2 else [] for _ in range(500)]
    x, y = toxicity.Design(hits, marks, 40), rng.random(500)
    start = np.zeros(40 + len(toxicity.PATTERNS) + 3)
    dense = np.stack([x @ e for e in np.eye(len(start))], 1)
    assert dense[3, :40].nonzero()[0].tolist() == hits[3]
    got = toxicity.fit(x, y, start)
    ridge = np.ones(len(start))
    ridge[-1] = 1e-6
    p = 1 / (1 + np.exp(-dense @ got))
    assert np.abs(dense.T @ (p - y) + ridge * got).max() < 1e-6
    assert np.allclose(x.chances(got), p)
