"""Models fitted by the table against a dense Newton solver, fold by fold and configuration by configuration."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.operators import training as TR
from attesta.session import Written

WORDS = {
    "cleaning-product": "bleach detergent floor stain soap".split(), "cosmetics-and-toiletries": "shampoo lotion perfume hair soap".split(),
    "general-food": "sugar milk cocoa flour salt".split()}
CLASSES = sorted(WORDS)
WAYS = [TR.Configuration("a", 1.0), TR.Configuration("b", 10.0, True, 1, 1)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for n in range(120):
        c = CLASSES[n % 3]
        words = [rng.choice(WORDS[c] if rng.random() < 0.7 else sum(WORDS.values(), [])) for _ in range(rng.randint(2, 9))]
        out.append((n, f"p{n % 7}", c, " ".join(words)))
    return out


def features(text, high):
    words, out = text.split(), {}
    for n in range(1, high + 1):
        for i in range(len(words) - n + 1):
            k = " ".join(words[i:i + n])
            out[k] = out.get(k, 0) + 1
    return out


def dense(train, held, way):
    """Probabilities of the held-out texts from a Newton solve on dense matrices."""
    counts = [features(r[3], way.high) for r in train]
    df = {}
    for x in counts:
        for k in x:
            df[k] = df.get(k, 0) + 1
    terms = sorted(k for k in df if df[k] >= way.min_df)
    at = {k: i for i, k in enumerate(terms)}
    idf = np.array([np.log((1 + len(train)) / (1 + df[k])) + 1 for k in terms])

    def matrix(rs):
        x = np.zeros((len(rs), len(terms) + 1))
        for a, r in enumerate(rs):
            for k, v in features(r[3], way.high).items():
                if k in at:
                    x[a, at[k]] = (1 + np.log(v) if way.sublinear else v) * idf[at[k]]
            x[a] /= np.linalg.norm(x[a]) or 1
        x[:, -1] = 1
        return x

    x, known = matrix(train), sorted({r[2] for r in train})
    y = np.array([known.index(r[2]) for r in train])
    k, d = len(known), x.shape[1]
    weight = np.array([len(train) / (k * (y == c).sum()) for c in y])
    penalty = np.full(d, (2.0 if k == 2 else 1.0) / way.c)
    penalty[-1] = 0
    w = np.zeros((k, d))
    for _ in range(50):
        z = x @ w.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = ((p - np.eye(k)[y]) * weight[:, None]).T @ x + w * penalty
        if np.abs(g).max() < 1e-11:
            break
        h = np.diag(np.tile(penalty, k)) + 1e-9 * np.eye(k * d)
        for a in range(k):
            for b in range(k):
                h[a * d:(a + 1) * d, b * d:(b + 1) * d] += (x * (weight * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x
        w -= np.linalg.lstsq(h, g.ravel(), rcond=None)[0].reshape(k, d)
    z = matrix(held) @ w.T
    p = np.exp(z - z.max(1, keepdims=True))
    out = np.zeros((len(held), len(CLASSES)))
    out[:, [CLASSES.index(c) for c in known]] = p / p.sum(1, keepdims=True)
    return out


def softmax(scores):
    s = np.array([-np.inf if v is None else v for v in scores])
    e = np.exp(s - s.max())
    return e / e.sum()


def held_against(fit, rows, ways, apart=5e-3):
    got = {(r.configuration, r.doc_id): r for r in fit.held_out().collect()}
    for way in ways:
        for product in sorted({r[1] for r in rows}):
            train = [r for r in rows if r[1] != product and len(r[3].split()) >= 3]
            held = [r for r in rows if r[1] == product]
            for r, p in zip(held, dense(train, held, way)):
                assert got[way.name, r[0]].product_id == product
                assert np.abs(softmax(got[way.name, r[0]].scores) - p).max() < apart
    assert len(got) == len(ways) * len(rows)


def test_all_folds_and_configurations_at_once(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, product_id string, subcategory string, text string").repartition(4)
    fit = TR.Fit(df, "subcategory", WAYS, "product_id")
    assert fit.models == 14
    held_against(fit.run(tolerance=5e-5), rows, WAYS)


def test_folds_that_lose_a_class(spark, rows):
    """One product alone holds a class, and without another only two classes are left for it: no class is scored that a fold has not seen."""
    few = [(n, "only" if c == CLASSES[2] else p, c, t) for n, p, c, t in rows[:60] if p in ("p1", "p2", "p3")]
    df = spark.createDataFrame(few, "doc_id long, product_id string, subcategory string, text string")
    fit = TR.Fit(df, "subcategory", WAYS[1:], "product_id").run(tolerance=5e-4)
    held_against(fit, few, WAYS[1:], 0.04)
    notes = {r.product_id: r for r in fit.folds().collect()}
    assert notes["only"].held_out_classes_absent_from_training == [CLASSES[2]] and notes["p1"].held_out_classes_absent_from_training == []
    assert notes["only"].classes_in_training == CLASSES[:2] and notes["only"].n_held_out == sum(r[1] == "only" for r in few)


def test_cross_validation_decides_and_abstains(spark, rows):
    extra = rows + [(500, "p1", CLASSES[0], "soap"), (501, "p1", CLASSES[0], "never seen words"), (502, None, CLASSES[0], "bleach floor stain")]
    df = spark.createDataFrame(extra, "doc_id long, product_id string, subcategory string, text string").withColumn("scores", F.lit("x"))
    decided, notes = TR.cross_validate(df, configurations=WAYS[:1], max_steps=2)
    by = {r.doc_id: r for r in decided.collect()}
    assert len(by) == len(rows) + 2 and 502 not in by
    assert (by[500].reason, by[501].reason) == ("insufficient text", "no known term") and by[501].category == "unknown"
    assert notes.count() == 7


def test_terms_are_numbered_without_gaps(spark):
    words = [f"w{n * 7919 % 5000:05d}" for n in range(5000)]
    df = spark.createDataFrame([(w,) for w in words + words[:100]], "term string").repartition(7)
    got = sorted((r.term, r.slot) for r in TR.numbered(df, "term", "slot", Written(spark)).collect())
    assert got == list(zip(sorted(words), range(5000)))


def test_training_needs_two_classes(spark):
    with pytest.raises(ValueError):
        TR.train(spark.createDataFrame([(1, "a", "one two three")], "doc_id long, subcategory string, text string"), "subcategory")


def test_copies_are_one_weighted_row(spark, rows):
    """Repeated texts are fitted once each; their models and scores are those of all the rows."""
    tripled = [(n, *r[1:]) for n, r in enumerate(rows[:40] * 3)]
    fit = TR.Fit(spark.createDataFrame(tripled, "doc_id long, product_id string, subcategory string, text string"), "subcategory", WAYS[:1], "product_id")
    assert fit.docs.count() <= 40 and fit.docs.agg(F.sum("copies")).first()[0] == 120
    held_against(fit.run(tolerance=5e-5), tripled, WAYS[:1])
    assert fit.held_out().count() == 120


def test_steps_take_the_tasks_that_their_features_need(spark, rows):
    """Few different texts are fitted by few tasks, however many partitions the session has."""
    df = spark.createDataFrame(rows[:30], "doc_id long, product_id string, subcategory string, text string")
    before, sc = spark.conf.get("spark.sql.shuffle.partitions"), spark.sparkContext
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        fit = TR.Fit(df, "subcategory", WAYS[:1], "product_id")
        sc.setJobGroup("steps of few texts", "")
        fit.run(max_steps=2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("steps of few texts")]
    stages = [sc.statusTracker().getStageInfo(s) for j in jobs for s in j.stageIds]
    assert len(jobs) > 5 and max(s.numTasks for s in stages if s) < 64


def test_copies_are_decided_once_and_stay_where_they_are(spark, rows, monkeypatch):
    """Few different texts go to their copies, many meet them by a shuffle; nulls meet nulls, and both ways decide alike."""
    odd = [("p1", None, "bleach floor stain"), ("p1", "general-food", None), (None, "general-food", "sugar milk 5 cocoa"), ("p2", "general-food", "sugar milk 7 cocoa")]
    given = [(n, *r) for n, r in enumerate([r[1:] for r in rows[:30] * 2] + odd * 2)]
    df = spark.createDataFrame(given, "doc_id long, product_id string, subcategory string, text string")
    found = []
    for few in (4 << 20, 0):
        monkeypatch.setattr(TR, "FEW_BYTES", few, raising=False)
        decided, _ = TR.cross_validate(df, configurations=WAYS, max_steps=2)
        moved = [x for x in decided._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x and "_given" in x]
        assert bool(moved) == (few == 0)
        found.append(sorted(map(repr, decided.collect())))
    assert found[0] == found[1] and len(found[0]) == len(WAYS) * sum(g[1] is not None for g in given)
