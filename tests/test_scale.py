"""Plans and forms that keep their size in check on larger tables."""

from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import classify as M, detect as D, training as TR


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_next_line_is_never_broadcast(spark):
    """The line table outgrows its estimate, so even a small one is joined by a shuffle."""
    texts = spark.createDataFrame([(1, "a\nb\nc"), (2, "d"), (3, "")], "image_id long, text string")
    got = D.with_next_line(D.lines_from_text(texts).select("image_id", "line_index", "text"))
    assert "Broadcast" not in _plan(got)
    assert sorted((r.image_id, r.line_index, r.next_text) for r in got.collect()) == [(1, 0, "b"), (1, 1, "c"), (1, 2, None), (2, 0, None)]


def test_examples_are_never_broadcast(spark):
    """No step of a fit sends a row an example through the driver."""
    words = ["sugar milk cocoa", "bleach floor stain"]
    df = spark.createDataFrame([(n, f"p{n % 3}", "ab"[n % 2], words[n % 2] + f" x{n % 5}") for n in range(60)], "doc_id long, product_id string, subcategory string, text string")
    fit = TR.Fit(df, "subcategory", group="product_id")
    rows = fit.examples.where("NOT held").selectExpr("model", "_e", "y", "weight", "inverse", "in0", "in1", "0D AS m0", "0D AS m1")
    features = fit.features.where("NOT held").drop("held")
    parameters = fit.vocabulary.select("model", "slot").selectExpr("*", "1D AS w0", "2D AS w1")
    for df in (fit._gradient(rows, features).where("slot >= 0"), fit._scores(features, rows, parameters, "w", "z")):
        assert "ShuffledHashJoin [model" in _plan(df)


def test_counts_are_never_broadcast(spark):
    docs = spark.createDataFrame([(1, "milk sugar cocoa"), (2, "soap soap bleach")], "doc_id int, text string")
    model = spark.createDataFrame([("milk", 1.0, [3.0, -3.0]), ("soap", 1.0, [-3.0, 3.0])], "term string, idf double, weights array<double>")
    scored = M.linear_scores(M.term_counts(docs), model, [0.5, 0.0])
    assert "Broadcast" not in _plan(scored)
    assert {r.doc_id: (r.known_terms, list(r.scores)) for r in scored.collect()} == {1: (1, [3.5, -3.0]), 2: (1, [-2.5, 3.0])}


def test_terms_are_counted_where_their_text_is(spark):
    """One shuffle, of texts by key; repeated keys, empty and null texts."""
    rows = [(1, "b a b a b 12 3"), (2, ""), (3, None), (4, "a"), (4, "a b"), (None, "x")]
    got = M.term_counts(spark.createDataFrame(rows, "doc_id int, text string"))
    assert _plan(got).count("Exchange hashpartitioning(") == 1 and "Exchange hashpartitioning(doc_id" in _plan(got)
    want = {(1, "b"): 3, (1, "a"): 2, (1, "<num>"): 2, (1, "b a"): 2, (1, "a b"): 2, (1, "b <num>"): 1, (1, "<num> <num>"): 1,
            (4, "a"): 2, (4, "b"): 1, (4, "a b"): 1, (None, "x"): 1}
    assert {(r.doc_id, r.term): r.tf for r in got.collect()} == want


def test_nfkc_is_row_by_row(spark):
    """No Arrow batch of ten thousand long texts in a worker; nulls stay null, in lists too."""
    df = spark.createDataFrame([("ﬁ５", ["ﬂ", None, "a"]), (None, None), ("plain", [])], "v string, l array<string>")
    got = df.select(T.nfkc(df.v).alias("v"), T.nfkc_each(df.l).alias("l"))
    assert "BatchEvalPython" in _plan(got) and "ArrowEvalPython" not in _plan(got)
    assert [tuple(r) for r in got.collect()] == [("fi5", ["fl", None, "a"]), (None, None), ("plain", [])]


def test_texts_are_split_once(spark):
    """No filter that makes and splits the text a second time beside the scan, and none that reads a line's contacts twice."""
    texts = spark.createDataFrame([(1, "care a@b.example\nNet Qty: 1 kg\n98765 43210"), (2, ""), (3, None)], "image_id long, text string").repartition(2, "image_id")
    lines = D.lines_from_text(texts)
    assert _plan(lines).count("BatchEvalPython") == 1
    assert sorted((r.image_id, r.line_index, r.next_text) for r in lines.collect()) == [(1, 0, "Net Qty: 1 kg"), (1, 1, "98765 43210"), (1, 2, None)]
    contacts = D.contact_lines(lines)
    assert _plan(contacts).count(D.V.EMAIL) == 1
    assert sorted((r.line_index, *r.emails, *r.phones) for r in contacts.collect()) == [(0, "a@b.example"), (2, "98765 43210")]


def test_terms_are_shuffled_once_to_their_weight(spark):
    """Document frequencies and weights are taken from one layout by term, and a text's terms are ranked in its row."""
    docs = spark.createDataFrame([(n, "bb aa cc aa" if n % 2 else "aa cc dd") for n in range(6)], "doc_id long, text string").repartition(2)
    counts = M.term_counts(docs)
    idf = M.fit_idf(counts, docs.groupBy().count().withColumnRenamed("count", "n"), met_again=True)
    plain = M.fit_idf(counts, docs.groupBy().count().withColumnRenamed("count", "n"))
    assert sorted(idf.collect()) == sorted(plain.collect())
    top = M.top_terms(counts, idf.selectExpr("*", "array(0D, 1D) AS weights"), 1, k=2)
    got = sorted((r.doc_id, r.rank, r.term) for r in top.collect())
    # document 0: cc dd, dd are in 3 of 6, ties fall to the term; document 1: aa is there twice, bb in 3 of 6
    assert got[:4] == [(0, 1, "cc dd"), (0, 2, "dd"), (1, 1, "aa"), (1, 2, "bb")] and len(got) == 12
    assert "ReusedExchange" in _plan(top)


def test_rules_are_decided_once_a_product_and_checked_once(spark):
    """Links are answered before runs are met, the framework's rules don't travel with the runs, and no filter on the outcome repeats a check."""
    import __spark_entry__ as entry

    found = entry.queries()["finding_snapshot"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("declared by number") == 1 and plan.count("withholds_exemption") == plan.split("explode(rules")[1].count("withholds_exemption")


def test_readings_are_shuffled_once(spark):
    """One layout by run; the earliest photograph wins, then the smaller id; a null position is 1, unknown keys drop out."""
    from attesta.functions import values as N
    from attesta.operators import readings as R

    rows = [(1, 5, 2, "net_quantity", "late"), (1, 9, None, "net_quantity", "null is one"), (1, 8, 1, "net_quantity", "first"), (1, 1, 1, "no key", "x"), (2, None, 1, "importer_name", "no id"), (3, 1, 1, "unlisted", "x")]
    df = spark.createDataFrame(rows, "run_id long, reading_id long, position int, field_key string, raw_value string").selectExpr(
        "*", "CAST(NULL AS BIGINT) AS image_id", "0.9D AS confidence")
    df = df.withColumn("normalized", N.normalized()).selectExpr("*", f"CAST(NULL AS {N.BOX_TYPE}) AS box")
    got = R.reading_maps(df)
    assert _plan(got).count("Exchange hashpartitioning(") == 1
    assert {r.run_id: {k: v.raw_value for k, v in r.fields.items()} for r in got.collect()} == {1: {"net_quantity": "first"}, 2: {"importer_name": "no id"}}


def test_another_layout_spreads_over_all_tasks(spark):
    """The reordered copy is dealt out by its key over Spark's partitions, not by a few sources into five."""
    import __spark_entry__ as entry

    plan = entry.queries()["version_digests_agree"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc_id" in plan and "RepartitionByExpression [source" not in plan


def test_cells_are_folded_once(spark):
    """Annotations of keys nobody extracts are cells of listed samples only, in every configuration, and take no second fold of the facts."""
    from attesta.operators import quality as Q

    samples = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "sample_id long, configuration string")
    ann = spark.createDataFrame([(1, "a", "batch_x", "unknown", "v"), (1, "a", "net_quantity", "present_and_readable", "5 g"), (9, "a", "batch_x", "unknown", "w"), (1, "b", None, "unknown", "n")],
                                "sample_id long, configuration string, key string, state string, value string")
    pred = spark.createDataFrame([(1, "a", "net_quantity", "net 5 G", ["5 g"], True, False)],
                                 "sample_id long, configuration string, key string, raw_value string, values array<string>, committed boolean, uncertain boolean")
    unread = spark.createDataFrame([(2, "a", "net_quantity")], "sample_id long, configuration string, key string")
    cells = Q.outcome_cells(samples, ann, pred, unread, keys=("net_quantity", "best_before"), by=("configuration",))
    assert _plan(cells).count("BatchEvalPython") <= 3
    got = sorted((r.sample_id, r.configuration, r.key or "-", r.state, r.has_value, r.declined, r.matches) for r in cells.collect())
    blank = ("unknown", False, False, False)
    assert got == sorted([
        (1, "a", "net_quantity", "present_and_readable", True, False, True), (1, "a", "best_before", *blank), (1, "a", "batch_x", *blank),
        (1, "b", "net_quantity", *blank), (1, "b", "best_before", *blank), (1, "b", "-", *blank),
        (2, "a", "net_quantity", "unknown", False, True, False), (2, "a", "best_before", *blank)])


def test_a_block_asks_for_its_terms_once(spark):
    """Terms go by block and not by text: the weights meet the counts without a layout by text, and the results are those of the plain way."""
    texts = ["bb aa cc aa", "aa cc dd", "", None, "dd dd 12 x5", "zz"]
    docs = spark.createDataFrame([(n if n != 7 else None, texts[n % 6]) for n in range(40)], "doc_id long, text string").repartition(3)
    n = docs.groupBy().count().withColumnRenamed("count", "n")
    plain, blocks = M.term_counts(docs), M.block_counts(M.in_blocks(docs))
    assert sorted(map(str, blocks.drop("block").collect())) == sorted(map(str, plain.collect()))
    idf = M.block_idf(blocks, n)
    assert sorted(idf.drop("block").distinct().collect()) == sorted(M.fit_idf(plain, n).collect())
    weigh = lambda df: df.selectExpr("*", "array(-1D, length(term) - 2D) AS weights")
    top = M.top_terms(blocks, weigh(idf), 1, k=2)
    assert "Exchange hashpartitioning(doc_id" not in _plan(top) and "Exchange hashpartitioning(block" in _plan(top) and "Join [block" not in _plan(top)
    assert sorted(map(str, top.drop("block").collect())) == sorted(map(str, M.top_terms(plain, weigh(M.fit_idf(plain, n)), 1, k=2).collect()))


def test_evidence_is_the_same_by_block(spark):
    """A model by block and a plain one, counts by block and plain ones; a text without a key knows no term."""
    from attesta.operators import evidence as E

    docs = spark.createDataFrame([(n if n != 3 else None, ["milk sugar cocoa", "soap soap bleach", "two words", None, "wholly other terms"][n % 5]) for n in range(1, 23)], "doc_id long, text string")
    model = spark.createDataFrame([("milk", 1.0, [3.0, -3.0]), ("sugar", 1.0, [2.0, -3.0]), ("soap", 1.0, [-3.0, 3.0])], "term string, idf double, weights array<double>")
    counts = M.block_counts(M.in_blocks(docs))
    by_block = counts.select("block", "term").distinct().join(model, "term")
    ways = [E.recorded_strings(docs, c, m, [0.0, 0.0], ["general-food", "cleaning-product"]) for c, m in ((counts, by_block), (M.term_counts(docs), model))]
    got = [sorted(map(str, w.select("doc_id", "reason", "evidence").collect())) for w in ways]
    assert got[0] == got[1] and len(got[0]) == 22
    assert sum("term: \'milk\' weighed" in g or "term: 'milk' weighed" in g for g in got[0]) == 4
    assert "Exchange hashpartitioning(doc_id" not in _plan(ways[0])


def test_signals_run_where_their_words_are(spark):
    import re

    assert T.words_of(r"\bdish\s*wash\b|\bmoisturi[sz](?:er|ing)\b") == ["dish", "moisturi"] and T.words_of(r"\d+|x") == [""]
    assert T.words_of(r"(?:ab|c(?i:def))?\w") == [""] and T.words_of(r"(?:abc|ab)+d") == ["ab"]
    words = "non-vegetarian veg ins 330 dishwash exp. date tooth paste how to consume drop fizz servings per medical device dermatologically caldera md-5 reach".split(" ")
    texts = [" ".join(words[k:k + n]) for n in (1, 2, 3, 5) for k in range(len(words))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", D.signal_hits(F.col("t")).alias("s"), D.signal_hits(F.col("t"), snippets=False).alias("p")).collect()
    for r in got:
        want = [name for name, _, pattern in D.V.SIGNALS if re.search(pattern, r.t)]
        assert [s.phrase for s in r.s] == want and [s.phrase for s in r.p] == want


def test_tokens_of_digits_are_told_by_their_first(spark):
    df = spark.createDataFrame([("a1 99 9٣ ٣9 é2 ²x",)], "t string")
    assert df.select(T.feature_tokens(F.col("t")).alias("k")).first().k == ["a", "<num>", "<num>", "<num>", "<num>", "é", "<num>", "x"]


def _odd_labels(spark):
    parts = ["Net Qty: 500 g", "NET WT 5 KG", "M.R.P. Rs 20/-", "max. retail price 30", "₹ 45", "12.50/1.25 NSP x", "MRP", "Unit price Rs. 2 per g", "5 / kg", "USP", "Batch No: B12X", "Lot no.", "b.no 7A", "bn 12",
             "Mfg Date: 2024-01-31", "MFD", "12/2025", "pkd on 3 May 2024", "Use by", "EXP", "9 months", "imported on 1/2/2024", "consıme by 2/2/2026", "CONSUME BY 2/2/2026", "Made in India", "origin: Nepal", "Country of Origin",
             "Packed by:", "Packer Co", "IMPORTED BY X", "marketed by #", "Customer Care", "a@b.example", "1800-10-22-221", "98765 43210", "E-mail", "toll free", "contact us", "nutrition per 100 g", "Quantıty 5 g", "QUANTITY 5 g", "x", "٣ kg net", ""]
    labels = ["\n".join(parts[(k * step + j * j) % len(parts)] for j in range(n)) for k in range(len(parts)) for n, step in ((1, 1), (2, 3), (4, 5), (7, 11))]
    return D.lines_from_text(spark.createDataFrame([*enumerate(labels), (-1, None)], "image_id long, text string"))


def test_detectors_run_where_a_line_has_what_they_need(spark):
    """The same candidates as without asking first, also for letters that fold to ASCII ones."""
    lines = _odd_labels(spark)
    kinds = (*D.ALL_DETECTORS, "any_quantity")
    plain = F.concat(*[F.coalesce(D.DETECTORS[k](F.col("text"), F.col("next_text"), D._candidate), F.array().cast(f"array<{D.CANDIDATE_TYPE}>")) for k in kinds])
    want = lines.select("image_id", "line_index", F.posexplode(plain).alias("ordinal", "c")).select("image_id", "line_index", "ordinal", "c.*")
    got = D.line_candidates(lines, kinds).select(want.columns)
    rows = sorted(map(str, want.collect()))
    assert sorted(map(str, got.collect())) == rows and len(rows) > 200
    assert T.words_of(D.V.COUNTRY_DECLARED, True) == ["country"] and T.words_of(D.V.COUNTRY_DECLARED) == [""]
    phones = D.contact_lines(lines).where("size(phones) > 0 OR size(emails) > 0 OR keyword")
    by_text = lines.where(F.col("text").rlike("(?i)customer care|@|1800|98765|e-mail|toll|contact us"))
    assert phones.count() == D.contact_lines(lines).count() == by_text.count()


def test_unread_declarations_take_one_scan(spark):
    """Anchors and candidates are asked together, and only of declarations that have an anchor."""
    lines = _odd_labels(spark)
    got = D.unread_in(lines)
    assert _plan(got).count("BatchEvalPython") == 1 and "Join" not in _plan(got) and D.V.EMAIL not in _plan(got)
    want = D.unread_declarations(lines, D.extract(lines))
    rows = sorted(map(str, want.collect()))
    assert sorted(map(str, got.select(want.columns).collect())) == rows and len(rows) > 10


def test_declarations_are_counted_without_their_values(spark):
    lines = _odd_labels(spark)
    got = D.keys_read(lines)
    assert "no retail-price keyword" not in _plan(got) and "no retail-price keyword" in _plan(D.extract(lines))
    want = sorted((r.image_id, r.field_key) for r in D.extract(lines).collect())
    assert sorted((r.image_id, r.field_key) for r in got.collect()) == want and len(want) > 200
