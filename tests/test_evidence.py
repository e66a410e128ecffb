"""What supports a suggestion, and the strings a classifier records, on small cases."""

import json

from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import audit as A, classify as M, evidence as E, policy as P


def _raw(**c):
    return json.dumps({"metadata": {"product_classification": {"category": "packaged-food", "confidence": 0.7, "classifier_name": "m", "classifier_version": "1", **c}}})


def _supporting(spark, runs, readings=()):
    runs = spark.createDataFrame(runs, "run_id int, recognised_text string, raw string").withColumn("c", P.read_classification(F.col("raw")))
    readings = spark.createDataFrame(list(readings), "run_id int, reading_id int, field_key string, raw_value string")
    return {r.run_id: r for r in E.supporting(runs, readings).collect()}


def test_lists_are_bounded_and_in_order(spark):
    terms = [f"term: 'w{i}' weighed for x" for i in range(20)]
    text = "Soap, shampoo, toothpaste, cream, hair, detergent, spray, bacteria, protein"
    fields = [(1, n, f"k{9 - n % 10}", f" v{n} ") for n in range(40)] + [(1, 99, "a", "  "), (1, 98, "a", None), (7, 1, "a", "x")]
    got = _supporting(spark, [(1, text, _raw(evidence=terms))], fields)
    assert list(got) == [1]
    assert [s.phrase for s in got[1].label_signals] == ["protein", "soap / bathing bar", "shampoo / conditioner", "toothpaste", "cream / lotion / serum", "skin / hair care"]
    assert "protein" in got[1].label_signals[0].snippet
    assert [tuple(f) for f in got[1].declared_fields] == [("k0", "v9"), ("k0", "v19"), ("k0", "v29"), ("k0", "v39"), ("k1", "v8"), ("k1", "v18")]
    assert got[1].model_terms == ["w0", "w1", "w2", "w3", "w4"]
    assert got[1].has_supporting_evidence and got[1].note == ""


def test_nothing_is_invented(spark):
    got = _supporting(spark, [(1, "zzz 123", _raw(evidence=[])), (2, " \n", _raw()), (3, None, None), (4, "bathing bar", "{broken"), (5, "zzz", _raw(evidence=["term: 'milk' weighed for y"]))])
    assert [got[n].note for n in (1, 2, 3, 4, 5)] == [E.NOTHING_FOUND, E.NOTHING_READ, E.NOTHING_READ, "", E.NOTHING_FOUND]
    assert [got[n].has_supporting_evidence for n in (1, 2, 3, 4, 5)] == [False, False, False, True, False]
    assert got[4].model_terms == [] and got[4].label_signals[0].phrase == "soap / bathing bar"
    assert got[5].model_terms == ["milk"]


def test_no_runs(spark):
    assert _supporting(spark, []) == {}


def test_malformed_terms(spark):
    given = ["term: x weighed for y", "term: ", "term: '' weighed for y", "term: ' weighed for y", 'term: "it\'s" weighed for y', "term: 'a", "signal: 'a' weighed for b", None, "term: 'ok' weighed for y"]
    df = spark.createDataFrame([(given,)], "e array<string>")
    assert df.select(E.shown_terms(F.col("e")).alias("t")).first().t == ["ok"]
    assert df.select(E.shown_terms(F.lit(None).cast("array<string>")).alias("t")).first().t == []
    assert spark.range(1).select(T.model_term(F.lit("term: 'a b' weighed for y")).alias("t")).first().t == "a b"


def test_recorded_strings(spark):
    docs = spark.createDataFrame([(1, "milk sugar cocoa"), (2, "soap soap bleach"), (3, "two words"), (4, "wholly other terms"), (5, None), (6, "milk soap bleach")], "doc_id int, text string")
    model = spark.createDataFrame([("milk", 1.0, [3.0, -3.0]), ("sugar", 1.0, [2.0, -3.0]), ("soap", 1.0, [-3.0, 3.0]), ("bleach", 1.0, [0.0, -1.0])], "term string, idf double, weights array<double>")
    rows = E.recorded_strings(docs, M.term_counts(docs), model, [0.0, 0.0], ["general-food", "cleaning-product"])
    got = {r.doc_id: r.evidence for r in rows.collect()}
    assert got[1] == ["signal: dairy (typical of packaged-food)", "signal: staple / spice (typical of packaged-food)", "term: 'milk' weighed for general-food", "term: 'sugar' weighed for general-food"]
    assert got[2][-1] == "term: 'soap' weighed for cleaning-product" and got[2][0].startswith("signal: soap")
    assert got[3] == ["insufficient text: 2 word token(s), fewer than the 3 required"]
    assert got[4] == ["insufficient evidence: none of the 3 word token(s) is known to the model"]
    assert got[5] == ["insufficient text: 0 word token(s), fewer than the 3 required"]
    # scores 0 and -0.577: a mass of 0.64 for food
    assert got[6][-1] == "term: 'milk' weighed for general-food"


def test_created_products_are_the_same_on_replay(spark):
    requests = spark.createDataFrame([(1, 10, 5, "food"), (2, 20, None, "food"), (3, 30, None, "food"), (4, 40, None, None), (5, 50, None, None), (6, None, None, None)],
                                     "run_id int, image_id int, explicit_product_id int, stated_category string")
    images = spark.createDataFrame([(20, 7), (20, 8)], "image_id int, product_id int")
    settled = spark.createDataFrame([(1, "non-food"), (3, "non-food"), (4, "non-food")], "run_id int, category_code string")
    for _ in range(2):
        products, runs = P.created_products(requests, images, settled)
        assert sorted(tuple(r) for r in products.select("product_key", "category_code", "origin").collect()) == [("run:3", "food", "stated_category"), ("run:4", "non-food", "classifier")]
        assert {r.run_id: (r.product_key, r.origin) for r in runs.collect()} == {
            1: ("5", "explicit"), 2: ("7", "image"), 3: ("run:3", "stated_category"), 4: ("run:4", "classifier"), 5: (None, "none"), 6: (None, "none")}


def test_worksheet_lines(spark):
    rows = [(1, "p", "food", "a", "d2", None), (2, "p", "food", "b", None, None), (3, "p", "food", "a", "d2", None), (4, "q", "food", "a", "d9", "me")]
    got = A.worksheet_lines(spark.createDataFrame(rows, "example_id long, product_id string, category string, subcategory string, image_sha256 string, label_verified_by string"))
    assert sorted(tuple(r) for r in got.collect()) == [
        ("p", "drafted_label", "food/a"), ("p", "drafted_label", "food/b"), ("p", "example", "1"), ("p", "example", "2"), ("p", "example", "3"), ("p", "image", "d2")]
