"""Contracts, lists and graphs that the query catalogue compares only in part."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from attesta.functions import text as T
from attesta.operators import audit as A, contracts as C, detect as D
from attesta.plans import bindings as B, evaluation as E

SF = "/root/testdata/sf0.001"


def test_word_distance_needs_no_python(spark):
    cases = [(["a", "b", "c"], ["a", "c"], 1), ([], ["x"], 1), (["x"], [], 1), (["a", "b"], ["b", "a"], 2), ([f"w{i}" for i in range(9000)], [f"w{i}" for i in range(1, 9001)], 2)]
    df = spark.createDataFrame(cases, "l array<string>, r array<string>, n int").select("n", T.word_levenshtein(F.col("l"), F.col("r")).alias("d"))
    assert all(r.n == r.d for r in df.collect())
    assert "ArrowEvalPython" not in df._jdf.queryExecution().toString()


def test_contact_lists_keep_every_element(spark):
    lines = D.lines_from_text(spark.createDataFrame([
        (1, "Customer Care: a@x.example\nb@x.example 1800 123 4567\nA@X.example"), (2, "call 98765 43210"), (3, "nothing here")], "image_id long, text string"))
    rows = {r.image_id: r for r in D.resolve(D.contact_candidates(lines)).collect()}
    assert rows[1].normalized.emails == ["a@x.example", "b@x.example"] and rows[1].normalized.phones == ["1800 123 4567"]
    assert rows[1].raw_value == "Customer Care: a@x.example | b@x.example 1800 123 4567 | A@X.example"
    assert rows[2].normalized.uncertain and rows[2].normalized.emails is None and 3 not in rows


def test_the_gate_names_every_error(spark):
    rows = spark.createDataFrame([("x", "error", f"s{i:03d}", "") for i in range(45)] + [("y", "warning", "w", "")], "code string, severity string, subject string, detail string")
    try:
        A.require_clean(rows)
    except ValueError as e:
        assert "45 dataset" in str(e) and all(f"s{i:03d}" in str(e) for i in range(45)) and "[w]" not in str(e)
    else:
        raise AssertionError
    A.require_clean(rows.where("severity = 'warning'"))


def test_result_graph_lists_equal_their_queries(spark):
    i = B.Inputs(spark, SF)
    c = E.candidate_findings(i.inspections, i.framework(), B.AS_OF).cache()
    g = C.result_graph(i.runs.select("run_id"), E.findings(c), E.violations(c), i.flat_readings).cache()
    assert g.count() == i.runs.count()
    for name, rows in (("findings", E.findings(c)), ("violations", E.violations(c)), ("fields", i.flat_readings)):
        assert g.agg(F.sum(F.size(name))).first()[0] == rows.count()
    c.unpersist()


def test_verification_worksheet_lists(spark):
    rows = [(1, "p", "food", "a", "d2", None), (2, "p", "food", "b", "d1", None), (3, "p", "food", "a", "d1", None), (4, "q", "food", "a", "d9", "me")]
    got = A.verification_worksheet(spark.createDataFrame(rows, "example_id long, product_id string, category string, subcategory string, image_sha256 string, label_verified_by string")).collect()
    assert [(r.product_id, r.examples, r.images, r.drafted_label, r.example_ids, r.image_digests) for r in got] == [("p", 3, 2, "food/a; food/b", "1; 2; 3", "d1; d2")]


def test_new_queries_are_registered():
    assert {"reading_contract", "requirement_problems", "example_problems", "sample_problems", "result_graph", "train_two_classes"} <= set(entry.queries()) & set(entry.oracle_sql())


def test_classification_evidence_must_be_a_list(spark):
    from attesta.operators import policy as P

    raw = '{"metadata": {"product_classification": {"category": "packaged-food", "confidence": 0.9, "classifier_name": "m", "classifier_version": "1"%s}}}'
    rows = spark.createDataFrame([(i, raw % e) for i, e in enumerate(("", ', "evidence": ["a", "b"]', ', "evidence": "a"', ', "evidence": null', ', "evidence": {"a": 1}'))], "i int, raw string")
    got = {r.i: r.c for r in rows.select("i", P.read_classification(F.col("raw")).alias("c")).collect()}
    assert [got[i].usable for i in range(5)] == [True, True, False, True, False]
    assert got[1].evidence == ["a", "b"] and got[2].problem == "evidence must be a list"


def test_an_image_of_two_products_keeps_one_run(spark):
    from attesta.operators import policy as P

    requests = spark.createDataFrame([(1, 7, None, None)], "run_id int, image_id int, explicit_product_id string, stated_category string")
    images = spark.createDataFrame([(7, "b"), (7, "a")], "image_id int, product_id string")
    assert [(r.product_id, r.origin) for r in P.choose_product(requests, images).collect()] == [("a", "image")]


def test_the_shipped_framework_breaks_no_rule_of_its_own(spark):
    from attesta.plans.bindings import Inputs

    assert C.condition_problems(Inputs(spark, "").conditions).count() == 0


def test_result_rows_evaluate_the_framework_once(spark):
    """Findings, violations and evidence come out of one evaluation of the rules."""
    plan = entry.queries()["result_rows"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(rules") == 1
    runs = spark.createDataFrame([(1, 9, 7, "completed"), (2, None, None, "empty")], "run_id long, product_id long, image_id long, status string")
    products = spark.createDataFrame([(9, "food")], "product_id long, category_code string")
    findings = spark.createDataFrame([(1, "a", "failed", "major", 7), (1, "b", "failed", "minor", None), (2, "c", "passed", "minor", 3)], "run_id long, rule_code string, status string, severity string, evidence_image_id long")
    readings = spark.createDataFrame([(1, "net", 5, None), (3, "net", 6, "x")], "run_id long, field_key string, reading_id long, raw_value string")
    got = sorted((tuple(r) for r in C.result_rows(runs, products, findings, readings).collect()), key=str)
    assert got == sorted([
        (1, "run", "1", "completed"), (1, "image", "7", None), (1, "product", "9", "food"), (2, "run", "2", "empty"), (1, "finding", "a", "failed"), (1, "finding", "b", "failed"),
        (2, "finding", "c", "passed"), (1, "violation", "a", "major"), (1, "violation", "b", "minor"), (1, "evidence", "a", "7"), (1, "field", "net/5", None)], key=str)
