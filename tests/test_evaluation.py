"""Scenarios of the rule evaluation, as rows in and a verdict out."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from attesta import vocabulary as V
from attesta.functions import values as N
from attesta.plans import bindings as B
from attesta.plans.evaluation import Framework, Inspections, candidate_findings, findings, verdicts

AS_OF = date(2025, 1, 1)
READ = "run_id long, key string, raw string, unit string, uncertain boolean, confidence double, phone boolean, email boolean, ym string, inclusive boolean"
DECLARE = "declaration_id long, product_id long, condition_code string, answer string, updated_at timestamp"
COMPLETE = [("net_quantity", "Net Qty 500 g", "g"), ("retail_sale_price", "MRP 10", None), ("consumer_care_contact", "care", None)]


def framework(spark, unverified=()):
    return Framework(B.rule_frame(spark, unverified), spark.sql(V.links_sql()), spark.sql(V.conditions_sql()), spark.sql(V.categories_sql()))


def judge(spark, cases, unverified=()):
    """cases: list of (category, status, readings, facts); returns (verdict by run, findings by (run, rule))."""
    runs = [(k, k, k * 10, c[1], "text") for k, c in enumerate(cases, 1)]
    products = [(k, c[0]) for k, c in enumerate(cases, 1)]
    readings = [(k, *r) for k, c in enumerate(cases, 1) for r in c[2]]
    facts = [(n, k, code, a, datetime(2024, 1, 1)) for n, (k, code, a) in enumerate(
        (k, code, a) for k, c in enumerate(cases, 1) for code, a in c[3].items())]
    flat = spark.createDataFrame(readings, READ)
    one = lambda c: F.when(F.col(c), F.array(F.lit("x")))
    value = N.normalized(uncertain=F.col("uncertain"), unit=F.col("unit"), phones=one("phone"), emails=one("email"),
                         year_month=F.col("ym"), inclusive_of_all_taxes=F.col("inclusive"))
    rows = flat.select("run_id", F.monotonically_increasing_id().alias("reading_id"), F.lit(None).cast("long").alias("image_id"),
                       F.lit(1).alias("position"), F.col("key").alias("field_key"), F.col("raw").alias("raw_value"), "confidence",
                       value.alias("normalized"), F.lit(None).cast(N.BOX_TYPE).alias("box"))
    data = Inspections(
        spark.createDataFrame(runs, "run_id long, product_id long, image_id long, status string, recognised_text string"),
        spark.createDataFrame(products, "product_id long, category_code string"), rows, spark.createDataFrame(facts, DECLARE))
    rows = candidate_findings(data, framework(spark, unverified), AS_OF)
    return ({r.run_id: r.result for r in verdicts(rows).collect()},
            {(r.run_id, r.rule_code[-2:]): r.status for r in findings(rows).collect()})


def reading(key, raw, unit=None, uncertain=False, confidence=0.9, phone=True, email=True, ym=None, inclusive=None):
    return (key, raw, unit, uncertain, confidence, phone, email, ym, inclusive)


FULL = [reading(*r) for r in COMPLETE]
NO = {c: "no" for c in ("imported-product", "bidi", "domestic-lpg-cylinder", "alcoholic-beverage")}


@pytest.fixture(scope="module")
def judged(spark):
    without = lambda key: [r for r in FULL if r[0] != key]
    cases = [
        (V.FOOD, "completed", FULL, {}),                                            # 1 nothing declared
        (V.FOOD, "completed", FULL, NO),                                            # 2 complete and declared
        (V.FOOD, "completed", without("net_quantity"), NO),                         # 3 missing quantity
        (V.FOOD, "empty", FULL, NO),                                                # 4 unreadable photograph
        (V.FOOD, "completed", FULL, {**NO, "industrial-consumer": "yes"}),          # 5 out of scope
        (V.FOOD, "completed", FULL, {**NO, "quantity-10g-10ml-or-less": "yes", "tobacco-product": "yes"}),  # 6 gate withheld
        (None, "completed", FULL, NO),                                              # 7 no category
        (V.FOOD, "completed", FULL, {**NO, "imported-product": "yes"}),             # 8 imported, no origin
        (V.FOOD, "completed", without("net_quantity") + [reading("net_quantity", "Net 12 oz", "oz")], NO),   # 9 ounces
        (V.FOOD, "completed", without("consumer_care_contact") + [reading("consumer_care_contact", "care", email=False, confidence=0.3)], NO),  # 10 weak
        (V.FOOD, "completed", without("retail_sale_price") + [reading("retail_sale_price", "MRP", inclusive=False)], NO),  # 11 exclusive
        (V.FOOD, "completed", FULL, {**NO, "quantity-10g-10ml-or-less": "unknown"}),  # 12 unanswered gate
        (V.NON_FOOD, "completed", FULL + [reading("date_of_manufacture", "Mfg 5/2024", ym="2024-05", uncertain=True)],
         {**NO, "seeds-certified": "no", "cosmetics-and-toiletries": "no", "incense-sticks": "no"}),  # 13 ambiguous date
    ]
    return judge(spark, cases)


@pytest.mark.parametrize("run, expected", [
    (1, "review_required"), (2, "compliant"), (3, "partially_compliant"), (4, "review_required"), (5, "review_required"),
    (6, "compliant"), (7, "review_required"), (8, "non_compliant"), (9, "non_compliant"), (10, "review_required"),
    (11, "non_compliant"), (12, "compliant"), (13, "partially_compliant")])
def test_verdict(judged, run, expected):
    assert judged[0][run] == expected


def test_findings(judged):
    found = judged[1]
    assert found[(2, "07")] == "not_applicable" and found[(8, "07")] == "failed"
    assert found[(1, "07")] == "inconclusive"
    assert {s for (r, _), s in found.items() if r == 5} == {"not_applicable"}
    assert found[(10, "10")] == "inconclusive" and found[(13, "11")] == "inconclusive" and found[(13, "04")] == "passed"
    assert found[(3, "03")] == "failed" and found[(3, "08")] == "inconclusive"
    assert not [k for k in found if k[0] == 7]


def test_unverified_rule_never_fails(spark):
    verdict, found = judge(spark, [(V.FOOD, "completed", FULL[1:], NO)], unverified=("LM-PC-0003",))
    assert found[(1, "03")] == "inconclusive" and verdict[1] == "review_required"
