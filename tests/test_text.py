"""Normalisers, detectors and edit distance on small inputs, against plain Python where one exists."""

import unicodedata

from pyspark.sql import functions as F

from attesta.functions import text as T, values as N
from attesta.operators import detect as D


def column(spark, values, build, names="v string"):
    rows = [(n, *(v if isinstance(v, tuple) else (v,))) for n, v in enumerate(values)]
    df = spark.createDataFrame(rows, "n int, " + names)
    return [r.out for r in df.select("n", build(df).alias("out")).orderBy("n").collect()]


def test_normalise_text(spark):
    given = ["  Net   Qty \n 500 g ", "５００ ｇ", "ﬁg", None, ""]
    want = [" ".join(unicodedata.normalize("NFKC", v or "").split()) for v in given]
    assert column(spark, given, lambda d: T.normalise_text(d.v)) == want


def test_parse_decimal(spark):
    got = column(spark, ["500", "2.5", "1,000", "1,00,000", "12,5", "abc", ""], lambda d: N.parse_decimal(d.v).cast("double"))
    assert got == [500, 2.5, 1000, 100000, None, None, None]


def test_dates(spark):
    got = column(spark, ["05/05/2025", "31/12/24", "31/02/2025", "06/2026", "12 Mar 2025", "9 months", "x"], lambda d: N.date_in(d.v))
    assert got[0].uncertain and len(got[0].candidates) == 2 and got[0].date is None
    assert got[1].date == "2024-12-31" and got[2].uncertain and got[2].date is None
    assert got[3].year_month == "2026-06" and got[4].date == "2025-03-12"
    assert (got[5].duration_value, got[5].duration_unit) == (9.0, "months") and got[6] is None


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_word_distance_both_paths(spark):
    pairs = [("a b c d", "a x c"), ("", "a b"), ("a a b", "b a a"), (" ".join(map(str, range(7000))), " ".join(map(str, range(3, 7003))))]
    got = column(spark, pairs, lambda d: T.word_levenshtein(
        F.filter(F.split(d.v, " "), lambda w: w != ""), F.filter(F.split(d.w, " "), lambda w: w != "")), "v string, w string")
    assert got[:3] == [distance(a.split(), b.split()) for a, b in pairs[:3]]
    assert got[3] == 6


def readings(spark, *labels):
    df = spark.createDataFrame(list(enumerate(labels)), "image_id long, text string")
    lines = D.lines_from_text(df)
    return lines, {(r.image_id, r.field_key): r for r in D.extract(lines).collect()}


def test_labels(spark):
    lines, got = readings(
        spark,
        "Net Qty: 500 g\nMRP Rs. 1500 (incl. of all taxes)\nMFG 12/2024 EXP 12/2026\nBatch No. & Use By Date",
        "NET CONTENTS 4 UNITS X 125 g + 125 g FREE\nper 100 g energy 50 kcal\nUSP: Rs.0.93/g",
        "MRP\nMade in a facility that also processes nuts\nMade in India\nManufactured by: #\n3M India",
        "Rs. 20 per kg\nPacked by ACME\nNSP x :350.00/23.33")
    assert got[0, "net_quantity"].normalized.base_quantity == 500
    assert got[0, "retail_sale_price"].normalized.amount == "1500" and got[0, "retail_sale_price"].normalized.inclusive_of_all_taxes
    assert got[0, "date_of_manufacture"].normalized.year_month == "2024-12" and got[0, "best_before"].normalized.year_month == "2026-12"
    assert (0, "batch_number") not in got
    assert got[1, "net_quantity"].conflicts == 2 and got[1, "net_quantity"].normalized.uncertain
    assert got[1, "unit_sale_price"].normalized.per_unit == "g" and (1, "retail_sale_price") not in got
    assert (2, "retail_sale_price") not in got and got[2, "country_of_origin"].normalized.country_text == "India"
    assert got[2, "manufacturer_name"].normalized.name == "3M India"
    assert got[3, "retail_sale_price"].normalized.amount == "350.00" and got[3, "retail_sale_price"].normalized.uncertain
    unread = {(r.image_id, r.field_key) for r in D.unread_declarations(lines, D.extract(lines)).collect()}
    assert (2, "retail_sale_price") in unread and (0, "batch_number") in unread
