"""Operator inputs derived from the driver's tables.

Each binding is one SQL text that Spark and an ANSI engine both run, so the library's input and the
oracle's input are the same rows.  ``{name}`` stands for a table; Spark substitutes DataFrames.
"""

from __future__ import annotations

import string
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from attesta import vocabulary as V
from attesta.functions import values as N
from attesta.operators import applicability as A, rules as RU
from attesta.plans.evaluation import Framework, Inspections
from attesta.session import table

AS_OF = date(2025, 1, 1)

RUNS = """
SELECT o_orderkey AS run_id, o_custkey AS product_id, o_orderkey * 10 AS image_id,
       CASE WHEN o_orderstatus <> 'P' THEN 'completed' WHEN o_orderkey % 2 = 0 THEN 'empty' ELSE 'failed' END AS status,
       concat('order ', o_orderpriority) AS recognised_text,
       CASE WHEN o_orderkey % 5 = 0 THEN CAST(NULL AS BIGINT) ELSE o_custkey % 7 END AS caller_id
FROM {orders}"""

PRODUCTS = """
SELECT c_custkey AS product_id,
       CASE WHEN c_custkey % 13 = 0 THEN CAST(NULL AS STRING) ELSE concat('nation-', CAST(c_nationkey AS STRING)) END
         AS category_code
FROM {customer}"""

CATEGORIES = V.categories_sql() + """
UNION ALL
SELECT concat('nation-', CAST(n_nationkey AS STRING)), n_name,
       CASE WHEN n_regionkey % 2 = 0 THEN 'packaged-food' ELSE 'packaged-non-food' END
FROM {nation}"""

READINGS = """
SELECT l_orderkey AS run_id, (l_partkey * 100000 + l_suppkey) * 10 + l_linenumber AS reading_id,
       CASE WHEN l_suppkey % 7 = 0 THEN CAST(NULL AS INT) ELSE CAST(1 + l_suppkey % 3 AS INT) END AS position,
       CASE WHEN l_suppkey % 7 = 0 THEN CAST(NULL AS BIGINT) ELSE l_orderkey * 10 + l_suppkey % 3 END AS image_id,
       CASE l_linenumber WHEN 1 THEN 'net_quantity' WHEN 2 THEN 'retail_sale_price' WHEN 3 THEN 'date_of_manufacture'
            WHEN 4 THEN 'consumer_care_contact' WHEN 5 THEN 'manufacturer_name' WHEN 6 THEN 'country_of_origin'
            ELSE 'importer_name' END AS field_key,
       CASE l_linenumber
            WHEN 1 THEN concat('Net Qty: ', CAST(CAST(l_quantity AS BIGINT) AS STRING), ' ',
                               CASE WHEN l_partkey % 9 = 7 THEN 'dozen' WHEN l_partkey % 9 = 8 THEN 'gross weight' ELSE 'units' END)
            WHEN 2 THEN concat('MRP Rs. ', CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING))
            WHEN 3 THEN concat('Mfg ', CAST(CAST(l_shipdate AS DATE) AS STRING))
            WHEN 4 THEN 'Customer care'
            ELSE concat('Supplier ', CAST(l_suppkey AS STRING)) END AS raw_value,
       CASE WHEN l_discount = 0 THEN CAST(NULL AS DOUBLE) ELSE round(l_discount * 10, 2) END AS confidence,
       l_returnflag = 'R' AS uncertain,
       CASE WHEN l_linenumber = 1 THEN CASE l_partkey % 9 WHEN 0 THEN 'g' WHEN 1 THEN 'kg' WHEN 2 THEN 'ml' WHEN 3 THEN 'l'
            WHEN 4 THEN 'pcs' WHEN 5 THEN 'oz' WHEN 6 THEN 'zz' WHEN 7 THEN 'g' ELSE CAST(NULL AS STRING) END END AS unit,
       CASE WHEN l_linenumber = 2 THEN CASE WHEN l_tax < 0.025 THEN FALSE WHEN l_tax < 0.055 THEN TRUE END END AS inclusive,
       CASE WHEN l_linenumber = 3 AND l_partkey % 5 <> 0
            THEN substr(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 7) END AS year_month,
       l_linenumber = 4 AND l_partkey % 3 <> 0 AS has_phone,
       l_linenumber = 4 AND l_suppkey % 3 <> 1 AS has_email
FROM {lineitem}"""

DECLARATIONS = """
SELECT event_id AS declaration_id, user_id * 10 + CAST(floor(event_id / 16) AS BIGINT) % 10 AS product_id,
       CASE WHEN event_id % 16 < 3 THEN 'imported-product' WHEN event_id % 16 < 6 THEN 'bidi'
            WHEN event_id % 16 < 9 THEN 'domestic-lpg-cylinder' WHEN event_id % 16 < 12 THEN 'alcoholic-beverage'
            ELSE CASE CAST(floor(event_id / 160) AS BIGINT) % 10
                 WHEN 0 THEN 'seeds-certified' WHEN 1 THEN 'cosmetics-and-toiletries' WHEN 2 THEN 'incense-sticks'
                 WHEN 3 THEN 'quantity-10g-10ml-or-less' WHEN 4 THEN 'tobacco-product' WHEN 5 THEN 'industrial-consumer'
                 WHEN 6 THEN 'medical-device' WHEN 7 THEN 'pan-masala' WHEN 8 THEN 'food-article'
                 ELSE 'not-a-condition' END END AS condition_code,
       CASE WHEN event_id % 97 < 8 THEN 'yes' WHEN event_id % 31 = 0 THEN 'unknown' ELSE 'no' END AS answer,
       CASE WHEN event_type = 'click' THEN 'submitter' ELSE 'reviewer' END AS source,
       ts AS updated_at
FROM {events}"""

# clause-level requirements and instruments, so the joins behind a finding have something to meet
REQUIREMENTS = V.values_sql(
    ("requirement_id", "clause", "version", "detection_method", "source", "is_active", "effective_from",
     "effective_to", "verification_status"),
    [
        (1, "6(1)(a)", 1, "ocr", "GSR-1", True, date(2011, 4, 1), date(2017, 12, 31), "verified"),
        (2, "6(1)(a)", 2, "ocr", "GSR-2", True, date(2018, 1, 1), date(2999, 12, 31), "verified"),
        (3, "6(1)(c)", 1, "ocr", "GSR-1", True, date(2011, 4, 1), date(2999, 12, 31), "verified"),
        (4, "6(1)(d)", 1, "ocr_cv", "GSR-3", True, date(2022, 10, 1), date(2999, 12, 31), "verified"),
        (5, "6(1)(e)", 1, "ocr", "GSR-3", True, date(2022, 10, 1), date(2999, 12, 31), "requires_review"),
        (6, "6(2)", 1, "manual_review", "GSR-9", True, date(2016, 1, 1), date(2999, 12, 31), "verified"),
        (7, "13(5)", 1, "cv", "GSR-3", True, date(2022, 10, 1), date(2999, 12, 31), "verified"),
        (8, "3", 1, "user_input", "GSR-1", True, date(2011, 4, 1), date(2999, 12, 31), "verified"),
        (9, "26", 1, "user_input", "GSR-1", True, date(2011, 4, 1), date(2999, 12, 31), "verified"),
        (10, "6(1)(aa)", 1, "ocr", "GSR-2", True, date(2018, 1, 1), date(2999, 12, 31), "unverified"),
    ],
)
INSTRUMENTS = V.values_sql(
    ("source", "citation"), [("GSR-1", "G.S.R. one"), ("GSR-2", "G.S.R. two"), ("GSR-3", "G.S.R. three")]
)

# printed labels rendered from orders: one label per order, one line per declaration
LABELS = """
SELECT o_orderkey AS image_id, o_custkey AS product_id,
       CAST(1 + o_orderkey % 997 AS STRING) AS qty_value,
       CASE o_orderkey % 7 WHEN 0 THEN 'g' WHEN 1 THEN 'kg' WHEN 2 THEN 'ml' WHEN 3 THEN 'L' WHEN 4 THEN 'pcs'
            WHEN 5 THEN 'mg' ELSE 'N' END AS qty_unit,
       o_orderkey % 11 = 0 AS multipack,
       CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS STRING) AS price,
       CASE o_custkey % 3 WHEN 0 THEN ' (incl. of all taxes)' WHEN 1 THEN ' exclusive of all taxes' ELSE '' END AS tax_words,
       CAST(CAST(o_orderdate AS DATE) AS STRING) AS iso_date,
       o_custkey % 5 AS date_style,
       concat('B', CAST(o_custkey AS STRING), 'X') AS batch,
       o_custkey % 4 AS contact_style,
       concat('care', CAST(o_custkey AS STRING), '@shop.example') AS email,
       CAST(1 + o_orderkey % 36 AS STRING) AS shelf_months,
       CASE o_custkey % 6 WHEN 0 THEN 'India' WHEN 1 THEN 'Sri Lanka' WHEN 2 THEN 'Republic of Korea'
            WHEN 3 THEN 'Viet Nam' WHEN 4 THEN 'Nepal' ELSE 'Japan' END AS country,
       o_orderkey % 9 AS name_style
FROM {orders}"""

LABEL_TEXT = """
SELECT image_id, concat_ws(chr(10),
  concat('Net Qty: ', CASE WHEN multipack THEN '4 x ' ELSE '' END, qty_value, ' ', qty_unit),
  concat('MRP Rs. ', price, tax_words),
  CASE date_style
    WHEN 0 THEN concat('Mfg Date: ', iso_date)
    WHEN 1 THEN concat('Mfg Date: ', substr(iso_date, 9, 2), '/', substr(iso_date, 6, 2), '/', substr(iso_date, 1, 4))
    WHEN 2 THEN concat('Mfg Date: ', substr(iso_date, 6, 2), '/', substr(iso_date, 1, 4))
    WHEN 3 THEN concat('Mfg Date:', chr(10), iso_date)
    ELSE 'Mfg Date: unreadable' END,
  concat('Best Before ', shelf_months, ' months from packing'),
  concat('Batch No: ', batch),
  CASE contact_style
    WHEN 0 THEN concat('Customer Care: ', email)
    WHEN 1 THEN concat('Customer Care:', chr(10), '1800-10-22-221', chr(10), 'write to ', upper(email), ' or ', email)
    WHEN 2 THEN 'Customer Care'
    ELSE 'Call 98765 43210' END,
  CASE WHEN name_style < 5 THEN concat('Country of Origin: ', country) ELSE concat('Made in ', country) END,
  CASE WHEN name_style < 3 THEN concat('Manufactured by: Maker ', batch)
       WHEN name_style < 6 THEN concat('Packed by:', chr(10), 'Packer ', batch)
       ELSE concat('Marketed by: Seller ', batch) END,
  concat('Unit Sale Price: Rs. ', price, ' per g')) AS text
FROM {labels_base}"""

EXAMPLES = """
SELECT d.doc_id AS example_id, concat('p', CAST(d.doc_id % 200 AS STRING)) AS product_id, d.text AS text,
       CASE WHEN d.doc_id % 4 < 2 THEN 'packaged-food' WHEN d.doc_id % 50 = 3 THEN 'packaged-toy' ELSE 'packaged-non-food' END
         AS category,
       CASE WHEN d.doc_id % 4 = 0 THEN 'general-food' WHEN d.doc_id % 4 = 1 THEN 'health-supplement'
            WHEN d.doc_id % 8 = 2 THEN 'cleaning-product' WHEN d.doc_id % 8 = 3 THEN 'other-non-food'
            WHEN d.doc_id % 24 = 6 THEN 'mystery' WHEN d.doc_id % 24 = 7 THEN '' ELSE 'medical-device' END AS subcategory,
       CASE WHEN d.doc_id % 3 = 0 THEN 'manual_transcription' ELSE 'ocr' END AS text_source,
       CASE WHEN d.doc_id % 41 = 0 THEN '' ELSE 'drafting-team' END AS labelled_by,
       CASE WHEN d.doc_id % 5 = 0 THEN 'A. Reviewer' WHEN d.doc_id % 37 = 0 THEN 'auto-labeller' END AS label_verified_by,
       CASE WHEN d.doc_id % 5 = 0 AND d.doc_id % 35 <> 0 THEN '2026-02-15' END AS label_verified_on,
       CASE WHEN d.doc_id % 5 = 0 THEN concat('ref-', CAST(d.doc_id % 60 AS STRING)) END AS label_verification_ref,
       CASE WHEN d.doc_id % 29 <> 0 THEN 'tess' END AS ocr_engine,
       CASE WHEN d.doc_id % 31 <> 0 THEN '5.4' END AS ocr_engine_version,
       CASE WHEN d.doc_id % 43 <> 0 THEN d.source END AS source_dataset,
       concat('s', CAST(d.doc_id AS STRING)) AS source_sample_id,
       CASE WHEN d.doc_id % 17 = 0 THEN CAST(NULL AS STRING) ELSE sha256(concat('img', CAST(d.doc_id % 300 AS STRING))) END
         AS image_sha256
FROM {documents} d"""

LEDGER = """
SELECT concat('ref-', CAST(s_suppkey AS STRING)) AS ref,
       concat('p', CAST(s_suppkey % 220 AS STRING)) AS product_id,
       CASE WHEN s_suppkey % 19 = 0 THEN 'label script' ELSE s_name END AS verifier,
       concat('2026-0', CAST(1 + s_suppkey % 9 AS STRING), '-', CASE WHEN s_suppkey % 23 = 0 THEN '45' ELSE '15' END) AS verified_on,
       CASE s_suppkey % 5 WHEN 0 THEN 'changed' WHEN 1 THEN 'unresolved' WHEN 2 THEN 'guessed' ELSE 'confirmed' END AS outcome,
       CASE WHEN s_suppkey % 2 = 0 THEN 'packaged-food' ELSE 'packaged-non-food' END AS category,
       CASE WHEN s_suppkey % 2 = 0 THEN 'general-food' ELSE 'other-non-food' END AS subcategory
FROM {supplier}"""

LEDGER_EXAMPLES = """
SELECT concat('ref-', CAST(s_suppkey AS STRING)) AS ref, s_suppkey % 220 + 200 * k AS example_id,
       sha256(concat('img', CAST((s_suppkey % 220 + 200 * k) % 330 AS STRING))) AS image_sha256
FROM {supplier}, (VALUES (0), (1), (2)) AS t(k)"""


def duck(sql: str, **ctes: str) -> str:
    """The oracle's form of a binding: table placeholders become plain names."""
    return string.Formatter().vformat(sql, (), _Names(ctes))


class _Names(dict):
    def __missing__(self, key):
        return key


class Inputs:
    """Lazy operator inputs over one folder of driver tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def sql(self, text: str, **extra: DataFrame) -> DataFrame:
        names = {f for _, f, _, _ in string.Formatter().parse(text) if f}
        frames = {n: extra[n] if n in extra else self.table(n) for n in names}
        return self.spark.sql(_sha(text), **frames)

    @cached_property
    def runs(self):
        return self.sql(RUNS)

    @cached_property
    def products(self):
        return self.sql(PRODUCTS)

    @cached_property
    def categories(self):
        return self.sql(CATEGORIES)

    @cached_property
    def lineage(self):
        return RU.ancestry(self.categories).persist()

    @cached_property
    def flat_readings(self):
        return self.sql(READINGS)

    @cached_property
    def readings(self):
        return structured(self.flat_readings)

    @cached_property
    def declarations(self):
        return self.sql(DECLARATIONS)

    @cached_property
    def conditions(self):
        return self.spark.sql(V.conditions_sql())

    @cached_property
    def links(self):
        return self.spark.sql(V.links_sql())

    @cached_property
    def requirements(self):
        return self.spark.sql(REQUIREMENTS)

    @cached_property
    def instruments(self):
        return self.spark.sql(INSTRUMENTS)

    def rules(self, unverified=()):
        return rule_frame(self.spark, unverified)

    @cached_property
    def facts(self):
        return A.latest_facts(self.declarations, self.conditions)

    @cached_property
    def product_answers(self):
        return A.product_answers(self.products, self.facts, self.lineage)

    def framework(self, unverified=(), with_requirements=False) -> Framework:
        req = None
        if with_requirements:
            live = self.requirements.where(RU.in_force(F.col("effective_from"), F.col("effective_to"), F.lit(AS_OF)))
            req = live.join(self.instruments, "source", "left")
        return Framework(self.rules(unverified), self.links, self.conditions, self.categories, req)

    @cached_property
    def inspections(self) -> Inspections:
        return Inspections(self.runs, self.products, self.readings, self.declarations)

    @cached_property
    def labels(self):
        return self.sql(LABELS)

    @cached_property
    def label_texts(self):
        # few large splits, much work a row
        return self.sql(LABEL_TEXT, labels_base=self.labels).repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "image_id")

    @cached_property
    def examples(self):
        return self.sql(EXAMPLES)

    @cached_property
    def ledger(self):
        return self.sql(LEDGER)

    @cached_property
    def ledger_examples(self):
        return self.sql(LEDGER_EXAMPLES)

    @cached_property
    def taxonomy(self):
        return self.spark.sql(V.taxonomy_sql())


def _sha(text: str) -> str:
    """Spark spells sha256(x) as sha2(x, 256)."""
    out, start = "", 0
    while (at := text.find("sha256(", start)) >= 0:
        depth, end = 1, at + 7
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        out += text[start:at] + "sha2(" + text[at + 7:end - 1] + ", 256)"
        start = end
    return out + text[start:]


def rule_frame(spark: SparkSession, unverified=()) -> DataFrame:
    """The shipped rules as a table."""
    keys = F.when(F.col("keys") == "", F.array().cast("array<string>")).otherwise(F.split("keys", ","))
    return spark.sql(V.rules_sql(unverified)).select(
        "rule_code", "check_type", keys.alias("field_keys"), F.array("target").alias("categories"), "clause",
        F.col("effective_from"), F.lit(None).cast("date").alias("effective_to"), "conditional", "is_active",
        "severity", "title", "source_status",
    )


def structured(flat: DataFrame) -> DataFrame:
    """Flat reading columns folded into the library's reading struct."""
    one = lambda flag, text: F.when(F.col(flag), F.array(F.lit(text)))
    norm = N.normalized(
        uncertain=F.col("uncertain"), unit=F.col("unit"), inclusive_of_all_taxes=F.col("inclusive"),
        year_month=F.col("year_month"), phones=one("has_phone", "1800 123 4567"), emails=one("has_email", "care@shop.example"),
        name=F.when(F.col("field_key").isin("manufacturer_name", "importer_name"), F.col("raw_value")),
    )
    return flat.select(
        "run_id", "reading_id", "image_id", "position", "field_key", "raw_value", "confidence",
        norm.alias("normalized"), F.lit(None).cast(N.BOX_TYPE).alias("box"),
    )
