"""Queries of policy, dataset audits and the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta import vocabulary as V
from attesta.operators import audit as A, policy as P
from attesta.plans import bindings as B
from attesta.plans.catalog import ORACLES, query
from attesta.plans.oracle_core import core, core_ctes

_RAW = """
SELECT o_orderkey AS run_id, o_custkey AS product_id,
  CASE o_orderkey % 9 WHEN 0 THEN '{{"metadata": {{}}}}' WHEN 1 THEN '{{"metadata": {{"product_classification": null}}}}' WHEN 2 THEN '{{"metadata": {{"product_classification": 7}}}}'
   WHEN 3 THEN '{{"metadata": {{"product_classification": {{"category": " "}}}}}}'
   WHEN 4 THEN '{{"metadata": {{"product_classification": {{"category": "packaged-food", "confidence": true, "classifier_name": "m", "classifier_version": "1"}}}}}}'
   WHEN 5 THEN '{{"metadata": {{"product_classification": {{"category": "unknown", "classifier_name": "m", "classifier_version": "1"}}}}}}'
   ELSE concat('{{"metadata": {{"product_classification": {{"category": "', CASE WHEN o_custkey % 3 = 0 THEN 'packaged-toy' WHEN o_custkey % 3 = 1 THEN 'packaged-food' ELSE 'packaged-non-food' END,
     '", "subcategory": "', CASE o_custkey % 4 WHEN 0 THEN 'medical-device' WHEN 1 THEN 'electronic-product' WHEN 2 THEN 'alcoholic-beverage' ELSE 'general-food' END,
     '", "confidence": 0.', CAST(50 + o_orderkey % 50 AS STRING), ', "classifier_name": "', CASE WHEN o_orderkey % 2 = 0 THEN 'm' ELSE 'n' END, '", "classifier_version": "1"}}}}}}') END AS raw,
  CASE WHEN o_orderkey % 5 = 0 THEN 'packaged-food' END AS in_effect, CASE WHEN o_orderkey % 10 = 0 THEN 'classifier' ELSE 'submitter' END AS in_effect_source
FROM {orders}"""
_READ = f""", x AS ({B.duck(_RAW)}), cl AS (SELECT x.*, run_id % 9 AS k, CASE WHEN run_id % 9 > 5 THEN CASE WHEN product_id % 3 = 0 THEN 'packaged-toy' WHEN product_id % 3 = 1 THEN 'packaged-food' ELSE 'packaged-non-food' END END AS proposed,
  CASE WHEN run_id % 9 > 5 THEN CASE product_id % 4 WHEN 0 THEN 'medical-device' WHEN 1 THEN 'electronic-product' WHEN 2 THEN 'alcoholic-beverage' ELSE 'general-food' END END AS sub, CASE WHEN run_id % 9 > 5 THEN (50 + run_id % 50) / 100.0 END AS conf FROM x),
st AS (SELECT *, CASE WHEN k < 5 THEN 'failed' WHEN k = 5 THEN 'unknown' WHEN run_id % 2 = 1 OR conf < 0.8 THEN 'uncertain' ELSE 'confident' END AS status FROM cl) """


def _classified(i):
    return i.sql(_RAW).withColumn("c", P.read_classification(F.col("raw")))


def _policy(i):
    return V.inline_table(i.spark, ("artifact", "min_confidence", "evaluation"), [("m/1", 0.8, "held-out run"), ("n/1", 1.5, "broken row")])


@query("read_classification_json", core_ctes() + _READ + """
SELECT run_id, k > 4 AS usable, k > 5 AS committed, proposed AS category, CAST(conf AS DOUBLE) AS confidence,
 CASE k WHEN 0 THEN 'no classification was recorded' WHEN 1 THEN 'the classifier produced no classification' WHEN 2 THEN 'not an object' WHEN 3 THEN 'category must be a non-empty string' WHEN 4 THEN 'confidence must be a number in [0, 1]' END AS problem FROM cl""")
def read_classification_json(i):
    return _classified(i).select("run_id", "c.usable", "c.committed", "c.category", "c.confidence", "c.problem")


_ASSESS = core_ctes() + _READ + """, asd AS (SELECT run_id, product_id, sub, status, CASE WHEN in_effect IS NOT NULL THEN CASE WHEN in_effect_source = 'classifier' THEN 'established_automatically' WHEN proposed = in_effect THEN 'confirmed_by_submitter' WHEN proposed IS NOT NULL THEN 'contradicted_by_submitter' ELSE 'stated_by_submitter' END
 WHEN proposed IS NOT NULL AND proposed <> 'packaged-toy' THEN 'needs_confirmation' ELSE 'not_proposed' END AS disposition, CASE WHEN proposed <> 'packaged-toy' THEN proposed END AS proposed,
 status = 'confident' AND proposed <> 'packaged-toy' AND in_effect IS NULL AS establishes_category, in_effect IS NULL AS asks_category FROM st) """


@query("category_disposition", _ASSESS + "SELECT run_id, status, disposition, proposed, coalesce(establishes_category, FALSE) AS establishes_category FROM asd")
def category_disposition(i):
    return P.assess(_classified(i), _policy(i), i.categories).select("run_id", "status", "disposition", "proposed", "establishes_category")


_FACTS = _ASSESS + """, fd AS (SELECT a.run_id, t.condition_code, CASE WHEN f.answer IN ('yes', 'no') THEN f.answer ELSE 'unknown' END AS in_effect,
 CASE WHEN f.answer = 'yes' THEN 'confirmed_by_submitter' WHEN f.answer = 'no' THEN 'contradicted_by_submitter' WHEN c.determination = 'not_determinable' THEN 'not_proposed' ELSE 'needs_confirmation' END AS disposition
 FROM asd a JOIN (VALUES ('medical-device', 'medical-device'), ('electronic-product', 'electronic-product'), ('alcoholic-beverage', 'alcoholic-beverage')) t(s, condition_code) ON t.s = a.sub
 JOIN conditions c ON c.condition_code = t.condition_code LEFT JOIN facts f ON f.product_id = a.product_id AND f.condition_code = t.condition_code) """


def _facts(i):
    proposals = _classified(i).where("c.committed").select("run_id", "product_id", "c.subcategory")
    return P.fact_dispositions(proposals, i.taxonomy, i.conditions, i.facts.drop("updated_at"))


@query("fact_disposition", _FACTS + "SELECT * FROM fd")
def fact_disposition(i):
    return _facts(i)


@query("open_questions", _FACTS + """SELECT run_id, 'category' AS kind, proposed AS code, '' AS clauses FROM asd WHERE asks_category
UNION ALL SELECT run_id, 'condition', fd.condition_code, coalesce(k.c, '') FROM fd LEFT JOIN (SELECT condition_code, string_agg(DISTINCT clause, ', ' ORDER BY clause) AS c FROM links GROUP BY 1) k USING (condition_code) WHERE disposition = 'needs_confirmation'""")
def open_questions(i):
    return P.open_questions(P.assess(_classified(i), _policy(i), i.categories), _facts(i), i.links)


@query("declared_field_evidence", core("SELECT run_id, CAST(rank AS INT) AS rank, field_key, raw_value FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY field_key, reading_id) AS rank FROM readings) WHERE rank <= 6"))
def declared_field_evidence(i):
    return P.declared_fields(i.flat_readings)


_EX = f"WITH e AS ({B.duck(B.EXAMPLES)}), tax AS ({V.taxonomy_sql()}), lg AS ({B.duck(B.LEDGER)}), le AS ({B.duck(B.LEDGER_EXAMPLES)}) "


@query("audit_rows", _EX + """, j AS (SELECT e.*, tax.category AS tc FROM e LEFT JOIN tax USING (subcategory)),
m AS (SELECT *, concat_ws(',', CASE WHEN source_dataset IS NULL THEN 'source_dataset' END, CASE WHEN image_sha256 IS NULL THEN 'image_sha256' END) AS miss FROM j)
SELECT code, 'error' AS severity, CAST(example_id AS VARCHAR) AS subject, detail FROM (
 SELECT 'missing-label' AS code, example_id, '' AS detail FROM m WHERE subcategory = '' UNION ALL SELECT 'invalid-category', example_id, '' FROM m WHERE category NOT LIKE '%food'
 UNION ALL SELECT 'unsupported-taxonomy-value', example_id, '' FROM m WHERE category LIKE '%food' AND tc IS NULL UNION ALL SELECT 'inconsistent-taxonomy-pair', example_id, '' FROM m WHERE category LIKE '%food' AND tc <> category
 UNION ALL SELECT 'missing-provenance', example_id, miss FROM m WHERE miss <> '' UNION ALL SELECT 'missing-ocr-provenance', example_id, '' FROM m WHERE text_source = 'ocr' AND (ocr_engine IS NULL OR ocr_engine_version IS NULL)
 UNION ALL SELECT 'missing-labeller', example_id, '' FROM m WHERE labelled_by = '' UNION ALL SELECT 'machine-verifier', example_id, 'auto-' FROM m WHERE label_verified_by = 'auto-labeller'
 UNION ALL SELECT 'incomplete-verification', example_id, '' FROM m WHERE label_verified_by IS NOT NULL AND (label_verified_on IS NULL OR label_verification_ref IS NULL))""")
def audit_rows(i):
    return A.row_findings(i.examples, i.taxonomy)


@query("audit_shared_images", _EX + "SELECT 'duplicate-product' AS code, 'error' AS severity, image_sha256 AS subject, CAST(count(DISTINCT product_id) AS VARCHAR) AS detail FROM e WHERE image_sha256 IS NOT NULL GROUP BY image_sha256 HAVING count(DISTINCT product_id) > 1")
def audit_shared_images(i):
    return A.shared_images(i.examples)


@query("audit_repeated_images", _EX + "SELECT 'duplicate-image' AS code, 'error' AS severity, concat(image_sha256, '|', text_source) AS subject, CAST(count(*) AS VARCHAR) AS detail FROM e WHERE image_sha256 IS NOT NULL GROUP BY image_sha256, text_source HAVING count(*) > 1")
def audit_repeated_images(i):
    return A.repeated_images(i.examples)


@query("audit_conflicting_labels", _EX + """SELECT 'conflicting-label' AS code, 'error' AS severity, concat(product_id, '|category') AS subject, CAST(count(DISTINCT category) AS VARCHAR) AS detail FROM e GROUP BY product_id HAVING count(DISTINCT category) > 1
UNION ALL SELECT 'conflicting-label', 'error', concat(product_id, '|subcategory'), CAST(count(DISTINCT subcategory) AS VARCHAR) FROM e GROUP BY product_id HAVING count(DISTINCT subcategory) > 1""")
def audit_conflicting_labels(i):
    return A.conflicting_labels(i.examples)


@query("audit_duplicate_texts", _EX + r""", f AS (SELECT product_id, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS d FROM e WHERE length(trim(text)) > 0)
SELECT CASE WHEN count(DISTINCT product_id) > 1 THEN 'duplicate-text-across-products' ELSE 'duplicate-text-within-product' END AS code, CASE WHEN count(DISTINCT product_id) > 1 THEN 'error' ELSE 'warning' END AS severity, d AS subject, CAST(count(*) AS VARCHAR) AS detail FROM f GROUP BY d HAVING count(*) > 1""")
def audit_duplicate_texts(i):
    return A.duplicate_texts(i.examples)


@query("audit_class_coverage", _EX + "SELECT t.subcategory, t.category, count(e.example_id) AS examples, count(DISTINCT e.product_id) AS products, count(e.label_verified_by) AS verified FROM tax t LEFT JOIN e ON e.subcategory = t.subcategory GROUP BY 1, 2")
def audit_class_coverage(i):
    return A.class_coverage(i.examples, i.taxonomy)


@query("audit_thin_classes", _EX + """, c AS (SELECT t.subcategory, count(e.example_id) AS n, count(DISTINCT e.product_id) AS p FROM tax t LEFT JOIN e ON e.subcategory = t.subcategory GROUP BY 1)
SELECT CASE WHEN n = 0 THEN 'empty-class' ELSE 'single-product-class' END AS code, 'warning' AS severity, subcategory AS subject, CAST(n AS VARCHAR) AS detail FROM c WHERE p < 2""")
def audit_thin_classes(i):
    return A.thin_classes(i.examples, i.taxonomy)


@query("audit_unverified_labels", _EX + "SELECT 'unverified-labels' AS code, 'warning' AS severity, 'dataset' AS subject, CAST(count(*) AS VARCHAR) AS detail FROM e WHERE label_verified_by IS NULL HAVING count(*) > 0")
def audit_unverified_labels(i):
    return A.unverified_labels(i.examples)


_PARTS = ("audit_rows", "audit_shared_images", "audit_repeated_images", "audit_conflicting_labels", "audit_duplicate_texts", "audit_thin_classes", "audit_unverified_labels")


@query("audit_finding_totals", "SELECT severity, code, count(*) AS findings FROM (" + " UNION ALL ".join(f"SELECT severity, code FROM ({ORACLES[p]})" for p in _PARTS) + ") GROUP BY ALL")
def audit_finding_totals(i):
    return A.validate(i.examples, i.taxonomy).groupBy("severity", "code").agg(F.count(F.lit(1)).alias("findings"))


@query("audit_fold_leakage", "SELECT 'product-leakage' AS code, 'error' AS severity, source AS subject, CAST(count(DISTINCT doc_id % 3) AS VARCHAR) AS detail FROM documents GROUP BY source HAVING count(DISTINCT doc_id % 3) > 1")
def audit_fold_leakage(i):
    return A.fold_leakage(i.table("documents").select((F.col("doc_id") % 3).alias("fold"), F.col("source").alias("product_id")))


@query("ledger_problems", _EX + """SELECT ref, 'machine-verifier' AS problem FROM lg WHERE verifier = 'label script' UNION ALL SELECT ref, 'bad-date' FROM lg WHERE verified_on LIKE '%-45' UNION ALL SELECT ref, 'bad-outcome' FROM lg WHERE outcome = 'guessed'""")
def ledger_problems(i):
    return A.ledger_problems(i.ledger, i.taxonomy)


@query("ledger_reconcile", _EX + """, kn AS (SELECT * FROM lg WHERE product_id IN (SELECT product_id FROM e)), met AS (SELECT kn.*, le.example_id, le.image_sha256 AS sha, e.example_id AS ee, e.product_id AS ep, e.category AS ec, e.subcategory AS es FROM kn JOIN le USING (ref) LEFT JOIN e ON e.example_id = le.example_id)
SELECT 'ledger-unknown-product' AS code, 'error' AS severity, ref AS subject FROM lg WHERE product_id NOT IN (SELECT product_id FROM e)
UNION ALL SELECT 'ledger-unknown-example', 'error', concat(ref, '|', example_id) FROM met WHERE ee IS NULL UNION ALL SELECT 'ledger-example-product-mismatch', 'error', concat(ref, '|', example_id) FROM met WHERE ep <> product_id
UNION ALL SELECT 'ledger-label-disagreement', 'error', concat(ref, '|', example_id) FROM met WHERE outcome IN ('confirmed', 'changed') AND (ec <> category OR es <> subcategory)
UNION ALL SELECT DISTINCT 'ledger-unknown-image', 'warning', ref FROM met WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.product_id = met.product_id AND e.image_sha256 = met.sha)
UNION ALL SELECT 'verified-without-ledger-entry', 'error', CAST(example_id AS VARCHAR) FROM e WHERE label_verified_by IS NOT NULL AND example_id NOT IN (SELECT example_id FROM le)
UNION ALL SELECT 'unknown-verification-ref', 'error', CAST(example_id AS VARCHAR) FROM e WHERE label_verified_by IS NOT NULL AND example_id IN (SELECT example_id FROM le) AND coalesce(label_verification_ref, '') NOT IN (SELECT ref FROM lg)
UNION ALL SELECT DISTINCT 'ledger-entry-not-applied', 'warning', lg.ref FROM lg JOIN le USING (ref) JOIN e ON e.example_id = le.example_id WHERE outcome IN ('confirmed', 'changed') AND e.label_verified_by IS NULL""")
def ledger_reconcile(i):
    return A.reconcile(i.examples, i.ledger, i.ledger_examples).drop("detail")


@query("ledger_apply", _EX + """, d AS (SELECT le.example_id, lg.*, row_number() OVER (PARTITION BY le.example_id ORDER BY verified_on DESC, ref DESC) AS rn FROM lg JOIN le USING (ref) WHERE outcome IN ('confirmed', 'changed'))
SELECT e.example_id, coalesce(d.category, e.category) AS category, coalesce(d.subcategory, e.subcategory) AS subcategory, coalesce(d.verifier, e.label_verified_by) AS label_verified_by FROM e LEFT JOIN d ON d.example_id = e.example_id AND d.rn = 1""")
def ledger_apply(i):
    return A.apply_ledger(i.examples, i.ledger, i.ledger_examples).select("example_id", "category", "subcategory", "label_verified_by")


@query("verification_worksheet", _EX + """SELECT product_id, count(*) AS examples, count(DISTINCT image_sha256) AS images,
array_to_string(list_sort(list_distinct(list(concat(category, '/', subcategory)))), '; ') AS drafted_label, array_to_string(list_sort(list_distinct(list(example_id))), '; ') AS example_ids,
array_to_string(list_sort(list_distinct(list(image_sha256))), '; ') AS image_digests FROM e WHERE label_verified_by IS NULL GROUP BY product_id""")
def verification_worksheet(i):
    return A.verification_worksheet(i.examples).select("product_id", "examples", "images", "drafted_label", "example_ids", "image_digests")


@query("verification_summary", _EX + """SELECT count(*) AS examples, count(label_verified_by) AS verified_examples, count(DISTINCT product_id) AS products, count(DISTINCT CASE WHEN label_verified_by IS NOT NULL THEN product_id END) AS verified_products,
 (SELECT count(*) FROM lg) AS ledger_entries, (SELECT count(*) FROM lg WHERE outcome = 'confirmed') AS confirmed, (SELECT count(*) FROM lg WHERE outcome = 'changed') AS changed, (SELECT count(*) FROM lg WHERE outcome = 'unresolved') AS unresolved, (SELECT count(DISTINCT verifier) FROM lg) AS verifiers FROM e""")
def verification_summary(i):
    return A.verification_summary(i.examples, i.ledger)
