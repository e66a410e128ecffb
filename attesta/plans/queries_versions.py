"""Queries of dataset versions and framework files."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import versions as VE
from attesta.plans import bindings as B
from attesta.plans.catalog import query
from attesta.sources import framework as FW

_OLD = "SELECT doc_id, text, lang, source FROM {documents} WHERE doc_id % 7 <> 0"
_NEW = "SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN concat(text, '!') ELSE text END AS text, lang, CASE WHEN doc_id % 17 = 0 THEN CAST(NULL AS STRING) ELSE source END AS source FROM {documents} WHERE doc_id % 11 <> 0"


@query("version_changes", f"""WITH a AS ({B.duck(_OLD)}), b AS ({B.duck(_NEW)}), m AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed'
 WHEN a.text IS DISTINCT FROM b.text OR a.source IS DISTINCT FROM b.source THEN 'changed' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id) SELECT * FROM m WHERE change IS NOT NULL""")
def version_changes(i):
    return VE.changes(i.sql(_OLD), i.sql(_NEW), "doc_id")


@query("version_digests_agree", f"WITH a AS ({B.duck(_OLD)}) SELECT CAST(count(*) AS BIGINT) AS rows, TRUE AS reordered_same, FALSE AS edited_same FROM a")
def version_digests_agree(i):
    """One digest for the same rows in another order and layout, another one after a single edit."""
    old = i.sql(_OLD)
    d = lambda df: VE.version_digest(df, "doc_id").select("rows", F.col("digest").alias("d"), F.lit(1).alias("one"))
    same = d(old.select("source", "lang", "text", "doc_id").repartition("doc_id"))  # by a key with as many values as rows: no task's share grows with the table
    edited = d(old.withColumn("text", F.when(F.col("doc_id") == 1, F.concat("text", F.lit(" "))).otherwise(F.col("text"))))
    return d(old).alias("a").join(same.alias("b"), "one").join(edited.alias("c"), "one").select(
        F.col("a.rows").alias("rows"), (F.col("a.d") == F.col("b.d")).alias("reordered_same"), (F.col("a.d") == F.col("c.d")).alias("edited_same"))


_SETS = """
SELECT p_brand AS dataset, concat('v', CAST(p_size % 5 AS STRING)) AS version, concat('d', CAST((p_size % 5) + CASE WHEN max(p_partkey) % 4 = 0 THEN 100 WHEN max(p_partkey) % 4 = 1 THEN 1 ELSE 0 END AS STRING)) AS digest
FROM {part} GROUP BY p_brand, p_size % 5"""
_REGISTRY = """
SELECT DISTINCT p_brand AS dataset, concat('v', CAST(p_size % 5 AS STRING)) AS version, concat('d', CAST(p_size % 5 AS STRING)) AS digest FROM {part} WHERE NOT (p_brand = 'Brand#13' AND p_size % 5 > 2)
UNION ALL SELECT DISTINCT p_brand, 'v0', 'd7' FROM {part} WHERE p_brand = 'Brand#21'"""


@query("registry_problems", f"""WITH s AS ({B.duck(_SETS)}), r AS ({B.duck(_REGISTRY)}), n AS (SELECT dataset, version, min(digest) AS lo, max(digest) AS hi FROM r GROUP BY 1, 2), c AS (SELECT dataset, digest, min(version) AS other FROM r GROUP BY 1, 2),
p AS (SELECT s.dataset, s.version, CASE WHEN lo <> hi THEN 'ambiguous version' WHEN lo <> s.digest THEN 'edited in place' WHEN lo IS NULL AND other IS NOT NULL THEN concat('published as ', other) WHEN lo IS NULL THEN 'not registered' END AS problem
 FROM s LEFT JOIN n ON n.dataset = s.dataset AND n.version = s.version LEFT JOIN c ON c.dataset = s.dataset AND c.digest = s.digest) SELECT * FROM p WHERE problem IS NOT NULL""")
def registry_problems(i):
    return VE.registry_problems(i.sql(_SETS), i.sql(_REGISTRY))


@query("taxonomy_version_mismatches", """SELECT 'version-mismatch' AS code, 'error' AS severity, CAST(doc_id AS VARCHAR) AS subject, CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'tax-1' END AS detail FROM documents WHERE doc_id % 9 < 2""")
def taxonomy_version_mismatches(i):
    rows = i.table("documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.lit(None)).when(F.col("doc_id") % 9 == 1, "tax-1").otherwise("tax-2").alias("made_under"))
    return VE.version_mismatches(rows, "doc_id", "made_under", "tax-2")


@query("new_dataset_version", f"""WITH e AS ({B.duck(B.EXAMPLES)}), lg AS ({B.duck(B.LEDGER)}), le AS ({B.duck(B.LEDGER_EXAMPLES)})
SELECT '2026.2' AS version, max(verified_on) AS created_on, count(*) AS applied, (SELECT count(*) FROM e) AS rows FROM lg JOIN le USING (ref) WHERE outcome IN ('confirmed', 'changed') AND le.example_id IN (SELECT example_id FROM e)""")
def new_dataset_version(i):
    registry = i.spark.sql("SELECT 'set' AS dataset, '2026.1' AS version, 'x' AS digest")
    _, header = VE.new_version(i.examples, i.ledger, i.ledger_examples, "2026.1", "2026.2", registry)
    return header.drop("digest")


_RULES_JSON = """
SELECT concat('r', CAST(p_partkey AS STRING), '.json') AS file, concat('{{"_about": 1, "rules": [{{"rule_number": "', CAST(p_partkey % 40 AS STRING), '", "title": "', p_name, '", "automation_class": "',
  CASE WHEN p_partkey % 8 = 1 THEN 'magic' ELSE 'manual_review' END, '", "verification_status": "unverified", "requirements": [{{"clause": "', CAST(p_partkey AS STRING), '(1)", "title": "t", "requirement": "r", "detection_method": "ocr", ',
  '"automation_class": "manual_review", "implementation_status": "implemented", "verification_status": "', CASE WHEN p_partkey % 8 = 2 THEN 'verified' ELSE 'unverified' END, '"',
  CASE p_partkey % 8 WHEN 3 THEN ', "version": 0' WHEN 4 THEN ', "colour": "red"' WHEN 5 THEN ', "effective_from": "2024-02-30"' WHEN 6 THEN ', "is_active": "yes"' WHEN 7 THEN ', "compliance_rule_codes": ["R1", "R2"]' ELSE '' END, '}}]}}]}}') AS content FROM {part}"""


@query("framework_faults", """SELECT concat('r', p_partkey, '.json') AS file, CASE p_partkey % 8 WHEN 1 THEN '$.rules[0].automation_class' WHEN 2 THEN '$.rules[0].requirements[0].source_note' WHEN 3 THEN '$.rules[0].requirements[0].version'
 WHEN 4 THEN '$.rules[0].requirements[0]' WHEN 5 THEN '$.rules[0].requirements[0].effective_from' WHEN 6 THEN '$.rules[0].requirements[0].is_active' END AS at,
 CASE p_partkey % 8 WHEN 1 THEN 'not one of the values' WHEN 2 THEN 'missing on a verified entry' WHEN 3 THEN 'not a whole number from 1' WHEN 4 THEN 'unrecognised: colour' WHEN 5 THEN 'not a date' WHEN 6 THEN 'not true or false' END AS fault
 FROM part WHERE p_partkey % 8 BETWEEN 1 AND 6""")
def framework_faults(i):
    return FW.all_faults(i.sql(_RULES_JSON))


@query("framework_requirements", """SELECT concat('r', p_partkey, '.json') AS file, CAST(p_partkey % 40 AS VARCHAR) AS parent, concat(p_partkey, '(1)') AS clause, CASE WHEN p_partkey % 8 = 3 THEN 0 ELSE 1 END AS version, 'major' AS severity,
 CASE WHEN p_partkey % 8 = 7 THEN 'R1,R2' END AS codes FROM part""")
def framework_requirements(i):
    return FW.rows_of(i.sql(_RULES_JSON), "requirements").select("file", "parent", "clause", "version", "severity", F.array_join("compliance_rule_codes", ",").alias("codes"))
