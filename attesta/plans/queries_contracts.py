"""Queries of contracts and small predicates; the inputs break every rule somewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta import vocabulary as V
from attesta.operators import audit as A, contracts as C, readings as R
from attesta.plans import bindings as B, evaluation as E
from attesta.plans.catalog import ORACLES, query
from attesta.plans.oracle_core import core

_RUNS = """
SELECT o_orderkey AS run_id, CASE WHEN o_custkey % 17 = 0 THEN 'done' WHEN o_custkey % 17 = 1 THEN CAST(NULL AS STRING) WHEN o_custkey % 3 = 0 THEN 'partial' ELSE 'completed' END AS status,
  CASE WHEN o_custkey % 19 = 0 THEN CAST(-1 AS BIGINT) WHEN o_custkey % 19 = 1 THEN CAST(NULL AS BIGINT) WHEN o_custkey % 19 = 2 THEN CAST(2147483648 AS BIGINT) ELSE CAST(o_custkey AS BIGINT) END AS processing_ms
FROM {orders}"""
_READ = """
SELECT l_orderkey AS run_id, CASE WHEN l_partkey % 41 = 0 THEN 'weight' WHEN l_linenumber = 1 THEN 'net_quantity' ELSE 'other' END AS field_key,
  CASE WHEN l_suppkey % 43 = 0 THEN '  ' ELSE l_returnflag END AS raw_value, CASE WHEN l_partkey % 37 = 0 THEN 1.5 WHEN l_partkey % 37 = 1 THEN CAST(NULL AS DOUBLE) ELSE CAST(l_discount AS DOUBLE) END AS confidence
FROM {lineitem}"""
_CONTRACT = f"""WITH r AS ({B.duck(_RUNS)}), f AS ({B.duck(_READ)}), p AS (
 SELECT run_id, 'unknown status' AS problem FROM r WHERE status IS NULL OR status = 'done' UNION SELECT run_id, 'processing time' FROM r WHERE processing_ms IS NULL OR processing_ms < 0 OR processing_ms > 2147483647
 UNION SELECT run_id, 'unknown key' FROM f WHERE field_key = 'weight' UNION SELECT run_id, 'empty raw value' FROM f WHERE trim(raw_value) = '' UNION SELECT run_id, 'confidence' FROM f WHERE confidence > 1) """


@query("reading_contract", _CONTRACT + "SELECT CAST(run_id AS VARCHAR) AS run_id, problem FROM p")
def reading_contract(i):
    return C.reading_contract(i.sql(_RUNS), i.sql(_READ))


@query("accepted_readings", _CONTRACT + "SELECT run_id, field_key, count(*) AS readings FROM f WHERE run_id NOT IN (SELECT run_id FROM p) GROUP BY ALL")
def accepted_readings(i):
    return C.accepted_readings(i.sql(_RUNS), i.sql(_READ)).groupBy("run_id", "field_key").agg(F.count(F.lit(1)).alias("readings"))


_UNREAD = """
SELECT o_orderkey AS run_id, CASE o_custkey % 5 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN '{{"metadata": {{"unread_declarations": "none"}}}}' WHEN 2 THEN '{{"metadata": {{}}}}'
  ELSE concat('{{"metadata": {{"unread_declarations": [{{"key": "best_before", "evidence_text": "line ', CAST(o_custkey AS STRING), '"}}, 7, "x", [1], {{"key": "net_quantity"}}]}}}}') END AS raw FROM {orders}"""


@query("unread_from_raw_output", f"""WITH r AS ({B.duck(_UNREAD)}) SELECT run_id, 'best_before' AS key, concat('line ', CAST(o_custkey AS VARCHAR)) AS evidence_text FROM r JOIN orders ON run_id = o_orderkey WHERE o_custkey % 5 > 2
UNION ALL SELECT run_id, 'net_quantity', NULL FROM r JOIN orders ON run_id = o_orderkey WHERE o_custkey % 5 > 2""")
def unread_from_raw_output(i):
    return i.sql(_UNREAD).select("run_id", F.explode(C.unread_list(F.col("raw"))).alias("u")).select("run_id", "u.key", "u.evidence_text")


_CONDITIONS = """
SELECT concat('c', CAST(p_partkey % 1900 AS STRING)) AS condition_code, CASE p_partkey % 4 WHEN 0 THEN 'product_category' WHEN 1 THEN 'user_declared' WHEN 2 THEN CASE WHEN p_partkey % 8 = 2 THEN 'guessed' ELSE 'database' END ELSE 'not_determinable' END AS determination,
  CASE WHEN p_partkey % 6 < 2 THEN 'packaged-food' WHEN p_partkey % 6 = 2 THEN ' ' END AS category_code FROM {part}"""


@query("condition_problems", f"""WITH c AS ({B.duck(_CONDITIONS)}), d AS (SELECT *, coalesce(trim(category_code), '') <> '' AS named FROM c)
SELECT condition_code AS subject, 'unknown determination' AS problem FROM d WHERE determination = 'guessed' UNION ALL SELECT condition_code, 'category missing' FROM d WHERE determination = 'product_category' AND NOT named
UNION ALL SELECT condition_code, 'category not asked for' FROM d WHERE determination <> 'product_category' AND named UNION ALL SELECT condition_code, 'repeated code' FROM d GROUP BY condition_code HAVING count(*) > 1""")
def condition_problems(i):
    return C.condition_problems(i.sql(_CONDITIONS))


_REQUIREMENTS = """
SELECT p_partkey AS requirement_id, CASE WHEN p_partkey % 11 = 0 THEN 'telepathy' ELSE 'ocr' END AS detection_method, p_partkey % 7 AS version, CASE WHEN p_partkey % 2 = 0 THEN 'verified' ELSE 'unverified' END AS verification_status,
  CASE WHEN p_partkey % 3 = 0 THEN 'checked' ELSE '' END AS source_note, DATE '2020-01-01' AS effective_from, CASE WHEN p_partkey % 13 = 0 THEN DATE '2019-01-01' WHEN p_partkey % 13 = 1 THEN DATE '2020-01-01' END AS effective_to,
  CASE WHEN p_partkey % 17 = 0 THEN p_partkey WHEN p_partkey % 17 = 1 THEN p_partkey + 1000000 WHEN p_partkey % 17 = 2 THEN p_partkey - 1 END AS supersedes, CASE WHEN p_partkey % 23 = 0 THEN 'lost' ELSE 'GSR-1' END AS source FROM {part}"""


@query("requirement_problems", f"""WITH r AS ({B.duck(_REQUIREMENTS)}), x AS (SELECT CAST(requirement_id AS VARCHAR) AS subject, * FROM r)
SELECT subject, 'detection method' AS problem FROM x WHERE detection_method = 'telepathy' UNION ALL SELECT subject, 'version' FROM x WHERE version < 1 UNION ALL SELECT subject, 'verified without a note' FROM x WHERE verification_status = 'verified' AND source_note = ''
UNION ALL SELECT subject, 'window' FROM x WHERE effective_to < effective_from UNION ALL SELECT subject, 'supersedes itself' FROM x WHERE supersedes = requirement_id
UNION ALL SELECT subject, 'unknown instrument' FROM x WHERE source = 'lost' UNION ALL SELECT subject, 'unknown superseded version' FROM x WHERE supersedes IS NOT NULL AND supersedes NOT IN (SELECT requirement_id FROM r)""")
def requirement_problems(i):
    return C.requirement_problems(i.sql(_REQUIREMENTS), i.instruments)


_STATE = """
SELECT p_partkey AS requirement_id, concat('k', CAST(p_partkey % 50 AS STRING)) AS clause, CASE p_partkey % 4 WHEN 0 THEN 'ocr' WHEN 1 THEN 'cv' WHEN 2 THEN 'ocr_cv' ELSE 'physical_inspection' END AS detection_method,
  CASE WHEN p_partkey % 9 = 0 THEN 'requires_review' ELSE 'verified' END AS verification_status, p_partkey % 5 <> 0 AS is_active FROM {part}"""
_GATES = "SELECT concat('k', CAST(s_suppkey % 60 AS STRING)) AS clause, CASE s_suppkey % 4 WHEN 0 THEN 'ordinary-packaged-commodity' ELSE 'bidi' END AS condition_code FROM {supplier}"


@query("requirement_state", f"""WITH r AS ({B.duck(_STATE)}), g AS ({B.duck(_GATES)}), o AS (SELECT DISTINCT clause FROM g WHERE condition_code = 'ordinary-packaged-commodity')
SELECT requirement_id, detection_method <> 'physical_inspection' AS image_evaluable, clause NOT IN (SELECT clause FROM o) AS determinable,
  detection_method = 'physical_inspection' OR clause IN (SELECT clause FROM o) OR verification_status = 'requires_review' AS needs_review FROM r""")
def requirement_state(i):
    return C.requirement_state(i.sql(_STATE), i.sql(_GATES), i.conditions)


@query("requirement_counts", f"""WITH r AS ({B.duck(_STATE)}), g AS ({B.duck(_GATES)}) SELECT 'recorded' AS kind, count(*) AS requirements FROM r WHERE is_active
UNION ALL SELECT 'evaluated', count(*) FROM r WHERE is_active AND clause IN (SELECT clause FROM g WHERE condition_code = 'bidi')""")
def requirement_counts(i):
    return C.requirement_counts(i.sql(_STATE), i.sql(_GATES).withColumn("is_active", F.col("condition_code") == "bidi"))


@query("example_problems", f"""WITH e AS ({B.duck(B.EXAMPLES)}), tax AS ({V.taxonomy_sql()}), x AS (SELECT e.*, tax.subcategory AS ts, (coalesce(label_verified_by, '') <> '')::INT + (coalesce(label_verified_on, '') <> '')::INT + (coalesce(label_verification_ref, '') <> '')::INT AS n
  FROM e LEFT JOIN tax ON tax.category = e.category AND tax.subcategory = e.subcategory)
SELECT CAST(example_id AS VARCHAR) AS subject, problem FROM (SELECT example_id, 'taxonomy pair' AS problem FROM x WHERE ts IS NULL UNION ALL SELECT example_id, 'reader of the text' FROM x WHERE text_source = 'ocr' AND (ocr_engine IS NULL OR ocr_engine_version IS NULL)
 UNION ALL SELECT example_id, 'verification in part' FROM x WHERE n IN (1, 2) UNION ALL SELECT example_id, 'image digest' FROM x WHERE image_sha256 IS NOT NULL AND NOT regexp_full_match(image_sha256, '[0-9a-f]{{64}}'))""")
def example_problems(i):
    return C.example_problems(i.examples, i.taxonomy)


_SAMPLES = """
SELECT CASE WHEN doc_id % 31 = 0 THEN 'Bad Id' WHEN doc_id % 31 = 1 THEN concat('Set_2.', CAST(doc_id AS STRING), '-B') WHEN doc_id % 31 = 2 THEN rpad(concat('n', CAST(doc_id AS STRING), 'n'), 129, 'z') ELSE concat('s', CAST(doc_id AS STRING)) END AS sample_id, CASE WHEN doc_id % 7 = 0 THEN 'abc' ELSE sha256(CAST(doc_id AS STRING)) END AS sha256,
  CASE WHEN doc_id % 11 = 0 THEN '2026-02-30' WHEN doc_id % 11 = 1 THEN 'May' WHEN doc_id % 11 = 2 THEN CAST(NULL AS STRING) ELSE '2026-02-03' END AS captured_on,
  CASE WHEN doc_id % 13 = 0 THEN '/etc/x' WHEN doc_id % 13 = 1 THEN 'a/../b' WHEN doc_id % 13 = 2 THEN '' ELSE concat('images/', source, '..png') END AS path FROM {documents}"""


@query("sample_problems", f"""WITH s AS ({B.duck(_SAMPLES).replace("sha256(CAST(doc_id AS STRING))", "sha256(CAST(doc_id AS VARCHAR))")})
SELECT sample_id AS subject, 'id' AS problem FROM s WHERE sample_id = 'Bad Id' OR length(sample_id) > 128 UNION ALL SELECT sample_id, 'digest' FROM s WHERE sha256 = 'abc' UNION ALL SELECT sample_id, 'date' FROM s WHERE captured_on = 'May'
UNION ALL SELECT sample_id, 'path' FROM s WHERE path IN ('/etc/x', 'a/../b', '') UNION ALL SELECT sample_id, 'repeated id' FROM s GROUP BY sample_id HAVING count(*) > 1""")
def sample_problems(i):
    return C.sample_problems(i.sql(_SAMPLES.replace("sha256(CAST(doc_id AS STRING))", "sha2(CAST(doc_id AS STRING), 256)")))


@query("stated_before_check", "SELECT o_orderkey AS run_id, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey % 100 <= o_orderkey % 100 END AS stated FROM orders")
def stated_before_check(i):
    start = F.when(F.col("o_custkey") % 4 != 0, F.col("o_orderkey") % 100)
    return i.table("orders").select(F.col("o_orderkey").alias("run_id"), C.stated_before(F.col("o_custkey") % 100, start).alias("stated"))


@query("rejected_categories", "SELECT c_custkey AS submission_id, concat('nation-', CAST(c_nationkey AS VARCHAR)) AS category_code FROM customer WHERE c_nationkey % 3 = 0")
def rejected_categories(i):
    active = i.table("nation").select(F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("category_code"), (F.col("n_nationkey") % 3 != 0).alias("is_active"))
    submitted = i.table("customer").select(F.col("c_custkey").alias("submission_id"), F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("category_code"))
    return C.rejected_categories(submitted, active).select("submission_id", "category_code")


@query("first_seen_products", "SELECT source AS value, min(doc_id) AS first FROM documents GROUP BY source")
def first_seen_products(i):
    return C.first_seen(i.table("documents"), "source", "doc_id")


@query("findings_digest", f"""WITH f AS ({ORACLES["audit_shared_images"]}), g AS (SELECT *, row_number() OVER (PARTITION BY severity, code ORDER BY subject) AS r FROM f)
SELECT severity, code, count(*) AS findings, concat(string_agg(subject, ', ' ORDER BY subject) FILTER (r <= 5), CASE WHEN count(*) > 5 THEN ', ...' ELSE '' END) AS subjects FROM g GROUP BY severity, code""")
def findings_digest(i):
    return C.findings_digest(A.shared_images(i.examples))


@query("result_graph", core("""SELECT run_id, listed AS fields FROM (SELECT l_orderkey AS run_id, string_agg(concat(CASE l_linenumber WHEN 1 THEN 'net_quantity' WHEN 2 THEN 'retail_sale_price' WHEN 3 THEN 'date_of_manufacture'
 WHEN 4 THEN 'consumer_care_contact' WHEN 5 THEN 'manufacturer_name' WHEN 6 THEN 'country_of_origin' ELSE 'importer_name' END), ',' ORDER BY CASE l_linenumber WHEN 1 THEN 'net_quantity' WHEN 2 THEN 'retail_sale_price' WHEN 3 THEN 'date_of_manufacture'
 WHEN 4 THEN 'consumer_care_contact' WHEN 5 THEN 'manufacturer_name' WHEN 6 THEN 'country_of_origin' ELSE 'importer_name' END) AS listed FROM lineitem GROUP BY l_orderkey)"""))
def result_graph(i):
    """Checks with all that belongs to them; the finding and violation lists are held against their own queries in the tests."""
    c = E.candidate_findings(i.inspections, i.framework(), B.AS_OF)
    g = C.result_graph(i.runs.select("run_id"), E.findings(c), E.violations(c), i.flat_readings)
    return g.where(F.size("fields") > 0).select("run_id", F.array_join(F.transform("fields", lambda f: f["field_key"]), ",").alias("fields"))


_REPORTS = """
SELECT l_orderkey AS run_id, l_linenumber AS position, CASE WHEN l_orderkey % 3 = 0 THEN CAST(NULL AS STRING) WHEN l_linenumber % 2 = 0 THEN '' ELSE concat('k', CAST(l_linenumber AS STRING), ',m', CAST(l_linenumber AS STRING)) END AS listed FROM {lineitem}"""


@query("merge_unread_lists", f"""WITH r AS ({B.duck(_REPORTS)}) SELECT run_id, coalesce(string_agg(CASE WHEN listed <> '' THEN listed END, ',' ORDER BY position), '') AS unread FROM r WHERE listed IS NOT NULL GROUP BY run_id""")
def merge_unread_lists(i):
    """Lists of all photographs of a run; a run whose photographs report empty lists keeps an empty one."""
    listed = F.when(F.col("listed") == "", F.array().cast("array<string>")).otherwise(F.split("listed", ","))
    reports = i.sql(_REPORTS).select("run_id", "position", F.when(F.col("listed").isNotNull(), listed).alias("unread"))
    return R.merge_unread(reports).select("run_id", F.array_join("unread", ",").alias("unread"))
