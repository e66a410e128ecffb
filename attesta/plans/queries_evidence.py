"""Queries of recorded evidence strings, of what supports a suggestion, and of reports laid out as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta import vocabulary as V
from attesta.operators import audit as A, classify as M, contracts as C, evidence as E, policy as P, reports as R
from attesta.plans import bindings as B, evaluation as EV
from attesta.plans.catalog import query
from attesta.plans.oracle_core import core, core_ctes
from attesta.plans.queries_quality import _BIAS, _CLASSES, _SCORES, _toy_model


def _signals_sql(cleaned: str, limit: int) -> str:
    """DuckDB list of the first signals (phrase, indicative_of) of a cleaned text."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    hits = ", ".join(
        f"CASE WHEN regexp_matches({cleaned}, {quote(p)}) THEN {{'phrase': {quote(n)}, 'indicative_of': {quote(k)}}} END" for n, k, p in V.SIGNALS)
    return f"list_filter([{hits}], lambda s: s IS NOT NULL)[1:{limit}]"


@query("classification_evidence", _SCORES + rf""", g AS (SELECT t.doc_id, len(t.k) AS tokens, known, a + b AS food, c + e AS non_food, a, b, c, e FROM t LEFT JOIN pr USING (doc_id)),
h AS (SELECT *, greatest(food, non_food) AS m, CASE WHEN food > non_food THEN 'packaged-food' ELSE 'packaged-non-food' END AS cat,
  CASE WHEN food > non_food THEN CASE WHEN a > b THEN 'general-food' ELSE 'health-supplement' END ELSE CASE WHEN e > c THEN 'cleaning-product' ELSE 'cosmetics-and-toiletries' END END AS sub,
  CASE WHEN food > non_food THEN greatest(a, b) ELSE greatest(c, e) END AS sm FROM g),
o AS (SELECT *, CASE WHEN tokens < 3 THEN 'insufficient text' WHEN known IS NULL THEN 'no known term' WHEN m < 0.6 THEN 'below category threshold' WHEN sm < 0.5 THEN 'subcategory below threshold' ELSE 'committed' END AS reason FROM h),
ws AS (SELECT doc_id, term, tf * idf AS x, length(term) AS n FROM c JOIN f USING (term)), nm AS (SELECT doc_id, sqrt(sum(x * x)) AS nrm FROM ws GROUP BY doc_id),
co AS (SELECT ws.doc_id, term, sub, round(x / nrm * ((n * CASE sub WHEN 'general-food' THEN 1 WHEN 'health-supplement' THEN 2 WHEN 'cosmetics-and-toiletries' THEN 3 ELSE 5 END) % 7 - 3), 6) AS v
  FROM ws JOIN nm ON nm.doc_id = ws.doc_id JOIN o ON o.doc_id = ws.doc_id WHERE reason IN ('committed', 'subcategory below threshold')),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY v DESC, term) AS r FROM co WHERE v > 0),
te AS (SELECT doc_id, list(concat('term: ''', term, ''' weighed for ', sub) ORDER BY r) AS l FROM rk WHERE r <= 6 GROUP BY doc_id),
sg AS (SELECT doc_id, list_transform({_signals_sql("lower(regexp_replace(text, '\\s+', ' ', 'g'))", 8)}, lambda s: concat('signal: ', s.phrase, ' (typical of ', s.indicative_of, ')')) AS l FROM documents),
ev AS (SELECT o.doc_id, reason, list_concat(CASE reason WHEN 'insufficient text' THEN [printf('insufficient text: %d word token(s), fewer than the 3 required', tokens)]
   WHEN 'no known term' THEN [printf('insufficient evidence: none of the %d word token(s) is known to the model', tokens)]
   WHEN 'below category threshold' THEN [printf('below confidence threshold 0.60: best candidate %s (%.2f)', cat, m)]
   WHEN 'subcategory below threshold' THEN [printf('subcategory below threshold 0.50: best candidate %s (%.2f)', sub, sm)] ELSE [] END,
  CASE WHEN reason IN ('insufficient text', 'no known term') THEN [] ELSE sg.l END, coalesce(te.l, [])) AS evidence FROM o JOIN sg USING (doc_id) LEFT JOIN te USING (doc_id))
SELECT doc_id, reason, CAST(len(evidence) AS INT) AS strings, array_to_string(evidence, '; ') AS evidence FROM ev""")
def classification_evidence(i):
    """Why each document was classified as it was, in the classifier's words."""
    d = i.table("documents")
    counts = M.block_counts(M.in_blocks(d))
    model = _toy_model(M.block_idf(counts, d.agg(F.count(F.lit(1)).alias("n"))))
    return E.recorded_strings(d, counts, model, _BIAS, _CLASSES).select("doc_id", "reason", F.size("evidence").alias("strings"), F.array_join("evidence", "; ").alias("evidence"))


# A third of the runs have no text; classifications carry proper, malformed, missing and too many strings.
_SUPPORT = """
SELECT o_orderkey AS run_id, CASE o_orderkey % 6 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN ' ' WHEN 2 THEN concat('Net order ', o_orderpriority)
    WHEN 3 THEN concat('Bathing   BAR with milk ', o_orderpriority) WHEN 4 THEN concat('rice flour, soap and shampoo, hair cream, floor cleaner spray, tablets ', o_orderstatus) ELSE concat('no. ', o_orderpriority) END AS recognised_text,
  CASE WHEN o_orderkey % 7 = 0 THEN '{{"metadata": {{}}}}' ELSE concat('{{"metadata": {{"product_classification": {{"category": "packaged-food", "confidence": 0.7, "classifier_name": "m", "classifier_version": "1", "evidence": [',
    CASE o_orderkey % 7 WHEN 1 THEN '' WHEN 2 THEN '"term: x weighed for y", "term: ", "signal: soap"' WHEN 3 THEN concat('"signal: z", "term: ''', o_orderpriority, ''' weighed for general-food", "term: '''' weighed for y"')
      ELSE '"term: ''a'' weighed for s", "term: ''b c'' weighed for s", "term: ''d'' weighed for s", "term: ''e'' weighed for s", "term: ''f'' weighed for s", "term: ''g'' weighed for s"' END, ']}}}}}}') END AS raw
FROM {orders}"""


@query("supporting_evidence", core_ctes() + rf""", x AS ({B.duck(_SUPPORT)}), cl AS (SELECT run_id, lower(trim(regexp_replace(coalesce(recognised_text, ''), '\s+', ' ', 'g'))) AS x FROM x),
sg AS (SELECT run_id, x, {_signals_sql('x', 6)} AS l FROM cl),
fl AS (SELECT run_id, trim(raw_value) AS v, field_key, row_number() OVER (PARTITION BY run_id ORDER BY field_key, reading_id) AS r FROM readings WHERE run_id % 5 <> 1 AND trim(raw_value) <> ''),
fd AS (SELECT run_id, string_agg(concat(field_key, '=', v), '; ' ORDER BY r) AS fields FROM fl WHERE r <= 6 GROUP BY run_id)
SELECT x.run_id, array_to_string(list_transform(l, lambda s: concat(s.phrase, ' > ', s.indicative_of)), '; ') AS signals, coalesce(fields, '') AS fields,
 CASE WHEN x.run_id % 7 IN (0, 1, 2) THEN '' WHEN x.run_id % 7 = 3 THEN o_orderpriority ELSE 'a; b c; d; e; f' END AS terms, (len(l) > 0 OR fields IS NOT NULL) AS supported,
 CASE WHEN len(l) > 0 OR fields IS NOT NULL THEN '' WHEN sg.x <> '' THEN '{E.NOTHING_FOUND}' ELSE '{E.NOTHING_READ}' END AS note
FROM x JOIN sg USING (run_id) JOIN orders ON o_orderkey = x.run_id LEFT JOIN fd ON fd.run_id = x.run_id""")
def supporting_evidence(i):
    """Every run's signals, declared fields and model terms, or a note that there is nothing."""
    runs = i.sql(_SUPPORT).withColumn("c", P.read_classification(F.col("raw")))
    e = E.supporting(runs, i.flat_readings.where("run_id % 5 <> 1"))
    return e.select(
        "run_id", F.array_join(F.transform("label_signals", lambda s: F.concat_ws(" > ", s["phrase"], s["indicative_of"])), "; ").alias("signals"),
        F.array_join(F.transform("declared_fields", lambda f: F.concat_ws("=", f["field_key"], f["value"])), "; ").alias("fields"),
        F.array_join("model_terms", "; ").alias("terms"), F.col("has_supporting_evidence").alias("supported"), "note")


@query("worksheet_lines", f"""WITH e AS ({B.duck(B.EXAMPLES)}), o AS (SELECT * FROM e WHERE label_verified_by IS NULL)
SELECT DISTINCT product_id, 'example' AS line, CAST(example_id AS VARCHAR) AS value FROM o WHERE example_id IS NOT NULL UNION SELECT product_id, 'image', image_sha256 FROM o WHERE image_sha256 IS NOT NULL
UNION SELECT product_id, 'drafted_label', concat_ws('/', category, subcategory) FROM o""")
def worksheet_lines(i):
    return A.worksheet_lines(i.examples)


@query("result_rows", core("""
SELECT run_id, 'run' AS part, CAST(run_id AS VARCHAR) AS item, status AS value FROM runs UNION ALL SELECT run_id, 'image', CAST(image_id AS VARCHAR), NULL FROM runs WHERE image_id IS NOT NULL
UNION ALL SELECT r.run_id, 'product', CAST(r.product_id AS VARCHAR), p.category_code FROM runs r LEFT JOIN products p USING (product_id) WHERE r.product_id IS NOT NULL
UNION ALL SELECT run_id, 'finding', rule_code, status FROM outcomes WHERE status IS NOT NULL
UNION ALL SELECT o.run_id, 'violation', o.rule_code, o.severity FROM outcomes o WHERE o.status = 'failed'
UNION ALL SELECT o.run_id, 'evidence', o.rule_code, CAST(coalesce(c.image_id, r.image_id) AS VARCHAR) FROM outcomes o JOIN runs r USING (run_id) LEFT JOIN chosen c ON c.run_id = o.run_id AND c.field_key = o.field_key
  WHERE o.status = 'failed' AND coalesce(c.image_id, r.image_id) IS NOT NULL
UNION ALL SELECT run_id, 'field', concat_ws('/', field_key, reading_id), raw_value FROM readings"""))
def result_rows(i):
    """Every check with its run, image, product, findings, violations, evidence and fields."""
    c = EV.candidate_findings(i.inspections, i.framework(), B.AS_OF)
    return C.result_rows(i.runs, i.products, EV.pictured(EV.findings(c)), i.flat_readings)


# Submissions meet their conditions: the catalogue's links, per product that has stated the condition.
_REQUIREMENTS = "SELECT DISTINCT clause, clause <> '18(1)' AS is_active FROM links"


@query("condition_catalogue", core(f""", rq AS ({_REQUIREMENTS}), rc AS (SELECT clause, string_agg(DISTINCT rule_code, ',' ORDER BY rule_code) AS codes FROM rules WHERE is_active GROUP BY 1),
ln AS (SELECT DISTINCT condition_code, clause, mode, rc.codes FROM conditions c JOIN links l USING (condition_code) JOIN rq USING (clause) LEFT JOIN rc USING (clause)
 WHERE c.is_active AND rq.is_active AND determination = 'user_declared' AND (clause IN ('3', '26') OR rc.codes IS NOT NULL)),
sc AS (SELECT condition_code, CASE WHEN bool_or(clause IN ('3', '26')) THEN 'rules' ELSE 'clause' END AS scope FROM ln GROUP BY 1),
st AS (SELECT condition_code, count(DISTINCT product_id) AS products FROM declarations GROUP BY 1)
SELECT condition_code, scope, clause, mode, concat('rule ', clause, ': ', mode) AS note, coalesce(codes, '') AS rule_codes, coalesce(products, 0) AS products FROM ln JOIN sc USING (condition_code) LEFT JOIN st USING (condition_code)"""))
def condition_catalogue(i):
    """What each stateable condition bears on, with the number of products it is stated of."""
    links = i.links.withColumn("note", F.concat(F.lit("rule "), F.col("clause"), F.lit(": "), F.col("mode")))
    requirements = i.links.select("clause", (F.col("clause") != "18(1)").alias("is_active")).distinct()
    stated = i.declarations.groupBy("condition_code").agg(F.count_distinct("product_id").alias("products"))
    c = R.condition_catalogue(i.conditions, links, i.rules(), requirements)
    return c.join(stated, "condition_code", "left").withColumn("products", F.coalesce("products", F.lit(0)))


@query("created_products", core("""SELECT concat('run:', run_id) AS product_key, CASE WHEN run_id % 7 = 0 THEN 'packaged-food' ELSE 'packaged-non-food' END AS category_code, CASE WHEN run_id % 7 = 0 THEN 'stated_category' ELSE 'classifier' END AS origin
FROM runs WHERE run_id % 3 <> 0 AND product_id % 2 <> 0 AND (run_id % 7 = 0 OR run_id % 5 = 0)"""))
def created_products(i):
    """New product rows of submissions that have none: for a stated category, else for one that the classifier settles."""
    requests = i.runs.select(
        "run_id", "image_id", F.when(F.col("run_id") % 3 == 0, F.col("product_id")).alias("explicit_product_id"),
        F.when(F.col("run_id") % 7 == 0, F.lit(V.FOOD)).alias("stated_category"))
    images = i.runs.where(F.col("product_id") % 2 == 0).select("image_id", "product_id")
    settled = i.runs.where("run_id % 5 = 0").select("run_id", F.lit(V.NON_FOOD).alias("category_code"))
    return P.created_products(requests, images, settled)[0].drop("name")
