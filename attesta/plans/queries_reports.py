"""Queries of sources, loads and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta import vocabulary as V
from attesta.functions import geometry as G, text as T
from attesta.operators import orderstats as O, reports as R, rules as RU
from attesta.plans import bindings as B, evaluation as E
from attesta.plans.catalog import query
from attesta.plans.oracle_core import core
from attesta.sources import manifests as M, rulefiles as S

_FILES = """
SELECT concat('f', CAST(p_partkey AS STRING), '.json') AS path, CASE WHEN p_partkey % 9 = 0 THEN '[1]' ELSE concat('{{"_note": "x", "code": "R', CAST(p_partkey % 1500 AS STRING), '", "title": "', p_name, '"',
  CASE WHEN p_partkey % 9 = 1 THEN '' ELSE ', "requirement": "text"' END, CASE WHEN p_partkey % 9 = 2 THEN ', "colour": "red"' ELSE '' END,
  ', "source_status": "', CASE WHEN p_partkey % 9 = 3 THEN 'maybe' ELSE 'unverified' END, '", "check_type": "', CASE WHEN p_partkey % 9 = 4 THEN 'mystery' ELSE 'si_unit' END, '"',
  CASE WHEN p_partkey % 9 = 5 THEN ', "effective_from": "2024-02-30"' ELSE '' END, CASE WHEN p_partkey % 9 = 6 THEN ', "effective_from": "2024-02-03", "effective_to": "2023-01-01"' ELSE '' END, '}}') END AS content FROM {part}"""


@query("rule_file_errors", """SELECT concat('f', p_partkey, '.json') AS path, CASE p_partkey % 9 WHEN 0 THEN 'not a JSON object' WHEN 1 THEN 'missing: requirement' WHEN 2 THEN 'unrecognised: colour' WHEN 3 THEN 'bad source_status'
 WHEN 4 THEN 'unknown check type' WHEN 5 THEN 'effective_from is not a date' ELSE 'effective_to precedes effective_from' END AS error FROM part WHERE p_partkey % 9 < 7""")
def rule_file_errors(i):
    return S.rule_errors(S.parse_rules(i.sql(_FILES)))


@query("duplicate_rule_codes", "SELECT concat('R', p_partkey % 1500) AS code, count(*) AS rows FROM part WHERE p_partkey % 9 > 0 GROUP BY 1 HAVING count(*) > 1")
def duplicate_rule_codes(i):
    return S.duplicate_keys(S.parse_rules(i.sql(_FILES)).where("rule IS NOT NULL").select("rule.code"), "code")


@query("dangling_references", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def dangling_references(i):
    return S.dangling(i.table("lineitem").select("l_orderkey", "l_partkey"), i.table("part").where("p_size > 5").select("p_partkey"), "l_partkey")


@query("upsert_actions", """SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v, CASE WHEN b.k IS NULL THEN 'kept' WHEN a.k IS NULL THEN 'created' WHEN a.v = b.v THEN 'unchanged' ELSE 'updated' END AS action
 FROM (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 > 0) a FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'NEW' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 4 > 0) b ON a.k = b.k""")
def upsert_actions(i):
    a = i.sql("SELECT c_custkey AS k, c_mktsegment AS v FROM {customer} WHERE c_custkey % 3 > 0")
    b = i.sql("SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'NEW' ELSE c_mktsegment END AS v FROM {customer} WHERE c_custkey % 4 > 0")
    return S.upsert(a, b, "k")


@query("replace_links", """SELECT l_orderkey AS clause, l_linenumber AS link FROM lineitem WHERE l_returnflag = 'A' AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
 UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'""")
def replace_links(i):
    pick = lambda f: i.table("lineitem").where(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("clause"), F.col("l_linenumber").alias("link"))
    return S.replace_links(pick("A"), pick("R"))


@query("seed_missing_categories", "SELECT category_code FROM (VALUES ('packaged-commodity'), ('packaged-food'), ('packaged-non-food')) t(category_code) WHERE category_code NOT IN (SELECT concat('packaged-', CASE WHEN r_regionkey = 0 THEN 'food' ELSE r_name END) FROM region)")
def seed_missing_categories(i):
    have = i.sql("SELECT concat('packaged-', CASE WHEN r_regionkey = 0 THEN 'food' ELSE r_name END) AS category_code FROM {region}")
    return M.seed_missing(have, i.spark.sql(V.categories_sql()).select("category_code"), "category_code")


_MANIFEST = """SELECT p_partkey AS image_id, p_partkey % 300 AS run_id, concat('p.', CASE p_partkey % 5 WHEN 0 THEN 'JPG' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' WHEN 3 THEN 'jpeg' ELSE 'gif' END) AS filename,
 CASE WHEN p_partkey % 7 = 0 THEN 'text/html' ELSE 'image/png; q=1' END AS content_type, CASE WHEN p_partkey % 11 = 0 THEN 0 WHEN p_partkey % 13 = 0 THEN 20000000 ELSE 5000 END AS size_bytes,
 CASE WHEN p_size < 5 THEN 20 WHEN p_size > 45 THEN 9000 ELSE 640 END AS width, CASE WHEN p_size > 45 THEN 9000 ELSE 480 END AS height, CASE WHEN p_partkey % 17 = 0 THEN 'inside' ELSE 'front' END AS view_type FROM {part}"""


@query("upload_gate", f"""WITH m AS ({B.duck(_MANIFEST)}) SELECT image_id, CASE WHEN filename LIKE '%gif' THEN 'unsupported_extension' WHEN content_type LIKE 'text%' THEN 'unsupported_content_type' WHEN size_bytes = 0 THEN 'empty_file'
 WHEN size_bytes > 10485760 THEN 'file_too_large' WHEN width < 32 THEN 'too_small' WHEN width = 9000 THEN 'too_many_pixels' WHEN view_type = 'inside' THEN 'unknown_view_type' END AS problem FROM m""")
def upload_gate(i):
    return M.upload_problems(i.sql(_MANIFEST)).select("image_id", "problem")


@query("oversized_inspections", "SELECT p_partkey % 300 AS run_id, count(*) AS images FROM part GROUP BY 1 HAVING count(*) > 6")
def oversized_inspections(i):
    return M.oversized_inspections(i.sql(_MANIFEST))


@query("content_digests", "SELECT doc_id, sha256(text) AS digest FROM documents")
def content_digests(i):
    return i.table("documents").select("doc_id", M.text_digest(F.replace("text", F.lit("\n"), F.lit("\r\n"))).alias("digest"))


@query("frozen_set_problems", """SELECT doc_id AS sample_id, CASE WHEN doc_id % 13 = 0 THEN 'path escapes the set' WHEN doc_id % 11 = 0 THEN 'image is missing' WHEN doc_id % 7 = 0 THEN 'annotation is missing' WHEN doc_id % 5 = 0 THEN 'sample id mismatch' ELSE 'digest mismatch' END AS problem
 FROM documents WHERE doc_id % 13 = 0 OR doc_id % 11 = 0 OR doc_id % 7 = 0 OR doc_id % 5 = 0 OR doc_id % 3 = 0""")
def frozen_set_problems(i):
    d = i.table("documents").withColumn("image", F.concat(F.when(F.col("doc_id") % 13 == 0, "../").otherwise(""), F.col("doc_id")))
    d = d.withColumn("annotation", F.concat(F.lit("a"), "doc_id")).withColumn("sha", F.sha2("text", 256))
    manifest = d.select(F.col("doc_id").alias("sample_id"), "image", "annotation", F.when(F.col("doc_id") % 3 == 0, "0").otherwise(F.col("sha")).alias("image_sha256"))
    notes = d.where("doc_id % 7 > 0").select("annotation", F.when(F.col("doc_id") % 5 == 0, -1).otherwise(F.col("doc_id")).alias("sample_id"))
    return M.frozen_set_problems(manifest, notes, d.where("doc_id % 11 > 0").select("image", F.col("sha").alias("sha256")))


@query("rows_visible_to_caller", "SELECT o_orderkey AS run_id FROM orders WHERE o_orderkey % 5 > 0 AND o_custkey % 7 = 3")
def rows_visible_to_caller(i):
    return R.visible_to(i.runs, "caller_id", F.lit(3)).select("run_id")


@query("runs_usable_by_caller", "SELECT o_orderkey AS run_id FROM orders o WHERE o_orderkey % 5 > 0 AND o_custkey % 7 = 3 AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_suppkey % 4 > 0)")
def runs_usable_by_caller(i):
    members = i.sql("SELECT l_orderkey AS run_id, CASE WHEN l_suppkey % 4 = 0 THEN 3 ELSE 5 END AS owner_id FROM {lineitem}")
    return R.usable_runs(i.runs.withColumnRenamed("caller_id", "owner_id"), members, F.lit(3)).select("run_id")


@query("counts_per_check", core("SELECT r.run_id, count(o.status) AS findings, count(*) FILTER (o.status = 'failed') AS violations FROM runs r LEFT JOIN outcomes o ON o.run_id = r.run_id GROUP BY r.run_id"))
def counts_per_check(i):
    return R.counts_per_check(E.candidate_findings(i.inspections, i.framework(), B.AS_OF))


@query("newest_orders_page", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def newest_orders_page(i):
    return R.page_after(i.table("orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@query("review_reasons", core("""SELECT run_id, rule_code, reason FROM (
 SELECT o.run_id, o.rule_code, unnest(list_filter([CASE WHEN o.decision = 'undetermined' THEN 'unresolved_conditions' END, CASE WHEN c.uncertain AND o.decision = 'applies' THEN 'uncertain_reading' END,
  CASE WHEN o.decision = 'applies' AND o.run_status <> 'completed' THEN 'unreadable_run' END], lambda x: x IS NOT NULL)) AS reason
 FROM outcomes o LEFT JOIN chosen c ON c.run_id = o.run_id AND c.field_key = o.field_key WHERE o.status = 'inconclusive')"""))
def review_reasons(i):
    return R.review_reasons(E.candidate_findings(i.inspections, i.framework(), B.AS_OF))


@query("finding_images", core("""SELECT o.run_id, o.rule_code, coalesce(CASE WHEN o.status = 'failed' THEN coalesce(c.image_id, o.run_image_id) END, CASE WHEN s.n = 1 THEN s.m END) AS image_id
 FROM outcomes o LEFT JOIN chosen c ON c.run_id = o.run_id AND c.field_key = o.field_key LEFT JOIN (SELECT run_id, field_key, count(*) AS n, min(image_id) AS m FROM readings WHERE image_id IS NOT NULL GROUP BY ALL) s ON s.run_id = o.run_id AND s.field_key = o.field_key WHERE o.status IS NOT NULL"""))
def finding_images(i):
    c = E.candidate_findings(i.inspections, i.framework(), B.AS_OF)
    return R.finding_images(E.findings(c), i.flat_readings)


@query("declaration_submission_problems", core("SELECT d.declaration_id, CASE WHEN c.determination IS NULL THEN 'unknown condition' ELSE 'not determinable' END AS problem FROM declarations d LEFT JOIN conditions c USING (condition_code) WHERE c.determination IS NULL OR c.determination = 'not_determinable'"))
def declaration_submission_problems(i):
    return R.submission_problems(i.declarations, i.conditions)


@query("conditions_that_matter", core("SELECT condition_code, count(DISTINCT d.product_id) AS products FROM conditions c LEFT JOIN declarations d USING (condition_code) WHERE determination = 'user_declared' AND condition_code IN (SELECT condition_code FROM links WHERE clause IN ('3', '26') OR clause IN (SELECT clause FROM rules WHERE is_active)) GROUP BY 1"))
def conditions_that_matter(i):
    c = R.changeable_conditions(i.conditions, i.links, i.rules())
    return c.join(i.declarations, "condition_code", "left").groupBy("condition_code").agg(F.count_distinct("product_id").alias("products"))


@query("operational_rates", "SELECT o_orderpriority AS engine, count(*) AS runs, round(count(*) FILTER (o_orderstatus = 'P' AND o_orderkey % 2 = 1) / count(*), 6) AS failure_rate, round(count(*) FILTER (o_orderstatus = 'P' AND o_orderkey % 2 = 0) / count(*), 6) AS empty_rate FROM orders GROUP BY 1")
def operational_rates(i):
    return R.operational_rates(i.runs.withColumn("engine", F.substring("recognised_text", 7, 40)))


@query("box_rescaling", """WITH b AS (SELECT p_partkey AS id, p_size * 4 AS x, p_size * 3 AS y, p_size AS w, p_size * 2 AS h FROM part), s AS (SELECT id, round_even(x * 1.5, 0) AS x, round_even(y * 0.5, 0) AS y, round_even(w * 1.5, 0) AS w, round_even(h * 0.5, 0) AS h FROM b)
 SELECT id, CAST(least(x, 199) AS INT) AS x, CAST(least(y, 99) AS INT) AS y, CAST(greatest(1, least(greatest(1, w), 200 - least(x, 199))) AS INT) AS width FROM s""")
def box_rescaling(i):
    box = F.struct((F.col("p_size") * 4).alias("x"), (F.col("p_size") * 3).alias("y"), F.col("p_size").alias("width"), (F.col("p_size") * 2).alias("height"))
    r = G.rescale_box(box, F.lit(1.5), F.lit(0.5), F.lit(200), F.lit(100))
    return i.table("part").select(F.col("p_partkey").alias("id"), r.alias("b")).select("id", "b.x", "b.y", "b.width")


@query("machine_marker", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'gpt' WHEN 1 THEN 'auto-' END AS marker FROM supplier")
def machine_marker(i):
    name = F.when(F.col("s_suppkey") % 3 == 0, "GPT drafter").when(F.col("s_suppkey") % 3 == 1, "Auto-Labeller").otherwise("A. Person")
    return i.table("supplier").select("s_suppkey", T.machine_marker(name).alias("marker"))


@query("current_requirement_versions", core("SELECT q.clause, max(q.version) AS version, count(DISTINCT c.product_id) AS products FROM requirements q JOIN rules r USING (clause) JOIN candidates c USING (rule_code) WHERE DATE '2025-01-01' BETWEEN q.effective_from AND q.effective_to GROUP BY 1"))
def current_requirement_versions(i):
    live = RU.current_requirements(i.requirements, B.AS_OF).join(i.rules().select("clause", "rule_code"), "clause")
    c = RU.candidate_rules(i.products, i.rules(), i.lineage, B.AS_OF)
    return live.join(c, "rule_code").groupBy("clause").agg(F.max("version").alias("version"), F.count_distinct("product_id").alias("products"))


_TIMED = """
SELECT o_orderkey AS run_id, concat('engine ', CAST(o_orderkey % 3 AS STRING)) AS engine, CASE WHEN o_orderkey % 4 = 0 THEN 'failed' ELSE 'completed' END AS status,
  CASE o_custkey % 5 WHEN 0 THEN 'timeout' WHEN 1 THEN CAST(NULL AS STRING) ELSE 'no_text' END AS error_code, CASE WHEN o_custkey % 11 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(o_totalprice AS DOUBLE) END AS processing_ms
FROM {orders}"""


@query("failures_by_code", f"""WITH r AS ({B.duck(_TIMED)}), n AS (SELECT engine, count(*) AS runs FROM r GROUP BY engine)
SELECT engine, coalesce(error_code, 'unknown') AS error_code, count(*) AS failures, round(count(*) / max(runs), 6) AS share FROM r JOIN n USING (engine) WHERE status = 'failed' GROUP BY 1, 2""")
def failures_by_code(i):
    return R.failures_by_code(i.sql(_TIMED))


_RANKED = """SELECT {by} count(*) AS n, round(avg(v), 2) AS mean, round((list_sort(list(v))[1 + CAST(floor((count(*) - 1) / 2) AS BIGINT)] + list_sort(list(v))[1 + CAST(ceil((count(*) - 1) / 2) AS BIGINT)]) / 2, 2) AS median,
 list_sort(list(v))[1 + CAST(floor(0.95 * (count(*) - 1)) AS BIGINT)] AS p95, max(v) AS max"""


def _two_decimals(df):
    return df.select(*[F.round(c, 2).alias(c) if c in ("mean", "median") else F.col(c) for c in df.columns])


@query("processing_times", f"WITH r AS ({B.duck(_TIMED)}) " + _RANKED.format(by="engine,") + " FROM (SELECT engine, processing_ms AS v FROM r WHERE processing_ms IS NOT NULL) GROUP BY engine")
def processing_times(i):
    return _two_decimals(R.processing_times(i.sql(_TIMED)))


@query("price_percentiles", "WITH r AS (SELECT CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem) " + _RANKED.format(by="") + " FROM r")
def price_percentiles(i):
    """One group of all lines: its order statistics come from refined ranges, not from one task's window."""
    return _two_decimals(O.summary(i.table("lineitem"), "l_extendedprice", limit=500))


_VERSIONS = """
SELECT p_partkey AS requirement_id, concat('clause ', CAST(CAST(floor((p_partkey - 1) / 40) AS BIGINT) AS STRING)) AS clause, CAST(1 + (p_partkey * 7) % 40 AS INT) AS version,
  CASE WHEN (p_partkey - 1) % 40 = 0 THEN CASE WHEN p_partkey % 240 = 41 THEN p_partkey + 39 WHEN p_partkey % 240 = 81 THEN -5 END WHEN p_partkey % 40 = 21 THEN p_partkey - 2 ELSE p_partkey - 1 END AS supersedes,
  CASE WHEN p_partkey % 97 = 0 THEN CAST(NULL AS DATE) ELSE DATE '2000-01-01' + CAST(p_size * 20 AS INT) END AS effective_from,
  CASE WHEN p_partkey % 13 = 0 THEN CAST(NULL AS DATE) ELSE DATE '2000-01-01' + CAST(p_size * 20 + p_partkey % 60 AS INT) END AS effective_to
FROM {part}"""
_CHAINS = f"""WITH RECURSIVE v AS ({B.duck(_VERSIONS)}), up AS (SELECT a.requirement_id AS id, b.requirement_id AS parent FROM v a LEFT JOIN v b ON a.supersedes = b.requirement_id),
w(id, here, depth) AS (SELECT id, id, CAST(0 AS BIGINT) FROM up UNION ALL SELECT w.id, up.parent, w.depth + 1 FROM w JOIN up ON up.id = w.here WHERE up.parent IS NOT NULL AND w.depth < 100),
e AS (SELECT w.id, w.here AS root, w.depth FROM w JOIN up ON up.id = w.here WHERE up.parent IS NULL),
chains AS (SELECT up.id AS requirement_id, e.root, e.depth, e.root IS NULL AS cyclic FROM up LEFT JOIN e USING (id)) """


@query("version_chains", _CHAINS + "SELECT * FROM chains")
def version_chains(i):
    return RU.version_chains(i.sql(_VERSIONS))


@query("version_chain_heads", _CHAINS + """, d AS (SELECT root, depth, count(*) AS n, max(requirement_id) AS last FROM chains WHERE NOT cyclic GROUP BY root, depth)
SELECT root, arg_max(last, depth) AS head, max(depth) + 1 AS length, max(n) > 1 AS forked FROM d GROUP BY root""")
def version_chain_heads(i):
    return RU.chain_heads(RU.version_chains(i.sql(_VERSIONS)))


@query("overlapping_versions", f"""WITH v AS ({B.duck(_VERSIONS)}), p AS (SELECT a.clause, a.version, a.effective_from, b.version AS open_version, coalesce(b.effective_to, DATE '9999-12-31') AS until
 FROM v a JOIN v b ON a.clause = b.clause AND (coalesce(b.effective_from, DATE '0001-01-01'), b.version) < (coalesce(a.effective_from, DATE '0001-01-01'), a.version)),
m AS (SELECT *, row_number() OVER (PARTITION BY clause, version ORDER BY until DESC, open_version DESC) AS r FROM p)
SELECT clause, version, effective_from, open_version, CASE WHEN until <> DATE '9999-12-31' THEN until END AS open_until FROM m WHERE r = 1 AND (effective_from IS NULL OR effective_from <= until)""")
def overlapping_versions(i):
    return RU.overlapping_versions(i.sql(_VERSIONS))
