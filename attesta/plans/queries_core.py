"""Queries of the rule evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta import vocabulary as V
from attesta.functions import values as N
from attesta.operators import applicability as A, checks as C, readings as R, rules as RU
from attesta.plans import bindings as B, evaluation as E
from attesta.plans.catalog import query
from attesta.plans.oracle_core import core

_VERDICT = ("run_id", "product_id", "category_code", "run_status", "applicable", "evaluated", "passed", "failed",
            "inconclusive", "not_applicable", "result", "summary")


@query("verdict_per_run", core(f"SELECT {', '.join(_VERDICT)} FROM verdicts"))
def verdict_per_run(i):
    return E.verdicts(E.candidate_findings(i.inspections, i.framework(), B.AS_OF)).select(*_VERDICT)


@query("verdict_totals", core(
    "SELECT result, summary, count(*) AS runs, CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(passed) AS BIGINT) AS passed "
    "FROM verdicts GROUP BY result, summary"))
def verdict_totals(i):
    v = E.verdicts(E.candidate_findings(i.inspections, i.framework(), B.AS_OF))
    return v.groupBy("result", "summary").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("failed").alias("failed"), F.sum("passed").alias("passed"))


@query("finding_snapshot", core("""
SELECT o.run_id, o.rule_code, coalesce(o.clause, '') AS clause, o.title, o.severity, o.check_type, o.decision, o.status,
       o.downgraded, CASE WHEN o.decision = 'undetermined' THEN coalesce(o.unresolved, '') ELSE '' END AS unresolved, o.field_key, c.reading_id,
       coalesce(c.raw_value, '') AS raw_value, c.confidence,
       coalesce(q.detection_method, '') AS detection_method, coalesce(n.citation, '') AS citation
FROM outcomes o LEFT JOIN chosen c ON c.run_id = o.run_id AND c.field_key = o.field_key
LEFT JOIN requirements q ON q.clause = o.clause AND DATE '2025-01-01' BETWEEN q.effective_from AND q.effective_to
LEFT JOIN instruments n ON n.source = q.source
WHERE o.status IS NOT NULL""", ("LM-PC-0009",)))
def finding_snapshot(i):
    f = E.findings(E.candidate_findings(
        i.inspections, i.framework(unverified=("LM-PC-0009",), with_requirements=True), B.AS_OF))
    return f.select(
        "run_id", "rule_code", "clause", "title", "severity", "check_type", "decision", "status",
        F.col("downgraded_from_failed").alias("downgraded"),
        F.array_join(F.coalesce("unresolved_conditions", F.array()), ",").alias("unresolved"), "field_key", "reading_id",
        F.col("extracted_raw_value").alias("raw_value"), F.col("extracted_confidence").alias("confidence"),
        "detection_method", F.col("legal_source_citation").alias("citation"))


@query("violations_with_evidence", core("""
SELECT o.run_id, o.rule_code, o.severity, o.field_key, c.reading_id,
       coalesce(c.image_id, o.run_image_id) AS evidence_image_id,
       CASE WHEN c.raw_value IS NOT NULL THEN c.raw_value ELSE o.recognised_text END AS excerpt
FROM outcomes o LEFT JOIN chosen c ON c.run_id = o.run_id AND c.field_key = o.field_key WHERE o.status = 'failed'"""))
def violations_with_evidence(i):
    return E.violations(E.candidate_findings(i.inspections, i.framework(), B.AS_OF)).select(
        "run_id", "rule_code", "severity", "field_key", "reading_id", "evidence_image_id",
        F.col("evidence_excerpt").alias("excerpt"))


@query("unverified_rule_downgrade", core(
    "SELECT run_id, rule_code, status, downgraded FROM outcomes WHERE rule_code IN ('LM-PC-0003', 'LM-PC-0008') AND status IS NOT NULL",
    ("LM-PC-0003", "LM-PC-0008")))
def unverified_rule_downgrade(i):
    f = E.candidate_findings(i.inspections, i.framework(unverified=("LM-PC-0003", "LM-PC-0008")), B.AS_OF)
    return f.where(F.col("rule_code").isin("LM-PC-0003", "LM-PC-0008")).select(
        "run_id", "rule_code", "status", F.col("downgraded_from_failed").alias("downgraded"))


@query("category_ancestry", core("SELECT category_code, ancestor_code, CAST(depth AS INT) AS depth FROM ancestry"))
def category_ancestry(i):
    return i.lineage


@query("products_per_ancestor", core(
    "SELECT ancestor_code, count(*) AS products FROM lineage GROUP BY ancestor_code"))
def products_per_ancestor(i):
    return i.products.join(i.lineage, "category_code").groupBy("ancestor_code").agg(F.count(F.lit(1)).alias("products"))


@query("candidate_rules_per_product", core("SELECT product_id, rule_code FROM candidates"))
def candidate_rules_per_product(i):
    return RU.candidate_rules(i.products, i.rules(), i.lineage, B.AS_OF)


@query("rules_in_force_by_order_date", f"""
WITH rules AS ({V.rules_sql()})
SELECT r.rule_code, count(*) AS orders FROM orders o JOIN rules r
  ON r.is_active AND CAST(o.o_orderdate + INTERVAL 20 YEAR AS DATE) >= r.effective_from GROUP BY r.rule_code""")
def rules_in_force_by_order_date(i):
    # one row per distinct date first: the range condition then meets few rows, not every order
    days = i.table("orders").groupBy(F.expr("CAST(o_orderdate + INTERVAL 20 YEAR AS DATE)").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    live = i.rules().where("is_active")
    hit = RU.in_force(F.col("effective_from"), F.col("effective_to"), F.col("day"))
    return days.join(live, hit).groupBy("rule_code").agg(F.sum("n").alias("orders"))


@query("rule_requirement_instrument", core("""
SELECT r.rule_code, r.clause, count(DISTINCT c.product_id) AS products, max(coalesce(q.detection_method, '')) AS detection_method,
       max(coalesce(n.citation, '')) AS citation
FROM rules r LEFT JOIN requirements q ON q.clause = r.clause AND DATE '2025-01-01' BETWEEN q.effective_from AND q.effective_to
LEFT JOIN instruments n ON n.source = q.source LEFT JOIN candidates c ON c.rule_code = r.rule_code
GROUP BY r.rule_code, r.clause"""))
def rule_requirement_instrument(i):
    live = i.requirements.where(RU.in_force(F.col("effective_from"), F.col("effective_to"), F.lit(B.AS_OF)))
    ctx = RU.rule_context(i.rules(), live.select("clause", "detection_method", "source"), i.instruments)
    n = RU.candidate_rules(i.products, i.rules(), i.lineage, B.AS_OF).groupBy("rule_code").agg(
        F.count(F.lit(1)).alias("products"))
    return ctx.join(n, "rule_code", "left").select(
        "rule_code", "clause", F.coalesce("products", F.lit(0)).alias("products"), "detection_method", "citation")


@query("latest_stated_fact", core("SELECT product_id, condition_code, answer, updated_at FROM facts"))
def latest_stated_fact(i):
    return i.facts


@query("condition_answers", core("SELECT product_id, condition_code, answer FROM answers"))
def condition_answers(i):
    return A.condition_answers(i.product_answers, i.lineage, i.conditions)


@query("scope_decision", core(
    "SELECT product_id, CASE WHEN out_of_scope THEN 'does_not_apply' ELSE 'applies' END AS scope FROM scopes"))
def scope_decision(i):
    return A.scope_decisions(i.product_answers, i.lineage, i.links, i.conditions)


@query("clause_decision", core("""
SELECT d.product_id, d.clause, d.decision, coalesce(u.codes, '') AS unresolved
FROM decisions d LEFT JOIN unresolved u ON u.product_id = d.product_id AND u.clause = d.clause"""))
def clause_decision(i):
    d = A.clause_decisions(i.product_answers, i.lineage, i.links, i.conditions)
    return d.select("product_id", "clause", "decision",
                    F.array_join(F.coalesce("unresolved", F.array()), ",").alias("unresolved"))


@query("applicability_note", core(f"""
SELECT d.product_id, d.clause, concat('clause ', d.clause,
         CASE WHEN d.decision = 'undetermined' THEN concat(' undetermined: ', replace(u.codes, ',', ', '))
              WHEN h.name IS NOT NULL THEN concat(' ', d.decision, ': ', h.name) ELSE concat(' ', d.decision) END,
         chr(10), chr(10), '{A.NO_CAVEAT_CLAUSES}') AS note
FROM decisions d LEFT JOIN unresolved u ON u.product_id = d.product_id AND u.clause = d.clause
LEFT JOIN (
  SELECT l.product_id, l.clause, arg_min(l.condition_name, l.link_order) AS name
  FROM linked l JOIN decisions d USING (product_id, clause) JOIN flags f USING (product_id, clause)
  WHERE l.answer = 'yes' AND l.mode = CASE WHEN f.gates AND f.w_yes THEN 'withholds_exemption' WHEN f.g_yes AND d.decision = 'does_not_apply' THEN 'scope_gate'
     WHEN f.e_yes AND d.decision = 'does_not_apply' THEN 'exempts' WHEN d.decision = 'applies' THEN 'requires' END
  GROUP BY l.product_id, l.clause) h ON h.product_id = d.product_id AND h.clause = d.clause"""))
def applicability_note(i):
    return A.clause_decisions(i.product_answers, i.lineage, i.links, i.conditions).select("product_id", "clause", "note")


@query("unmapped_conditional_rule", core("""
SELECT r.run_id, u.rule_code, CASE WHEN s.out_of_scope THEN 'not_applicable' ELSE 'inconclusive' END AS status
FROM runs r JOIN candidates c ON c.product_id = r.product_id JOIN rules u ON u.rule_code = c.rule_code
JOIN scopes s ON s.product_id = r.product_id WHERE u.conditional"""))
def unmapped_conditional_rule(i):
    fw = i.framework()
    fw.rules = fw.rules.withColumn("clause", F.when(~F.col("conditional"), F.col("clause")))
    f = E.candidate_findings(i.inspections, fw, B.AS_OF).where(F.col("decision").isin("unmapped", "out_of_scope"))
    return f.join(i.rules().where("conditional").select("rule_code"), "rule_code", "left_semi").select(
        "run_id", "rule_code", "status")


@query("first_reading_per_declaration", core("SELECT run_id, field_key, reading_id, raw_value, confidence FROM chosen"))
def first_reading_per_declaration(i):
    return R.first_readings(i.readings).select(
        "run_id", "field_key", "reading.reading_id", "reading.raw_value", "reading.confidence")


def _check_only(i, check_type, keys=()):
    """One check over every run, without applicability: the run's chosen readings in, an outcome out."""
    rows = i.runs.join(R.reading_maps(i.readings), "run_id", "left")
    given = C.CheckInput(F.col("fields"), F.col("status"), F.col("recognised_text"),
                         F.array(*[F.lit(k) for k in keys]).cast("array<string>"))
    return rows.select("run_id", C.evaluate(F.lit(check_type), given, (check_type,)).alias("o")).select(
        "run_id", F.col("o.status").alias("status"), F.col("o.field_key").alias("field_key"),
        F.coalesce("o.detail", F.lit("")).alias("detail"))


def _check_sql(key, status, field_key=None, detail="''"):
    return core(f"""
SELECT r.run_id, {status} AS status, {field_key or "'" + key + "'"} AS field_key, {detail} AS detail
FROM runs r LEFT JOIN chosen c ON c.run_id = r.run_id AND c.field_key = '{key}'""")


_STRONG = "(NOT c.uncertain AND NOT coalesce(c.confidence < 0.5, FALSE))"


@query("check_field_presence", _check_sql(
    "country_of_origin", "CASE WHEN c.rn IS NOT NULL THEN 'passed' WHEN r.status <> 'completed' THEN 'inconclusive' ELSE 'failed' END"))
def check_field_presence(i):
    return _check_only(i, "field_presence", ("country_of_origin",))


@query("check_field_presence_any_of", core("""
SELECT r.run_id, CASE WHEN a.field_key IS NOT NULL THEN 'passed' WHEN r.status <> 'completed' THEN 'inconclusive' ELSE 'failed' END AS status,
       coalesce(a.field_key, 'manufacturer_name') AS field_key, coalesce(a.satisfied, '') AS detail
FROM runs r LEFT JOIN any_of a ON a.run_id = r.run_id AND a.rule_code = 'LM-PC-0001'"""))
def check_field_presence_any_of(i):
    return _check_only(i, "field_presence_any_of", ("manufacturer_name", "packer_name", "importer_name"))


@query("check_consumer_care_elements", _check_sql("consumer_care_contact", f"""
CASE WHEN r.status <> 'completed' OR c.rn IS NULL OR (NOT c.has_phone AND NOT c.has_email) THEN 'inconclusive'
     WHEN c.has_phone AND c.has_email THEN 'passed' WHEN {_STRONG} THEN 'failed' ELSE 'inconclusive' END""",
    detail="CASE WHEN r.status = 'completed' AND c.has_phone AND NOT c.has_email THEN 'e-mail address' "
           "WHEN r.status = 'completed' AND c.has_email AND NOT c.has_phone THEN 'telephone number' ELSE '' END"))
def check_consumer_care_elements(i):
    return _check_only(i, "consumer_care_elements")


@query("check_month_year_declaration", _check_sql(
    "date_of_manufacture",
    "CASE WHEN r.status = 'completed' AND c.year_month IS NOT NULL AND NOT c.uncertain THEN 'passed' ELSE 'inconclusive' END",
    detail="CASE WHEN r.status = 'completed' AND NOT c.uncertain THEN coalesce(c.year_month, '') ELSE '' END"))
def check_month_year_declaration(i):
    return _check_only(i, "month_year_declaration", ("date_of_manufacture",))


@query("check_si_unit", _check_sql("net_quantity", """
CASE WHEN r.status <> 'completed' OR c.unit IS NULL OR c.unit = 'zz' THEN 'inconclusive' WHEN c.unit = 'oz' THEN 'failed' ELSE 'passed' END""",
    detail="CASE WHEN r.status = 'completed' THEN coalesce(c.unit, '') ELSE '' END"))
def check_si_unit(i):
    return _check_only(i, "si_unit")


@query("check_prohibited_counting_unit", _check_sql("net_quantity", """
CASE WHEN r.status <> 'completed' OR c.rn IS NULL THEN 'inconclusive' WHEN c.raw_value LIKE '%dozen%' THEN 'failed' ELSE 'passed' END""",
    detail="CASE WHEN r.status = 'completed' AND c.raw_value LIKE '%dozen%' THEN 'dozen' ELSE '' END"))
def check_prohibited_counting_unit(i):
    return _check_only(i, "prohibited_counting_unit")


@query("check_retail_price_tax", _check_sql("retail_sale_price", f"""
CASE WHEN r.status <> 'completed' OR c.rn IS NULL THEN 'inconclusive' WHEN c.inclusive IS NULL OR c.inclusive THEN 'passed'
     WHEN {_STRONG} THEN 'failed' ELSE 'inconclusive' END""",
    detail="CASE WHEN r.status <> 'completed' OR c.rn IS NULL THEN '' WHEN c.inclusive IS NULL THEN 'not_observed' "
           "WHEN c.inclusive THEN 'inclusive' ELSE 'exclusive' END"))
def check_retail_price_tax(i):
    return _check_only(i, "retail_price_tax_declaration")


@query("check_user_defined", core("""
SELECT r.run_id, CASE WHEN c.rn IS NULL THEN 'inconclusive' WHEN coalesce(c.confidence, 1) >= 0.9 THEN 'passed' ELSE 'failed' END AS status,
       'net_quantity' AS field_key, '' AS detail
FROM runs r LEFT JOIN chosen c ON c.run_id = r.run_id AND c.field_key = 'net_quantity'"""))
def check_user_defined(i):
    """A check a user adds through the registry: the net quantity must have been read clearly."""
    name = "clear_net_quantity"
    if name not in C.registered():
        def clear(c):
            reading = c.reading("net_quantity")
            good = F.coalesce(reading["confidence"], F.lit(1.0)) >= 0.9
            return (F.when(reading.isNull(), C.outcome(C.INCONCLUSIVE, "net_quantity", "declaration not read"))
                    .when(good, C.outcome(C.PASSED, "net_quantity", "read clearly", reading))
                    .otherwise(C.outcome(C.FAILED, "net_quantity", "read poorly", reading)))
        C.register(C.CheckSpec(name, clear, C.no_keys, "net quantity read clearly"))
    return _check_only(i, name)


@query("check_error_is_dropped", core("""
SELECT c.product_id, count(*) AS applicable, count(*) FILTER (c.rule_code <> 'LM-PC-0003') AS with_findings
FROM runs r JOIN candidates c ON c.product_id = r.product_id JOIN scopes s ON s.product_id = c.product_id
WHERE NOT s.out_of_scope GROUP BY c.product_id"""))
def check_error_is_dropped(i):
    """A rule whose parameters are broken leaves no finding but still counts as applicable."""
    fw = i.framework()
    broken = F.col("rule_code") == "LM-PC-0003"
    fw.rules = fw.rules.withColumn("field_keys", F.when(broken, F.array(F.lit("no_such_key"))).otherwise(F.col("field_keys")))
    f = E.candidate_findings(i.inspections, fw, B.AS_OF).where(F.col("rule_code").isNotNull() & (F.col("decision") != "out_of_scope"))
    return f.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("applicable"), F.count_if(F.col("status") != C.ERROR).alias("with_findings"))


@query("evidence_strength", core("""
SELECT run_id, reading_id, uncertain AS normalisation_uncertain, coalesce(confidence < 0.5, FALSE) AS confidence_low,
       NOT uncertain AND NOT coalesce(confidence < 0.5, FALSE) AS supports_violation,
       CASE WHEN uncertain THEN 'reading not interpreted with confidence'
            WHEN confidence < 0.5 THEN concat('confidence ', CAST(confidence AS VARCHAR), ' is below 0.5') ELSE '' END AS note
FROM readings"""))
def evidence_strength(i):
    n, c = F.col("normalized"), F.col("confidence")
    return i.readings.select(
        "run_id", "reading_id", N.is_uncertain(n).alias("normalisation_uncertain"), N.confidence_is_low(c).alias("confidence_low"),
        N.supports_violation(n, c).alias("supports_violation"), N.evidence_note(n, c).alias("note"))


@query("rule_parameter_problems", """
WITH r AS (SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 'field_presence' WHEN 1 THEN 'field_presence_any_of' WHEN 2 THEN 'si_unit'
  WHEN 3 THEN 'month_year_declaration' WHEN 4 THEN 'value_check' WHEN 5 THEN 'mystery' WHEN 6 THEN 'consumer_care_elements' ELSE 'field_presence' END AS check_type,
  CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN 'best_before' WHEN p_size % 4 = 2 THEN 'net_quantity,net_quantity' ELSE 'net_quantity,other' END AS keys FROM part)
SELECT id, check_type, CASE
  WHEN check_type = 'value_check' THEN 'check type is planned but not available'
  WHEN check_type = 'mystery' THEN 'unknown check type'
  WHEN check_type IN ('si_unit', 'consumer_care_elements') THEN CASE WHEN keys <> '' THEN 'takes no parameters' END
  WHEN check_type = 'field_presence_any_of' THEN CASE WHEN keys IN ('', 'best_before') THEN 'needs at least two field keys' WHEN keys = 'net_quantity,net_quantity' THEN 'field keys repeat' END
  ELSE CASE WHEN keys <> 'best_before' THEN 'needs exactly one field key' END END AS problem FROM r""")
def rule_parameter_problems(i):
    r = i.sql("""SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 'field_presence' WHEN 1 THEN 'field_presence_any_of' WHEN 2 THEN 'si_unit'
      WHEN 3 THEN 'month_year_declaration' WHEN 4 THEN 'value_check' WHEN 5 THEN 'mystery' WHEN 6 THEN 'consumer_care_elements' ELSE 'field_presence' END AS check_type,
      CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN 'best_before' WHEN p_size % 4 = 2 THEN 'net_quantity,net_quantity' ELSE 'net_quantity,other' END AS keys FROM {part}""")
    keys = F.when(F.col("keys") == "", F.array().cast("array<string>")).otherwise(F.split("keys", ","))
    return r.select("id", "check_type", C.parameter_problem(F.col("check_type"), keys).alias("problem"))


@query("product_for_run", core("""
SELECT r.run_id, CASE WHEN r.run_id % 3 = 0 THEN r.product_id WHEN i.product_id IS NOT NULL THEN i.product_id
  WHEN r.run_id % 7 = 0 THEN NULL END AS product_id,
  CASE WHEN r.run_id % 3 = 0 THEN 'explicit' WHEN i.product_id IS NOT NULL THEN 'image'
       WHEN r.run_id % 7 = 0 THEN 'stated_category' ELSE 'none' END AS origin
FROM runs r LEFT JOIN (SELECT DISTINCT run_id * 10 AS image_id, product_id FROM runs WHERE product_id % 2 = 0) i ON i.image_id = r.image_id"""))
def product_for_run(i):
    from attesta.operators import policy as P
    requests = i.runs.select(
        "run_id", "image_id", F.when(F.col("run_id") % 3 == 0, F.col("product_id")).alias("explicit_product_id"),
        F.when(F.col("run_id") % 7 == 0, F.lit(V.FOOD)).alias("stated_category"))
    images = i.runs.where(F.col("product_id") % 2 == 0).select("image_id", "product_id")
    return P.choose_product(requests, images).select("run_id", "product_id", "origin")
