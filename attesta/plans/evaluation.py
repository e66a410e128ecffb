"""The flagship plan: every run against every rule that governs it.

Shape of the physical plan: facts are folded per product, readings per run (both with map-side
combine), and runs meet each of them once.  Applicability is decided once a product and rides along with
its runs; the rules themselves join by category, as small as the framework, and are exploded after the
last shuffle, which is already by run, so findings and counters need no further exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from attesta.functions import values as N
from attesta.operators import applicability as A, checks as C, readings as R, rules as RU, verdict as VD


@dataclass
class Framework:
    """The rule side: small tables, joined map-side by Spark's own size check."""

    rules: DataFrame          # rule_code, check_type, field_keys[], categories[], clause?, conditional, is_active, ...
    links: DataFrame          # clause, mode, condition_code, link_order
    conditions: DataFrame     # condition_code, condition_name, determination, category_code?, is_active
    categories: DataFrame     # category_code, name, parent_code?
    requirements: DataFrame | None = None   # clause, detection_method, citation


@dataclass
class Inspections:
    """The data side."""

    runs: DataFrame           # run_id, product_id, image_id, status, recognised_text
    products: DataFrame       # product_id, category_code?
    readings: DataFrame       # run_id, reading_id, image_id, position?, field_key, raw_value, confidence, normalized, box
    declarations: DataFrame   # declaration_id, product_id, condition_code, answer, updated_at


def rule_plan(framework: Framework, lineage: DataFrame, on) -> DataFrame:
    """(category_code, lineage[], gates[], rules[]): what can bind a product of each category.

    Framework-sized; a run meets it once, by its category.
    """
    rules = framework.rules
    if framework.requirements is not None:
        rules = rules.join(framework.requirements.select("clause", "detection_method", "citation"), "clause", "left")
    else:
        rules = rules.withColumn("detection_method", F.lit("")).withColumn("citation", F.lit(""))
    per_clause = A.clause_links(framework.links, framework.conditions)
    entry = F.struct(
        "rule_code", "check_type", "field_keys", "clause", "conditional", "source_status", "severity", "title",
        F.coalesce("detection_method", F.lit("")).alias("detection_method"),
        F.coalesce("citation", F.lit("")).alias("citation"), "links",
    )
    reach = RU.category_rules(framework.rules, lineage, on)
    by_category = (
        reach.join(rules.join(per_clause, "clause", "left"), "rule_code")
        .groupBy("category_code").agg(F.array_sort(F.collect_list(entry), _by_code).alias("rules"))
    )
    gates = A.gate_rows(framework.links, framework.conditions).withColumn("_one", F.lit(1))
    codes = A.lineage_arrays(lineage).withColumn("_one", F.lit(1)).join(gates, "_one").drop("_one")
    return codes.join(by_category, "category_code", "left")


def _by_code(a, b):
    return F.when(a["rule_code"] < b["rule_code"], F.lit(-1)).when(a["rule_code"] > b["rule_code"], F.lit(1)).otherwise(F.lit(0))


def decided_products(products: DataFrame, facts: DataFrame, plan: DataFrame) -> DataFrame:
    """(product_id, category_code, decisions[], unresolved[], notes[]): applicability of each rule of the product's category, in the rules' order.

    It turns on the category and the stated facts alone, so it is decided once a product and not again for each of its runs.
    Three arrays of their own, so that a query carries only those it reads.
    """
    rows = products.select("product_id", "category_code").join(facts, "product_id", "left").join(plan, "category_code", "left").withColumn(
        "scope", A.scope(F.col("gates"), F.col("answers"), F.col("lineage")))
    rows = rows.withColumn("links", F.transform("rules", lambda r: A.answered(r["links"], F.col("answers"), F.col("lineage"))))
    decision = lambda rule, links: (
        F.when(rule["conditional"] & rule["clause"].isNull(), F.lit("unmapped"))
        .when(rule["clause"].isNull(), F.lit(A.APPLIES))
        .otherwise(A.decide(links)))
    # the scope stands outside the list, so it is not taken again for each rule
    rows = rows.withColumn("decisions", F.when(F.col("scope") == A.DOES_NOT_APPLY, F.transform("rules", lambda _: F.lit("out_of_scope")))
                           .otherwise(F.zip_with("rules", "links", decision)))
    at = lambda n: F.get("decisions", n)
    return rows.select(
        "product_id", "category_code", "decisions",
        F.transform("links", lambda l, n: F.when(at(n) == A.UNDETERMINED, A.unresolved_codes(l))).alias("unresolved"),
        F.transform("rules", lambda r, n: A.applicability_note(r["clause"], F.get("links", n), at(n))).alias("notes"))


def candidate_findings(data: Inspections, framework: Framework, on) -> DataFrame:
    """One row per (run, candidate rule), and one row with a null rule for a run without candidates."""
    lineage = RU.ancestry(framework.categories)
    plan = rule_plan(framework, lineage, on)
    facts = A.fact_maps(A.latest_facts(data.declarations, framework.conditions))
    products = decided_products(data.products, facts, plan)

    runs = data.runs.withColumnRenamed("status", "run_status").withColumnRenamed("image_id", "run_image_id")
    rows = (
        runs.join(products, "product_id", "left")
        .join(R.reading_maps(data.readings), "run_id", "left")
        # rules by category: as large as the framework, whatever the data
        .join(F.broadcast(plan.select("category_code", F.transform("rules", lambda r: r.dropFields("links")).alias("rules"))), "category_code", "left")
        .select("*", F.posexplode_outer("rules").alias("_n", "rule")).drop("rules")
        .withColumn("decision", F.get("decisions", "_n"))
    )
    clause = F.col("rule.clause")
    given = C.CheckInput(F.col("fields"), F.col("run_status"), F.col("recognised_text"), F.col("rule.field_keys"))
    ruled = lambda status, reason: C.outcome(status, None, reason)
    # the check is evaluated only behind an applicability decision, never before it
    outcome = (
        F.when(F.col("decision").isNull(), ruled(None, None))
        .when(F.col("decision").isin("out_of_scope", A.DOES_NOT_APPLY), ruled(C.NOT_APPLICABLE, "rule does not govern this package"))
        .when(F.col("decision") == "unmapped", ruled(C.INCONCLUSIVE, "conditional rule is not linked to a clause"))
        .when(F.col("decision") == A.UNDETERMINED, ruled(C.INCONCLUSIVE, "applicability not established"))
        .otherwise(C.evaluate(F.col("rule.check_type"), given))
    )
    # one element: what reads or filters the outcome stays behind it and does not repeat the check
    chosen = F.try_element_at("fields", F.get("_outcome", F.lit(0))["field_key"])
    rows = rows.withColumn("_outcome", F.array(outcome)).withColumn("reading", chosen).drop("fields").select("*", F.explode_outer("_outcome").alias("outcome"))
    downgraded = (F.col("outcome.status") == C.FAILED) & (F.col("rule.source_status") != "verified")
    downgraded = F.coalesce(downgraded, F.lit(False))
    reading = F.col("reading")
    return rows.select(
        "run_id", "product_id", "category_code", "run_status", "run_image_id",
        F.col("rule.rule_code").alias("rule_code"), F.coalesce(clause, F.lit("")).alias("clause"),
        F.col("rule.title").alias("title"), F.col("rule.severity").alias("severity"),
        F.col("rule.check_type").alias("check_type"), F.col("rule.detection_method").alias("detection_method"),
        F.col("rule.citation").alias("legal_source_citation"),
        "decision", F.when(downgraded, F.lit(C.INCONCLUSIVE)).otherwise(F.col("outcome.status")).alias("status"),
        downgraded.alias("downgraded_from_failed"),
        F.get("unresolved", "_n").alias("unresolved_conditions"), F.get("notes", "_n").alias("applicability_note"),
        F.coalesce("outcome.field_key", F.lit("")).alias("field_key"),
        F.when(downgraded, F.concat("outcome.reason", F.lit("; rule not verified, sent for review")))
        .otherwise(F.col("outcome.reason")).alias("message"),
        F.col("outcome.excerpt").alias("evidence_excerpt"), F.col("outcome.detail").alias("detail"),
        reading["reading_id"].alias("reading_id"), reading["image_id"].alias("reading_image_id"),
        F.coalesce(reading["raw_value"], F.lit("")).alias("extracted_raw_value"),
        reading["normalized"].alias("extracted_normalized"), reading["confidence"].alias("extracted_confidence"),
        F.when(reading.isNotNull(), N.is_uncertain(reading["normalized"])).alias("normalisation_uncertain"),
        reading["box"].alias("bounding_box"),
    )


def findings(candidates: DataFrame) -> DataFrame:
    """The finding snapshot: every decided outcome; a check that could not run leaves no finding."""
    return candidates.where(F.col("status").isin(C.PASSED, C.FAILED, C.INCONCLUSIVE, C.NOT_APPLICABLE))


def violations(candidates: DataFrame) -> DataFrame:
    """Failed findings with their evidence: the reading's photograph, else the run's primary one."""
    return candidates.where(F.col("status") == C.FAILED).select(
        "run_id", "rule_code", "severity", "field_key", "message", "evidence_excerpt", "reading_id",
        F.coalesce("reading_image_id", "run_image_id").alias("evidence_image_id"), "bounding_box",
    )


def pictured(findings: DataFrame) -> DataFrame:
    """Findings with ``evidence_image_id``: the reading's photograph, else the run's primary one."""
    return findings.withColumn("evidence_image_id", F.coalesce("reading_image_id", "run_image_id"))


def verdicts(candidates: DataFrame) -> DataFrame:
    """One verdict row per run, also for runs no rule reaches."""
    counted = VD.counters(candidates, ("run_id", "product_id", "category_code", "run_status"))
    return VD.with_verdict(counted)
