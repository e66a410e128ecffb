"""Listings, review reasons and attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attesta import vocabulary as V

STATUS_ORDER = {"failed": 0, "inconclusive": 1, "passed": 2, "not_applicable": 3}


def visible_to(df: DataFrame, owner: str, caller: Column) -> DataFrame:
    """A caller sees their own rows; an anonymous caller (null) sees only unowned ones."""
    return df.where(F.col(owner).eqNullSafe(caller))


def usable_runs(runs: DataFrame, members: DataFrame, caller: Column) -> DataFrame:
    """Runs whose primary image is the caller's and no member image is somebody else's."""
    foreign = members.where(~F.col("owner_id").eqNullSafe(caller)).select("run_id").distinct()
    return visible_to(runs, "owner_id", caller).join(foreign, "run_id", "left_anti")


def counts_per_check(candidates: DataFrame, key: str = "run_id") -> DataFrame:
    """Findings and violations of each check, from one pass over its candidate outcomes; a check without any counts 0."""
    return candidates.groupBy(key).agg(
        F.count_if(F.col("status").isin(*STATUS_ORDER)).alias("findings"), F.count_if(F.col("status") == "failed").alias("violations"))


def page_after(df: DataFrame, created: str, key: str, last_created=None, last_key=None, size: int = 20) -> DataFrame:
    """Newest first with a unique tie-break; the next page starts after the last row shown."""
    if last_created is not None:
        df = df.where((F.col(created) < last_created) | ((F.col(created) == last_created) & (F.col(key) < last_key)))
    return df.orderBy(F.desc(created), F.desc(key)).limit(min(size, 100))


def needs_evidence_beyond_image(method: Column) -> Column:
    return (F.coalesce(F.length(method), F.lit(0)) > 0) & ~method.isin(*V.IMAGE_EVALUABLE_METHODS)


def review_reasons(findings: DataFrame) -> DataFrame:
    """(run_id, rule_code, reason) of undecided findings; each names a flag the finding carries."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(F.coalesce(F.size("unresolved_conditions"), F.lit(0)) > 0, F.lit("unresolved_conditions")),
        F.when(yes(F.col("normalisation_uncertain")), F.lit("uncertain_reading")),
        F.when((F.col("decision") == "applies") & (F.col("run_status") != "completed"), F.lit("unreadable_run")),
        F.when(yes(F.col("downgraded_from_failed")), F.lit("rule_not_verified")),
        F.when(needs_evidence_beyond_image(F.col("detection_method")), F.lit("evidence_beyond_image"))))
    return findings.where("status = 'inconclusive'").select("run_id", "rule_code", F.explode(reasons).alias("reason"))


def status_rank(status: Column, unknown_first: bool = True) -> Column:
    order = F.create_map(*[x for s, r in STATUS_ORDER.items() for x in (F.lit(s), F.lit(r))])
    return F.coalesce(F.try_element_at(order, status), F.lit(-1 if unknown_first else len(STATUS_ORDER)))


def finding_images(findings: DataFrame, readings: DataFrame) -> DataFrame:
    """Image of a finding: a violation's evidence, which its row carries, else the only matching reading; ambiguous is null."""
    single = readings.where("image_id IS NOT NULL").groupBy("run_id", "field_key").agg(
        F.count(F.lit(1)).alias("n"), F.min("image_id").alias("only_image"))
    evidence = F.when(F.col("status") == "failed", F.coalesce("reading_image_id", "run_image_id"))
    return findings.join(single, ["run_id", "field_key"], "left").select(
        "run_id", "rule_code", F.coalesce(evidence, F.when(F.col("n") == 1, F.col("only_image"))).alias("image_id"))


def submission_problems(declarations: DataFrame, conditions: DataFrame) -> DataFrame:
    """(declaration_id, problem) of stated facts that may not be recorded."""
    known = conditions.where("is_active").select("condition_code", "determination")
    problem = F.when(F.col("determination").isNull(), F.lit("unknown condition")).when(
        F.col("determination") == "not_determinable", F.lit("not determinable")).when(F.col("product_id").isNull(), F.lit("needs a product"))
    return declarations.join(known, "condition_code", "left").select("declaration_id", problem.alias("problem")).where("problem IS NOT NULL")


def condition_catalogue(conditions: DataFrame, links: DataFrame, rules: DataFrame, requirements: DataFrame | None = None) -> DataFrame:
    """(condition_code, scope, clause, mode, note, rule_codes): what each condition that a person may state bears on, a row per link.

    Links of clauses that ``requirements`` (clause, is_active) calls inactive are left out, and so are links that could change
    nothing: neither a scope clause nor an active rule stands behind them.  ``scope`` is ``rules`` where any of the condition's links
    gates the whole rule set, else ``clause``.  ``links`` may have a ``note``.  All tables are framework-sized.
    """
    if "note" not in links.columns:
        links = links.withColumn("note", F.lit(""))
    if requirements is not None:
        links = links.join(requirements.where("is_active").select("clause").distinct(), "clause", "left_semi")
    codes = rules.where("is_active").groupBy("clause").agg(F.array_sort(F.collect_set("rule_code")).alias("codes"))
    stated = conditions.where("is_active AND determination = 'user_declared'").select("condition_code")
    gate = F.col("clause").isin(*V.SCOPE_CLAUSES)
    rows = stated.join(links.select("condition_code", "clause", "mode", "note").distinct(), "condition_code").join(codes, "clause", "left").where(
        gate | F.col("codes").isNotNull())
    gates = rows.groupBy("condition_code").agg(F.max(gate).alias("gates"))
    return rows.join(gates, "condition_code").select(
        "condition_code", F.when(F.col("gates"), F.lit("rules")).otherwise(F.lit("clause")).alias("scope"), "clause", "mode", "note",
        F.coalesce(F.array_join("codes", ","), F.lit("")).alias("rule_codes"))


def changeable_conditions(conditions: DataFrame, links: DataFrame, rules: DataFrame) -> DataFrame:
    """Active user-declared conditions whose clause gates scope or backs an active rule."""
    live = links.join(rules.where("is_active").select("clause").distinct(), "clause", "left_semi").unionByName(
        links.where(F.col("clause").isin(*V.SCOPE_CLAUSES)))
    return conditions.where("is_active AND determination = 'user_declared'").join(live.select("condition_code").distinct(), "condition_code", "left_semi").select("condition_code")


def operational_rates(runs: DataFrame, group: str = "engine") -> DataFrame:
    n = F.count(F.lit(1))
    return runs.groupBy(group).agg(n.alias("runs"), F.round(F.count_if(F.col("status") == "failed") / n, 6).alias("failure_rate"),
                                   F.round(F.count_if(F.col("status") == "empty") / n, 6).alias("empty_rate"))


def failures_by_code(runs: DataFrame, group: str = "engine") -> DataFrame:
    """(group, error_code, failures, share of the group's runs): why runs failed; a failure without a code is ``unknown``."""
    total = runs.groupBy(group).agg(F.count(F.lit(1)).alias("runs"))
    failed = runs.where("status = 'failed'").groupBy(group, F.coalesce("error_code", F.lit("unknown")).alias("error_code")).agg(F.count(F.lit(1)).alias("failures"))
    return failed.join(total, failed[group].eqNullSafe(total[group])).select(
        failed[group], "error_code", "failures", F.round(F.col("failures") / F.col("runs"), 6).alias("share"))


def processing_times(runs: DataFrame, group: str = "engine", value: str = "processing_ms") -> DataFrame:
    """(group, n, mean, median, p95, max) of the recorded times."""
    from attesta.operators import orderstats as O

    return O.summary(runs, value, group)
