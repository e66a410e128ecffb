"""Counters and the verdict of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

COMPLIANT, NON_COMPLIANT = "compliant", "non_compliant"
PARTIALLY_COMPLIANT, REVIEW_REQUIRED = "partially_compliant", "review_required"


def counters(findings: DataFrame, keys=("run_id",)) -> DataFrame:
    """Per-run counts over every candidate row.  ``applicable`` counts rules selected, also those
    whose check failed to run; ``evaluated`` does not count exemptions."""
    n = lambda status: F.count_if(F.col("status") == status)
    return findings.groupBy(*keys).agg(
        F.count("rule_code").alias("applicable"),
        n("passed").alias("passed"), n("failed").alias("failed"),
        n("inconclusive").alias("inconclusive"), n("not_applicable").alias("not_applicable"),
    ).withColumn("evaluated", F.col("passed") + F.col("failed") + F.col("inconclusive"))


def verdict(applicable: Column, not_applicable: Column, passed: Column, failed: Column, inconclusive: Column,
            usable: Column) -> Column:
    """First match wins.  Nothing checked, or nothing readable, is never a pass."""
    considered = applicable - not_applicable
    return (
        F.when((applicable == 0) | (considered == 0) | ~usable, F.lit(REVIEW_REQUIRED))
        .when((failed > 0) & (inconclusive == 0), F.lit(NON_COMPLIANT))
        .when(failed > 0, F.lit(PARTIALLY_COMPLIANT))
        .when(inconclusive > 0, F.lit(REVIEW_REQUIRED))
        .when(passed > 0, F.lit(COMPLIANT))
        .otherwise(F.lit(REVIEW_REQUIRED))
    )


def summary(applicable: Column, not_applicable: Column, passed: Column, failed: Column, inconclusive: Column,
            usable: Column, category_known: Column) -> Column:
    """Which of the verdict's cases was met, in a few words."""
    considered = applicable - not_applicable
    return (
        F.when((applicable == 0) & ~category_known, F.lit("category not known"))
        .when(applicable == 0, F.lit("no rules loaded for this category"))
        .when(considered == 0, F.lit("every selected rule was ruled out"))
        .when(~usable, F.lit("no readable text"))
        .when((failed > 0) & (inconclusive == 0), F.lit("rules not met"))
        .when(failed > 0, F.lit("rules not met and rules undecided"))
        .when(inconclusive > 0, F.lit("rules undecided"))
        .when(passed > 0, F.lit("all applicable rules met"))
        .otherwise(F.lit("no usable outcome"))
    )


def with_verdict(counted: DataFrame) -> DataFrame:
    usable = F.coalesce(F.col("run_status") == "completed", F.lit(False))
    args = [F.col(c) for c in ("applicable", "not_applicable", "passed", "failed", "inconclusive")]
    return counted.withColumn("result", verdict(*args, usable)).withColumn(
        "summary", summary(*args, usable, F.col("category_code").isNotNull())
    )
