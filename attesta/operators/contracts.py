"""Contracts: what a reading, a framework row or an example must satisfy, as tables of problems, and small predicates.

A problem table has one row per (subject, problem).  Every rule is a column over one row, so a table is scanned once however
many rules there are; uniqueness and references are one aggregation or anti-join each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attesta import vocabulary as V
from attesta.operators.checks import FAILED

VERIFICATION_COLUMNS = ("label_verified_by", "label_verified_on", "label_verification_ref")


def problems(df: DataFrame, subject: Column, rules: dict[str, Column]) -> DataFrame:
    """(subject, problem): the rules that hold of each row; a null answer is no problem."""
    named = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return df.select(subject.cast("string").alias("subject"), F.explode(named).alias("problem"))


def empty(c: str) -> Column:
    return F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) == 0


def repeated(df: DataFrame, key: str, problem: str) -> DataFrame:
    again = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return again.select(F.col(key).cast("string").alias("subject"), F.lit(problem).alias("problem"))


def unknown_reference(df: DataFrame, subject: str, ref: str, known: DataFrame, column: str, problem: str) -> DataFrame:
    missing = df.where(F.col(ref).isNotNull()).join(known.select(F.col(column).alias(ref)).distinct(), ref, "left_anti")
    return missing.select(F.col(subject).cast("string").alias("subject"), F.lit(problem).alias("problem"))


# --- readings ----------------------------------------------------------------------------------


def reading_contract(runs: DataFrame, readings: DataFrame) -> DataFrame:
    """(run_id, problem) of runs whose status, time or any reading breaks the contract."""
    time, confidence = F.col("processing_ms"), F.col("confidence")
    of_runs = problems(runs, F.col("run_id"), {
        "unknown status": ~F.coalesce(F.col("status").isin(*V.RUN_STATUSES), F.lit(False)),
        "processing time": time.isNull() | ~time.between(0, V.MAX_PROCESSING_MS),
    })
    of_readings = problems(readings, F.col("run_id"), {
        "unknown key": ~F.coalesce(F.col("field_key").isin(*V.FIELD_KEYS), F.lit(False)),
        "empty raw value": empty("raw_value"),
        "confidence": confidence.isNotNull() & (F.isnan(confidence) | ~confidence.between(0, 1)),
    })
    return of_runs.union(of_readings).distinct().withColumnRenamed("subject", "run_id")


def accepted_readings(runs: DataFrame, readings: DataFrame) -> DataFrame:
    """Readings of runs without any problem: one breach rejects the whole run."""
    bad = reading_contract(runs, readings).select("run_id").distinct()
    key = F.col("run_id").cast("string")
    return readings.withColumn("_run", key).join(bad.withColumnRenamed("run_id", "_run"), "_run", "left_anti").drop("_run")


def unread_list(raw_output: Column) -> Column:
    """The unread declarations in a run's raw output: its objects; anything that is no object, or no list at all, drops out."""
    item = "struct<key:string,evidence_text:string,confidence:double>"
    raw = F.get_json_object(raw_output, "$.metadata.unread_declarations")
    rows = F.coalesce(F.from_json(F.when(raw.startswith("["), raw), "array<string>"), F.array().cast("array<string>"))
    return F.transform(F.filter(rows, lambda x: x.startswith("{")), lambda x: F.from_json(x, item))


# --- rules and framework -----------------------------------------------------------------------


def condition_problems(conditions: DataFrame) -> DataFrame:
    named = ~empty("category_code")
    by_category = F.col("determination") == "product_category"
    return problems(conditions, F.col("condition_code"), {
        "unknown determination": ~F.coalesce(F.col("determination").isin(*V.DETERMINATIONS), F.lit(False)),
        "category missing": by_category & ~named, "category not asked for": ~by_category & named,
    }).union(repeated(conditions, "condition_code", "repeated code"))


def requirement_problems(requirements: DataFrame, instruments: DataFrame) -> DataFrame:
    """Enumerations, version, note when verified, window, self-supersession and references of requirement rows."""
    own = problems(requirements, F.col("requirement_id"), {
        "detection method": ~F.coalesce(F.col("detection_method").isin(*V.DETECTION_METHODS), F.lit(False)),
        "version": F.coalesce(F.col("version") < 1, F.lit(True)),
        "verified without a note": (F.col("verification_status") == "verified") & empty("source_note"),
        "window": F.col("effective_to") < F.col("effective_from"),
        "supersedes itself": F.col("supersedes") == F.col("requirement_id"),
    })
    return (
        own.union(unknown_reference(requirements, "requirement_id", "source", instruments, "source", "unknown instrument"))
        .union(unknown_reference(requirements, "requirement_id", "supersedes", requirements, "requirement_id", "unknown superseded version"))
    )


def requirement_state(requirements: DataFrame, links: DataFrame, conditions: DataFrame) -> DataFrame:
    """Whether an image could settle each requirement, whether its applicability can be known, and whether only a person can decide."""
    open_ = links.join(conditions.select("condition_code", "determination"), "condition_code").where("determination = 'not_determinable'").select("clause").distinct()
    image = F.col("detection_method").isin(*V.IMAGE_EVALUABLE_METHODS)
    known = F.col("open").isNull()
    return requirements.join(open_.withColumn("open", F.lit(True)), "clause", "left").select(
        "requirement_id", image.alias("image_evaluable"), known.alias("determinable"),
        (~image | ~known | (F.col("verification_status") == "requires_review")).alias("needs_review"))


def requirement_counts(requirements: DataFrame, rules: DataFrame) -> DataFrame:
    """Active requirements that are recorded, and those that some active rule evaluates."""
    live = requirements.where("is_active")
    evaluated = live.join(rules.where("is_active").select("clause").distinct(), "clause", "left_semi")
    return live.select(F.lit("recorded").alias("kind")).union(evaluated.select(F.lit("evaluated"))).groupBy("kind").agg(F.count(F.lit(1)).alias("requirements"))


# --- examples and frozen sets --------------------------------------------------------------------


def example_problems(examples: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Validity of classification examples."""
    given = sum((~empty(c)).cast("int") for c in VERIFICATION_COLUMNS)
    pairs = taxonomy.select(F.col("category").alias("_c"), F.col("subcategory").alias("_s"))
    joined = examples.join(pairs, (F.col("category") == F.col("_c")) & (F.col("subcategory") == F.col("_s")), "left")
    return problems(joined, F.col("example_id"), {
        "taxonomy pair": F.col("_s").isNull(),
        "text source": ~F.coalesce(F.col("text_source").isin(*V.TEXT_SOURCES), F.lit(False)),
        "reader of the text": (F.col("text_source") == "ocr") & (empty("ocr_engine") | empty("ocr_engine_version")),
        "verification in part": (given > 0) & (given < len(VERIFICATION_COLUMNS)),
        "image digest": F.col("image_sha256").isNotNull() & ~F.col("image_sha256").rlike(V.SHA256),
    }).union(repeated(examples, "example_id", "repeated id"))


def sample_problems(samples: DataFrame) -> DataFrame:
    """Entries of a frozen set: id, digest, date, and a relative path that stays inside."""
    path = F.col("path")
    return problems(samples, F.col("sample_id"), {
        "id": ~F.coalesce(F.col("sample_id").rlike(V.SAMPLE_ID), F.lit(False)),
        "digest": ~F.coalesce(F.col("sha256").rlike(V.SHA256), F.lit(False)),
        "date": F.col("captured_on").isNotNull() & ~F.col("captured_on").rlike(V.DATE_SHAPE),
        "path": empty("path") | path.startswith("/") | F.contains(path, F.lit("\\")) | F.array_contains(F.split(path, "/"), ".."),
    }).union(repeated(samples, "sample_id", "repeated id"))


# --- small predicates and orders -----------------------------------------------------------------


def stated_before(updated_at: Column, started_at: Column) -> Column:
    """Whether a declaration was stated before the check began; null where the check has no start."""
    return updated_at <= started_at


def rejected_categories(submissions: DataFrame, categories: DataFrame) -> DataFrame:
    """Submissions whose category is no active one."""
    return submissions.join(categories.where("is_active").select("category_code"), "category_code", "left_anti")


def first_seen(rows: DataFrame, column: str, position: str) -> DataFrame:
    """(value, first): distinct values with where each is first seen; sort by ``first``."""
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(position).alias("first"))


def findings_digest(findings: DataFrame, shown: int = 5) -> DataFrame:
    """(severity, code, findings, subjects): the report's lines, errors first, with the first subjects of each and ``...`` after them.

    Only ``shown`` subjects of a code survive the rank, which Spark applies before the shuffle.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("severity", "code").orderBy("subject")
    top = findings.withColumn("r", F.row_number().over(order)).where(F.col("r") <= shown).groupBy("severity", "code").agg(
        F.array_join(F.array_sort(F.collect_list("subject")), ", ").alias("first"))
    n = findings.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("findings"))
    return n.join(top, ["severity", "code"]).select(
        "severity", "code", "findings", F.concat("first", F.when(F.col("findings") > shown, ", ...").otherwise("")).alias("subjects"))


def result_graph(checks: DataFrame, findings: DataFrame, violations: DataFrame, readings: DataFrame) -> DataFrame:
    """One row per check with its findings, violations and readings.

    Findings and violations are bounded by the rules; a check's readings are those of its own images.  Each list is folded
    by check before it meets the others, so no join multiplies rows.
    """
    fold = lambda df, name, *columns: df.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    none = lambda name: F.coalesce(F.col(name), F.array()).alias(name)
    return (
        checks.join(fold(findings, "findings", "rule_code", "status"), "run_id", "left")
        .join(fold(violations, "violations", "rule_code", "evidence_image_id"), "run_id", "left")
        .join(fold(readings, "fields", "field_key", "raw_value"), "run_id", "left")
        .select(*checks.columns, none("findings"), none("violations"), none("fields"))
    )


def result_rows(checks: DataFrame, products: DataFrame, findings: DataFrame, readings: DataFrame) -> DataFrame:
    """(run_id, part, item, value): everything that belongs to a check, one row per element.

    ``result_graph`` puts a check's lists into one row; here a check with any number of readings spreads over all tasks.  Parts: ``run``
    (status), ``image``, ``product`` (category), ``finding`` (status by rule), ``violation`` (severity by rule), ``evidence`` (photograph by rule)
    and ``field`` (value by reading).  ``findings``: the outcomes of these checks by rule, each with ``evidence_image_id``; a failed one is a
    violation too, so the framework is evaluated once for all three parts.  Readings of unknown checks are left out; a null value stays null.
    Only products, and the check of each reading, need a join; the parts are laid side by side.
    """
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    part = lambda name, item, value: F.struct(F.lit(name).alias("part"), text(item).alias("item"), text(value).alias("value"))
    known = checks.select("run_id")
    head = checks.join(products.select("product_id", "category_code"), "product_id", "left").select("run_id", F.inline(F.filter(F.array(
        part("run", "run_id", "status"), part("image", "image_id", F.lit(None)), part("product", "product_id", "category_code")), lambda p: p["item"].isNotNull())))
    failed, pictured = F.col("status") == FAILED, F.col("evidence_image_id").isNotNull()
    outcome = F.array_compact(F.array(
        part("finding", "rule_code", "status"), F.when(failed, part("violation", "rule_code", "severity")),
        F.when(failed & pictured, part("evidence", "rule_code", "evidence_image_id"))))
    fields = readings.join(known, "run_id", "left_semi").select(
        "run_id", part("field", F.concat_ws("/", "field_key", "reading_id"), "raw_value").alias("p")).select("run_id", "p.*")
    return head.unionByName(findings.select("run_id", F.inline(outcome))).unionByName(fields)
