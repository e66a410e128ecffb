"""What a recorded classification may decide, and what a person still has to answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attesta import vocabulary as V


def choose_product(requests: DataFrame, images: DataFrame) -> DataFrame:
    """The product a run is judged as: named explicitly, else its image's; a stated category alone
    asks for a new product (``origin`` says which).  An image under several products counts for the first of them."""
    owned = images.groupBy("image_id").agg(F.min("product_id").alias("_image_product"))
    joined = requests.join(owned, "image_id", "left")
    return joined.withColumn(
        "origin",
        F.when(F.col("explicit_product_id").isNotNull(), F.lit("explicit"))
        .when(F.col("_image_product").isNotNull(), F.lit("image"))
        .when(F.col("stated_category").isNotNull(), F.lit("stated_category")).otherwise(F.lit("none")),
    ).withColumn("product_id", F.coalesce("explicit_product_id", "_image_product")).drop("_image_product")


def created_products(requests: DataFrame, images: DataFrame, established: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(products, runs): the rows that submissions without a product create, and the product that each run is judged as.

    ``established``: run_id, category_code of the runs whose category a licensed classifier settles.  A run without a product gets a
    row of its own, for the stated category first, else for the established one; without either it has none.  Its key follows from the
    run, so a replay creates the same row and never a second one.  Keys are strings: the product's id, or ``run:`` and the run's id for a new row.
    """
    chosen = choose_product(requests, images).join(established.select("run_id", F.col("category_code").alias("_settled")), "run_id", "left")
    fresh = F.col("product_id").isNull() & F.coalesce("stated_category", "_settled").isNotNull()
    origin = F.when(fresh & F.col("stated_category").isNull(), F.lit("classifier")).otherwise(F.col("origin"))
    key = F.when(fresh, F.concat(F.lit("run:"), F.col("run_id").cast("string"))).otherwise(F.col("product_id").cast("string"))
    rows = chosen.select("run_id", key.alias("product_key"), origin.alias("origin"), fresh.alias("_fresh"),
                         F.coalesce("stated_category", "_settled").alias("category_code"))
    products = rows.where("_fresh").select("product_key", "category_code", F.lit(V.UNIDENTIFIED).alias("name"), "origin")
    return products, rows.select("run_id", "product_key", "origin")


def read_classification(raw: Column) -> Column:
    """Read a classification out of raw JSON.  Any malformed part makes it unusable, with a problem."""
    doc = F.try_parse_json(raw)
    at = lambda path, kind: F.try_variant_get(doc, "$.metadata.product_classification" + path, kind)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(doc, "$.metadata.product_classification" + path, "variant"))
    number = lambda path: F.coalesce(kind(path).rlike("^(BIGINT|DOUBLE|DECIMAL|INT)"), F.lit(False))
    void = lambda path: F.coalesce(kind(path) == "VOID", F.lit(True))
    bad_unit = lambda path: ~void(path) & ~(number(path) & F.coalesce(at(path, "double").between(0.0, 1.0), F.lit(False)))
    category, sub = F.trim(at(".category", "string")), at(".subcategory", "string")
    text = lambda path: F.coalesce(kind(path) == "STRING", F.lit(False))
    problem = (
        F.when(kind("").isNull(), F.lit("no classification was recorded"))
        .when(void(""), F.lit("the classifier produced no classification"))
        .when(~kind("").startswith("OBJECT"), F.lit("not an object"))
        .when(~text(".category") | (F.coalesce(F.length(category), F.lit(0)) == 0), F.lit("category must be a non-empty string"))
        .when(~void(".subcategory") & ~text(".subcategory"), F.lit("subcategory must be a string or null"))
        .when((category == V.UNKNOWN) & (F.coalesce(F.length(sub), F.lit(0)) > 0), F.lit("a subcategory cannot hang off an unknown category"))
        .when(bad_unit(".confidence") | bad_unit(".subcategory_confidence"), F.lit("confidence must be a number in [0, 1]"))
        .when(~text(".classifier_name") | ~text(".classifier_version"), F.lit("classifier name and version must be strings"))
        .when(~void(".evidence") & ~F.coalesce(kind(".evidence").startswith("ARRAY"), F.lit(False)), F.lit("evidence must be a list"))
    )
    fine = problem.isNull()
    committed = fine & (category != V.UNKNOWN)
    return F.struct(
        fine.alias("usable"), F.coalesce(committed, F.lit(False)).alias("committed"), F.when(committed, category).alias("category"),
        F.when(fine & (F.length(sub) > 0), sub).alias("subcategory"), F.when(fine, at(".confidence", "double")).alias("confidence"),
        F.when(fine, F.concat_ws("/", at(".classifier_name", "string"), at(".classifier_version", "string"))).alias("artifact"),
        problem.alias("problem"), F.when(fine, at(".evidence", "array<string>")).alias("evidence"))


def valid_policy(policy: DataFrame) -> DataFrame:
    """Policy rows that may license an artifact; a malformed row licenses nothing."""
    return policy.where((F.col("min_confidence") > 0) & (F.col("min_confidence") <= 1) & (F.length(F.trim("evaluation")) > 0))


def status(usable: Column, committed: Column, confidence: Column, floor: Column) -> Column:
    return (
        F.when(~usable, F.lit("failed")).when(~committed, F.lit("unknown"))
        .when(floor.isNull(), F.lit("uncertain"))
        .when(confidence.isNull() | (confidence < floor), F.lit("uncertain")).otherwise(F.lit("confident")))


def assess(classified: DataFrame, policy: DataFrame, categories: DataFrame) -> DataFrame:
    """Status and category disposition per run.

    ``classified``: run_id, c (struct of ``read_classification``), in_effect, in_effect_source.
    """
    active = categories.select(F.col("category_code").alias("_known"))
    rows = classified.withColumn("artifact", F.col("c.artifact")).join(
        valid_policy(policy).select("artifact", "min_confidence"), "artifact", "left")
    rows = rows.withColumn("proposed", F.when(F.col("c.committed"), F.col("c.category"))).join(
        active, F.col("proposed") == F.col("_known"), "left")
    state = status(F.col("c.usable"), F.col("c.committed"), F.col("c.confidence"), F.col("min_confidence"))
    proposed, effect = F.col("proposed"), F.col("in_effect")
    disposition = (
        F.when(effect.isNotNull() & (F.col("in_effect_source") == "classifier"), F.lit("established_automatically"))
        .when(effect.isNotNull() & (proposed == effect), F.lit("confirmed_by_submitter"))
        .when(effect.isNotNull() & proposed.isNotNull(), F.lit("contradicted_by_submitter"))
        .when(effect.isNotNull(), F.lit("stated_by_submitter"))
        .when(proposed.isNotNull() & F.col("_known").isNotNull(), F.lit("needs_confirmation"))
        .otherwise(F.lit("not_proposed")))
    established = (state == "confident") & F.col("_known").isNotNull() & effect.isNull()
    return rows.select("run_id", state.alias("status"), disposition.alias("disposition"), F.when(F.col("_known").isNotNull(), proposed).alias("proposed"),
                       F.col("c.subcategory").alias("subcategory"), established.alias("establishes_category"), effect.isNull().alias("asks_category"))


def fact_dispositions(proposals: DataFrame, taxonomy: DataFrame, conditions: DataFrame, facts: DataFrame) -> DataFrame:
    """The fact a subcategory suggests, which takes effect only through a person's answer."""
    mapped = taxonomy.where("condition_code IS NOT NULL").select("subcategory", "condition_code")
    known = conditions.where("is_active").select("condition_code", "determination")
    rows = proposals.join(mapped, "subcategory").join(known, "condition_code").join(facts, ["product_id", "condition_code"], "left")
    said = F.when(F.col("answer").isin("yes", "no"), F.col("answer"))
    disposition = (
        F.when(said == "yes", F.lit("confirmed_by_submitter")).when(said == "no", F.lit("contradicted_by_submitter"))
        .when(F.col("determination") == "not_determinable", F.lit("not_proposed")).otherwise(F.lit("needs_confirmation")))
    return rows.select("run_id", "condition_code", F.coalesce(said, F.lit(V.UNKNOWN)).alias("in_effect"), disposition.alias("disposition"))


def open_questions(assessed: DataFrame, facts: DataFrame, links: DataFrame) -> DataFrame:
    """(run_id, kind, code, clauses): what a person still has to answer."""
    clauses = links.groupBy("condition_code").agg(F.array_join(F.array_sort(F.collect_set("clause")), ", ").alias("clauses"))
    category = assessed.where("asks_category").select("run_id", F.lit("category").alias("kind"), F.col("proposed").alias("code"), F.lit("").alias("clauses"))
    condition = facts.where("disposition = 'needs_confirmation'").join(clauses, "condition_code", "left").select(
        "run_id", F.lit("condition").alias("kind"), F.col("condition_code").alias("code"), F.coalesce("clauses", F.lit("")).alias("clauses"))
    return category.unionByName(condition)


def declared_fields(readings: DataFrame, k: int = 6) -> DataFrame:
    """(run_id, rank, field_key): the first fields with a value, in key order; Spark keeps k per map task."""
    from pyspark.sql import Window

    order = Window.partitionBy("run_id").orderBy("field_key", "reading_id")
    return readings.where(F.length(F.trim("raw_value")) > 0).withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= k).select("run_id", "rank", "field_key", "raw_value")
