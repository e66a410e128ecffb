"""Image manifests, digests, frozen evaluation sets and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from attesta import vocabulary as V


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("path", "length", F.sha2("content", 256).alias("sha256"))


def text_digest(text: Column) -> Column:
    """SHA-256 that does not depend on the line endings a checkout used."""
    return F.sha2(F.encode(F.replace(text, F.lit("\r\n"), F.lit("\n")), "utf-8"), 256)


def upload_problems(manifest: DataFrame) -> DataFrame:
    """(image_id, problem): the first reason each upload is refused, null when accepted."""
    ext = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))
    kind = F.trim(F.split(F.lower("content_type"), ";")[0])
    problem = (
        F.when(~ext.isin(*V.IMAGE_EXTENSIONS), F.lit("unsupported_extension"))
        .when(~kind.isin(*V.IMAGE_CONTENT_TYPES), F.lit("unsupported_content_type"))
        .when(F.col("size_bytes") == 0, F.lit("empty_file")).when(F.col("size_bytes") > V.MAX_IMAGE_BYTES, F.lit("file_too_large"))
        .when((F.col("width") < V.MIN_IMAGE_SIDE) | (F.col("height") < V.MIN_IMAGE_SIDE), F.lit("too_small"))
        .when(F.col("width").cast("bigint") * F.col("height") > V.MAX_IMAGE_PIXELS, F.lit("too_many_pixels"))
        .when(~F.col("view_type").isin(*V.VIEW_TYPES), F.lit("unknown_view_type")))
    return manifest.select("image_id", "run_id", problem.alias("problem"))


def oversized_inspections(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("run_id").agg(F.count(F.lit(1)).alias("images")).where(F.col("images") > V.MAX_IMAGES_PER_INSPECTION)


def frozen_set_problems(manifest: DataFrame, annotations: DataFrame, files: DataFrame) -> DataFrame:
    """(sample_id, problem) of a frozen set: every problem, so a load can fail with all of them."""
    rows = manifest.join(annotations.select("annotation", F.col("sample_id").alias("declared")), "annotation", "left").join(
        files.select("image", F.col("sha256").alias("actual")), "image", "left")
    escape = F.col("image").rlike(r"(^/|(^|/)\.\.(/|$))")
    problem = (F.when(escape, F.lit("path escapes the set")).when(F.col("actual").isNull(), F.lit("image is missing"))
               .when(F.col("declared").isNull(), F.lit("annotation is missing")).when(F.col("declared") != F.col("sample_id"), F.lit("sample id mismatch"))
               .when(F.col("actual") != F.col("image_sha256"), F.lit("digest mismatch")))
    return rows.select("sample_id", problem.alias("problem")).where("problem IS NOT NULL")


def annotation_problems(annotations: DataFrame) -> DataFrame:
    has = F.coalesce(F.length(F.trim("value")) > 0, F.lit(False))
    readable = F.col("state") == "present_and_readable"
    found = F.array_compact(F.array(
        F.when(~F.col("state").isin(*V.TRUTH_STATES), F.lit("unknown state")), F.when(~F.col("key").isin(*V.FIELD_KEYS), F.lit("unknown key")),
        F.when(readable & ~has, F.lit("readable without value")), F.when(~readable & has, F.lit("value without readable"))))
    return annotations.select("sample_id", "key", F.explode(found).alias("problem"))


def artifact_problems(artifacts: DataFrame) -> DataFrame:
    """Shape and finiteness of linear-model artifacts (name, vocabulary, idf, classes, coef, intercept, link)."""
    finite = lambda c: F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = F.when(F.col("link") == "sigmoid", F.lit(1)).otherwise(F.size("classes"))
    taxonomy = F.array(*[F.lit(s) for s, _, _ in V.TAXONOMY])
    found = F.array_compact(F.array(
        F.when(~F.col("link").isin("softmax", "sigmoid"), F.lit("unknown link")), F.when(F.size("idf") != F.size("vocabulary"), F.lit("idf length")),
        F.when(F.size("classes") < 2, F.lit("too few classes")), F.when(F.size(F.array_except("classes", taxonomy)) > 0, F.lit("class outside taxonomy")),
        F.when((F.size("coef") != rows) | (F.size("intercept") != rows), F.lit("coefficient rows")),
        F.when(F.exists("coef", lambda r: F.size(r) != F.size(F.col("vocabulary"))), F.lit("coefficient width")),
        F.when(~finite(F.col("idf")) | ~finite(F.flatten("coef")) | ~finite(F.col("intercept")), F.lit("non-finite number"))))
    return artifacts.select("name", F.explode(found).alias("problem"))


def artifact_tables(artifacts: DataFrame) -> DataFrame:
    """(name, term, idf, weights[]) ready for ``linear_scores``."""
    return artifacts.select("name", "coef", F.posexplode(F.arrays_zip("vocabulary", "idf")).alias("slot", "t")).select(
        "name", F.col("t.vocabulary").alias("term"), F.col("t.idf").alias("idf"),
        F.transform("coef", lambda row: F.get(row, F.col("slot"))).alias("weights"))


def seed_missing(current: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """Seed rows to append; nothing existing is renamed or removed."""
    return seed.join(current.select(key), key, "left_anti")
