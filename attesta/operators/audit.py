"""Dataset integrity: every check yields rows (code, severity, subject, detail) that are unioned.

A finding names its subject by key; members of a group are found by joining back, so no group is
ever collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from attesta import vocabulary as V
from attesta.functions import text as T

ERROR, WARNING = "error", "warning"


def finding(df: DataFrame, code: str, severity: str, subject: Column, detail: Column | None = None) -> DataFrame:
    return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"),
                     (F.lit("") if detail is None else detail).cast("string").alias("detail"))


def row_findings(examples: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Every check that looks at one example, in one scan."""
    blank = lambda c: F.coalesce(F.length(F.trim(c)) == 0, F.lit(True))
    known = taxonomy.select("subcategory", F.col("category").alias("_category"))
    rows = examples.join(known, "subcategory", "left")
    bad_category = ~F.col("category").isin(V.FOOD, V.NON_FOOD)
    marker = T.machine_marker(F.col("label_verified_by"))
    verified = ~blank("label_verified_by")
    item = lambda cond, code, detail=None: F.when(cond, F.struct(
        F.lit(code).alias("code"), (F.lit("") if detail is None else detail).alias("detail")))
    missing = F.concat_ws(",", *[F.when(blank(c), F.lit(c)) for c in ("source_dataset", "source_sample_id", "image_sha256")])
    found = F.array_compact(F.array(
        item(F.lower(F.trim("product_id")).isin(*V.PLACEHOLDER_PRODUCT_IDS), "missing-product-id"),
        item(blank("category") | blank("subcategory"), "missing-label"),
        item(bad_category, "invalid-category"),
        item(~bad_category & F.col("_category").isNull(), "unsupported-taxonomy-value"),
        item(~bad_category & (F.col("_category") != F.col("category")), "inconsistent-taxonomy-pair"),
        item(F.length(missing) > 0, "missing-provenance", missing),
        item((F.col("text_source") == "ocr") & (blank("ocr_engine") | blank("ocr_engine_version")), "missing-ocr-provenance"),
        item(blank("labelled_by"), "missing-labeller"),
        item(verified & marker.isNotNull(), "machine-verifier", marker),
        item(verified & (blank("label_verified_on") | blank("label_verification_ref")), "incomplete-verification"),
    ))
    rows = rows.select("example_id", F.explode(found).alias("f"))
    return rows.select("f.code", F.lit(ERROR).alias("severity"), F.col("example_id").cast("string").alias("subject"), "f.detail")


def shared_images(examples: DataFrame) -> DataFrame:
    g = examples.where("image_sha256 IS NOT NULL").groupBy("image_sha256").agg(F.count_distinct("product_id").alias("n"))
    return finding(g.where("n > 1"), "duplicate-product", ERROR, F.col("image_sha256"), F.col("n"))


def repeated_images(examples: DataFrame) -> DataFrame:
    g = examples.where("image_sha256 IS NOT NULL").groupBy("image_sha256", "text_source").agg(F.count(F.lit(1)).alias("n"))
    return finding(g.where("n > 1"), "duplicate-image", ERROR, F.concat_ws("|", "image_sha256", "text_source"), F.col("n"))


def conflicting_labels(examples: DataFrame) -> DataFrame:
    g = examples.groupBy("product_id").agg(F.count_distinct("category").alias("category"), F.count_distinct("subcategory").alias("subcategory"))
    rows = g.select("product_id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in ("category", "subcategory")])).alias("x"))
    return finding(rows.where("x.n > 1"), "conflicting-label", ERROR, F.concat_ws("|", "product_id", "x.field"), F.col("x.n"))


def duplicate_texts(examples: DataFrame) -> DataFrame:
    """Same text across products (error) or within one (warning); the text travels as its digest."""
    form = T.duplicate_form(F.col("text"))
    rows = examples.select("product_id", form.alias("form")).where(F.length("form") > 0).select("product_id", F.sha2("form", 256).alias("digest"))
    g = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("product_id").alias("p")).where("n > 1")
    across = F.col("p") > 1
    return g.select(
        F.when(across, F.lit("duplicate-text-across-products")).otherwise(F.lit("duplicate-text-within-product")).alias("code"),
        F.when(across, F.lit(ERROR)).otherwise(F.lit(WARNING)).alias("severity"), F.col("digest").alias("subject"), F.col("n").cast("string").alias("detail"))


def class_coverage(examples: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Examples and products per taxonomy class, empty classes included, verified counted apart."""
    per = examples.groupBy("subcategory").agg(
        F.count(F.lit(1)).alias("examples"), F.count_distinct("product_id").alias("products"), F.count("label_verified_by").alias("verified"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return taxonomy.select("subcategory", "category").join(per, "subcategory", "left").select(
        "subcategory", "category", zero("examples"), zero("products"), zero("verified"))


def thin_classes(examples: DataFrame, taxonomy: DataFrame) -> DataFrame:
    c = class_coverage(examples, taxonomy).where("products < 2")
    return c.select(F.when(F.col("examples") == 0, F.lit("empty-class")).otherwise(F.lit("single-product-class")).alias("code"),
                    F.lit(WARNING).alias("severity"), F.col("subcategory").alias("subject"), F.col("examples").cast("string").alias("detail"))


def unverified_labels(examples: DataFrame, required: bool = False) -> DataFrame:
    g = examples.agg(F.count_if(F.col("label_verified_by").isNull()).alias("n")).where("n > 0")
    return finding(g, "unverified-labels", ERROR if required else WARNING, F.lit("dataset"), F.col("n"))


def fold_leakage(placement: DataFrame) -> DataFrame:
    """``placement``: (fold, product_id)."""
    g = placement.groupBy("product_id").agg(F.count_distinct("fold").alias("n"))
    return finding(g.where("n > 1"), "product-leakage", ERROR, F.col("product_id"), F.col("n"))


def validate(examples: DataFrame, taxonomy: DataFrame, require_verified: bool = False) -> DataFrame:
    parts = [row_findings(examples, taxonomy), shared_images(examples), repeated_images(examples), conflicting_labels(examples),
             duplicate_texts(examples), thin_classes(examples, taxonomy), unverified_labels(examples, require_verified)]
    return reduce(DataFrame.unionByName, parts)


def require_clean(findings: DataFrame) -> None:
    """The severity gate: raise when any error exists, naming every one of them."""
    errors = findings.where(F.col("severity") == ERROR).orderBy("code", "subject")
    listed = [f"{r.code} [{r.subject}]" for r in errors.toLocalIterator()]
    if listed:
        raise ValueError(f"{len(listed)} dataset integrity error(s): {'; '.join(listed)}")


# --- verification ledger ---------------------------------------------------------------------


def ledger_problems(ledger: DataFrame, taxonomy: DataFrame) -> DataFrame:
    marker = T.machine_marker(F.col("verifier"))
    rows = ledger.join(taxonomy.select("subcategory", F.col("category").alias("_c")), "subcategory", "left")
    return rows.select("ref", F.explode(F.array_compact(F.array(
        F.when(marker.isNotNull(), F.lit("machine-verifier")), F.when(~T.is_iso_date_shape(F.col("verified_on")), F.lit("bad-date")),
        F.when(~F.col("outcome").isin(*V.LEDGER_OUTCOMES), F.lit("bad-outcome")),
        F.when(~F.coalesce(F.col("_c") == F.col("category"), F.lit(False)), F.lit("bad-taxonomy-pair"))))).alias("problem"))


def reconcile(examples: DataFrame, ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """Where ledger and dataset disagree.  ``entries``: (ref, example_id, image_sha256)."""
    products = examples.select("product_id").distinct()
    orphan = ledger.join(products, "product_id", "left_anti")
    known = ledger.join(products, "product_id", "left_semi")
    lined = known.join(entries, "ref")
    own = examples.select("example_id", F.col("product_id").alias("e_product"), F.col("category").alias("e_category"),
                          F.col("subcategory").alias("e_subcategory"), "label_verified_by", "label_verification_ref")
    met = lined.join(own, "example_id", "left")
    applicable = F.col("outcome").isin("confirmed", "changed")
    differs = (F.col("e_category") != F.col("category")) | (F.col("e_subcategory") != F.col("subcategory"))
    subject = F.concat_ws("|", "ref", "example_id")
    images = examples.select("product_id", "image_sha256").where("image_sha256 IS NOT NULL").distinct()
    unknown_images = lined.join(images, ["product_id", "image_sha256"], "left_anti").select("ref").distinct()
    verified = examples.where("label_verified_by IS NOT NULL")
    covered = entries.select("example_id").distinct()
    not_applied = ledger.where(applicable).join(entries, "ref").join(own.where("label_verified_by IS NULL"), "example_id").select("ref").distinct()
    parts = [
        finding(orphan, "ledger-unknown-product", ERROR, F.col("ref")),
        finding(met.where("e_product IS NULL"), "ledger-unknown-example", ERROR, subject),
        finding(met.where("e_product <> product_id"), "ledger-example-product-mismatch", ERROR, subject),
        finding(met.where(applicable & differs), "ledger-label-disagreement", ERROR, subject),
        finding(unknown_images, "ledger-unknown-image", WARNING, F.col("ref")),
        finding(verified.join(covered, "example_id", "left_anti"), "verified-without-ledger-entry", ERROR, F.col("example_id")),
        finding(verified.join(covered, "example_id", "left_semi").join(
            ledger.select(F.col("ref").alias("label_verification_ref")), "label_verification_ref", "left_anti"),
            "unknown-verification-ref", ERROR, F.col("example_id")),
        finding(not_applied, "ledger-entry-not-applied", WARNING, F.col("ref")),
    ]
    return reduce(DataFrame.unionByName, parts)


def apply_ledger(examples: DataFrame, ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """Examples with the ledger's decisions written in; the later entry wins, unresolved ones are skipped."""
    decided = ledger.where(F.col("outcome").isin("confirmed", "changed")).join(entries, "ref")
    body = F.struct("category", "subcategory", "verifier", "verified_on", "ref")
    last = decided.groupBy("example_id").agg(F.max_by(body, F.struct("verified_on", "ref")).alias("d"))
    pick = lambda new, old: F.coalesce(F.col(f"d.{new}"), F.col(old)).alias(old)
    kept = [c for c in examples.columns if c not in ("category", "subcategory", "label_verified_by", "label_verified_on", "label_verification_ref")]
    return examples.join(last, "example_id", "left").select(
        *kept, pick("category", "category"), pick("subcategory", "subcategory"), pick("verifier", "label_verified_by"),
        pick("verified_on", "label_verified_on"), pick("ref", "label_verification_ref"))


def verification_worksheet(examples: DataFrame) -> DataFrame:
    """One blank row per product still to be verified: its examples, photographs, and every label drafted for it.

    The lists hold one product's distinct values, in order.
    """
    label = F.concat_ws("/", "category", "subcategory")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "; ")
    open_ = examples.where(F.col("label_verified_by").isNull()) if "label_verified_by" in examples.columns else examples
    return open_.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("examples"), F.count_distinct("image_sha256").alias("images"), listed(label).alias("drafted_label"),
        listed("example_id").alias("example_ids"), listed("image_sha256").alias("image_digests")).withColumn("verifier", F.lit("")).withColumn("outcome", F.lit(""))


def worksheet_lines(examples: DataFrame) -> DataFrame:
    """(product_id, line, value): the worksheet as a table, one row per distinct example, photograph and drafted label still to be verified.

    ``verification_worksheet`` puts a product's lists into one row; here a product with any number of examples spreads over all tasks.
    Null values have no line.
    """
    open_ = examples.where(F.col("label_verified_by").isNull()) if "label_verified_by" in examples.columns else examples
    line = lambda kind, value: F.struct(F.lit(kind).alias("line"), value.cast("string").alias("value"))
    lines = F.array(line("example", F.col("example_id")), line("image", F.col("image_sha256")), line("drafted_label", F.concat_ws("/", "category", "subcategory")))
    return open_.select("product_id", F.inline(lines)).where("value IS NOT NULL").distinct()


def verification_summary(examples: DataFrame, ledger: DataFrame) -> DataFrame:
    v = F.col("label_verified_by").isNotNull()
    a = examples.agg(F.count(F.lit(1)).alias("examples"), F.count_if(v).alias("verified_examples"), F.count_distinct("product_id").alias("products"),
                     F.count_distinct(F.when(v, F.col("product_id"))).alias("verified_products")).withColumn("_one", F.lit(1))
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    b = ledger.agg(F.count(F.lit(1)).alias("ledger_entries"), *[n(o) for o in V.LEDGER_OUTCOMES], F.count_distinct("verifier").alias("verifiers")).withColumn("_one", F.lit(1))
    return a.join(b, "_one").drop("_one")
