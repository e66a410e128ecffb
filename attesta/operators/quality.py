"""Extraction quality (annotations x predictions) and classification metrics, as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attesta import vocabulary as V
from attesta.functions import text as T

OUTCOMES = ("true_positive", "false_positive", "false_negative", "true_negative", "fabricated", "correct_unread",
            "missed_unread", "value_correct", "value_incorrect", "excluded")


#: What the tables say of a cell; each leaves the others' part null.
_FACTS = {"supported": "boolean", "state": "string", "value": "string", "expected": "string", "emitted": "boolean",
          "raw_value": "string", "committed": "boolean", "uncertain": "boolean", "forms": "array<string>", "line": "string", "unread": "boolean"}


def key_grid(samples: DataFrame, keys=V.SUPPORTED_KEYS, by: tuple[str, ...] = ()) -> DataFrame:
    """(sample_id, key) over the whole vocabulary; exploded from a literal array, not a join."""
    return samples.select("sample_id", *by, F.explode(F.array(*[F.lit(k) for k in keys])).alias("key"))


def outcome_cells(samples: DataFrame, annotations: DataFrame, predictions: DataFrame, unread: DataFrame,
                  keys=V.SUPPORTED_KEYS, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per (sample, key): truth state, what was predicted, and whether the value matches.

    ``annotations``: sample_id, key, state, value.  ``predictions``: sample_id, key, raw_value,
    values (comparable strings), committed, uncertain.  ``unread``: sample_id, key.  All of them and the grid of supported
    keys are united and folded by (sample, key) in one aggregation.  An annotation whose key nobody extracts is a cell of
    its own with an unknown truth, so it is counted as excluded and nowhere else; samples not listed have no cells.  Such annotations
    are taken aside first, so nothing is folded twice.  ``by``: further columns of all tables and of the cells, such as a configuration.
    """
    value, raw = F.col("value"), F.col("raw_value")
    own, known = ("sample_id", *by), F.coalesce(F.col("key").isin(*keys), F.lit(False))
    extra = annotations.where(~known).join(samples.select(*own), list(own), "left_semi").groupBy(*own, "key").agg(F.max("value").alias("value"))
    annotations, predictions, unread = (df.where(known) for df in (annotations, predictions, unread))
    said = lambda df, **given: df.select(*own, "key", *[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in _FACTS.items()])
    facts = (
        said(key_grid(samples, keys, by), supported=F.lit(True))
        .union(said(annotations, state=F.col("state"), value=value, expected=T.comparison_form(F.coalesce(value, F.lit("")))))
        .union(said(predictions, emitted=F.lit(True), raw_value=raw, committed=F.col("committed"), uncertain=F.col("uncertain"),
                    forms=T.comparison_forms(F.col("values")), line=T.comparison_form(raw)))
        .union(said(unread, unread=F.lit(True)))
    )
    cells = facts.groupBy(*own, "key").agg(*[F.max(n).alias(n) for n in _FACTS]).where("supported")
    cells = cells.union(extra.select(*own, "key", *[(F.col(n) if n == "value" else F.lit(None).cast(t)).alias(n) for n, t in _FACTS.items()]))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    match = T.value_matches(F.col("expected"), F.col("forms"), F.col("line"))
    return cells.select(
        *own, "key", F.coalesce("state", F.lit("unknown")).alias("state"), "value", "raw_value",
        flag("emitted").alias("emitted"), (flag("emitted") & flag("committed")).alias("has_value"),
        ((flag("emitted") & ~flag("committed")) | flag("unread")).alias("declined"),
        (flag("emitted") & flag("uncertain")).alias("uncertain"), F.coalesce(match, F.lit(False)).alias("matches"),
    ).withColumn("kind", disagreement_kind())


def _cell():
    return F.col("state"), F.col("has_value"), F.col("declined"), F.col("matches")


def disagreement_kind() -> Column:
    """Which disagreement a cell is, null when truth and prediction agree or truth is unknown."""
    state, value, declined, match = _cell()
    return (
        F.when((state == "present_and_readable") & value & ~match, F.lit("wrong_value"))
        .when((state == "present_and_readable") & ~value, F.lit("missed_readable_declaration"))
        .when((state == "present_but_unreadable") & value, F.lit("fabricated_value"))
        .when((state == "present_but_unreadable") & ~declined, F.lit("missed_unread_declaration"))
        .when((state == "not_present") & value, F.lit("value_for_absent_declaration"))
        .when((state == "not_present") & declined, F.lit("named_an_absent_declaration"))
    )


def _counts() -> dict[str, Column]:
    state, value, declined, match = _cell()
    readable, hidden, absent = (state == s for s in V.TRUTH_STATES[:3])
    return {
        "true_positive": readable & value, "false_negative": readable & ~value,
        "false_positive": (hidden & value) | (absent & (value | declined)), "true_negative": absent & ~value & ~declined,
        "fabricated": hidden & value, "correct_unread": hidden & ~value & declined,
        "missed_unread": hidden & ~value & ~declined, "value_correct": readable & value & match,
        "value_incorrect": readable & value & ~match, "excluded": state == "unknown",
    }


def rates(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and value accuracy; null on an empty denominator."""
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    df = df.withColumn("precision", F.try_divide(tp, tp + fp)).withColumn("recall", F.try_divide(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("f1", F.try_divide(2 * p * r, p + r)).withColumn(
        "value_accuracy", F.try_divide(F.col("value_correct"), F.col("value_correct") + F.col("value_incorrect")))


def per_key(cells: DataFrame, *by: str) -> DataFrame:
    """The outcome table per declaration (or any other grouping), with its rates."""
    return rates(cells.groupBy(*(by or ("key",))).agg(*[F.count_if(c).alias(n) for n, c in _counts().items()]))


def micro(cells: DataFrame) -> DataFrame:
    return rates(cells.agg(*[F.count_if(c).alias(n) for n, c in _counts().items()]))


def per_condition(cells: DataFrame, sample_conditions: DataFrame) -> DataFrame:
    """Outcome table per photograph condition; ``sample_conditions`` is (sample_id, condition)."""
    return per_key(cells.join(sample_conditions, "sample_id"), "condition")


def uncertainty(cells: DataFrame) -> DataFrame:
    """Three rates, each over its own population.  Cells whose truth is unknown are outside all of them."""
    known = F.col("state") != "unknown"
    value, unsure, wrong = F.col("has_value"), F.col("uncertain"), F.col("kind").isin(
        "wrong_value", "fabricated_value", "value_for_absent_declaration")
    counted = cells.where(known).agg(
        F.count_if("emitted").alias("extracted_fields"), F.count_if(F.col("emitted") & unsure).alias("flagged_uncertain"),
        F.count_if(value).alias("committed_readings"), F.count_if(value & unsure).alias("flagged_uncertain_committed"),
        F.count_if(value & unsure & wrong).alias("uncertain_and_wrong"), F.count_if(value & ~unsure).alias("confident_total"),
        F.count_if(value & ~unsure & wrong).alias("confident_and_wrong"),
    )
    return counted.select(
        "*", F.try_divide("flagged_uncertain", "extracted_fields").alias("uncertain_rate"),
        F.try_divide("uncertain_and_wrong", "flagged_uncertain_committed").alias("uncertainty_precision"),
        F.try_divide("confident_and_wrong", "confident_total").alias("silent_error_rate"))


def text_accuracy(pairs: DataFrame) -> DataFrame:
    """CER and WER over (reference, hypothesis); samples without a reference are skipped and counted."""
    squeeze = lambda c: T.collapse(F.col(c))
    rows = pairs.select(squeeze("reference").alias("r"), F.coalesce(squeeze("hypothesis"), F.lit("")).alias("h"))
    scored = F.coalesce(F.length("r") > 0, F.lit(False))
    words = lambda c: F.when(F.length(c) > 0, F.split(F.col(c), " ")).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("scored", scored).withColumn("rw", words("r")).withColumn("hw", words("h"))
    only = lambda c: F.coalesce(F.sum(F.when(F.col("scored"), c)), F.lit(0)).cast("bigint")
    total = rows.agg(
        F.count_if("scored").alias("scored_samples"), F.count_if(~F.col("scored")).alias("skipped_samples"),
        only(F.levenshtein("h", "r")).alias("character_errors"), only(F.length("r")).alias("reference_characters"),
        only(T.word_levenshtein(F.col("hw"), F.col("rw"))).alias("word_errors"), only(F.size("rw")).alias("reference_words"),
    )
    return total.withColumn("cer", F.try_divide("character_errors", "reference_characters")).withColumn(
        "wer", F.try_divide("word_errors", "reference_words"))


def sample_summary(cells: DataFrame) -> DataFrame:
    return cells.groupBy("sample_id").agg(
        F.count_if("has_value").alias("fields_with_value"),
        F.count_if(F.col("emitted") & ~F.col("has_value")).alias("fields_withheld"),
        F.count_if(F.col("declined") & ~F.col("emitted")).alias("unread_declarations"))


def split_failures(predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scorable, failures): a crashed sample is listed and kept out of every score."""
    crashed = F.col("error").isNotNull()
    return predictions.where(~crashed), predictions.where(crashed)


# --- classification -------------------------------------------------------------------------


def confusion(pairs: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """(truth, prediction, n) with zero cells kept and an ``unknown`` prediction column."""
    spark = pairs.sparkSession
    counts = pairs.groupBy("truth", F.coalesce("prediction", F.lit(V.UNKNOWN)).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))
    grid = V.inline_table(spark, ("truth", "prediction"), [(t, p) for t in labels for p in (*labels, V.UNKNOWN)])
    return grid.join(counts, ["truth", "prediction"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def outside_vocabulary(pairs: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Rows the confusion matrix must refuse."""
    known = lambda c: F.coalesce(F.col(c).isin(*labels), F.lit(c == "prediction"))
    unknown = F.coalesce(F.col("prediction") == V.UNKNOWN, F.lit(False))
    return pairs.where(~known("truth") | ~(known("prediction") | unknown))


def per_class(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 (0.0 when undefined), support and predicted count of each label."""
    support = matrix.groupBy(F.col("truth").alias("label")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("prediction"), F.col("n"))).alias("tp"))
    predicted = matrix.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("predicted"))
    df = support.join(predicted, "label")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    df = df.withColumn("precision", zero(F.try_divide("tp", "predicted"))).withColumn("recall", zero(F.try_divide("tp", "support")))
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("f1", zero(F.try_divide(2 * p * r, p + r))).withColumn(
        "undefined_precision", (F.col("predicted") == 0) & (F.col("support") > 0)).drop("tp")


def overall(matrix: DataFrame) -> DataFrame:
    """Strict accuracy, accuracy on predicted, unknown rate, and macro averages over supported labels."""
    has = F.col("support") > 0
    macro = per_class(matrix).agg(
        *[F.coalesce(F.avg(F.when(has, F.col(c))), F.lit(0.0)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    n, right = F.col("n"), F.col("truth") == F.col("prediction")
    unsure = F.col("prediction") == V.UNKNOWN
    totals = matrix.agg(F.sum("n").alias("n_total"), F.sum(F.when(unsure, n)).alias("n_unknown"),
                        F.coalesce(F.sum(F.when(right, n)), F.lit(0)).alias("n_correct"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rates_ = totals.select(
        "*", zero(F.col("n_correct"), F.col("n_total")).alias("strict_accuracy"),
        zero(F.col("n_correct"), F.col("n_total") - F.col("n_unknown")).alias("accuracy_on_predicted"),
        zero(F.col("n_unknown"), F.col("n_total")).alias("unknown_rate"))
    return rates_.withColumn("_one", F.lit(1)).join(macro.withColumn("_one", F.lit(1)), "_one").drop("_one")


def constant_baselines(pairs: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """What always answering one label, or always abstaining, scores: from label counts alone."""
    per = pairs.groupBy("truth").agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("classes"))
    answers = V.inline_table(pairs.sparkSession, ("answer",), [(a,) for a in (*labels, V.UNKNOWN)])
    rows = answers.join(per, answers.answer == per.truth, "left").withColumn("_one", F.lit(1)).join(
        total.withColumn("_one", F.lit(1)), "_one")
    hit = F.coalesce("n", F.lit(0))
    precision = F.try_divide(hit, F.col("total"))
    f1 = F.when(hit > 0, 2 * precision / (precision + 1)).otherwise(0.0)
    abstain = F.col("answer") == V.UNKNOWN
    return rows.select(
        "answer", F.coalesce(precision, F.lit(0.0)).alias("strict_accuracy"),
        F.when(abstain, 0.0).otherwise(F.coalesce(precision, F.lit(0.0))).alias("accuracy_on_predicted"),
        F.when(abstain, 1.0).otherwise(0.0).alias("unknown_rate"), F.coalesce(f1 / F.col("classes"), F.lit(0.0)).alias("macro_f1"))


def _committed() -> Column:
    return F.col("prediction").isNotNull() & (F.col("prediction") != V.UNKNOWN) & F.col("confidence").isNotNull()


def threshold_sweep(predictions: DataFrame, thresholds=V.THRESHOLDS) -> DataFrame:
    """Kept, correct, accuracy and coverage at each threshold; coverage is over every prediction.

    Each threshold is a pair of conditional sums in one pass, then unpivoted.
    """
    ok, right = _committed(), F.col("prediction") == F.col("truth")
    aggs = [F.count(F.lit(1)).alias("total")]
    for k, t in enumerate(thresholds):
        keep = ok & (F.col("confidence") >= t)
        aggs += [F.count_if(keep).alias(f"k{k}"), F.count_if(keep & right).alias(f"c{k}")]
    wide = predictions.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(t).alias("min_confidence"), F.col(f"k{k}").alias("n_committed"), F.col(f"c{k}").alias("n_correct"))
                     for k, t in enumerate(thresholds)])
    return wide.select("total", F.explode(rows).alias("r")).select(
        "r.*", F.round(F.try_divide("r.n_correct", "r.n_committed"), 4).alias("accuracy_on_predicted"),
        F.coalesce(F.round(F.try_divide("r.n_committed", "total"), 4), F.lit(0.0)).alias("coverage"))


def confidence_separation(predictions: DataFrame) -> DataFrame:
    rows = predictions.where(_committed()).withColumn("right", F.col("prediction") == F.col("truth"))
    c = F.col("confidence")
    part = lambda flag, name: [
        F.count_if(flag).alias(f"{name}_n"), F.round(F.min(F.when(flag, c)), 4).alias(f"{name}_min"),
        F.round(F.max(F.when(flag, c)), 4).alias(f"{name}_max"), F.round(F.avg(F.when(flag, c)), 4).alias(f"{name}_mean")]
    right = F.col("right")
    agg = rows.agg(*part(right, "correct"), *part(~right, "wrong"),
                   (F.min(F.when(right, c)) > F.max(F.when(~right, c))).alias("separable"))
    return agg.withColumn("separable", F.coalesce("separable", F.lit(False)))


def per_product(predictions: DataFrame) -> DataFrame:
    """Held-out result of each product; distinct answers are few (the label set), so they are listed."""
    given = F.when(F.col("prediction") != "", F.col("prediction"))
    return predictions.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n_examples"), F.count_if(F.col("prediction") == F.col("truth")).alias("n_correct"),
        F.count_if(F.coalesce(F.col("prediction") == V.UNKNOWN, F.lit(True))).alias("n_unknown"),
        F.array_join(F.array_sort(F.collect_set(given)), ",").alias("predicted"))


def latency_summary(measurements: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """Mean, median, p95 and max.  p95 is the element at floor(0.95 * (n - 1)) of the sorted values.

    The order statistics come from refined value ranges (`orderstats`), so a group of any size is spread over all tasks.
    """
    from attesta.operators import orderstats as O

    return O.summary(measurements, value, *([group] if group else [])).drop("n")
