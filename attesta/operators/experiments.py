"""Comparing configurations: one table of predictions that carries a configuration column, one row of figures for each requested one.

Nothing is run once per configuration: scans, tokenising and joins are shared, and the configuration is part of the grouping key.
A requested configuration without predictions is a row that says so, never a silent repeat of another one's figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attesta import vocabulary as V
from attesta.operators import quality as Q

AVAILABLE, UNAVAILABLE = "measured", "not available"


def category_of(subcategory: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for s, c, _ in V.TAXONOMY for x in (s, c)])
    return F.try_element_at(pairs, subcategory)


def both_levels(decisions: DataFrame, *by: str) -> DataFrame:
    """(by.., level, truth, prediction): each decision once by category and once by subcategory, in one pass.

    ``decisions``: truth (a subcategory), category and subcategory as decided.  A decision of the category alone abstains below.
    """
    levels = F.array(
        F.struct(F.lit("category").alias("level"), category_of(F.col("truth")).alias("truth"), F.col("category").alias("prediction")),
        F.struct(F.lit("subcategory").alias("level"), F.col("truth").alias("truth"), F.col("subcategory").alias("prediction")))
    return decisions.select(*by, F.explode(levels).alias("_l")).select(*by, "_l.*")


def label_figures(pairs: DataFrame, *by: str) -> DataFrame:
    """(by.., label, support, predicted, tp, precision, recall, f1): one aggregation however many groups there are.

    A label counts where it is true or predicted; undefined ratios are 0.  An abstention predicts nothing.
    """
    said = F.when(F.col("prediction") != V.UNKNOWN, F.col("prediction"))
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.lit(1).alias("s"), F.lit(0).alias("p"), F.coalesce((said == F.col("truth")).cast("int"), F.lit(0)).alias("t")),
        F.struct(said.alias("label"), F.lit(0).alias("s"), F.lit(1).alias("p"), F.lit(0).alias("t")))
    sums = pairs.select(*by, F.explode(sides).alias("_x")).where("_x.label IS NOT NULL").groupBy(*by, F.col("_x.label").alias("label")).agg(
        F.sum("_x.s").alias("support"), F.sum("_x.p").alias("predicted"), F.sum("_x.t").alias("tp"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = sums.withColumn("precision", zero(F.try_divide("tp", "predicted"))).withColumn("recall", zero(F.try_divide("tp", "support")))
    return out.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def figures(pairs: DataFrame, *by: str) -> DataFrame:
    """(by.., n_total, n_unknown, n_correct, strict_accuracy, accuracy_on_predicted, unknown_rate, macro_precision, macro_recall, macro_f1) of each group."""
    unsure = F.coalesce(F.col("prediction") == V.UNKNOWN, F.lit(True))
    totals = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(unsure).alias("n_unknown"), F.count_if(F.col("prediction") == F.col("truth")).alias("n_correct"))
    macro = label_figures(pairs, *by).where("support > 0").groupBy(*by).agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    same = [totals[c].eqNullSafe(macro[c]) for c in by]
    joined = totals.join(macro, same, "left").select(*[totals[c] for c in totals.columns], *[F.coalesce(macro[f"macro_{c}"], F.lit(0.0)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    return joined.withColumn("strict_accuracy", zero(F.col("n_correct"), F.col("n_total"))).withColumn(
        "accuracy_on_predicted", zero(F.col("n_correct"), F.col("n_total") - F.col("n_unknown"))).withColumn("unknown_rate", zero(F.col("n_unknown"), F.col("n_total")))


def requested_rows(measured: DataFrame, requested: DataFrame) -> DataFrame:
    """Every requested configuration: its measured rows, or one row of nulls that says it is not available."""
    wanted = requested.select("configuration").distinct()
    return wanted.join(measured.withColumn("_there", F.lit(True)), "configuration", "left").withColumn(
        "status", F.when(F.col("_there"), F.lit(AVAILABLE)).otherwise(F.lit(UNAVAILABLE))).drop("_there")


def classification_grid(decisions: DataFrame, requested: DataFrame) -> DataFrame:
    """Figures at both levels of every requested configuration; ``decisions`` carries ``configuration``."""
    return requested_rows(figures(both_levels(decisions, "configuration"), "configuration", "level"), requested)


def extraction_grid(samples: DataFrame, annotations: DataFrame, predictions: DataFrame, unread: DataFrame, requested: DataFrame) -> DataFrame:
    """The outcome table of every requested configuration over the same frozen set.

    ``predictions`` and ``unread`` carry ``configuration``.  Samples and annotations are read once and repeated by the configurations that
    have predictions, so each of them is scored over the whole set.
    """
    ran = predictions.select("configuration").distinct().join(requested.select("configuration").distinct(), "configuration", "left_semi")
    names = F.array_sort(F.collect_set("configuration"))  # as many as were requested
    every = ran.agg(names.alias("names"))
    spread = lambda df: df.join(F.broadcast(every)).withColumn("configuration", F.explode("names")).drop("names")
    cells = Q.outcome_cells(spread(samples.select("sample_id")), spread(annotations), predictions, unread, by=("configuration",))
    return requested_rows(Q.per_key(cells, "configuration"), requested)
