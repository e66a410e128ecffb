"""Exact order statistics by refining value ranges.

For every wanted rank the values that may still hold it lie in one range.  A pass counts the values of each range by equal buckets
(combined map-side, with the smallest and largest value met in each), and the bucket that holds the rank is the next range.  A few
passes leave at most ``limit`` rows a rank, which are then ordered, or one single value.  No group is sorted or windowed as a
whole, so a single group of any size spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from attesta.session import Written

#: Buckets of a range, and rows of a rank that may be ordered in one task.
BUCKETS, LIMIT = 1024, 10_000


def order_statistics(df: DataFrame, value: str, ranks: Mapping[str, Callable[[Column], Column]], *by: str, buckets: int = BUCKETS, limit: int = LIMIT) -> DataFrame:
    """(by.., n, one column a rank): the value at each 0-based rank of its group in ascending order.

    ``ranks`` maps a name to a function from the group's size to a rank; a rank outside the group is null.  Nulls and NaN are not
    values; a group without values is not in the result.  Null group keys are a group.
    """
    keep = Written(df.sparkSession)
    rows = df.select(*[F.col(b) for b in by], F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in by] or F.lit(True)
    n = F.col("n")
    targets = F.array(*[F.struct(F.lit(name).alias("name"), rank(n).cast("long").alias("rank")) for name, rank in ranks.items()])
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")).where("n > 0")
    sizes = keep(sizes, "sizes")
    # rank: how many values of the range come before the wanted one
    wanted = sizes.select(*by, "n", "low", "high", F.explode(targets).alias("t")).select(*by, "t.name", "t.rank", "low", "high", F.col("n").alias("inside")).where("rank >= 0 AND rank < inside")
    wanted = keep(wanted, "ranges")
    while wanted.where((F.col("inside") > limit) & (F.col("low") < F.col("high"))).limit(1).count():
        wide = wanted.where((F.col("inside") > limit) & (F.col("low") < F.col("high")))
        done = wanted.where((F.col("inside") <= limit) | (F.col("low") >= F.col("high")))
        met = rows.join(wide, same(rows, wide)).where(F.col("_v").between(F.col("low"), F.col("high")))
        # halves first, so that the width of a range of any size is finite
        share = (F.col("_v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        bucket = F.least(F.lit(buckets - 1), F.floor(share * buckets)).cast("int")
        counts = met.select(*[wide[b] for b in by], "name", "rank", bucket.alias("bucket"), "_v").groupBy(*by, "name", "rank", "bucket").agg(
            F.count(F.lit(1)).alias("inside"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        upto = Window.partitionBy(*by, "name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # at most ``buckets`` rows
        found = counts.withColumn("_upto", F.sum("inside").over(upto)).where((F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col("inside") <= F.col("rank")))
        narrowed = found.select(*by, "name", (F.col("rank") - (F.col("_upto") - F.col("inside"))).alias("rank"), "low", "high", "inside")
        wanted = keep(narrowed.unionByName(done), "ranges")
        keep.keep_last("ranges", 2)
    single = wanted.where("low = high").select(*by, "name", F.col("low").alias("_v"))
    few = wanted.where("low < high")
    met = rows.join(few, same(rows, few)).where(F.col("_v").between(F.col("low"), F.col("high"))).select(*[few[b] for b in by], "name", "rank", "_v")
    place = F.row_number().over(Window.partitionBy(*by, "name").orderBy("_v")) - 1  # at most ``limit`` rows
    rest = met.withColumn("_place", place).where("_place = rank").select(*by, "name", "_v")
    wide = single.unionByName(rest).groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in ranks])
    joined = sizes.join(wide, same(sizes, wide), "left")
    return joined.select(*[sizes[b] for b in by], sizes["n"], *[wide[name] for name in ranks])


#: Ranks of the median's two middle values and of the 95th percentile.
MEDIAN_AND_P95 = {
    "_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.ceil((n - 1) / 2), "p95": lambda n: F.floor(0.95 * (n - 1))}


def summary(df: DataFrame, value: str, *by: str, buckets: int = BUCKETS, limit: int = LIMIT) -> DataFrame:
    """(by.., n, mean, median, p95, max) of each group, to four decimals."""
    found = order_statistics(df, value, MEDIAN_AND_P95, *by, buckets=buckets, limit=limit)
    given = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    sums = given.groupBy(*by).agg(F.avg(value).alias("mean"), F.max(F.col(value).cast("double")).alias("max"))
    joined = found.join(sums, [found[c].eqNullSafe(sums[c]) for c in by] or F.lit(True))
    r4 = lambda c: F.round(c, 4)
    return joined.select(*[found[b] for b in by], "n", r4("mean").alias("mean"), r4((F.col("_low") + F.col("_high")) / 2).alias("median"), r4("p95").alias("p95"), r4("max").alias("max"))
