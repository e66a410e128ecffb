"""Mixing sources to target weights by Pfair scheduling.

Every source's documents are cut into blocks.  Weights are rounded to whole blocks of a period, so that block j of a source with
weight m / period has the release floor(j * period / m) and the deadline ceil((j + 1) * period / m).  Earliest deadline first fills one slot
a block; as the weights fill the period exactly, the order repeats from period to period, and at any slot each source is
less than one block away from its share.  Only one period is worked out on the driver (its length is a parameter); a block's slot
follows by arithmetic, so the work on documents is joins with a table of one period and window ranks.

In `schedule` the mix ends at the first slot whose source has no block left; later blocks are outside it (``mixed`` false), since
any of them would bend the shares.  `schedule_all` goes on: a new phase of releases and deadlines gives the dry source's slots to the
others by their renormalised weights, until every block has a slot.  It has at most one phase a source, worked out on the driver.
Documents of a source come in the order of md5(id): a fixed shuffle.  Ranks are taken inside buckets
of leading md5 digits, as many as the input needs, so a source that holds most rows is no single task.

A null source is a source of its own.  Rows are ranked by distinct (source, id), so repeated rows share a slot; a null id is one
such id.  Empty texts count like any other.  An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from attesta.llm.common import written

#: Documents of a block, slots of a period, and the power of a source's size that is its default weight.
BLOCK, PERIOD, POWER = 8, 1000, 0.7
#: Rows of one source in a rank bucket, about.
BUCKET_ROWS = 50_000


def whole_weights(weights: dict[str | None, float], period: int) -> dict[str | None, int]:
    """Blocks of each source in a period: largest remainders, at least one each."""
    period = max(period, len(weights))
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, math.floor(x)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (out[s] - exact[s], str(s)))
    while sum(out.values()) < period:
        for s in by_rest:
            if sum(out.values()) < period:
                out[s] += 1
    while sum(out.values()) > period:
        out[max(out, key=lambda s: (out[s], str(s)))] -= 1
    return out


def one_period(share: dict[str | None, int]) -> list[tuple[str | None, int, int, int, int]]:
    """(source, block of the period, slot, release, deadline) of one period, earliest deadline first."""
    period = sum(share.values())
    done = dict.fromkeys(share, 0)
    out = []
    for slot in range(period):
        ready = [(-(-(done[s] + 1) * period // m), str(s), s) for s, m in share.items() if done[s] < m and done[s] * period // m <= slot]
        deadline, _, s = min(ready)
        out.append((s, done[s], slot, done[s] * period // share[s], deadline))
        done[s] += 1
    return out


def ranked(df: DataFrame, id_col: str, source_col: str, block: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(source, id, block): blocks of each source's distinct ids in the order of md5(id)."""
    ids = df.select(F.col(source_col).alias("source"), F.col(id_col).alias("id")).distinct()
    ids = written(ids.withColumn("digest", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))), "mix-ids")
    digits = max(1, math.ceil(math.log(max(1, ids.count()) / bucket_rows, 16))) if ids.count() else 1
    ids = ids.withColumn("bucket", F.substring("digest", 1, digits))
    counts = ids.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = written(before.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before"), "mix-buckets")
    inside = ids.withColumn("rank", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("digest", "id")) - 1)
    return inside.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).select(
        "source", "id", F.floor((F.col("before") + F.col("rank")) / block).cast("long").alias("block"))


def schedule(df: DataFrame, weights: dict[str | None, float] | None = None, power: float = POWER, block: int = BLOCK, period: int = PERIOD,
             id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(source, id, block, slot, release, deadline, mixed) of every distinct (source, id).

    ``weights`` are target shares by source (a source without one is outside the mix); by default a source's share is its number
    of blocks to the power ``power``, which damps large sources.
    """
    spark = df.sparkSession
    rows = written(ranked(df, id_col, source_col, block), "mix-ranks")
    blocks = {r.source: r.n for r in rows.groupBy("source").agg((F.max("block") + 1).alias("n")).collect()}  # one row a source
    target = {s: float(n) ** power for s, n in blocks.items()} if weights is None else {s: w for s, w in weights.items() if s in blocks and w > 0}
    share = whole_weights(target, period) if target else {}
    plan = one_period(share)
    length = len(plan)
    slots = {(s, k): slot for s, k, slot, _, _ in plan}
    horizon = min((n // share[s] * length + slots[s, n % share[s]] for s, n in blocks.items() if s in share), default=0)
    table = spark.createDataFrame([(s, share[s], k, slot, release, deadline) for s, k, slot, release, deadline in plan],
                                  "s string, m int, k int, at int, r int, d int")
    matched = rows.join(F.broadcast(spark.createDataFrame(list(share.items()), "s2 string, m2 int")), F.col("source").eqNullSafe(F.col("s2")), "left")
    matched = matched.withColumn("turn", F.floor(F.col("block") / F.col("m2"))).withColumn("k2", F.col("block") % F.col("m2"))
    timed = matched.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("s")) & (F.col("k2") == F.col("k")), "left")  # one row a slot of the period

    def moment(c: str) -> Column:
        return (F.col("turn") * length + F.col(c)).cast("long")

    slot = moment("at")
    return timed.select("source", "id", "block", slot.alias("slot"), moment("r").alias("release"), moment("d").alias("deadline"),
                        F.coalesce(slot < horizon, F.lit(False)).alias("mixed"))


def phases(blocks: dict[str | None, int], target: dict[str | None, float], period: int) -> list[tuple[int, int, dict, dict, list]]:
    """(first slot, number of slots, blocks taken before, weights, one period) of each phase; a phase ends where a source runs dry."""
    used, start, out = dict.fromkeys(blocks, 0), 0, []
    while left := {s: n - used[s] for s, n in blocks.items() if n > used[s]}:
        share = whole_weights({s: target[s] for s in left}, period)
        plan = one_period(share)
        slots = {(s, k): slot for s, k, slot, _, _ in plan}
        size = min(n // share[s] * len(plan) + slots[s, n % share[s]] for s, n in left.items())
        turns, rest = divmod(size, len(plan))
        out.append((start, size, {s: used[s] for s in left}, share, plan))
        for s in left:
            used[s] += turns * share[s]
        for s, *_ in plan[:rest]:  # in the order of slots
            used[s] += 1
        start += size
    return out


def schedule_all(df: DataFrame, power: float = POWER, block: int = BLOCK, period: int = PERIOD, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(source, id, block, phase, slot, release, deadline) of every distinct (source, id): no block is left without a slot."""
    spark = df.sparkSession
    rows = written(ranked(df, id_col, source_col, block), "mix-ranks")
    blocks = {r.source: r.n for r in rows.groupBy("source").agg((F.max("block") + 1).alias("n")).collect()}  # one row a source
    planned = phases(blocks, {s: float(n) ** power for s, n in blocks.items()}, period)
    parts, table = [], []
    for number, (start, _, before, share, plan) in enumerate(planned):
        following = planned[number + 1][2] if number + 1 < len(planned) else {}
        parts += [(s, number, before[s], following.get(s, blocks[s]), start, len(plan), m) for s, m in share.items()]
        table += [(number, s, k, slot, release, deadline) for s, k, slot, release, deadline in plan]
    parts = spark.createDataFrame(parts, "s2 string, phase int, low long, high long, start long, length long, m int")
    table = spark.createDataFrame(table, "p int, s string, k int, at int, r int, d int")
    inside = F.col("source").eqNullSafe(F.col("s2")) & (F.col("block") >= F.col("low")) & (F.col("block") < F.col("high"))
    placed = rows.join(parts, inside).withColumn("turn", F.floor((F.col("block") - F.col("low")) / F.col("m"))).withColumn("k2", (F.col("block") - F.col("low")) % F.col("m"))
    timed = placed.join(table, (F.col("phase") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("k2") == F.col("k")))
    moments = [(F.col("start") + F.col("turn") * F.col("length") + F.col(c)).cast("long").alias(name) for c, name in (("at", "slot"), ("r", "release"), ("d", "deadline"))]
    return timed.select("source", "id", "block", "phase", *moments)
