"""Exact top-k inner products over vectors sorted by length.

Vectors become whole numbers, floor(scale * x).  They are dealt to blocks in the order of descending length, so a block's longest
vector bounds every score in it by Cauchy-Schwarz.  Vectors and queries are turned by the right singular vectors of the
whole table (from its d x d Gram matrix), which gathers their mass in the leading coordinates: a partial sum over these and
the lengths of the two rests bound a score from above.  A query's k-th best score so far is the limit that bounds are held
against; it starts from the longest block, which every query meets first.  What survives is scored in whole numbers.

Queries come in groups of bounded number.  A block of vectors goes to the query groups that its length can still serve,
and each meeting is one bounded piece of work whose survivors (at most k a query) meet in a partial top-k aggregation.

Vectors that are null, empty or hold null or non-finite components take no part, neither do null ids; a repeated id counts as
one candidate a row, except the query's own id.  Vectors of another length than most take no part in each other's lists.  Ties go
to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from attesta.llm.caps import usable
from attesta.llm.common import written
from attesta.llm.groups import whole_groups

#: Vectors of a block, queries of a group, leading coordinates of the partial sums.
BLOCK, GROUP, LEAD = 8192, 1024, 16


def whole_vectors(df: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, norm2) with vec as whole numbers."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    finite = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    rows = rows.where(F.col("id").isNotNull() & finite & (F.size("v") > 0))
    rows = rows.select("id", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("vec"))
    return rows.withColumn("norm2", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x))


def gram(rows: DataFrame, dims: int) -> np.ndarray:
    """Gram matrix of all vectors: one d x d matrix a task, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = matrix(batch.column(0), dims).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims)), pa.array(total.ravel())], names=["cell", "x"])

    cells = {r.cell: r.x for r in rows.select("vec").mapInArrow(run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect()}
    return np.array([cells.get(i, 0.0) for i in range(dims * dims)]).reshape(dims, dims)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def search(df: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding",
           block: int = BLOCK, group: int = GROUP, lead: int = LEAD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other vectors for each vector whose id is divisible by ``every``."""
    spark = df.sparkSession
    rows = written(whole_vectors(df, scale, id_col, vec_col), "whole-vectors")
    out = None
    for dims in [r.d for r in rows.groupBy(F.size("vec").alias("d")).count().orderBy("d").collect()]:
        part = _search(rows.where(F.size("vec") == dims), dims, k, every, block, group, lead)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _search(rows: DataFrame, dims: int, k: int, every: int, block: int, group: int, lead: int) -> DataFrame:
    spark = rows.sparkSession
    n = rows.count()
    queries = rows.where(F.col("id") % every == 0)
    turn = np.linalg.svd(gram(rows, dims))[0]
    # blocks by length: their limits are quantiles of the lengths, shorter blocks follow
    blocks = max(1, -(-n // block))
    marks = sorted(set(rows.agg(F.percentile_approx("norm2", [i / blocks for i in range(1, blocks)], 10 * blocks).alias("q")).first().q)) if blocks > 1 else []
    cuts = np.array(marks)
    # equal lengths can crowd one interval: it is dealt on by id into as many blocks as its number needs
    placed = rows.withColumn("interval", _interval(cuts)(F.col("norm2")))
    crowd = placed.groupBy("interval").agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("longest"))
    crowd = written(crowd.withColumn("pieces", F.ceil(F.col("n") / block).cast("int")), "length-intervals")
    placed = placed.join(crowd.select("interval", "pieces"), "interval").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    groups = max(1, -(-queries.count() // group))
    asked = queries.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), F.col("norm2").alias("qnorm2"), F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g"))
    # the longest k + some vectors set the first limits
    head = rows.orderBy(F.desc("norm2"), "id").limit(min(block, max(256, 8 * k))).select("id", "vec").collect()  # bounded by a block
    started = written(asked.mapInArrow(_start(np.array([r.id for r in head], np.int64), np.array([r.vec for r in head], np.int64), dims, k), "qid long, qvec array<bigint>, qnorm2 double, g int, least double"), "queries")
    # a group needs a block if its length bound reaches any of its queries' limits
    need = started.select("g", (F.col("least") / F.sqrt(F.greatest("qnorm2", F.lit(1e-9)))).alias("reach")).groupBy("g").agg(F.min("reach").alias("reach"))
    cells = need.join(crowd.select("interval", "pieces", "longest"), F.sqrt("longest") * (1 + 1e-9) + 1e-6 >= F.col("reach")).select("g", "interval", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    cells = written(cells, "meetings")
    left = cells.join(placed, ["interval", "piece"]).select("g", "interval", "piece", "id", "vec", F.lit(None).cast("double").alias("least"))
    right = cells.join(started, "g").select("g", "interval", "piece", F.col("qid").alias("id"), F.col("qvec").alias("vec"), "least")
    keys = ["g", "interval", "piece"]
    met = left.union(right).repartition(*keys).sortWithinPartitions(*keys)
    found = met.mapInArrow(_meet(turn, dims, k, lead, keys), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _interval(cuts: np.ndarray):
    @F.pandas_udf("int")
    def interval(norm2):
        import pandas as pd

        return pd.Series(np.searchsorted(cuts, norm2.to_numpy(), "left").astype("int32"))

    return interval


def _start(ids: np.ndarray, vecs: np.ndarray, dims: int, k: int):
    """Adds a lower bound of each query's k-th best score: its k-th best among the longest vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = (matrix(batch.column(1), dims).astype(np.int64) @ vecs.T).astype(float)
            scores[batch.column(0).to_numpy()[:, None] == ids[None, :]] = -np.inf
            least = np.sort(scores, 1)[:, -k] if scores.shape[1] >= k else np.full(len(scores), -np.inf)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(least)], names=["qid", "qvec", "qnorm2", "g", "least"])

    return run


def _meet(turn: np.ndarray, dims: int, k: int, lead: int, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, keys):
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                part = table.slice(s, e - s).combine_chunks()
                ask = part.column("least").is_valid().to_numpy()
                ids, vec = part.column("id").to_numpy(), matrix(part.column("vec").chunk(0) if part.num_rows else pa.array([]), dims)
                least = part.column("least").to_numpy()[ask]
                yield from best_of(ids[ask], vec[ask], least, ids[~ask], vec[~ask], turn, k, lead)

    return run


def best_of(qids, queries, least, ids, vectors, turn, k: int, lead: int, chunk: int = 1024) -> Iterator[pa.RecordBatch]:
    """At most k survivors for each query, by partial sums over the leading coordinates and exact scores of the rest."""
    length = np.sqrt((vectors.astype(float) ** 2).sum(1))
    order = np.lexsort((ids, -length))
    ids, vectors, length = ids[order], vectors[order], length[order]
    q, v = queries.astype(float) @ turn, vectors.astype(float) @ turn
    q_rest, v_rest = np.sqrt((q[:, lead:] ** 2).sum(1)), np.sqrt((v[:, lead:] ** 2).sum(1))
    q_len = np.sqrt((q ** 2).sum(1))
    slack = 1e-9 * (q_len * (length.max(initial=0.0)) + 1) + 1e-6
    for i in range(len(qids)):
        held_s, held_i, limit = np.empty(0, np.int64), np.empty(0, np.int64), least[i]
        for a in range(0, len(ids), chunk):
            if q_len[i] * length[a] + slack[i] < limit:
                break  # all that follow are shorter
            b = min(a + chunk, len(ids))
            bound = v[a:b, :lead] @ q[i, :lead] + q_rest[i] * v_rest[a:b] + slack[i]
            at = a + np.flatnonzero(bound >= limit)
            at = at[ids[at] != qids[i]]
            if not len(at):
                continue
            held_s = np.concatenate((held_s, vectors[at] @ queries[i]))
            held_i = np.concatenate((held_i, ids[at]))
            if len(held_s) > k:
                best = np.lexsort((held_i, -held_s))[:k]
                held_s, held_i = held_s[best], held_i[best]
            if len(held_s) >= k:
                limit = max(limit, float(held_s.min()))
        if len(held_s):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held_s), qids[i])), pa.array(held_i), pa.array(held_s)], names=["query_id", "vec_id", "score"])
