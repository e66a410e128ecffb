"""Connected components by alternating large-star and small-star steps.

Every step is one aggregation (least neighbour, combined map-side) and one join back to the edges.  Edges and least
neighbours are written to the shared folder first, so both join inputs are plain exchanges: adaptive execution can split a
hub with very many neighbours, and lineage stays short.  Nothing is collected but a count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from attesta.llm.common import new_path, remove, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected ``edges`` (a, b); a component's name is its smallest node.

    Null ends and loops are ignored; repeated edges count once; without edges the result is empty.
    """
    spark = edges.sparkSession
    path = new_path(spark, "edges")
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "", path)
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, used = _star(both, "v > u")
        large, aside = _written(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        remove(spark, used)
        small, used = _star(large, None)
        following, path_2 = _written(small.where("u <> v").distinct())
        for p in (used, aside, path):
            remove(spark, p)
        now, path = following, path_2
        before, mark = mark, _mark(now)
        if before == mark:
            break
    # all edges now lead from a node to the smallest of its component
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _star(edges: DataFrame, keep: str | None) -> tuple[DataFrame, str]:
    """Each neighbour of u (and for small stars u itself) tied to the least of u and its neighbours."""
    least, path = _written(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    joined = edges.join(least, "u")
    if keep:
        return joined.where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")), path
    return joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")), path


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    path = new_path(df.sparkSession, "edges")
    return written(df, "", path), path


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row.n, row.h
