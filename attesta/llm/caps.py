"""Near-duplicate vectors by spherical-cap filters.

Directions come from a random product code: the turned vector is cut into two blocks, each with its own list of random unit
vectors, and every pair of one from either list is a filter.  A vector is in all filters whose direction it exceeds a threshold
with, and in its ``per_vector`` best ones whether or not it exceeds them; they are listed from the two short score lists without trying all pairs.  Vectors that share a filter and a label
are compared in double precision, each pair in its smallest shared filter only, so link counts need no shuffle of pairs.

Equal vectors of a label are one row of the search, with their number.  Large filters are compared as pairs of blocks.
The number of filters follows the largest label, so a filter's load stays level as the data grow; the threshold is set so that
a vector exceeds ``per_vector`` filters on average.  At more filters the threshold rises, and more and more vectors would exceed few
or none; the best ones keep the recall level.  Vectors that are null, zero, or hold null or non-finite components, and rows
without a label or an id, link with nothing.  Recall against brute force is measured in the tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attesta.llm.common import block_pairs, written
from attesta.llm.components import components
from attesta.llm.groups import forest, whole_groups

#: Filters of a vector on average, vectors of a filter (and label) on average, rows of a block.
PER_VECTOR, PER_FILTER, BLOCK = 16, 24, 1024


class Code:
    """Random product code for ``dims`` dimensions: a rotation, two lists of unit vectors, and the threshold."""

    def __init__(self, dims: int, side: int, per_vector: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        self.half = (dims + 1) // 2
        self.lists = [_unit(rng.normal(size=(side, d))) for d in (self.half, dims - self.half) if d]
        probe = _unit(rng.normal(size=(512, dims))) @ self.turn
        a, b = self._scores(probe)
        some = rng.integers(0, side, (2, 512, 8192))
        sums = np.take_along_axis(a, some[0], 1) + np.take_along_axis(b, some[1], 1)
        self.least = min(int(np.ceil(per_vector)), side)
        self.threshold = float(np.quantile(sums, 1 - min(1.0, per_vector / (side * side))))

    def _scores(self, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = turned[:, :self.half] @ self.lists[0].T
        return a, turned[:, self.half:] @ self.lists[1].T if len(self.lists) > 1 else np.zeros_like(a)

    def filters(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that the unit vectors exceed, and of the ``least`` best of each, in order of row and filter."""
        a, b = self._scores(unit @ self.turn)
        row, i = np.nonzero(a + b.max(1, keepdims=True) >= self.threshold)
        width = a.shape[1] * b.shape[1]
        out = [self._best(a, b) + np.arange(len(a))[:, None] * width]
        for s in range(0, len(row), 4096):
            k, j = np.nonzero(a[row[s:s + 4096], i[s:s + 4096], None] + b[row[s:s + 4096]] >= self.threshold)
            out.append(row[s:s + 4096][k] * width + i[s:s + 4096][k] * b.shape[1] + j)
        return np.divmod(np.unique(np.concatenate([x.ravel() for x in out])), width)

    def _best(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ``least`` filters of highest score of each row: both directions are among the ``least`` best of their lists."""
        i, j = (np.argpartition(-x, self.least - 1, 1)[:, :self.least] for x in (a, b))
        sums = (np.take_along_axis(a, i, 1)[:, :, None] + np.take_along_axis(b, j, 1)[:, None, :]).reshape(len(a), -1)
        at = np.argpartition(-sums, self.least - 1, 1)[:, :self.least]
        return np.take_along_axis(i, at // self.least, 1) * b.shape[1] + np.take_along_axis(j, at % self.least, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(vec: str) -> F.Column:
    """The vector has components, all finite, and not all zero."""
    v = F.col(vec)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & F.coalesce(good, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def near_vectors(df: DataFrame, least: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 per_vector: int = PER_VECTOR, per_filter: int = PER_FILTER, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links are pairs of one label with a cosine of ``least`` or more."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    good = rows.where(usable("vec") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0).cast("float")))
    good = written(good, "vectors")
    classes = written(good.groupBy("label", "vec").agg(F.min("vec_id").cast("long").alias("id"), F.count(F.lit(1)).alias("copies")), "vector-classes")
    largest = classes.groupBy("label", F.size("vec").alias("dims")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"), F.collect_set("dims").alias("dims")).first()
    found = None
    for dims in sorted(largest.dims or []):  # vectors of different dimensions have no cosine
        side = max(8, int(np.ceil(np.sqrt(largest.n * per_vector / per_filter))))
        part = _links(classes.where(F.size("vec") == dims), Code(dims, side, per_vector), least, block)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = written(found, "vector-links")
    named = components(found.where("b IS NOT NULL").select("a", "b"))
    counted = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    by_class = written(
        classes.join(named, classes.id == named.node, "left").join(counted, classes.id == counted.a, "left")
        .select("label", "vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")),
        "vector-components")
    linked = good.join(by_class, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~(usable("vec") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()))
    return linked.union(alone.select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(classes: DataFrame, code, least: float, block: int) -> DataFrame:
    """(a, b, n): links (a, b) that span those found, and with b null the number n of other vectors linked to a."""
    kind = classes.schema["label"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                vec = np.array(part.column(1).values.to_numpy(zero_copy_only=False)[part.column(1).offsets[0].as_py():part.column(1).offsets[-1].as_py()]).reshape(part.num_rows, -1)
                row, filters = code.filters(_unit(vec.astype(np.float64)))
                lists = np.split(filters.astype(np.int32), np.searchsorted(row, np.arange(1, part.num_rows)))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), part.column(3), pa.array([x.tobytes() for x in vec], pa.binary()), pa.array([x.tolist() for x in lists], pa.list_(pa.int32())),
                ], names=["label", "id", "copies", "vec", "filters"])

    dtype = np.float64 if "double" in classes.schema["vec"].dataType.simpleString() else np.float32
    listed = classes.select("label", "vec", "id", "copies").mapInArrow(decode, f"label {kind}, id long, copies long, vec binary, filters array<int>")
    keyed = listed.withColumn("filter", F.explode("filters"))
    keys = ["label", "filter", "b1", "b2"]
    laid = block_pairs(keyed, ["label", "filter"], F.col("id"), block).select(*keys, "block", "id", "copies", "vec", "filters")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, keys):
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                own = table.slice(s, e - s)
                vec = np.frombuffer(b"".join(own.column("vec").to_pylist()), dtype).reshape(e - s, -1).astype(np.float64)
                linked = cosines(vec) >= least
                np.fill_diagonal(linked, False)
                side = own.column("block").to_numpy()
                if own.column("b1")[0].as_py() != own.column("b2")[0].as_py():
                    linked &= side[:, None] != side[None, :]
                if not linked.any():
                    continue
                ids = own.column("id").to_numpy()
                some = np.flatnonzero(linked.any(1))
                linked, ids, copies = linked[np.ix_(some, some)], ids[some], own.column("copies").to_numpy()[some]
                label = forest(linked)
                at = np.flatnonzero(label != np.arange(len(some)))
                first = linked & ~shared_before(own.column("filters").take(pa.array(some)).to_pylist(), own.column("filter")[0].as_py())
                n = first.astype(np.int64) @ copies
                counted = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate((ids[at], ids[counted]))),
                    pa.array(np.concatenate((ids[label[at]], np.zeros(len(counted), np.int64))), mask=np.arange(len(at) + len(counted)) >= len(at)),
                    pa.array(np.concatenate((np.zeros(len(at), np.int64), n[counted]))),
                ], names=["a", "b", "n"])

    return laid.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long, n long")


def cosines(vec: np.ndarray) -> np.ndarray:
    norm = np.sqrt((vec * vec).sum(1))
    return (vec @ vec.T) / np.outer(norm, norm)


def shared_before(filters: list[list[int]], limit: int) -> np.ndarray:
    """Whether two rows share a filter below ``limit``."""
    below = [[f for f in row if f < limit] for row in filters]
    place: dict[int, int] = {}
    for row in below:
        for f in row:
            place.setdefault(f, len(place))
    held = np.zeros((len(below), max(1, len(place))), np.float32)
    for i, row in enumerate(below):
        held[i, [place[f] for f in row]] = 1
    return held @ held.T > 0
