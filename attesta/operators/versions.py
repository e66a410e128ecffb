"""Dataset versions by content: digests of row digests, a registry that holds them to their names, and differences between versions.

A version is a set of keyed rows.  Each row has a digest; rows fall into buckets by their key; a bucket's digest combines its rows'
digests whatever their order, and the version's digest is that of its buckets in order.  So the digest needs one aggregation and
no sort, equal content gives an equal digest however it is stored, and two versions are compared bucket by bucket first: rows are
read side by side only where bucket digests differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attesta.operators import audit as A

BUCKETS = 256


def row_digests(rows: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """(key, bucket, digest): SHA-256 of each row's columns in the order of their names; null and empty differ."""
    columns = sorted(c for c in rows.columns if c != key)
    body = F.to_json(F.struct(F.col(key).alias(key), *[F.col(c) for c in columns]), {"ignoreNullFields": "false"})
    return rows.select(F.col(key).alias("key"), F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"), F.sha2(body, 256).alias("digest"))


def bucket_digests(digests: DataFrame) -> DataFrame:
    """(bucket, rows, digest): number of rows, and the xor and the sum of two halves of their digests, in one digest."""
    half = lambda start: F.conv(F.substring("digest", start, 15), 16, 10).cast("decimal(38,0)")
    word = lambda start: F.conv(F.substring("digest", start, 15), 16, 10).cast("bigint")
    sums = digests.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(word(1)).alias("x"), F.bit_xor(word(16)).alias("y"), F.sum(half(31)).alias("s"), F.sum(half(46)).alias("t"))
    return sums.select("bucket", "rows", F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in ("rows", "x", "y", "s", "t")]), 256).alias("digest"))


def version_digest(rows: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """(rows, digest) of a whole version: one row.  An empty version has a digest too."""
    per = bucket_digests(row_digests(rows, key, buckets))
    listed = F.array_sort(F.collect_list(F.struct("bucket", "digest")))  # at most ``buckets`` entries
    return per.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sha2(F.to_json(listed), 256).alias("digest"))


def changes(old: DataFrame, new: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """(key, change): rows added, removed or changed from one version to the other.

    Buckets with equal digests are left out before rows meet.  A repeated key is one row for each of its digests.
    """
    a, b = row_digests(old, key, buckets), row_digests(new, key, buckets)
    left, right = (bucket_digests(x).select("bucket", F.col("digest").alias(n)) for x, n in ((a, "l"), (b, "r")))
    differ = left.join(right, "bucket", "full_outer").where(~F.col("l").eqNullSafe(F.col("r"))).select("bucket")
    at = lambda x, name: x.join(F.broadcast(differ), "bucket", "left_semi").select(  # at most ``buckets`` rows
        F.col("key").alias(f"key_{name}"), F.col("digest").alias(name), F.lit(True).alias(f"in_{name}"))
    met = at(a, "l").join(at(b, "r"), F.col("key_l").eqNullSafe(F.col("key_r")), "full_outer")
    change = F.when(F.col("in_l").isNull(), F.lit("added")).when(F.col("in_r").isNull(), F.lit("removed")).when(F.col("l") != F.col("r"), F.lit("changed"))
    return met.select(F.coalesce("key_l", "key_r").alias(key), change.alias("change")).where("change IS NOT NULL")


def registry_problems(datasets: DataFrame, registry: DataFrame) -> DataFrame:
    """(dataset, version, problem) of datasets (dataset, version, digest) against the registry of published digests.

    A version that is published with another digest was edited in place; content that is published under another version of the same dataset was
    renamed; a version the registry does not hold is unregistered; one it holds twice with different digests is ambiguous.
    """
    known = registry.select(F.col("dataset").alias("d"), F.col("version").alias("v"), F.col("digest").alias("k"))
    own = datasets.select("dataset", "version", "digest")
    by_name = known.groupBy("d", "v").agg(F.min("k").alias("k"), F.max("k").alias("k2"))
    by_content = known.groupBy("d", "k").agg(F.min("v").alias("elsewhere"), F.max("v").alias("elsewhere2")).withColumnRenamed("d", "d2").withColumnRenamed("k", "k3")
    joined = own.join(by_name, (own.dataset == F.col("d")) & (own.version == F.col("v")), "left").join(
        by_content, (own.dataset == F.col("d2")) & (own.digest == F.col("k3")), "left")
    renamed = F.col("elsewhere").isNotNull() & (F.col("d").isNull())
    problem = (F.when(F.col("k") != F.col("k2"), F.lit("ambiguous version")).when(F.col("k") != F.col("digest"), F.lit("edited in place"))
               .when(renamed, F.concat(F.lit("published as "), F.col("elsewhere"))).when(F.col("d").isNull(), F.lit("not registered")))
    return joined.select("dataset", "version", problem.alias("problem")).where("problem IS NOT NULL")


def version_mismatches(rows: DataFrame, key: str, column: str, expected: str, code: str = "version-mismatch") -> DataFrame:
    """Findings of rows that were made under another version (of the taxonomy, the dataset) than the expected one, or under none."""
    wrong = rows.where(~F.coalesce(F.col(column) == expected, F.lit(False)))
    return A.finding(wrong, code, A.ERROR, F.col(key), F.coalesce(F.col(column), F.lit("")))


def new_version(examples: DataFrame, ledger: DataFrame, entries: DataFrame, current: str, name: str, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, header) of the version that the ledger's decisions make; header: version, created_on, applied, rows, digest.

    ``created_on`` is the day of the latest decision that was applied, so the result does not depend on when it is made.  The name must be new:
    neither the current version's nor one of the registry's.
    """
    if name == current or registry.where(F.col("version") == name).limit(1).count():
        raise ValueError(f"version {name!r} is there already: decisions need a new one")
    rows = A.apply_ledger(examples, ledger, entries)
    decided = ledger.where(F.col("outcome").isin("confirmed", "changed")).join(entries, "ref").join(examples.select("example_id").distinct(), "example_id", "left_semi")
    made = decided.agg(F.max("verified_on").alias("created_on"), F.count(F.lit(1)).alias("applied"))
    digest = version_digest(rows, "example_id")
    header = made.withColumn("_one", F.lit(1)).join(digest.withColumn("_one", F.lit(1)), "_one").select(F.lit(name).alias("version"), "created_on", "applied", "rows", "digest")
    return rows, header
