"""Publishing tables so that readers see whole results or nothing, and a replay adds nothing.

A publication's data go to a folder of their own first.  What makes them visible is a small commit file, written last and only
if no commit of that key exists: the file system refuses the second one.  Readers follow commits, so half-written folders, failed
jobs and lost races are never read.  Nothing is moved or rewritten.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

COMMITS = "_commits"


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def committed(spark: SparkSession, root: str, key: str) -> bool:
    files, target = _path(spark, f"{root}/{COMMITS}/{key}.json")
    return files.exists(target)


def publish(df: DataFrame, root: str, key: str, partition_by: tuple[str, ...] = (), text: bool = False) -> bool:
    """Write ``df`` under ``root`` as the publication ``key``; False, and nothing visible, if the key is there already."""
    spark = df.sparkSession
    if committed(spark, root, key):
        return False
    folder = f"data-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    (writer.text if text else writer.parquet)(f"{root}/{folder}")
    files, target = _path(spark, f"{root}/{COMMITS}/{key}.json")
    try:
        stream = files.create(target, False)
    except Exception as e:
        if files.exists(target):  # somebody else has published this key meanwhile
            return False
        raise e
    stream.write(bytearray(json.dumps({"key": key, "folder": folder}).encode()))
    stream.close()
    return True


def commits(spark: SparkSession, root: str) -> DataFrame:
    """(key, folder) of what has been published; a commit file that is still being written doesn't count."""
    files, target = _path(spark, f"{root}/{COMMITS}")
    if not files.exists(target):
        return spark.createDataFrame([], "key string, folder string")
    return spark.read.schema("key string, folder string").json(f"{root}/{COMMITS}").where("folder IS NOT NULL")


def read_published(spark: SparkSession, root: str, schema: str, *keys: str) -> DataFrame:
    """All published rows (of the given keys).  One path a publication comes to the driver."""
    known = commits(spark, root)
    known = known.where(F.col("key").isin(*keys)) if keys else known
    folders = [f"{root}/{r.folder}" for r in known.orderBy("key").select("folder").collect()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def append_results(findings: DataFrame, root: str, evaluation: str, evaluated_on) -> bool:
    """Append-only results: an evaluation adds its rows once, a replay of it adds none, earlier rows are never touched."""
    return publish(findings.withColumn("evaluated_on", F.lit(evaluated_on)), root, evaluation)


def load_all_or_nothing(rows: DataFrame, errors: DataFrame, root: str, version: str, dry_run: bool = False) -> int:
    """Publish a version only if there is no error; returns the number of errors.

    Errors stay a table: they are published under ``errors-<version>`` and never gathered on the driver.  A dry run publishes nothing.
    """
    found = errors.count()
    if not dry_run:
        publish(errors, f"{root}-errors", version) if found else publish(rows, root, version)
    return found


def write_report(report: DataFrame, root: str, key: str) -> bool:
    """A report as JSON lines in the order of its columns: sorted by ranges, so that part files follow each other and none is too large."""
    parts = int(report.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = report.repartitionByRange(parts, *report.columns).sortWithinPartitions(*report.columns)
    return publish(ordered.select(F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"}).alias("value")), root, key, text=True)
