"""Readings of a run: choosing one per declaration, and merging several photographs into a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attesta import vocabulary as V


def image_positions(run_images: DataFrame) -> DataFrame:
    return run_images.select("run_id", "image_id", "position")


_BODY = ("reading_id", "image_id", "raw_value", "confidence", "normalized", "box")


def _earliest() -> Column:
    """Earliest photograph, then the order readings were written; a null ``position`` (no membership row) stands at 1."""
    return F.struct(F.coalesce("position", F.lit(1)).alias("p"), F.coalesce("reading_id", F.lit(0)).alias("i"))


def first_readings(readings: DataFrame, keys: tuple[str, ...] = V.FIELD_KEYS) -> DataFrame:
    """One reading per (run, declaration): earliest photograph, then the order readings were written.

    ``position`` may be null (no membership row): such a reading stands at position 1.  The choice
    is a ``min_by`` aggregate, so all but one reading per map task and key is gone before the shuffle.
    """
    return (
        readings.where(F.col("field_key").isin(*keys))
        .groupBy("run_id", "field_key").agg(F.min_by(F.struct(*_BODY), _earliest()).alias("reading"))
    )


def reading_maps(readings: DataFrame, keys: tuple[str, ...] = V.FIELD_KEYS) -> DataFrame:
    """(run_id, fields): declaration -> chosen reading; at most one entry per vocabulary key.

    The choice of ``first_readings``, with one aggregate a key, so readings are shuffled and sorted once, by their run.
    """
    chosen = [F.min_by(F.struct(*_BODY), F.when(F.col("field_key") == k, _earliest())).alias(f"_{n}") for n, k in enumerate(keys)]
    entries = F.array(*[F.when(F.col(f"_{n}").isNotNull(), F.struct(F.lit(k).alias("field_key"), F.col(f"_{n}").alias("reading"))) for n, k in enumerate(keys)])
    return readings.where(F.col("field_key").isin(*keys)).groupBy("run_id").agg(*chosen).select(
        "run_id", F.map_from_entries(F.array_compact(entries)).alias("fields"))


# --- several photographs of one package ------------------------------------------------------


def merge_runs(images: DataFrame) -> DataFrame:
    """Run status, time, block count, placeholder flag and error from its photographs.

    The best outcome of the set decides the status; times add up over measured ones only.  Flags
    and errors come from the first photograph that was read, else from the first failure.
    """
    read = F.col("status") != "failed"
    order = F.struct("position", "image_id")
    first = lambda c: F.min_by(F.when(read, F.col(c)), F.when(read, order))
    return images.groupBy("run_id").agg(
        F.when(F.bool_or(F.col("status") == "completed"), F.lit("completed"))
        .when(F.bool_or(F.col("status") == "empty"), F.lit("empty"))
        .otherwise(F.lit("failed")).alias("status"),
        F.least(F.sum(F.when(read, F.col("processing_ms"))), F.lit(V.MAX_PROCESSING_MS)).cast("bigint")
        .alias("processing_ms"),
        F.coalesce(F.sum(F.when(read, F.col("block_count"))), F.lit(0)).cast("bigint").alias("block_count"),
        F.coalesce(first("is_placeholder"), F.lit(False)).alias("is_placeholder"),
        F.when(F.bool_or(read), F.coalesce(first("error_code"), F.lit("")))
        .otherwise(F.min_by("error_code", order)).alias("error_code"),
        F.count(F.lit(1)).alias("images"),
    )


_PIECE = 64


def merge_text(images: DataFrame) -> DataFrame:
    """Non-empty texts of the read photographs joined by newline, in position order.

    Joined in pieces of 64 positions first, so one task never holds the separate rows of a whole
    run, only the pieces of the text it has to produce.
    """
    rows = images.where((F.col("status") != "failed") & (F.length("text") > 0))
    piece = rows.groupBy("run_id", F.expr(f"position div {_PIECE}").alias("piece")).agg(
        F.expr("listagg(text, '\\n') WITHIN GROUP (ORDER BY position)").alias("text")
    )
    return piece.groupBy("run_id").agg(
        F.expr("listagg(text, '\\n') WITHIN GROUP (ORDER BY piece)").alias("recognised_text")
    )


def merge_metadata(entries: DataFrame) -> DataFrame:
    """(run_id, key, value): the earliest photograph that reported a key wins.

    ``entries`` holds one row per (run_id, position, key, value) of the photographs that were read.
    """
    return entries.groupBy("run_id", "key").agg(F.min_by("value", "position").alias("value"))


def merge_unread(reports: DataFrame) -> DataFrame:
    """(run_id, unread): the photographs' unread lists one after the other, in position order.

    ``reports`` holds (run_id, position, unread), null where a photograph reported none; a run appears only if some
    photograph has a list, and then with what there is, even nothing.  A run has six photographs at most.
    """
    given = reports.where(F.col("unread").isNotNull())
    lists = F.array_sort(F.collect_list(F.struct("position", "unread")))
    return given.groupBy("run_id").agg(lists.alias("l")).select("run_id", F.flatten(F.transform("l", lambda x: x["unread"])).alias("unread"))


def image_status(lines: Column, readings: Column) -> Column:
    """Empty only when neither a line nor a reading came out."""
    return F.when((lines == 0) & (readings == 0), F.lit("empty")).otherwise(F.lit("completed"))


def number_images(images: DataFrame) -> DataFrame:
    """Positions from 1 in the supplied order, within a run of at most a few photographs."""
    from pyspark.sql import Window

    return images.withColumn(
        "position", F.row_number().over(Window.partitionBy("run_id").orderBy("supplied_order"))
    )


def backfill_run_images(runs: DataFrame, run_images: DataFrame) -> DataFrame:
    """Membership rows to add: every run without one gets its image at position 1."""
    return runs.join(run_images.select("run_id").distinct(), "run_id", "left_anti").select(
        "run_id", "image_id", F.lit(1).alias("position"), "status"
    )


def backfill_reading_image(readings: DataFrame, runs: DataFrame) -> DataFrame:
    owner = runs.select("run_id", F.col("image_id").alias("_run_image"))
    return readings.join(owner, "run_id", "left").withColumn(
        "image_id", F.coalesce("image_id", "_run_image")
    ).drop("_run_image")


# --- words to lines --------------------------------------------------------------------------


def assemble_lines(words: DataFrame, minimum_confidence: float = 0.0) -> DataFrame:
    """Lines from a word table: text in reading order, union box, mean of the reported confidences.

    Words are grouped by (image, page, block, paragraph, line), so a huge image spreads over its
    lines.  A score of -1 is "not reported"; blank words are dropped.
    """
    score = F.when(F.col("conf") >= 0, F.least(F.col("conf") / 100.0, F.lit(1.0)))
    rows = words.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).where(F.length("text") > 0)
    rows = rows.withColumn("score", score)
    if minimum_confidence > 0:
        rows = rows.where(F.coalesce(F.col("score") * 100 >= minimum_confidence, F.lit(True)))
    boxed = (F.col("width") > 0) & (F.col("height") > 0)
    line = ["image_id", "page_num", "block_num", "par_num", "line_num"]
    grouped = rows.groupBy(*line).agg(
        F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY word_num)").alias("text"),
        F.avg("score").alias("confidence"),
        F.greatest(F.lit(0), F.min(F.when(boxed, F.col("left")))).alias("x"),
        F.greatest(F.lit(0), F.min(F.when(boxed, F.col("top")))).alias("y"),
        F.max(F.when(boxed, F.col("left") + F.col("width"))).alias("right"),
        F.max(F.when(boxed, F.col("top") + F.col("height"))).alias("bottom"),
        F.bool_or(boxed).alias("has_box"),
    )
    ok = F.col("has_box") & (F.col("right") > F.col("x")) & (F.col("bottom") > F.col("y"))
    box = F.when(ok, F.struct(
        F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"),
        (F.col("right") - F.col("x")).cast("int").alias("width"),
        (F.col("bottom") - F.col("y")).cast("int").alias("height")))
    return grouped.select(*line, "text", "confidence", box.alias("box"))
