"""Runs and facts as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from attesta.operators import applicability as A
from attesta.plans.evaluation import Framework, Inspections, candidate_findings, verdicts


def evaluate_arrivals(runs: DataFrame, products: DataFrame, readings: DataFrame, declarations: DataFrame, framework: Framework,
                      on, path: str, checkpoint: str):
    """Evaluate each micro-batch of runs and write its verdicts under ``batch_id``.

    A batch replayed after a failure overwrites its own folder, so nothing is written twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        ids = batch.select("product_id").distinct()
        own = lambda table, key, of: table.join(of, key, "left_semi")  # only what the batch's runs and products need
        data = Inspections(batch, own(products, "product_id", ids), own(readings, "run_id", batch.select("run_id")), own(declarations, "product_id", ids))
        verdicts(candidate_findings(data, framework, on)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return runs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def latest_facts_arrivals(declarations: DataFrame, conditions: DataFrame, path: str, checkpoint: str):
    """The latest fact per (product, condition) as a stream, in Spark's state store: one row of state a key, however many rows arrive.

    The state is the aggregate of `applicability.latest_facts` itself, so rows that come late, again or out of order leave the same answer as
    in a batch.  Each batch writes the facts that changed under its ``batch_id``; a replayed batch overwrites its own folder.
    """
    known = conditions.where("is_active").select("condition_code")
    newest = declarations.join(known, "condition_code").groupBy("product_id", "condition_code").agg(
        F.max(F.struct("updated_at", "declaration_id", "answer")).alias("last"))
    facts = newest.select("product_id", "condition_code", "last.answer", "last.updated_at", "last.declaration_id")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return facts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def current_facts(stored: DataFrame) -> DataFrame:
    """The state as of the last batch: of each key the row of its newest batch."""
    last = F.max_by(F.struct("answer", "updated_at", "declaration_id"), "batch_id").alias("last")
    return stored.groupBy("product_id", "condition_code").agg(last).select("product_id", "condition_code", "last.answer", "last.updated_at", "last.declaration_id")
