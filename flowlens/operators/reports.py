"""Read-only summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col


def message_counts(envelopes: DataFrame) -> DataFrame:
    return envelopes.groupBy("message_name", "source", "status").agg(F.count(F.lit(1)).alias("messages"))


def message_listing(envelopes: DataFrame) -> DataFrame:
    return envelopes.select("correlation_id", "arrival_seq", "message_name", "source", "status").orderBy(
        "correlation_id", "arrival_seq"
    )


def flow_outcome(barriers: DataFrame, task_rows: DataFrame) -> DataFrame:
    """Per seeded flow: barrier count, whether all are closed, task count. Both sides are aggregated before the join."""
    per_flow = barriers.groupBy("correlation_id").agg(
        F.count(F.lit(1)).alias("barriers"), F.bool_and(c("status") == "CLOSED").alias("all_closed")
    )
    tasks = task_rows.groupBy("correlation_id").agg(F.count(F.lit(1)).alias("tasks"))
    return per_flow.join(tasks, "correlation_id", "left").withColumn("tasks", F.coalesce("tasks", F.lit(0)))


def barrier_listing(barriers: DataFrame) -> DataFrame:
    return barriers.select(
        "correlation_id", "batch_index", "task_total", "task_completed", "task_failed", "status"
    ).orderBy("correlation_id", "batch_index")


def task_listing(task_rows: DataFrame) -> DataFrame:
    return task_rows.select(
        "correlation_id", "task_flow_id", "action_name", "action_code", "batch_index", "status"
    ).orderBy("correlation_id", "batch_index", "action_name", "task_flow_id")


def first_deliveries(envelopes: DataFrame) -> DataFrame:
    """Each event id once, its first arrival winning; copies collapse before the shuffle."""
    others = [n for n in envelopes.columns if n not in ("event_id", "arrival_seq")]
    return (
        envelopes.groupBy("event_id")
        .agg(F.min_by(F.struct("arrival_seq", *others), "arrival_seq").alias("_r"))
        .select("event_id", "_r.*")
    )


def newest_first(task_rows: DataFrame) -> DataFrame:
    return task_rows.orderBy(c("first_seq").desc())
