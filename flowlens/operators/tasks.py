"""Latest task rows out of task events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col

LAST = ("action_name", "action_code", "batch_index", "status", "result_json", "error_json")


def upsert_tasks(events: DataFrame, keys: tuple[str, ...] = ("correlation_id", "task_flow_id")) -> DataFrame:
    """One row per task, the last arrival winning by the column rules of the task table.

    A plain aggregation: partial results are built before the shuffle, so re-deliveries of a hot task collapse
    where they are read. ``events`` holds auditable rows only; of the columns in ``LAST`` those that it has are kept.
    """
    last = [n for n in LAST if n in events.columns]
    order = c("arrival_seq")
    timed = F.when(c("has_execution"), order)
    lasting = F.when(c("has_execution") & c("duration_ms").isNotNull(), order)
    return (
        events.groupBy(*keys)
        .agg(
            F.max_by(F.struct(*last, "event_time"), order).alias("_last"),
            F.max_by(F.struct("started_at", "finished_at"), timed).alias("_time"),
            F.max_by("duration_ms", lasting).alias("duration_ms"),
            F.min(F.struct(order.alias("seq"), c("event_time").alias("at"))).alias("_first"),
            F.max(order).alias("last_seq"),
        )
        .select(
            *keys,
            *[c(f"_last.{n}").alias(n) for n in last],
            "_time.started_at",
            "_time.finished_at",
            "duration_ms",
            c("_first.seq").alias("first_seq"),
            "last_seq",
            c("_first.at").alias("created_at"),
            c("_last.event_time").alias("updated_at"),
        )
    )


def collapse_delta(events: DataFrame) -> DataFrame:
    """Mergeable form of ``upsert_tasks``: each value is kept with the sequence that set it."""
    order = c("arrival_seq")
    return events.groupBy("correlation_id", "task_flow_id").agg(
        F.max(F.struct(order.alias("seq"), *[c(n) for n in LAST], c("event_time").alias("at"))).alias("last"),
        F.max(F.when(c("has_execution"), F.struct(order.alias("seq"), "started_at", "finished_at"))).alias("timing"),
        F.max(
            F.when(c("has_execution") & c("duration_ms").isNotNull(), F.struct(order.alias("seq"), "duration_ms"))
        ).alias("lasting"),
        F.min(F.struct(order.alias("seq"), c("event_time").alias("at"))).alias("first"),
    )


def merge_deltas(deltas: DataFrame) -> DataFrame:
    """Fold any number of deltas; associative and idempotent, so replayed batches do no harm."""
    return deltas.groupBy("correlation_id", "task_flow_id").agg(
        F.max("last").alias("last"),
        F.max("timing").alias("timing"),
        F.max("lasting").alias("lasting"),
        F.min("first").alias("first"),
    )


def delta_rows(deltas: DataFrame) -> DataFrame:
    """Task table rows, with the day partition column, out of folded deltas."""
    return deltas.select(
        "correlation_id",
        "task_flow_id",
        *[c(f"last.{n}").alias(n) for n in LAST],
        "timing.started_at",
        "timing.finished_at",
        "lasting.duration_ms",
        c("first.seq").alias("first_seq"),
        c("last.seq").alias("last_seq"),
        c("first.at").alias("created_at"),
        c("last.at").alias("updated_at"),
        F.to_date(c("first.at")).alias("created_date"),
    )


def is_usable_result() -> Column:
    return (c("status") == "COMPLETED") & c("result_json").isNotNull()


def latest_results(task_rows: DataFrame, keys: tuple[str, ...] = ("correlation_id", "action_name")) -> DataFrame:
    """Newest completed result per (flow, action); newest means the task row created last."""
    return (
        task_rows.filter(is_usable_result())
        .groupBy(*keys)
        .agg(F.max_by("result_json", "first_seq").alias("result_json"), F.max("first_seq").alias("first_seq"))
    )
