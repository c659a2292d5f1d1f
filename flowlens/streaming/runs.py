"""Running streams into tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from flowlens.operators.routing import is_auditable
from flowlens.operators.storage import fresh_dir
from flowlens.sources.tables import DayTable, FirstDeliveries, TaskTable


def start_to_files(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream to Parquet files, exactly once per checkpoint. ``once`` drains what is there and stops."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.outputMode("append").start()


def drain_to_table(rows: DataFrame) -> DataFrame:
    """Drain a stream into a fresh folder of the shared directory and read the result back."""
    spark = rows.sparkSession
    path = fresh_dir(spark, "stream")
    start_to_files(rows, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/out")


def start_task_table(ledger: DataFrame, table: TaskTable | DayTable, checkpoint: str) -> StreamingQuery:
    """Task rows from a stream: every micro-batch is collapsed and stored as one replaceable delta."""

    def store(batch: DataFrame, batch_id: int) -> None:
        table.apply(batch, batch_id)

    return (
        ledger.filter(is_auditable())
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def drain_task_table(spark: SparkSession, ledger: DataFrame) -> TaskTable:
    path = fresh_dir(spark, "task-table")
    table = TaskTable(spark, f"{path}/deltas")
    start_task_table(ledger, table, f"{path}/checkpoint").awaitTermination()
    return table


def drain_day_table(spark: SparkSession, ledger: DataFrame, every: int = 2, feed: Iterable = (0,)) -> DayTable:
    """The day table of a stream. Whatever each step of ``feed`` adds to the source is drained before the next step."""
    path = fresh_dir(spark, "day-table")
    table = DayTable(spark, f"{path}/table", every)
    for _ in feed:
        start_task_table(ledger, table, f"{path}/checkpoint").awaitTermination()
    return table


def drain_deliveries(envelopes: DataFrame, delay: dt.timedelta, feed: Iterable = (0,)) -> FirstDeliveries:
    """First deliveries of a stream of (event_id, event_time, …), and its late records aside.

    Whatever each step of ``feed`` adds to the source is drained before the next step.
    """
    spark = envelopes.sparkSession
    path = fresh_dir(spark, "deliveries")
    schema = ", ".join(
        f"{f.name} {'timestamp_ntz' if f.name == 'event_time' else f.dataType.simpleString()}" for f in envelopes.schema
    )
    table = FirstDeliveries(spark, f"{path}/table", schema, delay)
    writer = envelopes.writeStream.foreachBatch(table.apply).option("checkpointLocation", f"{path}/checkpoint")
    for _ in feed:
        writer.trigger(availableNow=True).start().awaitTermination()
    return table


def first_in_watermark(envelopes: DataFrame, delay: str = "7 days") -> DataFrame:
    """Streaming dedup on the event id; an id is remembered until the watermark has passed its first copy."""
    return envelopes.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])
