"""Streaming twins of batch queries: drained once from files, so that their result can be compared."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens import schemas as S
from flowlens.operators import commands as C
from flowlens.operators.storage import fresh_dir
from flowlens.plans import queries as Q
from flowlens.sources import adapters as A
from flowlens.sources import envelopes as E
from flowlens.sources.tables import FirstDeliveries
from flowlens.streaming import runs, stateful

c = F.col
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = A.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")


def _stateful(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """The raw log as files, streamed back and decoded."""
    path = fresh_dir(spark, "raw-log")
    Q.raw_event_log(spark, sf).write.parquet(path)
    raw = E.stream_log(spark, path, "parquet", schema="arrival_seq bigint, value string")
    return runs.drain_to_table(Q.split_outcome(E.mark_envelopes(raw)))


FILE_ROWS = 250_000


def event_parts(spark: SparkSession, sf: str, order: Column, parts: int, file_rows: int = FILE_ROWS) -> tuple[DataFrame, Iterator[int]]:
    """The event table as a stream, and a feed that appends its parts to the folder in the order of ``order`` (0 to parts - 1).

    A part is as many files of some ``file_rows`` rows as it needs, so that no task writes or reads it whole. What the feed has
    appended is drained before the next part, so a part is one micro-batch.
    """
    path = fresh_dir(spark, "event-parts")
    events = A.table(spark, sf, "events")

    def feed() -> Iterator[int]:
        sizes = {r[0]: r[1] for r in events.groupBy(order.cast("int")).count().collect()}
        for n in range(parts):
            files = max(1, -(-sizes.get(n, 0) // file_rows))
            events.filter(order == n).repartition(files, "event_id").write.mode("append").parquet(path)
            yield n

    # a reader needs the folder before the first part is there
    spark.createDataFrame([], events.schema).write.parquet(path)
    return spark.readStream.schema(events.schema).parquet(path), feed()


def in_arrival_order(spark: SparkSession, sf: str, parts: int = 5) -> tuple[DataFrame, Iterator[int]]:
    most = A.table(spark, sf, "events").agg(F.max("event_id")).first()[0] or 0
    return event_parts(spark, sf, F.expr(f"event_id * {parts} div {most + 1}"), parts)


def stream_task_table(spark: SparkSession, sf: str) -> DataFrame:
    """Five micro-batches into the day table, merged every second time, then read."""
    events, feed = in_arrival_order(spark, sf)
    table = runs.drain_day_table(spark, E.ledger(A.shape_events(events)), feed=feed)
    return table.rows().select(
        "correlation_id", "task_flow_id", "action_name", "action_code", "batch_index", "status", "result_json",
        "error_json", "first_seq", "last_seq",
    )


LATE_AFTER = dt.timedelta(days=16)


def deliveries(spark: SparkSession, sf: str) -> FirstDeliveries:
    """The log delivered twice and out of order: days 16 on, days 1 to 12, then the
    days between, of which some are within the delay and some beyond it."""
    day = F.dayofmonth("ts")
    part = F.when(day >= 16, 0).when(day <= 12, 1).otherwise(2)
    events, feed = event_parts(spark, sf, part, 3)
    one = A.shape_events(events).select("event_id", "correlation_id", "status", "event_time")
    twice = one.select(F.explode(F.array(F.struct("*"), F.struct("*"))).alias("e")).select("e.*")
    return runs.drain_deliveries(twice, LATE_AFTER, feed)


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return deliveries(spark, sf).rows().drop("event_time")


def stream_late(spark: SparkSession, sf: str) -> DataFrame:
    """Late records, each as often as it was delivered."""
    late = deliveries(spark, sf).late()
    return late.groupBy("event_id", "correlation_id").agg(F.count(F.lit(1)).alias("deliveries"))


def stream_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Replies and registrations as two streams; records far ahead in time close both, so that lonely replies come out."""
    _stateful(spark)
    after = F.make_interval(years=F.lit(2))

    def closing(rows: DataFrame, name: str | None) -> DataFrame:
        last = rows.filter(c("arrival_seq") % 10 == 0).withColumn("at", c("at") + after).withColumn(
            "transaction_id", F.lit(name).cast("string"))
        return rows.unionByName(last)

    waiting = Q.waiting_registrations(event_stream(spark, sf))
    replies = Q.replies(event_stream(spark, sf))
    pairs = runs.drain_to_table(stateful.stream_replies(closing(waiting, "closing"), closing(replies, None)))
    return stateful.newest_matches(pairs.filter(c("transaction_id").isNotNull()))


def flow_changes(spark: SparkSession, sf: str) -> DataFrame:
    _stateful(spark)
    ledger = E.ledger(A.shape_events(event_stream(spark, sf)))
    return runs.drain_to_table(stateful.stream_flows(ledger, A.event_catalogue(spark), expire=False))


def stream_commands(spark: SparkSession, sf: str) -> DataFrame:
    """Commands as a stream: opened batches leave the state and meet catalogue and registry as static tables."""
    _stateful(spark)
    catalogue = A.event_catalogue(spark)
    ledger = E.ledger(A.shape_events(event_stream(spark, sf)))
    opened = stateful.opened_batches(stateful.stream_flows(ledger, catalogue, expire=False))
    rows = C.batch_commands(opened, catalogue, Q.command_codes(spark, sf), Q.dcx_codes(spark, sf))
    return runs.drain_to_table(Q.command_view(rows))


def stream_barriers(spark: SparkSession, sf: str) -> DataFrame:
    rows = stateful.barrier_table(flow_changes(spark, sf))
    return rows.withColumn("pending", c("task_total") - c("task_completed") - c("task_failed")).select(
        "correlation_id", "batch_index", "dag_key", "task_total", "task_completed", "task_failed", "pending", "status",
        "opened_seq", "closed_seq", "kickout",
    )


def stream_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    rows = flow_changes(spark, sf).filter(c("kind") == "lifecycle")
    return rows.select(
        "correlation_id",
        F.lit(S.LIFECYCLE).alias("message_name"),
        F.lit(S.SOURCE_ENGINE).alias("source"),
        "dag_key",
        "status",
        c("message").alias("error_message"),
        F.when(c("status") == "FAILED", F.lit(False)).alias("error_retryable"),
        c("seq").alias("lifecycle_seq"),
        "emit_pos",
    )


STREAM_QUERIES = {
    f.__name__: f
    for f in (stream_quarantine, stream_task_table, stream_dedup, stream_late, stream_signals, stream_barriers, stream_commands,
              stream_lifecycle)
}
