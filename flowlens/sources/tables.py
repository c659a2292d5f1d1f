"""Day-partitioned state tables: write, read, retention, recent-first lookups, incremental task updates."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.storage import cut
from flowlens.operators.tasks import collapse_delta, delta_rows, merge_deltas

c = F.col
DAY = "created_date"


def write_days(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write rows under ``created_date=…`` folders; with ``overwrite`` only the days present are replaced.

    The rebalance step gives each day few files and lets AQE split a day too large for one task.
    """
    rows.hint("rebalance", DAY).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def retained(rows: DataFrame, today: dt.date, days: int = 60) -> DataFrame:
    """Rows of the last ``days`` day partitions. The literal bound sits on the partition column, so old days are not read."""
    return rows.filter(c(DAY) >= F.lit(today - dt.timedelta(days=days)))


def rewrite_retained(spark: SparkSession, source: str, target: str, today: dt.date, days: int = 60) -> None:
    write_days(retained(read_days(spark, source), today, days), target)


def recent_first(keys: DataFrame, rows: DataFrame, on: list[str], today: dt.date) -> DataFrame:
    """Keyed lookup: the partition of ``today`` first, all others for the keys it misses; ``phase`` tells which."""
    recent = rows.filter(c(DAY) >= F.lit(today))
    hits = keys.join(recent, on).withColumn("phase", F.lit("recent"))
    misses = keys.join(recent.select(*on), on, "left_anti")
    older = misses.join(rows.filter(c(DAY) < F.lit(today)), on).withColumn("phase", F.lit("older"))
    return hits.unionByName(older)


def existing_keys(keys: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    return keys.join(rows.select(*on), on, "left_semi")


def of_flows(rows: DataFrame, flows: DataFrame) -> DataFrame:
    """All rows of the given flows, across all days, met on (flow, day) so that no flow sits in one task."""
    days = rows.select("correlation_id", DAY).distinct().join(flows.select("correlation_id"), "correlation_id", "left_semi")
    return rows.join(days, ["correlation_id", DAY], "left_semi")


def recent_first_days(keys: DataFrame, rows: DataFrame, on: list[str], days: list[dt.date], today: dt.date) -> DataFrame:
    """The lookup over a stored table: ``days`` are its partitions; only today's, then the others for what is missing, are read."""
    older = [d for d in days if d < today]
    recent = rows.filter(c(DAY) >= F.lit(today))
    hits = keys.join(recent, on).withColumn("phase", F.lit("recent"))
    misses = keys.join(recent.select(*on).distinct(), on, "left_anti")
    rest = misses.join(rows.filter(c(DAY).isin(older) if older else F.lit(False)), on).withColumn("phase", F.lit("older"))
    return hits.unionByName(rest)


def partition_days(spark: SparkSession, path: str) -> list[dt.date]:
    """The days a stored table has, out of its folder names; no file is read."""
    return sorted(r[0] for r in spark.read.parquet(path).select(DAY).distinct().collect() if r[0] is not None)


def write_barriers(barriers: DataFrame, path: str) -> None:
    """The barrier table: key (flow, batch, created_at), counts, status, positions and their times, in day partitions.

    ``barriers`` carries the times of ``with_times``; a barrier is created when it opens.
    """
    rows = barriers.select(
        "correlation_id", "batch_index", "dag_key", "task_total", "task_completed", "task_failed", "status", "kickout",
        "opened_seq", "closed_seq", "opened_at", "closed_at", c("opened_at").alias("created_at"),
        F.to_date("opened_at").alias(DAY),
    )
    write_days(rows, path)


class Ledger:
    """What each micro-batch of a stream has left behind: one folder per batch id, replaced when the batch runs again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def put(self, rows: DataFrame, name: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch_id={int(batch_id)}")

    def get(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        """The rows of all batches, or of those with a smaller id."""
        try:
            rows = self.spark.read.schema(f"{schema}, batch_id long").parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], f"{schema}, batch_id long")
        return rows if before is None else rows.filter(c("batch_id") < before)


class FirstDeliveries:
    """Streaming first deliveries with a record of what came too late.

    A record whose event time is more than ``delay`` behind the newest of earlier batches is late: it is stored aside and counted, not
    dropped. The others are kept once per id: copies whose event times lie up to ``delay`` apart are one. An id is looked for only among
    the times that its copies can have, so the look-up does not grow with the table. Batches are told apart by their id; one that runs again replaces what it left.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, delay: dt.timedelta = dt.timedelta(days=7)):
        self.ledger = Ledger(spark, path)
        self.schema = schema
        self.delay = delay

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        newest = self.ledger.get("marks", "newest timestamp_ntz", batch_id).agg(F.max("newest")).first()[0]
        rows = batch.withColumn("event_time", c("event_time").cast("timestamp_ntz"))
        late, fresh = F.lit(False), rows
        if newest is not None:
            late = F.coalesce(c("event_time") < F.lit(newest - self.delay).cast("timestamp_ntz"), F.lit(False))
            fresh = rows.filter(~late)
        names = [f.name for f in fresh.schema if f.name != "event_id"]
        once = fresh.groupBy("event_id").agg(F.min(F.struct("event_time", *[n for n in names if n != "event_time"])).alias("_r")).select(
            "event_id", "_r.*")
        known = self.ledger.get("rows", self.schema, batch_id).select("event_id", "event_time")
        if newest is not None:
            known = known.filter(c("event_time") >= F.lit(newest - 2 * self.delay).cast("timestamp_ntz"))
        self.ledger.put(rows.filter(late), "late", batch_id)
        self.ledger.put(once.join(known.select("event_id"), "event_id", "left_anti"), "rows", batch_id)
        self.ledger.put(rows.agg(F.max("event_time").alias("newest")), "marks", batch_id)

    def rows(self) -> DataFrame:
        return self.ledger.get("rows", self.schema).drop("batch_id")

    def late(self) -> DataFrame:
        return self.ledger.get("late", self.schema).drop("batch_id")


class TaskTable:
    """Task rows kept as mergeable deltas: one folder per batch, folded on read, compacted on demand.

    A batch writes only its own collapsed rows, and a replayed batch replaces its own folder, so each batch counts
    once however often it runs. No day partition is rewritten while events stream in.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def apply(self, auditable: DataFrame, batch_id: int) -> None:
        collapse_delta(auditable).write.mode("overwrite").parquet(f"{self.path}/batch_id={int(batch_id)}")

    def deltas(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("batch_id")

    def rows(self) -> DataFrame:
        return delta_rows(merge_deltas(self.deltas()))

    def compact(self, target: str) -> TaskTable:
        """Fold all batches into one at ``target``; the caller switches over and retires the old folder."""
        merge_deltas(self.deltas()).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch_id=-1")
        return TaskTable(self.spark, target)

    def publish(self, target: str) -> None:
        write_days(self.rows(), target)


class DayTable:
    """Task rows by day of creation, kept up from micro-batches.

    A micro-batch leaves one delta. Once ``every`` deltas are there they are merged: the rows of the days they touch are read, folded
    with the deltas and written over those days only, all other days keep their files. The fold is idempotent, so a delta that
    is merged twice, or a crash between the steps, changes nothing; deltas are marked as merged after the days are written.
    """

    _MERGED = "batch long"

    def __init__(self, spark: SparkSession, path: str, every: int = 8):
        self.spark, self.path, self.every = spark, path.rstrip("/"), every
        self.ledger = Ledger(spark, f"{self.path}/log")
        self.days = f"{self.path}/days"
        self.schema: str | None = None

    def apply(self, auditable: DataFrame, batch_id: int) -> None:
        delta = collapse_delta(auditable)
        self.schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in delta.schema)
        self.ledger.put(delta, "deltas", batch_id)
        if self.waiting().select("batch_id").distinct().count() >= self.every:
            self.merge()

    def waiting(self) -> DataFrame:
        """The deltas that no merge has taken in yet."""
        done = self.ledger.get("merged", self._MERGED).select(c("batch").alias("batch_id")).distinct()
        return self.ledger.get("deltas", self.schema).join(done, "batch_id", "left_anti")

    def stored(self) -> DataFrame:
        """The day table, in mergeable form."""
        try:
            return self.spark.read.schema(f"{self.schema}, {DAY} date").parquet(self.days)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], f"{self.schema}, {DAY} date")

    def merge(self) -> list[dt.date]:
        """Fold the waiting deltas into the days they touch; the days are returned."""
        taken = sorted(r[0] for r in self.waiting().select("batch_id").distinct().collect())
        if not taken:
            return []
        deltas = cut(merge_deltas(self.waiting().filter(c("batch_id").isin(taken)).drop("batch_id")))
        key = ["correlation_id", "task_flow_id"]
        old = self.stored().select(*key, c(DAY).alias("_old")).join(deltas.select(*key), key, "left_semi")
        fresh = deltas.join(old, key, "left").withColumn(DAY, F.coalesce("_old", F.to_date(c("first.at")))).drop("_old")
        fresh = cut(fresh)
        touched = [r[0] for r in fresh.select(DAY).distinct().collect()]
        around = self.stored().filter(c(DAY).isin(touched))
        names = [n for n in around.columns if n != DAY]
        merged = around.unionByName(fresh.select(*around.columns)).groupBy(*key, DAY).agg(
            *[(F.min if n == "first" else F.max)(n).alias(n) for n in names if n not in key]
        )
        write_days(cut(merged.select(*around.columns)), self.days)
        done = self.spark.createDataFrame([(b,) for b in taken], self._MERGED)
        self.ledger.put(done, "merged", max(taken))
        return touched

    def rows(self) -> DataFrame:
        """The task table as of the last micro-batch: merged days and waiting deltas folded."""
        return delta_rows(merge_deltas(self.stored().drop(DAY).unionByName(self.waiting().drop("batch_id"))))
