"""DAG catalogue and action registry snapshots."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens import schemas as S
from flowlens.functions.text import dcx_key, is_blank
from flowlens.operators.skew import BROADCAST_BYTES, BROADCAST_ROWS
from flowlens.operators.storage import cut


@dataclass(frozen=True)
class Catalogue:
    """``batches``: dag_key, batch_index, task_total (null when empty). ``actions``: one row per declared action.

    ``depth``: the longest run of batch indexes from 0 (a gap ends a flow). ``widest``: most actions in one batch.
    """

    batches: DataFrame
    actions: DataFrame
    depth: int
    widest: int


def _inline(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few configuration rows as a literal in the plan: no job, no Python worker, known tiny size."""
    fields = ", ".join(f"{n.strip().split(' ', 1)[0]}:{n.strip().split(' ', 1)[1]}" for n in schema.split(","))
    text = F.lit(json.dumps(rows))
    return spark.range(1).select(F.inline(F.from_json(text, f"array<struct<{fields}>>")))


def read_dag_documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file, in file-name order; a malformed file is skipped."""
    return (
        spark.read.schema(S.DAG_DOCUMENT.rsplit(",", 1)[0])
        .option("multiLine", True)
        .option("mode", "DROPMALFORMED")
        .json(path)
        .withColumn("load_pos", F.input_file_name())
    )


def dag_documents(spark: SparkSession, documents: Iterable[dict | None]) -> DataFrame:
    """Parsed documents (for instance YAML mappings) as the same frame; a null one is skipped."""
    rows = [{"doc": json.dumps(d), "load_pos": i} for i, d in enumerate(documents) if d]
    raw = _inline(spark, rows, "doc string, load_pos long")
    schema = S.DAG_DOCUMENT.rsplit(",", 1)[0]
    return raw.select(F.from_json("doc", schema).alias("d"), "load_pos").select("d.*", "load_pos")


def flatten_documents(documents: DataFrame) -> DataFrame:
    """One row per declared batch with its action array.

    Blank keys are skipped, the last document of a key wins, the first batch of an index wins.
    """
    kept = (
        documents.filter(~is_blank(F.col("dagKey")))
        .groupBy(F.col("dagKey").alias("dag_key"))
        .agg(F.max_by("batches", "load_pos").alias("batches"))
    )
    return (
        kept.select("dag_key", F.posexplode("batches").alias("_pos", "_b"))
        .groupBy("dag_key", F.col("_b.index").alias("batch_index"))
        .agg(F.min_by("_b.actions", "_pos").alias("actions"))
    )


def build_catalogue(documents: DataFrame) -> Catalogue:
    """Catalogue out of its documents, of any size: stored once, measured, and hinted for broadcast only within the bound.

    Null actions are dropped from ``actions`` but still count in ``task_total``. Only one row of measures is collected.
    """
    total = F.when(F.size("actions") > 0, F.size("actions")).alias("task_total")
    stored = cut(flatten_documents(documents).select("dag_key", "batch_index", total, "actions"))
    # Indexes are distinct per DAG, so an index equals its rank exactly until the first gap.
    rank = F.row_number().over(W.partitionBy("dag_key").orderBy("batch_index")) - 1
    run = stored.filter(F.col("batch_index") >= 0).withColumn("_run", F.col("batch_index") == rank)
    depth, = run.agg(F.coalesce(F.max(F.when(F.col("_run"), F.col("batch_index") + 1)), F.lit(0))).first()
    widest, rows, size = stored.agg(
        F.coalesce(F.max("task_total"), F.lit(0)),
        F.coalesce(F.sum(F.lit(1) + F.coalesce("task_total", F.lit(0))), F.lit(0)),
        F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)),
    ).first()
    batches = stored.select("dag_key", "batch_index", "task_total")
    actions = (
        stored.select("dag_key", "batch_index", "task_total", F.posexplode("actions").alias("action_pos", "_a"))
        .filter(F.col("_a").isNotNull())
        .select(
            "dag_key", "batch_index", "task_total", "action_pos",
            F.col("_a.actionName").alias("action_name"),
            F.col("_a.executionMode").alias("execution_mode"),
            F.col("_a.flowType").alias("flow_type"),
            F.col("_a.modemType").alias("modem_type"),
            F.col("_a.dependsOn").alias("depends_on"),
        )
    )
    if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        batches, actions = F.broadcast(batches), F.broadcast(actions)
    return Catalogue(batches, actions, depth, widest)


def valid_action_codes(rows: DataFrame) -> DataFrame:
    """Rows with a name, the last row of a name winning."""
    return (
        rows.filter(~is_blank(F.col("action_name")))
        .groupBy("action_name")
        .agg(F.max_by(F.struct("action_code", "action_type", "enabled", "load_pos"), "load_pos").alias("_r"))
        .select("action_name", "_r.*")
    )


def dcx_row_key() -> Column:
    return dcx_key(F.col("parent"), F.col("flow_type"), F.col("modem_type"))


def valid_dcx_codes(rows: DataFrame) -> DataFrame:
    """Rows with a parent, keyed by the normalised composite key, the last row of a key winning."""
    return (
        rows.filter(~is_blank(F.col("parent")))
        .groupBy(dcx_row_key().alias("dcx_key"))
        .agg(F.max_by(F.struct("parent", "dcx_action_code", "load_pos"), "load_pos").alias("_r"))
        .select("dcx_key", "_r.*")
    )


def select_snapshot(old: DataFrame, new_valid: DataFrame) -> DataFrame:
    """The new snapshot if it has any valid row, else the old one. The new load is evaluated once, into a stored table."""
    stored = cut(new_valid)
    return old if stored.isEmpty() else stored


def registry_audit(name: str, rows: DataFrame, valid_key: Column, key: Column) -> DataFrame:
    """Rows read, rows skipped, distinct keys kept and duplicate keys overwritten of one load."""
    valid = F.when(~is_blank(valid_key), key)
    return rows.agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count(F.when(is_blank(valid_key), 1)).alias("rows_skipped"),
        F.countDistinct(valid).alias("keys_kept"),
        F.count(valid).alias("_valid"),
    ).select(
        F.lit(name).alias("registry"),
        "rows_read",
        "rows_skipped",
        "keys_kept",
        (F.col("_valid") - F.col("keys_kept")).alias("keys_overwritten"),
        (F.col("keys_kept") > 0).alias("ready"),
    )
