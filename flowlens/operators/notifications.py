"""Notifications to envelopes, and replies to waiting tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens import schemas as S
from flowlens.operators.commands import base_columns
from flowlens.operators.routing import notification_kind
from flowlens.operators.skew import CHUNK

c = F.col


def initiated_from(notifications: DataFrame) -> DataFrame:
    """Created flows as initiations; the specification names the DAG."""
    kind = notification_kind(c("`@type`"))
    return notifications.filter(
        (kind == "flow_created") & c("id").isNotNull() & c("processFlowSpecification").isNotNull()
    ).select(
        *base_columns(c("id"), S.INITIATED, "EVENT", S.SOURCE_INTAKE, c("arrival_seq")),
        "arrival_seq",
        c("processFlowSpecification").alias("dag_key"),
        F.struct(
            F.struct(*[c(f"`{n}`").alias(n) for n in _FLOW_FIELDS if n in notifications.columns]).alias("processFlow")
        ).alias("inputs"),
    )


_FLOW_FIELDS = (
    "id", "href", "@type", "state", "channel", "@baseType", "relatedParty", "relatedEntity", "characteristic",
    "processFlowSpecification",
)


def signals_from(notifications: DataFrame) -> DataFrame:
    """Async replies as signals; they need a transaction id, and an unnamed reporting system is ``UNKNOWN``."""
    kind = notification_kind(c("`@type`"))
    return notifications.filter((kind == "async_reply") & c("event.id").isNotNull()).select(
        *base_columns(c("correlationId"), S.SIGNAL, "SIGNAL", S.SOURCE_INTAKE, c("arrival_seq")),
        "arrival_seq",
        F.struct(
            F.struct(c("event.id").alias("id"), c("event.href").alias("href")).alias("downstream"),
            c("eventId").alias("externalEventId"),
            c("`@type`").alias("externalType"),
            F.coalesce("reportingSystem.id", F.lit(S.UNKNOWN)).alias("reportingSystem"),
        ).alias("inputs"),
    )


def latest_before(
    rows: DataFrame, key: str, is_source: Column, payload: list[str], order: str = "arrival_seq", name: str = "found"
) -> DataFrame:
    """Adds to every row the payload of the last source row of its key at or before it, null when there is none.

    Scans (key, chunk) pieces, each bounded by the chunk size, and hands every piece the last source row of the
    pieces before it; that hand-over sees one row per piece. No pair of rows is ever formed.
    """
    value = F.when(is_source, F.struct(*payload))
    rows = rows.withColumn("_v", value)
    heads = rows.groupBy(key, CHUNK).agg(F.max_by("_v", F.when(c("_v").isNotNull(), c(order))).alias("_own"))
    before = W.partitionBy(key).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    carried = heads.select(key, CHUNK, F.last("_own", ignorenulls=True).over(before).alias("_carry"))
    inside = W.partitionBy(key, CHUNK).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        rows.withColumn("_in", F.last("_v", ignorenulls=True).over(inside))
        .join(carried, [key, CHUNK])
        .withColumn(name, F.coalesce("_in", "_carry"))
        .drop("_v", "_in", "_carry")
    )


def correlate_replies(waiting: DataFrame, replies: DataFrame, horizon: str | None = None) -> DataFrame:
    """Each reply with the waiting task its transaction id stands for at that moment; a ``horizon`` limits its age.

    ``waiting``: transaction_id, arrival_seq, chunk, at, correlation_id, task_flow_id. A later registration of an id
    replaces the earlier one. ``replies``: transaction_id, arrival_seq, chunk, at.
    """
    none = F.lit(None).cast("string")
    both = waiting.select(
        "transaction_id", "arrival_seq", CHUNK, "at", "correlation_id", "task_flow_id", F.lit(True).alias("_w")
    ).unionByName(
        replies.select(
            "transaction_id",
            "arrival_seq",
            CHUNK,
            "at",
            none.alias("correlation_id"),
            none.alias("task_flow_id"),
            F.lit(False).alias("_w"),
        )
    )
    own = F.struct(c("arrival_seq").alias("seq"), c("at"), c("correlation_id"), c("task_flow_id"))
    tagged = latest_before(both.withColumn("_own", own), "transaction_id", c("_w"), ["_own"])
    found = c("found._own")
    fresh = c("at") <= found["at"] + F.expr(f"INTERVAL {horizon}") if horizon else F.lit(True)
    return tagged.filter(~c("_w") & found.isNotNull() & fresh).select(
        "transaction_id",
        c("arrival_seq").alias("reply_seq"),
        found["seq"].alias("waiting_seq"),
        found["correlation_id"].alias("correlation_id"),
        found["task_flow_id"].alias("task_flow_id"),
    )
