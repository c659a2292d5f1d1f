"""Envelope and notification logs: decode, split off unreadable records, flatten, encode."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens import schemas as S
from flowlens.functions.body import verdict_of_body, verdict_of_struct
from flowlens.operators.skew import CHUNK, CHUNK_ROWS, chunk_of

_PARSE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": S.CORRUPT}

_TOP_LEVEL = {
    "eventId": "event_id",
    "correlationId": "correlation_id",
    "schemaVersion": "schema_version",
    "eventTime": "event_time",
    "messageType": "message_type",
    "messageName": "message_name",
    "source": "source",
    "dagKey": "dag_key",
    "intent": "intent",
    "status": "status",
    "batch": "batch",
    "action": "action",
    "task": "task",
    "execution": "execution",
    "downstream": "downstream",
    "awaitingSignal": "awaiting_signal",
    "inputs": "inputs",
    "result": "result",
    "error": "error",
}


_BODY = ("taskFlowResponse", "taskStatusCode", "statusChangeReason", S.CORRUPT)


@dataclass(frozen=True)
class Split:
    good: DataFrame
    quarantine: DataFrame


def read_log(spark: SparkSession, path: str, fmt: str = "text", **options: str) -> DataFrame:
    """A static log with a ``value`` column: a file format, or ``kafka`` where its connector is installed."""
    return spark.read.format(fmt).options(**options).load(path) if path else (
        spark.read.format(fmt).options(**options).load()
    )


def stream_log(spark: SparkSession, path: str, fmt: str = "text", schema: str | None = None, **options: str) -> DataFrame:
    reader = spark.readStream.format(fmt).options(**options)
    if schema:
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def _outside(c: Column, allowed: tuple[str, ...]) -> Column:
    return F.coalesce(~c.isin(*allowed), F.lit(False))


def parse_once(rows: DataFrame, text: Column, schema: str) -> DataFrame:
    """Adds the parsed fields as columns. The generator keeps the optimizer from copying the parse into every use."""
    return rows.select("*", F.inline(F.array(F.from_json(text, schema, _PARSE))))


def bad_envelope(value: Column) -> Column:
    """True where the parsed text is no readable envelope object or holds an unknown enum text."""
    c = F.col
    return (
        ~F.coalesce(value.rlike(r"^\s*\{"), F.lit(False))
        | c(S.CORRUPT).isNotNull()
        | _outside(c("messageType"), S.MESSAGE_TYPES)
        | _outside(c("intent"), S.INTENTS)
        | _outside(c("status"), S.STATUSES)
        | _outside(c("execution.mode"), S.MODES)
    )


def mark_envelopes(raw: DataFrame, value: str = "value", keep: tuple[str, ...] = ("arrival_seq",)) -> DataFrame:
    """Every record with its typed fields, its text ``raw_value`` and the flag ``readable``.

    Null values (tombstones) are dropped. One pass serves both sides of the split.
    """
    text = F.col(value).cast("string")
    kept = raw.filter(F.col(value).isNotNull()).select(*keep, text.alias("raw_value"))
    parsed = parse_once(kept, F.col("raw_value"), S.ENVELOPE_WIRE)
    return parsed.select(
        *keep,
        "raw_value",
        (~bad_envelope(F.col("raw_value"))).alias("readable"),
        *[F.col(w).alias(n) for w, n in _TOP_LEVEL.items()],
    )


def split_envelopes(marked: DataFrame, keep: tuple[str, ...] = ("arrival_seq",)) -> Split:
    good = marked.filter("readable").drop("readable", "raw_value")
    return Split(good, marked.filter("not readable").select(*keep, "raw_value"))


POSITION = ("topic", "partition", "offset")


def quarantine_records(marked: DataFrame, position: tuple[str, ...] = POSITION) -> DataFrame:
    """Each unreadable record once, however often it was delivered: its position in the source, its key and its text.

    ``marked`` keeps ``position`` and ``key``. Only the unreadable records are compared with each other.
    """
    bad = marked.filter("not readable")
    return bad.groupBy(*position).agg(F.first("key").alias("key"), F.first("raw_value").alias("raw_value"), F.count(F.lit(1)).alias("deliveries"))


def decode_envelopes(raw: DataFrame, value: str = "value", keep: tuple[str, ...] = ("arrival_seq",)) -> Split:
    """Typed envelopes and, apart from them, each unreadable record once with its position columns."""
    return split_envelopes(mark_envelopes(raw, value, keep), keep)


def decode_notifications(
    raw: DataFrame, value: str = "value", keep: tuple[str, ...] = ("arrival_seq",)
) -> Split:
    kept = raw.filter(F.col(value).isNotNull()).select(*keep, F.col(value).cast("string").alias("raw_value"))
    parsed = parse_once(kept, F.col("raw_value"), S.NOTIFICATION_WIRE)
    bad = ~F.coalesce(F.col("raw_value").rlike(r"^\s*\{"), F.lit(False)) | F.col(S.CORRUPT).isNotNull()
    good = parsed.filter(~bad).drop(S.CORRUPT, "raw_value")
    return Split(good, parsed.filter(bad).select(*keep, "raw_value"))


def ledger(envelopes: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Flat working view of typed envelopes. Unused columns are pruned away by Catalyst."""
    c = F.col
    return envelopes.select(
        "event_id",
        "correlation_id",
        "arrival_seq",
        chunk_of("arrival_seq", chunk_rows).alias(CHUNK),
        "event_time",
        "message_type",
        "message_name",
        "source",
        "dag_key",
        "status",
        c("batch.index").alias("batch_index"),
        c("action").isNotNull().alias("has_action"),
        c("action.actionName").alias("action_name"),
        c("action.actionCode").alias("action_code"),
        c("execution").isNotNull().alias("has_execution"),
        c("execution.startedAt").alias("started_at"),
        c("execution.finishedAt").alias("finished_at"),
        c("execution.durationMs").alias("duration_ms"),
        c("result").isNotNull().alias("has_result"),
        c("result.id").alias("task_flow_id"),
        c("result.taskFlowResponse.href").alias("href"),
        F.to_json("result").alias("result_json"),
        verdict_of_struct(c("result")).alias("verdict"),
        F.to_json("error").alias("error_json"),
        F.coalesce(c("error.retryable"), F.lit(False)).alias("retryable"),
        c("inputs.processFlow").isNotNull().alias("has_flow"),
        c("inputs.processFlow.id").alias("flow_id"),
    )


def with_json_verdict(rows: DataFrame) -> DataFrame:
    """Take the verdict from stored ``result_json`` text instead of the typed result."""
    bodies = parse_once(rows.drop("verdict"), F.col("result_json"), S.RESULT_BODY)
    verdict = verdict_of_body(F.col("result_json"), *[F.col(n) for n in _BODY])
    return bodies.withColumn("verdict", verdict).drop(*_BODY)


def encode_envelopes(rows: DataFrame) -> DataFrame:
    """``key`` / ``value`` / ``headers`` records, nulls dropped, keyed by flow (Kafka sink layout)."""
    present = {n: w for w, n in _TOP_LEVEL.items() if n in rows.columns}
    body = F.to_json(F.struct(*[F.col(n).alias(w) for n, w in present.items()]))

    def header(name: str) -> Column:
        return F.struct(
            F.lit(name).alias("key"), F.encode(F.col({w: n for n, w in present.items()}[name]), "UTF-8").alias("value")
        )

    names = [h for h in ("eventId", "messageType", "messageName", "source", "schemaVersion") if h in present.values()]
    return rows.select(
        F.col("correlation_id").alias("key"), body.alias("value"), F.array(*[header(h) for h in names]).alias("headers")
    )


def write_envelopes(rows: DataFrame, path: str, fmt: str = "json", **options: str) -> None:
    """Append encoded records to a file sink, or to Kafka with ``fmt='kafka'`` and its options."""
    out = encode_envelopes(rows).write.mode("append").format(fmt).options(**options)
    out.save(path) if path else out.save()
