"""Shape the star-schema test tables like the envelope model (the rules are stated in FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens import schemas as S
from flowlens.sources.catalogue import Catalogue, build_catalogue, dag_documents

# The demonstration catalogue over the event log.
EVENT_DAGS = [
    {
        "dagKey": "dag0",
        "batches": [
            {"index": 0, "actions": [{"actionName": "a0", "executionMode": "SYNC"}]},
            {"index": 1, "actions": [{"actionName": "a1", "executionMode": "ASYNC", "dependsOn": ["a0", "a1"]}]},
            {"index": 2, "actions": [{"actionName": "a0", "flowType": "SMALL", "modemType": "M1", "dependsOn": ["a0"]}]},
        ],
    },
    {
        "dagKey": "dag1",
        "batches": [
            {
                "index": 0,
                "actions": [{"actionName": "a0", "executionMode": "SYNC"}, {"actionName": "a1", "modemType": "M2"}],
            },
            {"index": 1, "actions": [{"actionName": "a1", "flowType": "LARGE", "dependsOn": ["a0", "a1", "a9"]}]},
        ],
    },
    {"dagKey": "dag2", "batches": [{"index": 0, "actions": [{"actionName": "a9"}]}]},
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_catalogue(spark: SparkSession) -> Catalogue:
    return build_catalogue(dag_documents(spark, EVENT_DAGS))


def shape_events(events: DataFrame) -> DataFrame:
    """Typed envelopes out of raw event rows; works on static and streaming frames.

    ``k`` goes through a generator so that its extraction is not copied into every expression that uses it.
    """
    c = F.col
    base = events.select(
        c("event_id").alias("arrival_seq"),
        c("ts"),
        c("user_id"),
        c("event_type"),
        F.explode(F.array(F.get_json_object("props", "$.k").try_cast("int"))).alias("k"),
        F.concat(c("user_id").cast("string"), F.lit("-"), F.expr("(day(ts) - 1) div 7").cast("string")).alias(
            "correlation_id"
        ),
    )
    start = c("event_type") == "signup"
    failed = c("event_type") == "error"
    digit = c("k") % 10
    status_code = (
        F.when(digit == 0, "ERROR").when(digit == 1, "FAILED").when(digit == 2, "ERROR_701").when(digit > 3, "COMPLETED")
    )
    reason = F.when(c("k") % 7 == 0, F.concat(F.lit("reason-"), c("k").cast("string"))).when(
        c("k") % 7 == 1, F.lit("  ")
    )
    task_id = F.concat_ws("-", "correlation_id", (c("k") % 3).cast("string"), (c("k") % 2).cast("string"))
    name = F.concat(F.lit("a"), (c("k") % 2).cast("string"))
    code = F.concat(F.lit("A"), (c("k") % 2).cast("string"))
    attribute = F.struct(
        F.lit("taskStatus").alias("name"), F.when(c("k") < 15, "Failed").otherwise("Passed").alias("value")
    )
    result = F.struct(
        task_id.alias("id"),
        F.struct(
            F.concat(F.lit("/taskFlow/"), task_id).alias("href"), F.array(attribute).alias("characteristic")
        ).alias("taskFlowResponse"),
        status_code.alias("taskStatusCode"),
        reason.alias("statusChangeReason"),
    )
    no_time = F.lit(None).cast("timestamp")
    return base.select(
        c("arrival_seq").cast("string").alias("event_id"),
        "correlation_id",
        "arrival_seq",
        "user_id",
        "k",
        c("ts").alias("event_time"),
        F.lit("EVENT").alias("message_type"),
        F.when(start, S.INITIATED).otherwise(S.TASK_EVENT).alias("message_name"),
        F.when(start, S.SOURCE_INTAKE).otherwise(S.SOURCE_RUNNER).alias("source"),
        F.when(start, F.concat(F.lit("dag"), (c("user_id") % 3).cast("string"))).alias("dag_key"),
        F.when(c("event_type") == "view", "WAITING")
        .when(c("event_type").isin("click", "purchase"), "COMPLETED")
        .when(failed, "FAILED")
        .alias("status"),
        F.when(~start, F.struct((c("k") % 3).alias("index"))).alias("batch"),
        F.when(~start, F.struct(name.alias("actionName"), code.alias("actionCode"))).alias("action"),
        F.when(
            F.lit(False),
            F.struct(
                no_time.alias("startedAt"), no_time.alias("finishedAt"), F.lit(None).cast("long").alias("durationMs")
            ),
        ).alias("execution"),
        F.when(~start, result).alias("result"),
        F.when(failed, F.struct((c("k") % 4 == 0).alias("retryable"))).alias("error"),
        F.when(start, F.struct(F.struct(c("correlation_id").alias("id")).alias("processFlow"))).alias("inputs"),
    )


def event_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_events(table(spark, sf_dir, "events"))


def line_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` rows as task updates in ledger form, ordered by the struct ``arrival_seq``."""
    c = F.col
    flow = c("l_orderkey").cast("string")
    task_id = F.concat(flow, F.lit("-"), c("l_linenumber").cast("string"))
    finished = c("l_linestatus") == "F"
    return table(spark, sf_dir, "lineitem").select(
        flow.alias("correlation_id"),
        task_id.alias("task_flow_id"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice").alias("arrival_seq"),
        c("l_shipdate").alias("event_time"),
        (c("l_linenumber") % 3).alias("batch_index"),
        F.concat(F.lit("n"), (c("l_partkey") % 10).cast("string")).alias("action_name"),
        F.concat(F.lit("N"), (c("l_partkey") % 10).cast("string")).alias("action_code"),
        F.when(c("l_returnflag") == "A", "COMPLETED")
        .when(c("l_returnflag") == "R", "FAILED")
        .when(c("l_returnflag") == "N", "WAITING")
        .alias("status"),
        F.lit(True).alias("has_action"),
        F.lit(True).alias("has_result"),
        finished.alias("has_execution"),
        F.when(finished, c("l_shipdate")).alias("started_at"),
        F.when(finished & (c("l_returnflag") == "A"), c("l_shipdate")).alias("finished_at"),
        F.when(finished & (c("l_partkey") % 2 == 0), c("l_quantity").cast("long")).alias("duration_ms"),
        F.concat(F.lit('{"id":"'), task_id, F.lit('"}')).alias("result_json"),
        F.when(c("l_returnflag") == "R", F.concat(F.lit('{"retryable":'), (~finished).cast("string"), F.lit("}"))).alias(
            "error_json"
        ),
        F.when(c("l_partkey") % 5 == 0, F.lit("  "))
        .when(c("l_partkey") % 5 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("/taskFlow/"), task_id))
        .alias("href"),
        "l_partkey",
    )


def part_action_codes(spark: SparkSession, sf_dir: str, name=None) -> DataFrame:
    """``part`` rows as action codes; names repeat, so the last row wins."""
    c = F.col
    return table(spark, sf_dir, "part").select(
        F.lpad(F.replace(c("p_brand"), F.lit("Brand#"), F.lit("")), 2, "0").alias("action_code"),
        (c("p_name") if name is None else name).alias("action_name"),
        F.lit(True).alias("enabled"),
        c("p_type").alias("action_type"),
        c("p_partkey").alias("load_pos"),
    )


def part_dcx_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "part").select(
        F.lpad(F.replace(c("p_brand"), F.lit("Brand#"), F.lit("")), 2, "0").alias("parent"),
        F.when(c("p_size") % 5 != 0, c("p_type")).alias("flow_type"),
        F.when(c("p_size") % 4 == 0, "").otherwise(F.concat(F.lit("M"), (c("p_size") % 3).cast("string"))).alias(
            "modem_type"
        ),
        F.when(c("p_partkey") % 13 != 0, F.concat(F.lit("DCX-"), c("p_partkey").cast("string"))).alias(
            "dcx_action_code"
        ),
        c("p_partkey").alias("load_pos"),
    )
