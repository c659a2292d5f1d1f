"""Registered queries: each takes (spark, sf_dir) and reads whole tables of that folder."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens import schemas as S
from flowlens.functions.body import to_attributes
from flowlens.functions.text import day_start
from flowlens.operators import barriers as B
from flowlens.operators import commands as C
from flowlens.operators import documents as D
from flowlens.operators import lookups as L
from flowlens.operators import notifications as N
from flowlens.operators import reports, routing, tasks
from flowlens.operators.skew import CHUNK, chunk_of, measured
from flowlens.operators.storage import cut, fresh_dir
from flowlens.sources import adapters as A
from flowlens.sources import catalogue as K
from flowlens.sources import envelopes as E
from flowlens.sources import tables

c = F.col


# ---- routing and classification -------------------------------------------------------------------------------


def mixed_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """Event envelopes with every message name, foreign and own commands, unknown and missing names."""
    slot = c("arrival_seq") % 10
    return (
        A.event_envelopes(spark, sf)
        .withColumn(
            "message_name",
            F.when(slot.isin(0, 1), S.EXECUTE)
            .when(slot == 2, S.SIGNAL)
            .when(slot == 3, S.LIFECYCLE)
            .when(slot == 4, "Task.Event")
            .when(slot != 5, c("message_name")),
        )
        .withColumn("source", F.when(slot == 0, S.SOURCE_ENGINE).when(slot != 9, c("source")))
    )


def route_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    return routing.routed(mixed_envelopes(spark, sf)).select("arrival_seq", "correlation_id", "message_name", "route")


def message_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return reports.message_counts(mixed_envelopes(spark, sf))


def message_listing(spark: SparkSession, sf: str) -> DataFrame:
    return reports.message_listing(mixed_envelopes(spark, sf))


def conformance_report(spark: SparkSession, sf: str) -> DataFrame:
    seq = c("arrival_seq")
    rows = (
        A.event_envelopes(spark, sf)
        .withColumn("status", F.when(seq % 23 != 0, c("status")))
        .withColumn("dag_key", F.when(seq % 29 == 0, "dagX").otherwise(c("dag_key")))
        .withColumn("source", F.when(seq % 31 == 0, S.SOURCE_ENGINE).otherwise(c("source")))
        .withColumn("correlation_id", F.when(seq % 37 != 0, c("correlation_id")))
    )
    return (
        routing.violations(rows)
        .filter(F.size("violations") > 0)
        .select("arrival_seq", "message_name", F.concat_ws(",", "violations").alias("violations"))
    )


def raw_event_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as raw records: some cut short, some of the wrong root, some with unknown enums, some empty."""
    seq = c("arrival_seq")
    env = A.event_envelopes(spark, sf).withColumn(
        "status", F.when(seq % 13 == 0, "DONE").otherwise(c("status"))
    )
    body = F.to_json(
        F.struct(
            c("event_id").alias("eventId"),
            c("correlation_id").alias("correlationId"),
            c("message_type").alias("messageType"),
            c("message_name").alias("messageName"),
            "source",
            "status",
            "batch",
            "action",
            "result",
        )
    )
    return env.select(
        "arrival_seq",
        F.when(seq % 19 == 0, F.lit(None))
        .when(seq % 17 == 0, F.lit("[]"))
        .when(seq % 11 == 0, F.substring(body, 1, 40))
        .otherwise(body)
        .alias("value"),
    )


def quarantine_split(spark: SparkSession, sf: str) -> DataFrame:
    return split_outcome(E.mark_envelopes(raw_event_log(spark, sf)))


def quarantine_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """The raw log as records of a topic with eight partitions, every fifth one delivered twice; the unreadable ones."""
    seq = c("arrival_seq")
    log = raw_event_log(spark, sf).select(
        F.lit("flow-events").alias("topic"), (seq % 8).alias("partition"), F.expr("arrival_seq div 8").alias("offset"),
        (seq % 100).cast("string").alias("key"), "value", F.explode(F.sequence(F.lit(1), F.when(seq % 5 == 0, 2).otherwise(1))).alias("delivery"),
    )
    marked = E.mark_envelopes(log, keep=(*E.POSITION, "key"))
    size = F.length("raw_value")  # of a whole record it follows from the writer; only the cut ones are told
    return E.quarantine_records(marked).select(*E.POSITION, "key", F.when(size <= 40, size).alias("text_length"), "deliveries")


def split_outcome(marked: DataFrame) -> DataFrame:
    """Both sides of the split in one pass; fields of unreadable records are blanked."""
    ok = c("readable")
    return marked.select(
        "arrival_seq",
        F.when(ok, "good").otherwise("quarantine").alias("outcome"),
        F.when(ok, c("correlation_id")).alias("correlation_id"),
        F.when(ok, c("status")).alias("status"),
        F.when(ok, c("batch.index")).alias("batch_index"),
    )


def event_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return E.ledger(A.event_envelopes(spark, sf))


def bad_body_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The event ledger with stored bodies as text, every 11th of them unreadable, every 13th an empty object."""
    text = (
        F.when(c("arrival_seq") % 11 == 0, "{bad")
        .when(c("arrival_seq") % 13 == 0, "{}")
        .when(c("arrival_seq") % 17 == 0, "[]")
        .otherwise(c("result_json"))
    )
    return E.with_json_verdict(event_ledger(spark, sf).withColumn("result_json", text))


def body_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = bad_body_ledger(spark, sf).filter(c("message_name") == S.TASK_EVENT)
    return rows.select(
        "arrival_seq",
        c("verdict.parsed").alias("parsed"),
        c("verdict.body_status").alias("body_status"),
        c("verdict.status_code").alias("status_code"),
        c("verdict.change_reason").alias("change_reason"),
    )


def valid_initiations(spark: SparkSession, sf: str) -> DataFrame:
    return B.seeds(event_ledger(spark, sf), A.event_catalogue(spark)).select(
        "correlation_id", "dag_key", "task_total", "opened_seq"
    )


def task_event_class(spark: SparkSession, sf: str) -> DataFrame:
    rows = event_ledger(spark, sf).filter(routing.is_countable_candidate())
    return rows.select(
        "arrival_seq",
        routing.event_class(c("status")).alias("event_class"),
        (routing.counts_as_done() | routing.counts_as_failed()).alias("countable"),
    )


# ---- tasks ----------------------------------------------------------------------------------------------------


def line_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Line updates as task events; a piece is one day and a run of part keys, never falling along the order."""
    piece = F.struct("arrival_seq.l_shipdate", F.expr("l_partkey div 1024").alias("run"))
    return (
        A.line_updates(spark, sf).withColumn("message_name", F.lit(S.TASK_EVENT)).withColumn(CHUNK, piece)
    )


def line_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.upsert_tasks(line_ledger(spark, sf).filter(routing.is_auditable()))


def task_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return line_tasks(spark, sf).drop("first_seq", "last_seq")


def event_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.upsert_tasks(event_ledger(spark, sf).filter(routing.is_auditable()))


def task_upsert_events(spark: SparkSession, sf: str) -> DataFrame:
    return event_tasks(spark, sf).select(
        "correlation_id", "task_flow_id", "action_name", "action_code", "batch_index", "status", "result_json",
        "error_json", "first_seq", "last_seq",
    )


def waiting_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return routing.waiting_tasks(event_tasks(spark, sf)).select("correlation_id", "task_flow_id", "last_seq")


def latest_results(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.latest_results(event_tasks(spark, sf)).orderBy(c("first_seq").desc())


# ---- barriers -------------------------------------------------------------------------------------------------


def barrier_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of every batch a flow could reach if no drained batch were kicked out."""
    log = B.working_log(event_ledger(spark, sf))
    rows = B.barrier_rows(B.closing_positions(log, A.event_catalogue(spark)))
    return rows.select(
        "correlation_id", "batch_index", "task_total", "task_completed", "task_failed", "pending",
        F.when(c("pending") == 0, "DRAINED").otherwise("OPEN").alias("status"),
    )


def event_barriers(spark: SparkSession, sf: str) -> DataFrame:
    return B.lifecycle(event_ledger(spark, sf), A.event_catalogue(spark))


def barrier_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    return event_barriers(spark, sf).select(
        "correlation_id", "batch_index", "dag_key", "task_total", "task_completed", "task_failed", "pending", "status",
        "opened_seq", "closed_seq", "kickout",
    )


def verify_listing(spark: SparkSession, sf: str) -> DataFrame:
    return reports.barrier_listing(event_barriers(spark, sf))


def task_listing(spark: SparkSession, sf: str) -> DataFrame:
    return reports.task_listing(event_tasks(spark, sf))


def flow_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """Barriers and tasks out of one stored log, so that the events are decoded once."""
    log = B.working_log(event_ledger(spark, sf), "has_execution", "started_at", "finished_at", "duration_ms")
    barriers = B.lifecycle_of(log, A.event_catalogue(spark))
    return reports.flow_outcome(barriers, tasks.upsert_tasks(log.filter(routing.is_auditable())))


def final_state(spark: SparkSession, sf: str) -> DataFrame:
    """Flow ends over stored bodies, some of them unreadable."""
    log, catalogue = B.working_log(bad_body_ledger(spark, sf)), A.event_catalogue(spark)
    return B.flow_ends(B.lifecycle_of(log, catalogue), log, catalogue)


def flow_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Stored flow documents out of orders; every second one holds an old status entry in odd case."""
    key = c("o_orderkey")
    even = key % 2 == 0

    def entry(name: Column, value: Column) -> Column:
        return F.struct(
            F.lit(None).cast("string").alias("id"),
            name.alias("name"),
            value.alias("value"),
            F.lit("string").alias("valueType"),
            F.lit(None).cast("string").alias("@type"),
            F.lit(None).cast("string").alias("@baseType"),
            F.lit(None).cast("array<string>").alias("characteristicRelationship"),
        )

    return A.table(spark, sf, "orders").select(
        F.concat(F.expr("o_orderkey div 5").cast("string"), F.lit("-"), (key % 5).cast("string")).alias("id"),
        F.when(c("o_orderstatus") == "O", "inProgress")
        .when(c("o_orderstatus") == "F", "COMPLETED")
        .otherwise("no such state")
        .alias("state"),
        F.array(
            entry(F.lit("priority"), c("o_orderpriority")),
            entry(F.when(even, "PROCESSSTATUS").otherwise("customer"), c("o_custkey").cast("string")),
        ).alias("characteristic"),
    )


def attributes_text(attributes: Column) -> Column:
    return F.concat_ws("|", F.transform(attributes, lambda a: F.concat(a["name"], F.lit("="), a["value"])))


def final_patch(spark: SparkSession, sf: str) -> DataFrame:
    log, barriers, catalogue = event_parts(spark, sf)
    ends = B.flow_ends(barriers, log, catalogue)
    return D.final_patches(ends, flow_documents(spark, sf)).select(
        "id", "state", attributes_text(c("characteristic")).alias("attributes")
    )


def state_patches(spark: SparkSession, sf: str) -> DataFrame:
    return D.state_patches(flow_documents(spark, sf), routing.flow_state(c("state")))


# ---- references and documents ---------------------------------------------------------------------------------

REF_FIELDS = ["href", "name", "role", "type", "referred_type", "flow_ref_type"]


def task_refs(spark: SparkSession, sf: str) -> DataFrame:
    """Line updates' references merged into the lists orders hold already."""
    key = c("o_orderkey").cast("string")
    existing = (
        A.table(spark, sf, "orders")
        .filter(c("o_orderstatus") == "F")
        .select(
            key.alias("correlation_id"),
            F.lit(1).cast("long").alias("pos"),
            F.concat(key, F.lit("-1")).alias("id"),
            F.lit("/old").alias("href"),
            F.lit("old").alias("name"),
            F.lit(D.REF_ROLE).alias("role"),
            F.lit(D.REF_TYPE).alias("type"),
            F.lit(D.REF_REFERRED).alias("referred_type"),
            F.lit("old").alias("flow_ref_type"),
        )
    )
    return D.merged_refs(existing, D.task_refs(line_ledger(spark, sf)), REF_FIELDS)


def task_flow_refs(spark: SparkSession, sf: str) -> DataFrame:
    """Line updates' references merged into both lists of a document, of which one may hold an id that the other lacks."""
    key = c("o_orderkey").cast("string")
    entry = F.when(c("o_orderstatus") == "F", F.struct(F.lit(D.RELATED).alias("list"), F.lit("-1").alias("n"))).when(
        c("o_orderstatus") == "O", F.struct(F.lit(D.TASK_FLOW).alias("list"), F.lit("-2").alias("n")))
    existing = A.table(spark, sf, "orders").withColumn("_e", entry).filter(c("_e").isNotNull()).select(
        key.alias("correlation_id"), c("_e.list").alias("list"), F.lit(1).cast("long").alias("pos"),
        F.concat(key, c("_e.n")).alias("id"), F.lit("/old").alias("href"), F.lit("old").alias("referred_type"),
    )
    new = D.both_lists(D.task_refs(line_ledger(spark, sf)))
    return D.merged_refs(existing, new, ["href", "referred_type"], ("correlation_id", "list"))


def line_patches(spark: SparkSession, sf: str) -> DataFrame:
    """One patch per order (first) and per line, with some fields absent."""
    none = F.lit(None).cast("string")
    order = "struct<l_shipdate:timestamp_ntz,l_partkey:bigint,l_suppkey:bigint,l_extendedprice:double>"
    pair = "array<struct<name:string,value:string>>"
    base = A.table(spark, sf, "orders").select(
        c("o_orderkey").alias("id"),
        F.struct(
            F.lit("1970-01-01 00:00:00").cast("timestamp_ntz").alias("l_shipdate"),
            F.lit(-1).cast("long").alias("l_partkey"),
            F.lit(-1).cast("long").alias("l_suppkey"),
            F.lit(-1.0).alias("l_extendedprice"),
        )
        .cast(order)
        .alias("seq"),
        F.lit("initial").alias("state"),
        none.alias("href"),
        c("o_orderpriority").alias("specification"),
        F.array(F.struct(F.lit("status").alias("name"), c("o_orderstatus").alias("value"))).cast(pair).alias(
            "characteristic"
        ),
        F.lit(None).cast("array<struct<id:string,name:string>>").alias("related"),
    )
    lines = A.table(spark, sf, "lineitem").select(
        c("l_orderkey").alias("id"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice").cast(order).alias("seq"),
        F.when(c("l_returnflag") == "A", "completed").when(c("l_returnflag") == "R", "failed").alias("state"),
        F.when(c("l_linestatus") == "F", F.concat(F.lit("/flow/"), c("l_orderkey").cast("string"))).alias("href"),
        none.alias("specification"),
        F.when(
            c("l_partkey") % 3 == 0,
            F.array(
                F.struct(F.lit("part").alias("name"), c("l_partkey").cast("string").alias("value")),
                F.struct(F.lit("line").alias("name"), c("l_linenumber").cast("string").alias("value")),
            ),
        ).alias("characteristic"),
        F.when(
            c("l_returnflag") != "N",
            F.array(
                F.struct(
                    F.concat_ws("-", c("l_orderkey").cast("string"), c("l_linenumber").cast("string")).alias("id"),
                    c("l_returnflag").alias("name"),
                )
            ),
        ).alias("related"),
    )
    return base.unionByName(lines)


def flow_document(spark: SparkSession, sf: str) -> DataFrame:
    folded = D.fold_patches(line_patches(spark, sf), ["state", "href", "specification", "characteristic"])
    return folded.select(
        "id", "state", "href", "specification", attributes_text(c("characteristic")).alias("attributes")
    )


def appended_related(spark: SparkSession, sf: str) -> DataFrame:
    """The appending store's list, in row form."""
    patches = line_patches(spark, sf).withColumnRenamed("related", "_rel")
    rows = D.appended_entries(patches.withColumn("_rel", F.transform("_rel", lambda e: F.struct(
        e["id"].alias("entry_id"), e["name"].alias("entry_name")))), "_rel")
    return rows.select("id", c("seq.l_shipdate").alias("patched_at"), "entry_pos", "entry_id", "entry_name")


# ---- registry -------------------------------------------------------------------------------------------------


def action_codes(spark: SparkSession, sf: str) -> DataFrame:
    return measured(K.valid_action_codes(A.part_action_codes(spark, sf)))


def dcx_codes(spark: SparkSession, sf: str) -> DataFrame:
    return measured(K.valid_dcx_codes(A.part_dcx_codes(spark, sf)))


def looked_up(spark: SparkSession, sf: str) -> DataFrame:
    """What lines ask the registry for, counted: lines are summed per part before they meet the part table.

    Parts of brand 13 ask for a name nobody registered.
    """
    per_part = A.table(spark, sf, "lineitem").groupBy(c("l_partkey").alias("p_partkey")).agg(
        F.count(F.lit(1)).alias("lines")
    )
    name = F.when(c("p_brand") == "Brand#13", F.concat(F.lit("unknown "), c("p_name"))).otherwise(c("p_name"))
    return (
        per_part.join(A.table(spark, sf, "part"), "p_partkey")
        .groupBy(
            name.alias("action_name"),
            c("p_type").alias("flow_type"),
            F.concat(F.lit("M"), (c("p_size") % 3).cast("string")).alias("modem_type"),
        )
        .agg(F.sum("lines").alias("lines"))
    )


def action_lookup(spark: SparkSession, sf: str) -> DataFrame:
    codes = action_codes(spark, sf)
    asked = looked_up(spark, sf).groupBy("action_name").agg(F.sum("lines").alias("lines"))
    return L.with_default_code(L.with_action(asked, codes), codes, "red bolt").select(
        "action_name", "lines", "known", "action_code", "action_type", "code_or_default", "name_or_default"
    )


def reverse_lookup(spark: SparkSession, sf: str) -> DataFrame:
    names = L.names_by_code(action_codes(spark, sf))
    asked = A.part_action_codes(spark, sf).groupBy("action_code").agg(F.count(F.lit(1)).alias("parts"))
    return asked.join(measured(names), "action_code", "left").select("action_code", "parts", "action_name")


def dcx_lookup(spark: SparkSession, sf: str) -> DataFrame:
    codes, dcx = action_codes(spark, sf), dcx_codes(spark, sf)
    known = L.with_action(looked_up(spark, sf), codes)
    return L.with_dcx(known, dcx, c("flow_type"), c("modem_type")).select(
        "action_name", "flow_type", "modem_type", "lines", "action_code", "dcx_action_code",
        F.coalesce("dcx_action_code", F.lit("FALLBACK")).alias("dcx_or_default"),
    )


def resolved_actions(spark: SparkSession, sf: str) -> DataFrame:
    asked = looked_up(spark, sf).groupBy("action_name").agg(F.sum("lines").alias("lines"))
    return L.resolve(asked, action_codes(spark, sf), dcx_codes(spark, sf)).select(
        "action_name", "lines", "action_code", "dcx_action_code"
    )


def dcx_membership(spark: SparkSession, sf: str) -> DataFrame:
    known = L.contains_name(looked_up(spark, sf), action_codes(spark, sf))
    keyed = L.with_action(known, action_codes(spark, sf))
    return L.contains_dcx_key(keyed, dcx_codes(spark, sf)).select("action_name", "flow_type", "modem_type", "action_code")


def missing_required(spark: SparkSession, sf: str) -> DataFrame:
    required = looked_up(spark, sf).select("action_name").distinct()
    return L.missing_names(required, action_codes(spark, sf))


def blanked_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Registry loads with unusable rows: blank or missing names."""
    name = F.when(c("p_partkey") % 10 == 0, F.lit(" \t")).when(c("p_partkey") % 10 != 1, c("p_name"))
    return A.part_action_codes(spark, sf, name)


def registry_audit(spark: SparkSession, sf: str) -> DataFrame:
    rows, dcx = blanked_parts(spark, sf), A.part_dcx_codes(spark, sf)
    return K.registry_audit("action_codes", rows, c("action_name"), c("action_name")).unionByName(
        K.registry_audit("dcx_action_codes", dcx, c("parent"), K.dcx_row_key())
    )


def registry_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """One registry takes its new load; the other keeps the old one, for the new load has no valid row."""
    old = K.valid_action_codes(A.part_action_codes(spark, sf, c("p_type")))
    new = K.valid_action_codes(blanked_parts(spark, sf))
    old_dcx = K.valid_dcx_codes(A.part_dcx_codes(spark, sf))
    new_dcx = K.valid_dcx_codes(A.part_dcx_codes(spark, sf).withColumn("parent", F.lit("  ")))
    taken = K.select_snapshot(old, new).select(
        F.lit("action_codes").alias("registry"), c("action_name").alias("name"), c("action_code").alias("code")
    )
    kept = K.select_snapshot(old_dcx, new_dcx).select(
        F.lit("dcx_action_codes").alias("registry"), c("dcx_key").alias("name"), c("dcx_action_code").alias("code")
    )
    return taken.unionByName(kept)


# ---- commands and lifecycle -----------------------------------------------------------------------------------


def command_codes(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("a"), (c("p_partkey") % 2).cast("string"))
    return measured(K.valid_action_codes(A.part_action_codes(spark, sf, name)))


def event_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, K.Catalogue]:
    """Stored log and barrier table, for queries that read them more than once."""
    log, catalogue = B.working_log(event_ledger(spark, sf)), A.event_catalogue(spark)
    return log, cut(B.lifecycle_of(log, catalogue)), catalogue


def opened_dependencies(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, K.Catalogue]:
    catalogue = A.event_catalogue(spark)
    log = B.working_log(C.dependency_candidates(event_ledger(spark, sf), catalogue), "result_json")
    barriers = cut(B.lifecycle_of(log, catalogue))
    return C.dependency_rows(log, barriers, catalogue), barriers, catalogue


def command_view(rows: DataFrame) -> DataFrame:
    deps = F.concat_ws(
        "|", F.transform(F.map_entries("dependency_results"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    )
    return rows.select(
        "event_id", c("event_time").cast("timestamp_ntz").alias("event_time"), "correlation_id", "message_name", "message_type",
        "source", "intent", "dag_key", "batch_index", "batch_total", "action_name", "action_code", "dcx_action_code",
        "execution_mode", deps.alias("dependency_results"), "process_flow", "command_seq", "emit_pos",
    )


def batch_commands(spark: SparkSession, sf: str) -> DataFrame:
    catalogue = A.event_catalogue(spark)
    log = B.working_log(C.dependency_candidates(event_ledger(spark, sf), catalogue), "result_json")
    barriers = cut(B.lifecycle_of(log, catalogue))
    found = C.dependency_rows(log, barriers, catalogue)
    opened = C.with_context(barriers, log)
    return command_view(C.batch_commands(opened, catalogue, command_codes(spark, sf), dcx_codes(spark, sf), found))


def dependency_results(spark: SparkSession, sf: str) -> DataFrame:
    rows, _, _ = opened_dependencies(spark, sf)
    return rows.select("correlation_id", "batch_index", "action_pos", "dependency", "result_json").filter(
        c("result_json").isNotNull()
    )


def missing_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    rows, _, _ = opened_dependencies(spark, sf)
    return C.missing_dependencies(rows).select("correlation_id", "batch_index", "action_pos", "dependency")


def lifecycle_rows(spark: SparkSession, sf: str) -> DataFrame:
    ledger, barriers, catalogue = event_parts(spark, sf)
    ends = B.flow_ends(barriers, ledger, catalogue)
    return C.lifecycle_rows(barriers, ends, ledger, catalogue).select(
        "correlation_id", "message_name", "source", "dag_key", "status", "error_message", "error_retryable",
        "lifecycle_seq", "emit_pos",
    )


def catalogue_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Every initiation of the log against the catalogue: its DAG's batches, sizes and whether a batch follows."""
    catalogue = A.event_catalogue(spark)
    per_dag = B.initiations(event_ledger(spark, sf)).groupBy("dag_key").agg(F.count(F.lit(1)).alias("initiations"))
    return B.next_batches(per_dag.join(catalogue.batches, "dag_key"), catalogue).select(
        "dag_key", "initiations", "batch_index", "task_total", "has_next", "next_total"
    )


# ---- notifications --------------------------------------------------------------------------------------------


def order_notifications(spark: SparkSession, sf: str) -> DataFrame:
    key = c("o_orderkey")
    kind = F.when(key % 3 == 0, "processFlow").when(key % 3 == 1, "PROCESSFLOW").otherwise("other")
    return A.table(spark, sf, "orders").select(
        key.alias("arrival_seq"),
        kind.alias("@type"),
        F.when(key % 19 != 0, key.cast("string")).alias("id"),
        c("o_orderstatus").alias("state"),
        F.when(key % 17 != 0, c("o_orderpriority")).alias("processFlowSpecification"),
    )


def initiations_from_notifications(spark: SparkSession, sf: str) -> DataFrame:
    return N.initiated_from(order_notifications(spark, sf)).select(
        "arrival_seq", "correlation_id", "schema_version", "message_type", "message_name", "source", "dag_key",
        c("inputs.processFlow.state").alias("flow_state"),
    )


def reply_notifications(events: DataFrame) -> DataFrame:
    """Clicks of the event log as async replies; some lack the transaction id, some the reporting system."""
    rows = A.shape_events(events.filter(c("event_type") == "click"))
    none = F.lit(None).cast("string")
    txn = F.concat_ws("-", F.lit("ASYNC"), c("user_id").cast("string"), c("k").cast("string"))
    return rows.select(
        "arrival_seq",
        c("event_time").alias("at"),
        F.when(c("k") % 2 == 0, S.ASYNC_REPLY).otherwise(S.ASYNC_REPLY.lower()).alias("@type"),
        none.alias("id"),
        none.alias("processFlowSpecification"),
        c("correlation_id").alias("correlationId"),
        c("event_id").alias("eventId"),
        F.struct(F.when(c("k") % 17 != 0, txn).alias("id"), none.alias("href")).alias("event"),
        F.when(c("k") % 3 != 0, F.struct(F.lit("desk").alias("id"))).alias("reportingSystem"),
    )


def signals_from_notifications(spark: SparkSession, sf: str) -> DataFrame:
    return N.signals_from(reply_notifications(A.table(spark, sf, "events"))).select(
        "arrival_seq", "correlation_id", "message_type", "message_name", "source",
        c("inputs.downstream.id").alias("transaction_id"),
        c("inputs.externalType").alias("external_type"),
        c("inputs.reportingSystem").alias("reporting_system"),
    )


def waiting_registrations(events: DataFrame) -> DataFrame:
    rows = A.shape_events(events.filter(c("event_type") == "view"))
    return rows.select(
        F.concat_ws("-", F.lit("ASYNC"), c("user_id").cast("string"), c("k").cast("string")).alias("transaction_id"),
        "arrival_seq",
        chunk_of("arrival_seq").alias(CHUNK),
        c("event_time").alias("at"),
        "correlation_id",
        c("result.id").alias("task_flow_id"),
    )


def replies(events: DataFrame) -> DataFrame:
    return reply_notifications(events).filter(c("event.id").isNotNull()).select(
        c("event.id").alias("transaction_id"), "arrival_seq", chunk_of("arrival_seq").alias(CHUNK), "at"
    )


def signals_correlated(spark: SparkSession, sf: str) -> DataFrame:
    events = A.table(spark, sf, "events")
    return N.correlate_replies(waiting_registrations(events), replies(events))


# ---- tables ---------------------------------------------------------------------------------------------------

TODAY = dt.date(2000, 1, 1)


def dated_line_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """The stored task table: written once, since each lookup reads it more than once."""
    rows = line_tasks(spark, sf).select("correlation_id", "task_flow_id", "status", "batch_index", "created_at")
    return cut(rows.withColumn(tables.DAY, F.to_date("created_at")))


def order_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = c("o_orderkey").cast("string")
    return A.table(spark, sf, "orders").select(
        key.alias("correlation_id"), F.concat(key, F.lit("-"), (c("o_custkey") % 7 + 1).cast("string")).alias("task_flow_id")
    )


def recent_first_lookup(spark: SparkSession, sf: str) -> DataFrame:
    found = tables.recent_first(
        order_keys(spark, sf), dated_line_tasks(spark, sf), ["correlation_id", "task_flow_id"], TODAY
    )
    return found.select(
        "correlation_id", "task_flow_id", "status", tables.DAY, day_start(c("created_at")).cast("date").alias("day"), "phase"
    )


def existing_rows(spark: SparkSession, sf: str) -> DataFrame:
    return tables.existing_keys(
        order_keys(spark, sf), dated_line_tasks(spark, sf), ["correlation_id", "task_flow_id"]
    )


def flow_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All task rows of the flows whose order failed its status check, across all days."""
    flows = A.table(spark, sf, "orders").filter(c("o_orderstatus") == "P").select(
        c("o_orderkey").cast("string").alias("correlation_id")
    )
    return tables.of_flows(dated_line_tasks(spark, sf), flows).select(
        "correlation_id", "task_flow_id", "status", "batch_index"
    )


def retained_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Task rows through the day-partitioned table, then its last 20 days."""
    path = fresh_dir(spark, "tasks")
    tables.write_days(event_tasks(spark, sf).withColumn(tables.DAY, F.to_date("created_at")), path)
    kept = tables.retained(tables.read_days(spark, path), dt.date(2024, 1, 30), days=20)
    return kept.select("correlation_id", "task_flow_id", "action_name", "batch_index", "status", tables.DAY)


BARRIER_DAY = dt.date(2024, 1, 20)


def stored_barriers(spark: SparkSession, sf: str) -> str:
    """The barrier table of the event log in its day partitions; the folder."""
    log, barriers, _ = event_parts(spark, sf)
    path = fresh_dir(spark, "barriers")
    tables.write_barriers(B.with_times(barriers, log), path)
    return path


def barrier_table(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_days(spark, stored_barriers(spark, sf)).select(
        "correlation_id", "batch_index", "dag_key", "task_total", "task_completed", "task_failed", "status", "opened_at",
        "closed_at", "created_at", tables.DAY,
    )


def barrier_keys(spark: SparkSession, sf: str) -> DataFrame:
    """(flow, batch) pairs somebody asks for: those that purchases of the log name, and some that never were."""
    rows = A.shape_events(A.table(spark, sf, "events").filter(c("event_type") == "purchase"))
    return rows.select("correlation_id", c("batch.index").alias("batch_index")).distinct()


def barrier_recent_first(spark: SparkSession, sf: str) -> DataFrame:
    path = stored_barriers(spark, sf)
    found = tables.recent_first_days(
        barrier_keys(spark, sf), tables.read_days(spark, path), ["correlation_id", "batch_index"],
        tables.partition_days(spark, path), BARRIER_DAY,
    )
    return found.select("correlation_id", "batch_index", "status", tables.DAY, "phase")


def barrier_exists(spark: SparkSession, sf: str) -> DataFrame:
    path = stored_barriers(spark, sf)
    keys, on = barrier_keys(spark, sf), ["correlation_id", "batch_index"]
    found = tables.recent_first_days(keys, tables.read_days(spark, path).select(*on, tables.DAY), on, tables.partition_days(spark, path), BARRIER_DAY)
    there = found.select(*on).distinct().withColumn("there", F.lit(True))
    return keys.join(there, on, "left").select(*on, F.coalesce("there", F.lit(False)).alias("there"))


def flow_barriers(spark: SparkSession, sf: str) -> DataFrame:
    """All barriers of the flows of every seventh user, across all days."""
    flows = A.shape_events(A.table(spark, sf, "events").filter("user_id % 7 = 0")).select("correlation_id").distinct()
    rows = tables.read_days(spark, stored_barriers(spark, sf))
    return tables.of_flows(rows, flows).select("correlation_id", "batch_index", "status", "opened_seq", tables.DAY)


def result_characteristics(spark: SparkSession, sf: str) -> DataFrame:
    """Result maps of events as attribute rows in order."""
    values = F.create_map(
        F.lit("type"), c("event_type"), F.lit("k"), F.get_json_object("props", "$.k"),
        F.lit("note"), F.when(c("value") > 10, F.round("value", 0).cast("bigint").cast("string")),
    )
    rows = A.table(spark, sf, "events").select(
        c("event_id").alias("arrival_seq"), F.posexplode(to_attributes(values)).alias("pos", "a")
    )
    return rows.select(
        "arrival_seq", "pos", "a.name", "a.value", c("a.valueType").alias("value_type"), F.to_json("a").alias("json")
    )


def dedup_events(spark: SparkSession, sf: str) -> DataFrame:
    """The log with every record delivered twice, the second time later and altered."""
    env = A.event_envelopes(spark, sf).select("event_id", "arrival_seq", "correlation_id", "status", "k")
    again = env.withColumn("arrival_seq", c("arrival_seq") + 1_000_000_000).withColumn("status", F.lit("CANCELLED"))
    return reports.first_deliveries(env.unionByName(again))


BATCH_QUERIES = {
    f.__name__: f
    for f in (
        route_envelopes, message_inventory, message_listing, conformance_report, quarantine_split, quarantine_provenance, body_verdicts,
        valid_initiations, task_event_class, task_upsert, task_upsert_events, waiting_tasks, latest_results,
        barrier_counts, barrier_lifecycle, verify_listing, task_listing, flow_outcome, final_state, final_patch,
        state_patches, task_refs, task_flow_refs, flow_document, appended_related, action_lookup, reverse_lookup, dcx_lookup,
        resolved_actions, dcx_membership, missing_required, registry_audit, registry_snapshot, batch_commands,
        dependency_results, missing_dependencies, lifecycle_rows, catalogue_steps, initiations_from_notifications,
        signals_from_notifications, signals_correlated, recent_first_lookup, existing_rows, flow_rows, retained_rows,
        barrier_table, barrier_recent_first, barrier_exists, flow_barriers,
        result_characteristics, dedup_events,
    )
}
