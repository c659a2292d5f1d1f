"""Derived command and lifecycle rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens import schemas as S
from flowlens.functions.text import is_blank, or_default
from flowlens.operators import barriers as B
from flowlens.operators.lookups import with_action, with_dcx
from flowlens.operators.documents import folded_at
from flowlens.operators.routing import is_countable_candidate, is_initiation
from flowlens.operators.skew import CHUNK, CHUNK_ROWS, chunk_of, measured
from flowlens.operators.tasks import latest_results
from flowlens.sources.catalogue import Catalogue

c = F.col
FLOW = B.FLOW


def event_id(*parts: Column) -> Column:
    """Replay-stable id out of what makes a derived row unique."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def base_columns(flow: Column, name: str, kind: str, source: str, *key: Column) -> list[Column]:
    """Columns every derived envelope carries."""
    return [
        event_id(flow, F.lit(name), *key).alias("event_id"),
        flow.alias("correlation_id"),
        F.lit(S.SCHEMA_VERSION).alias("schema_version"),
        F.lit(kind).alias("message_type"),
        F.lit(name).alias("message_name"),
        F.lit(source).alias("source"),
    ]


def declared_dependencies(catalogue: Catalogue) -> DataFrame:
    """(dag_key, batch_index, action_pos, dependency), each distinct name of an action once."""
    return catalogue.actions.select(
        "dag_key", "batch_index", "action_pos", F.explode(F.array_distinct("depends_on")).alias("dependency")
    )


def batch_dependencies(catalogue: Catalogue) -> DataFrame:
    """Distinct flattened dependency names per batch, in declared order."""
    ordered = F.array_sort(F.collect_list(F.struct("action_pos", "depends_on")))
    return catalogue.actions.groupBy("dag_key", "batch_index").agg(
        F.array_distinct(F.flatten(F.filter(ordered["depends_on"], lambda a: a.isNotNull()))).alias("dependencies")
    )


def dependency_candidates(ledger: DataFrame, catalogue: Catalogue) -> DataFrame:
    """The ledger with result bodies kept only where some batch depends on the action and the event completed it."""
    needed = declared_dependencies(catalogue).select(c("dependency").alias("action_name")).distinct()
    marked = ledger.join(measured(needed.withColumn("_needed", F.lit(True))), "action_name", "left")
    return marked.withColumn(
        "result_json", F.when(c("_needed") & (c("status") == "COMPLETED"), c("result_json"))
    ).drop("_needed")


def dependency_rows(candidates: DataFrame, barriers: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Per opened batch and declared dependency: the newest completed result at opening, null when there is none."""
    opened = [F.max(F.when(c("batch_index") == i, c("opened_seq"))).alias(f"p{i}") for i in range(catalogue.depth)]
    at = barriers.groupBy(FLOW).agg(*opened, F.max("opened_seq").alias("p_last"))
    wanted = barriers.select(FLOW, "batch_index", "dag_key").join(
        declared_dependencies(catalogue), ["dag_key", "batch_index"]
    )
    states = B.states_at(candidates, at, ["status", "action_name", "result_json"], range(catalogue.depth))
    latest = latest_results(states, (FLOW, "moment", "action_name")).select(
        FLOW,
        c("moment").alias("batch_index"),
        c("action_name").alias("dependency"),
        "result_json",
    )
    return wanted.join(latest, [FLOW, "batch_index", "dependency"], "left")


def dependency_maps(rows: DataFrame) -> DataFrame:
    """Map of found results per action; as large as the action's declared list at most."""
    found = rows.filter(c("result_json").isNotNull())
    entry = F.struct(c("dependency").alias("key"), c("result_json").alias("value"))
    return found.groupBy(FLOW, "batch_index", "action_pos").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("dependency_results")
    )


def missing_dependencies(rows: DataFrame) -> DataFrame:
    return rows.filter(c("result_json").isNull()).drop("result_json")


#: Fields of the flow document that the log itself patches, and the wire names they have inside a command.
DOCUMENT = {"state": "doc_state", "href": "doc_href", "processFlowSpecification": "doc_specification"}


def patch_columns() -> list[Column]:
    """What a ledger row patches in its flow's document: an initiation names the specification, a completed task moves the
    state on and is the last reference. A field that a row does not touch is null."""
    begins, done = is_initiation(), is_countable_candidate() & (c("status") == "COMPLETED")
    return [
        F.when(begins, F.lit("initial")).when(done, F.lit("inProgress")).alias("doc_state"),
        F.when(done, c("href")).alias("doc_href"),
        F.when(begins, c("dag_key")).alias("doc_specification"),
    ]


def flow_patches(ledger: DataFrame) -> DataFrame:
    """(flow, chunk, arrival_seq, event_time, patched fields) of the rows at which a batch can open, or that patch the document."""
    begins = is_initiation()
    return ledger.filter(begins | is_countable_candidate()).select(
        F.when(begins, c("flow_id")).otherwise(c(FLOW)).alias(FLOW), CHUNK, "arrival_seq", "event_time", *patch_columns()
    )


def with_context(barriers: DataFrame, ledger: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds event_time and process_flow (JSON) to every barrier: the moment it opened, and its flow's document at that moment."""
    moments = barriers.withColumn("arrival_seq", c("opened_seq")).withColumn(CHUNK, chunk_of("opened_seq", chunk_rows))
    fields = ["event_time", *DOCUMENT.values()]
    return with_document(folded_at(flow_patches(ledger), moments, FLOW, fields)).drop("arrival_seq", CHUNK)


def with_document(rows: DataFrame) -> DataFrame:
    entry = F.struct(c(FLOW).alias("id"), *[c(n).alias(w) for w, n in DOCUMENT.items()])
    return rows.withColumn("process_flow", F.to_json(entry)).drop(*DOCUMENT.values())


def batch_commands(
    barriers: DataFrame, catalogue: Catalogue, codes: DataFrame, dcx: DataFrame, dependencies: DataFrame | None = None
) -> DataFrame:
    """One command per sendable action of every opened batch, in (command_seq, emit_pos) order.

    Blank and unregistered actions are not sent, yet ``batch_total`` stays the declared size. Barriers that carry the columns
    of ``with_context`` hand them on. ``barriers`` may be a stream of opened batches: all joins are with static tables then, and the
    results an action depends on come from its column ``results``, a map by action name.
    """
    actions = catalogue.actions.filter(~is_blank(c("action_name"))).select(
        "dag_key", "batch_index", "action_pos", "action_name", "execution_mode", "flow_type", "modem_type", "depends_on"
    )
    context = [n for n in ("event_time", "process_flow", "results") if n in barriers.columns]
    opened = barriers.select(FLOW, "batch_index", "dag_key", "task_total", "opened_seq", *context)
    rows = with_action(opened.join(actions, ["dag_key", "batch_index"]), codes).filter(c("action_code").isNotNull())
    rows = with_dcx(rows, dcx, or_default(c("flow_type")), or_default(c("modem_type")))
    if dependencies is not None:
        rows = rows.join(dependency_maps(dependencies), [FLOW, "batch_index", "action_pos"], "left")
    elif "results" in context:
        wanted = F.map_filter("results", lambda name, _: F.array_contains(c("depends_on"), name))
        ordered = F.map_from_entries(F.array_sort(F.map_entries(wanted)))
        rows = rows.withColumn("dependency_results", F.when(F.size(wanted) > 0, ordered))
    else:
        rows = rows.withColumn("dependency_results", F.lit(None).cast("map<string,string>"))
    return rows.select(
        *base_columns(
            c(FLOW), S.EXECUTE, "COMMAND", S.SOURCE_ENGINE, c("batch_index"), c("action_pos"), c("opened_seq")
        ),
        F.lit("EXECUTE").alias("intent"),
        "dag_key",
        "batch_index",
        c("task_total").alias("batch_total"),
        "action_name",
        "action_code",
        "dcx_action_code",
        "execution_mode",
        "dependency_results",
        *[n for n in context if n != "results"],
        c("opened_seq").alias("command_seq"),
        (c("action_pos") + 1).alias("emit_pos"),
    )


def lifecycle_rows(barriers: DataFrame, ends: DataFrame, ledger: DataFrame, catalogue: Catalogue) -> DataFrame:
    """INITIAL, COMPLETED and FAILED rows; INITIAL takes emit position 0, ahead of the flow's commands."""
    none = F.lit(None).cast("string")

    def shape(rows: DataFrame, status: Column, seq: str, pos: int, dag: Column, message: Column) -> DataFrame:
        return rows.select(
            *base_columns(c(FLOW), S.LIFECYCLE, "EVENT", S.SOURCE_ENGINE, status, c(seq)),
            dag.alias("dag_key"),
            status.alias("status"),
            message.alias("error_message"),
            F.when(status == "FAILED", F.lit(False)).alias("error_retryable"),
            c(seq).alias("lifecycle_seq"),
            F.lit(pos).alias("emit_pos"),
        )

    seeded = barriers.filter(c("batch_index") == 0)
    started = shape(seeded, F.lit("INITIAL"), "opened_seq", 0, c("dag_key"), none)
    hollow = B.empty_starts(barriers, ledger, catalogue)
    announced = shape(hollow, F.lit("INITIAL"), "end_seq", 0, c("dag_key"), none)
    ended = shape(ends, F.upper("state"), "end_seq", 1, none, c("message"))
    return started.unionByName(announced).unionByName(ended)
