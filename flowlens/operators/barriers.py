"""Barriers: seed once, count, close, decide, promote.

The sequential rules are stated relationally. A kickout only cuts a flow's chain of batches short, so the chain of
*closing positions* is built first (one step per batch index, each event entering one step only), then one pass over
the task events derives the state of every task as of each of those positions, then the decisions are taken and the
batches after a first kickout fall away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.functions.text import is_blank, pending, same_text
from flowlens.operators import routing
from flowlens.operators.skew import CHUNK, spread_join
from flowlens.operators.storage import cut
from flowlens.sources.catalogue import Catalogue

c = F.col
FLOW = "correlation_id"

# Final status texts and default reasons.
ERROR, FAILED, ERROR_701, PASSED = "ERROR", "FAILED", "ERROR_701", "Passed"
REASON_SUCCESS = "Process Flow Success"
REASON_FAILURE = "Process Flow Failure"
REASON_NO_TASK = "No Task/Action Performed"


def initiations(ledger: DataFrame) -> DataFrame:
    return ledger.filter(routing.is_initiation()).select(
        c("flow_id").alias(FLOW), CHUNK, "arrival_seq", "dag_key", "event_time"
    )


def working_log(ledger: DataFrame, *extra: str) -> DataFrame:
    """The rows and columns barriers need, decoded once and stored narrow; every later step reads this."""
    used = (
        "message_name", "dag_key", "has_flow", "flow_id", FLOW, CHUNK, "arrival_seq", "event_time", "status",
        "batch_index", "retryable", "has_action", "task_flow_id", "action_name", "action_code", "verdict", "href",
    )
    kept = routing.is_initiation() | routing.is_auditable() | routing.is_countable_candidate()
    return cut(ledger.filter(kept).select(*used, *extra))


def seeds(ledger: DataFrame, catalogue: Catalogue) -> DataFrame:
    """First initiation per flow whose DAG has actions in batch 0; later ones are ignored."""
    first = catalogue.batches.filter((c("batch_index") == 0) & c("task_total").isNotNull()).select(
        "dag_key", "task_total"
    )
    return (
        initiations(ledger)
        .join(first, "dag_key")
        .groupBy(FLOW)
        .agg(F.min(F.struct(c("arrival_seq").alias("opened_seq"), CHUNK, "dag_key", "task_total")).alias("_s"))
        .select(FLOW, "_s.dag_key", "_s.task_total", "_s.opened_seq", c(f"_s.{CHUNK}").alias("opened_chunk"))
    )


_BARRIER = "struct<batch_index:int,dag_key:string,task_total:int,opened_seq:bigint,task_completed:int,task_failed:int,closed_seq:bigint>"


def next_batches(closed: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Left join of closed batches with the declared batch of the next index."""
    nxt = catalogue.batches.select(
        "dag_key",
        (c("batch_index") - 1).alias("batch_index"),
        c("task_total").alias("next_total"),
        F.lit(True).alias("has_next"),
    )
    return closed.join(nxt, ["dag_key", "batch_index"], "left").withColumn(
        "has_next", F.coalesce("has_next", F.lit(False))
    )


def count_step(flows: DataFrame, events: DataFrame, catalogue: Catalogue, index: int) -> DataFrame:
    """Count batch ``index`` of every flow that has it open, close it when drained, open the next one.

    Only the first ``task_total`` countable events after opening matter, and no batch has more than the catalogue's widest. So
    events are ranked within (flow, chunk) pieces first and over the flow afterwards, both with that bound as a literal: Spark keeps
    that many rows per key in each task before either shuffle, and neither a hot flow nor a wide batch gathers its events.
    """
    open_row = c("opened_seq").isNotNull()
    opened = flows.filter(open_row).select(FLOW, "task_total", "opened_seq")
    mine = events.filter(c("batch_index") == index).select(FLOW, CHUNK, "arrival_seq", "failed")
    after = spread_join(mine, opened, FLOW).filter(c("arrival_seq") > c("opened_seq"))
    first = after
    for keys in ([FLOW, CHUNK], [FLOW]):
        rank = F.row_number().over(W.partitionBy(*keys).orderBy("arrival_seq"))
        first = first.withColumn("_rn", rank).filter(c("_rn") <= catalogue.widest)
    first = first.filter(c("_rn") <= c("task_total"))
    found = first.groupBy(FLOW).agg(
        F.count(F.when(~c("failed"), 1)).cast("int").alias("_ok"),
        F.count(F.when(c("failed"), 1)).cast("int").alias("_fail"),
        F.max("arrival_seq").alias("_seq"),
        F.max(CHUNK).alias("_chunk"),
    )
    done = flows.join(found, FLOW, "left").select(
        *flows.columns,
        F.coalesce("_ok", F.lit(0)).alias("_done"),
        F.coalesce("_fail", F.lit(0)).alias("_bad"),
        F.struct("_seq", "_chunk").alias("_last"),
    )
    done = done.withColumn(
        "_closed", F.when(pending(c("task_total"), c("_done"), c("_bad")) == 0, c("_last._seq"))
    ).withColumn(
        "history",
        F.when(
            open_row,
            F.concat(
                "history",
                F.array(
                    F.struct(
                        F.lit(index).alias("batch_index"),
                        "dag_key",
                        "task_total",
                        "opened_seq",
                        c("_done").alias("task_completed"),
                        c("_bad").alias("task_failed"),
                        c("_closed").alias("closed_seq"),
                    )
                ),
            ),
        ).otherwise(c("history")),
    )
    following = catalogue.batches.filter(c("batch_index") == index + 1).select(
        "dag_key", c("task_total").alias("_next_total")
    )
    opens = c("_closed").isNotNull() & c("_next_total").isNotNull()
    return done.join(following, "dag_key", "left").select(
        FLOW,
        "dag_key",
        "history",
        F.when(opens, c("_next_total")).alias("task_total"),
        F.when(opens, c("_closed")).alias("opened_seq"),
        F.when(opens, c("_last._chunk")).alias("opened_chunk"),
    )


def closing_positions(ledger: DataFrame, catalogue: Catalogue) -> DataFrame:
    """One row per seeded flow; ``history`` lists its batches in order as if every drained batch were clean."""
    events = routing.countable(ledger).select(FLOW, CHUNK, "arrival_seq", "batch_index", "failed")
    flows = seeds(ledger, catalogue).withColumn("history", F.array().cast(f"array<{_BARRIER}>"))
    for index in range(catalogue.depth):
        flows = count_step(flows, events, catalogue, index)
        if index < catalogue.depth - 1:
            flows = cut(flows)  # each step reads the flows more than once
    return cut(flows.select(FLOW, "history"))


def barrier_rows(flows: DataFrame) -> DataFrame:
    rows = flows.select(FLOW, F.explode("history").alias("_b")).select(FLOW, "_b.*")
    return rows.withColumn("pending", pending(c("task_total"), c("task_completed"), c("task_failed")))


def positions(flows: DataFrame, depth: int) -> DataFrame:
    """Per flow: ``p0`` = opening of batch 0, ``p1`` = closing of batch 0, and so on; ``p_last`` = the last one."""
    out = flows.select(
        FLOW,
        F.get("history", 0)["opened_seq"].alias("p0"),
        *[F.get("history", i)["closed_seq"].alias(f"p{i + 1}") for i in range(depth)],
    )
    return out.withColumn("p_last", F.greatest(*[c(f"p{i}") for i in range(depth + 1)]))


def states_at(ledger: DataFrame, at: DataFrame, payload: list[Column | str], moments: range) -> DataFrame:
    """Task state as of each flow position in ``moments``: (flow, task, moment, first_seq, payload…).

    One shuffle of narrow rows on (flow, task), with the latest row per position pre-aggregated before it.
    """
    audit = ledger.filter(routing.is_auditable()).select(
        FLOW, CHUNK, "task_flow_id", "arrival_seq", F.struct(*payload).alias("_p")
    )
    tagged = spread_join(audit, at, FLOW).filter(c("arrival_seq") <= c("p_last"))
    last = [
        F.max_by("_p", F.when(c("arrival_seq") <= c(f"p{i}"), c("arrival_seq"))).alias(f"_s{i}") for i in moments
    ]
    per_task = tagged.groupBy(FLOW, "task_flow_id").agg(F.min("arrival_seq").alias("first_seq"), *last)
    moment = F.explode(F.array(*[F.struct(F.lit(i).alias("moment"), c(f"_s{i}").alias("s")) for i in moments]))
    return (
        per_task.select(FLOW, "task_flow_id", "first_seq", moment.alias("_m"))
        .filter(c("_m.s").isNotNull())
        .select(FLOW, "task_flow_id", c("_m.moment").alias("moment"), "first_seq", "_m.s.*")
    )


def row_reason() -> Column:
    """Why one task row fails its batch, or null: its own status first, then the body's."""
    name = F.coalesce("action_name", F.lit("null"))
    body = c("verdict.body_status")
    return F.when(
        c("status").isNotNull() & (c("status") != "COMPLETED"),
        F.concat(F.lit("action="), name, F.lit(" row.status="), c("status")),
    ).when(
        body.isNotNull() & ~same_text(body, "Passed"),
        F.concat(F.lit("action="), name, F.lit(" actionResponse.taskFlowResponse.taskStatus="), body),
    )


def decide(snapshot: DataFrame, keys: tuple[str, ...] = (FLOW, "batch_index")) -> DataFrame:
    """Kickout reason and final status values per batch out of its task rows (status, action_name, verdict, first_seq)."""
    code = c("verdict.status_code")
    parsed = c("verdict.parsed")
    reason, change = row_reason(), c("verdict.change_reason")

    def first(value: Column, when: Column) -> Column:
        return F.min(F.when(when, F.struct(c("first_seq").alias("at"), value.alias("text"))))["text"]

    def any_row(test: Column) -> Column:
        return F.coalesce(F.bool_or(test), F.lit(False))

    found = snapshot.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("task_rows"),
        first(reason, reason.isNotNull()).alias("kickout"),
        first(change, parsed & ~is_blank(change)).alias("_change"),
        any_row(parsed & code.isNull()).alias("_null"),
        any_row(same_text(code, ERROR)).alias("_error"),
        any_row(same_text(code, FAILED)).alias("_failed"),
        any_row(same_text(code, ERROR_701)).alias("_error_701"),
    )
    return found.select(
        *keys,
        "task_rows",
        "kickout",
        F.when(c("_null") | c("_error"), ERROR)
        .when(c("_failed"), FAILED)
        .when(c("_error_701"), ERROR_701)
        .otherwise(PASSED)
        .alias("process_status"),
        "_change",
    )


def with_times(barriers: DataFrame, log: DataFrame) -> DataFrame:
    """Adds opened_at and closed_at, the event times at the barrier's positions; sequence numbers are unique, so no key is hot."""
    times = log.select(c("arrival_seq").alias("_seq"), "event_time")
    out = barriers
    for name in ("opened", "closed"):
        at = times.withColumnsRenamed({"_seq": f"_{name}", "event_time": f"{name}_at"})
        out = out.join(at, c(f"{name}_seq") == c(f"_{name}"), "left").drop(f"_{name}")
    return out


def final_values(decided: DataFrame) -> DataFrame:
    """Fill in the values of batches without any task row and the default reasons."""
    empty = F.coalesce("task_rows", F.lit(0)) == 0
    status = F.when(empty, FAILED).otherwise(c("process_status"))
    return decided.withColumn("process_status", status).withColumn(
        "status_change_reason",
        F.when(empty, REASON_NO_TASK)
        .when(c("_change").isNotNull(), c("_change"))
        .when(c("process_status") == PASSED, REASON_SUCCESS)
        .otherwise(REASON_FAILURE),
    ).drop("_change")


def lifecycle(ledger: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Barrier table out of any ledger; see ``lifecycle_of``."""
    return lifecycle_of(working_log(ledger), catalogue)


def lifecycle_of(ledger: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Barrier table: counts, positions, OPEN / CLOSED / FAILED, kickout reason and the values of a final patch.

    ``ledger`` is read several times, so it should be stored: a ``working_log``.
    """
    depth = catalogue.depth
    flows = closing_positions(ledger, catalogue)
    states = states_at(
        ledger,
        positions(flows, depth),
        ["status", "action_name", "batch_index", "verdict"],
        range(1, depth + 1),
    )
    snapshot = states.filter(c("batch_index") == c("moment") - 1)
    joined = final_values(barrier_rows(flows).join(decide(snapshot), [FLOW, "batch_index"], "left"))
    failed = c("closed_seq").isNotNull() & c("kickout").isNotNull()
    earlier = W.partitionBy(FLOW).orderBy("batch_index").rowsBetween(W.unboundedPreceding, -1)
    return (
        joined.withColumn("_cut", F.coalesce(F.max(failed).over(earlier), F.lit(False)))
        .filter(~c("_cut"))
        .drop("_cut")
        .withColumn("status", F.when(c("closed_seq").isNull(), "OPEN").when(failed, "FAILED").otherwise("CLOSED"))
        .withColumn("kickout", F.when(failed, c("kickout")))
    )


def flow_ends(barriers: DataFrame, ledger: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Terminal rows: (flow, end_seq, state, message, process_status, status_change_reason).

    A kickout, a clean last batch, or a batch declared without actions. An initiation of a DAG whose batch 0 is
    empty ends at once, and again on every such initiation until the flow is seeded.
    """
    closed = next_batches(barriers.filter(c("status") != "OPEN"), catalogue)
    kicked = c("status") == "FAILED"
    no_actions = c("has_next") & c("next_total").isNull()
    ends = closed.filter(kicked | ~c("has_next") | no_actions).select(
        FLOW,
        c("closed_seq").alias("end_seq"),
        "batch_index",
        F.when(kicked | no_actions, "failed").otherwise("completed").alias("state"),
        F.when(
            kicked, F.concat(F.lit("batch "), c("batch_index").cast("string"), F.lit(" kickout: "), c("kickout"))
        )
        .when(no_actions, empty_batch_message(c("dag_key"), c("batch_index") + 1))
        .alias("message"),
        F.when(~kicked & no_actions, FAILED).otherwise(c("process_status")).alias("process_status"),
        F.when(~kicked & no_actions, REASON_NO_TASK)
        .otherwise(c("status_change_reason"))
        .alias("status_change_reason"),
    )
    return ends.unionByName(empty_starts(barriers, ledger, catalogue).drop("dag_key"))


def empty_batch_message(dag: Column, index: Column) -> Column:
    return F.concat(F.lit("DAG "), dag, F.lit(" batch "), index.cast("string"), F.lit(" has no actions"))


def empty_starts(barriers: DataFrame, ledger: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Initiations that hit an empty batch 0 before their flow was seeded."""
    empty = catalogue.batches.filter((c("batch_index") == 0) & c("task_total").isNull()).select("dag_key")
    seeded = barriers.filter(c("batch_index") == 0).select(FLOW, c("opened_seq").alias("_seeded"))
    return (
        initiations(ledger)
        .join(empty, "dag_key")
        .transform(lambda rows: spread_join(rows, seeded, FLOW, "left"))
        .filter(c("_seeded").isNull() | (c("arrival_seq") < c("_seeded")))
        .select(
            FLOW,
            c("arrival_seq").alias("end_seq"),
            F.lit(0).alias("batch_index"),
            F.lit("failed").alias("state"),
            empty_batch_message(c("dag_key"), F.lit(0)).alias("message"),
            F.lit(FAILED).alias("process_status"),
            F.lit(REASON_NO_TASK).alias("status_change_reason"),
            "dag_key",
        )
    )
