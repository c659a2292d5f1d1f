"""Row filters and classifications of the envelope log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens import schemas as S
from flowlens.functions.text import is_blank, same_text

c = F.col


def routed(envelopes: DataFrame, engine: str = S.SOURCE_ENGINE) -> DataFrame:
    """Known messages with a ``route``; unnamed and unknown ones and the commands of ``engine`` are dropped."""
    own = (c("message_name") == S.EXECUTE) & F.coalesce(c("source") == engine, F.lit(False))
    return envelopes.filter(c("message_name").isin(*S.MESSAGE_NAMES) & ~own).withColumn(
        "route",
        F.when(c("message_name") == S.INITIATED, "start_flow")
        .when(c("message_name") == S.TASK_EVENT, "apply_event")
        .when(c("message_name") == S.SIGNAL, "log_signal")
        .when(c("message_name") == S.EXECUTE, "log_command")
        .otherwise("log_lifecycle"),
    )


def is_initiation() -> Column:
    return (
        (c("message_name") == S.INITIATED) & c("dag_key").isNotNull() & c("has_flow") & c("flow_id").isNotNull()
    )


def is_countable_candidate() -> Column:
    return (c("message_name") == S.TASK_EVENT) & c("status").isNotNull() & c("batch_index").isNotNull()


def is_auditable() -> Column:
    """Events that become task rows: the coordinates and the table's mandatory columns are present."""
    return (
        (c("message_name") == S.TASK_EVENT)
        & c("correlation_id").isNotNull()
        & c("task_flow_id").isNotNull()
        & c("has_action")
        & c("batch_index").isNotNull()
        & c("status").isNotNull()
        & c("action_name").isNotNull()
        & c("action_code").isNotNull()
    )


def event_class(status: Column) -> Column:
    return (
        F.when(status.isin("INITIAL", "IN_PROGRESS"), "none")
        .when(status == "WAITING", "wait")
        .when(status == "COMPLETED", "done")
        .when(status.isin("FAILED", "CANCELLED"), "fail")
    )


def counts_as_done() -> Column:
    return c("status") == "COMPLETED"


def counts_as_failed() -> Column:
    return c("status").isin("FAILED", "CANCELLED") & ~c("retryable")


def countable(ledger: DataFrame) -> DataFrame:
    """Events able to move a barrier, with the flag ``failed``."""
    return ledger.filter(is_countable_candidate() & (counts_as_done() | counts_as_failed())).withColumn(
        "failed", ~counts_as_done()
    )


def waiting_tasks(task_rows: DataFrame) -> DataFrame:
    return task_rows.filter(c("status") == "WAITING")


# The documented field matrix. R required, O optional, X must be absent.
FIELD_MATRIX = {
    S.INITIATED: {
        "dag_key": "R", "intent": "X", "status": "X", "batch": "X", "action": "X", "task": "X", "execution": "X",
        "downstream": "X", "awaiting_signal": "X", "inputs.processFlow": "R", "inputs.downstream": "X",
        "result": "X", "error": "X",
    },
    S.EXECUTE: {
        "dag_key": "O", "intent": "R", "status": "X", "batch": "R", "action": "R", "task": "X", "execution": "R",
        "downstream": "X", "awaiting_signal": "X", "inputs.processFlow": "R", "inputs.downstream": "X",
        "result": "X", "error": "X",
    },
    S.TASK_EVENT: {
        "dag_key": "X", "intent": "X", "status": "R", "batch": "R", "action": "R", "task": "R", "execution": "R",
        "downstream": "O", "awaiting_signal": "O", "inputs.processFlow": "X", "inputs.downstream": "X",
        "result": "O", "error": "O",
    },
    S.SIGNAL: {
        "dag_key": "X", "intent": "X", "status": "X", "batch": "R", "action": "R", "task": "R", "execution": "X",
        "downstream": "X", "awaiting_signal": "X", "inputs.processFlow": "X", "inputs.downstream": "R",
        "result": "X", "error": "X",
    },
}
EXPECTED_TYPE = {S.INITIATED: "EVENT", S.EXECUTE: "COMMAND", S.TASK_EVENT: "EVENT", S.SIGNAL: "SIGNAL"}
EXPECTED_SOURCE = {
    S.INITIATED: S.SOURCE_INTAKE, S.EXECUTE: S.SOURCE_ENGINE, S.TASK_EVENT: S.SOURCE_RUNNER, S.SIGNAL: S.SOURCE_INTAKE,
}


def _has(envelopes: DataFrame, path: str) -> Column:
    """Presence of a field; a field the frame does not carry at all is absent."""
    head, _, leaf = path.partition(".")
    if head not in envelopes.columns:
        return F.lit(False)
    if leaf and leaf not in envelopes.schema[head].dataType.fieldNames():
        return F.lit(False)
    return c(path).isNotNull()


def violations(envelopes: DataFrame, sources: dict[str, str] = EXPECTED_SOURCE) -> DataFrame:
    """Adds ``violations``: names of the documented field rules each envelope breaks. ``sources``: expected per message."""
    rules: list[Column] = []

    def rule(broken: Column, text: str) -> None:
        rules.append(F.when(F.coalesce(broken, F.lit(False)), F.lit(text)))

    for name in ("event_id", "correlation_id", "event_time", "source", "message_type"):
        rule(~_has(envelopes, name), f"missing {name}")
    for message, fields in FIELD_MATRIX.items():
        mine = c("message_name") == message
        rule(mine & (c("message_type") != EXPECTED_TYPE[message]), "wrong message_type")
        rule(mine & (c("source") != sources[message]), "wrong source")
    paths = list(FIELD_MATRIX[S.INITIATED])
    for path in paths:
        required = [m for m, f in FIELD_MATRIX.items() if f[path] == "R"]
        forbidden = [m for m, f in FIELD_MATRIX.items() if f[path] == "X"]
        if required:
            rule(c("message_name").isin(*required) & ~_has(envelopes, path), f"missing {path}")
        if forbidden:
            rule(c("message_name").isin(*forbidden) & _has(envelopes, path), f"forbidden {path}")
    return envelopes.withColumn("violations", F.filter(F.array(*rules), lambda r: r.isNotNull()))


def flow_state(state: Column) -> Column:
    """Canonical flow state text (any case accepted), null when unknown."""
    from flowlens.functions.text import canonical

    return canonical(state, S.FLOW_STATES)


def has_task_ref() -> Column:
    """Events whose task reference is added to the flow document."""
    return (
        (c("message_name") == S.TASK_EVENT)
        & c("batch_index").isNotNull()
        & c("status").isin("COMPLETED", "FAILED", "CANCELLED")
        & c("has_result")
        & c("has_action")
        & ~is_blank(c("task_flow_id"))
        & ~is_blank(c("href"))
    )


def notification_kind(type_name: Column) -> Column:
    return F.when(same_text(type_name, "processFlow"), "flow_created").when(
        same_text(type_name, S.ASYNC_REPLY), "async_reply"
    )
