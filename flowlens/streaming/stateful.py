"""Keyed stateful operators: barriers per flow, and replies joined with registrations.

State lives in the RocksDB state store, one flow (or id) at a time. A flow's rows within one micro-batch are put in
arrival order here; across micro-batches the source must keep each key's order, as a keyed topic does. What one call
sees of a key is bounded by the trigger's admission limit (``maxOffsetsPerTrigger`` / ``maxFilesPerTrigger``). Tasks are a list of
updates: a call appends the rows it changed, one per task, and reads none; the list is read only where a batch closes or opens, and folded
to one row per task once it has doubled. Every state access is a round trip out of Python, so a call makes one read and two writes for
most flows. One timer per flow, moved on by every call, lets the flow expire as a whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowlens.operators import barriers as B
from flowlens.operators import routing
from flowlens.operators.commands import dependency_candidates, patch_columns, with_document
from flowlens.sources.catalogue import Catalogue

c = F.col

# Terminal flows stay as tombstones, so that late duplicates are ignored, for as long as the tables keep rows.
# Expiry needs a running clock, and a stream with a clock never counts as drained: ``expire=False`` for replays.
STATE_DAYS = 60


CHANGES = (
    "correlation_id string, kind string, seq long, emit_pos int, batch_index int, dag_key string, task_total int,"
    "task_completed int, task_failed int, opened_seq long, closed_seq long, status string, kickout string,"
    "message string, process_status string, status_change_reason string, event_time timestamp, results string,"
    "doc_state string, doc_href string, doc_specification string"
)


def _names(schema: str) -> list[str]:
    return [f.strip().split(" ")[0] for f in schema.split(",")]


_COLUMNS = _names(CHANGES)
_FLOW_STATE = (
    "batch_index int, dag_key string, task_total int, task_completed int, task_failed int, opened_seq long, status string,"
    "plan string"
)
_DOCUMENT_STATE = "doc_state string, doc_href string, doc_specification string"
_LIST_STATE = "entries int, folded int"  # task updates in the list, and how many were left when it was last folded
_TASK_STATE = (
    "task_flow_id string, first_seq long, action_name string, status string, batch_index int, parsed boolean, body_status string,"
    "status_code string, change_reason string, result_json string"
)
_TASK_FIELDS, _FLOW_FIELDS, _DOCUMENT_FIELDS = _names(_TASK_STATE), _names(_FLOW_STATE), _names(_DOCUMENT_STATE)
_STORED_STATE = f"{_FLOW_STATE}, {_DOCUMENT_STATE}, {_LIST_STATE}"
_STORED_FIELDS = _names(_STORED_STATE)
_LEAST_FOLD = 64
# Rows go into and out of Python as one text each: the cost there is by cell, not by byte.
_PACKED = "correlation_id string, change string"
_CHANGE = Row("correlation_id", "change")


_NOTHING = dict.fromkeys((
    "is_start", "is_audit", "is_count", "dag_key", "plan", "status", "batch_index", "task_flow_id", "action_name", "parsed",
    "body_status", "status_code", "change_reason", "result_json", *_DOCUMENT_FIELDS, "event_us",
))  # nulls are left out of the text


def plans(catalogue: Catalogue) -> DataFrame:
    """(dag_key, plan): the declared batches of each DAG as ``index:size`` texts, no size where a batch has no actions."""
    entry = F.struct("batch_index", F.concat_ws(":", c("batch_index").cast("string"), F.coalesce(c("task_total").cast("string"), F.lit(""))).alias("t"))
    return catalogue.batches.groupBy("dag_key").agg(F.array_join(F.array_sort(F.collect_list(entry))["t"], ",").alias("plan"))


def flow_inputs(ledger: DataFrame, catalogue: Catalogue) -> DataFrame:
    """The narrow rows barriers need, keyed by flow: initiations, task events that change a row or a count, document patches.

    The catalogue is joined as a static table: an initiation brings the plan of its DAG along, and a completed task its result where
    some batch depends on its action.
    """
    start = routing.is_initiation()
    audit, count = routing.is_auditable(), routing.is_countable_candidate() & (
        routing.counts_as_done() | routing.counts_as_failed()
    )
    rows = dependency_candidates(ledger.filter(start | audit | routing.is_countable_candidate()), catalogue)
    return rows.join(plans(catalogue), "dag_key", "left").select(
        F.when(start, c("flow_id")).otherwise(c("correlation_id")).alias("correlation_id"),
        "arrival_seq",
        c("event_time").cast("timestamp").alias("event_time"),
        start.alias("is_start"),
        F.coalesce(audit, F.lit(False)).alias("is_audit"),
        F.coalesce(count, F.lit(False)).alias("is_count"),
        "dag_key",
        "plan",
        "status",
        "batch_index",
        "task_flow_id",
        "action_name",
        c("verdict.parsed").alias("parsed"),
        c("verdict.body_status").alias("body_status"),
        c("verdict.status_code").alias("status_code"),
        c("verdict.change_reason").alias("change_reason"),
        "result_json",
        *patch_columns(),
    )


def _fold(updates: Iterator[tuple]) -> dict[str, dict]:
    """The latest state per task out of its updates in order; the first of them tells when the task was first seen."""
    tasks: dict[str, dict] = {}
    for update in updates:
        t = dict(zip(_TASK_FIELDS, update, strict=True))
        _put(tasks, t)
    return tasks


def _put(tasks: dict[str, dict], t: dict) -> None:
    known = tasks.get(t["task_flow_id"])
    tasks[t["task_flow_id"]] = t if known is None else t | {"first_seq": known["first_seq"]}


def _judge(tasks: list[dict]) -> tuple[str | None, str, str]:
    """Kickout, status and reason of one batch's task rows in arrival order."""
    kickout = change = None
    codes: list[str | None] = []
    for t in tasks:
        body = t["body_status"]
        if kickout is None and t["status"] is not None and t["status"] != "COMPLETED":
            kickout = f"action={t['action_name']} row.status={t['status']}"
        elif kickout is None and body is not None and body.lower() != "passed":
            kickout = f"action={t['action_name']} actionResponse.taskFlowResponse.taskStatus={body}"
        if t["parsed"]:
            codes.append(t["status_code"])
            if change is None and t["change_reason"] and t["change_reason"].strip():
                change = t["change_reason"]
    if not tasks:
        return kickout, B.FAILED, B.REASON_NO_TASK
    texts = {None if code is None else code.upper() for code in codes}
    status = next((s for s in (B.ERROR, B.FAILED, B.ERROR_701) if s in texts), B.PASSED)
    status = B.ERROR if None in texts else status
    return kickout, status, change or (B.REASON_SUCCESS if status == B.PASSED else B.REASON_FAILURE)


@lru_cache(maxsize=1024)
def _batches(plan: str) -> dict[int, int | None]:
    return {int(i): int(n) if n else None for i, n in (e.split(":") for e in plan.split(","))}


class FlowBarriers(StatefulProcessor):
    """Emits ``barrier`` rows (current counts and status, the newest ``seq`` counts), ``lifecycle`` rows and ``opened`` rows."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flow = handle.getValueState("flow", _STORED_STATE)
        self.tasks = handle.getListState("tasks", _TASK_STATE)

    def _expire_later(self, timers) -> None:
        """The flow expires as a whole, this long after its last row."""
        if self.ttl_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.ttl_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.flow.clear()
        self.tasks.clear()
        return iter(())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        self._expire_later(timerValues)
        stored = dict(zip(_STORED_FIELDS, self.flow.get() or [None] * len(_STORED_FIELDS), strict=True))
        flow = None if stored["status"] is None else {f: stored[f] for f in _FLOW_FIELDS}
        if flow is not None and flow["status"] != "OPEN":
            return
        document = {f: stored[f] for f in _DOCUMENT_FIELDS}
        entries, folded = stored["entries"] or 0, stored["folded"] or 0
        earlier: dict[str, dict] | None = None if entries else {}
        touched: dict[str, dict] = {}
        barrier: dict[int, dict] = {}
        out: list[dict] = []

        def all_tasks() -> dict[str, dict]:
            """Latest state per task; the stored updates are read once, and only where a batch closes or opens."""
            nonlocal earlier
            if earlier is None:
                earlier = _fold(self.tasks.get())
            found = dict(earlier)
            for t in touched.values():
                _put(found, t)
            return found

        def lifecycle(seq: int, pos: int, status: str, dag=None, index=None, message=None, values=(None, None)) -> None:
            out.append({
                "kind": "lifecycle", "seq": seq, "emit_pos": pos, "dag_key": dag, "batch_index": index, "status": status,
                "message": message, "process_status": values[0], "status_change_reason": values[1],
            })

        def no_actions(dag: str, index: int, seq: int) -> None:
            text = f"DAG {dag} batch {index} has no actions"
            lifecycle(seq, 1, "FAILED", None, max(index - 1, 0), text, (B.FAILED, B.REASON_NO_TASK))

        def note(state: dict, seq: int, **more) -> None:
            barrier[state["batch_index"]] = {"kind": "barrier", "seq": seq, "emit_pos": 0, **state, **more}

        def opened(dag: str, index: int, plan: str, seq: int, r: dict) -> dict:
            state = {"batch_index": index, "dag_key": dag, "task_total": _batches(plan)[index], "task_completed": 0,
                     "task_failed": 0, "opened_seq": seq, "status": "OPEN", "plan": plan}
            note(state, seq)
            results = _results(all_tasks())
            out.append({"kind": "opened", "seq": seq, "emit_pos": 0, **state, **document, "event_time": r["event_us"],
                        "results": json.dumps(results)})
            return state

        for seq, text in sorted(((row["arrival_seq"], row["packed"]) for row in rows), key=lambda r: r[0]):
            r = _NOTHING | json.loads(text)
            document |= {f: r[f] for f in _DOCUMENT_FIELDS if r[f] is not None}
            if r["is_start"]:
                if flow is None and r["plan"] is not None and 0 in _batches(r["plan"]):
                    lifecycle(seq, 0, "INITIAL", r["dag_key"])
                    if _batches(r["plan"])[0] is None:
                        no_actions(r["dag_key"], 0, seq)
                    else:
                        flow = opened(r["dag_key"], 0, r["plan"], seq, r)
                continue
            if r["is_audit"]:
                _put(touched, {f: r.get(f) for f in _TASK_FIELDS} | {"first_seq": seq})
            if not r["is_count"] or flow is None or flow["status"] != "OPEN" or r["batch_index"] != flow["batch_index"]:
                continue
            flow["task_completed" if r["status"] == "COMPLETED" else "task_failed"] += 1
            if flow["task_completed"] + flow["task_failed"] < flow["task_total"]:
                note(flow, seq)
                continue
            index, dag, plan = flow["batch_index"], flow["dag_key"], flow["plan"]
            mine = (t for t in all_tasks().values() if t["batch_index"] == index)
            kickout, status, reason = _judge(sorted(mine, key=lambda t: t["first_seq"]))
            flow["status"] = "FAILED" if kickout else "CLOSED"
            note(flow, seq, closed_seq=seq, kickout=kickout, process_status=status, status_change_reason=reason)
            declared = _batches(plan)
            if kickout:
                lifecycle(seq, 1, "FAILED", None, index, f"batch {index} kickout: {kickout}", (status, reason))
            elif index + 1 not in declared:
                lifecycle(seq, 1, "COMPLETED", None, index, None, (status, reason))
            elif declared[index + 1] is None:
                no_actions(dag, index + 1, seq)
            else:
                flow = opened(dag, index + 1, plan, seq, r)

        if flow is not None and flow["status"] != "OPEN":
            if entries:
                self.tasks.clear()
            document, entries, folded = {}, 0, 0
        elif touched:
            entries += len(touched)
            if entries > 2 * max(folded, _LEAST_FOLD):
                kept = all_tasks()
                entries = folded = len(kept)
                self.tasks.put([tuple(t[f] for f in _TASK_FIELDS) for t in kept.values()])
            else:
                self.tasks.appendList([tuple(t[f] for f in _TASK_FIELDS) for t in touched.values()])
        if flow is not None or entries or any(v is not None for v in document.values()):
            state = {**(flow or {}), **document, "entries": entries, "folded": folded}
            self.flow.update(tuple(map(state.get, _STORED_FIELDS)))
        out += barrier.values()
        for o in out:
            yield _CHANGE(key[0], json.dumps(o))

    def close(self) -> None:
        pass


def _results(tasks: dict[str, dict]) -> dict[str, str]:
    """The result of the newest task per action among those completed."""
    usable = [t for t in tasks.values() if t["status"] == "COMPLETED" and t["result_json"] is not None and t["action_name"] is not None]
    return {t["action_name"]: t["result_json"] for t in sorted(usable, key=lambda t: t["first_seq"])}


def stream_flows(ledger: DataFrame, catalogue: Catalogue, expire: bool = True, state_ms: int = STATE_DAYS * 86_400_000) -> DataFrame:
    """Barrier, lifecycle and opening changes of a streaming ledger, joined with the catalogue as a static table."""
    inputs = flow_inputs(ledger, catalogue)
    fields = [n for n in inputs.columns if n not in ("correlation_id", "arrival_seq")]
    packed = inputs.withColumn("event_us", F.unix_micros("event_time")).select(
        "correlation_id", "arrival_seq", F.to_json(F.struct(*[n for n in fields if n != "event_time"], "event_us")).alias("packed")
    )
    changes = packed.groupBy("correlation_id").transformWithState(
        statefulProcessor=FlowBarriers(state_ms if expire else None),
        outputStructType=_PACKED,
        outputMode="Append",
        timeMode="ProcessingTime" if expire else "None",
    )
    schema = ", ".join(CHANGES.replace("event_time timestamp", "event_time long").split(",")[1:])
    # The generator keeps the optimizer from copying the parse into every column.
    each = changes.select("correlation_id", F.inline(F.array(F.from_json("change", schema))))
    return each.withColumn("event_time", F.timestamp_micros("event_time")).select(*_COLUMNS)


def opened_batches(changes: DataFrame) -> DataFrame:
    """Opened batches of the change rows in the shape ``batch_commands`` takes: with time, document and results by action."""
    rows = changes.filter(c("kind") == "opened")
    return with_document(rows).withColumn("results", F.from_json("results", "map<string,string>"))


def barrier_table(changes: DataFrame) -> DataFrame:
    """Newest barrier row per (flow, batch)."""
    fields = [
        "dag_key", "task_total", "task_completed", "task_failed", "status", "opened_seq", "closed_seq", "kickout",
        "process_status", "status_change_reason",
    ]
    return (
        changes.filter(c("kind") == "barrier")
        .groupBy("correlation_id", "batch_index")
        .agg(F.max_by(F.struct(*fields), "seq").alias("_r"))
        .select("correlation_id", "batch_index", "_r.*")
    )


def stream_replies(waiting: DataFrame, replies: DataFrame, horizon: str = "60 days", delay: str = "1 day") -> DataFrame:
    """Every reply with each registration of its transaction id up to ``horizon`` before it, over two streams of the same log.

    A left outer join of two streams with watermarks and a time range: a reply waits for its registration until the watermark of
    the registrations has passed it, and is then put out alone, with nulls. Registrations without an id are dropped before their watermark. So a reply may come before its registration is read, and none
    vanishes. State is bounded by the horizon on the side of registrations, and by the delay on that of replies.
    """
    left = replies.select(
        c("transaction_id"), c("arrival_seq").alias("reply_seq"), c("at").cast("timestamp").alias("reply_at")
    ).withWatermark("reply_at", delay)
    right = waiting.select(
        c("transaction_id").alias("_txn"), c("arrival_seq").alias("waiting_seq"), c("at").cast("timestamp").alias("waiting_at"),
        "correlation_id", "task_flow_id",
    ).withWatermark("waiting_at", delay)
    ranged = F.expr(f"waiting_at <= reply_at AND waiting_at >= reply_at - INTERVAL {horizon}")
    earlier = c("waiting_seq") <= c("reply_seq")
    return left.join(right, (c("transaction_id") == c("_txn")) & ranged & earlier, "left_outer").drop("_txn")


def newest_matches(pairs: DataFrame) -> DataFrame:
    """One row per reply: its newest registration, nulls where there was none."""
    found = F.struct("waiting_seq", "correlation_id", "task_flow_id")
    return pairs.groupBy("transaction_id", "reply_seq").agg(F.max_by(found, "waiting_seq").alias("_m")).select(
        "transaction_id", "reply_seq", "_m.*"
    )
