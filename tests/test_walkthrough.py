"""A two-batch flow from its creation to its end: every derived row."""

import json

from support import envelopes, event, ledger_of, log_frame, start

from flowlens.operators import barriers as B
from flowlens.operators import commands as C
from flowlens.operators import documents as D
from flowlens.operators import notifications as N
from flowlens.operators import reports, routing, tasks
from flowlens.operators.skew import measured
from flowlens.sources import catalogue as K
from flowlens.sources import envelopes as E

DAG = {"dagKey": "repair", "batches": [
    {"index": 0, "actions": [{"actionName": "voice", "executionMode": "ASYNC"}, {"actionName": "net", "executionMode": "SYNC"}]},
    {"index": 1, "actions": [{"actionName": "notify", "executionMode": "SYNC", "dependsOn": ["voice", "net", "ghost"]}]}]}


def test_walkthrough(spark):
    note = {"@type": "processFlow", "id": "F", "processFlowSpecification": "repair", "state": "active"}
    first = N.initiated_from(E.decode_notifications(log_frame(spark, [note])).good).first()
    log = [
        json.loads(json.dumps(start(first.correlation_id, first.dag_key))),
        event("F", "COMPLETED", 0, "t-net", action="net", body="Passed"),
        event("F", "WAITING", 0, "t-voice", action="voice", code=None),
        {"messageName": "task.signal", "messageType": "SIGNAL", "source": "intake", "correlationId": "F"},
        event("F", "COMPLETED", 0, "t-voice", action="voice"),
        event("F", "COMPLETED", 1, "t-note", action="notify"),
    ]
    cat = K.build_catalogue(K.dag_documents(spark, [DAG]))
    led = ledger_of(spark, log, chunk_rows=2)
    codes = measured(K.valid_action_codes(spark.createDataFrame(
        [("VOICE", "voice", "MS", True, 0), ("NET", "net", "MS", True, 1), ("NOTE", "notify", "MS", True, 2)],
        "action_code string, action_name string, action_type string, enabled boolean, load_pos long")))
    dcx = measured(K.valid_dcx_codes(spark.createDataFrame(
        [("VOICE", "D1", "DEFAULT", "DEFAULT", 0), ("NOTE", "D3", None, None, 1)],
        "parent string, dcx_action_code string, modem_type string, flow_type string, load_pos long")))
    barriers = B.lifecycle(led, cat)
    assert [(r.batch_index, r.task_total, r.task_completed, r.task_failed, r.status) for r in barriers.orderBy("batch_index").collect()] == [
        (0, 2, 2, 0, "CLOSED"), (1, 1, 1, 0, "CLOSED")]

    deps = C.dependency_rows(C.dependency_candidates(led, cat), barriers, cat)
    sent = C.batch_commands(barriers, cat, codes, dcx, deps).orderBy("command_seq", "emit_pos").collect()
    assert [(r.action_name, r.action_code, r.dcx_action_code, r.batch_index, r.batch_total, r.execution_mode, r.command_seq) for r in sent] == [
        ("voice", "VOICE", "D1", 0, 2, "ASYNC", 0), ("net", "NET", None, 0, 2, "SYNC", 0), ("notify", "NOTE", "D3", 1, 1, "SYNC", 4)]
    assert sent[0].dependency_results is None and set(sent[2].dependency_results) == {"voice", "net"}
    assert [r.dependency for r in C.missing_dependencies(deps).collect()] == ["ghost"]

    ends = B.flow_ends(barriers, led, cat)
    life = C.lifecycle_rows(barriers, ends, led, cat).orderBy("lifecycle_seq", "emit_pos").collect()
    assert [(r.status, r.dag_key, r.lifecycle_seq, r.emit_pos) for r in life] == [("INITIAL", "repair", 0, 0), ("COMPLETED", None, 5, 1)]
    again = C.lifecycle_rows(barriers, ends, led, cat).collect()
    assert {r.event_id for r in again} == {r.event_id for r in life} and len({r.event_id for r in life}) == 2
    assert len(log) + len(sent) + len(life) == 11

    rows = tasks.upsert_tasks(led.filter(routing.is_auditable()))
    outcome = reports.flow_outcome(barriers, rows).first()
    assert (outcome.all_closed, outcome.barriers, outcome.tasks) == (True, 2, 3)
    none = spark.createDataFrame([], "correlation_id string, pos long, id string, name string, role string")
    refs = D.merged_refs(none, D.task_refs(led), ["name", "role"]).orderBy("pos").collect()
    assert [(r.id, r.name, r.role) for r in refs] == [("t-net", "net", "TaskFlow"), ("t-voice", "voice", "TaskFlow"), ("t-note", "notify", "TaskFlow")]
    assert envelopes(spark, log).count() == 6


def test_empty_batches_end_flows(spark):
    cat = K.build_catalogue(K.dag_documents(spark, [
        {"dagKey": "none", "batches": [{"index": 0, "actions": []}]},
        {"dagKey": "half", "batches": [{"index": 0, "actions": [{"actionName": "a"}]}, {"index": 1}]}]))
    led = ledger_of(spark, [start("N", "none"), start("N", "none"), start("H", "half"), event("H", "COMPLETED", 0, "t", action="a")])
    barriers = B.lifecycle(led, cat)
    ends = B.flow_ends(barriers, led, cat)
    life = C.lifecycle_rows(barriers, ends, led, cat).orderBy("lifecycle_seq", "emit_pos").collect()
    assert [(r.correlation_id, r.status, r.dag_key, r.error_message) for r in life] == [
        ("N", "INITIAL", "none", None), ("N", "FAILED", None, "DAG none batch 0 has no actions"),
        ("N", "INITIAL", "none", None), ("N", "FAILED", None, "DAG none batch 0 has no actions"),
        ("H", "INITIAL", "half", None), ("H", "FAILED", None, "DAG half batch 1 has no actions")]
    assert len({r.event_id for r in life}) == 6
