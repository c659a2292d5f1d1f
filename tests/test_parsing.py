import json

from pyspark.sql import functions as F
from support import envelopes, event, ledger_of, log_frame, start

from flowlens.functions import body, text
from flowlens.operators import notifications as N
from flowlens.operators import routing
from flowlens.sources import envelopes as E


def one(spark, expr, **values):
    row = [tuple(values.values())] if values else [(1,)]
    names = list(values) or ["x"]
    schema = ", ".join(f"{n} string" for n in names) if values else "x int"
    return spark.createDataFrame(row, schema).select(expr.alias("v")).first().v


def test_bodies_tell_bad_text_from_an_empty_object(spark):
    texts = [None, "", "  ", "{bad", "null", "[]", '"x"', "{}", '{"taskStatusCode":"X"}', ' {"taskStatusCode":"Y","more":1}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, result_json string")
    got = E.with_json_verdict(rows).selectExpr("i", "verdict as v").orderBy("i").collect()
    assert [r.v.parsed for r in got] == [False] * 7 + [True] * 3
    assert [r.v.status_code for r in got][-3:] == [None, "X", "Y"]


def test_first_attribute_stops_at_the_first_match(spark):
    j = json.dumps({"taskFlowResponse": {"characteristic": [
        None, {"name": "other", "value": "1"}, {"name": "TASKSTATUS", "value": None}, {"name": "taskStatus", "value": "Failed"}]}})
    rows = spark.createDataFrame([(j,)], "result_json string")
    assert E.with_json_verdict(rows).first().verdict.body_status is None


def test_blank_keys_and_zero_codes(spark):
    c = F.col
    assert one(spark, text.is_blank(c("a")), a=" \t\n") and not one(spark, text.is_blank(c("a")), a=" x ")
    assert one(spark, text.dcx_key(c("a"), c("b"), F.lit(None).cast("string")), a="07", b=" ") == "07,DEFAULT,DEFAULT"
    assert one(spark, text.starts_with_zero(c("a")), a="07") and not one(spark, text.starts_with_zero(F.lit(None).cast("string")))
    assert one(spark, routing.flow_state(c("a")), a="INPROGRESS") == "inProgress"
    assert one(spark, routing.flow_state(c("a")), a="gone") is None


def test_quarantine_takes_each_bad_record_once(spark):
    good = json.dumps(start("f", "d"))
    log = log_frame(spark, [good, "{bad", "[]", None, json.dumps({"status": "DONE"}), json.dumps({"batch": {"index": "1"}}),
                            json.dumps({"messageType": "event"}), json.dumps({"execution": {"mode": "LATER"}}), "{}"])
    split = E.decode_envelopes(log)
    assert [r.arrival_seq for r in split.quarantine.orderBy("arrival_seq").collect()] == [1, 2, 4, 5, 6, 7]
    assert [r.arrival_seq for r in split.good.orderBy("arrival_seq").collect()] == [0, 8]


def test_envelopes_survive_a_round_trip(spark):
    env = envelopes(spark, [start("f", "d"), event("f", "FAILED", 1, "t", retryable=True, reason="why")])
    encoded = E.encode_envelopes(env)
    again = E.decode_envelopes(
        encoded.select(F.col("value"), F.get_json_object("value", "$.eventId").alias("arrival_seq"))
    ).good
    for name in ("correlation_id", "message_name", "status", "batch", "action", "result", "error", "inputs"):
        assert sorted(map(str, env.select(name).collect())) == sorted(map(str, again.select(name).collect()))
    row = encoded.filter(F.col("value").contains("e1")).first()
    assert row.key == "f" and "null" not in row.value
    assert {h.key: bytes(h.value) if h.value is not None else None for h in row.headers}["messageName"] == b"task.event"


def test_writing_envelopes_appends_records(spark, tmp_path):
    env = envelopes(spark, [start("f", "d"), start("g", "d")])
    E.write_envelopes(env, str(tmp_path / "out"))
    E.write_envelopes(env, str(tmp_path / "out"))
    assert spark.read.schema("key string, value string").json(str(tmp_path / "out")).count() == 4


def test_routes(spark):
    msgs = [{"messageName": n, "source": s} for n, s in [
        ("processFlow.initiated", "x"), ("task.event", "x"), ("task.signal", "x"), ("task.execute", "x"), ("flow.lifecycle", "x"),
        ("task.execute", "engine"), ("TASK.EVENT", "x"), (None, "x")]]
    rows = routing.routed(envelopes(spark, msgs)).orderBy("arrival_seq").collect()
    assert [r.route for r in rows] == ["start_flow", "apply_event", "log_signal", "log_command", "log_lifecycle"]


def test_initiations_need_key_flow_and_id(spark):
    full = start("f", "d")
    msgs = [full, {**full, "dagKey": None}, {**full, "inputs": None}, {**full, "inputs": {"processFlow": {}}}]
    assert ledger_of(spark, msgs).filter(routing.is_initiation()).count() == 1


def test_references_need_id_and_href(spark):
    ok = event("f", "COMPLETED", 0, "t")
    blank = event("f", "COMPLETED", 0, " ")
    nohref = event("f", "FAILED", 0, "t")
    nohref["result"]["taskFlowResponse"] = {"href": " "}
    msgs = [ok, blank, nohref, event("f", "WAITING", 0, "t"), event("f", "COMPLETED", 0, None), event("f", "COMPLETED", 0, "t", action=None)]
    assert [r.arrival_seq for r in ledger_of(spark, msgs).filter(routing.has_task_ref()).collect()] == [0]


def test_conformance_names_each_broken_rule(spark):
    m = {**event("f", "COMPLETED", 0, "t"), "dagKey": "d", "source": "intake", "eventTime": "2026-01-01T00:00:00Z"}
    row = routing.violations(envelopes(spark, [m])).first()
    assert set(row.violations) == {"wrong source", "forbidden dag_key", "missing task", "missing execution"}


def test_notifications_become_envelopes(spark):
    notes = [
        {"@type": "PROCESSFLOW", "id": "f", "processFlowSpecification": "d", "state": "active"},
        {"@type": "processFlow", "id": "f"},
        {"@type": "taskFinalAsyncResponseSend", "correlationId": "f", "event": {"id": "tx", "href": "/h"}, "eventId": "e"},
        {"@type": "TaskFinalAsyncResponseSend", "correlationId": "f", "event": {}},
        {"@type": "TaskFinalAsyncResponseSend", "event": {"id": "ty"}, "reportingSystem": {"id": "desk"}},
        {"@type": "else"},
    ]
    frame = E.decode_notifications(log_frame(spark, notes)).good
    first = N.initiated_from(frame).collect()
    assert [(r.correlation_id, r.dag_key, r.message_name, r.inputs.processFlow.state) for r in first] == [
        ("f", "d", "processFlow.initiated", "active")]
    signals = N.signals_from(frame).orderBy("arrival_seq").collect()
    assert [(r.inputs.downstream.id, r.inputs.reportingSystem) for r in signals] == [("tx", "UNKNOWN"), ("ty", "desk")]
    assert len({r.event_id for r in signals}) == 2


def test_maps_become_ordered_attributes(spark):
    m = F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit(None).cast("string"))
    got = one(spark, body.to_attributes(m))
    assert [(a.name, a.value, a.valueType) for a in got] == [("b", "1", "String"), ("a", None, None)]
