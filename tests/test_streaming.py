"""Streams over several micro-batches give what the batch operators give on the whole log."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F
from support import RANDOM_DAGS, Replay, catalogue_of, envelopes, event, random_log, start
from test_signals import T0, brute, make

from flowlens.operators import barriers as B
from flowlens.operators import commands as C
from flowlens.operators import tasks
from flowlens.operators.routing import is_auditable
from flowlens.sources.envelopes import decode_envelopes, ledger
from flowlens.sources.tables import DayTable, FirstDeliveries
from flowlens.streaming import runs, stateful


def spread(spark, tmp_path, messages, files):
    """The log as JSON files in arrival order, one per micro-batch."""
    folder = tmp_path / "log"
    folder.mkdir()
    size = -(-len(messages) // files)
    for n in range(files):
        lines = [
            json.dumps({"arrival_seq": i, "value": json.dumps({"eventId": f"e{i}"} | messages[i])})
            for i in range(n * size, min((n + 1) * size, len(messages)))
        ]
        path = folder / f"{n:03d}.json"
        path.write_text("\n".join(lines))
        import os
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    raw = spark.readStream.schema("arrival_seq long, value string").option("maxFilesPerTrigger", 1).json(str(folder))
    return ledger(decode_envelopes(raw).good, 50)


@pytest.fixture(scope="module")
def log():
    return random_log(11, flows=40, rows=900)


def test_barriers_and_ends(spark, tmp_path, log):
    cat = catalogue_of(spark, RANDOM_DAGS)
    changes = runs.drain_to_table(stateful.stream_flows(spread(spark, tmp_path, log, 3), cat, expire=False))
    want = Replay(RANDOM_DAGS).run(log)
    got = {
        (r.correlation_id, r.batch_index, r.dag_key, r.task_total, r.task_completed, r.task_failed, r.status, r.opened_seq, r.closed_seq)
        for r in stateful.barrier_table(changes).collect()
    }
    assert got == want.barrier_rows()
    life = [r for r in changes.filter("kind = 'lifecycle'").collect()]
    ends = sorted((r.correlation_id, r.seq, r.status.lower(), r.message, r.process_status, r.status_change_reason)
                  for r in life if r.status != "INITIAL")
    assert ends == sorted(want.ends)
    assert sorted((r.correlation_id, r.seq, r.dag_key) for r in life if r.status == "INITIAL") == sorted(want.initials)


def test_task_table(spark, tmp_path, log):
    table = runs.drain_task_table(spark, spread(spark, tmp_path, log, 3))
    want = tasks.upsert_tasks(ledger(envelopes(spark, log)).filter(is_auditable()))
    cols = ["correlation_id", "task_flow_id", "status", "batch_index", "first_seq", "last_seq"]
    assert sorted(table.rows().select(*cols).collect()) == sorted(want.select(*cols).collect())


def test_day_table_merges_touched_days_only(spark, tmp_path):
    """Days that a merge does not touch keep their files, a batch that runs again changes nothing, and a second merge folds."""
    def rows(items):
        msgs = [event("f", status, 0, task, eventTime=f"2026-01-0{day}T00:00:00Z") for task, status, day in items]
        return ledger(envelopes(spark, msgs)).filter(is_auditable())

    def files(day):
        return {f.name for f in (tmp_path / "t" / "days" / f"created_date=2026-01-0{day}").glob("*.parquet")}

    def seen(table):
        return {r.task_flow_id: (r.status, r.created_date.day) for r in table.rows().collect()}

    table = DayTable(spark, str(tmp_path / "t"), every=2)
    table.apply(rows([("a", "WAITING", 1), ("b", "COMPLETED", 2)]), 0)
    assert not (tmp_path / "t" / "days").exists() and seen(table) == {"a": ("WAITING", 1), "b": ("COMPLETED", 2)}
    table.apply(rows([("c", "COMPLETED", 3)]).withColumn("arrival_seq", F.col("arrival_seq") + 10), 1)
    before = {d: files(d) for d in (1, 2, 3)}
    assert all(before.values())
    later = rows([("a", "COMPLETED", 5), ("d", "FAILED", 3)]).withColumn("arrival_seq", F.col("arrival_seq") + 20)
    want = {"a": ("COMPLETED", 1), "b": ("COMPLETED", 2), "c": ("COMPLETED", 3), "d": ("FAILED", 3)}
    for _ in range(2):
        table.apply(later, 2)
        assert seen(table) == want
    table.apply(rows([("e", "COMPLETED", 3)]).withColumn("arrival_seq", F.col("arrival_seq") + 30), 3)
    want["e"] = ("COMPLETED", 3)
    assert seen(table) == want and table.waiting().count() == 0
    assert files(2) == before[2] and files(1) != before[1] and files(3) != before[3]
    table.apply(later, 2)
    assert seen(table) == want


def test_commands_over_several_batches(spark, tmp_path):
    """A flow with a third of the log, over four micro-batches, against the batch commands with time and document."""
    log = [m | {"eventTime": f"2026-01-01T00:{i // 60 % 60:02d}:{i % 60:02d}Z"} for i, m in enumerate(
        random_log(21, flows=30, rows=700, hot_share=0.34))]
    dags = {k: [(i, a and [{"actionName": x, "dependsOn": ["a", "b"]} for x in a]) for i, a in b] for k, b in RANDOM_DAGS.items()}
    cat = catalogue_of(spark, dags)
    codes = spark.createDataFrame([(x, x.upper(), "t") for x in "abcdef"], "action_name string, action_code string, action_type string")
    dcx = spark.createDataFrame([("A,DEFAULT,DEFAULT", "X")], "dcx_key string, dcx_action_code string")
    opened = stateful.opened_batches(stateful.stream_flows(spread(spark, tmp_path, log, 4), cat, expire=False))
    got = runs.drain_to_table(C.batch_commands(opened, cat, codes, dcx))
    led = ledger(envelopes(spark, log), 50)
    work = B.working_log(C.dependency_candidates(led, cat), "result_json")
    barriers = B.lifecycle_of(work, cat)
    want = C.batch_commands(C.with_context(barriers, work, 50), cat, codes, dcx, C.dependency_rows(work, barriers, cat))
    assert want.count() > 20 and {str(r) for r in got.select(*want.columns).collect()} == {str(r) for r in want.collect()}
    assert want.filter("dependency_results IS NOT NULL").count() > 0 and want.filter("process_flow LIKE '%href%'").count() > 0


def test_a_flow_expires_as_a_whole(spark, tmp_path):
    """After the flow's timer nothing of it is left: its tasks are forgotten and the next initiation opens it anew."""
    folder = tmp_path / "log"
    folder.mkdir()

    def put(n, messages):
        lines = [json.dumps({"arrival_seq": n * 100 + i, "value": json.dumps({"eventId": f"e{n}-{i}"} | m)}) for i, m in enumerate(messages)]
        (folder / f"{n}.json").write_text("\n".join(lines))

    put(0, [start("f", "wide"), event("f", "FAILED", 0, "t1", action="a")])
    raw = spark.readStream.schema("arrival_seq long, value string").json(str(folder))
    changes = stateful.stream_flows(ledger(decode_envelopes(raw).good, 50), catalogue_of(spark, RANDOM_DAGS), state_ms=1500)
    query = runs.start_to_files(changes, str(tmp_path / "out"), str(tmp_path / "cp"), once=False)

    def barriers():
        try:
            rows = spark.read.schema(changes.schema).parquet(str(tmp_path / "out")).filter("kind = 'barrier'").collect()
        except Exception:  # noqa: BLE001  nothing is written yet
            return []
        return sorted((r.seq, r.batch_index, r.task_completed, r.task_failed, r.opened_seq) for r in rows)

    def wait_for(done):
        end = time.time() + 60
        while not done() and time.time() < end:
            time.sleep(0.5)
        assert done()

    try:
        wait_for(lambda: len(barriers()) == 1)
        time.sleep(8)
        put(1, [event("f", "COMPLETED", 0, "t2"), start("f", "one"), event("f", "COMPLETED", 0, "t3")])
        wait_for(lambda: len(barriers()) == 2)
    finally:
        query.stop()
    assert barriers() == [(1, 0, 0, 1, 0), (102, 0, 1, 0, 101)]


def test_late_records_are_kept_aside(spark, tmp_path):
    schema = "event_id string, event_time timestamp_ntz, n int"
    table = FirstDeliveries(spark, str(tmp_path / "t"), schema, dt.timedelta(days=7))

    def put(batch_id, *rows):
        table.apply(spark.createDataFrame([(i, None if d is None else T0 + dt.timedelta(days=d), n) for i, d, n in rows], schema), batch_id)

    put(0, ("a", 0, 1), ("a", 1, 2), ("b", 20, 3))
    for _ in range(2):
        put(1, ("a", 12, 4), ("c", 12, 5), ("d", 14, 6), ("b", 20, 7), ("c", 12, 8))
    put(2, ("d", 14, 9), ("e", 30, 10), (None, 25, 11))
    put(3, ("e", 30, 12), ("f", 22, 13), ("g", None, 14))
    assert sorted((r.event_id or "", r.n) for r in table.rows().collect()) == [("", 11), ("a", 1), ("b", 3), ("d", 6), ("e", 10), ("g", 14)]
    assert sorted((r.event_id, r.n) for r in table.late().collect()) == [("a", 4), ("c", 5), ("c", 8), ("f", 13)]


def test_dedup_across_batches(spark, tmp_path):
    one = [event("f", "COMPLETED", 0, f"t{i}", eventId=f"x{i}", eventTime="2026-01-01T00:00:00Z") for i in range(6)]
    led = spread(spark, tmp_path, one + one[:4] + [start("g", "d", eventId="y", eventTime="2026-01-02T00:00:00Z")], 4)
    got = runs.drain_to_table(runs.first_in_watermark(led.select("event_id", "event_time", "correlation_id")))
    assert sorted(r.event_id for r in got.collect()) == ["x0", "x1", "x2", "x3", "x4", "x5", "y"]


def test_replies(spark, tmp_path):
    """Two streams: matched replies as in the batch version, one whose registration is read later, and lonely ones with nulls."""
    waiting, replies = make(4, 200)
    days = lambda n: T0 + dt.timedelta(days=n)
    waiting += [("early", 5000, days(10), "fe", "te"), ("closing", 9000, days(900), "", "")]
    replies += [("early", 5001, days(10)), ("lonely", 5002, days(10)), (None, 9001, days(900))]
    w, r = str(tmp_path / "w"), str(tmp_path / "r")
    left = "transaction_id string, arrival_seq long, at timestamp"
    full = f"{left}, correlation_id string, task_flow_id string"
    for low, high in ((0, 100), (100, 6000), (6000, 10_000)):
        for path, rows, schema in ((r, replies, left), (w, waiting, full)):  # the early one's registration comes a file later
            part = [x for x in rows if low <= (x[1] + (1500 if path == w and x[0] == "early" else 0)) < high]
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    read = lambda path, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    pairs = runs.drain_to_table(stateful.stream_replies(read(w, full), read(r, left), delay="30 days"))
    got = {tuple(x) for x in stateful.newest_matches(pairs.filter("transaction_id IS NOT NULL")).collect()}
    matched = brute([x for x in waiting if x[0]], [x for x in replies if x[0]])
    assert {x for x in got if x[2] is not None} == matched and ("early", 5001, 5000, "fe", "te") in got
    assert {x[:2] for x in got} == {x[:2] for x in replies if x[0]} and ("lonely", 5002, None, None, None) in got


class Counted:
    """A state variable in memory that counts how often it is asked."""

    def __init__(self, calls):
        self.calls, self.value = calls, None

    def get(self):
        self.calls.append("get")
        return self.value if self.value is None or isinstance(self.value, tuple) else iter(self.value)

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def put(self, values):
        self.calls.append("put")
        self.value = list(values)

    def appendList(self, values):  # noqa: N802
        self.calls.append("append")
        self.value = (self.value or []) + values

    def clear(self):
        self.calls.append("clear")
        self.value = None


def test_state_accesses_do_not_grow_with_the_tasks():
    """A call that opens or closes no batch reads one value and writes two, however many tasks its rows touch; re-deliveries fold."""
    calls = []
    state = {"flow": Counted(calls), "tasks": Counted(calls)}

    class Handle:
        getValueState = getListState = lambda self, name, schema: state[name]

    flows = stateful.FlowBarriers(None)
    flows.init(Handle())

    def call(first, tasks, **more):
        rows = [{"is_audit": True, "is_count": False, "status": "WAITING", "batch_index": 0, "task_flow_id": t, "action_name": "a"} | more
                for t in tasks]
        calls.clear()
        return list(flows.handleInputRows(("f",), iter([{"arrival_seq": first + i, "packed": json.dumps(r)} for i, r in enumerate(rows)]), None))

    for n in (1, 30):
        call(n * 100, [f"t{i}" for i in range(n)])
        assert calls == ["get", "append", "update"]
    out = call(5000, ["x"], is_audit=False, is_start=True, dag_key="d", plan="0:2")
    assert calls == ["get", "get", "update"] and [json.loads(o.change)["kind"] for o in out] == ["lifecycle", "opened", "barrier"]
    for n in range(60, 70):
        call(n * 100, [f"t{i}" for i in range(30)], status="COMPLETED")
    assert len(state["tasks"].value) <= 2 * 64
    tasks = stateful._fold(iter(state["tasks"].value))
    assert {t["first_seq"] for t in tasks.values()} == {100, *range(3001, 3030)} and {t["status"] for t in tasks.values()} == {"COMPLETED"}


def test_parts_are_many_files_and_one_batch_each(spark, tmp_path):
    """No task writes or reads a part of the streamed event table whole, yet each part is one micro-batch."""
    from flowlens.plans import stream_queries as SQ

    spark.range(400).selectExpr("id AS event_id", "id % 5 AS user_id").write.parquet(str(tmp_path / "events.parquet"))
    events, feed = SQ.event_parts(spark, str(tmp_path), F.expr("CASE WHEN event_id < 300 THEN 1 WHEN event_id < 390 THEN 0 END"), 2, 50)
    seen = []

    def store(batch, batch_id):
        ids = [r.event_id for r in batch.collect()]
        seen.append((len(ids), min(ids), batch.select(F.input_file_name()).distinct().count()))

    for _ in feed:
        writer = events.writeStream.foreachBatch(store).option("checkpointLocation", str(tmp_path / "cp"))
        writer.trigger(availableNow=True).start().awaitTermination()
    assert [s[:2] for s in seen if s[0]] == [(90, 300), (300, 0)]
    assert [s[2] for s in seen if s[0]] == [2, 6]
