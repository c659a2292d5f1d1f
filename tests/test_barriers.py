import pytest
from support import RANDOM_DAGS, Replay, catalogue_of, event, ledger_of, random_log, start

from flowlens.operators import barriers as B

DAGS = {"d": [(0, ["a", "b"]), (1, ["c"])], "s": [(0, ["a"])]}


def run(spark, messages, dags=DAGS, chunk_rows=4):
    cat = catalogue_of(spark, dags)
    led = ledger_of(spark, messages, chunk_rows)
    rows = B.lifecycle(led, cat)
    ends = B.flow_ends(rows, led, cat)
    table = {
        (r.correlation_id, r.batch_index, r.dag_key, r.task_total, r.task_completed, r.task_failed, r.status, r.opened_seq,
         r.closed_seq)
        for r in rows.collect()
    }
    found = sorted(
        (r.correlation_id, r.end_seq, r.state, r.message, r.process_status, r.status_change_reason) for r in ends.collect()
    )
    return table, found


def same_as_replay(spark, messages, dags=DAGS, chunk_rows=4):
    table, ends = run(spark, messages, dags, chunk_rows)
    want = Replay(dags).run(messages)
    assert table == want.barrier_rows()
    assert ends == sorted(want.ends)
    return table, ends


def test_named_cases_in_one_log(spark):
    """Each flow is one case; the expected end of each is written out and the replay must agree on everything."""
    m = []
    m += [start("partial", "d"), event("partial", "COMPLETED", 0, "t1")]
    m += [start("clean", "s"), event("clean", "COMPLETED", 0, "t1", body="Passed")]
    m += [start("twice", "s"), start("twice", "d"), event("twice", "COMPLETED", 0, "t1")]
    m += [start("unknown", "nope"), event("unknown", "COMPLETED", 0, "t1")]
    m += [event("absent", "COMPLETED", 0, "t1")]
    m += [start("deferred", "d"), event("deferred", "FAILED", 0, "t1"), event("deferred", "COMPLETED", 0, "t2")]
    m += [start("retry", "s"), event("retry", "FAILED", 0, "t1", retryable=True), event("retry", "COMPLETED", 0, "t1")]
    m += [start("cancel", "s"), event("cancel", "CANCELLED", 0, "t1", retryable=False)]
    m += [start("waiting", "d"), event("waiting", "WAITING", 0, "t9"), event("waiting", "COMPLETED", 0, "t1"),
          event("waiting", "COMPLETED", 0, "t2")]
    m += [start("nostatus", "s"), event("nostatus", None, 0, "t1"), event("nostatus", "COMPLETED", None, "t1")]
    m += [start("body", "s"), event("body", "COMPLETED", 0, "t1", body="Failed", code="COMPLETED")]
    m += [start("closed", "s"), event("closed", "COMPLETED", 0, "t1"), event("closed", "COMPLETED", 0, "t1")]
    m += [start("dup", "d"), event("dup", "COMPLETED", 0, "t1"), event("dup", "COMPLETED", 0, "t1")]
    m += [start("norow", "s"), event("norow", "COMPLETED", 0, None)]
    m += [start("early", "d"), event("early", "COMPLETED", 1, "x"), event("early", "COMPLETED", 0, "t1"),
          event("early", "COMPLETED", 0, "t2")]
    m += [start("full", "d"), event("full", "COMPLETED", 0, "t1"), event("full", "COMPLETED", 0, "t2"),
          event("full", "COMPLETED", 1, "t3", reason="done by hand")]
    table, ends = same_as_replay(spark, m)
    status = {(r[0], r[1]): r[6] for r in table}
    assert status["partial", 0] == "OPEN" and ("unknown", 0) not in status and ("absent", 0) not in status
    assert status["deferred", 0] == "FAILED" and status["retry", 0] == "CLOSED" and status["waiting", 0] == "FAILED"
    assert status["dup", 0] == "CLOSED" and status["dup", 1] == "OPEN" and status["early", 1] == "OPEN"
    by_flow = {e[0]: e for e in ends}
    assert by_flow["body"][3] == "batch 0 kickout: action=a actionResponse.taskFlowResponse.taskStatus=Failed"
    assert by_flow["body"][4] == "Passed" and by_flow["cancel"][2] == "failed"
    assert by_flow["norow"][4:] == ("FAILED", "No Task/Action Performed")
    assert by_flow["full"][2:] == ("completed", None, "Passed", "done by hand")


def test_a_task_may_move_between_batches(spark):
    m = [start("f", "d"), event("f", "FAILED", 0, "t1"), event("f", "COMPLETED", 1, "t1"),
         event("f", "COMPLETED", 0, "t2")]
    table, _ = same_as_replay(spark, m)
    assert {(r[1], r[6]) for r in table} == {(0, "CLOSED"), (1, "OPEN")}


@pytest.mark.parametrize("seed,chunk_rows", [(1, 7), (2, 500)])
def test_random_logs_match_the_replay(spark, seed, chunk_rows):
    same_as_replay(spark, random_log(seed), RANDOM_DAGS, chunk_rows)


def test_one_flow_holding_a_third_of_the_log(spark):
    """Same result with shuffle joins only, and no (flow, chunk) piece beyond the chunk size."""
    messages = random_log(5, flows=60, rows=4000, hot_share=0.34)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        same_as_replay(spark, messages, RANDOM_DAGS, 100)
        sizes = ledger_of(spark, messages, 100).groupBy("correlation_id", "chunk").count()
        assert sizes.agg({"count": "max"}).first()[0] <= 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_per_flow_are_limited_before_each_shuffle(spark):
    """Both ranks keep at most the widest batch per key; the first runs where the join left its pieces, the second shuffles."""
    cat = catalogue_of(spark, DAGS)
    led = ledger_of(spark, [start("f", "d"), event("f", "COMPLETED", 0, "t")])
    flows = B.seeds(led, cat).withColumn("history", B.F.array().cast(f"array<{B._BARRIER}>"))
    events = B.routing.countable(led).select("correlation_id", "chunk", "arrival_seq", "batch_index", "failed")
    plan = B.count_step(flows, events, cat, 0)._jdf.queryExecution().executedPlan().toString()
    limits = [line for line in plan.splitlines() if "WindowGroupLimit" in line]
    assert any("Partial" in x for x in limits) and sum("Final" in x for x in limits) == 2


def test_a_batch_beyond_the_group_limit(spark):
    """1,500 actions in one batch: past Spark's threshold for limiting groups the result is the same."""
    dags = {"d": [(0, [f"a{i}" for i in range(1500)]), (1, ["z"])]}
    m = [start("f", "d")] + [event("f", "COMPLETED", 0, f"t{i}") for i in range(1600)] + [event("f", "COMPLETED", 1, "u")]
    table, ends = same_as_replay(spark, m, dags, 100)
    assert len(table) == 2 and [e[0] for e in ends] == ["f"]


def test_a_deep_catalogue(spark):
    dags = {"deep": [(i, ["a"]) for i in range(6)]}
    m = [start("f", "deep"), start("g", "deep")]
    m += [event("f", "COMPLETED", i, f"t{i}") for i in range(6)] + [event("g", "COMPLETED", i, f"t{i}") for i in (0, 1, 3)]
    table, ends = same_as_replay(spark, m, dags)
    assert len(table) == 9 and [e[0] for e in ends] == ["f"]
