from support import event, ledger_of

from flowlens.operators import tasks
from flowlens.operators.routing import is_auditable

TIMES = {"startedAt": "2026-01-01T00:00:01Z", "finishedAt": "2026-01-01T00:00:02Z"}


def audit(spark, messages):
    return ledger_of(spark, messages).filter(is_auditable())


def rows(frame):
    return {(r.correlation_id, r.task_flow_id): r for r in frame.collect()}


MESSAGES = [
    event("f", "WAITING", 0, "t", execution=TIMES | {"durationMs": 5}),
    event("f", "COMPLETED", 1, "t", execution={"startedAt": "2026-01-01T00:00:09Z"}),
    event("f", "FAILED", 1, "t", retryable=False),
    event("f", "WAITING", 2, "t", action="z"),
    event("g", "FAILED", 0, "u", retryable=True),
    event("g", "COMPLETED", 0, None),
    event("g", "COMPLETED", 0, "v", action=None),
    event("g", "COMPLETED", None, "v"),
    event("g", None, 0, "v"),
    event("g", "COMPLETED", 0, ""),
]


def test_column_rules(spark):
    got = rows(tasks.upsert_tasks(audit(spark, MESSAGES)))
    assert set(got) == {("f", "t"), ("g", "u"), ("g", "")}
    t = got["f", "t"]
    assert (t.status, t.batch_index, t.action_name, t.error_json) == ("WAITING", 2, "z", None)
    assert t.started_at.second == 9 and t.finished_at is None and t.duration_ms == 5
    assert (t.first_seq, t.last_seq) == (0, 3)
    assert got["g", "u"].error_json == '{"retryable":true}'


def test_deltas_fold_to_the_same_rows_in_any_split_and_when_replayed(spark):
    whole = audit(spark, MESSAGES)
    parts = [tasks.collapse_delta(whole.filter(whole.arrival_seq % 3 == i)) for i in range(3)]
    folded = tasks.merge_deltas(parts[2].unionByName(parts[0]).unionByName(parts[1]).unionByName(parts[0]))
    want = tasks.upsert_tasks(whole)
    assert rows(tasks.delta_rows(folded).select(*want.columns)) == rows(want)


def test_latest_result_is_of_the_task_created_last(spark):
    msgs = [event("f", "COMPLETED", 0, "old"), event("f", "COMPLETED", 0, "new"), event("f", "COMPLETED", 0, "old"),
            event("f", "WAITING", 0, "newest")]
    got = tasks.latest_results(tasks.upsert_tasks(audit(spark, msgs))).collect()
    assert len(got) == 1 and '"id":"new"' in got[0].result_json
