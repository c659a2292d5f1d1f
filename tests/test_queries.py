"""The registered queries against their SQL on the smallest tables, and the contract around them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from flowlens.plans.queries import BATCH_QUERIES
from flowlens.plans.stream_queries import STREAM_QUERIES
from tools.check_oracle import TABLES, compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")

QUICK = [
    "route_envelopes", "conformance_report", "quarantine_split", "body_verdicts", "task_upsert", "barrier_lifecycle", "final_patch",
    "task_refs", "flow_document", "action_lookup", "dcx_lookup", "registry_snapshot", "batch_commands", "lifecycle_rows",
    "signals_correlated", "recent_first_lookup", "retained_rows", "stream_task_table", "stream_barriers", "stream_commands",
    "stream_signals", "stream_late", "stream_dedup", "quarantine_provenance", "task_flow_refs", "barrier_table", "barrier_recent_first",
    "barrier_exists", "flow_barriers",
]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert {*BATCH_QUERIES, *STREAM_QUERIES} <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_its_sql(spark, con, name):
    assert compare(spark, con, name, SF).startswith("OK")


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_flow_outcome_decodes_the_events_once(spark, tmp_path, monkeypatch):
    """Barriers and tasks come out of one stored log; the rows are those of the two operators on logs of their own."""
    from flowlens.operators import reports
    from flowlens.plans import queries as Q

    spark.range(300).selectExpr(
        "id AS event_id", "timestamp '2024-01-01' + make_interval(0, 0, 0, id % 28) AS ts", "id % 7 AS user_id",
        "element_at(array('signup', 'view', 'click', 'error', 'purchase'), CAST(id * 7 % 11 % 5 AS INT) + 1) AS event_type",
        "CAST(id AS DOUBLE) AS value", "concat('{\"k\":', id * 13 % 97, '}') AS props",
    ).write.parquet(str(tmp_path / "events.parquet"))
    sf = str(tmp_path)
    want = sorted(map(tuple, reports.flow_outcome(Q.event_barriers(spark, sf), Q.event_tasks(spark, sf)).collect()))
    calls, decode = [], Q.event_ledger
    monkeypatch.setattr(Q, "event_ledger", lambda *a: calls.append(a) or decode(*a))
    got = sorted(map(tuple, Q.flow_outcome(spark, sf).collect()))
    assert got == want and len(got) > 10 and len(calls) == 1
