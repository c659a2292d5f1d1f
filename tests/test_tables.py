import datetime as dt

from pyspark.sql import functions as F
from support import event, ledger_of

from flowlens.operators.routing import is_auditable
from flowlens.sources import tables

DAY0 = dt.date(2026, 3, 1)


def dated(spark, days):
    rows = [(f"f{i % 3}", f"t{i}", "COMPLETED", DAY0 + dt.timedelta(days=d)) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "correlation_id string, task_flow_id string, status string, created_date date")


def test_retention_prunes_partitions_and_rewrites(spark, tmp_path):
    src, dst = str(tmp_path / "a"), str(tmp_path / "b")
    tables.write_days(dated(spark, [0, 10, 59, 60, 61, 61]), src)
    kept = tables.retained(tables.read_days(spark, src), DAY0 + dt.timedelta(days=70))
    assert kept.count() == 5
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_date" in plan
    tables.rewrite_retained(spark, src, dst, DAY0 + dt.timedelta(days=70))
    assert tables.read_days(spark, dst).count() == 5 and len(list((tmp_path / "b").glob("created_date=*"))) == 4


def test_overwriting_touches_only_the_days_written(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_days(dated(spark, [0, 1, 2]), path)
    tables.write_days(dated(spark, [1, 1]), path)
    got = {r.created_date: r["count"] for r in tables.read_days(spark, path).groupBy("created_date").count().collect()}
    assert list(got.values()).count(1) == 2 and got[DAY0 + dt.timedelta(days=1)] == 2


def test_two_phase_lookup(spark):
    rows = dated(spark, [0, 1, 2, 2])
    keys = spark.createDataFrame([("f0", "t0"), ("f2", "t2"), ("f9", "t9")], "correlation_id string, task_flow_id string")
    today = DAY0 + dt.timedelta(days=2)
    got = {r.task_flow_id: r.phase for r in tables.recent_first(keys, rows, ["correlation_id", "task_flow_id"], today).collect()}
    assert got == {"t0": "older", "t2": "recent"}
    assert tables.existing_keys(keys, rows, ["correlation_id", "task_flow_id"]).count() == 2
    flows = spark.createDataFrame([("f0",), ("f0",), ("f7",)], "correlation_id string")
    assert {r.task_flow_id for r in tables.of_flows(rows, flows).collect()} == {"t0", "t3"}


def test_task_table_counts_a_replayed_batch_once(spark, tmp_path):
    msgs = [event("f", "WAITING", 0, "t"), event("f", "COMPLETED", 0, "t"), event("f", "COMPLETED", 0, "u")]
    rows = ledger_of(spark, msgs).filter(is_auditable())
    table = tables.TaskTable(spark, str(tmp_path / "t"))
    table.apply(rows.filter("arrival_seq > 0"), 1)
    table.apply(rows.filter("arrival_seq = 0"), 0)
    table.apply(rows.filter("arrival_seq = 0"), 0)
    want = [("t", "COMPLETED", 0, 1), ("u", "COMPLETED", 2, 2)]

    def seen(t):
        return sorted((r.task_flow_id, r.status, r.first_seq, r.last_seq) for r in t.rows().collect())

    assert seen(table) == want
    compacted = table.compact(str(tmp_path / "c"))
    compacted.apply(rows.filter("arrival_seq > 0"), 1)
    assert seen(compacted) == want
    compacted.publish(str(tmp_path / "days"))
    assert tables.read_days(spark, str(tmp_path / "days")).filter(F.col("status") == "COMPLETED").count() == 2


def test_barrier_lookups_read_the_partitions_they_need(spark, tmp_path):
    path = str(tmp_path / "b")
    tables.write_days(dated(spark, [0, 1, 2, 2]), path)
    days = tables.partition_days(spark, path)
    assert days == [DAY0 + dt.timedelta(days=d) for d in (0, 1, 2)]
    keys = spark.createDataFrame([("f0", "t0"), ("f2", "t2"), ("f9", "t9")], "correlation_id string, task_flow_id string")
    on, today = ["correlation_id", "task_flow_id"], DAY0 + dt.timedelta(days=2)
    found = tables.recent_first_days(keys, tables.read_days(spark, path), on, days, today)
    assert {r.task_flow_id: r.phase for r in found.collect()} == {"t0": "older", "t2": "recent"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert scans and all("PartitionFilters: [isnotnull(created_date" in x or "created_date" in x.split("PartitionFilters: [")[1][:60] for x in scans)
