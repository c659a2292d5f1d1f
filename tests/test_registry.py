from pyspark.sql import functions as F
from support import catalogue_of

from flowlens import schemas as S
from flowlens.operators import lookups as L
from flowlens.operators.skew import measured
from flowlens.sources import catalogue as K

CODES = [("OLD", "run", "MS", 0), ("07", "zero", "MS", 1), ("RUN", "run", "XX", 2), (None, "bare", "MS", 3), ("RUN", "also", "MS", 4),
         ("N", None, "MS", 5), ("N", " \t", "MS", 6)]
DCX = [("RUN", "D-flow", None, "F1", 0), ("RUN", "D-def", "DEFAULT", None, 1), ("07", "D-modem", "M1", "", 2), ("07", None, "M2", None, 3),
       ("07", "D-zero", None, None, 4), ("RUN", "D-def2", " ", "DEFAULT", 5), (None, "x", None, None, 6)]


def registry(spark):
    codes = spark.createDataFrame(CODES, "action_code string, action_name string, action_type string, load_pos long")
    dcx = spark.createDataFrame(DCX, S.DCX_CODES)
    return (codes.withColumn("enabled", F.lit(False)), dcx)


def test_lookups(spark):
    codes, dcx = registry(spark)
    names, keys = measured(K.valid_action_codes(codes)), measured(K.valid_dcx_codes(dcx))
    asked = spark.createDataFrame(
        [("run", "F1", "M9"), ("run", "F2", None), ("zero", "F1", "M1"), ("zero", None, "M2"), ("bare", None, None), ("none", None, None),
         (None, None, None)],
        "action_name string, flow_type string, modem_type string",
    )
    known = L.with_action(asked, names)
    full = L.with_dcx(L.with_default_code(known, names, "zero"), keys, F.col("flow_type"), F.col("modem_type"))
    got = {(r.action_name, r.flow_type): r for r in full.collect()}
    assert got["run", "F1"].action_code == "RUN" and got["run", "F1"].action_type == "XX"
    assert got["run", "F1"].dcx_action_code == "D-flow" and got["run", "F2"].dcx_action_code == "D-def2"
    assert got["zero", "F1"].dcx_action_code == "D-modem" and got["zero", None].dcx_action_code == "D-zero"
    assert got["bare", None].known and got["bare", None].code_or_default is None and got["bare", None].dcx_action_code is None
    assert got["none", None].code_or_default == "07" and got["none", None].name_or_default == "zero"
    assert not got[None, None].known and got[None, None].name_or_default == "zero"
    assert {(r.action_code, r.action_name) for r in L.names_by_code(names).collect()} == {("RUN", "also"), ("07", "zero")}
    assert L.missing_names(asked.select("action_name"), names).filter("action_name is not null").first().action_name == "none"
    assert {r.action_name: r.dcx_action_code for r in L.resolve(asked.select("action_name").distinct(), names, keys).collect()} == {
        "run": "D-def2", "zero": "D-zero", "bare": "UNKNOWN"}
    exact = L.contains_dcx_key(known, keys).collect()
    assert {(r.action_name, r.modem_type) for r in exact} == {("zero", "M2")}  # the exact row exists, its code is null


def test_audit_and_snapshots(spark):
    codes, dcx = registry(spark)
    a = K.registry_audit("a", codes, F.col("action_name"), F.col("action_name")).first()
    assert (a.rows_read, a.rows_skipped, a.keys_kept, a.keys_overwritten, a.ready) == (7, 2, 4, 1, True)
    d = K.registry_audit("d", dcx, F.col("parent"), K.dcx_row_key()).first()
    assert (d.rows_skipped, d.keys_kept, d.keys_overwritten) == (1, 5, 1)
    old, none = K.valid_action_codes(codes), K.valid_action_codes(codes.filter("action_name is null"))
    new = K.valid_action_codes(codes.filter("load_pos = 1"))
    assert [r.action_name for r in K.select_snapshot(old, new).collect()] == ["zero"]
    assert K.select_snapshot(old, none).count() == 4


def test_large_dimensions_lose_the_broadcast_hint(spark):
    dim = spark.range(100).withColumnRenamed("id", "k")
    rows = spark.range(1000).withColumnRenamed("id", "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = rows.join(measured(dim), "k")._jdf.queryExecution().executedPlan().toString()
        large = rows.join(measured(dim, max_rows=99), "k")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in small and "BroadcastHashJoin" not in large


def test_catalogue_rules(spark, tmp_path):
    docs = [
        {"dagKey": "d", "batches": [{"index": 0, "actions": [{"actionName": "gone"}]}]},
        None,
        {"dagKey": "  ", "batches": [{"index": 0, "actions": [{"actionName": "x"}]}]},
        {"dagKey": "d", "batches": [
            {"index": 0, "actions": [{"actionName": "a", "dependsOn": ["p", "q"]}, None, {"actionName": "b", "dependsOn": ["q"]}]},
            {"index": 0, "actions": [{"actionName": "second"}]},
            {"index": 1, "actions": []}, {"index": 3, "actions": [{"actionName": "far"}]}]},
    ]
    cat = K.build_catalogue(K.dag_documents(spark, docs))
    assert {(r.dag_key, r.batch_index, r.task_total) for r in cat.batches.collect()} == {("d", 0, 3), ("d", 1, None), ("d", 3, 1)}
    assert {(r.action_name, r.action_pos) for r in cat.actions.filter("batch_index = 0").collect()} == {("a", 0), ("b", 2)}
    assert (cat.depth, cat.widest) == (2, 3)
    from flowlens.operators.commands import batch_dependencies
    deps = {r.batch_index: r.dependencies for r in batch_dependencies(cat).collect()}
    assert deps[0] == ["p", "q"] and deps[3] == []
    import json
    for i, d in enumerate(docs):
        (tmp_path / f"{i}.json").write_text("{bad" if d is None else json.dumps(d))
    read = K.build_catalogue(K.read_dag_documents(spark, str(tmp_path)))
    assert sorted(map(str, read.actions.collect())) == sorted(map(str, cat.actions.collect()))


def test_declared_catalogue_of_one_batch(spark):
    cat = catalogue_of(spark, {"s": [(0, ["a"])]})
    assert (cat.depth, cat.widest, cat.batches.count()) == (1, 1, 1)
