from pyspark.sql import functions as F

from flowlens.functions.body import append_if_absent
from flowlens.operators import documents as D

c = F.col


def attrs(*pairs):
    return [(None, n, v, None, None, None, None) for n, v in pairs]


def test_one_reference_is_appended_once(spark):
    arr = "array<struct<id:string,href:string>>"
    rows = spark.createDataFrame([(None,), ([("a", "1")],), ([("b", "9"), None],)], f"arr {arr}")
    new = F.struct(F.lit("b").alias("id"), F.lit("2").alias("href"))
    got = [[tuple(e) if e else None for e in r.v] for r in rows.select(append_if_absent(c("arr"), new).alias("v")).collect()]
    assert got == [[("b", "2")], [("a", "1"), ("b", "2")], [("b", "9"), None]]


def test_merged_references_keep_existing_first_and_number_across_pieces(spark):
    existing = spark.createDataFrame([("f", 1, "x", "/old"), ("f", 2, "t3", "/old")], "correlation_id string, pos int, id string, href string")
    new = spark.createDataFrame(
        [("f", i // 3, i, f"t{i % 7}", f"/{i}") for i in range(20)] + [("g", 0, 5, "t1", "/g")],
        "correlation_id string, chunk long, arrival_seq long, id string, href string",
    )
    got = D.merged_refs(existing, new, ["href"]).orderBy("correlation_id", "pos").collect()
    assert [(r.pos, r.id, r.href) for r in got if r.correlation_id == "f"] == [
        (1, "x", "/old"), (2, "t3", "/old"), (3, "t0", "/0"), (4, "t1", "/1"), (5, "t2", "/2"), (6, "t4", "/4"), (7, "t5", "/5"), (8, "t6", "/6")]
    assert [(r.pos, r.id) for r in got if r.correlation_id == "g"] == [(1, "t1")]


def test_existing_entries_as_rows(spark):
    docs = spark.createDataFrame(
        [("f", [("a", "/a"), None, ("b", "/b")]), ("g", None)], "id string, relatedEntity array<struct<id:string,href:string>>"
    )
    got = D.explode_refs(docs, "relatedEntity", {"href": "href"}).orderBy("pos").collect()
    assert [(r.correlation_id, r.pos, r.id, r.href) for r in got] == [("f", 1, "a", "/a"), ("f", 3, "b", "/b")]


def test_final_patch_replaces_old_status_entries(spark):
    from flowlens import schemas as S
    docs = spark.createDataFrame(
        [("f", attrs(("keep", "1"), ("PROCESSSTATUS", "old"), ("StatusChangeReason", "old"))), ("n", None)],
        f"id string, characteristic array<{S.CHARACTERISTIC}>",
    )
    ends = spark.createDataFrame(
        [("f", 9, "completed", "Passed", "why"), ("n", 9, "failed", "ERROR", " "), ("missing", 9, "failed", None, "x")],
        "correlation_id string, end_seq long, state string, process_status string, status_change_reason string",
    )
    got = {r.id: (r.state, [(a.name, a.value, a.valueType) for a in r.characteristic]) for r in D.final_patches(ends, docs).collect()}
    assert got["f"] == ("completed", [("keep", "1", None), ("processStatus", "Passed", "string"), ("statusChangeReason", "why", "string")])
    assert got["n"] == ("failed", [("processStatus", "ERROR", "string")])
    assert got["missing"] == ("failed", [("statusChangeReason", "x", "string")])


def test_patches_fold_field_by_field(spark):
    p = spark.createDataFrame(
        [("d", 1, "initial", "/1", ["a"]), ("d", 2, None, None, ["b", "c"]), ("d", 3, "failed", None, None)],
        "id string, seq long, state string, href string, related array<string>",
    )
    r = D.fold_patches(p, ["state", "href", "related"]).first()
    assert (r.state, r.href, r.related) == ("failed", "/1", ["b", "c"])
    e = p.withColumn("related", F.transform("related", lambda x: F.struct(x.alias("name"))))
    got = D.appended_entries(e, "related").orderBy("seq", "entry_pos").collect()
    assert [x.name for x in got] == ["a", "b", "c"]


def test_state_patches_skip_unknown_states(spark):
    from flowlens.operators.routing import flow_state
    rows = spark.createDataFrame([("a", "FAILED"), ("b", "odd"), ("c", None)], "id string, state string")
    assert [(r.id, r.state) for r in D.state_patches(rows, flow_state(c("state"))).collect()] == [("a", "failed")]
