"""The trained operators by held-out accuracy, and the pipeline against planted documents."""

import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from flowlens.llm import quality, toxicity
from flowlens.llm.queries import ORACLE
from tools.check_oracle import TABLES, compare

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
MODELS = {"quality": (quality.op2, 3, 1), "toxic": (toxicity.op8, 5, 0)}


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.mark.parametrize("label", MODELS)
def test_scores_rank_held_out_labels(spark, label):
    operator, folds, out = MODELS[label]
    docs, labels = read(spark, "documents"), read(spark, "labels")
    got = {r.doc_id: r for r in operator(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % folds == out) for d, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    known = [(got[r.doc_id].score, r[label]) for r in labels.where(f"{label} IS NOT NULL").collect() if got[r.doc_id].held_out]
    good, bad = (np.array([s for s, y in known if y == v]) for v in (1, 0))
    assert (good[:, None] > bad).mean() > 0.75


@pytest.mark.parametrize("label", MODELS)
def test_awkward_rows_get_scores(spark, label):
    operator = MODELS[label][0]
    rows = [(1, None, "x"), (2, "", "x"), (3, "word " * 100_000, "x"), (3, "word " * 100_000, "x"), (None, "a. b! c", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(3, 1, 1), (2, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert operator(docs, labels).where("score BETWEEN 0 AND 1 AND held_out IS NOT NULL").count() == 5
    assert operator(docs, labels.limit(0)).where("score BETWEEN 0 AND 1").count() == 5
    assert operator(docs.limit(0), labels).count() == 0


def test_decontamination_matches_its_sql(spark):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert set(ORACLE) <= set(entry.oracle_sql())
    assert compare(spark, con, "op3_template_decontamination", SF).startswith("OK")


def test_pipeline_on_planted_documents(spark, tmp_path):
    real = read(spark, "documents")
    item = read(spark, "benchmark").where("text IS NOT NULL").orderBy(F.length("text").desc()).first().text
    labelled = read(spark, "labels").where("toxic = 0").select("doc_id")
    clean = real.join(labelled, "doc_id").orderBy("doc_id").first()
    extra = spark.createDataFrame(
        [(900_001, clean.text, "en", "s", 1), (900_002, f"{clean.text[:300]} {item}", "en", "s", 1), (900_003, None, None, None, None)],
        real.schema,
    )
    path = str(tmp_path)
    real.unionByName(extra).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        read(spark, name).write.parquet(f"{path}/{name}.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, path)
        assert after.columns == docs.columns, name
        docs = after.checkpoint()
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    assert 900_001 not in kept and 900_002 not in kept
    assert {r.doc_id for r in corpus_pipeline.run(spark, path).select("doc_id").collect()} == kept
    toxic = {r.doc_id for r in read(spark, "labels").where("toxic = 1").collect()}
    assert len(kept & toxic) < len(toxic) / 4
    assert len(kept) > 0.7 * real.count()
