"""A training-data pipeline over ``documents``: each stage applies one corpus operator to all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import decontamination, packing, secrets, simhash, toxicity
from flowlens.llm.bits import without
from flowlens.llm.common import table
from flowlens.operators.storage import fresh_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the multiple-instance model scores below one half."""
    return toxicity.accepted(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose four-word fingerprints link at four or fewer bits."""
    return simhash.one_each(docs, width=4, distance=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; they are matched by a hash of their text, so a null id is no hiding place."""
    key = "xxhash64(coalesce(text, ''))"
    held = decontamination.contaminated(docs.select(F.expr(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(docs, key, held.select(F.col("doc_id").alias("h")).distinct())


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret that the ledger finds replaced in the text."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 ids; small slices, since executors still hold what earlier stages grew."""
    return packing.op5(docs, slice_bytes=2 << 20, slice_rows=2000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", keep_one_near_copy),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("packing", pack),
]

#: SQL can express neither the trained model nor the vocabulary; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_dir(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
