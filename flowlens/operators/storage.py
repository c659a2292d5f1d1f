"""Shared scratch storage: lineage cuts and working folders."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a private one only where it is unset (tests)."""
    named = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError(f"set {_CONF} to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="flowlens-")
    spark.conf.set(_CONF, made)
    return made


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute once into a table in the shared folder and read it back: short lineage, reusable, with real sizes."""
    path = fresh_dir(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
