"""What the trained operators share: which rows may teach, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import texts


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id has no fold."""
    return F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % folds


def teaching_sample(docs: DataFrame, labels: DataFrame, label: str, taught: Column, bound: int) -> DataFrame:
    """(doc_id, text, label) of at most ``bound`` labelled documents for which ``taught`` holds, by a hash of the id.

    Null ids and labels teach nothing; an id with several labels counts with the largest. The chosen ids are at most
    ``bound`` narrow rows, which is what is broadcast.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .dropna().where(taught).groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    rows = texts(docs)
    present = rows.select("doc_id").where(taught).distinct()
    chosen = known.join(present, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return rows.join(F.broadcast(chosen), "doc_id")
