"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums, so a change of a document is a pair of signed rows: minus what it
counted before, plus what it counts now. A batch of changes is summed before it is stored as an attempt, and counts from the
moment a marker names that attempt. Delivering it again makes a new attempt, whose marker takes the place of the older one, so
each batch counts once however often it comes, and one that breaks off leaves what stood before.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import arrow_map
from flowlens.llm.packing import END_ID, SLICE_BYTES, SLICE_ROWS, VOCABULARY, encoder
from flowlens.operators.storage import cut, fresh_dir

KEYS = ["source", "lang", "tokenizer_version"]
_DELTA = "source string, lang string, tokenizer_version string, documents long, tokens long, attempt string"
_MARKER = "batch string, attempt string, at long"


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, lang, tokenizer_version, tokens) of every whole text; a null text has none."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if batch.num_rows == 0:
            return None
        _, ends = encoder(vocabulary).encode(batch.column(batch.schema.get_field_index("text")), END_ID)
        tokens = pa.array(np.diff(ends, prepend=0) - 1)
        keep = [batch.column(i) for i in range(3)]
        return pa.RecordBatch.from_arrays([*keep, tokens], names=["doc_id", "source", "lang", "tokens"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"),
    )
    counted = arrow_map(rows, "doc_id long, source string, lang string, tokens long", run, SLICE_BYTES, SLICE_ROWS)
    return counted.withColumn("tokenizer_version", F.lit(vocabulary))


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Changes that add (1) or take away (-1) the counted documents."""
    return counts.select(*KEYS, F.lit(sign).cast("long").alias("documents"), (F.col("tokens") * sign).alias("tokens"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes that replace the counts of documents, also where source, language or version moved."""
    return signed(before, -1).unionByName(signed(after, 1))


def in_version(counts: DataFrame, version: str, extra: int = 0) -> DataFrame:
    """The same documents under another tokenizer version, which gives each text ``extra`` more ids."""
    return counts.withColumns({"tokenizer_version": F.lit(version), "tokens": F.col("tokens") + extra})


@dataclass
class Rollup:
    """A folder of committed batches, in storage that all executors share."""

    path: str

    def commit(self, batch: str, changes: DataFrame) -> None:
        """Store the sums of the batch as a new attempt, then the marker that makes it count; no file is ever replaced.

        Of several attempts at a batch the last one marked counts, by the writer's clock.
        """
        attempt = uuid.uuid4().hex
        sums = changes.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        sums.where("documents <> 0 OR tokens <> 0").write.parquet(f"{self.path}/sums/attempt={attempt}")
        marker = changes.sparkSession.createDataFrame([(batch, attempt, time.time_ns())], _MARKER)
        marker.coalesce(1).write.mode("append").parquet(f"{self.path}/markers")

    def totals(self, spark: SparkSession) -> DataFrame:
        """(source, lang, tokenizer_version, documents, tokens) over all batches; keys that came to nothing have no row."""
        markers = spark.read.schema(_MARKER).parquet(f"{self.path}/markers")
        counting = markers.groupBy("batch").agg(F.max_by("attempt", F.struct("at", "attempt")).alias("attempt"))
        rows = spark.read.schema(_DELTA).parquet(f"{self.path}/sums").join(counting, "attempt")
        sums = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 OR tokens <> 0")


def op6(docs: DataFrame, batches: int = 2) -> DataFrame:
    """Totals of all documents after a history of inserts, revisions and deletes, in batches by a hash of the id.

    Each batch arrives before its languages are known, counted as packing counts (with an end id); then its languages are set;
    then it is deleted in that version and inserted in the plain one. One batch of each kind is delivered twice. Texts are
    encoded once, and a batch's changes are summed where they are read. Null source or language is a group of its own; null and
    empty texts count as documents of no tokens; repeated rows count each; other columns are not read. An empty table gives no
    rows.
    """
    counts = cut(token_counts(docs).withColumn("_batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))))
    rollup = Rollup(fresh_dir(docs.sparkSession, "rollup"))
    for i in [*range(batches), 0]:
        plain = counts.where(F.col("_batch") == i)
        ended = in_version(plain, f"{VOCABULARY}+end", 1)
        arrived = ended.withColumn("lang", F.lit(None).cast("string"))
        rollup.commit(f"arrived {i}", signed(arrived, 1))
        rollup.commit(f"languages {i}", revised(arrived, ended))
        rollup.commit(f"versions {i}", revised(ended, plain))
    return rollup.totals(docs.sparkSession)
