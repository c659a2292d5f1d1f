"""Joins and numbering that never gather all rows of one key in one task.

The log's arrival sequence is unique, so ``arrival_seq div chunk_rows`` cuts any key into pieces of at most
``chunk_rows`` rows, whatever share of the log that key holds. Keyed work below runs on (key, chunk) pieces and
combines the small per-piece summaries afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.operators.storage import cut

CHUNK = "chunk"
CHUNK_ROWS = 1 << 18
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def chunk_of(seq: str, chunk_rows: int = CHUNK_ROWS) -> Column:
    return F.expr(f"`{seq}` div {int(chunk_rows)}")


def spread_join(rows: DataFrame, per_key: DataFrame, key: str, how: str = "inner", piece: str = CHUNK) -> DataFrame:
    """Join of a log with a frame of one row per key, on (key, piece). ``how`` is ``inner`` or ``left``."""
    spans = rows.select(key, piece).distinct()
    return rows.join(spans.join(per_key, key, how), [key, piece])


def number_rows(
    rows: DataFrame, keys: list[str], order: list[str], name: str, start: DataFrame | None = None
) -> DataFrame:
    """Dense position within ``keys`` by (chunk, order), from 1 or after the key's ``start`` (keys, _start).

    Rank inside each (keys, chunk) piece plus the row count of the pieces before it; the second window sees
    one row per piece. ``chunk`` must be non-decreasing in ``order``.
    """
    counts = rows.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, CHUNK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    if start is not None:
        offsets = offsets.join(start, keys, "left").select(
            *keys, CHUNK, (F.col("_off") + F.coalesce("_start", F.lit(0))).alias("_off")
        )
    inner = W.partitionBy(*keys, CHUNK).orderBy(*order)
    return (
        rows.withColumn("_rn", F.row_number().over(inner))
        .join(offsets, [*keys, CHUNK])
        .withColumn(name, F.col("_off") + F.col("_rn"))
        .drop("_off", "_rn")
    )


def measured(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Store a dimension once, measure it, and hint a broadcast only within the bound; past it, joins shuffle."""
    stored = cut(df)
    rows, size = stored.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))
    ).first()
    return F.broadcast(stored) if rows <= max_rows and size <= max_bytes else stored
