"""A bit table of fixed size over 64-bit hashes, as a constant of an expression: a first sieve inside a scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sieve(hashes: DataFrame, slots: int = 1 << 17) -> Callable[[str], str]:
    """From a frame with a column ``h``: SQL that is true for each of these hashes, and for few others.

    The table has ``slots`` bits whatever the number of hashes, so at most ``slots`` / 64 numbers reach the driver. With many
    hashes it lets more pass; an exact join has to follow.
    """
    slot = F.pmod("h", F.lit(slots))
    cells = dict(map(tuple, (
        hashes.where("h IS NOT NULL").select(slot.alias("slot")).distinct()
        .groupBy(F.expr("slot div 64").alias("cell"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot % 64 AS INT))")).alias("bits")).collect()
    )))
    table = f"CAST(split('{','.join(str(cells.get(i, 0)) for i in range(slots // 64))}', ',') AS array<bigint>)"
    return lambda h: (
        f"getbit(get({table}, CAST(pmod({h}, {slots}) div 64 AS INT)), CAST(pmod({h}, {slots}) % 64 AS INT)) = 1"
    )


def split_join(rows: DataFrame, h: str, other: DataFrame, slots: int = 1 << 17) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose hash (SQL ``h``, never null) is surely not in ``other.h``, and the few that have to join it to know."""
    passes = sieve(other.select("h"), slots)(h)
    return rows.where(f"NOT ({passes})"), rows.where(passes)


def without(rows: DataFrame, h: str, bad: DataFrame) -> DataFrame:
    """``rows`` whose hash (SQL ``h``) is not in ``bad.h``; only those that the sieve can't clear are shuffled.

    The caller's row travels as one struct, so its column names meet no others.
    """
    clear, doubtful = split_join(rows, h, bad)
    packed = doubtful.select(F.struct("*").alias("row"), F.expr(h).alias("its_h"))
    kept = packed.join(bad.select(F.col("h").alias("bad_h")), F.col("its_h") == F.col("bad_h"), "left_anti")
    return clear.unionByName(kept.select("row.*"))
