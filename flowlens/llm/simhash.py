"""SimHash near-duplicates through multi-index hashing.

A 64-bit fingerprint is cut into three segments. If two fingerprints differ in at most four bits, then the first segment
differs in at most one bit, or the second does, or the third is equal (else there were five). So every fingerprint asks
the table of each segment for the small Hamming ball of its own segment value, and the whole distance is verified.

Equal fingerprints are one entry. Before the ball search each fingerprint is linked to the smallest and the largest entry
of each of its buckets where the distance allows, and only links between the groups found so far are emitted afterwards, so
a large family of near copies gives about as many links as it has members, not all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.bits import split_join
from flowlens.llm.common import arrow_map, texts
from flowlens.llm.graph import components
from flowlens.operators.storage import cut

SEED = 42
BITS = 64
MEMBER_SLOTS = 1 << 20


def fingerprint(text: bytes, width: int) -> int:
    """Majority of the bits of the XXH64 (seed 42) of all word shingles; a text without words has zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], stops[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = stops[min(width, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)]
    counts = np.zeros(BITS, np.int64)
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(raw[at:at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, sign, fp): a hash of every whole text and its fingerprint, as signed longs; a null text counts as empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([fingerprint(t.encode(), width) for t in batch.column("text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("sign"), pa.array(made.view(np.int64))], names=["doc_id", "sign", "fp"]
        )

    return arrow_map(texts(docs).withColumn("sign", F.xxhash64("text")), "doc_id long, sign long, fp long", run)


def segments(distance: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment: radii of at most one with sum(radius + 1) = distance + 1."""
    many = distance // 2 + 1
    radii = [1] * (many - 1) + [distance - 2 * (many - 1)]
    edges = [BITS * i // many for i in range(many + 1)]
    return [(edges[i], edges[i + 1] - edges[i], radii[i]) for i in range(many)]


def _bucket(which: str, shift: str, width: str) -> Column:
    part = f"(shiftrightunsigned(fp, {shift}) & (shiftleft(1L, {width}) - 1L))"
    return F.expr(f"shiftleft(CAST({which} AS BIGINT), 56) | {part}")


def buckets(fps: DataFrame, distance: int, ball: bool) -> DataFrame:
    """One row per segment, or with ``ball`` one per value in the Hamming ball of each segment: bucket key and columns."""
    probes = []
    for i, (shift, width, radius) in enumerate(segments(distance)):
        flips = [0] + [1 << b for b in range(width)] * (ball and radius > 0)
        probes += [f"named_struct('s', {i}, 'sh', {shift}, 'w', {width}, 'x', {x}L)" for x in flips]
    out = fps.withColumn("_p", F.explode(F.expr(f"array({', '.join(probes)})")))
    return out.withColumn("bucket", _bucket("_p.s", "_p.sh", "_p.w").bitwiseXOR(F.col("_p.x"))).drop("_p")


def link_components(fps: DataFrame, distance: int) -> DataFrame:
    """(fp, comp) for a table of distinct fingerprints: the smallest fingerprint reachable by links, where any exist."""
    own = buckets(fps.select("fp"), distance, ball=False)
    ends = own.groupBy("bucket").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    pivots = own.join(ends, "bucket").select("fp", F.explode(F.array("lo", "hi")).alias("end"))
    near = pivots.where(f"fp <> end AND bit_count(fp ^ end) <= {distance}")
    first = cut(components(near.select(F.col("fp").alias("a"), F.col("end").alias("b"))))
    known = cut(
        fps.select("fp").join(first.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", F.coalesce("comp", "fp").alias("comp"))
    )
    asking = buckets(known, distance, ball=True)
    there = buckets(known.select(F.col("fp"), F.col("comp")), distance, ball=False)
    there = there.select("bucket", F.col("fp").alias("other"), F.col("comp").alias("its"))
    met = asking.join(there, "bucket").where(f"comp < its AND bit_count(fp ^ other) <= {distance}")
    second = cut(components(met.select(F.col("comp").alias("a"), F.col("its").alias("b"))))
    second = second.select(F.col("node").alias("comp"), F.col("comp").alias("whole"))
    return known.join(second, "comp", "left").select("fp", F.coalesce("whole", "comp").alias("comp"))


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, sign, fp, comp, component_id): every document with its fingerprint and the smallest doc_id reachable by links.

    ``sign`` is a hash of the text and ``comp`` the smallest fingerprint reachable. Null and empty texts have fingerprint zero
    and link like any other; documents of fewer than ``width`` words have the fingerprint of their whole word sequence.
    Repeated rows stay repeated. A null doc_id is kept and takes the component of its fingerprint. Other columns of ``docs``,
    whatever their names, are not read. An empty table gives no rows.
    """
    marked = cut(fingerprints(docs, width))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    group = cut(distinct.join(link_components(distinct, distance), "fp"))
    smallest = group.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = cut(group.join(smallest, "comp").select("fp", "comp", "component_id"))
    return marked.join(named, "fp").select("doc_id", "sign", "fp", "comp", "component_id")


def one_each(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """One row of ``docs`` per group of near duplicates, all columns as they are: the smallest doc_id, then the smallest hash.

    Null and empty texts are near each other; a null doc_id comes after all others; of equal rows one stays. Narrow rows decide.
    A document of a group of its own passes where it is read; only those that the sieve can't tell from members of real groups
    meet the decisions, with the caller's row as one struct, so that its column names are free.
    """
    narrow = cut(near_duplicates(docs, width, distance).select("doc_id", "sign", "comp"))
    pairs = narrow.groupBy("comp", "doc_id", "sign").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sign")
    best = narrow.groupBy("comp").agg(F.count(F.lit(1)).alias("members"), F.min(rank).alias("best")).where("members > 1")
    decided = cut(pairs.join(best, "comp").select(
        "doc_id", "sign", (F.col("n") > 1).alias("repeated"),
        (~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("sign") == F.col("best.sign")))).alias("dropped"),
        F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "sign").alias("h"),
    ))
    sign = "xxhash64(coalesce(text, ''))"
    clear, doubtful = split_join(docs, f"xxhash64(coalesce(CAST(doc_id AS BIGINT), -1), {sign})", decided, MEMBER_SLOTS)
    packed = doubtful.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("its_id"), F.expr(sign).alias("its_sign"))
    met = packed.join(decided, F.col("its_id").eqNullSafe(F.col("doc_id")) & (F.col("its_sign") == F.col("sign")), "left")
    kept = met.where("dropped IS NULL OR NOT dropped")
    once = kept.where("repeated").dropDuplicates(["its_id", "its_sign"])
    return clear.unionByName(kept.where("repeated IS NULL OR NOT repeated").select("row.*")).unionByName(once.select("row.*"))


def op9(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
