"""Shared pieces of the corpus operators: table reads, Arrow maps over texts, vectorised word hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICE_BYTES = 1 << 20
BATCH_ROWS = 2000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
_OURS = "flowlens.arrow.rows"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Two columns, (doc_id, text); a null text counts as empty."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def spread(spark: SparkSession, least: int = 1) -> int:
    """Partitions for an explicit repartition: the session's own shuffle setting."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Hold this session's Arrow batches to rows that are few enough for long texts; a setting of the caller's own stays."""
    if spark.conf.get(_BATCH_CONF) in ("10000", spark.conf.get(_OURS, "10000")):
        spark.conf.set(_BATCH_CONF, str(rows))
        spark.conf.set(_OURS, str(rows))


def give_back() -> None:
    """Free memory of this Python worker returns to the system; it idles beside its executor until the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, other C libraries need it less
    if trim is not None:
        trim(0)


def arrow_map(
    df: DataFrame, schema: str | StructType, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], most: int = SLICE_BYTES,
    rows: int = BATCH_ROWS,
) -> DataFrame:
    """``fn`` on every Arrow batch of at most ``rows``, cut into slices so that one slice holds few bytes of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most):
                made = fn(part)
                if made is not None:
                    yield made
        give_back()

    small_batches(df.sparkSession, rows)
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Row slices of about ``most`` bytes of text each (one row at least)."""
    if column not in batch.schema.names or batch.num_rows == 0:
        yield batch
        return
    _, ends = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
        to = max(to, at + 1)
        yield batch.slice(at, to - at)
        at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all strings one after another, and the end of each. Nulls count as empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if len(offsets) == 0 or column.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(column), np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets[1:] - offsets[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(by)
    return h ^ (h >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2**64."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[name] = np.multiply.accumulate(factors)
    return _powers["up"], _powers["down"]


class Words:
    """ASCII lower-cased words of a slice of texts: byte positions, 64-bit hashes, documents.

    Words are what white space parts, or with ``solid`` the runs of the bytes that it marks.
    """

    def __init__(self, column: pa.Array, solid: np.ndarray = ~_SPACE):
        self.raw, self.ends = utf8(column)
        data = self.raw
        self.data = _LOWER[data]
        n = len(self.data)
        self.n_docs = len(self.ends)
        solid = solid[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.ends] = True
        edge[0] = True
        start = solid.copy()
        start[1:] &= ~solid[:-1] | edge[1:n]
        stop = solid.copy()
        stop[:-1] &= ~solid[1:] | edge[1:n]
        self.start = np.flatnonzero(start)
        self.stop = np.flatnonzero(stop) + 1
        up, _ = powers(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.prefix[1:])
        self.hash = self.span_hash(self.start, self.stop)
        self.doc = np.searchsorted(self.ends, self.start, side="right")
        self.first = np.searchsorted(self.start, np.concatenate(([0], self.ends)))

    def span_hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each span, the same wherever the span lies."""
        _, down = powers(len(self.prefix))
        return mixed((self.prefix[stop] - self.prefix[start]) * down[start] + (stop - start).astype(np.uint64) * _MIX)


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each document; ``first`` has the document borders."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
