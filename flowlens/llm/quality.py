"""Document quality by a factorisation machine.

Inputs are hashed words, structure statistics of the text (repeats, symbols, digits, line and word shapes) and its length as
metadata, each statistic as the two bins next to its value. Besides a weight, every input has a short vector; the product of
two vectors weighs their interaction, and half of (square of the sum - sum of the squares) adds all pairs in linear time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import LETTERS, Words, arrow_map, per_doc, texts
from flowlens.llm.learn import fold, teaching_sample

WORD_BITS = 16
BINS = 12
FACTORS = 8
FOLDS, HELD_OUT = 3, 1
SAMPLE_ROWS = 6000
#: Names of the structure statistics, in the order of ``statistics``.
STATISTICS = (
    "log_bytes", "log_words", "bytes_per_word", "distinct_words", "repeats_previous", "top_word", "repeated_pairs",
    "letters", "digits", "symbols", "upper", "line_bytes", "repeated_lines", "sentence_words", "word_spread", "short_words",
)
STRUCTURE = len(STATISTICS) * (BINS + 1)
WIDTH = STRUCTURE + (1 << WORD_BITS)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def _groups(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (document, key) pairs and how often each occurs."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    first = np.flatnonzero(new)
    return d[first], k[first], np.diff(np.append(first, len(d)))


def statistics(words: Words) -> np.ndarray:
    """One row of ``STATISTICS`` per text; a text without bytes or words has zeros there."""
    n = words.n_docs
    edges = np.concatenate(([0], words.ends))
    size = np.diff(edges).astype(float)
    many = np.diff(words.first).astype(float)
    per_byte, per_word = np.maximum(size, 1), np.maximum(many, 1)
    length = (words.stop - words.start).astype(float)
    share = lambda marks: per_doc(marks[words.raw], edges) / per_byte
    d, _, count = _groups(words.doc, words.hash)
    distinct, top = np.bincount(d, minlength=n), np.zeros(n)
    np.maximum.at(top, d, count)
    same_doc = words.doc[1:] == words.doc[:-1]
    again = np.bincount(words.doc[1:][same_doc & (words.hash[1:] == words.hash[:-1])], minlength=n)
    pair = (words.hash[:-1] * np.uint64(31) ^ words.hash[1:])[same_doc]
    pairs = np.bincount(_groups(words.doc[1:][same_doc], pair)[0], minlength=n)
    breaks = words.raw == 10
    line_start = np.zeros(len(words.raw), bool)
    line_start[edges[:-1][size > 0]] = True
    line_start[1:] |= breaks[:-1]
    begin = np.flatnonzero(line_start)
    stop = np.append(begin[1:], len(words.raw))
    line_doc = np.searchsorted(words.ends, begin, side="right")
    lines = np.bincount(line_doc, minlength=n)
    kinds = np.bincount(_groups(line_doc, words.span_hash(begin, stop))[0], minlength=n)
    spread = np.bincount(words.doc, length * length, n) / per_word - (np.bincount(words.doc, length, n) / per_word) ** 2
    return np.stack(
        [
            np.log1p(size), np.log1p(many), size / per_word, distinct / per_word, again / per_word, top / per_word,
            1 - pairs / np.maximum(many - 1, 1), share(LETTERS), share(np.isin(np.arange(256), range(48, 58))),
            share(_SYMBOL), share(np.isin(np.arange(256), range(65, 91))), size / np.maximum(lines, 1),
            1 - kinds / np.maximum(lines, 1), many / np.maximum(per_doc(_STOP[words.raw], edges), 1),
            np.sqrt(np.maximum(spread, 0)), np.bincount(words.doc, length <= 2, n) / per_word,
        ],
        axis=1,
    )


@dataclass
class Inputs:
    """A sparse matrix by rows: row, column and value of each entry, by row."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    rows: int


def inputs(stats: np.ndarray, row: np.ndarray, bucket: np.ndarray, count: np.ndarray, edges: np.ndarray) -> Inputs:
    """Word counts scaled to length one per text, and for each statistic the two bins around its value.

    ``edges`` has BINS + 1 increasing points per statistic; a value between two points belongs to both in part.
    """
    n, many = stats.shape
    norm = np.sqrt(np.bincount(row, count.astype(float) ** 2, n))
    low, part = np.empty((n, many), np.int64), np.empty((n, many))
    for j in range(many):
        e = edges[j]
        low[:, j] = np.clip(np.searchsorted(e, stats[:, j], side="right") - 1, 0, BINS - 1)
        part[:, j] = np.clip((stats[:, j] - e[low[:, j]]) / np.maximum(e[low[:, j] + 1] - e[low[:, j]], 1e-12), 0, 1)
    column = low + np.arange(many) * (BINS + 1)
    at = np.repeat(np.arange(n), many)
    rows = np.concatenate((at, at, row))
    columns = np.concatenate((column.ravel(), column.ravel() + 1, STRUCTURE + bucket))
    values = np.concatenate(((1 - part).ravel(), part.ravel(), count / norm[row])) / np.sqrt(many)
    order = np.argsort(rows, kind="stable")
    return Inputs(rows[order], columns[order], values[order], n)


@dataclass
class Model:
    bias: float
    weight: np.ndarray
    vector: np.ndarray
    edges: np.ndarray

    def logits(self, x: Inputs) -> np.ndarray:
        first = np.searchsorted(x.row, np.arange(x.rows + 1))
        linear = per_doc(self.weight[x.column] * x.value, first)
        moved = self.vector[x.column] * x.value[:, None]
        return self.bias + linear + 0.5 * (per_doc(moved, first) ** 2 - per_doc(moved * moved, first)).sum(axis=1)


def describe(words: Words) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return statistics(words), _groups(words.doc, (words.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64))


def sample_rows(sample: DataFrame) -> list[tuple]:
    """(statistics, buckets, counts, label) of each document of a bounded sample, computed where the rows are."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats, (row, bucket, count) = describe(Words(batch.column("text")))
        cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
        pack = lambda v: pa.array(
            [v[i:j].astype(np.int32).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()
        )
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array([s.tobytes() for s in stats], pa.binary()),
             pack(bucket), pack(count)],
            names=["doc_id", "label", "stats", "bucket", "n"],
        )

    made = arrow_map(sample, "doc_id long, label int, stats binary, bucket binary, n binary", run)
    return [
        (np.frombuffer(r.stats), np.frombuffer(r.bucket, np.int32), np.frombuffer(r.n, np.int32), r.label)
        for r in sorted(made.collect(), key=lambda r: (r.doc_id, r.stats))
    ]


def fit(rows: list[tuple], epochs: int = 10, rate: float = 0.1, decay: float = 2e-4) -> Model:
    """AdaGrad on the logistic loss; no rows give a model that scores one half."""
    random = np.random.default_rng(0)
    weight, vector = np.zeros(WIDTH), random.normal(0, 0.05, (WIDTH, FACTORS))
    bias, bias_square = 0.0, 1e-6
    w_square, v_square = np.full(WIDTH, 1e-6), np.full((WIDTH, FACTORS), 1e-6)
    edges = np.tile(np.linspace(0, 1, BINS + 1), (len(STATISTICS), 1))
    if not rows:
        return Model(bias, weight, np.zeros((WIDTH, FACTORS)), edges)
    stats = np.stack([s for s, _, _, _ in rows])
    for j in range(len(STATISTICS)):
        e = np.quantile(stats[:, j], np.linspace(0, 1, BINS + 1))
        edges[j] = np.maximum.accumulate(e + np.arange(BINS + 1) * 1e-9)
    y = np.array([label for _, _, _, label in rows], float)
    for _ in range(epochs):
        for part in np.array_split(random.permutation(len(rows)), max(1, len(rows) // 32)):
            row = np.repeat(np.arange(len(part)), [len(rows[i][1]) for i in part])
            bucket, count = (np.concatenate([rows[i][k] for i in part]) for k in (1, 2))
            x = inputs(stats[part], row, bucket, count, edges)
            first = np.searchsorted(x.row, np.arange(x.rows + 1))
            moved = vector[x.column] * x.value[:, None]
            total = per_doc(moved, first)
            logit = bias + per_doc(weight[x.column] * x.value, first) + 0.5 * (
                total ** 2 - per_doc(moved * moved, first)
            ).sum(axis=1)
            pull = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y[part]) / len(part)
            hit, where = np.unique(x.column, return_inverse=True)
            g = pull[x.row] * x.value
            step = np.bincount(where, g, len(hit)) + decay * weight[hit]
            w_square[hit] += step * step
            weight[hit] -= rate * step / np.sqrt(w_square[hit])
            turn = g[:, None] * (total[x.row] - moved)
            for f in range(FACTORS):
                step = np.bincount(where, turn[:, f], len(hit)) + decay * vector[hit, f]
                v_square[hit, f] += step * step
                vector[hit, f] -= rate * step / np.sqrt(v_square[hit, f])
            bias_square += pull.sum() ** 2
            bias -= rate * pull.sum() / np.sqrt(bias_square)
    return Model(bias, weight.astype(np.float32), vector.astype(np.float32), edges)


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> Model:
    """The model of at most ``bound`` labelled documents outside the held-out fold."""
    return fit(sample_rows(teaching_sample(docs, labels, "quality", fold("doc_id", FOLDS) != HELD_OUT, bound)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text, between 0 and 1.

    Null and empty texts count as texts without words and get the score of their (zero) statistics. Repeated rows stay
    repeated, a null doc_id is kept, other columns are not read, an empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats, (row, bucket, count) = describe(Words(batch.column("text")))
        logits = model.logits(inputs(stats, row, bucket, count, model.edges))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(logits, -500, 500))), pa.float64())],
            names=["doc_id", "score"],
        )

    return arrow_map(texts(docs), "doc_id long, score double", run)


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels)).select(
        "doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
