"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence scores sigmoid(bias + sum of the weights of its words and word beginnings); the noisy-or of its sentences scores
the document. Only document labels teach. The loss reaches each sentence through the noisy-or, so the weights settle on the
sentences that explain the label, and the same weights locate the offending ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import LETTERS, SLICE_BYTES, Words, arrow_map, slices, small_batches, texts
from flowlens.llm.learn import fold, teaching_sample

BITS = 20
STEMS = (4, 5)
FOLDS, HELD_OUT = 5, 0
SAMPLE_ROWS = 4000
LEAST_DOCS = 3
BEYOND = 3.0
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Bags:
    """Sentences of a slice of texts: features, the sentence of each feature, the document and bytes of each sentence."""

    feature: np.ndarray
    sentence: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    stop: np.ndarray


def bags(words: Words) -> Bags:
    """A sentence ends at one of ``.!?``, a line break, or the end of its text; one without a word does not exist."""
    if len(words.start) == 0:
        empty = np.empty(0, np.int64)
        return Bags(empty, empty, empty, empty, empty)
    before = np.concatenate(([0], np.cumsum(_ENDS[words.raw])))[words.start]
    new = np.empty(len(words.start), bool)
    new[0] = True
    new[1:] = (before[1:] != before[:-1]) | (words.doc[1:] != words.doc[:-1])
    first = np.flatnonzero(new)
    sentence = np.cumsum(new) - 1
    parts = [words.hash] + [
        words.span_hash(words.start, np.minimum(words.start + n, words.stop)) ^ np.uint64(n) for n in STEMS
    ]
    feature = (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)
    return Bags(
        feature, np.tile(sentence, len(parts)), words.doc[first], words.start[first],
        words.stop[np.concatenate((first[1:], [len(words.start)])) - 1],
    )


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentence_logits(self, b: Bags) -> np.ndarray:
        return self.bias + np.bincount(b.sentence, self.weights[b.feature], len(b.doc))


def noisy_or(logits: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """1 - product of (1 - p) over the sentences of each document, in logarithms; 0 where there is no sentence."""
    return -np.expm1(-np.bincount(doc, np.logaddexp(0, logits), n_docs))


def sample_bags(sample: DataFrame) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(features, their sentences, label) of each document of a bounded sample, computed where the rows are."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        b = bags(Words(batch.column("text"), LETTERS))
        home = b.doc[b.sentence] if len(b.doc) else b.sentence
        order = np.argsort(home, kind="stable")
        cut = np.searchsorted(home[order], np.arange(batch.num_rows + 1))
        f, s = b.feature[order].astype(np.int32), b.sentence[order].astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("label"),
                pa.array([f[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                pa.array([s[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
            ],
            names=["doc_id", "label", "f", "s"],
        )

    made = arrow_map(sample, "doc_id long, label int, f binary, s binary", run)
    out = []
    for row in sorted(made.collect(), key=lambda r: (r.doc_id, r.f)):
        s = np.frombuffer(row.s, np.int32)
        out.append((np.frombuffer(row.f, np.int32), s - (s.min() if len(s) else 0), row.label))
    return out


def fit(bagged: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 12, rate: float = 0.5, decay: float = 1e-4, 
        least: int = LEAST_DOCS, beyond: float = BEYOND) -> Model:
    """AdaGrad on the noisy-or likelihood, a few documents at a time; no rows give a model that calls nothing toxic.

    Only features of at least ``least`` sample documents, toxic ones more often than chance by ``beyond`` deviations, get a
    weight, so neither a rare nor a common word explains a document away.
    """
    y = np.array([label for _, _, label in bagged], float)
    share = y.mean() if len(y) else 0.0
    in_docs, in_toxic = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for f, _, label in bagged:
        once = np.unique(f)
        in_docs[once] += 1
        in_toxic[once] += label
    above = (in_toxic - in_docs * share) / np.sqrt(in_docs * share * (1 - share) + 0.5)
    held = (in_docs >= least) & (above >= beyond)
    kept = [(f[held[f]], s[held[f]], y, int(s.max()) + 1) for f, s, y in bagged if len(s)]
    weights, squares = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    bias, bias_square = -7.0, 1e-6
    order = np.random.default_rng(0)
    for _ in range(epochs):
        ids = order.permutation(len(kept))
        for at in range(0, len(ids), 16):
            part = [kept[i] for i in ids[at:at + 16]]
            sizes = [n for _, _, _, n in part]
            base = np.cumsum([0, *sizes])
            feature = np.concatenate([f for f, _, _, _ in part])
            sentence = np.concatenate([s + b for (_, s, _, _), b in zip(part, base[:-1], strict=True)])
            doc = np.repeat(np.arange(len(part)), sizes)
            y = np.array([label for _, _, label, _ in part], float)
            logits = bias + np.bincount(sentence, weights[feature], base[-1])
            p_doc = np.clip(noisy_or(logits, doc, len(part)), 1e-9, 1 - 1e-9)
            p = 1 / (1 + np.exp(-np.clip(logits, -50, 50)))
            pull = np.where(y[doc] == 1, -(1 - p_doc[doc]) / p_doc[doc], 1.0) * p / len(part)
            hit, where = np.unique(feature, return_inverse=True)
            step = np.bincount(where, pull[sentence], len(hit)) + decay * weights[hit]
            squares[hit] += step * step
            weights[hit] -= rate * step / np.sqrt(squares[hit])
            total = float(pull.sum())
            bias_square += total * total
            bias -= rate * total / np.sqrt(bias_square)
    return Model(weights.astype(np.float32), bias)


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> Model:
    """The model of at most ``bound`` labelled documents outside the held-out fold."""
    sample = teaching_sample(docs, labels, "toxic", fold("doc_id", FOLDS) != HELD_OUT, bound)
    return fit(sample_bags(sample))


def score(docs: DataFrame, model: Model, offending: float = 0.5) -> DataFrame:
    """(doc_id, score, sentences): the noisy-or of every whole text, and the spans of its offending sentences.

    Spans are (start, end, score) in code points. A text that is null, empty or without a word scores 0 and offends nowhere.
    Repeated rows stay repeated, a null doc_id is kept, other columns are not read, an empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column("text"), LETTERS)
        b = bags(words)
        logits = model.sentence_logits(b)
        whole = noisy_or(logits, b.doc, batch.num_rows)
        p = 1 / (1 + np.exp(-np.clip(logits, -50, 50)))
        bad = np.flatnonzero(p >= offending)
        points = np.concatenate(([0], np.cumsum((words.raw & 0xC0) != 0x80)))
        origin = points[np.concatenate(([0], words.ends[:-1]))]
        spans = pa.StructArray.from_arrays(
            [
                pa.array(points[b.start[bad]] - origin[b.doc[bad]], pa.int32()),
                pa.array(points[b.stop[bad]] - origin[b.doc[bad]], pa.int32()), pa.array(p[bad], pa.float64()),
            ],
            names=["start", "end", "score"],
        )
        edges = np.searchsorted(b.doc[bad], np.arange(batch.num_rows + 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(whole, pa.float64()), pa.ListArray.from_arrays(pa.array(edges), spans)],
            names=["doc_id", "score", "sentences"],
        )

    return arrow_map(
        texts(docs), "doc_id long, score double, sentences array<struct<start:int,end:int,score:double>>", run
    )


def accepted(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose whole text scores below ``limit``.

    A text that is null, empty or without a word scores 0 and stays; repeated rows stay repeated. Only the text goes to Python and
    only its score comes back; the rows are filtered where they are read.
    """

    @F.arrow_udf("double")
    def whole(text: pa.Array) -> pa.Array:
        scores = [np.empty(0)]
        for part in slices(pa.RecordBatch.from_arrays([text], names=["text"]), SLICE_BYTES // 4):
            b = bags(Words(part.column("text"), LETTERS))
            scores.append(noisy_or(model.sentence_logits(b), b.doc, part.num_rows))
        return pa.array(np.concatenate(scores), pa.float64())

    small_batches(docs.sparkSession)
    return docs.where(whole(F.col("text")) < limit)


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, train(docs, labels))
    return scored.select(
        "doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("sentences").alias("n_offending"), "sentences",
    )
