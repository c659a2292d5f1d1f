"""Repeated passages by sparse suffix arrays.

Suffixes are retained at minimisers only: of every ``least - k + 1`` consecutive k-word grams the one with the smallest hash, so the
choice depends on the words alone and any passage of ``least`` words keeps a suffix in each place where it occurs. Suffixes
whose first k words occur in one text only drop out. The others, with the words on either side of the gram, are sorted over the
cluster by gram. Two texts that share ``least`` words share one of their retained grams with m words before it and the rest behind
it, for some m. So the suffixes are sorted once for each m, by the m words to the left and the ``least - k - m`` to the right: equal
ones are neighbours, however many others share the gram and one of its sides. Neighbours from other texts are compared word by word
and the match is extended right and left, as far as the next retained suffix can be away. Matches, joined where they touch, are
the passages; none is missed.

Ranges are cut within a gram by a hash of the text, so a passage that a third of all documents hold is spread. Where a gram may go
on in another range, each range hands over one row for a stretch that two of its texts share, and the places of a stretch
that it saw in one text only; an aggregation over these finds what ranges share. Texts are told apart by a 64-bit hash; copies
of one text are one entry, and a text of ``least`` words with copies is a passage as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.llm.common import Words, arrow_map, mixed, small_batches, spread, texts, utf8
from flowlens.operators.storage import cut

LEAST = 50
GRAM = 12
HELD_ROWS = 32_768
_STEP = np.uint64(0x9FB21C651E98DF25)


def grams(words: Words, k: int) -> np.ndarray:
    """Hash of the k words from each position on, for positions that have k words left in the slice."""
    n = len(words.hash) - k + 1
    total = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        total = total * _STEP + words.hash[j:j + n]
    return mixed(total)


def retained(words: Words, hashes: np.ndarray, k: int, least: int) -> np.ndarray:
    """Positions, in the slice, of the smallest gram of every window of ``least`` words inside one document."""
    width = least - k + 1
    if len(words.hash) < least:
        return np.empty(0, np.int64)
    inside = words.doc[:len(words.hash) - least + 1] == words.doc[least - 1:]
    view = np.lib.stride_tricks.sliding_window_view(hashes, width)
    picks = [
        at + np.flatnonzero(ok) + view[at:at + len(ok)][ok].argmin(axis=1)
        for at in range(0, len(inside), 1 << 16) if (ok := inside[at:at + (1 << 16)]).any()
    ]
    return np.unique(np.concatenate(picks)) if picks else np.empty(0, np.int64)


def suffix_table(docs: DataFrame, least: int = LEAST, k: int = GRAM) -> DataFrame:
    """(doc_id, text_hash, n_words, keys, positions) of every whole text: its retained suffixes by gram hash and word."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column("text"))
        hashes = grams(words, k)
        at = retained(words, hashes, k, least)
        edges = pa.array(np.searchsorted(at, words.first).astype(np.int32))
        lists = [
            pa.ListArray.from_arrays(edges, pa.array(v)) for v in
            (hashes[at].view(np.int64), (at - words.first[words.doc[at]]).astype(np.int32))
        ]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(np.diff(words.first).astype(np.int32)), *lists],
            names=["doc_id", "text_hash", "n_words", "keys", "positions"],
        )

    rows = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    return arrow_map(rows, "doc_id long, text_hash long, n_words int, keys array<long>, positions array<int>", run)


def contexts(chosen: DataFrame, least: int = LEAST, k: int = GRAM) -> DataFrame:
    """One row per listed suffix of (text_hash, text, positions): its gram, and the words around it as 32-bit hashes.

    ``left`` runs backwards from the gram; both sides hold ``least - k`` words, zeros past the ends of the text, and
    ``n_left`` and ``n_right`` say how many are there.
    """
    reach = least - k

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column("text"))
        lists = batch.column("positions")
        many = np.diff(lists.offsets.to_numpy())
        doc = np.repeat(np.arange(batch.num_rows), many)
        pos = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        at = pos + words.first[doc]
        keys = grams(words, k)[at]
        small = (words.hash >> np.uint64(32)).astype("<u4")
        step = np.arange(reach)
        n_left = np.minimum(pos, reach)
        n_right = np.minimum(words.first[doc + 1] - at - k, reach)
        left = np.where(step < n_left[:, None], small[np.maximum(at[:, None] - 1 - step, 0)], 0).astype("<u4")
        right = np.where(step < n_right[:, None], small[np.minimum(at[:, None] + k + step, len(small) - 1)], 0).astype("<u4")
        pack = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys.view(np.int64)), pack(right), pack(left), batch.column("text_hash").take(pa.array(doc)),
                pa.array(pos.astype(np.int32)), pa.array(n_left.astype(np.int32)), pa.array(n_right.astype(np.int32)),
            ],
            names=["key", "right", "left", "text_hash", "pos", "n_left", "n_right"],
        )

    schema = "key long, right binary, left binary, text_hash long, pos int, n_left int, n_right int"
    return arrow_map(chosen, schema, run)


@dataclass
class Suffixes:
    """Rows of ``contexts`` as arrays, sorted by gram; ``left`` and ``right`` have a line of word hashes per row."""

    key: np.ndarray
    text_hash: np.ndarray
    pos: np.ndarray
    n_left: np.ndarray
    n_right: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch, reach: int) -> Suffixes:
        plain = [batch.column(c).to_numpy() for c in ("key", "text_hash", "pos", "n_left", "n_right")]
        return Suffixes(*plain, *(utf8(batch.column(c))[0].view("<u4").reshape(-1, reach) for c in ("left", "right")))

    @staticmethod
    def joined(parts: list[Suffixes]) -> Suffixes:
        return Suffixes(*(np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(Suffixes)))

    def at(self, rows: np.ndarray | slice) -> Suffixes:
        return Suffixes(*(getattr(self, f.name)[rows] for f in fields(self)))

    def extend(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        """How far the suffixes of rows a and b match to the left and to the right of their gram."""
        out = []
        for words, there in ((self.left, self.n_left), (self.right, self.n_right)):
            same = words[a] == words[b]
            run = np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1))
            out.append(np.minimum(run, np.minimum(there[a], there[b])))
        return out

    def orders(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each m, from the middle outwards: (m, rows, hash, first, last).

        ``rows`` are those with m words to the left of the gram and the rest to its right, sorted by the hash of gram and words
        and then by text; ``first`` and ``last`` are the ends, in that order, of each one's run of equal hashes.
        """
        reach = self.left.shape[1]
        sums = []
        for words in (self.left, self.right):
            run = np.zeros((reach + 1, len(self.key)), np.uint64)
            for j in range(reach):
                run[j + 1] = run[j] * _STEP + words[:, j] + np.uint64(1)
            sums.append(run)
        gram = mixed(self.key.view(np.uint64))
        for m in sorted(range(reach + 1), key=lambda m: abs(2 * m - reach)):
            rows = np.flatnonzero((self.n_left >= m) & (self.n_right >= reach - m))
            if len(rows) == 0:
                continue
            h = mixed(mixed(sums[0][m, rows] + np.uint64(m)) * _STEP + mixed(sums[1][reach - m, rows]) + gram[rows])
            order = np.lexsort((self.text_hash[rows], h))
            rows, h = rows[order], h[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            size = np.diff(np.concatenate((first, [len(h)])))
            yield m, rows, h.view(np.int64), np.repeat(first, size), np.repeat(first + size - 1, size)


_COMPARED = "text_hash long, start int, end int, other long, key long, h long"


def _compared(*columns: np.ndarray | pa.Array | None) -> pa.RecordBatch:
    n = len(columns[0])
    types = {"int": pa.int32(), "long": pa.int64()}
    named = [c.split() for c in _COMPARED.split(", ")]
    arrays = [pa.nulls(n, types[t]) if c is None else pa.array(c).cast(types[t]) for (_, t), c in zip(named, columns, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in named])


def neighbours(rows: Suffixes, least: int, k: int) -> pa.RecordBatch:
    """(text_hash, start, end, other), one row per suffix that matches one of another text over ``least`` words.

    All matches of a suffix hold its gram, so together they are one passage. A stretch that earlier matches cover is not
    compared again.
    """
    reach = np.full((2, len(rows.key)), -1, np.int64)
    other = np.full(len(rows.key), np.iinfo(np.int64).max)
    for m, at, _, first, last in rows.orders():
        text = rows.text_hash[at]
        partner = np.where(text[first] != text, first, last)
        due = (text[partner] != text) & ((reach[0, at] < m) | (reach[1, at] < least - k - m))
        x, y = at[due], at[partner[due]]
        both = rows.extend(x, y)
        good = (rows.key[x] == rows.key[y]) & (both[0] + k + both[1] >= least)
        x, y = x[good], y[good]
        for side in (0, 1):
            reach[side, x] = np.maximum(reach[side, x], both[side][good])
        other[x] = np.minimum(other[x], rows.text_hash[y])
    hit = np.flatnonzero(reach[0] >= 0)
    pos = rows.pos[hit]
    return _compared(rows.text_hash[hit], pos - reach[0, hit], pos + k + reach[1, hit], other[hit], None, None)


def handed_over(rows: Suffixes, least: int) -> Iterator[pa.RecordBatch]:
    """Stretches of ``least`` words of one gram, for other ranges: one row without a place for each that two texts here share
    (its places are matched already), all places of each that one text holds."""
    for m, at, h, first, last in rows.orders():
        text = rows.text_hash[at]
        alone = text[first] == text[last]
        picks = np.flatnonzero(alone | (first == np.arange(len(at))))
        start = rows.pos[at[picks]] - m
        hidden = ~alone[picks]
        places = [pa.array(start + add, mask=hidden) for add in (0, least)]
        yield _compared(text[picks], *places, None, rows.key[at[picks]], h[picks])


def matches(around: DataFrame, least: int = LEAST, k: int = GRAM) -> DataFrame:
    """(text_hash, start, end, other) of all retained suffixes that match one of another text over ``least`` words."""
    spark = around.sparkSession
    dealt = around.withColumn("salt", F.xxhash64("text_hash"))
    dealt = dealt.repartitionByRange(spread(spark), "key", "salt").sortWithinPartitions("key").drop("salt")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole grams at a time, some ``HELD_ROWS`` rows or the rows that one gram has in this range."""
        held: list[Suffixes] = []
        many, opening = 0, True
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(Suffixes.of(batch, least - k))
            many += batch.num_rows
            if many < HELD_ROWS or held[0].key[0] == held[-1].key[-1]:
                continue
            rows = Suffixes.joined(held)
            end = int(np.searchsorted(rows.key, rows.key[-1]))
            done, held = rows.at(slice(0, end)), [rows.at(slice(end, None))]
            many = len(rows.key) - end
            yield neighbours(done, least, k)
            if opening:
                yield from handed_over(done.at(slice(0, int(np.searchsorted(done.key, done.key[0], side="right")))), least)
                opening = False
        if held:
            done = Suffixes.joined(held)
            yield neighbours(done, least, k)
            ends = {done.key[-1], done.key[0]} if opening else {done.key[-1]}
            for key in ends:
                yield from handed_over(done.at(done.key == key), least)

    small_batches(spark)
    compared = cut(dealt.mapInArrow(compare, _COMPARED))
    inner = compared.where("other IS NOT NULL").select("text_hash", "start", "end", "other")
    border = compared.where("other IS NULL")
    shared = border.groupBy("key", "h").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).where("a <> b")
    across = border.where("start IS NOT NULL").join(shared, ["key", "h"]).select(
        "text_hash", "start", "end", F.expr("IF(a = text_hash, b, a)").alias("other")
    )
    return inner.unionByName(across)


def passages(docs: DataFrame, least: int = LEAST, k: int = GRAM) -> DataFrame:
    """(doc_id, start, end, other): each passage of ``least`` words or more that a document shares with another one.

    ``start`` and ``end`` count white-space separated words, ASCII letters alike in either case; ``other`` is the smallest id
    of one text that holds (part of) it, for a copied text the smallest id of its copies. Null, empty and shorter texts have no
    passage. Copies with repeated ids give repeated rows. A null doc_id is kept. Other columns are not read. An empty table
    gives no rows.
    """
    table = cut(suffix_table(docs, least, k))
    copies = cut(table.groupBy("text_hash").agg(
        F.min("doc_id").alias("holder"), F.count(F.lit(1)).alias("copies"), F.max("n_words").alias("n_words")
    ))
    each = table.select("text_hash", F.explode(F.arrays_zip("keys", "positions")).alias("s")).select(
        "text_hash", F.col("s.keys").alias("key"), F.col("s.positions").alias("pos")
    )
    shared = each.groupBy("key").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).where("a <> b")
    listed = each.join(cut(shared.select("key")), "key").select("text_hash", "pos").distinct()
    listed = listed.groupBy("text_hash").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    listed = cut(listed.join(copies.select("text_hash", "holder"), "text_hash")).select(
        F.col("text_hash").alias("its_hash"), "holder", "positions"
    )
    rows = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("holder")) & (F.col("text_hash") == F.col("its_hash"))
    chosen = rows.join(listed.hint("shuffle_hash"), same).select("text_hash", "text", "positions")
    found = matches(contexts(chosen, least, k), least, k)
    before = W.partitionBy("text_hash").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    island = W.partitionBy("text_hash").orderBy("start", "end").rowsBetween(W.unboundedPreceding, 0)
    once = found.groupBy("text_hash", "start", "end").agg(F.min("other").alias("other"))
    fresh = once.withColumn("new", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int"))
    merged = fresh.withColumn("island", F.sum("new").over(island)).groupBy("text_hash", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("other").alias("other")
    ).select("text_hash", "start", "end", "other")
    merged = cut(merged).join(copies.where("copies > 1").select("text_hash"), "text_hash", "left_anti")
    names = copies.select(F.col("text_hash").alias("other"), F.col("holder").alias("other_id"))
    merged = merged.join(names, "other").select("text_hash", "start", "end", F.col("other_id").alias("other"))
    whole = copies.where((F.col("copies") > 1) & (F.col("n_words") >= least)).select(
        "text_hash", F.lit(0).alias("start"), F.col("n_words").alias("end"), F.col("holder").alias("other")
    )
    return table.select("doc_id", "text_hash").join(cut(merged.unionByName(whole)), "text_hash").select(
        "doc_id", "start", "end", "other"
    )


def op7(docs: DataFrame) -> DataFrame:
    return passages(docs).select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"),
                                 F.col("other").alias("other_doc_id"))
