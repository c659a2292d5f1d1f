"""Packing token sequences by cutting-stock column generation.

Long documents are cut into full sequences and one rest. The rests, by length class, are the items of a cutting-stock
problem: a linear program over patterns (how many items of each class share a sequence), whose columns are priced by a
knapsack dynamic program over the duals. Rounded-down pattern counts, and a first-fit pass over the few items left, give a
plan of slots per class; every piece takes the slot of its rank within its class. Only the histogram of classes, a fixed
number of rows, reaches the driver.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

from flowlens.llm.common import arrow_map, spread, texts
from flowlens.operators.storage import cut

SIZE = 2048
STEP = 8
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
CACHE_WORDS = 200_000
JOIN_BYTES = 8192
SLICE_BYTES = 8 << 20
SLICE_ROWS = 6000
_MARKS = r"!-/:-@\[-`{-~"
_PARTS = rf"^(?P<lead>[!-&(-/:;=-@\[-`{{-~]*)(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[{_MARKS}]*)$"
_PLAIN = rf"^([a-zß-öø-ÿ]+|[{_MARKS}]+)$"
_ADDED = re.compile("<[^A-Za-z]*[A-Za-z]")
_BETWEEN = "\x01"


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit numbers; remembers the ids of up to ``CACHE_WORDS`` parts of words.

    The vocabulary's pre-tokens never cross white space, so a text is encoded word by word. Letters between punctuation are
    three parts, in lower case as the vocabulary has them, so a word is encoded once for all ways to write it. (A quote before
    letters may be one pre-token with them, and "<" may begin a token that was added: such words, like those with other
    characters, stay whole.) Parts are encoded many at a time. A plain one needs no normalizer, and its ids are those up to the one that ends a word; others are told apart by
    a character put between them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would only hold memory
        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        whole, apart, gap = (self.tokenizer.encode(t, add_special_tokens=False).ids for t in ("(ÀB.", "( àb .", _BETWEEN))
        added = all(_ADDED.match(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.by_parts = added and whole == apart and int(self.ends[whole].sum()) == 3  # else words are encoded one by one
        self.between = gap[-1] if gap else -1
        self.words = pa.array([], pa.large_string())
        self.ids = pa.array([], pa.large_binary())

    def _joined(self, words: pa.Array, tokenizer: Tokenizer, glue: str) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Groups of words, and the ids of each group's text; a group starts in each further ``JOIN_BYTES``."""
        ends = np.cumsum(pc.binary_length(words).to_numpy())
        borders = np.flatnonzero(np.diff(ends // JOIN_BYTES, prepend=-1, append=-1))
        for at, to in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            part = words.slice(at, to - at)
            made = tokenizer.encode_batch_fast([glue.join(part.to_pylist())], add_special_tokens=False)[0]
            yield part, np.array(made.ids, "<u4")

    def _plain(self, words: pa.Array) -> list[pa.Array]:
        made = []
        for part, ids in self._joined(words, self.plain, " "):
            stops = np.flatnonzero(self.ends[ids]) + 1
            made.append(_spans(ids, stops) if len(stops) == len(part) else self._each(part))
        return made

    def _any(self, words: pa.Array) -> list[pa.Array]:
        made = []
        for part, ids in self._joined(words, self.tokenizer, f" {_BETWEEN} "):
            gap = ids == self.between
            stops = np.append(np.flatnonzero(gap) - np.arange(gap.sum()), len(ids) - gap.sum())
            made.append(_spans(ids[~gap], stops) if len(stops) == len(part) else self._each(part))
        return made

    def _each(self, words: pa.Array) -> pa.Array:
        made = (self.tokenizer.encode_batch_fast([w], add_special_tokens=False)[0].ids for w in words.to_pylist())
        return pa.array([np.array(ids, "<u4").tobytes() for ids in made], pa.large_binary())

    def _ids(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words; the cache takes new ones while it has room."""
        at = pc.index_in(words, value_set=self.words)
        unknown = at.is_null()
        new = words.filter(unknown)
        plain = pc.match_substring_regex(new, _PLAIN)
        added = [new.filter(plain), new.filter(pc.invert(plain))]
        ids = pa.concat_arrays([self.ids, *self._plain(added[0]), *self._any(added[1])])
        first = np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")
        place = at.fill_null(0).to_numpy().copy()
        place[np.flatnonzero(unknown)[first]] = np.arange(len(self.words), len(ids))
        if len(self.words) < CACHE_WORDS:
            self.words = pa.concat_arrays([pa.concat_arrays([self.words, *added]).slice(0, CACHE_WORDS)])
            self.ids = pa.concat_arrays([ids.slice(0, CACHE_WORDS)])  # a copy: the slice would hold all
        return ids.take(pa.array(place))

    def _word_ids(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words, put together from those of their parts."""
        if not self.by_parts:
            return self._each(words)
        lead, stem, tail = pc.extract_regex(words, _PARTS).flatten()
        whole = lead.is_null()
        parts = [pc.utf8_lower(stem.fill_null("")), pc.if_else(whole, words, lead), tail.fill_null("")]
        numbered = pa.concat_arrays(parts).dictionary_encode()
        ids = self._ids(numbered.dictionary)
        stem, lead, tail = (ids.take(numbered.indices.slice(i * len(words), len(words))) for i in range(3))
        return pc.binary_join_element_wise(lead, stem, tail, pa.scalar(b"", pa.large_binary()))

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, ``end_id`` after each text, and where each text's ids end.

        Only new parts of the distinct words of the slice pass through Python; Arrow splits, numbers and gathers the rest.
        """
        parts = pc.split_pattern(pc.replace_substring(column.cast(pa.large_string()), "\n", " "), " ")
        numbered = parts.flatten().dictionary_encode()
        words = pa.concat_arrays([
            self._word_ids(numbered.dictionary), pa.array([np.array([end_id], "<u4").tobytes()], pa.large_binary()),
        ])
        ends = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        order = np.insert(numbered.indices.to_numpy(), ends[1:], len(words) - 1)
        spans = words.take(pa.array(order))
        stops = np.frombuffer(spans.buffers()[1], np.int64)[:len(spans) + 1]
        return np.frombuffer(spans.buffers()[2], "<u4")[:stops[-1] // 4], stops[ends[1:] + np.arange(1, len(ends))] // 4


def _spans(ids: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The bytes of ``ids`` up to each stop as one value."""
    borders = np.concatenate(([0], stops)).astype(np.int64) * 4
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(borders), pa.py_buffer(ids)])


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One per Python worker and vocabulary; the file lies where the installed package has it."""
    if name not in _encoders:
        _encoders[name] = Encoder(public_tokenizers.path(name))
    return _encoders[name]


def token_pieces(
    docs: DataFrame, vocabulary: str = VOCABULARY, size: int = SIZE, end_id: int = END_ID, slice_bytes: int = SLICE_BYTES,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens): every document's ids and ``end_id``, cut into pieces of at most ``size``.

    ``ids`` holds little-endian unsigned 32-bit numbers. A null or empty text is one piece of ``end_id`` alone. Smaller slices
    hold less memory and take more time, for fewer words are shared within one; the rows are the same.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if batch.num_rows == 0:
            return None
        pa.default_memory_pool().release_unused()  # what the slice before took
        ids, ends = encoder(vocabulary).encode(batch.column(1), end_id)
        begins = np.concatenate(([0], ends[:-1]))
        totals = ends - begins
        pieces = -(-totals // size)
        doc = np.repeat(np.arange(len(ends)), pieces)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
        length = np.minimum(size, totals[doc] - start)
        borders = np.concatenate(((begins[doc] + start) * 4, ends[-1:] * 4)).astype(np.int32)
        raw = pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(borders), pa.py_buffer(ids)])
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), raw, pa.array(totals[doc])],
            names=["doc_id", "start", "length", "ids", "doc_tokens"],
        )

    return arrow_map(texts(docs), "doc_id long, start long, length long, ids binary, doc_tokens long", run, slice_bytes, slice_rows)


@dataclass
class Pattern:
    counts: dict[int, int]
    times: int


def price(value: np.ndarray, widths: np.ndarray, room: int) -> tuple[float, dict[int, int]]:
    """The most valuable filling of ``room`` with any number of items of each width."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for s in range(1, room + 1):
        fits = np.searchsorted(widths, s, side="right")
        best[s] = best[s - 1]
        if fits:
            gain = best[s - widths[:fits]] + value[:fits]
            i = int(gain.argmax())
            if gain[i] > best[s] + 1e-12:
                best[s], took[s] = gain[i], i
    counts: dict[int, int] = {}
    s = room
    while s > 0:
        if took[s] < 0:
            s -= 1
        else:
            counts[int(took[s])] = counts.get(int(took[s]), 0) + 1
            s -= int(widths[took[s]])
    return float(best[room]), counts


def patterns(demand: dict[int, int], room: int, most_columns: int = 3000) -> list[Pattern]:
    """Patterns that hold exactly ``demand`` (items per width), near the fewest in all.

    Revised simplex with one generated column a step, from the patterns of one width each. Stopping after ``most_columns``
    only leaves the plan a little longer.
    """
    widths = np.array(sorted(w for w, n in demand.items() if n > 0))
    if len(widths) == 0:
        return []
    need = np.array([demand[int(w)] for w in widths], float)
    fit = room // widths
    columns = [{i: int(fit[i])} for i in range(len(widths))]
    inverse = np.diag(1.0 / fit)
    x = need / fit
    for _ in range(most_columns):
        dual = inverse.sum(axis=0)
        worth, counts = price(np.maximum(dual, 0), widths, room)
        if worth <= 1 + 1e-7:
            break
        column = np.zeros(len(widths))
        column[list(counts)] = list(counts.values())
        turn = inverse @ column
        ratio = np.where(turn > 1e-9, x / np.maximum(turn, 1e-9), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x -= ratio[out] * turn
        x[out] = ratio[out]
        inverse[out] /= turn[out]
        others = np.arange(len(widths)) != out
        inverse[others] -= np.outer(turn[others], inverse[out])
        columns[out] = counts
    left = need.astype(np.int64)
    whole: list[Pattern] = []
    for counts, times in sorted(zip(columns, x, strict=True), key=lambda c: -c[1]):
        times = min(int(times + 1e-6), *(int(left[i] // n) for i, n in counts.items()))
        if times > 0:
            whole.append(Pattern({int(widths[i]): n for i, n in counts.items()}, times))
            for i, n in counts.items():
                left[i] -= n * times
    return whole + first_fit({int(w): int(n) for w, n in zip(widths, left, strict=True) if n}, room)


def first_fit(left: dict[int, int], room: int) -> list[Pattern]:
    """First-fit decreasing over what rounding left: a few items per pattern, whatever the size of the corpus."""
    bins: list[list] = []
    for width in sorted(left, reverse=True):
        for _ in range(left[width]):
            home = next((b for b in bins if b[0] >= width), None)
            if home is None:
                bins.append(home := [room, {}])
            home[0] -= width
            home[1][width] = home[1].get(width, 0) + 1
    return [Pattern(counts, 1) for _, counts in bins]


def slots(plan: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, end rank, first sequence, slots per sequence): where the ranks of each class go."""
    rows, rank, sequence = [], {}, 0
    for p in plan:
        for width, each in p.counts.items():
            at = rank.get(width, 0)
            rows.append((width, at, at + each * p.times, sequence, each))
            rank[width] = at + each * p.times
        sequence += p.times
    return rows


def place(pieces: DataFrame, size: int = SIZE, step: int = STEP) -> DataFrame:
    """``pieces`` (doc_id, start, length and any other columns) with sequence_id and offset.

    A class covers ``step`` lengths. Ranks are counted per (class, hash part) and offset by the parts before, so a class with
    most of the rows is spread. The plan has a few rows per class, at most size / step classes: that is what is broadcast.
    """
    spark = pieces.sparkSession
    parts = spread(spark)
    rows = pieces.withColumns({
        "_class": F.expr(f"CAST((length + {step - 1}) div {step} AS INT)"),
        "_part": F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)).cast("int"),
    })
    sizes = cut(rows.groupBy("_class", "_part").agg(F.count(F.lit(1)).alias("_n")))
    demand = dict(map(tuple, sizes.groupBy("_class").agg(F.sum("_n")).collect()))
    plan = slots(patterns(demand, size // step))
    before = W.partitionBy("_class").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_class", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    order = W.partitionBy("_class", "_part").orderBy("doc_id", "start")
    ranked = rows.withColumn("_rank", F.row_number().over(order) - 1).join(starts, ["_class", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before"))
    slot = spark.createDataFrame(plan, "_class int, _low long, _high long, _base long, _each int")
    there = ranked.join(F.broadcast(slot), "_class").where("_rank >= _low AND _rank < _high")
    there = there.withColumn("sequence_id", F.expr("_base + (_rank - _low) div _each"))
    inside = W.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "_rank")
    inside = inside.rowsBetween(W.unboundedPreceding, -1)
    return there.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop(
        "_class", "_part", "_rank", "_before", "_low", "_high", "_base", "_each"
    )


def sequences(placed: DataFrame, size: int = SIZE, pad_id: int = 0) -> DataFrame:
    """(sequence_id, length, ids): the ids of each sequence in order, padded to ``size`` except at a power of two."""
    whole = placed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("all")
    )
    missing = F.when(F.expr("bit_count(length) = 1"), F.lit(0)).otherwise(F.lit(size) - F.col("length")).cast("int")
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), missing))
    hexed = F.expr("array_join(transform(all, p -> hex(p.ids)), '')")
    return whole.select("sequence_id", "length", F.concat(F.unhex(hexed), pad).alias("ids"))


def op5(docs: DataFrame, slice_bytes: int = SLICE_BYTES, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Null and empty texts give one piece of one id; repeated rows are packed each; a null doc_id is kept; other columns
    are not read; an empty table gives no rows."""
    pieces = cut(token_pieces(docs, slice_bytes=slice_bytes, slice_rows=slice_rows).withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return place(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
