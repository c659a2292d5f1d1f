"""Spelling variants through a dictionary of trie-node pairs.

The frequent words, sorted, give the nodes of their trie: a word shares with its predecessor the nodes of their common beginning
and starts new ones after it. The reversed words give the nodes of the endings. So each word is a row of numbers of its prefixes and
one of its suffixes, and a pair (prefix node, suffix node) says all about a word but what stands between the two. Words that skip
one position at the same pair differ by one replaced code point; a word that skips a position where another one is merely cut
holds one more code point than that one. No candidate needs a check: the numbers are exact.

One pair holds at most one cut word and one skipping word per letter of the alphabet, so its group is small whatever the corpus.
Words may be long: numbers and counts travel, never the substrings.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import spread
from flowlens.operators.storage import cut

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH = 5
LEAST_COUNT = 3
EVERY = 97
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PART = 40
_FLUSH = 1 << 18


def occurrences(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word): one row per run of letters of every whole text, lower-cased, every 97th by its hash with a letter deleted."""
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))
    rows = docs.where("text IS NOT NULL").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(runs).alias("run")
    ).where(f"length(run) >= {least_length}")
    rows = rows.select("run", F.crc32(F.concat_ws(":", "doc_id", "run").cast("binary")).alias("h"))
    at = "CAST(h % length(run) AS INT)"
    cut_run = f"concat(substring(run, 1, {at}), substring(run, {at} + 2))"
    return rows.select(F.expr(f"CASE WHEN h % {EVERY} = 0 THEN {cut_run} ELSE run END").alias("word"))


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of ``least_length`` code points and ``least_count`` occurrences or more."""
    long_enough = occurrences(docs, least_length).where(F.length("word") >= least_length)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def trie_rows(words: DataFrame, key: str) -> DataFrame:
    """``words`` with ``nodes``, the trie numbers of all beginnings of the string ``key`` (the root first), and ``new``.

    ``new`` tells for each position whether its code point differs from the one before. Each range of the sorted strings
    numbers its own nodes; ``joined`` then gives beginnings shared over a range border the number of their first range.
    """
    fields = [f for f in words.schema if f.name != key]
    schema = ", ".join([f"{key} string", *[f"{f.name} {f.dataType.simpleString()}" for f in fields],
                        "part int", "nodes array<long>", "new array<boolean>"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, stack, last = "", None, 0
        for batch in batches:
            strings = batch.column(key).to_pylist()
            at = 0
            while at < len(strings):
                nodes, new, start, held = [], [], at, 0
                while at < len(strings) and held < _FLUSH:
                    word = strings[at]
                    if stack is None:
                        base = batch.column("part")[0].as_py() << _PART
                        stack, last = [base], base
                    shared = len(commonprefix((before, word)))
                    fresh = len(word) - shared
                    stack = stack[:shared + 1] + list(range(last + 1, last + fresh + 1))
                    last += fresh
                    before = word
                    nodes.append(stack)
                    new.append([a != b for a, b in zip(word, "\0" + word, strict=False)])
                    held += len(word)
                    at += 1
                piece = batch.slice(start, at - start)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(key), *[piece.column(f.name) for f in fields], piece.column("part"),
                     pa.array(nodes, pa.list_(pa.int64())), pa.array(new, pa.list_(pa.bool_()))],
                    names=[key, *[f.name for f in fields], "part", "nodes", "new"],
                )

    dealt = words.repartitionByRange(spread(words.sparkSession), key).sortWithinPartitions(key)
    dealt = dealt.select(key, *[f.name for f in fields], F.spark_partition_id().alias("part"))
    return joined(cut(dealt.mapInArrow(number, schema)), key)


def joined(rows: DataFrame, key: str) -> DataFrame:
    """One numbering over all ranges; the driver sees the first and the last string of each range, and the nodes of the last."""
    borders = rows.groupBy("part").agg(
        F.min(key).alias("first"), F.max(key).alias("last"), F.max_by("nodes", key).alias("nodes")
    ).orderBy("part").collect()
    before, stack, carried = "", [], []
    for row in borders:
        shared = len(commonprefix((before, row["first"])))
        carry = stack[:shared + 1]
        carried.append((row["part"], carry))
        first = row["part"] << _PART
        stack = [carry[i] if i < len(carry) and x == first + i else x for i, x in enumerate(row["nodes"])]
        before = row["last"]
    table = rows.sparkSession.createDataFrame(carried, "part int, carry array<long>")
    return rows.join(F.broadcast(table), "part").withColumn("nodes", F.expr(
        f"transform(nodes, (x, i) -> CASE WHEN i < size(carry) AND x = shiftleft(CAST(part AS BIGINT), {_PART}) + i "
        "THEN get(carry, i) ELSE x END)"
    )).drop("part", "carry")


def dictionary(words: DataFrame) -> DataFrame:
    """(id, word, n, down, up, new): the nodes of all beginnings and of all endings of each word, the shortest first.

    ``id`` is the node of the whole word, in code-point order of the words; ``new`` marks one position of each run of equal
    code points, since skipping any of them leaves the same string.
    """
    down = trie_rows(words, "word").select("word", "n", F.col("nodes").alias("down"), "new")
    up = trie_rows(words.select(F.reverse("word").alias("drow")), "drow")
    both = down.join(up.select(F.reverse("drow").alias("word"), F.col("nodes").alias("up")), "word")
    return both.select(F.expr("get(down, size(down) - 1)").alias("id"), "word", "n", "down", "up", "new")


def pair_rows(known: DataFrame) -> DataFrame:
    """(p, s, id, n, skips, new): a row for each place where a word of the dictionary is cut, and for each position it skips."""
    last = "size(down) - 1"
    places = f"""
      concat(
        transform(down, (x, i) -> named_struct('p', x, 's', get(up, {last} - i), 'skips', false, 'new', true)),
        transform(new, (x, i) -> named_struct('p', get(down, i), 's', get(up, {last} - 1 - i), 'skips', true, 'new', x)))"""
    return known.select("id", "n", F.explode(F.expr(places)).alias("e")).select("e.p", "e.s", "id", "n", "e.skips", "e.new")


def near_words(known: DataFrame) -> DataFrame:
    """(id, n_near, best): of every word with a near one, how many it has, and (-n, id) of the most frequent, then smallest."""
    member = "struct(-n AS m, id, skips, new)"
    groups = pair_rows(known).groupBy("p", "s").agg(F.array_sort(F.collect_list(F.expr(member))).alias("all"))
    groups = groups.where("size(all) > 1 AND exists(all, x -> x.skips)")
    others = "filter(all, y -> y.id <> x.id AND CASE WHEN x.skips AND y.skips THEN true WHEN x.skips THEN x.new ELSE y.skips AND y.new END)"
    met = groups.select(F.explode(F.expr(f"transform(all, x -> struct(x.id AS id, {others} AS near))")).alias("x")).where("size(x.near) > 0")
    met = met.select("x.id", F.size("x.near").alias("many"), F.expr("struct(get(x.near, 0).m AS m, get(x.near, 0).id AS id)").alias("best"))
    return met.groupBy("id").agg(F.sum("many").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root): where the links id -> form end. Each round doubles the distance seen; links lead to ever greater counts."""
    paths = cut(forms.select("id", F.col("form").alias("root")))
    while True:
        on = paths.select(F.col("id").alias("root"), F.col("root").alias("further"))
        longer = cut(paths.join(on, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        paths = longer.select("id", "root")
        if longer.where("moved").isEmpty():
            return paths


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every frequent word.

    Two words are near if one inserted, deleted or replaced code point makes one the other. The form is the near word with the largest
    n, of equal ones the first in code-point order, if its n is at least ``ratio`` times the word's. Null and empty texts hold no
    words; a null doc_id hashes like an empty one; repeated rows count each time. Other columns are not read. An empty table gives
    no rows.
    """
    known = cut(dictionary(cut(vocabulary(docs, least_length, least_count))))
    found = known.join(near_words(known), "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.expr(f"CASE WHEN -best.m >= {ratio} * n THEN best.id END").alias("form"),
    )
    found = cut(found)
    plain = found.where("form IS NULL").select(
        "word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", F.lit(None).cast("long").alias("form_n")
    )
    linked = found.where("form IS NOT NULL")
    of_form = found.select(F.col("id").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n"))
    of_root = found.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    named = linked.join(roots(linked), "id").join(of_form, "form").join(of_root, "root").select(
        "word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n"
    )
    return plain.unionByName(named)


def op13(docs: DataFrame) -> DataFrame:
    return variants(docs)


#: The same rows from strings with one code point left out, in DuckDB's SQL.
ORACLE_SQL = f"""
WITH crc AS MATERIALIZED (
  SELECT [list_reduce(list_prepend(x, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) FOR x IN range(256)] AS k),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(text, '{RUN}')), '{UPPER}', '{LOWER}') AS run
  FROM documents),
counted AS (
  SELECT run, d, count(*) AS n FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      regexp_extract_all(hex(encode(d || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda a, b: xor(a >> 8, k[1 + (xor(a, b) & 255)])), 4294967295::BIGINT) AS h
  FROM counted, crc),
results AS (
  SELECT CASE WHEN h % {EVERY} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
  FROM hashed),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM results WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
less AS (
  SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT l.word, l.n, w.word, w.n FROM less l JOIN words w ON l.rest = w.word
  UNION SELECT w.word, w.n, l.word, l.n FROM less l JOIN words w ON l.rest = w.word),
best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form,
    CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
chains AS (
  WITH RECURSIVE c AS (
    SELECT word, word AS at FROM formed
    UNION ALL SELECT c.word, f.form FROM c JOIN formed f ON c.at = f.word WHERE f.form IS NOT NULL)
  SELECT c.word, c.at AS root FROM c JOIN formed f ON c.at = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN chains USING (word)
"""
