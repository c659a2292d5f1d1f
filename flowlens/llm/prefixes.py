"""The prefix trie of conversations by van Emde Boas recursion.

Sequences of turns are cut at half depth. The name of a cut prefix is made from the name of its own root and the content of the
cut half, and it is the root of a lower trie; the upper trie and all lower ones are cut at their half depth in the same round,
until single turns are left, whose names are the nodes. Content names of the halves come from the same tree, read upwards.
Segments of ``PIECE`` turns run through their rounds inside one row; longer conversations take a join per halving above
that, on (conversation, segment), so a conversation of any length is spread over as many rows as it has segments.

A node belongs to its smallest member. Each conversation sums what its own nodes hold from the bottom up inside a segment; the totals
of the segments, halved upwards again, are grafted on the segments before, and one sum over members by node gives the totals of subtrees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.llm.common import spread
from flowlens.operators.skew import spread_join
from flowlens.operators.storage import cut

FAMILY = 20
SHARES = 4
PIECE = 32
SALTS = 64
ENDS_BITS = 8
WORD = r"[^\x20\x09-\x0D]+"
_ROOT = "unhex('00')"


def _name(*parts: str) -> str:
    """128 bits of SHA-256 over binary parts of known length; null where a part is null."""
    return f"substring(unhex(sha2(concat({', '.join(parts)}), 256)), 1, 16)"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, sym, words, part, at): every turn of every conversation, its content name, word count and place in a global order.

    Places come from one sort of all narrow rows, so no conversation has to fit a task. Equal turn numbers are ordered by
    role, then content name.
    """
    role, text = "coalesce(role, '')", "coalesce(text, '')"
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.expr(role).alias("role"),
        F.expr(_name(f"CAST(concat(length({role}), ':', {role}, {text}) AS BINARY)")).alias("sym"),
        F.regexp_count(F.expr(text), F.lit(WORD)).cast("long").alias("words"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "sym"]
    dealt = rows.repartitionByRange(spread(rows.sparkSession), *order).sortWithinPartitions(*order)
    return cut(dealt.select(
        "conv_id", "sym", "words", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")
    ))


def rebuilt(conversations: DataFrame, family: int = FAMILY, shares: int = SHARES) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, sym, words) of the rebuilt turns, and (conv_id, length) of every conversation, turnless ones too."""
    numbered = turns(conversations)
    held = numbered.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    held = held.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
    whole = held.groupBy("conv_id").agg(F.sum("n").alias("n")).select(
        "conv_id", "n", F.expr(f"conv_id - conv_id % {family}").alias("base"),
        F.expr(f"crc32(CAST(CAST(conv_id AS STRING) AS BINARY)) % {shares}").alias("h"),
    )
    whole = cut(whole)
    bases = whole.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    known = cut(whole.join(bases, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("k"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("own")
    ))
    placed = numbered.join(held.join(known, "conv_id").select("conv_id", "part", "first", "off", "h", "k"), ["conv_id", "part"])
    placed = placed.withColumn("pos", F.expr("at - first + off"))
    own = placed.where("pos >= h").select("conv_id", F.expr("pos - h + k").alias("pos"), "sym", "words")
    heads = placed.where(f"conv_id % {family} = 0 AND pos < {shares - 1}").select(F.col("conv_id").alias("base"), "pos", "sym", "words")
    given = known.where("k > 0").join(heads, "base").where("pos < k").select("conv_id", "pos", "sym", "words")
    return cut(own.unionByName(given)), cut(known.select("conv_id", F.expr("k + own").alias("length")))


def named(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv_id, depth, node, words) of all prefixes but the empty one, from (conv_id, pos, sym, words)."""
    pieces = cut(rows.groupBy("conv_id", F.expr(f"pos div {piece}").alias("j")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "sym", "words"))).alias("t")
    ).select("conv_id", "j", "t.sym", "t.words"))
    content = ["sym"]
    levels = piece.bit_length() - 1
    for k in range(levels):  # halves inside a row, upwards
        last = content[-1]
        pair = _name(f"get({last}, 2 * i)", f"get({last}, 2 * i + 1)")
        pieces = pieces.withColumn(f"b{k + 1}", F.expr(
            f"CASE WHEN size({last}) > 1 THEN transform(sequence(0, size({last}) div 2 - 1), i -> {pair}) ELSE CAST(array() AS array<binary>) END"
        ))
        content.append(f"b{k + 1}")
    top = pieces.where(f"size(sym) = {piece}").select("conv_id", "j", F.expr(f"get({content[-1]}, 0)").alias("b"))
    roots = _roots(top, pieces.select("conv_id", "j"))
    after = roots.select("conv_id", (F.col("j") - 1).alias("j"), F.col("root").alias("next"))
    wide = pieces.join(roots, ["conv_id", "j"]).join(after, ["conv_id", "j"], "left")
    wide = wide.withColumn("r", F.array("root"))
    for k in range(levels, 0, -1):  # cut prefixes inside a row, downwards; a half that is not full has no name
        lower = _name("x", f"get({content[k - 1]}, 2 * i)")
        wide = wide.withColumn("r", F.expr(f"filter(flatten(transform(r, (x, i) -> array(x, {lower}))), x -> x IS NOT NULL)"))
    wide = wide.withColumn("r", F.expr(f"CASE WHEN size(sym) = {piece} THEN concat(r, array(next)) ELSE r END"))
    return wide.select("conv_id", "j", F.posexplode(F.arrays_zip(F.slice("r", 2, F.size("sym")).alias("node"), "words")).alias("i", "e")).select(
        "conv_id", F.expr(f"j * {piece} + i + 1").alias("depth"), "e.node", "e.words"
    )


def _halves(blocks: DataFrame, joined: list[str]) -> DataFrame:
    """Neighbouring blocks of a conversation together: the columns of ``joined`` over l.* and r.*, where both are there."""
    even = blocks.where("j % 2 = 0").withColumn("j", F.expr("j div 2")).alias("l")
    odd = blocks.where("j % 2 = 1").withColumn("j", F.expr("j div 2")).alias("r")
    return even.join(odd, F.expr("l.conv_id = r.conv_id AND l.j = r.j")).selectExpr("l.conv_id", "l.j", *joined)


def _roots(full: DataFrame, pieces: DataFrame) -> DataFrame:
    """(conv_id, j, root): the name of what stands before piece j, for each piece and one after the last full one."""
    plain = pieces.where("j = 0").select("conv_id", "j", F.expr(_ROOT).alias("root"))
    most = full.agg(F.max("j")).first()[0]
    if most is None:
        return plain
    blocks = [cut(full)]
    rounds = (most + 1).bit_length()
    for _ in range(rounds - 1):
        blocks.append(cut(_halves(blocks[-1], [f"{_name('l.b', 'r.b')} AS b"])))
    roots = blocks[0].where("j = 0").select("conv_id", "j", F.expr(_ROOT).alias("root"))
    for k in range(rounds - 1, -1, -1):
        half = blocks[k].where("j % 2 = 0").select("conv_id", F.expr("j div 2").alias("j"), "b")
        both = f"array(struct(2 * j AS j, root AS root), struct(2 * j + 1 AS j, {_name('root', 'b')} AS root))"
        roots = cut(roots.join(half, ["conv_id", "j"], "left").select("conv_id", F.explode(F.expr(both)).alias("e")).select(
            "conv_id", "e.j", "e.root").where("root IS NOT NULL"))
    return plain.unionByName(roots.where("j > 0"))


def _after(sums: DataFrame) -> DataFrame:
    """(conv_id, j, leaves_after, saved_after): what the segments after segment j hold, by the same halving."""
    most = sums.agg(F.max("j")).first()[0] or 0
    blocks = [sums]
    for _ in range(max(most.bit_length() - 1, 0)):
        blocks.append(cut(blocks[-1].groupBy("conv_id", F.expr("j div 2").alias("j")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))))
    after = sums.where("j = 0").select("conv_id", "j", F.lit(0).cast("long").alias("leaves_after"), F.lit(0).cast("long").alias("saved_after"))
    for k in range(most.bit_length() - 1, -1, -1):
        odd = blocks[k].where("j % 2 = 1").select("conv_id", F.expr("j div 2").alias("j"), "leaves", "saved")
        both = """array(
          struct(2 * j AS j, leaves_after + coalesce(leaves, 0) AS leaves_after, saved_after + coalesce(saved, 0) AS saved_after),
          struct(2 * j + 1 AS j, leaves_after, saved_after))"""
        met = after.join(odd, ["conv_id", "j"], "left").withColumn("e", F.explode(F.expr(both)))
        after = cut(met.where("e.j % 2 = 0 OR leaves IS NOT NULL").select("conv_id", "e.*"))
    return after


def _digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of the nodes where conversations end, from (conv_id, depth, member).

    SHA-256 reads its input in order, so the ids of one node stream through one task, in runs that were joined before.
    """
    runs = ends.groupBy("conv_id", "depth", F.shiftright("member", ENDS_BITS).alias("run")).agg(
        F.expr("array_join(transform(array_sort(collect_list(member)), x -> CAST(x AS STRING)), ',')").alias("ids")
    )
    dealt = runs.repartition(spread(ends.sparkSession), "conv_id", "depth").sortWithinPartitions("conv_id", "depth", "run")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            made: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids")]
            for conv, depth, ids in zip(*columns, strict=True):
                if (conv, depth) == node:
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    made.append((*node, state.hexdigest()))
                node, state = (conv, depth), hashlib.sha256(ids.encode())
            yield _rows(made)
        if node is not None:
            yield _rows([(*node, state.hexdigest())])

    return dealt.select("conv_id", "depth", "ids").mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def _rows(made: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*made, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
        names=["conv_id", "depth", "ends_sha256"],
    )


def trie(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations: (conv_id, depth) name it, totals are of its subtree.

    Null roles and texts count as empty, a null turn comes first, turns of equal number are ordered by role and content; repeated
    rows are turns of their own. Rows without a conv_id belong to no conversation. Other columns are not read. An empty table has
    no conversation, hence no node. ``piece`` is a power of two: the height of the segments that run inside one row.
    """
    rows, lengths = rebuilt(conversations)
    root = lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), F.expr(_ROOT).alias("node"), F.lit(0).cast("long").alias("words"))
    paths = cut(named(rows, piece).unionByName(root).withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS))))
    owners = cut(paths.groupBy("node").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs")))
    paths = cut(spread_join(paths, owners, "node", piece="salt").select("conv_id", "depth", "words", "owner", "n_convs"))
    own = paths.where("conv_id = owner").select("conv_id", "depth", "words", "n_convs")
    above = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent_conv_id"))
    own = cut(own.join(above, ["conv_id", "depth"], "left"))
    below = own.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = cut(own.join(below, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saves"),
    ))
    held = paths.select("conv_id", "depth", "owner").join(nodes.select("conv_id", "depth", "n_children", "saves"), ["conv_id", "depth"], "left")
    held = cut(held.select(
        "conv_id", F.expr(f"depth div {piece}").alias("j"), "depth", "owner",
        F.expr("CAST(coalesce(n_children = 0, false) AS BIGINT)").alias("leaf"), F.coalesce("saves", F.lit(0)).alias("saves"),
    ))
    sums = cut(held.groupBy("conv_id", "j").agg(F.sum("leaf").alias("leaves"), F.sum("saves").alias("saved")))
    upwards = W.partitionBy("conv_id", "j").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    grafted = held.withColumns({"leaves": F.sum("leaf").over(upwards), "saved": F.sum("saves").over(upwards)}).join(
        _after(sums), ["conv_id", "j"]
    ).select(
        F.col("owner").alias("conv_id"), "depth", (F.col("leaves") + F.col("leaves_after")).alias("leaves"),
        (F.col("saved") + F.col("saved_after")).alias("saved"),
    ).where("leaves > 0 OR saved > 0")
    totals = grafted.groupBy("conv_id", "depth").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    at_end = paths.join(lengths.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"])
    digests = _digests(at_end.select(F.col("owner").alias("conv_id"), "depth", F.col("conv_id").alias("member")))
    return nodes.join(totals, ["conv_id", "depth"], "left").join(digests, ["conv_id", "depth"], "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children",
        F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op12(conversations: DataFrame) -> DataFrame:
    return trie(conversations)


#: The same rows from lists of whole turns, in DuckDB's SQL.
ORACLE_SQL = f"""
WITH crc AS MATERIALIZED (
  SELECT [list_reduce(list_prepend(x, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) FOR x IN range(256)] AS k),
said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, conv_id - conv_id % {FAMILY} AS base
  FROM conversations WHERE conv_id IS NOT NULL),
whole AS MATERIALIZED (
  SELECT conv_id, any_value(base) AS base, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, role,
    sha256(length(role) || ':' || role || text)) AS turns
  FROM said GROUP BY conv_id),
hashed AS (
  SELECT conv_id, base, turns, xor(list_reduce(list_prepend(4294967295::BIGINT,
      [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]),
    lambda a, b: xor(a >> 8, k[1 + (xor(a, b) & 255)])), 4294967295::BIGINT) % {SHARES} AS h
  FROM whole, crc),
built AS MATERIALIZED (
  SELECT c.conv_id, list_concat(coalesce(b.turns[:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM hashed c LEFT JOIN whole b ON b.conv_id = c.base),
paths AS MATERIALIZED (
  SELECT conv_id, d AS depth, turns[:d] AS node, d = len(turns) AS ends,
    CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(turns[d].t, '[^\x20\x09-\x0D]+')) END AS words
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM built)),
nodes AS MATERIALIZED (
  SELECT node, depth, min(conv_id) AS owner, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saves,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM paths GROUP BY node, depth),
linked AS MATERIALIZED (
  SELECT n.*, p.owner AS parent FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.node = n.node[:n.depth - 1]),
children AS (
  SELECT parent AS owner, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL),
marked AS MATERIALIZED (
  SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN children c ON l.owner = c.owner AND l.depth = c.depth),
totals AS (
  SELECT a.node, a.depth, sum(u.saves)::BIGINT AS saved_tokens, count(*) FILTER (u.n_children = 0) AS n_leaves
  FROM marked u JOIN paths a ON a.conv_id = u.owner AND a.depth <= u.depth GROUP BY ALL)
SELECT owner AS conv_id, m.depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM marked m JOIN totals t ON m.depth = t.depth AND m.node = t.node
"""
