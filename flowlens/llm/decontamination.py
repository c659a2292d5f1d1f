"""Benchmark decontamination by template canonicalisation.

Numbers, capitalised words and units after a number become typed placeholders, so a question with other names and quantities
has the same template. Windows of five template tokens of the benchmark are looked up in the windows of all documents; a
document holds an item if 0.8 or more of the item's windows occur in it, and if the slots agree: along each alignment that counts,
the values of the item and those of the document, at every position of its windows, stand for one another one to one.

A template window needs two words of its own, or it would fit everywhere. An item without such a window, be it short or all
numbers and names, is looked up by its plain tokens instead: windows of five, or the whole item where it is shorter.
Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.bits import sieve
from flowlens.operators.storage import cut

WINDOW = 5
SHARE = 0.8
LEAST_WORDS = 2
SLOTS = 1 << 18
TOKEN = r"[\p{L}\p{M}]+|[0-9]+(?:[.,][0-9]+)*"
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "ton", "tons",
    "ounce", "ounces", "pound", "pounds", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "second",
    "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "percent", "degree", "degrees", "dollar", "dollars", "euro", "euros", "cent", "cents", "volt", "volts", "watt", "watts",
)
_UNITS = ", ".join(f"'{u}'" for u in UNITS)
#: The template token of token w at position i of ``tokens``.
TEMPLATE = f"""
  CASE WHEN ascii(w) BETWEEN 48 AND 57 THEN '<num>'
    WHEN i > 0 AND lower(w) IN ({_UNITS}) AND ascii(get(tokens, i - 1)) BETWEEN 48 AND 57 THEN '<unit>'
    WHEN substring(w, 1, 1) <> lower(substring(w, 1, 1)) THEN '<name>'
    ELSE w END"""


def windows(rows: DataFrame, key: str, widths: list[int], text: str = "text") -> DataFrame:
    """(key, tokens, codes, wins): the tokens of every text, and its windows (at, size, h): five template tokens (size 0), and
    plain tokens of each of the ``widths``."""
    tokens = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0))

    def kind(source: str, width: int, size: int) -> str:
        each = ", ".join(f"get({source}, i + {k})" for k in range(width))
        made = f"named_struct('at', i, 'size', {size}, 'h', xxhash64({size}, {each}))"
        none = "CAST(array() AS array<struct<at:int,size:int,h:bigint>>)"
        return f"CASE WHEN size(tokens) >= {width} THEN transform(sequence(0, size(tokens) - {width}), i -> {made}) ELSE {none} END"

    kinds = [kind("codes", WINDOW, 0), *(kind("tokens", w, w) for w in widths)]
    return (
        rows.select(F.col(key).cast("long").alias(key), tokens.alias("tokens"))
        .withColumn("codes", F.expr(f"transform(tokens, (w, i) -> {TEMPLATE})"))
        .withColumn("wins", F.expr(f"concat({', '.join(kinds)})"))
    )


def _words(of: str) -> str:
    return f"slice(tokens, {of}.at + 1, CASE WHEN {of}.size = 0 THEN {WINDOW} ELSE {of}.size END)"


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, ipos, h, its, n): the windows to look up, with their tokens; n is how many the item has."""
    rows = windows(benchmark, "item_id", list(range(1, WINDOW + 1)))
    rows = rows.withColumn("own", F.expr("transform(zip_with(tokens, codes, (w, c) -> w = c), x -> CAST(x AS INT))"))
    good = f"filter(wins, x -> x.size = 0 AND aggregate(slice(own, x.at + 1, {WINDOW}), 0, (a, v) -> a + v) >= {LEAST_WORDS})"
    rows = rows.withColumn("good", F.expr(good)).withColumn("used", F.expr(
        f"CASE WHEN size(good) > 0 THEN good ELSE filter(wins, x -> x.size = least(size(tokens), {WINDOW})) END"))
    placed = rows.select("item_id", "tokens", F.explode("used").alias("x")).select(
        "item_id", F.col("x.at").alias("ipos"), "x.size", "x.h", F.expr(_words("x")).alias("its"))
    count = rows.groupBy("item_id").agg(F.max(F.size("used")).alias("n"))
    return placed.distinct().join(count, "item_id")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, shift, ipos, n, its, words): all windows that a document shares with an item, and both sides' tokens."""
    items = cut(item_windows(benchmark))
    widths = sorted(r[0] for r in items.select("size").where("size > 0").distinct().collect())  # five numbers at most
    passes = sieve(items.select("h"), SLOTS)
    found = windows(docs, "doc_id", widths).select("doc_id", "tokens", F.explode(F.expr(f"filter(wins, x -> {passes('x.h')})")).alias("x"))
    mine = found.select("doc_id", F.col("x.at").alias("dpos"), "x.h", F.expr(_words("x")).alias("words"))
    return mine.join(items.drop("size"), "h").withColumn("shift", F.col("dpos") - F.col("ipos"))


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, share, verbatim): the benchmark items that each document holds.

    ``share`` is the part of the item's windows found along consistent alignments; ``verbatim`` tells whether all tokens of them
    are the item's own. Null and empty texts match nothing, nor do items without a token. Repeated rows give one row, as do
    repeated items. Rows with a null id are left out. Other columns are not read. Empty tables give no rows.
    """
    found = cut(matches(docs.where("doc_id IS NOT NULL"), benchmark.where("item_id IS NOT NULL")))
    keys = ["doc_id", "item_id", "shift"]
    pairs = found.select(*keys, F.explode(F.expr("zip_with(its, words, (a, b) -> named_struct('a', a, 'b', b))")).alias("s"))
    sides = pairs.groupBy(*keys).agg(  # as many values as the item has tokens, at most
        F.size(F.collect_set("s")).alias("pairs"), F.size(F.collect_set("s.a")).alias("ours"),
        F.size(F.collect_set("s.b")).alias("theirs"), F.bool_and(F.col("s.a") == F.col("s.b")).alias("same"),
    )
    agreed = sides.where("pairs = ours AND pairs = theirs").select(*keys, "same")
    held = found.select(*keys, "ipos", "n").join(agreed, keys)
    once = held.groupBy("doc_id", "item_id", "ipos").agg(F.max("n").alias("n"), F.bool_or("same").alias("same"))
    total = once.groupBy("doc_id", "item_id").agg(
        (F.count(F.lit(1)) / F.max("n")).alias("share"), F.bool_and("same").alias("verbatim")
    )
    return total.where(F.col("share") >= share)


def op3(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark).select("doc_id", "item_id", F.round("share", 6).alias("share"), "verbatim")


#: The same rule in DuckDB's SQL: token lists, windows compared as lists, and every aligned position compared as a row.
ORACLE_SQL = f"""
WITH texts AS (
  SELECT DISTINCT 0 AS side, doc_id AS id, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS tokens
  FROM documents WHERE doc_id IS NOT NULL
  UNION SELECT 1, item_id, regexp_extract_all(coalesce(text, ''), '{TOKEN}') FROM benchmark WHERE item_id IS NOT NULL),
words AS (
  SELECT side, id, tokens, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS i FROM texts),
coded AS MATERIALIZED (
  SELECT *, CASE WHEN w[1] BETWEEN '0' AND '9' THEN '<num>'
    WHEN i > 1 AND lower(w) IN ({_UNITS}) AND tokens[i - 1][1] BETWEEN '0' AND '9' THEN '<unit>'
    WHEN w[1] <> lower(w[1]) THEN '<name>' ELSE w END AS t
  FROM words),
templated AS (
  SELECT side, id, tokens, i, list(t) OVER f AS win, sum(CASE WHEN t = w THEN 1 ELSE 0 END) OVER f AS own
  FROM coded WINDOW f AS (PARTITION BY side, id, tokens ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
good AS (
  SELECT id, i, 0 AS size, win FROM templated WHERE side = 1 AND len(win) = {WINDOW} AND own >= {LEAST_WORDS}),
plain AS (
  SELECT id, i, least(len(tokens), {WINDOW}) AS size, tokens[i:i + least(len(tokens), {WINDOW}) - 1] AS win FROM words
  WHERE side = 1 AND id NOT IN (SELECT id FROM good) AND i <= len(tokens) - least(len(tokens), {WINDOW}) + 1),
items AS MATERIALIZED (
  SELECT *, count(*) OVER (PARTITION BY id) AS n FROM (SELECT * FROM good UNION ALL SELECT * FROM plain)),
asked AS (
  SELECT id, i, 0 AS size, win FROM templated WHERE side = 0 AND len(win) = {WINDOW}
  UNION ALL SELECT w.id, w.i, s.size, w.tokens[w.i:w.i + s.size - 1]
  FROM words w JOIN (SELECT DISTINCT size FROM items WHERE size > 0) s ON w.i + s.size - 1 <= len(w.tokens) WHERE w.side = 0),
hits AS MATERIALIZED (
  SELECT d.id AS doc_id, m.id AS item_id, d.i - m.i AS shift, m.i AS ipos, m.n, len(m.win) AS width
  FROM asked d JOIN items m ON d.size = m.size AND d.win = m.win),
places AS (
  SELECT DISTINCT doc_id, item_id, shift, ipos + unnest(range(width)) AS i FROM hits),
met AS (
  SELECT doc_id, item_id, shift, a.w AS a, b.w AS b FROM places p
  JOIN words a ON a.side = 1 AND a.id = p.item_id AND a.i = p.i
  JOIN words b ON b.side = 0 AND b.id = p.doc_id AND b.i = p.i + p.shift),
agreed AS (
  SELECT doc_id, item_id, shift, bool_and(a = b) AS same FROM met GROUP BY ALL
  HAVING count(DISTINCT (a, b)) = count(DISTINCT a) AND count(DISTINCT (a, b)) = count(DISTINCT b)),
once AS (
  SELECT doc_id, item_id, ipos, max(n) AS n, bool_or(same) AS same FROM hits JOIN agreed USING (doc_id, item_id, shift)
  GROUP BY ALL)
SELECT doc_id, item_id, round(count(*) / max(n), 6) AS share, bool_and(same) AS verbatim
FROM once GROUP BY doc_id, item_id HAVING count(*) / max(n) >= {SHARE}
"""
