"""Personal data, and the words around it that give it away.

Entities are found by rules. How strongly a term t reveals an entity e is estimated from the corpus: with the information
content IC(e) = -log p(e) and the pointwise mutual information PMI(t; e), the disclosed share of e is PMI(t; e) / IC(e),
which is one exactly if t never occurs without e. Terms anywhere in a text with an entity that disclose more than a threshold, seen
together in enough different texts, are generalised; those that disclose all of it are removed. Probabilities are shares of all
documents; the support that a pair needs counts different texts. Built-in functions only.

Pairs are formed only where they can pass, which loses none: both sides need the support by themselves, and as no pair is in more
documents than its entity, the disclosed share is at most log p(t) / log p(e). So a term of a pair is in at most N p(e)^threshold of
the N documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.bits import sieve
from flowlens.llm.spans import SPAN, Rule, digest_text, listed, locate, replaced
from flowlens.operators.storage import cut

_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_DIGITS = "translate(s.value, translate(s.value, '0123456789', ''), '')"
_LUHN = (
    f"aggregate(sequence(1, length({_DIGITS})), 0, (acc, i) -> acc + get(array(0, 1, 2, 3, 4, 5, 6, 7, 8, 9, "
    f"0, 2, 4, 6, 8, 1, 3, 5, 7, 9), CAST(substring({_DIGITS}, -i, 1) AS INT) + 10 * ((i - 1) % 2)))"
)
#: Fixed values of the contract, with possessive repeats and run starts so that long runs cost linear time.
RULES = [
    Rule(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        needs="@",
    ),
    Rule(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        keep=rf"s.value RLIKE '^{_BYTE}(?:[.]{_BYTE}){{3}}$'", needs=".",
    ),
    Rule(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        keep=f"CASE WHEN length({_DIGITS}) BETWEEN 13 AND 19 THEN {_LUHN} % 10 = 0 ELSE false END",
    ),
    Rule(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        keep=f"length({_DIGITS}) BETWEEN 9 AND 15", needs="+",
    ),
]
KINDS = [r.kind for r in RULES]
WORD = r"\p{L}{3,}"
THRESHOLD = 0.9
SUPPORT = 3


def entities(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) and an array of spans for each kind of entity."""
    body = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"), F.sha2(body, 256).alias("digest"))
    return locate(rows, RULES).drop("text")


def holders(marked: DataFrame, support: int) -> DataFrame:
    """(entity, digest, spans, copies, n_entity): the texts of each entity that is in enough of them, and in how many documents it is.

    ``spans`` are its places in the text, ``copies`` the documents with this text.
    """
    with_any = marked.where(" + ".join(f"size({k})" for k in KINDS) + " > 0")
    copies = with_any.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    each = with_any.select("digest", F.explode(listed(KINDS, by_start=False)).alias("e")).select(
        F.concat_ws(":", "e.kind", F.lower("e.value")).alias("entity"), "digest", F.struct("e.start", "e.end").alias("span")
    )
    held = each.groupBy("entity", "digest").agg(F.collect_set("span").alias("spans")).join(copies, "digest")
    counts = held.groupBy("entity").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("n_entity"))
    return cut(held.join(counts.where(F.col("texts") >= support).drop("texts"), "entity"))


def document_counts(docs: DataFrame, least: int, most: float) -> DataFrame:
    """(term, n_term): in how many documents each word occurs, for the words in ``least`` to ``most`` of them."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0)))
    each = docs.select(F.explode(words).alias("term"))
    return cut(each.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).where(F.col("n_term").between(least, most)))


def mentions(docs: DataFrame, held: DataFrame, counted: DataFrame) -> DataFrame:
    """(digest, term, n_term, start, end): each place of a counted term in a text that holds an entity, once per text.

    Bit tables of fixed size, from the hashes of the texts and terms, drop most others inside the scan; what passes joins exactly.
    """
    a_text = sieve(held.select(F.xxhash64("digest").alias("h")))
    a_term = sieve(counted.select(F.xxhash64("term").alias("h")))
    body = F.coalesce("text", F.lit(""))
    rows = docs.select(body.alias("text"), F.sha2(body, 256).alias("digest")).where(a_text("xxhash64(digest)"))
    named = "transform(word, w -> named_struct('term', lower(w.value), 'start', w.start, 'end', w.end))"
    words = locate(rows, [Rule("word", WORD)]).select(
        "digest", F.explode(F.expr(f"filter({named}, w -> {a_term('xxhash64(w.term)')})")).alias("w")
    )
    return words.select("digest", "w.*").distinct().join(counted, "term")


def together(places: DataFrame, held: DataFrame, total: int, threshold: float) -> DataFrame:
    """(entity, term, digest, start, end, copies, n_term, n_entity): terms with each entity of their text that they may disclose."""
    most = F.pow(F.col("n_entity") / F.lit(float(max(total, 1))), F.lit(threshold)) * F.lit(total * (1 + 1e-9))
    outside = F.expr("exists(spans, s -> end <= s.start OR start >= s.end)")
    return places.join(held.where(F.col("n_entity") < total), "digest").where((F.col("n_term") <= most) & outside).drop("spans")


def disclosing(near: DataFrame, total: int, threshold: float, support: int) -> DataFrame:
    """(entity, term, disclosed) of the terms whose disclosed share of an entity in their texts is at least the threshold."""
    each = near.select("entity", "term", "digest", "copies", "n_term", "n_entity").distinct()
    pairs = each.groupBy("entity", "term", "n_term", "n_entity").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("n_both")
    )
    share = (F.log(F.col("n_both") * F.lit(float(total))) - F.log(F.col("n_term") * F.col("n_entity").cast("double"))) / -F.log(
        F.col("n_entity") / F.lit(float(max(total, 1)))
    )
    return (
        pairs.where(F.col("texts") >= support)
        .select("entity", "term", share.alias("disclosed")).where(F.col("disclosed") >= threshold)
    )


def protect(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """(doc_id, digest, email, ip, card, phone, term): the spans of every row; ``term`` has the added ones.

    The ``value`` of a term span is ``generalise`` or ``remove``. Null and empty texts have no spans. Repeated rows stay
    repeated and get the same spans. A null doc_id is kept. Other columns,
    whatever their names, are not read. An empty table gives no rows.
    """
    marked = cut(entities(docs))
    total = marked.count()
    held = holders(marked, support)
    widest = held.where(F.col("n_entity") < total).agg(F.max("n_entity")).first()[0]
    most = total * (widest / total) ** threshold * (1 + 1e-9) if widest else 0.0
    near = cut(together(mentions(docs, held, document_counts(docs, support, most)), held, total, threshold))
    told = disclosing(near, total, threshold, support)
    added = near.join(told, ["entity", "term"]).groupBy("digest", "start", "end").agg(F.max("disclosed").alias("most"))
    deed = F.when(F.col("most") >= 1 - 1e-9, "remove").otherwise("generalise")
    per_text = cut(
        added.groupBy("digest").agg(
            F.array_sort(F.collect_list(F.struct("start", "end", deed.alias("value")))).cast(f"array<{SPAN}>").alias("term")
        )
    )
    return marked.join(per_text, "digest", "left").withColumn("term", F.coalesce("term", F.array().cast(f"array<{SPAN}>")))


def sanitised(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text): the whole text of every row with its entities and generalised terms replaced, removed terms gone.

    Spans that overlap are replaced together, under the label of the one that starts first (then of the kind listed first).
    """
    body = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"), F.sha2(body, 256).alias("digest"))
    each = spans.select("digest", listed([*KINDS, "term"], by_start=True).alias("all")).dropDuplicates(["digest"])
    label = "CASE WHEN s.value = 'remove' AND s.kind = 'term' THEN '' ELSE concat('<', upper(s.kind), '>') END"
    new = replaced("text", "all", label)
    return rows.join(each, "digest", "left").select(
        "doc_id", F.when(F.col("all").isNull(), F.col("text")).otherwise(new).alias("text")
    )


def _count(kind: str) -> Column:
    return F.size(kind).cast("long").alias(f"n_{kind}")


def op10(docs: DataFrame) -> DataFrame:
    marked = protect(docs).withColumn("base", listed(KINDS, by_start=False)).withColumn(
        "every", listed([*KINDS, "term"], by_start=False)
    )
    return marked.select(
        "doc_id", *map(_count, KINDS), F.sha2(digest_text("base"), 256).alias("base_sha256"),
        digest_text("every").alias("spans"), _count("term"),
    )
