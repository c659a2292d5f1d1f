"""URL verdicts: rules first, then logistic regression on hashed character n-grams of host and path.

A rule names a host and the beginning of a path; it fits the host and all its subdomains, and the longest fitting rule decides. URLs
that no rule fits are judged by a model. It learns from a small table of labelled URLs; where none is given, from a bounded
sample of the URLs that the rules decide.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import mixed, slices, utf8

#: Fixed values of the contract: rule (host and path), verdict.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAMS = (2, 3, 4, 5)
BITS = 18
SAMPLE_ROWS = 10_000
SLICE = 1 << 18
_SALT = np.uint64(0x9FB21C651E98DF25)


def parts(pages: DataFrame, *others: str) -> DataFrame:
    """The columns ``others``, then (host, path) of every url; both are empty where it is null or has no ``://``."""
    rest = "CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END"
    host, path = (F.regexp_extract(F.expr(rest), "^([^/?#]*)([^?#]*)", i) for i in (1, 2))
    return pages.select(*others, F.translate(host, UPPER, LOWER).alias("host"), path.alias("path"))


def rule_of(rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest of ``rules`` that fits (host, path), as struct<size, rule, verdict>, or null.

    The rules are a list of the caller and stand in the plan, by host. A url looks up only as many endings of its host as the
    deepest rule has labels, so neither a long host nor a long list costs more than a few look-ups.
    """
    by_host: dict[str, list[Column]] = {}
    for rule, verdict in rules:
        host, slash, rest = rule.partition("/")
        by_host.setdefault(host, []).append(F.struct(
            F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(slash + rest).alias("path"),
        ))
    if not by_host:
        return F.expr("CAST(NULL AS struct<size:int,rule:string,verdict:string,path:string>)")
    listed = F.create_map(*[c for host, own in by_host.items() for c in (F.lit(host), F.array(*own))])
    deepest = max(host.count(".") + 1 for host in by_host)
    endings = F.array_distinct(F.array(*[F.substring_index("host", ".", -i) for i in range(1, deepest + 1)]))
    there = F.filter(F.transform(endings, lambda h: F.try_element_at(listed, h)), lambda r: r.isNotNull())
    return F.array_max(F.filter(F.flatten(there), lambda r: F.startswith(F.col("path"), r["path"])))


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of all character n-grams, of host and path apart; a mark stands before and after each."""
    buckets, rows = [], []
    for field, column in enumerate((hosts, paths)):
        data, ends = utf8(column)
        n = len(ends)
        starts = np.concatenate(([0], ends[:-1]))
        size = ends - starts
        marked = np.ones(len(data) + 2 * n, np.uint64)  # byte 1 marks the borders
        owner = np.repeat(np.arange(n), size + 2)
        inner = np.arange(len(data)) + 2 * np.repeat(np.arange(n), size) + 1
        marked[inner] = data
        for k in GRAMS:
            many = len(marked) - k + 1
            if many <= 0:
                continue
            same = owner[:many] == owner[k - 1:]
            code = np.full(many, np.uint64(k * 2 + field))
            for j in range(k):
                code = code * _SALT + marked[j:many + j] + np.uint64(1)
            buckets.append((mixed(code[same]) >> np.uint64(64 - BITS)).astype(np.int64))
            rows.append(owner[:many][same])
    return np.concatenate(buckets or [np.empty(0, np.int64)]), np.concatenate(rows or [np.empty(0, np.int64)])


def logits(model: Model, bucket: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """The linear score of each row; its n-grams share a length of one."""
    many = np.maximum(np.bincount(row, minlength=n), 1)
    return model.bias + np.bincount(row, model.weights[bucket], n) / np.sqrt(many)


def fit(hosts: list[str], paths: list[str], block: Sequence[int], epochs: int = 30, rate: float = 0.5, decay: float = 1e-5) -> Model:
    """AdaGrad on the logistic loss, in small batches of a fixed order; no rows give a model that allows everything."""
    model = Model(np.zeros(1 << BITS), 0.0 if len(hosts) else -1.0)
    y = np.asarray(block, float)
    bucket, row = features(pa.array(hosts, pa.string()), pa.array(paths, pa.string()))
    order = np.argsort(row, kind="stable")
    bucket, first = bucket[order], np.searchsorted(row[order], np.arange(len(hosts) + 1))
    squares, bias_square = np.full(1 << BITS, 1e-6), 1e-6
    random = np.random.default_rng(0)
    for _ in range(epochs):
        ids = random.permutation(len(hosts))
        for at in range(0, len(ids), 64):
            part = ids[at:at + 64]
            sizes = first[part + 1] - first[part]
            f = np.concatenate([bucket[first[i]:first[i + 1]] for i in part])
            r = np.repeat(np.arange(len(part)), sizes)
            scale = 1 / np.sqrt(np.maximum(sizes, 1))
            p = 1 / (1 + np.exp(-np.clip(model.bias + np.bincount(r, model.weights[f], len(part)) * scale, -50, 50)))
            pull = (p - y[part]) / len(part)
            hit, where = np.unique(f, return_inverse=True)
            step = np.bincount(where, (pull * scale)[r], len(hit)) + decay * model.weights[hit]
            squares[hit] += step * step
            model.weights[hit] -= rate * step / np.sqrt(squares[hit])
            total = float(pull.sum())
            bias_square += total * total
            model.bias -= rate * total / np.sqrt(bias_square)
    model.weights = model.weights.astype(np.float32)
    return model


def train(labelled: DataFrame, bound: int = SAMPLE_ROWS, key: str = "url") -> Model:
    """The model of at most ``bound`` rows of a table (url, verdict), chosen by a hash of ``key`` and url.

    Null urls and verdicts teach nothing.
    """
    rows = labelled.where("url IS NOT NULL AND verdict IS NOT NULL").select(
        "url", "verdict", F.xxhash64(F.col(key).cast("string"), "url").alias("order"))
    sample = parts(rows.orderBy("order", "url", "verdict").limit(bound), "verdict").collect()
    sample = sorted((r["host"], r["path"], int(r["verdict"] == "block")) for r in sample)
    return fit(*map(list, zip(*sample, strict=True))) if sample else fit([], [], [])


def score(split: DataFrame, model: Model) -> DataFrame:
    """``split`` (flat columns, host and path among them) and ``score``, how likely each url is one to block."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in split.schema), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (p for half in slices(batch, SLICE, "host") for p in slices(half, SLICE, "path")):
                linear = logits(model, *features(part.column("host"), part.column("path")), part.num_rows)
                p = 1 / (1 + np.exp(-np.clip(linear, -50, 50)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], names=[*part.schema.names, "score"])

    return split.mapInArrow(run, schema)


def judged(pages: DataFrame, labelled: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES, limit: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row: the verdict of the longest rule that fits, else the model's.

    ``labelled`` is a table (url, verdict) to learn from; without it the pages that rules decide are the teachers. A null url, or
    one without ``://``, has an empty host and path and is judged by the model. Repeated rows stay repeated, a null page_id is kept,
    other columns are not read, an empty table gives no rows; without any label the model allows everything.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    if labelled is None:
        ruled = parts(rows, "page_id", "url").withColumn("r", rule_of(rules)).where("r IS NOT NULL")
        model = train(ruled.select("page_id", "url", "r.verdict"), key="page_id")
    else:
        model = train(labelled)
    found = parts(rows, "page_id").withColumn("r", rule_of(rules)).select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("given"))
    learned = F.when(F.col("score") >= limit, "block").otherwise("allow")
    return score(found, model).select(
        "page_id", "host", "path", "rule", F.coalesce("given", learned).alias("verdict"), "score")


def op11(pages: DataFrame) -> DataFrame:
    return judged(pages)
