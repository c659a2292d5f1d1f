"""Repeated passages where very many texts share a gram and the words on one of its sides."""

import random

import pyarrow as pa
import pytest

import brute
from flowlens.llm import suffixes
from flowlens.llm.common import Words


def words(rng, n):
    return [f"{rng.choice('bcdfg')}o{rng.randrange(100_000)}a" for _ in range(n)]


def middle_gram(rng):
    """Fifty words whose smallest gram starts near their middle."""
    while True:
        made = words(rng, suffixes.LEAST)
        sliced = Words(pa.array([" ".join(made)]))
        at = suffixes.retained(sliced, suffixes.grams(sliced, suffixes.GRAM), suffixes.GRAM, suffixes.LEAST)
        if 15 <= at[0] <= 23:
            return made, int(at[0])


@pytest.mark.parametrize("parts", ["1", "3", "32"])
def test_crowded_grams(spark, parts):
    rng = random.Random(31)
    shared, at = middle_gram(rng)
    rows = [(i, " ".join(words(rng, 70) + shared + words(rng, 70))) for i in (1, 2)]
    rows += [(1000 + i, " ".join(words(rng, 60) + shared[at:] + words(rng, 60))) for i in range(400)]
    rows += [(2000 + i, " ".join(words(rng, 60) + shared[:at + suffixes.GRAM] + words(rng, 60))) for i in range(400)]
    common = words(rng, 55)
    rows += [(3000 + i, " ".join(words(rng, i % 7) + common + words(rng, 3 + i % 5))) for i in range(300)]
    rows += [(4000, " ".join(["again"] * 500)), (4001, " ".join(["x"] + ["again"] * 120)), (4002, None), (4003, "")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, key string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = suffixes.op7(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = brute.passages(rows, suffixes.LEAST)
    assert {(r.doc_id, r.start_word, r.end_word) for r in found} == want
    assert {(1, 70, 120), (2, 70, 120)} <= want
    assert {r.doc_id: r.other_doc_id for r in found if r.doc_id < 3} == {1: 2, 2: 1}
    assert all(r.doc_id != r.other_doc_id for r in found)
