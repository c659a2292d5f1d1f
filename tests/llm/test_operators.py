"""The corpus operators against sequential versions, on awkward rows: nulls, empty and long texts, ties, clashing columns."""

import hashlib
import random
import re
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowlens.llm import decontamination, embeddings, packing, pii, rollups, secrets, simhash, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, comp string, h string, blob string"
CLASH = SCHEMA.count(",") - 4


def frame(spark, rows):
    """Documents of (id, text), one source holding most, and extra columns named like inner ones."""
    return spark.createDataFrame(
        [(d, t, None if i % 7 == 0 else "en", "hot" if i % 3 else None, None, *["x"] * CLASH) for i, (d, t) in enumerate(rows)], SCHEMA
    )


def prose(rng, n, vocabulary=4000):
    return " ".join(f"{rng.choice('bcdfg')}o{rng.randrange(vocabulary)}a" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Null, empty, blank, short and very long texts, exact and near copies, a repeated row and a null id."""
    rng = random.Random(5)
    base = [prose(rng, 300) for _ in range(12)]
    out = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one TWO three"), (6, "ünïcode ß 漢字   İstanbul end"),
           (7, prose(rng, 60_000)), (None, base[0]), (8, base[0]), (8, base[0]), (9, base[0].upper())]
    for i, text in enumerate(base):
        words = text.split()
        words[rng.randrange(300)] = "changed"
        out += [(20 + 3 * i, text), (21 + 3 * i, " ".join(words)), (22 + 3 * i, prose(rng, 40) + " " + " ".join(words[100:180]))]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


def test_simhash_components(docs, rows):
    ids = [d for d, _ in rows]
    prints = [brute.fingerprint(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 4]
    root = brute.roots(range(len(rows)), links)
    least = {}
    for i, r in root.items():
        if ids[i] is not None:
            least[r] = min(ids[i], least.get(r, ids[i]))
    want = sorted((d or 0, f"{p:016x}", least[root[i]]) for i, (d, p) in enumerate(zip(ids, prints, strict=True)))
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.op9(docs).collect())
    assert got == want


def test_simhash_keeps_one_of_each_group(docs):
    kept = simhash.one_each(docs)
    assert kept.columns == docs.columns
    groups = {r.component_id for r in simhash.op9(docs).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(groups)


def rule_texts():
    rng = random.Random(3)
    bits = ["password", "API_KEY", "token", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGH1234567890", "deadbeef0123", "0123456789abcdef", "x",
            "a.b@c-d.org", "@", ".", "192.168.0.1", "300.1.1.1", "4111 1111 1111 1111", "4111-1111", "+1 (555) 010-9999", "+", "é", "漢", "\n", "7"]
    out = [None, "", "1." * 3000, "1 " * 5000, "a" * 20_000 + "@", "+1" * 2000]
    return out + ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(400)]


@pytest.mark.parametrize(("operator", "plain"), [(secrets.op4, brute.secrets), (pii.op10, brute.personal)])
def test_rules_find_the_contract_spans(spark, operator, plain):
    texts = rule_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(9, texts[9]), (None, texts[10])]
    got = operator(frame(spark, rows)).select("doc_id", "base_sha256", "spans").collect()
    want = [(d if d is not None else -1, hashlib.sha256(plain(t or "").encode()).hexdigest()) for d, t in rows]
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.base_sha256) for r in got) == sorted(want)
    for r in got:
        if r.doc_id is not None:
            assert set(filter(None, plain(texts[r.doc_id] or "").split(","))) <= set(r.spans.split(","))


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    ledger = secrets.Ledger(str(tmp_path / "ledger"))
    first = frame(spark, [(1, "token=abcdef1"), (2, "token=abcdef1")])
    ledger.commit(first, commit="0")
    ledger.commit(first, commit="0")
    later = frame(spark, [(1, "token=abcdef1"), (3, "token=uvwxyz2"), (4, None)])
    ledger.commit(later, commit="1")
    assert [r["count"] for r in ledger.read(later).groupBy("commit").count().orderBy("commit").collect()] == [1, 2]
    assert {r.doc_id: len(r.findings) for r in ledger.findings(later).collect()} == {1: 1, 3: 1, 4: 0}


def test_redaction_keeps_rows_and_columns(spark):
    got = secrets.redacted(frame(spark, [(1, "my token=abcdef1 ok"), (2, "clean"), (2, "clean"), (3, None)]))
    assert got.columns == frame(spark, [(1, "")]).columns
    found = sorted((r.doc_id, r.text or "") for r in got.collect())
    assert [f for f in found if f[0] != 1] == [(2, "clean"), (2, "clean"), (3, "")] and "abcdef1" not in found[0][1]


def test_disclosing_terms_are_added(spark):
    rng = random.Random(1)
    rows = [(i, f"{prose(rng, 20)} zanzibar mail bob@example.org now") for i in range(6)] + [(10 + i, prose(rng, 20)) for i in range(60)]
    got = {r.doc_id: r for r in pii.op10(frame(spark, rows)).collect()}
    at = rows[0][1].index("zanzibar")
    assert f":{at}:{at + 8}" in got[0].spans and got[0].n_email == 1 and got[30].spans == ""


def test_packing_is_an_exact_round_trip(docs, rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = packing.op5(docs).collect()
    whole = {}
    for d, t in rows:
        whole.setdefault(d, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    assert sum(p.length for p in pieces) == sum(len(i) for v in whole.values() for i in v)
    for d, copies in whole.items():
        ids = copies[0]
        own = sorted((p for p in pieces if p.doc_id == d), key=lambda p: p.start)
        assert sum(p.length for p in own) == len(ids) * len(copies)
        for p in own:
            part = np.array(ids[p.start:p.start + p.length], "<u4").tobytes()
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(part)
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_rollups_add_up(spark, docs, rows, tmp_path):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t in rows)
    got = rollups.op6(docs).collect()
    assert (sum(r.tokens for r in got), sum(r.documents for r in got)) == (want, len([d for d, _ in rows]))
    counts = rollups.token_counts(frame(spark, [(1, "one two"), (2, "three")]))
    rollup = rollups.Rollup(str(tmp_path / "rollup"))
    rollup.commit("a", rollups.signed(counts, 1))
    rollup.commit("a", rollups.signed(counts, 1))
    longer = rollups.token_counts(frame(spark, [(1, "one two and many more words")]))
    rollup.commit("b", rollups.revised(counts.where("doc_id = 1"), longer))
    assert sum(r.documents for r in rollup.totals(spark).collect()) == 2
    rollup.commit("c", rollups.signed(longer, -1))
    rollup.commit("d", rollups.signed(counts.where("doc_id = 2"), -1))
    assert rollup.totals(spark).count() == 0


def test_passages(docs, rows):
    known = [(d, t) for d, t in rows if d is not None]
    got = {(r.doc_id, r.start_word, r.end_word) for r in suffixes.op7(docs).collect() if r.doc_id is not None}
    assert got == brute.passages(known, 50) | {(9, 0, 300)}


@pytest.mark.parametrize("block", [4096, 16])
def test_vectors(spark, block):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 24))
    vectors = [(centres[i % 8] + rng.normal(size=24) * (0.1 + 0.1 * (i % 5))).tolist() for i in range(120)]
    vectors += [vectors[0], [2 * x for x in vectors[1]], None, [], [0.0] * 24, [float("nan")] * 24, [None] + vectors[2][1:],
                [float("inf")] + vectors[3][1:], vectors[0][:5]]
    links = brute.vector_links(vectors)
    root = brute.roots(range(len(vectors)), links)
    many = {i: sum(i in pair for pair in links) for i in root}
    df = spark.createDataFrame([(i, v, None, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int, digest string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, block=block).collect()}
    assert got == {i: (many[i], root[i], root[i] == i) for i in root}


def test_reparameterised_questions(spark):
    rng = random.Random(8)
    item = "a farmer in the valley sells 12 baskets of ripe apples for 30 dollars each and then buys 4 more goats how much is left over"
    other = item.replace("12", "7").replace("30", "55")
    mixed = re.sub("baskets of ripe apples", "crates with green pears", item)
    rows = [(1, prose(rng, 100) + " " + item), (2, other + " " + prose(rng, 100)), (3, prose(rng, 100)), (4, None), (5, ""), (6, mixed[:40])]
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (1, item, "x")], "item_id long, text string, n string")
    got = {(r.doc_id, r.item_id): r.verbatim for r in decontamination.op3(frame(spark, rows), bench).collect()}
    assert got == {(1, 1): True, (2, 1): False}


def test_empty_tables(spark):
    none = frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    made = [simhash.op9(none), secrets.op4(none), pii.op10(none), packing.op5(none), rollups.op6(none), suffixes.op7(none),
            embeddings.op1(vectors), decontamination.op3(none, bench)]
    assert [df.count() for df in made] == [0] * len(made)
    assert decontamination.op3(frame(spark, [(1, "some words")]), bench).select(F.count("*")).first()[0] == 0


def test_disclosing_terms_are_found_far_from_the_entity(spark):
    """Every position of a text counts: a term at its start gives away an entity 200 words on, a common word does not."""
    rng = random.Random(2)
    rows = [(i, f"zanzibar common {prose(rng, 200)} mail bob@example.org") for i in range(6)]
    rows += [(10 + i, f"common {prose(rng, 20)}") for i in range(60)] + [(90, f"zanzibar common {prose(rng, 5)}")]
    got = {r.doc_id: r for r in pii.op10(frame(spark, rows)).collect()}
    assert all("term:0:8" in got[i].spans for i in range(6)) and all("term:9:15" not in got[i].spans for i in range(6))
    assert got[90].spans == "" and got[10].spans == ""
