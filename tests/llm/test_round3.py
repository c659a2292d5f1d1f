"""URL verdicts, the prefix trie and spelling variants against sequential versions, on awkward rows."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowlens.llm import decontamination, pii, prefixes, rollups, secrets, simhash, spelling, urls
from flowlens.operators.storage import fresh_dir

# ---- spelling variants ----------------------------------------------------------------------------------------

TEXTS = "doc_id long, text string, word string, n long, id string, part string"


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, "x", "x") for d, t in rows], TEXTS)


def word_counts(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows):
    words = word_counts(rows)
    near = {w: [v for v in words if v != w and one_apart(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def variants(spark, rows):
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(documents(spark, rows)).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("ranges", [1, 7])
def test_variants_match_brute_force(spark, ranges):
    rng = random.Random(ranges)
    letters = "aab\u00e9\u00c9\u00f7B"
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 8))) for _ in range(150)]
    weights = [1 / (1 + i % 40) for i in range(150)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights, k=60))) for i in range(60)]
    rows += [(None, "aaaaa aaaa aaaaaa"), (None, "aaaaa"), (7, None), (8, ""), (9, " 12 "), (10, rows[0][1]), (10, rows[0][1])]
    rows += [(11, " ".join(["hotword"] * 3000)), (12, "hotwort hotwort hotwort, h\u00f3tword h\u00f3tword h\u00f3tword"), (13, "\u6f22\u5b57\u6f22\u5b57\u6f22")]
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        assert variants(spark, rows) == brute_variants(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_run_of_letters_without_end(spark):
    """Two words of 20,000 letters that differ in the middle: numbers travel, not substrings."""
    rng = random.Random(3)
    long = "".join(rng.choice("abcdef") for _ in range(20_000))
    other = long[:9_000] + "z" + long[9_001:]
    rows = [(i, f"{long} {long} {other}") for i in range(4)]
    assert variants(spark, rows) == brute_variants(rows)


# ---- prefix trie ----------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, node string, depth long, pos string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "x") for r in rows], TURNS)


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, role, name, (role, text)))
    turns = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(turns.get(c - c % 20, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below = [totals[x] for x in children[node]]
        totals[node] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[node]) - 1) * words)
    out = set()
    for node, held in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in held if len(built[c]) == len(node)))
        out.add((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(children[node]), *totals[node],
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes(spark, rows, piece):
    got = [tuple(r) for r in prefixes.trie(conversations(spark, rows), piece).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.fixture(scope="module")
def talk():
    """Shared openings, copies, ties, nulls, one conversation with a third of all turns, ends on and around segment borders."""
    rng = random.Random(9)
    rows = [(0, t, "user", f"opening {t} \u00e9\n two") for t in range(20)]
    for c in range(1, 70):
        for t in range(rng.choice([1, 2, 3, 4, 7, 8, 9, 16, 17, 33])):
            rows.append((c, t, rng.choice(["user", "user", None]), rng.choice(["yes", "yes no", None, "", " \t"])))
    rows += [(c, t, "user", "the same words") for c in (100, 101, 102, 103, 2000, 2001) for t in range(16)]
    rows += [(200, t, "user", f"long {t % 3}") for t in range(400)]
    rows += [(201, None, "user", "b"), (201, None, "user", "a"), (201, 5, "x", "q"), (201, 5, "x", "q"), (201, -3, None, "z")]
    rows += [(None, 0, "user", "lost"), (-7, 1, "user", "minus"), (-20, 1, "user", "minus")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("piece", [1, 4, 32])
def test_trie_matches_brute_force(spark, talk, piece):
    rows = talk if piece > 1 else [r for r in talk if r[0] != 200 or r[1] < 70]
    rows = [r for r in rows if r[0] is None or r[0] >= 0]  # Python's % differs from SQL's below zero
    assert nodes(spark, rows, piece) == brute_trie(rows)


def test_trie_takes_negative_ids_and_copies(spark):
    rows = [(-7, 1, "user", "minus"), (-20, 1, "user", "minus"), (40, 0, "a", "b"), (45, 0, "a", "b")]
    got = nodes(spark, rows, 32)
    assert sum(1 for r in got if r[1] == 0) == 1 and min(r[0] for r in got) == -20
    many = [(c, 0, "user", "copy") for c in range(0, 3000)]
    got = nodes(spark, many, 32)
    assert got == brute_trie(many)


# ---- urls -----------------------------------------------------------------------------------------------------


def split_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def brute_rule(host, path, rules=urls.RULES):
    best = None
    for rule, verdict in rules:
        h, _, rest = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return best


URLS = [
    None, "", "no scheme", "http://", "http://COM/", "http://com", "https://A.Example.COM/en/1?x=/y", "https://www.example.com/en/",
    "https://m.www.example.com/en/x#f", "http://x.net/es/1", "http://x.net/es", "http://net/fr/", "http://x.net:80/fr/1", "ftp://a..com/p",
    "http://xcom/", "http://\u00c9.example.com/EN/1", "x://y://z.com/", "http://h.com?q", "http://h.com#q/", "//a.com/",
    "http://a.org/" + "p/" * 20_000, "http://" + "s." * 20_000 + "net/es/q", "http://a\nb.com/\n",
]


def test_urls_follow_rules(spark):
    rows = [(i if i % 5 else None, u, "h", "p", "r") for i, u in enumerate(URLS * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string")
    got = Counter((r.page_id, r.host, r.path, r.rule) for r in urls.op11(df).collect())
    want = Counter()
    for page, url, *_ in rows:
        host, path = split_url(url)
        rule = brute_rule(host, path)
        want[page, host, path, rule[0] if rule else None] += 1
    assert got == want
    for r in urls.op11(df).collect():
        rule = brute_rule(r.host, r.path)
        assert r.verdict == (rule[1] if rule else "block" if r.score >= 0.5 else "allow")


def test_urls_learn_from_a_small_table(spark):
    rng = random.Random(4)

    def url(bad):
        name = "".join(rng.choice("abcdefgh") for _ in range(6))
        return f"http://{name}.{'cheap-pills' if bad else 'library'}.org/{rng.choice(['win', 'offer']) if bad else rng.choice(['read', 'text'])}/{rng.randrange(999)}"

    taught = [(url(i % 2), "block" if i % 2 else "allow") for i in range(300)] + [(None, "allow"), ("http://x.org/", None)]
    held = [(i, url(i % 2)) for i in range(400)]
    labelled = spark.createDataFrame(taught, "url string, verdict string")
    got = {r.page_id: r.verdict for r in urls.judged(spark.createDataFrame(held, "page_id long, url string"), labelled).collect()}
    assert sum(got[i] == ("block" if i % 2 else "allow") for i, _ in held) >= 0.98 * len(held)
    model = urls.train(labelled)
    again = urls.train(labelled)
    assert (model.weights == again.weights).all() and model.bias == again.bias


def test_score_is_the_sum_over_n_grams(spark):
    import pyarrow as pa

    model = urls.fit(["a.org", "b.net"] * 20, ["/x", "/y"] * 20, [0, 1] * 20)
    hosts, paths = ["a.org", "", "b.net"], ["/x", "/z", ""]
    bucket, row = urls.features(pa.array(hosts), pa.array(paths))
    for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
        alone, _ = urls.features(pa.array([h]), pa.array([p]))
        grams = sum(max(len(x) + 2 - k + 1, 0) for x in (h, p) for k in urls.GRAMS)
        assert sorted(bucket[row == i]) == sorted(alone) and len(alone) == grams


# ---- empty tables, clashing names, long texts -----------------------------------------------------------------


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert spelling.op13(documents(spark, [])).count() == 0
    assert spelling.op13(documents(spark, [(1, None), (2, "a b")])).count() == 0
    assert prefixes.op12(conversations(spark, [])).count() == 0 and urls.op11(pages).count() == 0


CLASHES = ("_text", "_id", "_sign", "_blob", "_findings", "_new", "_bad", "row", "its_id", "sign", "h", "blob", "new")


def test_stages_keep_columns_of_any_name(spark):
    text = "some words that stand here with token=abcdef1 in them"
    rows = [(1, text), (2, text), (2, text), (3, None), (None, "quite other words stand in this row alone now")]
    df = spark.createDataFrame([(d, t, *[f"v{i}"] * len(CLASHES)) for i, (d, t) in enumerate(rows)],
                               "doc_id long, text string, " + ", ".join(f"{n} string" for n in CLASHES))
    kept = simhash.one_each(df)
    assert kept.columns == df.columns and sorted(kept.collect(), key=str) == sorted((r for r in df.collect() if r._id in ("v0", "v3", "v4")), key=str)
    clean = {r._id: (r.text, r._new, r._blob) for r in secrets.redacted(df).collect()}
    assert clean["v1"] == (text.replace("token=abcdef1", "<SECRET>"), "v1", "v1") and clean["v3"] == (None, "v3", "v3")


def test_equal_rows_leave_one(spark):
    df = spark.createDataFrame([(5, "the very same words are here")] * 40 + [(6, "the very same words are here")], "doc_id long, text string")
    assert [tuple(r) for r in simhash.one_each(df).collect()] == [(5, "the very same words are here")]


def test_many_matches_in_one_text(spark):
    """A text of 200,000 numbers and one of 30,000 secrets: the work follows their length."""
    numbers = ",".join(str(i % 90 + 10) for i in range(200_000))
    hidden = " ".join(["token=abcdef1"] * 30_000)
    df = spark.createDataFrame([(1, numbers), (2, hidden)], "doc_id long, text string")
    began = time.time()
    assert sum(len(r.spans) for r in pii.op10(df).collect()) == 0
    got = {r.doc_id: r.text for r in secrets.redacted(df).collect()}
    assert got == {1: numbers, 2: " ".join(["<SECRET>"] * 30_000)} and time.time() - began < 60


def test_overlapping_secrets_leave_nothing(spark):
    text = "x secret=0123456789abcdef0123456789abcdef_tail y"
    df = spark.createDataFrame([(1, text), (2, "\u00e9" * 600 + " secret=abcdefgh " + "z" * 600)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redacted(df).collect()}
    assert got == {1: "x <SECRET> y", 2: "\u00e9" * 600 + " <SECRET> " + "z" * 600}


# ---- benchmark items: all slots, and items without a template window -------------------------------------------


@pytest.mark.parametrize("text,verbatim", [
    ("add apples 5 5 pears now", True), ("add apples 8 8 pears now", False), ("add apples 3 8 pears now", None),
    ("add apples 5 8 pears now", None), ("x add apples 9 9 pears now y", False), ("add apples 5 5 plums now", None),
])
def test_slots_agree_at_every_position(spark, text, verbatim):
    bench = spark.createDataFrame([(1, "add apples 5 5 pears now")], "item_id long, text string")
    got = {r.doc_id: r.verbatim for r in decontamination.op3(documents(spark, [(7, text)]), bench).collect()}
    assert got == ({} if verbatim is None else {7: verbatim})


def test_slots_agree_both_ways(spark):
    bench = spark.createDataFrame([(1, "first take 5 apples then add 7 pears to them")], "item_id long, text string")
    rows = [(1, "first take 9 apples then add 9 pears to them"), (2, "first take 7 apples then add 5 pears to them")]
    assert [r.doc_id for r in decontamination.op3(documents(spark, rows), bench).collect()] == [2]


def test_short_items_are_found_whole(spark):
    items = [(1, "Solve x"), (2, "Photosynthesis"), (3, "12 times 7 is"), (4, "1 2 3 4 5 6 7"), (5, None), (6, ""), (7, "John Smith met Ann Lee")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "please Solve x now"), (2, "on Photosynthesis"), (3, "so 12 times 7 is what"), (4, "0 1 2 3 4 5 6 7 8"),
            (5, "Solve y; Photosynthesi; 12 times 8 is; 1 2 3 4 0 5 6 7"), (6, "when John Smith met Ann Lee"), (7, "when Jim Smith met Ann Lee"), (8, None)]
    got = {(r.doc_id, r.item_id, r.verbatim) for r in decontamination.op3(documents(spark, rows), bench).collect()}
    assert got == {(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (6, 7, True)}


def test_a_passage_in_every_document_and_a_long_text(spark):
    rng = random.Random(6)
    item = "a farmer sells 12 baskets of ripe apples for 30 dollars each and buys 4 goats"
    filler = lambda n: " ".join(rng.choice(["so", "it", "was", "then", "and"]) for _ in range(n))
    rows = [(i, f"{filler(9)} {item} {filler(5)}") for i in range(300)] + [(900, f"{filler(60_000)} {item}"), (901, filler(60_000))]
    bench = spark.createDataFrame([(1, item), (2, item)], "item_id long, text string")
    got = decontamination.op3(documents(spark, rows + rows[:3]), bench).collect()
    assert {(r.doc_id, r.item_id, r.share, r.verbatim) for r in got} == {(d, i, 1.0, True) for d, _ in rows if d != 901 for i in (1, 2)}
    assert len(got) == 602


def test_rollup_history_against_sums(spark):
    """Inserts, revisions, deletes and versions, in any order and delivered again, come to the sums of what is left."""
    rng = random.Random(21)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(i, rng.choice([None, "", "one", "two words", "three words, 12 dots..."]), rng.choice([None, "en", "de"]), "hot" if i % 3 else None)
            for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")

    def sums(rows, version="word_bpe_49k.json", extra=0):
        want = {}
        for _, text, lang, source in rows:
            n, tokens = want.get((source, lang, version), (0, 0))
            made = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
            want[source, lang, version] = (n + 1, tokens + made + extra)
        return want

    def found(totals):
        return {tuple(r)[:3]: tuple(r)[3:] for r in totals.collect()}

    assert found(rollups.op6(docs, 3)) == sums(rows)
    assert found(rollups.op6(docs.limit(0), 2)) == {}
    counts = rollups.token_counts(docs)
    rollup = rollups.Rollup(fresh_dir(spark, "history"))
    rollup.commit("a", rollups.signed(counts, 1))
    rollup.commit("gone/1", rollups.signed(counts.where("doc_id < 10"), -1))
    rollup.commit("v2", rollups.signed(rollups.in_version(counts.where("doc_id >= 30"), "v2", 1), 1))
    for _ in range(2):
        rollup.commit("a", rollups.signed(counts, 1))
    assert found(rollup.totals(spark)) == sums(rows[10:]) | sums(rows[30:], "v2", 1)
    rollup.commit("gone/1", rollups.signed(counts.where("doc_id < 20"), -1))
    assert found(rollup.totals(spark)) == sums(rows[20:]) | sums(rows[30:], "v2", 1)
    rollups.signed(counts, 1).write.parquet(f"{rollup.path}/sums/attempt=broken-off")  # stored, never marked
    assert found(rollup.totals(spark)) == sums(rows[20:]) | sums(rows[30:], "v2", 1)
