"""Ids of the packing encoder against the tokenizer itself, on awkward words, and how much text it gives the tokenizer."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from flowlens.llm import packing

PATH = public_tokenizers.path(packing.VOCABULARY)
BITS = [
    "a", "s", "t", "B", "LL", "ve", "é", "É", "À", "ß", "ÿ", "Þ", "×", "÷", "ª", "H̱", "T̈", "́", "i̇", "İ", "Σ", "ς", "ﬁ", "中文",
    "𝔘", "😀", "'", "'S", "'ll", ".", ",", "(", ")", "...", "***", "`", "^", "~", "{", "}", "\\", "[", "]", "-", "_", "@", "/", "<", ">", "</w>", "1", "42",
    "٣", "\x01", "\x00", "\t", "\r", " ", " ", "‍", "<|endoftext|>", "<|startoftext|>", " ", " ", "\n", "don't", "the", "The",
]


class Counting:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, tokenizer, seen):
        self.tokenizer, self.seen = tokenizer, seen

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch_fast(self, words, **kinds):
        self.seen.append(sum(map(len, words)))
        return self.tokenizer.encode_batch_fast(words, **kinds)


def counted():
    made, seen = packing.Encoder(PATH), []
    for name, held in list(vars(made).items()):
        if isinstance(held, Tokenizer):
            setattr(made, name, Counting(held, seen))
    return made, seen


def column(*texts):
    return pa.array(texts, pa.string())


@pytest.mark.parametrize("room", [0, 7, 200_000])
def test_ids_are_those_of_the_whole_text(monkeypatch, room):
    monkeypatch.setattr(packing, "CACHE_WORDS", room)
    rng = random.Random(room)
    tokenizer = Tokenizer.from_file(PATH)
    made = packing.Encoder(PATH)
    for _ in range(6):
        texts = ["", " ", "\x01", "'s", "\"'s'", *("".join(rng.choices(BITS, k=rng.randrange(1, 40))) for _ in range(150))]
        ids, ends = made.encode(column(*texts), 1)
        want = [tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]
        assert [p.tolist() for p in np.split(ids, ends[:-1])] == want


def test_every_latin_letter_in_either_case():
    tokenizer = Tokenizer.from_file(PATH)
    texts = [f"({chr(c)}x{chr(c)}, {chr(c)}." for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]]
    ids, ends = packing.Encoder(PATH).encode(column(*texts), 1)
    assert [p.tolist() for p in np.split(ids, ends[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_a_word_is_encoded_once_for_all_ways_to_write_it():
    made, seen = counted()
    ways = [f"{a}{w}{b}" for w in ("wonderful", "Wonderful", "WONDERFUL") for a in ("", "(", "[") for b in ("", ".", ",", ")", "!")]
    made.encode(column(" ".join(ways)), 1)
    assert 0 < sum(seen) < 40


def test_the_cache_takes_words_of_a_slice_that_has_more_than_fit(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    made, seen = counted()
    words = ["".join(chr(97 + (i // 26**k) % 26) for k in range(3)) for i in range(100)]
    made.encode(column(" ".join(words)), 1)
    first = sum(seen)
    made.encode(column(" ".join(words)), 1)
    assert sum(seen) - first < 0.6 * first


def test_another_kind_of_vocabulary_takes_each_word_by_itself():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    ids, ends = packing.Encoder(path).encode(column("Some words, (Some) words", ""), 1)
    assert ids.tolist() == [i for w in "Some words, (Some) words".split() for i in tokenizer.encode(w, add_special_tokens=False).ids] + [1, 1]
    assert ends.tolist() == [len(ids) - 1, len(ids)]
