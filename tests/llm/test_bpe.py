import random
from collections import Counter

import pytest

from marginloom.llm import bpe
from marginloom.llm.tokenizing import tokenizer
from tests.llm import plain

NAME = bpe.VOCABULARY
SYLLABLES = ["aaaaa", "the", "ing", "Tion", "é", "ß", "e\u0301", "'s", "'re", "''", "!!", "<|endoftext|>", "<|startoftext|>", " ", "\n", "\x0b", "\u00a0", "\u2003", "1", "日本", "\U0001f600", "<|", "|>", "İ", "\u0308", "a" * 30]


def library(text):
    ids = tokenizer(NAME).encode(text or "", add_special_tokens=False).ids
    decoded = tokenizer(NAME).decode(ids, skip_special_tokens=False)
    return len(ids), plain.sha(" ".join(map(str, ids))), plain.sha(decoded)


def random_text(r, spaces):
    parts = SYLLABLES if spaces else [s for s in SYLLABLES if not s.isspace()]
    return "".join(r.choice(parts) for _ in range(r.randint(1, 900)))


@pytest.mark.parametrize("seed", range(40))
def test_joined_parts_are_the_whole(seed):
    r = random.Random(seed)
    text = random_text(r, seed % 2) if seed % 5 else "a" * r.randint(500, 4000)
    size = r.choice([40, 137, 400])
    parts = [bpe.encode_part(text, i, min(len(text), i + size), NAME) for i in range(0, len(text), size)]
    assert bpe.join_all(text, parts, NAME).ids.tolist() == tokenizer(NAME).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(40))
def test_remembered_words_are_the_whole(seed, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    text = random_text(random.Random(seed), True)
    ((ids, decoded),) = bpe.written([text.encode()], NAME)
    want = tokenizer(NAME).encode(text, add_special_tokens=False).ids
    assert ids.decode() == " ".join(map(str, want))
    assert decoded.decode() == tokenizer(NAME).decode(want, skip_special_tokens=False)


def test_table_matches_the_library(odd_twice, small, pairs):
    docs = odd_twice.select("doc_id", "text").unionByName(small.select("doc_id", "text"))
    rows = bpe.round_trip(docs, leaf_chars=2000).collect()
    assert Counter(tuple(r) for r in rows) == Counter((i, *library(t)) for i, t in pairs(docs))


def test_ids(odd, pairs):
    rows = bpe.encode(odd, leaf_chars=5000).collect()
    want = {i: tokenizer(NAME).encode(t or "", add_special_tokens=False).ids for i, t in pairs(odd)}
    assert {r.doc_id: r.ids for r in rows} == want
    assert bpe.encode(odd.limit(0)).count() == bpe.round_trip(odd.limit(0)).count() == 0


class Counting:
    """A tokenizer that counts the characters given to it."""

    def __init__(self, name):
        self.own, self.chars = tokenizer(name), 0

    def __getattr__(self, name):
        return getattr(self.own, name)

    def encode(self, text, **options):
        self.chars += len(text)
        return self.own.encode(text, **options)

    def encode_batch_fast(self, texts, **options):
        self.chars += sum(map(len, texts))
        return self.own.encode_batch_fast(texts, **options)


ODD_WORDS = ["~", "a~b", "don~", "it's", "Don't,", "É!", "ß?", "ªb", "µm", "x_y", "__", "a'", "İx", "é.", "a.b", "<|", "x<|", "a<|>", "̈a", "a̸", "Å", "÷", "a\x7f", "日本,", "Ж.", "1a!", "a1"]


def test_words_of_equal_letters_are_encoded_once():
    stems = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyzéß", k=12)) for i in range(200)]
    words = [form + signs for stem in stems for form in (stem, stem.title()) for signs in ("", ",", ".", "!?", "###")] + ODD_WORDS
    memory = bpe._Memory(NAME)
    memory.tokenizer = Counting(NAME)
    memory.learn({w.encode() for w in words})
    assert memory.tokenizer.chars < sum(map(len, words)) / 4
    for word in words:
        want = tokenizer(NAME).encode(word, add_special_tokens=False).ids
        ids, decoded = memory.texts([word.encode()])
        assert ids.decode() == " ".join(map(str, want))
        assert decoded.decode() == tokenizer(NAME).decode(want, skip_special_tokens=False)
