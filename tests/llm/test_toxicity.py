import random
import zlib

import pytest
from marginloom.llm import toxicity
from marginloom.llm.toxicity import Lexicon, chosen_entries, skeleton

FOLDER = "/root/testdata/sf0.01"


def test_skeleton():
    assert skeleton(None) == [] and skeleton("") == [] and skeleton(" \n!?") == []
    words = ["idiot", "IDIOT", "1d1ot", "іdіоt", "ïdíöt", "ｉｄｉｏｔ", "idi​ot", "|di0t"]
    assert {w for word in words for w in skeleton(word)} == {"idiot"}
    assert skeleton("Loser, l0ser; 1oser") == ["ioser"] * 3
    assert skeleton("straße 日本") == ["strasse", "日本"]


def test_matches_words_beginnings_and_exceptions():
    lexicon = Lexicon({"trash ": 2.0, "worth": 1.0, "worthless ": 3.0}, ["trash can", "the trash"])
    weights = lambda text: [w for _, w in lexicon.matches(text.split())]
    assert weights("trash trashy worthy worthless unworthy") == [2.0, 1.0, 3.0]
    assert weights("a trash can is the trash") == []
    assert weights("trash the trash can trash") == [2.0, 2.0]
    assert weights("") == [] and Lexicon({}).matches(["trash"]) == []


def test_matches_equal_plain_search():
    """Every word on its own, against the automaton over the whole text."""
    lexicon = Lexicon({"ab ": 1.0, "abc": 2.0, "b": 0.5, "ca ": 4.0}, ["ab b", "ca ca"])
    r = random.Random(4)
    for _ in range(300):
        words = [r.choice(["ab", "abc", "abcd", "b", "ca", "x"]) for _ in range(r.randint(0, 12))]
        want = []
        for i, w in enumerate(words):
            if any(" ".join(words[j : j + 2]) in lexicon.exceptions for j in (i - 1, i) if j >= 0):
                continue
            hits = [v for e, v in lexicon.weights.items() if (w + " ").startswith(e)]
            want += [max(hits)] if hits else []
        assert [v for _, v in lexicon.matches(words)] == want


def test_entries_need_evidence():
    candidates = [("idiot ", 0, 40), ("idio", 0, 40), ("the ", 900, 90), ("rare ", 0, 2), ("stem", 30, 60), ("stemx ", 0, 9)]
    chosen = chosen_entries(candidates, 100, 1000)
    assert set(chosen) == {"idiot ", "stem"} and chosen["idiot "] > chosen["stem"] > 0


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels")]


@pytest.fixture(scope="module")
def lexicon(tables):
    return toxicity.fit(*tables)


def test_held_out_accuracy(tables, lexicon):
    docs, labels = tables
    rows = toxicity.scored(docs, lexicon).join(labels, "doc_id").filter("held_out and toxic is not null").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert len(toxic) > 5 and len(clean) > 50
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)


def test_no_label_of_held_out_rows_is_used(spark, tables, lexicon):
    docs, labels = tables
    even = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - toxic else toxic end toxic")
    again = toxicity.fit(docs.drop("lang", "source"), even)
    assert (again.weights, again.exceptions, again.curve) == (lexicon.weights, lexicon.exceptions, lexicon.curve)


def test_bounded_sample(tables):
    docs, labels = tables
    assert 60 <= toxicity.training_rows(docs, labels, rows=100).count() <= 140
    assert toxicity.fit(docs, labels, rows=100).curve


def test_exception_phrases_are_learned(spark):
    r, rows, marks = random.Random(2), [], []
    for i in range(1200):
        toxic = i % 4 == 0
        filler = [f"word{r.randrange(40)}" for _ in range(8)]
        if toxic:
            filler.insert(r.randrange(8), "trash")
        elif i % 16 == 1:
            filler[3:3] = ["the", "trash"]
        rows.append((i, " ".join(filler)))
        marks.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, toxic int")
    lexicon = toxicity.fit(docs, labels)
    assert list(lexicon.weights) == ["trash "] and "the trash" in lexicon.exceptions
    found = {r.doc_id: r.predicted for r in toxicity.scored(docs, lexicon).collect()}
    assert sum(found[i] != toxic for i, toxic in marks) <= 12


def test_odd_rows(spark, odd_twice, lexicon):
    rows = toxicity.scored(odd_twice, lexicon).collect()
    assert len(rows) == odd_twice.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    none = {r.score for r in rows if r.doc_id in (1, 2, 3)}
    assert len(none) == 1 and none.pop() < 0.3
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1), (5, 0), (5, 1)], "doc_id bigint, toxic int")
    assert toxicity.toxicity_table(odd_twice, labels).count() == len(rows)
    empty = toxicity.toxicity_table(odd_twice.limit(0), labels.limit(0))
    assert empty.count() == 0 and empty.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
