import hashlib

import pytest
from marginloom.llm import merkle
from tests.llm import plain

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple(map(str, r)))


def _same(df, levels=merkle.LEVELS):
    want = plain.manifest([tuple(r) for r in df.select(*FIELDS).collect()])
    assert _sorted(merkle.manifest_table(df, levels).collect()) == _sorted(want)
    return want


def test_given_documents(small):
    want = _same(small)
    assert 0 < sum(r[-1] for r in want) < len(want)


def test_several_sweeps(spark):
    """Blocks of nine leaves: trees of several sweeps, complete and not, and many sources."""
    rows = [(i, f"s{i % 7}" if i % 3 else "hot", "en", i, f"text\n{i}") for i in range(700)]
    rows += [(1000 + i, f"only{i}", None, None, None) for i in range(100)]
    rows += [(2000 + i, "full", "de", 1, "") for i in range(81)] + [(3000 + i, "nine", "de", 1, "") for i in range(9)]
    _same(spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars int, text string").repartition(5), levels=2)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10])
def test_small_tables(spark, n):
    rows = [(i, None, "en", 1, "a\nb") for i in range(n)]
    want = _same(spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars int, text string"))
    if n == 1:
        assert want[0][1] == want[0][2] == want[0][3] and want[0][4] == hashlib.sha256(b"").hexdigest()


def test_odd_rows(odd_twice):
    _same(odd_twice)
    empty = merkle.manifest_table(odd_twice.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_proof_leads_to_the_root_and_any_change_is_found(small):
    rows = merkle.manifest(small).collect()
    assert {merkle.folded(r.leaf, r.proof) for r in rows} == {rows[0].root}
    assert all(merkle.folded("0" * 64, r.proof) != r.root for r in rows)


def test_queue_delivers_children_in_order():
    top, held = merkle.sweep([f"{i:02d}" for i in range(10)], 3)
    assert [len(level) for level in held] == [10, 4, 2]
    assert held[1][3] == merkle.parent(["09"]) and held[2][0] == merkle.parent(held[1][:3]) and top == merkle.parent(held[2])
