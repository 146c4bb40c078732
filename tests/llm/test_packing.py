import zlib
from collections import defaultdict

import numpy as np
import pytest

from marginloom.llm import packing
from marginloom.llm.tokenizing import byte_ids, tokenizer


def check(rows, docs, tokens=packing.TOKENS):
    """Every token once, pieces as agreed, sequences gapless; the number of sequences."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in docs:
        ids = np.array([*tokenizer(packing.VOCABULARY).encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cut = packing.pieces_of(len(ids), tokens)
        want = [(p, s, n, zlib.crc32(ids[s : s + n].tobytes())) for p, (s, n) in enumerate(cut)]
        assert sorted(pieces.pop(doc_id)) == want
    assert not pieces
    for held in sequences.values():
        held.sort()
        assert [o for o, _ in held] == [0, *np.cumsum([n for _, n in held])[:-1]]
        assert sum(n for _, n in held) <= tokens
    return len(sequences)


def test_all_tokens_are_packed(odd, small, pairs):
    docs = odd.select("doc_id", "text").unionByName(small.selectExpr("doc_id + 1000 doc_id", "text"))
    rows = packing.packed(docs).collect()
    total = sum(r.length for r in rows)
    assert check(rows, pairs(docs)) <= 1.05 * total / packing.TOKENS + 1


def test_small_groups_are_packed_again(small, pairs):
    rows = packing.packed(small, group_pieces=20).collect()
    one = packing.packed(small).collect()
    assert check(rows, pairs(small)) <= 1.1 * check(one, pairs(small)) + 1


def test_repeated_and_empty(odd_twice, odd):
    rows = packing.packed(odd_twice).collect()
    assert sum(r.doc_id == 2 for r in rows) == 2 and all(r.length == 1 for r in rows if r.doc_id in (1, 2))
    assert sum(r.doc_id is None for r in rows) == 3
    assert packing.packed(odd.limit(0)).count() == 0


def test_pieces():
    assert packing.pieces_of(5, 4) == [(0, 1), (1, 4)]
    assert packing.pieces_of(8, 4) == [(0, 4), (4, 4)]
    assert packing.pieces_of(4, 4) == [(0, 4)]


def test_exchanges_raise_squares_and_empty_sequences():
    # 6 + 3, 5 + 4 and 2 in tens: exchanging 4 and 3 makes room for 2
    lengths = np.array([6, 3, 5, 4, 2])
    out = packing.local_search([[0, 1], [2, 3], [4]], lengths, 10)
    assert len(out) == 2 and sorted(i for b in out for i in b) == list(range(5))


def test_tightest_room():
    """A sequence with 3 free and pieces of 2 and 5 takes 3 as it is, or up to 5 or 8 for a piece given back."""
    rooms = packing._Rooms(10)
    rooms.add(0, [2, 5], 3)
    found = lambda size, most=10, least=0: rooms.tightest(size, least, [7], most)
    assert found(3) == (0, 0, 0) and found(4) == (1, 0, 2) and found(7) == (1, 0, 5)
    assert found(9) is None and found(7, most=0) is None and found(3, least=8) is None
    rooms.drop(0, [2, 5], 3)
    assert rooms.filled == 0 and found(1) is None


@pytest.mark.parametrize("seed", range(5))
def test_packs_near_the_bound(seed):
    r = np.random.default_rng(seed)
    lengths = np.minimum(2047, r.lognormal(6, 1, 3000).astype(int) + 1)
    bins = packing.pack(lengths)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    assert all(lengths[b].sum() <= 2048 for b in bins)
    assert len(bins) <= -(-lengths.sum() // 2048) + 2


@pytest.mark.parametrize("text", ["", "a<|endoftext|>b", " " * 3000, "\n\n \t x", "ß日本\U0001f600é", "don't 1234 'S", "x" * 5000])
def test_fast_ids_are_the_librarys(text):
    want = tokenizer(packing.VOCABULARY).encode(text, add_special_tokens=False).ids
    assert byte_ids(text, packing.VOCABULARY).tolist() == want


def test_similar_lengths_are_searched_to_the_end():
    """A group of the full size, of lengths that best fit packs badly: every sequence is looked at."""
    lengths = np.random.default_rng(0).integers(500, 901, packing.GROUP_PIECES)
    first = packing.best_fit(lengths, packing.TOKENS)
    out = packing.local_search(first, lengths, packing.TOKENS)
    assert sorted(i for b in out for i in b) == list(range(len(lengths)))
    assert max(sum(lengths[b]) for b in out) <= packing.TOKENS
    assert len(out) <= 7305 < len(first)


def test_an_exchange_ends_fuller():
    """Against all moves, 1-1 and 2-1 exchanges by brute force: none that raises the squares is left."""
    r = np.random.default_rng(5)
    for _ in range(40):
        lengths = r.integers(1, 40, 14)
        out = packing.local_search(packing.best_fit(lengths, 60), lengths, 60)
        if len(out) == -(-lengths.sum() // 60):
            continue
        sums = [sum(lengths[b]) for b in out]
        for low, a in enumerate(out):
            for full, b in enumerate(out):
                if low == full or sums[low] > sums[full]:
                    continue
                given = [(i,) for i in a] + [(i, j) for i in a for j in a if i < j]
                for g in given:
                    for back in [0, *lengths[b]]:
                        gain = sum(lengths[list(g)]) - back
                        assert not (gain > 0 and sums[full] + gain <= 60)
