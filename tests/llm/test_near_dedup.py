import numpy as np
from marginloom.llm import near_dedup
from marginloom.llm.graph import components
from tests.llm import plain


def _groups(df, width):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.link_groups(df, width).collect()}


def test_links_match_plain(odd, small, pairs):
    docs = odd.select("doc_id", "text").unionByName(small.selectExpr("doc_id + 1000 doc_id", "text"))
    want = plain.link_groups(pairs(docs), 4)
    assert _groups(docs, 4) == want
    assert sum(i != c for i, (_, c) in want.items()) > 5


def test_long_lists_and_rebuilt_order(spark, monkeypatch, pairs):
    """Many variants of one text, linked only through some: block route and spanning forests."""
    monkeypatch.setattr(near_dedup, "SMALL_LIST", 4)
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 16)
    r = np.random.default_rng(3)
    rows = []
    for i in range(90):
        words = [f"w{k}" for k in range(120)]
        for place in r.choice(120, int(r.integers(0, 9)), replace=False):
            words[place] = f"x{i}_{place}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert _groups(docs, 5) == plain.link_groups(rows, 5)


def test_odd_rows(odd_twice):
    rows = near_dedup.link_groups(odd_twice, 4).collect()
    assert len(rows) == odd_twice.count()
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    by_id = {r.doc_id: r.component_id for r in rows}
    assert by_id[2] == 2 and by_id[3] == 3 and by_id[9] == 8 and by_id[21] == 5 and by_id[13] == 12


def test_rows_of_one_id_are_linked(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    docs = spark.createDataFrame([(5, a), (5, b), (3, a), (4, b), (9, "other words stand here")], "doc_id bigint, text string")
    assert {(r.doc_id, r.component_id) for r in near_dedup.link_groups(docs, 4).collect()} == {(5, 3), (3, 3), (4, 3), (9, 9)}


def test_stage_keeps_columns(odd):
    out = near_dedup.near_dedup(odd)
    assert out.columns == odd.columns
    ids = {r.doc_id for r in out.collect()}
    assert 8 in ids and not ids & {9, 10, 21}
    assert near_dedup.near_dedup(odd.limit(0)).count() == 0


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (7, 7)], "a bigint, b bigint")
    found = {r.node: r.component for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}


def test_sketches_of_similar_sets_meet():
    r = np.random.default_rng(0)
    for n in (1, 2, 4, 5, 9, 10, 47, 200):
        whole = r.integers(0, 2**63, n, dtype=np.uint64)
        for drop in range(n):
            if 100 * (n - drop) < 80 * n:
                break
            a, b = np.sort(whole), np.sort(r.permutation(whole)[drop:])
            k = [near_dedup.sketch_size(len(x), 80) for x in (a, b)]
            assert set(a[: k[0]]) & set(b[: k[1]])
