from collections import Counter

from marginloom.llm import line_dedup
from tests.llm import plain


def test_counts_match_plain(odd_twice, small, pairs):
    docs = odd_twice.select("doc_id", "text").unionByName(small.selectExpr("doc_id + 1000 doc_id", "text"))
    want = Counter((i, n, lost, plain.sha(kept)) for i, n, lost, kept in plain.kept_lines(pairs(docs)))
    assert Counter(tuple(r) for r in line_dedup.line_counts(docs).collect()) == want
    assert sum(n * lost for (_, _, lost, _), n in want.items()) > 0


def test_documents_keep_their_columns(odd, pairs):
    out = line_dedup.without_common_lines(odd)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    kept = {i: k for i, _, _, k in plain.kept_lines(pairs(odd))}
    rows = {r.doc_id: r for r in out.collect()}
    assert {i: r.text for i, r in rows.items() if i != 1} == {i: k for i, k in kept.items() if i != 1}
    assert rows[1].text is None
    assert rows[6].n_chars == len(rows[6].text)


def test_levels_are_merged(spark, odd):
    lines = line_dedup._occurrences(line_dedup._keyed(odd), 4)
    runs = line_dedup.LineRuns(spark, 4, fanout=2)
    for batch in range(4):
        runs.add(lines.filter(f"batch = {batch}"))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    want = lines.groupBy("h1", "h2").agg({"doc": "max"}).collect()
    assert {(r.h1, r.holder) for r in runs.lines().collect()} == {(r.h1, r["max(doc)"]) for r in want}
    runs.close()


def test_empty_table(odd):
    assert line_dedup.without_common_lines(odd.limit(0)).count() == 0
