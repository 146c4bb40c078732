from collections import Counter

from marginloom.llm import quality_rules
from tests.llm import plain


def _want(text):
    m = plain.measures(text)
    return (*m, m[0] < 20 or 100 * m[4] > 30 * m[0])


def test_measures_match_plain(odd_twice, small, pairs):
    columns = ["doc_id", "text", "source"]
    docs = odd_twice.select(columns).unionByName(small.select(columns))
    rows = quality_rules.quality_table(docs).collect()
    assert Counter(tuple(r)[:7] for r in rows) == Counter((i, *_want(t)) for i, t in pairs(docs))
    assert not any(r.kept and r.base_failed for r in rows)


def test_host_verdicts(spark):
    good = " ".join(f"w{i}" for i in range(40))
    bad = "too short"
    rows = [(i, good if i % 10 else bad, "https://Good.example/x") for i in range(200)]
    rows += [(1000 + i, bad if i % 10 else good, "https://bad.example/y") for i in range(200)]
    rows += [(2000, bad, "https://single.example/"), (2001, good, "https://single.example/"), (2002, good, None), (2003, good, "plain")]
    out = quality_rules.quality_table(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    kept = {r.doc_id for r in out.filter("kept").collect()}
    assert kept == {i for i in range(200) if i % 10} | {2001, 2002, 2003}


def test_documents_keep_their_columns(odd):
    out = quality_rules.good_documents(odd)
    assert out.columns == odd.columns
    assert {r.doc_id for r in out.collect()} >= {5, 19, 21}
    assert quality_rules.good_documents(odd.limit(0)).count() == 0
