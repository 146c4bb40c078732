from collections import defaultdict

import numpy as np
import pytest

from marginloom.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank int, score string"


def _frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(int(i), [float(x) for x in v], 0, 1, "s") for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def _by_query(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    return out


def _exact(vectors, query, k):
    """(id, score), best first; sums go coordinate by coordinate."""
    scores = ann.exact_products(vectors[query], vectors)
    order = [i for i in np.lexsort((np.arange(len(vectors)), -scores)) if i != query][:k]
    return [(int(i), float(scores[i])) for i in order]


@pytest.mark.parametrize("scaled", [False, True])
def test_recall_and_scores(spark, scaled):
    r = np.random.default_rng(1)
    vectors = r.normal(size=(1500, 32))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    if scaled:
        vectors *= r.uniform(0.5, 2, (1500, 1))
    vectors = vectors.astype(np.float32).astype(float)
    found = _by_query(ann.nearest(_frame(spark, vectors), _frame(spark, vectors[::20], range(0, 1500, 20)).withColumnRenamed("vec_id", "query_id"), group_bytes=200 * 32 * 8))
    recall = []
    for q in range(0, 1500, 20):
        assert [x[0] for x in found[q]] == list(range(1, 21))
        best = dict(_exact(vectors, q, 1499))
        assert all(best[i] == s for _, i, s in found[q])
        assert [(-s, i) for _, i, s in found[q]] == sorted((-s, i) for _, i, s in found[q])
        recall.append(len({i for i, _ in _exact(vectors, q, 20)} & {i for _, i, _ in found[q]}) / 20)
    assert np.mean(recall) >= 0.9


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    vectors = np.array([r.embedding for r in rows], float)
    place = {r.vec_id: i for i, r in enumerate(rows)}
    found = _by_query(ann.search_table(table))
    assert set(found) == {r.vec_id for r in rows if r.vec_id % 20 == 0}
    recall = [
        len({rows[i].vec_id for i, _ in _exact(vectors, place[q], 20)} & {i for _, i, _ in hits}) / 20 for q, hits in found.items()
    ]
    assert np.mean(recall) >= 0.9


def test_copies_ties_and_unusable_rows(spark):
    r = np.random.default_rng(2)
    vectors = np.vstack([np.tile(r.normal(size=8), (60, 1)), r.normal(size=(30, 8))]).astype(np.float32).astype(float)
    nan, inf = float("nan"), float("inf")
    odd = [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [nan] * 8), (1004, [inf] * 8), (1005, [None] * 8), (1006, [1.0] * 3), (None, [1.0] * 8)]
    extra = spark.createDataFrame([(i, v, None, None, None) for i, v in odd], SCHEMA)
    good = _frame(spark, vectors)
    table = good.unionByName(extra).unionByName(good.filter("vec_id = 3"))
    found = _by_query(ann.nearest(table, table.filter("vec_id in (0, 5, 70, 1002)").withColumnRenamed("vec_id", "query_id"), group_bytes=16 * 8 * 8))
    assert set(found) == {0, 5, 70}
    assert [i for _, i, _ in found[5]] == [i for i, _ in _exact(vectors, 5, 20)]
    assert [i for _, i, _ in found[0]] == list(range(1, 21))


def test_fewer_rows_than_asked(spark):
    vectors = np.eye(4)
    found = _by_query(ann.nearest(_frame(spark, vectors), _frame(spark, vectors[:1]).withColumnRenamed("vec_id", "query_id")))
    assert [(i, s) for _, i, s in found[0]] == [(1, 0.0), (2, 0.0), (3, 0.0)]
    assert ann.search_table(_frame(spark, vectors).limit(0)).count() == 0


def test_perturbations_come_in_order_of_cost():
    within = np.random.default_rng(4).uniform(size=5)
    steps = ann.perturbations(within, 60)
    cost = (np.where(steps < 0, within, 0) ** 2 + np.where(steps > 0, 1 - within, 0) ** 2).sum(axis=1)
    assert (np.diff(cost) >= -1e-12).all() and len({tuple(s) for s in steps}) == 60
    every = np.array(np.meshgrid(*[[-1, 0, 1]] * 5)).reshape(5, -1).T
    best = np.sort((np.where(every < 0, within, 0) ** 2 + np.where(every > 0, 1 - within, 0) ** 2).sum(axis=1))[:60]
    assert np.allclose(cost, best)
