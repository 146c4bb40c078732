"""Nearest neighbours by inner product with multiprobe p-stable hashing.

Vectors are scaled by the largest norm and lifted to the unit sphere with one more
coordinate, queries are normalised, so that the largest inner product is the smallest
Euclidean distance. Each of TABLES tables cuts HASHES random Gaussian projections into
cells of width CELL; a bucket is a tuple of cells. A query visits its own bucket and then,
in the order of estimated success, the PROBES - 1 buckets next to it whose boundaries lie
nearest. The candidates of all tables are merged and scored exactly, in double precision.

All rows are indexed. Buckets are dealt by hash into groups of about GROUP_BYTES of vectors; a
group that a frequent vector makes larger is cut into blocks, and the queries that probe it
visit every block. A task scores one block and returns at most k results per query, so no
pair table arises. Queries for which the probes found fewer than k rows are compared with
all rows, block by block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginloom.llm.common import for_python, stored

TABLES = 12
HASHES = 6
CELL = 1.5
PROBES = 96
SEED = 8
GROUP_BYTES = 32 << 20


@dataclass(frozen=True)
class Hashing:
    """The hash functions: fixed by the seed and the vectors' dimension."""

    dimension: int
    largest_norm: float
    tables: int = TABLES
    hashes: int = HASHES
    cell: float = CELL
    seed: int = SEED

    @cached_property
    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        r = np.random.default_rng(self.seed)
        return r.normal(size=(self.dimension + 1, self.tables * self.hashes)), r.uniform(0, self.cell, self.tables * self.hashes)

    def places(self, vectors: np.ndarray, queries: bool) -> np.ndarray:
        """Positions on all projections in cells: (rows, tables, hashes)."""
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        if queries:
            lifted = np.hstack([vectors / norms, np.zeros_like(norms)])
        else:
            lifted = np.hstack([vectors / self.largest_norm, np.sqrt(np.maximum(0.0, 1 - (norms / self.largest_norm) ** 2))])
        directions, shifts = self.functions
        return ((lifted @ directions + shifts) / self.cell).reshape(len(vectors), self.tables, self.hashes)


def bucket_keys(cells: np.ndarray, table: int) -> np.ndarray:
    """A 64-bit key for each tuple of cells of a table."""
    key = np.full(len(cells), table + 1, np.uint64)
    for column in cells.astype(np.int64).view(np.uint64).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def perturbations(within: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` most promising cell offsets of a query at ``within`` its cell, its own cell first.

    A step to a neighbouring cell costs the squared distance to the boundary; sets of steps
    are taken from a heap in the order of their sums, each grown from a cheaper one.
    """
    n = len(within)
    cost = np.concatenate([within**2, (1 - within) ** 2])
    step = np.repeat([-1, 1], n)
    place = np.tile(np.arange(n), 2)
    order = np.argsort(cost, kind="stable")
    cost, step, place = cost[order].tolist(), step[order].tolist(), place[order].tolist()
    out = [np.zeros(n, np.int64)]
    heap: list[tuple[float, tuple[int, ...]]] = [(cost[0], (0,))]
    while heap and len(out) < count:
        total, chosen = heapq.heappop(heap)
        if len({place[c] for c in chosen}) == len(chosen):
            offset = np.zeros(n, np.int64)
            for c in chosen:
                offset[place[c]] = step[c]
            out.append(offset)
        last = chosen[-1]
        if last + 1 < 2 * n:
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
    return np.stack(out)


def _vectors(column: pa.Array) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column.to_numpy(zero_copy_only=False)]) if len(column) else np.zeros((0, 0))


INDEXED = "table_no int, group_no int, vec_id bigint, bucket bigint, vector array<double>"
PROBED = "table_no int, group_no int, query_id bigint, buckets array<bigint>, vector array<double>"


def _group(keys: np.ndarray, groups: int) -> np.ndarray:
    return ((keys.view(np.uint64) >> np.uint64(7)) % np.uint64(groups)).astype(np.int32)


def _index(hashing: Hashing, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.floor(hashing.places(_vectors(batch.column("vector")), False))
            for table in range(hashing.tables):
                keys = bucket_keys(cells[:, table], table)
                yield pa.record_batch(
                    [np.full(len(keys), table, np.int32), _group(keys, groups), batch.column("vec_id"), keys, batch.column("vector")],
                    names=["table_no", "group_no", "vec_id", "bucket", "vector"],
                )

    return run


def _probe(hashing: Hashing, groups: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            places = hashing.places(_vectors(batch.column("vector")), True)
            rows = []
            for i, (query, vector) in enumerate(zip(batch.column("query_id").to_pylist(), batch.column("vector").to_pylist(), strict=True)):
                for table in range(hashing.tables):
                    own = np.floor(places[i, table])
                    keys = bucket_keys(own + perturbations(places[i, table] - own, probes), table)
                    group = _group(keys, groups)
                    for g in np.unique(group):
                        rows.append((table, int(g), query, keys[group == g], vector))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
            yield pa.record_batch(
                [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                names=["table_no", "group_no", "query_id", "buckets", "vector"],
            )

    return run


def exact_products(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products summed coordinate by coordinate: equal vectors give equal scores wherever they stand."""
    out = np.zeros(len(vectors))
    for i, x in enumerate(query):
        out += x * vectors[:, i]
    return out


def _best(query_id: int, query: np.ndarray, ids: np.ndarray, vectors: np.ndarray, runs: list[tuple[int, int]], k: int):
    """The k best rows of the runs (begin, end) but the query's own, best first, ties to the smaller id.

    A fast product finds the rows that can be among them, with room for its rounding; these
    are scored exactly.
    """
    rough = np.concatenate([vectors[a:b] @ query for a, b in runs])
    rows = np.concatenate([np.arange(a, b) for a, b in runs])
    rough[ids[rows] == query_id] = -np.inf
    if len(rows) > k:
        least = np.partition(rough, len(rough) - k)[len(rough) - k]
        rows = rows[rough >= least - 1e-9 * (1 + abs(least))]
    rows = rows[ids[rows] != query_id]
    scores = exact_products(query, vectors[rows])
    order = np.lexsort((ids[rows], -scores))[:k]
    return [(query_id, int(ids[rows[i]]), float(scores[i])) for i in order]


def _scored(k: int):
    def run(indexed: pd.DataFrame, probing: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(indexed) and len(probing):
            indexed = indexed.sort_values("bucket", kind="stable", ignore_index=True)
            vectors = np.stack(indexed["vector"].to_numpy())
            ids, buckets = indexed["vec_id"].to_numpy(), indexed["bucket"].to_numpy()
            for query_id, wanted, query in zip(probing["query_id"], probing["buckets"], probing["vector"], strict=True):
                runs = [(0, len(ids))]
                if wanted is not None:
                    low, high = np.searchsorted(buckets, wanted), np.searchsorted(buckets, wanted, "right")
                    runs = [(a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True) if a < b]
                if runs:
                    out += _best(int(query_id), np.asarray(query), ids, vectors, runs, k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (array<double>) of the rows that take part.

    Null, empty and zero vectors, vectors with null or non-finite components and rows
    without an id do not, nor do vectors of another length than most (ties: the longer).
    Of rows that share an id each takes part.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    nonzero = F.exists("vector", lambda x: x != 0)
    return rows.filter(F.col("vec_id").isNotNull() & F.coalesce(finite & nonzero, F.lit(False)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, probes: int = PROBES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products found for each query.

    ``vectors`` has vec_id and embedding, ``queries`` query_id and embedding; a query never
    finds the row of its own id. Ties go to the smaller vec_id; repeated rows of one id
    count once. Every query gets k rows, or all there are. Tables without usable vectors
    give no rows.
    """
    spark = vectors.sparkSession
    for_python(spark)
    rows = usable(vectors)
    asked = usable(queries.withColumnRenamed("query_id", "vec_id")).withColumnRenamed("vec_id", "query_id")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    lengths = rows.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("rows"), F.max(norm).alias("norm"))
    found = lengths.orderBy(F.desc("rows"), F.desc("length")).first()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if found is None:
        return spark.createDataFrame([], result)
    rows, asked = (df.filter(F.size("vector") == found.length) for df in (rows, asked))
    hashing = Hashing(found.length, found.norm)
    group_rows = max(1, group_bytes // (8 * found.length))
    groups = max(1, -(-found.rows // group_rows))

    indexed = rows.mapInArrow(_index(hashing, groups), INDEXED)
    keys = ["table_no", "group_no"]
    indexed = stored(indexed, "indexed")
    blocks = indexed.groupBy(*keys).agg(F.ceil(F.count("*") / (2 * group_rows)).cast("int").alias("blocks"))
    cut = indexed.join(blocks, keys).withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")).drop("blocks")
    probing = asked.mapInArrow(_probe(hashing, groups, probes), PROBED)
    visits = probing.join(blocks, keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    keys = [*keys, "block"]
    shown = "query_id bigint, vec_id bigint, score double"
    hits = cut.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(_scored(k), shown)
    hits = stored(hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "hits")

    few = hits.groupBy("query_id").count().filter(F.col("count") >= k)
    missing = asked.join(few, "query_id", "left_anti")
    rest = rows.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("block"), "vec_id", F.lit(0).cast("bigint").alias("bucket"), "vector"
    )
    everywhere = missing.select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("block"), "query_id", F.lit(None).cast("array<bigint>").alias("buckets"), "vector"
    )
    whole = rest.groupBy("block").cogroup(everywhere.groupBy("block")).applyInPandas(_scored(k), shown)
    merged = hits.unionByName(whole).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = merged.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def search_table(vectors: DataFrame, every: int = 20) -> DataFrame:
    """The 20 nearest of every row whose id is a multiple of ``every``."""
    queries = vectors.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return nearest(vectors, queries)
