"""Ranked lexical search of a set of items by dense blocked matrix products.

Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A first
pass over the documents counts, per document, all terms and those that some item has; the
sparse counts are written once. Document frequencies follow from them. In the second pass
the items are cut into tiles, and a tile's terms into a compact vocabulary. For each tile of
documents the impacts of the tile's terms are laid out as a dense matrix of float64 and
multiplied with the items' weights by BLAS. Weights and impacts are whole numbers; a tile's
terms are cut so that no sum of a product can reach 2^53, so every product is exact, and the
parts are added as 64-bit integers. Of each product an item keeps its k best documents and
no more: all above the k-th score and of those with that score the smallest ids.

The items are a stated query set; they come to the driver in groups of bounded size, and
documents are read in blocks. Statistics cover all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginloom.llm.common import for_python, stored

K = 10
# Fixed values of the scoring rule.
WEIGHT_SCALE, IMPACT_SCALE, TF_SCALE, LENGTH_SCALE, LENGTH_PERCENT = 1000, 1_000_000_000, 1000, 8, 75
LARGEST_IMPACT = IMPACT_SCALE // TF_SCALE
EXACT = 2**53
# Items are held in groups of about so many bytes of text, and multiplied in tiles of so many.
GROUP_BYTES, ITEM_TILE = 2 << 20, 64
# Documents of a tile, and cells of an impact matrix at most.
DOC_TILE, TILE_CELLS = 1024, 1 << 21
NO_ID = -(2**63)

_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return (text or b"").translate(_SPLIT).split()


def weight(documents: int, frequency: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * documents + 2) / (2 * frequency + 1)))


@dataclass
class ItemTile:
    """Some items over the compact vocabulary of their terms, cut into parts that sum exactly."""

    items: list[int]  # places of the items in their group
    vocabulary: np.ndarray  # ids of terms, ascending
    parts: list[tuple[int, int]]  # from and to, in the vocabulary
    layers: list[tuple[int, np.ndarray]]  # factor, and items x vocabulary: a term's weight times its occurrences, over the factor


def _layers(dense: np.ndarray, exact: int) -> list[tuple[int, np.ndarray]]:
    """The weights as they are, or as high and low digits if an item repeats a term so often that one product is not exact."""
    if dense.max(initial=0) * LARGEST_IMPACT < exact:
        return [(1, dense)]
    digit = max(1, (exact - 1) // LARGEST_IMPACT)
    out, factor = [], 1
    while dense.any():
        out.append((factor, dense % digit))
        dense, factor = dense // digit, factor * digit
    return out


def tiles(counts: list[Counter], weights: dict[int, int], size: int = ITEM_TILE, most_terms: int = TILE_CELLS // DOC_TILE, exact: int = EXACT) -> list[ItemTile]:
    """Cut items, given by their term counts, into tiles, and a tile's terms into parts; terms without weight are left out."""
    out = []
    for first in range(0, len(counts), size):
        chosen = range(first, min(first + size, len(counts)))
        vocabulary = np.array(sorted({t for i in chosen for t in counts[i] if weights.get(t)}), np.int64)
        place = {t: j for j, t in enumerate(vocabulary.tolist())}
        dense = np.zeros((len(chosen), len(vocabulary)))
        for row, i in enumerate(chosen):
            for term, n in counts[i].items():
                if term in place:
                    dense[row, place[term]] = n * weights[term]
        layers = _layers(dense, exact)
        most = np.max([layer for _, layer in layers], axis=0) * LARGEST_IMPACT
        parts, begin, bound = [], 0, np.zeros(len(chosen))
        for j in range(len(vocabulary)):
            if j > begin and (j - begin == most_terms or (bound + most[:, j]).max() >= exact):
                parts.append((begin, j))
                begin, bound = j, np.zeros(len(chosen))
            bound = bound + most[:, j]
        if len(vocabulary) > begin:
            parts.append((begin, len(vocabulary)))
        out.append(ItemTile(list(chosen), vocabulary, parts, layers))
    return out


def norms(lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """The length norms of documents, in Python's integers, where their products may pass 64 bits."""
    return np.array([100 - LENGTH_PERCENT + (LENGTH_PERCENT * n * documents) // total for n in lengths.tolist()], np.int64)


def impacts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """The impact of terms that occur ``tf`` times in documents of these norms."""
    return (IMPACT_SCALE * tf) // (TF_SCALE * tf + LENGTH_SCALE * norm)


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best positive scores, highest first, equal ones by ascending id; no tie is lost."""
    found = np.flatnonzero(scores > 0)
    if len(found) > k:
        kth = np.partition(scores[found], len(found) - k)[len(found) - k]
        above, level = found[scores[found] > kth], found[scores[found] == kth]
        room = k - len(above)
        if len(level) > room:
            level = level[np.argpartition(ids[level], room - 1)[:room]]
        found = np.concatenate([above, level])
    return found[np.lexsort((ids[found], -scores[found]))]


class _Best:
    """The best documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.scores, self.ids = k, [np.zeros(0, np.int64)] * items, [np.zeros(0, np.int64)] * items

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.scores[item]) == self.k and scores.max(initial=0) < self.scores[item][-1]:
            return
        best = top_rows(scores, ids, self.k)
        scores, ids = np.concatenate([self.scores[item], scores[best]]), np.concatenate([self.ids[item], ids[best]])
        best = top_rows(scores, ids, self.k)
        self.scores[item], self.ids[item] = scores[best], ids[best]


def _counted(vocabulary: dict[bytes, int]):
    """Per document its number of terms, and the ids and counts of those of the vocabulary, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ids, counts = [], [], []
            for text in batch.column("text").to_pylist():
                found = terms(text)
                seen = Counter(map(vocabulary.get, found))
                seen.pop(None, None)
                lengths.append(len(found))
                ids.append(sorted(seen))
                counts.append([seen[t] for t in ids[-1]])
            columns = [batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.record_batch(columns, names=["doc_id", "length", "terms", "counts"])

    return run


def _multiplied(held: list[ItemTile], items: int, documents: int, total: int, k: int, doc_tile: int):
    """Per item of the group its best documents among those of the task."""

    def block(rows: pa.Table, best: _Best) -> None:
        ids = rows.column("doc_id").combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)
        lists = rows.column("terms").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        term = lists.flatten().to_numpy(zero_copy_only=False)
        tf = rows.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(ids)), sizes)
        value = impacts(tf, norms(rows.column("length").to_numpy(), documents, total)[doc]).astype(np.float64)
        for tile in held:
            if not len(tile.vocabulary):
                continue
            place = np.searchsorted(tile.vocabulary, term)
            place[place == len(tile.vocabulary)] = 0
            own = np.flatnonzero(tile.vocabulary[place] == term)
            if not len(own):
                continue
            at, docs, of = place[own], doc[own], value[own]
            scores = np.zeros((len(tile.items), len(ids)), np.int64)
            for begin, end in tile.parts:
                inside = (at >= begin) & (at < end)
                dense = np.zeros((end - begin, len(ids)))
                dense[at[inside] - begin, docs[inside]] = of[inside]
                for factor, weights in tile.layers:
                    scores += factor * np.matmul(weights[:, begin:end], dense).astype(np.int64)
            for row, item in enumerate(tile.items):
                best.add(item, scores[row], ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, waiting, rows = _Best(items, k), [], 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= doc_tile:
                table = pa.Table.from_batches(waiting)
                whole = rows // doc_tile * doc_tile
                for at in range(0, whole, doc_tile):
                    block(table.slice(at, doc_tile), best)
                waiting, rows = table.slice(whole).to_batches(), rows - whole
        if rows:
            block(pa.Table.from_batches(waiting), best)
        item = np.repeat(np.arange(items), [len(s) for s in best.scores])
        columns = [pa.array(item, pa.int32()), pa.array(np.concatenate([*best.ids, np.zeros(0, np.int64)])), pa.array(np.concatenate([*best.scores, np.zeros(0, np.int64)]))]
        yield pa.record_batch(columns, names=["item", "doc", "score"])

    return run


def _groups(items: DataFrame, group_bytes: int) -> Iterator[list]:
    """The distinct items in groups of about ``group_bytes`` of text."""
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("binary").alias("text")).distinct()
    size = rows.agg(F.sum(F.octet_length("text") + F.lit(64))).first()[0] or 0
    parts = max(1, -(-size // group_bytes))
    for part in range(parts):
        yield rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()


def ranked(
    docs: DataFrame, items: DataFrame, k: int = K, group_bytes: int = GROUP_BYTES, item_tile: int = ITEM_TILE, doc_tile: int = DOC_TILE, cells: int = TILE_CELLS
) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` documents with the highest scores above 0.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored.
    Equal scores rank by ascending doc_id, rows without a doc_id first. A null text has no
    terms; a document without terms is not counted and is never found, and an item without
    terms finds nothing. Repeated documents are found each. Equal items are searched once;
    items that share only their id are ranked each on its own. Empty tables give no rows.
    """
    spark = docs.sparkSession
    for_python(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    results = None
    for group in _groups(items, group_bytes):
        bags = [Counter(terms(bytes(row.text or b""))) for row in group]
        vocabulary = {term: i for i, term in enumerate(sorted({t for bag in bags for t in bag}))}
        counted = stored(texts.mapInArrow(_counted(vocabulary), "doc_id bigint, length bigint, terms array<int>, counts array<int>"), "term-counts")
        seen = counted.agg(F.count_if(F.col("length") > 0), F.sum("length")).first()
        documents, total = seen[0], seen[1] or 0
        if not documents or not vocabulary:
            continue
        # one row per term of the group's items: bounded by the group's bytes
        frequencies = {r.term: r.n for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
        weights = {term: weight(documents, n) for term, n in frequencies.items()}
        held = tiles([Counter({vocabulary[t]: n for t, n in bag.items()}) for bag in bags], weights, item_tile, max(1, cells // doc_tile))
        names = spark.createDataFrame([(i, row.item_id) for i, row in enumerate(group)], "item int, item_id bigint")
        best = counted.filter(F.size("terms") > 0).mapInArrow(_multiplied(held, len(group), documents, total, k, doc_tile), "item int, doc bigint, score bigint")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))
        top = best.withColumn("rank", place).filter(F.col("rank") <= k).join(F.broadcast(names), "item")
        part = top.select("item_id", F.col("rank").cast("int").alias("rank"), F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "score")
        results = part if results is None else results.unionByName(part)
    return results if results is not None else spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
