"""Near-duplicate documents by bottom-k sketches of one hash function, without losing a link.

Every text is the set of its word shingles, hashed once to 64 bits. A document's sketch
holds its k smallest hashes, with k in proportion to its size: k = n - ceil(t n) + 1. Two
sets of similarity t or more then always share a retained value, so the inverted lists of
retained values generate every link; nothing rests on chance.

1. Documents with equal sets form a class; one of each class goes on.
2. Hash values that many documents share are marked in a bitmap of fixed size and come last
   in the order of the sketch, so a common passage fills no sketch. The bitmap only orders:
   any bitmap gives the same links.
3. Lists of up to SMALL_LIST documents give pairs. How often a pair meets is its overlap
   within the sketches; with the sizes it bounds the similarity over the union of both sets
   from above, and pairs that cannot reach t go. Each document's first pair is verified on
   the full sets, links are joined into components, and of the other pairs only those
   between different components are verified.
4. Longer lists consist of documents that are mostly common text. Those that meet in such
   lists form blocks; each pair of blocks is compared as a matrix product over full sets and
   returns only a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginloom.llm.common import for_python, stored
from marginloom.llm.graph import components
from marginloom.llm.shingles import mix, shingle_sets

# Values that a chunk of documents holds LOCAL_COMMON times, and all such chunks COMMON times, are
# ordered last. A sketch holds low values, so only a little more than that range is counted.
LOCAL_COMMON = 2
COMMON = 16
COUNTED_RANGE = 1.75
CHUNK_VALUES = 1 << 22
BITMAP_BITS = 1 << 24

# Longest list that gives pairs. If unmarked longer lists hold more than REBUILD_SHARE of the
# documents, their values are marked as well and the sketches are built once more.
SMALL_LIST = 64
REBUILD_SHARE = 0.01
BLOCK_DOCS = 1024

SHOWN = "kind int, doc_id bigint, n bigint, f1 bigint, f2 bigint"


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").to_pylist()]


def _fingerprint(values: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set of hashes."""
    first, second = mix(values + np.uint64(1)), mix(values ^ np.uint64(0x5851F42D4C957F2D))
    return int(first.sum(dtype=np.uint64).view(np.int64)), int(second.sum(dtype=np.uint64).view(np.int64))


def _sets_and_common(width: int, percent: int):
    """Per document its set's size and fingerprint; per chunk of documents the values it holds often."""

    counted = np.uint64(int(min(1.0, COUNTED_RANGE * (100 - percent) / 100) * (2**64 - 1)))

    def common(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= LOCAL_COMMON
        values, counts = values[often].view(np.int64), counts[often]
        none = pa.nulls(len(values), pa.int64())
        return pa.record_batch([np.ones(len(values), np.int32), none, counts.astype(np.int64), values, none], names=["kind", "doc_id", "n", "f1", "f2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, seen = 0, set()
        for batch in batches:
            sets = shingle_sets(_texts(batch), width)
            prints = [_fingerprint(s) for s in sets]
            n = np.array([len(s) for s in sets], np.int64)
            f1, f2 = (np.array([p[i] for p in prints], np.int64) for i in (0, 1))
            yield pa.record_batch([np.zeros(len(n), np.int32), batch.column("doc_id"), n, f1, f2], names=["kind", "doc_id", "n", "f1", "f2"])
            for s, p in zip(sets, prints, strict=True):
                if p not in seen:
                    seen.add(p)
                    low = s[: np.searchsorted(s, counted)]
                    held.append(low)
                    size += len(low)
                    if size >= CHUNK_VALUES:
                        yield common(held)
                        held, size, seen = [], 0, set()
        if held:
            yield common(held)

    return run


def _words(cells: DataFrame) -> DataFrame:
    """A bitmap of the numbers in ``cell``: at most BITMAP_BITS / 64 rows (word, bits)."""
    bits = cells.selectExpr("shiftrightunsigned(cell, 6) word", "shiftleft(1L, cast(cell & 63 as int)) bit")
    return bits.groupBy("word").agg(F.bit_or("bit").alias("bits"))


def _cell(hashed):
    return F.shiftrightunsigned(hashed, 64 - (BITMAP_BITS.bit_length() - 1))


def _bitmap(common: DataFrame) -> np.ndarray:
    """A bit for every common value, in an array whose size does not depend on the data."""
    often = common.groupBy("f1").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON)
    return _collected(_words(often.select(_cell("f1").alias("cell"))))


def _collected(words: DataFrame) -> np.ndarray:
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    for word, bits in words.collect():
        out[word] = bits
    return out


def _wanted(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the named documents and a few more, found without a shuffle of all texts.

    The broadcast bitmap has a bounded number of rows; where it fills up, more texts pass.
    """
    words = F.broadcast(_words(ids.select(_cell(F.xxhash64("doc_id")).alias("cell"))))
    cell = _cell(F.xxhash64("doc_id"))
    found = texts.withColumn("cell", cell).join(words, F.expr("shiftrightunsigned(cell, 6)") == words["word"])
    return stored(found.filter("bits & shiftleft(1L, cast(cell & 63 as int)) <> 0").select("doc_id", "text"), "wanted")


def ordered(values: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Places of the values in the order of the sketch: common ones behind all others."""
    cell = (values >> np.uint64(64 - (BITMAP_BITS.bit_length() - 1))).astype(np.int64)
    hot = (bitmap[cell >> 6].view(np.uint64) >> (cell & 63).astype(np.uint64)) & np.uint64(1)
    return (values >> np.uint64(1)) | (hot << np.uint64(63))


def sketch_size(n: int, percent: int) -> int:
    """How many smallest values two sets of at least that similarity cannot both be without sharing one."""
    return n - -(-percent * n // 100) + 1


def _sketches(width: int, percent: int, bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bitmap.value
        for batch in batches:
            ids, sizes, sketches = [], [], []
            for doc_id, values in zip(batch.column("doc_id").to_pylist(), shingle_sets(_texts(batch), width), strict=True):
                if doc_id is None or not len(values):
                    continue
                order = ordered(values, words)
                k = sketch_size(len(values), percent)
                order = np.sort(np.partition(order, k - 1)[:k] if k < len(order) else order)
                ids.append(doc_id)
                sizes.append(len(values))
                sketches.append(order.view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sketches])]).astype(np.int32)
            flat = np.concatenate(sketches) if sketches else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), lists], names=["doc_id", "n", "sketch"]
            )

    return run


def _lists(texts: DataFrame, nodes: DataFrame, width: int, percent: int, bitmap: np.ndarray) -> DataFrame:
    """The inverted lists of two and more documents: value, doc_id, n, docs, first, is_long."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)
    sketches = texts.mapInArrow(_sketches(width, percent, shared), "doc_id bigint, n bigint, sketch array<bigint>")
    alone = sketches.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    of_list = Window.partitionBy("value")
    lists = (
        alone.select("doc_id", "n", F.explode("sketch").alias("value"))
        .select("value", "doc_id", "n", F.count("*").over(of_list).alias("docs"), F.min("doc_id").over(of_list).alias("first"))
        .filter("docs > 1")
    )
    return stored(lists.withColumn("is_long", F.col("docs") > SMALL_LIST), "lists", "is_long")


def _pairs_of_lists(percent: int):
    """Pairs (a, b), a before b, of the rows of each list; equal pairs of a batch are counted together."""

    def pairs(frame: pd.DataFrame) -> pd.DataFrame:
        value, doc = frame["value"].to_numpy(), frame["doc_id"].to_numpy()
        n = frame["n"].to_numpy()
        begin = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        length = np.diff(np.concatenate([begin, [len(value)]]))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for g in np.unique(length[length > 1]):
            i, j = np.triu_indices(g, 1)
            at = begin[length == g][:, None]
            left.append((at + i).ravel())
            right.append((at + j).ravel())
        i, j = np.concatenate(left), np.concatenate(right)
        near = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (doc[i] != doc[j])
        i, j = i[near], j[near]
        swap = doc[i] > doc[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        out = pd.DataFrame({"a": doc[i], "b": doc[j], "na": n[i], "nb": n[j]})
        return out.groupby(["a", "b", "na", "nb"], sort=False).size().rename("met").reset_index()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for frame in batches:
            held.append(frame)
            rows += len(frame)
            if rows >= 100_000:
                whole = pd.concat(held, ignore_index=True)
                last = int((whole["value"].to_numpy() != whole["value"].iloc[-1]).sum())
                yield pairs(whole.iloc[:last])
                held, rows = [whole.iloc[last:]], len(whole) - last
        if rows:
            yield pairs(pd.concat(held, ignore_index=True))

    return run


def _verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (shingle_sets([t or b"" for t in batch.column(c).to_pylist()], width) for c in ("text_a", "text_b"))
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)], np.int64)
            union = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)], np.int64) - both
            linked = pa.array(100 * both >= percent * union)
            yield pa.record_batch([batch.column("a").filter(linked), batch.column("b").filter(linked)], names=["a", "b"])

    with_a = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def _forest(width: int, percent: int):
    """Within one pair of blocks: all similarities as a matrix product, returned as a spanning forest."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        first, second = key[1], key[2]
        frame = frame.sort_values(["block", "doc_id"], ignore_index=True)
        ids, block = frame["doc_id"].to_numpy(), frame["block"].to_numpy()
        sets = shingle_sets([t or b"" for t in frame["text"]], width)
        size = np.array([len(s) for s in sets], np.int64)
        values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), size)
        shared = times[column] > 1  # the others are in no overlap
        values, column, row = values[times > 1], (np.cumsum(times > 1) - 1)[column[shared]], row[shared]
        rows, others = np.flatnonzero(block == first), np.flatnonzero(block == second)
        place = np.full(len(sets), -1)
        place[rows] = np.arange(len(rows))
        behind = np.full(len(sets), -1)
        behind[others] = np.arange(len(others))
        overlap = np.zeros((len(rows), len(others)), np.float32)
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        span = 4096  # columns of the matrix held at once
        for low in range(0, len(values), span):
            lo, hi = np.searchsorted(column, [low, low + span])
            c, r = column[lo:hi] - low, row[lo:hi]
            x, y = np.zeros((len(rows), span), np.float32), np.zeros((len(others), span), np.float32)
            inside = place[r] >= 0
            x[place[r[inside]], c[inside]] = 1
            inside = behind[r] >= 0
            y[behind[r[inside]], c[inside]] = 1
            overlap += x @ y.T
        both = np.rint(overlap).astype(np.int64)
        linked = 100 * both >= percent * (size[rows][:, None] + size[others][None, :] - both)
        root = np.arange(len(sets))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        out = []
        for i, j in zip(*np.nonzero(linked), strict=True):
            p, q = find(rows[i]), find(others[j])
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((ids[rows[i]], ids[others[j]]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _links_of_long_lists(postings: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    meets = postings.select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()
    groups = components(meets)
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("int").alias("blocks"))
    placed = groups.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    # block i meets every block, itself included, once
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("component", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), F.col("node").alias("doc_id"))
    return (
        met.join(texts, "doc_id")
        .groupBy("component", "first", "second")
        .applyInPandas(_forest(width, percent), "a bigint, b bigint")
    )


def link_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id bigint, text string).

    component_id is the smallest doc_id reachable over links of at least ``percent`` / 100
    Jaccard similarity; kept marks the row whose own id it is. Documents without words and
    rows without a doc_id are linked with nothing; the latter have no component_id and are
    kept. Rows that share a doc_id count as one document, linked with each other. An empty
    table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    for_python(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    scanned = stored(texts.mapInArrow(_sets_and_common(width, percent), SHOWN), "sets", "kind")
    sets = scanned.filter("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "f1", "f2")

    full = sets.filter("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("node"))
    nodes = stored(classes, "classes")

    common = scanned.filter("kind = 1").select("f1", "n")
    bitmap = _bitmap(common)
    lists = _lists(texts, nodes, width, percent, bitmap)
    unmarked = lists.filter("is_long and value >= 0")  # the highest bit marks common values
    if unmarked.select("doc_id").distinct().count() > REBUILD_SHARE * nodes.count():
        more = unmarked.select(F.shiftright("value", 63 - (BITMAP_BITS.bit_length() - 1)).alias("cell"))
        lists = _lists(texts, nodes, width, percent, bitmap | _collected(_words(more)))

    met = (
        lists.filter("not is_long")
        .select("value", "doc_id", "n")
        .repartition("value")
        .sortWithinPartitions("value")
        .mapInPandas(_pairs_of_lists(percent), "a bigint, b bigint, na bigint, nb bigint, met bigint")
        .groupBy("a", "b", "na", "nb")
        .agg(F.sum("met").alias("met"))
    )
    # All shared values up to the lower sketch end were met here, unless the pair also meets in a long list.
    rest = f"ceil({percent} * greatest(na, nb) / 100) - 1"
    bound = F.expr(f"least(na, nb, met + {rest})")
    pairs = stored(met.filter(100 * bound >= percent * (F.col("na") + F.col("nb") - bound)).select("a", "b").distinct(), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(lists.filter("is_long").select("doc_id"))
    texts = _wanted(texts, ids)

    firsts = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = stored(_verify(firsts, texts, width, percent), "first-links")
    near = components(links)
    rest_of = pairs.join(firsts, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        named = near.select(F.col("node").alias(end), F.col("component").alias(f"component_{end}"))
        rest_of = rest_of.join(named, end, "left")
    apart = rest_of.filter("component_a is null or component_b is null or component_a <> component_b")
    more = _verify(apart.select("a", "b"), texts, width, percent)
    long = _links_of_long_lists(lists.filter("is_long"), texts, width, percent)
    keys = ["f1", "f2", "n_shingles"]
    of_many = full.groupBy("doc_id").agg(F.min(F.struct(*keys)).alias("low"), F.max(F.struct(*keys)).alias("high")).filter("low <> high")
    shared = full.join(of_many.select("doc_id"), "doc_id", "left_semi").join(nodes, keys)
    all_links = (
        links.unionByName(stored(more, "more-links"))
        .unionByName(stored(long, "long-links"))
        .unionByName(shared.select(F.col("node").alias("a"), F.col("doc_id").alias("b")))
    )

    labels = components(all_links)
    named = nodes.join(labels, "node", "left").select(
        "f1", "f2", "n_shingles", F.coalesce("component", "node").alias("component_id")
    )
    linked = _join_classes(full, named, keys)
    alone = sets.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _join_classes(full: DataFrame, named: DataFrame, keys: list[str], salts: int = 32) -> DataFrame:
    """Every document's component by its class; a class of very many copies is cut into parts."""
    salted = full.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    copies = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "salt"]).select("doc_id", "n_shingles", "component_id")


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies: of each linked group the one with the smallest doc_id stays.

    Rows without a doc_id stay. Columns and their order are those of ``docs``.
    """
    gone = link_groups(docs, width, percent).filter(~F.col("kept")).select("doc_id").distinct()
    ids = gone.select(F.col("doc_id").alias("_gone"))
    return docs.join(ids, docs["doc_id"].cast("bigint") == ids["_gone"], "left_anti")
