"""Packing documents into sequences of a fixed number of tokens.

Documents are tokenised once; longer ones are cut. Pieces are dealt by hash into groups of
a bounded number of pieces and each group is packed: best fit, longest first, and then a
local search over the underfull sequences. It exchanges one piece for one, two for one, or
moves a piece whenever that raises the sum of squared fills, always towards the fuller of
two sequences, until sequences are empty or nothing improves. The sequences that a group
leaves open are packed once more with those of other groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginloom.llm.common import for_python, stored
from marginloom.llm.tokenizing import byte_ids

TOKENS = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
GROUP_PIECES = 20_000
# Sequences below this fill are packed once more with those of other groups.
OPEN_PERCENT = 97

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces_of(n: int, tokens: int = TOKENS) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than ``tokens``."""
    first = n if n <= tokens else n % tokens or tokens
    return [(0, first), *((at, tokens) for at in range(first, n, tokens))]


def _pieces(tokens: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(byte_ids((text or b"").decode("utf-8", "replace"), name), np.uint32(END_ID))
                for piece, (start, length) in enumerate(pieces_of(len(ids), tokens)):
                    out.append((doc_id, piece, start, length, zlib.crc32(ids[start : start + length].astype("<u4").tobytes())))
            columns = zip(*out, strict=True) if out else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit, longest first: the pieces of each sequence. The set of free spaces is one integer's bits."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        fitting = spaces >> need
        if fitting:
            free = need + (fitting & -fitting).bit_length() - 1
            at = by_free[free].pop()
            if not by_free[free]:
                spaces ^= 1 << free
            bins[at].append(item)
        else:
            at, free = len(bins), capacity
            bins.append([item])
        by_free[free - need].append(at)
        spaces |= 1 << (free - need)
    return bins


class _Rooms:
    """What each sequence could take in, by room: its free space alone, or with one piece given back.

    A bucket for every number of tokens holds (sequence, length given back); one integer's
    bits tell which buckets are not empty, so the tightest room is found at once.
    """

    def __init__(self, capacity: int):
        self.capacity, self.buckets, self.filled = capacity, [{} for _ in range(capacity + 1)], 0

    def _places(self, at: int, lengths: Iterable[int], free: int) -> Iterator[tuple[int, tuple[int, int]]]:
        if free:
            for back in {0, *lengths}:
                yield free + back, (at, back)

    def add(self, at: int, lengths: Iterable[int], free: int) -> None:
        for room, entry in self._places(at, lengths, free):
            self.buckets[room][entry] = None
            self.filled |= 1 << room

    def drop(self, at: int, lengths: Iterable[int], free: int) -> None:
        for room, entry in self._places(at, lengths, free):
            del self.buckets[room][entry]
            if not self.buckets[room]:
                self.filled &= ~(1 << room)

    def tightest(self, size: int, least_fill: int, fill: list[int], most_left: int) -> tuple[int, int, int] | None:
        """(space left, sequence, length given back) of the tightest room for ``size`` that ends fuller; leaves at most ``most_left``."""
        rooms = self.filled >> size
        while rooms:
            left = (rooms & -rooms).bit_length() - 1
            if left > most_left:
                return None
            for at, back in self.buckets[size + left]:
                if back < size and fill[at] >= least_fill:
                    return left, at, back
            rooms &= rooms - 1
        return None


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Exchange pieces between underfull sequences while that raises the sum of squared fills.

    Each underfull sequence, the emptiest first, gives one or two pieces to any fuller one and
    takes at most one smaller piece back; of all such exchanges the one that leaves the least
    space comes first. This goes on over all underfull sequences until a pass finds no
    exchange, or no fewer sequences could hold the tokens. Every exchange moves tokens to
    the fuller of two sequences, so the sum of squares grows and the search ends.
    """
    held: list[dict[int, list[int]]] = []  # by length the pieces of a sequence
    for b in bins:
        held.append({})
        for i in b:
            held[-1].setdefault(int(lengths[i]), []).append(i)
    fill = [sum(n * len(p) for n, p in h.items()) for h in held]
    least = -(-sum(fill) // capacity)
    count, improved, rooms = len(held), True, _Rooms(capacity)
    for at, h in enumerate(held):
        rooms.add(at, h, capacity - fill[at])

    def put(at: int, size: int, piece: int) -> None:
        held[at].setdefault(size, []).append(piece)
        fill[at] += size

    def take(at: int, size: int) -> int:
        piece = held[at][size].pop()
        if not held[at][size]:
            del held[at][size]
        fill[at] -= size
        return piece

    while improved and count > least:
        improved = False
        for low in sorted((at for at, n in enumerate(fill) if 0 < n < capacity), key=lambda at: (fill[at], at)):
            if not 0 < fill[low] < capacity:
                continue
            rooms.drop(low, held[low], capacity - fill[low])
            while held[low] and count > least:
                best = None
                for sizes in _given(held[low]):
                    size = sum(sizes)
                    found = rooms.tightest(size, fill[low], fill, capacity if best is None else best[0][0])
                    if found:
                        left, at, back = found
                        rank = (left, back - size)
                        if best is None or rank < best[0]:
                            best = (rank, sizes, at, back)
                if best is None:
                    break
                _, sizes, at, back = best
                rooms.drop(at, held[at], capacity - fill[at])
                returned = take(at, back) if back else None
                for size in sizes:
                    put(at, size, take(low, size))
                if returned is not None:
                    put(low, back, returned)
                rooms.add(at, held[at], capacity - fill[at])
                improved = True
                count -= not held[low]
            rooms.add(low, held[low], capacity - fill[low] if held[low] else 0)
    return [sorted(i for pieces in h.values() for i in pieces) for h in held if h]


def _given(held: dict[int, list[int]]) -> Iterator[tuple[int, ...]]:
    """The different lengths, and pairs of lengths, that a sequence can give."""
    sizes = sorted(held, reverse=True)
    for i, one in enumerate(sizes):
        yield (one,)
        if len(held[one]) > 1:
            yield (one, one)
        for other in sizes[i + 1 :]:
            yield (one, other)


def pack(lengths: np.ndarray, capacity: int = TOKENS) -> list[list[int]]:
    """Sequences of at most ``capacity`` for pieces of these lengths: their places in ``lengths``."""
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def _packed(tokens: int, base: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "row"], ignore_index=True)
        lengths = frame["length"].to_numpy()
        sequence, offset, fill = (np.zeros(len(frame), np.int64) for _ in range(3))
        for number, members in enumerate(pack(lengths, tokens)):
            ends = np.cumsum(lengths[members])
            sequence[members] = base + int(key[0]) * 2**24 + number
            offset[members] = ends - lengths[members]
            fill[members] = ends[-1]
        return frame.assign(sequence_id=sequence, offset=offset, fill=fill).drop(columns="group")

    return run


def _grouped(pieces: DataFrame, tokens: int, base: int, group_pieces: int) -> DataFrame:
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(_packed(tokens, base), f"{PIECE}, row bigint, sequence_id bigint, offset bigint, fill bigint")


def packed(docs: DataFrame, tokens: int = TOKENS, vocabulary: str = VOCABULARY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``docs`` has doc_id and text; other columns are ignored. A document's tokens are its
    text's ids and then END_ID, so a null or empty text has one token. Pieces of repeated
    rows, or of rows without a doc_id, are packed like any others. An empty table gives no
    rows. Every token of every document is in exactly one sequence.
    """
    spark = docs.sparkSession
    for_python(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    cut = texts.mapInArrow(_pieces(tokens, vocabulary), PIECE).withColumn("row", F.monotonically_increasing_id())
    pieces = stored(cut, "pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = pieces.filter(F.col("length") == tokens).withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("bigint")})
    first = stored(_grouped(pieces.filter(F.col("length") < tokens), tokens, 0, group_pieces), "packed")
    closed = 100 * F.col("fill") >= OPEN_PERCENT * tokens
    again = _grouped(first.filter(~closed).select("doc_id", "piece", "start", "length", "ids_crc32", "row"), tokens, 2**62, group_pieces)
    return full.select(*names).unionByName(first.filter(closed).select(*names)).unionByName(again.select(*names))
