"""A Merkle tree over a dataset: a root, and for every row a proof that it is part of it.

Rows are leaves; a tree of FANOUT children a node stands over each source's leaves, ordered
by id, and one more over the sources' roots. Nodes are worked through by time-forward
processing: every node has a label in an order in which children come before parents, and a
node's digest is a message to its parent's label. Messages wait in a priority queue ordered
by label, and a node is made when its label is the least in the queue. The queue is external:
a heap holds the messages between nodes of one block of FANOUT^LEVELS consecutive leaves,
those that leave a block are written, shuffled and sorted by label. A reversed sweep goes
from the root down: each node sends its children the proof steps from its own level up, and
a child puts its own step before them, so every leaf receives its whole proof.

The number of sweeps is the number of levels over LEVELS. A task holds one block, whatever
the size of a source. Everything between sweeps lies in the shared folder.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginloom.llm.common import for_python, stored

FANOUT, LEVELS = 3, 5

LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """The digest of a row; ``text`` stands in for its text."""
    fields = [_field(F.col(c)) for c in LEAF_COLUMNS[:-1]]
    return F.sha2(F.concat(*fields, _field(text)).cast("binary"), 256)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text without its line breaks where crc32 of the id is even, else the text."""
    even = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def parent(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def sweep(leaves: list[str], levels: int) -> tuple[str, list[list[str]]]:
    """The digest ``levels`` above consecutive leaves, and the digests of every level below it.

    Time-forward: labels are (level, place); each node's digest goes to its parent's label, and
    the queue hands the children of the least label to it, left to right.
    """
    held: list[list[str]] = [[] for _ in range(levels + 1)]
    queue = [(0, i, i, digest) for i, digest in enumerate(leaves)]
    while queue:
        level, place = queue[0][:2]
        children = []
        while queue and queue[0][:2] == (level, place):
            children.append(heapq.heappop(queue)[3])
        digest = parent(children) if level else children[0]
        held[level].append(digest)
        if level < levels:
            heapq.heappush(queue, (level + 1, place // FANOUT, place, digest))
    return held[levels][0], held[:-1]


def _step(level: list[str], place: int) -> str:
    """A node's siblings to its left and right."""
    first = place // FANOUT * FANOUT
    return "".join(level[first:place]) + ":" + "".join(level[place + 1 : first + FANOUT])


def proofs(held: list[list[str]], above: str) -> list[str]:
    """The proof steps of all leaves below a node whose own steps are ``above``: the reversed sweep."""
    messages = [above]
    for level in reversed(held):
        messages = [f"{_step(level, place)}/{messages[place // FANOUT]}" for place in range(len(level))]
    return messages


def folded(digest: str, steps: str) -> str:
    """The root that a leaf's digest leads to along its proof steps."""
    for step in steps.split("/")[:-1]:
        before, after = step.split(":")
        digest = parent([before, digest, after])
    return digest


def siblings(steps: str) -> str:
    return steps.replace(":", "").replace("/", "")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``place``, counting from 0 within ``key`` in the order of ``order``.

    Rows are sorted by range and written; only the counts of the ranges' parts meet, so no
    key passes through one task. Equal rows are told apart by their place in the input.
    """
    keys = ["key", *order, "_row"]
    loose = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "unsorted")
    ordered = loose.repartitionByRange(_partitions(rows), *keys).sortWithinPartitions(*keys).drop("_row")
    written = stored(ordered.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    written = written.withColumn("_part", F.shiftright("_at", 33))
    starts = written.groupBy("_part", "key").agg(F.count("*").alias("rows"), F.min("_at").alias("first"))
    before = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = starts.select("_part", "key", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("_shift"))
    joined = written.join(shifts, ["_part", "key"])
    return stored(joined.withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift"), "placed")


def _batches(schema: pa.Schema, rows: Iterator[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict | None, list[dict]]]:
    """The (key, block) of each block, the message for it, if any, and its nodes in order."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for at, block in groupby(rows, key=lambda r: (r["key"], r["block"])):
        nodes = list(block)
        message = nodes.pop(0) if nodes[0]["message"] else None
        yield at, message, nodes


def _delivered(nodes: DataFrame, messages: DataFrame, size: int) -> DataFrame:
    """Nodes (key, place, ...) sorted by block, the message (key, block, ...) for a block before its nodes."""
    rows = nodes.withColumns({"block": F.floor(F.col("place") / size).cast("bigint"), "message": F.lit(False)})
    both = rows.unionByName(messages.withColumn("message", F.lit(True)), allowMissingColumns=True)
    return both.repartition(_partitions(nodes), "key", "block").sortWithinPartitions("key", "block", F.desc("message"), "place")


def _levels(size: Column) -> Column:
    """How many levels stand above ``size`` leaves: the least n with FANOUT^n >= size."""
    steps = [(size > F.lit(FANOUT**n).cast("bigint")).cast("int") for n in range(39)]
    return sum(steps[1:], steps[0])


def _finishing(sizes: DataFrame, number: int, size: int) -> DataFrame:
    """The keys (key, n, ...) whose last sweep this is, and the levels it climbs, as messages to their only block."""

    def left(sweeps: int) -> Column:
        return F.ceil(F.col("n") / F.lit(size**sweeps).cast("bigint")).cast("bigint")

    last = left(number) <= size
    if number:
        last = last & (left(number - 1) > size)
    return sizes.filter(last).withColumns({"levels": _levels(left(number)).cast("int"), "block": F.lit(0).cast("bigint")}).drop("n")


class Forest:
    """The trees over the leaves (key, place, digest, ...) of every key, one sweep a file of nodes.

    ``roots`` has key and digest. ``proofs`` is the reversed sweep.
    """

    def __init__(self, leaves: DataFrame, levels: int = LEVELS):
        self.levels, self.block = levels, FANOUT**levels
        self.sizes = stored(leaves.groupBy("key").agg(F.count("*").alias("n")), "sizes")
        most = self.sizes.agg(F.max("n")).first()[0] or 0
        self.sweeps = 1
        while most > self.block**self.sweeps:
            self.sweeps += 1
        self.nodes = [leaves]
        for number in range(self.sweeps):
            self.nodes.append(stored(self._up(number), "nodes"))
        done = [made.filter("done").select("key", "digest") for made in self.nodes[1:]]
        self.roots = done[0]
        for more in done[1:]:
            self.roots = self.roots.unionByName(more)

    def _waiting(self, number: int) -> DataFrame:
        return self.nodes[number].filter("not done") if number else self.nodes[0]

    def _up(self, number: int) -> DataFrame:
        schema = pa.schema([("key", pa.string()), ("place", pa.int64()), ("digest", pa.string()), ("done", pa.bool_())])
        levels = self.levels

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                for (key, block), message, nodes in _blocks(batches):
                    top, _ = sweep([n["digest"] for n in nodes], message["levels"] if message else levels)
                    yield key, block, top, message is not None

            return _batches(schema, rows())

        nodes = self._waiting(number).select("key", "place", "digest")
        return _delivered(nodes, _finishing(self.sizes, number, self.block), self.block).mapInArrow(run, "key string, place bigint, digest string, done boolean")

    def proofs(self, above: DataFrame, finish, schema: str, columns: pa.Schema) -> DataFrame:
        """The reversed sweep: ``above`` has each key's ``steps`` above its root and ``root``.

        ``finish`` makes a row of ``schema`` of each leaf's row, its proof steps and its key's root.
        """
        sizes = self.sizes.join(above, "key")
        messages = None
        for number in reversed(range(self.sweeps)):
            own = _finishing(sizes, number, self.block)
            messages = own if messages is None else own.unionByName(messages)
            delivered = _delivered(self._waiting(number), messages, self.block)
            if number == 0:
                return delivered.mapInArrow(_down(finish, columns), schema)
            kinds = pa.schema([("key", pa.string()), ("block", pa.int64()), ("levels", pa.int32()), ("steps", pa.string()), ("root", pa.string())])
            sent = delivered.mapInArrow(_down(_to_block(self.levels), kinds), "key string, block bigint, levels int, steps string, root string")
            messages = stored(sent, "proof-steps")


def _to_block(levels: int):
    """Makes the message to the block below a node, which climbs all ``levels`` to it."""
    return lambda node, steps, root: (node["key"], node["place"], levels, steps, root)


def _down(finish, columns: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for _, message, nodes in _blocks(batches):
                _, held = sweep([n["digest"] for n in nodes], message["levels"])
                for node, steps in zip(nodes, proofs(held, message["steps"]), strict=True):
                    yield finish(node, steps, message["root"])

        return _batches(columns, rows())

    return run


def _key(source: Column) -> Column:
    """A key that is never null and sorts rows without a source first, others by their bytes."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Per row: doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified, ``proof``.

    ``docs`` has doc_id, source, lang, n_chars and text; other columns are ignored. ``proof``
    holds the steps from the leaf to the root, each the siblings to the left, a colon and
    those to the right, ended by a slash. The leaf that folded_root starts from is the
    tampered one where tampering changes the text. Nulls are fields and sources of their own;
    rows of a source without a doc_id come first, and rows that share a doc_id are ordered by
    their leaves. Equal rows are leaves each. A single row's leaf is the root. An empty table
    gives no rows.
    """
    for_python(docs.sparkSession)
    text = F.col("text").cast("string")
    changed = tampered_text(F.col("doc_id"), text)
    rows = docs.select(
        _key(F.col("source")).alias("key"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        leaf_digest(text).alias("digest"),
        F.when(changed != text, leaf_digest(changed)).alias("tampered"),
    )
    forest = Forest(placed(rows, ["doc_id", "digest", "tampered"]), levels)
    subroots = placed(forest.roots.select(F.lit("top").alias("key"), F.col("key").alias("name"), "digest"), ["name"])
    top = Forest(subroots, levels)
    found = top.roots.first()
    root = found["digest"] if found else None
    whole = top.sizes.select("key").withColumns({"steps": F.lit(""), "root": F.lit(root).cast("string")})
    above = pa.schema([("key", pa.string()), ("steps", pa.string()), ("root", pa.string())])
    to_sources = stored(top.proofs(whole, lambda node, steps, _: (node["name"], steps, node["digest"]), "key string, steps string, root string", above), "source-proofs")

    def finish(node: dict, steps: str, subroot: str) -> tuple:
        reached = folded(node["tampered"] or node["digest"], steps)
        source = None if node["key"] == "n" else node["key"][1:]
        proof = hashlib.sha256(siblings(steps).encode()).hexdigest()
        return node["doc_id"], source, node["digest"], subroot, root, proof, reached, reached == root, steps

    names = ["source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof"]
    kinds = {"doc_id": pa.int64()} | {n: pa.string() for n in names} | {"verified": pa.bool_()}
    schema = "doc_id bigint, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof string"
    return forest.proofs(to_sources, finish, schema, pa.schema([(n, kinds[n]) for n in kinds]))


def manifest_table(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    return manifest(docs, levels).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
