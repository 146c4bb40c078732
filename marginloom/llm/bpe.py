"""BPE encoding and decoding of whole texts, long ones as a tree of parts.

A text of up to LEAF_CHARS is one leaf. A longer one is cut into leaves anywhere, white
space or not; tasks encode the leaves in parallel, and neighbours are joined pair by pair.
At a join the text around the cut is encoded anew, from a token start of the left part to a
token end of the right one, and the window doubles until its first tokens are those of the
left part and some of its last ones are those of the right part, by id and position. Byte
pair merges depend on neighbouring tokens only, so the parts and the window then agree for
good. A window that reaches both ends is the whole encoding.

Within a leaf that needs no positions, words between white space are encoded once per
worker and remembered: the vocabulary's normaliser and splitter never look across it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginloom.llm.common import for_python
from marginloom.llm.tokenizing import tokenizer

VOCABULARY = "word_bpe_49k.json"
LEAF_CHARS = 1 << 16
WINDOW_CHARS = 64
AGREEING_TOKENS = 4

# Words remembered per worker; the memory is emptied when it is full.
REMEMBERED = 400_000
MISSES_AT_ONCE = 2048
# Stands between words that are encoded together; words that hold it are encoded by themselves.
BORDER = "~"
# Letters, then signs but the apostrophe: the splitter cuts such a word between the two only, and only the letters have a case.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


@dataclass
class Part:
    """The tokens of text[begin:end]; starts and ends are places in the whole text."""

    begin: int
    end: int
    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def encode_part(text: str, begin: int, end: int, name: str) -> Part:
    encoded = tokenizer(name).encode(text[begin:end], add_special_tokens=False)
    at = np.array(encoded.offsets, np.int64).reshape(-1, 2) + begin
    return Part(begin, end, np.array(encoded.ids, np.int64), at[:, 0], at[:, 1])


def _same(a: Part, i: int, b: Part, j: int, n: int) -> bool:
    return all(
        len(x := getattr(a, f)[i : i + n]) == n and np.array_equal(x, getattr(b, f)[j : j + n]) for f in ("ids", "starts", "ends")
    )


def _meets(window: Part, right: Part, cut: int) -> tuple[int, int] | None:
    """The last places where the window's tokens go on as the right part's do, leaving out its last token."""
    for p in range(len(window.ids) - AGREEING_TOKENS - 1, -1, -1):
        if window.starts[p] < cut:
            return None
        q = int(np.searchsorted(right.starts, window.starts[p]))
        if _same(window, p, right, q, AGREEING_TOKENS):
            return p, q
    return None


def join(text: str, left: Part, right: Part, name: str) -> Part:
    """The tokens of both parts as of one text."""
    cut, reach = left.end, WINDOW_CHARS
    while True:
        i = max(0, int(np.searchsorted(left.starts, cut - reach, "right")) - 1)
        begin = int(left.starts[i]) if cut - reach > left.begin and i else left.begin
        i = i if begin > left.begin else 0
        j = int(np.searchsorted(right.ends, cut + reach))
        end = int(right.ends[j]) if j < len(right.ends) - 1 else right.end
        window = encode_part(text, begin, end, name)
        starts_right = begin == left.begin or _same(window, 0, left, i, AGREEING_TOKENS)
        if end == right.end:
            p, q = len(window.ids), len(right.ids)
            ends_right = True
        else:
            met = _meets(window, right, cut)
            p, q = met or (0, 0)
            ends_right = met is not None
        if starts_right and ends_right:
            parts = [np.concatenate([getattr(left, f)[:i], getattr(window, f)[:p], getattr(right, f)[q:]]) for f in ("ids", "starts", "ends")]
            return Part(left.begin, right.end, *parts)
        reach *= 2


def join_all(text: str, parts: list[Part], name: str) -> Part:
    """Join neighbours pair by pair, level by level."""
    while len(parts) > 1:
        paired = [join(text, a, b, name) for a, b in zip(parts[::2], parts[1::2], strict=False)]
        parts = paired + parts[len(paired) * 2 :]
    return parts[0]


def _marked(texts: list[bytes], at: list[int], keep: bool = False) -> list[bytes]:
    """The texts with a line end in place of some, or after them."""
    marked = list(texts)
    for i in at:
        marked[i] = texts[i] + b"\n" if keep else b"\n"
    return marked


class _Memory:
    """The ids and tokens of words, as written text."""

    def __init__(self, name: str):
        self.tokenizer = tokenizer(name)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(size)]
        ids = [b"%d" % i for i in range(size)]
        self.after_border = [_marked(t, self._border()) for t in (ids, self.tokens)]
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        ends = [i for i, t in enumerate(self.tokens) if suffix and t.endswith(suffix.encode())]
        self.after_ends = [_marked(t, ends, keep=True) for t in (ids, self.tokens)]
        self.ids: dict[bytes, bytes] = {}
        self.decoded: dict[bytes, bytes] = {}
        self.silent: set[bytes] = set()  # words without tokens

    def _border(self) -> list[int]:
        own = self.tokenizer.encode(BORDER, add_special_tokens=False).ids
        return own if len(own) == 1 else []

    def _written(self, text: str, tables: list[list[bytes]]) -> list[list[bytes]]:
        """Ids and tokens of a text, cut at the marks of the tables."""
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return [list(map(bytes.strip, b" ".join(map(t.__getitem__, ids)).split(b"\n"))) for t in tables]

    def _put(self, words: list[bytes], ids: list[bytes], decoded: list[bytes]) -> None:
        self.ids.update(zip(words, ids, strict=True))
        self.decoded.update(zip(words, decoded, strict=True))
        self.silent.update([w for w in words if not self.ids[w]])

    def _learn_plain(self, words: list[bytes]) -> list[bytes]:
        """Learn words of letters and signs after them from these two runs; returns the words that are not of that kind.

        The splitter cuts neither run, so each ends with its first token that ends a word.
        """
        matches = [PLAIN.fullmatch(w.decode("utf-8", "replace")) for w in words]
        cut = [(w, m[1].lower(), m[2]) for w, m in zip(words, matches, strict=True) if m]
        runs = list({stem for _, stem, _ in cut}.union([signs for _, _, signs in cut if signs]))
        pieces = self._written(" ".join(runs), self.after_ends)
        if not cut or len(pieces[0]) != len(runs) + 1:
            return words
        written = [dict(zip(runs, own, strict=False)) for own in pieces]
        self._put([w for w, _, _ in cut], *[[t[stem] + b" " + t[signs] if signs else t[stem] for _, stem, signs in cut] for t in written])
        return [w for w, m in zip(words, matches, strict=True) if not m]

    def learn(self, words: set[bytes]) -> None:
        if len(self.ids) > REMEMBERED:
            self.ids, self.decoded, self.silent = {}, {}, set()
        missing = sorted([w for w in words if w not in self.ids])  # in order, as words with the same letters share their ids
        for at in range(0, len(missing), MISSES_AT_ONCE):
            self._learn_others(self._learn_plain(missing[at : at + MISSES_AT_ONCE]))

    def _learn_others(self, words: list[bytes]) -> None:
        mark = BORDER.encode()
        alone = [w for w in words if b"<|" in w or mark in w]
        held = [w for w in words if b"<|" not in w and mark not in w]
        if held:
            ids, decoded = self._written(f" {BORDER} ".join([w.decode("utf-8", "replace") for w in held]), self.after_border)
            if len(ids) == len(held):
                self._put(held, ids, decoded)
            else:
                alone += held
        for word in alone:
            own = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
            self._put([word], [b" ".join([b"%d" % i for i in own])], [b" ".join([self.tokens[i] for i in own])])

    def texts(self, words: list[bytes]) -> tuple[bytes, bytes]:
        if self.silent and not self.silent.isdisjoint(words):
            words = [w for w in words if w not in self.silent]
        return b" ".join(map(self.ids.__getitem__, words)), b" ".join(map(self.decoded.__getitem__, words))


@cache
def _memory(name: str) -> _Memory:
    return _Memory(name)


def written(texts: list[bytes], name: str) -> Iterator[tuple[bytes, bytes]]:
    """For each text its ids as decimals and its decoded text, tokens joined by one space in both."""
    memory = _memory(name)
    split = [t.split() for t in texts]
    memory.learn(set().union(*split))
    for words in split:
        yield memory.texts(words)


DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _digest(ids: bytes, decoded: bytes) -> tuple[int, str, str]:
    return (ids.count(b" ") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())


def _digests(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_digest(*pair) for pair in written([t or b"" for t in batch.column("text").to_pylist()], name)]
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


PART = "doc_id bigint, row bigint, leaf int, text string, ids array<bigint>, starts array<bigint>, ends array<bigint>"


def _leaves(chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, row, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
                text = raw.decode("utf-8", "replace")
                cut = [text[i : i + chars] for i in range(0, len(text), chars)]
                n = len(cut)
                yield pa.record_batch(
                    [pa.array([doc_id] * n, pa.int64()), pa.array([row] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(cut, pa.string())],
                    names=["doc_id", "row", "leaf", "text"],
                )

    return run


def _encoded_leaves(name: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            parts = [encode_part(t, 0, len(t), name) for t in frame["text"]]
            yield frame.assign(ids=[p.ids for p in parts], starts=[p.starts for p in parts], ends=[p.ends for p in parts])

    return run


def _joined(name: str):
    def whole(frame: pd.DataFrame) -> Part:
        text, parts = "".join(frame["text"]), []
        at = 0
        for leaf, ids, starts, ends in zip(frame["text"], frame["ids"], frame["starts"], frame["ends"], strict=True):
            parts.append(Part(at, at + len(leaf), np.asarray(ids), np.asarray(starts) + at, np.asarray(ends) + at))
            at += len(leaf)
        return join_all(text, parts, name)

    return whole


def _long_digests(name: str):
    whole = _joined(name)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids = whole(frame.sort_values("leaf")).ids.tolist()
        decoded = tokenizer(name).decode(ids, skip_special_tokens=False)
        row = _digest(" ".join(map(str, ids)).encode(), decoded.encode())
        return pd.DataFrame([(frame["doc_id"].iloc[0], *row)], columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _long_ids(name: str):
    whole = _joined(name)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids = whole(frame.sort_values("leaf")).ids
        return pd.DataFrame({"doc_id": [frame["doc_id"].iloc[0]], "ids": [ids]})

    return run


def _short_ids(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [[int(i) for i in own.split()] for own, _ in written([t or b"" for t in batch.column("text").to_pylist()], name)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return run


def _split_by_length(docs: DataFrame, chars: int) -> tuple[DataFrame, DataFrame]:
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    long = F.col("chars") > chars
    return rows.filter(~long).drop("chars"), rows.filter(long).drop("chars")


def _long_parts(long: DataFrame, name: str, chars: int) -> DataFrame:
    """The encoded leaves, dealt over tasks one by one and grouped by text."""
    numbered = long.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", "text")
    leaves = numbered.mapInArrow(_leaves(chars), "doc_id bigint, row bigint, leaf int, text string").repartition("row", "leaf")
    return leaves.mapInPandas(_encoded_leaves(name), PART).groupBy("row")


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id and ids (array<bigint>) of every text; see round_trip for what odd rows give."""
    for_python(docs.sparkSession)
    short, long = _split_by_length(docs, leaf_chars)
    joined = _long_parts(long, vocabulary, leaf_chars).applyInPandas(_long_ids(vocabulary), "doc_id bigint, ids array<bigint>")
    return short.mapInArrow(_short_ids(vocabulary), "doc_id bigint, ids array<bigint>").unionByName(joined)


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    ids_sha256 is over the decimal ids joined by one space. A null or empty text has no
    tokens and decodes to nothing. Every row is encoded by itself, repeated ones and ones
    without a doc_id too. An empty table gives no rows; other columns are ignored.
    """
    for_python(docs.sparkSession)
    short, long = _split_by_length(docs, leaf_chars)
    joined = _long_parts(long, vocabulary, leaf_chars).applyInPandas(_long_digests(vocabulary), DIGEST)
    return short.mapInArrow(_digests(vocabulary), DIGEST).unionByName(joined)
