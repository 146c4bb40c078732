"""Vectorised word and shingle hashes of UTF-8 texts, for use inside tasks.

Words are maximal runs of bytes other than space and \\t..\\r; A-Z are lower-cased. Each
word hashes to 64 bits, and a shingle combines its words' hashes, so white space between
words does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base, kept for the longest chunk seen so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def at_least(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, n), _powers(_BASE_INVERSE, n)
        return cls.up[:n], cls.down[:n]


class Words:
    """The words of some texts: byte ranges in ``data``, hashes, and where each text's words start in ``at``."""

    def __init__(self, texts: list[bytes], lower: bool = True):
        joined = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        self.space = _SPACE[self.data]
        edge = np.flatnonzero(np.diff(self.space, prepend=True))
        self.starts, self.ends = edge[::2], edge[1::2]
        up, down = _Powers.at_least(len(self.data) + 1)
        prefix = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
        lengths = (self.ends - self.starts).astype(np.uint64)
        self.hashes = mix((prefix[self.ends] - prefix[self.starts]) * down[self.starts] + lengths * np.uint64(0xD6E8FEB86659FD93))
        self.begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])  # of the texts, in bytes
        self.at = np.searchsorted(self.starts, self.begins)

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all runs of ``width`` words, those across texts included; at least ``width`` words are needed."""
        weights = window_weights(width)
        n = max(0, len(self.hashes) - width + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(width):
            rolled += self.hashes[k : k + n] * weights[k]
        return mix(rolled)


def window_weights(width: int) -> np.ndarray:
    return mix(np.arange(1, width + 1, dtype=np.uint64) * _BASE) | np.uint64(1)


def chunks(texts: Iterator[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about CHUNK_BYTES, with the place of the first."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        if held and size + len(text) > CHUNK_BYTES:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield first, held


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending.

    A text of fewer than ``width`` words is one shingle of all its words; a text without
    words has none.
    """
    weights = window_weights(width)
    out: list[np.ndarray] = []
    for _, held in chunks(iter(texts)):
        words = Words(held)
        rolled = words.windows(width)
        for begin, end in zip(words.at[:-1], words.at[1:], strict=True):
            count = end - begin
            if count >= width:
                out.append(np.unique(rolled[begin : end - width + 1]))
            elif count:
                short = (words.hashes[begin:end] * weights[:count]).sum(dtype=np.uint64, keepdims=True)
                out.append(mix(short + np.array([count], np.uint64) * _BASE))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
