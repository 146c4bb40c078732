"""Quality rules judged per document and per host.

Each document is measured once and checked against a few rules. Failures are counted per
rule and host; a host's rate is shrunk towards the rate of all hosts by a beta prior fitted
to the hosts' own rates, so a host with few documents is not condemned for one of them. A
host of which more than half the documents would fail a rule, by its shrunk rate, loses all
its documents; the host verdicts are joined back to the documents.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginloom.llm.common import for_python, salted_left_join, stored
from marginloom.llm.shingles import Words, chunks

MIN_WORDS = 20
WINDOW = 8
REPEATED_PERCENT = 30
SYMBOL_PERCENT = 10
DUPLICATE_LINE_PERCENT = 30
HOST_LIMIT = 0.5

# Condemned hosts up to this number are broadcast; more are joined with a shuffle.
BROADCAST_HOSTS = 100_000

SYMBOLS = b"#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _repeated(words: Words) -> np.ndarray:
    """How many words of each text lie in a window that the text holds twice or more."""
    n = len(words.hashes)
    counts = np.diff(words.at)
    if n < WINDOW:
        return np.zeros(len(counts), np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    starts = np.flatnonzero(text[: n - WINDOW + 1] == text[WINDOW - 1 :])
    keys = words.windows(WINDOW)[starts]
    order = np.lexsort((keys, text[starts]))
    k, t = keys[order], text[starts][order]
    same = (k[1:] == k[:-1]) & (t[1:] == t[:-1])
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    held = starts[order][twice]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, held, 1)
    np.add.at(edge, held + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return covered[words.at[1:]] - covered[words.at[:-1]]


def _duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def measure(texts: list[bytes]) -> pd.DataFrame:
    """The MEASURES of every text."""
    parts = []
    for _, held in chunks(iter(texts)):
        words = Words(held, lower=False)

        def per_text(mask: np.ndarray, begins: np.ndarray = words.begins) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(mask)])
            return total[begins[1:]] - total[begins[:-1]]

        starts_point = (words.data & 0xC0) != 0x80
        parts.append(
            pd.DataFrame(
                {
                    "n_words": np.diff(words.at),
                    "word_chars": per_text(starts_point & ~words.space),
                    "n_symbols": per_text(_SYMBOL[words.data]),
                    "n_dup_lines": [_duplicate_lines(t) for t in held],
                    "n_repeat_words": _repeated(words),
                    "n_lines": [t.count(b"\n") + 1 for t in held],
                }
            )
        )
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=MEASURES, dtype="int64")


@F.pandas_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def _measured(texts: pd.Series) -> pd.DataFrame:
    return measure([t or b"" for t in texts])


def rules(m: Mapping[str, Column]) -> dict[str, Column]:
    """The rules a document can fail, by its measures."""
    return {
        "short": m["n_words"] < MIN_WORDS,
        "repeated": 100 * m["n_repeat_words"] > REPEATED_PERCENT * m["n_words"],
        "symbols": 100 * m["n_symbols"] > SYMBOL_PERCENT * m["n_words"],
        "same_lines": 100 * m["n_dup_lines"] > DUPLICATE_LINE_PERCENT * m["n_lines"],
    }


BASE_RULES = ["short", "repeated"]


def host_of(source: Column) -> Column:
    """The domain of a source: of a URL its host, of anything else the source itself, A-Z in lower case."""
    return F.lower(F.regexp_replace(source.cast("string"), r"^[^:/?#]*://([^/?#]*).*$", "$1"))


def host_rates(measured: DataFrame, host: str, measures: str) -> DataFrame:
    """Per host its documents and, per rule, the failures' rate shrunk by a beta prior: host, docs, rates.

    The prior has the mean of all documents and the strength that explains how far the
    hosts' own rates lie apart (method of moments). Partial counts come first, so a host
    with a third of all documents is one row per task.
    """
    failed = rules({m: F.col(measures)[m] for m in MEASURES})
    sums = [F.sum(rule.cast("bigint")).alias(name) for name, rule in failed.items()]
    hosts = stored(measured.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("docs"), *sums), "hosts")
    moments = []
    for name in failed:
        mean = F.sum(name) / F.sum("docs")
        rate = F.col(name) / F.col("docs")
        moments += [mean.alias(f"{name}_mean"), F.avg(rate).alias(f"{name}_avg"), F.var_pop(rate).alias(f"{name}_var")]
    seen = hosts.agg(*moments).first()
    rates = {}
    for name in failed:
        mean, avg, var = (seen[f"{name}_{x}"] or 0.0 for x in ("mean", "avg", "var"))
        strength = min(1e6, max(2.0, avg * (1 - avg) / var - 1)) if var > 0 else 1e6
        rates[name] = (F.col(name) + mean * strength) / (F.col("docs") + strength)
    return hosts.select("host", "docs", *[r.alias(n) for n, r in rates.items()])


def judged(docs: DataFrame, source: str = "source") -> DataFrame:
    """``docs`` with ``quality_measures`` (struct), ``base_failed`` and ``kept``.

    Words are runs of characters other than space and \\t..\\r; a null text has none and
    fails as too short. Rows without a source are judged by their own rules only. Repeated
    rows are judged, and counted for their host, each. An empty table gives no rows.
    Columns of ``docs`` with the names of the added ones are replaced.
    """
    for_python(docs.sparkSession)
    own, host = "quality_measures", "quality_host"
    measured = docs.withColumns({own: _measured(F.col("text").cast("binary")), host: host_of(F.col(source))})
    rates = host_rates(measured.select(host, own), host, own)
    worst = F.greatest(*rules({m: F.lit(0) for m in MEASURES}))
    condemned = rates.filter(worst > HOST_LIMIT).select(F.col("host").alias(host), F.lit(True).alias("quality_condemned"))
    if condemned.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        joined = measured.join(F.broadcast(condemned), host, "left")
    else:
        joined = salted_left_join(measured, condemned, host, F.struct("doc_id", F.xxhash64("text")))
    failed = rules({m: F.col(own)[m] for m in MEASURES})
    joined = joined.withColumn("base_failed", failed["short"] | failed["repeated"])
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("quality_condemned").isNull()).drop(host, "quality_condemned")


def quality_table(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, its measures, base_failed and kept."""
    rows = judged(docs.select("doc_id", "text", "source"))
    return rows.select("doc_id", *[F.col("quality_measures")[m].alias(m) for m in MEASURES[:-1]], "base_failed", "kept")


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns."""
    names = docs.columns
    place = {n: f"quality_{i}" for i, n in enumerate(names) if n not in ("doc_id", "text", "source")}
    kept = judged(docs.withColumnsRenamed(place)).filter("kept")
    return kept.select(*[F.col(place.get(n, n)).alias(n) for n in names])
