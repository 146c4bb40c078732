"""Toxicity by a weighted lexicon over folded text.

Texts are folded to a skeleton: lower case, no accents or invisible characters, look-alike
letters of other scripts and digits that stand for letters written as the letter they
imitate, everything else one space. The lexicon holds whole words and word beginnings of
the skeleton with weights, and exception phrases in which an entry is harmless. One
Aho-Corasick automaton finds both; an entry inside an exception phrase does not count. The
weights of the rest are added up and normalised by the text's length, and a logistic curve
turns the sum and the normalised sum into a score.

Entries, exceptions and curve are learned from labelled rows: an entry is a word or word
beginning far more frequent in toxic texts than in others, taken in order of the evidence
for it; an exception is a pair of neighbouring words with an entry that clean texts hold at
least as often as toxic ones. Learning reads at most about FIT_ROWS labelled rows, chosen
by hash; scoring reads every row.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginloom.llm.common import for_python, stored

FIT_ROWS = 20_000
MIN_PREFIX, MAX_PREFIX = 4, 12
# An entry needs so many toxic texts, and so large a log ratio of its rates, less two standard errors.
MIN_TEXTS, MIN_LOG_RATIO = 5, 1.5
MAX_ENTRIES = 2000
# An exception needs so many clean texts.
MIN_CLEAN_TEXTS = 5
THRESHOLD = 0.3
FOLDS, HELD_OUT_FOLD = 4, 2

# Letters of other scripts and the Latin letter they look like.
LOOKALIKES = dict(zip("абвгеёзіїјкмнопрстухцһԁԛԝѕαβγεηικνορτυχω", "abbreeziijkmhonpcтyxцhdqwsabyenikvoptuxw", strict=True)) | {"т": "t", "ц": "u", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe"}
# Digits and signs written in place of letters; i, l and 1 are one letter.
SUBSTITUTES = {"0": "o", "1": "i", "l": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i", "!": " "}


class _Fold(dict):
    """The skeleton of each character, worked out when it is first met; for ``str.translate``."""

    def __missing__(self, code: int) -> str:
        out = []
        for c in unicodedata.normalize("NFKD", chr(code)).lower():
            for part in LOOKALIKES.get(c, c):
                part = SUBSTITUTES.get(part, part)
                if part.isalnum():
                    out.append(part)
                elif not unicodedata.category(part) in ("Mn", "Me", "Cf"):
                    out.append(" ")
        self[code] = "".join(out)
        return self[code]


_FOLD = _Fold()


def skeleton(text: str | None) -> list[str]:
    """The folded words of a text."""
    return (text or "").translate(_FOLD).split()


@dataclass
class Lexicon:
    """Weights of entries, exception phrases, and the curve from the two sums to a score.

    An entry ends with a space if it is a whole word, else it is a word's beginning. Both it
    and exception phrases are skeletons.
    """

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, ...] = (-4.0, 1.0, 1.0)

    @cached_property
    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (True, len(phrase) + 2, 0.0))
        for entry, weight in self.weights.items():
            found.add_word(f" {entry}", (False, len(entry) + 1, weight))
        if len(found):
            found.make_automaton()
        return found

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve}

    def matches(self, words: list[str]) -> list[tuple[int, float]]:
        """(place in the spaced skeleton, weight) of the entries outside exception phrases."""
        if not len(self.automaton) or not words:
            return []
        entries, covered = {}, []
        for last, (exception, size, weight) in self.automaton.iter(f" {' '.join(words)} "):
            first = last - size + 1
            if exception:
                covered.append((first, last))
            elif weight > entries.get(first, (0, 0.0))[1]:
                entries[first] = (last, weight)  # of a word's entries the heaviest
        if covered:
            reach, at, spans = -1, 0, sorted(covered)
            kept = {}
            for first in sorted(entries):
                while at < len(spans) and spans[at][0] <= first:
                    reach, at = max(reach, spans[at][1]), at + 1
                if first + 1 >= reach:  # its word does not begin inside a phrase
                    kept[first] = entries[first]
            entries = kept
        return [(first, weight) for first, (_, weight) in sorted(entries.items())]

    def measures(self, text: str | None) -> tuple[float, float]:
        """The sum of the matched weights, and that sum for a thousand words."""
        words = skeleton(text)
        total = sum(weight for _, weight in self.matches(words))
        return total, 1000.0 * total / (len(words) + 20)

    def score(self, measures: tuple[float, float]) -> float:
        bias, by_sum, by_density = self.curve
        x = bias + by_sum * math.log1p(measures[0]) + by_density * math.log1p(measures[1])
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, x))))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; so are rows without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT_FOLD, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """text and toxic of about ``rows`` labelled rows that are not held out, each text once.

    The rows are those with the smallest hashes of their id. Contradicting labels of an id,
    or of equal texts, count as toxic.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labelled = usable.count()
    share = rows / max(rows, labelled)
    chosen = usable.filter(F.xxhash64("doc_id") <= F.lit(int(-(2**63) + share * (2**64 - 1)))) if share < 1 else usable
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    taken = stored(texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "labelled")
    first = taken.groupBy(F.xxhash64("text").alias("hash")).agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    return stored(first.select("text", "toxic"), "training").repartition(-(-min(rows, labelled + 1) // 512))


COUNTS = "item string, clean bigint, toxic bigint"


def _counted(rows: DataFrame, items) -> DataFrame:
    """In how many clean and toxic texts each item occurs; ``items`` turns a text into its items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            seen = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array(seen, pa.string()), *(pa.array([c[s] for s in seen], pa.int64()) for c in counts)]
            return pa.record_batch(columns, names=["item", "clean", "toxic"])

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                counts[int(toxic > 0)].update(set(items(text)))
            if len(counts[0]) + len(counts[1]) > 200_000:
                yield out()
                counts = (Counter(), Counter())
        yield out()

    return rows.mapInArrow(run, COUNTS).groupBy("item").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def log_ratio(toxic: float, clean: float, toxic_all: float, clean_all: float) -> tuple[float, float]:
    """The log of how much more frequent an item is in toxic texts, and its standard error."""
    a, b = toxic + 0.5, clean + 0.5
    return math.log(a / (toxic_all + 1)) - math.log(b / (clean_all + 1)), math.sqrt(1 / a + 1 / b)


def chosen_entries(candidates: list[tuple[str, int, int]], toxic_all: int, clean_all: int) -> dict[str, float]:
    """Weights of the candidates (entry, clean, toxic) with most evidence, none the beginning of another.

    Evidence is the number of toxic texts times the log ratio; of equals the longest, the whole word, comes first.
    """
    rated = []
    for entry, clean, toxic in candidates:
        ratio, error = log_ratio(toxic, clean, toxic_all, clean_all)
        if toxic >= MIN_TEXTS and ratio - 2 * error >= MIN_LOG_RATIO:
            rated.append((-toxic * ratio, -len(entry), entry, ratio))
    chosen: dict[str, float] = {}
    for _, _, entry, ratio in sorted(rated):
        beginnings = {entry[:n] for n in range(MIN_PREFIX, len(entry))}
        if not beginnings & chosen.keys() and not any(c.startswith(entry) for c in chosen):
            chosen[entry] = round(ratio, 4)
        if len(chosen) == MAX_ENTRIES:
            break
    return chosen


def _fitted_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's method with a small ridge; slopes below zero are set to zero."""
    design = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(design.shape[1]), 1e-2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(w)), design.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) if i == 0 else max(0.0, float(v)) for i, v in enumerate(w))


def _pairs(lexicon: Lexicon):
    """The neighbouring words of a text of which at least one has an entry."""

    def items(text: str) -> list[str]:
        words = skeleton(text)
        begins, at = {}, 0
        for i, word in enumerate(words):
            begins[at] = i
            at += len(word) + 1
        out = []
        for first, _ in lexicon.matches(words):
            i = begins[first]
            out += [" ".join(words[j : j + 2]) for j in (i - 1, i) if 0 <= j < len(words) - 1]
        return out

    return items


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Lexicon:
    """Learn a lexicon from the labelled rows of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Without labels of both kinds the lexicon is empty and every score is the same.
    """
    for_python(docs.sparkSession)
    sample = training_rows(docs, labels, rows)
    sizes = {bool(r.toxic): r.n for r in sample.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    toxic_all, clean_all = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic_all or not clean_all:
        return Lexicon({}, [], (math.log((toxic_all + 0.5) / (clean_all + 4.5)), 0.0, 0.0))
    words = stored(_counted(sample, skeleton), "words")
    beginnings = F.transform(F.sequence(F.lit(MIN_PREFIX), F.lit(MAX_PREFIX)), lambda n: F.substring("item", F.lit(1), n))
    starts = F.when(F.length("item") > MIN_PREFIX, F.filter(beginnings, lambda b: F.length(b) < F.length("item"))).otherwise(F.array().cast("array<string>"))
    entries = F.explode(F.array_distinct(F.concat(starts, F.array(F.concat("item", F.lit(" "))))))
    counts = words.select(entries.alias("entry"), "clean", "toxic").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # a candidate is in MIN_TEXTS toxic texts of the bounded sample, so the sample bounds their number
    likely = counts.filter((F.col("toxic") >= MIN_TEXTS) & (F.col("toxic") * float(clean_all) > math.exp(MIN_LOG_RATIO) * F.col("clean") * float(toxic_all)))
    lexicon = Lexicon(chosen_entries([tuple(r) for r in likely.select("entry", "clean", "toxic").collect()], toxic_all, clean_all))
    harmless = (F.col("clean") >= MIN_CLEAN_TEXTS) & (F.col("clean") * float(toxic_all) >= F.col("toxic") * float(clean_all))
    phrases = _counted(sample, _pairs(lexicon)).filter(harmless)
    lexicon = Lexicon(lexicon.weights, sorted(r.item for r in phrases.select("item").collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.measures(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array([m[0] for m in found], pa.float64()), pa.array([m[1] for m in found], pa.float64()), batch.column("toxic").cast(pa.int64())], names=["total", "density", "toxic"])

    seen = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "total double, density double, toxic bigint").toPandas()
    x = np.log1p(seen[["total", "density"]].to_numpy())
    return Lexicon(lexicon.weights, lexicon.exceptions, _fitted_curve(x, (seen["toxic"].to_numpy() > 0).astype(float)))


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score, predicted, and the two sums ``weight`` and ``density``, per row of ``docs`` (doc_id, text).

    A null or empty text holds no entry and has the score of a text without any. Repeated
    rows are scored each; rows without a doc_id too, as held out. Other columns are ignored.
    An empty table gives no rows.
    """
    for_python(docs.sparkSession)
    kinds = {"doc_id": pa.int64(), "held_out": pa.bool_(), "score": pa.float64(), "predicted": pa.int32(), "weight": pa.float64(), "density": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.measures(t) for t in batch.column("text").to_pylist()]
            scores = [lexicon.score(m) for m in found]
            columns = [batch.column("doc_id"), batch.column("held_out"), scores, [int(s >= THRESHOLD) for s in scores], [m[0] for m in found], [m[1] for m in found]]
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, weight double, density double")


def toxicity_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled rows that are not held out, and score every document."""
    return scored(docs, fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic")))
