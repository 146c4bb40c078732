"""Corpus-wide line deduplication over levelled sorted runs of line hashes.

The index is a set of runs, each sorted by hash and cut into the same hash buckets, so a
merge join with a run moves no row of it. A run holds per line hash how many documents of
its batch have the line, and, only where no older run knows the hash, the line's holder:
the largest doc_id. A new batch is merge-joined with every run to tell fresh hashes from
known ones and adds its own run; when a level holds FANOUT runs they are merged into one of
the next level. Batches come in descending order of doc_id, so the run that knew a hash
first has its holder for the whole corpus.

Only built-in functions run here. Line hashes are 128 bits; a hash stands for its line.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginloom.llm.common import stored
from marginloom.session import shared_folder

BATCHES = 4
FANOUT = 3
MIN_CHARS = 20
MIN_DOCS = 3

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

HASH = ["h1", "h2"]
RUN = "h1 bigint, h2 bigint, docs bigint, holder bigint"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANK))
    ascii_only = F.length(bare) == F.octet_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def text_lines(text: Column) -> Column:
    """The lines of a text; a null or empty text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """The levelled index. Runs are bucketed tables below the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.path = shared_folder(spark, "line-runs")
        self.levels: list[list[str]] = []

    def _write(self, run: DataFrame, level: int) -> str:
        name = f"line_run_{level}_{uuid.uuid4().hex}"
        spread = run.repartition(self.buckets, "h1")
        spread.write.bucketBy(self.buckets, "h1").sortBy(*HASH).option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def runs(self) -> list[DataFrame]:
        """The runs as bucketed tables, for joins by hash."""
        return [self.spark.table(name) for name in self._names()]

    def add(self, lines: DataFrame) -> None:
        """Add a batch of line occurrences (h1, h2, doc); every document of it is below all earlier ones."""
        own = lines.select(*HASH, "doc").distinct().groupBy(*HASH).agg(F.count("*").alias("docs"), F.max("doc").alias("holder"))
        own = own.withColumn("known", F.lit(False))
        for run in self.runs():
            keys = run.select(*HASH, F.lit(True).alias("here"))
            own = own.join(keys, HASH, "left").withColumn("known", F.col("known") | F.coalesce("here", F.lit(False))).drop("here")
        own = own.select(*HASH, "docs", F.when(~F.col("known"), F.col("holder")).alias("holder"))
        self._put(self._write(own, 0), 0)

    def _put(self, name: str, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            merged = self._write(self._merged(self.levels[level]), level + 1)
            self._forget(self.levels[level])
            self.levels[level] = []
            self._put(merged, level + 1)

    def _merged(self, names: list[str]) -> DataFrame:
        # Read as plain files: Spark 4.1 takes a union of bucketed tables for partitioned by bucket even
        # where it then reads them without buckets, and sums come out wrong.
        rows = self.spark.read.schema(RUN).parquet(*[f"{self.path}/{name}" for name in names])
        return rows.groupBy(*HASH).agg(F.sum("docs").alias("docs"), F.max("holder").alias("holder"))

    def lines(self) -> DataFrame:
        """All known lines: h1, h2, docs, holder."""
        return self._merged(self._names())

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        """Take the runs out of the session's catalog."""
        for level in self.levels:
            self._forget(level)


def _occurrences(docs: DataFrame, batches: int) -> DataFrame:
    """Every long enough line: batch, doc, text_hash, place, h1, h2. Batch 0 has the largest ids."""
    cuts = docs.select(F.percentile_approx("doc", [i / batches for i in range(batches - 1, 0, -1)])).first()[0] or []
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + (F.col("doc") <= cut).cast("int")
    lines = docs.select(batch.alias("batch"), "doc", "text_hash", F.posexplode(text_lines(F.col("text"))).alias("place", "line"))
    keys = lines.withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= MIN_CHARS)
    hashed = keys.select(
        "batch", "doc", "text_hash", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2")
    )
    return stored(hashed, "lines", "batch")


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """doc, text_hash and the ascending places of the lines to drop, for the documents that lose any.

    ``docs`` has doc, text_hash and text.
    """
    spark = docs.sparkSession
    lines = _occurrences(docs, batches)
    runs = LineRuns(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for batch in range(batches):
        runs.add(lines.filter(F.col("batch") == batch))
    common = stored(runs.lines().filter(F.col("docs") >= min_docs).select(*HASH, "holder"), "common-lines")
    runs.close()
    lost = lines.join(common, HASH).filter(F.col("doc") != F.col("holder"))
    places = lost.groupBy("doc", "text_hash").agg(F.array_sort(F.collect_set("place")).alias("places"))
    return places


def _keyed(docs: DataFrame) -> DataFrame:
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))
    return docs.select(doc.alias("doc"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))


def _kept(lines: Column, places: Column) -> Column:
    """The lines between the dropped places: slices, so the work is linear in the lines."""
    starts = F.concat(F.array(F.lit(0)), F.transform(places, lambda p: p + 1))
    ends = F.concat(places, F.array(F.size(lines)))
    return F.array_join(F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(lines, s + 1, e - s))), "\n")


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """``docs`` with two more columns, ``kept_text`` and ``dropped_lines`` (array of places, null if none).

    A line's key is the line without blanks at both ends, A-Z in lower case. Keys of
    MIN_CHARS code points or more that ``min_docs`` documents hold stay only in the largest
    doc_id that holds them; there every occurrence stays. A null or empty text is one empty
    line and its kept_text is empty. Rows that share a doc_id count as one document, and so
    do rows without a doc_id, below all others. An empty table gives an empty table. Other
    columns stay as they are, under whatever names.
    """
    taken = ["line_dedup_doc", "line_dedup_text", "line_dedup_lines", "line_dedup_lost", "line_dedup_lost_text", "line_dedup_places"]
    lost = dropped_lines(_keyed(docs), min_docs, batches).toDF(*taken[3:])
    rows = docs.withColumns(
        {
            taken[0]: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))),
            taken[1]: F.xxhash64("text"),
            taken[2]: text_lines(F.col("text").cast("string")),
        }
    )
    joined = rows.join(lost, (F.col(taken[0]) == F.col(taken[3])) & (F.col(taken[1]) == F.col(taken[4])), "left")
    lines, places = F.col(taken[2]), F.col(taken[5])
    kept = F.when(places.isNull(), F.array_join(lines, "\n")).otherwise(_kept(lines, places))
    return joined.withColumns({"kept_text": kept, "dropped_lines": places, "n_lines": F.size(lines).cast("bigint")}).drop(*taken)


def line_counts(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256."""
    deduped = line_dedup(docs.select("doc_id", "text"))
    return deduped.select(
        "doc_id",
        "n_lines",
        F.when(F.col("dropped_lines").isNull(), 0).otherwise(F.size("dropped_lines")).cast("bigint").alias("n_dropped"),
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"),
    )


def without_common_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the common lines taken out of ``text``; its columns stay, a null text stays null.

    ``n_chars``, where there is such a column, follows the text.
    """
    names = docs.columns
    place = {n: f"line_dedup_{i}" for i, n in enumerate(names) if n not in ("doc_id", "text")}
    deduped = line_dedup(docs.withColumnsRenamed(place))
    new = {"text": F.when(F.col("text").isNotNull(), F.col("kept_text"))}
    changed = F.col("dropped_lines").isNotNull()
    out = []
    for name in names:
        if name == "n_chars":
            old = F.col(place[name])
            out.append(F.when(changed, F.length("kept_text")).otherwise(old).cast(docs.schema[name].dataType).alias(name))
        else:
            out.append(new.get(name, F.col(place.get(name, name))).alias(name))
    return deduped.select(*out)
