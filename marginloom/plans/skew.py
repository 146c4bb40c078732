"""Joins from rows to one record per group that hold when a few groups own most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of one group that a task may hold; larger groups are cut into parts of that size.
ROWS_PER_TASK = 1_000_000


def join_groups(
    rows: DataFrame, groups: DataFrame, key: str, weight: str, spread: Column, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Join ``rows`` to ``groups`` (one record per ``key``), cutting groups with too many rows into parts.

    ``weight`` is a column of ``groups`` with at least the number of rows of each key. A
    group is cut by its own size, however many large groups there are, and only large ones
    are copied, once per part. The broadcast marks hold one record per ``rows_per_task`` rows
    at most. ``spread`` must be a value of the row itself that differs within a group.
    """
    parts = F.ceil(F.col(weight) / F.lit(rows_per_task)).cast("int")
    marks = groups.filter(F.col(weight) > rows_per_task).select(key, parts.alias("parts"))
    marked = rows.join(F.broadcast(marks), key, "left")
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64(spread), F.col("parts")).cast("int")).otherwise(0)
    cut = marked.withColumn("part", part).drop("parts")
    last = F.greatest(parts, F.lit(1)) - 1
    copies = groups.withColumn("part", F.explode(F.sequence(F.lit(0), last)))
    return cut.join(copies, [key, "part"]).drop("part")
