"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginloom.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """Label every node of the links (a, b) with the smallest node of its component: (node, component).

    Alternates hooking (each component takes the smallest label next to it) with pointer
    jumping, so the number of rounds grows with the logarithm of a component's diameter.
    Each round is written to the shared folder. Labels are aggregated with partial
    aggregates, so a node with very many links is no hot group. No links: no rows.
    """
    pairs = links.select("a", "b").filter("a <> b")
    both = stored(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "labels")
    while True:
        seen = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(seen, "node").withColumn("near", F.least("component", "near"))
        # the old label hooks below the smallest label seen by any node that carries it
        hooks = lower.groupBy(F.col("component").alias("root")).agg(F.min("near").alias("root_near"))
        hooked = lower.join(hooks, F.col("component") == F.col("root")).select(
            "node", F.col("component").alias("before"), F.least("near", "root_near").alias("component")
        )
        hooked = stored(hooked, "hooked")
        jump = hooked.select(F.col("node").alias("via"), F.col("component").alias("further"))
        jumped = hooked.join(jump, hooked["component"] == jump["via"], "left").select(
            "node", F.least("component", F.coalesce("further", "component")).alias("component"), "before"
        )
        moved = stored(jumped, "labels")
        labels = moved.select("node", "component")
        if moved.filter("component <> before").isEmpty():
            return labels
