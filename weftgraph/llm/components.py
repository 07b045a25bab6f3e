"""Connected components of an edge table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for the nodes of ``edges`` (a, b).

    Labels spread along edges and are then followed to their own labels (pointer
    jumping), so that rounds grow with the logarithm of a component's width. Each
    round's labels are written to the shared folder. The result is such a table.
    """
    both = stored(edges.select("a", "b").filter("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).filter("a <> b")).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy("a").agg(F.min("component").alias("near"))
        spread = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "near").alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("component").alias("upper"))
        following = stored(spread.join(up, "next", "left").select("node", F.least("next", F.coalesce("upper", "next")).alias("component"), (F.least("next", F.coalesce("upper", "next")) != F.col("old")).alias("changed")))
        changed = following.filter("changed").limit(1).count()
        drop_stored(labels)
        labels = following
        if not changed:
            drop_stored(both)
            out = labels.select("node", "component")
            out._weft_path = labels._weft_path
            return out
