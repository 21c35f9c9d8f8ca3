"""Connected components of an edge list, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node that can be reached) for each node of ``edges`` (a, b), both long.

    Each round takes the smallest label among a node's neighbours and then the label of
    that label, so long chains halve; it ends when no label changes. Labels are minima
    with map-side partials, so a node with very many edges is no hot group. Every round
    is written to the shared folder.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("comp", "near").alias("via"), F.col("comp").alias("was"))
        jumped = labels.select(F.col("node").alias("via"), F.col("comp").alias("next"))
        new = written(lower.join(jumped, "via", "left").select("node", F.least("via", F.coalesce("next", "via")).alias("comp"), "was"))
        changed = new.where("comp <> was").limit(1).count()
        labels = new.select("node", "comp")
        if not changed:
            return labels
