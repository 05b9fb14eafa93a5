"""Connected components by label propagation and pointer jumping, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.llm._common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in edges (a, b); the label is the least node of its component.

    Each round takes the least label of the neighbours and then the label of that label; minima are
    pre-aggregated, so a node with very many neighbours is no hot group. Rounds are written to the
    shared folder. An empty table gives no rows.
    """
    e = edges.select("a", "b").where("a <> b")
    e = materialize(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(e.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = e.join(labels, e["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = hooked.select(F.col("node").alias("up"), F.col("label").alias("above"))
        jumped = materialize(hooked.join(up, F.col("label") == F.col("up")).select("node", "was", F.least("label", "above").alias("label")), "labels")
        labels = jumped.select("node", "label")
        if jumped.where("was <> label").isEmpty():
            return labels
