"""Graph operators over edge lists edges(doc_id, source, target, relation, detail, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.store import materialize


def chains(edges: DataFrame, relation: str = "LOCATED_IN") -> DataFrame:
    """(doc_id, node, depth, ancestor): upward walk over the first parent, of any length; stops at a cycle.

    Pointer jumping: a walk of length n takes about log2(n) rounds, each written to the shared folder.
    """
    up = edges.where(F.col("relation") == relation).groupBy("doc_id", "source").agg(F.min_by("target", F.struct("seq", "target")).alias("target"))
    walk = materialize(up.where("source <> target").select("doc_id", F.col("source").alias("node"), F.lit(1).alias("depth"), F.col("target").alias("ancestor")), "walk")
    step = 1
    while True:
        ends = walk.where(F.col("depth") == step).select("doc_id", "node", F.col("ancestor").alias("mid"))
        beyond = walk.select("doc_id", F.col("node").alias("mid"), F.col("depth").alias("further"), "ancestor")
        more = ends.join(beyond, ["doc_id", "mid"]).where("node <> ancestor").select("doc_id", "node", (F.col("further") + step).alias("depth"), "ancestor")
        more = materialize(more.join(walk.select("doc_id", "node", "ancestor"), ["doc_id", "node", "ancestor"], "left_anti").select(*walk.columns), "walk")
        if more.isEmpty():
            return walk
        walk = materialize(walk.unionByName(more), "walk")
        step *= 2


def tree(edges: DataFrame, relation: str = "LOCATED_IN") -> DataFrame:
    """(doc_id, node, root, depth) of every node of the relation; roots have depth 0."""
    up = chains(edges, relation)
    top = up.groupBy("doc_id", "node").agg(F.max("depth").alias("depth"), F.max_by("ancestor", "depth").alias("root"))
    nodes = edges.where(F.col("relation") == relation).select("doc_id", F.explode(F.array("source", "target")).alias("node")).distinct()
    return nodes.join(top, ["doc_id", "node"], "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"))


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(doc_id, node, ring): nodes one and two undirected steps from seeds(doc_id, node)."""
    both = edges.select("doc_id", F.col("source").alias("a"), F.col("target").alias("b")).union(edges.select("doc_id", "target", "source")).distinct()
    one = seeds.join(both, (seeds["doc_id"] == both["doc_id"]) & (seeds["node"] == both["a"])).select(both["doc_id"], F.col("b").alias("node")).distinct().join(seeds, ["doc_id", "node"], "left_anti")
    step = one.withColumnRenamed("node", "a").join(both, ["doc_id", "a"]).select("doc_id", F.col("b").alias("node")).distinct()
    two = step.join(one, ["doc_id", "node"], "left_anti").join(seeds, ["doc_id", "node"], "left_anti")
    return one.withColumn("ring", F.lit(1)).union(two.withColumn("ring", F.lit(2)))


def kin_nodes(edges: DataFrame) -> DataFrame:
    return edges.where("relation = 'RELATED_TO'").select("doc_id", F.explode(F.array("source", "target")).alias("entity_id")).distinct()


def family_subtypes(subtypes: DataFrame, edges: DataFrame) -> DataFrame:
    """subtypes(doc_id, entity_id, subtype) with FAMILY where unset and at an end of a kin edge."""
    kin = kin_nodes(edges).withColumn("__kin", F.lit(True))
    return subtypes.join(kin, ["doc_id", "entity_id"], "left").withColumn("subtype", F.coalesce("subtype", F.when(F.col("__kin"), "FAMILY"))).drop("__kin")


def drop_edges(edges: DataFrame, relation: str, sources: DataFrame) -> DataFrame:
    """edges without those of the relation that start at sources(doc_id, source)."""
    gone = sources.select("doc_id", "source").distinct().withColumn("relation", F.lit(relation))
    return edges.join(gone, ["doc_id", "relation", "source"], "left_anti").select(edges.columns)


def unordered_pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select("doc_id", F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: that of the highest order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
