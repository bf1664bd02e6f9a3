"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import BROADCAST_ROWS, durable

#: Partitions that few links are kept in.
SLIM = 16


def components(edges: DataFrame) -> DataFrame:
    """node and root of every node that an edge (a, b) touches; connected nodes, and only those, share a root.

    Each round gives a node the least label within two steps and contracts the graph by it, so that the labels left
    shrink by a factor; the labels are node numbers scattered by xxhash64, which maps longs one to one, so no order in
    the input makes a long chain of rounds. While links are counted to be few, they are kept in few partitions and the
    labels are broadcast.
    """
    edge = durable(edges.select(F.xxhash64("a").alias("u"), F.xxhash64("b").alias("v")).where("u <> v").distinct())
    few = edge.count() <= BROADCAST_ROWS  # rounds only make it fewer
    side = F.broadcast if few else lambda df: df
    kept = (lambda df: durable(df.coalesce(SLIM))) if few else durable
    edge = kept(edge) if few else edge
    roots = None
    while True:
        both = edge.union(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("near")))
        far = both.join(side(near.withColumnRenamed("u", "v")), "v").groupBy("u").agg(F.min("near").alias("far"))
        label = kept(far.join(side(near), "u").select("u", F.least("near", "far").alias("label")))
        if roots is None:
            roots = label.select(F.col("u").alias("node"), F.col("label").alias("root"))
        else:
            step = label.select(F.col("u").alias("root"), "label")
            roots = kept(roots.join(side(step), "root", "left").select("node", F.coalesce("label", "root").alias("root")))
        moved = edge.join(side(label), "u").select(F.col("label").alias("a"), "v")
        moved = moved.join(side(label.withColumnRenamed("u", "v")), "v").select("a", F.col("label").alias("b")).where("a <> b")
        edge = kept(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        if edge.isEmpty():
            return roots
