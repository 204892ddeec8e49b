"""Connected components of a table of edges, by random contraction in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.llm.shared import settled


def components(spark: SparkSession, edges: DataFrame, name: str) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): equal labels mean connected.

    In each round every node moves to the neighbour (or itself) of least random priority; edges are
    renamed and those within a label go. A constant share of the labels goes in each round, whatever
    the shape of the graph, so the rounds grow with the logarithm of its size. The hub of a star is
    summed up map-side. Each round is written to the shared folder; nothing reaches the driver.
    """
    edges = edges.where(F.col("a") != F.col("b"))
    left = settled(spark, edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                   f"{name}-edges")
    ends = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = None
    turn = 0
    while not left.isEmpty():
        near = ends(left)
        order = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("p"), F.col(c).alias("v"))
        to = near.groupBy("a").agg(F.min(order("b")).alias("o")).select(
            F.col("a").alias("from"), F.least(order("a"), F.col("o")).getField("v").alias("to"))
        to = settled(spark, to, f"{name}-to")
        if labels is None:
            labels = to.select(F.col("from").alias("node"), F.col("to").alias("label"))
        else:
            moved = to.withColumnRenamed("from", "label")
            labels = labels.join(moved, "label", "left").select(
                "node", F.coalesce("to", "label").alias("label"))
        labels = settled(spark, labels, f"{name}-labels")
        one, two = to.toDF("a", "a2"), to.toDF("b", "b2")
        left = left.join(one, "a").join(two, "b").where(F.col("a2") != F.col("b2")).select(
            F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        left = settled(spark, left, f"{name}-edges")
        turn += 1
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
