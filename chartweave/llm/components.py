"""Connected components by contraction, with edges and labels in tables of the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node of its component) for every node of ``links`` (a, b).

    In each round every node joins the neighbour that comes first in an order drawn anew (itself
    included), and edges move to what their ends joined: nodes fall by a constant factor
    in expectation, whatever the shape of the graph. Only small aggregates meet per node; edges
    and labels stay distributed. No links give no rows; loops and repeats are harmless.
    """
    edges = materialize(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.lit(len(steps)), F.col(c)).alias("o"), F.col(c).alias("n"))
        joined = both.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("near")).select("node", F.least(F.col("near"), order("node"))["n"].alias("to"))
        step = materialize(joined, "step")
        steps.append(step)
        left, right = step.select(F.col("node").alias("a"), F.col("to").alias("ta")), step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(left, "a").join(right, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        edges = materialize(moved.where("a <> b").distinct(), "edges")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    label = steps[-1].select("node", F.col("to").alias("root"))
    for step in reversed(steps[:-1]):
        later = label.withColumnRenamed("node", "to")
        label = step.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    label = materialize(label, "labels")
    least = label.groupBy("root").agg(F.min(F.least("node", "root")).alias("component"))
    return label.join(least, "root").select("node", "component")
