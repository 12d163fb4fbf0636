"""Connected components of an edge table, by minimum hooking with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.tables import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b); component is its smallest node.

    Each round hooks every node to its smallest neighbour, follows that link once more, and
    contracts the edges; tables are written each round, groups are never collected.
    """
    edges = materialise(edges.select("a", "b").where("a != b").distinct(), "edges")
    labels = materialise(
        edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")),
        "labels",
    )
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("m"))
        hooks = materialise(hooks.select("a", F.least("a", "m").alias("p")), "hooks")
        far = hooks.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        jump = materialise(hooks.join(far, "p").select("a", F.col("pp").alias("p")), "jumps")
        labels = materialise(
            labels.join(jump.select(F.col("a").alias("component"), "p"), "component", "left").select(
                "node", F.coalesce("p", "component").alias("component")
            ),
            "labels",
        )
        left = edges.join(jump, "a").select(F.col("p").alias("x"), "b")
        edges = left.join(jump.withColumnRenamed("a", "b"), "b").select(F.col("x").alias("a"), F.col("p").alias("b"))
        edges = materialise(edges.where("a != b").distinct(), "edges")
    return labels
