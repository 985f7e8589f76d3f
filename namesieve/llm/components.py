"""Connected components of a graph given as edges, by alternating stars.

Each round first ties the larger neighbours of every node to the node's
smallest neighbour, then its smaller ones; both only aggregate and join. When
a round changes nothing, every node is tied to the smallest node of its
component. A node with very many edges costs one partial aggregate per task,
and its edges meet their minimum in a join of two written tables, which Spark
splits when it is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesieve.workspace import written


def _smallest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.min("b").alias("low"))


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that is not its component's smallest.

    Loops and repeated edges do no harm; nulls are dropped.
    """
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = written(ordered.distinct(), f"{folder}/round-0")
    state, turn = None, 0
    while True:
        turn += 1
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(
            _smallest(both).select("a", F.least("a", "low").alias("low")), f"{folder}/large-{turn}"
        )
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = written(large.distinct(), f"{folder}/tied-{turn}")
        low = written(_smallest(large), f"{folder}/small-{turn}")
        small = large.join(low, "a").filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = small.unionByName(low.select("a", F.col("low").alias("b"))).distinct()
        current = written(small, f"{folder}/round-{turn}")
        row = current.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("digest")
        ).first()
        if (row["n"], row["digest"]) == state:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = (row["n"], row["digest"])
