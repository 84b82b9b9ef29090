"""Connected components over an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandforge.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to (node, root) for every node that has an edge; root is the component's least node.

    Nodes are of any type that has an order: a struct whose first field is what the least is wanted of spares a step by component.

    Each round is two aggregations and two joins on node ids; the aggregations are partial before the shuffle and
    a hub's edges are split by the adaptive skew join.  Rounds go on until none changes an edge; they grow with the logarithm of the
    size.  Lineage is cut in
    the reliable checkpoint folder after every round.  Self edges and repeated edges are ignored, an empty edge
    table gives an empty result.
    """
    now = cut(edges.select("a", "b").filter("a <> b").distinct())
    mark = None
    while True:
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == mark or row[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(row)
        now = cut(_small_star(_large_star(now)))
