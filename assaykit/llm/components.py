"""Connected components of a graph that no machine holds, by alternating large and small stars.

Each round ties a node's larger neighbours, then its smaller ones, to the smallest that it knows. Groups are reduced
to their minimum before anything is joined; a hub's edges may be split by a skewed join. Rounds end when every node is
tied to its root alone, which edges may be from the start; chains halve with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import cut


def _is_settled(edges: DataFrame) -> bool:
    """Whether each x is tied to a single y that is tied to nothing itself; hubs are added up before they are dealt."""
    ends = edges.select(F.col("x").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("y", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def _to_smallest(neighbours: DataFrame) -> DataFrame:
    """Adds to rows (x, y) the smallest of x and all its y as m."""
    least = neighbours.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("k"), F.least("x", "m").alias("m"))
    return neighbours.join(least, F.col("x") == F.col("k")).drop("k")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (x, y): root is the smallest node of its component."""
    kept = cut(edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    while not _is_settled(kept):
        both = kept.union(kept.select(F.col("y").alias("x"), F.col("x").alias("y")))
        large = _to_smallest(both).where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        tied = _to_smallest(large)
        small = tied.select(F.col("y").alias("x"), F.col("m").alias("y")).union(tied.select("x", F.col("m").alias("y"))).where("x <> y").distinct()
        kept = cut(small)
    roots = kept.select(F.col("x").alias("node"), F.col("y").alias("root"))
    return cut(roots.union(roots.select("root", "root").distinct()))
