"""Connected components of an edge list by alternating large-star and small-star (Kiveris et al., SoCC 2014).

Minima are pre-aggregated and joined back, so a node with very many neighbours is a skewed
join that can be split, never one task's list. Each step's edges go to the shared
checkpoint folder; the loop ends when a step changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryspark.runtime import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: neighbours above a node go to its neighbourhood's least. Small: those below, and the node."""
    both = edges.union(edges.select("dst", "src")) if large else edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = both.groupBy("src").agg(F.min("dst").alias("_least")).select(F.col("src").alias("_node"), F.least("src", "_least").alias("_least"))
    joined = both.join(least, F.col("src") == F.col("_node"))
    if large:
        out = joined.filter(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("_least").alias("dst"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("dst").alias("src"), F.col("_least").alias("dst")), F.struct(F.col("src").alias("src"), F.col("_least").alias("dst")))).alias("e")).select("e.*")
    return out.filter(F.col("src") != F.col("dst")).distinct()


def connected_components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every node of an edge, component being the least id; edges are (src, dst)."""
    now = materialize(edges.select("src", "dst").filter(F.col("src") != F.col("dst")).distinct())
    mark = None
    for _ in range(max_rounds):
        now = materialize(_star(_star(now, large=True), large=False))
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst")), F.bit_xor(F.xxhash64("dst", "src"))).first()
        if seen == mark or seen[0] == 0:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("src").alias("id"), F.col("dst").alias("component")).union(now.select("dst", "dst").distinct())
