"""Connected components of an edge table, by alternating star contractions (large-star, small-star).

Each round is two partially aggregated groupBys and two joins over the edges; rounds grow with the logarithm of the longest path.
Every round is written to the shared folder, so lineage stays short. No component or edge list ever reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, stage_table


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): per u the least of u and its neighbours, joined back to the pairs."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u_"), F.least("m", "u").alias("m"))
    return pairs.join(least, pairs.u == least.u_).select("u", "v", "m")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100, staged: list | None = None) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node reachable. Loops and repeated edges are harmless. The staged table
    that the result reads is added to `staged`."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now, before = stage_table(now, "edges"), None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _star(large)
        nxt = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        nxt = stage_table(nxt, "edges")
        mark = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_staged(now)
        now = nxt
        if tuple(mark) == before:
            break
        before = tuple(mark)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if staged is not None:
        staged.append(now)
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(roots)
