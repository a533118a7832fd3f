"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.runtime import drop, written


def components(edges: DataFrame, *, name: str = "components", rounds: int = 200) -> tuple[DataFrame, list[str]]:
    """(node, component): every node of an edge and the least node it reaches.

    ``edges`` has bigint columns a and b. Each round links the larger
    neighbours of a node to the least one (large star), then the smaller ones
    (small star); minima come from window aggregates, which spill, so a hub
    needs no memory of its own. Rounds are written to the shared folder and
    their number grows with the logarithm of the diameter; should ``rounds`` not
    do, an error says so. Also returns the paths that the result still reads.
    """
    e, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    state = _state(e)
    for _ in range(rounds):
        if not state[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u")))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        linked = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        nxt, nxt_path = written(linked, name)
        drop(e.sparkSession, path)
        e, path = nxt, nxt_path
        now = _state(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components: no fixed point in {rounds} rounds")
    # a fixed point is a forest of stars: each node has one edge, to its root
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), [path]


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
