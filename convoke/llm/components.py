"""Connected components of a graph held as an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node in edges (a long, b long): the smallest node that it is connected with.

    Alternates two steps until nothing changes, which takes about log(n) rounds: every node points its larger
    neighbours to the smallest one around it, then its smaller ones and itself. Each round's table is written down, so
    a lost executor costs one round at most, and the one before it deleted. Loops and repeated edges do no harm; no edges give no nodes."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    nodes = edges.where("a = b").select("a")
    now = written(now.distinct(), name)
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        before, now = now, written(small, name)
        dropped(before)
        was, mark = mark, tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == was:
            break
    roots = now.select(F.col("b").alias("node")).unionByName(nodes.select(F.col("a").alias("node"))).distinct()
    alone = roots.join(now.select(F.col("a").alias("node")), "node", "left_anti").select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(alone)
