"""Connected components by alternating large-star and small-star contraction.

Every round is two aggregations (with partial minima, so a hub costs one row per task) and two joins that
adaptive execution can split. Rounds grow with the logarithm of the number of nodes. Each round's edges are
written to the shared folder and the round before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.plans.scratch import Scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Edges with a null end are ignored; a self-loop makes its node a component. Nodes need an orderable type.
    """
    work = Scratch(edges.sparkSession, "components")
    edges = edges.filter(F.col(src).isNotNull() & F.col(dst).isNotNull())
    e = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"))
    first = work.write(e.distinct(), "start")
    cur, name, seen = first.filter("a > b"), "start", None
    for k in range(max_rounds):
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        nxt = work.write(small.distinct(), f"round{k}")
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if name != "start":
            work.drop(name)
        cur, name = nxt, f"round{k}"
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
    loops = first.filter("a = b").select(F.col("a").alias("node")).distinct().join(out, "node", "left_anti")
    return out.unionByName(loops.select("node", F.col("node").alias("component")))
