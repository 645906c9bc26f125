"""What all batches add up to, kept as sorted runs that are folded level by level.

A batch adds one run: a row for each key that it touches, with what the batch adds to it. ``FAN`` runs of a level are folded into one of the
next, so a reader merges a few runs for each level whatever the number of batches, and a row is rewritten once a level.
A row may also be ``absolute``: it says all there is up to its batch, and rows of earlier batches count no more. Such rows are made where a document comes
again, as a largest score cannot be taken back; only the keys that the document had are counted anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FAN = 4


class Runs:
    """Runs of rows below a folder, one subfolder each, named by level and the batches they hold. ``keys`` tell rows apart; ``most``
    columns merge to the largest value that isn't null, ``sums`` to the sum."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], most: list[str], sums: list[str]):
        self.spark, self.path, self.schema, self.keys, self.most, self.sums = spark, path, f"{schema}, absolute boolean", keys, most, sums

    def live(self, done: list[int]) -> list[tuple[int, int, int]]:
        """``(level, first, last)`` of the runs that together hold each complete batch once, oldest first."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
        whole = [tuple(map(int, p.getName()[4:].split("-"))) for p in names if p.getName().startswith("run=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        found: list[tuple[int, int, int]] = []
        for run in sorted(whole, reverse=True):  # the highest levels first
            held = any(lo <= run[1] and run[2] <= hi for _, lo, hi in found)
            if not held and (run[0] or run[1] in done):
                found.append(run)
        return sorted(found, key=lambda r: r[1])

    def _at(self, run: tuple[int, int, int]) -> str:
        return f"{self.path}/run={'-'.join(map(str, run))}"

    def write(self, df: DataFrame, level: int, first: int, last: int) -> None:
        df.write.mode("overwrite").parquet(self._at((level, first, last)))

    def rows(self, runs: list[tuple[int, int, int]]) -> DataFrame:
        """The rows of the runs as they are, with the last batch of their run."""
        out = self.spark.createDataFrame([], f"{self.schema}, last int")
        for run in runs:
            out = out.unionByName(self.spark.read.schema(self.schema).parquet(self._at(run)).withColumn("last", F.lit(run[2])))
        return out

    def merged(self, runs: list[tuple[int, int, int]]) -> DataFrame:
        """One row a key."""
        rows = self.rows(runs)
        base = F.max(F.when(F.col("absolute"), F.col("last"))).over(W.partitionBy(*self.keys))
        rows = rows.withColumn("_base", base).filter(F.col("_base").isNull() | (F.col("last") >= F.col("_base")))
        return rows.groupBy(*self.keys).agg(*(F.max(c).alias(c) for c in self.most), *(F.sum(c).alias(c) for c in self.sums), F.bool_or("absolute").alias("absolute"))

    def current(self, done: list[int]) -> DataFrame:
        return self.merged(self.live(done))

    def fold(self, done: list[int]) -> None:
        """Fold until no level has ``FAN`` runs side by side; what was folded stays until ``drop_folded``."""
        while True:
            live = self.live(done)
            side = next((live[i : i + FAN] for i in range(len(live) - FAN + 1) if len({r[0] for r in live[i : i + FAN]}) == 1), None)
            if side is None:
                return
            self.write(self.merged(side), side[0][0] + 1, side[0][1], side[-1][2])

    def drop_folded(self, done: list[int]) -> None:
        """Delete the runs that others hold; not while a reader that began earlier is at work."""
        jvm, kept = self.spark._jvm, {f"run={'-'.join(map(str, r))}" for r in self.live(done)}
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for s in fs.listStatus(root) if fs.exists(root) else []:
            name = s.getPath().getName()
            if name.startswith("run=") and name not in kept and (not name.startswith("run=0-") or int(name[6:].split("-")[0]) in done):
                fs.delete(s.getPath(), True)


def join_components(state: DataFrame, pairs: DataFrame, components) -> DataFrame:
    """What new ``pairs(a, b)`` change in a partition kept as ``state(node, root)``: rows for nodes that are new or get another root.

    The pairs are taken between the roots that their ends have so far, so the graph that is searched holds the new links only, and
    ``components(edges, a, b)`` gives the smallest node of each part. A root is the smallest node ever joined.
    """
    root = state.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    at = lambda df, c: df.join(root, F.col(c) == F.col("_n"), "left").withColumn(f"r{c}", F.coalesce("_r", c)).drop("_n", "_r")
    linked = at(at(pairs.filter("a is not null and b is not null"), "a"), "b")
    found = components(linked.select("ra", "rb"), "ra", "rb").select(F.col("node").alias("old"), F.col("component").alias("new"))
    moved = state.join(found.filter("old <> new"), F.col("root") == F.col("old")).select("node", F.col("new").alias("root"))
    ends = linked.select(F.col("a").alias("node"), F.col("ra").alias("old")).union(linked.select("b", "rb")).distinct()
    fresh = ends.join(state.select("node"), "node", "left_anti").join(found, "old").select("node", F.col("new").alias("root"))
    return moved.unionByName(fresh)
