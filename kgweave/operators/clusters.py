"""Clusters of equal size over any number of items: k-means in groups, centres found from several orders, rooms given out over all clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgweave.plans.scratch import Scratch

CODE_BITS = 12  # of a code in an order
ORDERS = 4  # in which items meet centres
NEAR = 8  # centres kept per item


def _axes(dims: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dims, bits))


def _centres(x: np.ndarray, k: int, max_iter: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from ``k`` of the rows; a centre without rows stays where it is."""
    centre = x[np.sort(np.random.default_rng(seed).choice(len(x), k, replace=k > len(x)))]
    label = None
    for _ in range(max_iter):
        new = _far(x, centre).argmin(1)
        if label is not None and (new == label).all():
            break
        label, count = new, np.bincount(new, minlength=k)
        sums = np.stack([np.bincount(new, x[:, j], k) for j in range(x.shape[1])], 1)
        centre = np.where(count[:, None] > 0, sums / np.maximum(1, count)[:, None], centre)
    return centre


def _far(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances but for each row's own length, which does not change its order."""
    return (centre * centre).sum(1)[None, :] - 2 * x @ centre.T


def _rows(f: pd.DataFrame, by: str, v: str) -> tuple[pd.DataFrame, np.ndarray]:
    f = f.sort_values(by).reset_index(drop=True)
    return f, np.stack(f[v].to_numpy()).astype(np.float64)


def _one_group(size: int, max_iter: int, seed: int):
    """All items in one group -> ``(idx, cluster)``, every centre open to every item."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f, x = _rows(f, "idx", "v")
        n, k = len(f), max(1, len(f) // size)
        order = np.argsort(_far(x, _centres(x, k, max_iter, seed)), 1, kind="stable")
        room, out = np.full(k, size), np.full(n, -1)
        for turn in range(k):
            left = np.flatnonzero(out < 0)
            if not len(left):
                break
            want = order[left, turn]
            by = np.argsort(want, kind="stable")
            place = np.arange(len(by)) - np.searchsorted(want[by], want[by])
            got = by[place < room[want[by]]]
            out[left[got]] = want[got]
            room -= np.bincount(want[got], minlength=k)
        return pd.DataFrame({"idx": f["idx"], "cluster": out})

    return run


def _group_centres(groups: int, n: int, size: int, stride: int, max_iter: int, seed: int):
    """A group's centres ``(grp, cluster, c)``. Groups share n // size clusters evenly, so that together they make just that many."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f, x = _rows(f, "idx", "v")
        g = int(f["grp"].iat[0])
        k = (g + 1) * n // groups // size - g * n // groups // size
        c = _centres(x, k, max_iter, seed + g) if k else []
        return pd.DataFrame({"grp": g, "cluster": np.arange(k) + g * stride, "c": [row.tolist() for row in c]})

    return run


def _nearest(items: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
    """The nearest centres of each item among those of its group: ``(idx, near)``, near as (squared distance, cluster)."""
    if items.empty or centres.empty:
        return pd.DataFrame({"idx": items["idx"].iloc[:0], "near": pd.Series([], dtype=object)})
    f, x = _rows(items, "idx", "v")
    c, y = _rows(centres, "cluster", "c")
    far, ids = _far(x, y) + (x * x).sum(1)[:, None], c["cluster"].to_numpy()
    best = np.argsort(far, 1, kind="stable")[:, :NEAR]
    near = [[{"far": float(far[i, j]), "cluster": int(ids[j])} for j in row] for i, row in enumerate(best)]
    return pd.DataFrame({"idx": f["idx"], "near": near})


def _numbered(df: DataFrame, work: Scratch, name: str, *keys: str) -> DataFrame:
    """``df`` with ``i``, its place (from 1) in the order of ``keys``, which are unique: ranges are written, then counted on from the ranges before."""
    parts = work.write(df.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), name)
    ahead = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", ahead.alias("ahead"))
    place = F.row_number().over(W.partitionBy("part").orderBy(*keys))
    return parts.join(counts, "part").withColumn("i", place + F.col("ahead")).drop("part", "ahead")


def balanced(items: DataFrame, size: int, group_clusters: int, max_iter: int, seed: int) -> DataFrame:
    """``(idx, cluster)`` of ``items(idx, v)``, ``idx`` unique; items without id or vector take no part.

    Up to ``group_clusters * size`` items are one group, finished in one task. Beyond that:

    1. An order by random projection codes is cut into groups of about that many items; items of one code are dealt over the groups it
       covers by a hash, so no group grows with the data or a hot code. k-means in each group gives its share of n // size centres.
    2. Items and centres meet in groups of ``ORDERS`` orders, the first being that of step 1. An item keeps the ``NEAR`` closest centres it met, wherever they come from.
    3. In round r every item without a cluster asks for its r-th centre. The smallest ids get in while there is room, counted over all items.
       A window limit keeps at most ``size`` applicants of a centre per task before the shuffle.
    4. Items left, by their closest centre, fill the rooms left, by cluster; the rest, less than ``size``, share cluster -1.
    """
    spark, work = items.sparkSession, Scratch(items.sparkSession, "clusters")
    rows = items.select("idx", F.col("v").cast("array<double>").alias("v")).filter("idx is not null and v is not null")
    kind = items.schema["idx"].dataType.simpleString()

    @F.pandas_udf("array<int>")
    def codes(v: pd.Series) -> pd.Series:
        x, bits = np.stack(v.to_numpy()), 1 << np.arange(CODE_BITS)[::-1]
        return pd.Series(list(np.stack([(x @ _axes(x.shape[1], CODE_BITS, seed + 101 * o) > 0) @ bits for o in range(ORDERS)], 1).astype(np.int32)))

    rows = work.write(rows.withColumn("codes", codes("v")), "coded")
    n = rows.count()
    groups = max(1, -(-n // (group_clusters * size)))
    if groups == 1:
        return rows.select(F.lit(0).alias("grp"), "idx", "v").groupBy("grp").applyInPandas(_one_group(size, max_iter, seed), f"idx {kind}, cluster int")

    # 2 ** CODE_BITS rows an order, codes without items among them
    met = rows.select(F.posexplode("codes").alias("o", "code")).groupBy("o", "code").agg(F.count("*").alias("m"))
    every = spark.range(ORDERS << CODE_BITS).select(F.shiftright("id", CODE_BITS).cast("int").alias("o"), (F.col("id") % (1 << CODE_BITS)).cast("int").alias("code"))
    before = F.coalesce(F.sum("m").over(W.partitionBy("o").orderBy("code").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = work.write(every.join(met, ["o", "code"], "left").withColumn("before", before), "counts")

    def dealt(df: DataFrame, o: int, key: str) -> DataFrame:
        of = F.broadcast(counts.filter(F.col("o") == o).select("code", "before", F.coalesce("m", F.lit(1)).alias("m")))
        place = F.least(F.col("before") + F.pmod(F.xxhash64(key), F.col("m")), F.lit(n - 1))
        return df.withColumn("code", F.col("codes")[o]).join(of, "code").withColumn("grp", F.floor(place * groups / n).cast("int"))

    stride = 2 * group_clusters
    first = dealt(rows, 0, "idx").select("grp", "idx", "v")
    centres = work.write(first.groupBy("grp").applyInPandas(_group_centres(groups, n, size, stride, max_iter, seed), "grp int, cluster int, c array<double>"), "centres")
    placed = centres.withColumn("codes", codes("c"))
    seen = None
    for o in range(ORDERS):
        a = dealt(rows, o, "idx").select("grp", "idx", "v")
        b = centres if o == 0 else dealt(placed.drop("grp"), o, "cluster").select("grp", "cluster", "c")
        new = a.groupBy("grp").cogroup(b.groupBy("grp")).applyInPandas(_nearest, f"idx {kind}, near array<struct<far:double,cluster:int>>")
        seen = new if seen is None else seen.unionByName(new)
    near = F.array_distinct(F.transform(F.array_sort(F.flatten(F.collect_list("near"))), lambda s: s.cluster))
    near = work.write(seen.groupBy("idx").agg(F.slice(near, 1, NEAR).alias("near")), "near")

    waiting, taken = near, None
    for r in range(NEAR):
        ask = waiting.select("idx", F.get("near", F.lit(r)).alias("cluster")).filter("cluster is not null")
        got = ask.withColumn("turn", F.row_number().over(W.partitionBy("cluster").orderBy("idx"))).filter(F.col("turn") <= size)
        if taken is not None:
            used = taken.groupBy("cluster").agg(F.count("*").alias("used"))
            got = got.join(used, "cluster", "left").filter(F.col("turn") <= size - F.coalesce("used", F.lit(0)))
        got = work.write(got.select("idx", "cluster"), f"got{r}")
        taken = got if taken is None else taken.unionByName(got)
        waiting = work.write(waiting.join(got, "idx", "left_anti"), f"waiting{r}")
        if waiting.isEmpty():
            break

    left = rows.select("idx").join(taken, "idx", "left_anti").join(near, "idx", "left").select(F.coalesce(F.get("near", F.lit(0)), F.lit(-1)).alias("closest"), "idx")
    used = taken.groupBy("cluster").agg(F.count("*").alias("used"))
    free = centres.select("cluster").join(used, "cluster", "left").withColumn("free", (size - F.coalesce("used", F.lit(0))).cast("int")).filter("free > 0")
    slots = free.select("cluster", F.explode(F.sequence(F.lit(1), "free")).alias("slot"))
    last = _numbered(left, work, "left", "closest", "idx").join(_numbered(slots, work, "slots", "cluster", "slot").select("i", "cluster"), "i", "left")
    return taken.unionByName(last.select("idx", F.coalesce("cluster", F.lit(-1)).alias("cluster")))
