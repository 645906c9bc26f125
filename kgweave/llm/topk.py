"""Exact top-k by inner product with block-at-a-time pruning.

Terms are vector components, with integer weights of either sign. Candidates lie in blocks of about ``BLOCK`` rows that
are near one of ``PIVOTS`` sampled vectors; a block has a forward index (its rows' weights) and each term's largest and
smallest weight. A query's bound for a block is the sum over its terms of the larger of weight x maximum and
weight x minimum: no row can score more. Each query takes its blocks by falling bound and stops as soon as the
next bound is below its k-th score. Ties at the k-th score are still scored. So the result is exact whatever the order.

Queries are dealt into chunks and blocks into parts, and every chunk meets every part in a task, which keeps at most k
rows of each query. One part in ``FIRST`` goes before the others: what it finds is the k-th score they start from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kgweave.plans.scratch import Scratch

K, BLOCK, PIVOTS, FIRST, QUERY_CHUNK, PART_BLOCKS = 20, 512, 256, 16, 1024, 64


def usable(vector: str) -> Column:
    """Not null, without null and without non-finite components."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(False))


def quantised(vector: str, scale: int = 64) -> Column:
    """floor(scale * x) of each component, with x as a double."""
    return F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def _matrix(column) -> np.ndarray:
    """A list column with lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _build(pivots: dict[int, np.ndarray]):
    """Rows -> (dim, pivot, id, w) with the number of the nearest pivot."""

    def run(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            near = np.zeros(len(dims), np.int32)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if d and d in pivots:
                    x, p = _matrix(b.column("w").take(pa.array(at))).astype(np.float64), pivots[d]
                    near[at] = ((p * p).sum(1)[None, :] - 2 * x @ p.T).argmin(1)
            yield pa.RecordBatch.from_arrays([b.column("dim"), pa.array(near), b.column("id"), b.column("w")], ["dim", "pivot", "id", "w"])

    return run


def _narrow(w: np.ndarray) -> tuple[bytes, int]:
    """Bytes of whole numbers in the smallest type that holds them, and its size."""
    top = np.abs(w).max(initial=0)
    size = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return w.astype(f"<i{size}").tobytes(), size


def _wide(raw: bytes, size: int, dim: int) -> np.ndarray:
    w = np.frombuffer(raw, f"<i{size}").astype(np.int64)
    return w.reshape(-1, dim) if dim else w.reshape(0, 0)


def _pack(key: list[str]):
    """Rows (id, w) sorted by ``key`` -> one row for each key: (key, dim, n, ids, size, weights)."""
    names = [*key, "dim", "n", "ids", "size", "weights"]

    def run(batches):
        cur, ids, rows = None, [], []

        def block():
            w = np.array(rows, np.int64).reshape(len(rows), -1)
            raw, size = _narrow(w)
            values = [*cur, w.shape[1], len(rows), np.array(ids, np.int64).tobytes(), size, raw]
            types = [pa.int64()] * len(key) + [pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

        for b in batches:
            for i, w, *k in zip(*(b.column(c).to_pylist() for c in ("id", "w", *key))):
                if rows and k != cur:
                    yield block()
                    ids, rows = [], []
                cur = k
                ids.append(i)
                rows.append(w)
        if rows:
            yield block()

    return run


def best_of_blocks(qid: np.ndarray, q: np.ndarray, least: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best rows of each query in some blocks (ids, weights): (place of the query, id, score), and how many pairs of query and block were scored."""
    m, many = len(q), len(blocks)
    up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    top = np.stack([w.max(0) for _, w in blocks]).astype(np.float64)
    low = np.stack([w.min(0) for _, w in blocks]).astype(np.float64)
    large = float(np.abs(q).max(initial=0)) * max(np.abs(top).max(initial=0), np.abs(low).max(initial=0)) * max(1, q.shape[1])
    exact = large < 2**52  # whole numbers are exact in doubles
    bound = up @ top.T + down @ low.T if exact else (up.astype(object) @ top.astype(object).T + down.astype(object) @ low.astype(object).T).astype(np.float64) * (1 + 1e-12) + 1
    order = np.argsort(-bound, 1, kind="stable")
    fq = q.astype(np.float64)
    kth, scored = least.copy(), 0
    r, c, v = (np.zeros(0, np.int64) for _ in range(3))
    for turn in range(many):
        want = order[:, turn]
        live = np.flatnonzero(bound[np.arange(m), want] >= kth)
        if not len(live):
            break  # bounds fall, so no later block can reach any query's k-th score
        found = [(r, c, v)]
        by = live[np.argsort(want[live], kind="stable")]
        cut = np.flatnonzero(np.r_[True, want[by][1:] != want[by][:-1], True])
        for a, z in zip(cut, cut[1:]):
            pick, (ids, w) = by[a:z], blocks[want[by[a]]]
            score = (fq[pick] @ w.T.astype(np.float64)).astype(np.int64) if exact else q[pick] @ w.T
            scored += len(pick)
            x, y = np.nonzero((score >= kth[pick, None]) & (ids[None, :] != qid[pick, None]))
            found.append((pick[x], ids[y], score[x, y]))
        r, c, v = (np.concatenate(t) for t in zip(*found))
        at = np.lexsort((c, -v, r))
        r, c, v = r[at], c[at], v[at]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        last = place == k - 1
        kth[r[last]] = np.maximum(kth[r[last]], v[last])
        r, c, v = r[place < k], c[place < k], v[place < k]
    return r, c, v, scored


def _score(k: int):
    """Sorted rows of a cell - its chunk of queries, then its blocks - -> (query_id, id, score), the k best of each query."""

    def run(batches):
        key, asked, blocks = None, None, []

        def cell():
            if asked is not None and blocks:
                qid, q, least = asked
                r, c, v, _ = best_of_blocks(qid, q, least, blocks, k)
                yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(c), pa.array(v)], ["query_id", "id", "score"])

        for b in batches:
            for *cur, dim, kind, ids, size, weights, least in zip(*(b.column(x).to_pylist() for x in ("dim", "part", "chunk", "dim", "kind", "ids", "size", "weights", "least"))):
                if cur != key:
                    yield from cell()
                    key, asked, blocks = cur, None, []
                ids = np.frombuffer(ids, np.int64)
                w = _wide(weights, size, dim) if dim else np.zeros((len(ids), 0), np.int64)
                if kind == 0:
                    floor = dict(zip(least[0::2], least[1::2])) if least else {}
                    asked = ids, w, np.array([floor.get(i, -(1 << 63)) for i in ids.tolist()], np.int64)
                else:
                    blocks.append((ids, w))
        yield from cell()

    return run


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, id, score)`` for ``candidates(id, w)`` and ``queries(query_id, w)``, ``w`` an array of longs.

    Each query's k highest inner products over all candidates but those of its own id, ties to the smaller id.
    Vectors of another length than the query's are no candidates of it. A candidate id that comes again is a candidate
    again; of queries with one id the smallest vector counts. Rows without an id are left out.
    """
    spark = candidates.sparkSession
    work = Scratch(spark, "topk")
    rows = work.write(candidates.filter("id is not null and w is not null").select(F.size("w").alias("dim"), "id", "w"), "rows")
    # a bounded sample of rows sets the order only
    sample: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect():
        sample.setdefault(r.dim, []).append(r.w)
    pivots = {d: np.array(v, np.float64) for d, v in sample.items()}
    near = work.write(rows.mapInArrow(_build(pivots), "dim int, pivot int, id long, w array<bigint>"), "near")
    # one row for each pivot and length of vectors
    sizes = work.write(near.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / block).alias("m")), "sizes")
    dealt = near.join(sizes, ["dim", "pivot"]).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("m"))).select("id", "w", F.col("dim").cast("long").alias("d"), F.col("pivot").cast("long").alias("pivot"), "piece")
    by = ["d", "pivot", "piece"]
    packed = "dim int, n int, ids binary, size int, weights binary"
    blocks = work.write(dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(_pack(by), f"d long, pivot long, piece long, {packed}"), "blocks")
    asked = queries.filter("query_id is not null and w is not null").groupBy(F.col("query_id").cast("long").alias("id")).agg(F.min("w").alias("w"))
    asked = asked.select("id", "w", F.size("w").cast("long").alias("d"))
    nq, nb = asked.count(), blocks.count()
    chunks, parts = max(1, -(-nq // QUERY_CHUNK)), max(FIRST, -(-nb // PART_BLOCKS))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)))
    asked = work.write(asked.repartition("d", "chunk").sortWithinPartitions("d", "chunk").mapInArrow(_pack(["d", "chunk"]), f"d long, chunk long, {packed}"), "queries")
    placed = blocks.withColumn("part", F.pmod(F.xxhash64(*by), F.lit(parts)))

    def meet(chosen: DataFrame, numbers: list[int], floor: DataFrame | None) -> DataFrame:
        """Every chunk of queries with every part of ``chosen``: the k best of each query in each part."""
        q = asked if floor is None else asked.join(floor, ["d", "chunk"], "left")
        q = q.withColumn("least", F.lit(None).cast("array<bigint>") if floor is None else F.col("least")).withColumn("part", F.explode(F.sequence(F.lit(numbers[0]).cast("long"), F.lit(numbers[1]).cast("long"))))
        c = chosen.withColumn("least", F.lit(None).cast("array<bigint>")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
        cols = ["dim", "part", "chunk", "ids", "size", "weights", "least"]
        both = q.select(*cols, F.lit(0).alias("kind")).unionByName(c.select(*cols, F.lit(1).alias("kind")))
        return both.repartition("dim", "part", "chunk").sortWithinPartitions("dim", "part", "chunk", "kind").mapInArrow(_score(k), "query_id long, id long, score long")

    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    split = max(1, parts // FIRST)
    first = work.write(meet(placed.filter(F.col("part") < split), [0, split - 1], None).withColumn("rank", rank).filter(F.col("rank") <= k), "first")
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("s")).filter("s is not null")
    # the k-th scores of a chunk's queries, pairs side by side: bounded by the chunk
    of = queries.select(F.col("query_id").cast("long").alias("query_id"), F.size("w").cast("long").alias("d")).distinct()
    floor = kth.join(of, "query_id").groupBy("d", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).alias("chunk")).agg(F.flatten(F.collect_list(F.array("query_id", "s"))).alias("least"))
    out = first.select("query_id", "id", "score")
    if parts > split:
        out = out.unionByName(meet(placed.filter(F.col("part") >= split), [split, parts - 1], floor))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter(usable("embedding"))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), quantised("embedding").alias("w"))
    queries = rows.filter(F.pmod("id", F.lit(20)) == 0).select(F.col("id").alias("query_id"), "w")
    return exact_top_k(rows, queries).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLES = {
    "op5_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.w) = len(c.w) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""
}
QUERIES = {"op5_top_k": op5_top_k}
