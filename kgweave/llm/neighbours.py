"""Approximate nearest neighbours: a graph built by NN-descent, searched greedily.

Index. Equal vectors are one node (with the ids it stands for). A first graph comes from ``TREES`` orders of the
nodes by random projection codes: each run of ``CHUNK`` nodes in an order is compared whole. NN-descent then
repeats joins of neighbours of neighbours: the nearest forward and reverse neighbours of every node meet at
that node and are compared with each other, and every node keeps its ``DEGREE`` nearest seen so far. It ends
when a round hardly shortens the edges. Distances of the index use half-precision copies.

Search. A query starts at the nearest of a bounded sample of nodes, and at its own node if its vector is indexed, and holds the ``BEAM`` nearest nodes seen.
Each round expands its nearest unexpanded ones along forward and reverse edges; it ends when all are
expanded. Distances here are exact, in doubles on the original vectors.

Every set at a node is bounded: forward edges by the degree, reverse edges to the nearest ``REVERSE`` (a
window limit that each task applies before the shuffle, so a hub costs no task more than others).
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kgweave.llm.topk import _matrix, usable
from kgweave.plans.scratch import Scratch

DEGREE, FORWARD, REVERSE, OFFER = 32, 20, 16, 8
TREES, CHUNK, SAMPLE, ENTRIES, SEED = 6, 160, 4096, 16, 3
ROUNDS, SETTLED, BEAM, EXPAND = 6, 0.002, 320, 48


def _codes(scale: float, bits: int, centre: dict[int, np.ndarray], trees: int):
    """Nodes -> (dim, tree, code, node, h): the node in each order."""

    def run(batches):
        for b in batches:
            dims, node = b.column("dim").to_numpy(), b.column("node").to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = (_matrix(b.column("x").take(pa.array(at))) * scale).astype(np.float32)
                h = [r.tobytes() for r in x.astype(np.float16)]
                mid = centre.get(int(d), np.zeros(d, np.float32))
                for t in range(trees):
                    axes = np.random.default_rng(SEED + t).normal(size=(d, bits)).astype(np.float32)
                    code = (((x - mid) @ axes > 0) @ (1 << np.arange(bits)[::-1].astype(np.int64))).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(dims[at]), pa.array(np.full(len(at), t, np.int32)), pa.array(code), pa.array(node[at]), pa.array(h)], ["dim", "tree", "code", "node", "h"])

    return run


def _near(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the k nearest other rows and their squared distances."""
    n = len(x)
    s = (x * x).sum(1)
    d = s[:, None] + s[None, :] - 2 * x @ x.T
    np.fill_diagonal(d, np.inf)
    k = min(k, n - 1)
    at = np.argpartition(d, k - 1, 1)[:, :k] if k < n - 1 else np.argsort(d, 1)[:, :k]
    return at, np.maximum(0, np.take_along_axis(d, at, 1))


OFFERS = "node long, ids binary, ds binary"


def _offers(node, ids, ds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array([r.tobytes() for r in ids]), pa.array([r.tobytes() for r in ds])], ["node", "ids", "ds"])


def _compare(node: np.ndarray, h: list[bytes], k: int):
    if len(node) < 2:
        return None
    at, d = _near(np.frombuffer(b"".join(h), np.float16).reshape(len(node), -1).astype(np.float32), k)
    return _offers(node, node[at], d.astype(np.float32))


def _whole(batches, key: list[str]):
    """Slices of batches sorted by ``key`` in which no group is cut, as (arrays, group starts with the end)."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        k = np.stack([t.column(c).to_numpy() for c in key], 1)
        if not len(k):
            continue
        cut = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(1)])
        if cut[-1]:
            yield t.slice(0, cut[-1]).combine_chunks(), cut
        rest = t.slice(cut[-1])
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), np.array([0, rest.num_rows])


def _chunks(k: int, size: int):
    """Nodes sorted in their orders -> offers among each run of ``size``."""

    def run(batches):
        key, node, h = None, [], []
        for b in batches:
            for d, t, n, x in zip(*(b.column(c).to_pylist() for c in ("dim", "tree", "node", "h"))):
                if node and ((d, t) != key or len(node) == size):
                    if (out := _compare(np.array(node), h, k)) is not None:
                        yield out
                    node, h = [], []
                key = d, t
                node.append(n)
                h.append(x)
        if (out := _compare(np.array(node), h, k)) is not None:
            yield out

    return run


def _meet(k: int):
    """Members of each node, side by side -> offers among them."""

    def run(batches):
        for t, cut in _whole(batches, ["node"]):
            member, h = t.column("nbr").to_numpy(), t.column("h").to_pylist()
            out = [x for a, z in zip(cut, [*cut[1:], t.num_rows]) if a < z and (x := _compare(member[a:z], h[a:z], k)) is not None]
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return run


def _merge(k: int):
    """Offers sorted by node -> the k nearest distinct ones: (node, nbr, d, rank)."""

    def run(batches):
        for t, _ in _whole(batches, ["node"]):
            sizes = np.array([len(x) for x in t.column("ids").to_pylist()]) // 8
            node = np.repeat(t.column("node").to_numpy(), sizes)
            nbr, d = np.frombuffer(b"".join(t.column("ids").to_pylist()), np.int64), np.frombuffer(b"".join(t.column("ds").to_pylist()), np.float32)
            order = np.lexsort((d, nbr, node))
            node, nbr, d = node[order], nbr[order], d[order]
            new = np.r_[True, (node[1:] != node[:-1]) | (nbr[1:] != nbr[:-1])] & (node != nbr)
            node, nbr, d = node[new], nbr[new], d[new]
            order = np.lexsort((nbr, d, node))
            node, nbr, d = node[order], nbr[order], d[order]
            first = np.searchsorted(node, node)
            rank = (np.arange(len(node)) - first + 1).astype(np.int32)
            ok = rank <= k
            yield pa.RecordBatch.from_arrays([pa.array(node[ok]), pa.array(nbr[ok]), pa.array(d[ok]), pa.array(rank[ok])], ["node", "nbr", "d", "rank"])

    return run


def _pack_edges(batches):
    for t, cut in _whole(batches, ["node"]):
        nbr, d = t.column("nbr").to_numpy(), t.column("d").to_numpy()
        ends = [*cut[1:], t.num_rows]
        pairs = [(a, z) for a, z in zip(cut, ends) if a < z]
        node = t.column("node").to_numpy()[[a for a, _ in pairs]]
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([nbr[a:z].tobytes() for a, z in pairs]), pa.array([d[a:z].tobytes() for a, z in pairs])], ["node", "ids", "ds"])


def nodes_of(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", copies: int = 11) -> DataFrame:
    """``(node, dim, x, ids)``: each distinct usable vector that isn't zero, with its ``copies`` smallest ids."""
    rows = vectors.filter(usable(vector)).filter(F.exists(vector, lambda x: x != 0)).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    turn = F.row_number().over(W.partitionBy("x").orderBy("id"))
    rows = rows.filter("id is not null").distinct().withColumn("turn", turn).filter(F.col("turn") <= copies)
    return rows.groupBy("x").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("node"), F.size("x").alias("dim"), "x", "ids")


def build_graph(nodes: DataFrame, work: Scratch, degree: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    """``(node, nbr, d, rank)``: each node's nearest neighbours found by NN-descent."""
    n, top = nodes.agg(F.count("*"), F.max(F.aggregate("x", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x))))).first()
    scale = 1 / top if top else 1.0
    # a bounded sample gives the centre that the projection codes cut through
    centre: dict[int, list] = {}
    for r in nodes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("dim", "x").collect():
        centre.setdefault(r.dim, []).append(r.x)
    centre = {d: (np.median(np.array(v), 0) * scale).astype(np.float32) for d, v in centre.items()}
    bits = min(40, max(4, int(np.ceil(np.log2(max(2, n) / 16)))))
    coded = nodes.select("dim", "node", "x").mapInArrow(_codes(scale, bits, centre, TREES), "dim int, tree int, code long, node long, h binary")
    coded = work.write(coded, "codes")
    half = work.write(coded.filter("tree = 0").select(F.col("node").alias("nbr"), "h"), "half")
    tasks = max(1, min(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 8, -(-n * TREES // (CHUNK * 64))), -(-n * TREES // (CHUNK * 4096)))
    offers = coded.repartitionByRange(tasks, "dim", "tree", "code", "node").sortWithinPartitions("dim", "tree", "code", "node").mapInArrow(_chunks(degree, CHUNK), OFFERS)
    edges, length = None, None
    for r in range(rounds + 1):
        merged = offers.repartition("node").sortWithinPartitions("node").mapInArrow(_merge(degree), "node long, nbr long, d float, rank int")
        edges = work.write(merged, f"edges{r}")
        if r > 1:
            work.drop(f"edges{r - 2}")
        now = edges.agg(F.sum(F.sqrt("d"))).first()[0] or 0.0
        if r == rounds or length is not None and now >= (1 - SETTLED) * length:
            break
        length = now
        turn = F.row_number().over(W.partitionBy("node").orderBy("d", "nbr"))
        back = edges.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "d").withColumn("turn", turn).filter(F.col("turn") <= REVERSE)
        members = edges.filter(F.col("rank") <= FORWARD).select("node", "nbr").union(back.select("node", "nbr")).distinct().join(half, "nbr")
        met = members.repartition("node").sortWithinPartitions("node").mapInArrow(_meet(OFFER), OFFERS)
        old = edges.select("node", "nbr", "d").repartition("node").sortWithinPartitions("node").mapInArrow(_pack_edges, OFFERS)
        offers = met.unionByName(old)
    return edges


def _enter(entries: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Queries -> (query_id, node) of their nearest entries."""

    def run(batches):
        for b in batches:
            dims, q = b.column("dim").to_numpy(), b.column("query_id").to_numpy()
            for d in np.unique(dims):
                if d not in entries:
                    continue
                at = np.flatnonzero(dims == d)
                node, x = entries[d]
                dist = (x * x).sum(1)[None, :] - 2 * _matrix(b.column("q").take(pa.array(at))) @ x.T
                best = np.argsort(dist, 1, kind="stable")[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q[at], best.shape[1])), pa.array(node[best].ravel())], ["query_id", "node"])

    return run


def search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, work: Scratch, beam: int = BEAM) -> DataFrame:
    """``(query_id, node, d)``: the ``beam`` nearest nodes that a greedy search finds for ``queries(query_id, dim, q)``."""
    turn = F.row_number().over(W.partitionBy("node").orderBy("d", "nbr"))
    back = edges.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "d").withColumn("turn", turn).filter(F.col("turn") <= REVERSE)
    links = work.write(edges.select("node", "nbr").union(back.select("node", "nbr")).groupBy("node").agg(F.collect_set("nbr").alias("nbrs")), "links")
    entries: dict[int, tuple[list, list]] = {}
    for r in nodes.orderBy(F.xxhash64("node", F.lit(1))).limit(SAMPLE).select("dim", "node", "x").collect():
        kept = entries.setdefault(r.dim, ([], []))
        kept[0].append(r.node)
        kept[1].append(r.x)
    entries = {d: (np.array(a), np.array(b)) for d, (a, b) in entries.items()}
    q, x = queries.select("query_id", "q"), nodes.select("node", "x")
    square = F.aggregate(F.zip_with("q", "x", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    measured = lambda found: found.join(q, "query_id").join(x, "node").select("query_id", "node", F.sqrt(square).alias("d"))
    own = queries.join(nodes.select("node", F.col("x").alias("q")), "q").select("query_id", "node")
    starts = queries.mapInArrow(_enter(entries, ENTRIES), "query_id long, node long").union(own).distinct()
    state = measured(starts).withColumn("done", F.lit(False))
    state = work.write(state, "beam")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("d", "node"))
    for step in itertools.count():  # every round expands a node of each open query, so it ends
        open_ = state.filter("not done").withColumn("turn", rank).filter(F.col("turn") <= EXPAND).select("query_id", "node")
        reached = open_.join(links, "node").select("query_id", F.explode("nbrs").alias("node")).distinct()
        fresh = reached.join(state.select("query_id", "node"), ["query_id", "node"], "left_anti")
        expanded = state.join(open_.withColumn("now", F.lit(True)), ["query_id", "node"], "left").select("query_id", "node", "d", (F.col("done") | F.coalesce("now", F.lit(False))).alias("done"))
        both = expanded.unionByName(measured(fresh).withColumn("done", F.lit(False))).withColumn("turn", rank).filter(F.col("turn") <= beam).drop("turn")
        new = work.write(both, f"beam{step}")
        work.drop("beam" if step == 0 else f"beam{step - 1}")
        state = new
        if state.filter("not done").isEmpty():
            break
    return state.select("query_id", "node", "d")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest rows found for ``queries(query_id, q)`` by Euclidean distance.

    ``q`` is an array of doubles. A row with the query's own id is no candidate, other copies of its vector are.
    A repeated query counts once; of several vectors of one query_id the smallest (by its first component, then the next) is asked for.
    Ties go to the smaller id. An id that has several vectors is listed once, by the nearest. Vectors that are null, zero or hold null or non-finite components take no part;
    vectors of different length never meet. Rows without an id are left out. Recall is measured in the tests.
    """
    spark = vectors.sparkSession
    work = Scratch(spark, "nearest")
    nodes = work.write(nodes_of(vectors, vec_id, vector, k + 1), "nodes")
    if nodes.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    edges = build_graph(nodes, work)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "q").groupBy("query_id").agg(F.min("q").alias("q"))
    asked = work.write(asked.select("query_id", F.size("q").alias("dim"), "q"), "queries")
    found = search(asked, nodes, edges, work)
    rows = found.join(nodes.select("node", "ids"), "node").select("query_id", F.explode("ids").alias("vec_id"), F.col("d").alias("score")).filter("vec_id <> query_id")
    rows = rows.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = rows.filter(F.pmod(F.col("vec_id").cast("long"), F.lit(100)) == 0).filter(usable("embedding")).filter(F.exists("embedding", lambda x: x != 0))
    queries = asked.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    return nearest(rows, queries)


QUERIES = {"op3_neighbours": op3_neighbours}
