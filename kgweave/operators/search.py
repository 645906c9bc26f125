"""Retrieval, fusion, reranking and context packing for whole tables of queries."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgweave.functions.text import normalize_text
from kgweave.operators.graph import bfs_nearest, first_reached
from kgweave.operators.graph_tables import keyset_page
from kgweave.operators.text_index import bm25_top
from kgweave.plans import testgraph as tg
from kgweave.plans.registry import query
from kgweave.plans.scratch import Scratch

QUERY_BLOCK = 2048


def top_k(df: DataFrame, k: int, by: str = "query_id", tie: str = "item_id") -> DataFrame:
    """The ``k`` best rows of each query, ties to the smaller id, with ``rank`` from 1."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), tie))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def search_filters(labels: list | None = None, relation_types: list | None = None, document_sources: list | None = None, community_level: int | None = None, properties: dict | None = None) -> Column:
    """One predicate: all conditions given must hold, each by any of its values; nothing given lets all pass."""
    out = F.lit(True)
    for col, values in (("label", labels), ("type", relation_types), ("document_source", document_sources)):
        if values:
            out = out & F.col(col).isin(values)
    if community_level is not None:
        out = out & (F.col("level") == community_level)
    for k, v in (properties or {}).items():
        out = out & (F.col("properties")[k] == v)
    return out


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def truncate_and_normalize(vector: Column | str, dims: int) -> Column:
    """The first ``dims`` components scaled to length 1; a zero vector stays."""
    v = F.slice(F.col(vector) if isinstance(vector, str) else vector, 1, dims)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


#: Rows of a packed block at most.
PACK_ROWS = 4096


def _pack(parts: int | None, by: str | None):
    """Rows (item_id, v) -> a row for each Arrow batch, or for each run of equal ``by`` in it."""

    def run(batches):
        for b in batches:
            cuts = [0] if by is None else np.flatnonzero(np.r_[True, np.diff(b.column(by).to_numpy()) != 0]).tolist()
            for a, z in zip(cuts, [*cuts[1:], b.num_rows]):
                for at in range(a, z, PACK_ROWS):
                    part = b.slice(at, min(PACK_ROWS, z - at))
                    ids, v = part.column("item_id"), part.column("v")
                    cell = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                    key = part.column(by)[0].as_py() if by else zlib.crc32(str(ids[0].as_py()).encode()) % parts
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), cell(ids), cell(v)], [by or "part", "ids", "v"])

    return run


def pack_rows(rows: DataFrame, parts: int | None = None, by: str | None = None) -> DataFrame:
    """``(part | by, ids, v)``: consecutive rows ``(item_id, v)`` of a task as blocks, dealt to ``parts`` or each of one value of the int column ``by``."""
    t = {c: rows.schema[c].dataType.simpleString() for c in ("item_id", "v")}
    return rows.mapInArrow(_pack(parts, by), f"{by or 'part'} int, ids array<{t['item_id']}>, v array<{t['v']}>")


def unique_queries(queries: DataFrame) -> DataFrame:
    """``(query_id, q)`` with one row for an id: the smallest of its vectors."""
    return queries.filter("q is not null").groupBy("query_id").agg(F.min("q").alias("q"))


#: Scores that a task remembers at most; beyond, of each query only the least score that it must reach.
REMEMBERED = 1 << 22


class Best:
    """The ``k`` best scores that a task has seen of each query, by block of queries, so that later blocks of candidates give only pairs that may still count."""

    def __init__(self, k: int):
        self.k, self.floors, self.kept, self.size = k, {}, {}, 0

    def floor(self, block: int, n: int) -> np.ndarray:
        """The least score that a pair of each of the block's ``n`` queries must reach."""
        if block not in self.floors:
            self.floors[block] = np.full(n, -np.inf)
            if self.size + n * self.k <= REMEMBERED:
                self.size += n * self.k
                self.kept[block] = np.full((n, self.k), -np.inf)
        return self.floors[block]

    def reach(self, block: int, s: np.ndarray, error: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the pairs that may be among the best, where a score may be off by a row's ``error``."""
        least = self.floor(block, len(s)) - error
        if s.shape[1] > self.k and (new := np.flatnonzero(least == -np.inf)).size:
            off = error if np.isscalar(error) else error[new]
            least[new] = np.partition(s[new], s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k] - 2 * off
        return np.divmod(np.flatnonzero(s >= np.nextafter(least.astype(s.dtype), s.dtype.type(-np.inf))[:, None]), s.shape[1])

    def add(self, block: int, r: np.ndarray, c: np.ndarray, s: np.ndarray, cut: bool = True) -> np.ndarray:
        """Remember the scores of some pairs; the places of those that count. ``cut``: of equal scores the smaller columns are enough."""
        floor = self.floors[block]
        order = np.lexsort((c, -s, r))
        order = order[s[order] >= floor[r[order]]]
        rows, scores = r[order], s[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        first = place < self.k
        if (kept := self.kept.get(block)) is not None:
            at, to = np.unique(rows, return_inverse=True)
            both = np.full((len(at), 2 * self.k), -np.inf)
            both[:, self.k :] = kept[at]
            both[to[first], place[first]] = scores[first]
            kept[at] = np.partition(both, self.k, axis=1)[:, self.k :]
            floor[at] = kept[at].min(1)
        else:
            last = place == self.k - 1
            floor[rows[last]] = np.maximum(floor[rows[last]], scores[last])
        return order[first] if cut else order[scores >= floor[rows]]


def in_order(ids: pa.Array, *columns: pa.Array) -> tuple[bool, list[pa.Array]]:
    """Ids and what belongs to them in the order of ids, and whether there is one."""
    if pa.types.is_nested(ids.type):
        return False, [ids, *columns]
    order = pc.sort_indices(ids)
    return True, [x.take(order) for x in (ids, *columns)]


def matrix(lists: pa.Array, kind=np.float64) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(lists), -1)


def _score_blocks(k: int, metric: str, threshold: float | None):
    """Pairs of a block of queries and a block of candidates -> the k best of each query that the task has seen so far, ties to the smaller id. Vectors with
    non-finite components take no part.

    Cosines are taken in single precision first; those that may count, given its error, are computed again in double precision."""

    def run(batches):
        best = Best(k)
        for b in batches:
            for i in range(b.num_rows):
                block, asked = b.column("block")[i].as_py(), b.column("asked")[i].values
                ranked, (ids, rows) = in_order(b.column("ids")[i].values, b.column("v")[i].values)
                v, q = matrix(rows), matrix(asked.field("q"))
                if not (finite := np.isfinite(v).all(1)).all():
                    ids, v = ids.filter(pa.array(finite)), v[finite]
                if metric == "cosine":
                    nq, nv = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
                    small = min(nq[nq > 0].min(initial=1), nv[nv > 0].min(initial=1)) < 1e-15
                    kind = np.float64 if small else np.float32
                    unit = lambda x, n: (x / np.maximum(1e-30, n)[:, None]).astype(kind)
                    s = q @ v.T / np.maximum(1e-30, nq[:, None] * nv[None, :]) if small else unit(q, nq) @ unit(v, nv).T
                    error = (q.shape[1] + 16) * float(np.finfo(kind).eps)
                    r, c = best.reach(block, s, error)
                    found = np.empty(len(r))
                    for at in range(0, len(r), 1 << 16):
                        x, y = r[at : at + (1 << 16)], c[at : at + (1 << 16)]
                        found[at : at + (1 << 16)] = (q[x] * v[y]).sum(1) / np.maximum(1e-30, nq[x] * nv[y])
                else:
                    if metric == "euclid":
                        s = -np.sqrt(np.maximum(0, ((q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * q @ v.T)))
                    else:
                        s = q @ v.T
                    r, c = best.reach(block, s)
                    found = s[r, c]
                own = best.add(block, r, c, found, ranked)
                own = own if threshold is None else own[found[own] >= threshold]
                yield pa.RecordBatch.from_arrays([asked.field("query_id").take(pa.array(r[own])), ids.take(pa.array(c[own])), pa.array(found[own])], ["query_id", "item_id", "score"])

    return run


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "cosine", threshold: float | None = None, where: Column | None = None) -> DataFrame:
    """``(query_id, item_id, score, rank)`` for ``queries(query_id, q)`` over ``vectors(item_id, v)``, all of them.

    ``cosine`` and ``dot`` score by the product, ``euclid`` by the negative distance. Queries are gathered in blocks of about
    ``QUERY_BLOCK``; every block goes to each part of the candidates, and a task drops what is worse than the ``k`` best it has seen of a query, so the last
    shuffle carries little more than those. Candidates are dealt once, or stay where they are while Spark can broadcast the queries. Of a
    query id that comes again the smallest vector counts. ``where`` filters candidates before they are scored.
    """
    rows = vectors if where is None else vectors.filter(where)
    t = {c: f.schema[c].dataType.simpleString() for f, c in ((queries, "query_id"), (vectors, "item_id"))}
    parts = 2 * int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = pack_rows(rows.filter("v is not null").select("item_id", "v"), parts)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = unique_queries(queries).groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query_id", "q")).alias("asked"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    out = packed.join(asked, "part").select("block", "ids", "v", "asked").mapInArrow(_score_blocks(k, metric, threshold), f"query_id {t['query_id']}, item_id {t['item_id']}, score double")
    return top_k(out, k)


def _count_terms(batches):
    """Rows (item_id, w) -> (item_id, term, tf, dl): the distinct words of each row, counted."""
    for b in batches:
        words = b.column("w")
        size = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        if not len(coded):
            continue
        row, width = np.repeat(np.arange(b.num_rows), size), max(1, len(coded.dictionary))
        pair, tf = np.unique(row * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        row, term = np.divmod(pair, width)
        yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(row)), coded.dictionary.take(pa.array(term)), pa.array(tf), pa.array(size[row])], ["item_id", "term", "tf", "dl"])


@dataclass
class TextIndex:
    """An inverted index: ``postings(item_id, term, tf, dl)`` and ``terms(term, df, idf)`` in the shared folder, and two numbers."""

    postings: DataFrame
    terms: DataFrame
    n: int
    avgdl: float
    k1: float
    b: float
    unicode: bool

    def weight(self) -> Column:
        return F.col("tf") * (self.k1 + 1) / (F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("dl") / F.lit(self.avgdl or 1.0)))

    def asked(self, queries: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """The terms of ``queries(query_id, text)`` that the index knows, with how often each is asked."""
        words = F.filter(F.split(normalize_text("text", self.unicode), " "), lambda w: w != "")
        rows = queries.select("query_id", *keep, F.explode(words).alias("term")).groupBy("query_id", *keep, "term").agg(F.count("*").alias("qf"))
        return rows.join(self.terms, "term")


def inverted_index(docs: DataFrame, key: str = "item_id", text: str = "text", k1: float = 1.5, b: float = 0.75, floor: float = 0.25, unicode: bool = False, keep: tuple[str, ...] = ()) -> TextIndex:
    """The index of ``docs``, one row per item. A term's idf below zero counts as ``floor`` times the mean idf. ``keep`` columns stay with the postings."""
    work = Scratch(docs.sparkSession, "index")
    words = docs.select(F.col(key).alias("item_id"), F.filter(F.split(normalize_text(text, unicode), " "), lambda w: w != "").alias("w"), *keep)
    kind = docs.schema[key].dataType.simpleString()
    postings = work.write(words.select("item_id", "w").mapInArrow(_count_terms, f"item_id {kind}, term string, tf long, dl long"), "postings")
    n, avgdl = words.agg(F.count("*"), F.avg(F.size("w"))).first()
    index = TextIndex(postings, postings, n or 0, avgdl or 0.0, k1, b, unicode)
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = work.write(df.withColumn("idf", F.log(F.lit(float(n or 0)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "frequencies")
    mean = idf.agg(F.avg("idf")).first()[0] or 0.0
    index.terms = idf.withColumn("idf", F.when(F.col("idf") < 0, floor * mean).otherwise(F.col("idf")))
    if keep:
        index.postings = postings.join(docs.select(F.col(key).alias("item_id"), *keep), "item_id")
    return index


def bm25_scores(queries: DataFrame, docs: DataFrame, k1: float = 1.5, b: float = 0.75, floor: float = 0.25, unicode: bool = False, within: str | None = None) -> DataFrame:
    """``(query_id, item_id, score)`` of Okapi BM25 for ``queries(query_id, text)`` over ``docs(item_id, text)``: only documents that share
    a term, and with ``within`` only those of the query's own value of that column. A term's idf below zero counts as ``floor`` times
    the mean idf. A term repeated in a query counts each time. All pairs are scored: for the best of each query see ``bm25_top``."""
    keep = (within,) if within else ()
    index = inverted_index(docs, k1=k1, b=b, floor=floor, unicode=unicode, keep=keep)
    hits = index.asked(queries, keep).join(index.postings, ["term", *keep])
    return hits.groupBy("query_id", "item_id").agg(F.sum(F.col("qf") * F.col("idf") * index.weight()).alias("score"))


def hybrid_search(dense: DataFrame, sparse: DataFrame, k: int = 10, alpha: float = 0.5, threshold: float | None = None) -> DataFrame:
    """Both legs scaled to 0..1 per query (min-max; a constant leg counts 1) and summed with weights ``alpha`` and ``1 - alpha``."""

    def scaled(df: DataFrame, name: str) -> DataFrame:
        w = W.partitionBy("query_id")
        lo, hi = F.min("score").over(w), F.max("score").over(w)
        return df.select("query_id", "item_id", F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(1.0).alias(name))

    both = scaled(dense, "d").join(scaled(sparse, "s"), ["query_id", "item_id"], "full_outer")
    out = both.select("query_id", "item_id", (alpha * F.coalesce("d", F.lit(0.0)) + (1 - alpha) * F.coalesce("s", F.lit(0.0))).alias("score"))
    return top_k(out if threshold is None else out.filter(F.col("score") >= threshold), k)


def rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """``lists(query_id, kind, item_id, list, rank, score)`` -> reciprocal rank fusion, one row per item."""
    return lists.groupBy("query_id", "kind", "item_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.max("score").alias("best_score"), F.max_by("list", F.struct("score", "list")).alias("list"))


def token_overlap(q: Column, text: Column) -> Column:
    """Default pair scorer: ten times the share of the query's distinct words that the text has; native."""
    words = lambda c: F.array_distinct(F.filter(F.split(normalize_text(c, False), " "), lambda w: w != ""))
    return F.when(F.size(words(q)) > 0, F.size(F.array_intersect(words(q), words(text))) * 10.0 / F.size(words(q)))


def pair_rerank(pairs: DataFrame, k: int, scorer: Callable[[Column, Column], Column] = token_overlap) -> DataFrame:
    """``pairs(query_id, item_id, query, text)`` scored by the logistic function of a fifth of the scorer; a blank query or text scores 0."""
    raw = scorer(F.col("query"), F.col("text"))
    blank = (F.trim(F.coalesce("query", F.lit(""))) == "") | (F.trim(F.coalesce("text", F.lit(""))) == "")
    return top_k(pairs.withColumn("score", F.when(blank, 0.0).otherwise(1 / (1 + F.exp(-raw / 5)))).drop("query", "text"), k)


def mmr(hits: DataFrame, k: int = 10, lam: float = 0.7, candidates: int = 100) -> DataFrame:
    """Maximal marginal relevance over ``hits(query_id, item_id, score, v)``: of the ``candidates`` best of a query, greedily the one with most
    lam * score / best - (1 - lam) * largest cosine to those chosen. The first in rank order wins a tie."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["score", "item_id"], ascending=[False, True]).reset_index(drop=True)
        v = np.stack(f["v"].to_numpy()).astype(np.float64)
        v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-10
        rel = f["score"].to_numpy(np.float64) / (f["score"].max() + 1e-10)
        sim, near, chosen, open_ = v @ v.T, np.zeros(len(f)), [], np.ones(len(f), bool)
        for _ in range(min(k, len(f))):
            s = np.where(open_, lam * rel - (1 - lam) * near, -np.inf)
            i = int(s.argmax())
            chosen.append((f.at[i, "query_id"], f.at[i, "item_id"], len(chosen) + 1, float(s[i])))
            open_[i] = False
            near = sim[i] if len(chosen) == 1 else np.maximum(near, sim[i])
        return pd.DataFrame(chosen, columns=["query_id", "item_id", "rank", "score"])

    best = top_k(hits, candidates).drop("rank")
    t = {c: hits.schema[c].dataType.simpleString() for c in ("query_id", "item_id")}
    return best.select("query_id", "item_id", "score", "v").groupBy("query_id").applyInPandas(run, f"query_id {t['query_id']}, item_id {t['item_id']}, rank int, score double")


def node_distance_rerank(hits: DataFrame, decay: float = 0.5) -> DataFrame:
    """Scores of hits matched on ``hop_n`` fall by ``decay`` to the n."""
    hop = F.regexp_extract("matched_on", r"^hop_(\d+)", 1)
    out = hits.withColumn("score", F.when(hop != "", F.col("score") * F.pow(F.lit(decay), F.expr("try_cast(regexp_extract(matched_on, '^hop_(\\\\d+)', 1) as int)"))).otherwise(F.col("score")))
    return out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "item_id")))


@dataclass(frozen=True)
class Recipe:
    """What a search does; data only."""

    methods: tuple[str, ...]
    reranker: str = "rrf"
    bfs: bool = False
    bfs_depth: int = 2
    limit: int = 20
    min_score: float | None = None
    top: dict = field(default_factory=lambda: {"entity": 10, "relation": 10, "chunk": 10, "community": 5})


ALL = ("entity", "relation", "chunk", "community")
RECIPES = {m: Recipe((m,)) for m in ALL} | {"hybrid_rrf": Recipe(ALL), "hybrid_cross_encoder": Recipe(ALL, "cross_encoder", True), "bfs_expand": Recipe(("entity",), bfs=True, limit=50), "hybrid_mmr": Recipe(ALL, "mmr"), "hybrid_distance": Recipe(ALL, "node_distance", True)}


def retrieve(queries: DataFrame, items: DataFrame, kind: str, k: int, threshold: float | None = None, where: Column | None = None) -> DataFrame:
    """One leg: hybrid search of ``queries(query_id, text, q)`` over the items ``(kind, item_id, text, v)`` of a kind."""
    own = items.filter(F.col("kind") == kind)
    own = own if where is None else own.filter(where)
    dense = vector_search(queries.select("query_id", "q"), own.select("item_id", "v"), k * 4)
    sparse = bm25_top(queries.select("query_id", "text"), own.select("item_id", "text"), k * 4)
    return hybrid_search(dense, sparse, k, threshold=threshold).select("query_id", F.lit(kind).alias("kind"), "item_id", F.lit(kind).alias("list"), "rank", "score", F.lit("hybrid").alias("matched_on"))


@dataclass
class SearchGraph:
    """What expansion needs: ``nodes(id, name, label)``, ``edges(from, to, type)``, and for the legs whose items are no entities the entities they lead to: both ends of a
    relation, those that a chunk mentions, the members of a community, each ``(item_id, entity_id)``."""

    nodes: DataFrame
    edges: DataFrame
    relation: DataFrame | None = None
    chunk: DataFrame | None = None
    community: DataFrame | None = None


def expand_legs(legs: DataFrame, graph: SearchGraph, depth: int = 2, limit: int = 50) -> DataFrame:
    """Graph neighbours of the hits ``legs(query_id, list, item_id, rank)``, for each query and leg by itself: one search from all seeds, at most ``limit`` entities a
    leg, ranked after the leg's own hits. A leg without a table of entities has no seeds. An item that many queries hit is searched from once."""
    items = legs.select("list", "item_id").distinct()
    seeds = items.filter(F.col("list") == "entity").select("list", "item_id", F.col("item_id").alias("node_id"))
    for name in ("relation", "chunk", "community"):
        links = getattr(graph, name)
        if links is not None:
            own = items.filter(F.col("list") == name)
            seeds = seeds.unionByName(own.join(links.select("item_id", F.col("entity_id").alias("node_id")), "item_id").select("list", "item_id", "node_id"))
    found = bfs_nearest(seeds.select(F.struct("list", "item_id").alias("query_id"), "node_id"), graph.edges, graph.nodes, depth, limit)
    found = Scratch(legs.sparkSession, "expanded").write(found.select("query_id.list", "query_id.item_id", "node_id", "name", "hop"), "items")
    found = first_reached(legs.select("query_id", "list", "item_id").distinct().join(found, ["list", "item_id"]), ["query_id", "list"], limit)
    after = legs.groupBy("query_id", "list").agg(F.max("rank").alias("_n"))
    return found.join(after, ["query_id", "list"]).select("query_id", F.lit("entity").alias("kind"), F.col("node_id").alias("item_id"), "list", (F.col("_n") + F.col("rank")).alias("rank"), (1 / (1 + F.col("hop"))).alias("score"), F.concat(F.lit("hop_"), "hop").alias("matched_on"))


def search(queries: DataFrame, items: DataFrame, recipe: Recipe, graph: SearchGraph | tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``(query_id, kind, item_id, score, rank)``: the recipe's legs, graph neighbours of each leg's seeds after its own hits, the recipe's
    reranker, least score, limit. ``graph`` serves the recipes that expand; (nodes, edges) alone expands entity hits."""
    legs = None
    for m in recipe.methods:
        leg = retrieve(queries, items, m, recipe.top[m])
        legs = leg if legs is None else legs.unionByName(leg)
    if recipe.bfs and graph is not None:
        legs = Scratch(queries.sparkSession, "legs").write(legs, "hits")
        legs = legs.unionByName(expand_legs(legs, graph if isinstance(graph, SearchGraph) else SearchGraph(*graph), recipe.bfs_depth))
    keyed = legs.groupBy("query_id", "kind", "item_id").agg(F.max_by(F.struct("score", "matched_on"), F.struct("score", "matched_on")).alias("s")).select("query_id", "kind", "item_id", "s.*")
    texts = items.select("kind", "item_id", F.col("text").alias("_text"), "v")
    if recipe.reranker == "rrf":
        out = rrf(legs).select("query_id", "kind", "item_id", "score")
    elif recipe.reranker == "cross_encoder":
        pairs = keyed.join(texts, ["kind", "item_id"]).join(queries.select("query_id", F.col("text").alias("query")), "query_id")
        out = pair_rerank(pairs.select("query_id", "kind", "item_id", "query", F.col("_text").alias("text")), recipe.limit)
    elif recipe.reranker == "mmr":
        hit = keyed.join(texts.drop("_text"), ["kind", "item_id"]).select("query_id", F.struct("kind", "item_id").alias("key"), "score", "v")
        flat = hit.withColumn("item_id", F.concat_ws("\0", "key.kind", "key.item_id"))
        out = mmr(flat, recipe.limit).select("query_id", F.split("item_id", "\0")[0].alias("kind"), F.split("item_id", "\0")[1].alias("item_id"), "score")
    elif recipe.reranker == "node_distance":
        out = node_distance_rerank(keyed).select("query_id", "kind", "item_id", "score")
    else:
        raise ValueError(f"no reranker named {recipe.reranker}")
    out = out if recipe.min_score is None else out.filter(F.col("score") >= recipe.min_score)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "kind", "item_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= recipe.limit).select("query_id", "kind", "item_id", "score", "rank")


def federated_search(hits: DataFrame, limit: int, members: list[str] | None = None, known: list[str] | None = None) -> DataFrame:
    """Fuse ``hits(query_id, graph_id, kind, item_id, rank, score)`` of several graphs; each item keeps its graph."""
    if members is not None and known is not None and (missing := sorted(set(members) - set(known))):
        raise ValueError(f"no graph named {', '.join(missing)}")
    h = hits if members is None else hits.filter(F.col("graph_id").isin(members))
    fused = h.groupBy("query_id", "graph_id", "kind", "item_id").agg(F.sum(1.0 / (60 + F.col("rank"))).alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "graph_id", "kind", "item_id"))
    return fused.withColumn("rank", rank).filter(F.col("rank") <= limit).withColumnRenamed("graph_id", "source_graph_id")


#: Section titles by kind, in their fixed order.
SECTIONS = (("entity", "Entities"), ("relation", "Facts"), ("chunk", "Passages"), ("community", "Community summaries"), ("row", "Query results"))


def pack_context(hits: DataFrame, max_chars: int = 2500) -> DataFrame:
    """``hits(query_id, kind, rank, line)`` -> ``(query_id, context)``: per kind a heading and its lines, as many from the front as fit the budget; a
    later section goes on with what is left, and no heading stands alone."""
    # a line that starts beyond the budget of its own section never fits, so no list grows with its query
    before = W.partitionBy("query_id", "kind").orderBy("rank", "line").rowsBetween(W.unboundedPreceding, -1)
    hits = hits.withColumn("_at", F.coalesce(F.sum(F.length("line") + 3).over(before), F.lit(0))).filter(F.col("_at") <= max_chars)
    lists = hits.groupBy("query_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("rank", "line")))), lambda x: F.concat(F.lit("- "), x["line"])).alias(k) for k, _ in SECTIONS])
    lists = lists.withColumn("_out", F.array().cast("array<string>")).withColumn("_n", F.lit(0))

    def step(st: Column, line: Column) -> Column:
        n = st["len"] + 1 + F.length(line)
        ok = ~st["stop"] & (n <= max_chars)
        return F.struct(F.when(ok, F.concat(st["out"], F.array(line))).otherwise(st["out"]).alias("out"), F.when(ok, n).otherwise(st["len"]).cast("int").alias("len"), (~ok).alias("stop"))

    for k, title in SECTIONS:
        head = F.lit(f"## {title}")
        start = F.col("_n") + F.when(F.size("_out") > 0, 1).otherwise(0) + F.length(head)
        init = F.struct(F.array().cast("array<string>").alias("out"), start.cast("int").alias("len"), (start > max_chars).alias("stop"))
        lists = lists.withColumn("_st", F.aggregate(k, init, step))
        some = F.size("_st.out") > 0
        lists = lists.withColumn("_n", F.when(some, F.col("_st.len")).otherwise(F.col("_n"))).withColumn("_out", F.when(some, F.concat("_out", F.array(head), "_st.out")).otherwise(F.col("_out")))
    return lists.select("query_id", F.array_join("_out", "\n").alias("context"))


def graph_views(nodes: DataFrame, edges: DataFrame) -> None:
    nodes.createOrReplaceTempView("kg_nodes")
    edges.createOrReplaceTempView("kg_edges")


def sql_rows(result: DataFrame, order: str) -> DataFrame:
    """Rows of a query as hits: score 1 - 0.01 per place, not below 0."""
    place = F.row_number().over(W.orderBy(order)) - 1
    return result.withColumn("score", F.greatest(F.lit(0.0), F.round(1 - 0.01 * place, 6)))


def quantize_int8(vectors: DataFrame, quantile: float = 0.99, v: str = "v") -> DataFrame:
    """Components clipped at the quantile of their absolute values and scaled to -127..127; ``scale`` undoes it."""
    bound = vectors.select(F.explode(v).alias("x")).agg(F.percentile_approx(F.abs("x").cast("double"), quantile, 10000)).first()[0] or 1.0
    return vectors.withColumn("code", F.transform(v, lambda x: F.round(F.least(F.greatest(x.cast("double"), F.lit(-bound)), F.lit(bound)) * (127 / bound)).cast("byte"))).withColumn("scale", F.lit(bound / 127))


def quantize_binary(vectors: DataFrame, v: str = "v") -> DataFrame:
    """Signs of the components as longs of 64 bits."""
    size = F.ceil(F.size(v) / 64).cast("int")
    word = lambda w: F.aggregate(F.slice(F.col(v), w * 64 + 1, F.lit(64)), F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).alias("i")), lambda s, x: F.struct((s["b"].bitwiseOR(F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), s["i"])).otherwise(F.lit(0).cast("long")))).alias("b"), (s["i"] + 1).alias("i")), lambda s: s["b"])
    return vectors.withColumn("bits", F.transform(F.sequence(F.lit(0), size - 1), word))


def retrieve_vectors(table: DataFrame, ids: DataFrame, key: str = "item_id") -> DataFrame:
    """The rows of the ids, once each; unknown ids give none."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def count_vectors(table: DataFrame, where: Column | None = None) -> DataFrame:
    return (table if where is None else table.filter(where)).agg(F.count("*").alias("n"))


def delete_vectors(table: DataFrame, ids: DataFrame | None = None, where: Column | None = None, key: str = "item_id") -> DataFrame:
    """Without the rows of the ids, and without those the condition holds for; a condition that is null keeps its row."""
    out = table if ids is None else table.join(ids.select(key), key, "left_anti")
    return out if where is None else out.filter(~F.coalesce(where, F.lit(False)))


def scroll_vectors(table: DataFrame, limit: int, cursor=None, where: Column | None = None, key: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """The next ``limit`` rows in the order of the key after ``cursor``, and the next cursor (null unless the page is full)."""
    return keyset_page(table, limit, cursor, where, key)


def upsert_vectors(table: DataFrame, new: DataFrame, key: str = "item_id") -> DataFrame:
    return table.join(new.select(key), key, "left_anti").unionByName(new)


def _t(spark, d, name):
    return tg.table(spark, d, name)


def _emb(spark, d) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"), "label")


def _emb_queries(spark, d, every: int = 20) -> DataFrame:
    return _emb(spark, d).filter(F.col("item_id") % every == 0).select(F.col("item_id").alias("query_id"), F.col("v").alias("q"))


_COS = "list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"


@query("V1_vector_search", f"SELECT q.vec_id AS query_id, c.vec_id AS item_id, round({_COS}, 6) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, c.vec_id) <= 10")
def v1(spark, d):
    return vector_search(_emb_queries(spark, d), _emb(spark, d)).select("query_id", "item_id", F.round("score", 6).alias("score"))


@query("P9_filtered_search", f"SELECT q.vec_id AS query_id, c.vec_id AS item_id, round({_COS}, 6) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 AND c.label IN (1, 3, 5) AND {_COS} >= 0.1 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, c.vec_id) <= 10")
def p9(spark, d):
    return vector_search(_emb_queries(spark, d), _emb(spark, d), threshold=0.1, where=search_filters(labels=[1, 3, 5])).select("query_id", "item_id", F.round("score", 6).alias("score"))


_BM = """w AS (SELECT doc_id, list_filter(string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' '), lambda x: x <> '') AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
 p AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM w) GROUP BY 1, 2), f AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM p, s GROUP BY term, n),
 i AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM f) ELSE idf END AS idf FROM f), q AS (SELECT item_id AS query_id, term, count(*) AS qf FROM (SELECT item_id, unnest(string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' ')) AS term FROM benchmark) WHERE term <> '' GROUP BY 1, 2),
 bm AS (SELECT query_id, doc_id AS item_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN i USING (term) JOIN p USING (term), s GROUP BY 1, 2),
 top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM bm)"""


def _bm(spark, d):
    q = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return bm25_scores(q, _t(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")).withColumn("score", F.round("score", 9))


def _bm_top(spark, d, k: int):
    q = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return bm25_top(q, _t(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text"), k)


@query("V2_bm25", f"WITH {_BM} SELECT query_id, item_id, rank::INTEGER AS rank, round(score, 6) AS score FROM top WHERE rank <= 10")
def v2(spark, d):
    return _bm_top(spark, d, 10).withColumn("score", F.round("score", 6))


@query("R4_bm25_scores", f"WITH {_BM} SELECT query_id, count(*) AS n, round(sum(score), 4) AS total, round(max(score), 6) AS best FROM bm GROUP BY 1")
def r4(spark, d):
    return _bm(spark, d).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"), F.round(F.max("score"), 6).alias("best"))


# legs with scores from the tables: a query is a customer, an item a part it ordered
_LEGS = """a AS (SELECT o_custkey AS query_id, l_partkey AS item_id, max(l_quantity) AS score FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2), b AS (SELECT o_custkey AS query_id, l_partkey AS item_id, max(l_extendedprice) AS score FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY 1, 2)"""


def _legs(spark, d):
    x = _t(spark, d, "orders").join(_t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    g = lambda df, c: df.groupBy(F.col("o_custkey").alias("query_id"), F.col("l_partkey").alias("item_id")).agg(F.max(c).alias("score"))
    return g(x, "l_quantity"), g(x.filter("l_returnflag = 'R'"), "l_extendedprice")


_SC = "SELECT query_id, item_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS x FROM {} WINDOW w AS (PARTITION BY query_id)"


@query("V3_hybrid", f"WITH {_LEGS}, h AS (SELECT query_id, item_id, round(0.5 * coalesce(p.x, 0) + 0.5 * coalesce(s.x, 0), 9) AS score FROM ({_SC.format('a')}) p FULL JOIN ({_SC.format('b')}) s USING (query_id, item_id)) SELECT query_id, item_id, score FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) <= 10")
def v3(spark, d):
    a, b = _legs(spark, d)
    h = hybrid_search(a, b, 10**9).withColumn("score", F.round("score", 9)).drop("rank")
    return top_k(h, 10).drop("rank")


@query("V5_rrf", f"WITH {_LEGS}, l AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r FROM a UNION ALL SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) FROM b) SELECT query_id, item_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM l GROUP BY 1, 2")
def v5(spark, d):
    a, b = (top_k(x, 10**9).withColumn("list", F.lit(n)).withColumn("kind", F.lit("part")) for x, n in zip(_legs(spark, d), "ab"))
    return rrf(a.unionByName(b)).select("query_id", "item_id", F.round("score", 9).alias("score"))


@query("V6_pair_rerank", f"WITH {_BM}, c AS (SELECT query_id, item_id FROM top WHERE rank <= 20), qs AS (SELECT item_id AS query_id, list_distinct(list_filter(string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' '), lambda x: x <> '')) AS q FROM benchmark), z AS (SELECT query_id, c.item_id, round(1 / (1 + exp(-2.0 * len(list_intersect(q, w)) / len(q))), 9) AS score FROM c JOIN qs USING (query_id) JOIN w ON w.doc_id = c.item_id) SELECT query_id, item_id, round(score, 6) AS score FROM z QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) <= 5")
def v6(spark, d):
    docs, q = _t(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text"), _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    pairs = _bm_top(spark, d, 20).select("query_id", "item_id").join(docs, "item_id").join(q, "query_id")
    scored = pair_rerank(pairs, 10**9).withColumn("score", F.round("score", 9)).drop("rank")
    return top_k(scored, 5).select("query_id", "item_id", F.round("score", 6).alias("score"))


@query("V7_mmr")
def v7(spark, d):
    hits = vector_search(_emb_queries(spark, d), _emb(spark, d), 40).drop("rank").join(_emb(spark, d).select("item_id", "v"), "item_id")
    return mmr(hits, 10)


@query("V8_node_distance", "SELECT o_orderkey AS item_id, o_custkey AS query_id, round(CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice ELSE o_totalprice * 0.5 ** (o_orderkey % 4) END, 6) AS score FROM orders")
def v8(spark, d):
    h = _t(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item_id"), F.col("o_totalprice").alias("score"), F.expr("CASE WHEN o_orderkey % 4 = 0 THEN 'hybrid' ELSE 'hop_' || (o_orderkey % 4) END").alias("matched_on"))
    return node_distance_rerank(h).select("item_id", "query_id", F.round("score", 6).alias("score"))


def corpus_items(spark, d) -> tuple[DataFrame, DataFrame]:
    """Search items over the tables: documents are chunks, test graph nodes entities, nations community reports; and queries of the benchmark."""
    from kgweave.operators.chunks import embed

    docs = _t(spark, d, "documents").select(F.lit("chunk").alias("kind"), F.col("doc_id").cast("string").alias("item_id"), "text")
    ents = tg.nodes(spark, d).select(F.lit("entity").alias("kind"), F.col("id").alias("item_id"), F.concat_ws(" ", "name", "label").alias("text"))
    rels = _t(spark, d, "supplier").select(F.lit("relation").alias("kind"), F.concat(F.lit("SUP:"), "s_suppkey").alias("item_id"), F.concat(F.lit("located in "), F.col("s_nationkey"), F.lit(" of the "), F.col("s_name")).alias("text"))
    comms = _t(spark, d, "nation").select(F.lit("community").alias("kind"), F.concat(F.lit("NAT:"), "n_nationkey").alias("item_id"), F.concat(F.lit("nation "), F.col("n_name")).alias("text"))
    items = embed(docs.union(ents).union(rels).union(comms), "text", "v")
    asked = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return embed(asked, "text", "q"), items


@query("V9_search_hybrid_rrf")
def v9(spark, d):
    q, items = corpus_items(spark, d)
    return search(q, items, RECIPES["hybrid_rrf"])


def _search_graph(spark, d) -> SearchGraph:
    """Ends of the relation items (a supplier and its nation), customers that documents mention (of the same number), suppliers of a nation."""
    sup = _t(spark, d, "supplier").select(F.concat(F.lit("SUP:"), "s_suppkey").alias("s"), F.concat(F.lit("NAT:"), "s_nationkey").alias("n"))
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("item_id"), F.concat(F.lit("CUS:"), F.col("doc_id") + 1).alias("entity_id"))
    ends = sup.select(F.col("s").alias("item_id"), F.col("s").alias("entity_id")).union(sup.select("s", "n"))
    return SearchGraph(tg.nodes(spark, d), tg.edges(spark, d), ends, docs, sup.select(F.col("n").alias("item_id"), F.col("s").alias("entity_id")))


@query("V4_entity_bfs")
def v4(spark, d):
    q, items = corpus_items(spark, d)
    return search(q, items, RECIPES["bfs_expand"], (tg.nodes(spark, d), tg.edges(spark, d)))


@query("V9_search_expanded")
def v9_expanded(spark, d):
    """All four legs, each with the neighbours of its own seeds."""
    q, items = corpus_items(spark, d)
    return search(q, items, Recipe(ALL, "node_distance", True), _search_graph(spark, d))


@query("V4_seeds_by_kind", f"""WITH {tg.SQL}, s AS (SELECT s_suppkey AS query_id, 'entity' AS list, 'SUP:'||s_suppkey AS node FROM supplier UNION SELECT s_suppkey, 'relation', 'SUP:'||s_suppkey FROM supplier UNION SELECT s_suppkey, 'relation', 'NAT:'||s_nationkey FROM supplier
 UNION SELECT s_suppkey, 'chunk', 'CUS:'||(doc_id + 1) FROM supplier JOIN documents ON doc_id = s_suppkey UNION SELECT a.s_suppkey, 'community', 'SUP:'||b.s_suppkey FROM supplier a JOIN supplier b USING (s_nationkey)),
 one AS (SELECT DISTINCT query_id, list, "to" AS n FROM s JOIN edges ON "from" = s.node), two AS (SELECT DISTINCT query_id, list, "to" AS n FROM one JOIN edges ON "from" = one.n),
 r AS (SELECT query_id, list, n, min(h) AS hop FROM (SELECT *, 1 AS h FROM one UNION ALL SELECT *, 2 FROM two) GROUP BY 1, 2, 3)
 SELECT query_id, list, n AS item_id, 'hop_'||hop AS matched_on, 1 + row_number() OVER (PARTITION BY query_id, list ORDER BY hop, name, n) AS rank, 1.0::DOUBLE / (1 + hop) AS score FROM r JOIN nodes ON nodes.id = n QUALIFY rank <= 51""")
def v4_seeds(spark, d):
    """Each supplier is a query with one hit a leg: itself, its relation to its nation, the document of its number, its nation's community."""
    sup = _t(spark, d, "supplier").join(_t(spark, d, "documents").select("doc_id"), F.col("doc_id") == F.col("s_suppkey"), "left")
    hit = lambda name, item: sup.select(F.col("s_suppkey").alias("query_id"), F.lit(name).alias("list"), item.cast("string").alias("item_id"), F.lit(1).alias("rank"))
    own = F.concat(F.lit("SUP:"), "s_suppkey")
    legs = hit("entity", own).union(hit("relation", own)).union(hit("chunk", F.col("doc_id"))).union(hit("community", F.concat(F.lit("NAT:"), "s_nationkey")))
    return expand_legs(legs, _search_graph(spark, d)).drop("kind")


@query("V10_federated", f"WITH {_BM}, h AS (SELECT query_id, source, item_id, score FROM bm JOIN documents ON doc_id = item_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY round(score, 9) DESC, item_id) AS r FROM h), z AS (SELECT query_id, source AS source_graph_id, item_id, round(1.0::DOUBLE / (60 + r), 9) AS score FROM r WHERE r <= 20) SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_graph_id, item_id) <= 20")
def v10(spark, d):
    q = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("source").alias("graph_id"), "text")
    h = bm25_top(q, docs, 20, group="graph_id").withColumn("kind", F.lit("chunk"))
    return federated_search(h, 20).select("query_id", "source_graph_id", "item_id", F.round("score", 9).alias("score"))


@query("V11_pack_context", "WITH h AS (SELECT o_custkey AS query_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, '- '||o_orderpriority||' '||o_orderkey AS line FROM orders), s AS (SELECT *, 11 + sum(length(line) + 1) OVER (PARTITION BY query_id ORDER BY rank) AS n FROM h) SELECT query_id, '## Passages'||chr(10)||string_agg(line, chr(10) ORDER BY rank) AS context FROM s WHERE n <= 120 GROUP BY 1")
def v11(spark, d):
    h = _t(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.lit("chunk").alias("kind"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rank"), F.concat_ws(" ", "o_orderpriority", "o_orderkey").alias("line"))
    return pack_context(h, 120)


@query("V12_sql_rows", f"WITH {tg.SQL}, r AS (SELECT label, count(*) AS n FROM nodes GROUP BY 1) SELECT label, n, round(1 - 0.01::DOUBLE * (row_number() OVER (ORDER BY label) - 1), 6) AS score FROM r")
def v12(spark, d):
    graph_views(tg.nodes(spark, d), tg.edges(spark, d))
    return sql_rows(spark.sql("SELECT label, count(*) AS n FROM kg_nodes GROUP BY 1"), "label")


@query("V13_int8", "SELECT vec_id AS item_id, 64 AS n, true AS close FROM embeddings")
def v13(spark, d):
    """Codes times the scale give the clipped components back, to half a step."""
    q = quantize_int8(_emb(spark, d))
    bound = F.col("scale") * 127
    near = F.forall(F.arrays_zip("v", "code"), lambda x: F.abs(F.least(F.greatest(x["v"].cast("double"), -bound), bound) - x["code"] * F.col("scale")) <= F.col("scale") * 0.5001)
    return q.select("item_id", F.size("code").alias("n"), near.alias("close"))


@query("V13_binary", "SELECT vec_id AS item_id, CAST(list_sum(list_transform(embedding, lambda x, i: CASE WHEN x > 0 AND i <= 32 THEN (1::BIGINT << (i - 1)) ELSE 0 END)) AS BIGINT) AS low FROM embeddings")
def v13_binary(spark, d):
    return quantize_binary(_emb(spark, d)).select("item_id", F.col("bits")[0].bitwiseAND(F.lit((1 << 32) - 1)).alias("low"))


@query("V14_truncate", "SELECT vec_id AS item_id, round(e[1] / n, 6) AS first, round(list_sum(list_transform(e, lambda x: x * x)) / (n * n), 6) AS norm FROM (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT vec_id, embedding[1:16]::DOUBLE[] AS e FROM embeddings))")
def v14(spark, d):
    t = truncate_and_normalize("v", 16)
    return _emb(spark, d).select("item_id", F.round(t[0], 6).alias("first"), F.round(F.aggregate(t, F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


@query("V15_upsert", "SELECT vec_id AS item_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0")
def v15(spark, d):
    e = _emb(spark, d)
    return upsert_vectors(e.filter("item_id % 2 = 0"), e.filter("item_id % 3 = 0").withColumn("label", F.col("label") + 100)).select("item_id", "label")


@query("V15_retrieve", "SELECT vec_id AS item_id, label FROM embeddings WHERE vec_id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)")
def v15_retrieve(spark, d):
    ids = _t(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("item_id"))
    return retrieve_vectors(_emb(spark, d), ids.union(ids)).select("item_id", "label")


@query("V15_count", "SELECT count(*) AS n FROM embeddings WHERE label IN (1, 3)")
def v15_count(spark, d):
    return count_vectors(_emb(spark, d), search_filters(labels=[1, 3]))


@query("V15_delete", "SELECT vec_id AS item_id, label FROM embeddings WHERE vec_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) AND label <> 2")
def v15_delete(spark, d):
    ids = _t(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("item_id"))
    return delete_vectors(_emb(spark, d), ids, search_filters(labels=[2])).select("item_id", "label")


@query("V15_scroll", "WITH a AS (SELECT vec_id, label FROM embeddings WHERE label <> 4), one AS (SELECT * FROM a ORDER BY vec_id LIMIT 40), two AS (SELECT * FROM a WHERE vec_id > (SELECT max(vec_id) FROM one) ORDER BY vec_id LIMIT 40) SELECT 1 AS page, vec_id AS item_id, label FROM one UNION ALL SELECT 2, vec_id, label FROM two")
def v15_scroll(spark, d):
    """Two pages, the second from the cursor that the first gave."""
    rows, where = _emb(spark, d).select("item_id", "label"), F.col("label") != 4
    one, cursor = scroll_vectors(rows, 40, where=where)
    two, _ = scroll_vectors(rows, 40, cursor.first().cursor, where)
    return one.select(F.lit(1).alias("page"), "item_id", "label").union(two.select(F.lit(2), "item_id", "label"))
