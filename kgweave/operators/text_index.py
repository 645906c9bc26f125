"""Keyword search over a block-max index: documents in blocks, each with its own postings and the most that any of them can add.

A block holds the documents of a short range of ids: its terms in order, their postings as packed numbers of documents and counts, and for each term the largest
weight of its postings. A task goes through the blocks of its part with a block of queries and keeps the ``k`` best of each query. A
query is scored in a block only if the sum of its terms' largest weights there reaches the k-th score it has by then; the postings of
other queries' terms are never touched. So what is shuffled is one row of text statistics per block, not one for each posting.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kgweave.functions.text import normalize_text
from kgweave.plans.scratch import Scratch

#: Documents and words of a block at most (a longer document is a block of its own); queries that go through blocks together.
BLOCK_DOCS, BLOCK_WORDS, QUERIES = 2048, 1 << 20, 1024


def _words(text: str, unicode: bool):
    return F.filter(F.split(normalize_text(text, unicode), " "), lambda w: w != "")


def weights(tf: np.ndarray, dl: np.ndarray, avgdl: float, k1: float, b: float) -> np.ndarray:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / (avgdl or 1.0)))


def _block(ids: pa.Array, words: pa.ListArray, weigh) -> list:
    """The columns of one block: ids, dl, terms, counts, docs, tfs, most."""
    dl = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    code = place[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
    pair, tf = np.unique(code * max(1, len(ids)) + np.repeat(np.arange(len(ids)), dl), return_counts=True)
    term, doc = np.divmod(pair, max(1, len(ids)))
    starts = np.searchsorted(term, np.arange(len(order)))
    most = np.maximum.reduceat(weigh(tf, dl[doc]), starts) if len(term) else np.zeros(0)
    one = lambda x: pa.array([x.tobytes()])
    cell = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    counts = pa.array(np.diff(np.r_[starts, len(term)]).astype(np.int32))
    return [cell(ids), one(dl.astype(np.uint32)), cell(coded.dictionary.take(pa.array(order))), cell(counts), one(doc.astype(np.uint16)), one(tf.astype(np.uint32)), one(most)]


def _make_blocks(weigh, group: bool):
    """Rows (group, item_id, w) in order -> blocks of one group each."""

    def run(batches):
        held, n_words, key, number = [], 0, None, 0

        def close():
            rows = pa.concat_tables(held).combine_chunks()
            made = _block(rows.column("item_id").combine_chunks(), rows.column("w").combine_chunks(), weigh)
            name = [rows.column("group").combine_chunks().slice(0, 1)] if group else []
            return pa.RecordBatch.from_arrays([*name, *made], [*["group"] * group, *NAMES])

        for b in batches:
            sizes = b.column("w").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            own = b.column("group").to_pylist() if group else [None] * b.num_rows
            at = 0
            for i in range(b.num_rows + 1):
                here = number + i - at
                full = i < b.num_rows and here and (own[i] != key or here >= BLOCK_DOCS or n_words + sizes[i] > BLOCK_WORDS)
                if i == b.num_rows or full:
                    if i > at:
                        held.append(pa.Table.from_batches([b.slice(at, i - at)]))
                    number, at = here, i
                    if full:
                        yield close()
                        held, n_words, number = [], 0, 0
                if i < b.num_rows:
                    key, n_words = own[i], n_words + sizes[i]
        if held:
            yield close()

    return run


NAMES = ["ids", "dl", "terms", "counts", "docs", "tfs", "most"]


@dataclass
class BlockIndex:
    """``blocks`` and ``terms(term, df, idf)`` in the shared folder, and the numbers that weights need."""

    blocks: DataFrame
    terms: DataFrame
    n: int
    avgdl: float
    k1: float
    b: float
    unicode: bool
    group: str | None


def block_index(docs: DataFrame, key: str = "item_id", text: str = "text", k1: float = 1.5, b: float = 0.75, floor: float = 0.25, unicode: bool = False, group: str | None = None) -> BlockIndex:
    """The index of ``docs``, one row per item. A term's idf below zero counts as ``floor`` times the mean idf. With ``group`` no block
    mixes that column's values (null is one of them). A null or blank text has no terms; repeated rows are items of their own."""
    work = Scratch(docs.sparkSession, "blocks")
    own = [F.col(group).alias("group")] if group else []
    rows = docs.select(*own, F.col(key).alias("item_id"), F.col(text).alias("text"))
    words = rows.withColumn("w", _words("text", unicode)).drop("text")
    n, avgdl = words.agg(F.count("*"), F.avg(F.size("w"))).first()
    avgdl = avgdl or 0.0
    order = [*["group"] * bool(group), "item_id"]
    fields = [*(T.StructField("group", words.schema["group"].dataType) for _ in own), T.StructField("ids", T.ArrayType(words.schema["item_id"].dataType)), T.StructField("dl", T.BinaryType()), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.IntegerType())), *(T.StructField(c, T.BinaryType()) for c in NAMES[4:])]
    # texts are dealt as they are: words are more bytes, and would be made twice as ranges are sampled
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("w", _words("text", unicode)).drop("text")
    blocks = work.write(rows.mapInArrow(_make_blocks(lambda tf, dl: weights(tf, dl, avgdl, k1, b), bool(group)), T.StructType(fields)), "blocks")
    df = blocks.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("df"))
    idf = work.write(df.withColumn("idf", F.log(F.lit(float(n or 0)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "terms")
    mean = idf.agg(F.avg("idf")).first()[0] or 0.0
    return BlockIndex(blocks, idf.withColumn("idf", F.when(F.col("idf") < 0, floor * mean).otherwise(F.col("idf"))), n or 0, avgdl, k1, b, unicode, group)


class Scorer:
    """The best of each query of a block of queries over the blocks it is shown; ``read`` counts postings that were scored."""

    def __init__(self, asked: list[dict], k: int, digits: int, weigh):
        self.ids = [q["query_id"] for q in asked]
        self.terms = sorted({t["term"] for q in asked for t in q["terms"]})
        at = {t: i for i, t in enumerate(self.terms)}
        self.own = [np.array([at[t["term"]] for t in q["terms"]], np.int64) for q in asked]
        self.w = [np.array([t["w"] for t in q["terms"]]) for q in asked]
        self.k, self.digits, self.weigh, self.read = k, digits, weigh, 0
        self.best: list[list] = [[] for _ in asked]

    def show(self, ids: list, dl: np.ndarray, terms: pa.Array, counts: np.ndarray, docs: np.ndarray, tfs: np.ndarray, most: np.ndarray) -> None:
        place = pc.fill_null(pc.index_in(pa.array(self.terms, pa.string()), value_set=terms), -1).to_numpy(zero_copy_only=False)
        starts = np.cumsum(counts) - counts
        top = np.where(place >= 0, most[place], 0.0) if len(most) else np.zeros(len(place))
        made: dict[int, tuple] = {}
        for x, (own, w) in enumerate(zip(self.own, self.w)):
            here = place[own] >= 0
            best = self.best[x]
            least = best[-1][0] if len(best) == self.k else -np.inf
            if not here.any() or np.maximum(w * top[own], 0.0).sum() < least - 10.0**-self.digits:
                continue
            score, seen = np.zeros(len(ids)), np.zeros(len(ids), bool)
            for t, v in zip(own[here], w[here]):
                p = place[t]
                if p not in made:
                    at = docs[starts[p] : starts[p] + counts[p]]
                    made[p] = at, self.weigh(tfs[starts[p] : starts[p] + counts[p]].astype(np.float64), dl[at])
                at, add = made[p]
                score[at] += v * add
                seen[at] = True
                self.read += len(at)
            score = np.round(score, self.digits)
            new = np.flatnonzero(seen & (score >= least))
            if len(new) > 4 * self.k:  # all that tie with the k-th of them stay
                new = new[score[new] >= -np.partition(-score[new], self.k - 1)[self.k - 1]]
            self.best[x] = [(-s, i) for s, i in heapq.nsmallest(self.k, [(-s, i) for s, i in best] + [(-score[i], ids[i]) for i in new.tolist()])]

    def take(self) -> list[tuple]:
        rows = [(q, i, s) for q, best in zip(self.ids, self.best) for s, i in best]
        self.best = [[] for _ in self.ids]
        return rows


def _score(k: int, digits: int, weigh, types: dict, group: bool):
    def run(batches):
        held: dict[int, Scorer] = {}
        of: dict[int, object] = {}

        def out(x):
            rows = held[x].take()
            own = [pa.array([of[x]] * len(rows), types["group"])] if group else []
            return pa.RecordBatch.from_arrays([*own, *(pa.array([r[i] for r in rows], t) for i, t in enumerate((types["query_id"], types["item_id"], pa.float64())))], [*["group"] * group, "query_id", "item_id", "score"])

        for b in batches:
            for i in range(b.num_rows):
                x = b.column("block")[i].as_py()
                if x not in held:
                    held[x] = Scorer(b.column("asked")[i].as_py(), k, digits, weigh)
                if group:
                    key = b.column("group")[i].as_py()
                    if x in of and of[x] != key:
                        yield out(x)
                    of[x] = key
                raw = {c: np.frombuffer(b.column(c)[i].as_py(), t) for c, t in (("dl", np.uint32), ("docs", np.uint16), ("tfs", np.uint32), ("most", np.float64))}
                held[x].show(b.column("ids")[i].as_py(), raw["dl"].astype(np.float64), b.column("terms")[i].values, b.column("counts")[i].values.to_numpy(zero_copy_only=False).astype(np.int64), raw["docs"], raw["tfs"], raw["most"])
        for x in held:
            yield out(x)

    return run


def bm25_top(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, floor: float = 0.25, unicode: bool = False, digits: int = 9, group: str | None = None, index: BlockIndex | None = None) -> DataFrame:
    """``(query_id, item_id, score, rank)``: the ``k`` best of ``bm25_scores`` rounded to ``digits``, ties to the smaller id; with ``group`` the ``k`` best of
    each value of that column of ``docs``, in a column of its name. An ``index`` of the documents spares building one. A query id that comes again has the words of all its rows."""
    spark = queries.sparkSession
    index = index or block_index(docs, k1=k1, b=b, floor=floor, unicode=unicode, group=group)
    work = Scratch(spark, "bm25")
    asked = queries.select("query_id", F.explode(_words("text", index.unicode)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf")).join(index.terms, "term")
    asked = asked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", (F.col("qf") * F.col("idf")).alias("w")))).alias("terms"))
    asked = work.write(asked, "queries")
    blocks, parts = max(1, -(-asked.count() // QUERIES)), 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")).agg(F.array_sort(F.collect_list(F.struct("query_id", "terms"))).alias("asked"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # blocks that follow one another stay together, so that a task's k-th scores soon are high
    rows = index.blocks.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(parts))).join(asked, "part")
    fields = [*(T.StructField("group", index.blocks.schema["group"].dataType) for _ in [1] * bool(index.group)), queries.schema["query_id"], T.StructField("item_id", index.blocks.schema["ids"].dataType.elementType), T.StructField("score", T.DoubleType())]
    types = {f.name: to_arrow_type(f.dataType) for f in fields}
    weigh = lambda tf, dl, a=index.avgdl, k1=index.k1, b=index.b: weights(tf, dl, a, k1, b)
    found = rows.select("block", "asked", *["group"] * bool(index.group), *NAMES).mapInArrow(_score(k, digits, weigh, types, bool(index.group)), T.StructType(fields))
    by = ["query_id", *["group"] * bool(index.group)]
    found = found.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "item_id"))).filter(F.col("rank") <= k)
    return found.withColumnRenamed("group", index.group) if index.group else found
