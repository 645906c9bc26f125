"""Lexical retrieval packing: each window is a seed document and its nearest unused neighbours by BM25.

Terms are token ids, so the corpus-wide document frequencies are one bounded vector (the vocabulary), counted
over all documents. A MinHash of its token pairs deals each document, so that like texts share a shard of about
``SHARD_TOKENS`` tokens; a signature that alone would fill a shard (a large group of copies) is dealt over as many
as it needs by a hash of id and tokens. Shards depend on the rows alone, not on how they are partitioned. A task
takes several shards, one after the other, each with its inverted index. There whole windows of long documents
are cut first; then the first unused rest seeds a window, the index ranks the unused others by BM25 of the
seed's terms, and they fill the window greedily; the one that doesn't fit is cut, and what is left of it seeds
the next window. The last window of a shard is cut into powers of two, so nothing is padded.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kgweave.llm.tokens import WORD_BPE, WordEncoder, slices
from kgweave.plans.scratch import Scratch

WINDOW, EOS, SHARD_TOKENS = 4096, 2, 1 << 20
ROW_COST, TASK_SHARDS = 32, 16  # what a row counts for beside its tokens; shards of a task at most
K1, B = 1.5, 0.75
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _encode(tokenizer: str, eos: int):
    """Texts -> (doc_id, n, sig, ids) and, one row per slice, the slice's document frequencies (doc_id null, n -1)."""

    def run(batches):
        enc = WordEncoder.of(tokenizer)
        rng = np.random.default_rng(0)
        key = rng.integers(1, 1 << 62, enc.size, dtype=np.uint64)
        for b in slices(batches, "_text"):
            ids, n = enc.encode(b.column("_text"))
            end = np.cumsum(n + 1)
            all_ids = np.full(end[-1], eos, enc.dtype)
            all_ids[np.delete(np.arange(end[-1]), end - 1)] = ids
            start = end - n - 1
            keys = key[all_ids]
            after = np.r_[keys[1:], np.uint64(0)]
            after[end - 1] = 0  # a text's last token has no other after it
            pairs = keys * np.uint64(3) + after
            pairs = (pairs ^ (pairs >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            sig = (np.minimum.reduceat(pairs, start) >> np.uint64(1)).astype(np.int64)
            seen, df = np.zeros((64, enc.size), bool), np.zeros(enc.size, np.int64)
            for i in range(0, len(n), 64):
                z = min(i + 64, len(n))
                seen[:] = False
                seen[np.repeat(np.arange(z - i), n[i:z] + 1), all_ids[start[i] : end[z - 1]]] = True
                df += np.add.reduce(seen.view(np.uint8), 0, np.uint8)  # 64 at most
            raw = all_ids.astype("<u2" if enc.dtype == np.uint16 else "<u4")
            blobs = [raw[s:e].tobytes() for s, e in zip(start, end)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n + 1, pa.int64()), pa.array(sig), pa.array(blobs, pa.binary())], ["doc_id", "n", "sig", "ids"])
            has = np.flatnonzero(df)
            packed = np.stack([has, df[has]]).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.nulls(1, pa.int64()), pa.array([packed], pa.binary())], ["doc_id", "n", "sig", "ids"])

    return run


def _frequencies(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for x in b.column("ids").to_pylist():
            i, n = np.frombuffer(x, "<i8").reshape(2, -1)
            size = int(i.max()) + 1 if len(i) else 0
            t = total.get(0, np.zeros(0, np.int64))
            if len(t) < size:
                t = np.r_[t, np.zeros(size - len(t), np.int64)]
            t[i] += n
            total[0] = t
    if total:
        i = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total[0][i])], ["id", "df"])


class ShardIndex:
    """BM25 postings of one shard's documents, with the corpus's frequencies."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.docs, self.n = docs, len(docs)
        size = np.array([len(d) for d in docs])
        flat = np.concatenate(docs).astype(np.int64)
        key = flat * self.n + np.repeat(np.arange(self.n), size)
        key = np.sort(key.astype(np.uint32) if len(key) and key.max() < 1 << 32 else key)
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        tf, key = np.diff(np.r_[new, len(key)]), key[new].astype(np.int64)
        term, self.doc = key // self.n, key % self.n
        use = idf[term] > 0  # terms in over half of all documents tell nothing
        term, self.doc, tf = term[use], self.doc[use], tf[use]
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.doc] / mean))
        self.term, self.first = np.unique(term, return_index=True)
        self.first = np.r_[self.first, len(term)]
        order = np.argsort(self.doc, kind="stable")
        self.terms_of, self.edge = np.searchsorted(self.term, term[order]), np.searchsorted(self.doc[order], np.arange(self.n + 1))

    def scores(self, i: int) -> np.ndarray:
        t = self.terms_of[self.edge[i] : self.edge[i + 1]]
        size = self.first[t + 1] - self.first[t]
        end = np.cumsum(size)
        at = np.repeat(self.first[t] - (end - size), size) + np.arange(end[-1] if len(end) else 0)
        return np.bincount(self.doc[at], self.weight[at], self.n)


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length); full windows, then one for each power of two of the rest."""
    out, at = [], np.zeros(len(docs), np.int64)
    size = np.array([len(d) for d in docs], np.int64)
    for i in np.flatnonzero(size >= window):
        while size[i] - at[i] >= window:
            out.append([(i, int(at[i]), window)])
            at[i] += window
    left = size - at
    index = ShardIndex(docs, idf, mean)
    seed, tail = 0, []
    carried = -1
    while True:
        if carried < 0:
            while seed < len(docs) and left[seed] == 0:
                seed += 1
            if seed == len(docs):
                break
        i = carried if carried >= 0 else seed
        carried = -1
        row, room = [(i, int(at[i]), int(left[i]))], window - int(left[i])
        at[i] += left[i]
        left[i] = 0
        if room:
            score = index.scores(i)
            ranked = np.flatnonzero(left)
            ranked = ranked[np.argsort(-score[ranked], kind="stable")]
            take = ranked[: int(np.searchsorted(np.cumsum(left[ranked]), room, "left")) + 1]
            for j in take:
                k = min(room, int(left[j]))
                row.append((int(j), int(at[j]), k))
                at[j] += k
                left[j] -= k
                room -= k
                if left[j]:
                    carried = int(j)
        if room == 0:
            out.append(row)
        else:
            tail = row
    rest = sum(x[2] for x in tail)
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            need, row = 1 << bit, []
            while need:
                j, s, k = tail[0]
                use = min(need, k)
                row.append((j, s, use))
                tail = [(j, s + use, k - use), *tail[1:]] if use < k else tail[1:]
                need -= use
            out.append(row)
    return out


def _shard(rows: list[tuple], number: int, idf: np.ndarray, mean: float, window: int, wide: bool) -> list[tuple]:
    rows.sort(key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2]))
    docs = [np.frombuffer(r[2], "<u4" if wide else "<u2") for r in rows]
    out = []
    for s, row in enumerate(pack_shard(docs, idf, mean, window)):
        offset = 0
        for j, start, k in row:
            crc = zlib.crc32(docs[j][start : start + k].astype("<u4").tobytes())
            out.append((rows[j][1], start, k, crc, len(docs[j]), number << 32 | s, offset))
            offset += k
    return out


def _pack(idf: np.ndarray, mean: float, window: int, wide: bool):
    """Documents sorted by shard -> the pieces of each shard."""

    def pieces(shard, rows):
        out = _shard(rows, shard, idf, mean, window, wide)
        for i in range(0, len(out), 50_000):
            cols = list(zip(*out[i : i + 50_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [c.split()[0] for c in PIECE.split(", ")])

    def run(batches):
        shard, rows = None, []
        for b in batches:
            for s, *row in zip(*(b.column(c).to_pylist() for c in ("shard", "sig", "doc_id", "ids"))):
                if s != shard and rows:
                    yield from pieces(shard, rows)
                    rows = []
                shard = s
                rows.append(row)
        if rows:
            yield from pieces(shard, rows)

    return run


def deal(coded: DataFrame, shards: int, cost: int, work: Scratch) -> DataFrame:
    """``coded`` with ``shard``: a hash of the signature; a signature that costs more than half a shard is spread over several."""
    weight = F.col("n") + ROW_COST
    # the large signatures are fewer than two a shard; as a written table, Spark knows their size and broadcasts them only below its threshold
    large = coded.groupBy("sig").agg(F.sum(weight).alias("w")).filter(F.col("w") > cost / 2).select("sig", F.ceil(F.col("w") * 2 / cost).alias("m"))
    large = work.write(large.coalesce(8), "large")
    # rows of a large signature are dealt by their hash; equal rows that cost more than half a shard, fewer than two a shard again, by their
    # number among their equals too, counted in slices as one row may be most of them
    rows = coded.withColumn("_own", F.xxhash64("doc_id", "ids")).withColumn("_slice", F.spark_partition_id())
    hot = rows.groupBy("_own").agg(F.sum(weight).alias("w")).filter(F.col("w") > cost / 2).select("_own", F.lit(True).alias("_hot"))
    hot = work.write(hot.coalesce(8), "hot")
    rows = rows.join(large, "sig", "left").join(hot, "_own", "left")
    twins, rest = rows.filter("_hot"), rows.filter("_hot is null")
    per = twins.groupBy("_own", "_slice").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(W.partitionBy("_own").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = work.write(per.select("_own", "_slice", before.alias("_before")), "equals")
    place = F.row_number().over(W.partitionBy("_own", "_slice").orderBy("sig"))
    twins = twins.withColumn("_place", place).join(per, ["_own", "_slice"])
    shard = lambda salt: F.pmod(F.xxhash64("sig", F.coalesce(salt, F.lit(0))), F.lit(shards)).alias("shard")
    cols = ["sig", "doc_id", "ids"]
    return twins.select(shard(F.pmod(F.xxhash64("_own", F.col("_before") + F.col("_place")), "m")), *cols).union(rest.select(shard(F.pmod("_own", "m")), *cols))


def pack_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = WORD_BPE, eos: int = EOS, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """Pieces of all documents, one row each: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its tokens and then ``eos`` (a null text is empty: ``eos`` alone). Every row of ``docs`` is packed
    once, equal rows too; null ids are kept. Each id is in exactly one piece; a sequence's pieces lie side
    by side from offset 0. Sequences hold ``window`` ids, or a power of two below that. Other columns are ignored.
    Runs agree: rows that are equal in id and text are exchangeable, and are dealt by their number among their equals.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "packing")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text"))
    coded = work.write(rows.mapInArrow(_encode(tokenizer, eos), "doc_id long, n long, sig long, ids binary"), "tokens", compression="zstd")
    real = coded.filter("n >= 0")
    n, total = real.agg(F.count("*"), F.sum("n")).first()
    if not n:
        return spark.createDataFrame([], PIECE)
    vocabulary = WordEncoder.of(tokenizer)
    # one row per id of the vocabulary
    df = np.zeros(vocabulary.size)
    for r in coded.filter("n < 0").select("ids").mapInArrow(_frequencies, "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).collect():
        df[r.id] = r.df
    idf = np.log((n - df + 0.5) / (df + 0.5))
    shards = -(-(total + n * ROW_COST) // shard_tokens)
    tasks = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shards // TASK_SHARDS)))
    dealt = deal(real, shards, shard_tokens, work).repartition(tasks, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(_pack(idf, total / n, window, vocabulary.dtype == np.uint32), PIECE)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_packing": op8_packing}
