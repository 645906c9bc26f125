import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kgweave.operators import search as se
from kgweave.operators import text_index as ti

DOCS = "item_id long, text string, source string"


def corpus(n=400, seed=4):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    return [(i, " ".join(rng.choices(vocab, weights, k=rng.randint(1, 60))), f"s{i % 3}" if i % 7 else None) for i in range(n)]


def plain(spark, asked, docs, k, group=None):
    every = se.bm25_scores(asked, docs).withColumn("score", F.round("score", 9))
    if group:
        return se.top_k(every.join(docs.select("item_id", group), "item_id"), 10**9)
    return se.top_k(every, k)


@pytest.mark.parametrize("size", [3, 50, 2048])
def test_top_is_exact(spark, monkeypatch, size):
    monkeypatch.setattr(ti, "BLOCK_DOCS", size)
    monkeypatch.setattr(ti, "QUERIES", 4)
    rows = corpus() + [(1000, None, "s1"), (1001, "  ", "s1"), (1002, "w0 " * 5000, None), (1003, "w7 w8", "s0"), (1004, "w7 w8", "s0"), (1005, "w7 w8", "s0")]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    asked = [(i, " ".join(random.Random(i).choices([f"w{j}" for j in range(320)], k=6))) for i in range(20)]
    queries = spark.createDataFrame([*asked, (30, "w7 w8"), (31, None), (32, "unknown"), (33, "w0 w0"), (33, "w9")], "query_id long, text string")
    want = se.top_k(se.bm25_scores(queries, docs).withColumn("score", F.round("score", 9)), 4)
    got = ti.bm25_top(queries, docs, 4)
    assert sorted(map(tuple, got.select("query_id", "item_id", "score", "rank").collect())) == sorted(map(tuple, want.select("query_id", "item_id", "score", "rank").collect()))


def test_best_of_each_group(spark, monkeypatch):
    monkeypatch.setattr(ti, "BLOCK_DOCS", 16)
    docs = spark.createDataFrame(corpus(), DOCS)
    queries = spark.createDataFrame([(i, f"w{i} w{i + 40}") for i in range(12)], "query_id long, text string")
    got = {tuple(r) for r in ti.bm25_top(queries, docs, 3, group="source").select("query_id", "source", "item_id", "score", "rank").collect()}
    every = se.bm25_scores(queries, docs).withColumn("score", F.round("score", 9)).join(docs.select("item_id", "source"), "item_id").collect()
    by = {}
    for r in every:
        by.setdefault((r.query_id, r.source), []).append((-r.score, r.item_id))
    assert got == {(q, s, i, -x, n + 1) for (q, s), rows in by.items() for n, (x, i) in enumerate(sorted(rows)[:3])}


def test_postings_are_skipped(spark):
    """A word that is strong in few blocks, beside one that is everywhere: most postings of the common one aren't read."""
    rng = random.Random(2)
    rows = [(i, "common " * rng.randint(1, 3) + " ".join(f"x{rng.randrange(5000)}" for _ in range(20)) + (" rare" if i < 30 else "")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "item_id long, text string").coalesce(1)
    index = ti.block_index(docs)
    asked = [{"query_id": 1, "terms": [{"term": t, "w": w} for t, w in sorted((r.term, r.idf) for r in index.terms.filter("term in ('common', 'rare')").collect())]}]
    scorer = ti.Scorer(asked, 10, 9, lambda tf, dl: ti.weights(tf, dl, index.avgdl, 1.5, 0.75))
    blocks = sorted(index.blocks.collect(), key=lambda r: r.ids[0])
    for r in blocks:
        scorer.show(r.ids, np.frombuffer(r.dl, np.uint32).astype(float), pa.array(r.terms), np.array(r.counts), np.frombuffer(r.docs, np.uint16), np.frombuffer(r.tfs, np.uint32), np.frombuffer(r.most, float))
    assert len(blocks) > 1 and scorer.read < 0.8 * (3000 + 30)
    assert sorted(i for _, i, _ in scorer.take()) == sorted(r.item_id for r in ti.bm25_top(spark.createDataFrame([(1, "rare common")], "query_id long, text string"), docs, 10, index=index).collect())


def test_names_as_ids_and_no_documents(spark):
    docs = spark.createDataFrame([("b", "liver"), ("a", "liver"), ("ä", "liver"), ("Z", "liver heart")], "item_id string, text string")
    queries = spark.createDataFrame([("q", "liver")], "query_id string, text string")
    assert [r.item_id for r in ti.bm25_top(queries, docs, 3).orderBy("rank").collect()] == [r.item_id for r in se.top_k(se.bm25_scores(queries, docs).withColumn("score", F.round("score", 9)), 3).orderBy("rank").collect()]
    assert ti.bm25_top(queries, docs.limit(0), 3).count() == 0
