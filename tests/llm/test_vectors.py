import numpy as np
import pytest

from kgweave.llm.neighbours import nearest, op3_neighbours
from kgweave.llm.topk import best_of_blocks, exact_top_k, op5_top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(n=1500, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = (centres[rng.integers(0, 12, n)] + 0.6 * rng.normal(size=(n, dim))).astype(np.float32)
    x[40:60] = x[40:41]
    return x


def frame(spark, x, extra=()):
    return spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)] + list(extra), SCHEMA)


ODD = [(9000, None, 1), (9001, [0.0] * 24, 1), (9002, [float("nan")] * 24, 1), (9003, [None] * 24, 1), (9100, [float("inf")] * 24, 1), (9200, [1.0, 2.0], 1), (9300, [], 1)]


def test_recall_and_scores(spark, sf):
    x = table()
    out = op3_neighbours(spark, sf(frame(spark, x, ODD), "embeddings")).collect()
    got = {}
    for r in out:
        got.setdefault(r.query_id, []).append(r)
    assert set(got) - {9200, 9300} == set(range(0, 1500, 100))
    hit = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        mine = sorted(got[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11))
        assert all(abs(r.score - d[r.vec_id]) < 1e-12 for r in mine)
        hit += len(set(best) & {r.vec_id for r in mine})
    assert hit / 150 >= 0.9


def test_few_and_no_vectors(spark, sf):
    x = table(5)
    out = op3_neighbours(spark, sf(frame(spark, x), "embeddings")).collect()
    assert sorted(r.vec_id for r in out) == [1, 2, 3, 4]
    assert op3_neighbours(spark, sf(spark.createDataFrame([], SCHEMA), "embeddings")).count() == 0


def brute_top(x, every=20, k=20):
    w = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    out = []
    for q in range(0, len(x), every):
        s = w @ w[q]
        order = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:k]
        out += [(q, r + 1, int(i), int(s[i])) for r, i in enumerate(order)]
    return sorted(out)


def test_top_k_is_exact(spark, sf):
    x = table(900)
    out = op5_top_k(spark, sf(frame(spark, x, ODD), "embeddings")).collect()
    assert sorted(tuple(r) for r in out if r.query_id < 9000) == brute_top(x)
    assert op5_top_k(spark, sf(spark.createDataFrame([], SCHEMA), "embeddings")).count() == 0


@pytest.mark.parametrize("block", [1, 7, 64])
def test_small_blocks(spark, block):
    rng = np.random.default_rng(block)
    w = rng.integers(-3, 4, (120, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(w)], "id long, w array<bigint>")
    got = exact_top_k(df, df.filter("id % 10 = 0").selectExpr("id AS query_id", "w"), k=5, block=block).collect()
    want = []
    for q in range(0, 120, 10):
        s = w @ w[q]
        want += [(q, r + 1, int(i), int(s[i])) for r, i in enumerate([i for i in np.lexsort((np.arange(120), -s)) if i != q][:5])]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_blocks_are_skipped():
    """Where blocks differ, most are never scored; scores and ties stay exact."""
    rng = np.random.default_rng(8)
    centres = rng.integers(-60, 61, (40, 16))
    blocks = [(np.arange(i * 50, i * 50 + 50), c + rng.integers(-2, 3, (50, 16))) for i, c in enumerate(centres)]
    w = np.concatenate([x for _, x in blocks])
    qid = np.arange(0, 2000, 50)
    r, c, v, scored = best_of_blocks(qid, w[qid], np.full(40, -(1 << 63)), blocks, 10)
    assert scored < 0.2 * 40 * 40
    for i, q in enumerate(qid):
        s = w @ w[q]
        want = [j for j in np.lexsort((np.arange(2000), -s)) if j != q][:10]
        assert c[r == i].tolist() == want and v[r == i].tolist() == s[want].tolist()


def test_repeated_ids_and_large_weights(spark):
    rows = [(1, [1 << 40, 3]), (2, [5, 1 << 41]), (2, [5, 1 << 41]), (3, [-(1 << 40), 7]), (None, [1, 1]), (4, None)]
    df = spark.createDataFrame(rows, "id long, w array<bigint>")
    asked = spark.createDataFrame([(1, [1, 1]), (1, [0, 5]), (None, [1, 1])], "query_id long, w array<bigint>")
    got = [tuple(r) for r in exact_top_k(df, asked, k=9).orderBy("rank").collect()]
    assert got == [(1, 1, 2, 5 << 41), (1, 2, 2, 5 << 41), (1, 3, 3, 35)]


def test_repeated_rows_are_one_neighbour(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, q array<double>")
    assert [tuple(r) for r in nearest(df, asked, 5).orderBy("rank").collect()] == [(1, 1, 3, 0.0), (1, 2, 2, 1.0)]


@pytest.mark.parametrize("times", [6, 400])
def test_a_repeated_query_changes_nothing(spark, sf, times):
    x = table(1000, 16)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    plain = op3_neighbours(spark, sf(spark.createDataFrame(rows, SCHEMA), "embeddings")).collect()
    again = op3_neighbours(spark, sf(spark.createDataFrame(rows + [rows[200]] * (times - 1), SCHEMA), "embeddings")).collect()
    assert sorted(plain) == sorted(again) and len(plain) == 100


def test_queries_outside_the_index(spark):
    x, asked = table(1500), table(1600, seed=1)[1500:]
    df = frame(spark, x)
    queries = spark.createDataFrame([(10_000 + i, v.astype(float).tolist()) for i, v in enumerate(asked)], "query_id long, q array<double>")
    got = {}
    for r in nearest(df, queries).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for i, v in enumerate(asked):
        d = ((x.astype(float) - v.astype(float)) ** 2).sum(1)
        hit += len(got[10_000 + i] & set(np.lexsort((np.arange(len(d)), d))[:10].tolist()))
    assert hit >= 0.9 * 10 * len(asked)
