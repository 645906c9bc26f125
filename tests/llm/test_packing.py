import math
import random
from collections import Counter

import numpy as np
import pytest

from kgweave.llm import packing as p

from .conftest import ordered
from .test_tokens import check_packing, whole  # noqa: F401


def brute_pack(docs, df, n, mean, window):
    """Full windows, then seeds with their BM25 neighbours, by plain loops; the rest as one list of pieces."""
    idf = lambda t: math.log((n - df[t] + 0.5) / (df[t] + 0.5))
    at, out = [0] * len(docs), []
    for i, d in enumerate(docs):
        while len(d) - at[i] >= window:
            out.append([(i, at[i], window)])
            at[i] += window
    seed = carried = None
    while any(len(d) > a for d, a in zip(docs, at)):
        seed = carried if carried is not None else min(i for i, d in enumerate(docs) if len(d) > at[i])
        carried, row, room = None, [(seed, at[seed], len(docs[seed]) - at[seed])], window - len(docs[seed]) + at[seed]
        at[seed] = len(docs[seed])
        terms = set(docs[seed].tolist())
        score = {}
        for j, d in enumerate(docs):
            if len(d) > at[j]:
                words, tf = np.unique(d, return_counts=True)
                score[j] = sum(max(0.0, idf(t)) * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t, c in zip(words.tolist(), tf.tolist()) if t in terms)
        for j in sorted(score, key=lambda j: (-round(score[j], 9), j)):
            if not room:
                break
            k = min(room, len(docs[j]) - at[j])
            row.append((j, at[j], k))
            at[j] += k
            room -= k
            carried = j if len(docs[j]) > at[j] else None
        out.append(row)
    return out


def test_neighbours_against_brute_force():
    rng = np.random.default_rng(4)
    docs = [np.append(rng.choice(np.arange(3, 200) * (1 + i % 3), rng.integers(3, 150)), 2).astype(np.uint16) for i in range(60)]
    df = np.zeros(1000)
    for d in docs:
        df[np.unique(d)] += 1
    n, mean = 200, sum(map(len, docs)) / len(docs)
    idf = np.log((n - df + 0.5) / (df + 0.5))
    got, want = p.pack_shard(docs, idf, mean, 128), brute_pack(docs, df, n, mean, 128)
    assert [r for r in got if sum(x[2] for x in r) == 128][: len(want) - 1] == want[:-1] and len(want) > 20
    rest = [x for r in got[len(want) - 1 :] for x in r]
    assert sum(x[2] for x in rest) == sum(x[2] for x in want[-1])


def test_many_shards_do_not_depend_on_partitions(spark, whole):  # noqa: F811
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["red", "green", "blue", "sky", "sea"]) + str(rng.randrange(40)) for _ in range(rng.randrange(120))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, "one text held by a third of all") for i in range(150)] + [(7, texts[7])] * 3 + [(None, None)] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pack = lambda d: p.pack_documents(d, shard_tokens=4000).collect()
    one = pack(df.repartition(1))
    check_packing(one, rows, whole)
    shards = {r.sequence_id >> 32 for r in one}
    assert len(shards) > 5
    copies = {r.sequence_id >> 32 for r in one if r.doc_id and r.doc_id >= 1000}
    assert len(copies) > 1
    assert ordered(pack(df.repartition(7, "text"))) == ordered(one)


@pytest.mark.parametrize("doc_id", [5, None])
def test_a_row_repeated_very_often_fills_no_shard(spark, whole, doc_id):  # noqa: F811
    rows = [(doc_id, "the same words again")] * 20_000 + [(100 + i, f"text {i}") for i in range(200)]
    out = p.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), shard_tokens=4000).collect()
    check_packing(out, rows, whole)
    sizes = Counter(r.sequence_id >> 32 for r in out)
    assert max(sizes.values()) <= 3 * sorted(sizes.values())[len(sizes) // 2]
