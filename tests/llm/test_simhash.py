import itertools
import random

import numpy as np

from kgweave.llm.simhash import masks, near_duplicates, near_links, op2_simhash

from . import brute
from .conftest import ordered


def test_masks_cover_every_triple():
    kept = [np.uint64(m & (1 << 64) - 1) for m in masks()]
    assert len(kept) == 15
    for a, b, c in itertools.combinations(range(64), 3):
        bits = np.uint64(1 << a | 1 << b | 1 << c)
        assert any(m & bits == 0 for m in kept)


def test_query(spark, odd, nothing, sf):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert ordered(op2_simhash(spark, sf(odd)).collect()) == ordered(brute.simhash(rows))
    assert op2_simhash(spark, sf(nothing)).count() == 0


def test_large_buckets_lose_no_link(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = {centre} | {centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 5]))) for _ in range(400)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), len(fps), chunk=16).collect()
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        assert ((r.src ^ r.dst) & (1 << 64) - 1).bit_count() <= 64
        root[find(r.src)] = find(r.dst)
    want = {f: f for f in signed}

    def up(x):
        while want[x] != x:
            x = want[x]
        return x

    for a, b in itertools.combinations(signed, 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
            want[up(a)] = up(b)
    group = lambda f: sorted(sorted(map(str, (y for y in signed if f(y) == f(x)))) for x in signed)
    assert group(find) == group(up)


def test_near_copies_share_a_class(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(800)]
    near = list(words)
    near[400] = "changed"
    other = [f"v{rng.randrange(5000)}" for _ in range(800)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(other)), (4, " ".join(words).upper())], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}
