import random

import numpy as np

from kgweave.llm import substrings as s

from . import brute
from .conftest import ordered


def query(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return ordered(s.remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def test_against_brute_force(spark):
    rng = random.Random(1)
    vocab, rows = [f"w{i}" for i in range(400)], []
    passages = [[rng.choice(vocab) for _ in range(rng.choice([12, 13, 14, 60]))] for _ in range(8)]
    for d in range(120):
        words = []
        for _ in range(rng.randrange(4)):
            words += [rng.choice(vocab) for _ in range(rng.randrange(30))] + rng.choice(passages)
        rows.append((d, " ".join(words) if rng.random() < 0.9 else "\t".join(words)))
    rows += [(200, "a " * 50), (201, "a " * 30), (202, "a b " * 40), (203, "b a " * 9), (204, "a b " * 40), (205, "a " * 12)]
    assert query(spark, rows) == ordered(brute.substrings(rows))


def test_several_slices_of_a_group(spark):
    """Each document comes in a slice of its own; the first holder of a passage is not always in the first slice of its group."""
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(5000)]
    passages = [" ".join(rng.choice(vocab) for _ in range(20)) for _ in range(4)]
    rows = [(d, " ".join([rng.choice(vocab), rng.choice(passages), *rng.choices(vocab, k=rng.randrange(20))])) for d in range(500)]
    rng.shuffle(rows)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        assert query(spark, rows) == ordered(brute.substrings(rows))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_texts_of_a_group_in_slices_of_one(spark):
    """Blocks of a group are cut again: each document is looked at alone."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    passages = [" ".join(rng.choices(vocab, k=20)) for _ in range(4)]
    rows = [(d, " ".join([*rng.choices(vocab, k=3), rng.choice(passages)])) for d in range(400)] + [(None, passages[0]), (7, None), (8, "")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = s.remove_repeats(df, slice_bytes=1).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert ordered(got) == ordered(brute.substrings(rows))


def test_what_is_shuffled(spark, sf):
    """All bytes dealt over all steps, against the bytes of text."""
    rng = random.Random(6)
    vocab = ["".join(rng.choices("etaoinshr", k=rng.randrange(2, 9))) for _ in range(3000)]
    passages = [" ".join(rng.choices(vocab, k=60)) for _ in range(300)]
    texts = [" ".join([*rng.choices(vocab, k=600), *rng.choices(passages, k=d % 5 == 0)]) for d in range(4000)]
    folder = sf(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2))
    sc = spark.sparkContext._jsc.sc()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def stages():
        sc.listenerBus().waitUntilEmpty()
        all_ = sc.statusStore().stageList(None, False, False, none, None)
        return {all_.apply(i).stageId(): all_.apply(i).shuffleWriteBytes() for i in range(all_.size())}

    before = stages()
    assert s.op9_substrings(spark, folder).filter("n_removed > 0").count() > 500
    assert 0 < sum(n for i, n in stages().items() if i > max(before)) < 1.5 * sum(map(len, texts))


def test_odd_rows(spark, odd, nothing, sf):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert ordered(s.op9_substrings(spark, sf(odd)).collect()) == ordered(brute.substrings(rows))
    assert s.op9_substrings(spark, sf(nothing)).count() == 0


def test_symbols_are_consistent():
    """A symbol's range read alone, inside any text, gives the same symbol with the same range."""
    rng = np.random.default_rng(3)
    h = s.mix(rng.integers(0, 50, 300).astype(np.uint64))
    at, lo, hi = s.symbols(h, np.array([0, 300]))
    assert len(at) > 60
    for a, x, y in zip(at, lo, hi):
        around = np.concatenate([s.mix(rng.integers(0, 50, 7).astype(np.uint64)), h[x:y], s.mix(rng.integers(0, 50, 9).astype(np.uint64))])
        at2, lo2, hi2 = s.symbols(around, np.array([0, len(around)]))
        assert (a - x + 7, 7, y - x + 7) in set(zip(at2.tolist(), lo2.tolist(), hi2.tolist()))


def test_kept_text(spark):
    p = " ".join(f"p{i}" for i in range(13))
    df = spark.createDataFrame([(1, f"a  b\n{p}"), (2, f"c  {p} d"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in s.remove_repeats(df).collect()}
    assert got[1].decode() == f"a  b\n{p}" and got[2] == b"c d" and got[3] is None
