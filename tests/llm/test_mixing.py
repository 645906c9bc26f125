import random

from kgweave.llm.mixing import mix_sources, op1_mix, source_targets, take_mix, word_count

from .conftest import ordered


def targets(sizes):
    """Sizes by source -> targets, by filling up step by step."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        if not rest:
            return full
        level = (total - sum(full.values())) / sum(w[s] for s in rest)
        over = [s for s in rest if level * w[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return full | {s: level * w[s] for s in rest}
        full |= {s: 3.0 * sizes[s] for s in over}


def test_targets(spark):
    rng = random.Random(3)
    for _ in range(6):
        sizes = {s: rng.choice([0, 1, 5, 100, 1000]) for s in ["a", "b", "c", "d", None]}
        got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes), (sizes, got, want)


def test_mix_comes_near_and_repeats(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("aaaabcd"), rng.choice([0, 1, 3, 10, 50, 400])) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    first, again = mix_sources(df).collect(), mix_sources(df.repartition(7)).collect()
    assert ordered(first) == ordered(again) and len(first) == len(rows)
    for s in "abcd":
        part = [r for r in first if r.source == s]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 400
        assert all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in part)


def test_expected_copies_are_kept(spark):
    rows = [(i, "ab"[i % 2], 10 + i % 5) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    n = {}
    for seed in range(30):
        for r in mix_sources(df, seed=seed).collect():
            n[r.doc_id] = n.get(r.doc_id, 0) + r.copies
            wish = r.target / r.source_size if r.source == "a" else None
            if r.doc_id == 0:
                want = wish
    assert abs(sum(n[i] for i in range(0, 40, 2)) / (30 * 20) - want) < 0.02
    assert all(n[i] > 0 for i in range(0, 40, 2))


def test_odd_rows(spark, odd, nothing, sf):
    out = op1_mix(spark, sf(odd)).collect()
    assert len(out) == odd.count()
    assert [r.size for r in out if r.doc_id == 2] == [0]
    docs = odd.withColumn("clash", word_count("text"))
    size = word_count("text")
    mix = mix_sources(docs.select("doc_id", "source", size.alias("size"), "clash"))
    taken = take_mix(odd, mix, size)
    assert taken.columns == odd.columns
    assert taken.count() == sum(r.copies for r in mix.collect())
    assert op1_mix(spark, sf(nothing)).count() == 0
