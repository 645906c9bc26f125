import random

import corpus_pipeline as p

from . import brute
from .conftest import PASSAGE, ordered


def table(spark):
    rng = random.Random(7)
    words = {"en": ["the", "which", "house", "through"], "fr": ["le", "où", "maison", "déjà"]}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) + str(rng.randrange(10**6)) + "q" for _ in range(n))
    rows = [(i, text(lang, 120), lang, f"s{i % 3}", 1) for i in range(60) for lang in ["en" if i % 2 else "fr"]]
    rows += [(100, rows[3][1], "fr", "s0", 1), (101, rows[4][1] + " end", "fr", "s1", 1), (102, "12 34", "en", "s0", 1), (103, None, "en", "s0", 1), (104, "", None, None, 1)]
    rows += [(105, text("en", 60) + " " + PASSAGE, "en", "s1", 1), (106, text("en", 60) + " " + PASSAGE + " " + text("en", 60), "en", "s2", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, sf):
    docs = table(spark)
    d = sf(docs)
    spoken = p.language(spark, docs, d)
    assert spoken.columns == p.COLUMNS
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in spoken.collect()} == {102, 103, 104}
    single = p.near_duplicate(spark, spoken, d)
    rows = [(r.doc_id, r.text) for r in spoken.select("doc_id", "text").collect()]
    assert {r.doc_id for r in single.collect()} == {c for _, _, c in brute.simhash(rows)}
    assert not {100, 101} & {r.doc_id for r in single.collect()}
    cut = p.substring(spark, single, d)
    left = {r.doc_id: r.text for r in cut.collect()}
    want = {x[0]: x[2] for x in brute.substrings([(r.doc_id, r.text) for r in single.collect()])}
    assert set(left) == set(want) and PASSAGE in left[105] and PASSAGE not in left[106] and len(left[106].split()) == 120
    assert all(left[r.doc_id] == r.text for r in single.collect() if not want[r.doc_id])
    mixed = p.mix(spark, cut, d)
    assert mixed.columns == p.COLUMNS and {r.doc_id for r in mixed.collect()} <= set(left)
    packed = p.pack(spark, mixed, d).collect()
    assert sum(r.offset == 0 for r in packed) == len({r.sequence_id for r in packed})
    assert sorted(r.doc_id for r in packed if r.start == 0) == sorted(r.doc_id for r in mixed.collect())


def test_run(spark, sf, nothing):
    d = sf(table(spark))
    assert ordered(p.run(spark, d).collect()) == ordered(p.run(spark, d).collect())
    assert [f for _, f in p.STAGES] == [p.language, p.near_duplicate, p.substring, p.mix, p.pack]
    assert p.run(spark, sf(nothing)).count() == 0


def test_near_duplicates_with_missing_and_shared_ids(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in ("ant", "bee", "cow"))
    rows = [(None, one, "en", "s0", 1), (None, two, "en", "s0", 1), (None, two, "en", "s0", 1), (7, one, "en", "s1", 1), (8, three, "en", "s1", 1), (8, " ".join(f"dog{i}" for i in range(40)), "fr", None, None), (8, two, "en", "s2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = p.near_duplicate(spark, docs, "")
    assert got.columns == p.COLUMNS
    assert ordered((r.doc_id, r.text) for r in got.collect()) == ordered((i, t) for i, t, *_ in (rows[3], rows[4], rows[5], rows[6]))
    # without the row that gives one of them an id, both texts without ids stay, each once
    got = p.near_duplicate(spark, docs.filter("doc_id is null"), "")
    assert ordered((r.doc_id, r.text) for r in got.collect()) == ordered([(None, one), (None, two)])


def test_near_duplicates_against_brute_force(spark):
    """Copies with 0 to 12 words changed, of texts of 60 to 400 words: similarities from 0.4 to 1, and chains of copies."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for _ in range(40):
        cur = [word() for _ in range(rng.randrange(60, 400))]
        texts.append(" ".join(cur))
        for _ in range(5):
            new = list(cur)
            for _ in range(rng.randrange(12)):
                new[rng.randrange(len(new))] = word()
            texts.append(" ".join(new))
            cur = new if rng.random() < 0.4 else cur
    texts += ["one two three", "One  two three", "one two four"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in p.near_duplicate(spark, docs, "").collect()}
    assert got == set(brute.jaccard_groups(texts)) and 45 < len(got) < 200
