import random
import zlib
from collections import Counter

from kgweave.llm import spelling

from . import brute
from .conftest import LONG, ordered


def plain_counts(rows):
    total = Counter()
    for doc_id, text in rows:
        runs, word = [], ""
        for c in [*(text or ""), " "]:
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                word += c.lower() if c <= "Z" else c
            elif word:
                runs.append(word)
                word = ""
        for w in runs:
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                total[w] += 1
    return {w: n for w, n in total.items() if n >= 2}


def test_query(spark, odd, nothing, sf):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.choice([6, 7, 8, 12]))) for _ in range(40)]
    texts = [" ".join(rng.choices(base, weights=[400 if i % 7 == 0 else 1 for i in range(40)], k=150)) for _ in range(120)]
    more = spark.createDataFrame([(100 + i, t + " ÀÉ÷Straße Ünïcödë " * 3, "en", "s", 1) for i, t in enumerate(texts)], odd.schema)
    df = odd.union(more)
    want = brute.forms(plain_counts([(r.doc_id, r.text) for r in df.collect()]))
    assert any(f for _, _, f, _, _ in want.values())
    got = spelling.op12_spelling(spark, sf(df))
    assert ordered(got.select("word", "n", "n_near", "form", "form_n", "root").collect()) == ordered((w, *v) for w, v in want.items())
    assert spelling.op12_spelling(spark, sf(nothing)).count() == 0


def test_every_pair_is_found_once(spark):
    """Dense alphabets, where words agree on several keys, and words of every length from 1."""
    rng = random.Random(6)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(700)} | {"x" * 5000, "x" * 4999, "x" * 2500 + "y" + "x" * 2499}
    df = spark.createDataFrame([(w, 1 + len(w)) for w in words], "word string, n long")
    got = [(r.word, r.other) for r in spelling.near_words(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in words for b in words if brute.one_edit(a, b)}


def test_forms_lead_on_and_ties_go_by_code_point(spark):
    counts = {"abcdefg": 1, "abcdefgh": 10, "abcdefghi": 1000, "zzzzzzz": 5, "zzzzzzé": 50, "zzzzzzy": 50}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variant_forms(df).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    assert got == brute.forms(counts)
    assert got["abcdefg"][4] == "abcdefghi" and got["zzzzzzz"][2] == "zzzzzzy"


def test_counts_without_distortion(spark):
    df = spark.createDataFrame([(1, LONG), (2, "Straßen STRASSEN straßen"), (3, None)], "doc_id long, text string")
    got = {r.word: r.n for r in spelling.word_counts(df).collect()}
    assert got == {"straßen": 2, "strassen": 1}
