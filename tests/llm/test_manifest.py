import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgweave.llm import manifest, sha256

from . import brute
from .conftest import ordered

FIELDS = manifest.FIELDS


def leaf(values):
    return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()


def expected(rows):
    """rows: dictionaries of FIELDS."""
    made = []
    for r in rows:
        changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]) if changed else r["text"]
        made.append((r, leaf(r[c] for c in FIELDS), leaf({**r, "text": text}[c] for c in FIELDS)))
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((m for m in made if m[0]["lang"] == g), key=lambda m: (m[0]["doc_id"] is not None, m[0]["doc_id"] or 0, m[1])) for g in langs]
    trees = [brute.merkle([m[1] for m in g]) for g in groups]
    top = brute.merkle([t[-1][0] for t in trees])
    root, out = top[-1][0], []
    for k, (group, tree) in enumerate(zip(groups, trees)):
        for i, (r, own, seen) in enumerate(group):
            low, sub = brute.climb(tree, i, seen)
            high, got = brute.climb(top, k, sub)
            proof = hashlib.sha256("".join(low + high).encode()).hexdigest()
            out.append((r["doc_id"], own, tree[-1][0], root, proof, got, got == root))
    return out


def test_states_resume():
    rng = np.random.default_rng(3)
    d = rng.integers(0, 256, (5, 8, 32), dtype=np.uint8)
    state, kept = sha256.start(5), []
    for k in range(8):
        kept.append(sha256.from_bytes(sha256.to_bytes(state)))
        state = sha256.absorb(state, sha256.hex_block(d[:, k]))
    whole = sha256.hex_strings(sha256.finish(state, np.full(5, 8)))
    assert whole == [hashlib.sha256(b"".join(y.tobytes().hex().encode() for y in x)).hexdigest() for x in d]
    again = kept[5]
    for k in range(5, 8):
        again = sha256.absorb(again, sha256.hex_block(d[:, k]))
    assert sha256.hex_strings(sha256.finish(again, np.full(5, 8))) == whole


def test_query(spark, odd, nothing, sf):
    rows = [r.asDict() for r in odd.collect()]
    assert ordered(manifest.op13_manifest(spark, sf(odd)).collect()) == ordered(expected(rows))
    assert manifest.op13_manifest(spark, sf(nothing)).count() == 0


@pytest.mark.parametrize("sizes", [[1], [8], [9], [1, 1], [73, 1, 8, 64, 65, 4097]])
def test_sizes(spark, sf, sizes):
    """Lone leaves, whole runs, runs of one, more than one stratum; a group that holds most rows."""
    rng = random.Random(1)
    rows = [(g * 10_000 + i, f"Text {rng.random()}", None if g == 1 else f"l{g}", "s", i) for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = manifest.op13_manifest(spark, sf(df.repartition(5))).collect()
    assert ordered(got) == ordered(expected([r.asDict() for r in df.collect()]))


def test_more_groups_than_a_block(spark, monkeypatch):
    """Many groups make a high tree above the groups' roots, and many strata in small blocks."""
    for name, v in (("HEIGHT", 1), ("SPAN", 8), ("HELD", 16)):
        monkeypatch.setattr(manifest, name, v)
    rows = [(i, f"T{i}", f"g{i % 83:03}" if i < 300 else "g000", "s", i) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    made = manifest.build_manifest(df, "lang", "doc_id", manifest.leaf_digest(FIELDS), ["doc_id"])
    trees = {}
    for r in sorted(made.leaves.collect(), key=lambda r: (r.g, r.i)):
        trees.setdefault(r.g, []).append(r.leaf)
    assert made.root == brute.merkle([brute.merkle(trees[g])[-1][0] for g in sorted(trees)])[-1][0]


def test_subset_is_folded_and_siblings_given(spark):
    rows = [(i, f"T{i}", "en", "s", i) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    made = manifest.build_manifest(df, "lang", "doc_id", manifest.leaf_digest(FIELDS), ["doc_id"])
    bad = "0" * 64
    seen = made.leaves.filter("doc_id in (3, 77)").withColumn("seen", F.when(F.col("doc_id") == 3, F.lit(bad)).otherwise(F.col("leaf")))
    got = {r.doc_id: r for r in made.fold(seen, siblings=True).collect()}
    assert set(got) == {3, 77} and got[77].verified and not got[3].verified
    tree = brute.merkle([r.leaf for r in made.leaves.orderBy("i").collect()])
    beside, root = brute.climb(tree, 3, bad)
    assert got[3].siblings == "".join(beside) and got[3].folded_root == root


def test_equal_rows_and_clashing_names(spark, sf):
    rows = [(1, "a", "en", "s", 1)] * 300 + [(None, None, None, None, None)] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("g", F.lit(1)).withColumn("leaf", F.lit("x"))
    got = manifest.op13_manifest(spark, sf(df)).collect()
    assert ordered(got) == ordered(expected([{c: r[c] for c in FIELDS} for r in df.collect()]))
    with pytest.raises(ValueError):
        manifest.build_manifest(df, "lang", "doc_id", F.col("leaf"), ["doc_id", "leaf"])
