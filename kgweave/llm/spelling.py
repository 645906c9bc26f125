"""Spelling variants: words one edit apart, joined on asymmetric q-chunks.

Of two words one edit apart the shorter (of equal ones either) contributes its two disjoint chunks, its halves, and
the other one its positional grams. A single edit touches one half at most, so the other half stands in the longer
word: the first half at the same place, the second half moved by the difference in length. These are the only places
within a shift of one at which a gram can meet a chunk of an edit-distance-one partner, so only these grams are made.

A half alone is shared by thousands of words of any large vocabulary. The touched half is therefore split again,
and one of its two parts stands as well: a word of length L has the borders 0, L/4, L/2, 3L/4, L, and the key
``i`` is all of the word but part ``i``. Keys are joined as 64-bit hashes, so long words cost no more; the distance is
then verified on the words themselves, and a pair whose words agree on several keys counts for the first.
A join on keys is an ordinary one, so a hot key is split at run time. Nothing is capped.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.llm.caches import trim
from kgweave.llm.tokens import slices
from kgweave.plans.scratch import Scratch

MIN_CHARS, MIN_COUNT, RATIO = 7, 2, 10
#: Distinct words a task holds before it hands on its counts.
HELD = 400_000
PARTS = 4


def distorted(run: str, key: bytes, every: int) -> str:
    """The run, of one in ``every`` less one code point, as chosen by the crc32 of key, colon and run."""
    h = zlib.crc32(run.encode(), zlib.crc32(key + b":"))
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, every: int | None = None) -> DataFrame:
    """``(word, n)``: how often each word of ``min_chars`` or more code points occurs in all texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with only A-Z lower-cased. ``every`` deletes a code point of one run
    in so many, by a hash of id and run (a null id is hashed as an empty one). A null text has no words. Tasks hand on partial counts.
    """
    runs = re.compile(rf"[a-zÀ-ÿ]{{{min_chars},}}")

    def batch(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    def run(batches):
        total = Counter()
        for b in slices(batches, "_text"):
            for t, key in zip(b.column("_text").to_pylist(), b.column("_key").to_pylist()):
                found = runs.findall(t.lower().decode("utf-8", "replace")) if t else ()
                if every is None:
                    total.update(found)
                    continue
                for w, n in Counter(found).items():
                    w = distorted(w, key, every)
                    if len(w) >= min_chars:
                        total[w] += n
            if len(total) >= HELD:
                yield batch(total)
                total.clear()
        yield batch(total)
        trim()

    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary").alias("_key"), F.col(text).cast("string").cast("binary").alias("_text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _border(length: Column, i: int) -> Column:
    return F.floor(length * i / PARTS).cast("int")


def _kept(word: Column, own: Column, length: Column, i: int) -> Column:
    """All of ``word`` but part ``i``, as a word of ``length`` code points would leave it; ``own`` is the word's own length."""
    tail = length - _border(length, i + 1)
    return F.concat(F.substring(word, F.lit(1), _border(length, i)), F.lit("\u0000"), F.substring(word, own - tail + 1, tail))


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n, other, m)``: each pair of distinct words one inserted, deleted or replaced code point apart, in both
    directions, with their counts. ``words(word, n)`` has one row per word; null and empty words take no part."""
    words = words.filter(F.length("word") > 0).select("word", "n", F.length("word").alias("len"))
    part = lambda own, length: F.array(*[F.struct(F.lit(i).alias("i"), F.xxhash64(F.lit(i), length, _kept(F.col("word"), own, length, i)).alias("key")) for i in range(PARTS)])
    own = F.col("len")
    chunks = words.select(F.col("word").alias("s"), F.col("n").alias("sn"), F.explode(part(own, own)).alias("e")).select("s", "sn", "e.i", "e.key")
    # a gram can belong to a chunk of a word as long as this one, or one shorter
    grams = words.select(F.col("word").alias("t"), F.col("n").alias("tn"), F.explode(F.concat(part(own, own), F.when(own > 1, part(own, own - 1)).otherwise(F.array()))).alias("e"))
    grams = grams.select("t", "tn", "e.i", "e.key")
    s, t = F.col("s"), F.col("t")
    a, b = F.length("s"), F.length("t")
    earlier = [F.when((F.col("i") > j), _kept(s, a, a, j) == _kept(t, b, a, j)).otherwise(False) for j in range(PARTS - 1)]
    first = ~(earlier[0] | earlier[1] | earlier[2])
    same_size = a == b
    pairs = chunks.join(grams, ["i", "key"]).filter((s != t) & (~same_size | (s < t)) & (b - a).between(0, 1) & (F.levenshtein(s, t, 1) == 1) & first)
    both = F.array(F.struct(s.alias("word"), F.col("sn").alias("n"), t.alias("other"), F.col("tn").alias("m")), F.struct(t.alias("word"), F.col("tn").alias("n"), s.alias("other"), F.col("sn").alias("m")))
    return pairs.select(F.explode(both).alias("e")).select("e.*")


def variant_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for each row of ``words(word, n)``: the number of near words, the near
    word with the largest count (the smallest in code-point order of equal ones) if that is ``ratio`` times the word's own or more,
    and the last word that forms lead to (the word itself without one). Counts grow along forms, so they end."""
    work = Scratch(words.sparkSession, "spelling")
    words = work.write(words, "words")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("down"), "other")).alias("b"))
    near = near.select("word", "n_near", F.col("b.other").alias("other"), (-F.col("b.down")).alias("m"))
    out, much = words.join(near, "word", "left"), F.col("m") >= ratio * F.col("n")
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(much, F.col("other")).alias("form"), F.when(much, F.col("m")).alias("form_n"))
    out = work.write(out, "near")
    step, k = out.filter("form is not null").select("word", F.col("form").alias("root")), 0
    while True:  # each round doubles the distance that roots have been followed
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = work.write(step.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"root{k}")
        step, k = moved.select("word", "root"), k + 1
        if moved.filter("moved").isEmpty():
            break
    return out.join(step, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), every=31)
    out = variant_forms(counts.filter(F.col("n") >= MIN_COUNT))
    return out.select("word", "n", "n_near", "form", "form_n", "root")


#: Runs, their hashes and the words by lists; near words by what is left after one deletion at the same place (a replacement)
#: or at any place (the shorter word itself).
SQL = """
WITH RECURSIVE runs AS (
    SELECT DISTINCT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) GROUP BY ALL),
keyed AS (
    SELECT w, c, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(k)), lambda i: ('0x' || substr(hex(encode(k)), (2 * i + 1)::BIGINT, 2))::BIGINT)),
        lambda s, b: list_reduce(list_prepend(xor(s, b), range(0, 8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)) AS s
    FROM (SELECT w, c, coalesce(doc_id::VARCHAR, '') || ':' || w AS k FROM runs WHERE length(w) >= 7)),
hashed AS (SELECT w, c, xor(s, 4294967295::BIGINT) AS h FROM keyed),
bent AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, (h % length(w))::BIGINT) || substr(w, (h % length(w) + 2)::BIGINT) ELSE w END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM bent WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
less AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
pairs AS (
    SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
ranked AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS r FROM pairs),
near AS (
    SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.m >= 10 * w.n THEN r.other END AS form, CASE WHEN r.m >= 10 * w.n THEN r.m END AS form_n
    FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.r = 1),
follow AS (
    SELECT word, word AS root FROM near
    UNION SELECT f.word, n.form FROM follow f JOIN near n ON n.word = f.root AND n.form IS NOT NULL)
SELECT n.word, n.n, n.n_near, n.form, n.form_n, f.root
FROM near n JOIN follow f ON n.word = f.word JOIN near e ON e.word = f.root WHERE e.form IS NULL
"""
QUERIES = {"op12_spelling": op12_spelling}
ORACLES = {"op12_spelling": SQL}
