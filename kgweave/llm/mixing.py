"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A document of a source is wanted ``target / source_size`` times. The whole part is given; the fraction is a
probability. Two documents with open probabilities are paired: a random transfer of words between them, fair
on average, makes one of the two whole (0 or 1) and keeps their expected words. So all documents keep their
expected number of copies while the source's words hardly move.

The pairing runs as a reduction tree, for a source of any size: each level deals the open documents of a source into
small seeded buckets, folds every bucket down to at most one open document and passes those on. Levels go on until
a source has at most ``LEAF`` open documents left, residuals of its buckets. One last fold combines them: it goes from
the largest to the smallest and pairs each with the pool of all smaller ones, taken as one document whose parts scale
alike. A transfer between a document and a pool is the same fair move as one between two documents, so the expected
words stay; pairing the largest first leaves unbalanced only about the size of the smallest residual. The number of
levels is logarithmic in the largest source. The arrays folded are bounded by the bucket size and ``LEAF``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kgweave.plans.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
BUCKET, SPREAD, LEAF, SLICE, SEED = 64, 1024, 2048, 10_000, 7
KEYS = "k struct<id:long,source:string,size:long,rows:long,base:int>"
DONE = f"array<struct<{KEYS.replace(' ', ':', 1)},x:int>>"


def word_count(text: str) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: int = 3, cap: float = 3.0) -> DataFrame:
    """``(source, source_size)`` -> with ``target``, one row per source.

    In code point order (null last) the sources weigh 1, 2, .. ``cycle``, again and again, and share the sum of
    all sizes; no target exceeds ``cap`` times its size, the excess going to the others by weight. A source is
    capped where the level at which it would fill is below the level the rest end at; the windows here span
    only the table of sources.
    """
    w = sizes.withColumn("w", ((F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1) % cycle + 1).cast("double"))
    w = w.withColumn("full", F.col("source_size") * F.lit(cap)).withColumn("q", F.col("full") / F.col("w"))
    by_q, everything = W.orderBy("q", F.asc_nulls_last("source")), W.partitionBy()
    w = w.withColumn("i", F.row_number().over(by_q))
    before = by_q.rowsBetween(W.unboundedPreceding, -1)
    w = w.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # the first source, by q, that doesn't fill sets the level of all after it
    w = w.withColumn("final", F.min(F.when(F.col("level") <= F.col("q"), F.struct("i", "level"))).over(everything))
    open_ = F.col("final").isNotNull() & (F.col("i") >= F.col("final.i"))
    return w.select("source", "source_size", F.when(open_, F.col("w") * F.col("final.level")).otherwise(F.col("full")).alias("target"))


PAIR = """
aggregate(items, named_struct('c', cast(null as {item}), 'done', cast(array() as {done})), (st, i) ->
  CASE WHEN st.c IS NULL THEN named_struct('c', i, 'done', st.done) ELSE
  element_at(transform(transform(array(named_struct(
      'a', least((1 - st.c.p) * st.c.s, i.p * i.s), 'b', least(st.c.p * st.c.s, (1 - i.p) * i.s))), w ->
    CASE WHEN i.u * (w.a + w.b) < w.b THEN
      CASE WHEN (1 - st.c.p) * st.c.s <= i.p * i.s THEN named_struct('cp', 1D, 'ip', i.p - w.a / i.s)
           ELSE named_struct('cp', st.c.p + w.a / st.c.s, 'ip', 0D) END
    ELSE
      CASE WHEN st.c.p * st.c.s <= (1 - i.p) * i.s THEN named_struct('cp', 0D, 'ip', i.p + w.b / i.s)
           ELSE named_struct('cp', st.c.p - w.b / st.c.s, 'ip', 1D) END
    END), v -> named_struct(
      'c', CASE WHEN v.cp > {eps} AND v.cp < 1 - {eps} THEN named_struct('u', st.c.u, 'v', st.c.v, 'k', st.c.k, 's', st.c.s, 'p', v.cp)
                WHEN v.ip > {eps} AND v.ip < 1 - {eps} THEN named_struct('u', i.u, 'v', i.v, 'k', i.k, 's', i.s, 'p', v.ip) END,
      'done', concat(st.done,
        CASE WHEN v.cp > {eps} AND v.cp < 1 - {eps} THEN cast(array() as {done}) ELSE array(named_struct('k', st.c.k, 'x', cast(round(v.cp) as int))) END,
        CASE WHEN v.ip > {eps} AND v.ip < 1 - {eps} THEN cast(array() as {done}) ELSE array(named_struct('k', i.k, 'x', cast(round(v.ip) as int))) END))), 1)
  END)
"""

# p of item j in the pool is m + f * (its own p); mass and room are the pool's words taken and not taken
POOL = """
aggregate(items, named_struct('m', 0D, 'f', 1D, 's', aggregate(items, 0D, (t, i) -> t + i.s), 'ps', aggregate(items, 0D, (t, i) -> t + i.p * i.s), 'done', cast(array() as {done})), (st, i) ->
  element_at(transform(transform(transform(array(named_struct(
      'p', least(1D, greatest(0D, st.m + st.f * i.p)), 's', st.s - i.s, 'ps', st.ps - i.p * i.s)), w -> named_struct('p', w.p, 's', w.s, 'ps', w.ps,
      'mass', greatest(0D, least(w.s, st.m * w.s + st.f * w.ps)))), w -> named_struct('p', w.p, 's', w.s, 'ps', w.ps, 'mass', w.mass, 'room', w.s - w.mass,
      'a', least((1 - w.p) * i.s, w.mass), 'b', least(w.p * i.s, w.s - w.mass))), w ->
    CASE WHEN w.a + w.b <= {eps} THEN named_struct('m', st.m, 'f', st.f, 's', w.s, 'ps', w.ps, 'done', concat(st.done, array(named_struct('k', i.k, 'x', CASE WHEN i.u < w.p THEN 1 ELSE 0 END))))
    WHEN i.u * (w.a + w.b) < w.b THEN named_struct(
        'm', CASE WHEN (1 - w.p) * i.s < w.mass THEN st.m * (w.mass - w.a) / w.mass ELSE 0D END,
        'f', CASE WHEN (1 - w.p) * i.s < w.mass THEN st.f * (w.mass - w.a) / w.mass ELSE 0D END,
        's', w.s, 'ps', w.ps, 'done', concat(st.done, array(named_struct('k', i.k, 'x', CASE WHEN (1 - w.p) * i.s <= w.mass OR i.v < w.p + w.a / i.s THEN 1 ELSE 0 END))))
    ELSE named_struct(
        'm', CASE WHEN w.p * i.s < w.room THEN 1 - (w.room - w.b) / w.room * (1 - st.m) ELSE 1D END,
        'f', CASE WHEN w.p * i.s < w.room THEN st.f * (w.room - w.b) / w.room ELSE 0D END,
        's', w.s, 'ps', w.ps, 'done', concat(st.done, array(named_struct('k', i.k, 'x', CASE WHEN w.p * i.s > w.room AND i.v < w.p - w.b / i.s THEN 1 ELSE 0 END))))
    END), 1),
  st -> st.done)
"""
ITEM = "struct<u:double,v:double,k:struct<id:long,source:string,size:long,rows:long,base:int>,s:double,p:double>"
TEXT = {"item": ITEM, "done": DONE, "eps": "1e-9D"}


def _buckets(n):
    """Buckets of the next level for n open documents; also as SQL over a column."""
    return max(math.ceil(n / BUCKET), min(SPREAD, math.ceil(n / 2)))


def _uniform(*parts) -> Column:
    return (F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))).cast("double")


def _items(level: int, seed: int) -> Column:
    key = (F.lit(seed), F.lit(level), "k.id", "k.source", "k.size")
    return F.struct(_uniform(*key).alias("u"), _uniform(*key, F.lit(1)).alias("v"), "k", "s", "p")


def round_copies(wanted: DataFrame, largest: int, seed: int = SEED) -> DataFrame:
    """Round expected copies to whole ones: ``(k, s, p, n)`` -> ``(k, x)``.

    ``k`` names a group of equal rows, ``s`` its words, 0 < ``p`` < 1 its open probability, ``n`` a bound on its
    source's open documents; ``largest`` is the largest ``n``.
    """
    settled, cur, level, bound = [], wanted, 0, largest
    while bound > LEAF or not level:
        level, bound = level + 1, _buckets(bound)
        # every source is paired at the first level, later those that still have many open documents
        many = F.lit(True) if level == 1 else F.col("n") > LEAF
        busy, wait = cur.filter(many), cur.filter(~many)
        nb = F.greatest(F.ceil(F.col("n") / BUCKET), F.least(F.lit(SPREAD), F.ceil(F.col("n") / 2)))
        dealt = busy.withColumn("b", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.lit("b"), "k.id", "k.source", "k.size"), nb)).groupBy("k.source", "n", "b")
        dealt = dealt.agg(F.array_sort(F.collect_list(_items(level, seed))).alias("items")).select(F.expr(PAIR.format(**TEXT)).alias("st"), nb.alias("n"))
        settled.append(dealt.select(F.explode("st.done").alias("d")).select("d.k", "d.x"))
        cur = wait.unionByName(dealt.filter("st.c is not null").select("st.c.k", "st.c.s", "st.c.p", F.col("n").cast("long").alias("n")))
    last = cur.withColumn("o", -F.col("s")).groupBy(F.col("k.source").alias("source")).agg(F.array_sort(F.collect_list(F.struct("o", _items(level + 1, seed).alias("i")))).alias("items"))
    last = last.select(F.transform("items", lambda x: x["i"]).alias("items")).select(F.explode(F.expr(POOL.format(**TEXT))).alias("d")).select("d.k", "d.x")
    for s in settled:
        last = last.unionByName(s)
    return last


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "size", cycle: int = 3, cap: float = 3.0, seed: int = SEED) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)``, one row per row of ``docs``.

    ``copies`` is how often the mix takes the document, at most ``cap`` (rounded up) times; ``taken`` its words with
    repeats. Rows that agree in id, source and size count as one document and get the same copies. Null ids and
    sources are values like others; a null size is 0, and documents of size 0 get the whole part of their wish.
    The result depends on rows and seed alone, not on partitions. Other columns are ignored.
    """
    work = Scratch(docs.sparkSession, "mix")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"))
    rows = work.write(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "sized")
    per = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n"))
    goal = work.write(source_targets(per.select("source", "source_size"), cycle, cap).join(per.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2"), "targets")
    largest = goal.agg(F.max("n")).first()[0] or 0
    g = goal.select(F.col("source").alias("s2"), "source_size", "target", "n", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("r"))
    near = F.when(F.abs(F.col("r") - F.round("r")) < 1e-9, F.round("r")).otherwise(F.col("r"))
    wish = rows.join(g.withColumn("r", near), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    base = F.floor("r").cast("int")
    wish = wish.withColumn("p", F.col("r") - base).withColumn("k", F.struct(F.col("doc_id").alias("id"), "source", "size", "rows", base.alias("base")))
    is_open = (F.col("p") > 0) & (F.col("size") > 0)
    asked = wish.filter(is_open).select("k", (F.col("size") * F.col("rows")).cast("double").alias("s"), "p", F.col("n").cast("long").alias("n"))
    whole = wish.filter(~is_open).select("k", F.lit(0).alias("x"))
    got = whole.unionByName(round_copies(asked, largest, seed)).select("k.*", "x")
    got = got.join(g.select("s2", "source_size", "target"), F.col("source").eqNullSafe(F.col("s2"))).withColumn("copies", F.col("base") + F.col("x"))
    got = work.write(got.drop("s2"), "copies")
    # one row for each equal row: in slices, so that a row repeated very often is no task's alone
    slices = F.ceil(F.col("rows") / SLICE)
    few = got.filter(F.col("rows") <= SLICE).withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    lot = got.filter(F.col("rows") > SLICE).withColumn("_slice", F.explode(F.sequence(F.lit(1).cast("long"), slices))).repartition("_slice")
    lot = lot.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(SLICE).cast("long"), F.col("rows") - (F.col("_slice") - 1) * SLICE)))).drop("_slice")
    got = few.unionByName(lot)
    return got.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def take_mix(docs: DataFrame, mix: DataFrame, size: Column) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as ``mix`` takes it. ``size`` is the size ``mix`` was made with."""
    m = mix.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "copies").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (size == F.col("_size"))
    return docs.join(m, same).filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix_sources(docs.select("doc_id", "source", word_count("text").alias("size")))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


QUERIES = {"op1_mix": op1_mix}
