"""SimHash near-duplicates by covering locality-sensitive hashing.

Each fingerprint bit i has a vector phi(i) in {1..15} = GF(2)^4 without zero, and each table v in {1..15}
keeps the bits with an odd inner product <phi(i), v>. Three bits span at most three of the four dimensions, so
some v is orthogonal to all of them: that table drops exactly these bits. Hence any two fingerprints that
differ in at most three bits agree on a kept key of some table; no pair is missed.

Work is on distinct fingerprints, so copies cost nothing beyond one aggregation. A bucket of more than
``CHUNK`` fingerprints is dealt into chunks, and each pair of chunks is a group of its own: every pair is still
compared, in groups of bounded size. A group emits a spanning forest of its links, never all pairs; the
components of the forests are those of all links.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgweave.llm.caches import cache_of
from kgweave.operators.components import connected_components
from kgweave.plans.scratch import Scratch

SHINGLE, RADIUS, CHUNK, SEED = 3, 3, 512, 42
ROWS_PER_TASK = 2_000_000
_ROWS = 65_536


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles; 0 for a text without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    n = max(1, len(words) - width + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    set_ = sum(np.unpackbits(h[i : i + _ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, n, _ROWS))
    return int(np.packbits(set_ * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", width: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint's 64 bits as a long. A null text has fingerprint 0."""

    def run(batches):
        cache_of("simhash")
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py(), width) for x in b.column("_text")), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(fp)], [*keep, "fp"])

    rows = docs.select(*keep, F.col(text).cast("binary").alias("_text"))
    return rows.mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), T.StructField("fp", T.LongType())]))


def masks(radius: int = RADIUS) -> list[int]:
    """The bits kept by each of the 2^(radius+1) - 1 tables, as signed longs."""
    n = 2 ** (radius + 1) - 1
    kept = [sum(1 << i for i in range(64) if ((1 + i % n) & v).bit_count() % 2) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in kept]


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links of a symmetric matrix (true on its diagonal): each node with the first one it is connected with."""
    label = np.arange(len(near))
    while True:
        new = np.where(near, label[None, :], len(near)).min(1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(near)))
    return far, label[far]


def _links(radius: int):
    def run(batches):
        rest_key, rest_fp = None, None

        def groups(key, fp):
            """Links within the runs of equal keys."""
            cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
            size = np.diff(np.r_[cut, len(key)])
            two = cut[size == 2]
            a, b = fp[two], fp[two + 1]
            ok = np.bitwise_count(a ^ b) <= radius
            out = [(a[ok], b[ok])]
            for s, n in zip(cut[size > 2], size[size > 2]):
                x = np.unique(fp[s : s + n])
                a, b = forest(np.bitwise_count(x[:, None] ^ x[None, :]) <= radius)
                out.append((x[a], x[b]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]).view(np.int64)) for i in (0, 1)], ["src", "dst"])

        for b in batches:
            key = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("t", "key", "ci", "cj")], 1)
            fp = b.column("fp").to_numpy().view(np.uint64)
            if not len(fp):
                continue
            if rest_key is not None:
                key, fp = np.concatenate([rest_key, key]), np.concatenate([rest_fp, fp])
            last = np.flatnonzero((key != key[-1]).any(1))
            n = last[-1] + 1 if len(last) else 0
            if n:
                yield groups(key[:n], fp[:n])
            rest_key, rest_fp = key[n:], fp[n:]
        if rest_key is not None and len(rest_key):
            yield groups(rest_key, rest_fp)

    return run


def near_links(fps: DataFrame, n: int, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """``(src, dst)``: a forest with the same components as all pairs of the distinct ``fp`` within ``radius``."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks(radius))])
    rows = fps.select("fp", F.explode(tables).alias("e")).select("e.t", "e.key", "fp")
    hot = rows.groupBy("t", "key").count().filter(F.col("count") > chunk).select("t", "key", F.ceil(F.col("count") / chunk).cast("int").alias("n"))
    dealt = rows.join(hot, ["t", "key"], "left").withColumn("c", F.coalesce(F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"), F.lit(0)))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("n") - 1, F.lit(0)))))
    dealt = dealt.select("t", "key", F.least("c", "o").alias("ci"), F.greatest("c", "o").alias("cj"), "fp")
    tasks = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * len(masks(radius)) // ROWS_PER_TASK))
    by = ["t", "key", "ci", "cj"]
    return dealt.repartition(tasks, *by).sortWithinPartitions(*by).mapInArrow(_links(radius), "src long, dst long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, radius: int = RADIUS, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, fp, group, component_id)`` and the columns ``carry`` for every row of ``docs``.

    Documents link when their fingerprints differ in at most ``radius`` bits (texts without words have
    fingerprint 0 and link like others). ``component_id`` is the smallest id reachable over links; it is null
    only where all ids of a component are null. ``group`` names the component by one of its fingerprints, so it
    tells such components apart. Equal rows get equal results; other columns are ignored. Columns of ``carry`` named as
    the new ones are refused.
    """
    if clash := {"doc_id", "fp", "group", "component_id", "text", "_text"} & set(carry):
        raise ValueError(f"carry already has {sorted(clash)}")
    work = Scratch(docs.sparkSession, "simhash")
    seen = work.write(fingerprints(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *carry), ["doc_id", *carry], width=width), "fps")
    reps = work.write(seen.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    found = work.write(connected_components(work.write(near_links(reps.select("fp"), reps.count(), radius).distinct(), "links")), "components")
    least = found.join(reps, found.node == reps.fp).groupBy("component").agg(F.min("rep").alias("low"))
    linked = found.join(least, "component").select(F.col("node").alias("fp"), "low", "component")
    final = reps.join(linked, "fp", "left").select("fp", F.coalesce("component", "fp").alias("group"), F.coalesce("low", "rep").alias("component_id"))
    return seen.join(final, "fp").select("doc_id", *carry, "fp", "group", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash": op2_simhash}
