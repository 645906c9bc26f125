"""Near-duplicates by the Jaccard similarity of word shingle sets.

1. Texts with equal sets count as one. MinHash gives each set ``BANDS`` keys of ``ROWS`` minima; sets that share
   a key are candidates. At similarity s a pair shares none with probability (1 - s^ROWS)^BANDS, 2.3e-5 at 0.8.
2. The whole sets of a bucket meet in a task, which computes all their similarities exactly and emits a spanning
   forest of the links, never all pairs. A bucket of more than ``CHUNK`` sets is dealt into chunks, and each
   pair of chunks is a group of its own: every pair is still compared, in groups of bounded size.

So of all candidates none goes unchecked, and no row stands for a pair that is only a candidate.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgweave.llm.caches import cache_of
from kgweave.llm.simhash import forest
from kgweave.llm.substrings import mix
from kgweave.operators.components import connected_components
from kgweave.plans.scratch import Scratch

SHINGLE, BANDS, ROWS, CHUNK, SEED = 5, 20, 4, 256, 42
#: Similar from NUM / DEN on.
NUM, DEN = 4, 5
_STEP = 4096
_ODD = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, one without words has none."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    rows = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, rows, repeat(SEED)), np.uint64, max(1, len(words) - width + 1)))


def band_keys(h: np.ndarray) -> np.ndarray:
    if not len(h):
        return np.zeros(0, np.uint64)
    low = np.min([(h[i : i + _STEP, None] * _ODD).min(0) for i in range(0, len(h), _STEP)], axis=0).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low[:, j])
    return key


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def _sign(batches):
    cache_of("jaccard")
    for b in batches:
        sets = [shingles(t) for t in b.column("text").to_pylist()]
        fp = np.fromiter((xxhash.xxh64_intdigest(h.tobytes()) for h in sets), np.uint64, len(sets)).view(np.int64)
        cols = [b.column("_key"), pa.array(fp), pa.array([len(h) for h in sets], pa.int64()), pa.array([_signed(band_keys(h)) for h in sets], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["_key", "fp", "n", "bands"])


def _ship(batches):
    """Texts with the groups each goes to -> one row per group: (band, ci, cj, fp, h)."""
    for b in batches:
        for i in range(0, b.num_rows, 64):
            part = b.slice(i, 64)
            sets = [shingles(t).tobytes() for t in part.column("text").to_pylist()]
            groups = part.column("groups")
            of = pa.array(np.repeat(np.arange(part.num_rows), groups.value_lengths().to_numpy()))
            flat = groups.flatten()
            yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in ("band", "ci", "cj")), part.column("fp").take(of), pa.array(sets, pa.binary()).take(of)], ["band", "ci", "cj", "fp", "h"])


def similar_matrix(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sorted sets have a similarity of NUM / DEN or more."""
    n, m = np.array([len(x) for x in sets]), len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), n)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.r_[True, flat[1:] != flat[:-1]] if len(flat) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    use = np.bincount(column)[column] > 1 if len(flat) else new  # what one set alone holds is common to none
    column, owner = np.unique(column[use], return_inverse=True)[1], owner[use]
    common, width = np.zeros((m, m), np.float32), _STEP
    edge = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + width + 1, width))
    for a, z in zip(edge, edge[1:]):
        block = np.zeros((m, width), np.float32)
        block[owner[a:z], column[a:z] % width] = 1
        common += block @ block.T  # whole numbers below 2**24: exact
    np.fill_diagonal(common, n)
    return common * (NUM + DEN) >= (n[:, None] + n[None, :]) * NUM


def _compare(batches):
    """Rows sorted by group -> ``(src, dst)``, a forest of the similar pairs of each group."""
    key, fps, sets = None, [], []

    def links():
        found = dict(zip(fps, sets))
        if len(found) > 1:
            names = np.array(sorted(found))
            a, b = forest(similar_matrix([np.frombuffer(found[f], np.uint64) for f in names.tolist()]))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b])], ["src", "dst"])

    for b in batches:
        for *k, fp, h in zip(*(b.column(c).to_pylist() for c in ("band", "ci", "cj", "fp", "h"))):
            if k != key:
                yield from links()
                key, fps, sets = k, [], []
            fps.append(fp)
            sets.append(h)
    yield from links()


GROUP = T.StructType([T.StructField("band", T.LongType()), T.StructField("ci", T.IntegerType()), T.StructField("cj", T.IntegerType())])


def similar_groups(docs: DataFrame, key: str, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``(_key, group)`` for every row of ``docs``: rows whose shingle sets have a similarity of 4/5 or more are of one group, as
    are those linked over others. ``key`` is a long column that only wholly equal rows share; texts without words are one group."""
    work = Scratch(docs.sparkSession, "jaccard")
    texts = docs.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("text"))
    seen = work.write(texts.mapInArrow(_sign, "_key long, fp long, n long, bands array<long>"), "signed")
    reps = work.write(seen.groupBy("fp").agg(F.min("_key").alias("_key"), F.first("bands").alias("bands")), "distinct")
    rows = reps.select("fp", "_key", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count("*").alias("m")).filter("m > 1").select("band", F.ceil(F.col("m") / chunk).cast("int").alias("m"))
    dealt = rows.join(shared, "band").withColumn("c", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    group = F.struct("band", F.least("c", "o").alias("ci"), F.greatest("c", "o").alias("cj"))
    places = work.write(dealt.groupBy("_key", "fp").agg(F.collect_list(group).cast(T.ArrayType(GROUP)).alias("groups")), "places")
    # texts that are wholly equal have one key: any row of them will do
    wanted = texts.join(places, "_key").mapInArrow(_ship, "band long, ci int, cj int, fp long, h binary")
    by = ["band", "ci", "cj"]
    links = wanted.repartition(*by).sortWithinPartitions(*by).mapInArrow(_compare, "src long, dst long")
    found = work.write(connected_components(work.write(links.distinct(), "links")), "components")
    named = reps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("group"))
    return seen.select("_key", "fp").join(named, "fp").select("_key", "group")
