"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass 1 scatters the rows, with all their columns: a rendezvous hash of the key picks the shard, a seeded hash of the
row picks one of the shard's buckets, and the scattered rows are written to the shared folder. A bucket is
sized for memory: about ``BUCKET_BYTES`` bytes and at most about ``BUCKET_ROWS`` rows. Pass 2 brings each bucket
together, permutes it by Fisher-Yates, numbers its rows after those of the shard's earlier buckets and writes it.

Rows of one key always share a shard (that is the law ``key``), yet they scatter over its buckets. Rows that are
wholly equal are scattered by their place too, so a row repeated many times fills no bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kgweave.plans.scratch import Scratch

SHARDS, BUCKET_ROWS, BUCKET_BYTES, SEED = 24, 4096, 8 << 20, 42
TASK_BUCKETS = 16  # buckets of a task at most


def rendezvous(key: str, shards: int, seed: int = SEED) -> Column:
    """The shard with the largest hash of (seed, key, shard). One more shard only draws rows into itself."""
    picks = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), F.col(key), s).alias("h"), s.alias("s")))
    return F.array_max(picks)["s"]


def fisher_yates(size: Column, seed: Column) -> Column:
    """A permutation of 0 .. size-1: the k-th pick takes a random one of those left (an array of ints)."""
    start = F.struct(F.sequence(F.lit(0), size - 1).alias("left"), F.array().cast("array<int>").alias("picked"))

    def pick(st: Column, k: Column) -> Column:
        j = F.pmod(F.xxhash64(seed, k), F.size(st["left"]).cast("long")).cast("int")
        left = F.concat(F.slice(st["left"], F.lit(1), j), F.slice(st["left"], j + 2, F.size(st["left"])))
        return F.struct(left.alias("left"), F.concat(st["picked"], F.array(F.get(st["left"], j))).alias("picked"))

    return F.aggregate(F.sequence(F.lit(0), size - 1), start, pick, lambda st: st["picked"])


def _bytes(df: DataFrame) -> Column:
    """About what a row takes: 8 bytes a column and the lengths of strings and binaries."""
    out = F.lit(8 * len(df.columns)).cast("long")
    for c, t in df.dtypes:
        if t in ("string", "binary"):
            out = out + F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0))
    return out


def shard_rows(df: DataFrame, key: str, shards: int = SHARDS, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """``df`` with ``shard``, ``grown_shard`` (with one shard more) and ``slot``, gapless from 0 in each shard.

    All columns travel with the row and must be hashable (no maps). Every input row comes back once; equal
    rows get different slots; rows with a null key all go to the shard that null hashes to. An empty table
    gives an empty one. Columns of ``df`` named as the new ones, or with an underscore in front, are refused.
    """
    cols = df.columns
    if clash := {c for c in cols if c in ("shard", "grown_shard", "slot") or c.startswith("_")}:
        raise ValueError(f"df already has {sorted(clash)}")
    spark = df.sparkSession
    work = Scratch(spark, "shards")
    shard, row = rendezvous(key, shards, seed), F.xxhash64(F.lit(seed + 1), *[F.col(f"`{c}`") for c in cols])
    rows = df.select(shard.alias("_shard"), row.alias("_h"), _bytes(df).alias("_bytes"))
    rows = work.write(rows.groupBy("_shard", "_h").agg(F.count("*").alias("_m"), F.sum("_bytes").alias("_bytes")), "rows")
    buckets = F.greatest(F.ceil(F.sum("_bytes") / bucket_bytes), F.ceil(F.sum("_m") / bucket_rows), F.lit(1))
    # one row for each shard: bounded by the parameter, hence safe to broadcast
    sizes = work.write(rows.groupBy("_shard").agg(buckets.alias("_buckets")), "sizes")
    # a written table: Spark knows its size and broadcasts it only below its threshold
    equal = work.write(rows.filter("_m > 1").select("_h", "_m"), "equal")
    scattered = df.withColumn("_shard", shard).withColumn("_h", row).withColumn("_place", F.monotonically_increasing_id())
    scattered = scattered.join(equal, "_h", "left").join(F.broadcast(sizes), "_shard")
    own = F.when(F.col("_m").isNotNull(), F.xxhash64("_h", "_place")).otherwise(F.col("_h"))
    bucket = F.pmod(F.xxhash64(F.lit(seed + 2), own), F.col("_buckets"))
    scattered = work.write(scattered.select("_shard", bucket.alias("_bucket"), "_h", *[F.col(f"`{c}`") for c in cols]), "pass1", compression="zstd")
    total = sizes.agg(F.sum("_buckets")).first()[0] or 1
    tasks = min(total, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BUCKETS)))
    per = scattered.groupBy("_shard", "_bucket").agg(F.count("*").cast("int").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    order = fisher_yates(F.col("_n"), F.xxhash64(F.lit(seed), "_shard", "_bucket"))
    orders = work.write(per.withColumn("_before", before).repartition(tasks, "_shard", "_bucket").select("_shard", "_bucket", "_before", order.alias("_order")), "orders")
    number = F.row_number().over(W.partitionBy("_shard", "_bucket").orderBy("_h", key)) - 1
    placed = scattered.repartition(tasks, "_shard", "_bucket").withColumn("_k", number).join(orders, ["_shard", "_bucket"])
    out = placed.select(*[F.col(f"`{c}`") for c in cols], F.col("_shard").alias("shard"), (F.col("_before") + F.get("_order", F.col("_k"))).cast("long").alias("slot"))
    return out.withColumn("grown_shard", rendezvous(key, shards + 1, seed))


def write_shards(sharded: DataFrame, path: str) -> DataFrame:
    """Write one folder for each shard, where files hold buckets with their rows in the order of their slots; returns the table read back."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return sharded.sparkSession.read.schema(sharded.schema).parquet(path)


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    out = write_shards(shard_rows(docs, "doc_id"), Scratch(spark, "written").path)
    # bytes and CRC of the UTF-8 text; a null text counts as empty
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {"op10_shards": op10_shards}
