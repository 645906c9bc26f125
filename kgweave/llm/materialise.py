"""Training-order materialisation: token sequences in a keyed random order, in shards of a fixed stride.

1. Each task encodes its texts one after another (each with an end token) and cuts the stream into sequences of
   ``length`` ids; the last one of a task is padded. They are written to the shared folder, numbered within
   the task, so the corpus-wide number of a sequence is its number plus the counts of the tasks before.
2. A keyed Feistel network permutes the smallest even-bit domain that holds all numbers; cycle-walking applies
   it again while the result lies outside [0, n). That gives every sequence its slot, without a sort, and from
   key and slot its number can be found again.
3. Slots are dealt by range: shard s holds slots s * rows .. (s + 1) * rows - 1, in order. A task sorts its
   shards by slot and writes each to a file of its own, renamed when whole, so a lost task can run again.

Slot t lies in shard t // rows at byte (t % rows) * stride. A reader starts anywhere and reads on.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.llm.tokens import WORD_BPE, WordEncoder, slices
from kgweave.plans.scratch import Scratch

LENGTH, EOS, PAD, KEY, ROUNDS = 2048, 2, 0, 0x5DEECE66D, 4
SHARD_BYTES = 32 << 20
MANIFEST = "slot long, shard int, byte_offset long, number long, first_doc_id long, first_start long, n_docs int, n_ids int, crc32 long"


def feistel(x: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed permutation of 0 .. n-1 applied to ``x``."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, bits = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xC2B2AE3D27D4EB4F) % (1 << 64)) for r in range(rounds)]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> bits, v & mask
        for k in keys:
            f = (right + k) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return left << bits | right

    out = once(x.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def _sequences(tokenizer: str, length: int, eos: int, pad: int):
    def run(batches):
        enc, part, number = WordEncoder.of(tokenizer), TaskContext.get().partitionId(), 0
        press = zstandard.ZstdCompressor(level=3)
        ids, owner, inside = np.zeros(0, enc.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = np.zeros(0, bool)

        def cut(end: bool):
            nonlocal ids, owner, inside, known, number
            n = -(-len(ids) // length) if end else len(ids) // length
            rows = []
            for i in range(n):
                a, z = i * length, min((i + 1) * length, len(ids))
                raw = np.full(length, pad, enc.dtype)
                raw[: z - a] = ids[a:z]
                starts = 1 + int((np.diff(owner[a:z]) != 0).sum())
                rows.append((part, number + i, int(owner[a]) if known[a] else None, int(inside[a]), starts, z - a, press.compress(raw.astype(raw.dtype.newbyteorder("<")).tobytes())))
            number += n
            done = n * length
            ids, owner, inside, known = ids[done:], owner[done:], inside[done:], known[done:]
            return pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in rows], SEQUENCE) if rows else None

        for b in slices(batches, "_text"):
            new, n = enc.encode(b.column("_text"))
            end = np.cumsum(n + 1)
            flat = np.full(end[-1], eos, enc.dtype)
            flat[np.delete(np.arange(end[-1]), end - 1)] = new
            doc, null = b.column("doc_id"), b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids, owner = np.r_[ids, flat], np.r_[owner, np.repeat(doc.fill_null(0).to_numpy(zero_copy_only=False), n + 1)]
            inside, known = np.r_[inside, np.arange(end[-1]) - np.repeat(end - n - 1, n + 1)], np.r_[known, np.repeat(~null, n + 1)]
            if (out := cut(False)) is not None:
                yield out
        if (out := cut(True)) is not None:
            yield out

    return run


NAMES = ["part", "row", "first_doc_id", "first_start", "n_docs", "n_ids", "blob"]
SEQUENCE = pa.schema(zip(NAMES, [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]))


def _write(root: str, stride: int, rows: int):
    """Sequences sorted by slot -> files of the shards, and the manifest."""

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        press, shard, out = zstandard.ZstdDecompressor(), None, None

        def close():
            if out is not None:
                out.close()
                fs.move(f"{base}/.{shard:06d}-{attempt}", f"{base}/{shard:06d}.bin")

        for b in batches:
            crc = []
            for s, slot, blob in zip(*(b.column(c).to_pylist() for c in ("shard", "slot", "blob"))):
                if s != shard:
                    close()
                    shard, out = s, fs.open_output_stream(f"{base}/.{s:06d}-{attempt}")
                raw = press.decompress(blob, max_output_size=stride)
                out.write(raw)
                crc.append(zlib.crc32(raw))
            at = pa.array((b.column("slot").to_numpy() % rows) * stride)
            cols = {"byte_offset": at, "crc32": pa.array(crc, pa.int64())}
            names = [c.split()[0] for c in MANIFEST.split(", ")]
            yield pa.RecordBatch.from_arrays([cols[c] if c in cols else b.column(c) for c in names], names)
        close()

    return run


def materialise(
    docs: DataFrame, root: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str = WORD_BPE, length: int = LENGTH, eos: int = EOS, pad: int = PAD, key: int = KEY, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Write the shards under the URI ``root`` and return their manifest, one row per sequence.

    The files are written when the manifest is computed; computing it again writes the same bytes. Columns:
    ``slot``, ``shard``, ``byte_offset``, ``number`` (before the permutation: input order), ``first_doc_id`` and
    ``first_start`` (the document the sequence begins in and the ids of it that come before), ``n_docs``, ``n_ids``
    (without padding), ``crc32`` of the stored bytes (little-endian ids, 2 bytes each if the vocabulary allows, else 4).
    A null text is an end token alone. Equal rows stay separate. An empty table gives no sequence.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "sequences")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text"))
    schema = "part int, row long, first_doc_id long, first_start long, n_docs int, n_ids int, blob binary"
    seqs = work.write(rows.mapInArrow(_sequences(tokenizer, length, eos, pad), schema), "encoded", compression="none")
    # one number per task of the encoding stage
    counts = sorted((r["part"], r["count"]) for r in seqs.groupBy("part").count().collect())
    total = sum(n for _, n in counts)
    before = np.cumsum([0, *(n for _, n in counts)])
    base = {p: int(b) for (p, _), b in zip(counts, before)}
    stride = length * WordEncoder.of(tokenizer).dtype().itemsize
    per_shard = max(1, shard_bytes // stride)
    shards = max(1, -(-total // per_shard))

    @F.pandas_udf("number long, slot long")
    def place(part: pd.Series, row: pd.Series) -> pd.DataFrame:
        number = part.map(base).to_numpy(np.int64) + row.to_numpy(np.int64)
        return pd.DataFrame({"number": number, "slot": feistel(number, total, key)})

    placed = seqs.withColumn("_p", place("part", "row")).select("first_doc_id", "first_start", "n_docs", "n_ids", "blob", "_p.number", "_p.slot")
    placed = placed.withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int"))
    return placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "slot").mapInArrow(_write(root, stride, per_shard), MANIFEST)


def read_slots(root: str, first: int, n: int, length: int = LENGTH, dtype=np.uint16, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """Sequences ``first`` .. ``first + n - 1`` of the training order; the files alone are needed."""
    fs, base = pafs.FileSystem.from_uri(root)
    stride = length * np.dtype(dtype).itemsize
    per, out = max(1, shard_bytes // stride), []
    while n > 0:
        shard, row = divmod(first, per)
        k = min(n, per - row)
        with fs.open_input_file(f"{base}/{shard:06d}.bin") as f:
            out.append(np.frombuffer(f.read_at(k * stride, row * stride), np.dtype(dtype).newbyteorder("<")).reshape(-1, length))
        first, n = first + k, n - k
    return np.concatenate(out)


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = Scratch(spark, "training-order").path
    return materialise(spark.read.parquet(f"{sf_dir}/documents.parquet"), root)


QUERIES = {"op6_training_order": op6_training_order}
