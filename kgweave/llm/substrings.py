"""Exact substring dedup over words by recompression.

A text is a string of words, each named by a 64-bit hash. A round of recompression names its runs of a word
pair: every symbol falls on a left or a right side by a hash of its name, and a left symbol followed by a right
one becomes one symbol named by a hash of both. (Runs of one symbol never pair, so a run keeps its own
symbols and equal runs have equal ones.) Names are fingerprints of what they stand for, hence the same
everywhere without a shared dictionary. Each symbol carries the range of words its making looked at; wherever
this range of words occurs again, the same symbol occurs again. These are the consistent interior symbols.

1. Reveal: the key of a symbol is the hash of its range. Spark deals all keys by hash; a key that occurs in two
   documents is shared. A window can only repeat if all symbols whose ranges lie within it are shared. A
   window that holds none (it happens in runs and at the ends of a text) has its own key instead.
2. Verify: the windows left are hashed whole (96 bits), dealt by hash, and each learns the smallest document
   that holds it.
3. Remove: each document's windows that a smaller document holds cover the words to remove.

Steps 2 and 3 run on groups of documents dealt by a hash of the id. Keys are packed into byte strings, many to a
row, and cut to what a bucket needs; a key that repeats within a batch of documents leaves the batch once. So
neither a text held by a third of all documents nor a very common passage makes a large row or task. All that is
dealt is compressed before: texts in blocks of a group, keys in ascending order as differences, by planes of bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.llm.caches import cache_of, trim
from kgweave.plans.scratch import Scratch

WINDOW, ROUNDS, LONGEST = 13, 3, 6
GROUP_BYTES, LEAST_GROUPS, BATCH_WORDS = 8 << 20, 128, 400_000
SLICE_BYTES, HELD_BYTES, BLOCK_BYTES = BATCH_WORDS * 6, 32 << 20, 256 << 10  # of text: looked at, sorted into blocks, in a block
U = np.uint64
B1, B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd multipliers, fixed values
LAST = (1 << 63) - 1  # stands for a null id: after all others


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply)."""
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (with the end of the last)."""
    words = [t.split() if t else [] for t in texts]
    start = np.cumsum([0, *map(len, words)])
    return np.fromiter((xxhash.xxh64_intdigest(w) for ws in words for w in ws), U, int(start[-1])), start


class Ranges:
    """Hashes of any ranges of a word string, from one prefix sum: sum of h[k] * base^k, divided by base^start."""

    def __init__(self, h: np.ndarray, base: int):
        n = len(h)
        power = np.full(n + 1, base, U)
        power[0] = 1
        inverse = np.full(n + 1, pow(base, -1, 1 << 64), U)
        inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(h * np.multiply.accumulate(power)[:n], dtype=U)])

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.inverse[lo] + (hi - lo).astype(U))


def symbols(h: np.ndarray, start: np.ndarray, rounds: int = ROUNDS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, and range [lo, hi) of words looked at, of each symbol after ``rounds``; a symbol whose making
    looked at an end of its text has no range that stands for it and is left out."""
    n = len(h)
    first = np.zeros(n + 1, bool)
    first[start] = True
    first = first[:n]
    at, name, size = np.arange(n), h, np.ones(n, np.int64)
    lo, hi = np.arange(n), np.arange(n) + 1
    ok = np.ones(n, bool)
    for r in range(rounds):
        if not len(at):
            break
        right = (mix(name + U(r * 2 + 1)) >> U(63)).astype(bool)
        here_first = first[at]
        same = np.r_[False, ~here_first[1:]]  # the symbol before belongs to the same text
        pair = same & np.r_[False, ~right[:-1] & right[1:] & (size[:-1] + size[1:] <= longest)]  # joins the one before
        # a right symbol looked at the one before, a left one at the one after
        before, after = np.r_[0, np.arange(len(at) - 1)], np.r_[np.arange(1, len(at)), len(at) - 1]
        has_after = np.r_[same[1:], False]
        other = np.where(right, before, after)
        seen = np.where(right, same, has_after)
        lo2, hi2 = np.minimum(lo, lo[other]), np.maximum(hi, hi[other])
        ok2 = ok & seen & ok[other]
        keep = ~pair
        head = np.r_[pair[1:], False]  # the one after joins this one
        name = np.where(head, mix(name * U(B1) + np.r_[name[1:], U(0)] * U(B2) + U(r)), name)[keep]
        size = np.where(head, size + np.r_[size[1:], 0], size)[keep]
        at, lo, hi, ok = at[keep], lo2[keep], hi2[keep], ok2[keep]
    return at[ok], lo[ok], hi[ok]


class Batch:
    """Words, windows and keys of some texts."""

    def __init__(self, texts: list[bytes | None], window: int = WINDOW):
        self.h, self.start = word_hashes(texts)
        n, self.window = len(self.h), window
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.start))
        self.ranges = Ranges(self.h, B1)
        end = self.start[1:][self.doc] if n else np.zeros(0, np.int64)
        self.windows = np.flatnonzero(np.arange(n) + window <= end)  # first words
        _, lo, hi = symbols(self.h, self.start)
        use = hi - lo <= window
        lo, hi = lo[use], hi[use]
        # symbols by lo; hi grows along with lo within a text, so those inside a window are a run
        self.lo, self.hi = lo, hi
        left = np.searchsorted(lo, self.windows, "left")
        right = np.searchsorted(np.maximum.accumulate(hi), self.windows + window, "right") if len(hi) else left
        self.left, self.right = left, np.maximum(left, right)
        bare = self.windows[self.right == self.left]
        self.bare = self.right == self.left
        self.key = np.concatenate([self.ranges(lo, hi), self.ranges(bare, bare + window)])
        self.key_doc = self.doc[np.concatenate([lo, bare])]

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """First words of the windows all of whose keys are shared (``shared``: for each key)."""
        n = len(self.lo)
        count = np.concatenate([[0], np.cumsum(shared[:n])])
        ok = count[self.right] - count[self.left] == self.right - self.left
        ok[self.bare] = shared[n:]
        return self.windows[ok]

    def window_hash(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.ranges(at, at + self.window), (Ranges(mix(self.h + U(7)), B2)(at, at + self.window) >> U(32)).astype(np.uint32)


def _slices(b, size: int):
    """Rows of a batch in slices of about ``size`` bytes of text, one row at least."""
    lengths = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + size, "right")))
        yield b.slice(at, to - at)
        at = to


def _texts(batches, size: int = SLICE_BYTES):
    """Rows of the batches in slices of about ``size`` bytes of text."""
    cache_of("substrings")
    for b in batches:
        yield from _slices(b, size)
    trim()


def _size(b: pa.RecordBatch) -> int:
    return pc.sum(pc.binary_length(b.column("text"))).as_py() or 0


def _join(batches: list) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _shrink(raw) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _grow(blob: bytes) -> pa.Buffer:
    return pa.decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), "zstd")


def _squeeze(first: np.ndarray, *others: np.ndarray) -> bytes:
    """Columns of one length; the first ascends and is kept as differences, all by planes of bytes."""
    cols = [np.diff(first, prepend=first.dtype.type(0)), *others]
    return _shrink(b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in cols)) if len(first) else b""


def _spread(blobs: list[bytes], *forms: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """What ``_squeeze`` made of each blob: how many rows it has, and the columns of all."""
    sizes = np.cumsum([0, *(np.dtype(f).itemsize for f in forms)])
    count, parts = np.zeros(len(blobs), np.int64), [[np.zeros(0, f)] for f in forms]
    for i, blob in enumerate(blobs):
        if blob:
            planes = np.frombuffer(_grow(blob), np.uint8).reshape(int(sizes[-1]), -1)
            count[i] = planes.shape[1]
            cols = [np.ascontiguousarray(planes[a:z].T).view(f)[:, 0] for f, a, z in zip(forms, sizes, sizes[1:])]
            for p, c in zip(parts, [np.cumsum(cols[0], dtype=forms[0]), *cols[1:]]):
                p.append(c)
    return count, [np.concatenate(p) for p in parts]


def _blocks(schema: pa.Schema):
    """Documents -> (g, payload): texts of a group side by side, compressed."""

    def blocks(held):
        b = _join(held)
        b = b.take(pa.array(np.argsort(b.column("g").to_numpy(), kind="stable")))
        g, rows = b.column("g").to_numpy(), b.select(schema.names).cast(schema)
        cut = _cuts(g)
        out = [(g[a], _shrink(x.serialize())) for a, z in zip(cut, cut[1:]) for x in _slices(rows.slice(a, z - a), BLOCK_BYTES)]
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["g", "payload"])

    def run(batches):
        held, n = [], 0
        for b in _texts(batches):
            held.append(b)
            n += _size(b)
            if n >= HELD_BYTES:
                yield blocks(held)
                held, n = [], 0
        if held:
            yield blocks(held)

    return run


def _ids(b) -> np.ndarray:
    return b.column("doc_id").fill_null(LAST).to_numpy(zero_copy_only=False)


def _cuts(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1], True]) if len(sorted_) else np.zeros(1, np.int64)


def _bucket(key: np.ndarray, groups: int) -> np.ndarray:
    return ((key >> U(32)) * U(groups)) >> U(32)


def _reveal(groups: int):
    """Documents -> (bucket, keys and their groups, keys known to be shared of the group numbered as the bucket), packed."""
    none = groups  # of a key that several documents of the batch hold

    def run(batches):
        for b in _texts(batches):
            x = Batch(b.column("text").to_pylist())
            g = b.column("g").to_numpy()[x.key_doc].astype(np.uint32)
            key = _pack(x.key, groups)
            order = np.lexsort((x.key_doc, key))
            key, doc, g = key[order], x.key_doc[order], g[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])] if len(key) else np.zeros(0, bool)
            key, g = key[new], g[new]
            cut = _cuts(key)
            many = np.repeat(np.diff(cut) > 1, np.diff(cut))
            # a key of one document goes with its group; one of many goes once, and their groups are told at once
            head = np.zeros(len(key), bool)
            head[cut[:-1]] = True
            key1, g1 = key[head], np.where(many[head], none, g[head]).astype(np.uint32)
            key2, g2 = key[many], g[many]
            at1, at2 = (key1 >> U(32)).astype(np.int64), g2.astype(np.int64)
            low1 = key1.astype(np.uint32)
            o2 = np.lexsort((key2, at2))
            key2, at2 = key2[o2], at2[o2]
            twice = np.r_[False, (key2[1:] == key2[:-1]) & (at2[1:] == at2[:-1])] if len(key2) else np.zeros(0, bool)
            key2, at2 = key2[~twice], at2[~twice]
            # one row for each bucket that has keys or known groups
            has = np.union1d(at1, at2)
            spans = [zip(np.searchsorted(at, has, "left"), np.searchsorted(at, has, "right")) for at in (at1, at2)]
            cols = [[_squeeze(low1[a:z], g1[a:z]) for a, z in spans[0]], [_squeeze(key2[a:z]) for a, z in spans[1]]]
            yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), *(pa.array(c, pa.binary()) for c in cols)], ["bucket", "keys", "known"])

    return run


def _pack(key: np.ndarray, groups: int) -> np.ndarray:
    """What is kept of a key: its bucket and its low half."""
    return (_bucket(key, groups) << U(32)) | (key & U(0xFFFFFFFF))


def _by(batches, col: str, names: list[str]):
    """Runs of equal ``col`` in batches sorted by it, each as lists of the other columns."""
    cur, kept = None, None
    for b in batches:
        for v, *row in zip(b.column(col).to_pylist(), *(b.column(n).to_pylist() for n in names)):
            if v != cur:
                if kept:
                    yield cur, kept
                cur, kept = v, [[] for _ in names]
            for k, x in zip(kept, row):
                k.append(x)
    if kept:
        yield cur, kept


def _share(groups: int):
    """Packed keys of a bucket -> (g, keys): for each group the shared keys it holds."""

    def run(batches):
        for bucket, (keys, known) in _by(batches, "bucket", ["keys", "known"]):
            _, (key, g) = _spread(keys, "<u4", "<u4")
            order = np.argsort(key, kind="stable")
            key, g = key[order], g[order]
            n = np.diff(_cuts(key))
            many = np.repeat(n > 1, n) & (g != groups)
            key, g = key[many].astype(U) | (U(bucket) << U(32)), g[many]
            # what batches knew of the group numbered as this bucket comes along
            _, (told,) = _spread(known, "<u8")
            key, g = np.concatenate([key, told]), np.concatenate([g, np.full(len(told), bucket, np.uint32)])
            order = np.lexsort((key, g))
            key, g = key[order], g[order]
            cut = _cuts(g)
            if len(g):
                yield pa.RecordBatch.from_arrays([pa.array(g[cut[:-1]].astype(np.int32)), pa.array([_squeeze(np.unique(key[a:z])) for a, z in zip(cut, cut[1:])], pa.binary())], ["g", "payload"])

    return run


TEXTS = pa.schema([("doc_id", pa.int64()), ("text", pa.binary())])
WHOLE = TEXTS.append(pa.field("rest", pa.string()))
FULL = "<u8", "<u4", "<i8", "u1"  # both hashes of a window, smallest document of the batch that holds it, whether others do


def _with_payload(batches, forms: tuple, schema: pa.Schema, size: int):
    """Rows sorted by (g, kind): yields (g, the columns of all payloads of kind 0 in order, a slice of texts)."""
    cache_of("substrings")
    g, told, cols, held, n = None, [], None, [], 0

    def slices():
        for t in _slices(_join(held), size) if held else ():
            yield g, cols, t

    for b in batches:
        for h, kind, x in zip(*(b.column(c).to_pylist() for c in ("g", "kind", "payload"))):
            if h != g:
                yield from slices()
                g, told, cols, held, n = h, [], None, [], 0
            if kind == 0:
                told.append(x)
                continue
            if cols is None:
                _, cols = _spread(told, *forms)
                order = np.lexsort(cols[::-1])
                told, cols = [], [c[order] for c in cols]
            block = pa.ipc.read_record_batch(_grow(x), schema)
            if held and n + _size(block) > size:
                yield from slices()
                held, n = [], 0
            held.append(block)
            n += _size(block)
    yield from slices()
    trim()


def _in(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_, x)
    return sorted_[np.minimum(at, len(sorted_) - 1)] == x


def _verify(groups: int, size: int):
    """Texts of a group after its shared keys -> (bucket, g, windows): candidate windows, each once for a batch."""

    def run(batches):
        for g, (shared,), b in _with_payload(batches, ("<u8",), TEXTS, size):
            if not len(shared):
                continue
            x = Batch(b.column("text").to_pylist())
            at = x.candidates(_in(shared, _pack(x.key, groups)))
            key, low = x.window_hash(at)
            doc = _ids(b)[x.doc[at]]
            order = np.lexsort((doc, low, key))
            key, low, doc = key[order], low[order], doc[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (low[1:] != low[:-1])] if len(key) else np.zeros(0, bool)
            head = np.flatnonzero(new)
            if len(head):
                many = doc[np.r_[head[1:] - 1, len(doc) - 1]] != doc[head]
                key, low, doc = key[head], low[head], doc[head]
                bucket = _bucket(key, groups).astype(np.int32)
                cut = _cuts(bucket)
                packed = [_squeeze(key[a:z], low[a:z], doc[a:z], many[a:z]) for a, z in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]]), pa.array(np.full(len(packed), g, np.int32)), pa.array(packed, pa.binary())], ["bucket", "g", "windows"])

    return run


def _answer(batches):
    """Windows of a bucket -> (g, payload): (both hashes, smallest document that holds it) of each window that a document of
    the group's batch must give up. A group has several batches, so only the document itself tells whose window stays."""
    for _, (gs, packed) in _by(batches, "bucket", ["g", "windows"]):
        count, (key, low, doc, many) = _spread(packed, *FULL)
        g = np.repeat(np.array(gs, np.int32), count)
        order = np.lexsort((doc, low, key))
        key, low, doc, many, g = key[order], low[order], doc[order], many[order], g[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (low[1:] != low[:-1])]
        least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        pick = np.flatnonzero((least < doc) | (many == 1))
        pick = pick[np.argsort(g[pick], kind="stable")]
        key, low, least, g = key[pick], low[pick], least[pick], g[pick]
        cut = _cuts(g)
        if len(g):
            packed = [_squeeze(key[a:z], low[a:z], least[a:z]) for a, z in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(g[cut[:-1]]), pa.array(packed, pa.binary())], ["g", "payload"])


def _remove(size: int):
    """Texts of a group after its answers -> kept words of each document."""

    def run(batches):
        for _, (known, low_of, least), b in _with_payload(batches, FULL[:3], WHOLE, size):
            texts, ids = b.column("text").to_pylist(), _ids(b)
            lists = [t.split() if t else [] for t in texts]
            if len(known):
                x = Batch.__new__(Batch)
                x.h, x.start = word_hashes(texts)
                doc = np.repeat(np.arange(len(texts)), np.diff(x.start))
                at = np.flatnonzero(np.arange(len(x.h)) + WINDOW <= x.start[1:][doc]) if len(doc) else np.zeros(0, np.int64)
                x.ranges, x.window = Ranges(x.h, B1), WINDOW
                key = x.ranges(at, at + WINDOW)
                maybe = _in(known, key)
                at, key = at[maybe], key[maybe]
                _, low = x.window_hash(at)
                i = first = np.searchsorted(known, key)
                # keys that differ in ``low`` alone stand side by side
                for step in range(1, int(np.diff(_cuts(known)).max())):
                    j = np.minimum(first + step, len(known) - 1)
                    i = np.where((known[j] == key) & (low_of[j] == low), j, i)
                gone = (low_of[i] == low) & (ids[doc[at]] > least[i])
                step = np.zeros(len(x.h) + WINDOW + 1, np.int64)
                np.add.at(step, at[gone], 1)
                np.add.at(step, at[gone] + WINDOW, -1)
                covered = np.cumsum(step)[: len(x.h)] > 0
            else:
                x, covered = None, None
            out = []
            for i, (t, ws) in enumerate(zip(texts, lists)):
                c = covered[x.start[i] : x.start[i + 1]] if covered is not None else None
                hit = int(c.sum()) if c is not None else 0
                kept = b" ".join(w for w, off in zip(ws, c) if not off) if hit else b" ".join(ws)
                out.append((len(ws), hit, kept if hit else t, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3]), b.column("rest")], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256", "rest"])

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rest=None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept, kept_sha256, rest)``, one row per row of ``docs``.

    A word goes if some window of 13 words that covers it also starts in a document with a smaller id. ``kept``
    is the whole text where nothing goes (null stays null), else the words left, joined by blanks;
    ``kept_sha256`` is of the words left joined by blanks. A null text has no words. A null id counts as larger
    than all others. Rows of one id count as one document, and none removes words of another. ``rest`` is a string column
    that comes along. Texts of a group are looked at in slices of about ``slice_bytes``.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "substrings")
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    groups = max(LEAST_GROUPS, -(-size // GROUP_BYTES))
    base = docs.select(
        F.pmod(F.xxhash64(F.col(doc_id), F.octet_length(text)), F.lit(groups)).cast("int").alias("g"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).cast("binary").alias("text"),
        (rest if rest is not None else F.lit(None)).cast("string").alias("rest"),
    )
    tasks = max(groups, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = base.select("g", "text").mapInArrow(_reveal(groups), "bucket int, keys binary, known binary")
    shared = keys.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_share(groups), "g int, payload binary")
    shared = work.write(shared, "shared")

    def beside(payload: DataFrame, schema: pa.Schema) -> DataFrame:
        """Texts of each group after what was found for the group, in one partition, sorted."""
        told = payload.select("g", F.lit(0).alias("kind"), "payload")
        rows = base.select("g", *schema.names).mapInArrow(_blocks(schema), "g int, payload binary")
        return told.union(rows.select("g", F.lit(1).alias("kind"), "payload")).repartition(tasks, "g").sortWithinPartitions("g", "kind")

    windows = beside(shared, TEXTS).mapInArrow(_verify(groups, slice_bytes), "bucket int, g int, windows binary")
    answers = windows.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer, "g int, payload binary")
    answers = work.write(answers, "answers")
    work.drop("shared")
    return beside(answers, WHOLE).mapInArrow(_remove(slice_bytes), "doc_id long, n_words long, n_removed long, kept binary, kept_sha256 string, rest string")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLES = {
    "op9_substrings": r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(generate_series(1, len(w)::BIGINT - 12)) AS i FROM t WHERE len(w) >= 13),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM starts),
least AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS pos FROM windows JOIN least USING (k) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w)::BIGINT)) AS pos FROM t WHERE len(w) > 0),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)"""
}
QUERIES = {"op9_substrings": op9_substrings}
