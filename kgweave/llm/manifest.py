"""Merkle manifest of a dataset as a tree of SHA-256 midstates.

Every row is a leaf; leaves of a group stand in order, eight consecutive nodes have a parent, and the groups' roots are
the leaves of one more tree. A parent is the hash of its children's digests as hex text. As such a text is exactly one
block of SHA-256, the state of a parent's hash before each child is eight words: the manifest keeps these states
in the parent's row, beside the children's digests. To see what root follows from a changed row, each parent on its path
resumes from the state before its slot and takes in the new digest and the siblings to the right only.

Rows are numbered by a range shuffle with counts of each partition, so no group passes through one task. Nodes are made in
blocks of ``FAN ** HEIGHT`` leaves, four levels in one shuffle; the roots of blocks are the leaves of the next stratum, of
which there are three for some 10^10 rows. Folding goes down again: the path above a block is one row, however many leaves stand below it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgweave.llm import sha256
from kgweave.plans.scratch import Scratch

FAN, HEIGHT = 8, 4
BITS, SPAN = 3, FAN**HEIGHT
#: Rows a task works on together (whole blocks).
HELD = 2 * SPAN
_POSITION = 33  # bits of monotonically_increasing_id below the partition's number
STEPS = "array<struct<slot:int,state:binary,left:binary,right:binary>>"


def leaf_digest(columns: dict[str, Column] | list[str]) -> Column:
    """SHA-256 in hex of the columns in turn: ``-`` for null, else the UTF-8 byte count, a colon and the value."""
    values = [F.col(c) for c in columns] if isinstance(columns, list) else list(columns.values())
    parts = []
    for c in values:
        s = c.cast("string")
        parts.append(F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)))
    return F.sha2(F.concat(*parts), 256)


def number_rows(rows: DataFrame, group: str, order: list[str], work: Scratch) -> DataFrame:
    """``rows`` with ``g`` (rank of the group, null first, from 1), ``n`` (rows of the group) and ``i`` (place in it, from 0). Nulls
    come first; rows equal in ``order`` stand in the order of ``rows``, which should be a written table."""
    at = F.monotonically_increasing_id()
    by = [group, *order, "_tie"]
    sorted_ = work.write(rows.withColumn("_tie", at).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", at).drop("_tie"), "sorted")
    part, position = F.shiftright("_at", _POSITION).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << _POSITION) - 1))
    runs = sorted_.groupBy(part, group).agg(F.count("*").alias("_c"), F.min(position).alias("_first"))
    # a row for each task and group: their order is that of all rows
    before = W.orderBy("_part", F.col(group).asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    own = W.partitionBy(group)
    runs = runs.select("_part", F.col(group).alias("_same"), (F.col("_start") - F.min("_start").over(own) - F.col("_first")).alias("_shift"), F.sum("_c").over(own).alias("n"))
    runs = work.write(runs.withColumn("g", F.dense_rank().over(W.orderBy(F.col("_same").asc_nulls_first())).cast("long")), "runs")
    joined = sorted_.join(runs, (F.shiftright("_at", _POSITION) == F.col("_part")) & F.col(group).eqNullSafe(F.col("_same")))
    return joined.select(*rows.columns, "g", "n", (position + F.col("_shift")).alias("i"))


def _binary(raw: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive pieces of an array of bytes."""
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(raw).tobytes())])


def _bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and where each value starts and the last ends."""
    a = column.combine_chunks().cast(pa.binary())
    a = a if isinstance(a, pa.Array) else pa.concat_arrays(a.chunks)
    ends = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    raw = np.frombuffer(a.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(a) else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def _longs(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def _whole_blocks(batches):
    """Tables of whole blocks, from rows sorted by ``g`` and ``block``: at least ``HELD`` rows each but for the last."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows < HELD:
            continue
        g, block = _longs(held, "g"), _longs(held, "block")
        cut = np.flatnonzero((g != g[-1]) | (block != block[-1]))
        if len(cut):
            yield held.slice(0, cut[-1] + 1).combine_chunks()
            held = held.slice(cut[-1] + 1)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


NODES = "g long, block long, level int, i long, n long, digest binary, states binary, children binary"


def _make_nodes(batches):
    """All parents within blocks (``level`` from 1) and the root of each block (``level`` 0, with the number ``n`` of nodes there)."""
    for t in _whole_blocks(batches):
        g, n, i = (_longs(t, c) for c in ("g", "n", "i"))
        d = _bytes(t.column("digest"))[0].reshape(-1, 32)
        out, done = [], []
        for level in range(1, HEIGHT + 1):
            if not (go := n > 1).all():
                done.append((g[~go], i[~go], n[~go], d[~go]))
                g, n, i, d = g[go], n[go], i[go], d[go]
            if not len(g):
                break
            p = i >> BITS
            first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (p[1:] != p[:-1])])
            count = np.diff(np.r_[first, len(g)])
            state, kept = sha256.start(len(first)), np.zeros((len(g), 8), np.uint32)
            for k in range(FAN):
                has = np.flatnonzero(count > k)
                at = first[has] + k
                kept[at] = state[has]
                state[has] = sha256.absorb(state[has], sha256.hex_block(d[at]))
            states, children, d = sha256.to_bytes(kept), d, sha256.finish(state, count)
            g, n, i = g[first], (n[first] + FAN - 1) >> BITS, p[first]
            out.append((g, i >> BITS * (HEIGHT - level), np.full(len(g), level), i, n, d, _binary(states, 32 * count), _binary(children, 32 * count)))
        done.append((g, i, n, d))
        g, i, n, d = (np.concatenate(x) for x in zip(*done))
        none = np.zeros(len(g), np.int64)
        out.append((g, i, none, i, n, d, _binary(np.zeros(0, np.uint8), none), _binary(np.zeros(0, np.uint8), none)))
        for g, block, level, i, n, d, states, children in out:
            arrays = [pa.array(g), pa.array(block), pa.array(level.astype(np.int32)), pa.array(i), pa.array(n), _binary(d, np.full(len(d), 32)), states, children]
            yield pa.RecordBatch.from_arrays(arrays, ["g", "block", "level", "i", "n", "digest", "states", "children"])


def _strata(entries: DataFrame, work: Scratch, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Tables of nodes, lowest stratum first, and the root ``(g, n, i, digest)`` of each group, from leaves of these columns."""
    strata: list[DataFrame] = []
    while (entries.agg(F.max("n")).first()[0] or 0) > 1:
        rows = entries.withColumn("block", F.shiftright("i", BITS * HEIGHT))
        made = rows.repartition("g", "block").sortWithinPartitions("g", "block", "i").mapInArrow(_make_nodes, NODES)
        strata.append(work.write(made, f"{name}{len(strata)}"))
        entries = strata[-1].filter("level = 0").select("g", "n", "i", "digest")
    return strata, entries


class _Blocks:
    """Whole blocks of a stratum: the row of the path above (kind 0), nodes (kind 1) and entries (kind 2)."""

    def __init__(self, t: pa.Table):
        g, block, kind = _longs(t, "g"), _longs(t, "block"), _longs(t, "kind")
        number = np.cumsum(np.r_[True, (g[1:] != g[:-1]) | (block[1:] != block[:-1])]) - 1
        self.above = t.filter(pa.array(kind == 0)).column("steps").to_pylist()
        nodes = t.filter(pa.array(kind == 1))
        of, level, i = number[kind == 1], _longs(nodes, "level"), _longs(nodes, "i")
        raw, ends = _bytes(nodes.column("states"))
        self.states, self.start, self.count = sha256.from_bytes(raw), ends[:-1] // 32, np.diff(ends) // 32
        self.children = _bytes(nodes.column("children"))[0].reshape(-1, 32)
        self.first, self.base = np.full((len(self.above), HEIGHT + 1), -1), np.zeros((len(self.above), HEIGHT + 1), np.int64)
        self.first[of[::-1], level[::-1]] = np.arange(len(of))[::-1]  # the first of each level stays
        self.base[of[::-1], level[::-1]] = i[::-1]
        self.entries = t.filter(pa.array(kind == 2))
        self.of, self.i = number[kind == 2], _longs(self.entries, "i")

    def parents(self):
        """By level: the entries that have a parent there, the parent's number and their slot in it."""
        for level in range(1, HEIGHT + 1):
            has = np.flatnonzero(self.first[self.of, level] >= 0)
            of, i = self.of[has], self.i[has]
            yield has, self.first[of, level] + (i >> BITS * level) - self.base[of, level], (i >> BITS * (level - 1)) & FAN - 1


def _resume(state, digests, right, first, more, blocks):
    """Digests of parents whose hash goes on from ``state`` with ``digests`` and then ``more`` rows of ``right`` from ``first`` on."""
    state = sha256.absorb(state, sha256.hex_block(digests))
    for k in range(FAN - 1):
        has = np.flatnonzero(more > k)
        if not len(has):
            break
        state[has] = sha256.absorb(state[has], sha256.hex_block(right[first[has] + k]))
    return sha256.finish(state, blocks)


def _paths(batches):
    """``(g, i, steps)``: the path of each entry to the root, nearest parent first."""
    for t in _whole_blocks(batches):
        b = _Blocks(t)
        steps: list[list] = [[] for _ in b.i]
        for has, node, slot in b.parents():
            for x, k, s in zip(has.tolist(), node.tolist(), slot.tolist()):
                at, end = b.start[k], b.start[k] + b.count[k]
                steps[x].append({"slot": s, "state": sha256.to_bytes(b.states[at + s][None]).tobytes(), "left": b.children[at : at + s].tobytes(), "right": b.children[at + s + 1 : end].tobytes()})
        for x, k in enumerate(b.of.tolist()):
            steps[x] += b.above[k]
        kind = pa.list_(pa.struct([("slot", pa.int32()), ("state", pa.binary()), ("left", pa.binary()), ("right", pa.binary())]))
        yield pa.RecordBatch.from_arrays([b.entries.column("g").combine_chunks(), b.entries.column("i").combine_chunks(), pa.array(steps, kind)], ["g", "i", "steps"])


def _fold_batches(keep: list[str], siblings: bool):
    def run(batches):
        for t in _whole_blocks(batches):
            b = _Blocks(t)
            cur = _bytes(b.entries.column("digest"))[0].reshape(-1, 32).copy()
            beside: list[list] = [[] for _ in b.i]
            text = sha256.hex_bytes(b.children)
            for has, node, slot in b.parents():
                at, count = b.start[node], b.count[node]
                cur[has] = _resume(b.states[at + slot], cur[has], b.children, at + slot + 1, count - slot - 1, count)
                for x, lo, own, hi in zip(has.tolist(), (64 * at).tolist(), (64 * (at + slot)).tolist(), (64 * (at + count)).tolist()):
                    beside[x] += text[lo:own], text[own + 64 : hi]
            # the steps above, of all blocks side by side
            sizes = np.array([len(s) for s in b.above], np.int64)
            begin, steps = np.cumsum(sizes) - sizes, [s for own in b.above for s in own]
            state = sha256.from_bytes(np.frombuffer(b"".join(s["state"] for s in steps), np.uint8))
            right = np.frombuffer(b"".join(s["right"] for s in steps), np.uint8).reshape(-1, 32)
            more = np.array([len(s["right"]) // 32 for s in steps], np.int64)
            first, slots = np.cumsum(more) - more, np.array([s["slot"] for s in steps], np.int64)
            for k in range(int(sizes.max(initial=0))):
                has = np.flatnonzero(sizes[b.of] > k)
                at = begin[b.of[has]] + k
                cur[has] = _resume(state[at], cur[has], right, first[at], more[at], slots[at] + 1 + more[at])
            upper = [b"".join((s["left"] + s["right"]).hex().encode() for s in own) for own in b.above]
            proofs = []
            for pieces, k in zip(beside, b.of.tolist()):
                proofs.append(b"".join([*pieces, upper[k]]))
            arrays = [*(b.entries.column(c).combine_chunks() for c in ("g", *keep)), pa.array(sha256.hex_strings(cur)), pa.array([hashlib.sha256(p).hexdigest() for p in proofs])]
            yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(proofs).cast(pa.string())] * siblings], ["g", *keep, "folded_root", "proof_sha256", *["siblings"] * siblings])

    return run


@dataclass
class Manifest:
    """``leaves`` (the rows' kept columns, ``group``, ``leaf``, ``g``, ``n``, ``i``), tables of nodes with the states before each
    child, lowest stratum first, the groups' roots ``(g, subroot)`` and the root in hex (None without rows)."""

    leaves: DataFrame
    keep: list[str]
    strata: list[DataFrame]
    top: list[DataFrame]
    subroots: DataFrame
    root: str | None
    work: Scratch = field(repr=False)

    def _above(self, nodes: DataFrame, headers: DataFrame, entries: DataFrame) -> DataFrame:
        """Rows of a stratum's blocks, each block together, for ``_Blocks``."""
        block = F.shiftright("i", BITS * HEIGHT).alias("block")
        kind = lambda k: F.lit(k).alias("kind")
        rows = headers.select("g", F.col("i").alias("block"), kind(0), F.lit(0).alias("level"), "i", "steps")
        rows = rows.unionByName(nodes.filter("level > 0").select("g", "block", kind(1), "level", "i", "states", "children"), allowMissingColumns=True)
        rows = rows.unionByName(entries.select("*", block, kind(2), F.lit(0).alias("level")), allowMissingColumns=True)
        return rows.repartition("g", "block").sortWithinPartitions("g", "block", "kind", "level", "i")

    def headers(self) -> DataFrame:
        """``(g, i, steps)``: for each block of leaves the path above it."""
        spark = self.leaves.sparkSession
        out = spark.createDataFrame([(0, 0, [])], f"g long, i long, steps {STEPS}")
        groups = self.subroots.select(F.lit(0).cast("long").alias("g"), (F.col("g") - 1).alias("i"))
        for s in reversed(range(len(self.top))):
            entries = self.top[s - 1].filter("level = 0").select("g", "i") if s else groups
            out = self.work.write(self._above(self.top[s], out, entries).mapInArrow(_paths, f"g long, i long, steps {STEPS}"), f"above-top{s}")
        out = out.select((F.col("i") + 1).alias("g"), F.lit(0).cast("long").alias("i"), "steps")
        for s in reversed(range(1, len(self.strata))):
            entries = self.strata[s - 1].filter("level = 0").select("g", "i")
            out = self.work.write(self._above(self.strata[s], out, entries).mapInArrow(_paths, f"g long, i long, steps {STEPS}"), f"above{s}")
        return out

    def fold(self, seen: DataFrame | None = None, siblings: bool = False) -> DataFrame:
        """What root follows when single rows are as ``seen`` says, each by itself: ``keep``, ``leaf``, ``subroot``, ``root``,
        ``proof_sha256``, ``folded_root``, ``verified``, with ``siblings`` their digests as text, level by level. ``seen`` has rows of
        ``leaves``, any of them, and the digest seen now in hex in column ``seen``; without it the leaves themselves are folded."""
        rows = self.leaves.withColumn("seen", F.col("leaf")) if seen is None else seen
        kept = [*self.keep, "leaf"]
        entries = rows.select("g", "i", *(F.col(c).alias(f"_{k}") for k, c in enumerate(kept)), F.unhex("seen").alias("digest"))
        nodes = self.strata[0] if self.strata else self.leaves.sparkSession.createDataFrame([], NODES)
        source = self._above(nodes, self.headers(), entries)
        names = [f"_{k}" for k in range(len(kept))]
        fields = [T.StructField("g", T.LongType()), *(source.schema[c] for c in names), T.StructField("folded_root", T.StringType()), T.StructField("proof_sha256", T.StringType())]
        out = source.mapInArrow(_fold_batches(names, siblings), T.StructType(fields + [T.StructField("siblings", T.StringType())] * siblings))
        root = F.lit(self.root).cast("string")
        out = out.join(self.subroots, "g").withColumn("root", root).withColumn("verified", F.col("folded_root") == root)
        return out.select(*(F.col(n).alias(c) for n, c in zip(names, kept)), "subroot", "root", "proof_sha256", "folded_root", "verified", *["siblings"] * siblings)


def build_manifest(rows: DataFrame, group: str, order: str, leaf: Column, keep: list[str]) -> Manifest:
    """A manifest of all rows, those of a group (null first, then bytewise) by ``order`` (null first), equal ones by their digest.

    ``leaf`` is a digest in hex. A lone leaf is its group's root, and a lone group's root the root; an empty table has neither. Equal rows are
    leaves of their own. Only ``keep``, ``group`` and ``order`` are read beside the leaf, whatever other columns are called.
    Columns of ``keep`` named as the new ones are refused.
    """
    new = {"leaf", "g", "n", "i", "seen", "subroot", "root", "proof_sha256", "folded_root", "verified", "siblings", "_group", "_order"}
    if clash := new & set(keep):
        raise ValueError(f"keep already has {sorted(clash)}")
    work = Scratch(rows.sparkSession, "manifest")
    table = work.write(rows.select(*keep, F.col(group).alias("_group"), F.col(order).alias("_order"), leaf.alias("leaf")), "rows")
    leaves = work.write(number_rows(table, "_group", ["_order", "leaf"], work), "leaves")
    strata, roots = _strata(leaves.select("g", "n", "i", F.unhex("leaf").alias("digest")), work, "stratum")
    roots = roots.select("g", "digest")
    n = roots.agg(F.max("g")).first()[0] or 0
    top, root = _strata(roots.select(F.lit(0).cast("long").alias("g"), F.lit(n).cast("long").alias("n"), (F.col("g") - 1).alias("i"), "digest"), work, "top")
    one = root.select(F.lower(F.hex("digest"))).first()
    return Manifest(leaves, keep, strata, top, roots.select("g", F.lower(F.hex("digest")).alias("subroot")), one[0] if one else None, work)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    leaf = leaf_digest(FIELDS)
    changed = leaf_digest({c: F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS})
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rows = docs.withColumn("_seen", F.when(tampered, changed).otherwise(leaf))
    made = build_manifest(rows, "lang", "doc_id", leaf, ["doc_id", "_seen"])
    return made.fold(made.leaves.withColumn("seen", F.col("_seen"))).drop("_seen")


def _level(k: int) -> str:
    """SQL of level k of all trees: nodes of the one below, eight by eight, while a tree has several."""
    return f"""
n{k} AS (SELECT tree, i // 8 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d, list(d ORDER BY i) AS kids FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM l{k - 1}) WHERE c > 1 GROUP BY tree, i // 8),
l{k} AS (SELECT tree, i, d FROM n{k} UNION ALL SELECT tree, i, d FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM l{k - 1}) WHERE c = 1)"""


def _tree(levels: int, leaves: str, at: str) -> str:
    """SQL of a forest over ``leaves(tree, i, d)``: by leaf, the lists of siblings and own places on its path."""
    made = ",".join(_level(k) for k in range(1, levels + 1))
    joins = "".join(f" LEFT JOIN n{k} ON n{k}.tree = l0.tree AND n{k}.i = l0.i // {8**k}" for k in range(1, levels + 1))
    lists = ", ".join(f"CASE WHEN n{k}.tree IS NOT NULL THEN {{'kids': n{k}.kids, 'slot': (l0.i // {8 ** (k - 1)}) % 8}} END" for k in range(1, levels + 1))
    return f"""
{at} AS (WITH l0 AS (SELECT tree, i, d FROM {leaves}), {made}
    SELECT l0.tree, l0.i, l{levels}.d AS top, list_filter([{lists}], lambda x: x IS NOT NULL) AS path FROM l0 JOIN l{levels} ON l{levels}.tree = l0.tree{joins})"""


def _sql(levels: int = 8) -> str:
    field = lambda c, v: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(({v})::VARCHAR) || ':' || {v} END"
    hashed = lambda text: "sha256(" + " || ".join(field(c, text if c == "text" else c) for c in FIELDS) + ")"
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT)),
        lambda s, b: list_reduce(list_prepend(xor(s, b), range(0, 8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT)"""
    others = "array_to_string(list_transform(list_filter(range(0, len(x.kids)), lambda k: k <> x.slot), lambda k: x.kids[k + 1]), '')"
    fold = "sha256(array_to_string(list_transform(range(0, len(x.kids)), lambda k: CASE WHEN k = x.slot THEN {own} ELSE x.kids[k + 1] END), ''))"
    steps = "p.path"
    folded = f"""list_reduce(list_prepend({{'d': seen, 'kids': []::VARCHAR[], 'slot': 0::BIGINT}}, list_transform({steps}, lambda y: {{'d': ''::VARCHAR, 'kids': y.kids, 'slot': y.slot::BIGINT}})),
        lambda s, x: {{'d': {fold.format(own='s.d')}, 'kids': []::VARCHAR[], 'slot': 0::BIGINT}}).d"""
    return f"""
WITH docs AS (SELECT *, {hashed('text')} AS leaf, {hashed(f"translate(text, '{UPPER}', '{LOWER}')")} AS bent, {crc} % 3 = 0 AS changed FROM documents),
ranked AS (SELECT doc_id, leaf, CASE WHEN changed THEN bent ELSE leaf END AS seen, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM docs),
leaves AS (SELECT tree, i, leaf AS d FROM ranked),
{_tree(levels, "leaves", "low")},
tops AS (SELECT DISTINCT 0 AS tree, tree - 1 AS i, top AS d FROM low),
{_tree(levels, "tops", "high")},
p AS (SELECT r.doc_id, r.leaf, r.seen, l.top AS subroot, h.top AS root, l.path || h.path AS path
    FROM ranked r JOIN low l ON r.tree = l.tree AND r.i = l.i JOIN high h ON h.i = r.tree - 1)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: {others}), '')) AS proof_sha256, {folded} AS folded_root, {folded} = root AS verified FROM p
"""


QUERIES = {"op13_manifest": op13_manifest}
ORACLES = {"op13_manifest": _sql()}
