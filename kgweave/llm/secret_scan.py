"""Secrets in whole texts: fixed patterns, and strings that a tokenizer's vocabulary finds costly.

A vocabulary of byte pairs is a model of ordinary text: words take few tokens, random characters many. A
candidate is a maximal run of ``MIN_CHARS`` or more key characters; it is reported (kind ``dense``) when it has
few characters for each of its tokens. A run that is not costly as a whole is tried in the parts between its
separators, so a key in a path is found. Published forms that look random but are no secrets are left out
first: hex digests of the usual lengths, UUIDs and plain numbers; further known strings go by a table
(``exclude_known``).

The texts are read once: the hex and access patterns only match inside candidates, and the assignment pattern is
tried only where one of its keywords stands. Work is by row, nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgweave.llm.caches import cache_of
from kgweave.llm.tokens import BYTE_BPE, slices, tokenizer_path

#: Kinds in the order in which they are listed where two spans start together.
KINDS = ("assign", "access", "hex", "dense")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 8, 16, 32
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
MIN_CHARS = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{MIN_CHARS},}}")
PART = re.compile("[A-Za-z0-9]+")
#: Most characters for each token. Strings of letters alone are held to a stricter ratio and to more characters,
#: as long compounds of a language that the vocabulary hardly knows come down to 1.6.
RATIO, LETTERS_RATIO, LETTERS_CHARS = 2.0, 1.5, 20
#: Forms that are published: digests (MD5, SHA-1, SHA-2), UUIDs, numbers.
KNOWN = re.compile(
    r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
    r"|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128}"
    r"|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[0-9/_+-]+)"
)
#: Characters encoded at once; a longer run is encoded in pieces, so its cost stays in proportion.
PIECE = 1024


def _encoding(name: str):
    held = cache_of("secrets")
    if name not in held:
        import public_tokenizers
        import tiktoken

        with open(tokenizer_path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        held[name] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return held[name]


def chars_per_token(s: str, encoding) -> float:
    return len(s) / sum(len(encoding.encode_ordinary(s[i : i + PIECE])) for i in range(0, len(s), PIECE))


def is_dense(s: str, encoding) -> bool:
    """Whether the string costs so many tokens that it is taken for random."""
    if len(s) < MIN_CHARS or KNOWN.fullmatch(s):
        return False
    if any("0" <= c <= "9" for c in s):
        return chars_per_token(s, encoding) <= RATIO
    return len(s) >= LETTERS_CHARS and chars_per_token(s, encoding) <= LETTERS_RATIO


def find_secrets(text: str, encoding) -> list[tuple[int, int, int]]:
    """``(start, end, kind)`` in code points, sorted; kind is a place in ``KINDS``. A dense string that overlaps
    a span of the patterns is left out, as it is reported already."""
    found = []
    raw = text.encode("utf-8", "surrogatepass").lower()
    if any(k in raw for k in KEYWORDS):
        found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    runs = [(m.start(), m[0]) for m in CANDIDATE.finditer(text)]
    for at, s in runs:
        found += [(at + m.start(), at + m.end(), 1) for m in ACCESS.finditer(s) if len(m[0]) >= ACCESS_CHARS]
        found += [(at + m.start(), at + m.end(), 2) for m in HEX.finditer(s) if len(m[0]) >= HEX_CHARS]
    if runs:
        base = sorted(found)
        taken, k, reach = [], 0, 0
        for at, s in runs:
            parts = [(at, s)] if is_dense(s, encoding) else []
            if not parts and not s.isalnum() and not KNOWN.fullmatch(s):
                parts = [(at + m.start(), m[0]) for m in PART.finditer(s) if is_dense(m[0], encoding)]
            for start, p in parts:
                end = start + len(p)
                while k < len(base) and base[k][0] < end:
                    reach = max(reach, base[k][1])
                    k += 1
                # spans that begin before this string's end: it is free of them if all end before it starts
                if reach <= start:
                    taken.append((start, end, 3))
        found += taken
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], x[2])))


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("secret", T.StringType())]))


def scan_secrets(docs: DataFrame, keep: list[str], text: str = "text", tokenizer: str = BYTE_BPE) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, ``n_assign``, ``n_access``, ``n_hex``, ``n_dense``,
    ``base_sha256`` (of the spans of the three patterns), ``spans`` (all spans as ``kind:start:end``) and ``found``
    (all spans with the string itself).

    Patterns match leftmost and without overlap within a kind; a match that is too short is dropped, with what it
    covers. Positions are code points, ends are exclusive. A null or empty text has no span; equal rows give equal
    rows; a very long run is encoded piece by piece. Columns of ``keep`` named as the new ones are refused.
    """
    new = [("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("n_dense", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType()), ("found", _SPANS)]
    if clash := ({n for n, _ in new} | {"_text"}) & set(keep):
        raise ValueError(f"keep already has {sorted(clash)}")
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string())]))

    def run(batches):
        encoding = _encoding(tokenizer)
        for b in slices(batches, "_text"):
            counts, shas, all_spans, lists = [], [], [], []
            for t in b.column("_text").to_pylist():
                spans = find_secrets(t, encoding) if t else []
                counts.append([sum(k == i for *_, k in spans) for i in range(len(KINDS))])
                shas.append(hashlib.sha256(joined([s for s in spans if s[2] < 3]).encode()).hexdigest())
                all_spans.append(joined(spans))
                lists.append([{"kind": KINDS[k], "start": a, "end": e, "secret": t[a:e]} for a, e, k in spans])
            arrays = [*(b.column(c) for c in keep), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))), pa.array(shas, pa.string()), pa.array(all_spans, pa.string()), pa.array(lists, found_type)]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *(n for n, _ in new)])

    out = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(*x) for x in new)])
    return docs.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, out)


def secret_rows(scanned: DataFrame, keep: list[str]) -> DataFrame:
    """One row per span of ``scan_secrets``: ``keep``, ``kind``, ``start``, ``end``, ``secret``."""
    return scanned.select(*keep, F.explode("found").alias("_s")).select(*keep, "_s.*")


def exclude_known(rows: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Rows of ``secret_rows`` without the dense strings that the table ``known`` lists (digests and identifiers of
    one's own: a manifest's digests, commit ids). Spans of the patterns stay; nulls in ``known`` match nothing."""
    listed = known.select(F.col(column).cast("string").alias("secret"), F.lit("dense").alias("kind")).distinct()
    return rows.join(listed, ["secret", "kind"], "left_anti").select(*rows.columns)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_secrets(docs, ["doc_id"]).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


QUERIES = {"op11_secret_scan": op11_secret_scan}
