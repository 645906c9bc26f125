"""Token ids of whole texts, for tokenizers that drop white space, and token counts by section.

``encode`` gives the ids that the tokenizer gives for the whole text. As its pieces never reach across white
space, every distinct word of a slice is looked up once among the words the worker remembers. Words it doesn't know
are cut into pieces (a run of letters, a digit, a run of other signs), and every distinct piece is encoded once and
remembered too. Beyond ``MEMO`` words those of the slice at hand stay; beyond ``MEMO`` pieces all go.

``count_tokens`` encodes each whole document once with a byte-level tokenizer. Token lengths give each token's
span in the text; a merge of these spans with the (sorted) sections of the document attributes each token, and
a stated rule decides for tokens that cross a boundary.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgweave.llm.caches import cache_of, trim

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"
MEMO, SLICE_BYTES = 400_000, 4 << 20
#: Words of these characters only: ASCII (but NUL) and the letters of Latin-1, which need no normal form.
SIMPLE = "^[\x01-\x7fÀ-ÖØ-öø-ÿ]*$"
#: The pieces of simple words (lower case) that the tokenizer's pattern gives; "\n" ends a word here.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^\na-z0-9ß-öø-ÿ]+")
#: The signs by which byte-level tokenizers write bytes, where these don't stand for themselves.
SIGNS = dict(zip([*range(33), *range(127, 161), 173], range(256, 512)))
END, WHOLE = -2, -3  # places of the end of a word, and of a word that stands whole


def tokenizer_path(name: str) -> str:
    """A path as it stands, else a file of the installed public tokenizers."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The concatenation of flat[start : start + size] over all pairs."""
    end = np.cumsum(size)
    return flat[np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)]


def strings(column: pa.Array) -> list[str | None]:
    """A string array as a list; far faster than one scalar at a time."""
    return column.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    def __init__(self, name: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        # special tokens stand for themselves wherever they occur; all begin alike
        self.mark = os.path.commonprefix([t.content for t in self.tokenizer.get_added_tokens_decoder().values()]) or None
        # a pattern, then the bytes as signs
        steps = json.loads(self.tokenizer.pre_tokenizer.__getstate__()).get("pretokenizers", []) if self.tokenizer.pre_tokenizer else []
        self.byte_level = [x["type"] for x in steps] == ["Split", "ByteLevel"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.words = None  # the words known, with where their ids begin and how many they are
        self.word_ids, self.word_start, self.word_count = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.clear()

    @classmethod
    def of(cls, name: str) -> WordEncoder:
        held = cache_of("words")
        if name not in held:
            held[name] = cls(name)
        return held[name]

    def clear(self) -> None:
        self.at: dict[str, int] = {"\n": END, "\0": WHOLE}
        self.flat, self.start, self.count = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, new: list[str], simple: int) -> None:
        """Encode new pieces; the first ``simple`` ones give tokens of which only the last ends a word. Words that
        stand whole are marked by a NUL in front."""
        if self.byte_level:
            # these need neither normal form nor pattern, so the model gets them at once
            tokenize, ids, sizes = self.tokenizer.model.tokenize, [], []
            for p in new[:simple]:
                got = tokenize(p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(SIGNS))
                ids += [x.id for x in got]
                sizes.append(len(got))
            ids, sizes = np.array(ids, self.dtype), np.array(sizes, np.int64)
        else:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new[:simple])], add_special_tokens=False)[0].ids, self.dtype)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != simple:
                simple, ids, cut = 0, ids[:0], cut[:0]
            sizes = np.diff(np.r_[0, cut])
        parts = [ids]
        if simple < len(new):
            got = [x.ids for x in self.tokenizer.encode_batch([p.removeprefix("\0") for p in new[simple:]], add_special_tokens=False)]
            parts += [np.array(x, self.dtype) for x in got]
            sizes = np.r_[sizes, [len(x) for x in got]]
        self.at |= zip(new, range(len(self.start), len(self.start) + len(new)))
        self.start = np.r_[self.start, len(self.flat) + np.cumsum(sizes) - sizes].astype(np.int64)
        self.count = np.r_[self.count, sizes].astype(np.int64)
        self.flat = np.concatenate([self.flat, *parts])

    def _places(self, pieces: list[str], simple: bool) -> np.ndarray:
        """Places in ``start`` and ``count`` of pieces, or of words that stand whole."""
        pieces = pieces if simple else [f"\0{p}" for p in pieces]
        place = np.fromiter(map(self.at.get, pieces, repeat(-1)), np.int64, len(pieces))
        if len(miss := np.flatnonzero(place == -1)):
            new = list(dict.fromkeys(pieces[i] for i in miss))
            self._learn(new, len(new) if simple else 0)
            place[miss] = np.fromiter((self.at[pieces[i]] for i in miss), np.int64, len(miss))
        return place

    def _spell(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some words, one after another, and how many each has."""
        if len(self.at) > MEMO:
            self.clear()
        simple = pc.match_substring_regex(distinct, SIMPLE)
        if self.mark:
            simple = pc.and_(simple, pc.invert(pc.match_substring(distinct, self.mark)))
        whole = strings(distinct.filter(pc.invert(simple)))
        names = strings(pc.if_else(simple, distinct, "\0") if whole else distinct)
        place = self._places(PIECES.findall("\n".join([*names, ""]).lower()), True)
        if whole:
            place[place == WHOLE] = self._places(whole, False)
        is_end = place == END
        size = np.where(is_end, 0, self.count[np.maximum(place, 0)]) if len(self.count) else np.zeros(len(place), np.int64)
        ids = gather(self.flat, self.start[place[~is_end]], size[~is_end])
        return ids, np.diff(np.r_[0, np.cumsum(size)[is_end]])

    def _word_places(self, distinct: pa.Array) -> np.ndarray:
        """Places of distinct words in ``word_start`` and ``word_count``; new ones are added."""
        known = distinct.slice(0, 0) if self.words is None else self.words
        place = pc.fill_null(pc.index_in(distinct, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        miss = np.flatnonzero(place < 0)
        if len(miss) and len(known) + len(miss) > MEMO:
            hit = np.flatnonzero(place >= 0)
            at, known = place[hit], distinct.take(pa.array(hit))
            self.word_ids, self.word_count = gather(self.word_ids, self.word_start[at], self.word_count[at]), self.word_count[at]
            self.word_start = np.cumsum(self.word_count) - self.word_count
            place[hit] = np.arange(len(hit))
        if len(miss):
            new = distinct.take(pa.array(miss))
            ids, size = self._spell(new)
            place[miss] = len(known) + np.arange(len(miss))
            self.word_start = np.r_[self.word_start, len(self.word_ids) + np.cumsum(size) - size].astype(np.int64)
            self.word_ids, self.word_count = np.r_[self.word_ids, ids], np.r_[self.word_count, size]
            known = pa.concat_arrays([known, new])
        self.words = known
        return place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string array, one text after another, and how many each text has (a null one: 0)."""
        words = pc.ascii_split_whitespace(texts)
        per_text = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        place = self._word_places(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        size = self.word_count[place]
        per_word = np.r_[0, np.cumsum(size)]
        return gather(self.word_ids, self.word_start[place], size), np.diff(per_word[np.r_[0, np.cumsum(per_text)]])


def slices(batches, column: str, size: int = SLICE_BYTES):
    """Rows of the batches in slices of about ``size`` bytes of a string column."""
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + size, "right")))
            yield b.slice(at, to - at)
            at = to
    trim()


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Character spans of the lines of a text, each with the line break that ends it; a text has one at least."""
    ends = [i + 1 for i, c in enumerate(text) if c == "\n"] if "\n" in text else []
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return list(zip([0, *ends], ends))


def attribute(token_ends: np.ndarray, section_starts: np.ndarray, section_ends: np.ndarray, rule: str = "majority") -> np.ndarray:
    """Tokens of each section, from byte positions of one text. ``token_ends`` rises; sections are sorted and
    disjoint. A token that crosses a boundary goes by ``rule``: ``start`` (the section of its first byte), ``end``
    (of its last byte), ``majority`` (the section with most of its bytes, the earlier in a tie) or ``split``
    (to each section its share of the token's bytes). Tokens outside all sections count for none."""
    n = len(section_starts)
    if not len(token_ends):
        return np.zeros(n)
    starts = np.r_[0, token_ends[:-1]]
    if rule in ("start", "end"):
        at = starts if rule == "start" else token_ends - 1
        i = np.searchsorted(section_starts, at, "right") - 1
        # an empty section starts where the next one does and holds nothing
        ok = (i >= 0) & (at < section_ends[np.maximum(i, 0)])
        return np.bincount(i[ok], minlength=n).astype(np.float64)
    first = np.maximum(np.searchsorted(section_ends, starts, "right"), 0)
    last = np.searchsorted(section_starts, token_ends, "left") - 1
    width = np.maximum(0, last - first + 1)
    token = np.repeat(np.arange(len(starts)), width)
    section = np.repeat(first, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    share = np.minimum(token_ends[token], section_ends[section]) - np.maximum(starts[token], section_starts[section])
    token, section, share = token[share > 0], section[share > 0], share[share > 0]
    if rule == "split":
        return np.bincount(section, share / (token_ends - starts)[token], n)
    if rule != "majority":
        raise ValueError(f"no rule named {rule}")
    order = np.lexsort((section, -share, token))
    best = order[np.r_[True, token[order][1:] != token[order][:-1]]] if len(order) else order
    return np.bincount(section[best], minlength=n).astype(np.float64)


def _byte_encoding(name: str):
    held = cache_of("bytes")
    if name not in held:
        import public_tokenizers
        import tiktoken

        with open(tokenizer_path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            sizes[i] = len(token)
        held[name] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return held[name]


def count_tokens(
    docs: DataFrame, keep: list[str], text: str = "text", sections: Callable[[str], list[tuple[int, int]]] = paragraphs, rule: str = "majority", tokenizer: str = BYTE_BPE
) -> DataFrame:
    """One row per section of every text: ``keep``, ``section``, ``start``, ``end`` (characters), ``n_tokens``, ``doc_tokens``.

    ``sections`` gives sorted, disjoint character spans of a text. ``n_tokens`` is a double: whole numbers but for
    the rule ``split``. A null text counts as empty. Every text is encoded once and whole, so a token's pieces
    never depend on the sections. Equal rows give equal rows. Columns of ``keep`` named as the new ones are refused.
    """
    if clash := {"section", "start", "end", "n_tokens", "doc_tokens", "_text"} & set(keep):
        raise ValueError(f"keep already has {sorted(clash)}")

    def run(batches):
        encoding, sizes = _byte_encoding(tokenizer)
        for b in slices(batches, "_text"):
            rows, cols = [], []
            for i, t in enumerate(b.column("_text").to_pylist()):
                t = t or ""
                spans = sections(t)
                ends = np.cumsum(sizes[np.array(encoding.encode_ordinary(t), np.int64)])
                lo, hi = np.array([s[0] for s in spans], np.int64), np.array([s[1] for s in spans], np.int64)
                place = lo, hi
                if not t.isascii():
                    u = np.frombuffer(t.encode(), np.uint8)
                    byte = np.r_[np.flatnonzero((u & 0xC0) != 0x80), len(u)]
                    place = byte[lo], byte[hi]
                n = attribute(ends, *place, rule)
                rows += [i] * len(spans)
                cols.append((np.arange(len(spans)), lo, hi, n, np.full(len(spans), len(ends))))
            kept = pa.Table.from_batches([b]).select(keep).take(pa.array(rows, pa.int64())) if rows else None
            if kept is not None:
                s, lo, hi, n, total = (np.concatenate(c) for c in zip(*cols))
                arrays = [*(kept.column(c).combine_chunks() for c in keep), pa.array(s.astype(np.int32)), pa.array(lo), pa.array(hi), pa.array(n), pa.array(total.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, "section", "start", "end", "n_tokens", "doc_tokens"])

    new = [("section", T.IntegerType()), ("start", T.LongType()), ("end", T.LongType()), ("n_tokens", T.DoubleType()), ("doc_tokens", T.LongType())]
    out = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(*x) for x in new)])
    return docs.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, out)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, ["doc_id"]).withColumn("n_tokens", F.col("n_tokens").cast("long"))


QUERIES = {"op4_token_counts": op4_token_counts}
