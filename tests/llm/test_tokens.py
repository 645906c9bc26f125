import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from kgweave.llm import materialise as m
from kgweave.llm import tokens as t
from kgweave.llm.packing import WINDOW, op8_packing
from kgweave.llm.simhash import near_duplicates
from kgweave.plans.scratch import Scratch

TEXTS = ["", None, "  a\n", "<|endoftext|>foo <|ENDOFTEXT|>", "don't WE'LL 'tis 12 3,4 x y É́é ΣΑΣ", "\x1c a\x1cb \x85q", "日本語 テキスト", "a" * 3000, "\x00 z", "!!!...'s's", "Größe naïve ŒUVRE µ"]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(t.tokenizer_path(t.WORD_BPE))


def ids_of(whole, text):
    return whole.encode(text or "", add_special_tokens=False).ids


def test_encoder_gives_whole_text_ids(whole):
    ids, n = t.WordEncoder.of(t.WORD_BPE).encode(pa.array(TEXTS * 2, pa.string()))
    parts = np.split(ids, np.cumsum(n)[:-1])
    assert [p.tolist() for p in parts] == [ids_of(whole, x) for x in TEXTS] * 2
    assert t.WordEncoder.of(t.WORD_BPE).encode(pa.array([], pa.string()))[0].size == 0


def test_known_words_are_not_cut_again(monkeypatch):
    class Counting:
        def __init__(self, pattern):
            self.pattern, self.words = pattern, 0

        def findall(self, text):
            self.words += text.count("\n")
            return self.pattern.findall(text)

    cut = Counting(t.PIECES)
    monkeypatch.setattr(t, "PIECES", cut)
    encoder = t.WordEncoder(t.WORD_BPE)
    first = encoder.encode(pa.array(["some words, some more", "Größe naïve"]))
    assert cut.words == 5
    again = encoder.encode(pa.array(["some words, some more", "Größe naïve"]))
    assert cut.words == 5 and again[0].tolist() == first[0].tolist() and again[1].tolist() == first[1].tolist()


@pytest.mark.parametrize("memo", [1, 60])
def test_ids_when_little_is_remembered(whole, monkeypatch, memo):
    monkeypatch.setattr(t, "MEMO", memo)
    encoder, rng = t.WordEncoder(t.WORD_BPE), np.random.default_rng(3)
    for _ in range(30):
        texts = [" ".join(f"{'wörd' if x % 2 else 'it\'s'}{x}\x7f" for x in rng.integers(0, 80, 12)), TEXTS[rng.integers(len(TEXTS))]]
        ids, n = encoder.encode(pa.array(texts, pa.string()))
        assert [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])] == [ids_of(whole, x) for x in texts]


def brute_attribute(ends, spans, rule):
    out, start = [0.0] * len(spans), 0
    for end in ends:
        share = [len(set(range(start, end)) & set(range(a, z))) for a, z in spans]
        if rule == "split":
            out = [o + s / (end - start) for o, s in zip(out, share)]
        elif any(share):
            if rule == "majority":
                out[share.index(max(share))] += 1
            else:
                at = start if rule == "start" else end - 1
                for i, (a, z) in enumerate(spans):
                    out[i] += a <= at < z
        start = end
    return out


@pytest.mark.parametrize("rule", ["start", "end", "majority", "split"])
def test_attribution(rule):
    rng = np.random.default_rng(1)
    for _ in range(200):
        ends = np.cumsum(rng.integers(1, 5, rng.integers(1, 12)))
        cuts = np.sort(rng.integers(0, ends[-1] + 1, 2 * rng.integers(1, 4)))
        spans = list(zip(cuts[::2].tolist(), cuts[1::2].tolist()))
        got = t.attribute(ends, cuts[::2], cuts[1::2], rule)
        assert np.allclose(got, brute_attribute(ends.tolist(), spans, rule)), (ends, spans)


def test_counts_sum_to_the_whole_text(spark, odd, nothing, sf):
    encoding, _ = t._byte_encoding(t.BYTE_BPE)
    out = t.op4_token_counts(spark, sf(odd)).collect()
    total = {}
    for r in out:
        total[r.doc_id, r.doc_tokens] = total.get((r.doc_id, r.doc_tokens), 0) + r.n_tokens
    want = [(r.doc_id, len(encoding.encode_ordinary(r.text or ""))) for r in odd.collect()]
    for key in set(want):
        assert total[key] == key[1] * want.count(key)
    assert t.op4_token_counts(spark, sf(nothing)).count() == 0


def check_packing(rows, docs, whole):
    want = sorted(((d, ids_of(whole, x) + [2]) for d, x in docs), key=str)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0, *(r.length for r in s)])[:-1].tolist()
        n = sum(r.length for r in s)
        assert n == WINDOW or n & (n - 1) == 0
    assert sum(r.length for r in rows) == sum(len(i) for _, i in want)
    by_doc = {}
    for d, ids in want:
        by_doc.setdefault((d, len(ids)), []).append(ids)
    for (d, n), copies in by_doc.items():
        mine = [r for r in rows if r.doc_id == d and r.doc_tokens == n]
        for r in mine:
            assert any(zlib.crc32(np.array(c[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for c in copies)
        cover = np.zeros(n, int)
        for r in mine:
            cover[r.start : r.start + r.length] += 1
        assert (cover == len(copies)).all()


def test_packing(spark, odd, nothing, sf, whole):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    check_packing(op8_packing(spark, sf(odd)).collect(), docs, whole)
    assert op8_packing(spark, sf(nothing)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_feistel_is_a_permutation(n):
    x = np.arange(n)
    slots = m.feistel(x, n)
    assert sorted(slots) == x.tolist()
    assert n < 64 or (slots != m.feistel(x, n, key=1)).any()


def test_round_trip(spark, odd, nothing, whole):
    root = Scratch(spark, "order").path
    rows = m.materialise(odd.coalesce(1), root, length=64, shard_bytes=64 * 2 * 10).collect()
    n = len(rows)
    assert sorted(r.slot for r in rows) == list(range(n)) == sorted(r.number for r in rows)
    back = m.read_slots(root, 0, n, 64, shard_bytes=64 * 2 * 10)
    assert (m.read_slots(root, 5, 20, 64, shard_bytes=64 * 2 * 10) == back[5:25]).all()
    rows.sort(key=lambda r: r.number)
    stream = np.concatenate([back[r.slot][: r.n_ids] for r in rows]).tolist()
    assert stream == [i for r in odd.coalesce(1).collect() for i in ids_of(whole, r.text) + [2]]
    for r in rows:
        assert zlib.crc32(back[r.slot].astype("<u2").tobytes()) == r.crc32 and (r.shard, r.byte_offset) == (r.slot // 10, r.slot % 10 * 128)
    assert m.materialise(nothing, Scratch(spark, "order").path).count() == 0


def test_names_that_clash_are_refused(spark):
    df = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, section int")
    with pytest.raises(ValueError):
        t.count_tokens(df, ["doc_id", "section"])
    with pytest.raises(ValueError):
        near_duplicates(df.withColumnRenamed("section", "fp"), carry=("fp",))
