"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads a text as its bytes, ASCII letters folded to lower case. A GRU runs over them in each direction;
at every position a softmax over both states gives the probabilities of the languages. A document's probabilities
are the mean of those of all its positions. So that positions of one text are computed side by side, a text is read
in spans of ``SPAN`` positions, each with ``CONTEXT`` bytes more on either side from which the states start; bytes
beyond the ends of a text are 0. Every position is labelled once, and nothing else of the batch takes part in it.

Training is in numpy by backpropagation through time, on the driver, from a bounded sample: the documented
``DOCS`` documents and ``WINDOWS`` windows of ``SPAN_TRAIN`` bytes for each language, chosen by a hash from all
positions of those documents, and cut as the texts are cut for prediction.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgweave.llm.caches import cache_of, trim

DOCS, WINDOWS, SPAN_TRAIN = 300, 3000, 64
HIDDEN, STEPS, BATCH, RATE, SEED = 8, 250, 128, 0.02, 5
SPAN, CONTEXT, ROWS, SLICE = 256, 12, 1024, 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spans(texts: list[bytes], span: int = SPAN, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (row, context + span + context) of the spans of all texts, the text of each row, and how many of its positions are real."""
    size = np.array([len(t) for t in texts], np.int64)
    rows = -(-size // span)
    owner = np.repeat(np.arange(len(texts)), rows)
    at = (np.arange(len(owner)) - np.repeat(np.cumsum(rows) - rows, rows)) * span
    # every text with zeros around it, side by side
    gap = context + span
    start = np.cumsum(size + 2 * gap) - size - gap
    flat = np.zeros(int((size + 2 * gap).sum()), np.uint8)
    for t, s in zip(texts, start):
        flat[s : s + len(t)] = np.frombuffer(t, np.uint8)
    first = start[owner] + at - context
    raw = flat[first[:, None] + np.arange(span + 2 * context)[None, :]] if len(owner) else np.zeros((0, span + 2 * context), np.uint8)
    return raw, owner, np.minimum(span, size[owner] - at)


class ByteGru:
    """Weights of the two directions and the output layer; ``langs`` names the columns of the result."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.langs = langs
        init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.w = {}
        for d in "fb":
            # input rows by byte value: reset, update and candidate gate side by side
            self.w |= {f"x{d}": (rng.normal(0, 0.3, (256, 3 * hidden))).astype(np.float32), f"u{d}": init(hidden, 2 * hidden), f"c{d}": init(hidden, hidden)}
        self.w |= {"o": init(2 * hidden, len(langs)), "ob": np.zeros(len(langs), np.float32)}

    def states(self, raw: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (position, row, hidden)."""
        u, c, x_of = self.w[f"u{d}"], self.w[f"c{d}"], self.w[f"x{d}"]
        n = len(c)
        h = np.zeros((len(raw), n), np.float32)
        out = np.empty((raw.shape[1], len(raw), n), np.float32)
        columns = np.ascontiguousarray(raw.T)
        for t in range(raw.shape[1]) if d == "f" else range(raw.shape[1] - 1, -1, -1):
            x = x_of.take(columns[t], 0)
            g = h @ u
            g += x[:, : 2 * n]
            g *= 0.5
            np.tanh(g, g)
            g *= 0.5
            g += 0.5  # the logistic function
            r, z = g[:, :n], g[:, n:]
            cand = (r * h) @ c
            cand += x[:, 2 * n :]
            np.tanh(cand, cand)
            if keep is not None:
                keep.append((t, h, r, z, cand))
            h = np.add(cand, z * (h - cand), out=out[t])
        return out

    def _forward(self, columns: np.ndarray, d: str) -> np.ndarray:
        """The same states as (position, hidden, row): rows lie side by side, and the halves of the logistic function are in the weights."""
        n = len(self.w[f"c{d}"])
        half = np.r_[np.full(2 * n, 0.5), np.ones(n)].astype(np.float32)
        x_of = np.ascontiguousarray((self.w[f"x{d}"] * half).T)
        u, c = np.ascontiguousarray(self.w[f"u{d}"].T * np.float32(0.5)), np.ascontiguousarray(self.w[f"c{d}"].T * np.float32(0.5))
        h = np.zeros((n, columns.shape[1]), np.float32)
        out = np.empty((len(columns), *h.shape), np.float32)
        for t in range(len(columns)) if d == "f" else range(len(columns) - 1, -1, -1):
            x = x_of.take(columns[t], 1)
            g = u @ h
            g += x[: 2 * n]
            np.tanh(g, g)
            g += 1
            r, z = g[:n], g[n:]
            r *= h
            cand = c @ r
            cand += x[2 * n :]
            np.tanh(cand, cand)
            h = np.subtract(h, cand, out=out[t])
            h *= z
            h *= 0.5
            h += cand
        return out

    def probs(self, raw: np.ndarray, context: int = CONTEXT) -> np.ndarray:
        """Probabilities of the languages at every position between the contexts: (position, language, row)."""
        columns, n = np.ascontiguousarray(raw.T), len(self.w["cf"])
        y = np.matmul(self.w["o"][:n].T, self._forward(columns, "f")[context : len(columns) - context])
        y += np.matmul(self.w["o"][n:].T, self._forward(columns, "b")[context : len(columns) - context])
        y += self.w["ob"][:, None]
        y -= y.max(1, keepdims=True)
        np.exp(y, y)
        y /= y.sum(1, keepdims=True)
        return y

    def _softmax(self, both: list[np.ndarray]) -> np.ndarray:
        n = both[0].shape[2]
        y = both[0] @ self.w["o"][:n]
        y += both[1] @ self.w["o"][n:]
        y += self.w["ob"]
        y -= y.max(2, keepdims=True)
        np.exp(y, y)
        y /= y.sum(2, keepdims=True)
        return y

    def gradients(self, raw: np.ndarray, real: np.ndarray, label: np.ndarray, context: int = CONTEXT) -> tuple[float, dict]:
        """Mean cross entropy over the real positions and its gradients, by backpropagation through time."""
        tape = {d: [] for d in "fb"}
        both = [self.states(raw, d, tape[d]) for d in "fb"]
        y = self._softmax(both)
        at = np.arange(raw.shape[1])[:, None] - context
        live = (at >= 0) & (at < real[None, :])
        m = (live / live.sum())[:, :, None].astype(np.float32)
        loss = -(np.log(y[:, np.arange(len(label)), label] + 1e-12) * m[:, :, 0]).sum()
        dy = y
        dy[:, np.arange(len(label)), label] -= 1
        dy *= m
        states, n = np.concatenate(both, 2), both[0].shape[2]
        g = {"o": np.tensordot(states, dy, ((0, 1), (0, 1))), "ob": dy.sum((0, 1))}
        dboth = dy @ self.w["o"].T
        for k, d in enumerate("fb"):
            u, c = self.w[f"u{d}"], self.w[f"c{d}"]
            gx, gu, gc = np.zeros_like(self.w[f"x{d}"]), np.zeros_like(u), np.zeros_like(c)
            dh = np.zeros((len(raw), n), np.float32)
            inputs, places = [], []
            for t, h, r, z, cand in reversed(tape[d]):
                dh = dh + dboth[t, :, k * n : (k + 1) * n]
                dcand = dh * (1 - z) * (1 - cand * cand)
                drh = dcand @ c.T
                dgate = np.concatenate([drh * h * r * (1 - r), dh * (h - cand) * z * (1 - z)], 1)
                gc += (r * h).T @ dcand
                gu += h.T @ dgate
                inputs.append(np.concatenate([dgate, dcand], 1))
                places.append(raw[:, t])
                dh = dh * z + drh * r + dgate @ u.T
            inputs, places = np.concatenate(inputs), np.concatenate(places)
            for j in range(3 * n):
                gx[:, j] = np.bincount(places, inputs[:, j], 256)
            g |= {f"x{d}": gx, f"u{d}": gu, f"c{d}": gc}
        return float(loss), g

    def train(self, windows: list[bytes], label: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED, span: int = SPAN_TRAIN) -> ByteGru:
        """Adam on random batches of windows."""
        rng = np.random.default_rng(seed)
        raw, owner, real = spans(windows, span)
        label = label[owner]
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        for step in range(1, steps + 1):
            pick = rng.choice(len(raw), min(batch, len(raw)), replace=False)
            _, g = self.gradients(raw[pick], real[pick], label[pick])
            lr = rate * (1 - step / (steps + 1)) ** 0.5
            for k in self.w:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] * g[k] - v[k])
                self.w[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all positions of each text: (text, language); zeros for an empty text."""
        raw, owner, real = spans(texts)
        out = np.zeros((len(texts), len(self.langs)))
        for i in range(0, len(raw), ROWS):
            z = min(i + ROWS, len(raw))
            p = self.probs(raw[i:z])
            p *= (np.arange(SPAN)[:, None] < real[None, i:z])[:, None, :]
            np.add.at(out, owner[i:z], p.sum(0, dtype=np.float64).T)
        return out / np.maximum(1, [len(t) for t in texts])[:, None]

    def digest(self) -> str:
        return hashlib.sha256(b"".join(self.w[k].tobytes() for k in sorted(self.w)) + repr(self.langs).encode()).hexdigest()


def train_model(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", docs: int = DOCS, windows: int = WINDOWS) -> ByteGru | None:
    """Fit on at most ``docs`` documents and ``windows`` windows of each language; None without labelled text that has a byte."""
    rows = labelled.filter(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(doc_id).alias("_id"), F.col(lang).cast("string").alias("_lang"), F.col(text).cast("string").alias("_text"))
    rank = F.row_number().over(W.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id"))
    ids = rows.select("_id", "_lang").withColumn("_r", rank).filter(F.col("_r") <= docs).select("_id").distinct()
    # at most ``docs`` ids of each language, hence safe to broadcast
    some = rows.join(F.broadcast(ids), "_id").withColumn("_b", F.encode(F.translate("_text", UPPER, LOWER), "UTF-8"))
    last = F.ceil(F.octet_length("_b") / SPAN_TRAIN).cast("int") - 1
    cut = some.select("_lang", "_id", "_b", F.explode(F.sequence(F.lit(0), last)).alias("_pos"))
    at = F.row_number().over(W.partitionBy("_lang").orderBy("_h", "_pos"))
    cut = cut.select("_lang", F.xxhash64("_id", "_pos").alias("_h"), "_pos", F.substring("_b", F.col("_pos") * SPAN_TRAIN + 1, F.lit(SPAN_TRAIN)).alias("_w"))
    # ``windows`` of each language
    got = cut.withColumn("_r", at).filter(F.col("_r") <= windows).select("_lang", "_w").collect()
    langs = sorted({r._lang for r in got})
    if not langs:
        return None
    got.sort()
    return ByteGru(langs).train([bytes(r._w) for r in got], np.array([langs.index(r._lang) for r in got]))


def identify_languages(docs: DataFrame, model: ByteGru | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``lang_pred`` and ``score``, row by row; equal rows get equal results.

    ``score`` is the mean probability of ``lang_pred`` over all positions of the text. ``lang_pred`` is ``und`` with score 0 where the
    text is null or holds no letter, and everywhere without a model. Columns of ``keep`` named as the new ones or ``_text`` are refused.
    """
    if clash := {"lang_pred", "score", "_text"} & set(keep):
        raise ValueError(f"keep already has {sorted(clash)}")

    def run(batches):
        cache_of("language")
        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column("_text")), 0).to_numpy(zero_copy_only=False).cumsum()
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, "right")))
                part, at = b.slice(at, to - at), to
                texts = part.column("_text").to_pylist()
                pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
                if model is not None:
                    p = model.pooled([t.encode().lower() if t else b"" for t in texts])
                    ok = np.array([any(map(str.isalpha, t or "")) for t in texts])
                    best = p.argmax(1)
                    pred[ok], score[ok] = np.array(model.langs, object)[best][ok], np.minimum(1.0, p[np.arange(len(p)), best])[ok]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])
        trim()

    out = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, out)


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id's text leaves remainder 1 by 3; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", held_out())
    model = train_model(docs.filter(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return identify_languages(docs, model, ["doc_id", "held_out"])


QUERIES = {"op7_language": op7_language}
