import random

import numpy as np
import pytest

from kgweave.llm.langid import CONTEXT, SPAN, ByteGru, held_out, identify_languages, op7_language, spans, train_model

WORDS = {"en": ["the", "house", "which", "through", "with"], "de": ["der", "straße", "zwischen", "schön", "durch"], "fr": ["le", "maison", "où", "travers", "déjà"]}


def corpus(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[lang]) + rng.choice("abc") for _ in range(40)), lang, "s", 1) for i in range(n) for lang in [rng.choice("en de fr".split())]]


def test_gradients_by_differences():
    m = ByteGru(["a", "b"], hidden=3, seed=1)
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    raw, owner, real = spans([b"abc", b"z", b"qrstuvwx"], 5, 2)
    label = np.array([0, 1, 1])[owner]
    assert real.tolist() == [3, 1, 5, 3] and bytes(raw[2]) == b"\0\0qrstuvw" and bytes(raw[3]) == b"tuvwx\0\0\0\0"
    _, g = m.gradients(raw, real, label, 2)
    for k in m.w:
        flat = m.w[k].reshape(-1)
        for i in np.flatnonzero(np.abs(g[k].reshape(-1)) > 1e-6)[:5]:
            old, eps = flat[i], 1e-4
            flat[i] = old + eps
            up = m.gradients(raw, real, label, 2)[0]
            flat[i] = old - eps
            down = m.gradients(raw, real, label, 2)[0]
            flat[i] = old
            assert abs((up - down) / (2 * eps) - g[k].reshape(-1)[i]) < 1e-3, k


def test_held_out_accuracy(spark, sf):
    df = spark.createDataFrame(corpus(400, 1), "doc_id long, text string, lang string, source string, n_chars long")
    out = op7_language(spark, sf(df)).join(df.select("doc_id", "lang"), "doc_id").collect()
    tested = [r for r in out if r.held_out]
    assert len(out) == 400 and len(tested) > 80
    assert sum(r.lang == r.lang_pred for r in tested) / len(tested) >= 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_odd_rows(spark, odd, nothing, sf):
    model = train_model(spark.createDataFrame(corpus(150, 2), odd.schema))
    out = {(r.doc_id, r.text): r for r in identify_languages(odd, model, ["doc_id", "text"]).collect()}
    assert len(out) == odd.distinct().count()
    assert {k[0] for k, r in out.items() if r.lang_pred == "und"} == {2, 3, 4, 8}
    assert identify_languages(nothing, model, ["doc_id"]).count() == 0
    assert train_model(nothing) is None
    assert {r.lang_pred for r in identify_languages(odd, None, ["doc_id"]).collect()} == {"und"}
    assert odd.filter(held_out()).count() + odd.filter(~held_out()).count() == odd.count()
    assert op7_language(spark, sf(nothing)).count() == 0


def test_repeats_change_nothing(spark, odd):
    """Batches and remembered runs don't alter a document's result."""
    model = train_model(spark.createDataFrame(corpus(150, 2), odd.schema))
    a = {r.text: (r.lang_pred, round(r.score, 6)) for r in identify_languages(odd, model, ["text"]).collect()}
    b = {r.text: (r.lang_pred, round(r.score, 6)) for r in identify_languages(odd.union(odd).repartition(3), model, ["text"]).collect()}
    assert a == b


def plain(model, text):
    """The mean probabilities of one text, span by span and position by position."""
    w, n = model.w, len(model.w["cf"])
    logistic = lambda v: 1 / (1 + np.exp(-v))
    total = np.zeros(len(model.langs))
    for at in range(0, len(text), SPAN):
        around = [text[i] if 0 <= i < len(text) else 0 for i in range(at - CONTEXT, at + SPAN + CONTEXT)]
        states = {}
        for d in "fb":
            h, seen = np.zeros(n), {}
            for i in range(len(around)) if d == "f" else reversed(range(len(around))):
                x = w[f"x{d}"][around[i]]
                gate = logistic(x[: 2 * n] + h @ w[f"u{d}"])
                new = np.tanh(x[2 * n :] + (gate[:n] * h) @ w[f"c{d}"])
                h = gate[n:] * h + (1 - gate[n:]) * new
                seen[i] = h
            states[d] = seen
        for i in range(CONTEXT, CONTEXT + min(SPAN, len(text) - at)):
            y = np.exp(np.concatenate([states["f"][i], states["b"][i]]) @ w["o"] + w["ob"])
            total += y / y.sum()
    return total / len(text)


def test_scores_against_a_plain_pass():
    rng = np.random.default_rng(3)
    model = ByteGru(["a", "b", "c"], seed=4)
    texts = [bytes(rng.integers(1, 256, n).astype(np.uint8)) for n in (1, 17, SPAN, SPAN + 1, 3 * SPAN + 40)]
    got = model.pooled([*texts, b""])
    assert (got[-1] == 0).all()
    for t, p in zip(texts, got):
        assert np.allclose(p, plain(model, t), atol=1e-5)


def test_many_languages_and_refused_names(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 9, f"l{i % 90}") for i in range(180)]
    model = train_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 90
    with pytest.raises(ValueError):
        identify_languages(spark.createDataFrame([(1, "a", 2.0)], "doc_id long, text string, score double"), model, ["doc_id", "score"])
