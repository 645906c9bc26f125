import random

from kgweave.operators import chunks as ch
from kgweave.operators.components import connected_components
from kgweave.streaming import ingest as ing
from kgweave.streaming import merged


def rows(df):
    return sorted(map(str, df.collect()))


def names(spark):
    return spark.createDataFrame([("heart", "DET", 0.9), ("hearts", "DET", 0.8), ("box", "DET", 0.7), ("boxes", "DET", 0.9), ("lung", "CONJ", 0.6), ("of the", "PHRASE", 0.9)], "name string, label string, score double")


def texts(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(["heart", "hearts", "box", "boxes", "lung", "of the", "word"], k=8))) for i in range(n)]


def test_ten_batches_are_one(spark, tmp_path):
    lexicon, allowed = names(spark), ch.allowed_relations(spark)
    docs = spark.createDataFrame(texts(30), "doc_id long, text string")
    many, one = ing.Tables(spark, f"file://{tmp_path}/many"), ing.Tables(spark, f"file://{tmp_path}/one")
    for k in range(10):
        ing.ingest_batch(docs.filter(f"doc_id % 10 = {k}"), many, lexicon, allowed, k)
    ing.ingest_batch(docs, one, lexicon, allowed, 0)
    for part in (0, 1):
        assert rows(ing.ingested_graph(many)[part]) == rows(ing.ingested_graph(one)[part])
        assert rows(ing.resolved_graph(many)[part]) == rows(ing.resolved_graph(one)[part])
    assert {(r.label, r.n_names) for r in ing.resolved_graph(many)[0].collect()} == {("DET", 2), ("CONJ", 1), ("PHRASE", 1)}
    # a reader opens a few runs, whatever the number of batches, and their rows don't add up
    done = many.batches()
    live = many.entities().live(done)
    assert [r[0] for r in live] == [1, 1, 0, 0] and many.entities().rows(live).count() <= 4 * 6
    before = rows(ing.ingested_graph(many)[0])
    many.entities().drop_folded(done)
    assert rows(ing.ingested_graph(many)[0]) == before
    # documents that come again replace what they said: names lose chunks, or go
    changed = docs.filter("doc_id < 20").selectExpr("doc_id", "'lung word' AS text")
    ing.ingest_batch(changed, many, lexicon, allowed, 10)
    ing.ingest_batch(docs.filter("doc_id >= 20").union(changed), clean := ing.Tables(spark, f"file://{tmp_path}/clean"), lexicon, allowed, 0)
    for part in (0, 1):
        assert rows(ing.ingested_graph(many)[part]) == rows(ing.ingested_graph(clean)[part])
    ing.ingest_batch(docs.selectExpr("doc_id", "'nothing' AS text"), many, lexicon, allowed, 11)
    assert ing.ingested_graph(many)[0].count() == ing.resolved_graph(many)[1].count() == 0
    ing.ingest_batch(docs, many, lexicon, allowed, 12)
    assert rows(ing.ingested_graph(many)[0]) == rows(ing.ingested_graph(one)[0])


def test_runs_fold(spark, tmp_path):
    runs = merged.Runs(spark, f"file://{tmp_path}/r", "k string, top double, n long", ["k"], ["top"], ["n"])
    plain, done = {}, []
    rng = random.Random(3)
    for batch in range(21):
        new = []
        for k in rng.sample("abcdef", 3):
            top, n, absolute = rng.random(), rng.randint(1, 5), rng.random() < 0.2
            old = (0.0, 0) if absolute else plain.get(k, (0.0, 0))
            plain[k] = max(old[0], top), old[1] + n
            new.append((k, top, n, absolute))
        runs.write(spark.createDataFrame(new, "k string, top double, n long, absolute boolean"), 0, batch, batch)
        done.append(batch)
        runs.fold(done)
    assert {r.k: (r.top, r.n) for r in runs.current(done).collect()} == plain
    assert [r[0] for r in runs.live(done)] == [2, 1, 0]
    assert runs.current([]).count() in (0, len(plain)) and [r[1:] for r in runs.live(done)] == [(0, 15), (16, 19), (20, 20)]


def test_components_grow(spark):
    rng = random.Random(5)
    links = [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(50)] + [(None, "x")]
    state = spark.createDataFrame([], "node string, root string")
    for i in range(0, len(links), 17):
        new = merged.join_components(state, spark.createDataFrame(links[i : i + 17], "a string, b string"), connected_components).collect()
        held = {r.node: r.root for r in state.collect()}
        held |= {r.node: r.root for r in new}
        state = spark.createDataFrame(list(held.items()), "node string, root string")
    whole = connected_components(spark.createDataFrame(links, "a string, b string"), "a", "b")
    assert {r.node: r.component for r in whole.collect()} == held
