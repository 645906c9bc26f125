import numpy as np
import pytest

from kgweave.operators import models as mo
from kgweave.operators import resolve as rs
from kgweave.operators.chunks import embed


def test_relations_have_a_vector_for_each_representation(spark):
    rows = [("a", "metformin", "TREATS", "diabetes", "metformin treats it"), ("b", "x", "TREATS", "y", ""), ("c", "x", None, "y", None)]
    rel = spark.createDataFrame(rows, "id string, head_name string, type string, tail_name string, description string")
    got = {(r.id, r.representation): (r.text, r.vector) for r in mo.embed_relations(rel, ("fact", "type", "spo")).collect()}
    assert len(got) == 9
    assert got["a", "fact"][0] == "metformin treats it" and got["a", "spo"][0] == "metformin TREATS diabetes" and got["a", "type"][0] == "TREATS"
    assert got["b", "fact"][0] == "x TREATS y" and got["c", "type"] == (None, None) and got["c", "spo"][0] == "x y"
    for r in embed(spark.createDataFrame([(t,) for t, _ in got.values() if t is not None], "text string")).collect():
        assert all(v == r.vector for t, v in got.values() if t == r.text)
    assert [tuple(r) for r in mo.embed_relations(rel.drop("description")).select("id", "representation", "text").orderBy("id").limit(1).collect()] == [("a", "fact", "metformin TREATS diabetes")]
    assert mo.embed_relations(rel.limit(0), ("type",)).count() == 0
    with pytest.raises(ValueError):
        mo.relation_texts(rel, ("other",))


def test_extractor_gives_entities_relations_and_bad_answers(spark):
    def answer(batches):
        for f in batches:
            good = '{"entities": [{"name": "Aspirin", "label": "DRUG", "score": 0.9}, {"name": "odd", "label": "NONE", "score": 1.0}], "relations": []}'
            yield f.assign(response=[good if t else "no json" for t in f["text"].fillna("")]).drop(columns="text")

    chunks = spark.createDataFrame([(1, "x"), (2, None), (3, "x")], "chunk_id long, text string")
    e, r, bad = mo.extract_with(chunks, answer, ["DRUG"], ["R"], "m")
    assert sorted(map(tuple, e.collect())) == [(1, 0, "m", "Aspirin", "DRUG", 0.9), (3, 0, "m", "Aspirin", "DRUG", 0.9)]
    assert r.count() == 0 and [x.chunk_id for x in bad.collect()] == [2]


def test_clusters_reach_across_groups(spark, monkeypatch):
    """Close copies share a cluster nearly as often as where all items are one group, and every cluster is full."""
    rng = np.random.default_rng(0)
    base = rng.normal(size=(600, 12))
    v, place = np.concatenate([base, base + 0.1 * rng.normal(size=base.shape)]), rng.permutation(1200)
    items = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(place, v)], "idx long, v array<double>")

    def shared(clusters):
        monkeypatch.setattr(rs, "GROUP_CLUSTERS", clusters)
        of = {r.idx: r.cluster for r in rs.balanced_clusters(items, 16).collect()}
        sizes = np.unique(list(of.values()), return_counts=True)[1]
        assert len(of) == 1200 and (sizes == 16).all()
        return np.mean([of[int(place[i])] == of[int(place[i + 600])] for i in range(600)])

    assert shared(10) >= 0.75 * shared(1000)
