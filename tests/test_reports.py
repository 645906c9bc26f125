import random

import pytest
from pyspark.sql import functions as F

from kgweave.operators import graph as g
from kgweave.operators import search as se
from kgweave.plans.scratch import Scratch


@pytest.fixture(scope="module")
def star(spark):
    """A community of 3,000 members around a hub, and one of a single node."""
    rows = [(f"n{i:04}", f"name {i}", "L") for i in range(3000)] + [("z", "lone", "L")]
    nodes = spark.createDataFrame(rows, "id string, name string, label string")
    edges = nodes.filter("id not in ('n0000', 'z')").select(F.lit("n0000").alias("from"), F.col("id").alias("to"), F.lit("T").alias("type"))
    member = nodes.select(F.lit(0).alias("level"), F.col("id").alias("node"), F.when(F.col("id") == "z", "z").otherwise("n").alias("community"), F.lit(None).cast("string").alias("parent"))
    return nodes, edges, member


def text(n, m, budget):
    out = [f"Entities ({n}):", *(f"- name {i} [L]" for i in range(n)), f"\nRelationships ({m}):", *(f"- name 0 --T--> name {i}" for i in range(1, n))]
    return "\n".join(out)[:budget]


@pytest.mark.parametrize("budget", [10, 500, 8000, 60_000, 1_000_000])
def test_context_is_cut_before_it_is_gathered(star, budget):
    nodes, edges, member = star
    df = g.community_context(member, nodes, edges, max_chars=budget)
    got = {r.community: r.context for r in df.collect()}
    assert got["n"] == text(3000, 2999, budget) and got["z"].startswith("Entities (") and len(got["z"]) <= budget
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f"< {budget})") == 2


def test_tree_of_reports(spark, star):
    """Children of their own parent only; a community that went on unchanged is not its own child; answers override by id."""
    nodes = spark.createDataFrame([(x, f"N{x}", "L") for x in "abcdef"], "id string, name string, label string")
    edges = spark.createDataFrame([("a", "b", "T"), ("c", "d", "T"), ("e", "f", "T")], "`from` string, `to` string, type string")
    rows = [(0, x, "a" if x < "e" else "e", None) for x in "abcdef"] + [(1, x, "a" if x < "c" else "c" if x < "e" else "e", "a" if x < "e" else "e") for x in "abcdef"]
    member = spark.createDataFrame(rows, "level int, node string, community string, parent string")
    given = spark.createDataFrame([(1, "c", "C", "told", None), (1, "c", "D", "later", 1.0), (0, "c", "no such", "x", 1.0)], "level int, community string, title string, summary string, rating double")
    got = {(r.level, r.community): r for r in g.report_tree(member, nodes, edges, given).collect()}
    assert set(got) == {(0, "a"), (0, "e"), (1, "a"), (1, "c"), (1, "e")}
    assert (got[1, "c"].title, got[1, "c"].summary, got[1, "c"].rating, got[1, "c"].parent) == ("C", "told", 10.0, "a")
    assert got[0, "a"].context.endswith("\n\nSub-community summaries:\n[a]: Na T Nb\n[c]: told") and "Sub-community" not in got[0, "e"].context + got[1, "a"].context
    assert g.report_tree(member.limit(0), nodes, edges).count() == 0


def test_legs_expand_by_themselves(spark):
    nodes = spark.createDataFrame([(x, x, "L") for x in "abcdefg"], "id string, name string, label string")
    edges = spark.createDataFrame([("a", "b", "T"), ("b", "c", "T"), ("c", "d", "T"), ("e", "f", "T"), ("f", "g", "T")], "`from` string, `to` string, type string")
    links = lambda *rows: spark.createDataFrame(rows, "item_id string, entity_id string")
    graph = se.SearchGraph(nodes, edges, links(("r", "a"), ("r", "e")), links(("k", "c")), None)
    legs = spark.createDataFrame([(1, "entity", "a", 1), (1, "relation", "r", 1), (1, "relation", "s", 2), (1, "chunk", "k", 1), (1, "community", "x", 1), (2, "chunk", "unknown", 1)], "query_id long, list string, item_id string, rank int")
    got = sorted((r.query_id, r.list, r.rank, r.item_id, r.matched_on, r.kind) for r in se.expand_legs(legs, graph, 2, 3).collect())
    hop = lambda leg, rows: [(1, leg, rank, item, f"hop_{n}", "entity") for rank, item, n in rows]
    assert got == sorted(hop("entity", [(2, "b", 1), (3, "c", 2)]) + hop("relation", [(3, "b", 1), (4, "f", 1), (5, "c", 2)]) + hop("chunk", [(2, "d", 1)]))


def test_lists_longer_than_the_budget(spark):
    hits = spark.createDataFrame([(1, k, i, f"line {k} {i}") for k in ("entity", "chunk") for i in range(3000)], "query_id long, kind string, rank int, line string")
    (r,) = se.pack_context(hits, 100).collect()
    assert r.context == "## Entities\n" + "\n".join(f"- line entity {i}" for i in range(5)) and len(r.context) <= 100


def test_chunk_context_of_hubs(spark):
    """An entity that every chunk mentions, with many relations: lists are whole, or their first by id."""
    from kgweave.operators import enrich as en

    ids = spark.range(40).selectExpr("id AS chunk_id")
    chunks = ids.selectExpr("chunk_id", "chunk_id + 1 AS next_id", "chunk_id - 1 AS prev_id")
    mentions = ids.selectExpr("chunk_id", "'hub' AS entity_id").union(ids.selectExpr("chunk_id", "'e' || chunk_id")).union(ids.selectExpr("chunk_id", "'hub'"))
    relations = spark.range(500).selectExpr("'hub' AS head_id", "format_string('r%03d', id) AS id").union(spark.createDataFrame([("e3", "a"), ("e3", "r001")], "head_id string, id string"))
    member = spark.createDataFrame([("hub", "c1"), ("e3", "c0")], "node_id string, community_id string")
    every = {r.chunk_id: r for r in en.chunk_context(ids, chunks, mentions, relations, member).collect()}
    hub = [f"r{i:03}" for i in range(500)]
    assert every[0].relations == hub and every[3].relations == ["a", *hub] and every[3].communities == ["c0", "c1"] and every[3].entities == ["e3", "hub"]
    few = {r.chunk_id: r for r in en.chunk_context(ids, chunks, mentions, relations, member, limit=2).collect()}
    assert few[3].relations == ["a", "r000"] and few[5].relations == ["r000", "r001"] and few[3].entities == ["e3", "hub"] and len(few) == 40


@pytest.mark.parametrize("turned", [False, True])
def test_edges_are_made_once_and_meet_the_rarer_end(spark, tmp_path, turned):
    """Reports read what was written of the edges, not the edges again; the edges inside are the same whichever end comes first."""
    rng = random.Random(3)
    m = {f"n{i}": c for i in range(30) for c in {i % 4}}
    rows = [(f"n{rng.randrange(30)}", f"n{rng.randrange(90)}", "T") for _ in range(400)]
    rows = [(b, a, t) if turned else (a, b, t) for a, b, t in rows]
    spark.createDataFrame(rows, "`from` string, `to` string, type string").write.parquet(f"{tmp_path}/edges")
    edges = spark.read.parquet(f"{tmp_path}/edges")
    membership = spark.createDataFrame(list(m.items()), "node string, community int")
    nodes = spark.createDataFrame([(f"n{i}", f"name{i}", "L") for i in range(80) if i != 7], "id string, name string, label string")
    inside = g.inside_edges(membership, nodes, edges, Scratch(spark, "t"), "x")
    want = sorted((m[a], a, b, t) for a, b, t in rows if a in m and b in m and m[a] == m[b] and "n7" not in (a, b))
    assert sorted(map(tuple, inside.collect())) == want
    made = g.community_reports(membership, nodes, edges)
    assert not [f for f in made.inputFiles() if f"{tmp_path}/edges" in f]
    assert {r.community: r.n_members for r in made.collect()} == {c: sum(x == c for n, x in m.items() if n != "n7") for c in range(4)}
