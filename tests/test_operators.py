import collections
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgweave.functions.ids import identity_id, uuid5
from kgweave.functions.text import normalize_text, singularize
from kgweave.operators import chunks as ch
from kgweave.operators import evaluation as ev
from kgweave.operators import graph as g
from kgweave.operators import merge as m
from kgweave.operators import resolve as rs
from kgweave.operators import search as se
from kgweave.plans import registry
from kgweave.plans import testgraph as tg
from kgweave.sources import benchmarks as bm
from kgweave.streaming import ingest as ing


def test_ids(spark):
    df = spark.createDataFrame([("Größe X",), ("a's b",), (None,)], "x string").select("x", uuid5("x").alias("u"), identity_id("Entity", "x", F.lit("L M")).alias("i"))
    for r in df.collect():
        assert r.u == (str(uuid.uuid5(uuid.NAMESPACE_OID, r.x)) if r.x else None)
        assert r.i == (str(uuid.uuid5(uuid.NAMESPACE_OID, "Entity:" + r.x.lower().replace(" ", "_").replace("'", "") + "|l_m")) if r.x else None)


def test_text(spark):
    df = spark.createDataFrame([("ﬁn   A\tB",), (None,)], "x string")
    assert [r.n for r in df.select(normalize_text("x").alias("n")).collect()] == ["fin a b", None]
    words = "genes boxes studies class virus analysis dishes bus as".split()
    got = [r.s for r in spark.createDataFrame([(w,) for w in words], "x string").select(singularize("x").alias("s")).collect()]
    assert got == "gene box study class virus analysis dish bus as".split()


def test_collapse(spark):
    rows = [("a", "b", "L", t) for t in ("TARGET", "ENZYME", "ZZZ")] + [("a", "c", "L", t) for t in ("AGONIST", "ANTAGONIST", "INHIBITOR")] + [("a", "d", "L", t) for t in ("B_UNKNOWN", "A_UNKNOWN")]
    out = {r["to"]: r for r in m.collapse_relations(spark.createDataFrame(rows, "from string, to string, label string, type string"), "S", ("AGONIST", "ANTAGONIST", "INHIBITOR")).collect()}
    assert (out["b"].type, out["b"].relation_conflict, out["b"].asserted_relations) == ("ENZYME", False, ["ENZYME", "TARGET", "ZZZ"])
    assert (out["c"].type, out["c"].relation_conflict) == ("AGONIST", True) and out["d"].type == "A_UNKNOWN"
    assert out["b"].relation_assertions[0].asDict() == {"source": "S", "relation": "ENZYME"}


def test_combine_without_primary(spark):
    df = spark.createDataFrame([("x", 1, 0.5, "k"), ("y", 2, 0.7, "k")], "extractor string, ord int, score double, key string")
    assert [tuple(r) for r in m.combine_extractions(df, ["key"], "gliner_primary").select("key", "score", "extractor").collect()] == [("k", 0.7, "x")]


def test_upsert_twice_is_once(spark):
    a = spark.createDataFrame([("1", "old", ["c1"])], "id string, name string, chunk_ids array<string>")
    b = spark.createDataFrame([("1", None, ["c2", "c1"]), ("2", "new", ["c3"])], a.schema)
    once = m.merge_nodes(a, b)
    rows = sorted(tuple(r) for r in once.collect())
    assert rows == [("1", None, ["c1", "c2"]), ("2", "new", ["c3"])] and rows == sorted(tuple(r) for r in m.merge_nodes(once, b).collect())


def test_recursive_spans():
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "a", "\n", "\n\n", "longerword "]) for _ in range(rng.randrange(120)))
        spans = ch.recursive_spans(text, 40, 10)
        assert all(0 < z - a <= 40 for a, z in spans)
        covered = set().union(*[range(a, z) for a, z in spans]) if spans else set()
        assert covered == set(range(len(text)))
        assert all(a <= b and y <= z for (a, y), (b, z) in zip(spans, spans[1:]))
        assert all(y - b <= 10 for (_, y), (b, _) in zip(spans, spans[1:]))


def test_model_output(spark):
    rows = [(1, '{"entities":[{"name":"a","label":"X","score":1},{"name":"b","label":"Q","score":1}],"relations":[{"head":"a","type":"R","tail":"a","score":1},{"head":"a","type":"R","tail":"b","score":1}]}'), (2, "not json")]
    e, r, bad = ch.flatten_model_output(spark.createDataFrame(rows, "chunk_id int, response string"), ["X"], ["R"])
    assert [x.name for x in e.collect()] == ["a"] and [(x.head, x.tail) for x in r.collect()] == [("a", "a")] and [x.chunk_id for x in bad.collect()] == [2]


def test_extract_graph_query_reads_whole_documents(spark, tmp_path):
    """A relation after the first 8,000 characters of a document is found."""
    registry.load()
    text = "filler " * 2000 + "of the house the door"
    spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.type for r in registry.QUERIES["T8_extract_graph"](spark, str(tmp_path)).collect()} == {"NEAR"}


def test_rrf_and_mmr(spark):
    hits = spark.createDataFrame([(1, "e", "a", "x", 1, 0.5), (1, "e", "a", "y", 1, 0.9), (1, "e", "b", "x", 2, 0.4)], "query_id int, kind string, item_id string, list string, rank int, score double")
    out = {r.item_id: r.score for r in se.rrf(hits).collect()}
    assert abs(out["a"] - 2 / 61) < 1e-12 and abs({r.item_id: r.score for r in se.rrf(hits, 10).collect()}["a"] - 2 / 11) < 1e-12
    rng = np.random.default_rng(1)
    v, s = rng.normal(size=(12, 4)), rng.random(12)
    df = spark.createDataFrame([(1, i, float(s[i]), v[i].tolist()) for i in range(12)], "query_id int, item_id int, score double, v array<double>")
    u, rel, chosen = v / np.linalg.norm(v, axis=1, keepdims=True), s / s.max(), []
    for _ in range(5):
        best = max((i for i in range(12) if i not in chosen), key=lambda i: (0.7 * rel[i] - 0.3 * max((u[i] @ u[j] for j in chosen), default=0), s[i]))
        chosen.append(best)
    assert [r.item_id for r in se.mmr(df, 5).orderBy("rank").collect()] == chosen


def context(hits, budget):
    """The packing rule in plain Python."""
    out, n = [], 0
    for kind, title in se.SECTIONS:
        lines = [x for k, _, x in sorted(hits, key=lambda h: h[1]) if k == kind]
        part = []
        for line in [f"## {title}", *(f"- {x}" for x in lines)] if lines else []:
            add = (1 if out or part else 0) + len(line)
            if n + sum(map(len, part)) + len(part) - (1 if part and not out else 0) + add > budget:
                break
            part.append(line)
        if len(part) > 1:
            out += part
            n = len("\n".join(out))
    return "\n".join(out)


def test_pack_context(spark):
    rng = random.Random(2)
    for budget in (0, 20, 45, 80, 200):
        hits = [(rng.choice([k for k, _ in se.SECTIONS]), i, "x" * rng.randrange(1, 25)) for i in range(12)]
        df = spark.createDataFrame([(1, *h) for h in hits], "query_id int, kind string, rank int, line string")
        got = se.pack_context(df, budget).first().context
        assert got == context(hits, budget) and len(got) <= budget


def test_balanced_clusters(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(50)], "idx long, v array<double>")
    out = rs.balanced_clusters(df, 12).collect()
    sizes = {}
    for r in out:
        sizes[r.cluster] = sizes.get(r.cluster, 0) + 1
    assert len(out) == 50 == len({r.idx for r in out}) and all(n <= 12 for c, n in sizes.items() if c >= 0)


def test_grading(spark):
    options = [("A", "fever"), ("B", "cough")]
    cases = {"b": (True, "exact_letter"), "Answer: B": (True, "answer_marker"), "<answer>B</answer>": (True, "exact_letter"), "The answer is B.": (True, "answer_marker"), "COUGH": (True, "exact_answer_text"), "It was (A)": (False, "final_token"), "I Think So Yes, no": (False, "no_match"), "\\boxed{B}": (True, "exact_letter"), None: (False, "no_match")}
    s = spark.createDataFrame([(i, options, "B") for i in range(len(cases))], "sample_id int, options array<struct<label:string,text:string>>, answer_key string")
    p = spark.createDataFrame(list(enumerate(cases)), "sample_id int, prediction string")
    got = {r.sample_id: (r.correct, r.method) for r in ev.grade_mcq(s, p).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    t = spark.createDataFrame([(1, "- one\n\n2. two\n* three")], "sample_id int, trace string")
    assert [r.statement for r in ev.reasoning_items(t).collect()] == ["one", "two", "three"]


def test_shuffles(spark):
    options = [("A", "one"), ("B", "two"), ("C", "three"), ("D", "All of the above"), ("E", "five")]
    rows = [(str(i), i, "q", options, ["B"], False) for i in range(40)] + [("x", 99, "q", [("A", "Both B and C"), ("B", "b"), ("C", "c")], ["C"], False)]
    s = spark.createDataFrame(rows, f"sample_id string, row_id long, question_stem string, options {bm.OPTIONS}, answer_keys array<string>, is_multi boolean")
    for shuffle in (bm.shuffle_options, bm.shuffle_options_mt):
        out = {r.row_id: r for r in shuffle(s).collect()}
        assert all({o.label: o.text for o in r.options}[r.answer_keys[0]] == "two" and r.options[3].text == "All of the above" and r.options[4].text == "five" for i, r in out.items() if i < 99)
        assert [o.text for o in out[99].options] == ["Both B and C", "b", "c"] and out[99].answer_keys == ["C"]
        assert len({tuple(o.text for o in r.options) for r in out.values()}) > 4


def test_benchmarks(spark):
    row = lambda values, schema: spark.createDataFrame([values], schema)
    one = lambda df: df.first()
    assert one(bm.careqa(row(("i", 0, "q", "a", "b", "c", "d", 3, "s"), "id string, row_id long, question string, op1 string, op2 string, op3 string, op4 string, cop int, subject string"))).answer_keys == ["C"]
    assert one(bm.medmcqa(row(("i", 0, "q", "a", "b", "c", "d", 0, "s", "t", "single", "e"), "id string, row_id long, question string, opa string, opb string, opc string, opd string, cop int, subject_name string, topic_name string, choice_type string, exp string"))).answer_keys == ["A"]
    assert bm.medqa(row((0, "q", {"A": "x", "B": "y"}, "z", "m"), "row_id long, question string, options map<string,string>, answer_idx string, meta_info string")).count() == 0
    p = one(bm.pubmedqa(row((7, 0, "q?", (["BG"], ["text"], ["m"]), "Yes"), "pubid int, row_id long, question string, context struct<labels:array<string>,contexts:array<string>,meshes:array<string>>, final_decision string")))
    assert p.question_stem == "Context:\nBG. text\n\nQuestion: q?" and p.answer_keys == ["A"] and p.sample_id == "7"
    x = one(bm.medxpertqa(row(("i", 0, "stem Answer Choices: (A) x", {"A": "x"}, "a", "t", "b", "R"), "id string, row_id long, question string, options map<string,string>, label string, medical_task string, body_system string, question_type string")))
    assert x.question_stem == "stem" and x.answer_keys == ["A"]
    n = one(bm.nejm_qa(row(("card", 3, "Stem?\nA. x \nB. y\nC. z", "A, C,Z"), "specialty string, row_id long, question string, answer string")))
    assert (n.question_stem, n.answer_keys, n.is_multi, n.sample_id) == ("Stem?", ["A", "C"], True, "card_3") and [o.text for o in n.options] == ["x", "y", "z"]
    u = one(bm.mmlu_pro_health(row((1, 0, "q", ["x", "N/A", "z"], "C", "Health", "c", "s"), "question_id int, row_id long, question string, options array<string>, answer string, category string, cot_content string, src string")))
    assert [o.label for o in u.options] == ["A", "C"]
    f = one(bm.pubhealthbench_freeform(row((1, "q", ["x", "y"], 1, "c", "s", None), "question_id int, question string, options array<string>, answer_index int, category string, source string, reference_answer string")))
    assert f.reference_answer == "y"
    assert one(bm.nejm_diagnostic(row((0, "", "t", "d"), "row_id long, case_presentation string, Title string, Answer string"))).question == "t"
    h = bm.healthbench(row(("p", [("user", "hi"), ("assistant", "yo")], [("crit", 5, ["axis:a", "level:l", "cluster:c:d"])], ["theme:t"]), "prompt_id string, prompt array<struct<role:string,content:string>>, rubrics array<struct<criterion:string,points:int,tags:array<string>>>, example_tags array<string>"))
    r = one(h)
    assert (r.question, r.theme, r.axis, r.level, r.cluster, r.points, len(r.criterion_id)) == ("user: hi\n\nassistant: yo", "t", "a", "l", "c:d", 5, 16)


def test_stream_is_batch_and_repeats_nothing(spark, tmp_path):
    names, allowed = ch.lexicon(spark), ch.allowed_relations(spark)
    docs = spark.createDataFrame([(i, f"the end of the {i} and the rest that") for i in range(12)], "doc_id long, text string")
    docs.filter("doc_id < 8").repartition(2).write.parquet(f"{tmp_path}/in")
    rows = lambda df: sorted(map(str, df.collect()))

    def key(tables):
        entities, relations = ing.ingested_graph(tables)
        return [rows(entities), rows(relations), rows(tables.current("mentions")), rows(tables.current("facts"))]

    stream = lambda: ing.ingest_stream(spark, f"{tmp_path}/in", docs.schema, f"file://{tmp_path}/out", names, allowed)
    stream()
    docs.filter("doc_id >= 8").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    first = key(stream())
    assert first == key(stream()) and len(first[1]) and len(first[2]) > 24
    tables = ing.Tables(spark, f"file://{tmp_path}/batch")
    ing.ingest_batch(docs, tables, names, allowed, 0)
    assert first == key(tables)
    ing.ingest_batch(docs, tables, names, allowed, 0)
    assert first == key(tables) and tables.batches() == [0]
    # the same documents again, in a later batch
    ing.ingest_batch(docs, tables, names, allowed, 1)
    assert first == key(tables) and tables.batches() == [0, 1]


def test_a_lost_batch_is_written_anew(spark, tmp_path):
    names, allowed = ch.lexicon(spark), ch.allowed_relations(spark)
    docs = spark.createDataFrame([(i, f"the end of the {i} and the rest") for i in range(6)], "doc_id long, text string")
    tables = ing.Tables(spark, f"file://{tmp_path}/lost")

    class Stop(Exception):
        pass

    def write(name, df, batch):
        if name == "vectors":
            raise Stop
        return ing.Tables.write(tables, name, df, batch)

    tables.write = write
    with pytest.raises(Stop):
        ing.ingest_batch(docs, tables, names, allowed, 0)
    assert tables.batches() == [] and ing.ingested_graph(tables)[0].count() == 0
    del tables.write
    ing.ingest_batch(docs, tables, names, allowed, 0)
    whole = ing.Tables(spark, f"file://{tmp_path}/whole")
    ing.ingest_batch(docs, whole, names, allowed, 0)
    assert sorted(map(str, ing.ingested_graph(tables)[0].collect())) == sorted(map(str, ing.ingested_graph(whole)[0].collect()))


def test_clusters_in_many_groups(spark, monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(rs, "GROUP_CLUSTERS", 3)
    v = rng.normal(size=(500, 8))
    v[:200] = v[0]
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "idx long, v array<double>")
    got = rs.balanced_clusters(items, 10).collect()
    assert sorted(r.idx for r in got) == list(range(500))
    size = {}
    for r in got:
        size[r.cluster] = size.get(r.cluster, 0) + 1
    assert max(size.values()) <= 10 and all(n < 10 for c, n in size.items() if c < 0) and len(size) >= 50
    assert sorted(map(tuple, got)) == sorted(map(tuple, rs.balanced_clusters(items.repartition(5), 10).collect()))
    assert rs.balanced_clusters(items.limit(0), 10).count() == 0


def test_bm25_top_is_the_top_of_all_scores(spark):
    rng = np.random.default_rng(1)
    text = lambda n: " ".join(f"w{min(60, int(x))}" for x in rng.pareto(0.7, n) * 3)
    docs = spark.createDataFrame([(i, text(int(rng.integers(0, 60)))) for i in range(150)], "item_id long, text string")
    asked = spark.createDataFrame([(i, text(int(rng.integers(1, 12)))) for i in range(25)] + [(99, "nothing known"), (98, "")], "query_id long, text string")
    every = se.top_k(se.bm25_scores(asked, docs).withColumn("score", F.round("score", 9)), 5)
    assert sorted(map(tuple, se.bm25_top(asked, docs, 5).collect())) == sorted(map(tuple, every.select("query_id", "item_id", "score", "rank").collect()))


def test_vector_search_of_repeated_queries(spark, monkeypatch):
    monkeypatch.setattr(se, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 5))
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id long, v array<double>")
    asked = spark.createDataFrame([(i % 20, v[i % 20].tolist()) for i in range(200)], "query_id long, q array<double>")
    got = {(r.query_id, r.rank): r.item_id for r in se.vector_search(asked, items, 3, "euclid").collect()}
    for i in range(20):
        assert [got[i, r] for r in (1, 2, 3)] == np.argsort(((v - v[i]) ** 2).sum(1))[:3].tolist()
    assert len(got) == 60


@pytest.mark.parametrize("name", sorted(se.RECIPES))
def test_recipes(spark, name):
    words = ["liver", "heart", "kidney", "drug", "dose", "trial"]
    rng = np.random.default_rng(3)
    rows = [(kind, f"{kind}{i}", " ".join(rng.choice(words, 4)) + f" t{i}") for kind in se.ALL for i in range(12)]
    items = ch.embed(spark.createDataFrame(rows, "kind string, item_id string, text string"), "text", "v")
    asked = ch.embed(spark.createDataFrame([(1, rows[3][2]), (2, "liver dose")], "query_id long, text string"), "text", "q")
    nodes = spark.createDataFrame([(f"entity{i}", f"n{i}", "L") for i in range(12)], "id string, name string, label string")
    edges = spark.createDataFrame([(f"entity{i}", f"entity{(i + 1) % 12}", "T") for i in range(12)], "`from` string, `to` string, type string")
    recipe = se.RECIPES[name]
    got = se.search(asked, items, recipe, (nodes, edges)).collect()
    by = {q: sorted((r for r in got if r.query_id == q), key=lambda r: r.rank) for q in (1, 2)}
    for q, hits in by.items():
        assert [r.rank for r in hits] == list(range(1, len(hits) + 1)) and 0 < len(hits) <= recipe.limit
        assert [r.score for r in hits] == sorted((r.score for r in hits), reverse=True)
        assert {r.kind for r in hits} <= set(recipe.methods)
    if "entity" in recipe.methods:
        assert "entity3" in [r.item_id for r in by[1]]


def test_lsh_recall(spark):
    rng = random.Random(6)
    names = ["".join(rng.choices("abcdef", k=14)) for _ in range(150)]
    names += [n[:-1] + "z" for n in names[:80]]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    exact = {(r.a, r.b) for r in rs.near_pairs_exact(df, 0.6).collect()}
    got = {(r.a, r.b) for r in rs.near_pairs_lsh(df, 0.6).collect()}
    assert len(exact) >= 80 and got <= exact and len(got) >= 0.9 * len(exact)


@pytest.mark.parametrize("remembered", [0, 1 << 20])
def test_vector_search_keeps_what_may_count(monkeypatch, remembered):
    """Later blocks of a task give only what reaches the best so far, and of equal vectors the smallest ids; what is kept holds the best of all."""
    import pyarrow as pa

    monkeypatch.setattr(se, "REMEMBERED", remembered)
    rng = np.random.default_rng(4)
    v, q = rng.normal(size=(1200, 8)).astype(np.float32), rng.normal(size=(5, 8)).astype(np.float32)
    v[600:900] = v[600]
    cell = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
    rows = [list(map(float, x)) for x in v]
    asked = cell([{"query_id": i, "q": list(map(float, x))} for i, x in enumerate(q)], pa.struct([("query_id", pa.int64()), ("q", pa.list_(pa.float32()))]))
    blocks = [pa.RecordBatch.from_arrays([pa.array([0]), cell(list(range(a, a + 300)), pa.int64()), cell(rows[a : a + 300], pa.list_(pa.float32())), asked], ["block", "ids", "v", "asked"]) for a in (600, 0, 900, 300)]
    out = [b.to_pylist() for b in se._score_blocks(6, "cosine", None)(iter(blocks))]
    assert len(out[0]) == 30 and all(r["item_id"] < 606 for r in out[0])
    assert sum(map(len, out)) < 4 * 30
    exact = (q.astype(float) @ v.T.astype(float)) / np.linalg.norm(q.astype(float), axis=1)[:, None] / np.linalg.norm(v.astype(float), axis=1)[None, :]
    for i in range(5):
        got = sorted((-round(r["score"], 12), r["item_id"]) for b in out for r in b if r["query_id"] == i)[:6]
        assert got == sorted((-round(s, 12), j) for j, s in enumerate(exact[i].tolist()))[:6]


def _tags(words, names, longest=3):
    """Matches by comparing every pair."""
    hits = [(name, label, i, i + n - 1, n) for n in range(1, longest + 1) for i in range(len(words) - n + 1) for name, label in names if " ".join(words[i : i + n]) == name]
    return sorted((a[0], a[1], a[2], a[3]) for a in hits if not any(b[2] <= a[3] and b[3] >= a[2] and (b[4] > a[4] or b[4] == a[4] and b[2] < a[2]) for b in hits))


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_tags_and_pairs_in_one_pass(spark, tmp_path, longest):
    """As every pair compared, in a plan that reads the texts once and joins no match with another."""
    rng = random.Random(longest)
    names = [("a", "X"), ("a", "Y"), ("a b", "X"), ("b a", "Z"), ("a b c", "X"), ("c", "Z"), ("a  c", "W"), ("", "E"), ("a b c a", "V")]
    texts = {i: [rng.choice(["a", "b", "c", "--", "d"]) for _ in range(rng.randrange(60))] for i in range(30)}
    spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()] + [(99, None)], "chunk_id int, text string").write.parquet(f"{tmp_path}/t")
    lexicon = spark.createDataFrame([(*n, 0.9) for n in names] + [("d", "L", 0.1)], "name string, label string, score double")
    tagged = ch.tag_entities(spark.read.parquet(f"{tmp_path}/t"), lexicon, longest)
    plan = tagged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and plan.count("Join ") == 1
    got = collections.defaultdict(list)
    for r in tagged.collect():
        got[r.chunk_id].append((r.name, r.label, r["first"], r["last"]))
    own = {i: _tags(["" if w == "--" else w for w in words], names, longest) for i, words in texts.items()}
    assert {i: sorted(v) for i, v in got.items()} == {i: v for i, v in own.items() if v}
    allowed = spark.createDataFrame([("X", "NEAR", "Z"), ("Z", "BEFORE", "X"), ("X", "SAME", "X")], "head_label string, type string, tail_label string")
    types = {("X", "Z"): "NEAR", ("Z", "X"): "BEFORE", ("X", "X"): "SAME"}
    pairs = ch.propose_relations(tagged, allowed, 4)
    want = sorted((i, a[0], types[a[1], b[1]], b[0], round(1 / (b[2] - a[2]), 9), a[2]) for i, v in own.items() for a in v for b in v if 0 < b[2] - a[2] <= 4 and (a[1], b[1]) in types)
    assert sorted((r.chunk_id, r.head_name, r.type, r.tail_name, round(r.score, 9), r.ord) for r in pairs.collect()) == want


@pytest.mark.parametrize(("depth", "limit"), [(1, 4), (2, 3), (2, 50), (3, 5)])
def test_nearest_nodes_are_those_of_the_whole_search(spark, depth, limit):
    """Lists made once for each node and cut there give what the search of every query gives; some nodes have no row, names repeat, there are cycles."""
    rng = random.Random(depth * 100 + limit)
    nodes = spark.createDataFrame([(f"n{i}", rng.choice("abc"), "L") for i in range(40) if i % 7], "id string, name string, label string")
    edges = spark.createDataFrame([(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", rng.choice("TU")) for _ in range(110)], "`from` string, `to` string, type string")
    seeds = spark.createDataFrame([(rng.randrange(12), f"n{rng.randrange(40)}") for _ in range(30)], "query_id int, node_id string")
    want = g.bfs_expand(seeds, edges, nodes, depth, limit)
    cols = ["query_id", "node_id", "hop", "rank"]
    assert sorted(map(tuple, g.bfs_nearest(seeds, edges, nodes, depth, limit).select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95, 1.0])
def test_near_pairs_of_short_and_long_names(spark, threshold):
    """Names of too few grams to be near any other set meet by all their grams, and share no candidates by one gram."""
    rng = random.Random(6)
    names = sorted({"id" + "".join(rng.choice("01") for _ in range(rng.choice([3, 9, 12]))) for _ in range(150)} | {"a long name of many words " + x for x in ("one", "ones", "two")} | {"x" * i for i in range(1, 6)})
    grams = {x: {f" {x} "[i : i + 3] for i in range(max(1, len(x)))} for x in names}
    jaccard = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    df = rs.near_pairs_exact(spark.createDataFrame([(x,) for x in names], "name string"), threshold)
    want = {(a, b): round(jaccard(a, b), 9) for i, a in enumerate(names) for b in names[i + 1 :] if jaccard(a, b) >= threshold}
    assert {(r.a, r.b): round(r.similarity, 9) for r in df.collect()} == want and want
    assert "Union" in df._jdf.queryExecution().optimizedPlan().toString() or threshold == 0.5
