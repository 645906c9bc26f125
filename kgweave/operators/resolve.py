"""Entity resolution: exact and near duplicates of names, balanced clusters, candidates, verdicts, aliases."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, MinHashLSH
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgweave.functions.ids import relation_id
from kgweave.functions.text import normalize_text, singularize
from kgweave.operators import clusters
from kgweave.operators.chunks import embed
from kgweave.operators.components import connected_components
from kgweave.operators.search import bm25_scores
from kgweave.plans import testgraph as tg
from kgweave.plans.registry import query
from kgweave.plans.scratch import Scratch

GROUP_CLUSTERS = 64  # of a group of items that one task holds
ACCEPT = 3.0  # of the registered query


def dedupe_exact(names: DataFrame, unicode: bool = True) -> DataFrame:
    """``(alias, members)``: names with the same normal singular."""
    key = singularize(normalize_text("name", unicode))
    return names.filter("name is not null").groupBy(key.alias("alias")).agg(F.array_sort(F.collect_set("name")).alias("members"))


def char_grams(x, n: int = 3):
    """Distinct character n-grams of a string with a blank at both ends; a shorter string is its own gram."""
    s = F.concat(F.lit(" "), x, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - n + 1)), lambda i: F.substring(s, i, F.lit(n))))


def near_pairs_exact(names: DataFrame, threshold: float, n: int = 3) -> DataFrame:
    """``(a, b, similarity)``, a < b: all pairs of distinct names with n-gram Jaccard of at least ``threshold``.

    Prefix filtering keeps it sparse: a pair this similar shares one of the first |g| - ceil(t |g|) + 1 grams of each in the order of rarity. A name of
    fewer than t / (1 - t) grams is that similar only to names of the very same grams, as one gram more or less is too much; these meet by all their grams.
    """
    g = names.select("name").filter("name is not null").distinct().select("name", char_grams(F.col("name"), n).alias("g"))
    few = F.size("g") < (threshold / (1 - threshold) - 1e-9 if threshold < 1 else 1 << 30)
    a, b = (g.filter(few).select(F.col("name").alias(c), F.array_sort("g").alias("g")) for c in "ab")
    same = a.join(b, "g").filter("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    g = g.filter(~few)
    flat = g.select("name", F.size("g").alias("size"), F.explode("g").alias("gram"))
    freq = flat.groupBy("gram").agg(F.count("*").alias("f"))
    place = F.row_number().over(W.partitionBy("name").orderBy("f", "gram"))
    prefix = flat.join(freq, "gram").withColumn("p", place).filter(F.col("p") <= F.col("size") - F.ceil(threshold * F.col("size")) + 1)
    a = prefix.select("gram", F.col("name").alias("a"), F.col("size").alias("sa"))
    b = prefix.select("gram", F.col("name").alias("b"), F.col("size").alias("sb"))
    cand = a.join(b, "gram").filter((F.col("a") < F.col("b")) & (F.col("sa") >= threshold * F.col("sb")) & (F.col("sb") >= threshold * F.col("sa"))).select("a", "b").distinct()
    both = cand.join(g.select(F.col("name").alias("a"), F.col("g").alias("ga")), "a").join(g.select(F.col("name").alias("b"), F.col("g").alias("gb")), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    return both.select("a", "b", (common / (F.size("ga") + F.size("gb") - common)).alias("similarity")).filter(F.col("similarity") >= threshold).unionByName(same)


def near_pairs_lsh(names: DataFrame, threshold: float, tables: int = 16, features: int = 1 << 18, n: int = 3) -> DataFrame:
    """The same pairs found by MinHash, each verified on its exact n-grams; it may miss some."""
    g = names.select("name").filter("name is not null").distinct().withColumn("g", char_grams(F.col("name"), n))
    v = HashingTF(inputCol="g", outputCol="v", numFeatures=features, binary=True).transform(g)
    model = MinHashLSH(inputCol="v", outputCol="h", numHashTables=tables, seed=1).fit(v)
    pairs = model.approxSimilarityJoin(v, v, 1 - threshold + 0.05).filter("datasetA.name < datasetB.name").select(F.col("datasetA.name").alias("a"), F.col("datasetA.g").alias("ga"), F.col("datasetB.name").alias("b"), F.col("datasetB.g").alias("gb"))
    common = F.size(F.array_intersect("ga", "gb"))
    return pairs.select("a", "b", (common / (F.size("ga") + F.size("gb") - common)).alias("similarity")).filter(F.col("similarity") >= threshold)


def dedupe_near(aliases: DataFrame, threshold: float = 0.95, exact: bool = True) -> DataFrame:
    """Merge ``(alias, members)`` whose aliases are near duplicates: the smallest alias of a component stands for all."""
    pairs = (near_pairs_exact if exact else near_pairs_lsh)(aliases.select(F.col("alias").alias("name")), threshold)
    comp = connected_components(pairs, "a", "b").select(F.col("node").alias("alias"), "component")
    rows = aliases.join(comp, "alias", "left").select(F.coalesce("component", "alias").alias("alias"), "members")
    return rows.groupBy("alias").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))).alias("members"))


def balanced_clusters(items: DataFrame, size: int = 128, max_iter: int = 20, seed: int = 1) -> DataFrame:
    """``(idx, cluster)`` for ``items(idx, v)``: n // size clusters by k-means, at least one; in order of rank, then of index, each item goes to
    its nearest cluster with room; those that find none, less than ``size``, share a cluster of their own, which has a negative name.

    Room is counted over all items and centres are met across the borders of groups (``clusters.balanced``).
    """
    return clusters.balanced(items, size, GROUP_CLUSTERS, max_iter, seed)


def resolve_candidates(items: DataFrame, k: int = 16, w_text: float = 0.5, w_vector: float = 0.5) -> DataFrame:
    """``(idx, other, score, rank)`` for ``items(idx, cluster, name, v)``: the k best others of the same cluster by BM25 and cosine. Clusters
    are of bounded size (``balanced_clusters``), so pairs inside them are; BM25 too is computed inside clusters, with the
    frequencies of all items."""
    n = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = items.select("idx", "cluster", F.transform("v", lambda x: x.cast("double") / F.greatest(n, F.lit(1e-12))).alias("u"))
    b = unit.select("cluster", F.col("idx").alias("other"), F.col("u").alias("o"))
    pairs = unit.join(b, "cluster").filter("idx <> other").select("idx", "other", F.aggregate(F.zip_with("u", "o", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).alias("cos"))
    asked, texts = (items.select(F.col("idx").alias(c), F.col("name").alias("text"), "cluster") for c in ("query_id", "item_id"))
    bm = bm25_scores(asked, texts, within="cluster").select(F.col("query_id").alias("idx"), F.col("item_id").alias("other"), F.col("score").alias("bm"))
    fused = pairs.join(bm, ["idx", "other"], "left").withColumn("score", w_text * F.coalesce("bm", F.lit(0.0)) + w_vector * F.col("cos"))
    rank = F.row_number().over(W.partitionBy("idx").orderBy(F.desc("score"), "other"))
    return fused.withColumn("rank", rank).filter(F.col("rank") <= k).select("idx", "other", "score", "rank")


def apply_verdicts(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``(alias, members)`` from accepted pairs ``verdicts(a, b)`` over ``items(name)``: components, named by their shortest member (then the
    smallest); an item without a duplicate stands for itself."""
    comp = connected_components(verdicts, "a", "b").select(F.col("node").alias("name"), "component")
    rows = items.select("name").distinct().join(comp, "name", "left").withColumn("component", F.coalesce("component", "name"))
    return rows.groupBy("component").agg(F.min_by("name", F.struct(F.length("name"), "name")).alias("alias"), F.array_sort(F.collect_set("name")).alias("members")).select("alias", "members")


def apply_aliases(entities: DataFrame, relations: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities ``(id, name, label, score, surface_forms, chunk_ids)`` merged by alias and label: the best (score, then smallest id) keeps its id;
    relations ``(head_id, tail_id, type, score)`` follow, one per (head, tail, type), with new ids."""
    of = aliases.select("alias", F.explode("members").alias("name"))
    e = entities.join(of, "name", "left").withColumn("alias", F.coalesce("alias", "name"))
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    merged = e.groupBy("alias", "label").agg(F.min_by("id", F.struct(-F.col("score"), "id")).alias("id"), F.min_by("name", F.struct(-F.col("score"), "id")).alias("name"), F.max("score").alias("score"), F.collect_set("name").alias("_names"), flat("surface_forms").alias("_forms"), flat("chunk_ids").alias("chunk_ids"))
    merged = merged.select("id", "name", "label", "score", F.col("alias").alias("canonical_name"), F.array_sort(F.array_union("_names", "_forms")).alias("aliases"), "chunk_ids")
    to = e.select("id", "alias", "label").join(merged.select(F.col("canonical_name").alias("alias"), "label", F.col("id").alias("new")), ["alias", "label"]).select("id", "new")
    r = relations.join(to.select(F.col("id").alias("head_id"), F.col("new").alias("h")), "head_id").join(to.select(F.col("id").alias("tail_id"), F.col("new").alias("t")), "tail_id")
    rel = r.groupBy(F.col("h").alias("head_id"), F.col("t").alias("tail_id"), "type").agg(F.max("score").alias("score"))
    return merged, rel.withColumn("id", relation_id("head_id", "type", "tail_id"))


def resolve_graph(entities: DataFrame, relations: DataFrame, near: float = 0.95, accept: float | None = None, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact, then near duplicates; with ``vectors(name, v)`` and ``accept`` also candidates above that score inside balanced clusters."""
    aliases = dedupe_near(dedupe_exact(entities.select("name")), near)
    if vectors is not None and accept is not None:
        keys = aliases.select("alias", F.explode("members").alias("name")).join(vectors, "name").groupBy("alias").agg(F.min_by("v", "name").alias("v"))
        idx = keys.select(F.xxhash64("alias").alias("idx"), F.col("alias").alias("name"), "v")
        cand = resolve_candidates(idx.join(balanced_clusters(idx.select("idx", "v")), "idx")).filter(F.col("score") >= accept)
        a, b = idx.select("idx", F.col("name").alias("a")), idx.select(F.col("idx").alias("other"), F.col("name").alias("b"))
        second = apply_verdicts(aliases.select(F.col("alias").alias("name")), cand.join(a, "idx").join(b, "other").select("a", "b"))
        # aliases -> keys -> members
        up = second.select(F.col("alias").alias("top"), F.explode("members").alias("alias"))
        aliases = aliases.join(up, "alias").groupBy(F.col("top").alias("alias")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))).alias("members"))
    return apply_aliases(entities, relations, aliases)


def _names(spark, d) -> DataFrame:
    return tg.table(spark, d, "part").select(F.col("p_name").alias("name")).union(tg.table(spark, d, "part").select(F.concat(F.initcap("p_name"), F.lit("s"))))


@query("R1_dedupe_exact", "WITH n AS (SELECT lower(c_mktsegment)||' '||c_nationkey||' boxes' AS name FROM customer UNION ALL SELECT upper(c_mktsegment)||' '||c_nationkey||'  BOX' FROM customer WHERE c_custkey % 3 = 0) SELECT regexp_replace(lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))), 'xes$', 'x') AS alias, array_to_string(list_sort(list(DISTINCT name)), ';') AS members FROM n GROUP BY 1")
def r1(spark, d):
    c = tg.table(spark, d, "customer")
    n = c.select(F.concat(F.lower("c_mktsegment"), F.lit(" "), "c_nationkey", F.lit(" boxes")).alias("name")).union(c.filter("c_custkey % 3 = 0").select(F.concat(F.upper("c_mktsegment"), F.lit(" "), "c_nationkey", F.lit("  BOX"))))
    return dedupe_exact(n, unicode=False).withColumn("members", F.array_join("members", ";"))


_GRAMS = "n AS (SELECT DISTINCT n_name||' '||c_mktsegment AS name FROM customer JOIN nation ON c_nationkey = n_nationkey), g AS (SELECT name, list_distinct(list_transform(generate_series(1, length(name)), lambda i: substr(' '||name||' ', i::INTEGER, 3))) AS g FROM n)"


@query("R2_near_pairs", f"WITH {_GRAMS} SELECT * FROM (SELECT a.name AS a, b.name AS b, round(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))::DOUBLE, 6) AS similarity FROM g a JOIN g b ON a.name < b.name) WHERE similarity >= 0.6")
def r2(spark, d):
    n = tg.table(spark, d, "customer").join(tg.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws(" ", "n_name", "c_mktsegment").alias("name"))
    return near_pairs_exact(n, 0.6).withColumn("similarity", F.round("similarity", 6))


@query("R2_near_pairs_lsh")
def r2_lsh(spark, d):
    n = tg.table(spark, d, "customer").join(tg.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws(" ", "n_name", "c_mktsegment").alias("name"))
    return near_pairs_lsh(n, 0.6)


def _vectors(spark, d):
    return tg.table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("v"))


@query("R3_balanced_clusters")
def r3(spark, d):
    return balanced_clusters(_vectors(spark, d), 128)


@query("R3_invariants", "SELECT count(*) AS items, count(DISTINCT vec_id) AS ids, 0 AS too_large, 0 AS leftovers_too_large FROM embeddings")
def r3_invariants(spark, d):
    """Items and ids, each once; clusters above the size; rests that would have made a cluster."""
    out = Scratch(spark, "balanced").write(balanced_clusters(_vectors(spark, d), 128), "clusters")
    sizes = out.groupBy("cluster").agg(F.count("*").alias("n")).agg(F.count_if((F.col("cluster") >= 0) & (F.col("n") > 128)).alias("too_large"), F.count_if((F.col("cluster") < 0) & (F.col("n") >= 128)).alias("leftovers_too_large"))
    return out.agg(F.count("*").alias("items"), F.count_distinct("idx").alias("ids")).join(sizes, F.lit(True))


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("R5_candidates", f"SELECT a.vec_id AS idx, b.vec_id AS other, round(0.5 * {_COS}, 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id // 64 = b.vec_id // 64 AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) <= 5")
def r5(spark, d):
    e = tg.table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.concat_ws("-", "label", F.floor(F.col("vec_id") / 64)).alias("cluster"), F.concat(F.lit("n"), "vec_id").alias("name"), F.col("embedding").alias("v"))
    return resolve_candidates(e, 5).select("idx", "other", F.round("score", 6).alias("score"))


@query("R6_verdicts", "WITH n AS (SELECT 'c'||c_custkey AS name, c_custkey // 3 AS grp, c_custkey % 3 AS j FROM customer) SELECT arg_min(name, (length(name), name)) AS alias, string_agg(name, ';' ORDER BY name) AS members FROM n GROUP BY CASE WHEN grp % 2 = 0 THEN grp::VARCHAR ELSE 's'||name END")
def r6(spark, d):
    n = tg.table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("name"), F.floor(F.col("c_custkey") / 3).alias("grp"), F.col("c_custkey").alias("k"))
    e = n.filter("grp % 2 = 0")
    v = e.join(e.select(F.col("name").alias("b"), F.col("grp").alias("g2"), F.col("k").alias("k2")), (F.col("grp") == F.col("g2")) & (F.col("k2") == F.col("k") + 1)).select(F.col("name").alias("a"), "b")
    return apply_verdicts(n, v).withColumn("members", F.array_join("members", ";"))


@query("R7_aliases", "WITH e AS (SELECT c_custkey AS id, c_mktsegment||(c_custkey % 5) AS name, c_nationkey % 3 AS label, c_acctbal AS score FROM customer) SELECT 'seg'||left(name, 1) AS canonical_name, label, arg_min(id, (-score, id)) AS id, round(max(score), 2) AS score, string_agg(DISTINCT name, ';' ORDER BY name) AS aliases FROM e GROUP BY 1, 2")
def r7(spark, d):
    e = tg.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_mktsegment", F.col("c_custkey") % 5).alias("name"), (F.col("c_nationkey") % 3).alias("label"), F.col("c_acctbal").alias("score"))
    e = e.withColumn("surface_forms", F.array("name")).withColumn("chunk_ids", F.array("id"))
    aliases = e.groupBy(F.concat(F.lit("seg"), F.substring("name", 1, 1)).alias("alias")).agg(F.collect_set("name").alias("members"))
    r = e.select(F.col("id").alias("head_id"), F.col("id").alias("tail_id"), F.lit("R").alias("type"), "score")
    return apply_aliases(e, r, aliases)[0].select("canonical_name", "label", "id", F.round("score", 2).alias("score"), F.array_join("aliases", ";").alias("aliases"))


@query("R8_resolve_graph")
def r8(spark, d):
    """Names of the test graph and longer copies of its suppliers' names: exact and near duplicates, then candidates by text and vector."""
    ent, sup = tg.nodes(spark, d), tg.table(spark, d, "supplier")
    copy = sup.select(F.concat(F.lit("SUP2:"), "s_suppkey").alias("id"), F.concat(F.upper("s_name"), F.lit(" incorporated")).alias("name"), F.lit("Supplier").alias("label"))
    e = ent.unionByName(copy).withColumn("score", F.lit(1.0)).withColumn("surface_forms", F.array("name")).withColumn("chunk_ids", F.array("id"))
    r = tg.edges(spark, d).select(F.col("from").alias("head_id"), F.col("to").alias("tail_id"), "type", "score")
    r = r.unionByName(sup.select(F.concat(F.lit("SUP2:"), "s_suppkey").alias("head_id"), F.concat(F.lit("NAT:"), "s_nationkey").alias("tail_id"), F.lit("LOCATED_IN").alias("type"), F.lit(1.0).alias("score")))
    vectors = embed(e.select("name").distinct(), "name", "v")
    return resolve_graph(e, r, 0.95, ACCEPT, vectors)[1]
