"""Merging of extraction results, relations, nodes and edges. Every choice among rows has a total order: ``ord``
is the position of a row in the input (chunk, extractor, place), carried as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgweave.functions.ids import relation_id
from kgweave.functions.text import normalize_text
from kgweave.plans import testgraph as tg
from kgweave.plans.registry import query

#: Lower wins; drug-gene actions have 1, unknown types 999 (fixed values).
RELATION_PRIORITY = {"INDICATION": 1, "CONTRAINDICATION": 2, "OFF_LABEL_USE": 3, "ENZYME": 10, "TRANSPORTER": 11, "CARRIER": 12, "TARGET": 13, "OTHER": 100}
#: Types that can't both be true of a pair (fixed values).
EXCLUSIVE = (
    ("INDICATION", "CONTRAINDICATION", "OFF_LABEL_USE"),
    ("AGONIST", "ANTAGONIST", "INVERSE_AGONIST"),
    ("ACTIVATOR", "INHIBITOR"),
    ("POSITIVE_MODULATOR", "NEGATIVE_MODULATOR"),
    ("POSITIVE_ALLOSTERIC_MODULATOR", "NEGATIVE_ALLOSTERIC_MODULATOR"),
)


def first_seen(ord_: Column, value: Column) -> Column:
    """Aggregate: the distinct values that aren't null, in order of first appearance."""
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(ord_.alias("o"), value.alias("v")))))
    return F.array_distinct(F.transform(pairs, lambda x: x["v"]))


def _best(col: str) -> Column:
    return F.max_by(col, F.struct("score", -F.col("ord")))


def normalize_extractions(entities: DataFrame, relations: DataFrame, min_score: float = 0.0, min_length: int = 1, per: tuple[str, ...] = ("chunk_id",), unicode: bool = True) -> tuple[DataFrame, DataFrame]:
    """Merge the raw results of each chunk (``per``): entities ``(chunk_id, ord, extractor, name, label, score)``,
    relations ``(chunk_id, ord, extractor, head_name, tail_name, type, score)``.

    Entities merge by (normal name, label): best score and the name it came with (the earlier in a tie), sources and surface
    forms by first appearance. Relations need both ends among the chunk's entities and merge by (head, tail, type)
    with the best score and the first extractor.
    """
    norm = lambda c: normalize_text(c, unicode)
    e = entities.filter(F.col("score") >= min_score).withColumn("norm", norm("name")).filter(F.length("norm") >= min_length)
    merged = e.groupBy(*per, "norm", "label").agg(
        _best("name").alias("name"), F.max("score").alias("score"), F.min("ord").alias("ord"), first_seen(F.col("ord"), F.col("extractor")).alias("sources"), first_seen(F.col("ord"), F.col("name")).alias("surface_forms")
    )
    # one name for an end: of the entity that came last, when labels differ
    names = merged.groupBy(*per, "norm").agg(F.max_by("name", "ord").alias("name"))
    r = relations.withColumn("h", norm("head_name")).withColumn("t", norm("tail_name")).drop("head_name", "tail_name")
    ends = lambda k, name: names.select(*per, F.col("norm").alias(k), F.col("name").alias(name))
    r = r.join(ends("h", "head_name"), [*per, "h"]).join(ends("t", "tail_name"), [*per, "t"])
    rel = r.groupBy(*per, "h", "t", "type").agg(F.min_by("head_name", "ord").alias("head_name"), F.min_by("tail_name", "ord").alias("tail_name"), F.max("score").alias("score"), F.min_by("extractor", "ord").alias("source"), F.min("ord").alias("ord"))
    return merged, rel


def aggregate_graph(entities: DataFrame, relations: DataFrame, unicode: bool = True) -> tuple[DataFrame, DataFrame]:
    """Merge across chunks: entities ``(ord, name, label, score, sources, surface_forms, chunk_ids)`` by (normal name,
    label), relations ``(ord, head_name, tail_name, type, score, sources, chunk_ids)`` by (head, tail, type). Names are
    the normal ones; lists are united in order of first appearance."""
    norm = lambda c: normalize_text(c, unicode)
    lists = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col(c).alias("v")))), lambda x: x["v"]))).alias(c)
    e = entities.withColumn("name", norm("name")).groupBy("name", "label").agg(F.max("score").alias("score"), F.min("ord").alias("ord"), lists("sources"), lists("surface_forms"), lists("chunk_ids"))
    known = e.select("name").distinct()
    r = relations.withColumn("head_name", norm("head_name")).withColumn("tail_name", norm("tail_name"))
    r = r.join(known.withColumnRenamed("name", "head_name"), "head_name", "left_semi").join(known.withColumnRenamed("name", "tail_name"), "tail_name", "left_semi")
    return e, r.groupBy("head_name", "tail_name", "type").agg(F.max("score").alias("score"), F.min("ord").alias("ord"), lists("sources"), lists("chunk_ids"))


def combine_extractions(rows: DataFrame, keys: list[str], strategy: str = "union", extractors: list[str] | None = None, primary: str = "gliner") -> DataFrame:
    """One row per key from the rows ``(extractor, ord, score, ...)`` of several extractors.

    ``union``: best score of the key. ``intersection``: only keys that all of ``extractors`` (those that ran, also
    with no rows) found. ``max_score``: the whole best row, the earlier in a tie. ``gliner_primary``: the
    primary extractor's rows, and of the others those with new keys; without any primary row, ``union``.
    """
    others = [c for c in rows.columns if c not in {*keys, "score", "ord", "extractor"}]
    whole = rows.groupBy(*keys).agg(F.max("score").alias("score"), F.min("ord").alias("ord"), F.min_by("extractor", "ord").alias("extractor"), F.countDistinct("extractor").alias("_n"), *[F.min_by(c, "ord").alias(c) for c in others])
    if strategy == "union":
        return whole.drop("_n")
    if strategy == "intersection":
        if extractors is None:
            raise ValueError("intersection needs the extractors that ran")
        return whole.filter(F.col("_n") == len(set(extractors))).drop("_n")
    best = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "ord"))
    if strategy == "max_score":
        return rows.withColumn("_r", best).filter("_r = 1").drop("_r")
    if strategy != "gliner_primary":
        raise ValueError(f"no strategy named {strategy}")
    base = rows.filter(F.col("extractor") == primary)
    # without a primary row nothing is shadowed and every other key is new: that is the union
    rest = rows.filter(F.col("extractor") != primary)
    own = lambda df: df.groupBy(*keys).agg(F.max("score").alias("score"), F.min("ord").alias("ord"), F.min_by("extractor", "ord").alias("extractor"), *[F.min_by(c, "ord").alias(c) for c in others])
    return own(base).unionByName(own(rest.join(base.select(*keys).distinct(), keys, "left_anti")))


def collapse_relations(edges: DataFrame, source: str, actions: tuple[str, ...] = ()) -> DataFrame:
    """One edge per (from, to, label): the type of lowest priority (then alphabetical), all asserted types, and
    whether two of them exclude each other. Other columns keep their smallest value."""
    prio = F.create_map(*[x for k, v in ({a: 1 for a in actions} | RELATION_PRIORITY).items() for x in (F.lit(k), F.lit(v))])
    keys = ["from", "to", "label"]
    others = [c for c in edges.columns if c not in {*keys, "type"}]
    out = edges.groupBy(*keys).agg(
        F.min_by("type", F.struct(F.coalesce(F.try_element_at(prio, F.col("type")), F.lit(999)), "type")).alias("type"), F.array_sort(F.collect_set("type")).alias("asserted_relations"), *[F.min(c).alias(c) for c in others]
    )
    clash = F.lit(False)
    for group in EXCLUSIVE:
        clash = clash | (F.size(F.array_intersect("asserted_relations", F.array(*map(F.lit, group)))) >= 2)
    return out.withColumn("relation_assertions", F.transform("asserted_relations", lambda r: F.struct(F.lit(source).alias("source"), r.alias("relation")))).withColumn("relation_conflict", clash)


LISTS = ("chunk_ids", "surface_forms", "sources")


def merge_nodes(existing: DataFrame, incoming: DataFrame, key: str = "id", lists: tuple[str, ...] = LISTS) -> DataFrame:
    """Upsert: an incoming row replaces the old one, nulls included; list columns unite, old values first."""
    a = existing.select(key, F.lit(True).alias("_old"), *[F.col(c).alias(f"_a_{c}") for c in existing.columns if c != key])
    b = incoming.select(key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_b_{c}") for c in existing.columns if c != key])
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(existing.schema[c[3:]].dataType))
    pick = lambda c: F.array_union(empty(f"_a_{c}"), empty(f"_b_{c}")) if c in lists else F.when(F.col("_new"), F.col(f"_b_{c}")).otherwise(F.col(f"_a_{c}"))
    return a.join(b, key, "full_outer").select(*[F.col(c) if c == key else pick(c).alias(c) for c in existing.columns])


def merge_edges(existing: DataFrame, incoming: DataFrame, nodes: DataFrame, head: str = "head_id", tail: str = "tail_id", lists: tuple[str, ...] = LISTS) -> DataFrame:
    """As ``merge_nodes``; incoming edges without both ends among the nodes are left out."""
    ids = nodes.select("id")
    ok = incoming.join(ids.withColumnRenamed("id", head), head, "left_semi").join(ids.withColumnRenamed("id", tail), tail, "left_semi")
    return merge_nodes(existing, ok.select(*existing.columns), "id", lists)


def eval_summary(results: DataFrame) -> DataFrame:
    """``(dataset, sample_id, metric, score, passed, error)`` -> samples, mean score, passed and errors of each metric."""
    return results.groupBy("dataset", "metric").agg(
        F.countDistinct("sample_id").alias("samples"), F.avg("score").alias("mean_score"), F.count_if(F.col("passed")).alias("n_passed"), F.count_if(F.col("error").isNotNull()).alias("n_errors")
    )


def job_progress(items: DataFrame, by: str) -> DataFrame:
    """Items by status, and the percentage that is through; 0 for a job without items."""
    n = F.count("*")
    counts = {s: F.count_if(F.col("status") == s) for s in ("pending", "processing", "succeeded", "failed", "skipped")}
    done = counts["succeeded"] + counts["failed"] + counts["skipped"]
    return items.groupBy(by).agg(n.alias("total"), *[c.alias(s) for s, c in counts.items()], F.coalesce(F.round(F.try_divide(done * F.lit(100.0), n), 4), F.lit(0.0)).alias("percent"))


def link_endpoints(entities: DataFrame, relations: DataFrame, unicode: bool = True) -> DataFrame:
    """Relations by name -> by id, for names that exactly one entity has; the rest is dropped."""
    one = entities.groupBy(normalize_text("name", unicode).alias("n")).agg(F.min("id").alias("id"), F.countDistinct("id").alias("k")).filter("k = 1")
    r = relations.withColumn("_h", normalize_text("head_name", unicode)).withColumn("_t", normalize_text("tail_name", unicode))
    r = r.join(one.select(F.col("n").alias("_h"), F.col("id").alias("head_id")), "_h").join(one.select(F.col("n").alias("_t"), F.col("id").alias("tail_id")), "_t")
    return r.drop("_h", "_t").withColumn("id", relation_id("head_id", "type", "tail_id"))


# Extraction results derived from the tables: an order is a chunk, a line an entity mention or a relation.
_X = """x AS (SELECT l_orderkey AS chunk_id, l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey AS ord, CASE WHEN l_linenumber % 2 = 0 THEN 'gliner' ELSE 'llm' END AS extractor,
  CASE WHEN l_linenumber % 3 = 0 THEN '  Part  ' ELSE 'part ' END || (l_partkey % 7) AS name, l_returnflag AS label, l_quantity / 50 AS score FROM lineitem)"""


def _mentions(spark, d) -> DataFrame:
    return tg.table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS chunk_id", "l_linenumber * 10000000L + l_partkey * 1000 + l_suppkey AS ord", "CASE WHEN l_linenumber % 2 = 0 THEN 'gliner' ELSE 'llm' END AS extractor", "CASE WHEN l_linenumber % 3 = 0 THEN '  Part  ' ELSE 'part ' END || (l_partkey % 7) AS name", "l_returnflag AS label", "l_quantity / 50 AS score"
    )


_NORM = "lower(trim(regexp_replace(name, '\\s+', ' ', 'g')))"
_A1 = f"""WITH {_X}, n AS (SELECT *, {_NORM} AS norm FROM x WHERE score >= 0.2) SELECT chunk_id, norm, label, arg_max(name, (score, -ord)) AS name, max(score) AS score,
 array_to_string(list_distinct_first(list(extractor ORDER BY ord)), ';') AS sources FROM n GROUP BY 1, 2, 3"""
_A1 = _A1.replace("list_distinct_first(list(extractor ORDER BY ord))", "CASE WHEN count(DISTINCT extractor) = 1 THEN [min(extractor)] ELSE [arg_min(extractor, ord), CASE WHEN arg_min(extractor, ord) = 'llm' THEN 'gliner' ELSE 'llm' END] END")


@query("A1_normalize", _A1)
def a1(spark, d):
    m = _mentions(spark, d)
    none = m.select("chunk_id", "ord", "extractor", F.col("name").alias("head_name"), F.col("name").alias("tail_name"), F.col("label").alias("type"), "score")
    return normalize_extractions(m, none, 0.2, unicode=False)[0].select("chunk_id", "norm", "label", "name", "score", F.array_join("sources", ";").alias("sources"))


@query("A2_aggregate", f"WITH {_X}, n AS (SELECT {_NORM} AS name, label, score, chunk_id, extractor FROM x) SELECT name, label, max(score) AS score, count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT extractor) AS n_sources FROM n GROUP BY 1, 2")
def a2(spark, d):
    m = _mentions(spark, d).withColumn("ord", F.col("chunk_id") * 100 + F.col("ord"))
    lists = m.select("ord", "name", "label", "score", F.array("extractor").alias("sources"), F.array("name").alias("surface_forms"), F.array("chunk_id").alias("chunk_ids"))
    r = lists.select("ord", F.col("name").alias("head_name"), F.col("name").alias("tail_name"), F.col("label").alias("type"), "score", "sources", "chunk_ids")
    return aggregate_graph(lists, r, unicode=False)[0].select("name", "label", "score", F.size("chunk_ids").cast("long").alias("n_chunks"), F.size("sources").cast("long").alias("n_sources"))


_KEYED = "SELECT chunk_id, label, max(score) AS score, arg_min(extractor, ord) AS extractor"


@query("A3_union", f"WITH {_X} {_KEYED} FROM x GROUP BY 1, 2")
def a3(spark, d):
    return combine_extractions(_mentions(spark, d).drop("name"), ["chunk_id", "label"]).select("chunk_id", "label", "score", "extractor")


@query("A4_intersection", f"WITH {_X} {_KEYED} FROM x GROUP BY 1, 2 HAVING count(DISTINCT extractor) = 2")
def a4(spark, d):
    return combine_extractions(_mentions(spark, d).drop("name"), ["chunk_id", "label"], "intersection", ["llm", "gliner"]).select("chunk_id", "label", "score", "extractor")


@query("A5_max_score", f"WITH {_X} SELECT chunk_id, label, extractor, name, score FROM x QUALIFY row_number() OVER (PARTITION BY chunk_id, label ORDER BY score DESC, ord) = 1")
def a5(spark, d):
    return combine_extractions(_mentions(spark, d), ["chunk_id", "label"], "max_score").drop("ord")


@query("A5_primary", f"WITH {_X}, k AS (SELECT DISTINCT chunk_id, label FROM x WHERE extractor = 'gliner') {_KEYED} FROM x WHERE extractor = 'gliner' GROUP BY 1, 2 UNION ALL {_KEYED} FROM x WHERE extractor <> 'gliner' AND (chunk_id, label) NOT IN (SELECT (chunk_id, label) FROM k) GROUP BY 1, 2")
def a5_primary(spark, d):
    return combine_extractions(_mentions(spark, d).drop("name"), ["chunk_id", "label"], "gliner_primary").drop("ord")


_FLAG = "CASE l_returnflag WHEN 'A' THEN 'INDICATION' WHEN 'N' THEN 'CONTRAINDICATION' ELSE 'OFF_LABEL_USE' END"


@query("A6_collapse", f"""SELECT l_suppkey AS src, l_partkey AS dst, arg_min(t, CASE t WHEN 'INDICATION' THEN 1 WHEN 'CONTRAINDICATION' THEN 2 ELSE 3 END) AS type,
 array_to_string(list_sort(list(DISTINCT t)), ';') AS asserted, count(DISTINCT t) >= 2 AS conflict FROM (SELECT *, {_FLAG} AS t FROM lineitem) GROUP BY 1, 2""")
def a6(spark, d):
    e = tg.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("from"), F.col("l_partkey").alias("to"), F.lit("SUP-PRT").alias("label"), F.expr(_FLAG).alias("type"))
    return collapse_relations(e, "lineitem").select(F.col("from").alias("src"), F.col("to").alias("dst"), "type", F.array_join("asserted_relations", ";").alias("asserted"), F.col("relation_conflict").alias("conflict"))


@query("A7_merge_nodes", """WITH a AS (SELECT c_custkey AS id, c_name AS name, [c_nationkey] AS chunk_ids FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE upper(c_name) END AS name, [c_nationkey, 99] AS chunk_ids FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN a.name ELSE b.name END AS name, CASE WHEN b.id IS NULL THEN array_to_string(a.chunk_ids, ';') ELSE array_to_string(b.chunk_ids, ';') END AS chunk_ids FROM a FULL JOIN b ON a.id = b.id""")
def a7(spark, d):
    c = tg.table(spark, d, "customer").withColumnRenamed("c_custkey", "id")
    a = c.filter("id % 3 <> 0").select("id", F.col("c_name").alias("name"), F.array("c_nationkey").alias("chunk_ids"))
    b = c.filter("id % 2 = 0").select("id", F.expr("CASE WHEN id % 5 = 0 THEN NULL ELSE upper(c_name) END").alias("name"), F.array("c_nationkey", F.lit(99)).alias("chunk_ids"))
    return merge_nodes(a, b).withColumn("chunk_ids", F.array_join("chunk_ids", ";"))


@query("A9_eval_summary", "SELECT o_orderpriority AS dataset, o_orderstatus AS metric, count(DISTINCT o_orderkey) AS samples, round(avg(least(o_totalprice / 500000, 1)), 6) AS mean_score, count(*) FILTER (o_totalprice > 250000) AS n_passed, count(*) FILTER (o_orderkey % 50 = 0) AS n_errors FROM orders GROUP BY 1, 2")
def a9(spark, d):
    r = tg.table(spark, d, "orders").selectExpr("o_orderpriority AS dataset", "o_orderstatus AS metric", "o_orderkey AS sample_id", "least(o_totalprice / 500000, 1D) AS score", "o_totalprice > 250000 AS passed", "CASE WHEN o_orderkey % 50 = 0 THEN 'x' END AS error")
    return eval_summary(r).withColumn("mean_score", F.round("mean_score", 6))


_STATUS = "CASE event_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'processing' WHEN 3 THEN 'skipped' ELSE 'succeeded' END"


@query("A10_progress", f"""SELECT event_type, count(*) AS total, {', '.join(f"count(*) FILTER (s = '{s}') AS {s}" for s in ("pending", "processing", "succeeded", "failed", "skipped"))},
 round(100.0::DOUBLE * count(*) FILTER (s IN ('succeeded', 'failed', 'skipped')) / count(*), 4) AS percent FROM (SELECT *, {_STATUS} AS s FROM events) GROUP BY 1""")
def a10(spark, d):
    return job_progress(tg.table(spark, d, "events").withColumn("status", F.expr(_STATUS)), "event_type")


@query("E6_link_endpoints", """WITH e AS (SELECT c_custkey AS id, lower(CASE WHEN c_custkey % 10 = 0 THEN c_mktsegment ELSE c_name END) AS n FROM customer), u AS (SELECT n, min(id) AS id FROM e GROUP BY 1 HAVING count(DISTINCT id) = 1)
 SELECT h.id AS head_id, t.id AS tail_id, a.c_mktsegment AS type FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 JOIN u h ON h.n = lower(a.c_name) JOIN u t ON t.n = lower(b.c_name)""")
def e6(spark, d):
    c = tg.table(spark, d, "customer")
    after = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_name").alias("tail_name"))
    r = c.join(after, "c_custkey").select(F.upper("c_name").alias("head_name"), "tail_name", F.col("c_mktsegment").alias("type"))
    entities = c.select(F.col("c_custkey").alias("id"), F.expr("CASE WHEN c_custkey % 10 = 0 THEN c_mktsegment ELSE c_name END").alias("name"))
    return link_endpoints(entities, r, unicode=False).select("head_id", "tail_id", "type")
