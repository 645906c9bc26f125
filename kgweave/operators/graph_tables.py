"""Identity, projection and maintenance of node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.functions.ids import curie_to_entity_id, duck_uuid5, identity_id, prefixed, relation_id, to_biolink, uuid5
from kgweave.plans import testgraph as tg
from kgweave.plans.registry import query

RESERVED = {"id", "curie", "name", "label", "description", "score", "aliases"}


def nodes_to_entities(nodes: DataFrame, dataset: str, curie: str = "id") -> DataFrame:
    """Nodes -> entities: id from the curie; name, score and aliases get defaults; other columns that aren't null
    become string properties, stamped with the data set."""
    have = set(nodes.columns)
    pick = lambda c, other: F.coalesce(F.col(c), other) if c in have else other
    pairs = [x for c in nodes.columns if c not in RESERVED | {curie} for x in (F.lit(c), F.col(c).cast("string"))]
    props = F.map_filter(F.create_map(*pairs, F.lit("dataset"), F.lit(dataset)), lambda _, v: v.isNotNull())
    return nodes.select(
        curie_to_entity_id(curie).alias("id"), F.col(curie).alias("curie"), pick("name", F.col(curie)).alias("name"), "label",
        pick("score", F.lit(1.0)).alias("score"), pick("aliases", F.array().cast("array<string>")).alias("aliases"), props.alias("schema_properties"),
    )


def edges_to_relations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges -> relations with end names and a description made of them; ends without a node keep their curie."""
    names = lambda end: nodes.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"))
    e = edges.join(names("from"), "from", "left").join(names("to"), "to", "left")
    head, tail = F.coalesce("from_name", "from"), F.coalesce("to_name", "to")
    h, t = curie_to_entity_id("from"), curie_to_entity_id("to")
    text = F.concat(head, F.lit(" "), F.replace(F.lower("type"), F.lit("_"), F.lit(" ")), F.lit(" "), tail)
    return e.select(relation_id(h, "type", t).alias("id"), h.alias("head_id"), t.alias("tail_id"), head.alias("head_name"), tail.alias("tail_name"), "type", text.alias("description"), "score", F.col("label").alias("structural_label"))


def filter_valid_edges(edges: DataFrame, nodes: DataFrame, src: str = "from", dst: str = "to") -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id")
    return edges.join(ids, edges[src] == ids["id"], "left_semi").join(ids, edges[dst] == ids["id"], "left_semi")


def endpoint_nodes(nodes: DataFrame, edges: DataFrame, isolated: bool = False) -> DataFrame:
    """Nodes that some edge ends at, or those that none does."""
    ends = edges.select(F.col("from").alias("id")).union(edges.select("to")).distinct()
    return nodes.join(ends, "id", "left_anti" if isolated else "left_semi")


def validate_graph(nodes: DataFrame, edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges whose (head label, type, tail label) the schema ``allowed(head_label, type, tail_label)`` lacks."""
    labels = lambda end, col: nodes.select(F.col("id").alias(end), F.col("label").alias(col))
    typed = edges.join(labels("from", "head_label"), "from").join(labels("to", "tail_label"), "to")
    return typed.join(allowed, ["head_label", "type", "tail_label"], "left_anti")


def apply_patches(nodes: DataFrame, patches: DataFrame, key: str = "id", frozen: tuple[str, ...] = ()) -> DataFrame:
    """A patch's values that aren't null replace the old ones; ``frozen`` columns never change."""
    change = [c for c in patches.columns if c in nodes.columns and c != key and c not in frozen]
    p = patches.select(key, *[F.col(c).alias(f"_new_{c}") for c in change])
    return nodes.join(p, key, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in change else F.col(c) for c in nodes.columns])


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes ``ids(id)`` and without the edges at them."""
    gone = ids.select("id")
    return nodes.join(gone, "id", "left_anti"), edges.join(gone, edges["from"] == gone["id"], "left_anti").join(gone, edges["to"] == gone["id"], "left_anti")


def delete_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select("id"), "id", "left_anti")


def keyset_page(df: DataFrame, limit: int, cursor: str | None = None, where: Column | None = None, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The next ``limit`` rows after the cursor, and the next cursor (null unless the page is full)."""
    rows = df if where is None else df.filter(where)
    rows = rows if cursor is None else rows.filter(F.col(key) > cursor)
    page = rows.orderBy(key).limit(limit)
    return page, page.agg(F.when(F.count("*") == limit, F.max(key)).alias("cursor"))


def add_facts(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``facts(head, head_label, relation, tail, tail_label)`` -> distinct entities and relations with their ids."""
    ends = facts.select(F.col("head").alias("name"), F.col("head_label").alias("label")).union(facts.select("tail", "tail_label")).distinct()
    entities = ends.select(identity_id("Entity", "name", "label").alias("id"), "name", "label").dropDuplicates(["id"])
    h, t = identity_id("Entity", "head", "head_label"), identity_id("Entity", "tail", "tail_label")
    rel = facts.select(identity_id("Relation", h, t, "relation").alias("id"), h.alias("head_id"), t.alias("tail_id"), F.col("relation").alias("type")).dropDuplicates(["id"])
    return entities, rel


def kg_counts(**tables: DataFrame) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("collection"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


@query("P1_identity", f"SELECT c_custkey, {duck_uuid5('c_name')} AS raw, {duck_uuid5(chr(39) + 'Entity:' + chr(39) + '||replace(replace(lower(c_name),' + repr(' ') + ',' + repr('_') + '),chr(39),' + repr('') + ')||' + repr('|') + '||replace(lower(c_mktsegment),' + repr(' ') + ',' + repr('_') + ')')} AS id FROM customer")
def p1(spark: SparkSession, d: str) -> DataFrame:
    return tg.table(spark, d, "customer").select("c_custkey", uuid5("c_name").alias("raw"), identity_id("Entity", "c_name", "c_mktsegment").alias("id"))


_ENT = lambda c: duck_uuid5(f"'Entity:curie:'||trim({c})")
_RAW = 'raw AS (SELECT "from", "to", type, ' + f'{_ENT(chr(34) + "from" + chr(34))} AS h, {_ENT(chr(34) + "to" + chr(34))} AS t FROM edges)'


@query("P2_curie_ids", f"WITH {tg.SQL} SELECT id AS curie, {_ENT('id')} AS id FROM nodes")
def p2(spark, d):
    return tg.nodes(spark, d).select(F.col("id").alias("curie"), curie_to_entity_id("id").alias("id"))


@query("P3_relation_ids", f"WITH {tg.SQL}, {_RAW} SELECT \"from\" AS src, \"to\" AS dst, type, {duck_uuid5(chr(39) + 'Relation:' + chr(39) + '||h||' + repr('|') + '||type||' + repr('|') + '||t')} AS id FROM raw")
def p3(spark, d):
    return tg.edges(spark, d).select(F.col("from").alias("src"), F.col("to").alias("dst"), "type", relation_id(curie_to_entity_id("from"), "type", curie_to_entity_id("to")).alias("id"))


_CUR = "CASE p_partkey % 4 WHEN 0 THEN 'MONDO:' WHEN 1 THEN 'HP:' WHEN 2 THEN 'REG:' ELSE 'Orphanet:' END || p_partkey"


@query("P4_biolink", f"SELECT p_partkey, regexp_replace({_CUR}, '^(UBERON|HP|MONDO|GO|CL|Orphanet):', '\\1_') AS curie FROM part")
def p4(spark, d):
    return tg.table(spark, d, "part").select("p_partkey", to_biolink(F.expr(_CUR)).alias("curie"))


@query("P5_prefixed", "SELECT p_partkey, CASE WHEN starts_with(x, 'MESH:') THEN x ELSE 'MESH:'||x END AS curie FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'MESH:' ELSE '' END || p_partkey AS x FROM part)")
def p5(spark, d):
    return tg.table(spark, d, "part").select("p_partkey", prefixed(F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'MESH:' ELSE '' END || p_partkey"), "MESH:").alias("curie"))


@query("P6_entities", f"WITH {tg.SQL} SELECT {_ENT('id')} AS id, id AS curie, name, label, 1.0::DOUBLE AS score, 0 AS n_aliases, 'dataset=tg' AS props FROM nodes")
def p6(spark, d):
    e = nodes_to_entities(tg.nodes(spark, d), "tg")
    props = F.array_join(F.array_sort(F.transform(F.map_entries("schema_properties"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ";")
    return e.select("id", "curie", "name", "label", "score", F.size("aliases").alias("n_aliases"), props.alias("props"))


@query("P7_relations", f"WITH {tg.SQL} SELECT {_ENT('e.' + chr(34) + 'from' + chr(34))} AS head_id, a.name AS head_name, b.name AS tail_name, e.type, a.name||' '||replace(lower(e.type),'_',' ')||' '||b.name AS description, e.score, e.label AS structural_label FROM edges e JOIN nodes a ON a.id = e.\"from\" JOIN nodes b ON b.id = e.\"to\"")
def p7(spark, d):
    return edges_to_relations(tg.edges(spark, d), tg.nodes(spark, d)).drop("id", "tail_id")


@query("P8_valid_edges", f"WITH {tg.SQL}, n AS (SELECT id FROM nodes WHERE label <> 'Supplier') SELECT \"from\" AS src, \"to\" AS dst, type FROM edges WHERE \"from\" IN (SELECT id FROM n) AND \"to\" IN (SELECT id FROM n)")
def p8(spark, d):
    return filter_valid_edges(tg.edges(spark, d), tg.nodes(spark, d).filter("label <> 'Supplier'")).select(F.col("from").alias("src"), F.col("to").alias("dst"), "type")


@query("P11_invalid_edges", f"WITH {tg.SQL} SELECT type, a.label AS head_label, b.label AS tail_label, count(*) AS n FROM edges e JOIN nodes a ON a.id = e.\"from\" JOIN nodes b ON b.id = e.\"to\" WHERE NOT (type IN ('PART_OF','SUPPLIES') OR type = 'LOCATED_IN' AND a.label = 'Customer') GROUP BY 1, 2, 3")
def p11(spark, d):
    allowed = spark.sql("SELECT * FROM VALUES ('Nation','PART_OF','Region'),('Supplier','SUPPLIES','Part'),('Customer','LOCATED_IN','Nation') AS t(head_label,type,tail_label)")
    return validate_graph(tg.nodes(spark, d), tg.edges(spark, d), allowed).groupBy("type", "head_label", "tail_label").agg(F.count("*").alias("n"))


@query("P12_patches", f"WITH {tg.SQL} SELECT n.id, CASE WHEN label = 'Part' AND p_size > 25 THEN upper(name) ELSE name END AS name, label FROM nodes n LEFT JOIN part ON n.id = 'PRT:'||p_partkey")
def p12(spark, d):
    patches = tg.table(spark, d, "part").select(F.concat(F.lit("PRT:"), "p_partkey").alias("id"), F.when(F.col("p_size") > 25, F.upper("p_name")).alias("name"), F.lit("X").alias("label"))
    return apply_patches(tg.nodes(spark, d), patches, frozen=("label",))


@query("P13_delete", f"WITH {tg.SQL}, g AS (SELECT id FROM nodes WHERE label = 'Part' AND id LIKE '%7') SELECT 'node' AS kind, label, count(*) AS n FROM nodes WHERE id NOT IN (SELECT id FROM g) GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM edges WHERE \"from\" NOT IN (SELECT id FROM g) AND \"to\" NOT IN (SELECT id FROM g) GROUP BY 2")
def p13(spark, d):
    n = tg.nodes(spark, d)
    left, kept = delete_nodes(n, tg.edges(spark, d), n.filter("label = 'Part' AND id LIKE '%7'"))
    count = lambda df, kind, by: df.groupBy(F.col(by).alias("label")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "label", "n")
    return count(left, "node", "label").union(count(kept, "edge", "type"))


@query("P14_page", f"WITH {tg.SQL} SELECT id, name FROM nodes WHERE id > 'PRT:15' AND label = 'Part' ORDER BY id LIMIT 50")
def p14(spark, d):
    return keyset_page(tg.nodes(spark, d), 50, "PRT:15", F.col("label") == "Part")[0].select("id", "name")


@query("P15_facts", f"WITH f AS (SELECT DISTINCT c_mktsegment AS head, n_name AS tail FROM customer JOIN nation ON n_nationkey = c_nationkey), i AS (SELECT {duck_uuid5(chr(39) + 'Entity:' + chr(39) + '||lower(replace(head,' + repr(' ') + ',' + repr('_') + '))||' + repr('|segment'))} AS h, {duck_uuid5(chr(39) + 'Entity:' + chr(39) + '||lower(replace(tail,' + repr(' ') + ',' + repr('_') + '))||' + repr('|nation'))} AS t FROM f) SELECT {duck_uuid5(chr(39) + 'Relation:' + chr(39) + '||h||' + repr('|') + '||t||' + repr('|sold_in'))} AS id, h AS head_id, t AS tail_id, 'SOLD_IN' AS type FROM i")
def p15(spark, d):
    c = tg.table(spark, d, "customer").join(tg.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    facts = c.select(F.col("c_mktsegment").alias("head"), F.lit("Segment").alias("head_label"), F.lit("SOLD_IN").alias("relation"), F.col("n_name").alias("tail"), F.lit("Nation").alias("tail_label"))
    return add_facts(facts)[1]


@query("B14_endpoints_isolated", f"WITH {tg.SQL}, x AS (SELECT \"from\" AS id FROM edges UNION SELECT \"to\" FROM edges) SELECT label, count(*) FILTER (id IN (SELECT id FROM x)) AS linked, count(*) FILTER (id NOT IN (SELECT id FROM x)) AS isolated FROM nodes GROUP BY 1")
def b14(spark, d):
    n, e = tg.nodes(spark, d), tg.edges(spark, d)
    both = endpoint_nodes(n, e).withColumn("i", F.lit(0)).union(endpoint_nodes(n, e, True).withColumn("i", F.lit(1)))
    return both.groupBy("label").agg(F.sum(1 - F.col("i")).cast("long").alias("linked"), F.sum("i").cast("long").alias("isolated"))


@query("A8_counts", f"WITH {tg.SQL} SELECT 'documents' AS collection, count(*) AS n FROM documents UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges")
def a8(spark, d):
    return kg_counts(documents=tg.table(spark, d, "documents"), nodes=tg.nodes(spark, d), edges=tg.edges(spark, d))
