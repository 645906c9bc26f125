"""Harmonizing, enriching and looking up: the joins of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgweave.plans import testgraph as tg
from kgweave.plans.registry import query


def ensembl_ncbi(targets: DataFrame, genes: DataFrame) -> DataFrame:
    """``(ncbi_id, ensembl_id)`` through the gene symbol."""
    t = targets.select(F.col("id").alias("ensembl_id"), F.col("metadata.approved_symbol").alias("symbol"))
    return t.join(genes.select("symbol", "ncbi_id"), "symbol").select("ncbi_id", "ensembl_id").distinct()


def chembl_drugbank(molecules: DataFrame) -> DataFrame:
    """``(drugbank_id, chembl_id)`` from the molecules' cross references."""
    refs = molecules.select(F.col("id").alias("chembl_id"), F.explode("metadata.cross_references").alias("r")).filter(F.lower("r.source") == "drugbank")
    return refs.select(F.explode("r.ids").alias("drugbank_id"), "chembl_id").distinct()


def umls_disease(diseases: DataFrame) -> DataFrame:
    """``(umls_id, disease_id)`` from the diseases' cross references."""
    refs = diseases.select(F.col("id").alias("disease_id"), F.explode("metadata.db_xrefs").alias("x")).filter(F.col("x").startswith("UMLS"))
    return refs.select(F.regexp_replace("x", "UMLS:", "").alias("umls_id"), "disease_id").distinct()


def harmonize(df: DataFrame, col: str, mapping: DataFrame, source: str, target: str, how: str = "inner") -> DataFrame:
    """``col`` through the map: unmapped rows go (``inner``) or keep their id (``left``)."""
    m = mapping.select(F.col(source).alias(col), F.col(target).alias("_to"))
    out = df.join(m, col, how)
    return out.withColumn(col, F.coalesce("_to", col) if how == "left" else F.col("_to")).drop("_to").select(*df.columns)


def enrich(nodes: DataFrame, metadata: DataFrame, key: str = "id") -> DataFrame:
    """Nodes with the metadata's columns; of several metadata rows for a key the smallest counts, so rows never fan out."""
    cols = [c for c in metadata.columns if c != key]
    one = metadata.groupBy(key).agg(F.min(F.struct(*cols)).alias("_m")).select(key, "_m.*")
    return nodes.join(one, key, "left")


def hydrate(hits: DataFrame, rows: DataFrame, key: str = "item_id") -> DataFrame:
    """Hits with the full rows of their ids; a hit without a row stays. ``rank`` keeps the order."""
    return hits.join(rows.withColumnRenamed("id", key), key, "left")


def _gathered(pairs: DataFrame, links: DataFrame, key: str, value: str, name: str, limit: int | None) -> DataFrame:
    """``(chunk_id, name)``: the sorted ``value`` of ``links(key, value)`` over the entities of each chunk. They are gathered once for each entity and then joined, so
    an entity in many chunks isn't multiplied by what it is linked with; with ``limit`` no array holds more than an entity's and a chunk's first."""
    links = links.select(F.col(key).alias("entity_id"), F.col(value).alias("_v")).filter("_v is not null").distinct()
    if limit is not None:
        links = links.withColumn("_r", F.row_number().over(W.partitionBy("entity_id").orderBy("_v"))).filter(F.col("_r") <= limit)
    per = links.groupBy("entity_id").agg(F.collect_list("_v").alias("_all"))
    out = F.array_sort(F.array_distinct(F.flatten(F.collect_list("_all"))))
    return pairs.join(per, "entity_id").groupBy("chunk_id").agg((out if limit is None else F.slice(out, 1, limit)).alias(name))


def chunk_context(ids: DataFrame, chunks: DataFrame, mentions: DataFrame, relations: DataFrame, membership: DataFrame, limit: int | None = None) -> DataFrame:
    """For chunks ``ids(chunk_id)``: entities mentioned, relations out of them, next and previous chunk, communities; of each list the
    first ``limit``, else all. Each side is gathered before the joins, so sides don't multiply."""
    of = mentions.join(ids, "chunk_id", "left_semi").select("chunk_id", "entity_id").distinct()
    own = of if limit is None else of.withColumn("_r", F.row_number().over(W.partitionBy("chunk_id").orderBy("entity_id"))).filter(F.col("_r") <= limit)
    ents = own.groupBy("chunk_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entities"))
    rels = _gathered(of, relations, "head_id", "id", "relations", limit)
    comms = _gathered(of, membership, "node_id", "community_id", "communities", limit)
    out = ids.join(chunks.select("chunk_id", "next_id", "prev_id"), "chunk_id", "left")
    for side in (ents, rels, comms):
        out = out.join(side, "chunk_id", "left")
    return out


def member_subgraph(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges inside each community: ``(community_id, from, to, type)``."""
    a = membership.select("community_id", F.col("node_id").alias("from"))
    b = membership.select("community_id", F.col("node_id").alias("to"))
    return edges.join(a, "from").join(b, ["community_id", "to"]).select("community_id", "from", "to", "type")


def community_members(membership: DataFrame, mentions: DataFrame) -> DataFrame:
    """Members of each community with the chunks that mention them."""
    m = mentions.groupBy(F.col("entity_id").alias("node_id")).agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    return membership.join(m, "node_id", "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast(m.schema["chunk_ids"].dataType)))


def reports_at_level(communities: DataFrame, reports: DataFrame, level: int) -> DataFrame:
    return reports.join(communities.filter(F.col("level") == level).select("community_id", "level"), "community_id").withColumn("score", F.lit(1.0))


def entity_relations(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges at the nodes ``ids(id)`` in either direction, once each."""
    out = edges.join(ids, edges["from"] == ids["id"]).select("id", "from", "to", "type")
    return out.union(edges.join(ids, edges["to"] == ids["id"]).select("id", "from", "to", "type")).distinct()


def seed_entities(ids: DataFrame, links: DataFrame, key: str, entity: str = "entity_id") -> DataFrame:
    """Entities linked to a query's seeds: ``ids(query_id, key)`` -> ``(query_id, node_id)``."""
    return ids.join(links.select(key, F.col(entity).alias("node_id")), key).select("query_id", "node_id").distinct()


def structural_links(kind: str, links: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """Distinct links ``(src, dst)`` of a kind, where both ends exist (``src(id)``, ``dst(id)``)."""
    out = links.filter("src is not null and dst is not null").distinct()
    out = out.join(src.select(F.col("id").alias("src")), "src", "left_semi").join(dst.select(F.col("id").alias("dst")), "dst", "left_semi")
    return out.select(F.lit(kind).alias("type"), "src", "dst")


def _t(spark, d, name):
    return tg.table(spark, d, name)


@query("E4_harmonize_inner", "SELECT c_custkey, n_name AS c_nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 2 = 0")
def e4(spark, d):
    n = _t(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("k"), "n_name")
    return harmonize(_t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("c_nation")), "c_nation", n, "k", "n_name")


@query("E4_harmonize_left", "SELECT c_custkey, coalesce(n_name, c_nationkey::VARCHAR) AS c_nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 2 = 0")
def e4_left(spark, d):
    n = _t(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("k"), "n_name")
    return harmonize(_t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("c_nation")), "c_nation", n, "k", "n_name", "left")


@query("E5_enrich", f"WITH {tg.SQL}, m AS (SELECT 'PRT:'||l_partkey AS id, min((l_quantity, l_extendedprice)) AS s FROM lineitem GROUP BY 1) SELECT n.id, label, s[1] AS q, s[2] AS price FROM nodes n LEFT JOIN m USING (id)")
def e5(spark, d):
    meta = _t(spark, d, "lineitem").select(F.concat(F.lit("PRT:"), "l_partkey").alias("id"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("price"))
    return enrich(tg.nodes(spark, d).select("id", "label"), meta)


@query("E7_hydrate", f"WITH {tg.SQL}, h AS (SELECT o_orderkey % 10 AS query_id, 'PRT:'||(o_orderkey % 3000) AS item_id, o_orderkey AS rank FROM orders) SELECT query_id, rank, item_id, name, label FROM h LEFT JOIN nodes ON nodes.id = h.item_id")
def e7(spark, d):
    hits = _t(spark, d, "orders").select((F.col("o_orderkey") % 10).alias("query_id"), F.concat(F.lit("PRT:"), F.col("o_orderkey") % 3000).alias("item_id"), F.col("o_orderkey").alias("rank"))
    return hydrate(hits, tg.nodes(spark, d))


# An order is a chunk, its parts are the entities it mentions, a part's brand is its community.
@query("E8_chunk_context", """WITH m AS (SELECT l_orderkey AS chunk_id, 'PRT:'||l_partkey AS entity_id FROM lineitem), r AS (SELECT DISTINCT 'PRT:'||l_partkey AS head_id, 'S'||l_suppkey||'P'||l_partkey AS id FROM lineitem),
 b AS (SELECT 'PRT:'||p_partkey AS node_id, p_brand AS community_id FROM part), c AS (SELECT o_orderkey AS chunk_id, lead(o_orderkey) OVER w AS next_id, lag(o_orderkey) OVER w AS prev_id FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT chunk_id, next_id, prev_id, (SELECT string_agg(DISTINCT entity_id, ';' ORDER BY entity_id) FROM m WHERE m.chunk_id = c.chunk_id) AS entities,
 (SELECT string_agg(DISTINCT r.id, ';' ORDER BY r.id) FROM m JOIN r ON head_id = entity_id WHERE m.chunk_id = c.chunk_id) AS relations,
 (SELECT string_agg(DISTINCT community_id, ';' ORDER BY community_id) FROM m JOIN b ON node_id = entity_id WHERE m.chunk_id = c.chunk_id) AS communities FROM c""")
def e8(spark, d):
    items, w = _t(spark, d, "lineitem"), W.partitionBy("o_custkey").orderBy("o_orderkey")
    part = F.concat(F.lit("PRT:"), F.col("l_partkey"))
    chunks = _t(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.lead("o_orderkey").over(w).alias("next_id"), F.lag("o_orderkey").over(w).alias("prev_id"))
    mentions = items.select(F.col("l_orderkey").alias("chunk_id"), part.alias("entity_id"))
    rels = items.select(part.alias("head_id"), F.concat(F.lit("S"), "l_suppkey", F.lit("P"), "l_partkey").alias("id")).distinct()
    members = _t(spark, d, "part").select(F.concat(F.lit("PRT:"), "p_partkey").alias("node_id"), F.col("p_brand").alias("community_id"))
    out = chunk_context(chunks.select("chunk_id"), chunks, mentions, rels, members)
    return out.select("chunk_id", "next_id", "prev_id", *[F.array_join(c, ";").alias(c) for c in ("entities", "relations", "communities")])


_MEMBERS = "m AS (SELECT id AS node_id, label||'-'||(length(id) % 3) AS community_id FROM nodes)"


def membership(spark, d):
    return tg.nodes(spark, d).select(F.col("id").alias("node_id"), F.concat("label", F.lit("-"), F.length("id") % 3).alias("community_id"))


_CUSTNAT = "m AS (SELECT 'CUS:'||c_custkey AS node_id, c_nationkey % 5 AS community_id FROM customer UNION ALL SELECT 'NAT:'||n_nationkey, n_nationkey % 5 FROM nation UNION ALL SELECT 'SUP:'||s_suppkey, s_nationkey % 4 FROM supplier)"


def _custnat(spark, d):
    one = lambda t, p, k, n, m: _t(spark, d, t).select(F.concat(F.lit(p), F.col(k)).alias("node_id"), (F.col(n) % m).alias("community_id"))
    return one("customer", "CUS:", "c_custkey", "c_nationkey", 5).union(one("nation", "NAT:", "n_nationkey", "n_nationkey", 5)).union(one("supplier", "SUP:", "s_suppkey", "s_nationkey", 4))


@query("E9_member_subgraph", f"WITH {tg.SQL}, {_CUSTNAT} SELECT a.community_id, e.\"from\" AS src, e.\"to\" AS dst, e.type FROM edges e JOIN m a ON a.node_id = e.\"from\" JOIN m b ON b.node_id = e.\"to\" AND b.community_id = a.community_id")
def e9(spark, d):
    return member_subgraph(_custnat(spark, d), tg.edges(spark, d)).select("community_id", F.col("from").alias("src"), F.col("to").alias("dst"), "type")


@query("E10_community_members", f"WITH {tg.SQL}, {_MEMBERS}, c AS (SELECT 'PRT:'||l_partkey AS node_id, string_agg(DISTINCT l_suppkey, ';' ORDER BY l_suppkey) AS chunk_ids FROM lineitem GROUP BY 1) SELECT community_id, node_id, coalesce(chunk_ids, '') AS chunk_ids FROM m LEFT JOIN c USING (node_id)")
def e10(spark, d):
    mentions = _t(spark, d, "lineitem").select(F.concat(F.lit("PRT:"), "l_partkey").alias("entity_id"), F.col("l_suppkey").alias("chunk_id"))
    return community_members(membership(spark, d), mentions).select("community_id", "node_id", F.array_join("chunk_ids", ";").alias("chunk_ids"))


@query("E11_reports_at_level", "SELECT n_nationkey AS community_id, n_name AS title, 1 AS level, 1.0::DOUBLE AS score FROM nation WHERE n_nationkey % 3 = 1")
def e11(spark, d):
    n = _t(spark, d, "nation")
    comms = n.select(F.col("n_nationkey").alias("community_id"), (F.col("n_nationkey") % 3).alias("level"))
    return reports_at_level(comms, n.select(F.col("n_nationkey").alias("community_id"), F.col("n_name").alias("title")), 1)


@query("E12_entity_relations", f"WITH {tg.SQL} SELECT id, \"from\" AS src, \"to\" AS dst, type FROM nodes JOIN edges ON id = \"from\" OR id = \"to\" WHERE nodes.label IN ('Nation', 'Supplier')")
def e12(spark, d):
    return entity_relations(tg.nodes(spark, d).filter("label IN ('Nation', 'Supplier')").select("id"), tg.edges(spark, d)).select("id", F.col("from").alias("src"), F.col("to").alias("dst"), "type")


@query("E13_seeds", "SELECT DISTINCT o_custkey AS query_id, 'PRT:'||l_partkey AS node_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def e13(spark, d):
    asked = _t(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("chunk_id"))
    links = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.concat(F.lit("PRT:"), "l_partkey").alias("entity_id"))
    return seed_entities(asked, links, "chunk_id")


@query("E14_structural_links", "SELECT DISTINCT 'HAS_ENTITY' AS type, l_orderkey AS src, l_partkey AS dst FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size < 25 JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'O'")
def e14(spark, d):
    links = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return structural_links("HAS_ENTITY", links, _t(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id")), _t(spark, d, "part").filter("p_size < 25").select(F.col("p_partkey").alias("id")))
