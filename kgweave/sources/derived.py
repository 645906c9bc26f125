"""Queries of the readers and graph builders: the relational tables, written by Spark in the layouts the sources are
published in, are read back through the operators.

A part is a gene, a supplier a drug, a nation a disease, a customer an ontology term, a line item an observation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.operators.enrich import chembl_drugbank, ensembl_ncbi, umls_disease
from kgweave.operators.graph_tables import validate_graph
from kgweave.plans import testgraph as tg
from kgweave.plans.registry import query
from kgweave.plans.scratch import Scratch
from kgweave.sources import biomedical as bio
from kgweave.sources import corpora as co
from kgweave.sources import formats as fm
from kgweave.sources.schemas import allowed_triples

#: GO namespaces by number (fixed values), as SQL of both engines.
_SPACE = "CASE {0} % 3 WHEN 0 THEN 'biological_process' WHEN 1 THEN 'cellular_component' ELSE 'molecular_function' END"
_SHORT = "CASE {0} % 3 WHEN 0 THEN 'BPO' WHEN 1 THEN 'CCO' ELSE 'MFN' END"


def _root(spark: SparkSession) -> str:
    return Scratch(spark, "derived").path


def _t(spark, d, name):
    return tg.table(spark, d, name)


def _csv(df: DataFrame, path: str, sep: str = ",", header: bool = True, gz: bool = False) -> str:
    """Written as text files that hold the published columns; compressed where the source is."""
    df.write.options(sep=sep, header=header, emptyValue="", nullValue="", compression="gzip" if gz else "none").csv(path)
    return path


_VALS = "transform({0}, x -> named_struct('val', x))"


def _ontology(terms: DataFrame, edges: DataFrame, path: str) -> str:
    """An ontology in one document for each ``part`` of ``terms(part, id, name, xrefs, namespace)`` and ``edges(part, sub, obj, pred)``."""
    iri = lambda c: F.concat(F.lit(fm.OBO), F.col(c))
    about = F.struct(F.concat(F.lit("about "), "name").alias("val"))
    props = F.when(F.col("namespace").isNotNull(), F.array(F.struct(F.lit(fm.NAMESPACE).alias("pred"), F.col("namespace").alias("val"))))
    meta = F.struct(about.alias("definition"), F.array(F.struct(F.concat("name", F.lit(" too")).alias("val"))).alias("synonyms"), F.expr(_VALS.format("xrefs")).alias("xrefs"), props.alias("basicPropertyValues"))
    n = terms.select("part", F.struct(iri("id").alias("id"), F.col("name").alias("lbl"), meta.alias("meta")).alias("n")).groupBy("part").agg(F.collect_list("n").alias("nodes"))
    e = edges.select("part", F.struct(iri("sub").alias("sub"), "pred", iri("obj").alias("obj")).alias("e")).groupBy("part").agg(F.collect_list("e").alias("edges"))
    doc = n.join(e, "part", "full_outer").select(F.to_json(F.struct(F.array(F.struct("nodes", "edges")).alias("graphs"))).alias("value"))
    doc.write.option("maxRecordsPerFile", 1).text(path)
    return path


def _customers(spark, d, root: str) -> DataFrame:
    """Customers as terms, a document a nation; each is a child of the customer with a tenth of its key, every third is part of it."""
    c = _t(spark, d, "customer")
    terms = c.selectExpr("c_nationkey AS part", f"CASE WHEN c_custkey % 2 = 0 THEN 'GO_' ELSE 'UBERON_' END || c_custkey AS id", "c_name AS name", "array('MESH:' || c_nationkey) AS xrefs", f"CASE WHEN c_custkey % 2 = 0 THEN {_SPACE.format('c_custkey')} END AS namespace")
    up = "CASE WHEN c_custkey div 10 % 2 = 0 THEN 'GO_' ELSE 'UBERON_' END || (c_custkey div 10)"
    edges = c.filter("c_custkey >= 10").selectExpr("c_nationkey AS part", "CASE WHEN c_custkey % 2 = 0 THEN 'GO_' ELSE 'UBERON_' END || c_custkey AS sub", f"{up} AS obj", "CASE WHEN c_custkey % 3 = 0 THEN 'part_of' ELSE 'is_a' END AS pred")
    return fm.read_obograph(spark, _ontology(terms, edges, f"{root}/customers.json"))


_TERM = "terms AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'GO_' ELSE 'UBERON_' END || c_custkey AS id, c_custkey AS k, c_name AS name, c_nationkey AS n FROM customer), isa AS (SELECT CASE WHEN c_custkey // 10 % 2 = 0 THEN 'GO_' ELSE 'UBERON_' END || (c_custkey // 10) AS parent, CASE WHEN c_custkey % 2 = 0 THEN 'GO_' ELSE 'UBERON_' END || c_custkey AS child, c_custkey AS k FROM customer WHERE c_custkey >= 10 AND c_custkey % 3 <> 0)"


@query("S1_obo_terms", f"WITH {_TERM} SELECT id, name, 'about '||name AS definition, name||' too' AS synonyms, 'MESH:'||n AS xrefs FROM terms")
def s1(spark, d):
    t = fm.obo_terms(_customers(spark, d, _root(spark)))
    return t.select("id", "name", "definition", F.array_join("synonyms", ";").alias("synonyms"), F.array_join("xrefs", ";").alias("xrefs"))


@query("S2_isa_edges", f"WITH {_TERM} SELECT parent, child FROM isa")
def s2(spark, d):
    return fm.obo_isa_edges(_customers(spark, d, _root(spark)))


@query("S3_go_namespaces", f"WITH {_TERM} SELECT id, {_SPACE.format('k')} AS namespace FROM terms WHERE k % 2 = 0")
def s3(spark, d):
    return fm.go_term_namespaces(_customers(spark, d, _root(spark)))


def _interactions(spark, d, path: str) -> str:
    """Suppliers of one part interact: the drug of a line item with that of the next line of its order, told by both."""
    li = _t(spark, d, "lineitem")
    a, b = li.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("a")), li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("b"))
    pairs = a.join(b, ["l_orderkey", "l_linenumber"]).filter("a <> b").select("a", "b").distinct()
    both = pairs.union(pairs.select("b", "a")).distinct()
    item = F.struct(F.concat(F.lit("DB"), "b").alias("drugbank-id"), F.lit("risk").alias("description"))
    drugs = both.groupBy("a").agg(F.struct(F.collect_list(item).alias("drug-interaction")).alias("drug-interactions"))
    ids = F.array(F.struct(F.concat(F.lit("X"), "a").alias("_VALUE"), F.lit(None).cast("boolean").alias("_primary")), F.struct(F.concat(F.lit("DB"), "a").alias("_VALUE"), F.lit(True).alias("_primary")))
    drugs.select(ids.alias("drugbank-id"), "drug-interactions").write.format("xml").option("rowTag", "drug").option("rootTag", "drugbank").save(path)
    return path


_PAIRS = "pairs AS (SELECT DISTINCT a.l_suppkey AS a, b.l_suppkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_suppkey <> b.l_suppkey)"


@query("S4_xml_interactions", f"WITH {_PAIRS} SELECT DISTINCT least('DB'||a, 'DB'||b) AS head, greatest('DB'||a, 'DB'||b) AS tail, 'risk' AS description FROM pairs")
def s4(spark, d):
    return fm.read_drug_interactions_xml(spark, _interactions(spark, d, f"{_root(spark)}/interactions.xml"))


def _zip(df: DataFrame, members: dict[str, list[str] | dict[str, str]], root: str, by: str) -> str:
    """A zip file for each value of ``by`` with CSV members of the named columns (a dict: of these under the names given); tasks write the files."""
    from kgweave.plans.scratch import qualified

    where = qualified(df.sparkSession, root)

    def run(f):
        import io
        import zipfile

        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(where)
        fs.create_dir(base, recursive=True)
        key, held = f[by].iat[0], io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for name, cols in members.items():
                z.writestr(name, f[[*(cols.values() if isinstance(cols, dict) else cols)]].drop_duplicates().to_csv(index=False, header=[*cols]))
        with fs.open_output_stream(f"{base}/{key}.zip") as out:
            out.write(held.getvalue())
        return f[[by]].head(1)

    df.groupBy(by).applyInPandas(run, f"{by} {df.schema[by].dataType.simpleString()}").count()
    return root


@query("S5_zip_csv", "SELECT l_orderkey::VARCHAR AS l_orderkey, l_returnflag, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem) GROUP BY 1, 2")
def s5(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_orderkey") % 16).alias("part"))
    path = _zip(li, {"csv/items.csv": ["l_orderkey", "l_linenumber", "l_returnflag"]}, f"{_root(spark)}/zips", "part")
    return fm.read_zip_csv(spark, path, "csv/items.csv", ["l_orderkey", "l_returnflag"]).groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))


def _dump(blocks: list[tuple[str, list[str], DataFrame]], path: str) -> str:
    """A PostgreSQL dump of one file for each value of ``part``: COPY blocks of the given tables, one after the other."""
    out = None
    for i, (name, cols, df) in enumerate(blocks):
        cell = lambda c: F.coalesce(F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\\N"))
        rows = df.select("part", F.lit(i).alias("block"), F.lit(1).alias("k"), F.concat_ws("\t", *[cell(c) for c in cols]).alias("value"))
        parts = df.select("part").distinct()
        marks = [(0, f"COPY public.{name} ({', '.join(cols)}) FROM stdin;"), (2, "\\.")]
        for k, line in marks:
            rows = rows.union(parts.select("part", F.lit(i), F.lit(k), F.lit(line)))
        out = rows if out is None else out.union(rows)
    out.repartition(8, "part").sortWithinPartitions("part", "block", "k").select("part", "value").write.partitionBy("part").option("compression", "gzip").text(path)
    return path


@query("S6_pg_dump", "SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment||chr(92)||'x'||chr(9)||'y' END AS segment FROM customer")
def s6(spark, d):
    c = _t(spark, d, "customer").selectExpr("c_nationkey % 4 AS part", "c_custkey", "c_name", "CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment || chr(92) || 'x' || chr(9) || 'y' END AS segment")
    o = _t(spark, d, "orders").selectExpr("cast(o_custkey % 4 AS int) AS part", "o_orderkey", "o_orderstatus")
    path = _dump([("other", ["o_orderkey", "o_orderstatus"], o), ("customer", ["c_name", "c_custkey", "segment"], c)], f"{_root(spark)}/dump")
    return fm.read_pg_dump_table(spark, path, "customer", ["c_custkey", "segment"])


def reference(spark, d, root: str) -> fm.ReferenceData:
    """The shared tables: parts as genes, suppliers as drugs, nations as diseases, and three small ontologies."""
    part, sup, nat = (_t(spark, d, t) for t in ("part", "supplier", "nation"))
    meta = "named_struct('approved_symbol', 'SYM' || p_partkey, 'approved_name', p_name, 'biotype', p_type, 'synonyms', cast(array() AS array<string>), 'db_xrefs', cast(array() AS array<string>)) AS metadata"
    part.selectExpr("'ENSG' || p_partkey AS id", meta).write.parquet(f"{root}/opentargets/target")
    refs = "CASE WHEN s_suppkey % 3 <> 0 THEN array(named_struct('source', 'DrugBank', 'ids', array('DB' || s_suppkey)), named_struct('source', 'other', 'ids', array('X'))) END"
    sup.selectExpr("'CHEMBL' || s_suppkey AS id", f"named_struct('name', s_name, 'drug_type', 'Small', 'synonyms', cast(array() AS array<string>), 'trade_names', cast(array() AS array<string>), 'cross_references', {refs}) AS metadata").write.parquet(f"{root}/opentargets/drug_molecule")
    nat.selectExpr("CASE WHEN n_nationkey % 5 = 4 THEN 'HP_' ELSE 'MONDO_' END || n_nationkey AS id", "n_name AS name", "'land ' || n_name AS description", "named_struct('db_xrefs', array('UMLS:C' || n_nationkey, 'MESH:D' || n_nationkey), 'parents', array(CASE WHEN n_nationkey % 10 = 9 THEN 'HP_R' ELSE 'MONDO_R' END || n_regionkey)) AS metadata").write.parquet(f"{root}/opentargets/disease")
    _csv(part.filter("p_partkey % 7 <> 0").selectExpr("'SYM' || p_partkey AS symbol", "p_partkey * 10 AS ncbi_id"), f"{root}/gene_names/gene_names.tsv", "\t")
    none = nat.selectExpr("0 AS part", "'' AS sub", "'' AS obj", "'' AS pred").limit(0)
    _ontology(nat.selectExpr("0 AS part", "'MONDO_' || n_nationkey AS id", "n_name AS name", "array('MESH:D' || n_nationkey) AS xrefs", "cast(null AS string) AS namespace"), none, f"{root}/ontology/mondo.json")
    _ontology(nat.selectExpr("0 AS part", "'HP_' || n_nationkey AS id", "n_name AS name", "cast(array() AS array<string>) AS xrefs", "cast(null AS string) AS namespace"), none, f"{root}/ontology/hp.json")
    _ontology(part.select("p_size").distinct().selectExpr("0 AS part", "'GO_' || p_size AS id", "'size ' || p_size AS name", "cast(array() AS array<string>) AS xrefs", f"{_SPACE.format('p_size')} AS namespace"), none, f"{root}/ontology/go_plus.json")
    return fm.ReferenceData(spark, root)


@query("S7_reference", "SELECT 'ENSG'||p_partkey AS id, 'SYM'||p_partkey AS symbol, p_type AS biotype, (p_partkey * 10)::VARCHAR AS ncbi_id FROM part WHERE p_partkey % 7 <> 0")
def s7(spark, d):
    ref = reference(spark, d, _root(spark))
    t = ref.targets().select("id", F.col("metadata.approved_symbol").alias("symbol"), F.col("metadata.biotype").alias("biotype"))
    return t.join(ref.gene_names(), "symbol").select("id", "symbol", "biotype", "ncbi_id")


def _flat(df: DataFrame, *props: str) -> DataFrame:
    return df.select("source", "external_id", "title", F.length("text").cast("long").alias("n"), *[F.col("properties")[p].alias(p) for p in props])


_DOC = "FROM documents WHERE text IS NOT NULL AND text <> ''"


@query("S9_guidelines", f"SELECT 'clinical_guidelines' AS source, doc_id::VARCHAR AS external_id, lang AS title, length(text) AS n, doc_id::VARCHAR AS guideline_id, coalesce(source, '') AS issuing_org, substr(text, 1, 500) AS overview {_DOC}")
def s9(spark, d):
    raw = _t(spark, d, "documents").selectExpr("doc_id AS id", "source", "lang AS title", "text AS clean_text", "'u' AS url", "text AS overview")
    return _flat(co.clinical_guidelines(raw), "guideline_id", "issuing_org", "overview")


@query("S10_pubmed", f"SELECT 'pubmed' AS source, CASE WHEN doc_id % 3 = 0 THEN 'pubmed-'||doc_id||'-'||(doc_id % 7) WHEN doc_id % 3 = 1 THEN doc_id||'_'||(doc_id % 7) ELSE 'pubmed-'||doc_id END AS external_id, lang AS title, length(text) AS n, doc_id::VARCHAR AS pubmed_id, CASE WHEN doc_id % 3 = 2 THEN '0' ELSE (doc_id % 7)::VARCHAR END AS chunk_index {_DOC}")
def s10(spark, d):
    raw = _t(spark, d, "documents").selectExpr("CASE WHEN doc_id % 3 = 0 THEN 'pubmed-' || doc_id || '-' || (doc_id % 7) WHEN doc_id % 3 = 1 THEN doc_id || '_' || (doc_id % 7) ELSE 'pubmed-' || doc_id END AS id", "lang AS title", "text AS content")
    return _flat(co.pubmed(raw), "pubmed_id", "chunk_index")


@query("S11_case_reports", f"SELECT 'pubmed_case_reports' AS source, 'PMC'||doc_id AS external_id, lang AS title, length(text) AS n, source AS journal, (2000 + doc_id % 20)::VARCHAR AS publication_date {_DOC}")
def s11(spark, d):
    raw = _t(spark, d, "documents").selectExpr("'PMC' || doc_id AS pmcid", "lang AS title", "source AS journal", "2000 + doc_id % 20 AS publication_date", "text")
    return _flat(co.pubmed_case_reports(raw), "journal", "publication_date")


@query("S12_statpearls", f"SELECT 'statpearls' AS source, 'article-'||doc_id||'_'||(doc_id % 9) AS external_id, CASE WHEN doc_id % 2 = 0 THEN 'T -- A -- '||coalesce(lang, 'none') ELSE 'T' END AS title, length(text) AS n, doc_id::VARCHAR AS article_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(lang, 'none') ELSE 'Unknown' END AS section_type, (doc_id % 9)::VARCHAR AS chunk_index FROM documents WHERE text <> ''")
def s12(spark, d):
    raw = _t(spark, d, "documents").selectExpr("'article-' || doc_id || '_' || (doc_id % 9) AS id", "CASE WHEN doc_id % 2 = 0 THEN 'T -- A -- ' || coalesce(lang, 'none') ELSE 'T' END AS title", "text AS content")
    return _flat(co.statpearls(raw), "article_id", "section_type", "chunk_index")


@query("S13_textbooks", f"SELECT 'textbooks' AS source, 'textbooks-My_'||coalesce(source, 'x')||'_'||doc_id AS external_id, coalesce(lang, 'My_'||coalesce(source, 'x')) AS title, length(text) AS n, 'My_'||coalesce(source, 'x') AS book_name, doc_id::VARCHAR AS chunk_index {_DOC}")
def s13(spark, d):
    raw = _t(spark, d, "documents").selectExpr("'textbooks-My_' || coalesce(source, 'x') || '_' || doc_id AS id", "lang AS title", "text AS content")
    return _flat(co.textbooks(raw), "book_name", "chunk_index")


def _gold(spark, d, root: str) -> tuple[DataFrame, DataFrame]:
    """Parts in the layout with structs, suppliers in the one with JSON; line items as edges."""
    _t(spark, d, "part").selectExpr("'G' || p_partkey AS id", "'GEN' AS label", "named_struct('name', p_name, 'v_base64', 'AAA') AS properties").write.parquet(f"{root}/nodes-a")
    _t(spark, d, "supplier").selectExpr("'D' || s_suppkey AS id", "'DRG' AS label", "to_json(named_struct('name', s_name, 'v_base64', 'AAA')) AS properties").write.parquet(f"{root}/nodes-b")
    props = "to_json(named_struct('sources', named_struct('direct', array(flag), 'indirect', array('I')), 'asserted_relations', array('Z', status, status))) AS properties"
    e = _t(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"))
    e.selectExpr("'D' || l_suppkey AS `from`", "'G' || l_partkey AS `to`", "'DRG-GEN' AS label", "'TARGET' AS relation", "true AS undirected", props).write.parquet(f"{root}/edges")
    return fm.read_gold_graph(spark, [f"{root}/nodes-a", f"{root}/nodes-b"], [f"{root}/edges"])


@query("S16_gold_tables", "SELECT 'G'||p_partkey AS id, 'GEN' AS label, p_name AS name, 1::BIGINT AS fields FROM part UNION ALL SELECT 'D'||s_suppkey, 'DRG', s_name, 1 FROM supplier")
def s16(spark, d):
    nodes, _ = _gold(spark, d, _root(spark))
    return nodes.select("id", "label", F.get_json_object("properties", "$.name").alias("name"), F.size(F.json_object_keys("properties")).cast("long").alias("fields"))


@query("S17_object_lists", "SELECT o_orderkey, o_orderstatus||';'||o_orderpriority||';'||o_custkey AS names FROM orders")
def s17(spark, d):
    raw = F.expr("""'[{"label":"' || o_orderstatus || '","source":"s"},"' || o_orderpriority || '",{"id":"' || o_custkey || '","source":"t"}]'""")
    return _t(spark, d, "orders").select("o_orderkey", F.array_join(bio.object_list(raw), ";").alias("names"))


def _edges(graph: bio.Graph, *more: str | Column) -> DataFrame:
    return graph[1].select("from", "to", "type", "label", *more)


@query("B1_backbone", f"WITH {_TERM} SELECT parent AS \"from\", child AS \"to\", 'PARENT' AS type, 'ANA-ANA' AS label FROM isa WHERE starts_with(parent, 'UBERON') AND starts_with(child, 'UBERON')")
def b1(spark, d):
    root = _root(spark)
    _customers(spark, d, root)
    return _edges(bio.ontology_backbone(spark, f"{root}/customers.json", "UBERON_", "ANA", "UBERON"))


@query("B2_gene_ontology", f"WITH {_TERM} SELECT parent AS \"from\", child AS \"to\", 'PARENT' AS type, {_SHORT.format('k')}||'-'||{_SHORT.format('k')} AS label FROM isa WHERE starts_with(parent, 'GO_') AND k % 2 = 0")
def b2(spark, d):
    root = _root(spark)
    _customers(spark, d, root)
    return _edges(bio.gene_ontology(spark, f"{root}/customers.json"))


@query("B3_reactome", "SELECT DISTINCT 'R-HSA-'||o_custkey AS \"from\", 'R-HSA-'||(1000000 + o_orderkey) AS \"to\", 'PARENT' AS type, 'PWY-PWY' AS label FROM orders WHERE o_orderkey % 4 <> 0")
def b3(spark, d):
    root, o = _root(spark), _t(spark, d, "orders")
    kind = "CASE WHEN o_orderkey % 4 = 0 THEN 'R-MMU-' ELSE 'R-HSA-' END"
    _csv(o.selectExpr(f"{kind} || (1000000 + o_orderkey) AS id", "o_orderpriority AS name", "'x' AS species"), f"{root}/ReactomePathways.txt", "\t", False)
    _csv(o.selectExpr(f"{kind} || o_custkey AS a", f"{kind} || (1000000 + o_orderkey) AS b"), f"{root}/ReactomePathwaysRelation.txt", "\t", False)
    return _edges(bio.reactome(spark, root))


_BGEE = "b AS (SELECT 'UBERON_'||l_suppkey AS a, 'ENSG'||l_partkey AS g, min((CASE l_returnflag WHEN 'R' THEN 'EXPRESSION_PRESENT' ELSE 'EXPRESSION_ABSENT' END, l_quantity, l_linestatus)) AS m FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_suppkey % 5 <> 0 GROUP BY 1, 2)"


@query("B4_bgee", f"WITH {_BGEE} SELECT a AS \"from\", g AS \"to\", m[1] AS type, 'ANA-GEN' AS label, m[2] AS expression_rank, m[3] AS call_quality FROM b")
def b4(spark, d):
    root = _root(spark)
    where = "CASE WHEN l_suppkey % 10 = 5 THEN 'UBERON:' || l_suppkey || ' ∩ CL:1' WHEN l_suppkey % 10 = 0 THEN 'CL:' || l_suppkey ELSE 'UBERON:' || l_suppkey END"
    x = "CASE l_returnflag WHEN 'R' THEN 'present' WHEN 'A' THEN 'absent' ELSE 'unknown' END"
    raw = _t(spark, d, "lineitem").selectExpr("'ENSG' || l_partkey AS `Gene ID`", "'SYM' || l_partkey AS `Gene name`", f"{where} AS `Anatomical entity ID`", "'place ' || l_suppkey AS `Anatomical entity name`", f"{x} AS `Expression`", "l_linestatus AS `Call quality`", "l_quantity AS `Expression rank`")
    return _edges(bio.bgee(spark, _csv(raw, f"{root}/bgee.tsv", "\t", gz=True), reference(spark, d, root)), "expression_rank", "call_quality")


@query("B5_ctd", f"""WITH e AS (SELECT o_custkey, o_orderkey AS k FROM orders)
 SELECT DISTINCT 'MESH:C'||o_custkey AS "from", 'MONDO_'||(k % 40) AS "to", 'EXPOSURE_DISEASE' AS type, 'EXP-DIS' AS label FROM e WHERE k % 4 = 0 AND k % 40 < 25
 UNION ALL SELECT DISTINCT 'MESH:C'||o_custkey, 'ENSG'||(k % 300), 'EXPOSURE_GENE', 'EXP-GEN' FROM e JOIN part ON p_partkey = k % 300 WHERE k % 4 = 1
 UNION ALL SELECT DISTINCT 'MESH:C'||o_custkey, 'MESH:C'||(k % 100), 'EXPOSURE_EXPOSURE', 'EXP-EXP' FROM e WHERE k % 4 = 2 AND o_custkey <> k % 100
 UNION ALL SELECT DISTINCT 'MESH:C'||o_custkey, 'GO_'||(k % 60), 'EXPOSURE_'||upper({_SPACE.format('(k % 60)')}), 'EXP-'||{_SHORT.format('(k % 60)')} FROM e WHERE k % 4 = 3 AND k % 60 IN (SELECT p_size FROM part)""")
def b5(spark, d):
    root = _root(spark)
    pick = lambda i, x: f"CASE WHEN o_orderkey % 4 = {i} THEN {x} END"
    raw = _t(spark, d, "orders").selectExpr(
        "'C' || o_custkey AS exposurestressorid", "'stress ' || o_custkey AS exposurestressorname", f"{pick(1, "'SYM' || (o_orderkey % 300)")} AS exposuremarker",
        f"{pick(2, "'C' || (o_orderkey % 100)")} AS exposuremarkerid", f"{pick(0, "'D' || (o_orderkey % 40)")} AS diseaseid", f"{pick(3, "'GO:' || (o_orderkey % 60)")} AS phenotypeid",
    )
    return _edges(bio.ctd(spark, _csv(raw, f"{root}/ctd.csv", gz=True), reference(spark, d, root)))


_DIS = "CASE WHEN n_nationkey % 5 = 4 THEN 'HP_' ELSE 'MONDO_' END||n_nationkey"


@query("B6_disgenet", f"WITH m AS (SELECT {_DIS} AS \"from\", 'ENSG'||l_partkey AS \"to\", min((CASE WHEN l_linestatus = 'O' THEN 'PHE-GEN' ELSE 'DIS-GEN' END, l_discount, l_tax)) AS m FROM lineitem JOIN nation ON n_nationkey = l_orderkey % 30 GROUP BY 1, 2) SELECT \"from\", \"to\", 'ASSOCIATED_WITH' AS type, m[1] AS label, m[2] AS score, m[3] AS evidence_index FROM m")
def b6(spark, d):
    root = _root(spark)
    raw = _t(spark, d, "lineitem").selectExpr("'SYM' || l_partkey AS geneSymbol", "'C' || (l_orderkey % 30) AS diseaseId", "'d' AS diseaseName", "CASE WHEN l_linestatus = 'O' THEN 'phenotype' ELSE 'disease' END AS diseaseType", "l_discount AS score", "l_tax AS EI")
    return _edges(bio.disgenet(spark, _csv(raw, f"{root}/disgenet.tsv", "\t"), reference(spark, d, root)), "score", "evidence_index")


_ROLE = {"carrier": 0, "enzyme": 1, "target": 2, "transporter": 3}


@query("B7_drugbank", f"""WITH {_PAIRS}, x AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 <> 0 THEN 'CHEMBL'||s_suppkey ELSE 'DRUGBANK:DB'||s_suppkey END AS d, CASE WHEN s_suppkey % 3 <> 0 THEN 'CHEMBL'||s_suppkey ELSE 'DB'||s_suppkey END AS i FROM supplier),
 r AS (SELECT DISTINCT l_suppkey, l_partkey, l_orderkey % 4 AS role FROM lineitem WHERE l_partkey % 7 <> 0 AND l_orderkey % 5 <> 0)
 SELECT d AS "from", 'ENSG'||l_partkey AS "to", CASE min(CASE role WHEN 1 THEN 0 WHEN 3 THEN 1 WHEN 0 THEN 2 ELSE 3 END) WHEN 0 THEN 'ENZYME' WHEN 1 THEN 'TRANSPORTER' WHEN 2 THEN 'CARRIER' ELSE 'TARGET' END AS type, 'DRG-GEN' AS label, count(DISTINCT role) AS said FROM r JOIN x ON k = l_suppkey GROUP BY 1, 2
 UNION ALL SELECT DISTINCT a.i, b.i, 'DRUG_INTERACTION', 'DRG-DRG', 0 FROM pairs p JOIN x a ON a.k = CASE WHEN 'DB'||p.a < 'DB'||p.b THEN p.a ELSE p.b END JOIN x b ON b.k = CASE WHEN 'DB'||p.a < 'DB'||p.b THEN p.b ELSE p.a END""")
def b7(spark, d):
    root = _root(spark)
    _csv(_t(spark, d, "part").selectExpr("'P' || p_partkey AS `UniProt ID(supplied by UniProt)`", "p_partkey * 10 AS `NCBI Gene ID(supplied by NCBI)`"), f"{root}/drugbank_gene_map.tsv", "\t")
    li = _t(spark, d, "lineitem")
    for role, i in _ROLE.items():
        rows = li.filter(f"l_orderkey % 4 = {i}").groupBy("l_partkey", (F.col("l_orderkey") % 5 == 0).alias("mouse")).agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("DB"), "l_suppkey"))), "; ").alias("ids"))
        _csv(rows.selectExpr("l_partkey AS ID", "'x' AS Name", "CASE WHEN mouse THEN 'Mice' ELSE 'Humans' END AS Species", "'P' || l_partkey AS `UniProt ID`", "ids AS `Drug IDs`"), f"{root}/drugbank_all_{role}_polypeptide_ids.csv")
    _interactions(spark, d, f"{root}/full database.xml")
    said = F.coalesce(F.size("asserted_relations"), F.lit(0)).cast("long").alias("said")
    return _edges(bio.drugbank(spark, root, reference(spark, d, root)), said)


@query("B8_drugcentral", f"""WITH m AS (SELECT 'CHEMBL'||l_suppkey AS d, {_DIS} AS u, n_nationkey AS n, CASE l_orderkey % 4 WHEN 0 THEN 'INDICATION' WHEN 1 THEN 'CONTRAINDICATION' ELSE 'OFF_LABEL_USE' END AS type FROM lineitem JOIN nation ON n_nationkey = l_partkey % 30 WHERE l_orderkey % 4 < 3)
 SELECT d AS "from", u AS "to", CASE min(CASE type WHEN 'INDICATION' THEN 1 WHEN 'CONTRAINDICATION' THEN 2 ELSE 3 END) WHEN 1 THEN 'INDICATION' WHEN 2 THEN 'CONTRAINDICATION' ELSE 'OFF_LABEL_USE' END AS type, CASE WHEN max(n) % 5 = 4 THEN 'DRG-PHE' ELSE 'DRG-DIS' END AS label, string_agg(DISTINCT type, ';' ORDER BY type) AS said, count(DISTINCT type) > 1 AS conflict FROM m GROUP BY 1, 2""")
def b8(spark, d):
    root = _root(spark)
    use = "CASE l_orderkey % 4 WHEN 0 THEN 'indication' WHEN 1 THEN 'contraindication' WHEN 2 THEN 'off-label use' ELSE 'symptomatic' END AS relationship_name"
    omop = _t(spark, d, "lineitem").selectExpr("cast(l_suppkey % 4 AS int) AS part", "l_suppkey AS struct_id", use, "'C' || (l_partkey % 30) AS umls_cui", "'concept' AS concept_name")
    ids = _t(spark, d, "supplier").selectExpr("cast(s_suppkey % 4 AS int) AS part", "s_suppkey AS id", "s_suppkey AS struct_id", "'CHEMBL' || s_suppkey AS identifier", "'ChEMBL_ID' AS id_type")
    path = _dump([("identifier", ["id", "struct_id", "identifier", "id_type"], ids), ("omop_relationship", ["struct_id", "relationship_name", "umls_cui", "concept_name"], omop)], f"{root}/dump")
    return _edges(bio.drugcentral(spark, path, reference(spark, d, root)), F.array_join("asserted_relations", ";").alias("said"), F.col("relation_conflict").alias("conflict"))


@query("B9_onsides", "SELECT DISTINCT 'RXNORM:'||l_suppkey AS \"from\", 'meddra:'||l_partkey AS \"to\", 'ADVERSE_DRUG_REACTION' AS type, 'DRG-PHE' AS label FROM lineitem WHERE l_suppkey % 4 <> 0")
def b9(spark, d):
    name = "CASE WHEN l_suppkey % 4 = 0 THEN 'X' || l_suppkey ELSE '' || l_suppkey END"
    li = _t(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    li = li.selectExpr("l_suppkey % 8 AS part", f"{name} AS rxnorm_id", "'drug ' || l_suppkey AS rxnorm_name", "l_partkey AS meddra_id", "'effect ' || l_partkey AS meddra_name")
    pairs = {"ingredient_id": "rxnorm_id", "effect_meddra_id": "meddra_id"}
    members = {"csv/high_confidence.csv": pairs, "csv/vocab_rxnorm_ingredient.csv": ["rxnorm_id", "rxnorm_name"], "csv/vocab_meddra_adverse_effect.csv": ["meddra_id", "meddra_name"]}
    return _edges(bio.onsides(spark, _zip(li, members, f"{_root(spark)}/onsides", "part")))


@query("B10_ppi", "SELECT 'ENSG'||a.l_partkey AS \"from\", 'ENSG'||b.l_partkey AS \"to\", 'INTERACTS_WITH' AS type, 'GEN-GEN' AS label, list_aggregate(list_sort(list_distinct(list(a.l_returnflag) || list(b.l_linestatus))), 'string_agg', ';') AS databases FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey % 7 <> 0 AND b.l_partkey % 7 <> 0 GROUP BY 1, 2")
def b10(spark, d):
    root, li = _root(spark), _t(spark, d, "lineitem")
    b = li.selectExpr("l_orderkey", "l_linenumber - 1 AS l_linenumber", "l_partkey AS other", "l_linestatus AS status")
    raw = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").join(b, ["l_orderkey", "l_linenumber"]).selectExpr("l_partkey * 10 AS proteinA_entrezid", "other * 10 AS proteinB_entrezid", "l_returnflag || '|' || status AS databases")
    return _edges(bio.ppi(spark, _csv(raw, f"{root}/ppi.csv"), reference(spark, d, root)), F.array_join("databases", ";").alias("databases"))


def _opentargets(spark, d, root: str) -> bio.Graph:
    ref, li, nat = reference(spark, d, root), _t(spark, d, "lineitem"), _t(spark, d, "nation")
    dis = "CASE WHEN l_orderkey % 3 = 0 THEN 'GO_' || (l_orderkey % 60) WHEN l_orderkey % 3 = 1 THEN 'HP_' || (l_orderkey % 25) ELSE 'MONDO_' || (l_orderkey % 25) END"
    li.selectExpr(f"{dis} AS disease_id", "'ENSG' || l_partkey AS target_id", "named_struct('score', l_discount, 'evidence_count', cast(l_linenumber AS bigint)) AS metadata").write.parquet(f"{root}/opentargets/target_disease_associations")
    nat.selectExpr("'MONDO_' || n_nationkey AS disease", "CASE WHEN n_nationkey % 2 = 0 THEN 'HP_' ELSE 'X_' END || n_regionkey AS phenotype").write.parquet(f"{root}/opentargets/disease_phenotype")
    li.groupBy("l_suppkey").agg(F.collect_set(F.expr("CASE WHEN l_orderkey % 2 = 0 THEN 'MONDO_' ELSE 'HP_' END || (l_orderkey % 25)")).alias("x")).selectExpr("'CHEMBL' || l_suppkey AS id", "named_struct('indications', transform(x, y -> named_struct('disease', y))) AS metadata").write.parquet(f"{root}/opentargets/drug_indication")
    act = "CASE l_returnflag WHEN 'A' THEN 'Inverse agonist' WHEN 'R' THEN 'Inhibitor' ELSE 'odd thing' END"
    li.selectExpr("array('ENSG' || l_partkey) AS targets", "array('CHEMBL' || l_suppkey) AS chembl_ids", f"named_struct('action_type', {act}) AS metadata").write.parquet(f"{root}/opentargets/drug_mechanism_of_action")
    return bio.opentargets(spark, root, ref)


_OT = f"""o AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'GO_'||(l_orderkey % 60) WHEN l_orderkey % 3 = 1 THEN 'HP_'||(l_orderkey % 25) ELSE 'MONDO_'||(l_orderkey % 25) END AS d, l_orderkey % 60 AS go, l_orderkey % 3 AS kind, l_partkey FROM lineitem),
 pa AS (SELECT {_DIS} AS id, CASE WHEN n_nationkey % 10 = 9 THEN 'HP_R' ELSE 'MONDO_R' END||n_regionkey AS parent FROM nation),
 ot AS (SELECT DISTINCT d AS "from", 'ENSG'||l_partkey AS "to", 'ASSOCIATED_WITH' AS type, CASE kind WHEN 0 THEN {_SHORT.format('go')} WHEN 1 THEN 'PHE' ELSE 'DIS' END||'-GEN' AS label FROM o WHERE kind <> 0 OR go IN (SELECT p_size FROM part)
 UNION ALL SELECT parent, id, 'PARENT', 'DIS-DIS' FROM pa WHERE NOT contains(id, 'HP')
 UNION ALL SELECT parent, id, 'PARENT', 'PHE-PHE' FROM pa WHERE starts_with(id, 'HP_') AND starts_with(parent, 'HP_')
 UNION ALL SELECT DISTINCT 'MONDO_'||n_nationkey, 'HP_'||n_regionkey, 'HAS_PHENOTYPE', 'DIS-PHE' FROM nation WHERE n_nationkey % 2 = 0
 UNION ALL SELECT DISTINCT 'CHEMBL'||l_suppkey, 'MONDO_'||(l_orderkey % 25), 'INDICATION', 'DRG-DIS' FROM lineitem WHERE l_orderkey % 2 = 0
 UNION ALL SELECT 'CHEMBL'||l_suppkey, 'ENSG'||l_partkey, min(CASE l_returnflag WHEN 'A' THEN '1INVERSE_AGONIST' WHEN 'R' THEN '1INHIBITOR' ELSE '2OTHER' END)[2:], 'DRG-GEN' FROM lineitem GROUP BY 1, 2)"""


@query("B11_opentargets", f"WITH {_OT} SELECT * FROM ot")
def b11(spark, d):
    return _edges(_opentargets(spark, d, _root(spark)))


_FULL = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in bio.LABELS.items()) + " END"


@query("B12_endpoints", f"""WITH {_OT}, ends AS (SELECT "from" AS curie, {_FULL.format("label[:3]")} AS label FROM ot UNION SELECT "to", {_FULL.format("label[5:]")} FROM ot), one AS (SELECT curie, min(label) AS label FROM ends GROUP BY 1)
 SELECT curie, label, coalesce(CASE label WHEN 'Gene' THEN 'SYM'||replace(curie, 'ENSG', '') WHEN 'Drug' THEN (SELECT s_name FROM supplier WHERE 'CHEMBL'||s_suppkey = curie) WHEN 'Disease' THEN (SELECT n_name FROM nation WHERE {_DIS} = curie)
 WHEN 'Phenotype' THEN (SELECT n_name FROM nation WHERE 'HP_'||n_nationkey = curie) ELSE 'size '||replace(curie, 'GO_', '') END, curie) AS name FROM one""")
def b12(spark, d):
    return _opentargets(spark, d, _root(spark))[0].select("curie", "label", "name")


@query("B13_gold_graph", "SELECT 'D'||l_suppkey AS \"from\", 'G'||l_partkey AS \"to\", 'TARGET' AS type, 'DRG-GEN' AS label, min(l_returnflag) AS direct, 'I' AS indirect, max(l_linestatus)||';Z' AS said FROM lineitem GROUP BY l_suppkey, l_partkey")
def b13(spark, d):
    g = bio.gold_graph(*_gold(spark, d, _root(spark)))
    return _edges(g, F.array_join("direct_sources", ";").alias("direct"), F.array_join("indirect_sources", ";").alias("indirect"), F.array_join("asserted_relations", ";").alias("said"))


@query("E1_ensembl_ncbi", "SELECT (p_partkey * 10)::VARCHAR AS ncbi_id, 'ENSG'||p_partkey AS ensembl_id FROM part WHERE p_partkey % 7 <> 0")
def e1(spark, d):
    ref = reference(spark, d, _root(spark))
    return ensembl_ncbi(ref.targets(), ref.gene_names())


@query("E2_chembl_drugbank", "SELECT 'DB'||s_suppkey AS drugbank_id, 'CHEMBL'||s_suppkey AS chembl_id FROM supplier WHERE s_suppkey % 3 <> 0")
def e2(spark, d):
    return chembl_drugbank(reference(spark, d, _root(spark)).molecules())


@query("E3_umls_disease", f"SELECT 'C'||n_nationkey AS umls_id, {_DIS} AS disease_id FROM nation")
def e3(spark, d):
    return umls_disease(reference(spark, d, _root(spark)).diseases())


@query("F6_schema", f"WITH {_BGEE} SELECT a AS \"from\", 'WRONG' AS type, count(*) AS n FROM b WHERE m[2] > 40 GROUP BY 1")
def f6(spark, d):
    """Edges of a built graph against its source's schema: those retyped on purpose are the ones found."""
    root = _root(spark)
    raw = _t(spark, d, "lineitem").filter("l_suppkey % 5 <> 0").selectExpr("'ENSG' || l_partkey AS `Gene ID`", "'SYM' || l_partkey AS `Gene name`", "'UBERON:' || l_suppkey AS `Anatomical entity ID`", "'place' AS `Anatomical entity name`", "CASE l_returnflag WHEN 'R' THEN 'present' WHEN 'A' THEN 'absent' ELSE 'unknown' END AS `Expression`", "l_linestatus AS `Call quality`", "l_quantity AS `Expression rank`")
    nodes, edges = bio.bgee(spark, _csv(raw, f"{root}/bgee.tsv", "\t", gz=True), reference(spark, d, root))
    edges = edges.withColumn("type", F.when(F.col("expression_rank") > 40, "WRONG").otherwise(F.col("type")))
    return validate_graph(nodes.withColumnRenamed("curie", "id"), edges, allowed_triples(spark, "bgee")).groupBy("from", "type").agg(F.count("*").alias("n"))
