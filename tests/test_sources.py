import gzip
import json
import zipfile

import pytest

from kgweave.operators.enrich import chembl_drugbank, ensembl_ncbi, umls_disease
from kgweave.operators.graph_tables import validate_graph
from kgweave.sources import biomedical as b
from kgweave.sources import corpora as c
from kgweave.sources import formats as fm
from kgweave.sources.schemas import SCHEMAS, allowed_triples

OBO = fm.OBO


def term(i, name, ns=None, xrefs=()):
    meta = {"definition": {"val": f"about {name}"}, "synonyms": [{"val": f"{name} too"}], "xrefs": [{"val": x} for x in xrefs]}
    return {"id": OBO + i, "lbl": name, "meta": meta | ({"basicPropertyValues": [{"pred": "x", "val": "y"}, {"pred": fm.NAMESPACE, "val": ns}]} if ns else {})}


def edge(s, o, pred="is_a"):
    return {"sub": OBO + s, "pred": pred, "obj": OBO + o}


@pytest.fixture(scope="session")
def root(tmp_path_factory, spark):
    r = tmp_path_factory.mktemp("ref")
    meta = "struct<approved_symbol:string,approved_name:string,biotype:string,synonyms:array<string>,db_xrefs:array<string>>"
    spark.createDataFrame([("ENSG1", ("TP53", "tumor protein", "protein_coding", [], [])), ("ENSG2", ("EGFR", "receptor", "protein_coding", [], []))], f"id string, metadata {meta}").write.parquet(f"{r}/opentargets/target")
    meta = "struct<name:string,drug_type:string,synonyms:array<string>,trade_names:array<string>,cross_references:array<struct<source:string,ids:array<string>>>>"
    spark.createDataFrame([("CHEMBL25", ("aspirin", "Small", [], [], [("drugbank", ["DB00945"])])), ("CHEMBL100", ("warfarin", "Small", [], [], [("drugbank", ["DB01050"])]))], f"id string, metadata {meta}").write.parquet(f"{r}/opentargets/drug_molecule")
    meta = "struct<db_xrefs:array<string>,parents:array<string>>"
    spark.createDataFrame([("MONDO_0005148", "type 2 diabetes", "d", (["UMLS:C0011860", "MESH:D003924"], ["MONDO_0005015"])), ("EFO_1", "other", None, ([], []))], f"id string, name string, description string, metadata {meta}").write.parquet(f"{r}/opentargets/disease")
    (r / "gene_names").mkdir()
    (r / "gene_names/gene_names.tsv").write_text("symbol\tncbi_id\nTP53\t7157\nEGFR\t1956\n")
    (r / "ontology").mkdir()
    for name, nodes in (("mondo", [term("MONDO_0005148", "type 2 diabetes", xrefs=["MESH:D003924"])]), ("go_plus", [term("GO_0008150", "process", "biological_process")]), ("hp", [term("HP_1", "pain")])):
        (r / f"ontology/{name}.json").write_text(json.dumps({"graphs": [{"nodes": nodes, "edges": []}]}, indent=1))
    return str(r)


@pytest.fixture(scope="session")
def ref(spark, root):
    return fm.ReferenceData(spark, root)


def edges(df, *more):
    return sorted(tuple(r) for r in df.select("from", "to", "type", "label", *more).collect())


def valid(spark, source, graph):
    nodes, e = graph
    return validate_graph(nodes.withColumnRenamed("curie", "id"), e, allowed_triples(spark, source)).count() == 0


def test_ontologies(spark, tmp_path):
    doc = {"graphs": [{"nodes": [term("UBERON_0002107", "liver"), term("UBERON_1", "organ"), term("CL_1", "cell")], "edges": [edge("UBERON_0002107", "UBERON_1"), edge("UBERON_0002107", "UBERON_1", "part_of"), edge("CL_1", "UBERON_1")]}]}
    (tmp_path / "u.json").write_text(json.dumps(doc, indent=1))
    raw = fm.read_obograph(spark, str(tmp_path / "u.json"))
    assert {r.id: (r.name, r.synonyms) for r in fm.obo_terms(raw).collect()}["UBERON_0002107"] == ("liver", ["liver too"])
    assert fm.obo_isa_edges(raw).count() == 2
    nodes, e = b.ontology_backbone(spark, str(tmp_path / "u.json"), "UBERON_", "ANA", "UBERON")
    assert nodes.count() == 2 and edges(e) == [("UBERON_1", "UBERON_0002107", "PARENT", "ANA-ANA")]
    doc = {"graphs": [{"nodes": [term("GO_1", "a", "biological_process"), term("GO_2", "b", "biological_process")], "edges": [edge("GO_2", "GO_1")]}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    graph = b.gene_ontology(spark, str(tmp_path / "g.json"))
    assert edges(graph[1]) == [("GO_1", "GO_2", "PARENT", "BPO-BPO")] and valid(spark, "gene_ontology", graph)


def test_maps(spark, ref):
    assert [tuple(r) for r in ensembl_ncbi(ref.targets(), ref.gene_names()).orderBy("ncbi_id").collect()] == [("1956", "ENSG2"), ("7157", "ENSG1")]
    assert sorted(tuple(r) for r in chembl_drugbank(ref.molecules()).collect()) == [("DB00945", "CHEMBL25"), ("DB01050", "CHEMBL100")]
    assert [tuple(r) for r in umls_disease(ref.diseases()).collect()] == [("C0011860", "MONDO_0005148")]


def test_reactome_and_bgee(spark, tmp_path, ref):
    (tmp_path / "ReactomePathways.txt").write_text("R-HSA-1\tone\tHomo sapiens\nR-HSA-2\ttwo\tHomo sapiens\nR-MMU-1\tm\tMus\n")
    (tmp_path / "ReactomePathwaysRelation.txt").write_text("R-HSA-2\tR-HSA-1\nR-MMU-1\tR-MMU-2\n")
    graph = b.reactome(spark, str(tmp_path))
    assert graph[0].count() == 2 and edges(graph[1]) == [("R-HSA-2", "R-HSA-1", "PARENT", "PWY-PWY")] and valid(spark, "reactome", graph)
    head = "Gene ID\tGene name\tAnatomical entity ID\tAnatomical entity name\tExpression\tCall quality\tExpression rank\n"
    rows = "ENSG1\tTP53\tUBERON:1\tliver\tpresent\tgold\t1000\nENSG2\tEGFR\tUBERON:1\tliver\tabsent\tgold\tx\nENSG1\tTP53\tUBERON:1 ∩ CL:2\tmix\tpresent\tgold\t1\nENSG1\tTP53\tCL:1\tcell\tpresent\tgold\t1\n"
    with gzip.open(tmp_path / "b.tsv.gz", "wt", encoding="utf-8") as f:
        f.write(head + rows)
    graph = b.bgee(spark, str(tmp_path / "b.tsv.gz"), ref)
    assert edges(graph[1], "expression_rank") == [("UBERON_1", "ENSG1", "EXPRESSION_PRESENT", "ANA-GEN", 1000.0), ("UBERON_1", "ENSG2", "EXPRESSION_ABSENT", "ANA-GEN", None)]
    assert {r.curie: r.name for r in graph[0].collect()} == {"UBERON_1": "liver", "ENSG1": "TP53", "ENSG2": "EGFR"} and valid(spark, "bgee", graph)


def test_ctd(spark, tmp_path, ref):
    text = "# comment\nexposurestressorid,exposurestressorname,exposuremarker,exposuremarkerid,diseaseid,phenotypeid\nC001,smoke,,,D003924,\nC001,smoke,TP53,7157,,\nC001,smoke,,C002,,\nC001,smoke,,,,GO:0008150\nC001,smoke,,C001,,\n"
    with gzip.open(tmp_path / "e.csv.gz", "wt") as f:
        f.write(text)
    graph = b.ctd(spark, str(tmp_path / "e.csv.gz"), ref)
    m = "MESH:C001"
    assert edges(graph[1]) == [(m, "ENSG1", "EXPOSURE_GENE", "EXP-GEN"), (m, "GO_0008150", "EXPOSURE_BIOLOGICAL_PROCESS", "EXP-BPO"), (m, "MESH:C002", "EXPOSURE_EXPOSURE", "EXP-EXP"), (m, "MONDO_0005148", "EXPOSURE_DISEASE", "EXP-DIS")]
    names = {r.curie: r.name for r in graph[0].collect()}
    assert names[m] == "smoke" and names["ENSG1"] == "TP53" and names["GO_0008150"] == "process" and valid(spark, "ctd", graph)


def test_disgenet_and_ppi(spark, tmp_path, ref):
    (tmp_path / "d.tsv").write_text("geneSymbol\tdiseaseId\tdiseaseName\tdiseaseType\tscore\tEI\nTP53\tC0011860\tT2D\tdisease\t0.9\t1.0\nEGFR\tC0011860\tT2D\tphenotype\t0.4\t\nEGFR\tC9\tx\tdisease\t1\t1\n")
    graph = b.disgenet(spark, str(tmp_path / "d.tsv"), ref)
    assert edges(graph[1], "score") == [("MONDO_0005148", "ENSG1", "ASSOCIATED_WITH", "DIS-GEN", 0.9), ("MONDO_0005148", "ENSG2", "ASSOCIATED_WITH", "PHE-GEN", 0.4)]
    (tmp_path / "p.csv").write_text("proteinA_entrezid,proteinB_entrezid,databases\n7157,1956,IntAct|BioGRID\n7157,1956,BioGRID\n7157,1,IntAct\n")
    nodes, e = b.ppi(spark, str(tmp_path / "p.csv"), ref)
    assert [(r["from"], r["to"], r.databases) for r in e.collect()] == [("ENSG1", "ENSG2", ["BioGRID", "IntAct"])] and nodes.count() == 2


def test_drugbank(spark, tmp_path, ref):
    (tmp_path / "drugbank_gene_map.tsv").write_text("UniProt ID(supplied by UniProt)\tNCBI Gene ID(supplied by NCBI)\nP1\t7157\n")
    for role in b.ROLES:
        (tmp_path / f"drugbank_all_{role}_polypeptide_ids.csv").write_text("ID,Name,Species,UniProt ID,Drug IDs\n" + ("1,x,Humans,P1,DB00945; DB9\n2,y,Mice,P1,DB01050\n" if role in ("target", "enzyme") else ""))
    xml = '<drugbank xmlns="http://www.drugbank.ca"><drug><drugbank-id>DB2x</drugbank-id><drugbank-id primary="true">{}</drugbank-id><drug-interactions><drug-interaction><drugbank-id>{}</drugbank-id><description>bleeding risk</description></drug-interaction></drug-interactions></drug><drug><drugbank-id primary="true">{}</drugbank-id><drug-interactions><drug-interaction><drugbank-id>{}</drugbank-id><description>bleeding risk</description></drug-interaction></drug-interactions></drug></drugbank>'
    (tmp_path / "full database.xml").write_text(xml.format("DB00945", "DB01050", "DB01050", "DB00945"))
    graph = b.drugbank(spark, str(tmp_path), ref)
    assert edges(graph[1]) == [("CHEMBL25", "CHEMBL100", "DRUG_INTERACTION", "DRG-DRG"), ("CHEMBL25", "ENSG1", "ENZYME", "DRG-GEN"), ("DRUGBANK:DB9", "ENSG1", "ENZYME", "DRG-GEN")]
    assert {tuple(r.asserted_relations) for r in graph[1].filter("label = 'DRG-GEN'").collect()} == {("ENZYME", "TARGET")} and valid(spark, "drugbank", graph)


def test_drugcentral(spark, tmp_path, ref):
    dump = "SET x;\nCOPY public.identifier (id, struct_id, identifier, id_type) FROM stdin;\n1\t10\tCHEMBL25\tChEMBL_ID\n2\t10\tother\tX\n\\.\n\nCOPY public.omop_relationship (struct_id, relationship_name, umls_cui, concept_name) FROM stdin;\n"
    dump += "10\tindication\tC0011860\tT2D\\\\x\n10\tcontraindication\tC0011860\tT2D\n10\toff-label use\tC0011860\tT2D\n10\tindication\tC77\tnone\n10\tindication\t\\N\tnull\n\\.\n"
    with gzip.open(tmp_path / "dump.sql.gz", "wt") as f:
        f.write(dump)
    rows = fm.read_pg_dump_table(spark, str(tmp_path / "dump.sql.gz"), "omop_relationship", ["umls_cui", "concept_name"]).collect()
    assert sorted((r.umls_cui or "-", r.concept_name) for r in rows) == [("-", "null"), ("C0011860", "T2D"), ("C0011860", "T2D"), ("C0011860", "T2D\\x"), ("C77", "none")]
    graph = b.drugcentral(spark, str(tmp_path / "dump.sql.gz"), ref)
    (e,) = graph[1].collect()
    assert (e["from"], e["to"], e.type, e.relation_conflict) == ("CHEMBL25", "MONDO_0005148", "INDICATION", True) and e.asserted_relations == ["CONTRAINDICATION", "INDICATION", "OFF_LABEL_USE"] and valid(spark, "drugcentral", graph)


def test_onsides(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "o.zip", "w") as z:
        z.writestr("csv/high_confidence.csv", "ingredient_id,effect_meddra_id\n161,10028813\n161,5\nabc,10028813\n")
        z.writestr("csv/vocab_rxnorm_ingredient.csv", "rxnorm_id,rxnorm_name,x\n161,paracetamol,1\nabc,bad,1\n")
        z.writestr("csv/vocab_meddra_adverse_effect.csv", "meddra_id,meddra_name,x\n10028813,Nausea,1\n")
    graph = b.onsides(spark, str(tmp_path / "o.zip"))
    assert edges(graph[1]) == [("RXNORM:161", "meddra:10028813", "ADVERSE_DRUG_REACTION", "DRG-PHE")] and valid(spark, "onsides", graph)


def test_opentargets(spark, tmp_path, ref):
    w = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/opentargets/{name}")
    w([("MONDO_0005148", "ENSG1", (0.5, 3)), ("HP_1", "ENSG1", (0.4, 1)), ("GO_0008150", "ENSG2", (0.3, 1)), ("GO_9", "ENSG2", (0.3, 1))], "disease_id string, target_id string, metadata struct<score:double,evidence_count:long>", "target_disease_associations")
    w([("MONDO_0005148", "HP_1"), ("MONDO_0005148", "X_1")], "disease string, phenotype string", "disease_phenotype")
    w([("CHEMBL25", ([("MONDO_0005148",), (None,)],))], "id string, metadata struct<indications:array<struct<disease:string>>>", "drug_indication")
    w([(["ENSG1"], ["CHEMBL25"], ("Inhibitor",)), (["ENSG2"], ["CHEMBL25"], ("odd thing",))], "targets array<string>, chembl_ids array<string>, metadata struct<action_type:string>", "drug_mechanism_of_action")
    graph = b.opentargets(spark, str(tmp_path), ref)
    assert edges(graph[1]) == sorted([("MONDO_0005148", "ENSG1", "ASSOCIATED_WITH", "DIS-GEN"), ("HP_1", "ENSG1", "ASSOCIATED_WITH", "PHE-GEN"), ("GO_0008150", "ENSG2", "ASSOCIATED_WITH", "BPO-GEN"), ("MONDO_0005015", "MONDO_0005148", "PARENT", "DIS-DIS"), ("MONDO_0005148", "HP_1", "HAS_PHENOTYPE", "DIS-PHE"), ("CHEMBL25", "MONDO_0005148", "INDICATION", "DRG-DIS"), ("CHEMBL25", "ENSG1", "INHIBITOR", "DRG-GEN"), ("CHEMBL25", "ENSG2", "OTHER", "DRG-GEN")])
    assert {r.curie: r.name for r in graph[0].collect()} | {} == {"MONDO_0005148": "type 2 diabetes", "MONDO_0005015": "MONDO_0005015", "HP_1": "pain", "GO_0008150": "process", "ENSG1": "TP53", "ENSG2": "EGFR", "CHEMBL25": "aspirin"} and valid(spark, "opentargets", graph)


def test_gold_layouts_agree(spark, tmp_path):
    spark.createDataFrame([("G1", "GEN", ("TP53", "AAA"))], "id string, label string, properties struct<name:string,embedding_base64:string>").write.parquet(f"{tmp_path}/s")
    spark.createDataFrame([("G1", "GEN", '{"name":"TP53","embedding_base64":"AAA"}')], "id string, label string, properties string").write.parquet(f"{tmp_path}/j")
    e = [("G1", "G1", "GEN-GEN", "INTERACTS_WITH", True, '{"sources":{"direct":["a"],"indirect":["b"]},"asserted_relations":["Y","X","X"]}')]
    spark.createDataFrame(e, "from string, to string, label string, relation string, undirected boolean, properties string").write.parquet(f"{tmp_path}/e")
    out = [b.gold_graph(*fm.read_gold_graph(spark, [f"{tmp_path}/{x}"], [f"{tmp_path}/e"])) for x in "sj"]
    assert [tuple(r) for r in out[0][0].collect()] == [tuple(r) for r in out[1][0].collect()] == [("G1", "TP53", "Gene", '{"name":"TP53"}')]
    r = out[0][1].first()
    assert (r.direct_sources, r.indirect_sources, r.asserted_relations, r.type) == (["a"], ["b"], ["X", "Y"], "INTERACTS_WITH")
    x = spark.sql("""SELECT '[{"label":"a","source":"s"},"b",{"id":"c"}]' AS j""").select(b.object_list("j").alias("l")).first().l
    assert x == ["a", "b", "c"]


def test_export(spark, tmp_path):
    n, e = spark.createDataFrame([("a", "n")], "id string, label string"), spark.createDataFrame([("a", "b", "l")], "from string, to string, label string")
    fm.export_graph(n, e, f"{tmp_path}/x")
    assert spark.read.parquet(f"{tmp_path}/x/edges").select("from", "to", "label").collect() == e.collect()


def test_corpora(spark):
    rows = spark.createDataFrame([("pubmed-12-3", "t", "x"), ("77_4", "t", "x"), ("pubmed-9", None, "x"), ("pubmed-1-2", "t", "")], "id string, title string, content string")
    assert [(r.properties["pubmed_id"], r.properties["chunk_index"]) for r in c.pubmed(rows).collect()] == [("12", "3"), ("77", "4"), ("9", "0")]
    rows = spark.createDataFrame([("article-100_2", "Name -- A -- Intro", "x"), ("article-7", None, "x")], "id string, title string, content string")
    assert [(r.properties["article_id"], r.properties["section_type"], r.properties["chunk_index"]) for r in c.statpearls(rows).collect()] == [("100", "Intro", "2"), ("7", "Unknown", "0")]
    rows = spark.createDataFrame([("textbooks-Big_Book_12", None, "x")], "id string, title string, content string")
    r = c.textbooks(rows).first()
    assert (r.title, r.properties["book_name"], r.properties["chunk_index"]) == ("Big_Book", "Big_Book", "12")
    rows = spark.createDataFrame([("1", None, "t", "body", "u", "o" * 600)], "id string, source string, title string, clean_text string, url string, overview string")
    assert len(c.clinical_guidelines(rows).first().properties["overview"]) == 500
    rows = spark.createDataFrame([("PMC1", "t", "j", "2020", "x")], "pmcid string, title string, journal string, publication_date string, text string")
    assert c.pubmed_case_reports(rows).first().external_id == "PMC1"
    pages = spark.createDataFrame([("http://x/a.html", "<title> A &amp; b </title><script>no</script><h1>Head</h1><p>one<p>two"), ("http://x/b.htm", "<p>only"), ("http://x/c", None)], "url string, html string")
    assert [(r.title, r.text, r.extension) for r in c.pages_to_documents(pages).collect()] == [("A & b", "# Head\none\ntwo", "html"), ("b", "only", "htm")]


def test_schemas(spark):
    for s in SCHEMAS:
        assert allowed_triples(spark, s).count() > 0


def test_titles_match_sql_where_a_reference_is_cut(spark, tmp_path):
    """Titles cut inside a reference, and white space that isn't ASCII: as in the query's SQL."""
    import duckdb

    from kgweave.plans import registry

    registry.load()
    titles = ["a &quot", "b &quo", "c &lt d &gt", "e &amp", "f &amp g &quot;h&quot;", "&ampx", " i  j", "k&lt;b&gt; &amp;quot; \t\n l"]
    rows = [(i, f"http://x/{i}", f"<html><head><title>{t}</title></head><body><p>&lt z</p></body></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = registry.QUERIES["S14_page_titles"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted(con.execute(registry.ORACLES["S14_page_titles"]).fetchall())


def test_onsides_joins_a_vocabulary_row_once(spark, tmp_path):
    """Every archive holds the whole vocabularies: pairs aren't multiplied by the archives before they are merged."""
    for k in range(4):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
            z.writestr("csv/high_confidence.csv", "ingredient_id,effect_meddra_id\n" + f"{k},7\n")
            z.writestr("csv/vocab_rxnorm_ingredient.csv", "rxnorm_id,rxnorm_name\n" + "".join(f"{i},drug {i}\n" for i in range(4)))
            z.writestr("csv/vocab_meddra_adverse_effect.csv", "meddra_id,meddra_name\n7,rash\n")
    nodes, edges = b.onsides(spark, str(tmp_path))
    assert sorted((r["from"], r["to"]) for r in edges.collect()) == [(f"RXNORM:{i}", "meddra:7") for i in range(4)]
    assert {r.name for r in nodes.collect()} == {"rash", *(f"drug {i}" for i in range(4))}
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    for side in ("rxnorm_id", "meddra_id"):
        assert any(x.strip(" :+-").startswith("Aggregate") and f"[{side}#" in x for x in plan.split("\n"))
