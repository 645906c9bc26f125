"""Builders of node and edge tables from published biomedical sources: raw files -> (nodes, edges).

Nodes have ``curie, name, label`` and what the source knows; edges ``from, to, type, label, sources`` and attributes.
Where a source repeats an edge or a node, the smallest row by all columns counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.operators.enrich import chembl_drugbank, enrich, ensembl_ncbi, harmonize, umls_disease
from kgweave.operators.merge import collapse_relations
from kgweave.sources import formats as fm

#: Abbreviations of node labels (fixed values).
LABELS = {
    "ANA": "AnatomicalStructure", "BPO": "GoBiologicalProcess", "CCO": "GoCellularComponent", "DIS": "Disease", "DRG": "Drug",
    "EXP": "Exposure", "GEN": "Gene", "MFN": "GoMolecularFunction", "PHE": "Phenotype", "PWY": "Pathway",
}
#: Drug-gene actions (fixed values).
ACTIONS = (
    "ACTIVATOR", "AGONIST", "ALLOSTERIC_ANTAGONIST", "ANTAGONIST", "ANTISENSE_INHIBITOR", "BINDING_AGENT", "BLOCKER", "CROSS_LINKING_AGENT", "DEGRADER",
    "DISRUPTING_AGENT", "EXOGENOUS_GENE", "EXOGENOUS_PROTEIN", "HYDROLYTIC_ENZYME", "INHIBITOR", "INVERSE_AGONIST", "MODULATOR", "NEGATIVE_ALLOSTERIC_MODULATOR",
    "NEGATIVE_MODULATOR", "OPENER", "OTHER", "PARTIAL_AGONIST", "POSITIVE_ALLOSTERIC_MODULATOR", "POSITIVE_MODULATOR", "PROTEOLYTIC_ENZYME", "RELEASING_AGENT",
    "RNAI_INHIBITOR", "STABILISER", "SUBSTRATE", "VACCINE_ANTIGEN",
)
#: Labels of namespaces, roles of target files and kinds of use (fixed values).
NAMESPACES = {"biological_process": "BPO", "cellular_component": "CCO", "molecular_function": "MFN"}
ROLES = {"carrier": "CARRIER", "enzyme": "ENZYME", "target": "TARGET", "transporter": "TRANSPORTER"}
USES = {"indication": "INDICATION", "contraindication": "CONTRAINDICATION", "off-label use": "OFF_LABEL_USE"}

Graph = tuple[DataFrame, DataFrame]


def _map(col: str, values: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(col))


def _edge(df: DataFrame, src: str, dst: str, kind, label, source: str, *extra: str) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    rows = df.select(F.col(src).alias("from"), F.col(dst).alias("to"), lit(kind).alias("type"), lit(label).alias("label"), F.array(F.lit(source)).alias("sources"), *extra)
    return fm.one_per(rows.filter("`from` is not null and `to` is not null"), "from", "to")


def _nodes(df: DataFrame, curie: str, label, *cols: Column) -> DataFrame:
    return fm.one_per(df.select(F.col(curie).alias("curie"), (label if isinstance(label, Column) else F.lit(label)).alias("label"), *cols), "curie")


def _ends(edges: DataFrame) -> DataFrame:
    """Endpoints with the labels that the structural labels of their edges name."""
    at = lambda c, i: edges.select(F.col(c).alias("curie"), F.split("label", "-")[i].alias("k"))
    return _nodes(at("from", 0).union(at("to", 1)).withColumn("label", _map("k", LABELS)), "curie", F.col("label"))


class Enricher:
    """Names and descriptions of endpoints from the shared tables."""

    def __init__(self, ref: fm.ReferenceData):
        self.ref = ref

    def genes(self, nodes: DataFrame) -> DataFrame:
        meta = self.ref.targets().select(F.col("id").alias("curie"), F.col("metadata.approved_symbol").alias("symbol"), F.col("metadata.approved_name").alias("description"), F.col("metadata.biotype").alias("biotype"))
        return enrich(nodes, meta, "curie").withColumn("name", F.coalesce("symbol", "curie"))

    def drugs(self, nodes: DataFrame) -> DataFrame:
        meta = self.ref.molecules().select(F.col("id").alias("curie"), F.col("metadata.name").alias("drug_name"), F.col("metadata.drug_type").alias("drug_type"))
        return enrich(nodes, meta, "curie").withColumn("name", F.coalesce("drug_name", "curie"))

    def diseases(self, nodes: DataFrame) -> DataFrame:
        meta = self.ref.diseases().select(F.col("id").alias("curie"), F.col("name").alias("disease_name"), "description")
        own = F.col("name") if "name" in nodes.columns else F.lit(None).cast("string")
        return enrich(nodes, meta, "curie").withColumn("name", F.coalesce(own, "disease_name", "curie"))

    def terms(self, nodes: DataFrame, ontology: str) -> DataFrame:
        meta = fm.obo_terms(self.ref.ontology(ontology)).select(F.col("id").alias("curie"), F.col("name").alias("term_name"), F.col("definition").alias("description"))
        return enrich(nodes, meta, "curie").withColumn("name", F.coalesce("term_name", "curie"))


def _union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _by_label(enricher: Enricher, ends: DataFrame) -> DataFrame:
    pick = lambda *ls: ends.filter(F.col("label").isin(*ls))
    return _union(
        enricher.genes(pick("Gene")), enricher.drugs(pick("Drug")), enricher.diseases(pick("Disease")), enricher.terms(pick("Phenotype"), "hp"),
        enricher.terms(pick("GoBiologicalProcess", "GoCellularComponent", "GoMolecularFunction"), "go_plus"), pick("AnatomicalStructure", "Pathway", "Exposure").withColumn("name", F.col("curie")),
    )


def ontology_backbone(spark: SparkSession, path: str, prefix: str, abbrev: str, source: str) -> Graph:
    """Terms of one prefix and their is_a edges (parent to child)."""
    raw = fm.read_obograph(spark, path)
    ours = lambda c: F.col(c).startswith(prefix)
    terms = fm.obo_terms(raw).filter(ours("id"))
    nodes = terms.select(F.col("id").alias("curie"), "name", F.lit(LABELS[abbrev]).alias("label"), "definition", "synonyms", "xrefs")
    return nodes, _edge(fm.obo_isa_edges(raw).filter(ours("parent") & ours("child")), "parent", "child", "PARENT", f"{abbrev}-{abbrev}", source)


def gene_ontology(spark: SparkSession, path: str) -> Graph:
    raw = fm.read_obograph(spark, path)
    ns = fm.go_term_namespaces(raw).filter(F.col("namespace").isin(*NAMESPACES)).withColumn("k", _map("namespace", NAMESPACES))
    nodes = fm.obo_terms(raw).join(ns, "id").select(F.col("id").alias("curie"), "name", _map("k", LABELS).alias("label"), "namespace", "definition", "synonyms")
    e = fm.obo_isa_edges(raw).filter("parent like 'GO\\_%'").join(ns.withColumnRenamed("id", "child"), "child")
    return nodes, _edge(e, "parent", "child", "PARENT", F.concat("k", F.lit("-"), "k"), "GENE_ONTOLOGY")


def reactome(spark: SparkSession, root: str, species: str = "R-HSA-") -> Graph:
    p = fm.read_csv(spark, f"{root}/ReactomePathways.txt", "\t", names=["id", "name", "species"]).filter(F.col("id").startswith(species))
    r = fm.read_csv(spark, f"{root}/ReactomePathwaysRelation.txt", "\t", names=["parent", "child"]).filter(F.col("parent").startswith(species) & F.col("child").startswith(species))
    return _nodes(p, "id", LABELS["PWY"], F.col("name"), F.col("species")), _edge(r, "parent", "child", "PARENT", "PWY-PWY", "REACTOME")


def bgee(spark: SparkSession, path: str, ref: fm.ReferenceData) -> Graph:
    """Expression of genes in anatomical structures; composite structures are left out."""
    raw = fm.read_csv(spark, path, "\t").filter(F.col("Anatomical entity ID").startswith("UBERON") & ~F.col("Anatomical entity ID").contains("∩"))
    raw = raw.select(F.replace(F.col("Anatomical entity ID"), F.lit("UBERON:"), F.lit("UBERON_")).alias("a"), F.col("Anatomical entity name").alias("a_name"), F.col("Gene ID").alias("g"), F.col("Expression").alias("x"), F.col("Call quality").alias("call_quality"), F.col("Expression rank").try_cast("double").alias("expression_rank"))
    kind = F.when(F.col("x") == "present", "EXPRESSION_PRESENT").otherwise("EXPRESSION_ABSENT")
    edges = _edge(raw.filter("x in ('present', 'absent')"), "a", "g", kind, "ANA-GEN", "BGEE", "expression_rank", "call_quality")
    return _union(_nodes(raw, "a", LABELS["ANA"], F.col("a_name").alias("name")), Enricher(ref).genes(_nodes(raw, "g", LABELS["GEN"]))), edges


def ctd(spark: SparkSession, path: str, ref: fm.ReferenceData) -> Graph:
    """Exposure events: to diseases, genes, other exposures and GO terms."""
    r = fm.read_csv(spark, path, comment="#")
    mesh = lambda c: F.when(F.col(c) != "", F.concat(F.lit("MESH:"), F.col(c)))
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    ev = r.select(mesh("exposurestressorid").alias("e"), F.col("exposurestressorname").alias("e_name"), full("exposuremarker").alias("marker"), mesh("exposuremarkerid").alias("marker_id"), mesh("diseaseid").alias("mesh"), F.replace(full("phenotypeid"), F.lit("GO:"), F.lit("GO_")).alias("go"))
    xref = fm.obo_terms(ref.ontology("mondo")).select(F.col("id").alias("mondo"), F.explode("xrefs").alias("mesh")).distinct()
    target = ref.targets().select(F.col("id").alias("gene"), F.col("metadata.approved_symbol").alias("marker"))
    ns = fm.go_term_namespaces(ref.ontology("go_plus")).filter(F.col("namespace").isin(*NAMESPACES)).withColumnRenamed("id", "go")
    go = ev.join(ns, "go").withColumn("kind", F.concat(F.lit("EXPOSURE_"), F.upper("namespace"))).withColumn("lab", F.concat(F.lit("EXP-"), _map("namespace", NAMESPACES)))
    edges = (
        _edge(ev.join(xref, "mesh"), "e", "mondo", "EXPOSURE_DISEASE", "EXP-DIS", "CTD")
        .union(_edge(ev.join(target, "marker"), "e", "gene", "EXPOSURE_GENE", "EXP-GEN", "CTD"))
        .union(_edge(ev.filter("marker is null and marker_id <> e"), "e", "marker_id", "EXPOSURE_EXPOSURE", "EXP-EXP", "CTD"))
        .union(_edge(go, "e", "go", F.col("kind"), F.col("lab"), "CTD"))
    )
    names = ev.select(F.col("e").alias("curie"), F.col("e_name").alias("exposure_name"))
    nodes = _by_label(Enricher(ref), _ends(edges))
    return enrich(nodes, names.filter("exposure_name is not null"), "curie").withColumn("name", F.coalesce("exposure_name", "name")).drop("exposure_name"), edges


def disgenet(spark: SparkSession, path: str, ref: fm.ReferenceData) -> Graph:
    r = fm.read_csv(spark, path, "\t").select(F.col("geneSymbol").alias("symbol"), F.col("diseaseId").alias("umls"), F.col("diseaseName").alias("d_name"), F.col("diseaseType").alias("kind"), F.col("score").try_cast("double").alias("score"), F.col("EI").try_cast("double").alias("evidence_index"))
    m = r.join(ref.targets().select(F.col("id").alias("gene"), F.col("metadata.approved_symbol").alias("symbol")), "symbol")
    m = harmonize(m, "umls", umls_disease(ref.diseases()), "umls_id", "disease_id")
    head = F.when(F.col("kind") == "phenotype", "PHE").otherwise("DIS")
    edges = _edge(m, "umls", "gene", "ASSOCIATED_WITH", F.concat(head, F.lit("-GEN")), "DISGENET", "score", "evidence_index")
    d = _nodes(m.withColumn("k", head), "umls", _map("k", LABELS), F.col("d_name").alias("name"))
    en = Enricher(ref)
    return _union(en.diseases(d), en.genes(_nodes(m, "gene", LABELS["GEN"]))), edges


def drugbank(spark: SparkSession, root: str, ref: fm.ReferenceData) -> Graph:
    """Drug-gene roles of humans and drug-drug interactions; drugs without a ChEMBL id keep their own."""
    xref = chembl_drugbank(ref.molecules())
    # the map's ids may or may not carry the prefix; both forms meet
    both = xref.union(xref.select(F.concat(F.lit("DRUGBANK:"), "drugbank_id"), "chembl_id"))
    genes = fm.read_csv(spark, f"{root}/drugbank_gene_map.tsv", "\t").select(F.col("UniProt ID(supplied by UniProt)").alias("u"), F.col("NCBI Gene ID(supplied by NCBI)").alias("g")).filter("u is not null and g is not null")
    roles = None
    for role, kind in ROLES.items():
        f = fm.read_csv(spark, f"{root}/drugbank_all_{role}_polypeptide_ids.csv").filter("Species = 'Humans'").select(F.col("UniProt ID").alias("u"), F.explode(F.split("Drug IDs", "; ")).alias("d"), F.lit(kind).alias("type"))
        roles = f if roles is None else roles.union(f)
    dg = roles.join(genes, "u").withColumn("d", F.concat(F.lit("DRUGBANK:"), "d"))
    dg = harmonize(harmonize(dg, "d", both, "drugbank_id", "chembl_id", "left"), "g", ensembl_ncbi(ref.targets(), ref.gene_names()), "ncbi_id", "ensembl_id")
    dg = collapse_relations(dg.select(F.col("d").alias("from"), F.col("g").alias("to"), F.lit("DRG-GEN").alias("label"), "type", F.array(F.lit("DRUG_BANK")).alias("sources")), "DRUG_BANK")
    dd = fm.read_drug_interactions_xml(spark, f"{root}/full database.xml")
    dd = harmonize(harmonize(dd, "head", both, "drugbank_id", "chembl_id", "left"), "tail", both, "drugbank_id", "chembl_id", "left")
    dd = _edge(dd.withColumnRenamed("description", "interaction_description"), "head", "tail", "DRUG_INTERACTION", "DRG-DRG", "DRUG_BANK", "interaction_description")
    edges = _union(dg, dd)
    return _by_label(Enricher(ref), _ends(edges)), edges


def drugcentral(spark: SparkSession, path: str, ref: fm.ReferenceData) -> Graph:
    """Indications, contraindications and off-label uses, one edge per pair with all statements."""
    omop = fm.read_pg_dump_table(spark, path, "omop_relationship", ["struct_id", "relationship_name", "umls_cui", "concept_name"])
    chembl = fm.read_pg_dump_table(spark, path, "identifier", ["struct_id", "identifier", "id_type"]).filter("id_type = 'ChEMBL_ID'").select("struct_id", F.col("identifier").alias("drug"))
    m = omop.join(chembl, "struct_id").filter(F.col("relationship_name").isin(*USES) & F.col("umls_cui").isNotNull())
    m = harmonize(m, "umls_cui", umls_disease(ref.diseases()), "umls_id", "disease_id").withColumn("k", F.when(F.col("umls_cui").startswith("HP_"), "PHE").otherwise("DIS"))
    edges = collapse_relations(m.select(F.col("drug").alias("from"), F.col("umls_cui").alias("to"), F.concat(F.lit("DRG-"), "k").alias("label"), _map("relationship_name", USES).alias("type"), F.array(F.lit("DRUG_CENTRAL")).alias("sources")), "DRUG_CENTRAL")
    return _union(Enricher(ref).drugs(_nodes(m, "drug", LABELS["DRG"])), _nodes(m, "umls_cui", _map("k", LABELS), F.col("concept_name").alias("name"))), edges


def onsides(spark: SparkSession, path: str) -> Graph:
    """Adverse reactions with native ids; ingredients with a numeric RxNorm id only. A vocabulary row that several archives hold counts once."""
    h = fm.read_zip_csv(spark, path, "csv/high_confidence.csv", ["ingredient_id", "effect_meddra_id"])
    rx = fm.read_zip_csv(spark, path, "csv/vocab_rxnorm_ingredient.csv", ["rxnorm_id", "rxnorm_name"]).filter(F.col("rxnorm_id").rlike(r"^\d+$")).distinct()
    md = fm.read_zip_csv(spark, path, "csv/vocab_meddra_adverse_effect.csv", ["meddra_id", "meddra_name"]).distinct()
    j = h.join(rx, F.col("ingredient_id") == F.col("rxnorm_id")).join(md, F.col("effect_meddra_id") == F.col("meddra_id"))
    j = j.select(F.concat(F.lit("RXNORM:"), "rxnorm_id").alias("d"), "rxnorm_name", F.concat(F.lit("meddra:"), "meddra_id").alias("p"), "meddra_name")
    nodes = _nodes(j, "d", LABELS["DRG"], F.col("rxnorm_name").alias("name")).union(_nodes(j, "p", LABELS["PHE"], F.col("meddra_name").alias("name")))
    return nodes, _edge(j, "d", "p", "ADVERSE_DRUG_REACTION", "DRG-PHE", "ONSIDES")


def ppi(spark: SparkSession, path: str, ref: fm.ReferenceData) -> Graph:
    m = ensembl_ncbi(ref.targets(), ref.gene_names())
    r = fm.read_csv(spark, path).select(F.col("proteinA_entrezid").alias("a"), F.col("proteinB_entrezid").alias("b"), F.split("databases", r"\|").alias("db"))
    r = harmonize(harmonize(r, "a", m, "ncbi_id", "ensembl_id"), "b", m, "ncbi_id", "ensembl_id")
    edges = r.groupBy(F.col("a").alias("from"), F.col("b").alias("to")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("db")))).alias("databases"))
    edges = edges.select("from", "to", F.lit("INTERACTS_WITH").alias("type"), F.lit("GEN-GEN").alias("label"), F.array(F.lit("PRIMEKG")).alias("sources"), "databases")
    return Enricher(ref).genes(_ends(edges)), edges


def opentargets(spark: SparkSession, root: str, ref: fm.ReferenceData) -> Graph:
    """Associations, hierarchies, phenotypes, indications and mechanisms."""
    read = lambda n: spark.read.parquet(f"{root}/opentargets/{n}")
    src = "OPEN_TARGETS"
    hp = lambda c: F.col(c).contains("HP")
    a = read("target_disease_associations").select("disease_id", "target_id", F.col("metadata.score").alias("evidence_score"), F.col("metadata.evidence_count").alias("evidence_count"))
    ns = fm.go_term_namespaces(ref.ontology("go_plus")).select(F.col("id").alias("disease_id"), _map("namespace", NAMESPACES).alias("go"))
    head = F.when(F.col("disease_id").startswith("GO_"), F.col("go")).when(hp("disease_id"), "PHE").when(F.col("disease_id").startswith("UBERON_"), "ANA").otherwise("DIS")
    a = a.join(ns, "disease_id", "left").withColumn("head", head).filter("head is not null")
    assoc = _edge(a, "disease_id", "target_id", "ASSOCIATED_WITH", F.concat("head", F.lit("-GEN")), src, "evidence_score", "evidence_count")
    parents = ref.diseases().select("id", F.explode("metadata.parents").alias("parent"))
    dis = _edge(parents.filter(~hp("id") & ~F.col("id").startswith("GO_")), "parent", "id", "PARENT", "DIS-DIS", src)
    phe = _edge(parents.filter(F.col("id").startswith("HP_") & F.col("parent").startswith("HP_")), "parent", "id", "PARENT", "PHE-PHE", src)
    has = _edge(read("disease_phenotype").filter(hp("phenotype")), "disease", "phenotype", "HAS_PHENOTYPE", "DIS-PHE", src)
    ind = read("drug_indication").select("id", F.explode("metadata.indications").alias("i")).select("id", F.col("i.disease").alias("disease")).filter(F.col("disease").isNotNull() & ~hp("disease") & ~F.col("disease").startswith("GO_"))
    ind = _edge(ind, "id", "disease", "INDICATION", "DRG-DIS", src)
    moa = read("drug_mechanism_of_action").select(F.explode("chembl_ids").alias("from"), "targets", F.regexp_replace(F.upper("metadata.action_type"), "[ -]", "_").alias("action")).select("from", F.explode("targets").alias("to"), "action").filter("`from` is not null and `to` is not null")
    moa = moa.select("from", "to", F.lit("DRG-GEN").alias("label"), F.when(F.col("action").isin(*ACTIONS), F.col("action")).otherwise("OTHER").alias("type"), F.array(F.lit(src)).alias("sources"))
    edges = _union(assoc, dis, phe, has, ind, collapse_relations(moa, src, tuple(a for a in ACTIONS if a != "OTHER")))
    return _by_label(Enricher(ref), _ends(edges)), edges


def gold_graph(nodes: DataFrame, edges: DataFrame) -> Graph:
    """Released tables (see ``read_gold_graph``) in our shape: full labels, relation types, sources as two lists, sorted distinct asserted relations."""
    prop = lambda p: F.get_json_object("properties", p)
    n = nodes.select(F.col("id").alias("curie"), F.coalesce(prop("$.name"), F.col("id")).alias("name"), F.coalesce(_map("label", LABELS), F.col("label")).alias("label"), "properties")
    arr = lambda p: F.coalesce(F.from_json(prop(p), "array<string>"), F.array().cast("array<string>"))
    said = F.array_sort(F.array_distinct(arr("$.asserted_relations")))
    e = edges.select("from", "to", "label", F.col("relation").alias("type"), "undirected", arr("$.sources.direct").alias("direct_sources"), arr("$.sources.indirect").alias("indirect_sources"), said.alias("asserted_relations"), "properties")
    return n, e


def object_list(col: Column | str) -> Column:
    """A JSON list of strings or of objects with a label or an id -> a list of strings."""
    items = F.from_json(col, "array<string>")
    field = lambda x: F.coalesce(F.get_json_object(x, "$.label"), F.get_json_object(x, "$.id"))
    return F.filter(F.transform(items, lambda x: F.when(x.startswith("{"), field(x)).otherwise(x)), lambda x: x.isNotNull())
