"""Readers of published file formats as lazy tables. CSV columns are strings; builders cast them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgweave.sources.archives import read_pg_dump_table, read_zip_csv  # noqa: F401

OBO = "http://purl.obolibrary.org/obo/"
NAMESPACE = "http://www.geneontology.org/formats/oboInOwl#hasOBONamespace"
_VAL = "struct<val:string>"
GRAPHS = (
    "graphs array<struct<nodes:array<struct<id:string,lbl:string,meta:struct<definition:struct<val:string>,synonyms:array<struct<val:string>>,xrefs:array<struct<val:string>>,"
    "basicPropertyValues:array<struct<pred:string,val:string>>>>>,edges:array<struct<sub:string,pred:string,obj:string>>>>"
)
DRUG = "`drugbank-id` array<struct<_VALUE:string,_primary:boolean>>, `drug-interactions` struct<`drug-interaction`:array<struct<`drugbank-id`:string,description:string>>>"


def read_obograph(spark: SparkSession, path: str) -> DataFrame:
    """The raw document: one row with ``graphs``. The schema is given, so nothing is inferred."""
    return spark.read.schema(GRAPHS).json(path, multiLine=True)


def obo_terms(raw: DataFrame) -> DataFrame:
    """``(id, name, definition, synonyms, xrefs)``, one row per id (the smallest in the order of its columns)."""
    n = raw.select(F.explode("graphs.nodes").alias("ns")).select(F.explode("ns").alias("n"))
    vals = lambda c: F.transform(c, lambda x: x["val"])
    t = n.select(F.replace(F.col("n.id"), F.lit(OBO), F.lit("")).alias("id"), F.col("n.lbl").alias("name"), F.col("n.meta.definition.val").alias("definition"), vals("n.meta.synonyms").alias("synonyms"), vals("n.meta.xrefs").alias("xrefs"))
    return one_per(t.filter("id is not null"), "id")


def one_per(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key: the smallest by all its other columns."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_m")).select(*keys, "_m.*").select(*df.columns) if rest else df.distinct()


def obo_isa_edges(raw: DataFrame) -> DataFrame:
    """``(parent, child)`` of the is_a edges."""
    e = raw.select(F.explode("graphs.edges").alias("es")).select(F.explode("es").alias("e")).filter(F.col("e.pred").contains("is_a"))
    strip = lambda c: F.replace(F.col(c), F.lit(OBO), F.lit(""))
    return e.select(strip("e.obj").alias("parent"), strip("e.sub").alias("child")).filter("parent is not null and child is not null")


def go_term_namespaces(raw: DataFrame) -> DataFrame:
    """``(id, namespace)`` of the GO terms."""
    n = raw.select(F.explode("graphs.nodes").alias("ns")).select(F.explode("ns").alias("n"))
    ns = F.filter("n.meta.basicPropertyValues", lambda x: x["pred"] == NAMESPACE)[0]["val"]
    t = n.select(F.replace(F.col("n.id"), F.lit(OBO), F.lit("")).alias("id"), ns.alias("namespace")).filter("id like 'GO\\_%' and namespace is not null")
    return one_per(t, "id")


def read_drug_interactions_xml(spark: SparkSession, path: str) -> DataFrame:
    """``(head, tail, description)``, one row per unordered pair, ends in order."""
    d = spark.read.format("xml").option("rowTag", "drug").schema(DRUG).load(path)
    # the primary id, else the first
    ids = F.col("`drugbank-id`")
    own = F.coalesce(F.filter(ids, lambda x: x["_primary"])[0]["_VALUE"], ids[0]["_VALUE"])
    p = d.select(own.alias("a"), F.explode(F.col("`drug-interactions`.`drug-interaction`")).alias("i")).select("a", F.col("i.`drugbank-id`").alias("b"), F.col("i.description").alias("description"))
    p = p.filter("a is not null and b is not null")
    return one_per(p.select(F.least("a", "b").alias("head"), F.greatest("a", "b").alias("tail"), "description"), "head", "tail")


def read_csv(spark: SparkSession, path: str, sep: str = ",", comment: str | None = None, names: list[str] | None = None) -> DataFrame:
    r = spark.read.option("sep", sep).option("header", names is None).option("quote", '"').option("escape", '"')
    df = (r.option("comment", comment) if comment else r).csv(path)
    return df.toDF(*names) if names else df


class ReferenceData:
    """The tables that several builders share, below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def targets(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/opentargets/target")

    def molecules(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/opentargets/drug_molecule")

    def diseases(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/opentargets/disease")

    def gene_names(self) -> DataFrame:
        return read_csv(self.spark, f"{self.root}/gene_names/gene_names.tsv", "\t")

    def ontology(self, name: str) -> DataFrame:
        return read_obograph(self.spark, f"{self.root}/ontology/{name}.json")


def read_gold_graph(spark: SparkSession, nodes: list[str], edges: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(id, label, properties)`` and edges ``(from, to, label, relation, undirected, properties)`` of a released graph, with properties as one
    JSON string, whether the files hold structs per type or JSON. Columns of embeddings (base64) inside are dropped."""

    def load(paths: list[str]) -> DataFrame:
        out = None
        for p in paths:
            df = spark.read.parquet(p)
            kind = df.schema["properties"].dataType
            if kind.typeName() == "struct":
                keep = [c for c in kind.fieldNames() if not c.endswith("base64")]
                df = df.withColumn("properties", F.to_json(F.struct(*[F.col(f"properties.`{c}`").alias(c) for c in keep])))
            else:
                rest = F.regexp_replace("properties", r'"[^"]*base64"\s*:\s*(?:"[^"]*"|null)\s*,?\s*', "")
                df = df.withColumn("properties", F.regexp_replace(rest, r",\s*\}$", "}"))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out

    return load(nodes), load(edges)


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("label").parquet(f"{path}/edges")
