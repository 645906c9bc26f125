"""Resumable, idempotent ingestion: what is done is skipped, equal texts are extracted once, failures are set apart,
and a stream of files ends in the same tables as one batch."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.functions.ids import content_key, duck_uuid5, identity_id, relation_id
from kgweave.functions.text import normalize_text, singularize
from kgweave.operators.chunks import CHUNKS_SQL, LEXICON_SQL, SCHEMA_SQL, TAGS_SQL, allowed_relations, embed, embed_missing, fixed_chunks, lexicon, propose_relations, tag_entities
from kgweave.operators.components import connected_components
from kgweave.operators.graph_tables import edges_to_relations, filter_valid_edges, nodes_to_entities
from kgweave.operators.merge import merge_edges, merge_nodes
from kgweave.plans import testgraph as tg
from kgweave.plans.registry import query
from kgweave.plans.scratch import Scratch
from kgweave.streaming.merged import Runs, join_components


def skip_done(items: DataFrame, ledger: DataFrame, extraction_key: str, key: str = "chunk_id", text: str | None = None) -> DataFrame:
    """Items without a ledger entry for (id, extraction); with ``text`` the content counts too. Adds ``content_id``."""
    parts = [F.col(key).cast("string"), F.lit(extraction_key)] + ([F.col(text)] if text else [])
    return items.withColumn("content_id", content_key(*parts)).join(ledger.select("content_id"), "content_id", "left_anti")


def extract_distinct(chunks: DataFrame, extract: Callable[[DataFrame], DataFrame], key: str = "chunk_id", text: str = "text") -> DataFrame:
    """Run ``extract`` (from ``(chunk_id, text)`` to rows with ``chunk_id``) once per distinct text and bind its rows to all chunks of that text."""
    h = chunks.filter(F.col(text).isNotNull()).withColumn("_h", F.sha2(text, 256))
    got = extract(h.groupBy(F.col("_h").alias(key)).agg(F.min(text).alias(text)))
    return h.select(key, "_h").join(got.withColumnRenamed(key, "_h"), "_h").drop("_h")


def isolate(items: DataFrame, run: Callable[[str], str], col: str = "text", key: str = "chunk_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply a helper that may raise to each row: (rows with ``value``, failed rows with ``error``, status counts and how the run ended)."""

    def safe(x: pd.Series) -> pd.DataFrame:
        out = []
        for v in x:
            try:
                out.append((run(v), None))
            except Exception as e:  # noqa: BLE001  any failure of a row is set apart
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["value", "error"], dtype=object)

    r = items.withColumn("_r", F.pandas_udf(safe, "value string, error string")(F.col(col)))
    ok, bad = r.filter("_r.error is null").withColumn("value", F.col("_r.value")).drop("_r"), r.filter("_r.error is not null").select(key, F.col("_r.error").alias("error"))
    n_ok, n_bad = F.count_if(F.col("_r.error").isNull()), F.count_if(F.col("_r.error").isNotNull())
    status = r.agg(n_ok.alias("succeeded"), n_bad.alias("failed"), F.when(n_bad == 0, "succeeded").when(n_ok == 0, "failed").otherwise("partial").alias("status"))
    return ok, bad, status


def answer_key(question, project, config, graphs):
    """Cache key of an answer; no graph set differs from any set, whose order doesn't matter."""
    names = F.when(graphs.isNull(), F.lit("*")).otherwise(F.concat(F.lit("="), F.array_join(F.array_sort(F.array_distinct(graphs)), "\x1f")))
    return content_key(question, project, config, names)


def ingest_graph(nodes: DataFrame, edges: DataFrame, dataset: str, entities: DataFrame, relations: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A structured graph into entity and relation tables: ids, names, vectors of names not in the cache, merge. Returns both tables and new cache rows."""
    e = nodes_to_entities(nodes, dataset).withColumn("text", F.col("name"))
    e, fresh = embed_missing(e, cache, model)
    e = e.select(*entities.columns)
    r = edges_to_relations(filter_valid_edges(edges, nodes), nodes).select(*relations.columns)
    merged = merge_nodes(entities, e)
    return merged, merge_edges(relations, r, merged), fresh


#: Tables that a batch adds rows to; ``documents`` is written last and makes the batch count.
SCHEMAS = {
    "chunks": "chunk_id string, doc_id string, text string",
    "mentions": "chunk_id string, doc_id string, name string, label string, score double, first long",
    "facts": "chunk_id string, doc_id string, head_name string, head_label string, type string, tail_name string, tail_label string, score double",
    "vectors": "key string, vector array<float>",
    "documents": "doc_id string",
}


class Tables:
    """Append-only tables below a folder, one subfolder for each batch. A batch is written whole, over what a lost run left of it, and
    nothing else is rewritten; readers see the batches whose ``documents`` are complete."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def batches(self) -> list[int]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/documents")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root)]
        return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, name: str) -> DataFrame:
        """All rows of the complete batches, with ``batch``."""
        schema, done = f"{SCHEMAS[name]}, batch int", self.batches()
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/batch={b}" for b in done])

    def current(self, name: str) -> DataFrame:
        """Rows of each document's last batch: a document that comes again replaces what it said before."""
        last = self.read("documents").groupBy("doc_id").agg(F.max("batch").alias("batch"))
        return self.read(name).join(last, ["doc_id", "batch"], "left_semi").drop("batch")

    def one(self, name: str, batch: int) -> DataFrame:
        """The rows of a batch, complete or not."""
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}/batch={batch}")

    def entities(self) -> Runs:
        """By name and label: largest score, number of chunks, vector of the name."""
        return Runs(self.spark, f"{self.path}/merged-entities", "name string, label string, score double, vector array<float>, n_chunks long", ENTITY, ["score", "vector"], ["n_chunks"])

    def relations(self) -> Runs:
        return Runs(self.spark, f"{self.path}/merged-relations", ", ".join(f"{c} string" for c in FACT) + ", score double, n_chunks long", FACT, ["score"], ["n_chunks"])

    def names(self) -> Runs:
        """The partition of names into entities: ``node`` is a name or a normal form with its label, ``root`` stands for its part."""
        return Runs(self.spark, f"{self.path}/merged-names", "node string, root string", ["node"], ["root"], [])

    def fold(self) -> None:
        done = self.batches()
        for runs in (self.entities(), self.relations(), self.names()):
            runs.fold(done)

    def write(self, name: str, df: DataFrame, batch: int) -> DataFrame:
        path = f"{self.path}/{name}/batch={batch}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


MODEL = "hashed-64"
ENTITY, FACT = ["name", "label"], ["head_name", "head_label", "type", "tail_name", "tail_label"]


def _added(tables: Tables, source: str, keys: list[str], batch: int, again: DataFrame | None) -> DataFrame:
    """What a batch adds to each key, and all that there is for the keys of documents that come again."""
    totals = lambda df: df.groupBy(*keys).agg(F.max("score").alias("score"), F.count_distinct("chunk_id").alias("n_chunks"))
    own = tables.one(source, batch)
    added = totals(own).withColumn("absolute", F.lit(False))
    if again is None:
        return added
    touched = tables.current(source).join(again, "doc_id", "left_semi").select(*keys).distinct()
    rest = tables.current(source).join(again, "doc_id", "left_anti").unionByName(own)
    now = touched.join(totals(rest.join(touched, keys, "left_semi")), keys, "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    return added.join(touched, keys, "left_anti").unionByName(now.withColumn("absolute", F.lit(True)))


def same_normal_form(names: DataFrame) -> DataFrame:
    """Pairs of ``(name, label)`` with the name's normal singular: names that agree in it are one entity."""
    node = lambda x: F.concat_ws("\0", x, "label")
    form = singularize(normalize_text("name", True))
    return names.select(node("name").alias("a"), node(F.concat(F.lit("\x01"), form)).alias("b"))


def ingest_batch(docs: DataFrame, tables: Tables, names: DataFrame, allowed: DataFrame, batch: int, chunker: Callable[[DataFrame], DataFrame] = fixed_chunks, pairs: Callable[[DataFrame], DataFrame] = same_normal_form) -> None:
    """One batch of ``(doc_id, text)``: chunks, tagged entities, relations between them, and vectors of chunk texts and names that no earlier
    batch has; what it adds to entities and relations, and what ``pairs`` of its names that are new join in the partition of names. Equal texts are
    tagged and embedded once. A batch that is complete is skipped, one that was lost half-way is written anew, so running it again
    changes nothing. A document that comes again replaces what it said before; names stay joined."""
    if batch in tables.batches():
        return tables.fold()  # if that was lost
    cache = tables.read("vectors").select("key", "vector")
    chunks = tables.write("chunks", chunker(docs), batch)
    found = extract_distinct(chunks.select("chunk_id", "text"), lambda c: tag_entities(c, names)).join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    mentions = tables.write("mentions", found.select("chunk_id", "doc_id", "name", "label", "score", F.col("first").cast("long").alias("first")), batch)
    facts = propose_relations(mentions.select("chunk_id", "name", "label", "first"), allowed)
    tables.write("facts", facts.join(chunks.select("chunk_id", "doc_id"), "chunk_id").select("chunk_id", "doc_id", "head_name", "head_label", "type", "tail_name", "tail_label", "score"), batch)
    texts = chunks.select("text").union(mentions.select(F.col("name").alias("text"))).distinct()
    fresh = tables.write("vectors", embed_missing(texts, cache, MODEL)[1], batch)
    ids = docs.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    again = tables.read("documents").select("doc_id").join(ids, "doc_id", "left_semi").distinct()
    again = None if again.isEmpty() else again
    vectors = fresh.select("key", "vector").union(cache).groupBy("key").agg(F.max("vector").alias("vector"))
    added = _added(tables, "mentions", ENTITY, batch, again).withColumn("key", content_key("name", F.lit(MODEL))).join(vectors, "key", "left")
    tables.entities().write(added.select(*ENTITY, "score", "vector", "n_chunks", "absolute"), 0, batch, batch)
    tables.relations().write(_added(tables, "facts", FACT, batch, again), 0, batch, batch)
    known = tables.names().current(tables.batches()).select("node", "root")
    new = mentions.select(*ENTITY).distinct().withColumn("node", F.concat_ws("\0", *ENTITY)).join(known.select("node"), "node", "left_anti")
    tables.names().write(join_components(known, pairs(new.select(*ENTITY)), connected_components).withColumn("absolute", F.lit(True)), 0, batch, batch)
    tables.write("documents", ids, batch)
    tables.fold()


def ingested_graph(tables: Tables) -> tuple[DataFrame, DataFrame]:
    """What all batches add up to: entities ``(id, name, label, score, n_chunks, vector)``, one per name and label, and relations ``(id, head_id, tail_id, type, score,
    n_chunks)``, merged from a few runs for any number of batches. The chunks of each stay in ``mentions`` and ``facts``; no row gathers them, so a name
    in every chunk is one small row."""
    done = tables.batches()
    e = tables.entities().current(done).filter("n_chunks > 0")
    entities = e.select(identity_id("Entity", "name", "label").alias("id"), "name", "label", "score", "n_chunks", "vector")
    ends = [identity_id("Entity", f"{x}_name", f"{x}_label").alias(f"{x}_id") for x in ("head", "tail")]
    r = tables.relations().current(done).filter("n_chunks > 0").select(*ends, "type", "score", "n_chunks").groupBy("head_id", "tail_id", "type").agg(F.max("score").alias("score"), F.sum("n_chunks").alias("n_chunks"))
    return entities, r.select(relation_id("head_id", "type", "tail_id").alias("id"), "head_id", "tail_id", "type", "score", "n_chunks")


def resolved_graph(tables: Tables) -> tuple[DataFrame, DataFrame]:
    """``ingested_graph`` with the names of a part as one entity, under its name of most chunks (the smallest of several): entities ``(id, name, label, score, mentions,
    n_names)``, where a chunk counts for each of the names it has, and relations between them."""
    entities, relations = ingested_graph(tables)
    roots = tables.names().current(tables.batches()).select("node", "root")
    e = entities.withColumn("node", F.concat_ws("\0", "name", "label")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    one = e.groupBy("root").agg(F.min(F.struct((-F.col("n_chunks")).alias("n"), "name", "label", "id")).alias("b"), F.max("score").alias("score"), F.sum("n_chunks").alias("mentions"), F.count("*").alias("n_names"))
    to = e.select(F.col("id").alias("old"), "root").join(one.select("root", F.col("b.id").alias("new")), "root").select("old", "new")
    end = lambda df, c: df.join(to, F.col(c) == F.col("old")).drop(c, "old").withColumnRenamed("new", c)
    r = end(end(relations, "head_id"), "tail_id").groupBy("head_id", "tail_id", "type").agg(F.max("score").alias("score"), F.sum("n_chunks").alias("n_chunks"))
    return one.select("b.id", "b.name", "b.label", "score", "mentions", "n_names"), r.select(relation_id("head_id", "type", "tail_id").alias("id"), "head_id", "tail_id", "type", "score", "n_chunks")


def ingest_stream(spark: SparkSession, source: str, schema, target: str, names: DataFrame, allowed: DataFrame, files_per_batch: int = 1) -> Tables:
    """Ingest every file of the folder ``source`` not yet ingested, then stop; progress is kept below ``target``, so a lost run goes on where it was."""
    tables = Tables(spark, f"{target}/tables")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def one(batch: DataFrame, number: int) -> None:
        ingest_batch(batch, tables, names, allowed, number)

    stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{target}/progress").trigger(availableNow=True).start().awaitTermination()
    return tables


def _stream(spark, d) -> Tables:
    """The documents in four files, streamed."""
    work = Scratch(spark, "ingest")
    docs = tg.table(spark, d, "documents").select("doc_id", "text")
    docs.repartition(4, "doc_id").write.parquet(f"{work.path}/incoming")
    return ingest_stream(spark, f"{work.path}/incoming", docs.schema, work.path, lexicon(spark), allowed_relations(spark))


_SEEN = f"WITH {LEXICON_SQL}, {CHUNKS_SQL}, {TAGS_SQL.replace('{src}', 'ch')}, {SCHEMA_SQL}"
_ENTITY_SQL = _SEEN + " SELECT t.name, t.label, max(lex.score)::DOUBLE AS score, count(DISTINCT chunk_id) AS n_chunks, 64 AS dims FROM t JOIN lex USING (name, label) GROUP BY 1, 2"
_FACT_SQL = _SEEN + " SELECT a.name AS head, s.type, b.name AS tail, round(max(1.0::DOUBLE / (b.f - a.f)), 9) AS score, count(DISTINCT a.chunk_id) AS n_chunks FROM t a JOIN t b ON a.chunk_id = b.chunk_id AND b.f > a.f AND b.f - a.f <= 20 JOIN s ON s.hl = a.label AND s.tl = b.label GROUP BY 1, 2, 3"


def _entities(tables: Tables) -> DataFrame:
    return ingested_graph(tables)[0].select("name", "label", "score", "n_chunks", F.size("vector").alias("dims"))


@query("I1_ingest_stream", _ENTITY_SQL)
def i1(spark, d):
    return _entities(_stream(spark, d))


@query("I1_ingest_relations", _FACT_SQL)
def i1_relations(spark, d):
    entities, relations = ingested_graph(_stream(spark, d))
    end = lambda x: entities.select(F.col("id").alias(f"{x}_id"), F.col("name").alias(x))
    return relations.join(end("head"), "head_id").join(end("tail"), "tail_id").select("head", "type", "tail", F.round("score", 9).alias("score"), "n_chunks")


@query("I1_resolved", _SEEN + " SELECT t.name, t.label, max(lex.score)::DOUBLE AS score, count(DISTINCT chunk_id) AS mentions, 1 AS n_names FROM t JOIN lex USING (name, label) GROUP BY 1, 2")
def i1_resolved(spark, d):
    """The stream's graph after resolution; no two of the lexicon's names have one normal form."""
    return resolved_graph(_stream(spark, d))[0].drop("id")


@query("I1_ingest_batch", _ENTITY_SQL)
def i1_batch(spark, d):
    tables = Tables(spark, Scratch(spark, "ingest").path)
    for _ in range(2):  # the second run finds the batch done
        ingest_batch(tg.table(spark, d, "documents").select("doc_id", "text"), tables, lexicon(spark), allowed_relations(spark), 0)
    return _entities(tables)


@query("I2_skip_done", "SELECT doc_id, sha256(doc_id||chr(0)||'x1') AS content_id FROM documents WHERE doc_id % 3 <> 0")
def i2(spark, d):
    docs = tg.table(spark, d, "documents").select("doc_id")
    ledger = docs.filter("doc_id % 3 = 0").select(content_key(F.col("doc_id").cast("string"), F.lit("x1")).alias("content_id"))
    return skip_done(docs, ledger, "x1", "doc_id")


@query("I3_extract_distinct", "SELECT doc_id AS chunk_id, length(text) AS n FROM documents")
def i3(spark, d):
    docs = tg.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return extract_distinct(docs, lambda c: c.select("chunk_id", F.length("text").cast("long").alias("n")))


@query("I4_isolate", "SELECT count(*) FILTER (doc_id % 10 <> 0) AS succeeded, count(*) FILTER (doc_id % 10 = 0) AS failed, 'partial' AS status FROM documents")
def i4(spark, d):
    docs = tg.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.expr("CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE '1' END").alias("text"))
    return isolate(docs, lambda t: str(int(t)))[2]


@query("I5_answer_keys", "SELECT o_orderkey, sha256(o_orderstatus||chr(0)||'p'||chr(0)||o_orderpriority||chr(0)||CASE WHEN o_orderkey % 2 = 0 THEN '*' ELSE '=a'||chr(31)||'b' END) AS key FROM orders")
def i5(spark, d):
    graphs = F.expr("CASE WHEN o_orderkey % 2 = 1 THEN array('b', 'a', 'b') END")
    return tg.table(spark, d, "orders").select("o_orderkey", answer_key(F.col("o_orderstatus"), F.lit("p"), F.col("o_orderpriority"), graphs).alias("key"))


_NODE_ID = duck_uuid5("'Entity:curie:'||trim(id)")


@query("I6_ingest_graph", f"WITH {tg.SQL} SELECT {_NODE_ID} AS id, name, 64 AS dims FROM nodes")
def i6(spark, d):
    nodes, edges = tg.nodes(spark, d), tg.edges(spark, d)
    e = nodes_to_entities(nodes.limit(0), "tg").withColumn("vector", F.lit(None).cast("array<float>"))
    r = edges_to_relations(edges.limit(0), nodes)
    cache = embed(nodes.filter("label = 'Nation'").select(F.col("name").alias("text"))).select(content_key("text", F.lit("m1")).alias("key"), "vector").dropDuplicates(["key"])
    entities, relations, _ = ingest_graph(nodes, edges, "tg", e, r, cache, "m1")
    return entities.select("id", "name", F.size("vector").alias("dims"))
