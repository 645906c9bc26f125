"""Chunking, tokens, entity tagging, relation proposal and embedding."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgweave.functions.ids import content_key, duck_uuid5, identity_id
from kgweave.operators.merge import combine_extractions, link_endpoints, normalize_extractions
from kgweave.plans import testgraph as tg
from kgweave.plans.registry import query
from kgweave.plans.scratch import Scratch

SEPARATORS = ("\n\n", "\n", " ", "")
SLOT = 256


def recursive_spans(text: str, size: int = 4000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """Spans of at most ``size`` characters, cut at the coarsest separator that helps; a separator stays at the front
    of what follows it. Neighbouring spans share whole pieces of at most ``overlap`` characters."""

    def pieces(a: int, z: int, sep: str) -> list[tuple[int, int]]:
        if sep == "":
            return [(i, i + 1) for i in range(a, z)]
        cuts, at = [a], text.find(sep, a + (text.startswith(sep, a) and len(sep)), z)
        while at >= 0:
            cuts.append(at)
            at = text.find(sep, at + len(sep), z)
        return [(x, y) for x, y in zip(cuts, [*cuts[1:], z]) if x < y]

    def merge(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out, lo = [], 0
        for i, (_, end) in enumerate(parts):
            if end - parts[lo][0] > size and i > lo:
                out.append((parts[lo][0], parts[i - 1][1]))
                while lo < i and (parts[i - 1][1] - parts[lo][0] > overlap or end - parts[lo][0] > size):
                    lo += 1
        return out + [(parts[lo][0], parts[-1][1])] if parts else out

    def split(a: int, z: int, seps: tuple[str, ...]) -> list[tuple[int, int]]:
        k = next((i for i, s in enumerate(seps) if s == "" or text.find(s, a, z) >= 0), len(seps) - 1)
        out, run = [], []
        for x, y in pieces(a, z, seps[k]):
            if y - x <= size or not seps[k + 1 :]:
                run.append((x, y))
                continue
            out += merge(run)
            run = []
            out += split(x, y, seps[k + 1 :])
        return out + merge(run)

    return split(0, len(text), separators)


def chunk_documents(docs: DataFrame, size: int = 4000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS, strip: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, chunk_index, chunk_id, text, start_index, chunk_size)``; blank chunks are left out."""

    def run(frames):
        for f in frames:
            out = []
            for d, t in zip(f["doc_id"], f["text"]):
                i = 0
                for a, z in recursive_spans(t or "", size, overlap, separators):
                    s = t[a:z]
                    if strip:
                        a += len(s) - len(s.lstrip())
                        s = s.strip()
                    if s:
                        out.append((d, i, s, a))
                        i += 1
            yield pd.DataFrame(out, columns=["doc_id", "chunk_index", "text", "start_index"])

    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, "doc_id string, chunk_index int, text string, start_index int")
    return rows.select("doc_id", "chunk_index", identity_id("Chunk", "doc_id", "chunk_index").alias("chunk_id"), "text", "start_index", F.length("text").alias("chunk_size"))


def chunk_fixed(docs: DataFrame, size: int = 4000, overlap: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows of ``size`` characters, each ``overlap`` into the one before."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - overlap) / step).cast("int") - 1)
    rows = docs.filter(F.length(text) > 0).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    return rows.select("doc_id", "chunk_index", F.substring(F.col("_t"), F.col("chunk_index") * step + 1, F.lit(size)).alias("text"))


def link_next_chunk(chunks: DataFrame, doc: str = "doc_id", index: str = "chunk_index", key: str = "chunk_id") -> DataFrame:
    """``(src, dst)`` of consecutive chunks of a document."""
    return chunks.select(F.col(key).alias("src"), F.lead(key).over(W.partitionBy(doc).orderBy(index)).alias("dst")).filter("dst is not null")


def tokenize_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, pos, token, start, end)`` of the runs of characters that aren't white space."""
    toks, gaps = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), F.regexp_extract_all(text, F.lit(r"\s+"), F.lit(0))
    blank_first = F.col(text).rlike(r"^\s")
    lead = F.when(blank_first, F.length(gaps[0])).otherwise(0)
    after = F.when(blank_first, F.slice(gaps, F.lit(2), F.size(gaps))).otherwise(gaps)
    pairs = F.zip_with(toks, after, lambda t, g: F.struct(t.alias("t"), F.coalesce(F.length(g), F.lit(0)).alias("g")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), lead.alias("_lead"), F.posexplode(pairs).alias("pos", "_p"))
    before = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("_lead") + F.coalesce(F.sum(F.length("_p.t") + F.col("_p.g")).over(before), F.lit(0))
    return rows.select("doc_id", "pos", F.col("_p.t").alias("token"), start.cast("long").alias("start")).withColumn("end", F.col("start") + F.length("token"))


def char_to_token_spans(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """``spans(doc_id, span_id, start, end)`` -> first and last token that overlap each. Both sides are cut into slots of ``SLOT``
    characters, so a span meets the tokens near it alone."""
    slots = lambda a, z: F.explode(F.sequence(F.floor(F.col(a) / SLOT), F.floor((F.greatest(a, F.col(z) - 1)) / SLOT))).alias("_slot")
    t = tokens.select("doc_id", "pos", F.col("start").alias("_a"), F.col("end").alias("_z"), slots("start", "end"))
    hit = spans.select("doc_id", "span_id", "start", "end", slots("start", "end")).join(t, ["doc_id", "_slot"]).filter((F.col("_a") < F.col("end")) & (F.col("_z") > F.col("start")))
    return hit.groupBy("doc_id", "span_id").agg(F.min("pos").alias("first_token"), F.max("pos").alias("last_token"))


def tag_entities(chunks: DataFrame, lexicon: DataFrame, max_words: int = 3, threshold: float = 0.5, key: str = "chunk_id") -> DataFrame:
    """Lexicon matches ``(chunk_id, name, label, score, first, last)`` by word position; ``lexicon(name, label, score)``.

    Names are runs of lower-case words without punctuation at their ends, of at most ``max_words``. A match gives way to an
    overlapping longer one, and to an equally long one that starts earlier. Texts are tagged whole.
    """
    # a blank at either end is cut before the split, so positions count words
    words = F.transform(F.filter(F.split("text", r"\s+"), lambda w: w != ""), lambda w: F.regexp_replace(F.lower(w), r"^[^a-z0-9]+|[^a-z0-9]+$", ""))
    # texts are read once: a row for each word, which names that begin with it meet; the words after it go along for these to be compared with
    after = F.arrays_zip(F.col("w").alias("0"), *(F.slice(F.col("w"), i + 1, F.greatest(F.size("w") - i, F.lit(0))).alias(str(i)) for i in range(1, max_words)))
    rows = chunks.select(key, words.alias("w")).select(key, F.posexplode(after).alias("first", "r")).select(key, "first", *(F.col("r").getField(str(i)).alias(f"_{i}") for i in range(max_words)))
    parts = F.split("name", " ")
    names = lexicon.filter((F.col("score") >= threshold) & (F.size(parts) <= max_words)).select("name", "label", "score", F.size(parts).alias("n"), parts[0].alias("_0"))
    names = names.groupBy("_0").agg(F.collect_list(F.struct("name", "label", "score", "n")).alias("_names"))
    found = rows.join(names, "_0").select("*", F.inline("_names"))
    told = [F.when(F.col("n") == n, F.concat("_0", *(x for i in range(1, n) for x in (F.lit(" "), F.col(f"_{i}")))) == F.col("name")) for n in range(1, max_words + 1)]
    hits = found.filter(F.coalesce(*told, F.lit(False))).select(key, "name", "label", "score", "first", (F.col("first") + F.col("n") - 1).alias("last"), "n")
    # matches that overlap begin less than the longest name's words apart
    near = W.partitionBy(key).orderBy("first").rangeBetween(1 - max_words, max_words - 1)
    hits = hits.withColumn("_near", F.collect_list(F.struct("first", "last", "n")).over(near))
    beaten = F.exists("_near", lambda o: (o["first"] <= F.col("last")) & (o["last"] >= F.col("first")) & ((o["n"] > F.col("n")) | (o["n"] == F.col("n")) & (o["first"] < F.col("first"))))
    return hits.filter(~beaten).select(key, "name", "label", "score", "first", "last")


def propose_relations(entities: DataFrame, allowed: DataFrame, reach: int = 20, key: str = "chunk_id") -> DataFrame:
    """Pairs of tagged entities of one chunk within ``reach`` words, typed by ``allowed(head_label, type, tail_label)``;
    the score falls with the distance."""
    near = W.partitionBy(key).orderBy("first").rangeBetween(1, reach)
    heads = entities.select(key, "name", "label", F.col("first").cast("long").alias("first"))
    heads = heads.withColumn("_tails", F.collect_list(F.struct(F.col("name").alias("tail_name"), F.col("label").alias("tail_label"), F.col("first").alias("_b"))).over(near))
    pairs = heads.select(key, F.col("name").alias("head_name"), F.col("label").alias("head_label"), F.col("first").alias("_a"), F.inline("_tails"))
    return pairs.join(allowed, ["head_label", "tail_label"]).select(key, "head_name", "head_label", "type", "tail_name", "tail_label", (1 / (F.col("_b") - F.col("_a"))).alias("score"), F.col("_a").alias("ord"))


MODEL_OUTPUT = "struct<entities:array<struct<name:string,label:string,score:double>>,relations:array<struct<head:string,type:string,tail:string,score:double>>>"


def flatten_model_output(responses: DataFrame, labels: list[str], types: list[str], key: str = "chunk_id", col: str = "response") -> tuple[DataFrame, DataFrame, DataFrame]:
    """JSON answers -> (entities, relations, bad rows). Unknown labels and types are dropped, as are relations whose ends
    the answer doesn't list as entities."""
    r = responses.withColumn("_r", F.from_json(F.col(col), MODEL_OUTPUT, {"mode": "PERMISSIVE"}))
    bad = r.filter("_r is null or (_r.entities is null and _r.relations is null)").select(key, col)
    e = r.select(key, F.posexplode("_r.entities").alias("ord", "e")).select(key, "ord", "e.*").filter(F.col("label").isin(labels) & F.col("name").isNotNull())
    known = e.select(key, "name").distinct()
    rel = r.select(key, F.posexplode("_r.relations").alias("ord", "x")).select(key, "ord", "x.*").filter(F.col("type").isin(types))
    rel = rel.join(known.withColumnRenamed("name", "head"), [key, "head"], "left_semi").join(known.withColumnRenamed("name", "tail"), [key, "tail"], "left_semi")
    return e, rel, bad


def extract_graph(chunks: DataFrame, lexicon: DataFrame, allowed: DataFrame, others: list[tuple[DataFrame, DataFrame]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Tag, propose, merge per chunk, link the ends: entities and relations of all chunks. ``others`` are raw entities and relations of
    further extractors (``models.extract_with``), which are merged with those of the lexicon."""
    tagged = Scratch(chunks.sparkSession, "tagged").write(tag_entities(chunks, lexicon), "mentions")
    ents = tagged.select("chunk_id", F.col("first").alias("ord"), F.lit("lexicon").alias("extractor"), "name", "label", "score")
    rels = propose_relations(tagged, allowed).select("chunk_id", "ord", F.lit("lexicon").alias("extractor"), "head_name", "tail_name", "type", "score")
    for e, r in others or []:
        ents, rels = ents.unionByName(e), rels.unionByName(r)
    ents, rels = normalize_extractions(ents, combine_extractions(rels, ["chunk_id", "head_name", "tail_name", "type"]), unicode=False)
    nodes = ents.select(identity_id("Entity", "name", "label").alias("id"), "name", "label").distinct()
    return nodes, link_endpoints(nodes, rels, unicode=False)


def hashed_embedding(texts: pd.Series, dims: int = 64) -> pd.Series:
    """Default embedder: counts of hashed character trigrams, normalised."""

    def one(t: str | None):
        if t is None:
            return None
        b = f"  {t.lower()}  ".encode()
        v = np.bincount([zlib.crc32(b[i : i + 3]) % dims for i in range(len(b) - 2)], minlength=dims).astype(np.float32)
        n = np.linalg.norm(v)
        return (v / n if n else v).tolist()

    return texts.map(one)


def embed(df: DataFrame, text: str = "text", out: str = "vector", embedder: Callable[[pd.Series], pd.Series] = hashed_embedding) -> DataFrame:
    def run(x: pd.Series) -> pd.Series:
        return embedder(x)

    return df.withColumn(out, F.pandas_udf(run, "array<float>")(F.col(text)))


def embed_missing(df: DataFrame, cache: DataFrame, model: str, text: str = "text", embedder: Callable[[pd.Series], pd.Series] = hashed_embedding) -> tuple[DataFrame, DataFrame]:
    """Each distinct text not in ``cache(key, vector)`` is embedded once: (rows with vectors, new cache rows)."""
    keyed = df.withColumn("_key", content_key(text, F.lit(model)))
    new = keyed.filter("_key is not null").groupBy("_key").agg(F.min(text).alias("text")).join(cache.select(F.col("key").alias("_key")), "_key", "left_anti")
    fresh = embed(new, "text", "vector", embedder).select(F.col("_key").alias("key"), "vector")
    every = cache.select("key", "vector").unionByName(fresh)
    return keyed.join(every.withColumnRenamed("key", "_key"), "_key", "left").drop("_key"), fresh


def _docs(spark, d):
    return tg.table(spark, d, "documents")


@query("T1_chunk_recursive")
def t1(spark, d):
    return chunk_documents(_docs(spark, d), 1000, 100).drop("text")


@query("T2_chunk_fixed", "SELECT doc_id, i::INTEGER AS chunk_index, substr(text, (i * 900 + 1)::INTEGER, 1000) AS text FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(0, ceil((length(text) - 100) / 900.0)::INTEGER - 1))) AS i FROM documents WHERE length(text) > 0)")
def t2(spark, d):
    return chunk_fixed(_docs(spark, d), 1000, 100)


@query("T3_next_chunk", "SELECT doc_id||'-'||i AS src, doc_id||'-'||(i + 1) AS dst FROM (SELECT doc_id, length(text) AS n, unnest(generate_series(0, greatest(0, ceil((length(text) - 100) / 900.0)::INTEGER - 1))) AS i FROM documents WHERE length(text) > 0) WHERE i < greatest(0, ceil((n - 100) / 900.0)::INTEGER - 1)")
def t3(spark, d):
    return link_next_chunk(chunk_fixed(_docs(spark, d), 1000, 100).withColumn("chunk_id", F.concat("doc_id", F.lit("-"), "chunk_index")))


@query("T4_token_spans", r"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '\S+') AS k, regexp_extract_all(text, '\s+') AS g, CASE WHEN regexp_matches(text, '^\s') THEN 1 ELSE 0 END AS s FROM documents),
 u AS (SELECT doc_id, unnest(generate_series(1, len(k)::BIGINT)) AS i, k, g, s FROM t), o AS (SELECT doc_id, i, k[i] AS token, CASE WHEN s = 1 THEN length(g[1]) ELSE 0 END AS lead, length(k[i]) + coalesce(length(g[i + s]), 0) AS own FROM u)
 SELECT doc_id, count(*) AS n, max(st + length(token)) AS last_end, sum(st * (i % 7)) AS mark FROM (SELECT *, lead + coalesce(sum(own) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM o) GROUP BY 1""".replace("sum(st * (i % 7)) AS mark", "CAST(sum(st * (i % 7)) AS BIGINT) AS mark").replace("max(st + length(token)) AS last_end", "CAST(max(st + length(token)) AS BIGINT) AS last_end"))
def t4(spark, d):
    t = tokenize_spans(_docs(spark, d))
    return t.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("end").alias("last_end"), F.sum(F.col("start") * ((F.col("pos") + 1) % 7)).cast("long").alias("mark"))


LEXICON_SQL = "lex AS (SELECT * FROM (VALUES ('of the', 'PHRASE', 0.9), ('the', 'DET', 0.8), ('and', 'CONJ', 0.8), ('that', 'PRON', 0.3), ('in the', 'PHRASE', 0.9)) v(name, label, score))"


def lexicon(spark) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('of the', 'PHRASE', 0.9D), ('the', 'DET', 0.8D), ('and', 'CONJ', 0.8D), ('that', 'PRON', 0.3D), ('in the', 'PHRASE', 0.9D) AS v(name, label, score)")


#: Tagged entities ``t(chunk_id, f, n, l, name, label)`` of the chunks ``src(chunk_id, text)``.
TAGS_SQL = r"""w AS (SELECT chunk_id, list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), lambda x: regexp_replace(lower(x), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')) AS w FROM {src}),
 p AS (SELECT chunk_id, w, unnest(generate_series(1, len(w)::BIGINT)) AS i FROM w), g AS (SELECT chunk_id, i - 1 AS f, 1 AS n, w[i] AS name FROM p UNION ALL SELECT chunk_id, i - 1, 2, w[i]||' '||w[i + 1] FROM p WHERE i < len(w)),
 h AS (SELECT chunk_id, f, n, f + n - 1 AS l, name, label FROM g JOIN lex USING (name) WHERE score >= 0.5), t AS (SELECT * FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE a.chunk_id = b.chunk_id AND b.f <= a.l AND b.l >= a.f AND (b.n > a.n OR b.n = a.n AND b.f < a.f)))"""


_DOC_TAGS = TAGS_SQL.replace("{src}", "(SELECT doc_id AS chunk_id, text FROM documents)")
#: Fixed windows of 1,000 characters that overlap by 100, as chunks.
CHUNKS_SQL = "ch AS (SELECT doc_id||'-'||i AS chunk_id, doc_id, substr(text, (i * 900 + 1)::INTEGER, 1000) AS text FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(0, ceil((length(text) - 100) / 900.0)::INTEGER - 1))) AS i FROM documents WHERE length(text) > 0))"
SCHEMA_SQL = "s AS (SELECT * FROM (VALUES ('DET', 'BEFORE', 'CONJ'), ('PHRASE', 'NEAR', 'DET')) v(hl, type, tl))"


def fixed_chunks(docs: DataFrame) -> DataFrame:
    """``(chunk_id, doc_id, text)`` of the windows that the queries here and their SQL share."""
    return chunk_fixed(docs, 1000, 100).select(F.concat("doc_id", F.lit("-"), "chunk_index").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), "text")


@query("T5_tag_entities", f"WITH {LEXICON_SQL}, {_DOC_TAGS} SELECT chunk_id, name, label, f AS first FROM t")
def t5(spark, d):
    return tag_entities(_docs(spark, d).select(F.col("doc_id").alias("chunk_id"), "text"), lexicon(spark)).select("chunk_id", "name", "label", F.col("first").cast("long").alias("first"))


def allowed_relations(spark) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('DET', 'BEFORE', 'CONJ'), ('PHRASE', 'NEAR', 'DET') AS v(head_label, type, tail_label)")


@query("T6_propose", f"WITH {LEXICON_SQL}, {_DOC_TAGS}, s AS (SELECT * FROM (VALUES ('DET', 'BEFORE', 'CONJ'), ('PHRASE', 'NEAR', 'DET')) v(hl, type, tl)) SELECT a.chunk_id, a.name AS head_name, s.type, b.name AS tail_name, 1.0::DOUBLE / (b.f - a.f) AS score FROM t a JOIN t b ON a.chunk_id = b.chunk_id AND b.f > a.f AND b.f - a.f <= 20 JOIN s ON hl = a.label AND tl = b.label")
def t6(spark, d):
    tagged = tag_entities(_docs(spark, d).select(F.col("doc_id").alias("chunk_id"), "text"), lexicon(spark))
    return propose_relations(tagged, allowed_relations(spark)).select("chunk_id", "head_name", "type", "tail_name", "score")


_ANSWER = """CASE WHEN o_orderkey % 9 = 0 THEN 'no json' ELSE '{"entities":[{"name":"' || o_orderpriority || '","label":"' || o_orderstatus || '","score":0.5},{"name":"other","label":"O","score":1.0}],"relations":[{"head":"other","type":"R","tail":"' || o_orderpriority || '","score":0.25}]}' END"""


@query("T7_model_output", "SELECT o_orderkey AS chunk_id, 'other' AS head, 'R' AS type, o_orderpriority AS tail FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderstatus IN ('O', 'F')")
def t7(spark, d):
    r = tg.table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.expr(_ANSWER).alias("response"))
    return flatten_model_output(r, ["O", "F"], ["R"])[1].select("chunk_id", "head", "type", "tail")


_T8 = f"""WITH {LEXICON_SQL}, {CHUNKS_SQL}, {TAGS_SQL.replace("{src}", "ch")}, {SCHEMA_SQL}, r AS (SELECT DISTINCT a.chunk_id, a.name AS h, a.label AS hl, s.type, b.name AS t, b.label AS tl, max(1.0::DOUBLE / (b.f - a.f)) AS score
 FROM t a JOIN t b ON a.chunk_id = b.chunk_id AND b.f > a.f AND b.f - a.f <= 20 JOIN s ON s.hl = a.label AND s.tl = b.label GROUP BY ALL),
 e AS (SELECT *, {duck_uuid5("'Entity:'||replace(h, ' ', '_')||'|'||lower(hl)")} AS head_id, {duck_uuid5("'Entity:'||replace(t, ' ', '_')||'|'||lower(tl)")} AS tail_id FROM r)
 SELECT chunk_id, head_id, tail_id, type, round(score, 9) AS score, {duck_uuid5("'Relation:'||head_id||'|'||type||'|'||tail_id")} AS id FROM e"""


@query("T8_extract_graph", _T8)
def t8(spark, d):
    out = extract_graph(fixed_chunks(_docs(spark, d)).select("chunk_id", "text"), lexicon(spark), allowed_relations(spark))[1]
    return out.select("chunk_id", "id", "head_id", "tail_id", "type", F.round("score", 9).alias("score"))


@query("T9_embed", "SELECT doc_id, 64 AS dims, 1.0::DOUBLE AS norm FROM documents")
def t9(spark, d):
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return embed(_docs(spark, d)).select("doc_id", F.size("vector").alias("dims"), F.round(norm, 5).alias("norm"))


@query("T10_missing_keys", "WITH k AS (SELECT sha256(text||chr(0)||'m1') AS key, doc_id FROM documents) SELECT key, min(doc_id) AS doc_id, count(*) AS n FROM k WHERE key NOT IN (SELECT key FROM k WHERE doc_id % 4 = 0) GROUP BY 1")
def t10(spark, d):
    k = _docs(spark, d).select(content_key("text", F.lit("m1")).alias("key"), "doc_id")
    return k.join(k.filter("doc_id % 4 = 0").select("key").distinct(), "key", "left_anti").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("T10_embed_missing", "SELECT doc_id, 64 AS dims FROM documents")
def t10_embed(spark, d):
    docs = _docs(spark, d).select("doc_id", "text")
    cache = embed(docs.filter("doc_id % 4 = 0")).select(content_key("text", F.lit("m1")).alias("key"), "vector").dropDuplicates(["key"])
    return embed_missing(docs, cache, "m1")[0].select("doc_id", F.size("vector").alias("dims"))
