"""Slots for models: extractors of chunks and vectors of relations."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.functions.ids import duck_uuid5
from kgweave.operators.chunks import _T8, allowed_relations, embed, extract_graph, fixed_chunks, flatten_model_output, hashed_embedding, lexicon
from kgweave.plans import testgraph as tg
from kgweave.plans.registry import query
from kgweave.plans.scratch import Scratch

Batches = Iterator[pd.DataFrame]


def extract_with(chunks: DataFrame, extractor: Callable[[Batches], Batches], labels: list[str], types: list[str], name: str = "model") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, bad rows) of ``chunks(chunk_id, text)`` as ``normalize_extractions`` and ``extract_graph(others=)`` take them.

    ``extractor`` is a ``mapInPandas`` function from batches ``(chunk_id, text)`` to batches ``(chunk_id, response)`` with JSON answers, so it may
    load its model once a task and answer in batches. Answers are written once, since entities, relations and bad rows all read them.
    """
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    answers = chunks.select("chunk_id", "text").mapInPandas(extractor, f"chunk_id {kind}, response string")
    e, r, bad = flatten_model_output(Scratch(chunks.sparkSession, "answers").write(answers, "answers"), labels, types)
    e = e.select("chunk_id", "ord", F.lit(name).alias("extractor"), "name", "label", "score")
    r = r.select("chunk_id", "ord", F.lit(name).alias("extractor"), F.col("head").alias("head_name"), F.col("tail").alias("tail_name"), "type", "score")
    return e, r, bad


def relation_texts(relations: DataFrame, representations: tuple[str, ...] = ("fact",)) -> DataFrame:
    """``(id, representation, text)`` of ``relations(id, head_name, type, tail_name)``, with ``description`` if there is one.

    ``fact``: the description, or where it is null or empty the whole statement; ``type``: the predicate; ``spo``: the whole statement.
    """
    spo = F.concat_ws(" ", "head_name", "type", "tail_name")
    fact = F.coalesce(F.nullif(F.col("description"), F.lit("")), spo) if "description" in relations.columns else spo
    texts = {"fact": fact, "type": F.col("type"), "spo": spo}
    unknown = set(representations) - set(texts)
    if unknown:
        raise ValueError(f"no representation {sorted(unknown)}")
    each = F.array(*[F.struct(F.lit(k).alias("representation"), texts[k].alias("text")) for k in representations])
    return relations.select("id", F.inline(each))


def embed_relations(relations: DataFrame, representations: tuple[str, ...] = ("fact",), embedder: Callable[[pd.Series], pd.Series] = hashed_embedding) -> DataFrame:
    """``(id, representation, text, vector)``: each relation in each representation, all under its id. A predicate is embedded once, not once a
    relation; a null text has a null vector."""
    texts = relation_texts(relations, representations)
    if "type" not in representations:
        return embed(texts, "text", "vector", embedder)
    kinds = texts.filter("representation = 'type'")
    vectors = embed(kinds.select("text").filter("text is not null").distinct(), "text", "vector", embedder)
    kinds = kinds.join(vectors, "text", "left").select("id", "representation", "text", "vector")
    others = tuple(r for r in representations if r != "type")
    return embed(texts.filter(F.col("representation").isin(*others)), "text", "vector", embedder).unionByName(kinds) if others else kinds


def _long_words(batches: Batches) -> Batches:
    """An extractor: runs of ten or more small letters are entities, each run is followed by the next."""
    for f in batches:
        answers = []
        for text in f["text"]:
            w = re.findall("[a-z]{10,}", text or "")
            entities = [{"name": x, "label": "LONG", "score": 0.75} for x in dict.fromkeys(w)]
            relations = [{"head": a, "type": "NEXT", "tail": b, "score": 0.5} for a, b in dict.fromkeys(zip(w, w[1:]))]
            answers.append(json.dumps({"entities": entities, "relations": relations}))
        yield pd.DataFrame({"chunk_id": f["chunk_id"], "response": answers})


_LONG = f"""n AS (SELECT DISTINCT chunk_id, k[i] AS h, k[i + 1] AS t FROM (SELECT chunk_id, k, unnest(generate_series(1, len(k)::BIGINT - 1)) AS i FROM (SELECT chunk_id, regexp_extract_all(text, '[a-z]{{10,}}') AS k FROM ch))),
 ne AS (SELECT chunk_id, {duck_uuid5("'Entity:'||h||'|long'")} AS head_id, {duck_uuid5("'Entity:'||t||'|long'")} AS tail_id FROM n)"""


@query("T8_extract_model", _T8.replace("\n SELECT chunk_id", f", {_LONG}\n SELECT chunk_id") + f" UNION ALL SELECT chunk_id, head_id, tail_id, 'NEXT', 0.5, {duck_uuid5("'Relation:'||head_id||'|NEXT|'||tail_id")} FROM ne")
def t8_model(spark, d):
    """The graph of the lexicon and of an extractor's answers together."""
    chunks = fixed_chunks(tg.table(spark, d, "documents")).select("chunk_id", "text")
    found = extract_with(chunks, _long_words, ["LONG"], ["NEXT"])[:2]
    out = extract_graph(chunks, lexicon(spark), allowed_relations(spark), others=[found])[1]
    return out.select("chunk_id", "id", "head_id", "tail_id", "type", F.round("score", 9).alias("score"))


@query("T9_embed_relations", """WITH r AS (SELECT 'CUS:'||c_custkey AS id, c_name||' LOCATED_IN '||n_name AS spo, CASE WHEN c_custkey % 3 = 0 THEN c_name||' lives in '||n_name END AS d FROM customer JOIN nation ON c_nationkey = n_nationkey)
 SELECT id, 'fact' AS representation, coalesce(d, spo) AS text, 64 AS dims FROM r UNION ALL SELECT id, 'type', 'LOCATED_IN', 64 FROM r UNION ALL SELECT id, 'spo', spo, 64 FROM r""")
def t9_relations(spark, d):
    c = tg.table(spark, d, "customer").join(tg.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    told = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(" lives in "), "n_name")).when(F.col("c_custkey") % 3 == 1, F.lit(""))
    r = c.select(F.concat(F.lit("CUS:"), "c_custkey").alias("id"), F.col("c_name").alias("head_name"), F.lit("LOCATED_IN").alias("type"), F.col("n_name").alias("tail_name"), told.alias("description"))
    return embed_relations(r, ("fact", "type", "spo")).select("id", "representation", "text", F.size("vector").alias("dims"))
