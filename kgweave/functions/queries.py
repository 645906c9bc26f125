"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgweave.functions.ids import content_key
from kgweave.functions.text import clean_answer, normalize_text, singularize
from kgweave.plans import testgraph as tg
from kgweave.plans.registry import query
from kgweave.sources.biomedical import LABELS


@query("F1_normalize", r"SELECT doc_id, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS mark FROM documents WHERE strlen(text) = length(text)")
def f1(spark, d):
    docs = tg.table(spark, d, "documents").filter(F.octet_length("text") == F.length("text"))
    return docs.select("doc_id", F.md5(normalize_text("text")).alias("mark"))


@query("F1_normalize_unicode")
def f1_unicode(spark, d):
    return tg.table(spark, d, "documents").select("doc_id", F.length(normalize_text("text")).alias("n"))


@query("F2_singularize", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'body' WHEN 1 THEN 'box' WHEN 2 THEN 'gene' ELSE 'virus' END AS name FROM part")
def f2(spark, d):
    return tg.table(spark, d, "part").select("p_partkey", singularize(F.expr("CASE p_partkey % 4 WHEN 0 THEN 'bodies' WHEN 1 THEN 'boxes' WHEN 2 THEN 'genes' ELSE 'virus' END")).alias("name"))


@query("F3_clean_answer", r"SELECT o_orderkey, o_orderpriority||' '||o_orderkey AS answer FROM orders")
def f3(spark, d):
    raw = F.concat(F.lit("<think>no\n"), "o_orderstatus", F.lit("</think> <Answer> "), "o_orderpriority", F.lit("\t \\boxed{"), "o_orderkey", F.lit("} </answer>"))
    return tg.table(spark, d, "orders").select("o_orderkey", clean_answer(raw).alias("answer"))


@query("F4_labels", "SELECT e.k, count(*) AS n FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 'Drug-Gene' ELSE 'Disease-Gene' END AS k FROM lineitem) e GROUP BY 1")
def f4(spark, d):
    m = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    k = F.when(F.col("l_returnflag") == "R", "DRG-GEN").otherwise("DIS-GEN")
    named = F.concat_ws("-", F.try_element_at(m, F.split(k, "-")[0]), F.try_element_at(m, F.split(k, "-")[1]))
    return tg.table(spark, d, "lineitem").groupBy(named.alias("k")).agg(F.count("*").alias("n"))


@query("F5_content_key", "SELECT doc_id, sha256(text||chr(0)||lang) AS key FROM documents")
def f5(spark, d):
    return tg.table(spark, d, "documents").select("doc_id", content_key("text", "lang").alias("key"))
