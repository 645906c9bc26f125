"""Grading of predictions: multiple choice, rubrics, reasoning traces, judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweave.functions.text import clean_answer
from kgweave.plans import testgraph as tg
from kgweave.plans.registry import query

#: What counts as an answer marker, and as a letter at the end (fixed patterns).
MARKER = r"(?i:\b(?:final\s+)?(?:answer|option|choice))\s*(?:is|:|=)?\s*[(\[]?([A-Z])\b"
FINAL = r"(?:^|\s)[(\[]?([A-Z])[)\].:]?\s*$"


def grade_mcq(samples: DataFrame, predictions: DataFrame, unicode: bool = True) -> DataFrame:
    """``(sample_id, correct, method, matched)`` for ``samples(sample_id, options array<struct<label,text>>, answer_key)``, one key each.

    After cleaning: the letter itself, the answer's text, the last marked letter, a letter at the end, else no match.
    """
    key = F.upper("answer_key")
    text = F.filter("options", lambda o: F.upper(o["label"]) == key)[0]["text"]
    d = samples.join(predictions, "sample_id").withColumn("_c", clean_answer(F.coalesce("prediction", F.lit("")), unicode)).withColumn("_k", key).withColumn("_t", F.lower(clean_answer(text, unicode)))
    marks = F.regexp_extract_all("_c", F.lit(MARKER), F.lit(1))
    mark, last = F.try_element_at(marks, F.lit(-1)), F.regexp_extract("_c", FINAL, 1)
    method = F.when(F.upper("_c") == F.col("_k"), "exact_letter").when(F.lower("_c") == F.col("_t"), "exact_answer_text").when(mark.isNotNull(), "answer_marker").when(last != "", "final_token").otherwise("no_match")
    d = d.withColumn("method", method)
    matched = F.when(F.col("method").isin("exact_letter", "exact_answer_text"), F.col("_k")).when(F.col("method") == "answer_marker", mark).when(F.col("method") == "final_token", last)
    return d.withColumn("matched", matched).select("sample_id", F.coalesce(F.col("matched") == F.col("_k"), F.lit(False)).alias("correct"), "method", "matched")


def grade_mcq_multi(samples: DataFrame, predictions: DataFrame, unicode: bool = True) -> DataFrame:
    """As ``grade_mcq`` for ``answer_keys array<string>``: the sets of letters must agree. Only the last letter counts unless the answer lists
    several (a comma, a semicolon or the word and)."""
    d = samples.join(predictions, "sample_id").withColumn("_c", clean_answer(F.coalesce("prediction", F.lit("")), unicode))
    letters = F.regexp_extract_all(F.upper("_c"), F.lit(r"\b([A-Z])\b"), F.lit(1))
    many = F.col("_c").contains(",") | F.col("_c").contains(";") | F.lower("_c").contains(" and ")
    got = F.when(many, F.array_sort(F.array_distinct(letters))).otherwise(F.slice(letters, F.greatest(F.size(letters), F.lit(1)), F.lit(1)))
    want = F.array_sort(F.array_distinct(F.transform("answer_keys", lambda k: F.upper(k))))
    return d.select("sample_id", (got == want).alias("correct"), F.lit("multi_answer_set").alias("method"), F.when(F.size(got) > 0, F.array_join(got, ",")).alias("matched"))


def rubric_score(rubrics: DataFrame, judgements: DataFrame) -> DataFrame:
    """``rubrics(sample_id, criterion_id, points)``, ``judgements(sample_id, criterion_id, met)`` -> points met by all positive points, within 0 and 1;
    0 without positive points; passed from 0.5."""
    j = rubrics.join(judgements, ["sample_id", "criterion_id"], "left")
    s = j.groupBy("sample_id").agg(F.sum(F.when(F.col("met"), F.col("points")).otherwise(0)).alias("got"), F.sum(F.greatest(F.col("points"), F.lit(0))).alias("all"))
    score = F.when(F.col("all") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("got") / F.col("all")))).otherwise(0.0)
    return s.select("sample_id", score.alias("score"), (score >= 0.5).alias("passed"))


def reasoning_items(traces: DataFrame, text: str = "trace") -> DataFrame:
    """Statements of a trace: its lines without bullets, blank ones left out."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*\u2022]|\d+[.)])\s+", ""))), lambda x: x != "")
    return traces.select("sample_id", F.posexplode(lines).alias("pos", "statement"))


def reasoning_recall(items: DataFrame, judgements: DataFrame, diagnosis: DataFrame) -> DataFrame:
    """Share of the statements that the judgements ``(sample_id, pos, matched)`` find, within 0 and 1; the flag ``diagnosis(sample_id, correct)`` decides."""
    j = items.join(judgements, ["sample_id", "pos"], "left").groupBy("sample_id").agg(F.avg(F.when(F.col("matched"), 1.0).otherwise(0.0)).alias("recall"))
    return j.join(diagnosis, "sample_id", "left").select("sample_id", F.least(F.lit(1.0), "recall").alias("recall"), F.coalesce("correct", F.lit(False)).alias("passed"))


def final_answer(x: Column | str) -> Column:
    """Text of the last answer tag, else the whole text, trimmed."""
    x = F.col(x) if isinstance(x, str) else x
    return F.trim(F.coalesce(F.try_element_at(F.regexp_extract_all(x, F.lit(r"(?is)<answer>(.*?)</answer>"), F.lit(1)), F.lit(-1)), x))


def binary_metric(judgements: DataFrame, name: str, contexts: list[str]) -> DataFrame:
    """Judged samples as a metric of 0 or 1; ``context`` is the first of the columns that isn't empty. No judgement is an error."""
    context = F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in contexts]) if contexts else F.lit(None).cast("string")
    return judgements.select("sample_id", F.lit(name).alias("metric"), F.when(F.col("verdict"), 1.0).otherwise(0.0).alias("score"), F.coalesce("verdict", F.lit(False)).alias("passed"), F.when(F.col("verdict").isNull(), "no judgement").alias("error"), context.alias("context"))


_KEY = "chr((65 + o_orderkey % 4)::INTEGER)"
_PRED = """CASE o_orderkey % 7 WHEN 0 THEN 'b' WHEN 1 THEN '<think>A?</think> <answer> C </answer>' WHEN 2 THEN 'The answer is D.' WHEN 3 THEN 'So, by A, it is (B)' WHEN 4 THEN o_orderpriority WHEN 5 THEN 'Final answer: A, then Option C' ELSE 'none of it' END"""
_C = """trim(regexp_replace(regexp_replace(regexp_replace(p, '(?is)<think>.*?</think>', ' ', 'g'), '(?is)<answer>\\s*(.*?)\\s*</answer>', '\\1', 'g'), '\\s+', ' ', 'g'))"""


@query("X1_grade_mcq", f"""WITH p AS (SELECT o_orderkey AS sample_id, {_KEY} AS k, lower(CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority ELSE 'text '||(o_orderkey % 4) END) AS t, {_PRED} AS p FROM orders), c AS (SELECT *, {_C} AS c FROM p),
 m AS (SELECT *, regexp_extract_all(c, '(?i:\\b(?:final\\s+)?(?:answer|option|choice))\\s*(?:is|:|=)?\\s*[(\\[]?([A-Z])\\b', 1) AS marks, regexp_extract(c, '(?:^|\\s)[(\\[]?([A-Z])[)\\].:]?\\s*$', 1) AS last FROM c),
 r AS (SELECT *, CASE WHEN upper(c) = k THEN 'exact_letter' WHEN lower(c) = t THEN 'exact_answer_text' WHEN len(marks) > 0 THEN 'answer_marker' WHEN last <> '' THEN 'final_token' ELSE 'no_match' END AS method FROM m)
 SELECT sample_id, method, CASE method WHEN 'exact_letter' THEN true WHEN 'exact_answer_text' THEN true WHEN 'answer_marker' THEN marks[-1] = k WHEN 'final_token' THEN last = k ELSE false END AS correct FROM r""")
def x1(spark, d):
    o = tg.table(spark, d, "orders")
    options = F.expr("transform(sequence(0, 3), i -> named_struct('label', chr(65 + i), 'text', CASE i WHEN 0 THEN o_orderpriority ELSE 'text ' || i END))")
    s = o.select(F.col("o_orderkey").alias("sample_id"), options.alias("options"), F.expr("chr(65 + o_orderkey % 4)").alias("answer_key"))
    return grade_mcq(s, o.select(F.col("o_orderkey").alias("sample_id"), F.expr(_PRED).alias("prediction")), unicode=False).select("sample_id", "method", "correct")


_MULTI = "CASE o_orderkey % 5 WHEN 0 THEN 'A, C' WHEN 1 THEN 'b and a' WHEN 2 THEN 'D' WHEN 3 THEN 'I say C;A' ELSE 'not known' END"


@query("X2_grade_multi", f"WITH p AS (SELECT o_orderkey AS sample_id, {_MULTI} AS p, CASE WHEN o_orderkey % 2 = 0 THEN ['A', 'C'] ELSE ['A', 'B'] END AS w FROM orders), l AS (SELECT *, regexp_extract_all(upper(p), '\\b([A-Z])\\b', 1) AS l FROM p), g AS (SELECT *, CASE WHEN contains(p, ',') OR contains(p, ';') OR contains(lower(p), ' and ') THEN list_sort(list_distinct(l)) ELSE l[-1:] END AS g FROM l) SELECT sample_id, g = w AS correct, CASE WHEN len(g) > 0 THEN array_to_string(g, ',') END AS matched FROM g")
def x2(spark, d):
    o = tg.table(spark, d, "orders")
    s = o.select(F.col("o_orderkey").alias("sample_id"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN array('c', 'a') ELSE array('B', 'A') END").alias("answer_keys"))
    return grade_mcq_multi(s, o.select(F.col("o_orderkey").alias("sample_id"), F.expr(_MULTI).alias("prediction")), unicode=False).drop("method")


@query("X3_rubric", "WITH r AS (SELECT l_orderkey AS sample_id, CASE WHEN l_linenumber % 3 = 0 THEN -2 ELSE l_linenumber END AS pts, l_returnflag = 'R' AS met FROM lineitem), s AS (SELECT sample_id, sum(CASE WHEN met THEN pts ELSE 0 END) AS got, sum(greatest(pts, 0)) AS tot FROM r GROUP BY 1) SELECT sample_id, round(CASE WHEN tot > 0 THEN least(1.0, greatest(0.0, got / tot::DOUBLE)) ELSE 0 END, 6) AS score, CASE WHEN tot > 0 THEN least(1.0, greatest(0.0, got / tot::DOUBLE)) ELSE 0 END >= 0.5 AS passed FROM s")
def x3(spark, d):
    x = tg.table(spark, d, "lineitem").withColumn("criterion_id", F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_tax", "l_discount", "l_quantity"))
    r = x.select(F.col("l_orderkey").alias("sample_id"), "criterion_id", F.expr("CASE WHEN l_linenumber % 3 = 0 THEN -2 ELSE l_linenumber END").alias("points"))
    j = x.select(F.col("l_orderkey").alias("sample_id"), "criterion_id", (F.col("l_returnflag") == "R").alias("met"))
    return rubric_score(r, j).withColumn("score", F.round("score", 6))


@query("X4_reasoning", "WITH i AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS s FROM documents) SELECT doc_id AS sample_id, round(avg(CASE WHEN length(s) % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall, doc_id % 2 = 0 AS passed FROM i GROUP BY 1, 3")
def x4(spark, d):
    docs = tg.table(spark, d, "documents")
    plain = docs.select(F.col("doc_id").alias("sample_id"), F.split("text", "\n").alias("l")).select("sample_id", F.posexplode(F.filter(F.transform("l", lambda x: F.trim(x)), lambda x: x != "")).alias("pos", "statement"))
    return reasoning_recall(plain, plain.select("sample_id", "pos", (F.length("statement") % 2 == 0).alias("matched")), docs.select(F.col("doc_id").alias("sample_id"), (F.col("doc_id") % 2 == 0).alias("correct"))).withColumn("recall", F.round("recall", 6))


@query("X5_binary", "SELECT l.doc_id AS sample_id, CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0 END AS score, coalesce(quality = 1, false) AS passed, coalesce(nullif(trim(source), ''), lang) AS context FROM labels l JOIN documents USING (doc_id)")
def x5(spark, d):
    j = tg.table(spark, d, "labels").join(tg.table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id").select(F.col("doc_id").alias("sample_id"), (F.col("quality") == 1).alias("verdict"), "source", "lang")
    return binary_metric(j, "answer_equivalence", ["source", "lang"]).select("sample_id", "score", "passed", "context")
