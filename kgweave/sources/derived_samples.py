"""Queries of the benchmark mappings: orders and their line items in the raw layouts of the published benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.plans import testgraph as tg
from kgweave.plans.registry import query
from kgweave.sources import benchmarks as bm


def _orders(spark, d, *cols: str) -> DataFrame:
    """Rows of ``orders`` with ``k``, its key, as ``row_id``."""
    return tg.table(spark, d, "orders").selectExpr("o_orderkey AS row_id", "o_orderkey AS k", "o_custkey AS c", "o_orderstatus AS s", "o_orderpriority AS p").selectExpr("row_id", *cols)


#: The same columns for the SQL.
_O = "o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_orderpriority AS p FROM orders)"


def _flat(samples: DataFrame, *meta: str) -> DataFrame:
    options = F.array_join(F.transform("options", lambda o: F.concat_ws("=", o["label"], o["text"])), "|")
    return samples.select("sample_id", "question_stem", options.alias("options"), F.array_join("answer_keys", ",").alias("keys"), "is_multi", *[F.col("metadata")[m].alias(m) for m in meta])


def _sql(where: str = "true", sample: str = "k::VARCHAR", stem: str = "p", options: str = "'A=w'||k||'|B='||s||'|C=|D=z'", keys: str = "chr((65 + k % 4)::INTEGER)", multi: str = "false", **meta: str) -> str:
    more = "".join(f", {v} AS {m}" for m, v in meta.items())
    return f"WITH {_O} SELECT {sample} AS sample_id, {stem} AS question_stem, {options} AS options, {keys} AS keys, {multi} AS is_multi{more} FROM o WHERE {where}"


_TEXTS = "'w' || k", "s", "cast(null AS string)", "'z'"


@query("Q3_careqa", _sql("k % 6 BETWEEN 1 AND 4", keys="chr((64 + k % 6)::INTEGER)", subject="s"))
def q3(spark, d):
    raw = _orders(spark, d, "k AS id", "' ' || p || ' ' AS question", *[f"{t} AS op{i + 1}" for i, t in enumerate(_TEXTS)], "cast(k % 6 AS int) AS cop", "s AS subject")
    return _flat(bm.careqa(raw), "subject")


@query("Q4_medmcqa", _sql("k % 5 < 4 AND k % 7 <> 0", keys="chr((65 + k % 5)::INTEGER)", subject="s", topic="p", choice_type="'single'", explanation="'e'||k"))
def q4(spark, d):
    texts = [f"CASE WHEN k % 7 <> 0 THEN {t} END AS op{x}" for t, x in zip(_TEXTS, "abcd")]
    raw = _orders(spark, d, "k AS id", "p AS question", *texts, "cast(k % 5 AS int) AS cop", "s AS subject_name", "p AS topic_name", "'single' AS choice_type", "'e' || k AS exp")
    return _flat(bm.medmcqa(raw), "subject", "topic", "choice_type", "explanation")


_MAP = "map('B', s, 'A', 'w' || k) AS options"
_MAP_SQL = "'A=w'||k||'|B='||s"


@query("Q5_medqa", _sql("k % 3 < 2", options=_MAP_SQL, keys="chr((65 + k % 3)::INTEGER)", meta_info="s"))
def q5(spark, d):
    return _flat(bm.medqa(_orders(spark, d, "p AS question", _MAP, "' ' || chr(97 + k % 3) || ' ' AS answer_idx", "s AS meta_info")), "meta_info")


@query("Q6_pubmedqa", _sql("k % 2 = 0 AND k % 8 <> 6", stem="'Context:'||chr(10)||'BG. '||s||chr(10)||'END. '||c||chr(10)||chr(10)||'Question: '||p", options="'A=yes|B=no|C=maybe'", keys="CASE k % 8 WHEN 0 THEN 'A' WHEN 2 THEN 'B' ELSE 'C' END", pubid="k::VARCHAR", meshes="'m; '||s"))
def q6(spark, d):
    raw = _orders(spark, d, "k AS pubid", "p AS question", "named_struct('labels', array('BG', 'END'), 'contexts', array(s, '' || c), 'meshes', array('m', s)) AS context", "CASE k % 8 WHEN 0 THEN 'yes' WHEN 2 THEN ' No' WHEN 4 THEN 'MAYBE' WHEN 6 THEN 'unsure' ELSE 'yes' END AS final_decision")
    return _flat(bm.pubmedqa(raw, raw.filter("pubid % 2 = 0").select("pubid")), "pubid", "meshes")


@query("Q7_medxpertqa", _sql("k % 3 < 2 AND s = 'O'", options=_MAP_SQL, keys="chr((65 + k % 3)::INTEGER)", medical_task="p", body_system="c::VARCHAR", question_type="s"))
def q7(spark, d):
    raw = _orders(spark, d, "k AS id", "p || ' Answer Choices: (A) x' AS question", _MAP, "chr(97 + k % 3) AS label", "p AS medical_task", "c AS body_system", "s AS question_type")
    return _flat(bm.medxpertqa(raw, "O"), "medical_task", "body_system", "question_type")


@query("Q8_mmlu_med", _sql("k % 4 < 3 AND s IN ('O', 'F')", sample="s||'_'||k", options="'A=w'||k||'|B='||s||'|C=z'", keys="chr((65 + k % 4)::INTEGER)", subject="s"))
def q8(spark, d):
    raw = _orders(spark, d, "s", "p AS question", "array('w' || k, s, 'z') AS choices", "cast(k % 4 AS int) AS answer")
    return _flat(bm.mmlu_med({x: raw.filter(F.col("s") == x) for x in ("O", "F")}), "subject")


@query("Q9_mmlu_pro", _sql("s = 'F' AND k % 3 <> 1", options="'A=w'||k||'|C=z'", keys="chr((65 + k % 3)::INTEGER)", category="s", src="'x'"))
def q9(spark, d):
    raw = _orders(spark, d, "k AS question_id", "p AS question", "array('w' || k, 'N/A', 'z') AS options", "chr(97 + k % 3) AS answer", "s AS category", "'cot' AS cot_content", "'x' AS src")
    return _flat(bm.mmlu_pro_health(raw, "f"), "category", "src")


@query("Q10_nejm_qa", _sql("k % 4 <> 3", sample="s||'_'||k", stem="p||'?'", options="'A=w'||k||'|B='||s||'|C=z'", keys="CASE k % 4 WHEN 0 THEN 'A,C' ELSE chr((65 + k % 4)::INTEGER) END", multi="k % 4 = 0", specialty="s"))
def q10(spark, d):
    raw = _orders(spark, d, "s AS specialty", "p || '?' || chr(10) || 'A. w' || k || ' ' || chr(10) || 'B. ' || s || chr(10) || 'C. z' AS question", "CASE k % 4 WHEN 0 THEN 'A, C,Z' ELSE chr(65 + k % 4) END AS answer")
    return _flat(bm.nejm_qa(raw), "specialty")


@query("Q11_pubhealth", _sql("k % 4 < 3 AND s = 'O'", options="'A=w'||k||'|B='||s||'|C=z'", keys="chr((65 + k % 4)::INTEGER)", category="s", source="p"))
def q11(spark, d):
    raw = _orders(spark, d, "k AS question_id", "p AS question", "array('w' || k, s, 'z') AS options", "cast(k % 4 AS int) AS answer_index", "s AS category", "p AS source")
    return _flat(bm.pubhealthbench(raw, "O"), "category", "source")


@query("Q11_freeform", f"WITH {_O} SELECT k::VARCHAR AS sample_id, p AS question, CASE WHEN k % 5 = 0 THEN 'given' ELSE ['w'||k, s, 'z'][(k % 4 + 1)::INTEGER] END AS reference_answer FROM o WHERE k % 5 = 0 OR k % 4 < 3")
def q11_freeform(spark, d):
    raw = _orders(spark, d, "k AS question_id", "p AS question", "array('w' || k, s, 'z') AS options", "cast(k % 4 AS int) AS answer_index", "s AS category", "CASE WHEN k % 5 = 0 THEN ' given ' ELSE ' ' END AS reference_answer")
    return bm.pubhealthbench_freeform(raw).select("sample_id", "question", "reference_answer")


@query("Q12_supergpqa", _sql("k % 4 < 3 AND c % 3 = 0 AND s = 'F'", options="'A=w'||k||'|B='||s||'|C=z'", keys="chr((65 + k % 4)::INTEGER)", difficulty="s"))
def q12(spark, d):
    raw = _orders(spark, d, "p AS question", "array('w' || k, s, 'z') AS options", "chr(97 + k % 4) AS answer_letter", "CASE WHEN c % 3 = 0 THEN 'Medicine' ELSE 'Law' END AS discipline", "p AS field", "s AS difficulty", "'x' AS source")
    return _flat(bm.supergpqa_med(raw, difficulty="F"), "difficulty")


@query("Q13_healthbench", f"""WITH {_O}, l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, l_returnflag AS f FROM lineitem), g AS (SELECT k, count(*) AS m FROM l GROUP BY 1)
 SELECT k::VARCHAR AS prompt_id, 'user: '||p||chr(10)||chr(10)||'assistant: '||s AS question, s AS theme, n AS points, 'crit '||n AS criterion, 'acc:'||f AS axis, CASE WHEN n % 2 = 0 THEN 'cluster' END AS level, m AS criteria FROM o JOIN l USING (k) JOIN g USING (k)""")
def q13_healthbench(spark, d):
    li = tg.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("f")).distinct()
    rubric = F.struct(F.concat(F.lit("crit "), "n").alias("criterion"), F.col("n").alias("points"), F.array_compact(F.array(F.concat(F.lit("axis:acc:"), "f"), F.when(F.col("n") % 2 == 0, "level:cluster"))).alias("tags"))
    raw = _orders(spark, d, "k", "cast(k AS string) AS prompt_id", "array(named_struct('role', 'user', 'content', p), named_struct('role', 'assistant', 'content', s)) AS prompt", "array('theme:' || s, 'x') AS example_tags")
    out = bm.healthbench(raw.join(li.groupBy("k").agg(F.collect_list(rubric).alias("rubrics")), "k"))
    sizes = out.groupBy("prompt_id").agg(F.count("*").alias("criteria"))
    return out.filter(F.length("criterion_id") == 16).join(sizes, "prompt_id").select("prompt_id", "question", "theme", "points", "criterion", "axis", "level", "criteria")


@query("Q14_open_ended", f"""WITH {_O} SELECT 'care' AS kind, k::VARCHAR AS sample_id, p AS question, s AS reference_answer FROM o
 UNION ALL SELECT 'case', 'PMC'||k, p, s FROM o WHERE k % 3 <> 0 UNION ALL SELECT 'nejm', k::VARCHAR, CASE WHEN k % 2 = 0 THEN p ELSE 'title' END, s FROM o""")
def q14(spark, d):
    care = bm.careqa_reasoning(_orders(spark, d, "p AS question", "s AS answer", "'e' AS answer_explanation", "'x' AS subject"))
    case = bm.medcase_reasoning(_orders(spark, d, "'PMC' || k AS pmcid", "p AS case_prompt", "CASE WHEN k % 3 <> 0 THEN s ELSE '  ' END AS final_diagnosis", "'r' AS diagnostic_reasoning"))
    nejm = bm.nejm_diagnostic(_orders(spark, d, "CASE WHEN k % 2 = 0 THEN p ELSE ' ' END AS case_presentation", "'title' AS Title", "s AS Answer"))
    parts = [x.select(F.lit(n).alias("kind"), "sample_id", "question", "reference_answer") for n, x in (("care", care), ("case", case), ("nejm", nejm))]
    return parts[0].union(parts[1]).union(parts[2])


@query("Q15_rar_med", f"WITH {_O} SELECT k::VARCHAR AS sample_id, p AS question, s AS reference_answer, c::VARCHAR AS customer, 'x' AS other, 2 AS fields FROM o")
def q15(spark, d):
    raw = _orders(spark, d, "p AS question", "s AS reference_answer", "array(named_struct('a', 'b')) AS rubric", "c AS customer", "'x' AS other")
    m = F.col("metadata")
    return bm.rar_med(raw).select("sample_id", "question", "reference_answer", m["customer"].alias("customer"), m["other"].alias("other"), F.size(m).alias("fields"))
