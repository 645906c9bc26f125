"""Question-answering benchmarks: raw rows -> one table of samples.

Multiple choice: ``(sample_id, row_id, question_stem, options array<struct<label,text>>, answer_keys, is_multi, metadata)``. Rows that fail
a rule are dropped. Inputs carry an explicit ``row_id``, as Spark has no row order.
"""

from __future__ import annotations

import hashlib
import random
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweave.plans import testgraph as tg
from kgweave.plans.registry import query

#: Options that refer to the others and stay in place, and references to other options' labels (fixed patterns).
ANCHOR = r"(?i)\b(?:all|none|some|both|neither)\s+(?:of\s+(?:the\s+)?)?(?:above|following|these|choices?|options?|answers?|statements?|responses?|listed|apply|applicable|them)\b"
_TOKEN = r"(?:\((?-i:[A-Z0-9]+)\)|\[(?-i:[A-Z0-9]+)\]|\b(?-i:[A-Z])(?:[)\.:])?|\b\d+(?:[)\.:])?)"
_JOIN = r"(?:\s*[,&/]+\s*|\s+(?:and/or|and|or|nor)\s+)"
LABEL_REF = rf"(?i)(?:\b(?:both|either|neither|only)\b\s+)?{_TOKEN}{_JOIN}{_TOKEN}(?:{_JOIN}{_TOKEN})*"
OPTIONS = "array<struct<label:string,text:string>>"
SEED = 1618


def lettered(*texts: Column) -> Column:
    """Options A, B, ... of columns; null texts are empty."""
    return F.array(*[F.struct(F.lit(chr(65 + i)).alias("label"), F.coalesce(t.cast("string"), F.lit("")).alias("text")) for i, t in enumerate(texts)])


def letter_options(texts: Column) -> Column:
    return F.transform(texts, lambda t, i: F.struct(F.chr(65 + i).alias("label"), t.alias("text")))


def map_options(options: Column) -> Column:
    return F.transform(F.array_sort(F.map_entries(options)), lambda e: F.struct(e["key"].alias("label"), e["value"].alias("text")))


def keep_order(options: Column) -> Column:
    """Whether the order must stay: some option names others' labels."""
    return F.exists(options, lambda o: F.coalesce(o["text"].rlike(LABEL_REF), F.lit(False)))


def shuffle_options(samples: DataFrame, seed: int = SEED) -> DataFrame:
    """Options permuted inside the blocks between anchors by a hash of (seed, row, label); labels stay in order and keys follow. Native."""
    n = F.size("options")
    anchors = F.transform("options", lambda o: F.coalesce(o["text"].rlike(ANCHOR), F.lit(False)))
    # block number of a place: anchors before it; an anchor is a block of its own between two others
    block = lambda i: F.size(F.filter(F.slice(anchors, F.lit(1), i), lambda a: a)) * 2 + F.when(F.get(anchors, i), 1).otherwise(0)
    keyed = F.transform("options", lambda o, i: F.struct(block(i).alias("b"), F.sha2(F.concat_ws("::", F.lit(str(seed)), F.col("row_id").cast("string"), o["label"]), 256).alias("h"), i.alias("i"), o["text"].alias("text")))
    order = F.when(keep_order(F.col("options")), F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.lit(0).alias("b"), F.lit("").alias("h"), i.alias("i"), F.get("options", i)["text"].alias("text")))).otherwise(F.array_sort(keyed))
    s = samples.filter(n > 0).withColumn("_o", order)
    labels = F.transform("options", lambda o: o["label"])
    new = F.transform("_o", lambda x, i: F.struct(F.get(labels, i).alias("label"), x["text"].alias("text")))
    moved = lambda k: F.get(labels, F.array_position(F.transform("_o", lambda x: x["i"]), (F.array_position(labels, k) - 1).cast("int")).cast("int") - 1)
    return s.withColumn("_k", F.array_sort(F.transform("answer_keys", moved))).withColumn("_n", new).drop("options", "answer_keys", "_o").withColumnsRenamed({"_n": "options", "_k": "answer_keys"}).select(*samples.columns)


def shuffle_options_mt(samples: DataFrame, seed: int = SEED) -> DataFrame:
    """As ``shuffle_options`` with the blocks permuted by Python's generator seeded with SHA-256 of ``seed::row``, for bit-equal orders."""
    anchor, ref = re.compile(ANCHOR), re.compile(LABEL_REF)

    @F.pandas_udf("array<int>")
    def order(row: pd.Series, texts: pd.Series) -> pd.Series:
        def one(r, ts):
            ts = [t or "" for t in ts]
            if any(ref.search(t) for t in ts):
                return list(range(len(ts)))
            rng = random.Random(int(hashlib.sha256(f"{seed}::{r}".encode()).hexdigest(), 16) & ((1 << 64) - 1))
            stops, out, at = [*(i for i, t in enumerate(ts) if anchor.search(t)), len(ts)], [], 0
            for stop in stops:
                if at < stop:
                    part = list(range(at, stop))
                    rng.shuffle(part)
                    out += part
                if stop < len(ts):
                    out.append(stop)
                at = stop + 1
            return out

        return pd.Series([one(r, t) for r, t in zip(row, texts)])

    labels = F.transform("options", lambda o: o["label"])
    s = samples.withColumn("_o", order(F.col("row_id").cast("string"), F.transform("options", lambda o: o["text"])))
    new = F.transform("_o", lambda x, i: F.struct(F.get(labels, i).alias("label"), F.get("options", x)["text"].alias("text")))
    moved = lambda k: F.get(labels, F.array_position("_o", (F.array_position(labels, k) - 1).cast("int")).cast("int") - 1)
    return s.withColumn("_k", F.transform("answer_keys", moved)).withColumn("_n", new).drop("options", "answer_keys", "_o").withColumnsRenamed({"_n": "options", "_k": "answer_keys"}).select(*samples.columns)


def mcq_prompt(stem: Column, options: Column, multi: Column) -> Column:
    """The prompt text (fixed wording)."""
    lines = F.array_join(F.transform(options, lambda o: F.concat(o["label"], F.lit(". "), o["text"])), "\n")
    ask = F.when(multi, "Answer with the letter(s) of the correct option(s) (e.g., 'A' or 'B,C').").otherwise("Answer with only the letter of the correct option.")
    return F.concat(F.lit("Question: "), stem, F.lit("\nChoices:\n"), lines, F.lit("\n"), ask)


def validate_mcq(samples: DataFrame) -> DataFrame:
    """With ``errors``: no key, a repeated key, a key that isn't a label, several keys of a single-answer question."""
    labels = F.transform("options", lambda o: o["label"])
    checks = [
        (F.coalesce(F.size("answer_keys"), F.lit(0)) <= 0, "no answer key"), (F.size(F.array_distinct("answer_keys")) < F.size("answer_keys"), "repeated answer key"),
        (F.exists("answer_keys", lambda k: ~F.array_contains(labels, k)), "answer key without option"), (~F.col("is_multi") & (F.size("answer_keys") > 1), "several keys of a single-answer question"),
    ]
    return samples.withColumn("errors", F.array_compact(F.array(*[F.when(c, t) for c, t in checks])))


def _mcq(raw: DataFrame, stem: Column, options: Column, keys: Column, sample_id: Column, multi: Column | None = None, **meta: Column) -> DataFrame:
    pairs = [x for k, v in meta.items() for x in (F.lit(k), v.cast("string"))]
    out = raw.select(sample_id.cast("string").alias("sample_id"), "row_id", F.trim(stem).alias("question_stem"), options.alias("options"), keys.alias("answer_keys"), (multi if multi is not None else F.lit(False)).alias("is_multi"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("metadata"))
    labels = F.transform("options", lambda o: o["label"])
    return out.filter((F.col("question_stem") != "") & (F.size("options") > 0) & (F.size("answer_keys") > 0) & F.forall("answer_keys", lambda k: k.isNotNull() & F.array_contains(labels, k)))


def build_mcq(samples: DataFrame, seed: int | None = SEED, limit: int | None = None) -> DataFrame:
    """Shuffle, prompt, and the first ``limit`` samples by row."""
    s = samples if limit is None else samples.orderBy("row_id").limit(limit)
    s = s if seed is None else shuffle_options(s, seed)
    return s.withColumn("prompt", mcq_prompt(F.col("question_stem"), F.col("options"), F.col("is_multi")))


def _index_key(i: Column, n: Column) -> Column:
    """Letter of a 0-based index within n options."""
    return F.array(F.when((i >= 0) & (i < n), F.chr(65 + i)))


def careqa(raw: DataFrame) -> DataFrame:
    o = [F.col(f"op{i}") for i in range(1, 5)]
    return _mcq(raw, F.col("question"), lettered(*o), _index_key(F.col("cop") - 1, F.lit(4)), F.col("id"), subject=F.col("subject"))


def medmcqa(raw: DataFrame) -> DataFrame:
    o = [F.col(f"op{x}") for x in "abcd"]
    some = raw.filter(F.concat_ws("", *o) != "")
    return _mcq(some, F.col("question"), lettered(*o), _index_key(F.col("cop"), F.lit(4)), F.col("id"), subject=F.col("subject_name"), topic=F.col("topic_name"), choice_type=F.col("choice_type"), explanation=F.col("exp"))


def medqa(raw: DataFrame) -> DataFrame:
    return _mcq(raw, F.col("question"), map_options(F.col("options")), F.array(F.upper(F.trim("answer_idx"))), F.col("row_id"), meta_info=F.col("meta_info"))


def pubmedqa(raw: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """``allowed(pubid)`` names the rows of the test split."""
    rows = raw if allowed is None else raw.join(allowed.select(F.col("pubid").cast("string").alias("_p")), F.col("pubid").cast("string") == F.col("_p"), "left_semi")
    rows = rows.filter(F.trim(F.coalesce("question", F.lit(""))) != "")
    block = F.array_join(F.transform(F.arrays_zip("context.labels", "context.contexts"), lambda x: F.concat_ws(". ", x["labels"], x["contexts"])), "\n")
    stem = F.concat(F.lit("Context:\n"), F.coalesce(block, F.lit("")), F.lit("\n\nQuestion: "), "question")
    key = F.try_element_at(F.create_map(F.lit("yes"), F.lit("A"), F.lit("no"), F.lit("B"), F.lit("maybe"), F.lit("C")), F.lower(F.trim("final_decision")))
    return _mcq(rows, stem, lettered(F.lit("yes"), F.lit("no"), F.lit("maybe")), F.array(key), F.coalesce(F.col("pubid").cast("string"), F.col("row_id").cast("string")), pubid=F.col("pubid"), meshes=F.array_join("context.meshes", "; "))


def medxpertqa(raw: DataFrame, question_type: str | None = None) -> DataFrame:
    rows = raw if question_type is None else raw.filter(F.col("question_type") == question_type)
    return _mcq(rows, F.substring_index("question", "Answer Choices:", 1), map_options(F.col("options")), F.array(F.upper(F.trim("label"))), F.col("id"), medical_task=F.col("medical_task"), body_system=F.col("body_system"), question_type=F.col("question_type"))


def mmlu_med(subjects: dict[str, DataFrame]) -> DataFrame:
    """Tables by subject, each with its own ``row_id``."""
    out = None
    for name, raw in subjects.items():
        s = _mcq(raw, F.col("question"), letter_options(F.col("choices")), _index_key(F.col("answer"), F.size("choices")), F.concat_ws("_", F.lit(name), "row_id"), subject=F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out


def mmlu_pro_health(raw: DataFrame, category: str = "health") -> DataFrame:
    """Options that are not available go; the others keep their letters."""
    o = F.filter(letter_options(F.col("options")), lambda x: x["text"] != "N/A")
    return _mcq(raw.filter(F.lower("category") == category), F.col("question"), o, F.array(F.upper(F.trim("answer"))), F.col("question_id"), category=F.col("category"), cot_content=F.col("cot_content"), src=F.col("src"))


def nejm_qa(raw: DataFrame) -> DataFrame:
    """Options stand in the question's text, a line each; ``specialty`` names the split. Of a repeated letter the last text counts, at the place of the first."""
    line = r"(?:\n|^)([A-D])\.\s*(.+)"
    q = F.trim("question")
    opts = F.arrays_zip(F.regexp_extract_all(q, F.lit(line), F.lit(1)).alias("label"), F.transform(F.regexp_extract_all(q, F.lit(line), F.lit(2)), lambda t: F.trim(t)).alias("text"))
    r = raw.withColumn("_o", opts.cast(OPTIONS))
    labels = F.array_distinct(F.transform("_o", lambda o: o["label"]))
    last = F.transform(labels, lambda k: F.struct(k.alias("label"), F.element_at(F.filter("_o", lambda o: o["label"] == k), -1)["text"].alias("text")))
    r = r.withColumn("_opts", last).filter(F.size("_opts") >= 2)
    letters = F.filter(F.transform(F.split("answer", ","), lambda a: F.trim(a)), lambda a: F.array_contains(F.transform("_opts", lambda o: o["label"]), a))
    stem = F.element_at(F.split(q, line, 2), 1)
    return _mcq(r, stem, F.col("_opts"), letters, F.concat_ws("_", "specialty", "row_id"), F.size(letters) > 1, specialty=F.col("specialty"), answer_raw=F.col("answer"))


def pubhealthbench(raw: DataFrame, category: str | None = None) -> DataFrame:
    rows = raw if category is None else raw.filter(F.col("category") == category)
    return _mcq(rows, F.col("question"), letter_options(F.col("options")), _index_key(F.col("answer_index"), F.size("options")), F.col("question_id"), category=F.col("category"), source=F.col("source"))


def supergpqa_med(raw: DataFrame, discipline: str | None = "Medicine", field: str | None = None, difficulty: str | None = None) -> DataFrame:
    for col, v in (("discipline", discipline), ("field", field), ("difficulty", difficulty)):
        raw = raw if v is None else raw.filter(F.col(col) == v)
    return _mcq(raw, F.col("question"), letter_options(F.col("options")), F.array(F.upper(F.trim("answer_letter"))), F.col("row_id"), discipline=F.col("discipline"), field=F.col("field"), difficulty=F.col("difficulty"), source=F.col("source"))


def first_filled(*cols: Column) -> Column:
    """The first value that isn't null or blank."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in cols])


def open_ended(raw: DataFrame, question: Column, answer: Column, sample_id: Column, **meta: Column) -> DataFrame:
    pairs = [x for k, v in meta.items() for x in (F.lit(k), v.cast("string"))]
    return raw.select(sample_id.cast("string").alias("sample_id"), first_filled(question).alias("question"), first_filled(answer).alias("reference_answer"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("metadata")).filter("question is not null and reference_answer is not null")


def pubhealthbench_freeform(raw: DataFrame) -> DataFrame:
    """The reference answer is the given one, else the text of the right option; an index out of range gives none."""
    right = F.when(F.col("answer_index") >= 0, F.get("options", F.col("answer_index")))
    return open_ended(raw, F.col("question"), first_filled(F.col("reference_answer"), right), F.col("question_id"), category=F.col("category"))


def careqa_reasoning(raw: DataFrame) -> DataFrame:
    return open_ended(raw, F.col("question"), F.col("answer"), F.col("row_id"), explanation=F.col("answer_explanation"), subject=F.col("subject"))


def medcase_reasoning(raw: DataFrame) -> DataFrame:
    return open_ended(raw, F.col("case_prompt"), F.col("final_diagnosis"), F.col("pmcid"), diagnostic_reasoning=F.col("diagnostic_reasoning"))


def nejm_diagnostic(raw: DataFrame) -> DataFrame:
    pick = lambda *names: first_filled(*[F.col(f"`{c}`") for c in names if c in raw.columns])
    return open_ended(raw, pick("case_presentation", "Title", "question"), pick("diagnosis", "Answer", "answer"), F.col("row_id"))


def rar_med(raw: DataFrame) -> DataFrame:
    """Columns beyond question, answer and rubric become metadata."""
    rest = [c for c in raw.columns if c not in ("question", "reference_answer", "rubric", "row_id")]
    return open_ended(raw, F.col("question"), F.col("reference_answer"), F.col("row_id"), **{c: F.col(c) for c in rest})


def _blake(x: pd.Series) -> pd.Series:
    return x.map(lambda cs: [hashlib.blake2b(c.encode(), digest_size=8).hexdigest() for c in cs] if cs is not None else None)


def healthbench(raw: DataFrame, consensus: DataFrame | None = None) -> DataFrame:
    """``prompt_id, prompt array<struct<role,content>>, rubrics array<struct<criterion,points,tags>>, example_tags`` -> one row per criterion with its
    axis, level and cluster, the id of its text, the sample's theme and conversation, and the consensus criterion of its cluster."""

    def run(x: pd.Series) -> pd.Series:
        return _blake(x)

    tag = lambda k: F.regexp_extract(F.element_at(F.filter("r.tags", lambda t: t.startswith(f"{k}:")), -1), r"(?s)^[^:]*:(.*)$", 1)
    some = lambda k: F.when(F.exists("r.tags", lambda t: t.startswith(f"{k}:")), tag(k))
    theme = F.regexp_replace(F.filter("example_tags", lambda t: t.startswith("theme:"))[0], "^theme:", "")
    talk = F.array_join(F.transform("prompt", lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n\n")
    ids = F.pandas_udf(run, "array<string>")(F.transform("rubrics", lambda r: r["criterion"]))
    rows = raw.select("prompt_id", talk.alias("question"), theme.alias("theme"), F.posexplode(F.arrays_zip(F.col("rubrics"), ids.alias("ids"))).alias("pos", "z"))
    rows = rows.select("prompt_id", "question", "theme", "pos", F.col("z.rubrics").alias("r"), F.col("z.ids").alias("criterion_id"))
    out = rows.select("prompt_id", "question", "theme", "pos", "criterion_id", F.col("r.criterion").alias("criterion"), F.col("r.points").alias("points"), some("axis").alias("axis"), some("level").alias("level"), some("cluster").alias("cluster"))
    return out if consensus is None else out.join(consensus, "cluster", "left")


def conversation_text(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Turns joined in order as one text; a conversation's turns are gathered in a row."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, "role", "text"))), lambda t: F.concat_ws(": ", t["role"], t["text"]))
    return turns.groupBy(key).agg(F.array_join(lines, "\n\n").alias("question"))


_OPT = ["o_orderpriority", "'text ' || o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN 'None of the above' ELSE 'plain' END", "CASE WHEN o_orderkey % 11 = 0 THEN 'Both A and B' ELSE 'other' END"]


def _samples(spark, d) -> DataFrame:
    o = tg.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("question_stem"), lettered(*[F.expr(x) for x in _OPT]).alias("options"), F.array(F.expr("chr(65 + o_orderkey % 4)")).alias("answer_keys"), F.lit(False).alias("is_multi"))


@query("Q1_shuffle", f"""WITH s AS (SELECT o_orderkey AS id, unnest([0, 1, 2, 3]) AS i, [{', '.join(_OPT)}] AS t FROM orders), k AS (SELECT *, t[i + 1] AS x, CASE WHEN id % 3 = 0 THEN CASE WHEN i < 2 THEN 0 WHEN i = 2 THEN 1 ELSE 2 END ELSE 0 END AS b, sha256('1618::'||id||'::'||chr((65 + i)::INTEGER)) AS h FROM s),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN id % 11 = 0 THEN i ELSE b END, CASE WHEN id % 11 = 0 THEN '' ELSE h END) - 1 AS p FROM k) SELECT id AS sample_id, string_agg(x, '|' ORDER BY p) AS options, max(CASE WHEN i = id % 4 THEN chr((65 + p)::INTEGER) END) AS answer FROM r GROUP BY 1""")
def q1(spark, d):
    s = shuffle_options(_samples(spark, d))
    return s.select("sample_id", F.array_join(F.transform("options", lambda o: o["text"]), "|").alias("options"), F.col("answer_keys")[0].alias("answer"))


@query("Q2_prompt", "SELECT o_orderkey AS sample_id, 'Question: '||o_orderstatus||chr(10)||'Choices:'||chr(10)||'A. '||o_orderpriority||chr(10)||'B. '||o_orderdate::DATE::VARCHAR||chr(10)||'Answer with only the letter of the correct option.' AS prompt FROM orders")
def q2(spark, d):
    o = tg.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("sample_id"), mcq_prompt(F.col("o_orderstatus"), lettered(F.col("o_orderpriority"), F.col("o_orderdate").cast("date")), F.lit(False)).alias("prompt"))


@query("P10_validate_mcq", "SELECT o_orderkey AS sample_id, CASE o_orderkey % 4 WHEN 0 THEN 'no answer key' WHEN 1 THEN 'repeated answer key;several keys of a single-answer question' WHEN 2 THEN 'answer key without option' ELSE '' END AS errors FROM orders")
def p10(spark, d):
    keys = F.expr("CASE o_orderkey % 4 WHEN 0 THEN CAST(array() AS array<string>) WHEN 1 THEN array('A', 'A') WHEN 2 THEN array('Z') ELSE array('B') END")
    s = tg.table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), lettered(F.lit("x"), F.lit("y")).alias("options"), keys.alias("answer_keys"), F.lit(False).alias("is_multi"))
    return validate_mcq(s).select("sample_id", F.array_join("errors", ";").alias("errors"))


@query("Q13_conversations", "SELECT conv_id, string_agg(role||': '||text, chr(10)||chr(10) ORDER BY turn, role, text) AS question FROM conversations GROUP BY 1")
def q13(spark, d):
    return conversation_text(tg.table(spark, d, "conversations"))
