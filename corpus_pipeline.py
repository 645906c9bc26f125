"""The corpus pipeline: language ID, near-duplicates, repeated passages, source mix, packing.

Each stage takes all that the one before kept, acts on it and returns the columns of ``documents``; the last
returns the packed pieces. Where a document comes back changed, ``n_chars`` is that of its new text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.llm.jaccard import SHINGLE, similar_groups
from kgweave.llm.langid import held_out, identify_languages, train_model
from kgweave.llm.mixing import mix_sources, take_mix, word_count
from kgweave.llm.packing import pack_documents
from kgweave.llm.simhash import near_duplicates
from kgweave.llm.substrings import remove_repeats
from kgweave.plans.scratch import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_SCORE = 0.4  # mean probability of a position; of held-out documents one in a thousand is below 0.6
#: SQL has no recurrent network, transitive closure of hashes, recompression, dependent rounding or packing.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those no learned language claims with ``MIN_SCORE``, go."""
    model = train_model(docs.filter(~held_out()))
    return identify_languages(docs, model, COLUMNS).filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays: the one with the smallest id, null last. Covering SimHash of five-word
    shingles gathers the closest copies first; one of each such group is then compared by Jaccard similarity, 0.8 or more. Rows
    that share an id, or have none, are told apart by a hash of all their columns; wholly equal rows count as one."""
    rows = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("_key"))
    work = Scratch(spark, "near")
    close = work.write(near_duplicates(rows, "_key", width=SHINGLE).select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_rep")), "close")
    reps = rows.join(close.filter("_key = _rep").select("_key").distinct(), "_key", "left_semi")
    groups = close.select("_rep", "_key").distinct().join(similar_groups(reps, "_key").distinct().withColumnRenamed("_key", "_rep"), "_rep")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")).alias("first")
    ids = rows.select("doc_id", "_key").distinct()
    keep = groups.join(ids, "_key").groupBy("group").agg(first).select(F.col("first.doc_id").alias("_id"), F.col("first._key").alias("_kept"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_kept"))
    return rows.join(keep, same, "left_semi").dropDuplicates(["doc_id", "_key"]).select(*COLUMNS)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds go; documents of which nothing is left go with them."""
    rest = F.to_json(F.struct("lang", "source"))
    out = remove_repeats(docs, rest=rest).filter((F.col("n_removed") < F.col("n_words")) | (F.col("n_words") == 0))
    cut = out.select("doc_id", F.col("kept").cast("string").alias("text"), F.from_json("rest", "lang string, source string").alias("r"))
    return cut.select("doc_id", "text", "r.lang", "r.source", F.length("text").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    size = word_count("text")
    return take_mix(docs, mix_sources(docs.select("doc_id", "source", size.alias("size"))), size)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicate), ("substrings", substring), ("mix", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    work = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.write(docs, name)
    return docs
