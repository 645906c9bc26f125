"""The test graph: a typed graph over the relational tables, for queries on whole graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (table, key, name, curie prefix, label)
KINDS = (("region", "r_regionkey", "r_name", "REG", "Region"), ("nation", "n_nationkey", "n_name", "NAT", "Nation"), ("customer", "c_custkey", "c_name", "CUS", "Customer"), ("supplier", "s_suppkey", "s_name", "SUP", "Supplier"), ("part", "p_partkey", "p_name", "PRT", "Part"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, name, label)``"""
    out = None
    for t, key, name, prefix, label in KINDS:
        part = table(spark, sf_dir, t).select(F.concat(F.lit(f"{prefix}:"), F.col(key)).alias("id"), F.col(name).alias("name"), F.lit(label).alias("label"))
        out = part if out is None else out.union(part)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(from, to, label, type, score)``"""
    c = lambda p, k: F.concat(F.lit(f"{p}:"), F.col(k))
    row = lambda df, a, b, label, kind, score: df.select(a.alias("from"), b.alias("to"), F.lit(label).alias("label"), F.lit(kind).alias("type"), score.cast("double").alias("score"))
    one = F.lit(1.0)
    items = table(spark, sf_dir, "lineitem")
    supplies = items.select("l_suppkey", "l_partkey").distinct()
    bought = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "l_partkey").agg(F.max("l_quantity").alias("q"))
    return (
        row(table(spark, sf_dir, "nation"), c("NAT", "n_nationkey"), c("REG", "n_regionkey"), "NAT-REG", "PART_OF", one)
        .union(row(table(spark, sf_dir, "customer"), c("CUS", "c_custkey"), c("NAT", "c_nationkey"), "CUS-NAT", "LOCATED_IN", one))
        .union(row(table(spark, sf_dir, "supplier"), c("SUP", "s_suppkey"), c("NAT", "s_nationkey"), "SUP-NAT", "LOCATED_IN", one))
        .union(row(supplies, c("SUP", "l_suppkey"), c("PRT", "l_partkey"), "SUP-PRT", "SUPPLIES", one))
        .union(row(bought, c("CUS", "o_custkey"), c("PRT", "l_partkey"), "CUS-PRT", "ORDERED", F.least(F.col("q"), F.lit(50.0)) / 50))
    )


#: The same two tables as DuckDB common table expressions.
SQL = (
    "nodes AS ("
    + " UNION ALL ".join(f"SELECT '{p}:'||{k} AS id, {n} AS name, '{lab}' AS label FROM {t}" for t, k, n, p, lab in KINDS)
    + """), edges AS (
SELECT 'NAT:'||n_nationkey AS "from", 'REG:'||n_regionkey AS "to", 'NAT-REG' AS label, 'PART_OF' AS type, 1.0::DOUBLE AS score FROM nation
UNION ALL SELECT 'CUS:'||c_custkey, 'NAT:'||c_nationkey, 'CUS-NAT', 'LOCATED_IN', 1.0 FROM customer
UNION ALL SELECT 'SUP:'||s_suppkey, 'NAT:'||s_nationkey, 'SUP-NAT', 'LOCATED_IN', 1.0 FROM supplier
UNION ALL SELECT DISTINCT 'SUP:'||l_suppkey, 'PRT:'||l_partkey, 'SUP-PRT', 'SUPPLIES', 1.0 FROM lineitem
UNION ALL SELECT 'CUS:'||o_custkey, 'PRT:'||l_partkey, 'CUS-PRT', 'ORDERED', least(max(l_quantity), 50.0)/50 FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"""
)
