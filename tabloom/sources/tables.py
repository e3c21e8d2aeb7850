"""Driver tables and the small derived views that add what they lack.

The derived views (nulls, dirty text, scored predictions, a learnable
target) are plain projections of the driver tables, so their size grows
with the scale factor and Catalyst prunes them to the columns a query uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table (Parquet: column pruning and filter pushdown apply)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def f_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer with nulls in a number and in a string."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 7 == 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        "c_nationkey",
    )


def f_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with symbols, empty strings and dates as text."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        F.concat(F.lit("$"), F.col("o_totalprice").cast("string"),
                 F.when(F.col("o_orderkey") % 3 == 0, F.lit("!")).otherwise(F.lit(""))).alias("price_txt"),
        F.when(F.col("o_orderkey") % 11 == 0, F.lit("")).otherwise(F.col("o_custkey").cast("string")).alias("cust_txt"),
        F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("date_txt"),
    )


def f_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary truth + score and a regression truth + prediction."""
    o = table(spark, sf_dir, "orders")
    h = (F.col("o_orderkey") * 7919) % 1000
    pos = F.col("o_orderstatus") == "F"
    return o.select(
        "o_orderkey",
        F.when(pos, 1).otherwise(0).alias("y"),
        ((h + F.when(pos, 300).otherwise(0)).cast("double") / 1300).alias("score"),
        F.col("o_totalprice").alias("actual"),
        (F.col("o_totalprice") + h - 500).alias("predicted"),
    )


def f_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with a learnable, imbalanced binary target y and a 3-class y3."""
    li = table(spark, sf_dir, "lineitem")
    x1 = F.col("l_quantity") / 50
    x2 = F.col("l_discount") * 10
    noise = ((F.col("l_partkey") * 7919) % 100).cast("double") / 200
    s3 = x1 + x2
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        x1.alias("x1"), x2.alias("x2"), (F.col("l_tax") * 12.5).alias("x3"),
        F.when(2 * x1 + x2 + noise > 2.605, 1).otherwise(0).alias("y"),
        F.when(s3 > 1.303, 2).when(s3 > 0.703, 1).otherwise(0).alias("y3"),
    )


# The same views as SQL, for oracle queries run by another engine.
FIXTURE_SQL = {
    "f_null": """SELECT c_custkey,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
       c_nationkey
FROM customer""",
    "f_dirty": """SELECT o_orderkey,
       concat('$', CAST(o_totalprice AS VARCHAR(30)), CASE WHEN o_orderkey % 3 = 0 THEN '!' ELSE '' END) AS price_txt,
       CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR(20)) END AS cust_txt,
       substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) AS date_txt
FROM orders""",
    "f_scored": """SELECT o_orderkey,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
       CAST((o_orderkey * 7919) % 1000 + CASE WHEN o_orderstatus = 'F' THEN 300 ELSE 0 END AS DOUBLE) / 1300 AS score,
       o_totalprice AS actual,
       o_totalprice + ((o_orderkey * 7919) % 1000) - 500 AS predicted
FROM orders""",
    "f_class": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       l_quantity / 50 AS x1, l_discount * 10 AS x2, l_tax * 12.5 AS x3,
       CASE WHEN 2 * (l_quantity / 50) + l_discount * 10
                 + CAST((l_partkey * 7919) % 100 AS DOUBLE) / 200 > 2.605 THEN 1 ELSE 0 END AS y,
       CASE WHEN l_quantity / 50 + l_discount * 10 > 1.303 THEN 2
            WHEN l_quantity / 50 + l_discount * 10 > 0.703 THEN 1 ELSE 0 END AS y3
FROM lineitem""",
}


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix an oracle query with the named fixture views as CTEs."""
    ctes = ",\n".join(f"{n} AS (\n{FIXTURE_SQL[n]}\n)" for n in names)
    return f"WITH {ctes}\n{sql}"
