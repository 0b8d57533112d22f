"""Branches, logs and commit histories derived from the given tables.

Each builder has a SQL text of the same name in capitals, to be used as the
first part of a WITH clause.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MONEY = "decimal(18,2)"

# Dense ids are cut into chunks of this many rows; sparse ones by quantiles.
CHUNK_ROWS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- three branches of orders -------------------------------------------------

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate"]
KEYS = ["o_orderkey"]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.withColumn("o_totalprice", F.col("o_totalprice").cast(MONEY)).withColumn(
        "yr", F.year("o_orderdate")
    )


def _edited(df: DataFrame, status: Column, price: Column, priority: Column) -> DataFrame:
    return df.select(
        "o_orderkey",
        "o_custkey",
        status.alias("o_orderstatus"),
        price.cast(MONEY).alias("o_totalprice"),
        priority.alias("o_orderpriority"),
        "o_orderdate",
    )


def _reissued(df: DataFrame, condition: Column, status: Column) -> DataFrame:
    return df.where(condition).select(
        (-F.col("o_orderkey") - 1).alias("o_orderkey"),
        "o_custkey",
        status.alias("o_orderstatus"),
        "o_totalprice",
        "o_orderpriority",
        "o_orderdate",
    )


def order_branches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, ours, theirs): a common version of orders and two edited branches."""
    o = _orders(spark, sf_dir)
    st, pr, yr, price = (
        F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("yr"), F.col("o_totalprice")
    )
    base = o.select(*ORDER_COLUMNS)
    shipped = (st == "O") & (pr == "2-HIGH")
    theirs = _edited(
        o.where(~((pr == "5-LOW") & (yr == 1998))),
        F.when(shipped, "S")
        .when((st == "F") & (pr == "4-NOT SPECIFIED") & (yr == 1996), "X")
        .when((st == "P") & (pr == "1-URGENT") & (yr == 1999) & (F.month("o_orderdate") > 6), "X")
        .otherwise(st),
        F.when((pr == "1-URGENT") & (st == "P"), price + 100).otherwise(price),
        pr,
    ).unionByName(_reissued(o, (yr == 2001) & (pr == "1-URGENT"), st))
    ours = _edited(
        o.where(~((pr == "1-URGENT") & (yr == 2000))),
        F.when(shipped, "S").otherwise(st),
        F.when((pr == "1-URGENT") & (yr == 1999), price + 50).otherwise(price),
        F.when((yr == 1998) & (st == "F"), "9-OURS").otherwise(pr),
    ).unionByName(_reissued(o, (yr == 2001) & (st == "F"), F.lit("Z")))
    return base, ours, theirs


ORDER_BRANCHES = """
o AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice,
         o_orderpriority, o_orderdate, year(o_orderdate) AS yr, month(o_orderdate) AS mon FROM orders),
base AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderdate FROM o),
theirs AS (
  SELECT o_orderkey, o_custkey,
         CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' THEN 'S'
              WHEN o_orderstatus = 'F' AND o_orderpriority = '4-NOT SPECIFIED' AND yr = 1996 THEN 'X'
              WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AND yr = 1999 AND mon > 6 THEN 'X'
              ELSE o_orderstatus END AS o_orderstatus,
         CAST(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN o_totalprice + 100
              ELSE o_totalprice END AS DECIMAL(18,2)) AS o_totalprice,
         o_orderpriority, o_orderdate
  FROM o WHERE NOT (o_orderpriority = '5-LOW' AND yr = 1998)
  UNION ALL
  SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderdate
  FROM o WHERE yr = 2001 AND o_orderpriority = '1-URGENT'),
ours AS (
  SELECT o_orderkey, o_custkey,
         CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' THEN 'S' ELSE o_orderstatus END AS o_orderstatus,
         CAST(CASE WHEN o_orderpriority = '1-URGENT' AND yr = 1999 THEN o_totalprice + 50
              ELSE o_totalprice END AS DECIMAL(18,2)) AS o_totalprice,
         CASE WHEN yr = 1998 AND o_orderstatus = 'F' THEN '9-OURS' ELSE o_orderpriority END AS o_orderpriority, o_orderdate
  FROM o WHERE NOT (o_orderpriority = '1-URGENT' AND yr = 2000)
  UNION ALL
  SELECT -o_orderkey - 1, o_custkey, 'Z', o_totalprice, o_orderpriority, o_orderdate
  FROM o WHERE yr = 2001 AND o_orderstatus = 'F')"""


# --- customers: a second table of the same branches ---------------------------


def customer_branches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(main, branch) versions of customer."""
    c = table(spark, sf_dir, "customer")
    main = c.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal")
    branch = main.where(
        ~((F.col("c_mktsegment") == "FURNITURE") & (F.col("c_nationkey") == 3))
    ).withColumn(
        "c_mktsegment",
        F.when(F.col("c_nationkey") == 7, "ENERGY").otherwise(F.col("c_mktsegment")),
    )
    return main, branch


CUSTOMER_BRANCHES = """
cmain AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment, c_acctbal FROM customer),
cbranch AS (
  SELECT c_custkey, c_name, c_nationkey,
         CASE WHEN c_nationkey = 7 THEN 'ENERGY' ELSE c_mktsegment END AS c_mktsegment, c_acctbal
  FROM cmain WHERE NOT (c_mktsegment = 'FURNITURE' AND c_nationkey = 3))"""


# --- definitions per table, from part -------------------------------------------


def definitions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(source, target) definition tables ``table, name, definition``."""
    p = table(spark, sf_dir, "part")
    named = p.select(
        F.col("p_brand").alias("table"),
        F.concat(F.lit("idx_"), F.col("p_partkey").cast("string")).alias("name"),
        F.col("p_type").alias("definition"),
        "p_size",
        "p_name",
    )
    keep = ["table", "name", "definition"]
    source = named.where((F.col("p_size") < 45) | (F.col("table") == "Brand#1")).select(*keep)
    target = named.where((F.col("p_size") >= 8) | (F.col("table") == "Brand#1")).withColumn(
        "definition",
        F.when(
            F.col("p_name").startswith("red") & (F.col("table") != "Brand#1"),
            F.concat("definition", F.lit("_V2")),
        ).otherwise(F.col("definition")),
    ).select(*keep)
    return source, target


DEFINITIONS = """
named AS (SELECT p_brand AS "table", 'idx_' || p_partkey AS name, p_type AS definition, p_size, p_name FROM part),
dsrc AS (SELECT "table", name, definition FROM named WHERE p_size < 45 OR "table" = 'Brand#1'),
dtgt AS (SELECT "table", name,
                CASE WHEN p_name LIKE 'red%' AND "table" <> 'Brand#1' THEN definition || '_V2' ELSE definition END AS definition
         FROM named WHERE p_size >= 8 OR "table" = 'Brand#1'),
dstat AS (
  SELECT coalesce(s."table", t."table") AS "table", coalesce(s.name, t.name) AS name,
         CASE WHEN t.name IS NULL THEN 'added' WHEN s.name IS NULL THEN 'removed'
              WHEN s.definition IS DISTINCT FROM t.definition THEN 'modified' ELSE 'unchanged' END AS change,
         s.definition AS source_body, t.definition AS target_body
  FROM dsrc s FULL OUTER JOIN dtgt t ON s."table" = t."table" AND s.name = t.name)"""
