"""Queries through the snapshot store, filled once per session from the given tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..session import fresh_path
from ..sources import sinks
from ..sources.store import Store
from .tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
_STORES: dict[tuple[str, str], str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _store(spark, sf) -> Store:
    """A store whose main branch holds customer and supplier."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORES:
        store = Store(spark, fresh_path(spark, "store"))
        store.init(
            {
                "customer": (table(spark, sf, "customer"), ["c_custkey"]),
                "supplier": (table(spark, sf, "supplier"), ["s_suppkey"]),
            }
        )
        _STORES[key] = store.root
    return Store(spark, _STORES[key])


def _name() -> str:
    return f"q-{uuid.uuid4().hex[:12]}"


def _edit(store: Store, branch: str) -> None:
    """Drop one segment and rename another."""
    c = store.table(branch, "customer").where("c_mktsegment <> 'FURNITURE'")
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "HOUSES").otherwise(F.col("c_mktsegment"))
    store.write(branch, "customer", c.withColumn("c_mktsegment", segment))


_EDITED = """SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSES' ELSE c_mktsegment END AS c_mktsegment, c_acctbal
  FROM customer WHERE c_mktsegment <> 'FURNITURE'"""
_PLAIN = "SELECT c_custkey, c_name, c_nationkey, c_mktsegment, c_acctbal FROM customer"


_COUNTS = """SELECT 'customer' AS "table", count(*) AS row_count FROM customer
  UNION ALL SELECT 'supplier', count(*) FROM supplier"""


def _counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Each table by name with its number of rows."""
    parts = [df.agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table"), "row_count") for t, df in tables.items()]
    return reduce(DataFrame.union, parts)


@query("s1_read_branch", _EDITED)
def s1(spark, sf) -> DataFrame:
    store, name = _store(spark, sf), _name()
    store.create_branch(name, lazy=True)
    child = _name()
    store.create_branch(child, parent=name, lazy=True)
    _edit(store, name)
    return store.table(child, "customer")


@query("s2_read_commit", _EDITED)
def s2(spark, sf):
    store, name = _store(spark, sf), _name()
    store.create_branch(name)
    _edit(store, name)
    made = store.commit(name, "edit", "amy")
    store.write(name, "customer", store.table(name, "customer").limit(0))
    return store.read_at(made)["customer"]


@query(
    "s3_list_tables",
    f"{_COUNTS} UNION ALL SELECT 'nation', count(*) FROM nation",
)
def s3(spark, sf):
    store, name = _store(spark, sf), _name()
    store.create_branch(name, lazy=True)
    store.write(name, "nation", table(spark, sf, "nation"), ["n_nationkey"])
    return _counts({t: store.table(name, t) for t in store.list_tables(name)})


@query("s4_copy_table", _PLAIN)
def s4(spark, sf):
    path = fresh_path(spark, "copy")
    sinks.copy_table(_store(spark, sf).table("main", "customer"), path)
    return spark.read.parquet(path)


@query("s6_replace_table", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s6(spark, sf):
    path = fresh_path(spark, "out")
    sinks.replace_table(table(spark, sf, "region"), path)
    sinks.replace_table(table(spark, sf, "nation"), path)
    return spark.read.parquet(path)


@query(
    "s10_ingest",
    f"{_PLAIN} UNION ALL SELECT -s_suppkey - 1, s_name, s_nationkey, 'SUPPLY', s_acctbal FROM supplier",
)
def s10(spark, sf):
    from ..operators.changes import insert

    store, name = _store(spark, sf), _name()
    store.create_branch(name)
    rows = store.table(name, "supplier").selectExpr(
        "-s_suppkey - 1 AS c_custkey", "s_name AS c_name", "s_nationkey AS c_nationkey",
        "'SUPPLY' AS c_mktsegment", "s_acctbal AS c_acctbal",
    )
    store.write(name, "customer", insert(store.table(name, "customer"), rows, ["c_custkey"], 1)[0])
    return store.table(name, "customer")


@query("s11_schema_only_branch", f"{_PLAIN} LIMIT 0")
def s11(spark, sf):
    store, name = _store(spark, sf), _name()
    store.create_branch(name, schema_only=True)
    return store.table(name, "customer")


@query("s12_partial_branch", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def s12(spark, sf):
    store, name = _store(spark, sf), _name()
    store.create_branch(name, tables=["supplier"])
    (only,) = store.list_tables(name)
    return store.table(name, only)


@query(
    "t1_commit_snapshot",
    f"""SELECT 'customer' AS "table", count(*) AS row_count FROM ({_EDITED})
        UNION ALL SELECT 'supplier', count(*) FROM supplier""",
)
def t1(spark, sf):
    store, name = _store(spark, sf), _name()
    store.create_branch(name)
    _edit(store, name)
    made = store.commit(name, "edit")
    entries = store.commits().where(F.col("hash") == made).select(F.explode("snapshot").alias("table", "e"))
    return entries.select("table", "e.row_count")


@query(
    "t8_tables_at",
    _COUNTS,
)
def t8(spark, sf):
    store, name = _store(spark, sf), _name()
    store.create_branch(name)
    store.write(name, "empty", table(spark, sf, "nation").limit(0), ["n_nationkey"])
    made = store.commit(name, "with an empty table")
    held = store.read_at(made)
    return _counts({t: held[t] for t in store.tables_at(name, made)})


@query(
    "d5_store_diff",
    """SELECT 'customer' AS "table", CAST(c_custkey AS VARCHAR) AS "key",
       CASE c_mktsegment WHEN 'BUILDING' THEN 'modified' ELSE 'removed' END AS change
       FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')""",
)
def d5(spark, sf):
    store, name = _store(spark, sf), _name()
    store.create_branch(name)
    _edit(store, name)
    return store.diff(name, "main")


@query(
    "m5_store_merge",
    _EDITED.replace("c_nationkey,", "CASE WHEN c_mktsegment = 'MACHINERY' THEN 99 ELSE c_nationkey END AS c_nationkey,"),
)
def m5(spark, sf):
    store, source, target = _store(spark, sf), _name(), _name()
    store.create_branch(source)
    store.create_branch(target)
    _edit(store, source)
    store.commit(source, "segments")
    c = store.table(target, "customer")
    moved = F.when(F.col("c_mktsegment") == "MACHINERY", 99).otherwise(F.col("c_nationkey"))
    store.write(target, "customer", c.withColumn("c_nationkey", moved))
    store.commit(target, "nations")
    store.merge(source, target)
    return store.table(target, "customer")


@query("t12_checkpoint_restore", _PLAIN)
def t12(spark, sf):
    store, name = _store(spark, sf), _name()
    store.create_branch(name)
    point = store.checkpoint(name, "before")
    _edit(store, name)
    store.restore(name, point)
    return store.table(name, "customer")


@query("t13_stash_pop", _EDITED)
def t13(spark, sf):
    store, name = _store(spark, sf), _name()
    store.create_branch(name)
    _edit(store, name)
    store.stash(name, "later")
    store.pop_stash(name)
    return store.table(name, "customer")


@query("c12_reset_to_parent", _PLAIN)
def c12(spark, sf):
    store, name = _store(spark, sf), _name()
    store.create_branch(name)
    _edit(store, name)
    store.reset_to_parent(name)
    return store.table(name, "customer")


@query(
    "t16_garbage",
    f"""WITH e AS ({_EDITED}) SELECT c_mktsegment, count(*) AS "rows" FROM e GROUP BY c_mktsegment
        UNION ALL SELECT 'NOTHING', count(*) FROM supplier WHERE s_suppkey < 0""",
)
def t16(spark, sf):
    """The rows of the folders that only a deleted branch referred to."""
    store, name = _store(spark, sf), _name()
    store.create_branch(name, tables=["customer"])
    # Other columns: a folder of its own, not a change set in the log.
    _edit(store, name)
    store.write(name, "customer", store.table(name, "customer").withColumn("note", F.lit(name)))
    store.delete_branch(name)
    folders = [r["path"] for r in store.garbage().where("table = 'customer'").collect()]
    rows = spark.read.option("mergeSchema", True).parquet(*folders).where(F.col("note") == name)
    counts = rows.groupBy("c_mktsegment").agg(F.count("*").alias("rows"))
    kept = store.table("main", "supplier").where("s_suppkey < 0").agg(F.count("*").alias("rows"))
    return counts.union(kept.select(F.lit("NOTHING"), "rows"))
