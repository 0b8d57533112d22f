"""Filters, projections, lookups, groups, windows, sets and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import predicates as p, text as tx
from ..operators import query as q
from ..sources import sinks
from .tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# --- filters and projections ----------------------------------------------------


@query(
    "f1_find",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'
       ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
)
def f1(spark, sf) -> DataFrame:
    found = q.find(
        table(spark, sf, "orders"),
        F.col("o_orderstatus") == "F",
        [F.desc("o_totalprice"), "o_orderkey"],
        100,
    )
    return found.select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "f2_match_conjunction",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '2-HIGH'",
)
def f2(spark, sf):
    o = table(spark, sf, "orders")
    return q.find(o, (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "2-HIGH")).select(
        "o_orderkey"
    )


@query(
    "f3_comparisons",
    """SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'F'
       AND o_totalprice > 1000 AND o_totalprice <= 400000 AND o_custkey >= 3 AND o_orderdate < TIMESTAMP '2000-01-01'""",
)
def f3(spark, sf):
    o = table(spark, sf, "orders")
    return q.find(
        o,
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
        & p.not_equal(F.col("o_orderstatus"), "F")
        & (F.col("o_totalprice") > 1000)
        & (F.col("o_totalprice") <= 400000)
        & (F.col("o_custkey") >= 3)
        & (F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz")),
    ).select("o_orderkey")


_LABELED = """labeled AS (SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _labeled(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return docs.join(table(spark, sf, "labels"), "doc_id", "left")


@query(
    "f3_not_equal_keeps_missing",
    f"WITH {_LABELED} SELECT doc_id FROM labeled WHERE quality IS DISTINCT FROM 1",
)
def f3_ne(spark, sf):
    return _labeled(spark, sf).where(p.not_equal(F.col("quality"), 1)).select("doc_id")


@query(
    "f4_logical",
    f"""WITH {_LABELED} SELECT doc_id FROM labeled
        WHERE (quality IS NULL OR quality NOT IN (0)) AND NOT (coalesce(toxic = 1, false) AND coalesce(quality = 1, false))
          AND NOT (coalesce(toxic = 1, false) OR coalesce(quality = 0, false))""",
)
def f4(spark, sf):
    quality, toxic = F.col("quality"), F.col("toxic")
    return (
        _labeled(spark, sf)
        .where(
            p.not_in(quality, [0])
            & p.negate(p.all_of(toxic == 1, quality == 1))
            & p.none_of(toxic == 1, quality == 0)
        )
        .select("doc_id")
    )


@query(
    "f5_exists",
    f"WITH {_LABELED} SELECT doc_id, quality IS NOT NULL AS has_quality FROM labeled",
)
def f5(spark, sf):
    return _labeled(spark, sf).select("doc_id", F.col("quality").isNotNull().alias("has_quality"))


@query(
    "f5_exists_in_document",
    """SELECT event_id, event_type = 'purchase' AS has_amount, json_extract_string(props, '$.k') IS NOT NULL AS has_k FROM events""",
)
def f5_json(spark, sf):
    docs = _documents(spark, sf)
    return docs.select(
        "event_id",
        p.json_has(F.col("doc"), "amount").alias("has_amount"),
        p.json_has(F.col("props"), "k").alias("has_k"),
    )


def _documents(spark, sf):
    """Events as free-form JSON documents whose fields vary by event type."""
    e = table(spark, sf, "events")
    doc = F.to_json(
        F.struct(
            F.col("event_type").alias("kind"),
            F.when(F.col("event_type") == "purchase", F.col("user_id")).alias("amount"),
            F.when(F.col("event_type") == "click", F.array("user_id")).alias("path"),
            F.when(F.col("event_type") == "error", F.struct("user_id")).alias("detail"),
            F.when(F.col("event_type") == "view", F.col("user_id") > 5)
            .otherwise(F.lit(None).cast("boolean"))
            .alias("seen"),
        )
    )
    return e.select("event_id", "event_type", "user_id", "props", doc.alias("doc"))


@query(
    "f6_type_expr_mod_regex",
    """SELECT event_id, CASE event_type WHEN 'purchase' THEN 'number' END AS amount_type,
       CASE event_type WHEN 'click' THEN 'array' END AS path_type
       FROM events WHERE event_type IN ('purchase', 'click', 'view') AND regexp_matches(event_type, '^[cpv].*[ewk]$')
       AND user_id % 5 = 2 AND event_id > user_id""",
)
def f6(spark, sf):
    docs = _documents(spark, sf).where(
        F.col("event_type").isin("purchase", "click", "view")
        & F.rlike("event_type", F.lit("^[cpv].*[ewk]$"))
        & p.remainder_is(F.col("user_id"), 5, 2)
        & (F.col("event_id") > F.col("user_id"))
    )
    return docs.select(
        "event_id",
        p.json_type(F.col("doc"), "amount").alias("amount_type"),
        p.json_type(F.col("doc"), "path").alias("path_type"),
    )


@query(
    "f7_array_predicates",
    """WITH d AS (SELECT doc_id, string_split(text, ' ') AS words FROM documents)
       SELECT doc_id, list_has_all(words, ['the', 'of']) AS has_all, len([w for w in words if length(w) > 12]) > 0 AS has_long,
              len(words) = 40 AS forty FROM d""",
)
def f7(spark, sf):
    words = F.split("text", " ", -1)
    return table(spark, sf, "documents").select(
        "doc_id",
        p.contains_all(words, ["the", "of"]).alias("has_all"),
        p.any_element(words, lambda w: F.length(w) > 12).alias("has_long"),
        p.has_size(words, 40).alias("forty"),
    )


@query(
    "f8_dotted_path",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events
       WHERE CAST(json_extract_string(props, '$.k') AS INT) >= 50""",
)
def f8(spark, sf):
    e = table(spark, sf, "events").withColumn("props", F.from_json("props", "k int"))
    return e.where(F.col("props.k") >= 50).select("event_id", F.col("props.k").alias("k"))


@query("f9_project", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def f9(spark, sf):
    return table(spark, sf, "customer").drop("c_acctbal", "c_nationkey")


@query(
    "f10_add_fields",
    "SELECT p_partkey, split_part(p_name, ' ', 2) AS noun, NULLIF(split_part(p_name, ' ', 9), '') AS ninth FROM part",
)
def f10(spark, sf):
    words = F.split("p_name", " ")
    return (
        table(spark, sf, "part")
        .withColumn("noun", F.get(words, 1))
        .withColumn("ninth", F.get(words, 8))
        .select("p_partkey", "noun", "ninth")
    )


@query(
    "f11_exact_match",
    f"WITH {_LABELED} SELECT doc_id FROM labeled WHERE quality IS NOT DISTINCT FROM NULL AND toxic IS NOT DISTINCT FROM NULL",
)
def f11(spark, sf):
    return q.find_exact(_labeled(spark, sf), {"quality": None, "toxic": None}).select("doc_id")


@query(
    "f12_conditions",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'kept' END AS fate,
       CASE WHEN l_partkey < l_suppkey THEN -1 WHEN l_partkey = l_suppkey THEN 0 ELSE 1 END AS cmp FROM lineitem""",
)
def f12(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.when(F.col("l_returnflag") == "R", "returned").otherwise("kept").alias("fate"),
        p.order_of(F.col("l_partkey"), F.col("l_suppkey")).alias("cmp"),
    )


@query(
    "f13_sample",
    "SELECT least(100, count(*)) AS rows, least(100, count(*)) AS known, least(100, count(*)) AS keys FROM orders",
)
def f13(spark, sf):
    """How large a sample is, how many of its rows are orders, and how many keys it has."""
    orders = table(spark, sf, "orders")
    drawn = q.sample_rows(orders, 100, seed=7)
    known = drawn.join(orders.select("o_orderkey", F.col("o_custkey").alias("__c")), "o_orderkey").where("o_custkey = __c")
    return drawn.agg(F.count("*").alias("rows"), F.countDistinct("o_orderkey").alias("keys")).join(
        known.agg(F.count("*").alias("known"))
    )


# --- lookups ----------------------------------------------------------------------


@query(
    "j1_lookup_counts",
    """SELECT c_custkey, coalesce(count(o_orderkey), 0) AS orders, max(o_orderkey) AS last_order
       FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""",
)
def j1_counts(spark, sf):
    found = q.lookup_agg(
        table(spark, sf, "customer"), table(spark, sf, "orders"), "c_custkey", "o_custkey",
        orders=F.count("*"), last_order=F.max("o_orderkey"),
    )
    return found.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), "last_order")


@query(
    "j1_lookup",
    """SELECT n_nationkey, n_name, CAST(count(r_regionkey) AS INT) AS regions, max(r_name) AS region
       FROM nation LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def j1(spark, sf):
    found = q.lookup(
        table(spark, sf, "nation"), table(spark, sf, "region"), "n_regionkey", "r_regionkey", "r"
    )
    return found.select(
        "n_nationkey", "n_name", F.size("r").alias("regions"), F.get("r", 0)["r_name"].alias("region")
    )


@query(
    "j1_lookup_first",
    """SELECT c_custkey, min(o_orderkey) AS first_order, arg_min(o_orderpriority, o_orderkey) AS first_priority
       FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""",
)
def j1_first(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    found = q.lookup_one(
        table(spark, sf, "customer"), orders, "c_custkey", "o_custkey", "o", "o_orderkey"
    )
    return found.select(
        "c_custkey",
        F.col("o.o_orderkey").alias("first_order"),
        F.col("o.o_orderpriority").alias("first_priority"),
    )


@query(
    "j2_lookup_unwind",
    """SELECT c_custkey, c_name, o_orderkey, o_orderstatus FROM customer LEFT JOIN orders ON c_custkey = o_custkey""",
)
def j2(spark, sf):
    rows = q.lookup_rows(
        table(spark, sf, "customer"), table(spark, sf, "orders"), "c_custkey", "o_custkey"
    )
    return rows.select("c_custkey", "c_name", "o_orderkey", "o_orderstatus")


@query(
    "j3_join_inner_anti_full",
    """SELECT 'inner' AS kind, count(*) AS rows FROM customer JOIN orders ON c_custkey = o_custkey
       UNION ALL SELECT 'anti', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
       UNION ALL SELECT 'full', count(*) FROM customer FULL OUTER JOIN orders ON c_custkey = o_custkey""",
)
def j3(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    parts = [
        c.join(o, "c_custkey", how).agg(F.count("*").alias("rows")).select(
            F.lit(kind).alias("kind"), "rows"
        )
        for kind, how in (("inner", "inner"), ("anti", "left_anti"), ("full", "full_outer"))
    ]
    return parts[0].union(parts[1]).union(parts[2])


# --- aggregation --------------------------------------------------------------------


@query(
    "a1_group_all",
    """SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean, count(*) AS orders
       FROM orders WHERE o_orderstatus = 'F' HAVING count(*) > 0""",
)
def a1(spark, sf):
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return q.group_all(
        q.find(table(spark, sf, "orders"), "o_orderstatus = 'F'"),
        revenue=total,
        mean=total / F.count("*"),
        orders=F.count("*"),
    )


@query(
    "a1_group_all_empty",
    "SELECT CAST(count(*) AS BIGINT) AS orders FROM orders WHERE o_orderstatus = 'none' HAVING count(*) > 0",
)
def a1_empty(spark, sf):
    return q.group_all(
        q.find(table(spark, sf, "orders"), "o_orderstatus = 'none'"), orders=F.count("*")
    )


@query(
    "a2_group_count",
    "SELECT l_returnflag, l_linestatus, count(*) AS rows FROM lineitem GROUP BY ALL",
)
def a2(spark, sf):
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.count("*").alias("rows"))
    )


@query(
    "a3_count_stage",
    "SELECT count(*) AS n FROM events WHERE event_type = 'error' HAVING count(*) > 0",
)
def a3(spark, sf):
    return q.count_stage(q.find(table(spark, sf, "events"), "event_type = 'error'"), "n")


@query("a4_count_rows", "SELECT count(*) AS rows FROM lineitem WHERE l_quantity >= 30")
def a4(spark, sf):
    return q.count_rows(table(spark, sf, "lineitem"), F.col("l_quantity") >= 30)


@query(
    "a6_infer_schema",
    """SELECT 'kind' AS field, 'string' AS types, count(*) AS rows FROM events
       UNION ALL SELECT 'amount', 'number', count(*) FROM events WHERE event_type = 'purchase'
       UNION ALL SELECT 'path', 'array', count(*) FROM events WHERE event_type = 'click'
       UNION ALL SELECT 'detail', 'object', count(*) FROM events WHERE event_type = 'error'
       UNION ALL SELECT 'seen', 'boolean', count(*) FROM events WHERE event_type = 'view'""",
)
def a6(spark, sf):
    return q.infer_schema(_documents(spark, sf).select("doc"))


@query(
    "a6_field_counts",
    """SELECT 'o_orderkey' AS field, 'number' AS type, count(o_orderkey) AS rows FROM orders
       UNION ALL SELECT 'o_custkey', 'number', count(o_custkey) FROM orders
       UNION ALL SELECT 'o_orderstatus', 'string', count(o_orderstatus) FROM orders
       UNION ALL SELECT 'o_totalprice', 'number', count(o_totalprice) FROM orders
       UNION ALL SELECT 'o_orderdate', 'date', count(o_orderdate) FROM orders
       UNION ALL SELECT 'o_orderpriority', 'string', count(o_orderpriority) FROM orders""",
)
def a6_typed(spark, sf):
    return q.field_counts(table(spark, sf, "orders"))


_NAMES = ["customer", "orders", "lineitem", "events", "documents"]


@query(
    "a7_branch_stats",
    " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS rows FROM {n}" for n in _NAMES),
)
def a7(spark, sf):
    return q.table_rows({n: table(spark, sf, n) for n in _NAMES})


@query("a7_branch_bytes")
def a7_bytes(spark, sf):
    return q.table_bytes({n: table(spark, sf, n) for n in _NAMES})


@query(
    "a10_top_groups",
    "SELECT l_suppkey, count(*) AS rows FROM lineitem GROUP BY ALL ORDER BY rows DESC, l_suppkey LIMIT 10",
)
def a10(spark, sf):
    return q.top_groups(table(spark, sf, "lineitem"), ["l_suppkey"], 10)


# --- branch records derived from orders ---------------------------------------------

_BRANCHES = """branches AS (SELECT 'b' || o_orderkey AS name, 'b' || o_custkey AS created_by,
  CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'merged' ELSE 'deleted' END AS status,
  o_orderdate AS created_at, o_orderdate + INTERVAL 2 DAY AS updated_at,
  CASE WHEN o_orderpriority = '5-LOW' THEN o_orderdate + INTERVAL 30 DAY END AS expires_at FROM orders)"""


def branch_records(spark, sf):
    status = (
        F.when(F.col("o_orderstatus") == "O", "active")
        .when(F.col("o_orderstatus") == "F", "merged")
        .otherwise("deleted")
    )
    return table(spark, sf, "orders").select(
        F.concat(F.lit("b"), F.col("o_orderkey").cast("string")).alias("name"),
        F.concat(F.lit("b"), F.col("o_custkey").cast("string")).alias("created_by"),
        status.alias("status"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 2 DAYS")).alias("updated_at"),
        F.when(
            F.col("o_orderpriority") == "5-LOW", F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")
        ).alias("expires_at"),
    )


@query(
    "a8_system_status",
    f"""WITH {_BRANCHES} SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active,
        count(*) FILTER (status = 'merged') AS merged, max(updated_at) AS latest_activity
        FROM branches WHERE status <> 'deleted'""",
)
def a8(spark, sf):
    return q.system_status(branch_records(spark, sf))


@query(
    "a9_owner_status",
    f"""WITH {_BRANCHES} SELECT created_by, count(*) AS branches, count(*) FILTER (status = 'active') AS active
        FROM branches WHERE status <> 'deleted' GROUP BY created_by""",
)
def a9(spark, sf):
    return q.owner_status(branch_records(spark, sf))


@query(
    "t18_list_branches",
    f"""WITH {_BRANCHES} SELECT name, status, created_at FROM branches WHERE status = 'merged'
        ORDER BY created_at DESC, name DESC""",
)
def t18(spark, sf):
    return q.list_branches(branch_records(spark, sf), "merged").select("name", "status", "created_at")


# --- windows, paging, sets ----------------------------------------------------------


@query(
    "w1_previous_row",
    """SELECT event_id, lag(event_type) OVER (ORDER BY event_id) AS previous FROM events""",
)
def w1(spark, sf):
    from ..functions.ordered import previous_value

    e = table(spark, sf, "events").select("event_id", "event_type")
    return previous_value(e, [], "event_id", F.col("event_type"), "previous").select(
        "event_id", "previous"
    )


@query(
    "w2_stack_positions",
    """SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) - 1 AS position FROM events""",
)
def w2(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id")
    return q.stack_positions(e, ["event_type"], "event_id").select(
        "event_type", "event_id", "position"
    )


_LAST = """SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders"""


@query("w3_keep_last", f"SELECT o_custkey, o_orderkey FROM ({_LAST}) WHERE rn <= 5")
def w3(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return q.keep_last(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], 5).drop("o_orderdate")


@query("t12_prune_checkpoints", f"SELECT o_custkey, o_orderkey FROM ({_LAST}) WHERE rn > 5")
def t12(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    gone = q.pruned(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], 5, ["o_orderkey"])
    return gone.select("o_custkey", "o_orderkey")


@query(
    "w4_rank",
    """SELECT l_returnflag, l_orderkey, l_linenumber, l_quantity, l_partkey,
       rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC) AS "rank" FROM lineitem""",
)
def w4(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_returnflag", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey"
    )
    return q.rank_rows(li, ["l_returnflag"], "l_quantity")


@query(
    "w4_rank_nulls",
    """SELECT o_orderkey, o_orderstatus, x, rank() OVER (PARTITION BY o_orderstatus ORDER BY x DESC NULLS LAST) AS "rank"
       FROM (SELECT o_orderkey, o_orderstatus, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS x FROM orders)""",
)
def w4_nulls(spark, sf):
    x = F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("x")
    return q.rank_rows(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", x), ["o_orderstatus"], "x")


@query(
    "w4_rank_date",
    """SELECT o_orderkey, o_orderpriority, o_orderdate, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS "rank" FROM orders""",
)
def w4_date(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return q.rank_rows(o, ["o_orderpriority"], "o_orderdate", descending=False)


@query(
    "w5_latest_per_group",
    """SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM (SELECT *, row_number() OVER
       (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
)
def w5(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return q.latest_per(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query(
    "w6_page",
    "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 50 OFFSET 100",
)
def w6(spark, sf):
    return q.page(table(spark, sf, "events"), ["event_id"], 100, 50).select("event_id", "event_type")


@query(
    "w7_newest",
    "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20",
)
def w7(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return q.newest(o, ["o_orderdate", "o_orderkey"], 20)


@query(
    "u1_union_with",
    """SELECT c_name AS name, c_mktsegment AS segment, c_nationkey AS nation FROM customer
       UNION ALL SELECT s_name, NULL, s_nationkey FROM supplier""",
)
def u1(spark, sf):
    c = table(spark, sf, "customer").selectExpr(
        "c_name AS name", "c_mktsegment AS segment", "c_nationkey AS nation"
    )
    s = table(spark, sf, "supplier").selectExpr("s_name AS name", "s_nationkey AS nation")
    return q.union_with(c, s)


@query(
    "u2_key_sets",
    """SELECT coalesce(a.k, b.k) AS "key", a.k IS NOT NULL AS in_a, b.k IS NOT NULL AS in_b
       FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL OUTER JOIN (SELECT DISTINCT c_custkey AS k FROM customer) b ON a.k = b.k""",
)
def u2(spark, sf):
    return q.key_sets(
        table(spark, sf, "orders").select("o_custkey"), table(spark, sf, "customer").select("c_custkey")
    )


@query(
    "u3_array_sets",
    """WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS a, ['red', 'ring', 'blue'] AS b FROM part)
       SELECT p_partkey, array_to_string([x for x in a if NOT list_contains(b, x)], ' ') AS difference,
              array_to_string([x for x in a if list_contains(b, x)], ' ') AS intersection FROM w""",
)
def u3(spark, sf):
    a = F.split("p_name", " ")
    b = F.array(F.lit("red"), F.lit("ring"), F.lit("blue"))
    return table(spark, sf, "part").select(
        "p_partkey",
        F.array_join(F.array_except(a, b), " ").alias("difference"),
        F.array_join(F.array_intersect(a, b), " ").alias("intersection"),
    )


# --- names and exports ----------------------------------------------------------------


@query(
    "v0_storage_name",
    "SELECT page_id, replace(replace(url, '/', '--'), '.', '-dot-') AS name FROM pages",
)
def storage_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.storage_name(F.col("url")).alias("name"))


@query(
    "v0_validate_name",
    r"""SELECT doc_id, CASE WHEN trim(name) = '' THEN 'empty' WHEN name = 'main' THEN 'reserved'
        WHEN NOT regexp_full_match(name, '[a-zA-Z0-9][a-zA-Z0-9._\-/]*') THEN 'invalid' END AS problem
        FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN split_part(text, ' ', 1) WHEN source = 'src1' THEN 'main'
              WHEN source = 'src5' THEN '' ELSE source || '/' || lang || '.' || doc_id END AS name FROM documents)""",
)
def validate_name(spark, sf):
    name = (
        F.when(F.col("lang") == "en", F.get(F.split("text", " "), 0))
        .when(F.col("source") == "src1", "main")
        .when(F.col("source") == "src5", "")
        .otherwise(F.concat_ws("", "source", F.lit("/"), "lang", F.lit("."), F.col("doc_id").cast("string")))
    )
    return table(spark, sf, "documents").select("doc_id", tx.name_problem(name).alias("problem"))


def history_rows(spark, sf):
    """Event history with one text per row, from conversations."""
    c = table(spark, sf, "conversations")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return c.select(
        (start + F.expr("make_dt_interval(cast(conv_id as int), cast(turn as int), 0, 0)")).alias("timestamp"),
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("branchName"),
        F.col("role").alias("event"),
        F.col("text").alias("summary"),
    )


_HISTORY = """hist AS (SELECT TIMESTAMP '2024-01-01' + INTERVAL (conv_id) DAY + INTERVAL (turn) HOUR AS "timestamp",
  'conv-' || conv_id AS "branchName", role AS event, text AS summary FROM conversations)"""


@query(
    "s7_export_json",
    f"""WITH {_HISTORY} SELECT strftime("timestamp", '%Y-%m-%dT%H:%M:%S.000Z') AS ts, "branchName" AS branch, event, summary
        FROM hist WHERE event = 'user' AND "timestamp" >= TIMESTAMP '2024-01-03' AND "timestamp" <= TIMESTAMP '2024-03-01 05:00:00'""",
)
def s7(spark, sf):
    from ..operators.history import history_rows as chosen

    rows = chosen(
        history_rows(spark, sf), event="user", since="2024-01-03", until="2024-03-01 05:00:00"
    )
    doc = F.from_json("line", "timestamp string, branchName string, event string, summary string")
    return sinks.event_json(rows).select(doc.alias("d")).select(
        F.col("d.timestamp").alias("ts"),
        F.col("d.branchName").alias("branch"),
        "d.event",
        "d.summary",
    )


@query(
    "s8_export_csv",
    f"""WITH {_HISTORY} SELECT strftime("timestamp", '%Y-%m-%dT%H:%M:%S.000Z') || ',' || "branchName" || ',' || event || ',"' ||
        replace(summary, '"', '""') || '"' AS line FROM hist""",
)
def s8(spark, sf):
    return sinks.event_csv(history_rows(spark, sf)).select("line")


@query(
    "s13_materialized_view",
    """SELECT c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN -1 ELSE count(*) END AS rows
       FROM customer GROUP BY c_mktsegment UNION ALL SELECT 'OLD', CAST(7 AS BIGINT)""",
)
def s13(spark, sf):
    counts = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("rows"))
    previous = counts.withColumn("rows", F.lit(0).cast("long")).unionByName(
        counts.agg(F.lit("OLD").alias("c_mktsegment"), F.lit(7).cast("long").alias("rows"))
    )
    fresh = counts.withColumn(
        "rows", F.when(F.col("c_mktsegment") == "BUILDING", F.lit(-1)).otherwise(F.col("rows"))
    )
    return sinks.merge_into(previous, fresh, ["c_mktsegment"])
