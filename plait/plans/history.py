"""Commit graphs, time travel, blame, cherry-pick, drift and deploy requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.ordered import previous_value
from ..operators import changes, graph as g, history as h, merge as m, query as q
from ..session import written
from .reading import _BRANCHES, _HISTORY, branch_records, history_rows
from .tables import CHUNK_ROWS, KEYS, MONEY, ORDER_COLUMNS, table
from .updating import ACCOUNT, LOG, account_log

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# --- a commit graph from region, nation, customer and orders ---------------------------
# Regions are roots, nations branch off them, each customer is a branch whose
# orders are its commits; an urgent order merges the nation's commit again.

GRAPH = """
chain AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate, o_orderstatus,
                 lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders),
commits AS (
  SELECT 'R' || r_regionkey AS hash, 'main' AS branch, CAST(NULL AS VARCHAR) AS p1, CAST(NULL AS VARCHAR) AS p2,
         TIMESTAMP '1990-01-01' AS ts FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'main', 'R' || n_regionkey, NULL, TIMESTAMP '1990-01-01' + INTERVAL (n_nationkey + 1) DAY FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'b' || c_custkey, 'N' || c_nationkey, NULL, TIMESTAMP '1994-01-01' FROM customer
  UNION ALL SELECT 'O' || o_orderkey, 'b' || o_custkey, coalesce('O' || prev, 'C' || o_custkey),
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'N' || c_nationkey END, o_orderdate
  FROM chain JOIN customer ON o_custkey = c_custkey),
heads AS (SELECT 'b' || c_custkey AS branch, c_custkey, coalesce('O' || max(o_orderkey), 'C' || c_custkey) AS hash
          FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)"""


def _id(prefix: str, column: str) -> F.Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def commit_graph(spark, sf) -> DataFrame:
    def stamp(text):
        return F.lit(text).cast("timestamp_ntz")

    none = F.array().cast("array<string>")
    regions = table(spark, sf, "region").select(
        _id("R", "r_regionkey").alias("hash"), F.lit("main").alias("branch"),
        none.alias("parents"), stamp("1990-01-01").alias("ts"), F.lit(0).cast("long").alias("generation"),
    )
    nations = table(spark, sf, "nation").select(
        _id("N", "n_nationkey"), F.lit("main"), F.array(_id("R", "n_regionkey")),
        stamp("1990-01-01") + F.expr("make_dt_interval(n_nationkey + 1)"), F.lit(1).cast("long"),
    )
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    firsts = customers.select(
        _id("C", "c_custkey"), _id("b", "c_custkey"), F.array(_id("N", "c_nationkey")), stamp("1994-01-01"),
        F.lit(2).cast("long"),
    )
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate"
    )
    chunk = F.floor(F.col("o_orderkey") / CHUNK_ROWS)
    chained = previous_value(orders, ["o_custkey"], "o_orderkey", F.col("o_orderkey"), "prev", chunk)
    linked = chained.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    first = F.coalesce(_id("O", "prev"), _id("C", "o_custkey"))
    parents = F.when(
        F.col("o_orderpriority") == "1-URGENT", F.array(first, _id("N", "c_nationkey"))
    ).otherwise(F.array(first))
    # A customer's orders follow each other by key, so the key grows along the chain.
    above = (F.col("o_orderkey") + 3).cast("long")
    steps = linked.select(_id("O", "o_orderkey"), _id("b", "o_custkey"), parents, "o_orderdate", above)
    return regions.union(nations).union(firsts).union(steps)


def graph_heads(spark, sf) -> DataFrame:
    last = (
        table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    )
    c = table(spark, sf, "customer").select("c_custkey")
    joined = c.join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select(
        _id("b", "c_custkey").alias("branch"),
        F.coalesce(_id("O", "o_orderkey"), _id("C", "c_custkey")).alias("hash"),
        "c_custkey",
    )


def _walk(start: str, both: bool) -> str:
    links = "SELECT hash, p1 AS p FROM commits WHERE p1 IS NOT NULL"
    if both:
        links += " UNION ALL SELECT hash, p2 FROM commits WHERE p2 IS NOT NULL"
    return f"""links AS ({links}),
walk(head, hash, depth) AS (SELECT hash, hash, -1 FROM ({start})
  UNION SELECT w.head, l.p, w.depth + 1 FROM walk w JOIN links l ON w.hash = l.hash)"""


@query(
    "j4_ancestors",
    f"""WITH RECURSIVE {GRAPH}, {_walk('SELECT hash FROM heads', True)}
        SELECT head, hash, min(depth) AS depth FROM walk GROUP BY head, hash""",
)
def j4(spark, sf):
    return g.ancestors(commit_graph(spark, sf), graph_heads(spark, sf))


@query(
    "j4_ancestors_max_depth",
    f"""WITH RECURSIVE {GRAPH}, {_walk('SELECT hash FROM heads', True)}
        SELECT head, hash, min(depth) AS depth FROM walk GROUP BY head, hash HAVING min(depth) <= 2""",
)
def j4_max(spark, sf):
    return g.ancestors(commit_graph(spark, sf), graph_heads(spark, sf), max_depth=2, hops=4)


@query(
    "t3_branch_heads",
    f"""WITH {GRAPH} SELECT branch, hash FROM heads UNION ALL
        SELECT 'main', arg_max(hash, ts) FROM commits WHERE branch = 'main'""",
)
def t3(spark, sf):
    pointers = graph_heads(spark, sf).select(
        F.col("branch").alias("name"), F.col("hash").alias("head_commit")
    )
    return g.branch_heads(pointers, commit_graph(spark, sf))


@query(
    "t4_log",
    f"""WITH RECURSIVE {GRAPH}, {_walk('SELECT hash FROM heads', False)}
        SELECT h.branch, w.hash, CAST(w.depth + 1 AS BIGINT) AS pos FROM walk w JOIN heads h ON w.head = h.hash WHERE w.depth < 49""",
)
def t4(spark, sf):
    return g.commit_log(commit_graph(spark, sf), graph_heads(spark, sf), limit=50)


@query(
    "t4_log_counts",
    f"""WITH RECURSIVE {GRAPH}, {_walk('SELECT hash FROM heads', False)}
        SELECT h.branch, count(*) AS commits FROM walk w JOIN heads h ON w.head = h.hash GROUP BY h.branch""",
)
def t4_count(spark, sf):
    log = g.commit_log(commit_graph(spark, sf), graph_heads(spark, sf), limit=None)
    return log.groupBy("branch").agg(F.count("*").alias("commits"))


@query(
    "t5_common_ancestor",
    f"""WITH RECURSIVE {GRAPH}, {_walk('SELECT hash FROM heads', True)},
        up AS (SELECT head, hash, min(depth) AS depth FROM walk GROUP BY head, hash),
        pairs AS (SELECT x.hash AS a, y.hash AS b FROM heads x JOIN heads y ON y.c_custkey = x.c_custkey + 1),
        both_ AS (SELECT a, b, ub.hash, ub.depth FROM pairs JOIN up ub ON ub.head = b JOIN up ua ON ua.head = a AND ua.hash = ub.hash)
        SELECT a, b, arg_min(hash, depth * 1000 + CAST(substr(hash, 2) AS BIGINT)) AS base, min(depth) AS depth FROM both_ GROUP BY a, b""",
)
def t5(spark, sf):
    heads = graph_heads(spark, sf)
    after = heads.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("hash").alias("b"))
    pairs = heads.join(after, "c_custkey").select(F.col("hash").alias("a"), "b")
    return g.common_ancestor(commit_graph(spark, sf), pairs)


@query(
    "t14_nesting_depth",
    f"""WITH RECURSIVE {GRAPH}, down(hash, depth) AS (SELECT hash, CAST(0 AS BIGINT) FROM commits WHERE p1 IS NULL
          UNION ALL SELECT c.hash, d.depth + 1 FROM down d JOIN commits c ON c.p1 = d.hash)
        SELECT hash AS name, depth, depth <= 5 AS allowed FROM down""",
)
def t14(spark, sf):
    nodes = commit_graph(spark, sf).select(
        F.col("hash").alias("name"), F.get("parents", 0).alias("parent")
    )
    return g.nesting_allowed(g.nesting_depth(nodes))


@query(
    "t6_tags",
    f"""WITH {GRAPH}, tags AS (SELECT 'v' || o_orderkey AS name, 'O' || (o_orderkey - 1) AS hash, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'F')
        SELECT t.name, t.hash, c.branch, t.created_at FROM tags t JOIN commits c ON t.hash = c.hash""",
)
def t6(spark, sf):
    tags = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(
        _id("v", "o_orderkey").alias("name"),
        F.concat(F.lit("O"), (F.col("o_orderkey") - 1).cast("string")).alias("hash"),
        F.col("o_orderdate").alias("created_at"),
    )
    commits = commit_graph(spark, sf).select("hash", "branch")
    return tags.join(commits, "hash").select("name", "hash", "branch", "created_at").orderBy(
        F.desc("created_at"), F.desc("name")
    )


@query(
    "j6_as_of",
    f"""WITH {GRAPH}, probes AS (SELECT l_orderkey, l_partkey, l_linenumber, 'b' || l_partkey AS branch, l_shipdate AS "at" FROM lineitem),
        latest AS (SELECT branch, ts, max(hash) AS hash FROM commits GROUP BY branch, ts)
        SELECT p.*, c.hash FROM probes p ASOF LEFT JOIN latest c ON p.branch = c.branch AND p."at" >= c.ts""",
)
def j6(spark, sf):
    probes = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", _id("b", "l_partkey").alias("branch"),
        F.col("l_shipdate").alias("at"),
    )
    graph = written(commit_graph(spark, sf), "graph")
    return h.resolve_as_of(graph, probes).drop("ts")


@query(
    "j6_as_of_null_time",
    f"""WITH {GRAPH}, probes AS (SELECT l_orderkey, l_linenumber, 'b' || l_partkey AS branch,
          CASE WHEN l_linenumber <> 3 THEN l_shipdate END AS "at" FROM lineitem),
        latest AS (SELECT branch, ts, max(hash) AS hash FROM commits GROUP BY branch, ts)
        SELECT p.*, c.hash FROM probes p ASOF LEFT JOIN latest c ON p.branch = c.branch AND p."at" >= c.ts""",
)
def j6_null(spark, sf):
    probes = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", _id("b", "l_partkey").alias("branch"),
        F.when(F.col("l_linenumber") != 3, F.col("l_shipdate")).alias("at"),
    )
    return h.resolve_as_of(commit_graph(spark, sf), probes).drop("ts")


@query(
    "j7_ever_existed",
    """SELECT 'b' || c_custkey AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""",
)
def j7(spark, sf):
    names = table(spark, sf, "customer").select(_id("b", "c_custkey").alias("name"))
    return h.ever_existed(names, _reflog(spark, sf))


# --- versions of orders along a commit history -------------------------------------------

# Hash, branch, author, time and position on the first-parent chain of m1.
HISTORY = [
    ("m1", "dev", "merger", "2024-01-06", 0),
    ("c4", "dev", "dave", "2024-01-05", 1),
    ("c3", "dev", "carol", "2024-01-04", 2),
    ("c2", "dev", "bob", "2024-01-03", 3),
    ("c1", "dev", "alice", "2024-01-02", 4),
    ("c0", "main", "system", "2024-01-01", 5),
]


def order_versions(spark, sf) -> dict[str, DataFrame]:
    o = table(spark, sf, "orders").withColumn(
        "o_totalprice", F.col("o_totalprice").cast(MONEY)
    )
    st, pr, yr, price = (
        F.col("o_orderstatus"), F.col("o_orderpriority"), F.year("o_orderdate"), F.col("o_totalprice")
    )
    c0 = o
    c1 = c0.withColumn("o_orderstatus", F.when((st == "O") & (pr == "2-HIGH"), "S").otherwise(st))
    c2 = c1.withColumn(
        "o_totalprice",
        F.when((pr == "1-URGENT") & (st == "P"), price + 100).otherwise(price).cast(MONEY),
    )
    reissued = o.where((yr == 2001) & (pr == "1-URGENT")).withColumn(
        "o_orderkey", -F.col("o_orderkey") - 1
    )
    c3 = c2.unionByName(reissued)
    s1 = c1.withColumn("o_orderpriority", F.when((yr == 1998) & (st == "F"), "9-SIDE").otherwise(pr))
    c4 = c3.where(~((pr == "5-LOW") & (yr == 1998))).withColumn(
        "o_totalprice",
        F.when((pr == "1-URGENT") & (yr == 1999), price + 50).otherwise(price).cast(MONEY),
    )
    found = {n: df.select(*ORDER_COLUMNS) for n, df in
             (("c0", c0), ("c1", c1), ("c2", c2), ("c3", c3), ("s1", s1), ("c4", c4))}
    found["m1"] = m.merge3(found["c1"], found["c4"], found["s1"], KEYS, strategy="ours")
    return found


_LIST = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderdate"
VERSIONS = f"""
v0 AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice, o_orderpriority, o_orderdate,
       year(o_orderdate) AS yr FROM orders),
v1 AS (SELECT * REPLACE (CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' THEN 'S' ELSE o_orderstatus END AS o_orderstatus) FROM v0),
v2 AS (SELECT * REPLACE (CAST(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN o_totalprice + 100 ELSE o_totalprice END AS DECIMAL(18,2)) AS o_totalprice) FROM v1),
v3 AS (SELECT * FROM v2 UNION ALL SELECT * REPLACE (-o_orderkey - 1 AS o_orderkey) FROM v0 WHERE yr = 2001 AND o_orderpriority = '1-URGENT'),
v4 AS (SELECT * REPLACE (CAST(CASE WHEN o_orderpriority = '1-URGENT' AND yr = 1999 THEN o_totalprice + 50 ELSE o_totalprice END AS DECIMAL(18,2)) AS o_totalprice)
       FROM v3 WHERE NOT (o_orderpriority = '5-LOW' AND yr = 1998)),
v5 AS (SELECT * REPLACE (CASE WHEN yr = 1998 AND o_orderstatus = 'F' THEN '9-SIDE' ELSE o_orderpriority END AS o_orderpriority) FROM v4)"""


@query("t7_find_at_hash", f"WITH {VERSIONS} SELECT {_LIST} FROM v3 WHERE o_orderstatus = 'S'")
def t7(spark, sf):
    return q.find_exact(order_versions(spark, sf)["c3"], {"o_orderstatus": "S"})


@query("t7_merge_commit", f"WITH {VERSIONS} SELECT {_LIST} FROM v5")
def t7_merge(spark, sf):
    return order_versions(spark, sf)["m1"]


@query(
    "t7_table_at_time",
    f"""WITH {LOG} SELECT user_id, arg_max_null(after, seq) AS balance FROM log WHERE ts <= TIMESTAMP '2024-01-02 12:00:00'
        GROUP BY user_id HAVING arg_max_null(after, seq) IS NOT NULL""",
)
def t7_time(spark, sf):
    at = F.lit("2024-01-02 12:00:00").cast("timestamp_ntz")
    return h.table_at(account_log(spark, sf), ACCOUNT, at)


def _blame_sql() -> str:
    fields = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate"]
    rows = " UNION ALL ".join(
        f"SELECT {pos} AS pos, o_orderkey, '{f}' AS field, CAST({f} AS VARCHAR) AS value FROM v{v}"
        for v, pos in ((5, 0), (4, 1), (3, 2), (2, 3), (1, 4), (0, 5))
        for f in fields
    )
    info = ", ".join(f"({p}, '{x}', '{a}')" for x, _, a, _, p in HISTORY)
    return f"""WITH {VERSIONS}, cells AS ({rows}),
runs AS (SELECT *, pos - row_number() OVER w AS grp, first_value(pos) OVER w AS p0 FROM cells
         WINDOW w AS (PARTITION BY o_orderkey, field ORDER BY pos)),
seen AS (SELECT *, lead(value) OVER (PARTITION BY o_orderkey, field ORDER BY pos) AS older,
                lead(pos) OVER (PARTITION BY o_orderkey, field ORDER BY pos) AS older_pos
         FROM runs WHERE grp = p0 - 1),
edits AS (SELECT o_orderkey, field, value, older_pos - 1 AS pos FROM seen WHERE older_pos IS NOT NULL AND value <> older),
made AS (SELECT o_orderkey, field, coalesce(max(pos) FILTER (pos < 5), max(pos)) AS pos FROM cells GROUP BY ALL),
origin AS (SELECT s.o_orderkey, s.field, s.value, d.pos FROM seen s JOIN made d USING (o_orderkey, field)
           WHERE s.older_pos IS NULL AND NOT EXISTS (SELECT 1 FROM edits e WHERE e.o_orderkey = s.o_orderkey AND e.field = s.field)),
info(pos, hash, author) AS (VALUES {info})
SELECT o_orderkey, field, value, hash, author FROM (SELECT * FROM edits UNION ALL SELECT * FROM origin) JOIN info USING (pos)"""


@query("t9_blame", _blame_sql())
def t9(spark, sf):
    found = order_versions(spark, sf)
    stacked = h.stack_versions([(pos, found[x]) for x, _, _, _, pos in HISTORY])
    chain = spark.createDataFrame(
        [(pos, x, branch, author, ts) for x, branch, author, ts, pos in HISTORY],
        "pos int, hash string, branch string, author string, ts string",
    )
    spans = [(pos, pos, pos if branch == "dev" else None) for _, branch, _, _, pos in HISTORY]
    return h.blame(stacked, chain, KEYS, "dev", spans).drop("pos", "ts")


_CHERRY = """SELECT coalesce(t.o_orderkey, n.o_orderkey) AS o_orderkey, {cols}
  FROM {target} t FULL OUTER JOIN {new} n ON t.o_orderkey = n.o_orderkey FULL OUTER JOIN {old} o
    ON coalesce(t.o_orderkey, n.o_orderkey) = o.o_orderkey
  WHERE (n.o_orderkey IS NOT NULL AND (o.o_orderkey IS NULL OR {diff})) OR
        (t.o_orderkey IS NOT NULL AND NOT (n.o_orderkey IS NULL AND o.o_orderkey IS NOT NULL))"""


def _cherry_sql(target: str, old: str, new: str) -> str:
    fields = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate"]
    diff = "(" + " OR ".join(f"n.{f} IS DISTINCT FROM o.{f}" for f in fields) + ")"
    taken = f"n.o_orderkey IS NOT NULL AND (o.o_orderkey IS NULL OR {diff})"
    cols = ", ".join(f"CASE WHEN {taken} THEN n.{f} ELSE t.{f} END AS {f}" for f in fields)
    body = _CHERRY.format(cols=cols, target=target, new=new, old=old, diff=diff)
    return f"WITH {VERSIONS} {body}"


@query("t10_cherry_pick", _cherry_sql("v0", "v1", "v2"))
def t10(spark, sf):
    v = order_versions(spark, sf)
    return h.cherry_pick(v["c0"], v["c1"], v["c2"], KEYS)


@query("t10_cherry_pick_delete", _cherry_sql("v1", "v3", "v4"))
def t10_delete(spark, sf):
    v = order_versions(spark, sf)
    return h.cherry_pick(v["c1"], v["c3"], v["c4"], KEYS)


@query(
    "t10_cherry_pick_counts",
    f"""WITH {VERSIONS} SELECT (SELECT count(*) FROM v4 WHERE o_orderkey NOT IN (SELECT o_orderkey FROM v3)) AS rows_added,
        (SELECT count(*) FROM v3 WHERE o_orderkey NOT IN (SELECT o_orderkey FROM v4)) AS rows_removed,
        (SELECT count(*) FROM v3 JOIN v4 USING (o_orderkey) WHERE v3.o_totalprice <> v4.o_totalprice) AS rows_modified""",
)
def t10_counts(spark, sf):
    v = order_versions(spark, sf)
    return h.cherry_pick_counts(v["c3"], v["c4"], KEYS)


@query("t11_revert", _cherry_sql("v3", "v2", "v1"))
def t11(spark, sf):
    v = order_versions(spark, sf)
    return h.revert(v["c3"], v["c1"], v["c2"], KEYS)


# --- branch records, reflog, history -------------------------------------------------------


@query(
    "t14_expiry",
    f"""WITH {_BRANCHES} SELECT name, CAST(CASE WHEN status = 'merged' THEN TIMESTAMP '2000-01-01 01:30:00' WHEN status = 'deleted' THEN NULL
        ELSE expires_at END AS VARCHAR) AS expires_at FROM branches""",
)
def t14_expiry(spark, sf):
    now = F.lit("2000-01-01").cast("timestamp_ntz")
    b = h.extend_expiry(branch_records(spark, sf), F.col("status") == "merged", now, 90)
    cleared = h.clear_expiry(b, F.col("status") == "deleted")
    return cleared.select("name", F.col("expires_at").cast("string").alias("expires_at"))


@query(
    "t15_expired_branches",
    f"WITH {_BRANCHES} SELECT name FROM branches WHERE expires_at <= TIMESTAMP '1998-06-01'",
)
def t15(spark, sf):
    now = F.lit("1998-06-01").cast("timestamp_ntz")
    return h.expired(branch_records(spark, sf), "expires_at", now).select("name")


@query(
    "t15_retention",
    f"WITH {LOG} SELECT seq, user_id FROM log WHERE ts >= TIMESTAMP '2024-02-02' - INTERVAL 30 DAY",
)
def t15_log(spark, sf):
    now = F.lit("2024-02-02").cast("timestamp_ntz")
    return h.retained(account_log(spark, sf), "ts", now, h.RETENTION["changelog"]).select(
        "seq", "user_id"
    )


@query(
    "t17_materialized_status",
    """WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS own, ['blue', 'bolt', 'red', 'ring'] AS every FROM part)
       SELECT p_partkey AS name, array_to_string([x for x in every if NOT list_contains(own, x)], ',') AS pending FROM t""",
)
def t17(spark, sf):
    branches = table(spark, sf, "part").select(
        F.col("p_partkey").alias("name"),
        F.split("p_name", " ").alias("materialized"),
        F.array(*[F.lit(x) for x in ("ring", "red", "bolt", "blue")]).alias("tables"),
    )
    return h.materialized_status(branches).select("name", F.array_join("pending", ",").alias("pending"))


def _reflog(spark, sf) -> DataFrame:
    action = (
        F.when(F.col("o_orderstatus") == "O", "create")
        .when(F.col("o_orderstatus") == "F", "merge")
        .otherwise("delete")
    )
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        _id("b", "o_custkey").alias("branch"),
        action.alias("action"),
        F.col("o_orderdate").alias("ts"),
    )


_REFLOG = """reflog AS (SELECT o_orderkey AS id, 'b' || o_custkey AS branch, CASE o_orderstatus WHEN 'O' THEN 'create'
  WHEN 'F' THEN 'merge' ELSE 'delete' END AS action, o_orderdate AS ts FROM orders)"""


@query(
    "t19_reflog_branch",
    f"WITH {_REFLOG} SELECT * FROM reflog WHERE branch = 'b7' ORDER BY ts DESC, id DESC LIMIT 50",
)
def t19(spark, sf):
    return h.reflog_entries(_reflog(spark, sf), branch="b7", limit=50)


@query(
    "t19_reflog_action",
    f"WITH {_REFLOG} SELECT * FROM reflog WHERE action = 'merge' ORDER BY ts DESC, id DESC LIMIT 50",
)
def t19_action(spark, sf):
    return h.reflog_entries(_reflog(spark, sf), action="merge", limit=50)


@query(
    "t19_last_state",
    f"""WITH {_REFLOG} SELECT branch, id, action, ts FROM (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY ts DESC, id DESC) AS rn
        FROM reflog) WHERE rn = 1""",
)
def t19_last(spark, sf):
    return h.last_state(_reflog(spark, sf))


@query(
    "t20_branch_history",
    f"""WITH {_HISTORY} SELECT "timestamp", "branchName", event, summary FROM hist WHERE "branchName" = 'conv-5' ORDER BY "timestamp" """,
)
def t20(spark, sf):
    return h.branch_history(history_rows(spark, sf), "conv-5")


@query(
    "t20_all_history",
    f"""WITH {_HISTORY} SELECT "timestamp", "branchName", event FROM hist ORDER BY "timestamp" DESC, "branchName" DESC LIMIT 50""",
)
def t20_all(spark, sf):
    return h.all_history(history_rows(spark, sf), limit=50).select("timestamp", "branchName", "event")


# --- drift and deploy requests ----------------------------------------------------------------

_CHANGES = "changelog AS (SELECT event_id AS seq, 'b' || user_id AS branch FROM events)"
_BASELINES = """baselines AS (SELECT 'd' || o_orderkey AS id, 'b' || o_custkey AS branch, o_orderkey AS seq, o_orderdate AS captured_at FROM orders)"""


def _changelog(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), _id("b", "user_id").alias("branch")
    )


def _baselines(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        _id("d", "o_orderkey").alias("id"),
        _id("b", "o_custkey").alias("branch"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderdate").alias("captured_at"),
    )


@query(
    "t21_drift",
    f"""WITH {_CHANGES}, {_BASELINES} SELECT b.id, b.branch,
        CASE WHEN EXISTS (SELECT 1 FROM changelog c WHERE c.branch = b.branch AND c.seq > b.seq) THEN 'drifted' ELSE 'clean' END AS status,
        CASE WHEN EXISTS (SELECT 1 FROM changelog c WHERE c.branch = b.branch AND c.seq > b.seq)
          THEN 'Branch "' || branch || '" changed since baseline "' || id || '".'
          ELSE 'No changes detected on "' || branch || '" since baseline "' || id || '".' END AS reason FROM baselines b""",
)
def t21(spark, sf):
    return h.drift(_baselines(spark, sf), _changelog(spark, sf))


@query(
    "t21_latest_baseline",
    f"""WITH {_BASELINES} SELECT branch, id, seq FROM (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY captured_at DESC, id DESC) AS rn
        FROM baselines) WHERE rn = 1""",
)
def t21_latest(spark, sf):
    return h.latest_baselines(_baselines(spark, sf)).drop("captured_at")


_REQUESTS = """requests AS (SELECT o_orderkey AS id, 'b' || o_custkey AS source, 'b' || (o_custkey % 10) AS target,
  CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'approved' ELSE 'merged' END AS status,
  o_orderkey AS approval_seq, o_orderdate AS created_at FROM orders)"""


def _requests(spark, sf) -> DataFrame:
    status = (
        F.when(F.col("o_orderstatus") == "O", "open")
        .when(F.col("o_orderstatus") == "F", "approved")
        .otherwise("merged")
    )
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        _id("b", "o_custkey").alias("source"),
        F.concat(F.lit("b"), (F.col("o_custkey") % 10).cast("string")).alias("target"),
        status.alias("status"),
        F.col("o_orderkey").alias("approval_seq"),
        F.col("o_orderdate").alias("created_at"),
    )


@query(
    "t22_stale_approvals",
    f"""WITH {_CHANGES}, {_REQUESTS}, last AS (SELECT branch, max(seq) AS s FROM changelog GROUP BY branch),
        j AS (SELECT r.id, CASE WHEN s.s > approval_seq THEN 'source ' || source || ' has moved on since its approval' END AS a,
                     CASE WHEN t.s > approval_seq THEN 'target ' || target || ' has moved on since its approval' END AS b
              FROM requests r LEFT JOIN last s ON s.branch = source LEFT JOIN last t ON t.branch = target WHERE status = 'approved')
        SELECT id, concat_ws('; ', a, b) AS reason FROM j WHERE a IS NOT NULL OR b IS NOT NULL""",
)
def t22(spark, sf):
    return h.stale_approvals(_requests(spark, sf), _changelog(spark, sf))


@query(
    "t22_list_requests",
    f"WITH {_REQUESTS} SELECT id, source, target FROM requests WHERE status = 'open' AND target = 'b3'",
)
def t22_list(spark, sf):
    return h.list_requests(_requests(spark, sf), "open", "b3").select("id", "source", "target")


@query(
    "t22_duplicate_requests",
    f"""WITH {_REQUESTS} SELECT source, target, count(*) AS requests FROM requests WHERE status IN ('open', 'approved')
        GROUP BY source, target HAVING count(*) > 1""",
)
def t22_duplicates(spark, sf):
    return h.duplicate_requests(_requests(spark, sf))


@query(
    "t22_conflict_summary",
    f"""WITH {VERSIONS}, c AS (SELECT o_orderkey FROM v3 JOIN v2 USING (o_orderkey) WHERE v3.o_orderpriority = '5-LOW' AND v3.yr = 1998
          AND v3.o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 3)
        SELECT string_agg('orders/' || o_orderkey || ':_deleted', ', ' ORDER BY o_orderkey) AS summary FROM c""",
)
def t22_conflicts(spark, sf):
    v = order_versions(spark, sf)
    return m.conflict_summary(m.diff3(v["c1"], v["c4"], v["s1"], KEYS), "orders")
