"""Row changes, update expressions, the change log and undo."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import updates as u
from ..functions.ordered import previous_value
from ..operators import changes as c, diff as d
from .tables import CHUNK_ROWS, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _customers(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal")


_C = "c AS (SELECT c_custkey, c_name, c_mktsegment, c_nationkey, c_acctbal FROM customer)"
KEY = ["c_custkey"]


@query(
    "c1_insert",
    f"WITH {_C} SELECT * FROM c UNION ALL SELECT -s_suppkey - 1, s_name, 'SUPPLY', s_nationkey, s_acctbal FROM supplier",
)
def c1(spark, sf):
    rows = table(spark, sf, "supplier").selectExpr(
        "-s_suppkey - 1 AS c_custkey", "s_name AS c_name", "'SUPPLY' AS c_mktsegment",
        "s_nationkey AS c_nationkey", "s_acctbal AS c_acctbal",
    )
    return c.insert(_customers(spark, sf), rows, KEY, seq=1)[0]


@query(
    "c1_insert_log",
    "SELECT CAST(1 AS BIGINT) AS seq, 'insert' AS op, -s_suppkey - 1 AS c_custkey, s_name AS name, 'amy' AS performed_by FROM supplier",
)
def c1_log(spark, sf):
    rows = table(spark, sf, "supplier").selectExpr(
        "-s_suppkey - 1 AS c_custkey", "s_name AS c_name", "'SUPPLY' AS c_mktsegment",
        "s_nationkey AS c_nationkey", "s_acctbal AS c_acctbal",
    )
    log = c.insert(_customers(spark, sf), rows, KEY, seq=1, by="amy")[1]
    return log.where("before IS NULL").select(
        "seq", "op", "c_custkey", F.col("after.c_name").alias("name"), "performed_by"
    )


@query(
    "c2_update_one",
    f"""WITH {_C} SELECT c_custkey, c_name, CASE WHEN c_custkey = (SELECT min(c_custkey) FROM c WHERE c_nationkey = 7)
        THEN 'PICKED' ELSE c_mktsegment END AS c_mktsegment, c_nationkey, c_acctbal FROM c""",
)
def c2(spark, sf):
    return c.update(
        _customers(spark, sf), F.col("c_nationkey") == 7, {"c_mktsegment": F.lit("PICKED")}, KEY,
        seq=1, one=True,
    )[0]


@query(
    "c3_delete_one",
    f"WITH {_C} SELECT * FROM c WHERE c_custkey <> (SELECT min(c_custkey) FROM c WHERE c_nationkey = 7)",
)
def c3(spark, sf):
    return c.delete(_customers(spark, sf), F.col("c_nationkey") == 7, KEY, seq=1, one=True)[0]


@query(
    "c4_update_many_counts",
    f"""WITH {_C} SELECT count(*) AS matched, count(*) FILTER (c_mktsegment <> 'BUILDING') AS modified
        FROM c WHERE c_nationkey IN (3, 7)""",
)
def c4(spark, sf):
    return c.update_counts(
        _customers(spark, sf), F.col("c_nationkey").isin(3, 7), {"c_mktsegment": F.lit("BUILDING")}
    )


@query(
    "c4_update_many_log",
    f"""WITH {_C} SELECT c_custkey, c_mktsegment AS old, 'BUILDING' AS new FROM c WHERE c_nationkey IN (3, 7)""",
)
def c4_log(spark, sf):
    _, log = c.update(
        _customers(spark, sf), F.col("c_nationkey").isin(3, 7), {"c_mktsegment": F.lit("BUILDING")},
        KEY, seq=2,
    )
    return log.select(
        "c_custkey",
        F.col("before.c_mktsegment").alias("old"),
        F.col("after.c_mktsegment").alias("new"),
    )


@query(
    "c5_set_path",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS INT) END AS k,
       event_type AS kind FROM events""",
)
def c5(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id",
        F.struct(F.from_json("props", "k int")["k"].alias("k"), F.col("event_type").alias("kind")).alias("p"),
    )
    new = c.assign(e, {"p.k": F.lit(0)}, F.col("p.kind") == "error")
    return new.select("event_id", "p.k", "p.kind")


@query(
    "c6_multiply",
    "SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN p_size * 3 ELSE p_size END AS p_size FROM part",
)
def c6(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_type", "p_size")
    new = c.assign(part, {"p_size": u.multiply(F.col("p_size"), 3)}, F.col("p_type") == "ECONOMY")
    return new.drop("p_type")


@query(
    "c7_inc_unset_push",
    """SELECT p_partkey, p_size + 5 AS p_size, CAST(NULL AS VARCHAR) AS p_brand,
       array_to_string(list_concat(string_split(p_name, ' '), ['new', 'tag']), ',') AS tags FROM part""",
)
def c7(spark, sf):
    part = table(spark, sf, "part").select(
        "p_partkey", "p_size", "p_brand", F.split("p_name", " ").alias("tags")
    )
    new = c.assign(
        part,
        {
            "p_size": u.increment(F.col("p_size"), 5),
            "p_brand": F.lit(None),
            "tags": u.push(F.col("tags"), ["new", "tag"]),
        },
        F.lit(True),
    )
    return new.withColumn("tags", F.array_join("tags", ","))


@query("c7_current_date", "SELECT p_partkey, true AS is_now FROM part")
def c7_date(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.lit(None).cast("timestamp").alias("at"))
    dated = c.assign(part, {"at": F.current_timestamp()}, F.lit(True))
    return dated.select("p_partkey", (F.col("at") == F.current_timestamp()).alias("is_now"))


@query(
    "c7_set_on_insert",
    """SELECT coalesce(c_custkey, s_suppkey) AS c_custkey, coalesce(s_name, c_name) AS c_name,
       CASE WHEN c_custkey IS NULL THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, c_nationkey, c_acctbal
       FROM (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') FULL OUTER JOIN supplier ON c_custkey = s_suppkey""",
)
def c7_insert(spark, sf):
    old = _customers(spark, sf).where("c_mktsegment <> 'BUILDING'")
    rows = table(spark, sf, "supplier").selectExpr("s_suppkey AS c_custkey", "s_name AS c_name")
    return c.upsert(old, rows, KEY, {"c_mktsegment": F.lit("NEW")})


@query(
    "c8_min_max_bit",
    """SELECT p_partkey, least(p_size, 20) AS low, greatest(p_size, 30) AS high, p_size & 12 AS b_and, p_size | 5 AS b_or,
       xor(p_size, 7) AS b_xor, p_name AS title FROM part""",
)
def c8(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey",
        u.lower_to(size, 20).alias("low"),
        u.raise_to(size, 30).alias("high"),
        u.bit_and(size, 12).alias("b_and"),
        u.bit_or(size, 5).alias("b_or"),
        u.bit_xor(size, 7).alias("b_xor"),
        F.col("p_name").alias("title"),
    )


_W = "w AS (SELECT doc_id, string_split(text, ' ') AS a FROM documents)"


@query(
    "c8_array_updates",
    f"""WITH {_W} SELECT doc_id,
        len([x for x in a if NOT starts_with(x, 't')]) AS pulled,
        len([x for x in a if x NOT IN ('the', 'of')]) AS pulled_all,
        len(a) + CASE WHEN list_contains(a, 'the') THEN 0 ELSE 1 END + CASE WHEN list_contains(a, 'zzz') THEN 0 ELSE 1 END AS with_set,
        a[2] AS popped_first, a[len(a) - 1] AS popped_last FROM w""",
)
def c8_arrays(spark, sf):
    a = F.split("text", " ", -1)
    docs = table(spark, sf, "documents").select("doc_id", a.alias("a"))
    words = F.col("a")
    return docs.select(
        "doc_id",
        F.size(u.pull(words, lambda x: F.startswith(x, F.lit("t")))).cast("long").alias("pulled"),
        F.size(u.pull_all(words, ["the", "of"])).cast("long").alias("pulled_all"),
        F.size(u.add_to_set(words, ["the", "zzz"])).cast("long").alias("with_set"),
        F.get(u.pop(words, first=True), 0).alias("popped_first"),
        F.get(u.pop(words), F.size(u.pop(words)) - 1).alias("popped_last"),
    )


@query(
    "c8_push_modifiers",
    """WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS a FROM part)
       SELECT p_partkey, array_to_string(list_concat([a[1]], ['x', 'y'], a[2:]), ',') AS placed,
       array_to_string(list_sort(list_concat(a, ['m', 'b']))[1:3], ',') AS smallest,
       array_to_string(list_concat(a, ['m', 'b'])[-2:], ',') AS newest FROM w""",
)
def c8_push(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("a"))
    a = F.col("a")
    return part.select(
        "p_partkey",
        F.array_join(u.push(a, ["x", "y"], at=1), ",").alias("placed"),
        F.array_join(u.push(a, ["m", "b"], order="asc", keep=3), ",").alias("smallest"),
        F.array_join(u.push(a, ["m", "b"], keep=-2), ",").alias("newest"),
    )


# --- operation log of accounts, from events --------------------------------------------

ACCOUNT = ["user_id"]

LOG = """
images AS (SELECT event_id AS seq, ts, user_id, 'u' || user_id AS performed_by,
  CASE WHEN event_type = 'error' THEN NULL ELSE CAST(value AS DECIMAL(18,2)) END AS after FROM events),
paired AS (SELECT *, lag(after) OVER (PARTITION BY user_id ORDER BY seq) AS before FROM images),
log AS (SELECT seq, ts, user_id, performed_by, before, after,
  CASE WHEN before IS NULL THEN 'insert' WHEN after IS NULL THEN 'delete' ELSE 'update' END AS op
  FROM paired WHERE before IS NOT NULL OR after IS NOT NULL)"""


def account_log(spark, sf) -> DataFrame:
    """Balance changes per user; images are structs ``balance``."""
    e = table(spark, sf, "events")
    balance = F.col("value").cast("decimal(18,2)")
    images = e.select(
        F.col("event_id").alias("seq"),
        "ts",
        "user_id",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("performed_by"),
        F.when(F.col("event_type") != "error", F.struct(balance.alias("balance"))).alias("after"),
    )
    chunk = F.floor(F.col("seq") / CHUNK_ROWS)
    paired = previous_value(images, ACCOUNT, "seq", F.col("after"), "before", chunk)
    op = (
        F.when(F.col("before").isNull(), c.INSERT)
        .when(F.col("after").isNull(), c.DELETE)
        .otherwise(c.UPDATE)
    )
    return paired.where("before IS NOT NULL OR after IS NOT NULL").withColumn("op", op)


@query(
    "c9_bulk_write",
    """WITH ops AS (SELECT event_id AS ord, user_id AS c_custkey, event_type FROM events),
       last AS (SELECT c_custkey, arg_max(event_type, ord) AS t, max(ord) AS ord FROM ops GROUP BY c_custkey),
       made AS (SELECT c_custkey, arg_max(event_type, ord) AS t FROM ops WHERE event_type NOT IN ('click', 'view') GROUP BY c_custkey)
       SELECT coalesce(c.c_custkey, l.c_custkey) AS c_custkey,
              CASE WHEN l.c_custkey IS NULL THEN c.c_mktsegment ELSE l.t || '-' || l.ord END AS c_mktsegment
       FROM customer c FULL OUTER JOIN last l ON c.c_custkey = l.c_custkey LEFT JOIN made m ON l.c_custkey = m.c_custkey
       WHERE l.c_custkey IS NULL OR NOT (l.t = 'error' OR coalesce(m.t = 'error', c.c_custkey IS NULL))""",
)
def c9(spark, sf):
    op = (
        F.when(F.col("event_type") == "error", c.DELETE)
        .when(F.col("event_type").isin("click", "view"), c.UPDATE)
        .when(F.col("event_type") == "signup", c.INSERT)
        .otherwise("replace")
    )
    note = F.concat_ws("-", "event_type", F.col("event_id").cast("string"))
    ops = table(spark, sf, "events").select(
        F.col("event_id").alias("ord"),
        F.col("user_id").alias("c_custkey"),
        op.alias("op"),
        F.struct(F.col("user_id").alias("c_custkey"), note.alias("c_mktsegment")).alias("row"),
    )
    base = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return c.apply_ops(base, ops, KEY)


@query(
    "c10_op_log",
    f"WITH {LOG} SELECT seq, user_id, op, after FROM log WHERE user_id = 3 ORDER BY seq",
)
def c10(spark, sf):
    return c.op_log(account_log(spark, sf), F.col("user_id") == 3).select(
        "seq", "user_id", "op", F.col("after.balance").alias("after")
    )


_SUMMARY = """count(*) FILTER (op = 'insert') AS inserts, count(*) FILTER (op = 'update') AS updates,
  count(*) FILTER (op = 'delete') AS deletes, count(*) AS total"""


@query("a5_op_summary", f"WITH {LOG} SELECT {_SUMMARY} FROM log")
def a5(spark, sf):
    return c.op_summary(account_log(spark, sf))


@query(
    "a5_op_summary_by_user",
    f"WITH {LOG} SELECT performed_by, {_SUMMARY} FROM log GROUP BY performed_by",
)
def a5_user(spark, sf):
    return c.op_summary(account_log(spark, sf), ["performed_by"])


_STATE = """SELECT user_id, arg_max_null(after, seq) AS balance FROM {log} GROUP BY user_id HAVING arg_max_null(after, seq) IS NOT NULL"""


@query("c11_replay", f"WITH {LOG} {_STATE.format(log='log')}")
def c11_replay(spark, sf):
    return c.replay(account_log(spark, sf), ACCOUNT)


@query(
    "c11_undo_last",
    f"""WITH {LOG}, kept AS (SELECT * FROM log WHERE seq NOT IN (SELECT seq FROM log ORDER BY seq DESC LIMIT 300))
        {_STATE.format(log='kept')}""",
)
def c11(spark, sf):
    log = account_log(spark, sf)
    return c.undo_last(c.replay(log, ACCOUNT), log, 300, ACCOUNT)[0]


@query(
    "c11_undo_batch",
    "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'first' ELSE c_mktsegment END AS c_mktsegment FROM customer",
)
def c11_batch(spark, sf):
    """One update of many rows is one operation."""
    old = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    once, first = c.update(old, F.col("c_mktsegment") == "BUILDING", {"c_mktsegment": F.lit("first")}, KEY, 1)
    twice, second = c.update(once, F.col("c_custkey") % 3 == 0, {"c_mktsegment": F.lit("second")}, KEY, 2)
    return c.undo_last(twice, first.union(second), 1, KEY)[0]


@query(
    "c11_undo_last_log",
    f"WITH {LOG} SELECT seq, user_id FROM log WHERE seq NOT IN (SELECT seq FROM log ORDER BY seq DESC LIMIT 300)",
)
def c11_log(spark, sf):
    log = account_log(spark, sf)
    return c.undo_last(c.replay(log, ACCOUNT), log, 300, ACCOUNT)[1].select("seq", "user_id")


@query(
    "d12_diff_log",
    f"""WITH {LOG}, net AS (SELECT user_id, arg_min_null(before, seq) AS before, arg_max_null(after, seq) AS after FROM log GROUP BY user_id)
        SELECT user_id, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' ELSE 'modified' END AS change,
               before, after FROM net WHERE before IS DISTINCT FROM after""",
)
def d12(spark, sf):
    net = d.diff_log(account_log(spark, sf), ACCOUNT)
    return net.select(
        "user_id",
        "change",
        F.col("before.balance").alias("before"),
        F.col("after.balance").alias("after"),
    )
