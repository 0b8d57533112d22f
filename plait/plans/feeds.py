"""Streaming queries over the events table, read back from their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import fresh_path
from ..streaming import feed as f
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


def _events(spark, sf) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return f.read_changes(spark, sf, schema, files="events.parquet")


def _changes(events: DataFrame) -> DataFrame:
    """Events as change log rows with JSON images."""
    k = F.from_json("props", "k int")["k"]
    op = (
        F.when(F.col("event_type") == "error", "delete")
        .when(F.col("event_type") == "signup", "insert")
        .when(F.col("event_type") == "click", "replace")
        .otherwise("update")
    )
    before = F.to_json(
        F.struct(
            "user_id", k.alias("k"), F.when(F.col("event_type") == "view", "x").alias("mark")
        )
    )
    after = F.to_json(
        F.struct(
            "user_id",
            F.when(F.col("event_type") == "view", k).otherwise(k + 1).alias("k"),
            F.col("event_type").alias("kind"),
        )
    )
    return events.select(
        F.col("event_id").alias("seq"),
        F.when(k < 50, "dev").otherwise("main").alias("branch"),
        F.lit("acct").alias("table"),
        op.alias("op"),
        F.col("user_id").cast("string").alias("key"),
        F.when(F.col("event_type") != "signup", before).alias("before"),
        F.when(F.col("event_type") != "error", after).alias("after"),
        "ts",
    )


_FEED = """raw AS (SELECT event_id AS seq, CAST(json_extract_string(props, '$.k') AS INT) AS k, user_id, event_type, ts FROM events),
feed AS (SELECT seq, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' WHEN 'click' THEN 'replace' ELSE 'update' END AS type,
  CASE WHEN k < 50 THEN 'dev' ELSE 'main' END AS branch, CAST(user_id AS VARCHAR) AS "key",
  CASE WHEN event_type <> 'error' THEN '{"user_id":' || user_id || ',"k":' || (CASE WHEN event_type = 'view' THEN k ELSE k + 1 END)
       || ',"kind":"' || event_type || '"}' END AS document,
  CASE WHEN event_type = 'view' THEN 'kind' WHEN event_type IN ('click', 'purchase') THEN 'k,kind' END AS updated,
  CASE WHEN event_type = 'view' THEN 'mark' WHEN event_type IN ('click', 'purchase') THEN '' END AS removed, ts FROM raw)"""


def _saved(spark, sf, branch=None) -> DataFrame:
    feed = f.change_feed(_changes(_events(spark, sf)), branch)
    base = fresh_path(spark, "feed")
    return f.save_feed(feed, f"{base}/rows", f"{base}/checkpoint")


@query("r1_change_feed", f"""WITH {_FEED} SELECT seq, type, "key", document FROM feed WHERE branch = 'dev'""")
def r1(spark, sf):
    return _saved(spark, sf, "dev").select("seq", "type", "key", "document")


@query(
    "r2_update_description",
    f"WITH {_FEED} SELECT seq, updated, removed FROM feed",
)
def r2(spark, sf):
    names = F.array_join(F.array_sort(F.map_keys("updated")), ",")
    return _saved(spark, sf).select(
        "seq", names.alias("updated"), F.array_join("removed", ",").alias("removed")
    )


@query(
    "r5_events_since",
    f"""WITH {_FEED} SELECT seq, type FROM feed WHERE branch = 'main' AND ts > TIMESTAMP '2024-01-02 08:00:00' ORDER BY seq""",
)
def r5(spark, sf):
    since = F.lit("2024-01-02 08:00:00").cast("timestamp_ntz")
    return f.events_since(_saved(spark, sf, "main"), since).select("seq", "type")


@query(
    "r6_fence",
    f"""WITH {_FEED} SELECT branch, max(seq) > 500 AS changed FROM feed GROUP BY branch""",
)
def r6(spark, sf):
    from ..operators.history import drift

    changes = _changes(table(spark, sf, "events"))
    fences = changes.select("branch").distinct().select(
        F.col("branch").alias("id"), "branch", F.lit(500).cast("long").alias("seq")
    )
    return drift(fences, changes).select("branch", (F.col("status") == "drifted").alias("changed"))


@query(
    "r7_once_per_request",
    "SELECT DISTINCT user_id || '-' || event_type AS request_id FROM events",
)
def r7(spark, sf):
    requests = _events(spark, sf).select(
        F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("request_id"), "ts"
    )
    base = fresh_path(spark, "requests")
    saved = f.save_feed(f.once_per_request(requests), f"{base}/rows", f"{base}/checkpoint")
    return saved.select("request_id")


@query(
    "r8_apply_feed",
    """WITH last AS (SELECT user_id, arg_max(event_type, event_id) AS t, arg_max(CAST(value AS DECIMAL(18,2)), event_id) AS v FROM events GROUP BY user_id)
       SELECT coalesce(c.c_custkey, l.user_id) AS user_id, CASE WHEN l.user_id IS NULL THEN CAST(c.c_acctbal AS DECIMAL(18,2)) ELSE l.v END AS balance
       FROM customer c FULL OUTER JOIN last l ON c.c_custkey = l.user_id WHERE l.t IS DISTINCT FROM 'error'""",
)
def r8(spark, sf):
    image = F.struct(F.col("value").cast("decimal(18,2)").alias("balance"))
    changes = _events(spark, sf).select(
        F.col("event_id").alias("seq"),
        "user_id",
        F.when(F.col("event_type") != "error", image).alias("after"),
    )
    base = fresh_path(spark, "apply")
    f.apply_feed(changes, ["user_id"], f"{base}/changes", f"{base}/checkpoint")
    accounts = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_acctbal").cast("decimal(18,2)").alias("balance")
    )
    return f.current_table(spark, accounts, f"{base}/changes", ["user_id"])
