"""Queries over a store with a long history: fifty commits of small edits to customer."""

from __future__ import annotations

import datetime
import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.canonical import as_checksum, digest_sums
from ..operators import changesets as cs, diff as d, history as h
from ..session import fresh_path
from ..sources.requests import Requests
from ..sources.store import Store
from ..streaming import feed as f
from .tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
_STORES: dict[tuple[str, str], tuple[str, list[str]]] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# --- the store -------------------------------------------------------------------------
# Commit i of 1 to 50 on branch dev moves the customers with key % 50 = i (50: 0) to
# nation 100 + i. Besides, commit 20 drops key % 50 = 7, commit 30 takes suppliers over as
# customers with negative keys, and commit 40 renames a segment for key % 50 < 5.

COMMITS = 50
FIRST_DAY = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
KEYS = ["c_custkey"]


def _suppliers(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").selectExpr(
        "-s_suppkey - 1 AS c_custkey", "s_name AS c_name", "s_nationkey AS c_nationkey",
        "'SUPPLY' AS c_mktsegment", "s_acctbal AS c_acctbal",
    )


def _history(spark, sf) -> tuple[Store, list[str]]:
    """The store and its commits on dev, filled once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORES:
        store = Store(spark, fresh_path(spark, "history"))
        store.init({
            "customer": (table(spark, sf, "customer"), KEYS),
            "nation": (table(spark, sf, "nation"), ["n_nationkey"]),
        })
        store.create_branch("dev")
        part = F.col("c_custkey") % 50
        made = []
        for i in range(1, COMMITS + 1):
            by = f"u{i % 3}"
            store.update("dev", "customer", part == i % 50, {"c_nationkey": F.lit(100 + i)}, by)
            if i == 20:
                store.delete("dev", "customer", part == 7, by)
            if i == 30:
                store.insert("dev", "customer", _suppliers(spark, sf), by)
            if i == 40:
                building = (F.col("c_mktsegment") == "BUILDING") & (part < 5)
                store.update("dev", "customer", building, {"c_mktsegment": F.lit("HOUSES")}, by)
            made.append(store.commit("dev", f"step {i}", by, ts=FIRST_DAY + datetime.timedelta(days=i)))
        _STORES[key] = (store.root, made)
    root, made = _STORES[key]
    return Store(spark, root), made


def _fresh(kind: str) -> str:
    """A branch or tag name of this run's own."""
    return f"{kind}-{uuid.uuid4().hex[:12]}"


_ALL = "c_custkey, c_name, c_nationkey, c_mktsegment, c_acctbal"


def _state(i: int) -> str:
    """SQL of customer as of commit ``i``."""
    place = "CASE WHEN c_custkey % 50 = 0 THEN 50 ELSE c_custkey % 50 END"
    old = f"""SELECT c_custkey, c_name, CASE WHEN {place} <= {i} THEN 100 + {place} ELSE c_nationkey END AS c_nationkey,
      CASE WHEN {i} >= 40 AND c_custkey % 50 < 5 AND c_mktsegment = 'BUILDING' THEN 'HOUSES' ELSE c_mktsegment END AS c_mktsegment, c_acctbal
      FROM customer WHERE {i} < 20 OR c_custkey % 50 <> 7"""
    new = f"""SELECT -s_suppkey - 1, s_name, CASE WHEN {i} = 50 AND (-s_suppkey - 1) % 50 = 0 THEN 150 ELSE s_nationkey END, 'SUPPLY', s_acctbal FROM supplier"""
    return f"{old} UNION ALL {new}" if i >= 30 else old


@query("s2_read_old_commit", _state(25))
def s2(spark, sf):
    store, made = _history(spark, sf)
    return store.read_at(made[24])["customer"]


@query(
    "t1_commit_counts",
    f"""SELECT i AS step, 'customer' AS "table", (SELECT count(*) FROM customer) - CASE WHEN i >= 20 THEN (SELECT count(*) FROM customer WHERE c_custkey % 50 = 7) ELSE 0 END
          + CASE WHEN i >= 30 THEN (SELECT count(*) FROM supplier) ELSE 0 END AS row_count FROM range(1, {COMMITS + 1}) r(i)
        UNION ALL SELECT i, 'nation', (SELECT count(*) FROM nation) FROM range(1, {COMMITS + 1}) r(i)""",
)
def t1(spark, sf):
    """Every commit's tables with the counts and checksums it was sealed with."""
    commits = _history(spark, sf)[0].commits().where("branch = 'dev'")
    step = F.regexp_extract("message", r"step (\d+)", 1).cast("long")
    entries = commits.select(step.alias("step"), F.explode("snapshot").alias("table", "e"))
    return entries.select("step", "table", "e.row_count")


@query("t7_find_at_time", f"SELECT * FROM ({_state(33)}) WHERE c_nationkey = 112")
def t7(spark, sf):
    at = (FIRST_DAY + datetime.timedelta(days=33, hours=5)).strftime("%Y-%m-%d %H:%M:%S")
    return _history(spark, sf)[0].find_at("dev", "customer", at, {"c_nationkey": 112})


@query("t7_find_at_commit", f"SELECT * FROM ({_state(41)}) WHERE c_mktsegment = 'HOUSES'")
def t7_hash(spark, sf):
    store, made = _history(spark, sf)
    return store.find_at("main", "customer", made[40], {"c_mktsegment": "HOUSES"})


def _blamed() -> str:
    place = "CASE WHEN c_custkey % 50 = 0 THEN 50 ELSE c_custkey % 50 END"
    first = "CASE WHEN c_custkey < 0 THEN 30 ELSE 1 END"
    return f"""WITH rows_ AS (SELECT {_ALL} FROM customer UNION ALL SELECT -s_suppkey - 1, s_name, s_nationkey, 'SUPPLY', s_acctbal FROM supplier),
      moved AS (SELECT *, {place} AS i, c_custkey >= 0 OR c_custkey % 50 = 0 AS m, c_custkey >= 0 AND c_custkey % 50 < 5 AND c_mktsegment = 'BUILDING' AS r FROM rows_),
      cells AS (
        SELECT c_custkey, 'c_name' AS field, c_name AS value, {first} AS step FROM moved
        UNION ALL SELECT c_custkey, 'c_acctbal', CAST(c_acctbal AS VARCHAR), {first} FROM moved
        UNION ALL SELECT c_custkey, 'c_nationkey', CAST(CASE WHEN m THEN 100 + i ELSE c_nationkey END AS VARCHAR), CASE WHEN m THEN i ELSE {first} END FROM moved
        UNION ALL SELECT c_custkey, 'c_mktsegment', CASE WHEN r THEN 'HOUSES' ELSE c_mktsegment END, CASE WHEN r THEN 40 ELSE {first} END FROM moved)
      SELECT c_custkey, field, value, CAST(50 - step AS INTEGER) AS pos, 'u' || (step % 3) AS author FROM cells"""


@query("t9_store_blame", _blamed())
def t9(spark, sf):
    """Dropped rows are blamed up to their last commit."""
    return _history(spark, sf)[0].blame("dev", "customer").select("c_custkey", "field", "value", "pos", "author")


# --- the log that its writes have made -----------------------------------------------------

# Number of a write's record: three before the first, one for each commit and write before it.
_SEQ = "3 + 2 * (i - 1) + CAST(i > 20 AS INTEGER) + CAST(i > 30 AS INTEGER) + CAST(i > 40 AS INTEGER)"
_LOG = f"""base AS (SELECT *, CASE WHEN c_custkey % 50 = 0 THEN 50 ELSE c_custkey % 50 END AS i FROM customer),
slog AS (
  SELECT {_SEQ} AS seq, 'update' AS op, c_custkey, 'u' || (i % 3) AS performed_by, c_nationkey AS before_nation, 100 + i AS after_nation, c_acctbal FROM base
  UNION ALL SELECT {_SEQ}, 'update', -s_suppkey - 1, 'u2', s_nationkey, 150, s_acctbal FROM (SELECT *, 50 AS i FROM supplier WHERE (-s_suppkey - 1) % 50 = 0)
  UNION ALL SELECT {_SEQ} + 1, 'delete', c_custkey, 'u2', 107, NULL, c_acctbal FROM (SELECT * REPLACE (20 AS i) FROM base WHERE c_custkey % 50 = 7)
  UNION ALL SELECT {_SEQ} + 1, 'insert', -s_suppkey - 1, 'u0', NULL, s_nationkey, s_acctbal FROM (SELECT *, 30 AS i FROM supplier)
  UNION ALL SELECT {_SEQ} + 1, 'update', c_custkey, 'u1', CASE WHEN c_custkey % 50 = 0 THEN c_nationkey ELSE 100 + c_custkey % 50 END,
    CASE WHEN c_custkey % 50 = 0 THEN c_nationkey ELSE 100 + c_custkey % 50 END, c_acctbal FROM (SELECT * REPLACE (40 AS i) FROM base WHERE c_custkey % 50 < 5 AND c_mktsegment = 'BUILDING'))"""
_LOGGED = """CAST(seq AS BIGINT) AS seq, op, CAST(c_custkey AS VARCHAR) AS "key", performed_by, CAST(before_nation AS INTEGER) AS before_nation,
  CAST(after_nation AS INTEGER) AS after_nation, c_acctbal"""


def _images(log: DataFrame) -> DataFrame:
    def of(side: str, field: str, kind: str):
        return F.get_json_object(side, f"$.{field}").cast(kind)

    return log.select(
        "seq", "op", "key", "performed_by", of("before", "c_nationkey", "int").alias("before_nation"),
        of("after", "c_nationkey", "int").alias("after_nation"),
        F.coalesce(of("after", "c_acctbal", "double"), of("before", "c_acctbal", "double")).alias("c_acctbal"),
    )


@query("c10_op_log_by_table", f"WITH {_LOG} SELECT {_LOGGED} FROM slog ORDER BY seq")
def c10(spark, sf):
    """All changes of one table on one branch, in order."""
    return _images(_history(spark, sf)[0].op_log("dev", "customer")).orderBy("seq")


@query(
    "c10_op_log_by_user",
    f"WITH {_LOG} SELECT {_LOGGED} FROM slog WHERE performed_by = 'u2'",
)
def c10_user(spark, sf):
    return _images(_history(spark, sf)[0].op_log().where("performed_by = 'u2'"))


@query(
    "r1_store_feed",
    f"""WITH {_LOG} SELECT CAST(seq AS BIGINT) AS seq, op AS type, CAST(c_custkey AS VARCHAR) AS "key", CAST(after_nation AS INTEGER) AS nation,
        CASE WHEN op = 'update' THEN CASE WHEN after_nation = before_nation THEN 'c_mktsegment' ELSE 'c_nationkey' END END AS updated FROM slog""",
)
def r1(spark, sf):
    events = f.change_feed(_history(spark, sf)[0].op_log(), "dev")
    return events.select(
        "seq", "type", "key", F.get_json_object("document", "$.c_nationkey").cast("int").alias("nation"),
        F.array_join(F.map_keys("updated"), ",").alias("updated"),
    )


@query("r3_resume", f"""WITH {_LOG} SELECT CAST(seq AS BIGINT) AS seq, op AS type, CAST(c_custkey AS VARCHAR) AS "key", seq > 60 AS resumed FROM slog""")
def r3(spark, sf):
    """A feed read up to a token and one resumed from it: every event once."""
    store = _history(spark, sf)[0]
    token = f.resume_token(store.op_log("dev").where("seq <= 60"))
    first = f.feed_until(store.op_log("dev"), token)
    rest = f.feed_after(store.op_log("dev", after=f.position_of(token)), token)
    parts = [e.select("seq", "type", "key", F.lit(late).alias("resumed")) for e, late in ((first, False), (rest, True))]
    return reduce(DataFrame.union, parts)


@query(
    "r4_handler_failures",
    f"""WITH {_LOG} SELECT 'broken' AS handler, 'ValueError: no such thing' AS error, CAST(0 AS BIGINT) AS rows_handled, 2 AS batches_failed
        UNION ALL SELECT h, NULL, (SELECT count(*) FROM slog), 0 FROM (VALUES ('count'), ('keep')) t(h)""",
)
def r4(spark, sf):
    """Three handlers of a streamed feed, one of them failing in every batch."""
    store, base = _history(spark, sf)[0], fresh_path(spark, "handlers")
    log = store.op_log("dev").select(*[c.split()[0] for c in f.CHANGELOG.split(", ")])

    def count(batch: DataFrame) -> None:
        batch.groupBy().count().write.mode("append").parquet(f"{base}/count")

    def keep(batch: DataFrame) -> None:
        batch.select("seq", "key").write.mode("append").parquet(f"{base}/keep")

    def broken(batch: DataFrame) -> None:
        raise ValueError("no such thing")

    handlers = {"count": count, "broken": broken, "keep": keep}
    # Each part is one batch, however many files its tasks have written.
    for i, part in enumerate((log.where("seq <= 60"), log.where("seq > 60"))):
        part.write.parquet(f"{base}/log/part={i}")
        changes = f.read_changes(spark, f"{base}/log/*")
        failures = f.run_handlers(f.change_feed(changes), handlers, f"{base}/checkpoint", f"{base}/failures")
    counted = spark.read.parquet(f"{base}/count").agg(F.sum("count").alias("rows_handled")).withColumn("handler", F.lit("count"))
    kept = spark.read.parquet(f"{base}/keep").agg(F.count("*").alias("rows_handled")).withColumn("handler", F.lit("keep"))
    done = counted.unionByName(kept)
    failed = failures.groupBy("handler").agg(F.max("error").alias("error"), F.count("*").cast("int").alias("batches_failed"))
    return failed.join(done, "handler", "full_outer").select(
        "handler", "error", F.coalesce("rows_handled", F.lit(0).cast("long")).alias("rows_handled"),
        F.coalesce("batches_failed", F.lit(0)).alias("batches_failed"),
    )


@query(
    "t21_store_drift",
    f"""WITH {_LOG} SELECT b.id, b.branch, CASE WHEN b.branch = 'dev' AND b.seq < (SELECT max(seq) FROM slog) THEN 'drifted' ELSE 'clean' END AS status
        FROM (VALUES ('start', 'dev', 2), ('late', 'dev', 1000), ('main', 'main', 0)) b(id, branch, seq)""",
)
def t21(spark, sf):
    fences = spark.createDataFrame([("start", "dev", 2), ("late", "dev", 1000), ("main", "main", 0)], "id string, branch string, seq long")
    return h.drift(fences, _history(spark, sf)[0].op_log()).drop("reason")


@query("c11_store_undo", _state(40).replace("c_custkey % 50 < 5 AND", "false AND"))
def c11(spark, sf):
    """Take back the last write of a branch that starts at commit 40."""
    store, made = _history(spark, sf)
    name = _fresh("undo")
    store.create_branch(name)
    store.write(name, "customer", store.read_at(made[38])["customer"])
    part = F.col("c_custkey") % 50
    store.update(name, "customer", part == 40, {"c_nationkey": F.lit(140)})
    store.update(name, "customer", (F.col("c_mktsegment") == "BUILDING") & (part < 5), {"c_mktsegment": F.lit("HOUSES")})
    store.delete(name, "customer", part == 3)
    store.undo(name, "customer", 2)
    return store.table(name, "customer")


@query(
    "m5_merge_changes",
    """SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 3 THEN 77 ELSE c_nationkey END AS c_nationkey,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSES' ELSE c_mktsegment END AS c_mktsegment, c_acctbal
       FROM customer WHERE NOT (c_mktsegment = 'FURNITURE' AND c_custkey % 2 = 0)
       UNION ALL SELECT -s_suppkey - 1, s_name, s_nationkey, 'SUPPLY', s_acctbal FROM supplier""",
)
def m5(spark, sf):
    """Both sides edit a table; the merge reads their change sets only."""
    store = _history(spark, sf)[0]
    source, target = _fresh("src"), _fresh("tgt")
    store.create_branch(source)
    store.create_branch(target)
    segment, key = F.col("c_mktsegment"), F.col("c_custkey")
    store.update(source, "customer", segment == "BUILDING", {"c_mktsegment": F.lit("HOUSES")})
    store.delete(source, "customer", (segment == "FURNITURE") & (key % 2 == 0) & (key % 10 != 3))
    store.insert(source, "customer", _suppliers(spark, sf))
    store.commit(source, "segments")
    store.update(target, "customer", key % 10 == 3, {"c_nationkey": F.lit(77)})
    store.commit(target, "nations")
    store.merge(source, target)
    return store.table(target, "customer")


# --- digests ---------------------------------------------------------------------------------

_EDITED = f"""SELECT c_custkey, c_name, CASE WHEN c_nationkey = 7 THEN 70 ELSE c_nationkey END AS c_nationkey, c_mktsegment, c_acctbal
  FROM customer WHERE c_mktsegment <> 'FURNITURE' UNION ALL SELECT -s_suppkey - 1, s_name, s_nationkey, 'SUPPLY', s_acctbal FROM supplier"""
_TEXT = (
    """'{"c_acctbal":' || c_acctbal || ',"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || """
    """'","c_nationkey":' || c_nationkey || '}'"""
)


@query(
    "a11_incremental",
    f"""SELECT row_count, substr(sha256(row_count || ':' || s0 || ':' || s1 || ':' || s2 || ':' || s3), 1, 16) AS checksum
        FROM (SELECT count(*) AS row_count, {", ".join(f"sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS BIGINT)) AS s{i}" for i in range(4))}
              FROM (SELECT sha256({_TEXT}) AS h FROM ({_EDITED})))""",
)
def a11(spark, sf):
    """The digest of an edited table from that of the table before and the changes alone."""
    c = table(spark, sf, "customer")
    new = c.where("c_mktsegment <> 'FURNITURE'").withColumn(
        "c_nationkey", F.when(F.col("c_nationkey") == 7, 70).otherwise(F.col("c_nationkey")).cast(c.schema["c_nationkey"].dataType)
    ).unionByName(_suppliers(spark, sf).select(*[F.col(f.name).cast(f.dataType) for f in c.schema]))
    changes = cs.capture(c, new, KEYS)
    return as_checksum(cs.changed_digest(digest_sums(c), changes))


# --- tags, gates, requests, masks and comparisons through the store ---------------------------


@query(
    "t6_store_tags",
    "SELECT 'v' || i AS tag, 'step ' || (5 * i) AS message, 'u' || ((5 * i) % 3) AS author FROM range(1, 11) r(i) WHERE i % 3 <> 0",
)
def t6(spark, sf):
    """Ten tags, a third of them deleted, with the commits that the others resolve to."""
    store, made = _history(spark, sf)
    token = _fresh("tag")
    for i in range(1, 11):
        store.tag(f"{token}/v{i}", made[5 * i - 1])
    for i in range(3, 11, 3):
        store.delete_tag(f"{token}/v{i}")
    mine = store.tags().where(F.col("name").startswith(token))
    return mine.join(store.commits(), "hash").select(F.substring_index("name", "/", -1).alias("tag"), "message", "author")


@query(
    "m10_merge_gate",
    """SELECT n, 'moves' AS first_check, n <= 5 AS allowed, CASE WHEN n > 5 THEN n || ' rows leave their nation' END AS reason
       FROM (SELECT count(*) AS n FROM customer WHERE c_custkey % 7 = 3)""",
)
def m10(spark, sf):
    """Checks see the plan before a merge, by ascending priority; the first rejection wins."""
    store = _history(spark, sf)[0]
    source, target = _fresh("src"), _fresh("tgt")
    store.create_branch(source)
    store.create_branch(target)
    store.update(source, "customer", F.col("c_custkey") % 7 == 3, {"c_nationkey": F.lit(9), "c_acctbal": F.col("c_acctbal") + 1})
    store.commit(source, "moves")
    seen = []

    def moves(plan: DataFrame):
        n = plan.where("theirs.c_acctbal <> ours.c_acctbal").count()
        seen.append(("moves", n))
        return n <= 5, f"{n} rows leave their nation"

    def never(plan: DataFrame):
        seen.append(("never", plan.count()))
        return True, None

    done = store.merge(source, target, gate=[(2, "never", never), (1, "moves", moves)])
    kept = store.table(target, "customer")
    assert done["success"] or kept.where("c_custkey % 7 = 3").exceptAll(store.table("main", "customer")).isEmpty()
    return spark.createDataFrame([(seen[0][1], seen[0][0], done["success"], done.get("reason"))], "n long, first_check string, allowed boolean, reason string")


_DEPLOYED = """SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN 88 ELSE c_nationkey END AS c_nationkey, c_mktsegment, c_acctbal FROM customer"""


def _deployed(spark, sf) -> tuple[Store, str]:
    """A target with one request carried out, one stale and one rejected."""
    store = _history(spark, sf)[0]
    target = _fresh("target")
    store.create_branch(target)
    asked = Requests(store)
    ids = {}
    for kind, rest in (("done", 0), ("stale", 1), ("refused", 2)):
        source = _fresh(kind)
        store.create_branch(source, parent=target)
        store.update(source, "customer", F.col("c_custkey") % 4 == rest, {"c_nationkey": F.lit(88)})
        store.commit(source, kind)
        ids[kind] = asked.open(source, target, kind, "amy")
    asked.approve(ids["done"], "max")
    asked.execute(ids["done"])
    asked.approve(ids["stale"], "max")
    store.delete(asked.get(ids["stale"])["source"], "customer", F.col("c_custkey") == 1)
    try:
        asked.execute(ids["stale"])
    except ValueError:
        pass
    asked.reject(ids["refused"], "max", "not this week")
    return store, target


@query("t22_execute", _DEPLOYED)
def t22(spark, sf):
    """The target after its approved request was carried out and a stale one was not."""
    store, target = _deployed(spark, sf)
    return store.table(target, "customer")


@query(
    "t22_request_states",
    """SELECT * FROM (VALUES ('done', 'merged', 'max', NULL), ('stale', 'approved', 'max', 'source has moved on since its approval'),
         ('refused', 'rejected', 'max', 'not this week')) t(description, status, reviewed_by, reason),
       LATERAL (SELECT count(*) AS rows_modified FROM customer WHERE c_custkey % 4 = CASE description WHEN 'done' THEN 0 WHEN 'stale' THEN 1 ELSE 2 END)""",
)
def t22_states(spark, sf):
    store, target = _deployed(spark, sf)
    reason = F.regexp_replace("reason", r"source \S+", "source")
    return Requests(store).list(target=target).select(
        "description", "status", "reviewed_by", reason.alias("reason"), F.col("changes")["modified"].alias("rows_modified")
    )


@query(
    "p4_masked_branch",
    """SELECT 'customer' AS "table", CAST(c_custkey AS VARCHAR) AS "key", substr(sha256(c_name), 1, 16) AS name, '[REDACTED]' AS extra FROM customer
       UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), '[REDACTED]', CAST(n_regionkey AS VARCHAR) FROM nation
       UNION ALL SELECT 'people', CAST(s_suppkey AS VARCHAR), substr(sha256(s_name), 1, 16), NULL FROM supplier""",
)
def p4(spark, sf):
    """Three tables of a branch masked at once, one of them inside a struct."""
    store = _history(spark, sf)[0]
    plain, safe = _fresh("plain"), _fresh("safe")
    store.create_branch(plain)
    people = table(spark, sf, "supplier").select("s_suppkey", F.struct("s_name", "s_acctbal").alias("who"))
    store.write(plain, "people", people, ["s_suppkey"])
    store.masked_branch(safe, {
        "customer": {"c_name": "hash", "c_mktsegment": "redact", "missing": "mask"},
        "nation": {"n_name": "redact"},
        "people": {"who.s_name": "hash", "who.s_acctbal": "null"},
    }, parent=plain)

    def part(t: str, key: str, name: str, extra: str) -> DataFrame:
        return store.table(safe, t).select(
            F.lit(t).alias("table"), F.col(key).cast("string").alias("key"), F.col(name).alias("name"), F.col(extra).cast("string").alias("extra")
        )

    return part("customer", "c_custkey", "c_name", "c_mktsegment").union(
        part("nation", "n_nationkey", "n_name", "n_regionkey")
    ).union(part("people", "s_suppkey", "who.s_name", "who.s_acctbal"))


@query(
    "n1_compare_tables",
    """SELECT 'customer' AS "table", CAST(c_custkey AS VARCHAR) AS "key", 'present' AS one, CASE WHEN c_custkey % 5 = 0 THEN 'absent' WHEN c_custkey % 5 = 1 THEN 'modified' ELSE 'present' END AS two,
         'absent' AS three FROM customer
       UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), 'present', 'present', 'present' FROM nation
       UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), 'absent', 'absent', 'present' FROM supplier""",
)
def n1(spark, sf):
    """All tables of three branches; two of them lack a table."""
    store = _history(spark, sf)[0]
    names = {n: _fresh(n) for n in ("one", "two", "three")}
    store.create_branch(names["one"])
    store.create_branch(names["two"])
    store.create_branch(names["three"], tables=["nation"])
    store.delete(names["two"], "customer", F.col("c_custkey") % 5 == 0)
    store.update(names["two"], "customer", F.col("c_custkey") % 5 == 1, {"c_nationkey": F.lit(-1)})
    store.write(names["three"], "supplier", table(spark, sf, "supplier"), ["s_suppkey"])
    found = store.compare_all(list(names.values()))
    return found.select("table", "key", *[F.col(f"`{v}`").alias(n) for n, v in names.items()])


@query(
    "d13_schema_diff",
    """SELECT path, change, from_type, to_type, CASE change WHEN 'added' THEN NULL WHEN 'retyped' THEN o.n ELSE o.n END AS rows_before,
         CASE change WHEN 'removed' THEN NULL ELSE o.n END AS rows_after
       FROM (VALUES ('o_totalprice', 'retyped', 'decimal(18,2)', 'string'), ('who.priority', 'removed', 'string', NULL),
               ('who.state', 'retyped', 'string', 'struct'), ('who.state.code', 'added', NULL, 'string'), ('made', 'added', NULL, 'int')) t(path, change, from_type, to_type),
            (SELECT count(*) AS n FROM orders) o""",
)
def d13(spark, sf):
    """Columns and inner fields that came, went or changed their type, with the values they hold."""
    o = table(spark, sf, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    old = o.select("o_orderkey", "o_totalprice", F.struct(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("state")).alias("who"))
    new = o.select(
        "o_orderkey", F.col("o_totalprice").cast("string"),
        F.struct(F.col("o_custkey").alias("id"), F.struct(F.col("o_orderstatus").alias("code")).alias("state")).alias("who"),
        F.year("o_orderdate").alias("made"),
    )
    before, after = (d.filled_paths(x).withColumnRenamed("rows", n) for x, n in ((old, "rows_before"), (new, "rows_after")))
    return d.diff_schema(new, old).join(before, "path", "left").join(after, "path", "left")
