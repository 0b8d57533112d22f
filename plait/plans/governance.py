"""Audit chains, write rules, scopes, idempotent requests, row checks, merge queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..operators import audit as a, govern as gv
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


# --- audit chains: one per 64 consecutive events -------------------------------------------

_CHAIN_COLUMNS = "chain, sequence, detail, data_hash, prev_hash, chain_hash"
CHAIN = """
entries AS (SELECT event_id // 64 AS chain, event_id % 64 + 1 AS sequence, event_type || ':' || user_id AS detail, event_id, ts FROM events),
walk(chain, sequence, detail, data_hash, prev_hash, chain_hash) AS (
  SELECT chain, CAST(0 AS BIGINT), 'Audit chain initialized', sha256('Audit chain initialized'), 'GENESIS',
         sha256('GENESIS:' || sha256('Audit chain initialized') || ':0') FROM (SELECT DISTINCT chain FROM entries)
  UNION ALL
  SELECT e.chain, e.sequence, e.detail, sha256(e.detail), w.chain_hash, sha256(w.chain_hash || ':' || sha256(e.detail) || ':' || e.sequence)
  FROM walk w JOIN entries e ON e.chain = w.chain AND e.sequence = w.sequence + 1)"""


def _batch(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.floor(F.col("event_id") / 64).alias("chain"),
        F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("detail"),
        "event_id",
        F.col("ts"),
        F.col("event_type").alias("action"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"),
    )


def _entries(spark, sf) -> DataFrame:
    """Appended entries without the genesis rows."""
    batch = _batch(spark, sf)
    first = a.genesis(batch.select("chain").distinct())
    return a.chain_append(a.heads(first), batch, "event_id")


def _chain(spark, sf) -> DataFrame:
    batch = _batch(spark, sf)
    first = a.genesis(batch.select("chain").distinct())
    return _entries(spark, sf).unionByName(first, allowMissingColumns=True)


def _tampered(spark, sf) -> DataFrame:
    """Damage: some details, links and hashes changed, by chain number."""
    kind = F.col("chain") % 4
    return (
        _chain(spark, sf)
        .withColumn(
            "detail",
            F.when((kind == 1) & (F.col("sequence") == 50), "forged").otherwise(F.col("detail")),
        )
        .withColumn(
            "prev_hash",
            F.when((kind == 2) & (F.col("sequence") == 30), "forged").otherwise(F.col("prev_hash")),
        )
        .withColumn(
            "chain_hash",
            F.when((kind == 3) & (F.col("sequence") == 0), "forged").otherwise(F.col("chain_hash")),
        )
    )


_TAMPERED = f"""{CHAIN}, bad AS (SELECT chain, sequence,
  CASE WHEN chain % 4 = 1 AND sequence = 50 THEN 'forged' ELSE detail END AS detail, data_hash,
  CASE WHEN chain % 4 = 2 AND sequence = 30 THEN 'forged' ELSE prev_hash END AS prev_hash,
  CASE WHEN chain % 4 = 3 AND sequence = 0 THEN 'forged' ELSE chain_hash END AS chain_hash FROM walk)"""


def _verify_sql(source: str, where: str = "true") -> str:
    return f"""chk AS (SELECT *, lag(chain_hash) OVER w AS before_hash, lag(sequence) OVER w AS before_seq FROM {source} WHERE {where}
    WINDOW w AS (PARTITION BY chain ORDER BY sequence)),
res AS (SELECT chain, sequence, CASE
  WHEN before_seq IS NULL THEN CASE WHEN sequence = 0 AND chain_hash <> sha256('GENESIS:' || data_hash || ':0') THEN 'first entry: its chain hash is wrong' END
  WHEN prev_hash <> before_hash THEN 'entry ' || sequence || ' does not follow entry ' || before_seq
  WHEN data_hash <> sha256(detail) THEN 'entry ' || sequence || ': its data hash does not fit its detail'
  WHEN chain_hash <> sha256(prev_hash || ':' || data_hash || ':' || sequence) THEN 'entry ' || sequence || ': its chain hash is wrong' END AS reason FROM chk)
SELECT chain, count(reason) = 0 AS valid, count(*) AS total_entries, min(sequence) FILTER (reason IS NOT NULL) AS broken_at,
       arg_min(reason, sequence) FILTER (reason IS NOT NULL) AS broken_reason FROM res GROUP BY chain"""


@query("h1_chain_append", f"WITH RECURSIVE {CHAIN} SELECT {_CHAIN_COLUMNS} FROM walk")
def h1(spark, sf):
    return _chain(spark, sf).select(*_CHAIN_COLUMNS.split(", "))


@query("h2_chain_verify", f"WITH RECURSIVE {CHAIN}, {_verify_sql('walk')}")
def h2(spark, sf):
    return a.chain_verify(_chain(spark, sf), group=["chain"])


@query("h2_chain_verify_tampered", f"WITH RECURSIVE {_TAMPERED}, {_verify_sql('bad')}")
def h2_bad(spark, sf):
    return a.chain_verify(_tampered(spark, sf), group=["chain"], chunk_rows=16)


@query(
    "h2_chain_verify_range",
    f"WITH RECURSIVE {_TAMPERED}, {_verify_sql('bad', 'sequence BETWEEN 30 AND 60')}",
)
def h2_range(spark, sf):
    return a.chain_verify(_tampered(spark, sf), 30, 60, ["chain"], chunk_rows=16)


@query(
    "h3_chain_page",
    f"""WITH RECURSIVE {CHAIN} SELECT {_CHAIN_COLUMNS} FROM walk ORDER BY chain, sequence LIMIT 20 OFFSET 10""",
)
def h3(spark, sf):
    return a.chain_page(_chain(spark, sf), 20, 10, ["chain", "sequence"]).select(*_CHAIN_COLUMNS.split(", "))


@query(
    "h3_chain_by_hash",
    f"""WITH RECURSIVE {CHAIN} SELECT chain, sequence FROM walk
        WHERE chain_hash = (SELECT sha256('GENESIS:' || sha256('Audit chain initialized') || ':0'))""",
)
def h3_hash(spark, sf):
    import hashlib

    data = hashlib.sha256(a.GENESIS_DETAIL.encode()).hexdigest()
    first = hashlib.sha256(f"{a.GENESIS}:{data}:0".encode()).hexdigest()
    return a.by_hash(_chain(spark, sf), first).select("chain", "sequence")


@query(
    "h3_chain_by_branch",
    """SELECT event_id, ts FROM events WHERE user_id = 5 ORDER BY ts DESC LIMIT 50""",
)
def h3_branch(spark, sf):
    entries = _entries(spark, sf).withColumnRenamed("actor", "branch")
    return a.by_branch(entries, "u5", limit=50).select("event_id", "ts")


@query(
    "h3_chain_by_time",
    """SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-01 06:00:00' AND ts <= TIMESTAMP '2024-01-03'""",
)
def h3_time(spark, sf):
    start, end = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-01 06:00:00", "2024-01-03"))
    return a.by_time(_entries(spark, sf), start, end).select("event_id")


@query(
    "s9_export_chain_csv",
    f"""WITH RECURSIVE {CHAIN} SELECT w.sequence, w.sequence || ',write,b' || w.chain || ',u' || split_part(w.detail, ':', 2) || ',' ||
        split_part(w.detail, ':', 1) || ',"' || w.detail || '",' || data_hash || ',' || prev_hash || ',' || chain_hash || ',' ||
        strftime(e.ts, '%Y-%m-%dT%H:%M:%S.') || substr(strftime(e.ts, '%f'), 1, 3) || 'Z' AS line
        FROM walk w JOIN entries e ON e.chain = w.chain AND e.sequence = w.sequence""",
)
def s9(spark, sf):
    entries = _entries(spark, sf).select(
        "*",
        F.lit("write").alias("entry_type"),
        F.concat(F.lit("b"), F.col("chain").cast("string")).alias("branch"),
    )
    return a.chain_export(entries, "csv")


@query(
    "s9_export_chain_json",
    f"""WITH RECURSIVE {CHAIN} SELECT w.sequence, w.detail, w.data_hash AS "dataHash", w.prev_hash AS "prevHash", w.chain_hash AS "chainHash",
        'b' || w.chain AS "branchName" FROM walk w WHERE w.sequence > 0""",
)
def s9_json(spark, sf):
    entries = _entries(spark, sf).select(
        "*",
        F.lit("write").alias("entry_type"),
        F.concat(F.lit("b"), F.col("chain").cast("string")).alias("branch"),
    )
    doc = "sequence bigint, detail string, dataHash string, prevHash string, chainHash string, branchName string"
    return a.chain_export(entries).select(F.from_json("line", doc).alias("d")).select("d.*")


@query(
    "s9_export_chain_whole",
    f"""WITH RECURSIVE {CHAIN}, n AS (SELECT w.chain, count(*) AS n FROM walk w JOIN entries e ON e.chain = w.chain AND e.sequence = w.sequence GROUP BY w.chain)
        SELECT chain, 0 AS part, CAST(-1 AS BIGINT) AS sequence, '# audit chain as of 2024-01-31' AS line FROM n
        UNION ALL SELECT chain, 1, -1, '# valid: true, entries: ' || n FROM n
        UNION ALL SELECT chain, 2, -1, 'sequence,entryType,branchName,actor,action,detail,dataHash,prevHash,chainHash,timestamp' FROM n
        UNION ALL SELECT w.chain, 9, w.sequence, w.sequence || ',write,b' || w.chain || ',u' || split_part(w.detail, ':', 2) || ',' ||
        split_part(w.detail, ':', 1) || ',"' || w.detail || '",' || data_hash || ',' || prev_hash || ',' || chain_hash || ',' ||
        strftime(e.ts, '%Y-%m-%dT%H:%M:%S.') || substr(strftime(e.ts, '%f'), 1, 3) || 'Z'
        FROM walk w JOIN entries e ON e.chain = w.chain AND e.sequence = w.sequence""",
)
def s9_whole(spark, sf):
    """Every chain as one verified document, header lines first."""
    entries = _entries(spark, sf).select(
        "*",
        F.lit("write").alias("entry_type"),
        F.concat(F.lit("b"), F.col("chain").cast("string")).alias("branch"),
    )
    return a.chain_document(entries, "csv", "2024-01-31", ["chain"])


# --- rules on branch names ----------------------------------------------------------------------

# Pattern, merge-only flag, order.
PROTECTIONS = [
    ("building/3.*", True, 1),
    ("*.77", False, 2),
    ("machinery/*5", True, 3),
    ("furniture/1*.1*", True, 4),
    ("household/7.v1", True, 5),
    ("b*", True, 6),
]
_RULE_ROWS = ", ".join(f"('{p}', {str(f).lower()}, {n})" for p, f, n in PROTECTIONS)
_NAMED = f"""names AS (SELECT c_custkey AS id, lower(c_mktsegment) || '/' || c_nationkey || '.' || c_custkey AS branch,
    c_acctbal < 0 AS is_merge FROM customer),
rules(pattern, merge_only, created_at) AS (VALUES {_RULE_ROWS}),
firsts AS (SELECT n.id, arg_min(r.pattern, r.created_at) AS pattern, arg_min(r.merge_only, r.created_at) AS merge_only
  FROM names n JOIN rules r ON n.branch = r.pattern OR (contains(r.pattern, '*') AND
       regexp_full_match(n.branch, replace(replace(r.pattern, '.', '\\.'), '*', '.*'))) GROUP BY n.id)"""


def _names(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(
            F.lower("c_mktsegment"), F.lit("/"), F.col("c_nationkey").cast("string"), F.lit("."),
            F.col("c_custkey").cast("string"),
        ).alias("branch"),
        (F.col("c_acctbal") < 0).alias("is_merge"),
    )


def _protections(spark) -> DataFrame:
    return spark.createDataFrame(PROTECTIONS, "pattern string, merge_only boolean, created_at int")


@query(
    "j5_glob_rules",
    f"WITH {_NAMED} SELECT n.branch AS name, f.pattern FROM names n JOIN firsts f USING (id)",
)
def j5(spark, sf):
    names = _names(spark, sf).select(F.col("branch").alias("name"))
    return gv.match_rules(names, _protections(spark)).select("name", "rule.pattern")


@query(
    "g4_write_permission",
    f"""WITH {_NAMED} SELECT n.id, n.branch, NOT coalesce(merge_only AND NOT is_merge, false) AS allowed,
        CASE WHEN merge_only AND NOT is_merge THEN 'Branch "' || branch || '": rule "' || pattern || '" lets merges through only' END AS reason
        FROM names n LEFT JOIN firsts f USING (id)""",
)
def g4(spark, sf):
    return gv.check_write(_names(spark, sf), _protections(spark)).drop("is_merge")


# --- scopes ---------------------------------------------------------------------------------------

# Agent, permissions, allowed tables, denied tables, branch quota.
SCOPES = [
    ("agent-0", ["read", "write"], ["click"], None, 5),
    ("agent-1", ["read", "write", "delete"], ["view", "signup"], None, 0),
    ("agent-2", ["read"], None, None, 100000),
    ("agent-3", ["read", "write"], None, ["error"], None),
]


def _sql_list(values) -> str:
    return "CAST(NULL AS VARCHAR[])" if values is None else "[" + ", ".join(f"'{v}'" for v in values) + "]"


_SCOPES = "scopes(agent, permissions, allowed_tables, denied, max_branches) AS (VALUES " + ", ".join(
    f"('{n}', {_sql_list(p)}, {_sql_list(al)}, {_sql_list(d)}, {'NULL' if q is None else q})"
    for n, p, al, d, q in SCOPES
) + ")"
_REQ = """req AS (SELECT event_id AS id, 'agent-' || (user_id % 5) AS agent, event_type AS "table",
  CASE WHEN value < 20 THEN 'read' WHEN value < 60 THEN 'write' ELSE 'delete' END AS op, ts, user_id FROM events)"""
_SCOPE_REASON = """CASE WHEN permissions IS NULL THEN NULL
  WHEN NOT list_contains(permissions, op) THEN 'Agent "' || agent || '" was not granted "' || op || '" rights'
  WHEN list_contains(denied, "table") THEN 'Table "' || "table" || '" is closed to agent "' || agent || '"'
  WHEN allowed_tables IS NOT NULL AND NOT list_contains(allowed_tables, "table") THEN 'Table "' || "table" || '" is not among the tables of agent "' || agent || '"' END"""


def _scopes(spark) -> DataFrame:
    return spark.createDataFrame(
        SCOPES,
        "agent string, permissions array<string>, allowed_tables array<string>, denied array<string>, max_branches int",
    )


def _requests(spark, sf) -> DataFrame:
    op = F.when(F.col("value") < 20, "read").when(F.col("value") < 60, "write").otherwise("delete")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("agent-"), (F.col("user_id") % 5).cast("string")).alias("agent"),
        F.col("event_type").alias("table"),
        op.alias("op"),
        "ts",
        "user_id",
    )


@query(
    "g1_scope_check",
    f"""WITH {_SCOPES}, {_REQ}, r AS (SELECT id, {_SCOPE_REASON} AS reason FROM req LEFT JOIN scopes USING (agent))
        SELECT id, reason IS NULL AS allowed, reason FROM r""",
)
def g1(spark, sf):
    return gv.check_permission(_requests(spark, sf), _scopes(spark)).select("id", "allowed", "reason")


@query(
    "g2_branch_quota",
    f"""WITH {_SCOPES}, c AS (SELECT 'agent-' || c_nationkey AS agent, count(*) AS branches FROM customer GROUP BY 1)
        SELECT agent, branches, NOT coalesce(max_branches > 0 AND branches >= max_branches, false) AS allowed,
        CASE WHEN max_branches > 0 AND branches >= max_branches THEN 'Agent "' || agent || '" already owns its share of branches (' || max_branches || ')' END AS reason
        FROM c LEFT JOIN scopes USING (agent)""",
)
def g2(spark, sf):
    owner = F.concat(F.lit("agent-"), F.col("c_nationkey").cast("string")).alias("agent")
    counts = table(spark, sf, "customer").groupBy(owner).agg(F.count("*").alias("branches"))
    return gv.check_quota(counts, _scopes(spark))


@query(
    "g3_violations",
    f"""WITH {_SCOPES}, {_REQ}, r AS (SELECT id, agent, "table", op, ts AS "at", {_SCOPE_REASON} AS reason FROM req LEFT JOIN scopes USING (agent))
        SELECT id, agent, "table", op, "at", reason FROM r WHERE reason IS NOT NULL AND agent = 'agent-2' ORDER BY "at" DESC, id DESC LIMIT 50""",
)
def g3(spark, sf):
    checked = gv.check_permission(_requests(spark, sf), _scopes(spark))
    log = gv.violations(checked, F.col("ts")).drop("ts", "user_id")
    return gv.newest_violations(log, "agent-2", limit=50)


@query(
    "g5_write_gate",
    f"""WITH {_SCOPES}, {_REQ}, {_NAMED},
        w AS (SELECT r.*, n.branch, f.pattern, f.merge_only, coalesce(n.branch IN (SELECT branch FROM names WHERE is_merge), false) AS ro
              FROM req r LEFT JOIN names n ON n.id = r.user_id LEFT JOIN firsts f ON f.id = n.id),
        x AS (SELECT w.id, w.branch, w.ro, CASE WHEN merge_only THEN 'Branch "' || branch || '": rule "' || pattern || '" lets merges through only' END AS prot,
              {_SCOPE_REASON} AS sc FROM w LEFT JOIN scopes USING (agent))
        SELECT id, CASE WHEN ro THEN 'read_only' WHEN prot IS NOT NULL THEN 'protection' WHEN sc IS NOT NULL THEN 'scope' END AS gate,
               NOT ro AND prot IS NULL AND sc IS NULL AS allowed,
               CASE WHEN ro THEN 'Branch "' || branch || '" is read-only' ELSE coalesce(prot, sc) END AS reason FROM x""",
)
def g5(spark, sf):
    names = _names(spark, sf)
    target = names.select(F.col("id").alias("__n"), "branch")
    requests = (
        _requests(spark, sf)
        .join(target, F.col("user_id") == F.col("__n"), "left")
        .select("id", "agent", "branch", "table", "op")
    )
    read_only = names.where("is_merge").select("branch")
    decided = gv.write_gate(requests, read_only, _protections(spark), _scopes(spark))
    return decided.select("id", "gate", "allowed", "reason")


# --- idempotent requests ----------------------------------------------------------------------------


def _deliveries(spark, sf) -> DataFrame:
    """Requests whose id comes back: one per user and payload kind."""
    return table(spark, sf, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("request_id"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("payload"),
    )


_DELIVERIES = """deliveries AS (SELECT user_id || '-' || event_type AS request_id, ts AS "at", event_id AS payload FROM events)"""


def _receipts(spark, sf) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf, "customer").select(
        F.concat(F.col("c_custkey").cast("string"), F.lit("-click")).alias("request_id"),
        F.when(F.col("c_acctbal") > 0, "done").alias("result"),
        (start + F.expr("make_dt_interval(0, c_nationkey, 0, 0)")).alias("executed_at"),
    )


_RECEIPTS = """receipts AS (SELECT c_custkey || '-click' AS request_id, CASE WHEN c_acctbal > 0 THEN 'done' END AS result,
  TIMESTAMP '2024-01-01' + INTERVAL (c_nationkey) HOUR AS executed_at FROM customer)"""


@query(
    "g6_first_per_request",
    f"""WITH {_DELIVERIES}, {_RECEIPTS} SELECT request_id, "at", payload FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY "at", payload) AS rn
        FROM deliveries) WHERE rn = 1 AND request_id NOT IN (SELECT request_id FROM receipts WHERE result IS NOT NULL)""",
)
def g6(spark, sf):
    return gv.first_per_request(_deliveries(spark, sf), _receipts(spark, sf), ("at", "payload"))


@query(
    "g6_purge_receipts",
    f"WITH {_RECEIPTS} SELECT request_id FROM receipts WHERE executed_at >= TIMESTAMP '2024-01-02 10:00:00' - INTERVAL 24 HOUR",
)
def g6_purge(spark, sf):
    now = F.lit("2024-01-02 10:00:00").cast("timestamp_ntz")
    return gv.purge_receipts(_receipts(spark, sf), now).select("request_id")


@query(
    "j7_already_executed",
    f"""WITH {_DELIVERIES}, {_RECEIPTS} SELECT DISTINCT request_id FROM deliveries WHERE request_id IN (SELECT request_id FROM receipts WHERE result IS NOT NULL)""",
)
def j7(spark, sf):
    ids = _deliveries(spark, sf).select("request_id").distinct()
    return gv.has_receipt(ids, _receipts(spark, sf))


# --- row checks -------------------------------------------------------------------------------------

ROW_RULES = [
    ("c_acctbal", "minimum", 0),
    ("c_acctbal", "maximum", 9000),
    ("c_mktsegment", "enum", ["BUILDING", "MACHINERY", "HOUSEHOLD", "FURNITURE"]),
    ("c_name", "pattern", "^Customer#[0-9]{9}$"),
    ("email", "required", None),
    ("email", "min_length", 20),
    ("email", "max_length", 30),
    ("code", "type", "int"),
    ("tags", "items", "int"),
]
_CHECKED = """t AS (SELECT *, CASE WHEN c_mktsegment <> 'BUILDING' THEN lower(c_name) || '@' || c_nationkey END AS email,
   CASE WHEN c_nationkey = 3 THEN 'x' ELSE c_nationkey::VARCHAR END AS code, string_split(replace(c_name, '#', ','), ',') AS tags FROM customer),
checked AS (SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'c_acctbal:minimum' END, CASE WHEN c_acctbal > 9000 THEN 'c_acctbal:maximum' END,
   CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD', 'FURNITURE') THEN 'c_mktsegment:enum' END,
   CASE WHEN NOT regexp_full_match(c_name, 'Customer#[0-9]{9}') THEN 'c_name:pattern' END,
   CASE WHEN email IS NULL THEN 'email:required' END, CASE WHEN length(email) < 20 THEN 'email:min_length' END,
   CASE WHEN length(email) > 30 THEN 'email:max_length' END, CASE WHEN code = 'x' THEN 'code:type' END, 'tags:items') AS failed FROM t)"""


def _checked(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    email = F.concat(F.lower("c_name"), F.lit("@"), F.col("c_nationkey").cast("string"))
    return c.select(
        "*",
        F.when(F.col("c_mktsegment") != "BUILDING", email).alias("email"),
        F.when(F.col("c_nationkey") == 3, "x")
        .otherwise(F.col("c_nationkey").cast("string"))
        .alias("code"),
        F.split(F.replace("c_name", F.lit("#"), F.lit(",")), ",").alias("tags"),
    )


@query("v1_validate_rows", f"WITH {_CHECKED} SELECT c_custkey, failed FROM checked")
def v1(spark, sf):
    checked = gv.validate_rows(_checked(spark, sf), ROW_RULES)
    return checked.select("c_custkey", F.array_join("failed", ",").alias("failed"))


@query(
    "v1_split_valid",
    f"WITH {_CHECKED} SELECT c_custkey FROM checked WHERE failed = 'tags:items'",
)
def v1_split(spark, sf):
    rules = [r for r in ROW_RULES if r[1] != "items"]
    return gv.split_valid(_checked(spark, sf), rules)[0].select("c_custkey")


# --- merge queue --------------------------------------------------------------------------------------

_QUEUE = """queue AS (SELECT o_orderkey AS id, 'b' || o_custkey AS branch, CASE o_orderstatus WHEN 'O' THEN 'pending'
  WHEN 'P' THEN 'processing' ELSE 'completed' END AS status, o_orderdate AS queued_at FROM orders)"""


def _queue(spark, sf) -> DataFrame:
    status = (
        F.when(F.col("o_orderstatus") == "O", "pending")
        .when(F.col("o_orderstatus") == "P", "processing")
        .otherwise("completed")
    )
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("b"), F.col("o_custkey").cast("string")).alias("branch"),
        status.alias("status"),
        F.col("o_orderdate").alias("queued_at"),
    )


@query(
    "m11_queue_order",
    f"WITH {_QUEUE} SELECT id, branch FROM queue WHERE status = 'pending' ORDER BY queued_at, id",
)
def m11(spark, sf):
    return gv.queue_list(_queue(spark, sf), "pending").select("id", "branch")


@query("m11_queue_length", f"WITH {_QUEUE} SELECT count(*) AS pending FROM queue WHERE status = 'pending'")
def m11_length(spark, sf):
    return gv.queue_length(_queue(spark, sf))


@query(
    "m11_next_in_queue",
    f"WITH {_QUEUE} SELECT id, branch FROM queue WHERE status = 'pending' ORDER BY queued_at, id LIMIT 1",
)
def m11_next(spark, sf):
    return gv.next_in_queue(_queue(spark, sf)).select("id", "branch")


@query(
    "m11_already_queued",
    f"WITH {_QUEUE} SELECT DISTINCT branch FROM queue WHERE status IN ('pending', 'processing')",
)
def m11_queued(spark, sf):
    return gv.already_queued(_queue(spark, sf))


@query(
    "v0_glob_match",
    """SELECT p_partkey, p_name LIKE 'r%i%g' AS hit, p_name = 'red.ring' AS exact FROM part""",
)
def v0_glob(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        tx.glob_match(F.col("p_name"), F.lit("r*i*g")).alias("hit"),
        tx.glob_match(F.col("p_name"), F.lit("red.ring")).alias("exact"),
    )
