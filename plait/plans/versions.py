"""Diff, merge, compare, digests and masking over branches of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..functions.canonical import content_hash, row_hash, table_digest
from ..operators import compare as cmp, diff as d, merge as m, privacy
from ..sources import sinks
from .tables import (
    CUSTOMER_BRANCHES,
    DEFINITIONS,
    KEYS,
    ORDER_BRANCHES,
    customer_branches,
    definitions,
    order_branches,
    table,
)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# --- diff ---------------------------------------------------------------------


@query(
    "d1_diff_added",
    f"WITH {ORDER_BRANCHES} SELECT * FROM theirs WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ours)",
)
def d1(spark: SparkSession, sf: str) -> DataFrame:
    _, ours, theirs = order_branches(spark, sf)
    return d.diff_added(theirs, ours, KEYS)


@query(
    "d2_diff_removed",
    f"WITH {ORDER_BRANCHES} SELECT * FROM ours WHERE o_orderkey NOT IN (SELECT o_orderkey FROM theirs)",
)
def d2(spark, sf):
    _, ours, theirs = order_branches(spark, sf)
    return d.diff_removed(theirs, ours, KEYS)


_DIFFERENT = """(t.o_custkey IS DISTINCT FROM o.o_custkey OR t.o_orderstatus IS DISTINCT FROM o.o_orderstatus
   OR t.o_totalprice IS DISTINCT FROM o.o_totalprice OR t.o_orderpriority IS DISTINCT FROM o.o_orderpriority
   OR t.o_orderdate IS DISTINCT FROM o.o_orderdate)"""


@query(
    "d3_diff_modified",
    f"""WITH {ORDER_BRANCHES} SELECT t.* FROM theirs t JOIN ours o USING (o_orderkey) WHERE {_DIFFERENT}""",
)
def d3(spark, sf):
    _, ours, theirs = order_branches(spark, sf)
    return d.diff_modified(theirs, ours, KEYS).select(*KEYS, "src.*")


def _field_rows(new: str, old: str) -> str:
    cols = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate"]
    return " UNION ALL ".join(
        f"""SELECT n.o_orderkey, '{c}' AS field, CAST(p.{c} AS VARCHAR) AS "from", CAST(n.{c} AS VARCHAR) AS "to"
            FROM {new} n JOIN {old} p USING (o_orderkey) WHERE n.{c} IS DISTINCT FROM p.{c}"""
        for c in cols
    )


@query("d4_diff_fields", f"WITH {ORDER_BRANCHES} {_field_rows('theirs', 'ours')}")
def d4(spark, sf):
    _, ours, theirs = order_branches(spark, sf)
    return d.diff_fields(theirs, ours, KEYS)


_ORDER_CHANGES = f"""
  SELECT coalesce(t.o_orderkey, o.o_orderkey) AS k,
         CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN t.o_orderkey IS NULL THEN 'removed' ELSE 'modified' END AS change
  FROM theirs t FULL OUTER JOIN ours o ON t.o_orderkey = o.o_orderkey
  WHERE o.o_orderkey IS NULL OR t.o_orderkey IS NULL OR {_DIFFERENT}"""
_CUSTOMER_CHANGES = """
  SELECT coalesce(t.c_custkey, o.c_custkey) AS k,
         CASE WHEN o.c_custkey IS NULL THEN 'added' WHEN t.c_custkey IS NULL THEN 'removed' ELSE 'modified' END AS change
  FROM cbranch t FULL OUTER JOIN cmain o ON t.c_custkey = o.c_custkey
  WHERE o.c_custkey IS NULL OR t.c_custkey IS NULL OR t.c_mktsegment IS DISTINCT FROM o.c_mktsegment"""
_ALL_CHANGES = f"""{ORDER_BRANCHES},{CUSTOMER_BRANCHES},
changes AS (
  SELECT 'orders' AS "table", CAST(k AS VARCHAR) AS "key", change FROM ({_ORDER_CHANGES})
  UNION ALL SELECT 'customer', CAST(k AS VARCHAR), change FROM ({_CUSTOMER_CHANGES})
  UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), 'added' FROM supplier)"""


def _tables(spark, sf):
    _, ours, theirs = order_branches(spark, sf)
    main, branch = customer_branches(spark, sf)
    return d.diff_tables(
        {
            "orders": (theirs, ours, KEYS),
            "customer": (branch, main, ["c_custkey"]),
            "supplier": (table(spark, sf, "supplier"), None, ["s_suppkey"]),
        }
    )


QUERIES["d5_diff_branches"] = _tables
SQL["d5_diff_branches"] = f"WITH {_ALL_CHANGES} SELECT * FROM changes"


@query(
    "d6_diff_summary",
    f'WITH {_ALL_CHANGES} SELECT "table", change, count(*) AS rows FROM changes GROUP BY ALL',
)
def d6(spark, sf):
    return d.diff_summary(_tables(spark, sf))


@query(
    "d7_diff_definitions",
    f"""WITH {DEFINITIONS} SELECT "table", name, change FROM dstat WHERE change IN ('added', 'removed')""",
)
def d7(spark, sf):
    return d.diff_definitions(*definitions(spark, sf))


@query(
    "d8_diff_constraints",
    """WITH s AS (SELECT p_partkey, p_brand, p_size FROM part WHERE p_size < 45),
            t AS (SELECT p_partkey, p_brand, CASE WHEN p_name LIKE 'red%' THEN p_size + 1 ELSE p_size END AS p_size
                  FROM part WHERE p_size >= 8)
       SELECT coalesce(s.p_partkey, t.p_partkey) AS p_partkey, s.p_size AS source_max, t.p_size AS target_max
       FROM s FULL OUTER JOIN t ON s.p_partkey = t.p_partkey
       WHERE s.p_partkey IS NULL OR t.p_partkey IS NULL OR s.p_size <> t.p_size""",
)
def d8(spark, sf):
    p = table(spark, sf, "part")
    columns = ["p_partkey", "p_brand", "p_size"]
    source = p.where("p_size < 45").select(*columns)
    target = (
        p.where("p_size >= 8")
        .withColumn("p_size", F.expr("p_size + CASE WHEN p_name LIKE 'red%' THEN 1 ELSE 0 END"))
        .select(*columns)
    )
    return d.diff_constraints(source, target, on="p_partkey").select(
        "p_partkey",
        F.col("src.p_size").alias("source_max"),
        F.col("tgt.p_size").alias("target_max"),
    )


@query(
    "d9_diff_search_definitions",
    f"""WITH {DEFINITIONS} SELECT * FROM dstat
        WHERE "table" IN (SELECT "table" FROM dstat WHERE change <> 'unchanged')""",
)
def d9(spark, sf):
    return d.diff_search_definitions(*definitions(spark, sf))


_MERGED_DEFS = """SELECT "table", name, CASE WHEN change = 'removed' THEN target_body ELSE source_body END AS definition,
  CASE change WHEN 'added' THEN 'created' WHEN 'modified' THEN 'updated' ELSE 'kept' END AS action FROM dstat"""


@query("d10_merge_definitions", f"WITH {DEFINITIONS} {_MERGED_DEFS}")
def d10(spark, sf):
    return d.merge_definitions(*definitions(spark, sf))


@query(
    "d10_merge_definitions_remove_orphans",
    f"WITH {DEFINITIONS} {_MERGED_DEFS} WHERE change <> 'removed'",
)
def d10_orphans(spark, sf):
    return d.merge_definitions(*definitions(spark, sf), remove_orphans=True)


@query(
    "d10_merge_definition_counts",
    f"""WITH {DEFINITIONS} SELECT count(*) FILTER (change = 'added') AS created,
        count(*) FILTER (change = 'modified') AS updated, count(*) FILTER (change = 'removed') AS removed FROM dstat""",
)
def d10_counts(spark, sf):
    return d.merge_definition_counts(*definitions(spark, sf), remove_orphans=True)


@query(
    "d11_diff_status",
    f"""WITH {ORDER_BRANCHES} SELECT o.o_orderkey,
        CASE WHEN t.o_orderkey IS NULL THEN 'deleted_in_branch' WHEN {_DIFFERENT} THEN 'modified' ELSE 'unchanged' END AS status
        FROM base o LEFT JOIN theirs t ON o.o_orderkey = t.o_orderkey""",
)
def d11(spark, sf):
    base, _, theirs = order_branches(spark, sf)
    return d.diff_status(theirs, base, KEYS)


# --- three-way and two-way merge --------------------------------------------------

_COLS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate"]


def _diff3_sql() -> str:
    def any_of(a: str, b: str) -> str:
        return "(" + " OR ".join(f"{a}.{c} IS DISTINCT FROM {b}.{c}" for c in _COLS) + ")"

    clash = " OR ".join(
        f"(o.{c} IS DISTINCT FROM t.{c} AND b.{c} IS DISTINCT FROM o.{c} AND b.{c} IS DISTINCT FROM t.{c})"
        for c in _COLS
    )
    taken = " OR ".join(
        f"(o.{c} IS DISTINCT FROM t.{c} AND b.{c} IS NOT DISTINCT FROM o.{c})" for c in _COLS
    )
    return f"""{ORDER_BRANCHES},
d3 AS (
  SELECT coalesce(b.o_orderkey, o.o_orderkey, t.o_orderkey) AS o_orderkey,
         b.o_orderkey AS bk, o.o_orderkey AS ok, t.o_orderkey AS tk,
         {", ".join(f"b.{c} AS b_{c}, o.{c} AS o_{c}, t.{c} AS t_{c}" for c in _COLS)},
         CASE WHEN b.o_orderkey IS NULL AND o.o_orderkey IS NULL THEN 'add'
              WHEN b.o_orderkey IS NULL AND t.o_orderkey IS NULL THEN 'skip'
              WHEN o.o_orderkey IS NULL AND t.o_orderkey IS NULL THEN 'skip'
              WHEN t.o_orderkey IS NULL THEN CASE WHEN {any_of('b', 'o')} THEN 'theirs_deleted' ELSE 'delete' END
              WHEN o.o_orderkey IS NULL THEN CASE WHEN {any_of('b', 't')} THEN 'ours_deleted' ELSE 'skip' END
              WHEN {clash} THEN 'field_conflict' WHEN {taken} THEN 'modify' ELSE 'skip' END AS outcome
  FROM base b FULL OUTER JOIN ours o ON b.o_orderkey = o.o_orderkey
       FULL OUTER JOIN theirs t ON coalesce(b.o_orderkey, o.o_orderkey) = t.o_orderkey)"""


_D3 = _diff3_sql()


def _json(prefix: str) -> str:
    return (
        f"""'{{"o_custkey":' || {prefix}_o_custkey || ',"o_orderdate":"' || strftime({prefix}_o_orderdate, '%Y-%m-%dT%H:%M:%S.000') || '","o_orderpriority":"' || {prefix}_o_orderpriority || """
        f"""'","o_orderstatus":"' || {prefix}_o_orderstatus || '","o_totalprice":' || {prefix}_o_totalprice || '}}'"""
    )


_CONFLICTS = (
    " UNION ALL ".join(
        f"""SELECT o_orderkey, '{c}' AS field, CAST(b_{c} AS VARCHAR) AS base, CAST(o_{c} AS VARCHAR) AS ours,
            CAST(t_{c} AS VARCHAR) AS theirs FROM d3 WHERE outcome = 'field_conflict'
            AND o_{c} IS DISTINCT FROM t_{c} AND b_{c} IS DISTINCT FROM o_{c} AND b_{c} IS DISTINCT FROM t_{c}"""
        for c in _COLS
    )
    + f""" UNION ALL SELECT o_orderkey, '_deleted', {_json('b')}, {_json('o')}, {_json('t')}
           FROM d3 WHERE outcome IN ('theirs_deleted', 'ours_deleted')"""
)


@query("m1_diff3", f"WITH {_D3} SELECT o_orderkey, outcome FROM d3")
def m1(spark, sf):
    return m.diff3(*order_branches(spark, sf), KEYS).rows.select("o_orderkey", "outcome")


@query(
    "m2_merge_fields",
    f"""WITH {_D3} {" UNION ALL ".join(
        f"SELECT o_orderkey, '{c}' AS field, CAST(t_{c} AS VARCHAR) AS value FROM d3 WHERE outcome = 'modify' "
        f"AND o_{c} IS DISTINCT FROM t_{c} AND b_{c} IS NOT DISTINCT FROM o_{c}" for c in _COLS)}""",
)
def m2(spark, sf):
    plan = m.diff3(*order_branches(spark, sf), KEYS)
    taken = plan.rows.where("outcome = 'modify'").select(
        "o_orderkey", "theirs", F.explode("taken").alias("field")
    )
    value = F.coalesce(
        *[F.when(F.col("field") == c, F.col("theirs")[c].cast("string")) for c in plan.types]
    )
    return taken.select("o_orderkey", "field", value.alias("value"))


@query("m3_conflicts", f"WITH {_D3} {_CONFLICTS}")
def m3(spark, sf):
    return m.conflicts(m.diff3(*order_branches(spark, sf), KEYS))


def _counts_sql(success: str, dry_run: str) -> str:
    return f"""WITH {_D3}, conf AS ({_CONFLICTS})
SELECT count(*) FILTER (outcome = 'add') AS rows_added, count(*) FILTER (outcome = 'delete') AS rows_removed,
       count(*) FILTER (outcome = 'modify') AS rows_modified, (SELECT count(*) FROM conf) AS conflict_count,
       CAST(1 AS BIGINT) AS tables_affected, {success} AS success, {dry_run} AS dry_run FROM d3"""


@query("m4_merge3_manual", _counts_sql("(SELECT count(*) FROM conf) = 0", "false"))
def m4(spark, sf):
    return m.merge_counts({"orders": m.diff3(*order_branches(spark, sf), KEYS)})


@query("m4_merge3_theirs_dry_run", _counts_sql("true", "true"))
def m4_dry(spark, sf):
    return m.merge_counts(
        {"orders": m.diff3(*order_branches(spark, sf), KEYS)}, "theirs", dry_run=True
    )


def _apply_sql(theirs: bool, keep: bool = False) -> str:
    cols = []
    for c in _COLS:
        clash = f"(o_{c} IS DISTINCT FROM t_{c} AND b_{c} IS DISTINCT FROM o_{c} AND b_{c} IS DISTINCT FROM t_{c})"
        clean = f"(o_{c} IS DISTINCT FROM t_{c} AND b_{c} IS NOT DISTINCT FROM o_{c})"
        cases = [f"WHEN outcome = 'add' THEN t_{c}", f"WHEN outcome = 'modify' AND {clean} THEN t_{c}"]
        if theirs:
            cases.append(f"WHEN outcome = 'ours_deleted' THEN t_{c}")
            cases.append(f"WHEN outcome = 'field_conflict' AND {clash} THEN t_{c}")
        if keep:
            cases.append(f"WHEN outcome = 'field_conflict' AND {clean} THEN t_{c}")
        cols.append(f"CASE {' '.join(cases)} ELSE o_{c} END AS {c}")
    gone = "outcome = 'delete' OR (outcome = 'skip' AND ok IS NULL) OR outcome = " + (
        "'theirs_deleted'" if theirs else "'ours_deleted'"
    )
    return f"WITH {_D3} SELECT o_orderkey, {', '.join(cols)} FROM d3 WHERE NOT ({gone})"


@query("m5_merge3_apply_ours", _apply_sql(False))
def m5_ours(spark, sf):
    return m.merge3(*order_branches(spark, sf), KEYS, strategy="ours")


@query("m5_merge3_apply_theirs", _apply_sql(True))
def m5_theirs(spark, sf):
    return m.merge3(*order_branches(spark, sf), KEYS, strategy="theirs")


@query("m5_merge3_keep_clean_fields", _apply_sql(True, True))
def m5_keep(spark, sf):
    return m.merge3(*order_branches(spark, sf), KEYS, strategy="theirs", keep_clean_fields=True)


@query("m6_merge2", f"WITH {ORDER_BRANCHES} SELECT * FROM theirs")
def m6(spark, sf):
    _, ours, theirs = order_branches(spark, sf)
    return m.merge2(theirs, ours, KEYS)


@query(
    "m6_merge2_dry_run",
    f"""WITH {ORDER_BRANCHES}, ch AS ({_ORDER_CHANGES}) SELECT count(*) FILTER (change = 'added') AS rows_added,
        count(*) FILTER (change = 'removed') AS rows_removed, count(*) FILTER (change = 'modified') AS rows_modified FROM ch""",
)
def m6_dry(spark, sf):
    _, ours, theirs = order_branches(spark, sf)
    return m.merge2_counts(theirs, ours, KEYS)


@query(
    "m7_merge_detect_conflicts",
    f"""WITH {_D3}, conf AS ({_CONFLICTS})
        SELECT o_orderkey, 'Concurrent change on field "' || field || '"' AS reason FROM conf""",
)
def m7(spark, sf):
    base, ours, theirs = order_branches(spark, sf)
    return m.merge_detect(base, theirs, ours, KEYS, "ours")[1]


@query("m7_merge_detect_abort", f"WITH {ORDER_BRANCHES} SELECT * FROM ours")
def m7_abort(spark, sf):
    base, ours, theirs = order_branches(spark, sf)
    return m.merge_detect(base, theirs, ours, KEYS, "abort")[0]


@query("m8_merge_without_ancestor", f"WITH {ORDER_BRANCHES} SELECT * FROM theirs")
def m8(spark, sf):
    _, ours, theirs = order_branches(spark, sf)
    return m.merge_detect(None, theirs, ours, KEYS)[0]


@query("m9_task_review", SQL["m6_merge2_dry_run"])
def m9(spark, sf):
    _, ours, theirs = order_branches(spark, sf)
    return m.task_review(theirs, ours, KEYS, auto_merge=True)[0]


@query(
    "m10_merge_gate_rows",
    f"""WITH {_D3} SELECT o_orderkey, t_o_totalprice AS new_price FROM d3
        WHERE outcome IN ('add', 'modify') AND t_o_totalprice > 450000""",
)
def m10(spark, sf):
    plan = m.diff3(*order_branches(spark, sf), KEYS)
    too_dear = plan.rows.where(
        F.col("outcome").isin(m.ADD, m.MODIFY) & (F.col("theirs.o_totalprice") > 450000)
    )
    return too_dear.select("o_orderkey", F.col("theirs.o_totalprice").alias("new_price"))


# --- upsert sink ------------------------------------------------------------------


def _merge_into_sql(columns: str, where: str = "true") -> str:
    return f"""WITH {ORDER_BRANCHES} SELECT coalesce(o.o_orderkey, t.o_orderkey) AS o_orderkey, {columns}
        FROM ours o FULL OUTER JOIN theirs t ON o.o_orderkey = t.o_orderkey WHERE {where}"""


def _pick(rule: str) -> str:
    return ", ".join(f"{rule.replace('@', c)} AS {c}" for c in _COLS)


@query(
    "s5_merge_into_replace",
    _merge_into_sql(_pick("CASE WHEN t.o_orderkey IS NOT NULL THEN t.@ ELSE o.@ END")),
)
def s5_replace(spark, sf):
    _, ours, theirs = order_branches(spark, sf)
    return sinks.merge_into(ours, theirs, KEYS)


@query(
    "s5_merge_into_keep_existing",
    _merge_into_sql(_pick("CASE WHEN o.o_orderkey IS NOT NULL THEN o.@ ELSE t.@ END")),
)
def s5_keep(spark, sf):
    _, ours, theirs = order_branches(spark, sf)
    return sinks.merge_into(ours, theirs, KEYS, when_matched="keep_existing")


@query(
    "s5_merge_into_merge_discard",
    _merge_into_sql(_pick("coalesce(t.@, o.@)"), "o.o_orderkey IS NOT NULL"),
)
def s5_merge(spark, sf):
    _, ours, theirs = order_branches(spark, sf)
    return sinks.merge_into(ours, theirs, KEYS, "merge", "discard")


# --- compare ----------------------------------------------------------------------

_SAME = " AND ".join(f"x.{c} IS NOT DISTINCT FROM b.{c}" for c in _COLS)
_MATRIX = f"""{ORDER_BRANCHES}, ids AS (SELECT o_orderkey FROM base UNION SELECT o_orderkey FROM ours
   UNION SELECT o_orderkey FROM theirs),
matrix AS (SELECT i.o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'absent' ELSE 'present' END AS base,
  {", ".join(f'''CASE WHEN {a}.o_orderkey IS NULL THEN 'absent' WHEN b.o_orderkey IS NULL THEN 'present'
     WHEN {_SAME.replace("x.", a + ".")} THEN 'present' ELSE 'modified' END AS {n}''' for a, n in (("u", "ours"), ("v", "theirs")))}
  FROM ids i LEFT JOIN base b ON i.o_orderkey = b.o_orderkey LEFT JOIN ours u ON i.o_orderkey = u.o_orderkey
       LEFT JOIN theirs v ON i.o_orderkey = v.o_orderkey)"""


def _matrix(spark, sf):
    base, ours, theirs = order_branches(spark, sf)
    return cmp.compare({"base": base, "ours": ours, "theirs": theirs}, KEYS)


QUERIES["n1_compare"] = _matrix
SQL["n1_compare"] = f"WITH {_MATRIX} SELECT * FROM matrix"


@query(
    "n2_compare_stats",
    f"""WITH {_MATRIX}, n AS (SELECT (base <> 'absent')::INT + (ours <> 'absent')::INT + (theirs <> 'absent')::INT AS n FROM matrix)
        SELECT count(*) AS total_rows, count(*) FILTER (n = 3) AS in_all, count(*) FILTER (n = 1) AS unique_to_one,
               count(*) FILTER (n = 2) AS in_some FROM n""",
)
def n2(spark, sf):
    return cmp.compare_stats(_matrix(spark, sf), ["base", "ours", "theirs"])


# --- digests ------------------------------------------------------------------------

_CUSTOMER_TEXT = (
    """'{"c_acctbal":' || c_acctbal || ',"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || """
    """'","c_nationkey":' || c_nationkey || '}'"""
)


@query(
    "a11_row_hash",
    f"SELECT c_custkey, sha256({_CUSTOMER_TEXT}) AS row_hash FROM customer",
)
def a11_rows(spark, sf):
    main, _ = customer_branches(spark, sf)
    return main.select("c_custkey", row_hash(main).alias("row_hash"))


def _digest_sql(source: str, text: str) -> str:
    lanes = ", ".join(
        f"sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS BIGINT)) AS s{i}" for i in range(4)
    )
    return f"""SELECT row_count, substr(sha256(row_count || ':' || s0 || ':' || s1 || ':' || s2 || ':' || s3), 1, 16) AS checksum
        FROM (SELECT count(*) AS row_count, {lanes} FROM (SELECT sha256({text}) AS h FROM {source}))"""


@query("a11_table_digest", _digest_sql("customer", _CUSTOMER_TEXT))
def a11(spark, sf):
    return table_digest(customer_branches(spark, sf)[0])


@query(
    "t2_commit_hash",
    """SELECT o_orderkey, sha256('{"branch":"' || o_custkey || '","parents":["' || (o_orderkey - 1) || '"],"message":"' ||
       o_orderpriority || '","author":"' || o_orderstatus || '","ts":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') || '"}') AS hash
       FROM orders""",
)
def t2(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey",
        content_hash(
            branch=F.col("o_custkey").cast("string"),
            parents=F.array((F.col("o_orderkey") - 1).cast("string")),
            message=F.col("o_orderpriority"),
            author=F.col("o_orderstatus"),
            ts=F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        ).alias("hash"),
    )


# --- masking ---------------------------------------------------------------------------

_CONTACTS = """contacts AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL
    WHEN c_mktsegment = 'BUILDING' THEN c_name
    ELSE lower(replace(c_name, '#', '.')) || '@example.com' END AS email, c_name, c_mktsegment FROM customer)"""


def _contacts(spark, sf):
    c = table(spark, sf, "customer")
    email = (
        F.when(F.col("c_mktsegment") == "FURNITURE", F.lit(None).cast("string"))
        .when(F.col("c_mktsegment") == "BUILDING", F.col("c_name"))
        .otherwise(
            F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com"))
        )
    )
    return c.select("c_custkey", email.alias("email"), "c_name", "c_mktsegment")


_MASKED = """CASE WHEN contains(email, '@') THEN left(split_part(email, '@', 1), 1)
      || repeat('*', greatest(length(split_part(email, '@', 1)) - 2, 1)) || right(split_part(email, '@', 1), 1)
      || '@' || split_part(email, '@', 2)
    WHEN length(email) <= 2 THEN repeat('*', length(email))
    ELSE left(email, 1) || repeat('*', length(email) - 2) || right(email, 1) END"""


@query("p1_anonymize_hash", f"WITH {_CONTACTS} SELECT c_custkey, substr(sha256(email), 1, 16) AS email FROM contacts")
def p1(spark, sf):
    return _contacts(spark, sf).select("c_custkey", tx.hash16(F.col("email")).alias("email"))


@query("p2_anonymize_mask", f"WITH {_CONTACTS} SELECT c_custkey, {_MASKED} AS email FROM contacts")
def p2(spark, sf):
    return _contacts(spark, sf).select("c_custkey", tx.mask(F.col("email")).alias("email"))


@query(
    "p3_anonymize_null_redact",
    f"""WITH {_CONTACTS} SELECT c_custkey, CASE WHEN email IS NOT NULL THEN '[REDACTED]' END AS email,
        CAST(NULL AS VARCHAR) AS c_name, c_mktsegment FROM contacts""",
)
def p3(spark, sf):
    return privacy.anonymize(_contacts(spark, sf), {"email": "redact", "c_name": "null"})


def _nested(spark, sf):
    c = _contacts(spark, sf)
    return c.select("c_custkey", F.struct("email", "c_name").alias("contact"), "c_mktsegment")


@query(
    "p4_anonymize",
    f"""WITH {_CONTACTS} SELECT c_custkey, {_MASKED} AS email, substr(sha256(c_name), 1, 16) AS c_name,
        '[REDACTED]' AS c_mktsegment FROM contacts""",
)
def p4(spark, sf):
    rules = {"contact.email": "mask", "contact.c_name": "hash", "c_mktsegment": "redact"}
    return privacy.anonymize(_nested(spark, sf), rules).select(
        "c_custkey", "contact.email", "contact.c_name", "c_mktsegment"
    )


@query(
    "p4_anonymize_counts",
    f"""WITH {_CONTACTS} SELECT count(*) FILTER (email IS NOT NULL OR c_mktsegment IS NOT NULL) AS rows_changed,
        count(email) + count(c_mktsegment) AS fields_changed FROM contacts""",
)
def p4_counts(spark, sf):
    return privacy.anonymize_counts(
        _nested(spark, sf), {"contact.email": "mask", "c_mktsegment": "redact"}
    )
