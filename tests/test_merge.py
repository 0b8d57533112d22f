"""Diff, merge and compare: known counts, truth table, laws, nested values."""

import itertools

import pytest
from pyspark.sql import functions as F

from plait.functions.canonical import row_hash, table_digest
from plait.operators import compare as cmp, diff as d, history as h, keys, merge as m
from plait.sources import sinks
from tests.conftest import rows

K = ["id"]
SCHEMA = "id int, a string, b string"


def frame(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


# --- a published fixture with known counts ---------------------------------------------

BRANCHES = {
    "base": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM {orders}",
    "theirs": """SELECT o_orderkey, o_custkey,
        CASE WHEN o_orderkey % 11 = 6 THEN 'S' WHEN o_orderkey % 14 = 5 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
        CASE WHEN o_orderkey % 10 = 1 THEN o_totalprice + 100.0 ELSE o_totalprice END AS o_totalprice, o_orderpriority
      FROM {orders} WHERE o_orderkey % 20 <> 3
      UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM {orders} WHERE o_orderkey < 50""",
    "ours": """SELECT o_orderkey, o_custkey,
        CASE WHEN o_orderkey % 11 = 6 THEN 'S' ELSE o_orderstatus END AS o_orderstatus,
        CASE WHEN o_orderkey % 15 = 1 THEN o_totalprice + 50.0 ELSE o_totalprice END AS o_totalprice,
        CASE WHEN o_orderkey % 9 = 4 THEN '9-OURS' ELSE o_orderpriority END AS o_orderpriority
      FROM {orders} WHERE o_orderkey % 25 <> 7
      UNION ALL SELECT o_orderkey + 10000000, o_custkey, 'Z', o_totalprice, o_orderpriority FROM {orders} WHERE o_orderkey < 20
      UNION ALL SELECT o_orderkey + 20000000, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM {orders} WHERE o_orderkey < 30""",
}
OK = ["o_orderkey"]


@pytest.fixture(scope="module")
def branches(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return {n: spark.sql(q, orders=orders) for n, q in BRANCHES.items()}


def test_known_diff_counts(branches):
    base, ours, theirs = (branches[n] for n in ("base", "ours", "theirs"))
    assert [x.count() for x in (base, ours, theirs)] == [1500, 1490, 1475]

    def counts(s, t):
        return {r["change"]: r["rows"] for r in d.diff_summary(d.diff_rows(s, t, OK)).collect()}

    assert counts(theirs, base) == {"added": 50, "removed": 75, "modified": 334}
    assert counts(theirs, ours) == {"added": 90, "removed": 105, "modified": 399}


def test_known_merge_counts(branches):
    plan = m.diff3(branches["base"], branches["ours"], branches["theirs"], OK)
    found = {r["outcome"]: r["count"] for r in plan.rows.groupBy("outcome").count().collect()}
    assert found == {
        "add": 30, "delete": 61, "modify": 165, "theirs_deleted": 14, "ours_deleted": 9,
        "field_conflict": 70, "skip": 30 + 51 + 1150,
    }
    dropped = plan.rows.where((F.col("outcome") == "field_conflict") & (F.size("taken") > 0))
    assert dropped.count() == 6
    counts = m.merge_counts({"orders": plan}).collect()[0]
    assert counts["conflict_count"] == 93 and not counts["success"]
    assert m.merged_rows(plan, "ours").count() == 1459
    assert m.merged_rows(plan, "theirs").count() == 1454


def test_known_compare_counts(branches):
    stats = cmp.compare_stats(cmp.compare(branches, OK), list(branches)).collect()[0]
    assert (stats["total_rows"], stats["in_all"], stats["in_some"], stats["unique_to_one"]) == (
        1580, 1365, 155, 60,
    )


def test_two_way_merge_leaves_the_source(branches):
    merged = m.merge2(branches["theirs"], branches["ours"], OK)
    assert d.diff_rows(merged, branches["theirs"], OK).isEmpty()


# --- every combination of three versions, against a plain model -----------------------------


def _model(b, o, t):
    """(outcome, conflicting fields) of one row; a version is None or a pair."""
    if b is None and o is None:
        return ("add" if t else "skip"), set()
    if t is None:
        if b is None or o is None:
            return "skip", set()
        return ("delete", set()) if b == o else ("theirs_deleted", {"_deleted"})
    if o is None:
        return ("skip", set()) if b == t else ("ours_deleted", {"_deleted"})
    base = b or (None, None)
    clash, taken = set(), False
    for name, x, y, z in zip("ab", base, o, t):
        if y == z or x == z:
            continue
        if x == y:
            taken = True
        else:
            clash.add(name)
    if clash:
        return "field_conflict", clash
    return ("modify" if taken else "skip"), set()


def test_diff3_against_model(spark):
    states = [None, *itertools.product(["x", "y", None], ["x", "z"])]
    cases = [c for c in itertools.product(states, repeat=3) if any(c)]
    sides = [[(i, *c[s]) for i, c in enumerate(cases) if c[s]] for s in range(3)]
    plan = m.diff3(*[spark.createDataFrame(side, SCHEMA) for side in sides], K)
    got = {
        r["id"]: (r["outcome"], {c["field"] for c in r["conflicts"] or []})
        for r in plan.rows.collect()
    }
    assert got == {i: _model(*c) for i, c in enumerate(cases)}
    for strategy in ("ours", "theirs"):
        for keep in (False, True):
            merged = {r["id"]: (r["a"], r["b"]) for r in m.merged_rows(plan, strategy, keep).collect()}
            want = {}
            for i, (b, o, t) in enumerate(cases):
                outcome, clash = _model(b, o, t)
                if outcome == "add":
                    row = t
                elif outcome == "delete":
                    row = None
                elif outcome in ("theirs_deleted", "ours_deleted"):
                    row = t if strategy == "theirs" else o
                elif o is None:
                    row = None
                else:
                    x = b or (None, None)
                    row = []
                    for n, bv, ov, tv in zip("ab", x, o, t or o):
                        clean = outcome == "modify" or (outcome == "field_conflict" and keep)
                        if n in clash:
                            row.append(tv if strategy == "theirs" else ov)
                        elif clean and ov != tv and bv == ov:
                            row.append(tv)
                        else:
                            row.append(ov)
                    row = tuple(row)
                if row is not None:
                    want[i] = row
            assert merged == want, (strategy, keep)


def test_strategies_and_gate(spark):
    base = frame(spark, (1, "x", "p"), (2, "x", "p"))
    ours = frame(spark, (1, "o", "p"), (2, "x", "p"))
    theirs = frame(spark, (1, "t", "p"), (2, "x", "q"))
    assert rows(m.merge3(base, ours, theirs, K)) == rows(ours)
    merged, reasons = m.merge_detect(base, theirs, ours, K)
    assert rows(merged) == rows(ours)
    assert rows(reasons) == [(1, 'Concurrent change on field "a"')]
    assert rows(m.merge_detect(base, theirs, ours, K, "manual")[0]) == [(1, "o", "p"), (2, "x", "q")]
    assert rows(m.merge_detect(base, theirs, ours, K, "theirs")[0]) == rows(theirs)
    with pytest.raises(ValueError):
        m.merge3(base, ours, theirs, K, strategy="best")
    # Abort is nothing special in a three-way merge without detection.
    assert rows(m.merge3(base, ours, theirs, K, "abort")) == [(1, "o", "p"), (2, "x", "q")]

    plan = m.diff3(base, ours, theirs, K).rows
    calls = []

    def check(allow, reason=None):
        def run(df):
            calls.append(reason)
            return allow, reason

        return run

    def broken(df):
        raise RuntimeError("boom")

    assert m.merge_gate(plan, [(2, "late", check(False, "late")), (1, "first", check(False, "first"))]) == (False, "first")
    assert calls == ["first"]
    assert m.merge_gate(plan, [(1, "a", check(True))]) == (True, None)
    assert m.merge_gate(plan, [(1, "a", broken)]) == (False, 'Check "a" failed: boom')
    assert m.merge_gate(plan, [(1, "a", check(False))]) == (False, 'Rejected by check "a"')
    assert m.after_merge(plan, [broken, check(True)]) == ["boom"]


def test_affected_tables(spark):
    base = frame(spark, (1, "x", "p"))
    clash = m.diff3(base, frame(spark, (1, "o", "p")), frame(spark, (1, "t", "p")), K)
    added = m.diff3(base, base, frame(spark, (1, "x", "p"), (2, "n", "n")), K)
    got = m.merge_counts({"clash": clash, "added": added}, "theirs").collect()[0]
    assert (got["tables_affected"], got["rows_added"], got["conflict_count"], got["success"]) == (1, 1, 1, True)


# --- laws ---------------------------------------------------------------------------------------


def test_laws(spark):
    b = frame(spark, (1, "x", "p"), (2, "y", None), (3, "z", "q"))
    t = frame(spark, (1, "x", "w"), (3, "z", "q"), (4, "n", "n"))
    assert rows(m.merge3(b, t, b, K)) == rows(t)
    assert rows(m.merge3(b, b, t, K)) == rows(t)
    assert rows(h.cherry_pick(b, b, t, K)) == rows(t)
    assert rows(h.revert(h.cherry_pick(b, b, t, K), b, t, K)) == rows(b)
    assert d.diff_rows(t, t, K).isEmpty()
    back = {(r["id"], r["change"]) for r in d.diff_rows(b, t, K).collect()}
    swap = {"added": "removed", "removed": "added", "modified": "modified"}
    assert {(r["id"], swap[r["change"]]) for r in d.diff_rows(t, b, K).collect()} == back
    assert rows(sinks.merge_into(b, t, K)) == [(1, "x", "w"), (2, "y", None), (3, "z", "q"), (4, "n", "n")]
    one = table_digest(b).collect()[0]
    two = table_digest(b.repartition(3).orderBy(F.desc("id"))).collect()[0]
    assert one == two and one["row_count"] == 3 and len(one["checksum"]) == 16
    assert table_digest(t).collect()[0]["checksum"] != one["checksum"]
    assert table_digest(b.limit(0)).collect()[0]["row_count"] == 0


def test_upsert_modes(spark):
    old, new = frame(spark, (1, "x", "p")), frame(spark, (1, None, "q"), (2, "n", "n"))
    assert rows(sinks.merge_into(old, new, K, "merge")) == [(1, "x", "q"), (2, "n", "n")]
    assert rows(sinks.merge_into(old, new, K, "keep_existing", "discard")) == [(1, "x", "p")]
    with pytest.raises(Exception, match="row exists"):
        sinks.merge_into(old, new, K, "fail").collect()
    with pytest.raises(Exception, match="row is missing"):
        sinks.merge_into(old, new, K, "replace", "fail").collect()
    with pytest.raises(ValueError):
        sinks.merge_into(old, new, K, "other")


# --- nested, map and changed types --------------------------------------------------------------


def test_nested_and_map_values(spark):
    schema = "id int, s struct<x:int,y:string>, l array<int>, m map<string,int>"
    a = spark.createDataFrame([(1, (1, "p"), [1, 2], {"k": 1, "j": 2}), (2, (1, "p"), [1], {"k": 1})], schema)
    b = spark.createDataFrame([(1, (1, "p"), [1, 2], {"j": 2, "k": 1}), (2, (2, "p"), [1, 3], {"k": 5})], schema)
    got = rows(d.diff_fields(b, a, K))
    assert got == [
        (2, "l", "[1]", "[1,3]"),
        (2, "m", '[{"key":"k","value":1}]', '[{"key":"k","value":5}]'),
        (2, "s", '{"x":1,"y":"p"}', '{"x":2,"y":"p"}'),
    ]
    assert rows(a.where("id = 1").select(row_hash(a))) == rows(b.where("id = 1").select(row_hash(b)))
    states = cmp.compare({"a": a, "b": b}, K)
    assert rows(states) == [(1, "present", "present"), (2, "present", "modified")]
    with pytest.raises(ValueError):
        cmp.compare({"a": a}, K)


def test_column_added_and_retyped(spark):
    old = spark.createDataFrame([(1, "5", "x"), (2, "6", "y")], "id int, n string, gone string")
    new = spark.createDataFrame([(1, 5, None), (2, 7, "z")], "id int, n int, fresh string")
    assert rows(d.diff_fields(new, old, K)) == [
        (1, "gone", "x", None), (2, "fresh", None, "z"), (2, "gone", "y", None), (2, "n", "6", "7"),
    ]
    assert rows(d.diff_schema(new, old)) == [
        ("fresh", "added", None, "string"), ("gone", "removed", "string", None),
        ("n", "retyped", "string", "int"),
    ]


def test_nested_schema_diff(spark):
    old = "id int, a struct<x:int,y:struct<p:string,q:int>>, l array<struct<u:int>>, m map<string,int>, s string"
    new = "id int, a struct<x:bigint,y:struct<p:string,r:int>>, l array<struct<u:int,v:date>>, m map<string,array<int>>, s struct<t:int>"
    empty = lambda schema: spark.createDataFrame([], schema)
    got = {r[0]: tuple(r[1:]) for r in d.diff_schema(empty(new), empty(old)).collect()}
    assert got == {
        "a.x": ("retyped", "int", "bigint"), "a.y.q": ("removed", "int", None), "a.y.r": ("added", None, "int"),
        "l[].v": ("added", None, "date"), "m{value}": ("retyped", "int", "array"), "m{value}[]": ("added", None, "int"),
        "s": ("retyped", "string", "struct"), "s.t": ("added", None, "int"),
    }
    assert d.diff_schema(empty(old), empty(old)).isEmpty()
    rows = spark.createDataFrame([(1, (5, None), [], {}, "x"), (2, None, None, None, None)], "id int, a struct<x:int,y:string>, l array<int>, m map<string,int>, s string")
    assert {r["path"]: r["rows"] for r in d.filled_paths(rows).collect()} == {"id": 2, "a": 1, "a.x": 1, "a.y": 0, "l": 1, "m": 1, "s": 1}


def test_composite_key_and_uniqueness(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "p int, q int, v string")
    b = spark.createDataFrame([(1, 1, "x"), (1, 2, "z"), (2, 1, "n")], "p int, q int, v string")
    got = d.diff_tables({"t": (b, a, ["p", "q"])})
    assert rows(got) == [("t", "1/2", "modified"), ("t", "2/1", "added")]
    keys.assert_unique_key(a, ["p", "q"])
    with pytest.raises(ValueError):
        keys.assert_unique_key(a, ["p"])
    with pytest.raises(ValueError):
        keys.assert_unique_key(spark.createDataFrame([(None, 1)], "p int, q int"), ["p"])
