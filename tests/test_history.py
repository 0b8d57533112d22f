"""Ordered helpers, ancestry, as-of, blame and change logs against plain models."""

import datetime
import random

import pytest
from pyspark.sql import Window, functions as F

from plait.functions import ordered, updates as u
from plait.operators import changes as c, graph as g, history as h, query as q
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows; one group key is NULL."""
    rnd = random.Random(3)
    data = [(rnd.choice(["hot", "hot", "hot", "a", None]), i, rnd.choice([None, 1, 2, 3]), rnd.randint(0, 9))
            for i in range(600)]
    rnd.shuffle(data)
    return spark.createDataFrame(data, "grp string, seq bigint, v int, score int")


def test_previous_value_and_position(skewed):
    w = Window.partitionBy("grp").orderBy("seq")
    got = ordered.previous_value(skewed, ["grp"], "seq", F.col("v"), "p")
    got = ordered.position(got, ["grp"], "seq", "up")
    got = ordered.position(got, ["grp"], "seq", "down", descending=True, chunk=F.floor(F.col("seq") / 50))
    want = (
        skewed.withColumn("p", F.lag("v").over(w))
        .withColumn("up", (F.row_number().over(w) - 1).cast("long"))
        .withColumn("down", (F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("seq"))) - 1).cast("long"))
    )
    assert rows(got.select(*want.columns)) == rows(want)
    whole = ordered.previous_value(skewed, [], "seq", F.col("seq"), "p", F.floor(F.col("seq") / 7))
    assert all(r["p"] == (r["seq"] - 1 if r["seq"] else None) for r in whole.collect())


@pytest.mark.parametrize("n", [10, 1_000, 100_000])
def test_order_helpers_equal_windows(spark, n):
    """NULLs, ties and every ordered type, at any size."""
    key = F.when(F.col("id") % 10 != 0, (F.col("id") * 7919) % (n // 2 + 1))
    df = spark.range(n).select(
        "id", F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 5).cast("string")).alias("g"),
        key.alias("num"), key.cast("string").alias("txt"), F.date_add(F.lit("2024-01-01").cast("date"), (key % 900).cast("int")).alias("day"),
        F.timestamp_seconds(key).alias("ts"), (key / 7).cast("decimal(18,3)").alias("dec"), (key / 7).alias("dbl"),
    )
    for column in ["num", "txt", "day", "ts", "dec", "dbl"] if n == 1_000 else ["num", "ts"]:
        for descending in (True, False):
            order = F.desc(column) if descending else F.asc(column)
            want = F.rank().over(Window.partitionBy("g").orderBy(order)).cast("long")
            got = ordered.rank_by(df, ["g"], column, "r", descending)
            assert got.join(df.select(F.col("id").alias("i"), want.alias("w")), F.col("id") == F.col("i")).where("r <> w").isEmpty()
    unique = df.select("g", "id", F.when(F.col("id") != 4, F.col("id").cast("string")).alias("o"))
    w = Window.partitionBy("g").orderBy("o")
    want = unique.select("id", (F.row_number().over(w) - 1).alias("p"), F.lag("id").over(w).alias("b"))
    at = ordered.position(unique, ["g"], "o", "at").join(want, "id")
    assert at.where("at <> p").isEmpty() and at.count() == n
    prev = ordered.previous_value(unique, ["g"], "o", F.col("id"), "prev").join(want, "id")
    assert prev.where("NOT prev <=> b").isEmpty() and prev.count() == n


def test_keys_are_checked(spark):
    a = spark.createDataFrame([(1, "x"), (None, "n"), (2, "y")], "id int, v string")
    twice = a.union(a.where("id = 2"))
    from plait.operators import diff as d, merge as m

    assert d.diff_rows(a, a, ["id"]).isEmpty() and d.diff_added(a, a, ["id"]).isEmpty()
    changed = a.withColumn("v", F.when(F.col("id").isNull(), "new").otherwise(F.col("v")))
    assert rows(d.diff_fields(changed, a, ["id"])) == [(None, "v", "n", "new")]
    for broken in (lambda: d.diff_rows(twice, a, ["id"]), lambda: m.diff3(a, twice, a, ["id"]).rows):
        with pytest.raises(Exception, match="not unique"):
            broken().collect()
    only = a.select("id")
    assert d.diff_fields(only, only.where("id = 1"), ["id"]).isEmpty()
    assert rows(d.diff_rows(only, only.where("id = 1"), ["id"]).select("id", "change")) == [(None, "added"), (2, "added")]


def test_as_of_without_time(spark):
    t = datetime.datetime(2024, 1, 1)
    versions = spark.createDataFrame([("a", "c1", t), ("a", "c2", None)], "branch string, hash string, ts timestamp_ntz")
    probes = spark.createDataFrame([(1, "a", t), (2, "a", None), (3, None, t)], "id int, branch string, at timestamp_ntz")
    got = h.resolve_as_of(versions, probes)
    assert rows(got.select("id", "hash")) == [(1, "c1"), (2, None), (3, None)]


def test_lookup_of_many(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.range(100_001).select(F.lit(1).alias("rk"), "id")
    assert rows(q.lookup(left, right, "k", "rk", "m").select("k", F.size("m"))) == [(1, 100_001), (2, 0)]
    assert rows(q.lookup_agg(left, right, "k", "rk", n=F.count("*"))) == [(1, 100_001), (2, None)]


def test_shared_folder(spark):
    from plait.session import fresh_path, shared_dir, written

    assert fresh_path(spark, "x").startswith(shared_dir(spark))
    assert written(spark.range(5), "five").count() == 5


def test_rank(skewed):
    for descending in (True, False):
        key = F.desc("score") if descending else F.asc("score")
        want = skewed.withColumn("rank", F.rank().over(Window.partitionBy("grp").orderBy(key)).cast("long"))
        assert rows(q.rank_rows(skewed, ["grp"], "score", descending)) == rows(want)


def test_as_of_join(spark):
    rnd = random.Random(5)
    start = datetime.datetime(2024, 1, 1)

    def at(n):
        return start + datetime.timedelta(hours=n)

    versions = [(rnd.choice("ab"), f"c{i:03d}", at(rnd.randint(0, 200))) for i in range(80)]
    probes = [(i, rnd.choice("abz"), at(rnd.randint(-5, 210))) for i in range(120)]
    got = h.resolve_as_of(
        spark.createDataFrame(versions, "branch string, hash string, ts timestamp_ntz"),
        spark.createDataFrame(probes, "id int, branch string, at timestamp_ntz"),
    )
    want = {}
    for i, branch, t in probes:
        fit = [(ts, x) for b, x, ts in versions if b == branch and ts <= t]
        want[i] = max(fit)[1] if fit else None
    assert {r["id"]: r["hash"] for r in got.collect()} == want


@pytest.fixture(scope="module")
def dag(spark):
    """A long chain with a side branch, a merge, a cycle and a lone root."""
    data = [("a0", [])] + [(f"a{i}", [f"a{i-1}"]) for i in range(1, 16)]
    data += [("s1", ["a3"]), ("s2", ["s1"]), ("m", ["a9", "s2"]), ("lone", [])]
    data += [("x", ["y"]), ("y", ["x"]), ("cut", ["missing"])]
    return spark.createDataFrame(data, "hash string, parents array<string>")


def test_ancestors(spark, dag):
    graph = {r["hash"]: r["parents"] for r in dag.collect()}

    def walk(head):
        depth, level, found = -1, {head}, {}
        while level:
            for x in level:
                found.setdefault(x, depth)
            level = {p for x in level for p in graph[x] if p in graph} - set(found)
            depth += 1
        return found

    heads = spark.createDataFrame([("a15",), ("m",), ("x",), ("cut",), ("nowhere",)], "hash string")
    for hops in (2, 8):
        got: dict = {}
        for r in g.ancestors(dag, heads, hops=hops).collect():
            got.setdefault(r["head"], {})[r["hash"]] = r["depth"]
        assert got == {x: walk(x) for x in ("a15", "m", "x", "cut")}
    near = g.ancestors(dag, heads.where("hash = 'a15'"), max_depth=1)
    assert rows(near.select("hash", "depth")) == [("a13", 1), ("a14", 0), ("a15", -1)]


def test_log_and_common_ancestor(spark, dag):
    heads = spark.createDataFrame([("dev", "m"), ("main", "a15"), ("none", "zz")], "branch string, hash string")
    log = g.commit_log(dag, heads, limit=None)
    dev = [r["hash"] for r in log.where("branch = 'dev'").orderBy("pos").collect()]
    assert dev == ["m"] + [f"a{i}" for i in range(9, -1, -1)]
    assert log.where("branch = 'main'").count() == 16
    assert g.commit_log(dag, heads, limit=5).groupBy("branch").count().where("count <> 5").isEmpty()
    pairs = spark.createDataFrame(
        [("a15", "m"), ("m", "a7"), ("a5", "s2"), ("a15", "lone"), ("s2", "s2")], "a string, b string"
    )
    got = {(r["a"], r["b"]): r["base"] for r in g.common_ancestor(dag, pairs).collect()}
    assert got == {("a15", "m"): "a9", ("m", "a7"): "a7", ("a5", "s2"): "a3", ("s2", "s2"): "s2"}
    depth = g.nesting_depth(
        spark.createDataFrame([("r", None), ("c", "r"), ("d", "c"), ("e", "d")], "name string, parent string")
    )
    assert rows(depth) == [("c", 1), ("d", 2), ("e", 3), ("r", 0)]


def test_tables_and_resolve(spark):
    info = "struct<row_count:bigint>"
    commits = spark.createDataFrame(
        [
            ("c1", "dev", datetime.datetime(2024, 1, 1), {"u": (2,), "e": (0,)}),
            ("c2", "dev", datetime.datetime(2024, 1, 3), {"u": (3,)}),
            ("s1", "side", datetime.datetime(2024, 1, 2), {"u": (2,)}),
        ],
        f"hash string, branch string, ts timestamp, snapshot map<string,{info}>",
    )

    def one(branch, at):
        found = h.resolve(commits, branch, at).collect()
        return found[0]["hash"] if found else None

    assert one("dev", "2024-01-02T12:00:00Z") == "c1"
    assert one("side", "2024-01-01 12:00:00") is None
    assert one("dev", "s1") == "s1"
    assert one("dev", "no date") is None
    assert rows(h.tables_at(commits)) == [("c1", "u"), ("c2", "u"), ("s1", "u")]


def _blame_model(chain, versions, branch):
    """Field history of one key, walking newest to oldest."""
    seen = [(pos, versions[pos]) for pos in sorted(versions) if versions[pos] is not None or True]
    out, newer = {}, None
    for pos, row in seen:
        if row is None and newer is not None:
            break
        if row is None:
            continue
        if newer is not None:
            for f, v in newer.items():
                if v is not None and v != row[f]:
                    out.setdefault(f, []).append((v, pos - 1))
        newer = row
    if newer is None:
        return {}
    holding = [pos for pos, row in versions.items() if row is not None]
    own = [pos for pos in holding if chain[pos] == branch]
    created = max(own) if own else max(holding)
    for f, v in newer.items():
        if v is not None and f not in out:
            out[f] = [(v, created)]
    return out


def test_blame_against_model(spark):
    rnd = random.Random(11)
    positions = [0, 1, 3, 4, 6, 7]  # the table is missing at 2 and 5
    chain = {pos: "dev" if pos < 6 else "main" for pos in range(8)}
    chain_df = spark.createDataFrame(
        [(p, f"h{p}", b, "amy", "t") for p, b in chain.items()],
        "pos int, hash string, branch string, author string, ts string",
    )
    keys = {
        k: {p: None if rnd.random() < 0.3 else {"a": rnd.choice(["1", "2", None]), "b": rnd.choice(["x", "y"])}
            for p in positions}
        for k in range(60)
    }
    keys = {k: v for k, v in keys.items() if any(v.values())}
    data = [(k, p, r["a"], r["b"]) for k, v in keys.items() for p, r in v.items() if r]
    versions = spark.createDataFrame(data, "id int, pos int, a string, b string")
    want = sorted(
        (k, f, value, pos)
        for k, v in keys.items()
        for f, entries in _blame_model(chain, v, "dev").items()
        for value, pos in entries
    )
    for spans in (None, [(p, p, p if chain[p] == "dev" else None) for p in positions]):
        got = h.blame(versions, chain_df, ["id"], "dev", spans)
        assert sorted((r["id"], r["field"], r["value"], r["pos"]) for r in got.collect()) == want
        assert got.where("hash <> concat('h', pos)").isEmpty()


def test_blame_with_shared_versions(spark):
    chain = spark.createDataFrame(
        [(p, f"h{p}", "dev" if p < 4 else "main", "amy", "t") for p in range(6)],
        "pos int, hash string, branch string, author string, ts string",
    )
    new, old = [(1, "x", "2")], [(1, "x", "1")]
    full = spark.createDataFrame(
        [(p, *r) for p, data in enumerate([new, new, old, old, old, old]) for r in data],
        "pos int, id int, a string, b string",
    )
    want = rows(h.blame(full, chain, ["id"], "dev"))
    short = full.where("pos in (0, 2)")
    assert rows(h.blame(short, chain, ["id"], "dev", [(0, 1, 1), (2, 5, 3)])) == want
    assert [(r[1], r[3]) for r in want] == [("a", 3), ("b", 1)]


def test_drift_and_deploy_messages(spark):
    log = spark.createDataFrame([(5, "dev"), (9, "dev"), (4, "main")], "seq bigint, branch string")
    base = spark.createDataFrame(
        [("b1", "dev", 9), ("b2", "dev", 8), ("b3", "new", 0)], "id string, branch string, seq bigint"
    )
    got = {r["id"]: (r["status"], r["reason"]) for r in h.drift(base, log).collect()}
    assert got["b1"] == ("clean", 'No changes detected on "dev" since baseline "b1".')
    assert got["b2"] == ("drifted", 'Branch "dev" changed since baseline "b2".')
    assert got["b3"][0] == "clean"
    requests = spark.createDataFrame(
        [("r1", "dev", "main", "approved", 3), ("r2", "dev", "main", "approved", 9),
         ("r3", "dev", "main", "approved", None), ("r4", "dev", "main", "open", 0)],
        "id string, source string, target string, status string, approval_seq bigint",
    )
    assert rows(h.stale_approvals(requests, log)) == [
        ("r1", "source dev has moved on since its approval; target main has moved on since its approval"),
        ("r3", "approved at no known position"),
    ]


# --- row changes and undo ---------------------------------------------------------------------


@pytest.fixture()
def people(spark):
    return spark.createDataFrame(
        [(1, "Ann", 10, ("x", 1)), (2, "Bob", 20, None), (3, "Cid", None, ("z", 3))],
        "id int, name string, score int, info struct<city:string,zip:int>",
    )


def test_writes_and_undo(spark, people):
    one, log1 = c.update(people, F.col("score") >= 10, {"score": F.lit(0), "info.zip": F.lit(9)}, ["id"], 1, "amy", one=True)
    assert rows(one.select("id", "score", "info.zip")) == [(1, 0, 9), (2, 20, None), (3, None, 3)]
    assert log1.count() == 1
    two, log2 = c.delete(one, F.col("name") == "Bob", ["id"], 2)
    new = spark.createDataFrame([(4, "Dee", 5, None)], people.schema)
    three, log3 = c.insert(two, new, ["id"], 3)
    four, log4 = c.update(three, F.lit(True), {"name": F.upper("name")}, ["id"], 4)
    log = log1.union(log2).union(log3).union(log4)
    assert rows(c.op_summary(log)) == [(1, 4, 1, 6)]
    assert rows(four.select("name")) == [("ANN",), ("CID",), ("DEE",)]
    back, rest = c.undo_last(four, log, 1, ["id"])
    assert rows(back) == rows(three) and rest.count() == 3
    back, rest = c.undo_last(four, log, 0, ["id"])
    assert rows(back) == rows(four) and rest.count() == 6
    back, rest = c.undo_last(four, log, 4, ["id"])
    assert rows(back) == rows(people) and rest.isEmpty()
    with pytest.raises(ValueError, match="key exists"):
        c.insert(people, people.limit(1), ["id"], 5)
    counts = c.update_counts(people, F.col("id") < 3, {"score": F.lit(10)}).collect()[0]
    assert (counts["matched"], counts["modified"]) == (2, 1)
    none, empty = c.update(people, F.col("id") > 99, {"score": F.lit(1)}, ["id"], 1, one=True)
    assert rows(none) == rows(people) and empty.isEmpty()


def test_bulk_operations(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    ops = [
        (1, 1, "update", "x"), (2, 1, "delete", None), (3, 2, "delete", None), (4, 2, "insert", "n"),
        (5, 2, "update", "m"), (6, 4, "update", "lost"), (7, 5, "insert", "five"), (8, 3, "delete", None),
        (9, 3, "update", "dead"),
    ]
    df = spark.createDataFrame(
        [(o, k, op, (k, v)) for o, k, op, v in ops], "ord int, id int, op string, row struct<id:int,v:string>"
    )
    assert rows(c.apply_ops(base, df, ["id"])) == [(2, "m"), (5, "five")]


def test_update_expressions(spark):
    df = spark.createDataFrame([(1, None, ["a", "b"]), (2, 6, None)], "id int, n int, l array<string>")
    got = df.select(
        u.increment(F.col("n"), 2), u.multiply(F.col("n"), 3), u.lower_to(F.col("n"), 4), u.raise_to(F.col("n"), 9),
        u.push(F.col("l"), ["z"]), u.add_to_set(F.col("l"), ["b", "c", "c"]), u.push(F.col("l"), ["q"], at=0, keep=2),
        u.pop(F.col("l")),
    ).collect()
    assert list(got[0]) == [2, 0, 4, 9, ["a", "b", "z"], ["a", "b", "c"], ["q", "a"], ["a"]]
    assert list(got[1])[:7] == [8, 18, 4, 9, ["z"], ["b", "c"], ["q"]]


# --- ancestry against plain walks ------------------------------------------------------------


def plain_up(graph, head):
    """Least number of steps from a head to each ancestor, less one."""
    depth, front = {head: -1}, [head]
    while front:
        nexts = [p for h in front for p in graph[h] if p in graph and p not in depth]
        depth |= {p: depth[h] + 1 for h in front for p in graph[h] if p in graph and p not in depth}
        front = list(dict.fromkeys(nexts))
    return depth


def plain_base(graph, a, b):
    up_a, up_b = plain_up(graph, a), plain_up(graph, b)
    return min(((d, h) for h, d in up_b.items() if h in up_a), default=None)


def random_graph(rng, size, merges, roots=3):
    """Commits named by number, each newer than its parents, and their generations."""
    graph, level = {}, {}
    for i in range(size):
        name = f"c{i:04d}"
        known = list(graph)
        near = known[-6:] if rng.random() < 0.8 else known
        parents = [] if i < roots else rng.sample(near, min(len(near), 2 if rng.random() < merges else 1))
        graph[name], level[name] = parents, 1 + max([level[p] for p in parents], default=-1)
    return graph, level


@pytest.mark.parametrize("hops, merges, levels", [(1, 0.3, True), (6, 0.3, True), (3, 0.8, True), (2, 0.3, False), (6, 0.0, False)])
def test_merge_bases_against_walks(spark, hops, merges, levels):
    rng = random.Random(hops * 10 + int(merges * 10))
    graph, level = random_graph(rng, 120, merges)
    names = list(graph)
    rows = [(h, p, level[h]) for h, p in graph.items()] + [("torn", ["gone", "c0005"], 99)]
    graph["torn"] = ["gone", "c0005"]
    commits = spark.createDataFrame(rows, "hash string, parents array<string>, generation long")
    commits = commits if levels else commits.drop("generation")
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(60)] + [("c0100", "c0100"), ("torn", "c0050"), ("none", "c0001")]
    got = g.common_ancestor(commits, spark.createDataFrame(pairs, "a string, b string"), hops=hops).collect()
    want = {(a, b): plain_base(graph, a, b) for a, b in pairs if a in graph}
    assert {(r.a, r.b): (r.depth, r.base) for r in got} == {k: v for k, v in want.items() if v is not None}
    assert len(got) == len({(r.a, r.b) for r in got})


def test_pairs_leave_when_they_are_certain(spark, monkeypatch):
    """Two branches of a long history that part near its end: the walk stops there."""
    graph = {f"m{i:04d}": [f"m{i - 1:04d}"] if i else [] for i in range(400)}
    graph |= {"a1": ["m0395"], "a2": ["a1"], "b1": ["m0390"], "b2": ["b1"], "b3": ["b2", "m0380"]}
    level = {h: int(h[1:]) for h in graph if h[0] == "m"} | {"a1": 396, "a2": 397, "b1": 391, "b2": 392, "b3": 393}
    commits = spark.createDataFrame([(h, p, level[h]) for h, p in graph.items()], "hash string, parents array<string>, generation long")
    rounds = []
    advance = g._Walk.advance
    monkeypatch.setattr(g._Walk, "advance", lambda w: rounds.append(1) or advance(w))
    got = g.common_ancestor(commits, spark.createDataFrame([("a2", "b3")], "a string, b string")).first()
    assert (got.base, got.depth) == ("m0380", 0) and len(rounds) <= 4
    walked = g.ancestors(commits, spark.createDataFrame([("b3",)], "hash string")).collect()
    assert {r.hash: r.depth for r in walked} == plain_up(graph, "b3")


@pytest.mark.parametrize("limit, hops", [(None, 16), (50, 16), (100, 16), (None, 2), (9, 2), (1, 16)])
def test_logs_of_long_and_short_chains(spark, limit, hops):
    graph = {f"m{i:04d}": [f"m{i - 1:04d}"] if i else [] for i in range(150)} | {"x1": ["m0003", "m0100"], "y": ["lost"]}
    commits = spark.createDataFrame(list(graph.items()), "hash string, parents array<string>")
    heads = [("long", "m0149"), ("short", "x1"), ("torn", "y"), ("none", "nowhere"), ("twin", "m0149")]
    got = sorted((r.branch, r.pos, r.hash) for r in g.commit_log(commits, spark.createDataFrame(heads, "branch string, hash string"), limit, hops).collect())
    want = []
    for branch, h in heads:
        pos = 0
        while h in graph and (limit is None or pos < limit):
            want.append((branch, pos, h))
            h, pos = (graph[h] or [None])[0], pos + 1
    assert got == sorted(want)
