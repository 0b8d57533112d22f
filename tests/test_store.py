import pytest
from pyspark.sql import functions as F

from plait.functions.canonical import table_digest
from plait.operators import changesets as cs
from plait.sources.records import Records, Taken
from plait.sources.requests import Requests
from plait.sources.store import Store


@pytest.fixture()
def store(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield from _store(spark, tmp_path)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def _store(spark, tmp_path):
    users = spark.createDataFrame(
        [(1, "Alice", "admin", 10), (2, "Bob", "user", 20), (3, "Cid", "user", 30)],
        "id int, name string, role string, score int",
    )
    items = spark.createDataFrame([(1, "pen", 1.5), (2, "ink", 3.0)], "id int, item string, price double")
    s = Store(spark, str(tmp_path / "store"))
    s.init({"users": (users, ["id"]), "items": (items, ["id"])})
    yield s


def rows(df):
    return sorted(map(tuple, df.collect()))


def edit(store, branch, condition, column, value):
    t = store.table(branch, "users")
    store.write(
        branch, "users", t.withColumn(column, F.when(F.expr(condition), F.lit(value)).otherwise(F.col(column)))
    )


def test_branch_commit_merge_and_time_travel(store):
    store.create_branch("dev", created_by="amy")
    first = store.branch("dev").head_commit
    edit(store, "dev", "id = 1", "score", 11)
    c1 = store.commit("dev", "score", "amy")
    assert store.table("main", "users").where("score = 11").isEmpty()
    assert rows(store.diff("dev", "main")) == [("users", "1", "modified")]
    edit(store, "main", "id = 2", "name", "Bobby")
    store.commit("main", "rename", "max")
    assert store.common_ancestor("main", "dev") == first
    done = store.merge("dev", "main", author="max")
    assert done["success"] and done["tables"] == ["users"] and done["rows_modified"] == 1
    assert rows(store.table("main", "users").select("id", "name", "score")) == [
        (1, "Alice", 11), (2, "Bobby", 20), (3, "Cid", 30),
    ]
    log = store.log("main").collect()
    assert [r["message"] for r in log] == ['Merge "dev" into "main"', "rename", "bootstrap main history"]
    assert len(log[0]["parents"]) == 2 and log[0]["parents"][1] == c1
    assert rows(store.find_at("main", "users", c1, {"id": 1}).select("score")) == [(11,)]
    assert rows(store.find_at("main", "users", first).select("score")) == [(10,), (20,), (30,)]
    with pytest.raises(KeyError):
        store.find_at("main", "users", "1999-01-01")
    assert store.tables_at("main", c1) == ["items", "users"]
    with pytest.raises(KeyError):
        store.branch("nothing")


def test_conflict_strategies(store):
    store.create_branch("a")
    edit(store, "a", "id = 1", "score", 99)
    store.commit("a", "a")
    edit(store, "main", "id = 1", "score", 50)
    store.commit("main", "m")
    failed = store.merge("a")
    assert not failed["success"] and failed["conflict_count"] == 1
    assert rows(failed["conflicts"]["users"]) == [(1, "score", "10", "50", "99")]
    assert rows(store.table("main", "users").where("id = 1").select("score")) == [(50,)]
    refused = store.merge(
        "a", strategy="theirs", gate=[(1, "never", lambda plan: (False, "closed"))]
    )
    assert not refused["success"] and refused["reason"] == "closed"
    assert store.merge("a", strategy="theirs")["success"]
    assert rows(store.table("main", "users").where("id = 1").select("score")) == [(99,)]


def test_lazy_partial_schema_only_and_rules(store):
    store.create_branch("lazy", lazy=True)
    store.create_branch("child", parent="lazy", lazy=True)
    edit(store, "lazy", "id = 3", "score", 33)
    assert rows(store.table("child", "users").where("id = 3").select("score")) == [(33,)]
    assert store.materialization("lazy") == {"materialized": ["users"], "pending": ["items"]}
    edit(store, "main", "id = 1", "score", 12)
    assert rows(store.table("lazy", "users").where("id = 1").select("score")) == [(10,)]
    store.create_branch("part", tables=["items"])
    assert store.list_tables("part") == ["items"]
    with pytest.raises(ValueError, match="nope"):
        store.create_branch("bad", tables=["items", "nope"])
    store.create_branch("shape", schema_only=True)
    empty = store.table("shape", "users")
    assert empty.isEmpty() and empty.columns == ["id", "name", "role", "score"]
    store.create_branch("fixed", read_only=True)
    with pytest.raises(PermissionError):
        edit(store, "fixed", "id = 1", "score", 0)
    users = store.table("lazy", "users")
    with pytest.raises(ValueError, match="not unique"):
        store.write("lazy", "users", users.union(users))
    assert store.table("lazy", "users").count() == 3
    for name in ("", "main", "-x", "a b"):
        with pytest.raises(ValueError):
            store.create_branch(name)
    with pytest.raises(ValueError, match="exists"):
        store.create_branch("part")
    with pytest.raises(ValueError, match="depth"):
        store.create_branch("deep", parent="child", max_depth=1)


def test_cherry_pick_revert_blame_tags(store):
    store.create_branch("dev")
    edit(store, "dev", "id = 1", "score", 11)
    c1 = store.commit("dev", "one", "amy")
    edit(store, "dev", "id = 1", "role", "owner")
    c2 = store.commit("dev", "two", "bea")
    store.create_branch("other")
    store.cherry_pick("other", c1)
    assert rows(store.table("other", "users").where("id = 1").select("role", "score")) == [("admin", 11)]
    picked = store.log("other").collect()[0]["message"]
    assert picked == f"Cherry-pick: one (from {c1[:8]})"
    store.revert("dev", c1)
    assert rows(store.table("dev", "users").where("id = 1").select("role", "score")) == [("admin", 10)]
    store.cherry_pick("dev", c2)
    blame = store.blame("dev", "users").where("id = 1")
    assert blame.where("field = 'score'").count() == 3
    assert blame.where("field = 'name'").count() == 1
    store.tag("v1", c1)
    assert store.resolve_tag("v1") == c1
    with pytest.raises(ValueError):
        store.tag("v1", c2)
    with pytest.raises(KeyError):
        store.tag("v2", "missing")


def test_checkpoint_stash_reset_garbage(store):
    store.create_branch("dev")
    point = store.checkpoint("dev", "before")
    edit(store, "dev", "true", "score", 0)
    store.commit("dev", "zero")
    out = store.restore("dev", point)
    assert out == {"tables_restored": 2, "rows_restored": 5, "commits_rolled_back": 1}
    assert rows(store.table("dev", "users").select("score")) == [(10,), (20,), (30,)]
    for _ in range(3):
        store.checkpoint("dev")
    assert store.prune_checkpoints("dev", 2) == 2
    assert store.checkpoints("dev").count() == 2
    assert not store.delete_checkpoint("dev", point)

    store.stash("dev", "later")
    assert store.table("dev", "users").isEmpty()
    with pytest.raises(ValueError):
        store.stash("dev")
    assert [r["position"] for r in store.stashes("dev").collect()] == [0]
    store.pop_stash("dev")
    assert store.table("dev", "users").count() == 3
    with pytest.raises(KeyError):
        store.pop_stash("dev")

    edit(store, "dev", "id = 1", "score", 5)
    assert store.reset_to_parent("dev")["tables_reset"] == 2
    assert rows(store.table("dev", "users").select("score")) == [(10,), (20,), (30,)]
    edit(store, "dev", "id = 1", "score", 6)
    store.delete_branch("dev")
    cleaned = store.collect_garbage()
    assert cleaned["branches"] == 1 and cleaned["folders"] >= 1
    assert store.garbage().isEmpty()
    assert store.table("main", "users").count() == 3


def newest_change_rows(spark, store, table="users"):
    logged = store._logged(None, table, None).orderBy(F.desc("seq")).first()
    return store._change_sets(table, logged["keys"], logged["columns"], [logged["id"]])


def test_editing_one_row_writes_one_row(spark, store):
    before = store.branch("main").tables["users"]
    store.update("main", "users", F.col("id") == 2, {"score": F.lit(21)}, by="amy")
    after = store.branch("main").tables["users"]
    assert after.base == before.base and len(after.deltas) == 1 and after.row_count == 3
    assert newest_change_rows(spark, store).count() == 1
    edit(store, "main", "id = 3", "score", 33)  # a whole table given, one row of it new
    assert newest_change_rows(spark, store).count() == 1
    assert rows(store.table("main", "users").select("id", "score")) == [(1, 10), (2, 21), (3, 33)]
    last = store.position()
    edit(store, "main", "id = 3", "score", 33)
    assert store.position() == last  # nothing changed, nothing logged


def test_versions_follow_a_plain_model(spark, store):
    """Many writes across several bases: rows, counts and checksums stay those of the table."""
    model = {1: ("Alice", "admin", 10), 2: ("Bob", "user", 20), 3: ("Cid", "user", 30)}
    store.insert("main", "users", spark.range(10, 60).selectExpr("cast(id as int) id", "'n' name", "'r' role", "cast(id as int) score"))
    model |= {i: ("n", "r", i) for i in range(10, 60)}
    made = []
    for i in range(20):
        if i % 5 == 4:
            store.delete("main", "users", F.col("id") == 10 + i)
            model.pop(10 + i)
        else:
            store.update("main", "users", F.col("id") % 7 == i % 7, {"score": F.col("score") + 1})
            model = {k: (*v[:2], v[2] + (k % 7 == i % 7)) for k, v in model.items()}
        if i % 4 == 0:
            made.append((store.commit("main", f"c{i}"), dict(model)))
    want = sorted((k, *v) for k, v in model.items())
    entry = store.branch("main").tables["users"]
    assert rows(store.table("main", "users")) == want and entry.row_count == len(want)
    assert len(entry.deltas) < 16 and entry.origin is not None
    digest = table_digest(store.table("main", "users")).first()
    assert (digest["row_count"], digest["checksum"]) == (entry.row_count, entry.checksum)
    for value, old in made[::2]:
        assert rows(store.read_at(value)["users"]) == sorted((k, *v) for k, v in old.items())
    again = Store(spark, store.root)
    assert rows(again.table("main", "users")) == want


def test_log_of_writes_and_undo(spark, store):
    store.create_branch("dev")
    start = store.position()
    store.update("dev", "users", F.col("role") == "user", {"score": F.col("score") * 2}, by="amy")
    store.upsert("dev", "users", spark.createDataFrame([(3, "Cy"), (9, "New")], "id int, name string"), by="bea")
    store.delete("dev", "users", F.col("id") == 1, by="amy")
    store.insert("main", "items", spark.createDataFrame([(3, "cup", 9.0)], "id int, item string, price double"))
    log = store.op_log("dev", "users").orderBy("seq", "key").collect()
    assert [(r.op, r.key, r.performed_by) for r in log] == [
        ("update", "2", "amy"), ("update", "3", "amy"), ("update", "3", "bea"), ("insert", "9", "bea"), ("delete", "1", "amy"),
    ]
    assert log[2].before == '{"id":3,"name":"Cid","role":"user","score":60}' and log[4].after is None
    assert len({r.seq for r in log}) == 3 and all(r.seq > start for r in log)
    assert store.op_log(after=store.position()).count() == 0
    assert {r.table for r in store.op_log(after=start).collect()} == {"users", "items"}
    assert store.table_log("dev", "users").where("after.score = 60").count() == 2
    with pytest.raises(ValueError, match="exists"):
        store.insert("dev", "users", store.table("dev", "users").limit(1))
    store.undo("dev", "users", 2)
    assert rows(store.table("dev", "users").select("id", "name", "score")) == [(1, "Alice", 10), (2, "Bob", 40), (3, "Cid", 60)]
    assert store.op_log("dev", "users").where("action = 'undo'").count() == 3
    store.undo("dev", "users", 1)  # an undo is a write like any other
    assert store.table("dev", "users").count() == 3 and store.table("dev", "users").where("id = 9").count() == 1


def test_merge_reads_changes_only(spark, store):
    store.insert("main", "users", spark.range(100, 5100).selectExpr("cast(id as int) id", "'n' name", "'r' role", "1 score"))
    store.commit("main", "many")
    store.create_branch("dev")
    store.update("dev", "users", F.col("id") == 200, {"score": F.lit(2)})
    store.delete("dev", "users", F.col("id") == 201)
    store.commit("dev", "d")
    store.update("main", "users", F.col("id").isin(200, 202), {"role": F.lit("x")})
    store.commit("main", "m")
    src, tgt = store.branch("dev"), store.branch("main")
    base = store._commit_row(store.common_ancestor("main", "dev"))["snapshot"]["users"]
    from plait.sources import store as module

    plans = store._plans({"users": module._entry(base)}, tgt.tables, src.tables)
    assert plans["users"].rows.count() == 2  # of 5,003 keys
    assert not [f for f in plans["users"].rows.inputFiles() if "/data/" in f]
    done = store.merge("dev", "main")
    assert (done["rows_modified"], done["rows_removed"], done["conflict_count"]) == (1, 1, 0)
    assert newest_change_rows(spark, store).count() == 2
    got = store.table("main", "users").where("id BETWEEN 199 AND 203").select("id", "role", "score")
    assert rows(got) == [(199, "r", 1), (200, "x", 2), (202, "x", 1), (203, "r", 1)]


def test_second_writer_looks_again(spark, store, monkeypatch):
    """Another writer publishes between a writer's look at the store and its record."""
    other = Store(spark, store.root)
    create, turns = Records.create, []

    def late(records, seq, record):
        if records is store._records and not turns:
            turns.append(seq)
            other.update("main", "users", F.col("id") == 1, {"score": F.lit(11)})
            other.update("main", "items", F.col("id") == 1, {"price": F.lit(9.5)})
        create(records, seq, record)

    monkeypatch.setattr(Records, "create", late)
    store.update("main", "users", F.col("id") == 2, {"score": F.col("score") + 1})
    assert rows(store.table("main", "users").select("id", "score")) == [(1, 11), (2, 21), (3, 30)]
    assert rows(other.table("main", "items").select("price")) == [(3.0,), (9.5,)]
    log = store.reflog().select("seq").collect()
    assert len(log) == len({r.seq for r in log})
    with pytest.raises(Taken):
        create(store._records, turns[0], {"action": "again"})


def test_merge_starts_anew_when_the_target_moves(spark, store, monkeypatch):
    store.create_branch("dev")
    store.update("dev", "users", F.col("id") == 1, {"score": F.lit(99)})
    store.commit("dev", "d")
    other, create, turns = Store(spark, store.root), Records.create, []

    def late(records, seq, record):
        if record["action"] == "merge" and not turns:
            turns.append(seq)
            other.update("main", "users", F.col("id") == 3, {"score": F.lit(31)})
            other.commit("main", "meanwhile")
        create(records, seq, record)

    monkeypatch.setattr(Records, "create", late)
    assert store.merge("dev", "main")["success"]
    assert rows(store.table("main", "users").select("id", "score")) == [(1, 99), (2, 20), (3, 31)]
    head = store.log("main").first()
    assert head["message"] == 'Merge "dev" into "main"' and store.log("main").count() == 3


def test_crash_before_the_record_changes_nothing(spark, store, monkeypatch):
    store.create_branch("dev")
    store.update("dev", "users", F.col("id") == 1, {"score": F.lit(99)})
    store.commit("dev", "d")
    last, create = store.position(), Records.create

    def crash(records, seq, record):
        raise OSError("the machine is gone")

    monkeypatch.setattr(Records, "create", crash)
    with pytest.raises(OSError):
        store.merge("dev", "main")
    with pytest.raises(OSError):
        store.update("dev", "users", F.col("id") == 2, {"score": F.lit(0)})
    monkeypatch.setattr(Records, "create", create)
    fresh = Store(spark, store.root)
    assert fresh.position() == last and fresh.branch("dev").status == "active"
    assert rows(fresh.table("main", "users").select("score")) == [(10,), (20,), (30,)]
    assert rows(fresh.table("dev", "users").select("score")) == [(20,), (30,), (99,)]
    assert fresh.op_log("dev", "users").count() == 1  # the orphaned change set is in no record
    assert fresh.merge("dev", "main")["success"]


def test_opening_reads_a_saved_state(spark, store, monkeypatch):
    monkeypatch.setattr("plait.sources.store.STATE_EVERY", 4)
    for i in range(9):
        store.create_branch(f"b{i}")
    store.delete_branch("b0")
    store.tag("v1", store.branch("b1").head_commit)
    point = store.checkpoint("b2", "keep")
    reads = []
    read = Records._read
    monkeypatch.setattr(Records, "_read", lambda r, p: reads.append(p) or read(r, p))
    fresh = Store(spark, store.root)
    assert fresh.branch("b8").parent == "main" and fresh.resolve_tag("v1")
    assert len([p for p in reads if "/log/" in p]) <= 5
    assert fresh.restore("b2", point)["tables_restored"] == 2
    with pytest.raises(KeyError):
        fresh.branch("b0")
    assert fresh.delete_tag("v1") and not fresh.delete_tag("v1") and fresh.tags().count() == 0


def test_compare_all_tables(spark, store):
    store.create_branch("a")
    store.create_branch("b", tables=["users"])
    store.update("a", "users", F.col("id") == 1, {"score": F.lit(1)})
    store.write("b", "extra", spark.createDataFrame([(1, "x")], "id int, v string"), ["id"])
    got = {(r.table, r.key): (r.main, r.a, r.b) for r in store.compare_all(["main", "a", "b"]).collect()}
    assert got[("users", "1")] == ("present", "modified", "present")
    assert got[("items", "1")] == ("present", "present", "absent")
    assert got[("extra", "1")] == ("absent", "absent", "present")


def test_masked_branch(spark, store):
    people = spark.createDataFrame([(1, ("a@b.cd", "Al")), (2, None)], "id int, who struct<mail:string,name:string>")
    store.write("main", "people", people, ["id"])
    counts = store.masked_branch("safe", {"people": {"who.mail": "redact", "who.none": "mask"}, "users": {"name": "hash", "score": "null"}})
    assert counts == {"people": {"rows_changed": 1, "fields_changed": 1}, "users": {"rows_changed": 3, "fields_changed": 6}}
    got = store.table("safe", "people").orderBy("id").collect()
    assert got[0]["who"]["mail"] == "[REDACTED]" and got[0]["who"]["name"] == "Al" and got[1]["who"] is None
    assert store.table("safe", "users").where("name = 'Alice' OR score IS NOT NULL").isEmpty()
    assert store.table("safe", "items").count() == 2 and store.table("main", "users").where("name = 'Alice'").count() == 1
    with pytest.raises(ValueError, match="nope"):
        store.masked_branch("other", {"nope": {"x": "hash"}})


def test_deploy_requests(spark, store):
    asked = Requests(store)
    store.create_branch("dev")
    store.update("dev", "users", F.col("id") == 1, {"score": F.lit(99)})
    store.commit("dev", "d")
    id = asked.open("dev", "main", "raise a score", "amy")
    assert asked.get(id)["changes"] == {"modified": 1}
    with pytest.raises(ValueError, match="open"):
        asked.open("dev", "main", "again", "bea")
    with pytest.raises(ValueError, match="not approved"):
        asked.execute(id)
    asked.approve(id, "max")
    store.update("dev", "users", F.col("id") == 2, {"score": F.lit(98)})
    with pytest.raises(ValueError, match="source dev has moved on"):
        asked.execute(id)
    assert asked.get(id)["status"] == "approved" and asked.get(id)["reason"]
    asked.reopen(id, "max")
    store.commit("dev", "d2")
    asked.approve(id, "max")
    with pytest.raises(ValueError, match="refused: too late"):
        asked.execute(id, gate=[(1, "hours", lambda rows: (False, "too late"))])
    assert asked.execute(id)["rows_modified"] == 2
    assert asked.get(id)["status"] == "merged" and store.log("main").first()["author"] == "max"
    assert rows(store.table("main", "users").select("score")) == [(30,), (98,), (99,)]
    with pytest.raises(ValueError, match="merged"):
        asked.approve(id, "max")

    store.create_branch("other")
    store.update("other", "users", F.lit(True), {"score": F.lit(1)})
    store.commit("other", "o")
    store.update("main", "users", F.lit(True), {"score": F.lit(2)})
    store.commit("main", "m")
    second = asked.open("other", "main", "clash", "bea")
    asked.approve(second, "max")
    with pytest.raises(ValueError, match="users/1:score, users/2:score, users/3:score"):
        asked.execute(second)
    assert asked.get(second)["status"] == "approved" and store.branch("other").status == "active"
    store.create_branch("third")
    third = asked.open("third", "main", "no", "bea")
    asked.reject(third, "max", "not now")
    assert [r["status"] for r in asked.list().collect()] == ["rejected", "approved", "merged"]
    assert asked.list("merged", "main").count() == 1
    with pytest.raises(KeyError):
        asked.get("none")


def test_a_write_filters_images_before_it_folds_them(spark):
    """Rows that meet a condition now: not those that did once, gone or not yet; null keys are keys."""
    base = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, 0), (None, 5), (6, 5)], "id int, v int")
    rows = [  # ord, id, value after (None: deleted)
        (1, 1, 7), (1, 4, 5), (1, None, 6), (1, 9, 5), (1, 6, None),
        (2, 2, None), (2, 4, 0), (2, 1, 5), (3, 9, 8), (3, 6, 5),
    ]
    changes = spark.createDataFrame(rows, "ord int, id int, v int")
    changes = changes.select("ord", F.struct("id").alias("key"), F.when(F.col("v").isNotNull(), F.struct("id", "v")).alias("after"))
    for many in (False, True):
        whole = cs.fold(base, changes, ["id"], many=many)
        assert {tuple(r) for r in whole.collect()} == {(1, 5), (3, 5), (4, 0), (None, 6), (9, 8), (6, 5)}
        for condition in (F.col("v") == 5, F.col("v") > 5, F.col("id").isNull(), F.lit(None).cast("boolean")):
            got = cs.fold_where(base, changes, ["id"], condition, many=many)
            assert sorted(map(str, got.collect())) == sorted(map(str, whole.where(condition).collect()))
    plan = cs.fold_where(base, changes, ["id"], F.col("v") == 5, many=True)._jdf.queryExecution().executedPlan().toString()
    assert "max_by" not in plan and "BroadcastHashJoin" not in plan
