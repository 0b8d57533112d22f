"""Change feeds: resume, failing handlers, deduplication, applying changes."""

import datetime

import pytest
from pyspark.sql import functions as F

from plait.streaming import feed as f
from tests.conftest import rows

T0 = datetime.datetime(2024, 1, 1)


def change(seq, op, key, before=None, after=None, branch="dev", hours=0):
    return (seq, branch, "t", op, key, before, after, T0 + datetime.timedelta(hours=hours))


def publish(spark, folder, number, *changes):
    f.write_change(number, spark.createDataFrame(list(changes), f.CHANGELOG).coalesce(1), folder)


def test_resume_and_handlers(spark, tmp_path):
    log, mark = str(tmp_path / "log"), str(tmp_path / "mark")
    publish(spark, log, 1, change(1, "insert", "a", None, '{"x":1}'), change(2, "insert", "b", None, '{"x":1}', "main"))
    seen = []

    def good(batch):
        seen.extend(r["seq"] for r in batch.collect())

    def bad(batch):
        raise RuntimeError("handler down")

    def go():
        stream = f.change_feed(f.read_changes(spark, log), "dev")
        return f.run_feed(stream, {"bad": bad, "good": good}, mark)

    assert [x[1:] for x in go()] == [("bad", "handler down")]
    assert seen == [1]
    assert go() == [] and seen == [1]
    publish(spark, log, 2, change(3, "delete", "a", '{"x":1}'))
    assert len(go()) == 1 and seen == [1, 3]


def test_update_description(spark):
    df = spark.createDataFrame(
        [
            change(1, "update", "a", '{"x":1,"y":2,"z":null}', '{"x":1,"y":3,"w":[1]}'),
            change(2, "delete", "a", '{"x":1}'),
            change(3, "insert", "a", None, '{"x":1}'),
        ],
        f.CHANGELOG,
    )
    got = {r["seq"]: r for r in f.change_feed(df, "dev", before_image=True).collect()}
    assert got[1]["updated"] == {"y": "3", "w": "[1]"} and got[1]["removed"] == ["z"]
    assert got[2]["document"] is None and got[2]["document_before"] == '{"x":1}'
    assert got[3]["updated"] is None and got[3]["document"] == '{"x":1}'
    assert f.changed_since(df, "dev", 2) and not f.changed_since(df, "dev", 3)


def test_images_are_parsed_once_a_row(spark, tmp_path):
    log = str(tmp_path / "log")
    publish(spark, log, 1, change(1, "update", "a", '{"x":1,"y":2}', '{"x":2,"z":3}'), change(2, "replace", "b", None, '{"x":1}'))
    feed = f.change_feed(spark.read.schema(f.CHANGELOG).parquet(log), "dev")
    plan = feed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2
    assert [(r["updated"], r["removed"]) for r in feed.orderBy("seq").collect()] == [({"x": "2", "z": "3"}, ["y"]), (None, None)]


def test_saved_events(spark, tmp_path):
    log = str(tmp_path / "log")
    publish(spark, log, 1, *[change(i, "insert", str(i), None, "{}", hours=i) for i in range(5)])
    saved = f.save_feed(f.change_feed(f.read_changes(spark, log)), str(tmp_path / "out"), str(tmp_path / "mark"))
    since = F.lit(T0 + datetime.timedelta(hours=2))
    assert [r["seq"] for r in f.events_since(saved, since).collect()] == [3, 4]


def test_requests_once_with_expiry(spark, tmp_path):
    folder = str(tmp_path / "req")
    schema = "request_id string, ts timestamp, n int"
    batches = [[("a", 0, 1), ("a", 1, 2), ("b", 1, 3)], [("a", 5, 4), ("c", 6, 5)], [("d", 80, 6)], [("a", 90, 7), ("d", 91, 8)]]
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for i, data in enumerate(batches):
        rowset = [(x, T0 + datetime.timedelta(hours=h), n) for x, h, n in data]
        f.write_change(i, spark.createDataFrame(rowset, schema).coalesce(1), folder)
        stream = f.read_changes(spark, folder, schema, files_per_batch=1)
        saved = f.save_feed(f.once_per_request(stream), out, mark)
    assert rows(saved.groupBy("request_id").count()) == [("a", 2), ("b", 1), ("c", 1), ("d", 1)]


def test_apply_feed(spark, tmp_path):
    folder, sets, mark = str(tmp_path / "log"), str(tmp_path / "sets"), str(tmp_path / "mark")
    schema = "seq bigint, id int, after struct<v:string>"
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    for i, data in enumerate([[(1, 1, ("x",)), (2, 1, ("y",)), (3, 3, ("n",))], [(4, 2, None), (5, 3, ("m",))]]):
        f.write_change(i, spark.createDataFrame(data, schema), folder)
        f.apply_feed(f.read_changes(spark, folder, schema), ["id"], sets, mark)
        got = rows(f.current_table(spark, base, sets, ["id"]))
        assert got == ([(1, "y"), (2, "b"), (3, "n")] if i == 0 else [(1, "y"), (3, "m")])
    assert rows(f.current_table(spark, None, sets, ["id"])) == [(1, "y"), (3, "m")]


def test_resume_tokens(spark):
    log = spark.createDataFrame(
        [(i, "dev" if i % 3 else "main", "t", "insert", str(i), None, "{}", None) for i in range(20)], f.CHANGELOG
    )
    assert f.resume_token(log.where("false")) is None and f.position_of(None) is None
    seen, token = [], None
    for upto in (6, 6, 13, 19):  # the second run finds nothing new
        part = log.where(f"seq <= {upto}")
        events = f.feed_after(part, token, "dev").collect()
        seen += [e["seq"] for e in events]
        token = f.resume_token(part)
    assert seen == [i for i in range(20) if i % 3]
    assert [e["seq"] for e in f.feed_until(log, "seq:4").collect()] == [0, 1, 2, 3, 4]
    assert f.feed_until(log, None).isEmpty() and f.feed_after(log, None).count() == 20
    for bad in ("5", "seq:x", ""):
        with pytest.raises(ValueError):
            f.feed_after(log, bad)


def test_failing_handlers_are_listed(spark, tmp_path):
    for i in range(3):
        rows = [(10 * i + j, "dev", "t", "insert", str(j), None, "{}", None) for j in range(4)]
        spark.createDataFrame(rows, f.CHANGELOG).coalesce(1).write.parquet(str(tmp_path / f"log/part={i}"))
    changes = f.read_changes(spark, str(tmp_path / "log/*"), files_per_batch=1)
    done = []

    def count(batch):
        done.append(batch.count())

    def second(batch):
        if batch.where("seq >= 10 AND seq < 20").count():
            raise KeyError("ten")

    def broken(batch):
        raise ValueError("always")

    handlers = {"count": count, "second": second, "broken": broken}
    failed = f.run_handlers(f.change_feed(changes), handlers, str(tmp_path / "c"), str(tmp_path / "f"))
    assert sorted(done) == [4, 4, 4]
    assert sorted(map(tuple, failed.select("handler", "error").collect())) == [
        ("broken", "ValueError: always")] * 3 + [("second", "KeyError: 'ten'")]
    again = f.run_handlers(f.change_feed(changes), handlers, str(tmp_path / "c"), str(tmp_path / "f"))
    assert again.count() == 4 and len(done) == 3


def test_streamed_log_of_a_store_is_written_by_all_tasks(spark, sf, monkeypatch):
    import glob

    from plait.plans import histories

    bases = []
    fresh = histories.fresh_path
    monkeypatch.setattr(histories, "fresh_path", lambda s, label: bases.append(fresh(s, label)) or bases[-1])
    handled = {tuple(r) for r in histories.QUERIES["r4_handler_failures"](spark, sf).collect()}
    assert {(r[0], r[3]) for r in handled} == {("broken", 2), ("count", 0), ("keep", 0)}
    base = next(b for b in bases if "/handlers-" in b).removeprefix("file:")
    for part in range(2):
        assert len(glob.glob(f"{base}/log/part={part}/*.parquet")) > 1
