"""Audit chains, masks, scopes, protections, idempotency, validation, search, names."""

import datetime
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from plait.functions import predicates as p, text as tx
from plait.functions.vectors import cosine
from plait.operators import audit as a, govern as gv, privacy, query as q, search as s
from plait.sources import sinks
from tests.conftest import rows


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def chain_rows(sf, spark):
    """Genesis and the first 200 events, hashed in plain Python."""
    out = [[0, "Audit chain initialized", sha("Audit chain initialized"), "GENESIS"]]
    out[0].append(sha(f"GENESIS:{out[0][2]}:0"))
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").limit(200).collect()
    for e in events:
        detail, seq, prev = f"{e['event_type']}:{e['user_id']}", e["event_id"] + 1, out[-1][4]
        out.append([seq, detail, sha(detail), prev, sha(f"{prev}:{sha(detail)}:{seq}")])
    return out


def entries(spark, data):
    return spark.createDataFrame(
        [tuple(r) for r in data],
        "sequence bigint, detail string, data_hash string, prev_hash string, chain_hash string",
    )


def changed(data, seq, column, value="forged"):
    return [[*r[:column], value, *r[column + 1:]] if r[0] == seq else r for r in data]


def verdict(df, *bounds):
    r = a.chain_verify(df, *bounds, chunk_rows=32).collect()[0]
    return r["valid"], r["total_entries"], r["broken_at"], r["broken_reason"]


def test_chain_verify(spark, chain_rows):
    assert verdict(entries(spark, chain_rows)) == (True, 201, None, None)
    bad = verdict(entries(spark, changed(chain_rows, 50, 1)))
    assert bad == (False, 201, 50, "entry 50: its data hash does not fit its detail")
    bad = verdict(entries(spark, changed(chain_rows, 70, 3)))
    assert bad == (False, 201, 70, "entry 70 does not follow entry 69")
    bad = verdict(entries(spark, changed(chain_rows, 0, 4)))
    assert bad[2:] == (0, "first entry: its chain hash is wrong")
    assert verdict(entries(spark, changed(chain_rows, 200, 4)))[2:] == (200, "entry 200: its chain hash is wrong")
    assert verdict(entries(spark, chain_rows), 100, 150) == (True, 51, None, None)
    assert verdict(entries(spark, changed(chain_rows, 100, 3)), 100, 150)[0]
    assert verdict(entries(spark, changed(chain_rows, 0, 1)))[0]
    gap = [r for r in chain_rows if r[0] != 64]
    assert verdict(entries(spark, gap))[2:] == (65, "entry 65 does not follow entry 63")
    assert a.chain_problems(entries(spark, changed(changed(chain_rows, 9, 1), 80, 1))).count() == 2
    assert verdict(entries(spark, []))[:2] == (True, 0)


def test_chain_append_in_steps(spark, chain_rows):
    batch = spark.createDataFrame([("c", r[0], r[1]) for r in chain_rows[1:]], "chain string, n bigint, detail string")
    last = a.heads(a.genesis(spark.createDataFrame([("c",)], "chain string")))
    got = a.chain_append(last, batch, "n", rows_per_step=64)
    want = [tuple(r) for r in chain_rows[1:]]
    found = got.select("sequence", "detail", "data_hash", "prev_hash", "chain_hash").orderBy("sequence")
    assert [tuple(r) for r in found.collect()] == want
    assert a.chain_append(last, batch.limit(0), "n").isEmpty()


def test_chain_export(spark, chain_rows):
    df = entries(spark, chain_rows[:2]).select(
        "*", F.lit("write").alias("entry_type"), F.lit("main").alias("branch"), F.lit("amy").alias("actor"),
        F.lit("put").alias("action"), F.lit(datetime.datetime(2024, 1, 1)).alias("ts"),
    ).withColumn("detail", F.concat(F.lit('say "'), "detail", F.lit('"')))
    lines = [r["line"] for r in a.chain_export(df, "csv").orderBy("sequence").collect()]
    assert lines[0].startswith('0,write,main,amy,put,"say ""Audit chain initialized""",')
    assert lines[0].endswith(",2024-01-01T00:00:00.000Z")
    header = [r["line"] for r in a.export_header(a.chain_verify(df), "csv", "now").collect()]
    assert header[1] == "# valid: false, entries: 2"
    assert header[2].startswith("sequence,entryType,branchName,actor")
    assert '"brokenAt":1' in a.export_header(a.chain_verify(df), "json", "now").collect()[0]["line"]


def test_event_export(spark, tmp_path):
    ev = spark.createDataFrame(
        [(datetime.datetime(2024, 1, 2), "dev", "merge", 'a "b"'), (datetime.datetime(2024, 1, 1), "dev", "create", None)],
        "timestamp timestamp, branchName string, event string, summary string",
    )
    sinks.write_lines(sinks.event_csv(ev), str(tmp_path / "log"), ",".join(sinks.EVENT_COLUMNS))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "log" / "rows")).collect()]
    assert lines == ['2024-01-01T00:00:00.000Z,dev,create,""', '2024-01-02T00:00:00.000Z,dev,merge,"a ""b"""']
    assert rows(spark.read.text(str(tmp_path / "log" / "header"))) == [("timestamp,branchName,event,summary",)]


@pytest.mark.parametrize(
    "value,want",
    [("alice@corp.io", "a***e@corp.io"), ("a@b.co", "a*a@b.co"), ("ab@x.y", "a*b@x.y"), ("ab", "**"),
     ("x", "*"), ("secret", "s****t"), ("a@b@c", "a*a@b"), (None, None)],
)
def test_mask(spark, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(tx.mask(F.col("v"))).collect()[0][0] == want


def test_anonymize(spark):
    df = spark.createDataFrame(
        [("Al", "al@x.io", "123-45", ("deep", 4)), ("Bo", None, "999-99", None)],
        "name string, email string, ssn string, info struct<note:string,n:int>",
    )
    got = privacy.anonymize(df, {"email": "mask", "ssn": "hash", "info.note": "redact", "nope": "hash", "info.n": "null"})
    assert rows(got.select("name", "email", "ssn", "info")) == [
        ("Al", "a*l@x.io", sha("123-45")[:16], ("[REDACTED]", None)), ("Bo", None, sha("999-99")[:16], None),
    ]
    counts = privacy.anonymize_counts(df, {"name": "hash", "email": "mask", "ssn": "hash"}).collect()[0]
    assert (counts["rows_changed"], counts["fields_changed"]) == (2, 5)
    with pytest.raises(ValueError):
        privacy.anonymize(df, {"name": "scramble"})


def test_names_and_globs(spark):
    names = spark.createDataFrame([("feature/a.b",), ("main",), (" ",), ("-x",), ("a b",)], "n string")
    got = {r[0]: (r[1], r[2]) for r in names.select("n", tx.name_problem(F.col("n")), tx.storage_name(F.col("n"), "p_")).collect()}
    assert got["feature/a.b"] == (None, "p_feature--a-dot-b")
    assert [got[n][0] for n in ("main", " ", "-x", "a b")] == ["reserved", "empty", "invalid", "invalid"]
    rules = spark.createDataFrame(
        [("main", True, 1), ("prod-*", True, 2), ("prod.v1", True, 3), ("*-x(1)", False, 4), ("*", False, 9)],
        "pattern string, merge_only boolean, created_at int",
    )
    branches = ["main", "prod-1", "prod.v1", "prodXv1", "a-x(1)", "prod-x(1)", ""]
    df = spark.createDataFrame([(b,) for b in branches], "name string")
    got = {r["name"]: r["rule"]["pattern"] for r in gv.match_rules(df, rules).collect()}
    assert got == {"main": "main", "prod-1": "prod-*", "prod.v1": "prod.v1", "prodXv1": "*", "a-x(1)": "*-x(1)",
                   "prod-x(1)": "prod-*", "": "*"}
    req = spark.createDataFrame([("prod-1", False), ("prod-1", True), ("dev", False)], "branch string, is_merge boolean")
    assert rows(gv.check_write(req, rules)) == [
        ("dev", False, True, None),
        ("prod-1", False, False, 'Branch "prod-1": rule "prod-*" lets merges through only'),
        ("prod-1", True, True, None),
    ]


def test_scopes_quota_gate(spark):
    scopes = spark.createDataFrame(
        [("pricing", ["read", "write"], ["products"], None, 2), ("deny", ["write"], None, ["orders"], 0)],
        "agent string, permissions array<string>, allowed_tables array<string>, denied array<string>, max_branches int",
    )
    req = spark.createDataFrame(
        [(1, "pricing", "main", "products", "write"), (2, "pricing", "dev", "orders", "write"), (3, "pricing", "dev", "products", "delete"),
         (4, "deny", "dev", "orders", "write"), (5, "free", "ro", "orders", "write"), (6, None, "dev", "orders", "delete")],
        "id int, agent string, branch string, table string, op string",
    )
    protections = spark.createDataFrame([("main", True, 1)], "pattern string, merge_only boolean, created_at int")
    read_only = spark.createDataFrame([("ro",)], "branch string")
    got = {r["id"]: (r["allowed"], r["gate"], r["reason"]) for r in gv.write_gate(req, read_only, protections, scopes).collect()}
    assert got[1][:2] == (False, "protection")
    assert got[2] == (False, "scope", 'Table "orders" is not among the tables of agent "pricing"')
    assert got[3] == (False, "scope", 'Agent "pricing" was not granted "delete" rights')
    assert got[4] == (False, "scope", 'Table "orders" is closed to agent "deny"')
    assert got[5] == (False, "read_only", 'Branch "ro" is read-only')
    assert got[6] == (True, None, None)
    counts = spark.createDataFrame([("pricing", 2), ("deny", 50), ("free", 50)], "agent string, branches int")
    assert rows(gv.check_quota(counts, scopes).select("agent", "allowed")) == [("deny", True), ("free", True), ("pricing", False)]


def test_requests_and_queue(spark):
    t = [datetime.datetime(2024, 1, d) for d in range(1, 6)]
    req = spark.createDataFrame([("a", t[1], 1), ("a", t[0], 2), ("b", t[0], 3), ("c", t[0], 4)], "request_id string, at timestamp, payload int")
    receipts = spark.createDataFrame([("b", "ok", t[0]), ("c", None, t[3])], "request_id string, result string, executed_at timestamp")
    assert rows(gv.first_per_request(req, receipts).select("request_id", "payload")) == [("a", 2), ("c", 4)]
    assert rows(gv.has_receipt(req.select("request_id").distinct(), receipts)) == [("b",)]
    now = F.lit(datetime.datetime(2024, 1, 4, 12))
    assert rows(gv.purge_receipts(receipts, now).select("request_id")) == [("c",)]
    queue = spark.createDataFrame(
        [(1, "x", "pending", t[2]), (2, "y", "pending", t[0]), (3, "z", "processing", t[0]), (4, "w", "completed", t[0])],
        "id int, branch string, status string, queued_at timestamp",
    )
    done = []

    def merge(entry):
        done.append(entry["branch"])
        if entry["branch"] == "y":
            raise RuntimeError("conflict")

    results = gv.merge_batch(queue, merge)
    assert done == ["y", "x"] and [(r["status"], r["error"]) for r in results] == [("failed", "conflict"), ("completed", None)]
    assert rows(gv.already_queued(queue)) == [("x",), ("y",), ("z",)]


def test_row_rules(spark):
    df = spark.createDataFrame([(1, "ab", 5, ["1"]), (2, None, 50, ["1", "x"]), (3, "abcdef", -1, None)], "id int, name string, n int, l array<string>")
    rules = [("name", "required", None), ("name", "max_length", 4), ("n", "minimum", 0), ("n", "maximum", 9), ("l", "items", "int")]
    got = {r["id"]: r["failed"] for r in gv.validate_rows(df, rules).collect()}
    assert got == {1: [], 2: ["name:required", "n:maximum", "l:items"], 3: ["name:max_length", "n:minimum"]}
    good, bad = gv.split_valid(df, rules)
    assert [r["id"] for r in good.collect()] == [1] and bad.count() == 2
    assert gv.require_valid(good, rules).count() == 1
    with pytest.raises(Exception, match="row breaks"):
        gv.require_valid(df, rules).collect()
    with pytest.raises(ValueError):
        gv.validate_rows(df, [("n", "odd", None)])


def test_predicates(spark):
    df = spark.createDataFrame([(1, 5, '{"a":null,"b":[1]}'), (2, None, '{"b":{"c":1}}')], "id int, n int, doc string")
    got = df.select(
        "id", p.not_equal(F.col("n"), 5), p.not_in(F.col("n"), [5]), p.negate(F.col("n") == 5), p.json_has(F.col("doc"), "a"),
        p.json_type(F.col("doc"), "a"), p.json_type(F.col("doc"), "b"), p.order_of(F.col("n"), F.lit(7)),
    )
    assert rows(got) == [(1, False, False, False, True, "null", "array", -1), (2, True, True, True, False, None, "object", -1)]
    kinds = q.infer_schema(df.select("doc"))
    assert rows(kinds) == [("a", "null", 1), ("b", "array,object", 2)]
    assert q.group_all(df.where("id > 9"), n=F.count("*")).isEmpty()
    assert q.count_stage(df.where("id > 9")).isEmpty()


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [1.0, 1.0])], "id int, v array<double>")
    assert rows(s.vector_topk(df, "id", "v", [2.0, 2.0], 3).select("id")) == [(1,), (3,), (4,)]
    zero = df.select(cosine(F.col("v"), F.array(F.lit(0.0), F.lit(0.0)))).collect()[0][0]
    assert math.isnan(zero)
    with pytest.raises(Exception, match="differ in length"):
        df.select(cosine(F.col("v"), F.array(F.lit(1.0)))).collect()


def test_text_search_and_fusion(spark):
    docs = {1: "Red fish, blue fish", 2: "one fish", 3: "no match here", 4: "RED red red wine and fish"}
    df = spark.createDataFrame(list(docs.items()), "id int, text string")
    tokens = {k: v.lower().replace(",", "").split() for k, v in docs.items()}
    mean = sum(map(len, tokens.values())) / 4
    want = {}
    for k, w in tokens.items():
        score = 0.0
        for term in ("red", "fish"):
            found = sum(term in x for x in tokens.values())
            tf = w.count(term)
            score += math.log(1 + (4 - found + 0.5) / (found + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        if score:
            want[k] = round(score, 6)
    got = s.text_search(df, "id", ["red", "FISH"], ["text"]).collect()
    assert {r["id"]: r["score"] for r in got} == want
    assert [r["id"] for r in got] == sorted(want, key=lambda k: (-want[k], k))
    one = spark.createDataFrame([("a", 1, 9.0), ("b", 2, 3.0)], "id string, rank int, score double")
    two = spark.createDataFrame([("b", 1, 1.0), ("c", 2, 1.0)], "id string, rank int, score double")
    fused = {r["id"]: r["score"] for r in s.rank_fusion([one, two], [1.0, 2.0], "id").collect()}
    assert fused == {"a": round(1 / 61, 9), "b": round(1 / 62 + 2 / 61, 9), "c": round(2 / 62, 9)}
    scored = {r["id"]: r["score"] for r in s.score_fusion([one, two], [1.0, 2.0], "id").collect()}
    assert scored == {"a": 1.0, "b": 2.0, "c": 2.0}
