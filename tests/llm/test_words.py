"""Spelling variants, URL reputations and hard negatives against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plait.llm import negatives, reputation, spelling
from plait.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")


# --- spelling variants


def one_error(a, b):
    """Exactly one inserted, deleted or replaced letter apart."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_variants(counts, ratio=10):
    near = {w: [] for w in counts}
    by_length = {}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    for w in counts:
        for size in (len(w) - 1, len(w), len(w) + 1):
            near[w] += [v for v in by_length.get(size, []) if one_error(w, v)]
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return out


def brute_words(rows, damaged=31):
    out = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % damaged == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                out[run] += 1
    return out


def variant_rows(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_position_index():
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abé", k=rng.randint(1, 6))) for _ in range(400)})
    index = spelling.PositionIndex(words)
    for w in [*words, "", "zzzz", "abababab"]:
        assert sorted(index.near(w)) == [v for v in words if one_error(w, v)]


def test_variants_in_split_groups(spark, monkeypatch):
    rng = random.Random(5)
    words = {"".join(rng.choices("abc", k=rng.randint(7, 9))): rng.choice([2, 3, 5, 40, 600]) for _ in range(900)}
    words |= {"prefix" * 2 + "".join(rng.choices("abÿ", k=4)): rng.choice([2, 30, 400]) for _ in range(300)}
    words |= {"q" * 5000: 900, "q" * 4999: 3, "q" * 4998 + "é": 3, "short": 7, "shor": 70}
    df = spark.createDataFrame([(w, n, "x", 1) for w, n in words.items()], "word string, n long, form string, side int")
    want = brute_variants(words)
    assert any(f is not None and f != r for _, f, r, *_ in want)  # chains of two
    assert variant_rows(spelling.variants(df)) == want
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 16)
    monkeypatch.setattr(spelling, "LARGE_GROUPS", 10**9)
    assert variant_rows(spelling.variants(df)) == want
    none = spark.createDataFrame([(None, 3), ("", 4)], "word string, n long")
    assert spelling.variants(none).collect() == [] and spelling.variants(df.where("false")).collect() == []


def test_ties_go_to_the_smaller_word(spark):
    df = spark.createDataFrame([("aaaaaaa", 1), ("aaaaaab", 10), ("éaaaaaa", 10), ("zaaaaaa", 10)], "word string, n long")
    got = {r.word: r for r in spelling.variants(df).collect()}
    assert (got["aaaaaaa"].form, got["aaaaaaa"].n_near, got["aaaaaaa"].form_n) == ("aaaaaab", 3, 10)
    assert got["zaaaaaa"].form is None and got["zaaaaaa"].root == "zaaaaaa"


def test_corpus_words(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, " ".join("".join(rng.choices("abcdEFGé÷ÿ-1", k=rng.randint(6, 30))) for _ in range(60))) for i in range(60)]
    rows += [(None, "Documents documents, docuMENTS"), (7, None), (8, ""), (9, "straße ıİſtanbul Ærøskøbing ĀBCDEFGHI"),
             (10, "repeated " * 60_000 + "x" * 300_000), (10, "twice the same"), (10, "twice the same")]
    df = spark.createDataFrame([(i, t, 5, "w") for i, t in rows], "doc_id long, text string, n int, word string")
    want = brute_words(rows)
    for held in (500_000, 10):
        monkeypatch.setattr(spelling, "HELD_WORDS", held)
        assert {r.word: r.n for r in spelling.corpus_words(df, damaged=31).collect()} == dict(want)
    assert spelling.corpus_words(df.where("false"), damaged=31).collect() == []
    plain = {r.word: r.n for r in spelling.corpus_words(df).collect()}
    assert plain["repeated"] == 60_000 and plain["x" * 300_000] == 1


def test_spelling_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    words = {w: n for w, n in brute_words(rows).items() if n >= 2}
    assert variant_rows(QUERIES["op11_spelling_variants"](spark, sf)) == brute_variants(words)


# --- URL reputations


def brute_rule(host, path, rules):
    best = None
    for verdict, rule in rules:
        name, slash, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + start):
            if best is None or len(rule) > len(best[1]):
                best = (verdict, rule)
    return best


def brute_part(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


URLS = [
    "http://A.Example.NET/en/1", "https://example.net/en", "ftp://sub.example.com/de/x?q=/", "x://example.com",
    "http://example.com/de/", "http://notexample.com/de/1", "http://net/", "http://net", "http://a.org/fr/?x#y",
    "http://bé.ORG/fr/\n/2", "no scheme", "", None, "://h.org/fr/", "http://u:p@x.net:80/a://b/", "HTTP://ÀB.net#/en/",
    "http:///path", "a://b://c/", "http://a.b.c.d.e.co.uk/x/" + "y" * 100_000,
]
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"), ("block", "co.uk/x/")]


def test_rules(spark, monkeypatch):
    rows = [(i, u, "h", "v", 1) for i, u in enumerate(URLS)] + [(None, URLS[0], "h", "v", 1), (0, URLS[0], "h", "v", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string, rules int")
    outcomes = pages.select("url", F.lit(None).cast("boolean").alias("bad"))
    for hot in (1000, 1):
        monkeypatch.setattr(reputation, "HOT_HOSTS", hot)
        got = reputation.judge(pages, outcomes, RULES).collect()
        want = []
        for ident, url, *_ in rows:
            host, path = brute_part(url)
            best = brute_rule(host, path, RULES)
            want.append((ident, host, path, best and best[1], best[0] if best else "allow", 0, 0))
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert reputation.judge(pages.where("false"), outcomes, RULES).collect() == []
    assert {r.verdict for r in reputation.judge(pages, outcomes, []).collect()} == {"allow"}
    ties = [("allow", "b.org/"), ("block", "b.org/"), ("allow", "org/abc"), ("block", "b.org/a")]
    page = spark.createDataFrame([(1, "http://a.b.org/abcd")], "page_id long, url string")
    found = reputation.judge(page, outcomes, ties).first()
    assert (found.rule, found.verdict) == ("b.org/a", "block")
    with pytest.raises(ValueError):
        reputation.judge(page, outcomes, [("deny", "org/")])


def test_reputations_shrink(spark):
    """Many bad pages block a host, a few do not, and a bad domain blocks its new hosts."""
    rng = random.Random(4)
    rows = []
    for d in range(20):
        for h in range(5):
            rows += [(f"http://h{h}.good{d}.com/{i}", rng.random() < 0.1) for i in range(40)]
    for h in range(30):
        rows += [(f"http://h{h}.spam.com/{i}", rng.random() < 0.97) for i in range(40)]
    rows += [(f"http://lone.good3.com/{i}", True) for i in range(2)]
    rows += [(f"http://worst.good4.com/{i}", True) for i in range(300)]
    rows += [("http://h0.good0.com/x", None)] * 3
    pages = [(i, u) for i, (u, _) in enumerate(rows)] + [(-1, "http://new.spam.com/"), (-2, "http://new.good5.com/"), (-3, "http://fresh.org/")]
    got = reputation.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rows, "url string, bad boolean"), [])
    blocked = {r.host for r in got.where("verdict = 'block'").collect()}
    assert blocked == {f"h{h}.spam.com" for h in range(30)} | {"worst.good4.com", "new.spam.com"}
    first = got.where("page_id = 0").first()
    assert (first.host_labelled, first.rule) == (40, None)


# --- hard negatives


def brute_negatives(rows, every=50):
    good = [(i, k, v) for i, k, v in rows if i is not None and k is not None and v is not None
            and all(x is not None and np.isfinite(x) for x in v)]
    ints = [(i, k, [int(np.floor(256 * float(x))) for x in v]) for i, k, v in good]
    anchors = {(i, k, tuple(v)) for i, k, v in ints if i % every == 0}
    out = []
    for i, k, v in anchors:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, c) for j, c, w in ints if j != i)
        for p, j, _ in [x for x in scored if x[2] == k][:5]:
            fits = [(n, m) for n, m, c in scored if c != k and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(i, j, r + 1, m, -p, -n) for r, (n, m) in enumerate(fits)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("factor", [1.0, 1e3, 3e5])
def test_negatives_of_odd_rows(spark, factor):
    rng = np.random.default_rng(2)
    near = rng.standard_normal(6)
    rows = [(i, i % 3, ((near + rng.standard_normal(6)) * factor).tolist()) for i in range(300)]
    rows += [(1000 + i, i % 2, rows[i % 4][2]) for i in range(40)]  # ties
    rows += [(2000, 0, [0.0] * 6), (2001, 1, None), (2050, 1, [1.0, NAN] + [0.0] * 4), (2002, 0, [1.0, None] + [0.0] * 4),
             (2003, 2, [INF] * 6), (None, 1, [9.0] * 6), (2100, None, [1.0] * 6), (2150, 9, [1.0] * 6), (2200, 0, [1.0, 2.0]),
             (2250, 0, []), (0, 0, rows[0][2]), (3, 0, rows[3][2])]
    df = spark.createDataFrame([(i, k, v, 1, "x") for i, k, v in rows], "vec_id long, label int, embedding array<double>, rank int, place string")
    want = brute_negatives(rows)
    assert len(want) > 40
    assert mined(negatives.mine(df)) == want
    assert mined(negatives.mine(df, block_rows=40, anchor_rows=2)) == want
    assert negatives.mine(df.where("false")).collect() == []
    one = df.where("label = 1")
    assert negatives.mine(one).collect() == []


@pytest.mark.parametrize("size", [1, 300, 10**6, 2**40])
def test_packed_products(size):
    rng = np.random.default_rng(7)
    rows = rng.integers(-size, size + 1, (101, 17))
    packed = negatives.Packed(rows, negatives._strain(rows))
    for anchor in rows[:20]:
        exact = [sum(a * b for a, b in zip(anchor.tolist(), row)) for row in rows.tolist()]
        assert packed.scores(anchor).tolist() == [min(max(x, -(2**63)), 2**63 - 1) for x in exact]
    alone = negatives.Packed(np.array([[-(2**63), 2**63 - 1]]), 0)
    assert alone.scores(np.zeros(2, np.int64)).tolist() == [0]


def test_negatives_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    rows = [(i, (k + 1) % 10 if i % 7 == 0 else k, v) for i, k, v in rows]
    assert mined(QUERIES["op13_hard_negatives"](spark, sf)) == brute_negatives(rows)
