"""SimHash, the vector forest and the impact-ordered index against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plait.llm import forest, impact, simhash
from plait.llm.components import components
from plait.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")


def least_reachable(links, nodes):
    top = {n: n for n in nodes}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1500)]
    links += [(10_000 + i, 10_001 + i) for i in range(200)] + [(20_000, 20_000), (None, 4)]
    links += [(30_000, 30_000 + i) for i in range(1, 300)]
    rng.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [x for x in links if x[0] is not None]
    assert got == least_reachable(real, {n for x in real for n in x})
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def close(prints):
    values = np.array(sorted(set(prints)), np.uint64)
    out = []
    for i, v in enumerate(values):
        apart = np.bitwise_count(values[i + 1 :] ^ v)
        out += [(int(v), int(w)) for w in values[i + 1 :][apart <= 2]]
    return out


def check_simhash(rows, got):
    prints = [fingerprint(t) for _, t in rows]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint) for r in got) == sorted(
        (d is None, d or 0, f"{p:016x}") for (d, _), p in zip(rows, prints)
    )
    top = least_reachable(close(prints), set(prints))
    least = {}
    for (d, _), p in zip(rows, prints):
        if d is not None:
            least[top[p]] = min(d, least.get(top[p], d))
    want = sorted((d is None, d or 0, least.get(top[p]) is None, least.get(top[p]) or 0) for (d, _), p in zip(rows, prints))
    assert want == sorted((r.doc_id is None, r.doc_id or 0, r.component_id is None, r.component_id or 0) for r in got)


def test_links_find_every_pair(spark):
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(30)] + [0, 2**64 - 1]
    prints = set(centres)
    for c in centres:
        for _ in range(40):
            flips = rng.sample(range(64), rng.choice([1, 2, 3]))
            prints.add(c ^ sum(1 << f for f in flips))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    got = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long")).collect()
    want = {tuple(sorted((signed(a), signed(b)))) for a, b in close(prints)}
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 1000


def test_simhash_odd_rows(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base), (3, base.upper()), (9, base + " more"), (2**40, None), (4, ""), (7, " \n\t"),
            (11, "two words"), (12, "TWO\x0bwords"), (13, "a b"), (None, base), (None, "alone here"),
            (20, "é É ß  x"), (20, "é É ß  x"), (21, "long " * 50_000)]
    df = spark.createDataFrame([(d, t, "x", 1, "c") for d, t in rows],
                               "doc_id long, text string, fp string, a int, component_id string")
    check_simhash(rows, simhash.near_duplicates(df.repartition(3)).collect())
    assert simhash.near_duplicates(df.where("false")).collect() == []


def test_keep_one(spark, tmp_path):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base, "b"), (3, base.upper(), "a"), (3, base.upper(), "a"), (8, "other text here now", None),
            (None, "no id at all", "z"), (None, "no id at all", "z"), (None, "quite another one", "z")]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string, _row string").write.parquet(path)
    kept = simhash.keep_one(spark.read.parquet(path))
    assert kept.columns == ["doc_id", "text", "_row"]
    assert sorted(kept.collect(), key=str) == sorted(
        [(3, base.upper(), "a"), (8, "other text here now", None), (None, "no id at all", "z"),
         (None, "quite another one", "z")], key=str)


def near_copies(rng, groups, size, most):
    """Groups of copies of a text of 150 words, each with up to ``most`` of them changed."""
    texts = []
    for g in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(150)]
        texts += [" ".join(w if rng.random() > share else f"v{rng.randrange(5000)}" for w in base)
                  for share in [rng.random() * most for _ in range(size)]]
    return texts


@pytest.mark.parametrize("groups, size, most", [(60, 4, 0.03), (2, 150, 0.06)])
def test_stage_keeps_one_of_each_class(spark, tmp_path, groups, size, most):
    """The stage against fingerprints and links found one by one, with a large group of copies."""
    texts = near_copies(random.Random(groups), groups, size, most)
    texts += [texts[5]] * 200 + [texts[7].upper()] * 3 + [None, "", " "]
    prints = [fingerprint(t) for t in texts]
    top = least_reachable(close(prints), set(prints))
    first = {}
    for i, p in enumerate(prints):
        first.setdefault(top[p], i)
    path = str(tmp_path / "d")
    rows = [(i, t, "k", 2) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, _kept string, _row int").repartition(3).write.parquet(path)
    kept = simhash.keep_one(spark.read.parquet(path))
    assert {r.doc_id for r in kept.collect()} == set(first.values()) and kept.columns[2:] == ["_kept", "_row"]
    assert len(first) < len(texts) - 200


def test_simhash_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check_simhash(rows, QUERIES["op8_simhash_duplicates"](spark, sf).collect())


def brute_top(rows, k=10, every=100):
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ints = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in good]
    out = set()
    for i, q in ints:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ints if j != i)
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])}
    return out


def top_rows(df):
    return {tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()}


def test_top_k_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(30)]  # ties
    rows += [(2000, [0.0] * 6), (2001, None), (2100, [1.0, NAN] + [0.0] * 4), (2002, [1.0, None] + [0.0] * 4),
             (2003, [INF] * 6), (None, [9.0] * 6), (2200, [1.0, 2.0]), (2300, []), (0, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string")
    want = brute_top(rows)
    for options in ({}, {"block_rows": 50, "query_rows": 2, "levels": 5}):
        assert top_rows(impact.top_k(df, **options)) == want, options
    wide = [(i, [x * 1e6 for x in v]) for i, v in rows[:120]]
    assert top_rows(impact.top_k(spark.createDataFrame(wide, "vec_id long, embedding array<double>"))) == brute_top(wide)
    assert impact.top_k(df.where("false")).collect() == []


@pytest.mark.parametrize("width, size", [(64, 4096), (512, 4096.0), (1536, 4096.0), (1024, 4e4), (300, 1e12)])
def test_top_k_of_wide_vectors(spark, width, size):
    """Vectors whose sums come close to a long's end, and beyond what it holds."""
    rng = np.random.default_rng(width)
    rows = [(i, (size * (1 - 1e-3 * rng.random(width))).tolist()) for i in range(120)]
    rows += [(200 + i, (size * rng.choice([-1.0, 1.0], width)).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    top = 2**63 - 1
    want = brute_top(rows)
    if size < 1e12:
        assert top_rows(impact.top_k(df)) == want and max(abs(s) for *_, s in want) < top
    else:
        assert all(r.score in (top, -top - 1) for r in impact.top_k(df).collect())


def test_top_k_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert top_rows(QUERIES["op6_impact_top_k"](spark, sf)) == brute_top(rows)


def test_index_stops_early():
    rng = np.random.default_rng(1)
    rows = np.floor(rng.standard_normal((5000, 64)) * 128).astype(np.int64)
    rows[7] = rows[3]
    index = impact.Index(rows, 64)
    hits, scores = index.search(rows[3], 10, np.arange(5000) == 3)
    best = np.sort(rows @ rows[3])[::-1]
    assert len(hits) < 500 and np.sort(scores)[::-1][:10].tolist() == best[1:11].tolist()


def brute_links(rows, least=0.95):
    good = [n for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max((len(rows[n][1]) for n in good), default=0)
    x = np.array([list(rows[n][1]) + [0.0] * (width - len(rows[n][1])) for n in good], float).reshape(len(good), width)
    x = x / np.abs(x).max(1, keepdims=True) if len(x) else x
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x
    i, j = np.nonzero(np.triu(x @ x.T >= least, 1))
    pairs = [(good[a], good[b]) for a, b in zip(i, j)]
    top = least_reachable(pairs, range(len(rows)))
    count = np.bincount([n for p in pairs for n in p], minlength=len(rows))
    best = {}
    for n, (vec, _) in enumerate(rows):
        if vec is not None:
            best[top[n]] = min(vec, best.get(top[n], vec))
    return [(vec, int(count[n]), best.get(top[n])) for n, (vec, _) in enumerate(rows)], len(pairs)


def link_rows(df):
    got = df.collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str)


def test_forest_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(50)]
    rows += [(100 + i, (np.array(rows[i % 5][1]) * (1 + i) + 0.01).tolist()) for i in range(40)]
    rows += [(200 + i, rows[7][1]) for i in range(30)]
    rows += [(300, [0.0] * 8), (301, None), (302, [NAN] + [1.0] * 7), (303, [None] + [1.0] * 7), (304, []),
             (305, [-0.0, 1.0] + [0.0] * 6), (306, [0.0, 1.0]), (307, [0.0, 1e-300]), (308, [0.0, 1e300]),
             (None, rows[7][1]), (None, None), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, node int, kept string")
    want, _ = brute_links(rows)
    assert link_rows(forest.similar_vectors(df)) == sorted(want, key=str)
    assert forest.similar_vectors(df.where("false")).collect() == []


@pytest.mark.parametrize("leaf_rows", [64, 250])
def test_forest_recall(spark, leaf_rows):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((300, 64))
    rows = [(i, c.tolist()) for i, c in enumerate(centres)]
    for i, c in enumerate(centres):
        for n in range(3):  # close to the threshold
            noise = rng.standard_normal(64) * np.linalg.norm(c) / 8
            rows.append((1000 + 3 * i + n, (c + noise * rng.choice([0.1, 0.3, 0.32])).tolist()))
    rows += [(5000 + i, (centres[0] + rng.standard_normal(64) * 0.05).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, pairs = brute_links(rows)
    got = {r.vec_id: r for r in forest.similar_vectors(df, leaf_rows=leaf_rows).collect()}
    assert all(got[v].n_links <= n for v, n, _ in want)
    assert sum(r.n_links for r in got.values()) / 2 >= 0.97 * pairs
    assert sum(got[v].component_id == c for v, _, c in want) >= 0.97 * len(want)


def test_forest_recall_of_concentrated_rows(spark):
    """Splits of rows with a mean cosine of 0.9 part more pairs at the threshold."""
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(32)
    centre /= np.linalg.norm(centre)
    x = centre + rng.standard_normal((4000, 32)) / np.sqrt(32) / 3
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = np.triu(unit @ unit.T, 1)
    assert 0.88 < cosine.sum() / (4000 * 3999 / 2) < 0.92 and not (cosine >= 0.99).any()
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    sample = forest._unit(x)
    trees = forest._grown(sample, 4, 0.02, 0.95, 0.995, 7)
    i, j = np.nonzero((cosine >= 0.95) & (cosine < 0.97))
    met = np.zeros(len(i), bool)
    for tree in trees:
        held = forest._places(tree, sample)
        for k in range(held.shape[1]):
            met |= ((held[i, k, None] == held[j]) & (held[i, k, None] >= 0)).any(1)
    assert met.mean() >= 0.985 and len(i) > 1000
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in forest.similar_vectors(df, leaf_rows=250).collect()}
    want, pairs = brute_links(rows)
    assert all(got[v].n_links <= n for v, n, _ in want)
    assert sum(r.n_links for r in got.values()) / 2 >= 0.985 * pairs


def test_forest_cuts_leaves(spark, monkeypatch):
    """A leaf with a third of the rows is compared by pairs of blocks, none of them large."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(400)]
    centre = rng.standard_normal(16)
    rows += [(1000 + i, (centre + rng.standard_normal(16) * 0.2).tolist()) for i in range(200)]
    rows += [(2000 + i, rows[-1][1]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, pairs = brute_links(rows)
    assert link_rows(forest.similar_vectors(df, block_rows=32)) == sorted(want, key=str) and pairs > 1000
    got = {r.vec_id: r for r in forest.similar_vectors(df, leaf_rows=64, block_rows=32).collect()}
    assert all(got[v].n_links <= n for v, n, _ in want)
    assert sum(r.n_links for r in got.values()) / 2 >= 0.97 * pairs
    same = spark.createDataFrame([(i, 1, v) for i, v in rows[:600]], "node long, copies long, embedding array<double>")
    tree = forest.Tree(np.zeros((0, 16)), 0, 0.02, 0.95, 7)
    compared, real = [], spark.createDataFrame([], "a int").groupBy("a").__class__.applyInArrow
    monkeypatch.setattr("pyspark.sql.GroupedData.applyInArrow", lambda g, f, s: compared.append(g.count()) or real(g, f, s))
    forest._linked(same, [tree], 16, 0.95, 32).count()
    sizes = [r["count"] for r in compared[0].collect()]
    assert len(sizes) == 19 * 20 / 2 and max(sizes) <= 120


def test_forest_over_the_given_vectors(spark):
    """The 2,000 given vectors and copies near the threshold of each fourth, in leaves of 64."""
    rng = np.random.default_rng(5)
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = [(r.vec_id, list(r.embedding)) for r in given]
    for vec, v in rows[::4]:
        noise = rng.standard_normal(len(v)) * np.linalg.norm(v) / np.sqrt(len(v))
        rows.append((10_000 + vec, (np.array(v) + noise * rng.choice([0.05, 0.2, 0.3, 0.32])).tolist()))
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    want, pairs = brute_links(rows)
    got = {r.vec_id: r for r in forest.similar_vectors(e, leaf_rows=64).collect()}
    assert len(rows) == 2500 and pairs > 400
    assert all(got[v].n_links <= n for v, n, _ in want)
    assert sum(r.n_links for r in got.values()) / 2 >= 0.95 * pairs
    assert sum(got[v].component_id == c for v, _, c in want) >= 0.95 * len(want)


def test_forest_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, _ = brute_links(rows)
    assert link_rows(QUERIES["op9_vector_forest"](spark, sf)) == sorted(want, key=str)
