"""Near-duplicate vectors by a forest of random-projection trees."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import written
from .common import batch_of
from .components import components

MOST_TREES = 64


def usable(df: DataFrame, vector: str = "embedding"):
    """Condition: the vector and all its components are there and finite."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros to ``width``."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(lists.offsets.to_numpy().astype(np.int64))
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = lists.flatten().to_numpy()
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows or vanishes."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


class Tree:
    """Random splits, kept as one array for each of direction, threshold and margin.

    Node n has the children 2n + 1 and 2n + 2. A row nearer to the threshold than the
    margin goes both ways. The margin spans ``2 * spill`` of the node's rows, where they
    stand farthest apart, nearness to the middle weighed in: a split then goes around
    dense groups instead of through them. A node whose rows have an average cosine of
    ``least`` is not split any more, as most of its pairs are links.
    """

    def __init__(self, sample: np.ndarray, depth: int, spill: float, least: float, seed: int):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        self.depth = depth
        self.direction = rng.standard_normal((2**depth - 1, width))
        self.direction /= np.sqrt((self.direction**2).sum(1, keepdims=True))
        self.threshold = np.zeros(2**depth - 1)
        self.margin = np.zeros(2**depth - 1)
        parts = [np.arange(len(sample))]
        for node in range(2**depth - 1):
            part = parts[node]
            n = len(part)
            if n < 2:
                parts += [part, part[:0]]
            elif (sample[part].mean(0) ** 2).sum() >= least:
                self.threshold[node] = np.inf  # all go left
                parts += [part, part[:0]]
            else:
                at = sample[part] @ self.direction[node]
                ranked = np.sort(at)
                window = max(1, int(2 * spill * n))
                share = (np.arange(n - window) + window / 2 + 0.5) / n
                gap = (ranked[window:] - ranked[:-window]) * np.minimum(share, 1 - share)
                best = int(np.argmax(gap))
                low, high = ranked[best], ranked[best + window]
                self.threshold[node], self.margin[node] = (low + high) / 2, (high - low) / 2
                right = at > self.threshold[node]
                parts += [part[~right], part[right]]

    def leaves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and the leaves they fall into."""
        who, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        for _ in range(self.depth):
            off = np.einsum("ij,ij->i", rows[who], self.direction[node]) - self.threshold[node]
            left, right = off <= self.margin[node], off >= -self.margin[node]
            who, node = (
                np.concatenate([who[left], who[right]]),
                np.concatenate([2 * node[left] + 1, 2 * node[right] + 2]),
            )
        return who, node - (2**self.depth - 1)


def trees_for(depth: int, lost: float, recall: float) -> int:
    """Trees needed if a level separates a pair with probability ``lost``."""
    together = (1 - lost) ** depth
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - together))) if together < 1 else 1


def _compare(
    rows: np.ndarray, copies: np.ndarray, forest: list[Tree], leaf: int, least: float,
    left: np.ndarray, right: np.ndarray,
):
    """Links between two blocks of one leaf, or within one, that no earlier leaf holds,
    by row, and each row's least partner.

    ``forest`` has all trees up to the leaf's own. A pair belongs to the first tree in
    which it shares a leaf, and there to the smallest one.
    """
    n, within = len(rows), left is right
    count, top = np.zeros(n, np.int64), np.arange(n)
    places = None
    step = max(1, (1 << 22) // max(1, len(right)))
    for begin in range(0, len(left), step):
        others = right[begin:] if within else right
        x, y = np.nonzero(rows[left[begin : begin + step]] @ rows[others].T >= least)
        if within:
            x, y = x[y > x], y[y > x]  # each pair once
        i, j = left[begin + x], others[y]
        _unite(top, i, j)
        if len(i) and places is None:
            places = [_places(tree, rows) for tree in forest]
        for t, held in enumerate(places or []):
            mine = np.ones(len(i), bool)
            own, other = held[i], held[j]
            for k in range(own.shape[1]):
                for m in range(other.shape[1]):
                    shared = (own[:, k] == other[:, m]) & (own[:, k] >= 0)
                    if t == len(places) - 1:
                        shared &= own[:, k] < leaf
                    mine &= ~shared
            i, j = i[mine], j[mine]
        np.add.at(count, i, copies[j])
        np.add.at(count, j, copies[i])
    return count, top


def _unite(top: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Lower every row's top to the least over its links until none changes."""
    while len(i):
        a, b = top[i], top[j]
        least = np.minimum(a, b)
        if (a == b).all():
            return
        np.minimum.at(top, a, least)
        np.minimum.at(top, b, least)
        while not (top[top] == top).all():
            top[:] = top[top]


def _places(tree: Tree, rows: np.ndarray) -> np.ndarray:
    """Each row's leaves side by side, padded with -1."""
    who, leaf = tree.leaves(rows)
    order = np.argsort(who, kind="stable")
    who, leaf = who[order], leaf[order]
    held = np.bincount(who, minlength=len(rows))
    out = np.full((len(rows), held.max()), -1, np.int64)
    out[who, np.arange(len(who)) - np.repeat(np.cumsum(held) - held, held)] = leaf
    return out


def _near_pairs(sample: np.ndarray, least: float, seed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Both sides of pairs near the threshold, and how many of them are real.

    Up to four partners of each of some sampled rows, no nearer than two fifths of the way
    from the threshold to one; then made pairs: sampled rows moved in any direction until
    their cosine is ``least``.
    """
    rng = np.random.default_rng(seed)
    chosen = rng.permutation(len(sample))[:2048]
    a, b = [], []
    for begin in range(0, len(chosen), 128):
        own = chosen[begin : begin + 128]
        cosine = sample[own] @ sample.T
        near = (cosine >= least) & (cosine < least + 0.4 * (1 - least))
        for row, partners in zip(own, map(np.flatnonzero, near)):
            partners = rng.permutation(partners)[:4]
            a.append(np.full(len(partners), row))
            b.append(partners)
    a, b = np.concatenate(a), np.concatenate(b)
    base = sample[chosen[:512]]
    aside = rng.standard_normal(base.shape)
    aside -= (aside * base).sum(1, keepdims=True) * base
    length = np.sqrt((aside**2).sum(1, keepdims=True))
    aside /= np.where(length > 0, length, 1)
    moved = least * base + math.sqrt(1 - least**2) * aside
    return np.concatenate([sample[a], base]), np.concatenate([sample[b], moved]), len(a)


def _grown(sample: np.ndarray, depth: int, spill: float, least: float, recall: float, seed: int) -> list[Tree]:
    """Trees in which ``recall`` of the sample's pairs near the threshold meet.

    How often a split parts a pair depends on how dense the rows lie, so it is measured.
    At least as many trees are grown as isotropic rows need. Where that takes more than
    ``MOST_TREES``, or more comparisons than all pairs are, the trees are made less deep;
    without splits every pair meets.
    """
    if not depth:
        return [Tree(sample, 0, spill, least, seed)]
    a, b, real = _near_pairs(sample, least, seed)
    while depth:
        forest, met, work = [], np.zeros(len(a), bool), 0.0
        fewest = trees_for(depth, math.acos(least) / math.pi, recall)
        while len(forest) < MOST_TREES and work < 1:
            tree = Tree(sample, depth, spill, least, seed + len(forest))
            forest.append(tree)
            work += ((np.bincount(tree.leaves(sample)[1]) / len(sample)) ** 2).sum()
            left, right = _places(tree, a), _places(tree, b)
            for k in range(left.shape[1]):
                met |= ((left[:, k, None] == right) & (left[:, k, None] >= 0)).any(1)
            if len(forest) >= fewest and met[real:].mean() >= recall and (not real or met[:real].mean() >= recall):
                return forest
        depth -= 1
    return [Tree(sample, 0, spill, least, seed)]


def _leaf_sizes(same: DataFrame, forest: list[Tree], width: int) -> list[np.ndarray]:
    """Rows of each leaf, by tree; the number of leaves does not grow with the table."""
    schema = pa.schema([("tree", pa.int32()), ("leaf", pa.int64()), ("held", pa.int64())])

    def count(batches):
        for batch in batches:
            unit = _unit(_matrix(batch.column(0), width))
            for number, tree in enumerate(forest):
                leaf, held = np.unique(tree.leaves(unit)[1], return_counts=True)
                yield batch_of(schema, {"tree": np.full(len(leaf), number, np.int32), "leaf": leaf, "held": held})

    counted = same.select("embedding").mapInArrow(count, "tree int, leaf long, held long")
    counted = counted.groupBy("tree", "leaf").agg(F.sum("held").alias("held")).toArrow()
    tree, leaf, held = (counted.column(c).to_numpy() for c in ("tree", "leaf", "held"))
    out = [np.zeros(2**t.depth, np.int64) for t in forest]
    for t, sizes in enumerate(out):
        sizes[leaf[tree == t]] = held[tree == t]
    return out


def _linked(same: DataFrame, forest: list[Tree], width: int, least: float, block_rows: int) -> DataFrame:
    """``node, links, top`` for every linked row of every leaf; copies count as links.

    A leaf is cut into blocks of about ``block_rows`` rows by a hash of the node, and each
    pair of blocks is compared as a group of its own, so no task holds a larger leaf
    whole. A row occurs once in each pair, with its links and one partner there; both are
    brought together afterwards.
    """
    found = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("top", pa.int64())])
    blocks = [-(-sizes // block_rows) for sizes in _leaf_sizes(same, forest, width)]

    def deal(batches):
        for batch in batches:
            unit = _unit(_matrix(batch.column(2), width))
            vectors = pa.array([u.tobytes() for u in unit], pa.binary())
            mark = batch.column(3).to_numpy()
            for number, tree in enumerate(forest):
                who, leaf = tree.leaves(unit)
                parts = blocks[number][leaf]
                block = mark[who] % parts
                for other in range(int(parts.max(initial=0))):
                    there = parts > other
                    rows, own = pa.array(who[there]), block[there]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows), vectors.take(rows),
                         pa.array(np.full(len(own), number, np.int32)), pa.array(leaf[there]),
                         pa.array(np.minimum(own, other)), pa.array(np.maximum(own, other)), pa.array(own)],
                        names=["node", "copies", "vec", "tree", "leaf", "i", "j", "block"])

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        number, leaf, first, second = (k.as_py() for k in key)
        nodes, block = table["node"].to_numpy(), table["block"].to_numpy()
        unit = np.frombuffer(b"".join(table["vec"].to_pylist())).reshape(len(nodes), width)
        left = np.flatnonzero(block == first)
        right = left if first == second else np.flatnonzero(block == second)
        count, top = _compare(unit, table["copies"].to_numpy(), forest[: number + 1], leaf, least, left, right)
        some = (count > 0) | (top != np.arange(len(top)))
        columns = {"node": nodes[some], "links": count[some], "top": nodes[top[some]]}
        return pa.Table.from_batches([batch_of(found, columns)])

    mark = F.pmod(F.xxhash64("node"), F.lit(1 << 40))
    dealt = same.select("node", "copies", "embedding", mark.alias("mark")).mapInArrow(
        deal, "node long, copies long, vec binary, tree int, leaf long, i long, j long, block long"
    )
    return dealt.groupBy("tree", "leaf", "i", "j").applyInArrow(compare, "node long, links long, top long")


def similar_vectors(
    df: DataFrame,
    least: float = 0.95,
    leaf_rows: int = 1024,
    sample_rows: int = 32_768,
    spill: float = 0.02,
    recall: float = 0.995,
    seed: int = 7,
    block_rows: int = 2048,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, embedding``.

    A pair is linked if its cosine, in double precision, is ``least`` or more.
    Equal vectors are first brought down to one; their links are exact. The rest goes
    through trees of random splits at the medians of a sample of about ``sample_rows``
    rows. Leaves hold about ``leaf_rows`` rows, or a sixteen-fold of the table over the
    sample where that is more (raise ``sample_rows`` with the table), all rows of a leaf
    are compared, in tasks of two blocks of ``block_rows``, and trees are added until ``recall`` of the sample's pairs
    near the threshold meet in a leaf (``_grown``). Counts need no list of
    pairs: a pair is counted in the first leaf it shares, which each row's list of
    leaves tells, and a leaf hands on counts and one link for each linked row.

    Vectors that are null, zero or hold null or non-finite components link with
    nothing; shorter vectors count as filled up with zeros; rows with a null
    ``vec_id`` are returned, link, and never name a component unless all are null.
    """
    rows = df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    there = usable(rows) & F.exists("embedding", lambda x: x != 0)
    good = rows.where(there)
    # Equal vectors: minus zero is zero.
    clean = F.transform("embedding", lambda x: x + F.lit(0.0))
    same = written(
        good.groupBy(clean.alias("embedding"))
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        .withColumn("node", F.monotonically_increasing_id()),
        "vectors",
    )
    n, width = same.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if n:
        share = min(1.0, 1.2 * sample_rows / n)
        drawn = same.where(F.rand(seed) < share).limit(2 * sample_rows).select("embedding")
        sample = _unit(_matrix(drawn.toArrow().column(0), width)) if n > leaf_rows else np.zeros((0, width))
        depth = max(0, math.ceil(math.log2(n / leaf_rows)))
        depth = min(depth, max(0, int(math.log2(max(1, len(sample)) / 16))))
        forest = _grown(sample, depth, spill, least, recall, seed)
        linked = _linked(same, forest, width, least, block_rows)
    else:
        linked = same.select("node", F.lit(0).cast("long").alias("links"), F.col("node").alias("top"))
    linked = written(linked, "linked")
    tied = components(linked.where("top <> node"), "node", "top")
    weight = linked.groupBy("node").agg(F.sum("links").alias("links"))
    named = (
        same.select("node", "embedding", "least", "copies")
        .join(weight.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
        .join(tied.withColumnRenamed("node", "_m"), F.col("node") == F.col("_m"), "left")
        .select("embedding", "least", F.coalesce("component", "node").alias("component"),
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "component").select(F.col("embedding").alias("_e"), "n_links", "component_id")
    alone = rows.where(~there | F.col("embedding").isNull()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    out = good.select("vec_id", clean.alias("_v")).join(
        named, (F.xxhash64("_v") == F.xxhash64("_e")) & (F.col("_v") == F.col("_e"))
    ).select(
        "vec_id", "n_links", "component_id"
    )
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
