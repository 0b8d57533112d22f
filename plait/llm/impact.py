"""Exact top-k inner products by impact-ordered, score-at-a-time search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written
from .common import batch_of, integers, tile_partitions
from .forest import usable

# Sums of products stay below this, or are taken in whole numbers of any size.
MOST = 1 << 62


class Index:
    """Postings of one block of vectors, by dimension and quantised impact.

    A segment holds the rows whose component lies in one level of its dimension; the
    levels of a dimension cut its range evenly. Within a dimension the rows stand in
    order of their component, so a segment is one stretch.
    """

    def __init__(self, vectors: np.ndarray, levels: int):
        self.vectors = vectors
        n, width = vectors.shape
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()
        low, high = vectors.min(0), vectors.max(0)
        self.step = np.maximum(1, -(-(high - low + 1) // levels))
        # The level of dimension d ranges from low + step * level to that + step - 1.
        edges = low[:, None] + self.step[:, None] * np.arange(levels + 1)[None, :]
        ranked = np.take_along_axis(vectors, self.order.T, 0)
        self.stops = np.stack([np.searchsorted(ranked[:, d], edges[d]) for d in range(width)])
        dim, level = np.nonzero(np.diff(self.stops, axis=1))
        self.dim = dim
        self.begin, self.end = self.stops[dim, level], self.stops[dim, level + 1]
        self.floor, self.top = edges[dim, level], edges[dim, level] + self.step[dim] - 1

    def search(self, query: np.ndarray, k: int, barred: np.ndarray) -> tuple:
        """Rows that may be among the best ``k`` and their exact scores.

        ``barred`` rows take no part. Segments are added in the order of the most they can give,
        less what a dimension gives at least; after each batch of segments the bounds
        of all rows are known:

            given so far - slack <= score <= given so far + (open dimensions) * next most

        The search stops when so few rows can still be members that scoring them is
        cheaper than going on; the rest are out by proof. Members are scored exactly.
        """
        weight = query[self.dim]
        most = np.maximum(weight * self.floor, weight * self.top)
        base = np.full(len(query), np.iinfo(np.int64).max)
        np.minimum.at(base, self.dim, most)
        gain = most - base[self.dim]
        seen = np.isin(np.arange(len(query)), self.dim)
        start, open_dims = int(base[seen].sum()), int(seen.sum())
        slack = int((np.abs(query) * (self.step - 1)).sum())
        turn = np.argsort(-gain, kind="stable")
        # The low bits count the dimensions met, where sums leave them free.
        bits = len(query).bit_length()
        tops = np.zeros(len(query), np.int64)
        np.maximum.at(tops, self.dim, gain)
        packed = int(tops.sum(dtype=object)) + 1 < MOST >> bits
        n = len(self.vectors)
        acc = np.zeros(n, np.int64)
        met = np.zeros(n, np.int64)
        given = (gain << bits) + 1 if packed else gain
        sizes = np.cumsum((self.end - self.begin)[turn])
        checks = np.searchsorted(sizes, sizes[-1] * np.arange(4, 16) / 16).tolist()
        at = 0
        for check in [*checks, len(turn)]:
            for s in turn[at:check].tolist():
                rows = self.order[self.dim[s], self.begin[s] : self.end[s]]
                acc[rows] += given[s]
                if not packed:
                    met[rows] += 1
            at = max(at, check)
            left = int(gain[turn[at]]) if at < len(turn) else 0
            sums = acc + start
            if packed:
                sums, met = (acc >> bits) + start, acc & ((1 << bits) - 1)
            upper = sums + (open_dims - met) * left
            may = ~barred
            if may.sum() > k:
                reached = int(np.partition((sums - slack)[may], -k)[-k])
                may &= upper >= reached
            if at >= len(turn) or may.sum() <= 64:
                break
        rows = np.flatnonzero(may)
        return rows, self.vectors[rows] @ query


def _largest(values: np.ndarray) -> np.ndarray:
    """The largest magnitude in each column, as whole numbers of any size."""
    return np.maximum(values.max(0).astype(object), -values.min(0).astype(object))


def top_k(
    df: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, block_rows: int = 16_384,
    query_rows: int = 4096, levels: int = 32,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest integer inner products.

    Components x become ``floor(scale * x)``. Queries are the rows whose ``vec_id`` is
    divisible by ``every``; candidates are all rows with another ``vec_id``; ties go to
    the smaller ``vec_id``. Vectors that are null or hold null or non-finite components
    and rows with a null ``vec_id`` take no part; shorter vectors count as filled up
    with zeros; a repeated row counts as often as it occurs, a repeated query once.
    Where a block and a query could give products of 2^60 and more in all dimensions
    together, they are taken in whole numbers of any size without an index; scores end at
    those of a long.

    Rows are dealt at random into blocks, each with its own index, and queries into
    blocks of theirs, so many that there are three pairs of blocks a core while blocks
    hold 64 queries. A task holds one block of each; it hands on ``k`` rows a query.
    """
    whole = F.transform(
        F.col("embedding").cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale)))
    )
    rows = df.select(F.col("vec_id").cast("long"), "embedding").where(
        usable(df) & F.col("vec_id").isNotNull()
    )
    rows = written(rows.select("vec_id", whole.alias("v")), "vectors")
    n, width, queries = rows.agg(
        F.count("*"), F.max(F.size("v")), F.count_if(F.col("vec_id") % every == 0)
    ).first()
    width = max(1, width or 0)
    blocks = max(1, -(-n // block_rows))
    wanted = 3 * df.sparkSession.sparkContext.defaultParallelism
    query_blocks = max(1, -(-queries // query_rows), min(-(-queries // 64), -(-wanted // blocks)))
    found = pa.schema([("query_id", pa.int64()), ("q_no", pa.int64()), ("vec_id", pa.int64()),
                       ("score", pa.int64())])

    def search(table: pa.Table, asks: pa.Table) -> pa.Table:
        out = {f.name: [] for f in found}
        if table.num_rows and asks.num_rows:
            known = table["vec_id"].to_numpy()
            own = integers(table["v"], width)
            reach = _largest(own)
            # The ends of a level lie at most one range beyond the components.
            index = Index(own, levels) if max(reach) < MOST >> 4 else None
            queries = zip(asks["vec_id"].to_pylist(), asks["no"].to_pylist(), integers(asks["v"], width))
            for query_id, no, query in queries:
                barred = known == query_id
                # No bound of a row exceeds the largest product in every dimension.
                room = 4 * width * max((reach + 1) * np.abs(query.astype(object)))
                if index is None or room >= MOST:
                    hits = np.flatnonzero(~barred)
                    exact = own[hits].astype(object) @ query.astype(object)
                    scores = np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)
                else:
                    hits, scores = index.search(query, k, barred)
                best = np.lexsort((known[hits], ~scores))[:k]
                out["query_id"] += [query_id] * len(best)
                out["q_no"] += [no] * len(best)
                out["vec_id"] += known[hits[best]].tolist()
                out["score"] += scores[best].tolist()
        return pa.Table.from_batches([batch_of(found, out)])

    def dealt(number: int) -> Column:
        return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(number)).cast("long")

    def each(number: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(number - 1).cast("long")))

    asked = rows.where(F.col("vec_id") % every == 0).distinct()
    asked = written(asked.withColumn("no", F.monotonically_increasing_id()), "queries")
    tiles = rows.withColumn("block", dealt(blocks)).withColumn("q", each(query_blocks))
    asked = asked.withColumn("q", dealt(query_blocks)).withColumn("block", each(blocks))
    parts = tile_partitions(blocks * query_blocks)
    tiles, asked = (x.repartition(parts, "block", "q") for x in (tiles, asked))
    best = tiles.groupBy("block", "q").cogroup(asked.groupBy("block", "q")).applyInArrow(
        search, "query_id long, q_no long, vec_id long, score long"
    )
    order = Window.partitionBy("q_no").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
