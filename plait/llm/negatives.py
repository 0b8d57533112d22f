"""Hard negatives by Kronecker-packed products: several candidates in one multiplication."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written
from .common import batch_of, integers, tile_partitions
from .forest import usable

# Scores end at those of a long.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Packed:
    """Candidates' components side by side in the fields of wide integers.

    Components are biased to be no less than zero and put into fields wide enough for a
    whole score, so that one multiplication by an anchor's component serves every
    candidate in the integer and sums never reach the next field. Fields of up to 32
    bits share words of 64; wider ones share one integer of any size per dimension.
    """

    def __init__(self, rows: np.ndarray, strain: int):
        """``strain``: the largest sum of an anchor's magnitudes that will be asked for."""
        self.count, width = rows.shape
        low, high = (int(rows.min()), int(rows.max())) if rows.size else (0, 0)
        self.bias = max(0, -low)
        # One bit more than the largest score holds its sign.
        self.bits = (max(1, strain) * (high + self.bias)).bit_length() + 1
        self.in_words = self.bits <= 32
        if self.in_words:
            self.shared = 64 // self.bits
            filled = np.zeros((-(-self.count // self.shared) * self.shared, width), np.uint64)
            filled[: self.count] = rows + self.bias
            self.shifts = (np.arange(self.shared) * self.bits).astype(np.uint64)
            fields = filled.reshape(-1, self.shared, width) << self.shifts[None, :, None]
            self.words = fields.sum(1, dtype=np.uint64).T.copy()
            self.half = 1 << (self.bits - 1)
            self.offset = np.uint64(sum(self.half << int(s) for s in self.shifts))
        else:
            self.size = -(-self.bits // 8)
            self.wide = [
                int.from_bytes(b"".join((x + self.bias).to_bytes(self.size, "little") for x in column), "little")
                for column in rows.T.tolist()
            ]
            self.half = 1 << (8 * self.size - 1)
            half = self.half.to_bytes(self.size, "little")
            self.offset = int.from_bytes(half * self.count, "little")

    def scores(self, anchor: np.ndarray) -> np.ndarray:
        """The inner product of every candidate with one anchor."""
        undo = self.half + self.bias * sum(anchor.tolist())
        if self.in_words:
            # Whole words wrap around; the fields' true values fit, so they come out right.
            packed = anchor.astype(np.uint64) @ self.words + self.offset
            fields = packed[:, None] >> self.shifts[None, :]
            fields &= np.uint64((1 << self.bits) - 1)
            return fields.reshape(-1)[: self.count].astype(np.int64) - undo
        packed = sum(a * w for a, w in zip(anchor.tolist(), self.wide)) + self.offset
        data = packed.to_bytes(self.size * self.count, "little")
        found = (int.from_bytes(data[i : i + self.size], "little") for i in range(0, len(data), self.size))
        return np.array([min(max(x - undo, LEAST), MOST) for x in found], np.int64)


def _first(scores: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` of ``rows`` with the highest scores; ties go to the earlier row."""
    if len(rows) > count:
        least = np.partition(scores[rows], -count)[-count]
        rows = rows[scores[rows] >= least]
    return rows[np.lexsort((rows, ~scores[rows]))[:count]]


def _strain(anchors: np.ndarray) -> int:
    return int(np.abs(anchors.astype(object)).sum(1).max())


def mine(
    df: DataFrame, label: Column | None = None, every: int = 50, scale: int = 256, positives: int = 5,
    negatives: int = 3, low: int = 50, high: int = 95, block_rows: int = 16_384, anchor_rows: int = 4096,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components x become ``floor(scale * x)``; a row's score is its integer inner product
    with the anchor, held at the ends of a long. Anchors are the rows whose ``vec_id`` is
    divisible by ``every``; an anchor's positives are the ``positives`` best rows of its
    label, and each positive's negatives the ``negatives`` best rows of other labels with
    ``low * positive <= 100 * negative <= high * positive``, numbered by ``rank`` from 1.
    Ties go to the smaller ``vec_id``; all there are, if fewer.

    Rows with a null ``vec_id``, ``label`` or vector or with null or non-finite components
    take no part; shorter vectors count as filled up with zeros. Rows with the anchor's
    ``vec_id`` are never its partners; a repeated row counts as often as it occurs, a
    repeated anchor once. A positive without such negatives gives no row, and no input
    gives none. Other columns, whatever their names, are ignored.

    Rows are dealt at random into blocks, so a label may hold any share of them, and
    anchors into blocks of theirs. A task packs one block of rows and asks it for one block
    of anchors: first for positives, label by label, then, once they are known across all
    blocks, for negatives. It hands on a few rows an anchor.
    """
    label = F.col("label") if label is None else label
    whole = F.transform(
        F.col("embedding").cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale)))
    )
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), whole.alias("v"), usable(df).alias("fit"))
    rows = rows.where("fit and vec_id is not null and label is not null").drop("fit")
    rows = written(rows, "vectors")
    n, width, asked = rows.agg(
        F.count("*"), F.max(F.size("v")), F.count_if(F.col("vec_id") % every == 0)
    ).first()
    width = max(1, width or 0)
    anchor_blocks = max(1, -(-asked // anchor_rows))
    wanted = 3 * df.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // block_rows), min(-(-n // 1024), -(-wanted // anchor_blocks)))

    def dealt(number: int) -> Column:
        return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(number)).cast("long")

    def each(number: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(number - 1).cast("long")))

    parts = tile_partitions(blocks * anchor_blocks)
    tiles = rows.withColumn("block", dealt(blocks)).withColumn("a", each(anchor_blocks))
    tiles = tiles.repartition(parts, "block", "a").groupBy("block", "a")
    anchors = rows.where(F.col("vec_id") % every == 0).distinct()
    anchors = written(anchors.withColumn("no", F.monotonically_increasing_id()), "anchors")

    def spread(asks: DataFrame):
        asks = asks.withColumn("a", F.pmod(F.xxhash64("no"), F.lit(anchor_blocks)).cast("long"))
        return asks.withColumn("block", each(blocks)).repartition(parts, "block", "a").groupBy("block", "a")

    def taken(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, labels and components."""
        return table["vec_id"].to_numpy(), table["label"].to_numpy(), integers(table["v"], width)

    near = pa.schema([("no", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def own_label(table: pa.Table, asks: pa.Table) -> pa.Table:
        return pa.Table.from_batches(
            [batch_of(near, {"no": [], "vec_id": [], "score": []}), *_own_label(table, asks)]
        )

    def _own_label(table: pa.Table, asks: pa.Table) -> Iterator[pa.RecordBatch]:
        if not (table.num_rows and asks.num_rows):
            return
        ids, labels, vectors = taken(table.sort_by("vec_id"))
        names, kinds, anchors = taken(asks)
        numbers = asks["no"].to_numpy()
        for kind in np.unique(kinds).tolist():
            held, asking = np.flatnonzero(labels == kind), np.flatnonzero(kinds == kind)
            packed = Packed(vectors[held], _strain(anchors[asking]))
            for i in asking.tolist():
                scores = packed.scores(anchors[i])
                best = _first(scores, np.flatnonzero(ids[held] != names[i]), positives)
                yield batch_of(near, {"no": np.full(len(best), numbers[i]), "vec_id": ids[held[best]], "score": scores[best]})

    found = tiles.cogroup(spread(anchors)).applyInArrow(own_label, "no long, vec_id long, score long")
    best = Window.partitionBy("no").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    # At most ``positives`` of them an anchor.
    found = found.groupBy("no").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    pairs = anchors.join(found, "no").select(
        "no", "vec_id", "label", "v", F.col("found.vec_id").alias("pos"), F.col("found.score").alias("pos_score")
    )
    pairs = written(pairs, "positives")

    far = pa.schema([("no", pa.int64()), ("anchor_id", pa.int64()), ("place", pa.int64()), ("positive_id", pa.int64()),
                     ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])

    def other_labels(table: pa.Table, asks: pa.Table) -> pa.Table:
        out = {f.name: [] for f in far}
        if table.num_rows and asks.num_rows:
            ids, labels, vectors = taken(table.sort_by("vec_id"))
            names, kinds, anchors = taken(asks)
            packed = Packed(vectors, _strain(anchors))
            known = asks["no"].to_pylist(), names.tolist(), kinds, anchors
            each_anchor = zip(*known, asks["pos"].to_pylist(), asks["pos_score"].to_pylist())
            for no, name, kind, anchor, best_ids, best_scores in each_anchor:
                scores = packed.scores(anchor)
                others = labels != kind
                others &= ids != name
                for place, (positive, score) in enumerate(zip(best_ids, best_scores)):
                    least, most = -(-low * score // 100), high * score // 100
                    if least > most:
                        continue
                    fits = np.flatnonzero(others & (scores >= least) & (scores <= most))
                    for row in _first(scores, fits, negatives).tolist():
                        values = (no, name, place, positive, score, int(ids[row]), int(scores[row]))
                        for column, value in zip(out.values(), values):
                            column.append(value)
        return pa.Table.from_batches([batch_of(far, out)])

    hard = tiles.cogroup(spread(pairs)).applyInArrow(
        other_labels,
        "no long, anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    order = Window.partitionBy("no", "place").orderBy(F.desc("negative_score"), "negative_id")
    return (
        hard.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
