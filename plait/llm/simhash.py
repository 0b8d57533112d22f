"""Near-duplicate documents by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import written
from .common import batch_of, raw_bytes, shingle_hashes, slices, unused
from .components import components

SLICE = 1 << 20


def _fingerprints(texts: list[bytes | None], width: int) -> np.ndarray:
    """Bit i is 1 if it is 1 in over half of the text's shingle hashes."""
    found = [shingle_hashes((t or b"").lower().split(), width) for t in texts]
    counts = np.array([len(h) for h in found])
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    flat = np.fromiter((x for h in found for x in h), np.uint64, int(counts.sum()))
    starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
    for byte in range(8):
        part = ((flat >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.uint8)
        bits = np.unpackbits(part[:, None], axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        set_ = (2 * ones > counts[some][:, None]).astype(np.uint64)
        values = (set_ << np.arange(8, dtype=np.uint64)).sum(1, dtype=np.uint64)
        out[some] |= values << np.uint64(8 * byte)
    return out


def fingerprints(docs: DataFrame, width: int = 3, keep: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """The columns ``keep`` and ``fp``, the fingerprint as a signed long.

    A-Z are lower-cased, words are runs of anything but ASCII white space, a shingle is
    ``width`` words joined by spaces, counted as often as it occurs. A text without
    words, null or empty, has fingerprint zero.
    """
    schema = pa.schema([*[(c, pa.int64()) for c in keep], ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            texts = raw_bytes(batch.column(len(keep)))
            parts = [
                _fingerprints(texts[a:b], width)
                for a, b in slices([len(t or b"") for t in texts], SLICE)
            ]
            fp = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
            own = {c: batch.column(i) for i, c in enumerate(keep)}
            yield batch_of(schema, own | {"fp": fp})

    chosen = [F.col(c).cast("long").alias(c) for c in keep]
    return docs.select(*chosen, F.col("text").cast("string").alias("text")).mapInArrow(
        run, ", ".join(f"{c} long" for c in [*keep, "fp"])
    )


def _flips(segment: Column, bits: int) -> Column:
    """The segment itself and, for each of its zero bits, the segment with that bit set."""
    ups = [
        F.when(segment.bitwiseAND(F.lit(1 << i)) == 0, segment.bitwiseOR(F.lit(1 << i)))
        for i in range(bits)
    ]
    return F.array_compact(F.array(segment, *ups))


def links(fps: DataFrame) -> DataFrame:
    """``a, b``: all pairs with at most two differing bits of the distinct ``fp`` given.

    A fingerprint has two segments of 32 bits. Of two differing bits, one segment holds
    at most one, so enumerating the ball of radius one in each segment finds every pair.
    What is left to differ in the other segment is used to narrow the table at once:

    - segment equal: the other half differs in two bits at most, one of its two
      16-bit parts in one at most; key: the segment and the ball of that part;
    - segment off by one bit: the other half differs in one bit at most, one of its
      parts in none; key: the ball's point and that part.

    So a key fixes 48 bits and a bucket holds few fingerprints, however many agree in
    one segment. The side with the zero bit looks up the other, so a pair is fetched by
    one of the two. Complete distances are verified.
    """
    # Each row becomes a hundred, so small rows are spread over many tasks first.
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = fps.select("fp").repartition(parts)
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)

    def key(kind: int, segment: Column, part: Column) -> Column:
        """The 48 bits, and above them which segment and part they are."""
        return F.shiftleft(segment, 16).bitwiseOR(part).bitwiseOR(F.lit(kind << 48))

    table, probes = [], []
    for s, (segment, rest) in enumerate([(low, high), (high, low)]):
        for p, part in enumerate([rest.bitwiseAND(F.lit(0xFFFF)), F.shiftright(rest, 16)]):
            kind = 2 * s + p
            table.append(F.array(key(kind, segment, part)))
            # Both the equal segment with the part's ball and the segment's ball with
            # the equal part; the point itself, met in both, is listed once.
            ball = _flips(part, 16)
            probes.append(F.transform(ball, lambda x: key(kind, segment, x)))  # noqa: B023
            ball = F.slice(_flips(segment, 32), 2, 32)
            probes.append(F.transform(ball, lambda x: key(kind, x, part)))  # noqa: B023
    fetched = one.select(F.col("fp").alias("b"), F.explode(F.concat(*table)).alias("key"))
    asked = one.select(F.col("fp").alias("a"), F.explode(F.concat(*probes)).alias("key"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    found = asked.join(
        fetched.withColumnRenamed("key", "at"),
        (F.col("key") == F.col("at")) & (F.col("a") != F.col("b")) & (apart <= 2),
    )
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _components(prints: DataFrame) -> DataFrame:
    """The distinct fingerprints of ``prints`` with the ``component`` each belongs to."""
    tied = components(links(prints))
    return prints.join(tied, prints["fp"] == tied["node"], "left").drop("node").withColumn(
        "component", F.coalesce("component", "fp")
    )


def classes(fps: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``fp, component_id``: the smallest id among all fingerprints reachable by links."""
    own = written(fps.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    named = _components(own)
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(ids, "component").select("fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable by links of at most two bits;
    texts without words have fingerprint zero and link like any other; repeated rows
    stay; a null ``doc_id`` links but names a class only if all its members are null.
    """
    fps = written(fingerprints(docs, width), "fingerprints")
    found = classes(fps).withColumnRenamed("fp", "_fp")
    return fps.join(found, F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, width: int = 3) -> DataFrame:
    """One document of each class: the one with the smallest id, whole, all columns.

    Classes are those of :func:`near_duplicates`: fingerprints over ``width`` words linked
    at two differing bits or fewer. Rows are told apart by their place in ``docs``, so of
    repeated rows one stays too; a null id comes last; all texts without words are one
    class. ``docs`` has to be read the same way twice, as files are.

    A class is reduced to its first document per fingerprint before anything is joined, so
    a group of copies may hold any share of the rows.
    """
    row, kept = unused(docs, "_row"), unused(docs, "_kept")
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    fps = fingerprints(placed, width, ["doc_id", row])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row")))
    own = written(fps.groupBy("fp").agg(first.alias("first")), "distinct")
    stays = _components(own).groupBy("component").agg(F.min("first").alias("first"))
    stays = written(stays.select(F.col("first.row").alias(kept)), "kept")
    # The same plan at every size: what stays is most of the table, never a small side.
    return placed.join(stays.hint("merge"), F.col(row) == F.col(kept), "left_semi").drop(row)
