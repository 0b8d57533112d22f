"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

SEED = 42
# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def raw_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a text column, without decoding them."""
    return column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()


def shingle_hashes(words: list[bytes], width: int) -> list[int]:
    """XXH64 of every shingle; a short text is one shingle."""
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    line = memoryview(b" ".join(words))
    if len(words) <= width:
        return [digest(line, SEED)]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    return [digest(line[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]


def batch_of(schema: pa.Schema, columns: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], type=f.type) for f in schema], schema=schema
    )


def integers(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors of longs as rows, filled up with zeros."""
    lists = column.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy().astype(np.int64))
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = lists.flatten().to_numpy()
    return out


def tile_partitions(tiles: int) -> int:
    """Partitions for groups of equal work: while they are few, so many that few share one."""
    return tiles if tiles > 256 else 4 * tiles


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of rows of about ``limit`` bytes, one row at least."""
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > limit:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def before(
    df: DataFrame, group: list[str], order: list[str], value: Column, name: str, chunk: Column
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the group that come earlier.

    ``chunk`` is a whole number that never falls along ``order``. Chunks are summed
    first, and chunks of chunks before them, so no window sees more than one chunk of
    rows or 4096 chunk sums: a group may hold any share of the table.
    """
    c, v, far = (unused(df, x) for x in ("_chunk", "_value", "_far"))
    cut = df.withColumns({c: chunk.cast("long"), v: value})
    sums = cut.groupBy(*group, c).agg(F.sum(v).alias(v)).withColumn(far, F.shiftright(c, 12))
    wide = sums.groupBy(*group, far).agg(F.sum(v).alias(v))
    earlier = lambda keys, by: (
        Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0).cast("long")
    wide = wide.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col(far).alias("_gf"),
        F.coalesce(F.sum(v).over(earlier(group, [far])), zero).alias("_base"),
    )
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    keys = [f"_g{i}" for i in range(len(group))]
    offsets = (
        sums.join(wide, [*same, F.col(far) == F.col("_gf")])
        .select(
            *keys,
            F.col(c).alias("_gc"),
            (F.col("_base") + F.coalesce(F.sum(v).over(earlier([*group, far], [c])), zero)).alias("_off"),
        )
    )
    placed = cut.withColumn(name, F.coalesce(F.sum(v).over(earlier([*group, c], order)), zero))
    return (
        placed.join(offsets, [*same, F.col(c) == F.col("_gc")])
        .withColumn(name, F.col(name) + F.col("_off"))
        .drop(c, v, "_gc", "_off", *keys)
    )
