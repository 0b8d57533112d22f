"""Comparison of several versions of one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.canonical import struct_text
from .keys import row_struct, value_types
from pyspark.sql import types as T

ABSENT, PRESENT, MODIFIED = "absent", "present", "modified"


def compare(versions: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """One row per key with a column per version: absent, present or modified.

    The first version is the reference. Rows travel as SHA-256 digests, so the
    one shuffle carries the key and 32 bytes per version whatever the row width.
    """
    if len(versions) < 2:
        raise ValueError("need at least two versions to compare")
    names = list(versions)
    types = value_types(list(versions.values()), keys)
    schema = T.StructType([T.StructField(n, t) for n, t in types.items()])
    parts = []
    for name, df in versions.items():
        digest = F.unhex(F.sha2(struct_text(row_struct(df, types), schema), 256))
        parts.append(
            df.select(
                *keys,
                *[
                    (digest if n == name else F.lit(None).cast("binary")).alias(n)
                    for n in names
                ],
            )
        )
    stacked = reduce(DataFrame.unionByName, parts).repartition(*keys)
    rows = stacked.groupBy(*keys).agg(
        *[F.any_value(n, ignoreNulls=F.lit(True)).alias(n) for n in names]
    )
    first = F.col(names[0])
    states = []
    for n in names:
        state = F.when(F.col(n).isNull(), ABSENT)
        if n != names[0]:
            state = state.when(first.isNotNull() & (F.col(n) != first), MODIFIED)
        states.append(state.otherwise(PRESENT).alias(n))
    return rows.select(*keys, *states)


def compare_stats(matrix: DataFrame, names: list[str]) -> DataFrame:
    """Totals of a comparison: in all versions, in one only, in some."""
    present = reduce(
        lambda a, b: a + b, [F.when(F.col(n) != ABSENT, 1).otherwise(0) for n in names]
    )
    n = F.col("n")
    return matrix.select(present.alias("n")).agg(
        F.count("*").alias("total_rows"),
        F.count_if(n == len(names)).alias("in_all"),
        F.count_if((n == 1) & (n != len(names))).alias("unique_to_one"),
        F.count_if((n > 1) & (n < len(names))).alias("in_some"),
    )
