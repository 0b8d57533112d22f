"""Masked copies of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import REDACTED, hash16, mask

STRATEGIES = ("hash", "mask", "null", "redact")


def _dtype(schema: T.StructType, path: str) -> T.DataType | None:
    current: T.DataType = schema
    for part in path.split("."):
        if not isinstance(current, T.StructType) or part not in current.names:
            return None
        current = current[part].dataType
    return current


def masked_value(col: Column, strategy: str) -> Column:
    """The replacement of a present value; a missing value stays missing."""
    if strategy == "hash":
        return hash16(col)
    if strategy == "mask":
        return mask(col)
    if strategy == "null":
        return F.lit(None).cast("string")
    if strategy == "redact":
        return F.when(col.isNotNull(), F.lit(REDACTED))
    raise ValueError(f"unknown strategy {strategy!r}")


def anonymize(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Replace fields by rule, ``{path: strategy}``; dotted paths reach into structs.

    Paths the table does not have are skipped. Masked fields become text.
    """
    for path, strategy in rules.items():
        dtype = _dtype(df.schema, path)
        if dtype is None:
            continue
        value = masked_value(F.col(path), strategy)
        if strategy == "null":
            value = F.lit(None).cast(dtype)
        top, _, rest = path.partition(".")
        if not rest:
            df = df.withColumn(top, value)
        else:
            nested = F.col(top).withField(rest, value)
            df = df.withColumn(top, F.when(F.col(top).isNotNull(), nested))
    return df


def anonymize_counts(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows with at least one masked field, and masked fields in total."""
    hits = [
        F.col(p).isNotNull().cast("long") for p in rules if _dtype(df.schema, p) is not None
    ]
    n = reduce(lambda a, b: a + b, hits, F.lit(0).cast("long"))
    return df.select(n.alias("n")).agg(
        F.count_if(F.col("n") > 0).alias("rows_changed"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("fields_changed"),
    )
