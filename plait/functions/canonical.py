"""Order-insensitive text forms of rows, row hashes and table digests."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F, types as T

_JSON = {"ignoreNullFields": "false"}


def _has_unordered(dtype: T.DataType) -> bool:
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return True
    if isinstance(dtype, T.ArrayType):
        return _has_unordered(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_has_unordered(f.dataType) for f in dtype.fields)
    return False


def comparable(col: Column, dtype: T.DataType) -> Column:
    """``col`` in a form that supports ``<=>``; maps become sorted entries."""
    if not _has_unordered(dtype):
        return col
    if isinstance(dtype, T.VariantType):
        return F.to_json(col)
    if isinstance(dtype, T.MapType):
        entries = F.transform(
            F.map_entries(col),
            lambda e: F.struct(
                e["key"].alias("key"), comparable(e["value"], dtype.valueType).alias("value")
            ),
        )
        return F.array_sort(entries)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda e: comparable(e, dtype.elementType))
    fields = [comparable(col[f.name], f.dataType).alias(f.name) for f in dtype.fields]
    return F.when(col.isNotNull(), F.struct(*fields))


def _sorted_value(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name)
        inner = F.struct(*[_sorted_value(col[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(col.isNotNull(), inner)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda e: _sorted_value(e, dtype.elementType))
    return comparable(col, dtype)


def as_text(col: Column, dtype: T.DataType) -> Column:
    """A value as text: nested values as JSON, everything else by cast."""
    if isinstance(dtype, T.StringType):
        return col
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(_sorted_value(col, dtype), _JSON)
    return col.cast("string")


def struct_text(col: Column, dtype: T.StructType) -> Column:
    """JSON of a row struct with sorted field names; NULL for an absent row."""
    return F.when(col.isNotNull(), F.to_json(_sorted_value(col, dtype), _JSON))


def row_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    """JSON of the whole row with sorted column names and explicit NULLs."""
    types = {f.name: f.dataType for f in df.schema.fields}
    names = sorted(columns or df.columns)
    return F.to_json(
        F.struct(*[_sorted_value(F.col(n), types[n]).alias(n) for n in names]), _JSON
    )


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of :func:`row_text`, 64 hex characters."""
    return F.sha2(row_text(df, columns), 256)


def _lane(digest: Column, number: int) -> Column:
    """15 hex digits of a digest as a number below 2**60."""
    return F.conv(F.substring(digest, 1 + 15 * number, 15), 16, 10).cast("decimal(38,0)")


def lane_sums(digest: Column, weight: Column | int = 1) -> list[Column]:
    """Sums of a row digest's four lanes, ``s0`` to ``s3``, each row times ``weight``."""
    return [
        F.coalesce(F.sum(_lane(digest, i) * weight), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}")
        for i in range(4)
    ]


def digest_sums(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row ``row_count, s0, s1, s2, s3``: what a digest is made of, and can be added up."""
    hashed = df.select(row_hash(df, columns).alias("h"))
    return hashed.agg(F.count("*").alias("row_count"), *lane_sums(F.col("h")))


def as_checksum(sums: DataFrame) -> DataFrame:
    """``row_count, checksum`` of sums; 16 hex characters."""
    text = F.concat_ws(":", "row_count", *[F.col(f"s{i}").cast("string") for i in range(4)])
    return sums.select("row_count", F.substring(F.sha2(text, 256), 1, 16).alias("checksum"))


def checksum_of(row_count: int, lanes: list[int]) -> str:
    """:func:`as_checksum` of numbers the driver holds."""
    text = ":".join(map(str, [row_count, *lanes]))
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def table_digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row ``(row_count, checksum)`` that ignores row order and partitioning.

    Row hashes are summed in four independent lanes, so every task reduces its
    rows to one partial sum and nothing is sorted or gathered. Equal tables give
    equal digests. Being sums, they follow a change without a second look at the
    table: old row hashes are taken away and new ones added.
    """
    return as_checksum(digest_sums(df, columns))


def content_hash(**parts: Column) -> Column:
    """SHA-256 over the JSON of named parts (commit identity), 64 hex characters."""
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()]), _JSON), 256)
