"""Key handling shared by the keyed operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.canonical import as_text

# Stands for the values of a row that has key columns only.
PRESENT = "__present"


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once or hold a NULL."""
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where((F.col("rows") > 1) | null_key)


def assert_unique_key(df: DataFrame, keys: list[str]) -> None:
    """Raise when ``keys`` do not identify rows (one aggregation over the table)."""
    bad = duplicate_keys(df, keys).limit(1).collect()
    if bad:
        raise ValueError(f"keys {keys} are not unique, for example {bad[0].asDict()}")


def key_text(df: DataFrame, keys: list[str]) -> Column:
    """The key as one text value, parts joined by ``/``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return F.concat_ws("/", *[as_text(F.col(k), types[k]) for k in keys])


def value_types(frames: list[DataFrame], keys: list[str]) -> dict[str, T.DataType]:
    """Union of the non-key columns in first-seen order.

    A column whose type differs between the tables is compared as text.
    """
    out: dict[str, T.DataType] = {}
    for df in frames:
        for f in df.schema.fields:
            if f.name in keys:
                continue
            if f.name not in out:
                out[f.name] = f.dataType
            elif out[f.name] != f.dataType:
                out[f.name] = T.StringType()
    return out


def row_struct(df: DataFrame, types: dict[str, T.DataType]) -> Column:
    """The value columns as one struct of the given types; missing columns are NULL."""
    own = {f.name: f.dataType for f in df.schema.fields}
    fields = []
    for name, dtype in types.items():
        if name not in own:
            col = F.lit(None).cast(dtype)
        elif own[name] == dtype:
            col = F.col(name)
        else:
            col = as_text(F.col(name), own[name])
        fields.append(col.alias(name))
    return F.struct(*(fields or [F.lit(True).alias(PRESENT)]))


def same_key(keys: list[str], prefix: str) -> Column:
    """The key columns equal their prefixed namesakes; NULL equals NULL."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys])


def align(
    versions: dict[str, DataFrame], keys: list[str], types: dict[str, T.DataType] | None = None
) -> tuple[DataFrame, dict[str, T.DataType]]:
    """One row per key with a struct per version (NULL = row absent there).

    The union is shuffled once; the aggregation then runs on that partitioning. NULL
    keys are keys like any other; a key that occurs twice in a version raises.
    """
    types = value_types(list(versions.values()), keys) if types is None else types
    names = list(versions)
    fields = [T.StructField(n, t) for n, t in types.items()] or [T.StructField(PRESENT, T.BooleanType())]
    absent = F.lit(None).cast(T.StructType(fields))
    parts = []
    for name, df in versions.items():
        row = row_struct(df, types)
        parts.append(df.select(*keys, *[(row if n == name else absent).alias(n) for n in names]))
    stacked = reduce(DataFrame.unionByName, parts).repartition(*keys)

    def only(name: str) -> Column:
        twice = F.raise_error(F.concat(F.lit(f"keys {keys} are not unique in {name}: "), F.to_json(F.struct(*keys))))
        return F.when(F.count(name) > 1, twice).otherwise(F.any_value(name, ignoreNulls=F.lit(True)))

    return stacked.groupBy(*keys).agg(*[only(n).alias(n) for n in names]), types
