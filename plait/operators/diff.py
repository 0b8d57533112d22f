"""Keyed table diff: rows, fields, definitions and schemas.

A diff shuffles each side once on the key. ``source`` is the changed side and
``target`` the side it is compared with.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.canonical import as_text, comparable
from .keys import align, key_text, row_struct, same_key, value_types

ADDED, REMOVED, MODIFIED, UNCHANGED = "added", "removed", "modified", "unchanged"


def _select_values(types: dict[str, T.DataType], columns: list[str] | None):
    return {n: t for n, t in types.items() if columns is None or n in columns}


def differs(a: Column, b: Column, types: dict[str, T.DataType]) -> Column:
    """Any field of two row structs differs (null-safe)."""
    tests = [
        ~comparable(a[n], t).eqNullSafe(comparable(b[n], t)) for n, t in types.items()
    ]
    return reduce(lambda x, y: x | y, tests, F.lit(False))


def row_pairs(
    source: DataFrame, target: DataFrame, keys: list[str], columns: list[str] | None = None
) -> tuple[DataFrame, dict[str, T.DataType]]:
    """Both sides by key as structs ``src`` and ``tgt`` (NULL = absent)."""
    types = _select_values(value_types([source, target], keys), columns)
    return align({"src": source, "tgt": target}, keys, types)


def diff_added(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``source`` whose key is not in ``target``."""
    known = target.select(*[F.col(k).alias(f"__t_{k}") for k in keys])
    return source.join(known, same_key(keys, "__t_"), "left_anti")


def diff_removed(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``target`` whose key is not in ``source``."""
    return diff_added(target, source, keys)


def _modified_pairs(source, target, keys, columns=None):
    pairs, types = row_pairs(source, target, keys, columns)
    both = F.col("src").isNotNull() & F.col("tgt").isNotNull()
    return pairs.where(both & differs(F.col("src"), F.col("tgt"), types)), types


def diff_modified(
    source: DataFrame, target: DataFrame, keys: list[str], columns: list[str] | None = None
) -> DataFrame:
    """Rows of ``source`` (as ``src`` and ``tgt`` structs) present on both sides that differ."""
    return _modified_pairs(source, target, keys, columns)[0]


def diff_rows(
    source: DataFrame, target: DataFrame, keys: list[str], columns: list[str] | None = None
) -> DataFrame:
    """One row per changed key: keys, ``change``, ``src`` and ``tgt`` structs."""
    pairs, types = row_pairs(source, target, keys, columns)
    src, tgt = F.col("src"), F.col("tgt")
    change = (
        F.when(tgt.isNull(), ADDED)
        .when(src.isNull(), REMOVED)
        .when(differs(src, tgt, types), MODIFIED)
    )
    return pairs.withColumn("change", change).where("change IS NOT NULL")


def _changed_fields(a: Column, b: Column, types: dict[str, T.DataType]) -> Column:
    entries = [
        F.when(
            ~comparable(a[n], t).eqNullSafe(comparable(b[n], t)),
            F.struct(
                F.lit(n).alias("field"), as_text(b[n], t).alias("from"), as_text(a[n], t).alias("to")
            ),
        )
        for n, t in types.items()
    ]
    if not entries:  # key columns only
        return F.array().cast("array<struct<field:string,from:string,to:string>>")
    return F.array_compact(F.array(*entries))


def diff_fields(
    source: DataFrame, target: DataFrame, keys: list[str], columns: list[str] | None = None
) -> DataFrame:
    """One row per changed top-level field of a modified row: ``field, from, to``.

    Values are text, nested values JSON; a nested change shows the whole value.
    """
    pairs, types = _modified_pairs(source, target, keys, columns)
    return pairs.select(*keys, F.inline(_changed_fields(F.col("src"), F.col("tgt"), types)))


def diff_tables(tables: dict[str, tuple[DataFrame, DataFrame | None, list[str]]]) -> DataFrame:
    """Changed keys ``(table, key, change)`` over all tables of the source.

    Tables only the target has are not in the mapping and so never reported; a
    table missing on the target is passed as None and counts as all added.
    """
    parts = []
    for name, (source, target, keys) in tables.items():
        if target is None:
            changed = source.withColumn("change", F.lit(ADDED))
        else:
            changed = diff_rows(source, target, keys)
        parts.append(
            changed.select(
                F.lit(name).alias("table"), key_text(changed, keys).alias("key"), "change"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def diff_summary(changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Change counts per table and kind (map-side combined)."""
    by = by or (["table", "change"] if "table" in changes.columns else ["change"])
    return changes.groupBy(*by).agg(F.count("*").alias("rows"))


def diff_status(branch: DataFrame, main: DataFrame, keys: list[str]) -> DataFrame:
    """Status of every row of ``main`` as seen from ``branch``."""
    rows, types = align({"src": branch, "tgt": main}, keys)
    status = (
        F.when(F.col("src").isNull(), "deleted_in_branch")
        .when(differs(F.col("src"), F.col("tgt"), types), MODIFIED)
        .otherwise(UNCHANGED)
    )
    return rows.where("tgt IS NOT NULL").select(*keys, status.alias("status"))


def diff_definitions(
    source: DataFrame, target: DataFrame, on: list[str] = ["table", "name"]
) -> DataFrame:
    """Definitions added or removed, compared by name only."""
    s = source.select(*on).distinct().withColumn("__s", F.lit(True))
    t = target.select(*on).distinct().withColumn("__t", F.lit(True))
    change = F.when(F.col("__t").isNull(), ADDED).when(F.col("__s").isNull(), REMOVED)
    return (
        s.join(t, on, "full_outer")
        .select(*on, change.alias("change"))
        .where("change IS NOT NULL")
    )


def diff_constraints(
    source: DataFrame, target: DataFrame, on: str = "table"
) -> DataFrame:
    """Tables whose row constraints (all other columns) differ or exist on one side only."""
    types = value_types([source, target], [on])
    s = source.select(on, row_struct(source, types).alias("src"))
    t = target.select(on, row_struct(target, types).alias("tgt"))
    src, tgt = F.col("src"), F.col("tgt")
    changed = src.isNull() | tgt.isNull() | differs(src, tgt, types)
    return s.join(t, on, "full_outer").where(changed)


def definition_status(
    source: DataFrame,
    target: DataFrame,
    on: list[str] = ["table", "name"],
    body: str = "definition",
) -> DataFrame:
    """Every definition of both sides with its change kind and both bodies."""
    s = source.select(*on, F.struct(body).alias("src"))
    t = target.select(*on, F.struct(body).alias("tgt"))
    change = (
        F.when(F.col("tgt").isNull(), ADDED)
        .when(F.col("src").isNull(), REMOVED)
        .when(~F.col("src").eqNullSafe(F.col("tgt")), MODIFIED)
        .otherwise(UNCHANGED)
    )
    return s.join(t, on, "full_outer").select(
        *on,
        change.alias("change"),
        F.col(f"src.{body}").alias("source_body"),
        F.col(f"tgt.{body}").alias("target_body"),
    )


def diff_search_definitions(
    source: DataFrame,
    target: DataFrame,
    on: list[str] = ["table", "name"],
    body: str = "definition",
) -> DataFrame:
    """Definition changes; tables without any change are dropped.

    Which tables changed is decided from counts per table, so a table with most
    of the definitions costs one summary row.
    """
    status = definition_status(source, target, on, body)
    table = on[0]
    touched = (
        status.where(F.col("change") != UNCHANGED).select(table).distinct()
    )
    return status.join(touched, table, "left_semi")


def merge_definitions(
    source: DataFrame,
    target: DataFrame,
    remove_orphans: bool = False,
    on: list[str] = ["table", "name"],
    body: str = "definition",
) -> DataFrame:
    """New target definitions: create missing, replace modified, keep or drop the rest.

    ``action`` tells what happened to each one (created, updated, kept).
    """
    status = definition_status(source, target, on, body)
    if remove_orphans:
        status = status.where(F.col("change") != REMOVED)
    action = (
        F.when(F.col("change") == ADDED, "created")
        .when(F.col("change") == MODIFIED, "updated")
        .otherwise("kept")
    )
    merged = F.when(F.col("change") == REMOVED, F.col("target_body")).otherwise(
        F.col("source_body")
    )
    return status.select(*on, merged.alias(body), action.alias("action"))


def merge_definition_counts(
    source: DataFrame,
    target: DataFrame,
    remove_orphans: bool = False,
    on: list[str] = ["table", "name"],
    body: str = "definition",
) -> DataFrame:
    """How many definitions a merge creates, updates and removes."""
    change = F.col("change")
    return definition_status(source, target, on, body).agg(
        F.count_if(change == ADDED).alias("created"),
        F.count_if(change == MODIFIED).alias("updated"),
        F.count_if((change == REMOVED) & F.lit(remove_orphans)).alias("removed"),
    )


def diff_log(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Net change per key from a change log: O(changes), not O(table).

    The first before-image and the last after-image decide; a key that ends
    where it began is no change.
    """
    types = {f.name: f.dataType for f in log.schema.fields}
    before, after = F.col("before"), F.col("after")
    net = log.groupBy(*keys).agg(
        F.min_by("before", seq).alias("before"), F.max_by("after", seq).alias("after")
    )
    change = F.when(before.isNull() & after.isNotNull(), ADDED).when(
        before.isNotNull() & after.isNull(), REMOVED
    ).when(
        ~comparable(before, types["before"]).eqNullSafe(comparable(after, types["after"])),
        MODIFIED,
    )
    return net.withColumn("change", change).where("change IS NOT NULL")


def schema_paths(dtype: T.DataType, path: str = "") -> dict[str, str]:
    """Type by path through structs (``a.b``), arrays (``a[]``) and maps (``a{key}``, ``a{value}``)."""
    if isinstance(dtype, T.StructType):
        out = {path: "struct"} if path else {}
        for f in dtype.fields:
            out |= schema_paths(f.dataType, f"{path}.{f.name}" if path else f.name)
        return out
    if isinstance(dtype, T.ArrayType):
        return {path: "array"} | schema_paths(dtype.elementType, f"{path}[]")
    if isinstance(dtype, T.MapType):
        inner = schema_paths(dtype.keyType, f"{path}{{key}}") | schema_paths(dtype.valueType, f"{path}{{value}}")
        return {path: "map"} | inner
    return {path: dtype.simpleString()}


def diff_schema(source: DataFrame, target: DataFrame) -> DataFrame:
    """Paths added, removed or retyped: ``path, change, from_type, to_type`` (metadata only).

    Nested types are walked to their leaves, so a change deep in a struct, an array or a
    map is reported where it is; a container that changes its kind is retyped and its
    inner paths come and go.
    """
    new, old = schema_paths(source.schema), schema_paths(target.schema)
    rows = []
    for path in dict.fromkeys([*old, *new]):
        if path not in old:
            rows.append((path, ADDED, None, new[path]))
        elif path not in new:
            rows.append((path, REMOVED, old[path], None))
        elif old[path] != new[path]:
            rows.append((path, "retyped", old[path], new[path]))
    return source.sparkSession.createDataFrame(
        rows, "path string, change string, from_type string, to_type string"
    )


def filled_paths(df: DataFrame) -> DataFrame:
    """``path, rows``: how many rows hold a value at each path outside arrays and maps."""
    paths = [p for p in schema_paths(df.schema) if not re.search(r"[\[{]", p)]
    if not paths:
        return df.sparkSession.createDataFrame([], "path string, rows bigint")
    counts = df.agg(*[F.count(F.col(p)).alias(f"c{i}") for i, p in enumerate(paths)])
    entries = F.array(*[F.struct(F.lit(p).alias("path"), F.col(f"c{i}").alias("rows")) for i, p in enumerate(paths)])
    return counts.select(F.inline(entries))
