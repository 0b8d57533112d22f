"""The document query surface on tables: find, group, lookup, page, infer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.ordered import position, rank_by
from ..functions.predicates import kind_name


def find(
    df: DataFrame,
    where: Column | str | None = None,
    sort: list | None = None,
    limit: int | None = None,
    skip: int = 0,
) -> DataFrame:
    """Filter, sort and page; sort with limit runs as a per-task top-k."""
    if where is not None:
        df = df.where(where)
    if sort:
        df = df.orderBy(*sort)
    if skip:
        df = df.offset(skip)
    return df if limit is None else df.limit(limit)


def find_exact(df: DataFrame, values: dict) -> DataFrame:
    """Rows whose top-level fields equal the given values, NULL matching NULL."""
    for name, value in values.items():
        df = df.where(F.col(name).eqNullSafe(F.lit(value)))
    return df


def count_rows(df: DataFrame, where: Column | str | None = None) -> DataFrame:
    return (df if where is None else df.where(where)).agg(F.count("*").alias("rows"))


def count_stage(df: DataFrame, name: str = "count") -> DataFrame:
    """Row count as a table; no row for an empty input."""
    return df.agg(F.count("*").alias(name)).where(F.col(name) > 0)


def group_all(df: DataFrame, **aggregates: Column) -> DataFrame:
    """One group over all rows; no row for an empty input."""
    named = [c.alias(n) for n, c in aggregates.items()]
    return df.agg(*named, F.count("*").alias("__n")).where("__n > 0").drop("__n")


def top_groups(df: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The largest groups by row count, ties by group value."""
    counts = df.groupBy(*by).agg(F.count("*").alias("rows"))
    return counts.orderBy(F.desc("rows"), *by).limit(limit)


def lookup(
    left: DataFrame, right: DataFrame, left_on: str, right_on: str, name: str
) -> DataFrame:
    """Left outer join with the matches as an array column.

    An array is one value of one row, for keys known to have few matches;
    :func:`lookup_rows` and :func:`lookup_agg` take keys of any size.
    """
    matches = right.groupBy(F.col(right_on).alias("__k")).agg(
        F.collect_list(F.struct(*right.columns)).alias(name)
    )
    joined = left.join(matches, F.col(left_on) == F.col("__k"), "left").drop("__k")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(matches.schema[name].dataType)))


def lookup_one(
    left: DataFrame, right: DataFrame, left_on: str, right_on: str, name: str, order: str
) -> DataFrame:
    """Left outer join with the first match by ``order`` as a struct column."""
    first = right.groupBy(F.col(right_on).alias("__k")).agg(
        F.min_by(F.struct(*right.columns), F.col(order)).alias(name)
    )
    return left.join(first, F.col(left_on) == F.col("__k"), "left").drop("__k")


def lookup_agg(
    left: DataFrame, right: DataFrame, left_on: str, right_on: str, **aggregates: Column
) -> DataFrame:
    """Left outer join with aggregates of the matches, combined before the shuffle."""
    named = [c.alias(n) for n, c in aggregates.items()]
    found = right.groupBy(F.col(right_on).alias("__k")).agg(*named)
    return left.join(found, F.col(left_on) == F.col("__k"), "left").drop("__k")


def lookup_rows(
    left: DataFrame, right: DataFrame, left_on: str, right_on: str, keep_unmatched: bool = True
) -> DataFrame:
    """One row per match; unmatched rows stay with NULLs when ``keep_unmatched``."""
    how = "left" if keep_unmatched else "inner"
    return left.join(right, left[left_on] == right[right_on], how)


def sample_rows(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly ``min(n, rows)`` random rows, as a top-k over random numbers."""
    return df.withColumn("__r", F.rand(seed)).orderBy("__r").limit(n).drop("__r")


def page(df: DataFrame, sort: list, offset: int, limit: int) -> DataFrame:
    return find(df, None, sort, limit, offset)


def newest(df: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The newest rows by the given columns, all descending."""
    return df.orderBy(*[F.desc(c) for c in by]).limit(limit)


def latest_per(df: DataFrame, group: list[str], by: list[str]) -> DataFrame:
    """The latest row of each group; reduced on the map side before the shuffle."""
    row = F.struct(*[c for c in df.columns if c not in group])
    top = df.groupBy(*group).agg(F.max_by(row, F.struct(*by)).alias("r"))
    return top.select(*group, "r.*").select(*df.columns)


def keep_last(df: DataFrame, group: list[str], by: list[str], n: int) -> DataFrame:
    """The newest ``n`` rows per group; tasks cut to ``n`` per group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*[F.desc(c) for c in by])
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def pruned(df: DataFrame, group: list[str], by: list[str], n: int, keys: list[str]) -> DataFrame:
    """The rows :func:`keep_last` would drop."""
    return df.join(keep_last(df, group, by, n).select(*keys), keys, "left_anti")


def stack_positions(df: DataFrame, group: list[str], seq: str) -> DataFrame:
    """Position in a stack, 0 for the newest entry."""
    return position(df, group, seq, "position", descending=True)


def rank_rows(df: DataFrame, group: list[str], by: str, descending: bool = True) -> DataFrame:
    return rank_by(df, group, by, "rank", descending)


def union_with(*frames: DataFrame) -> DataFrame:
    """Stack tables by column name; missing columns become NULL."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def key_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every key of two one-column tables with ``in_a`` and ``in_b`` flags."""
    name = a.columns[0]
    both = a.select(F.col(name).alias("key"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(
        b.select(F.col(b.columns[0]), F.lit(0), F.lit(1))
    )
    return both.groupBy("key").agg(
        (F.max("a") == 1).alias("in_a"), (F.max("b") == 1).alias("in_b")
    )


def infer_schema(docs: DataFrame, sample: int | None = None, seed: int = 0) -> DataFrame:
    """Fields of JSON documents in the first column: ``field, types, rows``."""
    doc = docs.columns[0]
    if sample is not None:
        docs = sample_rows(docs.select(doc), sample, seed)
    spark = docs.sparkSession
    parsed = docs.select(F.parse_json(doc).alias("v"))
    entries = spark.sql(
        "SELECT e.key AS field, schema_of_variant(e.value) AS kind "
        "FROM {parsed} p, LATERAL variant_explode(p.v) e",
        parsed=parsed,
    )
    kinds = entries.select("field", kind_name(F.col("kind")).alias("kind"))
    return kinds.groupBy("field").agg(
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("types"),
        F.count("*").alias("rows"),
    )


def field_counts(df: DataFrame) -> DataFrame:
    """For a typed table: ``field, type, rows`` with the non-null count per column."""
    counted = df.agg(
        *[F.count(F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields]
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("field"),
                F.lit(document_type(f.dataType)).alias("type"),
                F.col(f"`{f.name}`").alias("rows"),
            )
            for f in df.schema.fields
        ]
    )
    return counted.select(F.inline(entries))


def document_type(dtype: T.DataType) -> str:
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, T.ArrayType):
        return "array"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    return "object"


def table_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    parts = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        parts = one if parts is None else parts.union(one)
    return parts


def table_bytes(tables: dict[str, DataFrame]) -> DataFrame:
    """Stored bytes per table, from a listing of its files; no content is read."""
    parts = None
    for name, df in tables.items():
        files = df.sparkSession.read.format("binaryFile").load(df.inputFiles())
        files = files.select(F.lit(name).alias("table"), "length")
        parts = files if parts is None else parts.union(files)
    return parts.groupBy("table").agg(F.sum("length").alias("bytes"), F.count("*").alias("files"))


def system_status(branches: DataFrame) -> DataFrame:
    """Branch counts by status and the latest activity, deleted branches aside."""
    live = branches.where("status <> 'deleted'")
    return live.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "merged").alias("merged"),
        F.max_by("updated_at", F.struct("created_at", "name")).alias("latest_activity"),
    )


def owner_status(branches: DataFrame) -> DataFrame:
    """Branches and active branches per owner."""
    return branches.where("status <> 'deleted'").groupBy("created_by").agg(
        F.count("*").alias("branches"),
        F.count_if(F.col("status") == "active").alias("active"),
    )


def list_branches(
    branches: DataFrame, status: str | None = None, include_deleted: bool = False
) -> DataFrame:
    """Branches newest first."""
    if not include_deleted:
        branches = branches.where("status <> 'deleted'")
    if status is not None:
        branches = branches.where(F.col("status") == status)
    return branches.orderBy(F.desc("created_at"), F.desc("name"))
