"""Ordered computations that stay parallel when one group holds most rows.

A plain window puts a whole group into one task. Here the order is first cut
into chunks of similar size and each (group, chunk) is windowed on its own. What
a chunk needs from the ones before it comes from a small per-chunk summary and
joins the window as one extra row in front, so the data are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written

_CHUNK = "__chunk"


def _chunked(df: DataFrame, group: list[str], order: str, chunk: Column | None) -> DataFrame:
    """Cut each group along ``order``, into parts of similar size over the whole table.

    Spark's range partitioning cuts by any type that can be ordered, NULLs first, and
    never between equal values. Its cut points come from a sample, so the rows are
    written once with the part they fall into; only the balance depends on the sample.
    """
    if chunk is not None:
        return df.withColumn(_CHUNK, chunk)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(parts, *group, order)
    return written(cut.withColumn(_CHUNK, F.spark_partition_id().cast("long")), "chunks")


def _by_chunk(group: list[str], descending: bool = False) -> Window:
    """Order chunk summaries; at most one row per chunk and group."""
    key = F.desc(_CHUNK) if descending else F.asc(_CHUNK)
    return Window.partitionBy(*(group or [F.lit(0)])).orderBy(key)


def _fronted(rows: DataFrame, carry: DataFrame) -> DataFrame:
    """Rows marked real, with one carry row per (group, chunk) marked not real."""
    return rows.withColumn("__real", F.lit(1)).unionByName(
        carry.withColumn("__real", F.lit(0)), allowMissingColumns=True
    )


def previous_value(
    df: DataFrame,
    group: list[str],
    order: str,
    value: Column,
    name: str,
    chunk: Column | None = None,
) -> DataFrame:
    """``lag(value)`` per group along a unique ``order`` column, NULL first.

    ``chunk`` may be any function of ``order`` that is never NULL and never falls, such
    as ``floor(seq / 1e6)`` of a whole number; by default the order is cut by ranges.
    """
    cut = _chunked(df, group, order, chunk).withColumn("__v", F.struct(value.alias("v")))
    last = cut.groupBy(*group, _CHUNK).agg(F.max_by("__v", F.struct(order)).alias("__last"))
    carry = last.select(*group, _CHUNK, F.lag("__last").over(_by_chunk(group)).alias("__v"))
    local = Window.partitionBy(*group, _CHUNK).orderBy("__real", order)
    out = _fronted(cut, carry).withColumn("__prev", F.lag("__v").over(local)).where("__real = 1")
    return out.withColumn(name, F.col("__prev.v")).drop("__v", "__prev", "__real", _CHUNK)


def position(
    df: DataFrame,
    group: list[str],
    order: str,
    name: str,
    descending: bool = False,
    chunk: Column | None = None,
) -> DataFrame:
    """Zero-based position per group along a unique ``order`` column; NULL is least."""
    cut = _chunked(df, group, order, chunk)
    sizes = cut.groupBy(*group, _CHUNK).agg(F.count("*").alias("__n"))
    before = _by_chunk(group, descending).rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.select(
        *group, _CHUNK, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off")
    )
    key = F.desc(order) if descending else F.asc(order)
    local = Window.partitionBy(*group, _CHUNK).orderBy("__real", key)
    rows = _fronted(cut, carry)
    # The carry row is number 1, so the first real row is number 2.
    place = F.row_number().over(local) - 2 + F.first("__off").over(local)
    return (
        rows.withColumn(name, place).where("__real = 1").drop("__off", "__real", _CHUNK)
    )


def rank_by(
    df: DataFrame, group: list[str], order: str, name: str, descending: bool = True
) -> DataFrame:
    """SQL ``rank()`` per group over a column of any ordered type; NULL is least.

    Ties are counted once per distinct value before anything is ordered, so a
    value shared by most rows costs one summary row.
    """
    counts = df.groupBy(*group, order).agg(F.count("*").alias("__n"))
    cut = _chunked(counts, group, order, None)
    before = _by_chunk(group, descending).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        cut.groupBy(*group, _CHUNK)
        .agg(F.sum("__n").alias("__size"))
        .select(*group, _CHUNK, F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__n"))
    )
    key = F.desc(order) if descending else F.asc(order)
    earlier = (
        Window.partitionBy(*group, _CHUNK)
        .orderBy("__real", key)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = _fronted(cut, carry).withColumn(name, F.sum("__n").over(earlier) + 1)
    names = [*group, order]
    ranks = placed.where("__real = 1").select(
        *[F.col(n).alias(f"__r_{n}") for n in names], name
    )
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(n).eqNullSafe(F.col(f"__r_{n}"))
    return df.join(ranks, cond, "left").drop(*[f"__r_{n}" for n in names])


def as_of_join(
    probes: DataFrame,
    versions: DataFrame,
    group: list[str],
    probe_time: str,
    version_time: str,
    tie: str,
) -> DataFrame:
    """For each probe the latest version of its group with time not after the probe.

    Probes keep their columns and gain the version's other columns (NULL when
    there is none or the probe has no time); times are timestamps, a version without
    one never applies, ties go to the greater ``tie``.
    Distinct probe times and versions are laid out on one time line, cut into
    chunks of similar size; the answers are then joined back to the probes.
    """
    rest = [c for c in versions.columns if c not in group]

    def micros(col: str) -> Column:
        return F.unix_micros(F.col(col).cast("timestamp"))

    newest = F.max_by(F.struct(*rest), F.col(tie).cast("string")).alias("__v")
    dated = versions.where(F.col(version_time).isNotNull())
    v = dated.groupBy(*group, micros(version_time).alias("__t")).agg(newest)
    times = probes.where(F.col(probe_time).isNotNull())
    times = times.select(*group, micros(probe_time).alias("__t")).distinct()
    line = v.withColumn("__kind", F.lit(0)).unionByName(
        times.withColumn("__kind", F.lit(1)), allowMissingColumns=True
    )
    line = _chunked(line, group, "__t", None)
    by_time = F.when(F.col("__kind") == 0, F.col("__t"))
    last = line.groupBy(*group, _CHUNK).agg(F.max_by("__v", by_time).alias("__last"))
    before = _by_chunk(group).rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(
        *group, _CHUNK, F.last("__last", ignorenulls=True).over(before).alias("__v")
    )
    local = (
        Window.partitionBy(*group, _CHUNK)
        .orderBy("__real", "__t", "__kind")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    answered = _fronted(line, carry).withColumn(
        "__f", F.last("__v", ignorenulls=True).over(local)
    )
    answers = answered.where("__kind = 1").select(
        *[F.col(n).alias(f"__a_{n}") for n in group], F.col("__t").alias("__a_t"), "__f"
    )
    cond = micros(probe_time) == F.col("__a_t")
    for n in group:
        cond = cond & F.col(n).eqNullSafe(F.col(f"__a_{n}"))
    return probes.join(answers, cond, "left").select(*probes.columns, "__f.*")
