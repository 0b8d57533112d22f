"""Three-way and two-way merge of keyed tables.

The three versions are brought together by one shuffle on the key; everything
else (classification, conflicts, counts, the merged rows) is a projection of
that aligned table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from ..functions.canonical import as_text, comparable, struct_text
from . import changesets
from .diff import diff_rows, differs
from .keys import PRESENT, align, key_text, row_struct, same_key, value_types

ADD, DELETE, MODIFY, SKIP = "add", "delete", "modify", "skip"
THEIRS_DELETED, OURS_DELETED = "theirs_deleted", "ours_deleted"
FIELD_CONFLICT = "field_conflict"

# Fixed value: the pseudo-field that reports a delete/modify conflict.
DELETED_FIELD = "_deleted"

COUNTS = ("rows_added", "rows_removed", "rows_modified", "conflict_count")

STRATEGIES = ("manual", "abort", "ours", "theirs")


@dataclass(frozen=True)
class MergePlan:
    """Aligned and classified rows: keys, base, ours, theirs, outcome, taken, conflicts."""

    rows: DataFrame
    keys: list[str]
    types: dict[str, T.DataType]


def _field_states(types: dict[str, T.DataType]) -> dict[str, tuple[Column, Column]]:
    """Per field: (only theirs changed, both changed differently)."""
    states = {}
    for n, t in types.items():
        b, o, r = (comparable(F.col(s)[n], t) for s in ("base", "ours", "theirs"))
        agree = o.eqNullSafe(r)
        states[n] = (
            ~agree & b.eqNullSafe(o),
            ~agree & ~b.eqNullSafe(o) & ~b.eqNullSafe(r),
        )
    return states


def diff3(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str]) -> MergePlan:
    """Classify every key of three versions; see the outcome constants."""
    return classify(*align({"base": base, "ours": ours, "theirs": theirs}, keys), keys)


def classify(rows: DataFrame, types: dict[str, T.DataType], keys: list[str]) -> MergePlan:
    """Classify rows of ``base, ours, theirs`` by key (NULL: absent in that version)."""
    b, o, r = F.col("base"), F.col("ours"), F.col("theirs")
    states = _field_states(types)
    schema = T.StructType([T.StructField(n, t) for n, t in types.items()])

    taken = F.array_compact(F.array(*[F.when(s[0], F.lit(n)) for n, s in states.items()]))
    clashes = F.array_compact(
        F.array(
            *[
                F.when(
                    s[1],
                    F.struct(
                        F.lit(n).alias("field"),
                        as_text(b[n], types[n]).alias("base"),
                        as_text(o[n], types[n]).alias("ours"),
                        as_text(r[n], types[n]).alias("theirs"),
                    ),
                )
                for n, s in states.items()
            ]
        )
    )
    any_clash = reduce(lambda x, y: x | y, [s[1] for s in states.values()], F.lit(False))
    any_taken = reduce(lambda x, y: x | y, [s[0] for s in states.values()], F.lit(False))
    outcome = (
        F.when(b.isNull() & o.isNull(), ADD)
        .when(b.isNull() & r.isNull(), SKIP)
        .when(o.isNull() & r.isNull(), SKIP)
        .when(r.isNull(), F.when(differs(b, o, types), THEIRS_DELETED).otherwise(DELETE))
        .when(o.isNull(), F.when(differs(b, r, types), OURS_DELETED).otherwise(SKIP))
        .when(any_clash, FIELD_CONFLICT)
        .when(any_taken, MODIFY)
        .otherwise(SKIP)
    )
    deleted = F.array(
        F.struct(
            F.lit(DELETED_FIELD).alias("field"),
            struct_text(b, schema).alias("base"),
            struct_text(o, schema).alias("ours"),
            struct_text(r, schema).alias("theirs"),
        )
    )
    classified = rows.withColumn("outcome", outcome)
    both = F.col("outcome").isin(FIELD_CONFLICT, MODIFY)
    classified = classified.withColumn("taken", F.when(both, taken)).withColumn(
        "conflicts",
        F.when(F.col("outcome") == FIELD_CONFLICT, clashes).when(
            F.col("outcome").isin(THEIRS_DELETED, OURS_DELETED), deleted
        ),
    )
    return MergePlan(classified, keys, types)


def conflicts(plan: MergePlan) -> DataFrame:
    """One row per conflicting field: keys, ``field, base, ours, theirs`` as text."""
    found = plan.rows.where(
        F.col("outcome").isin(FIELD_CONFLICT, THEIRS_DELETED, OURS_DELETED)
    )
    return found.select(*plan.keys, F.inline("conflicts"))


def has_conflicts(plan: MergePlan) -> bool:
    return not plan.rows.where(
        F.col("outcome").isin(FIELD_CONFLICT, THEIRS_DELETED, OURS_DELETED)
    ).isEmpty()


def merge_counts(
    plans: dict[str, MergePlan], strategy: str = "manual", dry_run: bool = False
) -> DataFrame:
    """One row of merge results over all tables.

    ``tables_affected`` counts tables with additions, deletions, clean
    modifications or rows deleted by theirs, not those with field conflicts only.
    """
    parts = []
    for name, plan in plans.items():
        parts.append(
            plan.rows.select(
                F.lit(name).alias("table"),
                "outcome",
                F.coalesce(F.size("conflicts"), F.lit(0)).alias("n"),
            )
        )
    out = F.col("outcome")
    per_table = (
        reduce(DataFrame.unionByName, parts)
        .groupBy("table")
        .agg(
            F.count_if(out == ADD).alias("a"),
            F.count_if(out == DELETE).alias("d"),
            F.count_if(out == MODIFY).alias("m"),
            F.count_if(out == THEIRS_DELETED).alias("t"),
            F.sum(F.when(F.col("n") > 0, F.col("n")).otherwise(0)).alias("c"),
        )
    )
    total = per_table.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("rows_added"),
        F.coalesce(F.sum("d"), F.lit(0)).alias("rows_removed"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("rows_modified"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("conflict_count"),
        F.count_if(F.col("a") + F.col("d") + F.col("m") + F.col("t") > 0).alias("tables_affected"),
    )
    gated = strategy in ("manual", "abort")
    success = (F.col("conflict_count") == 0) if gated else F.lit(True)
    return total.withColumn("success", success).withColumn("dry_run", F.lit(dry_run))


def observed(plan: MergePlan) -> tuple[MergePlan, Observation]:
    """The plan with counts that become known while its rows are computed.

    A write of :func:`merged_rows` then yields the counts of :func:`merge_counts`
    for one table without a second pass.
    """
    watch = Observation()
    out = F.col("outcome")
    size = F.when(F.col("conflicts").isNotNull(), F.size("conflicts")).otherwise(0)
    rows = plan.rows.observe(
        watch,
        F.count_if(out == ADD).alias("rows_added"),
        F.count_if(out == DELETE).alias("rows_removed"),
        F.count_if(out == MODIFY).alias("rows_modified"),
        F.count_if(out == THEIRS_DELETED).alias("theirs_deleted"),
        F.coalesce(F.sum(size), F.lit(0)).alias("conflict_count"),
    )
    return MergePlan(rows, plan.keys, plan.types), watch


def merged_rows(
    plan: MergePlan, strategy: str = "ours", keep_clean_fields: bool = False
) -> DataFrame:
    """The target after the merge, with conflicts resolved as ours or theirs.

    A row with a field conflict takes over only its conflicting fields; fields
    that only theirs changed are kept for such rows with ``keep_clean_fields``.
    """
    dropped, fields = _resolution(plan, strategy, keep_clean_fields)
    return plan.rows.where(~dropped).select(*plan.keys, *fields)


def _resolution(plan: MergePlan, strategy: str, keep_clean_fields: bool) -> tuple[Column, list[Column]]:
    """Whether the merged target lacks a row, and its fields if not."""
    theirs_wins = F.lit(strategy == "theirs")
    out = F.col("outcome")
    dropped = (
        (out == DELETE)
        | ((out == THEIRS_DELETED) & theirs_wins)
        | ((out == OURS_DELETED) & ~theirs_wins)
        | (F.col("ours").isNull() & (out == SKIP))
    )
    whole_theirs = (out == ADD) | ((out == OURS_DELETED) & theirs_wins)
    take_clean = (out == MODIFY) | ((out == FIELD_CONFLICT) & F.lit(keep_clean_fields))
    fields = []
    for n, (clean, clash) in _field_states(plan.types).items():
        from_theirs = (
            whole_theirs
            | (take_clean & clean)
            | ((out == FIELD_CONFLICT) & clash & theirs_wins)
        )
        fields.append(
            F.when(from_theirs, F.col("theirs")[n]).otherwise(F.col("ours")[n]).alias(n)
        )
    return dropped, fields


def merged_changes(
    plan: MergePlan, columns: list[str], strategy: str = "ours", keep_clean_fields: bool = False
) -> DataFrame:
    """What :func:`merged_rows` changes in ours, as ``op, key, before, after``.

    ``columns`` names the target's columns in order; images hold whole rows.
    """
    dropped, fields = _resolution(plan, strategy, keep_clean_fields)
    values = {n: f for n, f in zip(plan.types, fields)}
    after = F.struct(*[F.col(c) if c in plan.keys else values[c].alias(c) for c in columns])
    ours = F.struct(*[F.col(c) if c in plan.keys else F.col("ours")[c].alias(c) for c in columns])
    rows = plan.rows.select(
        F.struct(*plan.keys).alias("key"),
        F.when(F.col("ours").isNotNull(), ours).alias("before"),
        F.when(~dropped, after).alias("after"),
    )
    return changesets.with_op(rows)


def diff3_changes(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> MergePlan:
    """:func:`diff3` from what both sides changed since the base, without the tables.

    ``ours`` and ``theirs`` are net changes (``key, before, after``, one per key). Only keys
    that theirs changed can change ours: where ours left the row alone, its row is theirs'
    before-image. Rows that neither changed are neither read nor moved.
    """
    types = {f.name: f.dataType for f in theirs.schema["after"].dataType.fields if f.name not in keys}
    own = ours.select(
        *[F.col("key")[k].alias(f"__o_{k}") for k in keys], F.lit(True).alias("__hit"), F.col("after").alias("__after")
    )
    rows = theirs.select(*[F.col("key")[k].alias(k) for k in keys], "before", "after")
    rows = rows.join(own, same_key(keys, "__o_"), "left")

    def values(image: Column) -> Column:
        fields = [image[n].alias(n) for n in types] or [F.lit(True).alias(PRESENT)]
        return F.when(image.isNotNull(), F.struct(*fields))

    before, after, mine = (values(F.col(c)) for c in ("before", "after", "__after"))
    rows = rows.select(
        *keys, before.alias("base"), F.when(F.col("__hit"), mine).otherwise(before).alias("ours"), after.alias("theirs")
    )
    return classify(rows, types, keys)


def merge3(
    base: DataFrame,
    ours: DataFrame,
    theirs: DataFrame,
    keys: list[str],
    strategy: str = "manual",
    keep_clean_fields: bool = False,
) -> DataFrame:
    """Target after a three-way merge; ``manual`` with conflicts leaves it untouched.

    Every strategy but ``manual`` and ``theirs`` resolves as ours.
    """
    _check(strategy)
    plan = diff3(base, ours, theirs, keys)
    if strategy == "manual" and has_conflicts(plan):
        return ours
    return merged_rows(plan, strategy, keep_clean_fields)


def merge_detect(
    base: DataFrame | None,
    source: DataFrame,
    target: DataFrame,
    keys: list[str],
    strategy: str = "abort",
) -> tuple[DataFrame, DataFrame | None]:
    """Merge with conflict detection: (new target, conflicts with a reason).

    Without a base the merge falls back to :func:`merge2` and reports no
    conflicts. ``abort`` with conflicts returns the target unchanged; every
    strategy but ``theirs`` resolves as ours.
    """
    _check(strategy)
    if base is None:
        return merge2(source, target, keys), None
    plan = diff3(base, target, source, keys)
    reasons = conflict_reasons(plan)
    if strategy == "abort" and has_conflicts(plan):
        return target, reasons
    return merged_rows(plan, strategy), reasons


def conflict_reasons(plan: MergePlan) -> DataFrame:
    text = F.concat(F.lit('Concurrent change on field "'), "field", F.lit('"'))
    return conflicts(plan).select(*plan.keys, text.alias("reason"))


def merge2(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Make the target equal the source: rows only the target has are deleted.

    No join is needed: the result is the source in the target's column order,
    with the source's extra columns last.
    """
    types = value_types([target, source], keys)
    row = row_struct(source, types)
    return source.select(*keys, row.alias("r")).select(*keys, "r.*")


def merge2_counts(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows a two-way merge adds, removes and modifies."""
    change = F.col("change")
    return diff_rows(source, target, keys).agg(
        F.count_if(change == "added").alias("rows_added"),
        F.count_if(change == "removed").alias("rows_removed"),
        F.count_if(change == "modified").alias("rows_modified"),
    )


def task_review(
    source: DataFrame, target: DataFrame, keys: list[str], auto_merge: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Counts against the target, and the target after an optional merge."""
    counts = merge2_counts(source, target, keys)
    return counts, merge2(source, target, keys) if auto_merge else target


Check = tuple[int, str, Callable[[DataFrame], tuple[bool, str | None]]]


def merge_gate(rows: DataFrame, checks: list[Check]) -> tuple[bool, str | None]:
    """Run pre-merge checks by ascending priority; the first rejection wins.

    A check gets the plan's rows and returns (allow, reason); one that raises
    rejects.
    """
    for _, name, check in sorted(checks, key=lambda c: c[0]):
        try:
            allow, reason = check(rows)
        except Exception as error:
            return False, f'Check "{name}" failed: {error}'
        if not allow:
            return False, reason or f'Rejected by check "{name}"'
    return True, None


def after_merge(rows: DataFrame, handlers: list[Callable[[DataFrame], None]]) -> list[str]:
    """Run post-merge handlers; failures are returned and never raised."""
    failures = []
    for handler in handlers:
        try:
            handler(rows)
        except Exception as error:
            failures.append(str(error))
    return failures


def conflict_summary(plan: MergePlan, table: str, n: int = 3) -> DataFrame:
    """The first ``n`` conflicts as ``table/key:field``, joined by a comma."""
    found = conflicts(plan)
    text = F.concat(F.lit(f"{table}/"), key_text(found, plan.keys), F.lit(":"), "field")
    order = [*plan.keys, "field"]
    top = found.select(F.struct(*order).alias("o"), text.alias("t")).orderBy("o").limit(n)
    entries = F.array_sort(F.collect_list(F.struct("o", "t")))
    return top.agg(F.array_join(F.transform(entries, lambda e: e["t"]), ", ").alias("summary"))


def _check(strategy: str) -> None:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
