"""Field update expressions; each returns the new value of a column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def set_path(df_column: str, path: str, value: Column) -> Column:
    """New value of a struct column with one nested field replaced."""
    return F.col(df_column).withField(path, value)


def increment(col: Column, by) -> Column:
    return F.coalesce(col, F.lit(0)) + F.lit(by)


def multiply(col: Column, by) -> Column:
    return F.coalesce(col, F.lit(0)) * F.lit(by)


def lower_to(col: Column, value) -> Column:
    return F.least(col, F.lit(value))


def raise_to(col: Column, value) -> Column:
    return F.greatest(col, F.lit(value))


def push(
    array: Column,
    values: list,
    at: int | None = None,
    order: str | None = None,
    keep: int | None = None,
) -> Column:
    """Append values; optionally at a position, re-sorted, and cut to ``keep``.

    A negative ``keep`` keeps the last elements.
    """
    base = F.coalesce(array, F.array().cast("array<string>") if not values else F.slice(_lits(values), 1, 0))
    extra = _lits(values)
    if at is None:
        out = F.concat(base, extra)
    else:
        rest = F.greatest(F.size(base) - at, F.lit(0))
        out = F.concat(F.slice(base, F.lit(1), F.lit(at)), extra, F.slice(base, F.lit(at + 1), rest))
    if order is not None:
        out = F.sort_array(out, asc=order == "asc")
    if keep is None:
        return out
    if keep >= 0:
        return F.slice(out, 1, keep)
    start = F.greatest(F.size(out) + keep, F.lit(0)) + 1
    return F.slice(out, start, F.lit(-keep))


def add_to_set(array: Column, values: list) -> Column:
    """Append the values that are not there yet; existing elements stay as they are."""
    present = F.coalesce(array, F.slice(_lits(values), 1, 0))
    new = F.filter(F.array_distinct(_lits(values)), lambda v: ~F.array_contains(present, v))
    return F.concat(present, new)


def pull(array: Column, test) -> Column:
    return F.filter(array, lambda e: ~F.coalesce(test(e), F.lit(False)))


def pull_all(array: Column, values: list) -> Column:
    return F.filter(array, lambda e: ~F.coalesce(e.isin(*values), F.lit(False)))


def pop(array: Column, first: bool = False) -> Column:
    n = F.greatest(F.size(array) - 1, F.lit(0))
    return F.slice(array, F.lit(2 if first else 1), n)


def bit_and(col: Column, bits: int) -> Column:
    return col.bitwiseAND(F.lit(bits))


def bit_or(col: Column, bits: int) -> Column:
    return col.bitwiseOR(F.lit(bits))


def bit_xor(col: Column, bits: int) -> Column:
    return col.bitwiseXOR(F.lit(bits))


def _lits(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])
