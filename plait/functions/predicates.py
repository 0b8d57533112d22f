"""Row conditions with document semantics: a missing value is just unequal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def not_equal(col: Column, value) -> Column:
    """True also where the field is missing."""
    return ~col.eqNullSafe(F.lit(value))


def not_in(col: Column, values: list) -> Column:
    """True also where the field is missing."""
    return col.isNull() | ~col.isin(*values)


def holds(condition: Column) -> Column:
    """Two-valued truth: unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, map(holds, conditions), F.lit(True))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, map(holds, conditions), F.lit(False))


def none_of(*conditions: Column) -> Column:
    return ~any_of(*conditions)


def negate(condition: Column) -> Column:
    return ~holds(condition)


def json_has(doc: Column, field: str) -> Column:
    """Whether a JSON document has a top-level key, even with a null value."""
    keys = F.json_object_keys(doc)
    return holds(F.array_contains(keys, field))


def json_type(doc: Column, field: str) -> Column:
    """Type name of a top-level JSON value; NULL when the key is absent."""
    kind = F.schema_of_variant(F.variant_get(F.parse_json(doc), f"$.{field}", "variant"))
    return kind_name(kind)


def kind_name(kind: Column) -> Column:
    """Variant type name to document type name."""
    return (
        F.when(kind.isNull(), F.lit(None).cast("string"))
        .when(kind == "VOID", "null")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("TIMESTAMP") | (kind == "DATE"), "date")
        .otherwise("number")
    )


def remainder_is(col: Column, divisor: int, remainder: int) -> Column:
    return holds(col % divisor == remainder)


def contains_all(array: Column, values: list) -> Column:
    return all_of(*[F.array_contains(array, v) for v in values])


def any_element(array: Column, test) -> Column:
    return holds(F.exists(array, test))


def has_size(array: Column, n: int) -> Column:
    return holds(F.size(array) == n)


def order_of(a: Column, b: Column) -> Column:
    """-1, 0 or 1; NULL sorts first."""
    return (
        F.when(a.eqNullSafe(b), 0)
        .when(a.isNull(), -1)
        .when(b.isNull(), 1)
        .when(a < b, -1)
        .otherwise(1)
    )
