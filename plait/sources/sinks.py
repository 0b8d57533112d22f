"""Upsert, replace and text export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.keys import row_struct, value_types

WHEN_MATCHED = ("replace", "keep_existing", "merge", "fail")
WHEN_NOT_MATCHED = ("insert", "discard", "fail")


def merge_into(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    when_matched: str = "replace",
    when_not_matched: str = "insert",
) -> DataFrame:
    """The target after upserting ``source``; one shuffle per side on the key.

    ``merge`` overlays the fields the source has a value for. ``fail`` raises
    while the result is computed, so nothing of it gets published.
    """
    if when_matched not in WHEN_MATCHED or when_not_matched not in WHEN_NOT_MATCHED:
        raise ValueError("unknown merge mode")
    types = value_types([target, source], keys)
    t = target.select(*keys, row_struct(target, types).alias("t"))
    s = source.select(*keys, row_struct(source, types).alias("s"))
    how = "left" if when_not_matched == "discard" else "full_outer"
    both = t.join(s, keys, how)
    old, new = F.col("t"), F.col("s")
    if when_matched == "replace":
        matched = new
    elif when_matched == "keep_existing":
        matched = old
    elif when_matched == "merge":
        matched = F.struct(*[F.coalesce(new[n], old[n]).alias(n) for n in types])
    else:
        matched = F.raise_error(F.lit("row exists in the target")).cast(_struct_type(types))
    inserted = new
    if when_not_matched == "fail":
        inserted = F.raise_error(F.lit("row is missing in the target")).cast(_struct_type(types))
    row = (
        F.when(new.isNull(), old).when(old.isNull(), inserted).otherwise(matched)
    )
    return both.select(*keys, row.alias("r")).select(*keys, "r.*")


def _struct_type(types: dict) -> str:
    return "struct<" + ",".join(f"`{n}`:{t.simpleString()}" for n, t in types.items()) + ">"


def replace_table(df: DataFrame, path: str) -> None:
    """Write a whole table, replacing what the folder holds."""
    df.write.mode("overwrite").parquet(path)


def copy_table(df: DataFrame, path: str) -> None:
    """Export a full copy of a table to a new folder."""
    df.write.mode("error").parquet(path)


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _quoted(text: Column) -> Column:
    inner = F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit('""'))
    return F.concat(F.lit('"'), inner, F.lit('"'))


# Fixed value: column order of exported event logs.
EVENT_COLUMNS = ["timestamp", "branchName", "event", "summary"]


def event_csv(events: DataFrame) -> DataFrame:
    """Event rows as CSV lines; only the summary is quoted."""
    line = F.concat_ws(
        ",", _iso(F.col("timestamp")), "branchName", "event", _quoted(F.col("summary"))
    )
    return events.select("timestamp", line.alias("line"))


def event_json(events: DataFrame) -> DataFrame:
    """Event rows as JSON documents, one per row."""
    doc = F.struct(
        _iso(F.col("timestamp")).alias("timestamp"), *EVENT_COLUMNS[1:]
    )
    return events.select("timestamp", F.to_json(doc, {"ignoreNullFields": "false"}).alias("line"))


def write_lines(lines: DataFrame, path: str, header: str | None = None) -> None:
    """Write ordered text lines; the range sort keeps file order equal to line order."""
    out = lines.orderBy("timestamp", "line").select(F.col("line").alias("value"))
    if header is not None:
        spark = lines.sparkSession
        spark.createDataFrame([(header,)], "value string").coalesce(1).write.text(f"{path}/header")
        out.write.text(f"{path}/rows")
    else:
        out.write.text(path)
