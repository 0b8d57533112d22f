"""Row changes as table transforms, with a log of before and after images.

A write returns the new table and the log rows ``seq, op, keys, before, after,
performed_by``; images are structs of the whole row. ``seq`` is the number the
caller gives the batch, so (seq, key) orders the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.canonical import comparable

INSERT, UPDATE, DELETE = "insert", "update", "delete"


def _image(df: DataFrame) -> Column:
    return F.struct(*df.columns)


def _log(rows: DataFrame, op: str, keys, seq: int, by: str | None, before, after) -> DataFrame:
    return rows.select(
        F.lit(seq).cast("long").alias("seq"),
        F.lit(op).alias("op"),
        *keys,
        before.alias("before"),
        after.alias("after"),
        F.lit(by).cast("string").alias("performed_by"),
    )


def insert(
    df: DataFrame, rows: DataFrame, keys: list[str], seq: int, by: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Append rows; an existing key raises."""
    clash = rows.join(df.select(*keys), keys, "left_semi").limit(1).collect()
    if clash:
        raise ValueError(f"key exists: {[clash[0][k] for k in keys]}")
    rows = rows.select(*df.columns)
    image = _image(rows)
    none = F.lit(None).cast(df.select(image.alias("i")).schema["i"].dataType)
    return df.unionByName(rows), _log(rows, INSERT, keys, seq, by, none, image)


def _picked(df: DataFrame, condition: Column, keys: list[str], one: bool) -> Column:
    matches = F.coalesce(condition, F.lit(False))
    if not one:
        return matches
    lowest = df.where(matches).agg(F.min(F.struct(*keys)).alias("k"))
    return matches & F.coalesce(F.struct(*keys) == lowest.scalar(), F.lit(False))


def assign(df: DataFrame, sets: dict[str, Column], condition: Column) -> DataFrame:
    """Set columns or nested fields (dotted path) where ``condition`` holds."""
    marked = df.withColumn("__hit", condition)
    by_top: dict[str, list[tuple[str, Column]]] = {}
    for path, value in sets.items():
        top, _, rest = path.partition(".")
        by_top.setdefault(top, []).append((rest, value))
    types = {f.name: f.dataType for f in df.schema.fields}
    columns = []
    for name in df.columns:
        new = F.col(name)
        for rest, value in by_top.pop(name, []):
            new = new.withField(rest, value) if rest else value.cast(types[name])
        columns.append(
            F.when(F.col("__hit"), new).otherwise(F.col(name)).alias(name)
            if name in {p.partition(".")[0] for p in sets}
            else F.col(name)
        )
    added = [
        F.when(F.col("__hit"), value).alias(name)
        for name, parts in by_top.items()
        for rest, value in parts
        if not rest
    ]
    return marked.select(*columns, *added)


def update(
    df: DataFrame,
    condition: Column,
    sets: dict[str, Column],
    keys: list[str],
    seq: int,
    by: str | None = None,
    one: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Update matching rows, or only the one with the lowest key."""
    hit = _picked(df, condition, keys, one)
    new = assign(df, sets, hit)
    before = df.where(hit).withColumn("__before", _image(df))
    after = assign(before.drop("__before"), sets, F.lit(True))
    changed = assign(before, sets, F.lit(True))
    image = F.struct(*[c for c in after.columns])
    return new, _log(changed, UPDATE, keys, seq, by, F.col("__before"), image)


def delete(
    df: DataFrame,
    condition: Column,
    keys: list[str],
    seq: int,
    by: str | None = None,
    one: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Delete matching rows, or only the one with the lowest key."""
    hit = _picked(df, condition, keys, one)
    gone = df.where(hit)
    image = _image(df)
    none = F.lit(None).cast(df.select(image.alias("i")).schema["i"].dataType)
    return df.where(~hit), _log(gone, DELETE, keys, seq, by, image, none)


def update_counts(df: DataFrame, condition: Column, sets: dict[str, Column]) -> DataFrame:
    """Rows matched, and rows an update would really modify."""
    types = {f.name: f.dataType for f in df.schema.fields}
    old = F.struct(*[comparable(F.col(c), types[c]).alias(c) for c in df.columns])
    matched = df.where(F.coalesce(condition, F.lit(False))).withColumn("__old", old)
    new = assign(matched, sets, F.lit(True))
    same = F.struct(*[comparable(F.col(c), types[c]).alias(c) for c in df.columns])
    return new.agg(
        F.count("*").alias("matched"),
        F.count_if(~F.col("__old").eqNullSafe(same)).alias("modified"),
    )


def upsert(
    df: DataFrame, rows: DataFrame, keys: list[str], on_insert: dict[str, Column] | None = None
) -> DataFrame:
    """Overlay the columns of ``rows``; ``on_insert`` fills new rows only."""
    set_columns = [c for c in rows.columns if c not in keys]
    new = rows.select(*keys, F.struct(F.lit(1).alias("__one"), *set_columns).alias("n"))
    old = df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias("o"))
    both = old.join(new, keys, "full_outer")
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in df.columns:
        if c in keys:
            out.append(F.col(c))
            continue
        kept = F.col("o")[c]
        if on_insert and c in on_insert:
            kept = F.when(F.col("o").isNull(), on_insert[c].cast(types[c])).otherwise(kept)
        if c in set_columns:
            kept = F.when(F.col("n").isNotNull(), F.col("n")[c]).otherwise(kept)
        out.append(kept.alias(c))
    return both.select(*out)


def last_op_per_key(ops: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last operation of each key; reduced on the map side."""
    rest = [c for c in ops.columns if c not in keys]
    last = ops.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return last.select(*keys, "r.*")


def apply_ops(df: DataFrame, ops: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Apply ordered whole-row operations in one join.

    ``ops`` has the keys, ``op``, ``row`` (struct of the whole new row) and the
    order column. A delete drops the key; everything else replaces or inserts,
    except that an update of a missing key does nothing.
    """
    images = ops.withColumn("__gone", F.col("op") == DELETE)
    known = F.col("op").isin(INSERT, "replace")
    last = images.groupBy(*keys).agg(
        F.max_by(F.struct("row", "__gone"), F.col(order)).alias("last"),
        F.max_by(F.struct(known.alias("made")), F.when(F.col("op") != UPDATE, F.col(order))).alias(
            "base"
        ),
    )
    old = df.select(*keys, F.struct(*df.columns).alias("old"))
    both = old.join(last, keys, "full_outer")
    dangling = F.col("old").isNull() & F.col("base.made").isNull()
    after_delete = F.col("base.made") == F.lit(False)
    gone = F.col("last").isNotNull() & (
        F.col("last.__gone") | dangling | F.coalesce(after_delete, F.lit(False))
    )
    row = F.when(F.col("last").isNull(), F.col("old")).otherwise(F.col("last.row"))
    return both.where(~F.coalesce(gone, F.lit(False))).select(row.alias("r")).select("r.*")


def replay(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The table a change log leads to: the last after-image of each key."""
    last = log.groupBy(*keys).agg(F.max_by("after", F.col(seq)).alias("r"))
    return last.where("r IS NOT NULL").select(*keys, "r.*")


def op_log(
    log: DataFrame, where: Column | None = None, limit: int | None = None, seq: str = "seq"
) -> DataFrame:
    """Log rows in order."""
    if where is not None:
        log = log.where(where)
    return log.orderBy(seq) if limit is None else log.orderBy(seq).limit(limit)


def op_summary(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Inserts, updates, deletes and total."""
    op = F.col("op")
    return log.groupBy(*(by or [])).agg(
        F.count_if(op == INSERT).alias("inserts"),
        F.count_if(op == UPDATE).alias("updates"),
        F.count_if(op == DELETE).alias("deletes"),
        F.count("*").alias("total"),
    )


def undo_last(
    df: DataFrame, log: DataFrame, n: int, keys: list[str], seq: str = "seq"
) -> tuple[DataFrame, DataFrame]:
    """Undo the last ``n`` operations: (table, remaining log).

    An operation is all log rows of one ``seq``, however many rows it touched. Per key
    the before-image of the oldest undone operation is restored; a NULL image means the
    row did not exist.
    """
    newest = log.select(seq).distinct().orderBy(F.desc(seq)).limit(n)
    first = newest.agg(F.min(seq)).scalar()
    undone = F.coalesce(F.col(seq) >= first, F.lit(False))
    recent = log.where(undone)
    images = recent.groupBy(*keys).agg(
        F.min_by(F.struct("before"), F.col(seq)).alias("image")
    )
    values = [c for c in df.columns if c not in keys]
    old = df.select(*keys, F.struct(*values).alias("old"))
    both = old.join(images, keys, "full_outer")
    restored = F.struct(*[F.col("image.before")[c].alias(c) for c in values])
    row = F.when(F.col("image").isNull(), F.col("old")).when(
        F.col("image.before").isNotNull(), restored
    )
    table = (
        both.select(*keys, row.alias("r")).where("r IS NOT NULL").select(*keys, "r.*")
    )
    return table.select(*df.columns), log.where(~undone)
