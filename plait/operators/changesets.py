"""Keyed change sets: tables, digests and blame from what has changed.

A change set has one row per changed key: ``op``, ``key`` (struct of the key columns),
``before`` and ``after`` (structs of the whole row, NULL where there is none). Several
change sets stacked on each other carry a number that orders them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.canonical import as_text, comparable, lane_sums, struct_text
from .changes import DELETE, INSERT, UPDATE
from .diff import diff_log, differs
from .keys import align, assert_unique_key, same_key


def with_op(images: DataFrame) -> DataFrame:
    """``op, key, before, after`` of images by key; what is no change is left out."""
    before, after = F.col("before"), F.col("after")
    types = {f.name: f.dataType for f in images.schema.fields}
    same = comparable(before, types["before"]).eqNullSafe(comparable(after, types["after"]))
    op = F.when(before.isNull(), INSERT).when(after.isNull(), DELETE).otherwise(UPDATE)
    return images.where(~same).select(op.alias("op"), "key", "before", "after")


def capture(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The change set that leads from ``old`` to ``new``, tables of the same columns."""
    rows, _ = align({"before": old, "after": new}, keys)

    def whole(side: str) -> Column:
        row = F.struct(*[F.col(c) if c in keys else F.col(side)[c].alias(c) for c in new.columns])
        return F.when(F.col(side).isNotNull(), row).alias(side)

    return with_op(rows.select(F.struct(*keys).alias("key"), whole("before"), whole("after")))


def from_log(log: DataFrame, keys: list[str]) -> DataFrame:
    """The log rows of one write as a change set."""
    return with_op(log.select(F.struct(*keys).alias("key"), "before", "after"))


def net(stacked: DataFrame, order: str = "ord") -> DataFrame:
    """One change per key over stacked change sets: from the first before to the last after."""
    return diff_log(stacked, ["key"], order).select("key", "before", "after")


def by_key(images: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return images.select(*[F.col("key")[k].alias(prefix + k) for k in keys], *[c for c in images.columns if c != "key"])


def fold(base: DataFrame, stacked: DataFrame, keys: list[str], order: str = "ord", many: bool = False) -> DataFrame:
    """``base`` after the stacked change sets: the last image of each key counts.

    The base is only filtered by the changed keys, so where these are few enough to be
    broadcast it is read once and not shuffled. With ``many`` of them nothing is broadcast.
    """
    last = stacked.groupBy("key").agg(F.max_by("after", order).alias("after"))
    known = by_key(last.select("key"), keys, "__c_")
    kept = base.join(known.hint("merge") if many else known, same_key(keys, "__c_"), "left_anti")
    return kept.unionByName(last.where("after IS NOT NULL").select("after.*").select(*base.columns))


def fold_where(
    base: DataFrame, stacked: DataFrame, keys: list[str], condition: Column, order: str = "ord", many: bool = False
) -> DataFrame:
    """The rows of :func:`fold` that meet a condition.

    All images are filtered first; a hit counts where no later image has its key. So whole
    images are neither grouped nor moved, only the keys of the change sets and the hits.
    """
    images = stacked.where("after IS NOT NULL").select("after.*", F.col(order).alias("__at"))
    images = images.where(condition).dropDuplicates([*keys, "__at"])
    hits = base.where(condition).withColumn("__at", F.lit(None).cast(images.schema["__at"].dataType)).unionByName(images)
    later = by_key(stacked.select("key", order), keys, "__c_")
    newer = F.col("__at").isNull() | (F.col(order) > F.col("__at"))
    kept = hits.join(later.hint("merge") if many else later, same_key(keys, "__c_") & newer, "left_anti")
    return kept.select(*base.columns)


def overlay(current: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """The change set that gives ``images`` (``key, after``, unique) to a table.

    Only the table's rows with these keys are looked up.
    """
    new = by_key(images.select("key", "after"), keys, "__c_")
    row = F.struct(*current.columns)
    found = current.join(new.drop("after"), same_key(keys, "__c_"), "left_semi")
    found = found.select(*keys, row.alias("before"))
    key = F.struct(*[F.col(f"__c_{k}").alias(k) for k in keys])
    both = new.join(found, same_key(keys, "__c_"), "left")
    return with_op(both.select(key.alias("key"), "before", "after"))


def inserted(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append as a change set; a key that is there already raises."""
    rows = rows.select(*current.columns)
    assert_unique_key(rows, keys)
    new = rows.select(*[F.col(k).alias(f"__c_{k}") for k in keys])
    clash = current.join(new, same_key(keys, "__c_"), "left_semi").limit(1).collect()
    if clash:
        raise ValueError(f"key exists: {[clash[0][k] for k in keys]}")
    none = F.lit(None).cast(rows.schema)
    return rows.select(
        F.lit(INSERT).alias("op"), F.struct(*keys).alias("key"), none.alias("before"), F.struct(*rows.columns).alias("after")
    )


def first_before(stacked: DataFrame, order: str = "ord") -> DataFrame:
    """``key, after``: the rows as they were before all the stacked change sets."""
    return stacked.groupBy("key").agg(F.min_by("before", order).alias("after"))


# --- digests -------------------------------------------------------------------------


def digest_change(changes: DataFrame) -> list[Column]:
    """Aggregates ``row_count, s0, s1, s2, s3`` by which a change set changes a digest's sums.

    They follow rows in a write that is observed, or as one row in ``agg``.
    """
    row = changes.schema["after"].dataType

    def hashed(side: str) -> Column:
        return F.sha2(struct_text(F.col(side), row), 256)

    count = F.count("after") - F.count("before")
    sums = []
    for i in range(4):
        new, old = lane_sums(hashed("after"))[i], lane_sums(hashed("before"))[i]
        sums.append((new - old).cast("decimal(38,0)").alias(f"s{i}"))
    return [count.alias("row_count"), *sums]


def changed_digest(sums: DataFrame, changes: DataFrame) -> DataFrame:
    """Digest sums after a change set, from the sums before it."""
    both = sums.unionByName(changes.agg(*digest_change(changes)))
    parts = [F.sum(f"s{i}").cast("decimal(38,0)").alias(f"s{i}") for i in range(4)]
    return both.agg(F.sum("row_count").alias("row_count"), *parts)


# --- blame ----------------------------------------------------------------------------


def blame(
    first: DataFrame, first_pos: Column, stacked: DataFrame, chain: DataFrame, keys: list[str], branch: str
) -> DataFrame:
    """Who set each field of each row: the last writers per (key, field).

    ``first`` holds the rows of the oldest version of the table along a first-parent
    chain and ``first_pos`` its position (0: the newest commit). ``stacked`` holds
    all changes since, with the ``pos`` of the commit that made them and ``ord`` within
    it. ``chain`` has ``pos, hash, branch, author, ts``. Result as of
    :func:`~plait.operators.history.blame`.

    Rows that no commit has changed are credited in one pass without a shuffle; only
    keys with changes are grouped, and each has at most one row per commit.
    """
    types = {f.name: f.dataType for f in first.schema.fields if f.name not in keys}
    row = F.struct(*first.columns)
    per_commit = diff_log(stacked, ["key", "pos"], "ord").select("key", "pos", "before", "after")
    touched = by_key(per_commit.select("key").distinct(), keys, "__c_")
    born = first.join(touched, same_key(keys, "__c_"), "left_semi").select(
        F.struct(*keys).alias("key"), first_pos.cast("long").alias("pos"),
        F.lit(None).cast(first.schema).alias("before"), row.alias("after"),
    )
    events = per_commit.withColumn("pos", F.col("pos").cast("long")).unionByName(born)

    # The oldest commit of the branch itself at or above each position.
    own = chain.select(F.col("pos").cast("long").alias("__p"), (F.col("branch") == branch).alias("__own"))
    upto = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumn("__own", F.max(F.when(F.col("__own"), F.col("__p"))).over(upto))

    made, gone = F.col("before").isNull(), F.col("after").isNull()
    newer = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("key")
    marked = events.withColumns({
        "__end": F.coalesce(F.max(F.when(gone, F.col("pos"))).over(newer) + 1, F.lit(0)),
        "__start": F.min(F.when(made, F.col("pos"))).over(whole),
    }).join(own, F.col("pos") == F.col("__p"))
    credit = F.when(made & (F.col("__own") >= F.col("__end")), F.col("__own"))
    marked = marked.withColumn(
        "__created", F.coalesce(F.max(credit).over(whole), F.max(F.when(made, F.col("pos"))).over(whole))
    )
    # The walk covers the newest stretch of commits that hold the row.
    marked = marked.where(~gone & (F.col("pos") <= F.col("__start")))
    for i, (n, t) in enumerate(types.items()):
        a, b = (comparable(F.col(side)[n], t) for side in ("before", "after"))
        marked = marked.withColumn(f"__c{i}", ~made & ~a.eqNullSafe(b) & F.col("after")[n].isNotNull())
    entries = []
    for i, (n, t) in enumerate(types.items()):
        value = F.col("after")[n]
        entry = [F.lit(n).alias("field"), as_text(value, t).alias("value")]
        entries.append(F.when(F.col(f"__c{i}"), F.struct(*entry, F.col("pos").alias("pos"))))
        never = made & ~F.max(f"__c{i}").over(whole) & value.isNotNull()
        marked = marked.withColumn(f"__n{i}", never)
        entries.append(F.when(F.col(f"__n{i}"), F.struct(*entry, F.col("__created").alias("pos"))))
    key_columns = [F.col("key")[k].alias(k) for k in keys]
    found = marked.select(*key_columns, F.inline(F.array_compact(F.array(*entries))))

    plain = first.join(touched, same_key(keys, "__c_"), "left_anti")
    there = F.array_compact(F.array(*[
        F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("field"), as_text(F.col(n), t).alias("value")))
        for n, t in types.items()
    ]))
    since = own.where(F.col("__p") == first_pos).select(F.coalesce("__own", "__p").alias("pos"))
    plain = plain.select(*keys, F.inline(there)).withColumn("pos", since.scalar())
    info = chain.select(F.col("pos").cast("long").alias("pos"), "hash", "author", "ts")
    return (
        found.unionByName(plain)
        .join(info, "pos")
        .select(*keys, "field", "value", F.col("pos").cast("int").alias("pos"), "hash", "author", "ts")
    )
