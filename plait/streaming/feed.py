"""Change feed of a branch: events, handlers, deduplication, applying changes.

A change log is a folder of files with ``seq, branch, table, op, key, before,
after, ts``; images are JSON texts. The stream's checkpoint is the resume token.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.changes import DELETE, INSERT, last_op_per_key, replay

CHANGELOG = (
    "seq bigint, branch string, table string, op string, key string, "
    "before string, after string, ts timestamp"
)

Handler = Callable[[DataFrame], None]


def read_changes(
    spark: SparkSession,
    folder: str,
    schema: StructType | str = CHANGELOG,
    files: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Stream of a parquet folder; ``files`` is a glob on file names."""
    reader = spark.readStream.schema(schema)
    if files is not None:
        reader = reader.option("pathGlobFilter", files)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _fields(image: str) -> Column:
    return F.coalesce(
        F.from_json(image, "map<string,string>"), F.create_map().cast("map<string,string>")
    )


def _updated(old: Column, new: Column) -> Column:
    return F.map_filter(
        new,
        lambda k, v: ~F.map_contains_key(old, k) | ~F.element_at(old, k).eqNullSafe(v),
    )


def _removed(old: Column, new: Column) -> Column:
    return F.array_sort(F.array_except(F.map_keys(old), F.map_keys(new)))


def updated_fields(before: str = "before", after: str = "after") -> Column:
    """Fields whose value is new or changed, as a map of texts."""
    return _updated(_fields(before), _fields(after))


def removed_fields(before: str = "before", after: str = "after") -> Column:
    """Fields that are gone, sorted."""
    return _removed(_fields(before), _fields(after))


def change_feed(
    changes: DataFrame, branch: str | None = None, before_image: bool = False
) -> DataFrame:
    """Change events of a branch; works on a stream and on a batch alike."""
    if branch is not None:
        changes = changes.where(F.col("branch") == branch)
    changed = (F.col("op") == "update") | (F.col("op") == "replace")
    both = changed & F.col("before").isNotNull()
    old, new = F.col("__old"), F.col("__new")
    # Columns of their own, parsed once a row: a lambda parses its images for every field.
    changes = changes.withColumns({"__old": F.when(both, _fields("before")), "__new": F.when(both, _fields("after"))})
    columns = [
        "seq",
        F.col("op").alias("type"),
        "branch",
        "table",
        "key",
        F.when(F.col("op") != DELETE, F.col("after")).alias("document"),
        F.when(both, _updated(old, new)).alias("updated"),
        F.when(both, _removed(old, new)).alias("removed"),
        "ts",
    ]
    if before_image:
        columns.append(F.col("before").alias("document_before"))
    return changes.select(*columns)


def run_feed(
    feed: DataFrame, handlers: dict[str, Handler], checkpoint: str
) -> list[tuple[int, str, str]]:
    """Hand every new batch to all handlers, then stop when none is left.

    A failing handler stops neither the feed nor the other handlers; failures
    come back as (batch, handler, error). Calling again with the same
    ``checkpoint`` goes on after the last batch.
    """
    failures: list[tuple[int, str, str]] = []

    def each(batch: DataFrame, number: int) -> None:
        for name, handler in handlers.items():
            try:
                handler(batch)
            except Exception as error:
                failures.append((number, name, str(error)))

    _drain(feed.writeStream.foreachBatch(each), checkpoint)
    return failures


def run_handlers(feed: DataFrame, handlers: dict[str, Handler], checkpoint: str, failures: str) -> DataFrame:
    """:func:`run_feed` with a table of failures: ``batch, handler, error``.

    The table at ``failures`` outlives the run and holds the failures of all runs; a
    batch that is repeated after a crash may be in it twice.
    """
    spark = feed.sparkSession
    schema = "batch bigint, handler string, error string"
    spark.createDataFrame([], schema).write.mode("append").parquet(failures)

    def each(batch: DataFrame, number: int) -> None:
        found = []
        for name, handler in handlers.items():
            try:
                handler(batch)
            except Exception as error:
                found.append((number, name, f"{type(error).__name__}: {error}"))
        if found:
            spark.createDataFrame(found, schema).coalesce(1).write.mode("append").parquet(failures)

    _drain(feed.writeStream.foreachBatch(each), checkpoint)
    return spark.read.schema(schema).parquet(failures)


def resume_token(events: DataFrame) -> str | None:
    """An opaque text for the position after the given events; None if there are none."""
    last = events.agg(F.max("seq")).first()[0]
    return None if last is None else f"seq:{last}"


def position_of(token: str | None) -> int | None:
    """The position a token stands for; None is the start."""
    if token is None:
        return None
    kind, _, number = token.partition(":")
    if kind != "seq" or not number.isdigit():
        raise ValueError(f"no resume token: {token!r}")
    return int(number)


def feed_after(changes: DataFrame, token: str | None, branch: str | None = None) -> DataFrame:
    """Feed events that follow a token's position, none of those before it."""
    at = position_of(token)
    return change_feed(changes if at is None else changes.where(F.col("seq") > at), branch)


def feed_until(changes: DataFrame, token: str | None, branch: str | None = None) -> DataFrame:
    """Feed events up to a token's position."""
    at = position_of(token)
    return change_feed(changes.where(F.lit(False) if at is None else F.col("seq") <= at), branch)


def _drain(writer, checkpoint: str) -> StreamingQuery:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def save_feed(feed: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append new feed rows to a parquet folder exactly once and read it."""
    _drain(feed.writeStream.format("parquet").option("path", path), checkpoint)
    return feed.sparkSession.read.schema(feed.schema).parquet(path)


def events_since(saved: DataFrame, since: Column) -> DataFrame:
    """Saved events after a point in time, in order."""
    return saved.where(F.col("ts") > since).orderBy("seq")


def changed_since(changes: DataFrame, branch: str, seq: int) -> bool:
    """Whether a branch has any change after a position."""
    return not changes.where((F.col("branch") == branch) & (F.col("seq") > seq)).isEmpty()


def once_per_request(
    requests: DataFrame, ts: str = "ts", keep: str = "24 hours"
) -> DataFrame:
    """First delivery of each ``request_id``; ids are forgotten after ``keep``."""
    stamped = requests.withColumn(ts, F.col(ts).cast("timestamp"))
    return stamped.withWatermark(ts, keep).dropDuplicatesWithinWatermark(["request_id"])


def apply_feed(
    changes: DataFrame, keys: list[str], path: str, checkpoint: str, seq: str = "seq"
) -> None:
    """Reduce each batch to the last image per key and store it.

    A batch writes one change set of its own size; the table is never rewritten
    here. A repeated batch replaces its own folder, so retries are harmless.
    """

    def each(batch: DataFrame, number: int) -> None:
        last = last_op_per_key(batch, keys, seq)
        last.write.mode("overwrite").parquet(f"{path}/epoch={number}")

    _drain(changes.writeStream.foreachBatch(each), checkpoint)


def current_table(spark: SparkSession, base: DataFrame | None, path: str, keys: list[str], seq: str = "seq") -> DataFrame:
    """The table after all stored change sets: their last image per key over ``base``."""
    sets = spark.read.parquet(path).drop("epoch")
    if base is None:
        return replay(sets, keys, seq)
    last = sets.groupBy(*keys).agg(F.max_by(F.struct("after"), F.col(seq)).alias("n"))
    values = [c for c in base.columns if c not in keys]
    old = base.select(*keys, F.struct(*values).alias("o"))
    row = F.when(F.col("n").isNull(), F.col("o")).otherwise(F.col("n.after"))
    both = old.join(last, keys, "full_outer")
    return both.select(*keys, row.alias("r")).where("r IS NOT NULL").select(*keys, "r.*")


def write_change(batch_number: int, log: DataFrame, folder: str) -> None:
    """Publish the log rows of one write as a folder the feed picks up."""
    log.write.mode("error").parquet(f"{folder}/batch={batch_number}")


__all__ = [
    "CHANGELOG", "DELETE", "INSERT", "apply_feed", "change_feed", "changed_since",
    "current_table", "events_since", "feed_after", "feed_until", "once_per_request", "position_of",
    "read_changes", "removed_fields", "resume_token", "run_feed", "run_handlers", "save_feed",
    "updated_fields", "write_change",
]
