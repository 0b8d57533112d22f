"""Write rules, scopes, quotas, idempotent requests, merge queue, row checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, functions as F

from ..functions.text import glob_match

# --- rules that match branch names --------------------------------------------------


def match_rules(names: DataFrame, rules: DataFrame) -> DataFrame:
    """The first matching rule of each distinct name: ``name, rule`` (struct).

    ``rules`` has ``pattern`` and ``created_at`` (their order) and any columns.
    A glob can only match names that start with its text before the first
    ``*``, so names meet rules by an equi-join on that prefix. Names are cut at the
    prefix lengths that occur among the rules, so most rules met are near ones.
    """
    prefix = F.substring_index("pattern", "*", 1)
    lengths = rules.agg(F.array_sort(F.collect_set(F.length(prefix)))).scalar()
    keyed = rules.select(F.struct(*rules.columns).alias("rule"), prefix.alias("prefix"))
    starts = names.select("name").distinct().withColumn("lengths", lengths).select(
        "name",
        F.explode(
            F.transform(
                F.filter("lengths", lambda n: n <= F.length("name")),
                lambda n: F.substring(F.col("name"), F.lit(1), n),
            )
        ).alias("prefix"),
    )
    hits = starts.join(keyed, "prefix").where(glob_match(F.col("name"), F.col("rule.pattern")))
    order = F.struct("rule.created_at", "rule.pattern")
    return hits.groupBy("name").agg(F.min_by("rule", order).alias("rule"))


def check_write(requests: DataFrame, protections: DataFrame) -> DataFrame:
    """Add ``allowed`` and ``reason``: protected branches may take merges only.

    ``requests`` has ``branch`` and ``is_merge``; ``protections`` has ``pattern,
    merge_only, created_at``.
    """
    rules = match_rules(requests.select(F.col("branch").alias("name")), protections)
    joined = requests.join(rules.withColumnRenamed("name", "branch"), "branch", "left")
    blocked = F.coalesce(F.col("rule.merge_only") & ~F.col("is_merge"), F.lit(False))
    reason = F.concat(
        F.lit('Branch "'), "branch", F.lit('": rule "'),
        F.col("rule.pattern"), F.lit('" lets merges through only'),
    )
    return joined.select(
        *requests.columns, (~blocked).alias("allowed"), F.when(blocked, reason).alias("reason")
    )


# --- scopes and quotas ------------------------------------------------------------------


def _scope_reason() -> Column:
    agent, op, table = F.col("agent"), F.col("op"), F.col("table")
    lacks = F.concat(F.lit('Agent "'), agent, F.lit('" was not granted "'), op, F.lit('" rights'))
    denied = F.concat(
        F.lit('Table "'), table, F.lit('" is closed to agent "'), agent, F.lit('"')
    )
    unlisted = F.concat(
        F.lit('Table "'), table, F.lit('" is not among the tables of agent "'), agent, F.lit('"')
    )
    return (
        F.when(F.col("permissions").isNull(), F.lit(None).cast("string"))
        .when(~F.array_contains(F.col("permissions"), op), lacks)
        .when(F.coalesce(F.array_contains(F.col("denied"), table), F.lit(False)), denied)
        .when(F.col("allowed_tables").isNotNull() & ~F.array_contains(F.col("allowed_tables"), table), unlisted)
    )


def check_permission(requests: DataFrame, scopes: DataFrame) -> DataFrame:
    """Add ``allowed`` and ``reason`` to requests ``agent, table, op``.

    ``scopes`` has one row per agent: ``agent, permissions, allowed_tables,
    denied``; an agent without one is unrestricted.
    """
    own = scopes.select("agent", "permissions", "allowed_tables", "denied")
    joined = requests.join(own, "agent", "left").withColumn("reason", _scope_reason())
    return joined.select(*requests.columns, F.col("reason").isNull().alias("allowed"), "reason")


def check_quota(counts: DataFrame, scopes: DataFrame) -> DataFrame:
    """Whether an agent ``agent, branches`` may create another branch; 0 or NULL is unlimited."""
    joined = counts.join(scopes.select("agent", "max_branches"), "agent", "left")
    limit = F.col("max_branches")
    full = F.coalesce((limit > 0) & (F.col("branches") >= limit), F.lit(False))
    reason = F.concat(
        F.lit('Agent "'), "agent", F.lit('" already owns its share of branches ('),
        limit.cast("string"), F.lit(")"),
    )
    return joined.select(
        *counts.columns, (~full).alias("allowed"), F.when(full, reason).alias("reason")
    )


def violations(checked: DataFrame, at: Column) -> DataFrame:
    """Rejected requests as log rows."""
    return checked.where(~F.col("allowed")).drop("allowed").withColumn("at", at)


def newest_violations(log: DataFrame, agent: str, limit: int | None = None) -> DataFrame:
    ordered = log.where(F.col("agent") == agent).orderBy(F.desc("at"), F.desc("id"))
    return ordered if limit is None else ordered.limit(limit)


def write_gate(
    requests: DataFrame, read_only: DataFrame, protections: DataFrame, scopes: DataFrame
) -> DataFrame:
    """Decide each write request ``id, agent, branch, table, op``.

    Order: read-only branch, protection, scope. ``gate`` names the one that
    rejected; scope rejections are what :func:`violations` logs.
    """
    flags = read_only.select("branch").distinct().withColumn("__ro", F.lit(True))
    ruled = check_write(requests.withColumn("is_merge", F.lit(False)), protections)
    ruled = ruled.withColumnRenamed("reason", "__protected").drop("allowed", "is_merge")
    scoped = check_permission(ruled, scopes).withColumnRenamed("reason", "__scope")
    joined = scoped.drop("allowed").join(flags, "branch", "left")
    ro = F.when(
        F.col("__ro"), F.concat(F.lit('Branch "'), "branch", F.lit('" is read-only'))
    )
    reason = F.coalesce(ro, "__protected", F.when(F.col("agent").isNotNull(), F.col("__scope")))
    gate = (
        F.when(ro.isNotNull(), "read_only")
        .when(F.col("__protected").isNotNull(), "protection")
        .when(F.col("agent").isNotNull() & F.col("__scope").isNotNull(), "scope")
    )
    return joined.select(
        *requests.columns, reason.isNull().alias("allowed"), gate.alias("gate"), reason.alias("reason")
    )


# --- idempotent requests ------------------------------------------------------------------


def first_per_request(
    requests: DataFrame, receipts: DataFrame | None = None, order: tuple[str, ...] = ("at",)
) -> DataFrame:
    """The earliest request per id that no completed receipt covers.

    Failed executions leave no receipt, so they may be retried. Requests are
    reduced on the map side, an id repeated very often costs one row per task.
    """
    rest = [c for c in requests.columns if c != "request_id"]
    first = requests.groupBy("request_id").agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("r")
    )
    fresh = first.select("request_id", "r.*").select(*requests.columns)
    if receipts is None:
        return fresh
    done = receipts.where("result IS NOT NULL").select("request_id")
    return fresh.join(done, "request_id", "left_anti")


def args_hash(args: Column) -> Column:
    """SHA-256 of request arguments given as a JSON text."""
    return F.sha2(args, 256)


def purge_receipts(receipts: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Receipts not older than ``hours``."""
    return receipts.where(F.col("executed_at") >= now - F.expr(f"INTERVAL {int(hours)} HOURS"))


def has_receipt(ids: DataFrame, receipts: DataFrame) -> DataFrame:
    """Requests that were executed to the end."""
    return ids.join(receipts.where("result IS NOT NULL").select("request_id"), "request_id", "left_semi")


# --- merge queue ------------------------------------------------------------------------------

# States that block queueing the same branch again.
WAITING = ["pending", "processing"]


def queue_list(queue: DataFrame, status: str | None = None) -> DataFrame:
    """Queue entries, oldest first."""
    if status is not None:
        queue = queue.where(F.col("status") == status)
    return queue.orderBy("queued_at", "id")


def queue_length(queue: DataFrame) -> DataFrame:
    return queue.where("status = 'pending'").agg(F.count("*").alias("pending"))


def next_in_queue(queue: DataFrame) -> DataFrame:
    return queue_list(queue, "pending").limit(1)


def already_queued(queue: DataFrame) -> DataFrame:
    """Branches that may not be queued again."""
    return queue.where(F.col("status").isin(*WAITING)).select("branch").distinct()


def merge_batch(queue: DataFrame, merge: Callable[[Row], object]) -> list[Row]:
    """Run pending requests one at a time, oldest first.

    Each merge is a Spark job of its own; a failing one is recorded with its
    error and does not stop the rest.
    """
    results = []
    for entry in queue_list(queue, "pending").toLocalIterator():
        try:
            merge(entry)
            results.append(Row(id=entry["id"], status="completed", error=None))
        except Exception as error:
            results.append(Row(id=entry["id"], status="failed", error=str(error)))
    return results


# --- row checks ----------------------------------------------------------------------------------

Rule = tuple[str, str, object]


def _fails(column: str, kind: str, value) -> Column:
    c = F.col(column)
    if kind == "required":
        return c.isNull()
    if kind == "type":
        return c.isNotNull() & c.try_cast(value).isNull()
    if kind == "min_length":
        return F.length(c) < value
    if kind == "max_length":
        return F.length(c) > value
    if kind == "enum":
        return ~c.isin(*value)
    if kind == "minimum":
        return c < value
    if kind == "maximum":
        return c > value
    if kind == "pattern":
        return ~c.rlike(value)
    if kind == "items":
        return F.exists(c, lambda e: e.try_cast(value).isNull())
    raise ValueError(f"unknown rule {kind!r}")


def failed_rules(rules: list[Rule]) -> Column:
    """Names ``column:kind`` of the rules a row breaks; a missing value breaks only ``required``."""
    tests = [
        F.when(F.coalesce(_fails(c, k, v), F.lit(False)), F.lit(f"{c}:{k}")) for c, k, v in rules
    ]
    return F.array_compact(F.array(*tests))


def validate_rows(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``failed``, the list of broken rules."""
    return df.withColumn("failed", failed_rules(rules))


def split_valid(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Warn mode: (valid rows, rejected rows with ``failed``)."""
    checked = validate_rows(df, rules)
    ok = F.size("failed") == 0
    return checked.where(ok).drop("failed"), checked.where(~ok)


def require_valid(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Error mode: computing the result raises when any row breaks a rule."""
    names = F.array_join(failed_rules(rules), ", ")
    message = F.concat(F.lit("row breaks "), names)
    guard = F.when(names == "", F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return df.where(guard)
