"""Time travel, blame, cherry-pick and revert, and history tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.canonical import as_text, comparable
from ..functions.ordered import as_of_join
from . import changes
from .diff import ADDED, MODIFIED, REMOVED, differs
from .keys import align

# How long each kind of record is kept.
RETENTION = {
    "changelog": "30 days",
    "reflog": "90 days",
    "violations": "30 days",
    "receipts": "24 hours",
}


# --- time travel -------------------------------------------------------------------


def resolve_as_of(commits: DataFrame, probes: DataFrame) -> DataFrame:
    """Latest commit per probe ``branch, at`` made on that branch up to that time."""
    own = commits.select("branch", "hash", "ts")
    return as_of_join(probes, own, ["branch"], "at", "ts", "hash")


def resolve(commits: DataFrame, branch: str, at: str) -> DataFrame:
    """The commit with hash ``at`` on any branch, else the latest one up to time ``at``."""
    by_hash = commits.where(F.col("hash") == at).withColumn("__o", F.lit(1))
    stamp = F.try_to_timestamp(F.lit(at))
    by_time = (
        commits.where((F.col("branch") == branch) & (F.col("ts").cast("timestamp") <= stamp))
        .orderBy(F.desc("ts"), F.desc("hash"))
        .limit(1)
        .withColumn("__o", F.lit(2))
    )
    return by_hash.unionByName(by_time).orderBy("__o").limit(1).drop("__o")


def table_at(log: DataFrame, keys: list[str], at: Column, ts: str = "ts") -> DataFrame:
    """A table as of a time, folded from its change log."""
    return changes.replay(log.where(F.col(ts) <= at), keys)


def tables_at(commits: DataFrame) -> DataFrame:
    """``hash, table`` for every non-empty table of each commit's snapshot."""
    entries = commits.select("hash", F.explode("snapshot").alias("table", "info"))
    return entries.where("info.row_count > 0").select("hash", "table").orderBy("hash", "table")


# --- cherry-pick and revert ----------------------------------------------------------


def _delta(target, before, after, keys):
    rows, types = align({"target": target, "before": before, "after": after}, keys)
    old, new = F.col("before"), F.col("after")
    change = (
        F.when(old.isNull() & new.isNotNull(), ADDED)
        .when(old.isNotNull() & new.isNull(), REMOVED)
        .when(old.isNotNull() & new.isNotNull() & differs(old, new, types), MODIFIED)
    )
    return rows.withColumn("change", change), types


def cherry_pick(target: DataFrame, parent: DataFrame, commit: DataFrame, keys: list[str]) -> DataFrame:
    """Apply what ``commit`` changed against ``parent`` to ``target``.

    Changed rows are taken over whole, without conflict checks; one shuffle.
    """
    rows, types = _delta(target, parent, commit, keys)
    row = F.when(F.col("change").isin(ADDED, MODIFIED), F.col("after")).when(
        F.col("change").isNull(), F.col("target")
    )
    kept = rows.select(*keys, row.alias("r")).where("r IS NOT NULL")
    return kept.select(*keys, *[F.col("r")[n].alias(n) for n in types])


def cherry_pick_counts(parent: DataFrame, commit: DataFrame, keys: list[str]) -> DataFrame:
    rows, _ = _delta(commit, parent, commit, keys)
    change = F.col("change")
    return rows.agg(
        F.count_if(change == ADDED).alias("rows_added"),
        F.count_if(change == REMOVED).alias("rows_removed"),
        F.count_if(change == MODIFIED).alias("rows_modified"),
    )


def revert(target: DataFrame, parent: DataFrame, commit: DataFrame, keys: list[str]) -> DataFrame:
    """Undo what ``commit`` changed against ``parent`` on ``target``."""
    return cherry_pick(target, commit, parent, keys)


def cherry_pick_message(message: str, commit_hash: str) -> str:
    return f"Cherry-pick: {message} (from {commit_hash[:8]})"


def revert_message(message: str, commit_hash: str) -> str:
    return f"Revert: {message} (reverting {commit_hash[:8]})"


# --- blame ---------------------------------------------------------------------------


def blame(
    versions: DataFrame,
    chain: DataFrame,
    keys: list[str],
    branch: str,
    spans: list[tuple[int, int, int | None]] | None = None,
) -> DataFrame:
    """Who set each field of each row, for all keys at once.

    ``versions`` holds the rows of the table along a first-parent chain with the
    commit's ``pos`` (0 = newest); ``chain`` has ``pos, hash, branch, author, ts``
    for all of the chain, commits without the table included. Result: keys,
    ``field, value, pos, hash, author, ts``, newest first by ``pos``.

    Successive commits that share one snapshot of the table need only one
    version: ``spans`` lists (newest, oldest, oldest on ``branch`` or None)
    positions per version, ``pos`` being the newest. Without it every position
    found in ``versions`` stands for itself.

    A key has at most one row per version, so its window is as long as the chain.
    """
    fields = {
        f.name: f.dataType for f in versions.schema.fields if f.name not in (*keys, "pos")
    }
    # Versions of the table, numbered without gaps.
    if spans is None:
        held = chain.join(versions.select("pos").distinct(), "pos", "left_semi")
        held = held.select(
            "pos",
            F.col("pos").alias("__oldest"),
            F.when(F.col("branch") == branch, F.col("pos")).alias("__own"),
        )
    else:
        held = versions.sparkSession.createDataFrame(
            spans, "pos int, __oldest int, __own int"
        )
    order = Window.partitionBy(F.lit(0)).orderBy("pos")
    numbered = held.select(
        "pos",
        F.row_number().over(order).alias("__t"),
        (F.lead("pos").over(order) - 1).alias("__credit"),
        "__oldest",
        "__own",
    )
    rows = versions.join(numbered, "pos")
    by_key = Window.partitionBy(*keys)
    newest_first = by_key.orderBy("__t")
    marked = rows.withColumn("__rn", F.row_number().over(newest_first)).withColumn(
        "__t0", F.first("__t").over(newest_first)
    )
    # The walk covers commits from the first one with the row to the first gap.
    run = F.col("__t") - F.col("__rn") == F.col("__t0") - 1
    marked = marked.withColumn("__run", run)
    older = F.lead(F.struct(F.col("__run").alias("run"), *fields)).over(newest_first)
    marked = marked.withColumn("__older", older)
    visited = F.col("__run") & F.coalesce(F.col("__older.run"), F.lit(False))
    last = F.col("__run") & ~F.coalesce(F.col("__older.run"), F.lit(False))

    flags = {
        n: visited
        & ~comparable(F.col(n), t).eqNullSafe(comparable(F.col("__older")[n], t))
        & F.col(n).isNotNull()
        for n, t in fields.items()
    }
    for i, flag in enumerate(flags.values()):
        marked = marked.withColumn(f"__c{i}", flag)
    created = F.coalesce(F.max("__own").over(by_key), F.max("__oldest").over(by_key))
    marked = marked.withColumn("__created", created).withColumn("__last", last)
    for i in range(len(fields)):
        marked = marked.withColumn(f"__any{i}", F.max(f"__c{i}").over(by_key))
    entries = []
    for i, (n, t) in enumerate(fields.items()):
        value = as_text(F.col(n), t).alias("value")
        name = F.lit(n).alias("field")
        entries.append(
            F.when(F.col(f"__c{i}"), F.struct(name, value, F.col("__credit").cast("int").alias("pos")))
        )
        entries.append(
            F.when(
                F.col("__last") & ~F.col(f"__any{i}") & F.col(n).isNotNull(),
                F.struct(name, value, F.col("__created").cast("int").alias("pos")),
            )
        )
    found = marked.select(*keys, F.inline(F.array_compact(F.array(*entries))))
    info = chain.select(F.col("pos").cast("int").alias("pos"), "hash", "author", "ts")
    return found.join(info, "pos").select(*keys, "field", "value", "pos", "hash", "author", "ts")


def stack_versions(versions: list[tuple[int, DataFrame]]) -> DataFrame:
    """One table of all versions with their chain position."""
    parts = [df.withColumn("pos", F.lit(pos)) for pos, df in versions]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# --- history, reflog, retention -------------------------------------------------------


def history_rows(
    history: DataFrame,
    branch: str | None = None,
    event: str | None = None,
    since: str | None = None,
    until: str | None = None,
) -> DataFrame:
    """Event rows by branch, event and inclusive time range."""
    ts = history.schema["timestamp"].dataType
    if branch is not None:
        history = history.where(F.col("branchName") == branch)
    if event is not None:
        history = history.where(F.col("event") == event)
    if since is not None:
        history = history.where(F.col("timestamp") >= F.lit(since).cast(ts))
    if until is not None:
        history = history.where(F.col("timestamp") <= F.lit(until).cast(ts))
    return history


def branch_history(history: DataFrame, branch: str) -> DataFrame:
    return history_rows(history, branch).orderBy("timestamp")


def all_history(history: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first."""
    ordered = history.orderBy(F.desc("timestamp"), F.desc("branchName"))
    return ordered if limit is None else ordered.limit(limit)


def reflog_entries(
    reflog: DataFrame, branch: str | None = None, action: str | None = None, limit: int | None = None
) -> DataFrame:
    """Reference moves, newest first."""
    if branch is not None:
        reflog = reflog.where(F.col("branch") == branch)
    if action is not None:
        reflog = reflog.where(F.col("action") == action)
    ordered = reflog.orderBy(F.desc("ts"), F.desc("id"))
    return ordered if limit is None else ordered.limit(limit)


def ever_existed(names: DataFrame, reflog: DataFrame) -> DataFrame:
    """Names the reflog saw created, even if the branch is long gone."""
    created = reflog.where("action = 'create'").select(F.col("branch").alias("name"))
    return names.join(created, "name", "left_semi")


def last_state(reflog: DataFrame) -> DataFrame:
    """The latest reflog row per branch."""
    rest = [c for c in reflog.columns if c != "branch"]
    top = reflog.groupBy("branch").agg(F.max_by(F.struct(*rest), F.struct("ts", "id")).alias("r"))
    return top.select("branch", "r.*")


def retained(df: DataFrame, ts: str, now: Column, keep: str) -> DataFrame:
    """Rows not older than ``keep`` (such as ``30 days``) at ``now``."""
    return df.where(F.col(ts) >= now - F.expr(f"INTERVAL {keep}"))


def expired(df: DataFrame, expires: str, now: Column) -> DataFrame:
    """Rows whose expiry has passed; no expiry means never."""
    return df.where(F.col(expires) <= now)


def extend_expiry(
    branches: DataFrame, names: Column, now: Column, minutes: int
) -> DataFrame:
    """Set the expiry of the chosen branches to ``minutes`` from ``now``."""
    until = now + F.expr(f"INTERVAL {int(minutes)} MINUTES")
    return branches.withColumn(
        "expires_at",
        F.when(names, until).otherwise(F.col("expires_at")).cast(branches.schema["expires_at"].dataType),
    )


def clear_expiry(branches: DataFrame, names: Column) -> DataFrame:
    return branches.withColumn("expires_at", F.when(~names, F.col("expires_at")))


def materialized_status(branches: DataFrame) -> DataFrame:
    """Per lazy branch the tables it owns and those still read from its parent."""
    return branches.select(
        "name",
        "materialized",
        F.array_sort(F.array_except("tables", "materialized")).alias("pending"),
    )


# --- drift and deploy requests ----------------------------------------------------------


def last_change(changelog: DataFrame) -> DataFrame:
    """``branch, last_seq``; reduced on the map side."""
    return changelog.groupBy("branch").agg(F.max("seq").alias("last_seq"))


def drift(baselines: DataFrame, changelog: DataFrame) -> DataFrame:
    """Status of each baseline ``id, branch, seq``: any later change counts, even a net-zero one."""
    joined = baselines.join(last_change(changelog), "branch", "left")
    drifted = F.coalesce(F.col("last_seq") > F.col("seq"), F.lit(False))
    moved = F.concat(F.lit('Branch "'), "branch", F.lit('" changed since baseline "'), "id", F.lit('".'))
    still = F.concat(
        F.lit('No changes detected on "'), "branch", F.lit('" since baseline "'), "id", F.lit('".')
    )
    return joined.select(
        "id",
        "branch",
        F.when(drifted, "drifted").otherwise("clean").alias("status"),
        F.when(drifted, moved).otherwise(still).alias("reason"),
    )


def latest_baselines(baselines: DataFrame) -> DataFrame:
    """The newest baseline of each branch."""
    top = baselines.groupBy("branch").agg(
        F.max_by(F.struct("id", "seq", "captured_at"), F.struct("captured_at", "id")).alias("r")
    )
    return top.select("branch", "r.*")


def stale_approvals(requests: DataFrame, changelog: DataFrame) -> DataFrame:
    """Approved requests whose source or target changed since approval: ``id, reason``."""
    last = last_change(changelog)
    src = last.select(F.col("branch").alias("source"), F.col("last_seq").alias("s_seq"))
    tgt = last.select(F.col("branch").alias("target"), F.col("last_seq").alias("t_seq"))
    joined = (
        requests.where("status = 'approved'").join(src, "source", "left").join(tgt, "target", "left")
    )

    def changed(side: str, name: str, seq: str) -> Column:
        text = F.concat(F.lit(f"{side} "), name, F.lit(" has moved on since its approval"))
        return F.when(F.col(seq) > F.col("approval_seq"), text)

    reason = F.when(
        F.col("approval_seq").isNull(), "approved at no known position"
    ).otherwise(
        F.concat_ws("; ", changed("source", "source", "s_seq"), changed("target", "target", "t_seq"))
    )
    return joined.select("id", reason.alias("reason")).where("reason <> ''")


# States in which a request blocks another one for the same pair.
OPEN_STATES = ["open", "approved"]


def list_requests(
    requests: DataFrame, status: str | None = None, target: str | None = None
) -> DataFrame:
    """Requests newest first."""
    if status is not None:
        requests = requests.where(F.col("status") == status)
    if target is not None:
        requests = requests.where(F.col("target") == target)
    return requests.orderBy(F.desc("created_at"), F.desc("id"))


def duplicate_requests(requests: DataFrame) -> DataFrame:
    """Source and target pairs with more than one open request."""
    live = requests.where(F.col("status").isin(*OPEN_STATES))
    return live.groupBy("source", "target").agg(F.count("*").alias("requests")).where("requests > 1")
