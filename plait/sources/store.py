"""Branches, commits and snapshots of tables in a shared folder.

A version of a table is an immutable Parquet folder, its base, and a few change sets
that are laid over it: editing one row writes one row. Every so many change sets the
version they lead to is written as a new base. A branch maps table names to versions,
so branching, restoring and rolling back move pointers and never rows.

All that happens is one ordered log of small records (:mod:`.records`). A record takes
effect as a whole: a merge moves the target's tables and head, retires the source and
adds the commit and the logged changes in one step, or not at all. Folders written by a
writer that died before its record are never referred to.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import re
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window, functions as F, types as T

from ..functions.canonical import as_text, checksum_of, lane_sums, row_hash, struct_text
from ..functions.text import NAME_PATTERN, RESERVED_NAME
from ..operators import changes as ch, changesets as cs, compare as cmp, diff, graph, history, merge as mg, privacy, query
from ..operators.keys import assert_unique_key, key_text
from ..session import written
from .records import STATE_EVERY, Records, publish

_ENTRY = (
    "struct<base:string, keys:array<string>, columns:string, deltas:array<string>, origin:string, "
    "trail:array<string>, row_count:bigint, lanes:array<string>, checksum:string>"
)
_TABLES = f"map<string, {_ENTRY}>"
_STATE = (
    "struct<name:string, parent:string, status:string, head_commit:string, lazy:boolean, read_only:boolean, "
    "depth:int, created_by:string, created_at:timestamp, expires_at:timestamp, generation:bigint, "
    f"tables:{_TABLES}>"
)
_COMMIT = (
    "struct<hash:string, branch:string, parents:array<string>, message:string, author:string, "
    f"ts:timestamp, generation:bigint, snapshot:{_TABLES}>"
)
_PIN = (
    "struct<id:string, kind:string, branch:string, label:string, commit_hash:string, created_by:string, "
    f"created_at:timestamp, status:string, tables:{_TABLES}>"
)
_TAG = "struct<name:string, hash:string, created_by:string, created_at:timestamp, deleted:boolean>"
_REQUEST = (
    "struct<id:string, source:string, target:string, description:string, status:string, created_by:string, "
    "created_at:timestamp, reviewed_by:string, approval_seq:bigint, reason:string, changes:map<string,bigint>>"
)
_CHANGE = "struct<id:string, branch:string, table:string, keys:array<string>, columns:string>"
_RECORD = (
    f"seq bigint, at timestamp, action string, by string, states array<{_STATE}>, commit {_COMMIT}, "
    f"pin {_PIN}, tag {_TAG}, request {_REQUEST}, changes array<{_CHANGE}>, cleaned array<string>"
)

MAX_DEPTH = 5

# Change sets over one base; beyond that, or beyond half its rows, a new base is written.
CHANGES_PER_BASE = 16

# Changed rows over a base beyond which their keys are shuffled and never broadcast.
BROADCAST_KEYS = 100_000


@dataclass(frozen=True)
class Entry:
    """One version of a table: a base and the change sets over it, in order.

    ``origin`` and ``trail`` name the base before this one and the change sets that led
    from there, so two versions on both sides of a new base can still be compared by
    their change sets. ``lanes`` are the sums its checksum is made of.
    """

    base: str
    keys: list[str]
    columns: str
    row_count: int
    lanes: list[int]
    deltas: list[str] = field(default_factory=list)
    origin: str | None = None
    trail: list[str] = field(default_factory=list)
    changed: int = 0

    @property
    def checksum(self) -> str:
        return checksum_of(self.row_count, self.lanes)

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.columns))


@dataclass(frozen=True)
class Branch:
    name: str
    parent: str | None
    status: str = "active"
    head_commit: str | None = None
    lazy: bool = False
    read_only: bool = False
    depth: int = 0
    created_by: str | None = None
    created_at: datetime.datetime | None = None
    expires_at: datetime.datetime | None = None
    generation: int | None = None  # of the head commit
    tables: dict[str, Entry] = field(default_factory=dict)


def _now() -> datetime.datetime:
    return datetime.datetime.now(datetime.timezone.utc)


def _stamp(at: datetime.datetime | None) -> str | None:
    if at is None:
        return None
    return at.astimezone(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def _time(text: str | None) -> datetime.datetime | None:
    return None if text is None else datetime.datetime.fromisoformat(text)


def _entry_json(e: Entry) -> dict:
    return {**asdict(e), "lanes": [str(x) for x in e.lanes], "checksum": e.checksum}


def _entry(raw: dict | Row) -> Entry:
    raw = raw.asDict() if isinstance(raw, Row) else raw
    return Entry(
        raw["base"], list(raw["keys"]), raw["columns"], raw["row_count"], [int(x) for x in raw["lanes"]],
        list(raw["deltas"]), raw["origin"], list(raw["trail"]), raw.get("changed") or 0,
    )


def _entries(raw: dict | None) -> dict[str, Entry]:
    return {n: _entry(r) for n, r in (raw or {}).items()}


def _raw(tables: dict[str, Entry]) -> dict[str, dict]:
    return {n: _entry_json(e) for n, e in tables.items()}


def _branch_json(b: Branch) -> dict:
    return {
        "name": b.name, "parent": b.parent, "status": b.status, "head_commit": b.head_commit, "lazy": b.lazy,
        "read_only": b.read_only, "depth": b.depth, "created_by": b.created_by, "created_at": _stamp(b.created_at),
        "expires_at": _stamp(b.expires_at), "generation": b.generation, "tables": _raw(b.tables),
    }


def _branch(raw: dict) -> Branch:
    return Branch(
        raw["name"], raw["parent"], raw["status"], raw["head_commit"], raw["lazy"], raw["read_only"], raw["depth"],
        raw["created_by"], _time(raw["created_at"]), _time(raw["expires_at"]), raw["generation"],
        _entries(raw["tables"]),
    )


def _same(a: Entry, b: Entry) -> bool:
    """Equal content without reading it: the same version, or the same checksum."""
    return (a.base, a.deltas) == (b.base, b.deltas) or (a.lanes == b.lanes and a.row_count == b.row_count)


def _added(old: Entry, new: Entry) -> list[str] | None:
    """Change sets that lead from one version to another, or None if that is not known."""
    n = len(old.deltas)
    if old.columns != new.columns:
        return None
    if new.base == old.base and new.deltas[:n] == old.deltas:
        return new.deltas[n:]
    if new.origin == old.base and new.trail[:n] == old.deltas:
        return new.trail[n:] + new.deltas
    return None


class Store:
    """Versioned tables under ``root``, a folder all executors can reach.

    Every table a user writes is checked for unique keys; results of merges have them by
    construction. Several writers may use one store: whoever publishes second looks at
    the store again and, if its table has moved, works its change out anew.
    """

    def __init__(self, spark: SparkSession, root: str, check_keys: bool = True):
        self.spark = spark
        self.root = root.rstrip("/")
        self.check_keys = check_keys
        self._records = Records(spark, f"{self.root}/meta", _RECORD)
        self._last = -1
        self._live: dict[str, Branch] = {}
        self._pinned: dict[str, dict] = {}
        self._tagged: dict[str, dict] = {}

    # --- records ---------------------------------------------------------------------

    def _follow(self) -> int:
        """Take in what has been published since; the number of the last record."""
        if self._last < 0:
            self._last, state = self._records.newest_state()
            if state is not None:
                self._live = {n: _branch(b) for n, b in state["branches"].items()}
                self._pinned, self._tagged = state["pins"], state["tags"]
        for record in self._records.after(self._last):
            self._last = record["seq"]
            for raw in record.get("states") or []:
                self._live[raw["name"]] = _branch(raw)
            pin, tag = record.get("pin"), record.get("tag")
            if pin:
                self._pinned[pin["id"]] = {**pin, "seq": self._last}
                if pin["status"] != "active":
                    del self._pinned[pin["id"]]
            if tag:
                self._tagged[tag["name"]] = tag
                if tag["deleted"]:
                    del self._tagged[tag["name"]]
        return self._last

    def _publish(self, build: Callable[[], dict | None]) -> dict | None:
        made = publish(self._records, self._follow, build)
        if made is not None and self._last % STATE_EVERY == STATE_EVERY - 1:
            branches = {n: _branch_json(b) for n, b in self._live.items() if b.status != "removed"}
            state = {"branches": branches, "pins": self._pinned, "tags": self._tagged}
            self._records.save_state(self._last, state)
        return made

    def _save(self, name: str, action: str, change: Callable[[Branch], Branch], **more) -> Branch:
        """Replace a branch's state by what ``change`` makes of the newest one."""

        def build() -> dict:
            return _record(action, [change(self._at(name))], **more)

        self._publish(build)
        return self._live[name]

    def reflog(self) -> DataFrame:
        """Every branch state ever published."""
        rows = self._records.table().select("seq", "action", F.col("at").alias("updated_at"), F.explode("states").alias("s"))
        return rows.select("seq", "action", "updated_at", "s.*")

    def branches(self) -> DataFrame:
        """The latest state of each branch."""
        return query.latest_per(self.reflog(), ["name"], ["seq"])

    def commits(self) -> DataFrame:
        return self._records.table().where("commit IS NOT NULL").select("commit.*")

    def _at(self, name: str) -> Branch:
        found = self._live.get(name)
        if found is None or found.status in ("deleted", "removed"):
            raise KeyError(f"no branch is called {name!r}")
        return found

    def branch(self, name: str) -> Branch:
        """The live state of a branch."""
        self._follow()
        return self._at(name)

    # --- tables ------------------------------------------------------------------------

    def _visible(self, branch: Branch) -> dict[str, Entry]:
        if not branch.lazy or branch.parent is None:
            return branch.tables
        return {**self._visible(self._at(branch.parent)), **branch.tables}

    def visible(self, branch: Branch) -> dict[str, Entry]:
        """Tables seen on a branch: a lazy branch falls back to its parent's."""
        self._follow()
        return self._visible(branch)

    def list_tables(self, name: str) -> list[str]:
        return sorted(self.visible(self.branch(name)))

    def _folder(self, table: str, columns: str) -> str:
        """Where change sets of a table with these columns are."""
        shape = hashlib.sha256(columns.encode()).hexdigest()[:8]
        return f"{self.root}/changes/{table}/{shape}"

    def _change_sets(self, table: str, keys: list[str], columns: str, ids: list[str] | None = None) -> DataFrame:
        """``change, op, key, before, after`` of some or all change sets of a table."""
        row = T.StructType.fromJson(json.loads(columns))
        schema = T.StructType([
            T.StructField("op", T.StringType()), T.StructField("key", T.StructType([row[k] for k in keys])),
            T.StructField("before", row), T.StructField("after", row), T.StructField("change", T.StringType()),
        ])
        folder = self._folder(table, columns)
        reader = self.spark.read.schema(schema).option("basePath", folder)
        return reader.parquet(*([folder] if ids is None else [f"{folder}/change={i}" for i in ids]))

    def _stacked(self, table: str, entry: Entry, ids: list[str]) -> DataFrame:
        """The given change sets with their order."""
        place = F.array_position(F.array(*map(F.lit, ids)), F.col("change"))
        return self._change_sets(table, entry.keys, entry.columns, ids).withColumn("ord", place)

    def _load(self, table: str, entry: Entry, condition: Column | None = None) -> DataFrame:
        """The rows of a version, or those that meet a condition."""
        base = self.spark.read.schema(entry.schema).parquet(entry.base)
        if not entry.deltas:
            return base if condition is None else base.where(condition)
        stacked, many = self._stacked(table, entry, entry.deltas), entry.changed > BROADCAST_KEYS
        if condition is None:
            return cs.fold(base, stacked, entry.keys, many=many)
        return cs.fold_where(base, stacked, entry.keys, condition, many=many)

    def table(self, name: str, table: str) -> DataFrame:
        """A table as seen from a branch."""
        found = self.visible(self.branch(name))
        if table not in found:
            raise KeyError(f"{name!r} has no table {table!r}")
        return self._load(table, found[table])

    def _snapshot(self, table: str, df: DataFrame, keys: list[str], checked: bool = False) -> Entry:
        """Write a whole table; its digest is taken in the same pass."""
        path = f"{self.root}/data/{table}/{uuid.uuid4().hex}"
        watch = Observation()
        hashed = df.withColumn("__h", row_hash(df))
        sums = [F.count(F.lit(1)).alias("row_count"), *lane_sums(F.col("__h"))]
        hashed.observe(watch, *sums).drop("__h").write.mode("error").parquet(path)
        if checked and self.check_keys:
            try:
                assert_unique_key(self.spark.read.schema(df.schema).parquet(path), keys)
            except ValueError:
                self._records.delete([path])
                raise
        nullable = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
        return Entry(path, list(keys), nullable.json(), watch.get["row_count"], _lanes(watch.get))

    def _extended(self, table: str, entry: Entry, changes: DataFrame) -> tuple[Entry, str | None]:
        """The version after a change set, written, and the change set's id (None: no change)."""
        made = f"c{uuid.uuid4().hex}"
        path = f"{self._folder(table, entry.columns)}/change={made}"
        row = entry.schema
        changes = changes.select(
            "op", "key", F.col("before").cast(row).alias("before"), F.col("after").cast(row).alias("after")
        )
        watch = Observation()
        count = F.count(F.lit(1)).alias("changed")
        try:
            changes.observe(watch, count, *cs.digest_change(changes)).write.mode("error").parquet(path)
        except Exception as error:  # raised in a task, wrapped by the scheduler
            twice = re.search(r"keys \[.*?\] are not unique[^\n]*", str(error))
            if twice:
                raise ValueError(twice[0]) from error
            raise
        seen = watch.get
        if not seen["changed"]:
            self._records.delete([path])
            return entry, None
        lanes = [a + b for a, b in zip(entry.lanes, _lanes(seen))]
        longer = replace(
            entry, deltas=[*entry.deltas, made], row_count=entry.row_count + seen["row_count"], lanes=lanes,
            changed=entry.changed + seen["changed"],
        )
        if len(longer.deltas) >= CHANGES_PER_BASE or 2 * longer.changed > longer.row_count:
            # The first rule bounds what a reader folds, the second what it folds in vain.
            path = f"{self.root}/data/{table}/{uuid.uuid4().hex}"
            self._load(table, longer).write.mode("error").parquet(path)
            longer = replace(longer, base=path, deltas=[], origin=entry.base, trail=longer.deltas, changed=0)
        return longer, made

    def _change(
        self, name: str, table: str, make: Callable[[Entry], DataFrame], action: str, by: str | None
    ) -> Branch:
        """Lay a change set over a table of a branch, log it and publish both at once."""
        done: dict[tuple, tuple[Entry, str | None]] = {}

        def build() -> dict | None:
            branch = self._writable(name)
            entry = self._visible(branch).get(table)
            if entry is None:
                raise KeyError(f"{name!r} has no table {table!r}")
            version = (entry.base, *entry.deltas)
            if version not in done:
                done[version] = self._extended(table, entry, make(entry))
            after, made = done[version]
            if made is None:
                return None
            moved = replace(branch, tables={**branch.tables, table: after})
            return _record(action, [moved], by=by, changes=[_change_json(made, name, table, entry)])

        self._publish(build)
        return self._live[name]

    def _writable(self, name: str) -> Branch:
        branch = self._at(name)
        if branch.read_only:
            raise PermissionError(f"{name!r} may only be read")
        return branch

    def write(
        self, name: str, table: str, df: DataFrame, keys: list[str] | None = None, by: str | None = None
    ) -> Branch:
        """Make a table of a branch hold these rows; only what differs is written.

        A new table, new columns or other keys write the whole table.
        """
        self._follow()
        known = self._visible(self._writable(name)).get(table)
        if known is None and keys is None:
            raise ValueError(f"{table!r} is new: name its keys")
        plain = [(f.name, f.dataType) for f in df.schema.fields]
        if known is not None and keys in (None, known.keys) and plain == [(f.name, f.dataType) for f in known.schema]:
            return self._change(name, table, lambda e: cs.capture(self._load(table, e), df, e.keys), "write", by)
        entry = self._snapshot(table, df, keys or known.keys, checked=True)
        return self._save(
            name, "write", lambda b: replace(self._writable(name), tables={**b.tables, table: entry}), by=by
        )

    def insert(self, name: str, table: str, rows: DataFrame, by: str | None = None) -> Branch:
        """Append rows; a key that exists raises."""
        return self._change(name, table, lambda e: cs.inserted(self._load(table, e), rows, e.keys), "insert", by)

    def update(
        self, name: str, table: str, condition: Column, sets: dict[str, Column], by: str | None = None, one: bool = False
    ) -> Branch:
        """Set columns or nested fields where ``condition`` holds, or only in the lowest such key."""

        def make(e: Entry) -> DataFrame:
            log = ch.update(self._load(table, e, condition), F.lit(True), sets, e.keys, 0, by, one)[1]
            return cs.from_log(log, e.keys)

        return self._change(name, table, make, "update", by)

    def delete(self, name: str, table: str, condition: Column, by: str | None = None, one: bool = False) -> Branch:
        """Delete rows where ``condition`` holds, or only the one with the lowest key."""

        def make(e: Entry) -> DataFrame:
            return cs.from_log(ch.delete(self._load(table, e, condition), F.lit(True), e.keys, 0, by, one)[1], e.keys)

        return self._change(name, table, make, "delete", by)

    def upsert(self, name: str, table: str, rows: DataFrame, by: str | None = None) -> Branch:
        """Overlay the columns of ``rows`` by key; unknown keys become new rows."""

        def make(e: Entry) -> DataFrame:
            assert_unique_key(rows, e.keys)
            old = self._load(table, e)
            touched = old.join(rows.select(*e.keys), e.keys, "left_semi")
            new = ch.upsert(touched, rows, e.keys)
            return cs.overlay(old, new.select(F.struct(*e.keys).alias("key"), F.struct(*old.columns).alias("after")), e.keys)

        return self._change(name, table, make, "upsert", by)

    # --- the log of changes ---------------------------------------------------------------

    def _logged(self, branch: str | None, table: str | None, after: int | None) -> DataFrame:
        """Published change sets: ``seq, at, action, by, id, branch, table, keys, columns``."""
        rows = self._records.table().select("seq", "at", "action", "by", F.explode("changes").alias("c"))
        rows = rows.select("seq", "at", "action", "by", "c.*")
        for column, value in (("branch", branch), ("table", table)):
            rows = rows if value is None else rows.where(F.col(column) == value)
        return rows if after is None else rows.where(F.col("seq") > after)

    def position(self) -> int:
        """The number of the last record: a resume token for :meth:`op_log`."""
        return self._follow()

    def op_log(self, branch: str | None = None, table: str | None = None, after: int | None = None) -> DataFrame:
        """One row per changed row, of all writes or those after a position.

        ``seq, branch, table, op, key, before, after, performed_by, ts, action``; keys are
        text and images JSON, so all tables fit into one log in the order of ``seq``.
        """
        return self._log_of(branch, table, after, typed=False)

    def table_log(self, branch: str, table: str, after: int | None = None) -> DataFrame:
        """:meth:`op_log` of one table with images as structs and the ``key`` as one."""
        return self._log_of(branch, table, after, typed=True)

    def _log_of(self, branch: str | None, table: str | None, after: int | None, typed: bool) -> DataFrame:
        logged = self._logged(branch, table, after)
        parts = []
        # As many as there are tables and column layouts.
        for kind in logged.select("table", "keys", "columns").distinct().collect():
            sets = self._change_sets(kind["table"], kind["keys"], kind["columns"])
            row = T.StructType.fromJson(json.loads(kind["columns"]))
            if not typed:
                sets = sets.select(
                    "change", "op", F.concat_ws("/", *[as_text(F.col("key")[k], row[k].dataType) for k in kind["keys"]]).alias("key"),
                    struct_text(F.col("before"), row).alias("before"), struct_text(F.col("after"), row).alias("after"),
                )
            mine = logged.where((F.col("table") == kind["table"]) & (F.col("columns") == kind["columns"]))
            mine = mine.select("id", "seq", "branch", "table", F.col("by").alias("performed_by"), F.col("at").alias("ts"), "action")
            joined = sets.join(mine, F.col("change") == F.col("id"))
            parts.append(joined.select("seq", "branch", "table", "op", "key", "before", "after", "performed_by", "ts", "action"))
        if not parts:
            return self.spark.createDataFrame(
                [], "seq bigint, branch string, table string, op string, key string, before string, after string, "
                "performed_by string, ts timestamp, action string",
            )
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def undo(self, name: str, table: str, n: int = 1, by: str | None = None) -> Branch:
        """Take back the last ``n`` logged writes to a table of a branch, as one more write.

        What was undone stays in the log, followed by the change that undid it.
        """
        last = self._logged(name, table, None).orderBy(F.desc("seq")).limit(n).collect()
        if not last:
            return self.branch(name)
        ids = [r["id"] for r in reversed(last)]

        def make(e: Entry) -> DataFrame:
            return cs.overlay(self._load(table, e), cs.first_before(self._stacked(table, e, ids)), e.keys)

        return self._change(name, table, make, "undo", by)

    # --- branches -----------------------------------------------------------------------

    def init(self, tables: dict[str, tuple[DataFrame, list[str]]], author: str = "system") -> str:
        """Create ``main`` with its first commit."""
        entries = {n: self._snapshot(n, df, keys, checked=True) for n, (df, keys) in tables.items()}
        main = Branch(RESERVED_NAME, None, created_by=author, created_at=_now(), tables=entries)
        self._publish(lambda: _record("create", [main], by=author))
        return self.commit(RESERVED_NAME, "bootstrap main history", author)

    def create_branch(
        self,
        name: str,
        parent: str = RESERVED_NAME,
        tables: list[str] | None = None,
        lazy: bool = False,
        schema_only: bool = False,
        read_only: bool = False,
        created_by: str = "unknown",
        ttl_minutes: int | None = None,
        max_depth: int = MAX_DEPTH,
        overlay: dict[str, Entry] | None = None,
    ) -> Branch:
        """A new branch of all or some tables of ``parent``.

        ``lazy`` branches see later changes of their parent in tables they have
        not written; ``schema_only`` branches start with empty tables; ``overlay`` holds
        versions that take the place of the parent's.
        """
        if not name or not name.strip():
            raise ValueError("a branch needs a name")
        if name == RESERVED_NAME or not re.match(NAME_PATTERN, name):
            raise ValueError(f"{name!r} cannot name a branch")

        def build() -> dict:
            try:
                self._at(name)
            except KeyError:
                pass
            else:
                raise ValueError(f"{name!r} exists")
            base = self._at(parent)
            seen = self._visible(base)
            missing = [t for t in tables or [] if t not in seen]
            if missing:
                raise ValueError(f"{parent!r} has no table {', '.join(missing)}")
            depth = 0 if parent == RESERVED_NAME else base.depth + 1
            if depth > max_depth:
                raise ValueError(f"branches nest to a depth of {max_depth}")
            chosen = {n: e for n, e in seen.items() if tables is None or n in tables}
            if schema_only:
                chosen = {n: self._empty(n, e) for n, e in chosen.items()}
            chosen |= overlay or {}
            now = _now()
            expires = now + datetime.timedelta(minutes=ttl_minutes) if ttl_minutes else None
            made = Branch(
                name, parent, "active", base.head_commit, lazy, read_only, depth, created_by, now,
                expires, base.generation, {} if lazy and not schema_only else chosen,
            )
            return _record("create", [made], by=created_by)

        self._publish(build)
        return self._live[name]

    def _empty(self, table: str, entry: Entry) -> Entry:
        return self._snapshot(table, self.spark.createDataFrame([], entry.schema), entry.keys)

    def masked_branch(
        self, name: str, rules: dict[str, dict[str, str]], parent: str = RESERVED_NAME, created_by: str = "unknown"
    ) -> dict[str, dict[str, int]]:
        """A branch of ``parent`` whose fields are masked by ``{table: {path: strategy}}``.

        Paths may lead into structs; a path a table lacks is skipped. All masked tables are
        written before the branch is published, so no one sees it with a plain field.
        Returns rows and fields changed by table.
        """
        seen = self.visible(self.branch(parent))
        missing = sorted(set(rules) - set(seen))
        if missing:
            raise ValueError(f"{parent!r} has no table {', '.join(missing)}")
        masked, counts = {}, {}
        for t, fields in rules.items():
            table = self._load(t, seen[t])
            changed = privacy.anonymize_counts(table, fields).first()
            counts[t] = changed.asDict()
            masked[t] = self._snapshot(t, privacy.anonymize(table, fields), seen[t].keys)
        self.create_branch(name, parent, created_by=created_by, overlay=masked)
        return counts

    def materialization(self, name: str) -> dict[str, list[str]]:
        """Tables a lazy branch owns and those it reads from its parent."""
        branch = self.branch(name)
        own = sorted(branch.tables)
        return {"materialized": own, "pending": sorted(set(self.visible(branch)) - set(own))}

    def expire(self, name: str, minutes: int | None) -> Branch:
        """Set the expiry to ``minutes`` from now, or remove it with None."""
        until = None if minutes is None else _now() + datetime.timedelta(minutes=minutes)
        return self._save(name, "expire", lambda b: replace(b, expires_at=until))

    def delete_branch(self, name: str) -> None:
        if name == RESERVED_NAME:
            raise ValueError("main stays")
        self._save(name, "delete", lambda b: replace(b, status="deleted"))

    def reset_to_parent(self, name: str) -> dict[str, int]:
        """Point all tables at what the parent sees now."""

        def change(branch: Branch) -> Branch:
            if branch.parent is None:
                raise ValueError("main has no parent")
            return replace(branch, tables=self._visible(self._at(branch.parent)))

        self._follow()
        seen = self._save(name, "reset", change).tables
        return {"tables_reset": len(seen), "rows_restored": sum(e.row_count for e in seen.values())}

    # --- commits -------------------------------------------------------------------------

    def _committed(
        self, branch: Branch, message: str, author: str, parents: list[str] | None, ts: datetime.datetime | None = None
    ) -> tuple[Branch, dict]:
        """A branch with a commit of its visible tables as its head, and the commit.

        Versions know their counts and checksums, so no table is read.
        """
        snapshot = self._visible(branch)
        if parents is None:
            parents = [branch.head_commit] if branch.head_commit else []
        ts = ts or _now()
        content = {
            "branch": branch.name,
            "parents": parents,
            "message": message,
            "author": author,
            "ts": ts.isoformat(),
            "snapshot": {n: [e.row_count, e.checksum] for n, e in sorted(snapshot.items())},
        }
        value = hashlib.sha256(json.dumps(content, separators=(",", ":")).encode()).hexdigest()
        commit = {
            "hash": value, "branch": branch.name, "parents": parents, "message": message, "author": author,
            "ts": _stamp(ts), "generation": self._generation(parents), "snapshot": _raw(snapshot),
        }
        return replace(branch, head_commit=value, generation=commit["generation"]), commit

    def _generation(self, parents: list[str]) -> int:
        """One more than the largest of the parents; a commit without parents has 0."""
        heads = {b.head_commit: b.generation for b in self._live.values()}
        if all(p in heads for p in parents):
            return max([heads[p] + 1 for p in parents], default=0)
        known = self.commits().where(F.col("hash").isin(parents)).agg(F.max("generation")).first()[0]
        return 0 if known is None else known + 1

    def commit(
        self,
        name: str,
        message: str,
        author: str = "unknown",
        parents: list[str] | None = None,
        ts: datetime.datetime | None = None,
    ) -> str:
        """Record the visible tables of a branch; returns the commit hash."""

        def build() -> dict:
            branch, commit = self._committed(self._at(name), message, author, parents, ts)
            return _record("commit", [branch], by=author, commit=commit)

        return self._publish(build)["commit"]["hash"]

    def _commit_row(self, value: str) -> Row:
        rows = self.commits().where(F.col("hash") == value).limit(1).collect()
        if not rows:
            raise KeyError(f"no commit {value!r}")
        return rows[0]

    def read_at(self, value: str) -> dict[str, DataFrame]:
        """All tables of a commit."""
        return {n: self._load(n, e) for n, e in _entries(self._commit_row(value)["snapshot"]).items()}

    def log(self, name: str, limit: int | None = None) -> DataFrame:
        """Commits of a branch, newest first."""
        heads = self.spark.createDataFrame(
            [(name, self.branch(name).head_commit)], "branch string, hash string"
        )
        commits = self.commits()
        chain = graph.commit_log(commits, heads, limit).select("hash", "pos")
        return chain.join(commits, "hash").orderBy("pos")

    def common_ancestor(self, a: str, b: str) -> str | None:
        """Merge base of two branches, nearest to ``b``."""
        pair = (self.branch(a).head_commit, self.branch(b).head_commit)
        if None in pair:
            return None
        if pair[0] == pair[1]:
            return pair[0]
        pairs = self.spark.createDataFrame([pair], "a string, b string")
        rows = graph.common_ancestor(self.commits(), pairs).collect()
        return rows[0]["base"] if rows else None

    def tags(self) -> DataFrame:
        """Live tags, newest first."""
        rows = self._records.table().where("tag IS NOT NULL").select("seq", "tag.*")
        live = query.latest_per(rows, ["name"], ["seq"]).where("NOT deleted").drop("seq", "deleted")
        return live.orderBy(F.desc("created_at"), F.desc("name"))

    def tag(self, name: str, value: str, created_by: str = "unknown") -> None:
        """Name a commit; a tag never moves."""
        self._commit_row(value)

        def build() -> dict:
            if name in self._tagged:
                raise ValueError(f"tag {name!r} exists")
            tag = {"name": name, "hash": value, "created_by": created_by, "created_at": _stamp(_now()), "deleted": False}
            return _record("tag", [], by=created_by, tag=tag)

        self._publish(build)

    def delete_tag(self, name: str) -> bool:
        """Drop a tag; False if there is none. Its name may be given anew."""

        def build() -> dict | None:
            known = self._tagged.get(name)
            return known and _record("untag", [], tag={**known, "deleted": True})

        return self._publish(build) is not None

    def resolve_tag(self, name: str) -> str:
        self._follow()
        if name not in self._tagged:
            raise KeyError(f"no tag {name!r}")
        return self._tagged[name]["hash"]

    # --- time travel -----------------------------------------------------------------------

    def find_at(self, name: str, table: str, at: str, values: dict | None = None) -> DataFrame:
        """Rows of a table at a commit hash or time, by exact field values."""
        rows = history.resolve(self.commits(), name, at).collect()
        if not rows:
            raise KeyError(f"{name!r} has no commit at {at!r}")
        entries = _entries(rows[0]["snapshot"])
        if table not in entries:
            try:
                return self.table(name, table).limit(0)
            except KeyError:  # gone from the branch too: nothing found
                return self.spark.range(0).select()
        return query.find_exact(self._load(table, entries[table]), values or {})

    def tables_at(self, name: str, at: str) -> list[str]:
        rows = history.resolve(self.commits(), name, at)
        found = history.tables_at(rows.select("hash", "snapshot")).collect()
        return sorted(r["table"] for r in found)

    def blame(self, name: str, table: str) -> DataFrame:
        """Who set each field of each row of a table, from the changes along its commits.

        Read are the oldest version on the branch's chain and the change sets since;
        where versions do not follow each other by change sets (after a restore or new
        columns), the snapshots are compared instead.
        """
        chain = self.log(name, None)
        chain = chain.select("pos", "hash", "branch", "author", "ts", F.col("snapshot")[table].alias("entry"))
        chain = written(chain, "chain")
        held = chain.where("entry IS NOT NULL").select("pos", "entry")
        oldest = held.orderBy(F.desc("pos")).limit(1).collect()
        if not oldest:
            raise KeyError(f"no commit of {name!r} holds {table!r}")
        first, at = _entry(oldest[0]["entry"]), oldest[0]["pos"]
        info = chain.select("pos", "hash", "branch", "author", "ts")
        steps = _steps(held)
        if steps.where("ids IS NULL").isEmpty():
            ids = steps.select("pos", F.posexplode("ids").alias("ord", "id"))
            sets = self._change_sets(table, first.keys, first.columns) if not ids.isEmpty() else None
            if sets is None:
                stacked = self._no_changes(first)
            else:
                stacked = sets.join(ids, F.col("change") == F.col("id")).select("key", "before", "after", "pos", "ord")
            return cs.blame(self._load(table, first), F.lit(at), stacked, info, first.keys, name)
        return self._blame_by_snapshots(name, table, held, info)

    def _no_changes(self, entry: Entry) -> DataFrame:
        row = entry.schema
        key = T.StructType([row[k] for k in entry.keys])
        schema = T.StructType([
            T.StructField("key", key), T.StructField("before", row), T.StructField("after", row),
            T.StructField("pos", T.LongType()), T.StructField("ord", T.IntegerType()),
        ])
        return self.spark.createDataFrame([], schema)

    def _blame_by_snapshots(self, name: str, table: str, held: DataFrame, info: DataFrame) -> DataFrame:
        versions, spans, keys, last = [], [], None, None
        for r in held.join(info.select("pos", "branch"), "pos").orderBy("pos").collect():
            entry = _entry(r["entry"])
            own = r["pos"] if r["branch"] == name else None
            keys = keys or entry.keys
            if last is not None and _same(entry, last):
                newest, _, before = spans[-1]
                spans[-1] = (newest, r["pos"], own if own is not None else before)
            else:
                versions.append((r["pos"], self._load(table, entry)))
                spans.append((r["pos"], r["pos"], own))
            last = entry
        return history.blame(history.stack_versions(versions), info, keys, name, spans)

    # --- diff, merge, cherry-pick -------------------------------------------------------------

    def _between(self, table: str, old: Entry | None, new: Entry | None) -> DataFrame | None:
        """Net changes from one version to another by their change sets, if they have them."""
        if old is None or new is None or old.keys != new.keys:
            return None
        ids = _added(old, new)
        if ids is None:
            return None
        if not ids:
            return self._no_changes(old).select("key", "before", "after")
        return cs.net(self._stacked(table, new, ids))

    def diff(self, source: str, target: str) -> DataFrame:
        """Changed keys over the source's tables; tables of the same content are skipped."""
        src = self.branch(source)
        own = src.tables if src.lazy else self.visible(src)
        tgt = self.visible(self.branch(target))
        pairs = {}
        for n, e in own.items():
            other = tgt.get(n)
            if other is None or not _same(e, other):
                pairs[n] = (self._load(n, e), self._load(n, other) if other else None, e.keys)
        if not pairs:
            return self.spark.createDataFrame([], "table string, key string, change string")
        return diff.diff_tables(pairs)

    def compare(self, names: list[str], table: str) -> DataFrame:
        entries = [self.visible(self.branch(n))[table] for n in names]
        versions = {n: self._load(table, e) for n, e in zip(names, entries)}
        return cmp.compare(versions, entries[0].keys)

    def compare_all(self, names: list[str]) -> DataFrame:
        """:meth:`compare` of every table any of the branches has: ``table, key`` and one state a branch.

        A branch without a table lacks all its rows.
        """
        seen = [self.visible(self.branch(n)) for n in names]
        parts = []
        for t in sorted({t for s in seen for t in s}):
            known = next(s[t] for s in seen if t in s)
            empty = self.spark.createDataFrame([], known.schema)
            versions = {n: self._load(t, s[t]) if t in s else empty for n, s in zip(names, seen)}
            matrix = cmp.compare(versions, known.keys)
            key = key_text(matrix, known.keys).alias("key")
            parts.append(matrix.select(F.lit(t).alias("table"), key, *[F.col(n) for n in names]))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _plans(self, base: dict[str, Entry], ours: dict[str, Entry], theirs: dict[str, Entry]):
        plans = {}
        for n in sorted({*base, *ours, *theirs}):
            b, o, t = base.get(n), ours.get(n), theirs.get(n)
            if t is not None and any(x is not None and _same(t, x) for x in (b, o)):
                continue
            if t is None and (b is None or o is None):
                continue
            mine, other = self._between(n, b, o), self._between(n, b, t)
            known = [e for e in (b, o, t) if e is not None]
            if mine is not None and other is not None:
                plans[n] = mg.diff3_changes(mine, other, known[0].keys)
                continue
            empty = self.spark.createDataFrame([], known[0].schema)
            frames = [self._load(n, e) if e is not None else empty for e in (b, o, t)]
            plans[n] = mg.diff3(*frames, known[0].keys)
        return plans

    def merge(
        self,
        source: str,
        target: str = RESERVED_NAME,
        strategy: str = "manual",
        author: str = "unknown",
        message: str | None = None,
        dry_run: bool = False,
        keep_clean_fields: bool = False,
        gate: list[mg.Check] | None = None,
        together: dict | None = None,
    ) -> dict:
        """Three-way merge of branches with a two-parent commit.

        Without a common ancestor the source's tables replace the target's. Tables the
        source left as they were in the base are not read at all, and of others only what
        both sides changed since the base, where versions follow each other by change
        sets. Conflicts are counted before anything is written. Tables, head, commit, log
        and the source's end are published together; if the target has moved meanwhile,
        the merge starts anew. ``together`` holds further parts of the record it makes.
        """
        while True:
            src, tgt = self.branch(source), self.branch(target)
            seen = (src.head_commit, tgt.head_commit, self.visible(src), self.visible(tgt))
            result, moved = self._merged(src, tgt, strategy, keep_clean_fields, gate, dry_run)
            if moved is None:
                return result
            tables, changes = moved
            made = self._finish(source, target, seen, tables, changes, author, message, together or {})
            if made is not None:
                return {**result, "commit": made}

    def _merged(self, src: Branch, tgt: Branch, strategy, keep_clean_fields, gate, dry_run):
        """The result of a merge, and the target's tables and change sets if it goes on."""
        theirs, ours = self.visible(src), self.visible(tgt)
        ancestor = self.common_ancestor(tgt.name, src.name)
        if ancestor is None:
            changed = {n: e for n, e in theirs.items() if n not in ours or not _same(e, ours[n])}
            result = {"base": None, "success": True, "tables": sorted(changed), "conflicts": None}
            return result, None if dry_run else ({**ours, **changed}, [])
        base = _entries(self._commit_row(ancestor)["snapshot"])
        plans = self._plans(base, ours, theirs)
        result = {"base": ancestor, "success": True, "tables": sorted(plans), "conflicts": None}
        if plans:
            counts = mg.merge_counts(plans, strategy, dry_run).collect()[0].asDict()
            result.update({c: v for c, v in counts.items() if dry_run or c != "dry_run"})
            if counts["conflict_count"]:
                result["conflicts"] = {n: mg.conflicts(p) for n, p in plans.items()}
        else:
            result.update(dict.fromkeys(mg.COUNTS, 0), tables_affected=0)
        if dry_run:
            return result, None
        for n, plan in plans.items():
            allowed, reason = mg.merge_gate(plan.rows, gate or [])
            if not allowed:
                return {**result, "success": False, "reason": reason, "table": n}, None
        if not result["success"]:
            return result, None
        merged, changes = {}, []
        for n, plan in plans.items():
            entry = ours.get(n)
            names = [f.name for f in entry.schema] if entry else None
            if entry is not None and set(names) == {*plan.keys, *plan.types}:
                rows = mg.merged_changes(plan, names, strategy, keep_clean_fields)
                merged[n], made = self._extended(n, entry, rows)
                changes += [_change_json(made, tgt.name, n, entry)] if made else []
            else:
                merged[n] = self._snapshot(n, mg.merged_rows(plan, strategy, keep_clean_fields), plan.keys)
        return result, ({**ours, **merged}, changes)

    def _finish(self, source, target, seen, tables, changes, author, message, together) -> str | None:
        def build() -> dict | None:
            src, tgt = self._at(source), self._at(target)
            if seen != (src.head_commit, tgt.head_commit, self._visible(src), self._visible(tgt)):
                return None
            parents = [h for h in (tgt.head_commit, src.head_commit) if h]
            text = message or f'Merge "{source}" into "{target}"'
            moved, commit = self._committed(replace(tgt, tables=tables), text, author, parents)
            ended = [] if source == RESERVED_NAME else [replace(src, status="merged")]
            return _record("merge", [moved, *ended], by=author, commit=commit, changes=changes, **together)

        made = self._publish(build)
        return made and made["commit"]["hash"]

    def cherry_pick(self, target: str, value: str, author: str = "unknown") -> str:
        """Apply one commit's changes to a branch and commit them."""
        return self._replay(target, value, author, backwards=False)

    def revert(self, name: str, value: str, author: str = "unknown") -> str:
        """Undo one commit's changes on a branch and commit that."""
        return self._replay(name, value, author, backwards=True)

    def _replay(self, name: str, value: str, author: str, backwards: bool) -> str:
        row = self._commit_row(value)
        after = _entries(row["snapshot"])
        before = _entries(self._commit_row(row["parents"][0])["snapshot"]) if row["parents"] else {}
        describe = history.revert_message if backwards else history.cherry_pick_message
        while True:
            branch = self.branch(name)
            ours = self.visible(branch)
            moved, changes = {}, []
            for n in sorted({*before, *after}):
                b, a, o = before.get(n), after.get(n), ours.get(n)
                if b is not None and a is not None and _same(a, b):
                    continue
                known = next(e for e in (o, a, b) if e is not None)
                images = self._between(n, b, a)
                if images is not None and o is not None and o.columns == a.columns:
                    picked = F.col("before" if backwards else "after").alias("after")
                    rows = cs.overlay(self._load(n, o), images.select("key", picked), known.keys)
                    moved[n], made = self._extended(n, o, rows)
                    changes += [_change_json(made, name, n, o)] if made else []
                    continue
                empty = self.spark.createDataFrame([], known.schema)
                sides = (o, a, b) if backwards else (o, b, a)
                frames = [self._load(n, e) if e is not None else empty for e in sides]
                moved[n] = self._snapshot(n, history.cherry_pick(*frames, known.keys), known.keys)

            def build() -> dict | None:
                now = self._at(name)
                if self._visible(now) != ours:
                    return None
                picked, commit = self._committed(
                    replace(now, tables={**now.tables, **moved}), describe(row["message"], value), author, None
                )
                return _record("replay", [picked], by=author, commit=commit, changes=changes)

            made = self._publish(build)
            if made is not None:
                return made["commit"]["hash"]

    # --- checkpoints and stashes ------------------------------------------------------------

    def _pins(self, kind: str, name: str) -> DataFrame:
        rows = self._records.table().where("pin IS NOT NULL").select("seq", "pin.*")
        latest = query.latest_per(rows, ["id"], ["seq"])
        return latest.where(
            (F.col("kind") == kind) & (F.col("branch") == name) & (F.col("status") == "active")
        )

    def _held(self, kind: str, name: str) -> list[dict]:
        """Live pins of a branch, newest first."""
        self._follow()
        found = [p for p in self._pinned.values() if (p["kind"], p["branch"]) == (kind, name)]
        return sorted(found, key=lambda p: (p["created_at"], p["seq"]), reverse=True)

    def _drop(self, pin: dict, states: list[Branch] = [], action: str = "unpin") -> None:
        dropped = {k: v for k, v in pin.items() if k != "seq"} | {"status": "dropped"}
        self._publish(lambda: _record(action, states, pin=dropped))

    def checkpoint(self, name: str, label: str | None = None, by: str = "checkpoint-system") -> str:
        """Commit a branch and pin its tables, in one step; returns the checkpoint id."""
        id = uuid.uuid4().hex[:8]
        label = label or f"checkpoint-{id}"

        def build() -> dict:
            branch, commit = self._committed(self._at(name), f"[checkpoint] {label}", by, None)
            pin = _pin_json(id, "checkpoint", name, label, commit["hash"], by, self._visible(branch))
            return _record("checkpoint", [branch], by=by, commit=commit, pin=pin)

        self._publish(build)
        return id

    def checkpoints(self, name: str) -> DataFrame:
        return self._pins("checkpoint", name).orderBy(F.desc("created_at"), F.desc("seq"))

    def restore(self, name: str, id: str) -> dict[str, int]:
        """Put the tables of a checkpoint back; empty tables vanish, the head stays."""
        found = [p for p in self._held("checkpoint", name) if p["id"] == id]
        if not found:
            raise KeyError(f"{name!r} has no checkpoint {id!r}")
        tables = {n: e for n, e in _entries(found[0]["tables"]).items() if e.row_count}
        since = self.log(name).where(F.col("hash") == found[0]["commit_hash"]).collect()
        self._save(name, "restore", lambda b: replace(b, tables=tables))
        return {
            "tables_restored": len(tables),
            "rows_restored": sum(e.row_count for e in tables.values()),
            "commits_rolled_back": since[0]["pos"] if since else 0,
        }

    def delete_checkpoint(self, name: str, id: str) -> bool:
        found = [p for p in self._held("checkpoint", name) if p["id"] == id]
        for pin in found:
            self._drop(pin)
        return bool(found)

    def prune_checkpoints(self, name: str, keep: int = 5) -> int:
        """Drop all but the newest checkpoints of a branch."""
        old = self._held("checkpoint", name)[keep:]
        for pin in old:
            self._drop(pin)
        return len(old)

    def stash(self, name: str, message: str = "", by: str = "unknown") -> str:
        """Set the rows of all tables aside and leave the tables empty, in one step."""
        id = uuid.uuid4().hex[:8]

        def build() -> dict:
            branch = self._at(name)
            full = {n: e for n, e in self._visible(branch).items() if e.row_count}
            if not full:
                raise ValueError(f"{name!r} has no rows to set aside")
            empty = {n: self._empty(n, e) for n, e in full.items()}
            pin = _pin_json(id, "stash", name, message, branch.head_commit, by, full)
            return _record("stash", [replace(branch, tables={**branch.tables, **empty})], by=by, pin=pin)

        self._publish(build)
        return id

    def stashes(self, name: str) -> DataFrame:
        """Stashes of a branch with their position, 0 for the newest."""
        return query.stack_positions(self._pins("stash", name), ["branch"], "seq").orderBy("position")

    def _stash_at(self, name: str, position: int) -> dict:
        held = self._held("stash", name)
        if not 0 <= position < len(held):
            raise KeyError(f"{name!r} has no stash number {position}")
        return held[position]

    def pop_stash(self, name: str) -> None:
        """Put the newest stash back, next to rows written since."""
        pin = self._stash_at(name, 0)
        branch = self.branch(name)
        now = self.visible(branch)
        back = {}
        for n, e in _entries(pin["tables"]).items():
            current = now.get(n)
            if current is None or not current.row_count:
                back[n] = e
            else:
                both = self._load(n, current).unionByName(self._load(n, e), allowMissingColumns=True)
                back[n] = self._snapshot(n, both, e.keys)
        self._drop(pin, [replace(branch, tables={**branch.tables, **back})], "pop")

    def drop_stash(self, name: str, position: int = 0) -> None:
        self._drop(self._stash_at(name, position))

    # --- garbage --------------------------------------------------------------------------------

    def _paths(self, entries: DataFrame) -> DataFrame:
        """Folders that ``table, e`` (versions by table) are made of."""
        shape = F.substring(F.sha2("e.columns", 256), 1, 8)
        under = F.concat(F.lit(f"{self.root}/changes/"), "table", F.lit("/"), shape, F.lit("/change="))
        ids = F.array_union("e.deltas", "e.trail")
        paths = F.concat(F.array("e.base"), F.transform(ids, lambda i: F.concat(under, i)))
        return entries.select("table", F.explode(paths).alias("path")).distinct()

    def garbage(self) -> DataFrame:
        """``table, path``: folders that no live branch, commit or pin refers to."""
        records = self._records.table()
        self._follow()

        def of(df: DataFrame, column: str) -> DataFrame:
            return df.select(F.explode(column).alias("table", "e"))

        states = self.reflog()
        pins = records.where("pin IS NOT NULL").select("seq", "pin.*")
        live_pins = query.latest_per(pins, ["id"], ["seq"]).where("status = 'active'")
        live_states = query.latest_per(states, ["name"], ["seq"]).where("status = 'active'")
        known = self._paths(of(states, "tables").union(of(pins, "tables")))
        live = self._paths(
            of(live_states, "tables").union(of(live_pins, "tables")).union(of(self.commits(), "snapshot"))
        )
        gone = records.select(F.explode("cleaned").alias("path"))
        # A logged change set is history, whoever made it.
        logged = self._logged(None, None, None).select(
            F.concat(F.lit(f"{self.root}/changes/"), "table", F.lit("/"), F.substring(F.sha2("columns", 256), 1, 8), F.lit("/change="), "id").alias("path")
        )
        return known.join(live.select("path").union(gone).union(logged), "path", "left_anti").select("table", "path")

    def collect_garbage(self) -> dict[str, int]:
        """Retire merged and deleted branches and delete unreferenced folders."""

        def build() -> dict | None:
            stale = [b for b in self._live.values() if b.status in ("merged", "deleted")]
            return _record("remove", [replace(b, status="removed", tables={}) for b in stale]) if stale else None

        self._follow()
        retired = self._publish(build)
        folders = [r["path"] for r in self.garbage().toLocalIterator()]
        self._records.delete(folders)
        if folders:
            self._publish(lambda: _record("clean", [], cleaned=folders))
        return {"branches": len(retired["states"]) if retired else 0, "folders": len(folders)}


def _record(action: str, states: list[Branch], by: str | None = None, **parts) -> dict:
    made = {"at": _stamp(_now()), "action": action, "by": by, "states": [_branch_json(b) for b in states]}
    return made | {k: v for k, v in parts.items() if v is not None}


def _change_json(made: str, branch: str, table: str, entry: Entry) -> dict:
    return {"id": made, "branch": branch, "table": table, "keys": entry.keys, "columns": entry.columns}


def _pin_json(id: str, kind: str, branch: str, label: str, commit: str | None, by: str, tables: dict[str, Entry]) -> dict:
    return {
        "id": id, "kind": kind, "branch": branch, "label": label, "commit_hash": commit, "created_by": by,
        "created_at": _stamp(_now()), "status": "active", "tables": _raw(tables),
    }


def _lanes(seen: dict) -> list[int]:
    return [int(seen[f"s{i}"]) for i in range(4)]


def _steps(held: DataFrame) -> DataFrame:
    """``pos, ids``: the change sets that lead from the next older version to each version.

    ``ids`` is null where versions do not follow each other by change sets. ``held`` has
    ``pos, entry``; commits without the table are passed over.
    """
    older = F.lead("entry").over(Window.orderBy("pos"))
    pairs = held.select("pos", "entry", older.alias("old")).where("old IS NOT NULL")
    n = F.size("old.deltas")

    def follows(ids: str) -> Column:
        return F.slice(f"entry.{ids}", F.lit(1), n) == F.col("old.deltas")

    def rest(ids: str) -> Column:
        return F.slice(f"entry.{ids}", n + 1, F.greatest(F.size(f"entry.{ids}") - n, F.lit(0)))

    alike = (F.col("entry.columns") == F.col("old.columns")) & (F.col("entry.keys") == F.col("old.keys"))
    same_base = F.col("entry.base") == F.col("old.base")
    from_old = F.col("entry.origin").eqNullSafe(F.col("old.base"))
    ids = F.when(alike & same_base & follows("deltas"), rest("deltas")).when(
        alike & from_old & follows("trail"), F.concat(rest("trail"), F.col("entry.deltas"))
    )
    return pairs.select("pos", ids.alias("ids"))
