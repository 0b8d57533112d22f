"""Deploy requests: a merge that is proposed, reviewed and then carried out.

A request is a record in the store's log; its newest one counts. Approval remembers the
position in the log, and a request whose branches have logged a change since then is
not carried out. The merge and the request's end are one record.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..operators import diff, history, merge as mg, query
from ..operators.keys import key_text
from .store import Store, _now, _record, _stamp

OPEN, APPROVED, REJECTED, MERGED = "open", "approved", "rejected", "merged"


class Requests:
    def __init__(self, store: Store):
        self.store = store

    def table(self) -> DataFrame:
        """The newest state of every request."""
        rows = self.store._records.table().where("request IS NOT NULL").select("seq", "request.*")
        return query.latest_per(rows, ["id"], ["seq"])

    def list(self, status: str | None = None, target: str | None = None) -> DataFrame:
        """Requests newest first."""
        return history.list_requests(self.table(), status, target)

    def get(self, id: str) -> dict:
        rows = self.table().where(F.col("id") == id).collect()
        if not rows:
            raise KeyError(f"no deploy request {id!r}")
        found = rows[0].asDict()
        found["created_at"] = found["created_at"].strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        found.pop("seq")
        return found

    def _in(self, id: str, status: str) -> dict:
        found = self.get(id)
        if found["status"] != status:
            raise ValueError(f"deploy request {id!r} is {found['status']}, not {status}")
        return found

    def _put(self, request: dict, action: str, by: str | None) -> None:
        self.store._publish(lambda: _record(action, [], by=by, request=request))

    def open(self, source: str, target: str, description: str, by: str) -> str:
        """Propose to merge ``source`` into ``target``; counts what differs now."""
        for name in (source, target):
            self.store.branch(name)
        same = self.table().where((F.col("source") == source) & (F.col("target") == target))
        if not same.where(F.col("status").isin(*history.OPEN_STATES)).isEmpty():
            raise ValueError(f"a deploy request from {source!r} to {target!r} is open")
        found = diff.diff_summary(self.store.diff(source, target), ["change"]).collect()
        id = uuid.uuid4().hex[:8]
        request = {
            "id": id, "source": source, "target": target, "description": description, "status": OPEN,
            "created_by": by, "created_at": _stamp(_now()), "changes": {r["change"]: r["rows"] for r in found},
        }
        self._put(request, "propose", by)
        return id

    def approve(self, id: str, by: str) -> None:
        """Approve an open request as its branches are now."""
        found = self._in(id, OPEN)
        self._put({**found, "status": APPROVED, "reviewed_by": by, "approval_seq": self.store.position(), "reason": None}, "approve", by)

    def reject(self, id: str, by: str, reason: str) -> None:
        found = self._in(id, OPEN)
        self._put({**found, "status": REJECTED, "reviewed_by": by, "reason": reason}, "reject", by)

    def reopen(self, id: str, by: str) -> None:
        """Put an approved request back to review, as after :class:`ValueError` for staleness."""
        self._put({**self._in(id, APPROVED), "status": OPEN, "approval_seq": None}, "reopen", by)

    def execute(self, id: str, gate: list[mg.Check] | None = None) -> dict:
        """Merge an approved request; raises if it is stale, rejected by a check or conflicting.

        A stale request keeps its state and the reason. A merge that fails changes nothing.
        """
        found = self._in(id, APPROVED)
        log = self.store._logged(None, None, found["approval_seq"]).select("branch", "seq")
        stale = history.stale_approvals(self.table().where(F.col("id") == id), log).collect()
        if stale:
            reason = stale[0]["reason"]
            self._put({**found, "reason": reason}, "stale", None)
            raise ValueError(f"deploy request {id!r} needs another review: {reason}")
        done = self.store.merge(
            found["source"], found["target"], "manual", found["reviewed_by"],
            f"Deploy {id}: {found['source']} into {found['target']}", gate=gate,
            together={"request": {**found, "status": MERGED, "reason": None}},
        )
        if done["success"]:
            return done
        if done.get("reason"):
            raise ValueError(f"deploy request {id!r} is refused: {done['reason']}")
        raise ValueError(f"deploy request {id!r} has conflicts: {conflict_names(done['conflicts'])}")


def conflict_names(conflicts: dict[str, DataFrame], n: int = 3) -> str:
    """The first ``n`` conflicts as ``table/key:field``."""
    names = []
    for table, found in sorted(conflicts.items()):
        if len(names) < n:
            keys = [c for c in found.columns if c not in ("field", "base", "ours", "theirs")]
            text = F.concat(F.lit(f"{table}/"), key_text(found, keys), F.lit(":"), "field")
            names += [r["t"] for r in found.select(*keys, "field", text.alias("t")).orderBy(*keys, "field").limit(n - len(names)).collect()]
    return ", ".join(names)
