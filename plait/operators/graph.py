"""Ancestry over commit graphs, for many heads at once.

Walks start at the heads they are asked for and take several generations in one job;
only long first-parent chains go on by pointer doubling, so their length costs a
logarithmic number of joins. Every step is written to the shared folder, which keeps
plans small and lets a lost executor restart from the last step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..session import written


def edges(commits: DataFrame) -> DataFrame:
    """``hash, parent`` for every parent of every commit."""
    return commits.select("hash", F.explode("parents").alias("parent"))


def first_parents(commits: DataFrame) -> DataFrame:
    return commits.select("hash", F.get("parents", 0).alias("parent")).where("parent IS NOT NULL")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def _paths(start: DataFrame, links: DataFrame, hops: int) -> DataFrame:
    """``start`` (with ``hash``) with ``path``: the next ``hops`` nodes of every way on, shorter at a root.

    ``links`` has ``hash, far``. One chain of joins; nothing is computed twice.
    """
    at = start.withColumn("p0", F.col("hash"))
    for i in range(hops):
        step = links.select(F.col("hash").alias(f"p{i}"), F.col("far").alias(f"p{i + 1}"))
        at = at.join(step, f"p{i}", "left")
    path = F.array_compact(F.array(*[f"p{i + 1}" for i in range(hops)]))
    return at.select(*start.columns, path.alias("path"))


def commit_log(commits: DataFrame, heads: DataFrame, limit: int | None = None, hops: int = 16) -> DataFrame:
    """First-parent chain of each head: ``branch, hash, pos`` with 0 the newest.

    ``heads`` has ``branch, hash``. The first rounds walk ``hops`` commits each from the
    heads alone; chains that go on are followed by doubling links of that length. A
    cycle ends the walk only through ``limit``.
    """
    commits = written(commits.select("hash", "parents"), "commits")
    known = commits.select("hash")
    first = first_parents(commits).join(known.withColumnRenamed("hash", "parent"), "parent", "left_semi")
    first = first.select("hash", F.col("parent").alias("far"))
    start = heads.join(known, "hash", "left_semi").select("branch", "hash", F.lit(0).cast("long").alias("pos"))
    parts, covered = [start], 0
    for _ in range(4):
        if limit is not None and covered >= limit - 1:
            break
        steps = _paths(start, first, hops).select("branch", "pos", F.posexplode("path").alias("i", "hash"))
        added = written(steps.select("branch", "hash", (F.col("pos") + F.col("i") + 1).alias("pos")), "chain")
        parts.append(added)
        covered += hops
        start = added.where(F.col("pos") == covered)
        if start.isEmpty():
            covered = None
            break
    if covered is not None and (limit is None or covered < limit - 1):
        parts += _doubled(first, start, covered, limit)
    chain = _union(parts)
    return chain if limit is None else chain.where(F.col("pos") < limit)


def _doubled(first: DataFrame, start: DataFrame, covered: int, limit: int | None) -> list[DataFrame]:
    """The rest of the chains from ``start`` at position ``covered``, by pointer doubling."""
    parts, jump, step = [written(start, "chain")], first, 1
    while limit is None or covered + step < limit:
        longer = _union(parts).join(jump, "hash").select(
            "branch", F.col("far").alias("hash"), (F.col("pos") + step).alias("pos")
        )
        added = written(longer, "chain")
        if added.isEmpty():
            break
        parts.append(added)
        step *= 2
        far = jump.select(F.col("hash").alias("far"), F.col("far").alias("__on"))
        jump = written(jump.join(far, "far").select("hash", F.col("__on").alias("far")), "jump")
    return parts[1:]


def ancestors(
    commits: DataFrame, heads: DataFrame, max_depth: int | None = None, hops: int = 8
) -> DataFrame:
    """All ancestors of each head: ``head, hash, depth``; safe on cycles.

    The head itself has depth -1 and its parents depth 0; the smallest depth wins. A
    round walks twice ``hops`` generations from the nodes the last one has ended at.
    """
    walk = _Walk(commits, heads, hops)
    while not walk.ended and (max_depth is None or walk.covered < max_depth):
        walk.advance()
    found = walk.found().groupBy("head", "hash").agg(F.min("depth").alias("depth"))
    return found if max_depth is None else found.where(F.col("depth") <= max_depth)


class _Walk:
    """Breadth-first walks from many heads, a few generations at a time.

    ``found`` has every ancestor met so far, more than once where ways of different
    length lead to it.
    """

    def __init__(self, commits: DataFrame, heads: DataFrame, hops: int):
        # With generations no way leads back, so nodes met again need no second look.
        self.layered = "generation" in commits.columns
        level = F.col("generation") if self.layered else F.lit(None)
        commits = written(commits.select("hash", "parents", level.cast("long").alias("level")), "commits")
        known = commits.select(F.col("hash").alias("far"), "level")
        links = edges(commits).select("hash", F.col("parent").alias("far")).distinct()
        # A node carries its level, so that none is looked up again.
        self.links = written(links.join(known, "far").select("hash", F.struct("far", "level").alias("far")), "links")
        own = heads.select("hash").distinct().join(commits.select("hash", "level"), "hash")
        node = F.struct(F.col("hash").alias("far"), "level")
        front = own.select(F.col("hash").alias("head"), "hash", F.lit(-1).alias("depth"), "level", node.alias("node"))
        self.front = written(front, "found")
        self.parts, self.covered, self.hops, self.ended = [self.front], -1, hops, False

    def found(self) -> DataFrame:
        return _union(self.parts)

    def _reached(self, front: DataFrame, covered: int) -> DataFrame:
        """Nodes up to ``hops`` generations from ``front``, each at its least depth."""
        at = front.select("head", F.col("node").alias("p0"))
        for i in range(self.hops):
            step = self.links.select(F.col("hash").alias(f"__h{i}"), F.col("far").alias(f"p{i + 1}"))
            at = at.join(step, F.col(f"p{i}.far") == F.col(f"__h{i}"), "left").drop(f"__h{i}")
        path = F.array_compact(F.array(*[f"p{i + 1}" for i in range(self.hops)]))
        steps = at.select("head", F.posexplode(path).alias("i", "node"))
        nearest = steps.groupBy("head", F.col("node.far").alias("hash")).agg(
            F.min("i").alias("i"), F.any_value("node").alias("node")
        )
        depth = (F.col("i") + (covered + 1)).cast("int").alias("depth")
        return nearest.select("head", "hash", depth, F.col("node.level").alias("level"), "node")

    def advance(self) -> None:
        """Walk on twice as far as ways are followed one by one: in between they are joined."""
        near = self._reached(self.front, self.covered)
        middle = self.covered + self.hops
        far = self._reached(near.where(F.col("depth") == middle), middle)
        both = near.union(far)
        if not self.layered:
            both = self._new(both)
        self.covered += 2 * self.hops
        last = F.col("depth") == self.covered
        newer, goes_on = _counted(both, "found", F.count_if(last))
        self.parts.append(newer)
        self.front = newer.where(last)
        self.ended = not goes_on

    def _new(self, reached: DataFrame) -> DataFrame:
        """Nodes not found before, each once, at the least depth; ways may lead back."""
        once = reached.groupBy("head", "hash").agg(
            F.min("depth").alias("depth"), F.any_value("level").alias("level"), F.any_value("node").alias("node")
        )
        # Only heads that are still walked are looked up.
        seen = self.found().select("head", "hash").join(self.front.select("head").distinct(), "head", "left_semi")
        return once.join(seen, ["head", "hash"], "left_anti")

    def keep(self, heads: DataFrame) -> None:
        """Walk on from these heads only."""
        self.front = self.front.join(heads, "head", "left_semi")


def _counted(df: DataFrame, label: str, count: Column) -> tuple[DataFrame, int]:
    """``df`` written, and a count taken in the same pass."""
    watch = Observation()
    out = written(df.observe(watch, count.alias("n")), label)
    return out, watch.get["n"]


def common_ancestor(commits: DataFrame, pairs: DataFrame, hops: int = 8) -> DataFrame:
    """Merge base of each pair ``a, b`` of commits: ``a, b, base, depth``.

    The base is the common ancestor (a head counts as its own) nearest to ``b``;
    ties go to the smaller hash. Pairs without one are missing.

    Both sides of all pairs are walked at once, and a pair leaves when its base is
    certain. ``commits`` may have a ``generation``, larger than that of all parents: an
    ancestor of ``a`` that is not found yet then has a smaller one than the nodes the
    walk from ``a`` stands at, so nodes of ``b`` above these are no common ancestors.
    Without it a pair leaves when the walk from ``a`` has ended or ``b`` itself is met.
    """
    pairs = written(pairs.select("a", "b").distinct(), "pairs")
    heads = pairs.select(F.explode(F.array("a", "b")).alias("hash"))
    walk = _Walk(commits, heads, hops)
    bases, open_ = [], pairs
    while True:
        walk.advance()
        found = walk.found().select("head", "hash", "depth", "level")
        sides = F.explode(F.array(F.struct(F.col("a").alias("head"), F.lit(True).alias("mine")),
                                  F.struct(F.col("b").alias("head"), F.lit(False).alias("mine"))))
        met = open_.select("a", "b", sides.alias("s")).select("a", "b", "s.*").join(found, "head")
        # All that concerns a pair in one place: one shuffle for both groupings.
        nodes = met.repartition("a", "b").groupBy("a", "b", "hash").agg(
            F.max("mine").alias("met"), F.min(F.when(~F.col("mine"), F.col("depth"))).alias("depth"), F.any_value("level").alias("level")
        )
        # How high the walk from a still stands; null where it has ended.
        stands = walk.front.groupBy(F.col("head").alias("a")).agg(
            F.max(F.coalesce("level", F.lit((1 << 63) - 1))).alias("stands")
        )
        both = nodes.where("depth IS NOT NULL").join(stands, "a", "left")
        below = F.col("level").isNull() | (F.col("level") < F.col("stands"))
        unsure = ~F.col("met") & below & F.col("stands").isNotNull()
        judged = both.groupBy("a", "b").agg(
            F.min(F.when(F.col("met"), F.struct("depth", "hash"))).alias("m"),
            F.min(F.when(unsure, F.col("depth"))).alias("unsure"),
        )
        sure = F.col("m").isNotNull() & (F.col("unsure").isNull() | (F.col("m.depth") < F.col("unsure")))
        judged, left = _counted(judged, "judged", F.count_if(~sure))
        bases.append(judged.where(sure).select("a", "b", F.col("m.hash").alias("base"), F.col("m.depth").alias("depth")))
        if walk.ended or not left:
            break
        open_ = judged.where(~sure).select("a", "b")
        walk.keep(open_.select(F.explode(F.array("a", "b")).alias("head")).distinct())
    return _union(bases)


def nesting_depth(nodes: DataFrame, name: str = "name", parent: str = "parent") -> DataFrame:
    """Distance of every node from its root: ``name, depth``, 0 for a root."""
    at = written(
        nodes.select(
            F.col(name).alias("name"),
            F.col(parent).alias("up"),
            F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("depth"),
        ),
        "depth",
    )
    while not at.where("up IS NOT NULL").isEmpty():
        open_ = at.where("up IS NOT NULL")
        target = at.select(
            F.col("name").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2")
        )
        moved = open_.join(target, "up", "left").select(
            "name",
            F.col("up2").alias("up"),
            (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"),
        )
        at = written(at.where("up IS NULL").unionByName(moved), "depth")
    return at.select("name", "depth")


def nesting_allowed(depths: DataFrame, limit: int = 5) -> DataFrame:
    """Whether a node at this depth may be created."""
    return depths.withColumn("allowed", F.col("depth") <= limit)


def branch_heads(branches: DataFrame, commits: DataFrame) -> DataFrame:
    """``branch, hash``: main by its newest commit, others by their pointer."""
    main = (
        commits.where("branch = 'main'")
        .groupBy("branch")
        .agg(F.max_by("hash", F.struct("ts", "hash")).alias("hash"))
    )
    others = branches.where("name <> 'main'").select(
        F.col("name").alias("branch"), F.col("head_commit").alias("hash")
    )
    return main.union(others.where("hash IS NOT NULL"))
