"""Mixing sources to target weights by a low-discrepancy schedule of word blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written
from .common import WORD, before, unused

REPEATS = 3  # no source and no document is read more often


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources by code point, null last, weigh 1, 2, ... ``weights``, repeating, and share
    the sum of all sizes. A target stops at three times its source's size; the excess is
    shared again by weight. So a target is the smaller of that bound and a common level
    times the weight: with sources in the order of bound over weight, the level is the
    first that leaves no later source above its bound.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = ((F.row_number().over(by_name) - 1) % weights + 1).cast("double")
    bound = F.col("source_size").cast("double") * REPEATS
    rows = sizes.select("source", "source_size", weight.alias("w"), bound.alias("bound"))
    order = Window.orderBy(F.col("bound") / F.col("w"), F.col("source").isNull(), "source")
    later = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything).cast("double")
    level = (total - F.coalesce(F.sum("bound").over(earlier), F.lit(0.0))) / F.sum("w").over(later)
    rows = rows.withColumn("level", level)
    rows = rows.withColumn("turn", F.row_number().over(order))
    open_ = rows.withColumn("full", F.col("bound") <= F.col("level") * F.col("w"))
    # Sources that reach their bound come first; the level of the next one holds for all.
    common = F.min(F.when(~F.col("full"), F.struct("turn", "level"))).over(everything)
    target = F.when(F.col("full"), F.col("bound")).otherwise(F.col("w") * common["level"])
    return open_.select("source", "source_size", target.alias("target"))


def van_der_corput(i: Column, bits: int) -> Column:
    """The lowest ``bits`` bits of i in reverse order, as a number."""
    out = i
    for step, mask in (
        (1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F),
        (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF),
    ):
        up = F.shiftleft(out.bitwiseAND(F.lit(mask)), step)
        out = F.shiftrightunsigned(out, step).bitwiseAND(F.lit(mask)).bitwiseOR(up)
    out = F.shiftleft(out, 32).bitwiseOR(F.shiftrightunsigned(out, 32))
    return F.shiftrightunsigned(out, 64 - bits)


def schedule(plan: DataFrame, block: int) -> DataFrame:
    """``slot, source_no, block, epoch, words``: which block is read when.

    ``plan`` has ``source_no, source_size, goal``, the goal in whole words. Slots are as
    many as blocks of words in all goals. Slot i has the i-th van der Corput point, and
    the source in whose part of the cumulative weights the point falls; any stretch of
    slots so holds the sources nearly in proportion. A source's slots are ranked, and
    rank r reads block r of the source, over and over. What a source has too many slots
    for is dropped, what it lacks follows at the end, the last slot may be cut: goals
    are met to the word.
    """
    spark = plan.sparkSession
    total = plan.agg(F.coalesce(F.sum("goal"), F.lit(0))).first()[0]
    slots = -(-int(total) // block)
    bits = max(1, (slots - 1).bit_length())
    cells_bits = min(bits, max(0, (4 * plan.count() - 1).bit_length()))
    order = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("goal").over(order)
    scale = F.lit(float(1 << bits) / max(1, total))
    parts = plan.select(
        "*",
        F.ceil((upto - F.col("goal")).cast("double") * scale).alias("lo"),
        F.ceil(upto.cast("double") * scale).alias("hi"),
        # Whole passes, and the slots and words of the last one.
        F.ceil(F.col("source_size") / block).cast("long").alias("blocks"),
    )
    full = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.greatest("source_size", F.lit(1)))).otherwise(0)
    rest = F.col("goal") - full * F.col("source_size")
    parts = parts.withColumn("need", (full * F.col("blocks") + F.ceil(rest / block)).cast("long"))
    shift = bits - cells_bits
    cell = F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift)))
    ranges = parts.where("hi > lo").select("source_no", "lo", "hi", cell.alias("cell"))
    points = spark.range(slots).select(
        F.col("id").alias("slot"), van_der_corput(F.col("id"), bits).alias("point")
    ).withColumn("at", F.shiftrightunsigned("point", shift))
    taken = points.join(
        ranges, (F.col("at") == F.col("cell")) & (F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi"))
    ).select("slot", "source_no")
    ranked = before(taken, ["source_no"], ["slot"], F.lit(1), "rank", F.shiftright("slot", 10))
    held = taken.groupBy("source_no").agg(F.count("*").alias("held"))
    short = parts.join(held, "source_no", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    short = short.where("held < need").select(
        "source_no", F.explode(F.sequence("held", F.col("need") - 1)).alias("rank")
    )
    late = short.select((F.lit(slots) + F.col("rank")).alias("slot"), "source_no", "rank")
    blocks, size = F.col("blocks"), F.col("source_size")
    used = (
        ranked.select("slot", "source_no", "rank").union(late)
        .join(parts.drop("lo", "hi"), "source_no")
        .where("rank < need")
        .withColumn("epoch", F.floor(F.col("rank") / blocks))
        .withColumn("block", F.col("rank") % blocks)
    )
    inside = F.least(F.lit(block), size - F.col("block") * block)
    left = F.col("goal") - F.col("epoch") * size - F.col("block") * block
    return used.select("slot", "source_no", "block", "epoch", F.least(inside, left).cast("long").alias("words"))


# Copies of one row that a task deals out at a time.
COPIES = 4096


def _dealt(counted: DataFrame) -> DataFrame:
    """Each row as often as ``_copies`` says, ``mixed`` being a hash of its own."""
    batch = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / COPIES)))
    # Only batches of copies are moved; a row without copies stays where it is.
    many = counted.where(F.col("_copies") > COPIES).withColumn("_batch", batch).repartition("_own", "_batch")
    few = counted.where(F.col("_copies") <= COPIES).withColumn("_batch", F.lit(0).cast("long"))
    first = F.col("_batch") * COPIES
    last = F.least(first + COPIES, F.col("_copies")) - 1
    rows = few.unionByName(many).withColumn("_copy", F.explode(F.sequence(first, last)))
    mixed = F.when(F.col("_copy") == 0, F.col("_own")).otherwise(F.xxhash64("_own", "_copy"))
    return rows.withColumn("mixed", mixed).drop("_own", "_copies", "_batch", "_copy")


def mix(docs: DataFrame, keep: list[str] = ["doc_id"], block: int = 1024, seed: int = 17) -> DataFrame:  # noqa: B006
    """The long columns ``keep``, ``size, source_size, target, taken`` for every row.

    ``size`` is the number of words, ``taken`` the words that the mix reads, repeats
    counted: the blocks of ``block`` words of each source, its documents in shuffled
    order, joined with the slots of the ``schedule``. A document is read at most three
    times over. Null and empty texts have no words and give none; a null source is a
    source; repeated rows are documents of their own; equal input gives equal output.
    """
    chosen = [F.col(c).cast("long").alias(c) for c in keep]
    # The order hangs on what a document is, not on where its row happens to stand: equal
    # rows are counted and then dealt out by number, so that they spread like any others.
    ident = [F.col("doc_id")] if "doc_id" in docs.columns else [F.col(c) for c in keep]
    rows = docs.select(*chosen, F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
                       F.xxhash64(F.lit(seed), F.xxhash64("text"), *ident).alias("_own"))
    counted = written(rows.groupBy(*rows.columns).agg(F.count("*").alias("_copies")), "sizes")
    rows = _dealt(counted)
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    plan = targets(sums.select("source", "source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    plan = plan.select("*", F.row_number().over(by_name).cast("long").alias("source_no"),
                       F.round("target").cast("long").alias("goal"))
    plan = written(plan.join(sums.select(F.col("source").alias("_s"), "docs"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "plan")
    # Chunks of about 128 documents, in the order of the hash.
    chunks = F.greatest(F.lit(1), F.shiftright("docs", 7))
    near = (F.shiftrightunsigned("mixed", 33) * chunks / F.lit(float(1 << 31))).cast("long")
    of = plan.select("source_no", F.col("source").alias("_s"), "docs")
    numbered = rows.join(of, F.col("source").eqNullSafe(F.col("_s"))).withColumn("near", near)
    order = [F.shiftrightunsigned("mixed", 1), F.col("mixed"), *keep]
    some = numbered.where("size > 0").select(*keep, "size", "source_no", "mixed", "near")
    placed = before(some, ["source_no"], order, F.col("size"), "start", F.col("near"))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    spread = placed.select(
        *keep, "size", "source_no", "start", F.explode(F.sequence(first, last)).alias("piece")
    ).select(
        "*",
        F.greatest(F.lit(0), F.col("start") - F.col("piece") * block).alias("lo"),
        F.least(F.lit(block), F.col("start") + F.col("size") - F.col("piece") * block).alias("hi"),
    )
    # How often a block is read in full, and how far by the one slot that may be cut.
    inside = schedule(plan.select("source_no", "source_size", "goal"), block).join(
        plan.select(F.col("source_no").alias("_n"), F.col("source_size").alias("_size")), F.col("source_no") == F.col("_n")
    )
    whole = F.least(F.lit(block), F.col("_size") - F.col("block") * block)
    reads = inside.groupBy("source_no", F.col("block").alias("piece")).agg(
        F.count_if(F.col("words") == whole).alias("full"),
        F.coalesce(F.max(F.when(F.col("words") < whole, F.col("words"))), F.lit(0)).alias("cut"),
    )
    part = F.greatest(F.lit(0), F.least(F.col("hi"), F.coalesce("cut", F.lit(0))) - F.col("lo"))
    words = F.coalesce("full", F.lit(0)) * (F.col("hi") - F.col("lo")) + part
    taken = spread.join(reads, ["source_no", "piece"], "left").groupBy("source_no", "start").agg(
        *[F.first(c).alias(c) for c in [*keep, "size"]], F.sum(words).cast("long").alias("taken")
    )
    none = numbered.where("size = 0").select(
        "source_no", *keep, "size", F.lit(0).cast("long").alias("taken")
    )
    out = taken.select("source_no", *keep, "size", "taken").union(none)
    return out.join(plan.select("source_no", "source_size", "target"), "source_no").select(
        *keep, "size", "source_size", "target", "taken"
    )


def mixed_documents(docs: DataFrame, block: int = 1024) -> DataFrame:
    """The rows of ``docs`` as often as the mix reads them, with all columns.

    A document is given once for every time it is read to the end; the one document of a
    source at which its words run out is given up to the last word read, with ``n_chars``
    to match, if there is such a column.
    """
    row, taken, size, part, of = (unused(docs, n) for n in ("_row", "_taken", "_size", "_part", "_of"))
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    counts = mix(placed, [row], block).where("taken > 0").select(
        F.col(row).alias(of), F.col("taken").alias(taken), F.col("size").alias(size)
    )
    joined = placed.join(counts, F.col(row) == F.col(of))
    last = F.col(taken) % F.col(size)
    times = F.array_repeat(F.col(size), F.floor(F.col(taken) / F.col(size)).cast("int"))
    parts = F.when(last > 0, F.array_append(times, last)).otherwise(times)
    spread = joined.withColumn(part, F.explode(parts))
    # The first words of a text: the shortest beginning that ends with the last of them.
    beginning = F.expr(f"regexp_extract(text, concat('^(?:[\\\\x20\\\\x09-\\\\x0D]*+[^\\\\x20\\\\x09-\\\\x0D]++){{', {part}, '}}+'), 0)")
    text = F.when(F.col(part) < F.col(size), beginning).otherwise(F.col("text"))
    out = spread.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(part) < F.col(size), F.length("text")).otherwise(F.col("n_chars"))
                             .cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
