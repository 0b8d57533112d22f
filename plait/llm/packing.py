"""Packing documents into sequences of a fixed length by swap-based local search."""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import written
from .common import batch_of, raw_bytes
from .tokens import encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(
    docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, the packed ``ids``.

    A document is its ids and ``end_id``. One that is longer than ``size`` is cut into
    pieces of that length, the last of which may be shorter. A null or empty text is
    the end id alone; repeated rows are documents of their own; a null ``doc_id`` stays.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
              ("length", pa.int64()), ("ids_crc32", pa.int64())]
    if with_ids:
        fields.append(("ids", pa.binary()))
    schema = pa.schema(fields)

    def cut(batches):
        enc = encoder(tokenizer)
        kind = f"<u{enc.width}"
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            packed = enc.packed(raw_bytes(batch.column(1)))
            for doc, own in zip(batch.column(0).to_pylist(), packed):
                ids = np.frombuffer(own + enc.pack(end_id), kind).astype("<u4")
                for number, start in enumerate(range(0, len(ids), size)):
                    part = ids[start : start + size].tobytes()
                    row = (doc, number, start, len(part) // 4, zlib.crc32(part), part)
                    for name, value in zip(out, row):
                        out[name].append(value)
            yield batch_of(schema, out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        cut, PIECE + (", ids binary" if with_ids else "")
    )


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Best fit in decreasing order: bins as lists of item numbers.

    A bit mask of the free spaces that occur gives the tightest bin in one shift.
    """
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins: list[list[int]] = []
    by_space: list[list[int]] = [[] for _ in range(size + 1)]
    mask = 0
    for i in order:
        need = lengths[i]
        fitting = mask >> need
        if fitting:
            space = need + (fitting & -fitting).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                mask &= ~(1 << space)
            bins[b].append(i)
        else:
            space, b = size, len(bins)
            bins.append([i])
        by_space[space - need].append(b)
        mask |= 1 << (space - need)
    return bins


def fewest(lengths: np.ndarray, size: int) -> int:
    """A lower bound of the bins: for each t, items over ``size - t`` stand alone, those
    over half need a bin each, and the rest fill what these leave, or more bins."""
    if not len(lengths):
        return 0
    sizes = np.sort(lengths)
    total = np.concatenate([[0], np.cumsum(sizes)])
    best = -(-int(total[-1]) // size)
    half = np.searchsorted(sizes, size // 2, "right")
    for t in np.unique(sizes[:half]):
        alone = np.searchsorted(sizes, size - t, "right")
        low = np.searchsorted(sizes, t, "left")
        large = len(sizes) - alone
        paired = alone - half
        room = paired * size - int(total[alone] - total[half])
        rest = int(total[half] - total[low]) - room
        best = max(best, large + paired + max(0, -(-rest // size)))
    return best


def improve(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Local search: moves, one-for-one and two-for-one exchanges between underfull bins.

    The least filled bin gives. Each step makes another bin fuller at its cost and
    raises the sum of squared fills, until the giver is empty or no step is left; then
    the next bin gives. Rounds follow until one brings no step (the sum can't rise for
    ever), or no packing can have fewer bins. Where steps of neighbouring lengths are used
    up, a round looks at all pairs of a bin's pieces.
    """
    least = fewest(np.asarray(lengths), size)
    fill = [sum(lengths[i] for i in b) for b in bins]
    live = len(bins)
    item, length, owner = [], [], []
    for b, members in enumerate(bins):
        if fill[b] < size:
            item += members
            length += [lengths[i] for i in members]
            owner += [b] * len(members)
    if live <= least or not item:
        return [b for b in bins if b]
    item, length, owner = np.array(item), np.array(length), np.array(owner)
    fills = np.array(fill)
    whole = False
    while live > least:
        moved = False
        for giver in sorted(set(owner.tolist()), key=lambda b: fills[b]):
            if live <= least or fills[giver] == size:
                break
            while fills[giver] and _step(giver, item, length, owner, fills, size, whole):
                moved = True
            live -= not fills[giver]
        if not moved and whole:
            break
        whole = not moved
    done: list[list[int]] = [b if fill[n] == size else [] for n, b in enumerate(bins)]
    for i, b in zip(item.tolist(), owner.tolist()):
        done[b].append(i)
    return [b for b in done if b]


def _pairs(length: np.ndarray, members: np.ndarray) -> list[tuple]:
    """One pair of the given pieces for each sum of lengths."""
    a, b = np.triu_indices(len(members), 1)
    _, first = np.unique(length[members[a]] + length[members[b]], return_index=True)
    return list(zip(members[a[first]], members[b[first]]))


def _step(giver, item, length, owner, fills, size, whole=False) -> bool:
    """Make the best step for this giver; False if none raises the squared fills.

    Of pairs of a bin's pieces, those of neighbouring lengths are tried or, if ``whole``,
    one for each sum that any two of them have.
    """
    space = size - fills
    mine = np.flatnonzero(owner == giver)
    mine = mine[np.argsort(-length[mine], kind="stable")]
    own = fills[giver]
    # Any bin that takes part must end up fuller than the giver was.
    open_bins = np.flatnonzero((fills > 0) & (space > 0))
    open_bins = open_bins[open_bins != giver]
    if not len(open_bins):
        return False
    for x in mine:  # move into the tightest bin that has room
        fits = open_bins[(space[open_bins] >= length[x]) & (fills[open_bins] + length[x] > own)]
        if len(fits):
            to = fits[np.argmin(space[fits])]
            fills[giver] -= length[x]
            fills[to] += length[x]
            owner[x] = to
            return True
    room = space[owner]
    free = (owner != giver) & (room > 0) & (fills[owner] > 0)
    pairs = _pairs(length, mine) if whole else [(x, y) for n, x in enumerate(mine[:-1]) for y in mine[n + 1 : n + 4]]
    for given in [(x,) for x in mine] + pairs:  # one or two of the giver's for one
        weight = int(length[list(given)].sum())
        gain = weight - length
        good = free & (gain > 0) & (gain <= room) & (fills[owner] + gain > own)
        if good.any():
            y = np.flatnonzero(good)[np.argmax(gain[good])]
            to, won = owner[y], int(gain[y])
            owner[list(given)] = to
            owner[y] = giver
            fills[giver] -= won
            fills[to] += won
            return True
    # One of the giver's for two of a bin's.
    if whole:
        both = [p for to in open_bins.tolist() for p in _pairs(length, np.flatnonzero(owner == to))]
        a, b = np.array(both, np.int64).reshape(-1, 2).T
    else:
        order = np.lexsort((length, owner))
        a, b = order[:-1], order[1:]
        same = (owner[a] == owner[b]) & free[a]
        a, b = a[same], b[same]
    for x in mine if len(a) else []:
        gain = length[x] - length[a] - length[b]
        good = (gain > 0) & (gain <= room[a]) & (fills[owner[a]] + gain > own)
        if good.any():
            n = np.flatnonzero(good)[np.argmax(gain[good])]
            to, won = owner[a[n]], int(gain[n])
            owner[x] = to
            owner[[a[n], b[n]]] = giver
            fills[giver] -= won
            fills[to] += won
            return True
    return False


def pack(
    docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, group_pieces: int = 4096
) -> DataFrame:
    """The pieces of ``docs`` with ``sequence_id`` and ``offset``, gapless from 0.

    Pieces are dealt at random into groups of about ``group_pieces``, each of which is
    packed on its own. A group leaves a few bins wide open (less than nine tenths full);
    their pieces are dealt into new, fewer groups and packed again, until one group holds
    all of these. Only lengths and numbers of pieces are moved. An empty table gives no rows; see ``pieces`` for
    nulls.
    """
    cut = written(pieces(docs, tokenizer, size, end_id), "pieces")
    groups = max(1, -(-cut.count() // group_pieces))

    def place(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.select(named)
        lengths = table["length"].to_pylist()
        bins = improve(best_fit(lengths, size), lengths, size)
        sequence = np.empty(len(lengths), np.int64)
        offset, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for b, members in enumerate(bins):
            at = 0
            for i in members:
                sequence[i], offset[i] = b, at
                at += lengths[i]
            fill[members] = at
        table = table.append_column("sequence_id", pa.array((key[0].as_py() << 32) + sequence))
        return table.append_column("offset", pa.array(offset)).append_column("fill", pa.array(fill))

    named = cut.columns

    def packed(rows: DataFrame, first: int, count: int) -> DataFrame:
        lot = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(count)).cast("long") + first
        dealt = rows.select(*named, lot.alias("grp"))
        made = dealt.groupBy("grp").applyInArrow(place, PIECE + ", sequence_id long, offset long, fill long")
        return written(made, "packed")

    done, first = [], 0
    while True:
        placed = packed(cut, first, groups)
        open_ = placed.where(F.col("fill") * 10 < size * 9)
        fewer = max(1, -(-open_.count() // group_pieces))
        if groups == 1 or fewer >= groups:
            done.append(placed)
            break
        done.append(placed.where(F.col("fill") * 10 >= size * 9))
        cut, first, groups = open_, first + groups, fewer
    return reduce(DataFrame.union, done).drop("fill")
