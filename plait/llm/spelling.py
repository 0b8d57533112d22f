"""Spelling variants of a corpus's words, found by a bit-sliced position index."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import written
from .common import batch_of, raw_bytes, slices

# Letters: A-Z, a-z and U+00C0 to U+00FF, whose UTF-8 forms are C3 80 to C3 BF.
_LETTER = rb"(?:[A-Za-z]|\xc3[\x80-\xbf])"

# Distinct words a task holds before it hands on their counts.
HELD_WORDS = 500_000

# Words in one index; larger groups are split.
BLOCK_WORDS = 4096

# At most so many groups are told apart as large ones.
LARGE_GROUPS = 100_000


def corpus_words(
    df: DataFrame, damaged: int | None = None, shortest: int = 7, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``word, n``: how often each word of at least ``shortest`` letters occurs.

    Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF) of whole texts with A-Z
    in lower case; a null text has none, and a text of any length is read whole.

    ``damaged`` plants typing errors: where it divides the CRC-32 ``h`` of ``key:run``
    (UTF-8, a null key is an empty text), the run loses its letter ``h % length``.

    A task counts before it hands anything on, so neither a frequent word nor a group of
    copies reaches one task whole.
    """
    runs = re.compile(_LETTER + rb"{%d,}" % shortest)
    counted = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def flushed(held: Counter) -> pa.RecordBatch:
        made = batch_of(counted, {"word": [w.decode() for w in held], "n": list(held.values())})
        held.clear()
        return made

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            ids, texts = raw_bytes(batch.column(0)), raw_bytes(batch.column(1))
            for begin, end in slices([len(t or b"") for t in texts], 4 << 20):
                for ident, body in zip(ids[begin:end], texts[begin:end]):
                    found = runs.findall((body or b"").lower())
                    if damaged is None:
                        held.update(found)
                        continue
                    start = zlib.crc32((ident or b"") + b":")
                    for run, times in Counter(found).items():
                        h = zlib.crc32(run, start)
                        if h % damaged == 0:
                            letters = run.decode()
                            if len(letters) <= shortest:
                                continue
                            at = h % len(letters)
                            run = (letters[:at] + letters[at + 1 :]).encode()
                        held[run] += times
                if len(held) > HELD_WORDS:
                    yield flushed(held)
        yield flushed(held)

    named = df.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t"))
    return named.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class PositionIndex:
    """For each position and letter, the set of words with that letter there.

    Sets are bit vectors over the words, as whole numbers, so one operation on them treats
    all words at once. Longer words come first: few have a letter at a far position, and
    their sets stay short.
    """

    def __init__(self, words: list[str]):
        self.words = sorted(words, key=len, reverse=True)
        self.at: dict[tuple[int, str], int] = {}
        self.lengths: dict[int, int] = {}
        for j, word in enumerate(self.words):
            bit = 1 << j
            self.lengths[len(word)] = self.lengths.get(len(word), 0) | bit
            for place in enumerate(word):
                self.at[place] = self.at.get(place, 0) | bit
        self.all = (1 << len(words)) - 1

    def near(self, word: str) -> list[str]:
        """The indexed words that one inserted, deleted or replaced letter makes of ``word``.

        ``same`` holds the words that agree so far; the three others those with one error
        behind them: a replaced letter, one more letter (positions shifted up) or one less
        (positions shifted down).
        """
        same, replaced, more, less = self.all, 0, 0, 0
        at = self.at.get
        for i, letter in enumerate(word):
            before, here, after = (at((j, letter), 0) for j in (i - 1, i, i + 1))
            less = less & before | same
            more = (more | same) & after
            replaced = replaced & here | same & ~here
            same &= here
            if not (same or replaced or more or less):
                return []
        size = len(word)
        length = self.lengths.get
        bits = replaced & length(size, 0) | (more | same) & length(size + 1, 0) | less & length(size - 1, 0)
        found = []
        while bits:
            low = bits & -bits
            found.append(self.words[low.bit_length() - 1])
            bits ^= low
        return found


def _half(word: str, length: int, side: int) -> str:
    """The part by which a word meets indexed words of ``length`` on one side."""
    size = length // 2
    return word[len(word) - size :] if side else word[:size]


def _half_of(word: Column, length: Column, side: Column) -> Column:
    size = F.floor(length / 2).cast("int")
    front = F.substring(word, F.lit(1), size)
    return F.when(side == 1, F.substring(word, F.length(word) - size + 1, size)).otherwise(front)


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, n_near, best_n, best``: near words and the most frequent of them.

    ``words`` holds ``word, n`` with unique words. Two words are near if they differ by
    exactly one inserted, deleted or replaced letter. One error leaves the first or the
    last ``L // 2`` letters of the indexed word (of ``L`` letters) in both words, so a word
    looks only among words of its length and one more or less that share such a half;
    those that share both are taken on the first side only. Groups of words with the
    same half are put together into indexes; groups with more than 4096 words are split into
    several, and each word asks all of them. Only counts and the best word leave a task,
    never pairs.
    """
    words = words.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n"))
    words = written(words.where("word is not null and word <> ''"), "words")
    total = words.count()
    buckets = max(1, -(-8 * total // 100_000), min(-(-total // 1000), 3 * words.sparkSession.sparkContext.defaultParallelism))
    sides = F.explode(F.array(F.lit(0), F.lit(1)))
    kept = words.withColumn("side", sides).withColumn("length", F.length("word"))
    asked = words.withColumn("side", sides).withColumn(
        "length", F.explode(F.array(*[F.length("word") + d for d in (-1, 0, 1)]))
    )
    group = F.xxhash64("side", "length", _half_of(F.col("word"), F.col("length"), F.col("side")))
    kept, asked = kept.withColumn("group", group), asked.withColumn("group", group)
    # No more than 2 * total rows lie in groups, so this many groups at most are large.
    large = max(BLOCK_WORDS, -(-2 * total // LARGE_GROUPS))
    groups = kept.groupBy("group").count().where(F.col("count") > large)
    groups = written(groups.select(F.col("group").alias("_g"), F.ceil(F.col("count") / BLOCK_WORDS).cast("int").alias("parts")), "large")

    def split(rows: DataFrame, part: Column) -> DataFrame:
        rows = rows.join(F.broadcast(groups), F.col("group") == F.col("_g"), "left")
        rows = rows.withColumn("part", part)
        return rows.withColumn("bucket", F.pmod(F.xxhash64("group", "part"), F.lit(buckets)))

    parts = F.coalesce("parts", F.lit(1))
    kept = split(kept, F.pmod(F.xxhash64("word"), parts).cast("int"))
    asked = split(asked, F.explode(F.sequence(F.lit(0), parts - 1)))
    columns = ["bucket", "group", "part", "side", "length", "word", "n"]
    rows = kept.select(*columns, F.lit(False).alias("asks")).unionByName(asked.select(*columns, F.lit(True).alias("asks")))
    # Words that meet no indexed group are still asked, and answer with nothing.
    found = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def search(table: pa.Table) -> pa.Table:
        out = {f.name: [] for f in found}
        table = table.sort_by([("group", "ascending"), ("part", "ascending"), ("asks", "ascending")])
        names = table["word"].to_pylist()
        counts, sides, lengths, asks = (table[c].to_pylist() for c in ("n", "side", "length", "asks"))
        groups = list(zip(table["group"].to_pylist(), table["part"].to_pylist()))
        current, held, indexes = None, {}, {}
        for i, word in enumerate(names):
            if groups[i] != current:
                current, held, indexes = groups[i], {}, {}
            half = (sides[i], lengths[i], _half(word, lengths[i], sides[i]))
            if not asks[i]:
                held.setdefault(half, {})[word] = counts[i]
                continue
            known = held.get(half)
            if known is None:
                continue
            if half not in indexes:
                indexes[half] = PositionIndex(list(known))
            near = indexes[half].near(word)
            if half[0]:
                front = _half(word, half[1], 0)
                near = [w for w in near if _half(w, half[1], 0) != front]
            if near:
                best = min(near, key=lambda w: (-known[w], w))
                for column, value in zip(out.values(), (word, len(near), known[best], best)):
                    column.append(value)
        return pa.Table.from_batches([batch_of(found, out)])

    met = rows.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(
        search, "word string, n_near long, best_n long, best string"
    )
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    none = F.lit(None)
    every = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), none.cast("long").alias("best_n"), none.cast("string").alias("best"))
    met = met.withColumn("n", none.cast("long")).unionByName(every)
    met = met.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("top"))
    return met.select("word", "n", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"))


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of ``word, n`` (unique words).

    A word's form is its near word of largest ``n`` (ties: the smallest in code-point
    order) if that is at least ``ratio`` times the word's own, else null; its root is the
    end of the chain of forms, the word itself if it has none. ``n_near`` counts near
    words and ``form_n`` is the form's ``n``. Rows with a null or empty word are left out;
    no words give no rows; a word of any length is compared whole.

    Each form is at least ``ratio`` times as frequent, so chains are short; they are
    followed by doubling, and each step is written.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their variants")
    found = near_words(words)
    takes = F.col("best_n") >= F.col("n") * ratio
    found = found.select(
        "word", F.when(takes, F.col("best")).alias("form"), "n", "n_near", F.when(takes, F.col("best_n")).alias("form_n")
    )
    found = written(found, "forms")
    tops = written(found.where("form is not null").select("word", F.col("form").alias("root")), "tops")
    while True:
        nexts = tops.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        moved = tops.join(nexts, F.col("root") == F.col("_word"), "left")
        if not moved.where("_root is not null").limit(1).count():
            break
        tops = written(moved.select("word", F.coalesce("_root", "root").alias("root")), "tops")
    tops = tops.withColumnRenamed("word", "_word")
    return found.join(tops, F.col("word") == F.col("_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
