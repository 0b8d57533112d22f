"""Language identification by prediction by partial matching."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch_of, raw_bytes, slices, unused

UNDETERMINED = "und"
ORDER = 3  # the longest context, in bytes
UNIT = 1 << 12  # code lengths are whole numbers of 1/4096 bit
SLICE = 1 << 19


def _fold() -> np.ndarray:
    """Bytes as the models see them: ASCII letters in lower case, all that stands for no
    letter as a space; bytes of other scripts stay."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


FOLD = _fold()


def _folded(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array, runs of spaces as one, each text starting with a space;
    and where the texts begin."""
    joined = np.frombuffer(b" " + b" ".join(t or b"" for t in texts), np.uint8)
    sizes = np.array([len(t or b"") + 1 for t in texts])
    starts = np.cumsum(sizes) - sizes
    joined = FOLD[joined]
    space = joined == 32
    kept = np.ones(len(joined), bool)
    kept[1:] = ~(space[1:] & space[:-1])
    kept[starts] = True
    return joined[kept], (np.cumsum(kept) - 1)[starts]


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """The number made of each byte and the ``n - 1`` before it; spaces stand in front."""
    padded = np.concatenate([np.full(n - 1, 32, np.uint8), data])
    out = np.zeros(len(data), np.int64)
    for i in range(n):
        out = (out << 8) | padded[i : i + len(data)]
    return out


class _Places:
    """Finds numbers in a fixed set: open addressing, a whole array at a time."""

    def __init__(self, keys: np.ndarray):
        self.shift = 64 - max(4, int(4 * len(keys)).bit_length())
        self.slots = np.full(1 << (64 - self.shift), -1, np.int64)
        self.rows = np.zeros(len(self.slots), np.int32)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            empty = self.slots[at] == -1
            self.slots[at[empty]] = keys[left[empty]]  # the last one of a clash stays
            mine = self.slots[at] == keys[left]
            self.rows[at[mine]] = left[mine]
            left, at = left[~mine], self._next(at[~mine])

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(self.shift)).astype(np.int64)

    def _next(self, at: np.ndarray) -> np.ndarray:
        return (at + 1) & (len(self.slots) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 if it is not in the set."""
        at = self._home(keys)
        held = self.slots[at]
        out = np.where(held == keys, self.rows[at], -1)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        at = at[open_]
        while len(open_):
            at = self._next(at)
            held = self.slots[at]
            hit = held == keys[open_]
            out[open_[hit]] = self.rows[at[hit]]
            on = ~hit & (held != -1)
            open_, at = open_[on], at[on]
        return out


class Models:
    """One context tree of bytes per language, with frozen counts.

    A byte seen c times after a context that holds t bytes of d kinds costs
    -log2(c / (t + d)); one not seen there costs an escape, -log2(d / (t + d)), and then
    what it costs after the context without its first byte. Below the empty context all
    256 bytes are alike. Costs of all byte strings seen in any language are worked out
    once; any other string is an escape and a shorter string, so a code length is exact.
    """

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """``counts[n]`` has strings of n + 1 bytes as numbers, languages, and how often."""
        self.languages = languages
        width = len(languages)
        self.found, self.cost, self.escape = [], [], []
        flat = np.full((1, width), 8.0)
        for n, (gram, language, count) in enumerate(counts):
            keys = np.unique(gram)
            seen = np.zeros((len(keys), width))
            np.add.at(seen, (np.searchsorted(keys, gram), language), count)
            contexts, of = np.unique(keys >> 8, return_inverse=True)
            total, kinds = np.zeros((2, len(contexts), width))
            np.add.at(total, of, seen)
            np.add.at(kinds, of, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(kinds > 0, np.log2((total + kinds) / kinds), 0.0)
                own = np.log2((total + kinds)[of] / seen)
            shorter = self._exact(n - 1, keys & ((1 << 8 * n) - 1)) if n else flat.repeat(len(keys), 0)
            cost = np.where(seen > 0, own, escape[of] + shorter)
            self.found.append((_Places(keys), _Places(contexts)))
            self.cost.append(cost)
            self.escape.append(escape)
        self.cost = [np.rint(c * UNIT).astype(np.int32) for c in self.cost]
        self.escape = [np.rint(e * UNIT).astype(np.int32) for e in self.escape]

    def _exact(self, n: int, grams: np.ndarray) -> np.ndarray:
        """Costs of strings of n + 1 bytes; unlike any, they escape to shorter ones."""
        width = len(self.languages)
        if n < 0:
            return np.full((len(grams), width), 8 * (UNIT if self.cost and self.cost[0].dtype == np.int32 else 1.0))
        row = self.found[n][0].find(grams)
        out = self.cost[n][row]
        new = np.flatnonzero(row < 0)
        if len(new):
            left = grams[new]
            context = self.found[n][1].find(left >> 8)
            paid = np.where((context >= 0)[:, None], self.escape[n][context], 0)
            out[new] = paid + self._exact(n - 1, left & ((1 << 8 * n) - 1))
        return out

    def lengths(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Code length by text and language in 1/4096 bit, and the bytes coded."""
        data, starts = _folded(texts)
        ends = np.concatenate([starts[1:], [len(data)]])
        costs = self._exact(ORDER, _grams(data, ORDER + 1))
        first = starts[:, None] + np.arange(ORDER)[None, :]
        inside = first < ends[:, None]
        # The first bytes of a text must not see the text before it.
        lone = [_grams(data[a : min(a + ORDER, b)], ORDER + 1) for a, b in zip(starts.tolist(), ends.tolist())]
        costs[first[inside]] = self._exact(ORDER, np.concatenate(lone))
        return np.add.reduceat(costs, starts, axis=0, dtype=np.int64), ends - starts


# Characters of a text that are drawn together.
PIECE = 16_384


def held_out(doc_id: str = "doc_id"):
    """Documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, bytes_per_language: int = 3_000_000) -> Models | None:
    """Models of the languages named by ``lang`` in the rows that are not held out.

    Of each language a sample of about ``bytes_per_language`` bytes is drawn by a hash of
    whole texts or, of longer ones, of pieces of 16,384 characters, one piece at least;
    it bounds the counts, which are the only thing the driver sees. Texts without ASCII
    or other letters and rows without a language teach nothing; None if no row does.
    """
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = rows.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"[A-Za-z\x{80}-\x{10FFFF}]"))
    long = F.octet_length("text") > PIECE
    pieces = F.when(long, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).otherwise(F.array("text"))
    rows = rows.select("lang", "doc_id", F.posexplode(pieces).alias("part", "text"))
    # Copies of a text under other ids, and equal pieces of one text, are drawn apart.
    lot = F.pmod(F.xxhash64("text", "doc_id", "part"), F.lit(1 << 20))
    rows = rows.select("text", "lang", lot.alias("lot"))
    sums = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.min("lot").alias("least"))
    sums = sums.collect()
    sizes = {r.lang: r.bytes for r in sums}
    if not sizes:
        return None
    languages = sorted(sizes)
    lots = {r.lang: max(r.least + 1, int(min(1.0, bytes_per_language / r.bytes) * (1 << 20))) for r in sums}
    limit = F.create_map(*[x for l in languages for x in (F.lit(l), F.lit(lots[l]))])
    number = F.create_map(*[x for i, l in enumerate(languages) for x in (F.lit(l), F.lit(i))])
    sample = rows.where(F.col("lot") < limit[F.col("lang")]).select(number[F.col("lang")].alias("language"), "text")
    schema = pa.schema([("n", pa.int32()), ("language", pa.int32()), ("gram", pa.int64()), ("count", pa.int64())])

    def count(batches):
        for batch in batches:
            language = batch.column(0).to_numpy()
            texts = raw_bytes(batch.column(1))
            for a, b in slices([len(t) for t in texts], SLICE):
                for own in np.unique(language[a:b]):
                    some = [texts[i] for i in range(a, b) if language[i] == own]
                    # Each text alone: no string may reach into the next one.
                    data, starts = _folded(some)
                    cuts = [data[x:y] for x, y in zip(starts, [*starts[1:], len(data)])]
                    for n in range(ORDER + 1):
                        gram, times = np.unique(np.concatenate([_grams(c, n + 1) for c in cuts]), return_counts=True)
                        yield batch_of(schema, {"n": np.full(len(gram), n, np.int32), "language": np.full(len(gram), own, np.int32),
                                                "gram": gram, "count": times})

    counted = sample.mapInArrow(count, "n int, language int, gram long, count long")
    counted = counted.groupBy("n", "language", "gram").agg(F.sum("count").alias("count")).toArrow()
    n, language, gram, times = (counted.column(c).to_numpy() for c in ("n", "language", "gram", "count"))
    return Models(languages, [(gram[n == i], language[n == i], times[n == i]) for i in range(ORDER + 1)])


def _judge(models: Models | None, texts: list[bytes | None], lettered: list[bool]):
    """Language, score and bits a byte of each text; undetermined without letters."""
    pred, score, rate = [], [], []
    for a, b in slices([len(t or b"") for t in texts], SLICE):
        if models is None:
            pred += [UNDETERMINED] * (b - a)
            score += [0.0] * (b - a)
            rate += [None] * (b - a)
            continue
        bits, size = models.lengths(texts[a:b])
        best = bits.argmin(1)
        least = bits[np.arange(b - a), best]
        share = 1 / np.exp2((least[:, None] - bits) / UNIT).sum(1)
        for known, n, own, bits_per_byte in zip(lettered[a:b], best.tolist(), share.tolist(), (least / UNIT / size).tolist()):
            pred.append(models.languages[n] if known else UNDETERMINED)
            score.append(own if known else 0.0)
            rate.append(bits_per_byte if known else None)
    return pred, score, rate


def _lettered():
    return F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, bits_per_byte`` for every row of ``docs``.

    ``lang_pred`` is the language whose model codes the whole text in the fewest bits
    (ties: the first by name), ``score`` its share of the probability that all models
    give the text. A text that is null or has no letter is ``und`` with score 0, and so
    is every text if nothing could be learned. Null ids are not held out; repeated rows
    are answered one by one.
    """
    models = train(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()),
                        ("bits_per_byte", pa.float64())])

    def run(batches):
        for batch in batches:
            found = _judge(models, raw_bytes(batch.column(1)), batch.column(2).to_pylist())
            yield batch_of(schema, dict(zip(schema.names, [batch.column(0), *found])))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _lettered().alias("lettered"))
    found = rows.mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def keep_languages(docs: DataFrame, most_bits: float = 8.0) -> DataFrame:
    """The rows of ``docs`` that are text in one of its languages, with all columns.

    Rejected are texts without letters and those that the best model codes in
    ``most_bits`` a byte or more, that is no better than unread bytes. A row without
    ``lang`` gets the language found. Rows pass through whole, so nothing is shuffled.
    If no row teaches a language (``train``), nothing can be judged: every text with
    letters stays, and ``lang`` as it is.
    """
    models = train(docs)
    if models is None:
        return docs.where(_lettered())
    lettered = unused(docs, "_lettered")
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches):
        for batch in batches:
            pred, _, rate = _judge(models, raw_bytes(batch.column(text)), batch.column(batch.num_columns - 1).to_pylist())
            columns = batch.columns[:-1]
            own = columns[lang].to_pylist()
            columns[lang] = pa.array([o if o is not None else p for o, p in zip(own, pred)], columns[lang].type)
            good = pa.array([r is not None and r < most_bits for r in rate], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1]).filter(good)

    return docs.withColumn(lettered, _lettered()).mapInArrow(run, docs.schema)
