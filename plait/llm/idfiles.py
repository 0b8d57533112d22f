"""Binary files of token ids with Elias-Fano document boundaries.

One file is one shard:

    64 bytes   magic, documents, ids, null document ids, first document id, spread of
               the document ids, bytes of an id (big-endian numbers)
    ...        Elias-Fano sequence of the document ends, in ids
    ...        Elias-Fano sequence of the document ids, less the first
    ...        the ids of all documents, little-endian

An Elias-Fano sequence of n numbers up to u takes about n * (2 + log2(u / n)) bits:
low bits are packed, high bits stand in unary, and the place of every 256th number in
the unary part is noted, so a single number is found without reading the rest.
Shards follow each other in the order of the file names, and documents within them by
document id, nulls first.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import batch_of, raw_bytes
from .tokens import encoder

MAGIC = b"PLAITEF1"
HEADER = struct.Struct(">8sQQQqQI12x")
EVERY = 256


def _pack_bits(bits: np.ndarray) -> bytes:
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


class EliasFano:
    """A non-decreasing sequence of ``n`` numbers from 0 to ``top``."""

    def __init__(self, n: int, top: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray):
        self.n, self.top, self.low, self.high, self.marks = n, top, low, high, marks
        self.low_bits = self._low_bits(n, top)

    @staticmethod
    def _low_bits(n: int, top: int) -> int:
        return max(0, (top // n).bit_length() - 1) if n else 0

    @staticmethod
    def _sizes(n: int, top: int) -> tuple[int, int, int]:
        """Bytes of the low part, of the high part, and the number of marks."""
        k = EliasFano._low_bits(n, top)
        return -(-n * k // 8), -(-(n + (top >> k) + 1) // 8) if n else 0, -(-n // EVERY)

    @classmethod
    def of(cls, values: np.ndarray, top: int) -> "EliasFano":
        n = len(values)
        values = values.astype(np.uint64)
        k = cls._low_bits(n, top)
        places = (values >> np.uint64(k)).astype(np.int64) + np.arange(n)
        _, high_bytes, _ = cls._sizes(n, top)
        unary = np.zeros(high_bytes * 8, np.uint8)
        unary[places] = 1
        shifts = np.arange(k, dtype=np.uint64)
        low = (values[:, None] >> shifts) & np.uint64(1) if k else np.zeros((0, 0))
        part = lambda b: np.frombuffer(b, np.uint8)
        return cls(n, top, part(_pack_bits(low.ravel())), part(_pack_bits(unary)),
                   places[::EVERY].astype("<u4"))

    def to_bytes(self) -> bytes:
        return self.low.tobytes() + self.high.tobytes() + self.marks.tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int, n: int, top: int) -> tuple["EliasFano", int]:
        """The sequence that starts at byte ``at``, and the byte after it."""
        low, high, marks = cls._sizes(n, top)
        ends = np.cumsum([at, low, high, 4 * marks]).tolist()
        cut = [np.frombuffer(data[a:b], np.uint8) for a, b in zip(ends, ends[1:])]
        return cls(n, top, cut[0], cut[1], cut[2].view("<u4")), ends[-1]

    def _low(self, first: int, count: int) -> np.ndarray:
        k = self.low_bits
        if not k:
            return np.zeros(count, np.uint64)
        begin, end = first * k, (first + count) * k
        bits = np.unpackbits(self.low[begin // 8 : -(-end // 8)], bitorder="little")
        bits = bits[begin % 8 : begin % 8 + count * k].reshape(count, k).astype(np.uint64)
        return (bits << np.arange(k, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The number at place ``i``, from one stretch between two marks."""
        j = i // EVERY
        begin = int(self.marks[j])
        end = int(self.marks[j + 1]) if j + 1 < len(self.marks) else len(self.high) * 8
        bits = np.unpackbits(self.high[begin // 8 : end // 8 + 1], bitorder="little")
        bits[: begin % 8] = 0
        place = int(np.flatnonzero(bits)[i % EVERY]) + begin // 8 * 8
        return ((place - i) << self.low_bits) | int(self._low(i, 1)[0])

    def decode(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        return (high | self._low(0, self.n)).astype(np.int64)


def shard(doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    """One file; documents come in order, null ids first."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    spread = int(known[-1]) - first if len(known) else 0
    ends = EliasFano.of(np.cumsum(lengths, dtype=np.int64), len(ids) // width)
    keys = EliasFano.of(known.astype(np.uint64) - np.uint64(first % (1 << 64)), spread)
    head = HEADER.pack(
        MAGIC, len(doc_ids), len(ids) // width, len(doc_ids) - len(known), first, spread, width
    )
    return head + ends.to_bytes() + keys.to_bytes() + ids


class Shard:
    """Reads one file; ``span(i)`` touches only the stretch of one document."""

    def __init__(self, data: bytes):
        data = memoryview(data)
        magic, self.docs, n, self.nulls, first, spread, self.width = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        self.ends, at = EliasFano.read(data, HEADER.size, self.docs, n)
        self.keys, at = EliasFano.read(data, at, self.docs - self.nulls, spread)
        self.first = first
        self.ids = np.frombuffer(data[at : at + n * self.width], f"<u{self.width}")

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def doc_ids(self) -> list[int | None]:
        known = self.keys.decode().astype(object) + self.first
        return [None] * self.nulls + known.tolist()


def write(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_ids: int = 1 << 22
) -> None:
    """Encode whole texts and write the files, in ascending ``doc_id`` order.

    Tasks cover ranges of document ids, so a table of any size is one exchange of the
    texts; a file is closed at about ``shard_ids`` ids. Null texts are the end id
    alone, null document ids come first, repeated rows are written as often as they
    occur, and an empty table gives no file.
    """
    schema = pa.schema([("shard", pa.binary())])

    def encode(batches):
        enc = encoder(tokenizer)
        end = enc.pack(end_id)
        names, lengths, parts, held = [], [], [], 0
        for batch in batches:
            packed = enc.packed(raw_bytes(batch.column(1)))
            for doc, own in zip(batch.column(0).to_pylist(), packed):
                ids = own + end
                names.append(doc)
                lengths.append(len(ids) // enc.width)
                parts.append(ids)
                held += lengths[-1]
                if held >= shard_ids:
                    blob = shard(names, lengths, b"".join(parts), enc.width)
                    yield batch_of(schema, {"shard": [blob]})
                    names, lengths, parts, held = [], [], [], 0
        if names:
            blob = shard(names, lengths, b"".join(parts), enc.width)
            yield batch_of(schema, {"shard": [blob]})

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # Rows of one id are ordered by their texts' hash, and equal rows, of which any order
    # gives the same files, by place: no id has to go to one task.
    order = ["doc_id", "_hash", "_place"]
    ordered = ordered.withColumns({"_hash": F.xxhash64("text"), "_place": F.monotonically_increasing_id()})
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order).drop("_hash", "_place")
    # Spark has no writer of raw bytes, but its text writer passes a string's bytes on
    # unchanged and adds a line end, which the reader never looks at.
    (
        ordered.mapInArrow(encode, "shard binary")
        .select(F.col("shard").cast("string"))
        .write.option("maxRecordsPerFile", 1)
        .text(path)
    )


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, if asked for, the ``ids`` of each document.

    ``start`` counts the ids of all documents before it in all files; the checksum is
    that of the ids as little-endian unsigned 32-bit integers.
    """
    fields = [("file", pa.string()), ("doc_id", pa.int64()), ("at", pa.int64()),
              ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
    schema = pa.schema(fields)

    def decode(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = Shard(content.as_buffer())
                ends = part.ends.decode()
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                wide = part.ids.astype("<u4")
                spans = list(zip(starts.tolist(), ends.tolist()))
                raw = memoryview(wide).cast("B")
                columns = {
                    "file": [file] * part.docs,
                    "doc_id": part.doc_ids(),
                    "at": starts,
                    "n_tokens": ends - starts,
                    "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in spans],
                }
                if with_ids:
                    offsets = np.concatenate([starts, ends[-1:]]).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(offsets, wide.astype(np.int32))
                yield batch_of(schema, columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    number = lambda n: F.regexp_extract("path", r"part-(\d+)-.*?(?:-c(\d+))?[^-]*$", n)
    heads = files.select(
        F.col("path").alias("_file"),
        F.conv(F.hex(F.substring("content", 17, 8)), 16, 10).cast("long").alias("_ids"),
        number(1).cast("int").alias("_part"),
        F.coalesce(F.expr("try_cast(regexp_extract(path, '-c(\\\\d+)[^-]*$', 1) AS INT)"), F.lit(0)).alias("_no"),
    )
    # One row a file: this window holds a few numbers for every few million ids.
    earlier = Window.orderBy("_part", "_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = heads.select("_file", F.coalesce(F.sum("_ids").over(earlier), F.lit(0)).alias("_base"))
    rows = files.select("path", "content").mapInArrow(
        decode, "file string, doc_id long, at long, n_tokens long, ids_crc32 long"
        + (", ids array<int>" if with_ids else "")
    )
    return rows.join(bases, F.col("file") == F.col("_file")).select(
        "doc_id", (F.col("_base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32",
        *(["ids"] if with_ids else []),
    )
