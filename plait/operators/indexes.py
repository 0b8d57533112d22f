"""Stored search structures: word statistics of texts and cells of vectors.

Both are made once, kept up by change sets and read only where a search needs them.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.vectors import cosine
from ..session import written
from .search import BM25_B, BM25_K1, words

# Rows and queries of a cell that one task scores.
BLOCK_ROWS = 8192
BLOCK_QUERIES = 4096


class TextIndex:
    """Postings by term, document lengths and totals under a shared folder.

    A generation holds the postings of the texts added at one time, in folders by bucket of
    the term; generation 0 is the first load. A changed or dropped text is put on a list of
    replaced keys, which hides its older postings. A search reads the buckets of its
    terms and the narrow lists, never a text.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, fields: list[str], buckets: int = 256):
        self.spark, self.path, self.key, self.fields, self.buckets = spark, path.rstrip("/"), key, fields, buckets

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _add(self, df: DataFrame, generation: int) -> None:
        """Store a generation's postings and lengths; a text is split once."""
        split = df.select(F.col(self.key).alias("doc"), words(F.concat_ws(" ", *self.fields)).alias("w"))
        lengths = split.select("doc", F.size("w").cast("long").alias("n"))
        lengths.write.mode("error").parquet(f"{self.path}/lengths/gen={generation}")
        # A text is one row, so its words are counted there: runs of the sorted words.
        ordered = split.select("doc", F.array_sort("w").alias("w"))
        starts = F.filter(
            F.transform("w", lambda x, i: F.struct(x.alias("term"), i.alias("at"))),
            lambda s: (s["at"] == 0) | (s["term"] != F.get("w", s["at"] - 1)),
        )
        runs = ordered.select("doc", F.size("w").alias("n"), starts.alias("s"))
        ends = F.transform("s", lambda s, i: F.struct(
            s["term"].alias("term"), (F.coalesce(F.get("s", i + 1)["at"], F.col("n")) - s["at"]).cast("long").alias("tf")
        ))
        counted = runs.select("doc", F.inline(ends)).withColumn("bucket", self._bucket(F.col("term")))
        # Frequent terms spread over tasks: one part of a bucket per hash of the document.
        parts = counted.repartition("bucket", F.pmod(F.xxhash64("doc"), F.lit(8)))
        parts.sortWithinPartitions("bucket", "term").write.mode("error").partitionBy("bucket").parquet(
            f"{self.path}/postings/gen={generation}"
        )

    def build(self, df: DataFrame) -> TextIndex:
        self._add(df, 0)
        key = df.schema[self.key].dataType.simpleString()
        none = self.spark.createDataFrame([], f"doc {key}")
        none.write.parquet(f"{self.path}/replaced/gen=0")
        return self

    def apply(self, changes: DataFrame, generation: int) -> None:
        """Keep up with a change set ``key, before, after`` (structs); generations count up."""
        after = F.struct(*[F.col("after")[c].alias(c) for c in dict.fromkeys([self.key, *self.fields])])
        # Read three times below, and what it is made from costs a shuffle of all texts.
        changes = written(changes.select(
            F.col("key")[self.key].alias("doc"), F.col("before").isNotNull().alias("had"),
            F.when(F.col("after").isNotNull(), after).alias("after"),
        ), "changes")
        old = changes.where("had").select("doc")
        old.write.mode("error").parquet(f"{self.path}/replaced/gen={generation}")
        self._add(changes.where("after IS NOT NULL").select("after.*"), generation)

    def _live(self, folder: str) -> DataFrame:
        """Rows of texts as they are now: none older than the generation that replaced them."""
        rows = self.spark.read.parquet(f"{self.path}/{folder}")
        gone = self.spark.read.parquet(f"{self.path}/replaced")
        gone = gone.groupBy(F.col("doc").alias("__doc")).agg(F.max("gen").alias("__gen"))
        newer = (F.col("doc") == F.col("__doc")) & (F.col("gen") < F.col("__gen"))
        return rows.join(gone, newer, "left_anti")

    def search(self, terms: list[str], k: int | None = None) -> DataFrame:
        """Rows with any of the terms, ranked by BM25: key, ``score``."""
        terms = [t.lower() for t in terms]
        lengths = self._live("lengths")
        buckets = [r[0] for r in self.spark.range(1).select(F.explode(F.array(*[self._bucket(F.lit(t)) for t in terms]))).collect()]
        postings = self._live("postings").where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        place = F.array_position(F.array(*map(F.lit, terms)), F.col("term")) - 1
        by_doc = postings.groupBy("doc").agg(
            *[F.coalesce(F.sum(F.when(place == i, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i in range(len(terms))]
        )
        totals = lengths.agg(F.struct(F.count("*").alias("rows"), F.sum("n").alias("words")).alias("s")).scalar()
        found = by_doc.agg(
            F.struct(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).alias("s")
        ).scalar()
        mean = totals["words"] / totals["rows"]
        parts = []
        for i in range(len(terms)):
            tf, df = F.col(f"tf{i}"), found[f"df{i}"]
            idf = F.log(1 + (totals["rows"] - df + 0.5) / (df + 0.5))
            norm = tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("n") / mean)
            parts.append(idf * tf * (BM25_K1 + 1) / norm)
        scored = by_doc.join(lengths.select("doc", "n"), "doc")
        ranked = scored.select(
            F.col("doc").alias(self.key), F.round(reduce(lambda a, b: a + b, parts), 6).alias("score")
        ).orderBy(F.desc("score"), self.key)
        return ranked if k is None else ranked.limit(k)


class VectorCells:
    """Vectors in folders by cell of a coarse quantiser, for nearest neighbours by cosine.

    Cell centres are k-means centres of unit vectors, fitted to a sample of about
    ``sample_rows`` rows; every vector goes to the cells of its ``spill`` nearest centres. A
    search reads the cells of the centres nearest to each query and scores their rows
    exactly; with all cells it is exact. Zero vectors have no direction and are left out.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, vector: str):
        self.spark, self.path, self.key, self.vector = spark, path.rstrip("/"), key, vector

    def build(
        self, df: DataFrame, cells: int = 64, spill: int = 2, sample_rows: int = 100_000, seed: int = 7
    ) -> VectorCells:
        rows = df.select(self.key, F.col(self.vector).cast("array<double>").alias("__v"))
        length = F.sqrt(F.aggregate("__v", F.lit(0.0), lambda a, x: a + x * x))
        units = rows.withColumn("__l", length).where("__l > 0")
        share = min(1.0, sample_rows / max(1, rows.count()))
        sample = units.where(F.pmod(F.xxhash64(self.key, F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)))
        sample = sample.select(array_to_vector(F.transform("__v", lambda x: x / F.col("__l"))).alias("unit"))
        means = KMeans(k=cells, seed=seed, featuresCol="unit").fit(sample)
        # One row per cell.
        centres = [(i, [float(x) for x in c]) for i, c in enumerate(means.clusterCenters())]
        self.spark.createDataFrame(centres, "cell int, centre array<double>").coalesce(1).write.parquet(f"{self.path}/centres")
        own = self._nearest(units.select(self.key, "__v"), spill)
        placed = own.select(self.key, "__v", "__near", F.posexplode("__near").alias("__n", "cell"))
        placed = placed.select(self.key, "__v", F.slice("__near", F.lit(1), F.col("__n")).alias("before"), "cell")
        # A crowded cell is written by several tasks.
        spread = placed.withColumnRenamed("__v", self.vector).repartition("cell", F.pmod(F.xxhash64(self.key), F.lit(8)))
        spread.write.mode("error").partitionBy("cell").parquet(f"{self.path}/cells")
        return self

    def _nearest(self, rows: DataFrame, count: int) -> DataFrame:
        """Add ``__near``: the cells of the ``count`` centres nearest to ``__v``."""
        centres = self.spark.read.parquet(f"{self.path}/centres")
        every = centres.agg(F.collect_list(F.struct("cell", "centre")).alias("c")).scalar()  # one entry a cell
        far = F.transform(
            "__c", lambda c: F.struct((-cosine(F.col("__v"), c["centre"])).alias("far"), c["cell"].alias("cell"))
        )
        return rows.withColumn("__c", every).withColumn("__near", F.slice(F.array_sort(far), 1, count)["cell"]).drop("__c")

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """``query``, key, ``score``: the ``k`` nearest rows of each query's ``probes`` cells.

        ``queries`` has ``query`` (its key, never its own neighbour) and ``v``. A query
        meets the cells by their centres; a row that stands in two of its cells is met in
        the first of them. A cell's rows and the queries that probe it are dealt into
        blocks of bounded size; a task scores one block of rows for one of queries and
        hands on the ``k`` best of each query.
        """
        asked = queries.select("query", F.col("v").cast("array<double>").alias("__v"))
        asked = self._nearest(asked, probes).withColumn("cell", F.explode("__near"))
        asked = written(asked.withColumn("no", F.monotonically_increasing_id()), "asked")
        rows = self.spark.read.parquet(f"{self.path}/cells").withColumn("no", F.monotonically_increasing_id())
        rows = rows.select("cell", "no", F.col(self.key).alias("key"), F.col(self.vector).alias("__v"), "before")
        # One entry a cell: into how many blocks both sides are dealt.
        sizes = written(_blocks(rows, BLOCK_ROWS, "blocks").join(_blocks(asked, BLOCK_QUERIES, "asks"), "cell"), "blocks")
        tiles = sizes.agg(F.sum(F.col("blocks") * F.col("asks"))).first()[0] or 1
        parts = tiles if tiles > 256 else 4 * tiles  # while they are few, few share a task

        def dealt(df: DataFrame, own: str, other: str):
            """Every row to one block of its side, and to all of the other side's."""
            at, every = F.pmod(F.xxhash64("no"), F.col(own)), F.sequence(F.lit(0).cast("long"), F.col(other) - 1)
            placed = df.join(sizes, "cell").withColumns({f"{own}_at": at, f"{other}_at": F.explode(every)})
            placed = placed.drop("no", "blocks", "asks")
            tile = ["cell", "blocks_at", "asks_at"]
            return placed.repartition(parts, *tile).groupBy(*tile)

        key = rows.schema["key"].dataType
        own = F.col("query").try_cast(key).alias("own")
        asked = asked.select("cell", "no", "query", own, "__v", "__near")
        out = T.StructType([asked.schema["query"], T.StructField(self.key, key), T.StructField("score", T.DoubleType())])

        def score(rows: pa.Table, asks: pa.Table) -> pa.Table:
            asked, found, scores = _best(rows, asks, k)
            return pa.table({"query": asks["query"].take(asked), out.names[1]: rows["key"].take(found), "score": scores})

        met = dealt(rows, "blocks", "asks").cogroup(dealt(asked, "asks", "blocks")).applyInArrow(score, out)
        scored = met.withColumn("score", F.round("score", 9))
        best = Window.partitionBy("query").orderBy(F.desc("score"), self.key)
        return scored.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= k).drop("__r")


def _blocks(df: DataFrame, most: int, name: str) -> DataFrame:
    return df.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("long").alias(name))


def _matrix(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as rows filled up with zeros, their lengths (null: -1), and whether they hold no null."""
    lists = column.combine_chunks()
    lengths = lists.value_lengths().fill_null(-1).to_numpy()
    flat = lists.flatten()
    there = np.arange(width)[None, :] < lengths[:, None]
    out, null = np.zeros((len(lists), width)), np.zeros((len(lists), width), bool)
    out[there] = flat.fill_null(0.0).to_numpy()
    null[there] = flat.is_null().to_numpy(zero_copy_only=False)
    return out, lengths, (lengths >= 0) & ~null.any(1)


def _dots(a: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Inner products of rows with columns, added up dimension by dimension as ``cosine`` does."""
    total = np.zeros((len(a), columns.shape[1]))
    for x, y in zip(a.T, columns):
        total += x[:, None] * y[None, :]
    return total


def _ninth(values: np.ndarray) -> np.ndarray:
    """Billionths, rounded as Spark's ``round`` does: half away from zero on the decimal text. NaN is the largest."""
    size = np.abs(values) * 1e9
    whole = np.floor(size + 0.5)
    for i in np.flatnonzero(np.abs(size - np.floor(size) - 0.5) < 1e-5).tolist():
        text = Decimal(repr(abs(float(values[i]))))
        whole[i] = float(text.scaleb(9).to_integral_value(ROUND_HALF_UP))
    return np.where(np.isnan(values), np.inf, np.copysign(whole, values))


def _best(rows: pa.Table, asks: pa.Table, k: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The ``k`` best rows of each query of one tile: places of both and unrounded cosines.

    Ties go to the smaller key. A query without a whole vector has null scores.
    """
    asked, found, scores = [], [], []
    if rows.num_rows and asks.num_rows:
        order = pc.sort_indices(rows, sort_keys=[("key", "ascending")], null_placement="at_start")
        rows = rows.take(order)
        width = max(pc.max(pc.list_value_length(t["__v"])).as_py() or 0 for t in (rows, asks))
        x, lengths, _ = _matrix(rows["__v"], width)
        q, asked_lengths, whole = _matrix(asks["__v"], width)
        keys = rows["key"].combine_chunks().dictionary_encode(null_encoding="encode")
        codes = keys.indices.to_numpy()
        own = pc.index_in(asks["own"].combine_chunks(), value_set=keys.dictionary).fill_null(-1).to_numpy().copy()
        own[asks["query"].is_valid().to_numpy() & asks["own"].is_null().to_numpy()] = -1
        earlier = rows["before"].to_pylist()
        known = np.full((len(x), max(1, max(map(len, earlier)))), -1)
        for i, cells in enumerate(earlier):
            known[i, : len(cells)] = cells
        columns = np.ascontiguousarray(x.T)
        with np.errstate(all="ignore"):
            norms = np.sqrt(_own_dots(x)), np.sqrt(_own_dots(q))
        near = asks["__near"].to_pylist()
        for start in range(0, len(q), 8):
            with np.errstate(all="ignore"):
                norm = norms[0][None, :] * norms[1][start : start + 8, None]
                values = np.where(norm == 0, np.nan, _dots(q[start : start + 8], columns) / norm)
            for i, value in enumerate(values, start):
                probed = np.zeros(max(known.max(), *near[i]) + 2, bool)
                probed[near[i]] = True
                met = np.flatnonzero((codes != own[i]) & ~probed[known].any(1))
                if asked_lengths[i] >= 0 and (lengths[met] != asked_lengths[i]).any():
                    raise ValueError("vectors differ in length")
                if not whole[i]:
                    best, cosines = met[:k], [None] * len(met[:k])
                else:
                    # A row below the k-th by more than the rounding is none of the best.
                    ranked = np.where(np.isnan(value[met]), np.inf, value[met])
                    if len(met) > k:
                        fit = ranked >= np.partition(ranked, -k)[-k] - 1e-9
                        met = met[fit]
                    best = met[np.lexsort((met, -_ninth(value[met])))[:k]]
                    cosines = value[best].tolist()
                asked += [i] * len(best)
                found += order.take(pa.array(best)).to_pylist()
                scores += cosines
    return pa.array(asked, pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.float64())


def _own_dots(a: np.ndarray) -> np.ndarray:
    total = np.zeros(len(a))
    for x in a.T:
        total += x * x
    return total
