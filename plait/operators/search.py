"""Vector and text search, and fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vectors import cosine
from ..session import written

# Usual constants of the ranking formulas.
RANK_CONSTANT = 60
BM25_K1 = 1.2
BM25_B = 0.75


def vector_topk(
    df: DataFrame, id_column: str, vector: str, query: list[float], k: int
) -> DataFrame:
    """The ``k`` rows nearest to one query vector: ``id, score``.

    A scan with a per-task top-k, so nothing but ``k`` rows per task is moved.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = df.select(id_column, F.round(cosine(F.col(vector), q), 9).alias("score"))
    return scored.orderBy(F.desc("score"), id_column).limit(k)


def words(text: Column) -> Column:
    """Lower-case words of a text; anything but letters and digits separates."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _occurrences(array: str, term: str) -> Column:
    return F.size(array) - F.size(F.array_remove(array, term))


def text_search(
    df: DataFrame, id_column: str, terms: list[str], fields: list[str], k: int | None = None
) -> DataFrame:
    """Rows with any of the terms in any of the fields, ranked by BM25: ``id, score``.

    The text is read and split once: word counts per row are written to the
    shared folder as a narrow table, from which both the corpus statistics and
    the scores are computed without any shuffle of rows.
    """
    terms = [t.lower() for t in terms]
    tokens = words(F.concat_ws(" ", *fields))
    counted = written(
        df.select(id_column, tokens.alias("w")).select(
            id_column,
            F.size("w").alias("n"),
            *[_occurrences("w", t).alias(f"tf{i}") for i, t in enumerate(terms)],
        ),
        "words",
    )
    stats = counted.agg(
        F.count("*").alias("rows"),
        F.sum("n").alias("words"),
        *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))],
    ).select(F.struct("*").alias("s"))
    s = stats.scalar()
    hits = reduce(lambda a, b: a | b, [F.col(f"tf{i}") > 0 for i in range(len(terms))])
    mean = s["words"] / s["rows"]
    parts = []
    for i in range(len(terms)):
        tf, found = F.col(f"tf{i}"), s[f"df{i}"]
        idf = F.log(1 + (s["rows"] - found + 0.5) / (found + 0.5))
        norm = tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("n") / mean)
        parts.append(idf * tf * (BM25_K1 + 1) / norm)
    score = F.round(reduce(lambda a, b: a + b, parts), 6)
    ranked = counted.where(hits).select(id_column, score.alias("score"))
    ranked = ranked.orderBy(F.desc("score"), id_column)
    return ranked if k is None else ranked.limit(k)


def rank_fusion(
    rankings: list[DataFrame], weights: list[float], id_column: str, c: int = RANK_CONSTANT
) -> DataFrame:
    """Fuse ranked lists ``id, rank`` (1 = best) into ``id, score``."""
    parts = [
        df.select(id_column, (F.lit(float(w)) / (F.lit(c) + F.col("rank"))).alias("s"))
        for df, w in zip(rankings, weights)
    ]
    fused = reduce(DataFrame.union, parts).groupBy(id_column).agg(
        F.round(F.sum("s"), 9).alias("score")
    )
    return fused.orderBy(F.desc("score"), id_column)


def score_fusion(
    scored: list[DataFrame], weights: list[float], id_column: str
) -> DataFrame:
    """Fuse scored lists ``id, score`` after scaling each to the range 0 to 1."""
    parts = []
    for df, w in zip(scored, weights):
        span = df.agg(F.struct(F.min("score").alias("lo"), F.max("score").alias("hi")).alias("s"))
        s = span.scalar()
        scaled = F.when(s["hi"] == s["lo"], F.lit(1.0)).otherwise(
            (F.col("score") - s["lo"]) / F.nullif(s["hi"] - s["lo"], F.lit(0.0))
        )
        parts.append(df.select(id_column, (F.lit(float(w)) * scaled).alias("s")))
    fused = reduce(DataFrame.union, parts).groupBy(id_column).agg(
        F.round(F.sum("s"), 9).alias("score")
    )
    return fused.orderBy(F.desc("score"), id_column)
