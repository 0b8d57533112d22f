"""Vector and text search over embeddings and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.vectors import cosine
from ..operators import changesets as cs, diff as d, indexes, merge as m, search as s
from ..session import fresh_path
from .tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(
    "x1_cosine",
    f"SELECT a.vec_id, round({_COS}, 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def x1(spark, sf):
    e = table(spark, sf, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(after, "vec_id").select(
        "vec_id", F.round(cosine(F.col("embedding"), F.col("b")), 6).alias("score")
    )


def _nearest(spark, sf, k: int) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()["embedding"]
    return s.vector_topk(e.where("vec_id <> 0"), "vec_id", "embedding", q, k)


_NEAREST = f"""near AS (SELECT a.vec_id, round({_COS}, 9) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b
   WHERE a.vec_id <> 0 ORDER BY score DESC, a.vec_id LIMIT 20)"""


@query("x2_vector_topk", f"WITH {_NEAREST} SELECT vec_id, round(score, 6) AS score FROM near")
def x2(spark, sf):
    return _nearest(spark, sf, 20).withColumn("score", F.round("score", 6))


_TERMS = ["the", "queaux", "tion"]
_TF = ", ".join(f"len([x for x in w if x = '{t}']) AS tf{i}" for i, t in enumerate(_TERMS))
_SCORE = " + ".join(
    f"ln(1 + (n_rows - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * n / (n_words / n_rows)))"
    for i in range(3)
)
_BM25 = f"""tok AS (SELECT doc_id, [x for x in regexp_split_to_array(lower(lang || ' ' || text), '[^\\p{{L}}\\p{{N}}]+') if x <> ''] AS w FROM documents),
tf AS (SELECT doc_id, len(w) AS n, {_TF} FROM tok),
st AS (SELECT count(*) AS n_rows, CAST(sum(n) AS DOUBLE) AS n_words, {", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(3))} FROM tf),
hits AS (SELECT doc_id, round({_SCORE}, 6) AS score FROM tf, st WHERE tf0 + tf1 + tf2 > 0)"""


@query("x3_text_search", f"WITH {_BM25} SELECT doc_id, score FROM hits")
def x3(spark, sf):
    return s.text_search(table(spark, sf, "documents"), "doc_id", _TERMS, ["lang", "text"])


@query(
    "x3_text_search_top",
    f"WITH {_BM25} SELECT doc_id, score FROM hits ORDER BY score DESC, doc_id LIMIT 25",
)
def x3_top(spark, sf):
    return s.text_search(table(spark, sf, "documents"), "doc_id", _TERMS, ["lang", "text"], 25)


_INDEXES: dict[tuple, str] = {}


def _once(spark, sf, kind: str, make) -> str:
    """The folder of an index that is made once per session."""
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _INDEXES:
        path = fresh_path(spark, kind)
        make(path)
        _INDEXES[key] = path
    return _INDEXES[key]


def _texts(spark, path: str) -> indexes.TextIndex:
    return indexes.TextIndex(spark, path, "doc_id", ["lang", "text"])


@query("x3_text_search_stored", f"WITH {_BM25} SELECT doc_id, score FROM hits")
def x3_stored(spark, sf):
    path = _once(spark, sf, "texts", lambda p: _texts(spark, p).build(table(spark, sf, "documents")))
    return _texts(spark, path).search(_TERMS)


@query(
    "x3_text_search_updated",
    f"""WITH {_BM25.replace("FROM documents)", "FROM edited)").replace("tok AS", """edited AS (
          SELECT doc_id, lang, CASE WHEN doc_id % 10 = 3 THEN text || ' the queaux' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 4
          UNION ALL SELECT -doc_id - 1, lang, 'tion ' || text FROM documents WHERE doc_id % 10 = 5), tok AS""")} SELECT doc_id, score FROM hits""",
)
def x3_updated(spark, sf):
    """Statistics made before an edit and kept up by its change set."""
    docs = table(spark, sf, "documents")
    part = F.col("doc_id") % 10
    new = docs.where(part != 4).withColumn(
        "text", F.when(part == 3, F.concat("text", F.lit(" the queaux"))).otherwise(F.col("text"))
    ).unionByName(
        docs.where(part == 5).withColumn("doc_id", -F.col("doc_id") - 1).withColumn("text", F.concat(F.lit("tion "), "text"))
    )

    def make(path: str) -> None:
        _texts(spark, path).build(docs).apply(cs.capture(docs, new, ["doc_id"]), 1)

    return _texts(spark, _once(spark, sf, "texts-updated", make)).search(_TERMS)


def _cells(spark, sf) -> indexes.VectorCells:
    def make(path: str) -> None:
        indexes.VectorCells(spark, path, "vec_id", "embedding").build(table(spark, sf, "embeddings"), cells=16)

    return indexes.VectorCells(spark, _once(spark, sf, "cells", make), "vec_id", "embedding")


def _asked(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings").where("vec_id % 50 = 0")
    return e.select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))


_TEN = f"""SELECT b.vec_id AS query, a.vec_id, round({_COS}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
   WHERE b.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY b.vec_id ORDER BY round({_COS}, 9) DESC, a.vec_id) <= 10"""


@query("x2_vector_all_cells", _TEN)
def x2_all(spark, sf):
    """Searching all cells is exact."""
    return _cells(spark, sf).search(_asked(spark, sf), 10, probes=16).withColumn("score", F.round("score", 6))


@query("x2_vector_candidates")
def x2_cells(spark, sf):
    """The ten nearest rows among the candidates of a few cells; recall is tested."""
    return _cells(spark, sf).search(_asked(spark, sf), 10, probes=8).withColumn("score", F.round("score", 6))


def _ranked(df: DataFrame, key: str) -> DataFrame:
    """Ranks of a short result list."""
    w = Window.orderBy(F.desc("score"), key)
    return df.select(F.col(key).alias("id"), F.row_number().over(w).alias("rank"), "score")


_LISTS = f"""{_NEAREST}, {_BM25},
top AS (SELECT doc_id, score FROM hits ORDER BY score DESC, doc_id LIMIT 25),
r1 AS (SELECT vec_id AS id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM near),
r2 AS (SELECT doc_id AS id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM top)"""


def _lists(spark, sf) -> list[DataFrame]:
    return [_ranked(_nearest(spark, sf, 20), "vec_id"), _ranked(x3_top(spark, sf), "doc_id")]


@query(
    "x4_rank_fusion",
    f"""WITH {_LISTS} SELECT id, round(sum(w / (60 + rank)), 9) AS score FROM (SELECT id, rank, 0.6::DOUBLE AS w FROM r1
        UNION ALL SELECT id, rank, 0.4::DOUBLE FROM r2) GROUP BY id""",
)
def x4(spark, sf):
    return s.rank_fusion(_lists(spark, sf), [0.6, 0.4], "id")


@query(
    "x5_score_fusion",
    f"""WITH {_LISTS}, n AS (SELECT id, 0.6::DOUBLE * (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS s FROM r1
        UNION ALL SELECT id, 0.4::DOUBLE * (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) FROM r2)
        SELECT id, round(sum(s), 6) AS score FROM n GROUP BY id""",
)
def x5(spark, sf):
    fused = s.score_fusion([df.drop("rank") for df in _lists(spark, sf)], [0.6, 0.4], "id")
    return fused.withColumn("score", F.round("score", 6))


def _vector_branches(spark, sf):
    base = table(spark, sf, "embeddings")
    theirs = base.where("label <> 9").withColumn(
        "embedding",
        F.when(F.col("label") == 2, F.reverse("embedding")).otherwise(F.col("embedding")),
    )
    ours = base.withColumn("label", F.when(F.col("label") == 4, 40).otherwise(F.col("label")))
    return base, ours, theirs


@query(
    "x6_vector_diff",
    """SELECT vec_id, CASE WHEN label = 9 THEN 'removed' ELSE 'modified' END AS change FROM embeddings
       WHERE label = 9 OR (label = 2 AND embedding <> list_reverse(embedding))""",
)
def x6(spark, sf):
    base, _, theirs = _vector_branches(spark, sf)
    return d.diff_rows(theirs, base, ["vec_id"]).select("vec_id", "change")


@query(
    "x6_vector_merge",
    """SELECT vec_id, CASE WHEN label = 4 THEN 40 ELSE label END AS label,
       CASE WHEN label = 2 THEN embedding[64] ELSE embedding[1] END AS head FROM embeddings WHERE label <> 9""",
)
def x6_merge(spark, sf):
    merged = m.merge3(*_vector_branches(spark, sf), ["vec_id"], strategy="theirs")
    return merged.select("vec_id", "label", F.get("embedding", 0).alias("head"))
