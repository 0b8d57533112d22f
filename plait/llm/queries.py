"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import fresh_path
from . import (
    forest, idfiles, impact, langid, licenses, mixing, negatives, packing, pii, reputation, simhash, spelling,
    tokencount,
)

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def public_tokenizer(name: str) -> str:
    """Where the machine keeps a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_ppm_language(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identify(_table(spark, sf, "documents"))


def op2_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_table(spark, sf, "documents"))


def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf, "documents"), public_tokenizer("piece_bpe_32k.model"))


def op4_token_id_files(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "token-ids")
    idfiles.write(_table(spark, sf, "documents"), path, public_tokenizer("word_bpe_49k.json"))
    return idfiles.read(spark, path)


def op5_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_table(spark, sf, "documents"), public_tokenizer("word_bpe_49k.json"))


def op6_impact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return impact.top_k(_table(spark, sf, "embeddings"))


def op7_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Documents have no paths: they are put into directories by source and language.

    What a document inherits follows from these made-up directories only; ``own`` licences
    do not.
    """
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/"),
                    F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return licenses.scan(_table(spark, sf, "documents"), path)


def op8_simhash_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf, "documents"))


def op9_vector_forest(spark: SparkSession, sf: str) -> DataFrame:
    return forest.similar_vectors(_table(spark, sf, "embeddings"))


def op10_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find(_table(spark, sf, "documents"))


def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    words = spelling.corpus_words(_table(spark, sf, "documents"), damaged=31)
    return spelling.variants(words.where("n >= 2"))


def op12_url_reputation(spark: SparkSession, sf: str) -> DataFrame:
    """A page's path ends with the number of its document, whose label is its outcome."""
    pages, labels = _table(spark, sf, "pages"), _table(spark, sf, "labels")
    number = F.regexp_extract(reputation.path_of(F.col("url")), r"/([0-9]{1,18})(\.[a-z]+)?/?$", 1)
    bad = labels.groupBy(F.col("doc_id").cast("long").alias("no")).agg(
        F.bool_or((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    )
    numbered = pages.select("url", F.when(number != "", number).cast("long").alias("no"))
    return reputation.judge(pages, numbered.join(bad, "no"), URL_RULES)


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, sf, "embeddings"), label)


QUERIES = {
    "op1_ppm_language": op1_ppm_language,
    "op2_source_mix": op2_source_mix,
    "op3_token_counts": op3_token_counts,
    "op4_token_id_files": op4_token_id_files,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_impact_top_k": op6_impact_top_k,
    "op7_license_scan": op7_license_scan,
    "op8_simhash_duplicates": op8_simhash_duplicates,
    "op9_vector_forest": op9_vector_forest,
    "op10_personal_data": op10_personal_data,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_url_reputation": op12_url_reputation,
    "op13_hard_negatives": op13_hard_negatives,
}
# Vectors whose components are all there and finite.
_GOOD = """embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0"""

# The other operators are no SQL: their tests hold them against brute force.
SQL = {
    "op6_impact_top_k": f"""
        WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e
                   FROM embeddings WHERE vec_id IS NOT NULL AND {_GOOD}),
        s AS (SELECT q.vec_id AS query_id, c.vec_id,
                     CAST(list_sum([p[1] * p[2] for p in list_zip(q.e, c.e)]) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank",
                     vec_id, score FROM s)
        SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 10""",
    "op9_vector_forest": f"""
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                             WHERE {_GOOD} AND len([x for x in embedding if x <> 0]) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
                  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.b) AS component_id, e.vec_id = min(r.b) AS kept
        FROM embeddings e JOIN reach r ON r.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id GROUP BY e.vec_id""",
    "op12_url_reputation": r"""
        WITH p AS (SELECT page_id, url,
                     translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
        l AS (SELECT CAST(doc_id AS BIGINT) AS no, bool_or(quality = 0 OR toxic = 1) AS bad FROM labels GROUP BY 1),
        o AS (SELECT p.host, count(bad) AS n, count_if(bad) AS bad
              FROM (SELECT host, TRY_CAST(nullif(regexp_extract(path, '/([0-9]{1,18})(\.[a-z]+)?/?$', 1), '') AS BIGINT) AS no FROM p) p JOIN l USING (no) GROUP BY 1),
        h AS (SELECT host, coalesce(o.n, 0) AS n, coalesce(o.bad, 0) AS bad, string_split(host, '.') AS parts FROM (SELECT DISTINCT host FROM p) LEFT JOIN o USING (host)),
        k AS (SELECT *, array_to_string(parts[-2:], '.') IN ('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'co.za', 'com.au', 'com.br', 'com.cn', 'gov.uk', 'org.uk') AS two FROM h),
        d AS (SELECT host, n, bad, CASE WHEN two THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END AS suffix,
                     CASE WHEN two THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain FROM k),
        g AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS m FROM d),
        s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(m) AS m FROM d, g GROUP BY 1),
        s1 AS (SELECT 1 / least(greatest(coalesce(sum((bad - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.001), 0.001), 0.5) - 1 AS k FROM s0),
        s AS (SELECT suffix, (bad + k * m) / (n + k) AS m FROM s0, s1),
        d0 AS (SELECT domain, sum(n) AS n, sum(bad) AS bad, any_value(m) AS m FROM d JOIN s USING (suffix) GROUP BY 1),
        d1 AS (SELECT 1 / least(greatest(coalesce(sum((bad - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.001), 0.001), 0.5) - 1 AS k FROM d0),
        e AS (SELECT domain, (bad + k * m) / (n + k) AS m FROM d0, d1),
        h0 AS (SELECT host, n, bad, m FROM d JOIN e USING (domain)),
        h1 AS (SELECT 1 / least(greatest(coalesce(sum((bad - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.001), 0.001), 0.5) - 1 AS k FROM h0),
        r AS (SELECT host, n, bad, (bad + k * m) / (n + k) AS rate, k FROM h0, h1),
        j AS (SELECT host, n, bad, rate - 1.645 * sqrt(rate * (1 - rate) / (n + k + 1)) > 0.5 AS blocked FROM r),
        v(rule_host, rule_path, rule, verdict) AS (VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'),
            ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')),
        f AS (SELECT p.page_id, p.host, p.path, v.rule, v.verdict, j.n, j.bad, j.blocked,
                     row_number() OVER (PARTITION BY p.rowid ORDER BY length(v.rule) DESC) AS place
              FROM (SELECT *, row_number() OVER () AS rowid FROM p) p JOIN j USING (host)
              LEFT JOIN v ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path))
        SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict,
               CAST(n AS BIGINT) AS host_labelled, CAST(bad AS BIGINT) AS host_bad FROM f WHERE place = 1""",
    "op13_hard_negatives": f"""
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_GOOD}),
        s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id,
                     CAST(list_sum([p[1] * p[2] for p in list_zip(a.e, c.e)]) AS BIGINT) AS score
              FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
        pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
                QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id,
               CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank",
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM pos JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY "rank" <= 3""",
}
