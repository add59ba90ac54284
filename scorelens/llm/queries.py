"""The queries of the training-data operators, and their SQL for comparison.

Each applies an operator with production parameters to its whole table and adds or renames the
columns of its contract.  ORACLE_SQL has those that SQL can express; the others are tested
against brute force in tests/llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, licenses, lm_scoring, mixing, packing, pii, quality, simhash, topk_search, toxicity
from .common import read


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = packing.pieces(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))
    return packing.pack(cuts)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(topk_search.scaled(read(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is what ``labels`` calls good."""
    docs = read(spark, sf_dir, "documents")
    return lm_scoring.score(docs, lm_scoring.fit(docs, read(spark, sf_dir, "labels").where("quality = 1")))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.personal_data(read(spark, sf_dir, "documents")))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_source_mixing": op4_source_mixing,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_quality": op6_quality,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_license_scan": op9_license_scan,
    "op10_pii": op10_pii,
}

ORACLE_SQL = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op4_source_mixing": """
        WITH RECURSIVE sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                   (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
            FROM documents),
        sources AS (
            SELECT source, s, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS w
            FROM (SELECT source, sum(size)::BIGINT AS s FROM sized GROUP BY source)),
        level AS (
            SELECT min_by(struct_pack(l := l, h := h), k) AS x FROM (
                SELECT row_number() OVER o AS k, s, w,
                       sum(s) OVER () - coalesce(sum(3 * s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
                       sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h
                FROM sources WINDOW o AS (ORDER BY (3 * s)::DOUBLE / w, source NULLS LAST))
            WHERE l * w < 3 * s * h),
        targets AS (
            SELECT source, s, CASE WHEN w * x.l < 3 * s * x.h THEN (w * x.l)::DOUBLE / x.h::DOUBLE ELSE (3 * s)::DOUBLE END AS target
            FROM sources, level),
        drawing AS (
            SELECT *, greatest(0.0::DOUBLE, target - copies * s) AS rest,
                   CASE WHEN s > 0 THEN greatest(0.0::DOUBLE, target - copies * s) / s ELSE 0.0::DOUBLE END AS f
            FROM (SELECT *, CASE WHEN s > 0 THEN least(3, floor(target / s))::BIGINT ELSE 0 END AS copies FROM targets)),
        ranked AS (
            SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto
            FROM (SELECT z.*, d.rest, u * (1 - f) / (u * (1 - f) + f * (1 - u)) AS rank
                  FROM sized z JOIN drawing d ON z.source IS NOT DISTINCT FROM d.source WHERE f > 0 AND size > 0)),
        beyond AS (SELECT * FROM ranked WHERE upto > rest),
        gap0 AS (SELECT source, max(rest - (upto - size)) AS gap FROM beyond GROUP BY source),
        sizes AS (
            SELECT b.source, size, count(*) AS n, row_number() OVER (PARTITION BY b.source ORDER BY size DESC) AS k
            FROM beyond b JOIN gap0 g ON b.source IS NOT DISTINCT FROM g.source WHERE size <= gap GROUP BY b.source, size),
        fill AS (
            SELECT source, 0::BIGINT AS k, gap, 0::BIGINT AS size, 0::BIGINT AS take FROM gap0
            UNION ALL
            SELECT source, k, gap - take * size, size, take
            FROM (SELECT f.source, o.k, f.gap, o.size, CASE WHEN o.size <= f.gap THEN least(o.n, floor(f.gap / o.size)::BIGINT) ELSE 0 END AS take
                  FROM fill f JOIN sizes o ON o.source IS NOT DISTINCT FROM f.source AND o.k = f.k + 1)),
        filled AS (
            SELECT b.doc_id
            FROM (SELECT *, row_number() OVER (PARTITION BY source, size ORDER BY rank, doc_id NULLS FIRST) AS place FROM beyond) b
            JOIN fill f ON b.source IS NOT DISTINCT FROM f.source AND b.size = f.size AND place <= take),
        taken AS (SELECT doc_id FROM ranked WHERE upto <= rest UNION ALL SELECT doc_id FROM filled)
        SELECT z.doc_id, z.size, d.s AS source_size, d.target,
               (z.size * (d.copies + (z.doc_id IN (SELECT doc_id FROM taken))::BIGINT))::BIGINT AS taken,
               CASE WHEN z.size > 0 THEN d.copies + (z.doc_id IN (SELECT doc_id FROM taken))::BIGINT ELSE 0 END::INTEGER AS copies
        FROM sized z JOIN drawing d ON z.source IS NOT DISTINCT FROM d.source
    """,
    "op7_exact_top_k": """
        WITH whole AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS (
            SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM whole q JOIN whole c ON c.r <> q.r WHERE q.vec_id % 20 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank, vec_id, score
        FROM pairs
        QUALIFY rank <= 20
    """,
    "op9_license_scan": licenses.oracle_sql(),
}
