"""The registered queries of this subpackage (QUERIES) and, where SQL can state them, their DuckDB SQL (ORACLES)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linenet.llm import exact_dedup, html_text, jaccard, jpeg, mixing, pieces, sharding, suffix, toxicity, warc
from linenet.llm.common import documents


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(pages(spark, sf_dir)).drop("url")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove(documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(documents(spark, sf_dir)).taken()


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(documents(spark, sf_dir))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir)).drop("class_id")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), shards=24)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.features(jpeg.store(documents(spark, sf_dir)))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(pages(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_toxicity": op2_toxicity,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_mixing": op4_mixing,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_jaccard": op6_jaccard,
    "op7_sharding": op7_sharding,
    "op8_media": op8_media,
    "op9_html": op9_html,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLES = {
    "op1_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, body, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM p)
        SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((((
                (instr('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 1 AS INT), 1)) - 1) * 16
                + greatest(instr('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 2 AS INT), 1)) - 1, 0)) >> CAST(3 - (5 * i) % 4 AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM d""",
    "op6_jaccard": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        r AS (SELECT doc_id AS v, doc_id AS m FROM documents UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.v)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.m) AS component_id FROM d JOIN r ON r.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op10_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        r AS (SELECT doc_id, norm, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
              FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST))
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r""",
}
