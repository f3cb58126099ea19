"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.decontamination import find_leaks
from strandlake.llm.exact_dedup import exact_copies
from strandlake.llm.langid import language_ids
from strandlake.llm.packing import pack_documents
from strandlake.llm.quality import quality_scores
from strandlake.llm.secret_scan import scan_secrets
from strandlake.llm.sharding import shard_rows
from strandlake.llm.simhash_dedup import near_copies
from strandlake.llm.url_filter import PATTERN_RULES, judge_urls
from strandlake.llm.warc import archive_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(_table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard_rows(_table(spark, sf_dir, "documents"), 16)
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return dealt.select(
        "doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "word", "value_sha256", F.length("value").alias("length"), "score", "is_secret")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_table(spark, sf_dir, "pages"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_ids(_table(spark, sf_dir, "documents"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_sharding, op3_secret_scan, op4_warc, op5_quality_classifier, op6_packing, op7_decontamination, op8_language_id, op9_simhash_dedup, op10_url_filter)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_BLOCKED = "|".join(f"({pattern})" for pattern, _ in PATTERN_RULES)

ORACLE_SQL = {
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY body)""",
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        g AS (SELECT page_id, html, strlen(html) AS n, max(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN n >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND first <> page_id THEN first END AS refers_to
        FROM g""",
    "op10_url_filter": f"""
        WITH u AS (
            SELECT page_id, coalesce(url, '') AS url,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS raw_host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages
        ),
        h AS (SELECT *, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM u),
        r AS (SELECT *, CASE
            WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
            WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
            WHEN ('.' || host) LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
            WHEN ('.' || host) LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
            WHEN ('.' || host) LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule FROM h)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
                    WHEN regexp_matches(lower(url), '{_BLOCKED}') THEN 'block' ELSE 'allow' END AS verdict
        FROM r""",
}
