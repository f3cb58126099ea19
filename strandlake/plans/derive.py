"""Omics-shaped inputs derived from the driver's tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, gene_id, value): quantity that each customer bought of each brand."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cell_id"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("gene_id"))
    return items.join(orders, "l_orderkey").join(parts, "l_partkey").groupBy("cell_id", "gene_id").agg(F.sum("l_quantity").alias("value"))


COUNTS = """counts AS (SELECT o_custkey AS cell_id, p_brand AS gene_id, sum(l_quantity) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, cell_type, batch, perturbation): a customer's segment, region and an assigned brand or control."""
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    kind = F.pmod("c_custkey", F.lit(6))
    return customers.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("cell_id"),
        F.col("c_mktsegment").alias("cell_type"),
        F.col("n_regionkey").cast("long").alias("batch"),
        F.when(kind == 0, "non-targeting").otherwise(F.concat(F.lit("Brand#"), kind.cast("string"), F.lit("1"))).alias("perturbation"),
    )


OBS = """obs AS (SELECT c_custkey AS cell_id, c_mktsegment AS cell_type, CAST(n_regionkey AS BIGINT) AS batch,
  CASE WHEN c_custkey % 6 = 0 THEN 'non-targeting' ELSE 'Brand#' || CAST(c_custkey % 6 AS VARCHAR) || '1' END AS perturbation
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, sequence): the letters a, c, g and t of each document, in capitals."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("seq_id"), F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^acgt]", "")).alias("sequence"))


SEQUENCES = """sequences AS (SELECT doc_id AS seq_id, upper(regexp_replace(coalesce(text, ''), '[^acgt]', '', 'g')) AS sequence
  FROM documents)"""


def item_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, sequence): as `sequences`, of the benchmark's short texts."""
    items = table(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("seq_id"), F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^acgt]", "")).alias("sequence"))


ITEM_SEQUENCES = """sequences AS (SELECT item_id AS seq_id, upper(regexp_replace(coalesce(text, ''), '[^acgt]', '', 'g')) AS sequence
  FROM benchmark)"""


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, position, base, quality, strand): events as single-base reads, an hour being a position."""
    events = table(spark, sf_dir, "events")
    hour = F.floor((F.unix_timestamp("ts") - F.lit(1704067200)) / 3600)
    return events.select(
        F.col("event_id").alias("read_id"),
        hour.cast("long").alias("position"),
        F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_BASES.items() for x in kv]), F.col("event_type")).alias("base"),
        F.least("value", F.lit(40.0)).alias("quality"),
        F.pmod("user_id", F.lit(2)).alias("strand"),
    )


EVENT_BASES = {"click": "A", "error": "C", "purchase": "G", "signup": "T", "view": "N"}
READS = """reads AS (SELECT event_id AS read_id, CAST(floor((epoch(ts) - 1704067200) / 3600) AS BIGINT) AS position,
  CASE event_type WHEN 'click' THEN 'A' WHEN 'error' THEN 'C' WHEN 'purchase' THEN 'G' WHEN 'signup' THEN 'T' ELSE 'N' END AS base,
  least(value, 40.0) AS quality, user_id % 2 AS strand FROM events)"""


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, value): events per hour over the whole range of hours, zeros included."""
    hourly = reads(spark, sf_dir).groupBy("position").agg(F.count("*").cast("double").alias("n"))
    span = hourly.agg(F.min("position").alias("a"), F.max("position").alias("b")).select(F.explode(F.sequence("a", "b")).alias("pos"))
    return span.join(hourly, F.col("pos") == F.col("position"), "left").select("pos", F.coalesce("n", F.lit(0.0)).alias("value"))


SIGNAL = (
    READS
    + """, hourly AS (SELECT position, CAST(count(*) AS DOUBLE) AS n FROM reads GROUP BY 1),
  signal AS (SELECT pos, coalesce(n, 0.0) AS value FROM (SELECT unnest(range((SELECT min(position) FROM hourly), (SELECT max(position) + 1 FROM hourly))) AS pos)
  LEFT JOIN hourly ON pos = position)"""
)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec array<double>, label, batch): the embeddings."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("vec"), F.col("label").cast("long").alias("label"),
        F.pmod("vec_id", F.lit(2)).alias("batch"),
    )


POINTS = """points AS (SELECT vec_id AS id, [CAST(v AS DOUBLE) FOR v IN embedding] AS vec, CAST(label AS BIGINT) AS label, vec_id % 2 AS batch FROM embeddings)"""
