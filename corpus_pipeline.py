"""The corpus pipeline: quality, exact copies, near copies, benchmark leaks, packing; each stage written and reread.

Every stage works on all rows that its predecessor kept, and all but the last return the columns of `documents`. Every
stage reads its input more than once, so it must be a table of files, as `run` writes them.

Defined cases, for every stage: an empty table gives an empty result; null and empty texts are texts without words (the
quality stage scores them like any other, the two deduplicating stages take them for copies of each other, the
decontaminating stage keeps them, and packing gives them their end token); texts of any length are read whole; null ids
and repeated rows are rows of their own; other columns may hold nulls and have any name, and come out as they were.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandlake.llm.common import materialise
from strandlake.llm.decontamination import drop_leaks
from strandlake.llm.exact_dedup import drop_exact_copies
from strandlake.llm.packing import pack_documents
from strandlake.llm.quality import keep_good
from strandlake.llm.similar_dedup import drop_similar


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts: scores at the threshold stay; without any label all stay."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (but for the case of A-Z): the one of the largest id, of equal ids the last; a null id is the least."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (similarity of five-word shingles): the one of the smallest id, of equal ids the first; a null id is the greatest."""
    return drop_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty items are held by none."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: every id of every document is in one piece."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("packing", packing),
]

#: The stages learn, hash and tokenise: SQL does not express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the whole of `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
