"""Session helpers: the shared folder, lineage cuts and schema guards."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_ROOT = f"/tmp/checkpoints/strandlake-engine-{os.getpid()}"


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not os.path.isdir(_OWN_ROOT):
        os.makedirs(_OWN_ROOT)
        atexit.register(shutil.rmtree, _OWN_ROOT, ignore_errors=True)
    return f"file://{_OWN_ROOT}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: what follows depends on files only."""
    path = f"{shared_root(df.sparkSession)}/strandlake/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """The table itself, or an error at plan time if a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are: {', '.join(df.columns)}")
    return df
