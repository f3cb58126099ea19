"""Streaming twins of the batch aggregates: an addition of this engine, since its inputs may also arrive as events.

Every function here works on batch and streaming DataFrames alike; after all input is consumed both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def timed(events: DataFrame) -> DataFrame:
    """Event times with a zone: watermarks do not take zoneless ones."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows."""
    return _windowed(events, F.window("ts", width), late)


def sliding_counts(events: DataFrame, width: str = "6 hours", step: str = "3 hours", late: str = "2 hours") -> DataFrame:
    """As tumbling_counts, with overlapping windows."""
    return _windowed(events, F.window("ts", width, step), late)


def _windowed(events: DataFrame, window, late: str) -> DataFrame:
    g = timed(events).withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n) of sessions that end after a gap."""
    g = timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of_each(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """Events without repeats within the watermark."""
    w = timed(events).withWatermark("ts", late)
    return w.dropDuplicatesWithinWatermark([key]) if events.isStreaming else w.dropDuplicates([key])


def running_coverage(reads: DataFrame, late: str = "2 hours") -> DataFrame:
    """(position, base, n) of single-base reads as they arrive; an update-mode aggregate without a window."""
    return reads.groupBy("position", "base").agg(F.count("*").alias("n"))


def consume(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all available input and return its rows.

    Appended rows, as many as the input may have, go to files of the shared folder; complete and update results to a
    memory table, since they are small.
    """
    from strandlake.session import shared_root

    spark: SparkSession = stream.sparkSession
    import uuid

    at = f"{shared_root(spark)}/streams/{uuid.uuid4().hex}"
    if mode == "append":
        out = f"{at}-rows"
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", at).option("path", out).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
