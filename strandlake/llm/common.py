"""What the training-data operators share: scratch tables, skew-safe look-ups and connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import shutil
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups holding more than this share of all rows are looked up by broadcast; fewer than HOT_PARTS groups can.
HOT_PARTS = 1000
#: Bytes of an Arrow batch, about, while a scratch table is written.
BATCH_BYTES = 8 << 20

_OWN_ROOT = f"/tmp/checkpoints/strandlake-{os.getpid()}"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and Spark runs in this machine alone."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    if not os.path.isdir(_OWN_ROOT):
        os.makedirs(_OWN_ROOT)
        atexit.register(shutil.rmtree, _OWN_ROOT, ignore_errors=True)
    return f"file://{_OWN_ROOT}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/strandlake/{uuid.uuid4().hex}/{name}"


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES):
    """Lower the session's bytes of an Arrow batch for what runs inside: Spark's default of 64 MB is held more than once on both sides of a worker's pipe."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    given = int(re.sub(r"\D", "", before)) if before and re.fullmatch(r"\d+b?", before.lower()) else 0
    if 0 < given <= most:
        yield
        return
    spark.conf.set(key, f"{most}b")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends there and survives lost executors.

    Such tables stay until the folder is cleaned, since a lazy result may still read them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage, so that Spark drops the broadcasts and shuffle files of plans that are done with.

    Otherwise they stay, on the executors too, until the driver happens to run short.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trimmed(kernel):
    """A kernel that hands free memory back to the system at its end: workers are reused, and would keep the most they ever held."""

    def run(batches):
        try:
            yield from kernel(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def spare_name(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not have, whatever the case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def lookup_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "left") -> DataFrame:
    """Join each row to its group, one row of `groups` a key, whatever share of the rows a group holds.

    `size` is the column of `groups` that counts the rows of `rows` with that key, `total` the number of rows. Keys of
    more than total / HOT_PARTS rows are fewer than HOT_PARTS, so broadcasting them is bounded; the rest shuffles.
    Rows must be cheap to read twice (a written table).
    """
    limit = max(total // HOT_PARTS, 1)
    hot = F.broadcast(groups.filter(F.col(size) > limit))
    cold = groups.filter(F.col(size) <= limit)
    small = rows.join(F.broadcast(groups.filter(F.col(size) > limit).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(small.join(cold, key, how))


def min_label_components(members: DataFrame) -> DataFrame:
    """Connected components of a bipartite membership table (node, cell): nodes that share a cell are connected.

    Returns (node, label) with label the smallest node reachable. Rounds contract the graph: every label hooks to the
    smallest label that shares a cell with it, chains of hooks are halved twice, and the memberships move to the new
    labels. A label with a smaller neighbour vanishes, so the rounds grow with the logarithm of the longest path, not
    with its length. Cells and labels that hold a large share of the rows are broadcast (lookup_groups); each round is
    written to the shared folder, so no lineage piles up.
    """
    edges = materialise(members.select(F.col("node").alias("label"), "cell").distinct(), "members")
    labels = None
    while True:
        total = edges.count()
        cells = edges.groupBy("cell").agg(F.count("*").alias("cell_n"), F.min("label").alias("least"))
        cells = materialise(cells.filter("cell_n > 1"), "cells")
        near = lookup_groups(edges, cells, "cell", "cell_n", total, "inner")
        hooks = near.groupBy("label").agg(F.min("least").alias("up")).filter("up < label")
        hooks = materialise(hooks, "hooks")
        if not hooks.limit(1).count():
            if labels is None:
                return edges.select(F.col("label").alias("node"), "label").distinct()
            return labels.select("node", "label")
        for _ in range(2):
            above = hooks.select(F.col("label").alias("up"), F.col("up").alias("top"))
            hooks = hooks.join(above, "up", "left").select("label", F.coalesce("top", "up").alias("up"))
        hooks = materialise(hooks, "hooks")
        sized = hooks.join(edges.groupBy("label").agg(F.count("*").alias("label_n")), "label")
        moved = lookup_groups(edges, sized, "label", "label_n", total)
        if labels is None:
            nodes = edges.select(F.col("label").alias("node")).distinct()
            labels = nodes.join(hooks.withColumnRenamed("label", "node"), "node", "left").select("node", F.coalesce("up", "node").alias("label"))
        else:
            n_nodes = labels.count()
            held = hooks.join(labels.groupBy("label").agg(F.count("*").alias("label_n")), "label")
            labels = lookup_groups(labels, held, "label", "label_n", n_nodes).select("node", F.coalesce("up", "label").alias("label"))
        labels = materialise(labels, "labels")
        edges = materialise(moved.select(F.coalesce("up", "label").alias("label"), "cell").distinct(), "members")


def pair_components(pairs: DataFrame) -> DataFrame:
    """Connected components of links (a, b): (node, label) with label the smallest node reachable; nodes without a link to another have no row.

    Rounds contract the graph: the greater end of every link hooks to its smallest neighbour, chains of hooks are halved
    twice, and links and labels move to the new ends. Links inside a component vanish, so each round works on what is
    left, and every label that is not the smallest of its neighbours is gone after it. Ends that hold a large share of
    the rows are broadcast (lookup_groups).
    """
    spark = pairs.sparkSession
    tidy = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = materialise(pairs.filter("a <> b").select(*tidy).distinct(), "links")
    labels = links.select(F.col("b").alias("node"), F.col("a").alias("label")).limit(0)
    while total := links.count():
        hooks = links.groupBy(F.col("b").alias("label")).agg(F.min("a").alias("up"))
        for _ in range(2):
            above = hooks.select(F.col("label").alias("up"), F.col("up").alias("top"))
            hooks = hooks.join(above, "up", "left").select("label", F.coalesce("top", "up").alias("up"))
        hooks = materialise(hooks, "hooks")
        if n_labels := labels.count():
            held = hooks.join(labels.groupBy("label").agg(F.count("*").alias("n")), "label")
            labels = lookup_groups(labels, held, "label", "n", n_labels).select("node", F.coalesce("up", "label").alias("label"))
        labels = materialise(labels.unionByName(hooks.select(F.col("label").alias("node"), F.col("up").alias("label"))), "labels")
        for end in ("a", "b"):
            named = hooks.select(F.col("label").alias(end), "up").join(links.groupBy(end).agg(F.count("*").alias("n")), end)
            links = lookup_groups(links, named, end, "n", total).withColumn(end, F.coalesce("up", end)).select("a", "b")
            links = materialise(links.filter("a <> b").select(*tidy).distinct() if end == "b" else links, "links")
        release(spark)
    roots = labels.select(F.col("label").alias("node"), "label").distinct()
    # A label in the middle of a long chain hooks in more than one round: its rows agree in the end.
    return materialise(labels.unionByName(roots).distinct(), "components")
