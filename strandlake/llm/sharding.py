"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows each input partition gives to each cell is drawn exactly (a random contingency table with the given row
and column sums), every partition permutes its rows locally to match its row of the table, one exchange brings the cells
together, and each cell is permuted again. A shard is a run of cells, so its size is exact, its slots have no gap and no
task ever holds a whole shard. The table is never built: a task draws its own row by walking down a binary tree over the
partitions, each node splitting its cell counts by a multivariate hypergeometric draw seeded by the node alone.

Law: `rows`. Shard sizes differ by one at most. Equal texts are dealt independently, as a uniform shuffle asks.

Defined cases: equal draws within a cell (a chance of 2 ** -62 a pair) go in any order; rows of any length are carried whole; null values anywhere are carried along; repeated rows are separate rows; an empty table gives an empty
result; the operator's own columns are shard and slot, and an input column of the same name is replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a cell, the unit one task permutes, holds at most, and bytes of text, on average.
CELL_ROWS = 200_000
CELL_BYTES = 64 << 20
#: Largest population NumPy draws hypergeometric samples from.
_NUMPY_MOST = 900_000_000


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of `sample` rows drawn from good + bad rows are good; inversion from the mode beyond NumPy's range."""
    if good + bad <= _NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, sample))
    low, high = max(0, sample - bad), min(good, sample)
    mode = min(max((sample + 1) * (good + 1) // (good + bad + 2), low), high)
    lg = math.lgamma

    def log_p(k):
        return (
            lg(good + 1) - lg(k + 1) - lg(good - k + 1) + lg(bad + 1) - lg(sample - k + 1) - lg(bad - sample + k + 1)
            - lg(good + bad + 1) + lg(sample + 1) + lg(good + bad - sample + 1)
        )

    u = rng.random()
    p_up = p_down = math.exp(log_p(mode))
    up = down = mode
    u -= p_up
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (sample - up) / ((up + 1) * (bad - sample + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - sample + down) / ((good - down + 1) * (sample - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def split_counts(rng: np.random.Generator, counts: np.ndarray, sample: int) -> np.ndarray:
    """Multivariate hypergeometric draw: how many of `sample` rows come from each kind."""
    out, rest = np.zeros_like(counts), int(counts.sum())
    for j, c in enumerate(counts):
        if sample == 0:
            break
        rest -= int(c)
        out[j] = k = draw_hypergeometric(rng, int(c), rest, sample) if rest else sample
        sample -= k
    return out


def matrix_row(seed: int, ends: np.ndarray, cells: np.ndarray, part: int) -> np.ndarray:
    """Row `part` of the communication matrix. ends: cumulative rows of the partitions, from 0; cells: cell sizes."""
    low, high, counts = 0, len(ends) - 1, cells.copy()
    while high - low > 1:
        mid = (low + high) // 2
        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, low, high])))
        left = split_counts(rng, counts, int(ends[mid] - ends[low]))
        low, high, counts = (low, mid, left) if part < mid else (mid, high, counts - left)
    return counts


def cell_sizes(total: int, n_shards: int, per_shard: int) -> np.ndarray:
    """Sizes of the cells, shard by shard: shards as equal as can be, and the cells of a shard too."""
    shards = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    return np.array([m // per_shard + (c < m % per_shard) for m in shards for c in range(per_shard)], dtype=np.int64)


def _deal(seed: int, ends: np.ndarray, cells: np.ndarray):
    """Kernel: give every row its cell, by a local permutation of the partition's row of the matrix, and a draw."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        row = matrix_row(seed, ends, cells, part)
        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, part, 1 << 20])))
        labels = rng.permutation(np.repeat(np.arange(len(cells), dtype=np.int32), row))
        at = 0
        for batch in batches:
            n = batch.num_rows
            if at + n > len(labels):
                raise RuntimeError("the input gave other rows than it was counted with; write it to a table first")
            draws = pa.array(rng.integers(0, 1 << 62, n))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels[at : at + n]), draws], names=[*batch.schema.names, "__cell", "__draw"])
            at += n
        if at != len(labels):
            raise RuntimeError("the input gave other rows than it was counted with; write it to a table first")

    return run


def shard_rows(docs: DataFrame, n_shards: int = 16, seed: int = 17, cell_rows: int = CELL_ROWS, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """All columns of `docs`, plus shard int and slot long: a uniform random permutation cut into exact shards.

    A cell holds at most `cell_rows` rows, and about `cell_bytes` bytes: rows are dealt at random, so a cell's bytes
    differ from the average by chance, and by the longest row.

    `docs` is scanned twice, once to count its partitions, and must give the same partitions each time, as a table read
    from files does; a task that meets other counts fails instead of dealing wrong rows.
    """
    docs = docs.drop("shard", "slot", "__cell", "__draw")
    spark = docs.sparkSession
    n_parts = docs.rdd.getNumPartitions()
    # One number for each input partition, whatever the rows.
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)).cast("long") for f in docs.schema.fields if f.dataType.typeName() in ("string", "binary")]
    sizes = docs.select(F.spark_partition_id().alias("p"), sum(texts, F.lit(0).cast("long")).alias("b")).groupBy("p").agg(F.count("*"), F.sum("b")).collect()
    counts, total_bytes = {r[0]: r[1] for r in sizes}, sum(r[2] for r in sizes)
    ends = np.concatenate([[0], np.cumsum([counts.get(p, 0) for p in range(n_parts)], dtype=np.int64)])
    total = int(ends[-1])
    schema = docs.select("*", F.lit(0).alias("__cell"), F.lit(0).cast("long").alias("__draw")).schema
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_shard = max(1, -(-total // (n_shards * cell_rows)), min(-(-total_bytes // (n_shards * cell_bytes)), -(-total // n_shards)), -(-min(width, total) // n_shards))
    cells = cell_sizes(total, n_shards, per_shard)
    dealt = docs.mapInArrow(_deal(seed, ends, cells), schema).repartition("__cell")
    # Cells come shard by shard and, within a shard, the larger ones first: their starts follow from arithmetic.
    shard = F.floor(F.col("__cell") / per_shard).cast("int")
    in_shard = F.col("__cell") % per_shard
    shard_n = F.lit(total // n_shards) + (shard < total % n_shards).cast("long")
    base = F.floor(shard_n / per_shard)
    start = in_shard * base + F.least(in_shard.cast("long"), shard_n % per_shard)
    place = F.row_number().over(Window.partitionBy("__cell").orderBy("__draw")) - 1
    return dealt.select(*docs.columns, shard.alias("shard"), (start + place).cast("long").alias("slot"))
