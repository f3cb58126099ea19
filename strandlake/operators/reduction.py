"""Reductions that are fitted once and applied to any rows: principal components, tf-idf with its singular vectors, PHATE.

Gram matrices of the features are summed by Spark; their width is the number of features, whatever the rows. The small
eigenproblem is solved by NumPy on the driver, and a fitted reduction is a few arrays that go into expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.numeric import dot


class FrozenReduction(Protocol):
    """What a fitted reduction does: scale rows, and transform them."""

    def scaled(self, rows: DataFrame) -> DataFrame: ...

    def transform(self, rows: DataFrame) -> DataFrame: ...


def _array(values):
    return F.array(*[F.lit(float(v)) for v in values])


def signed(vectors: np.ndarray) -> np.ndarray:
    """Columns whose largest entry by size is positive."""
    return vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])


def vector_moments(points: DataFrame, vec: str = "vec") -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, population deviations) of the entries of an array column."""
    n = points.count()
    rows = points.select(F.posexplode(vec).alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("k").collect()
    return n, np.array([r["m"] for r in rows]), np.array([r["s"] for r in rows])


def gram(points: DataFrame, vec: str = "vec") -> np.ndarray:
    """Sum over rows of the outer product of a vector with itself: partial sums by task, one matrix each."""
    import pyarrow as pa

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(0).to_pylist(), np.float64)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["row", "v"])

    parts = points.select(vec).mapInArrow(run, "row int, v array<double>")
    cells = parts.select("row", F.posexplode("v").alias("col", "x")).groupBy("row", "col").agg(F.sum("x").alias("x")).collect()
    width = max((r["row"] for r in cells), default=-1) + 1
    out = np.zeros((width, width))
    for r in cells:
        out[r["row"], r["col"]] = r["x"]
    return out


@dataclass
class PCAReduction:
    """Training means and deviations, a clip, and components in columns."""

    mean: np.ndarray
    scale: np.ndarray
    clip: float
    components: np.ndarray
    variances: np.ndarray

    def scaled(self, rows: DataFrame, vec: str = "vec") -> DataFrame:
        z = F.zip_with(F.zip_with(vec, _array(self.mean), lambda x, m: x - m), _array(self.scale), lambda x, s: F.least(F.greatest(x / s, F.lit(-self.clip)), F.lit(self.clip)))
        return rows.withColumn("scaled", z)

    def transform(self, rows: DataFrame, vec: str = "vec") -> DataFrame:
        scores = [dot("scaled", _array(self.components[:, k])) for k in range(self.components.shape[1])]
        return self.scaled(rows, vec).withColumn("scores", F.array(*scores)).drop("scaled")


def fit_pca(points: DataFrame, k: int, clip: float = 10.0, standardise: bool = True) -> PCAReduction:
    """Fit on training rows (id, vec): scale by their means and deviations (0 counts as 1), clip, and take k components."""
    n, mean, std = vector_moments(points)
    scale = np.where(std > 0, std, 1.0) if standardise else np.ones_like(std)
    out = PCAReduction(mean, scale, clip if standardise else np.inf, np.zeros((len(mean), 0)), np.zeros(0))
    z = out.scaled(points) if standardise else points.withColumn("scaled", F.zip_with("vec", _array(mean), lambda x, m: x - m))
    _, centre, _ = vector_moments(z, "scaled")
    moment = (gram(z, "scaled") - n * np.outer(centre, centre)) / max(n - 1, 1)
    values, vectors = np.linalg.eigh(moment)
    order = np.argsort(-values)[:k]
    out.components, out.variances = signed(vectors[:, order]), values[order]
    return out


def robust_pca(points: DataFrame, k: int, jitter: float = 1e-6) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """((id, scores), components, eigenvalues): covariance over n - 1 with a jitter on the diagonal, largest loadings positive."""
    n, mean, _ = vector_moments(points)
    centred = points.withColumn("c", F.zip_with("vec", _array(mean), lambda x, m: x - m))
    values, vectors = np.linalg.eigh(gram(centred, "c") / max(n - 1, 1) + jitter * np.eye(len(mean)))
    order = np.argsort(-values)[:k]
    v = signed(vectors[:, order])
    return centred.select("id", F.array(*[dot("c", _array(v[:, i])) for i in range(k)]).alias("scores")), v, values[order]


def matrix_free_pca(points: DataFrame, k: int, rounds: int = 8, oversampling: int = 10, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(components, variances) by randomised subspace iteration: every round is one pass that sums x (x' Q) over the rows.

    No Gram matrix is formed: a task's part is as wide as the features and as deep as the subspace.
    """
    import pyarrow as pa

    n, mean, _ = vector_moments(points)
    width = min(k + oversampling, len(mean))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(mean), width)))[0]

    def push(basis):
        def run(batches):
            total = np.zeros((len(mean), basis.shape[1]))
            for batch in batches:
                if batch.num_rows:
                    x = np.array(batch.column(0).to_pylist(), np.float64) - mean
                    total += x.T @ (x @ basis)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["row", "v"])

        parts = points.select("vec").mapInArrow(run, "row int, v array<double>")
        out = np.zeros((len(mean), basis.shape[1]))
        for r in parts.select("row", F.posexplode("v").alias("c", "x")).groupBy("row", "c").agg(F.sum("x").alias("x")).collect():
            out[r["row"], r["c"]] = r["x"]
        return out

    for _ in range(rounds):
        q = np.linalg.qr(push(q))[0]
    small = q.T @ push(q) / max(n - 1, 1)
    values, u = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:k]
    return signed(q @ u[:, order]), values[order]


@dataclass
class TFIDFReduction:
    """Inverse frequencies by gene and the singular vectors of the training rows, the first one dropped."""

    idf: dict
    scale: float
    components: dict

    def scaled(self, rows: DataFrame) -> DataFrame:
        """(cell_id, gene_id, value) of counts: log1p(tf * idf * scale); genes unseen in training are left out."""
        spark = rows.sparkSession
        idf = F.broadcast(spark.createDataFrame(list(self.idf.items()), "gene_id string, idf double"))
        total = rows.groupBy("cell_id").agg(F.sum("value").alias("t"))
        tf = F.col("value") / F.when(F.col("t") == 0, 1.0).otherwise(F.col("t"))
        return rows.join(total, "cell_id").join(idf, "gene_id").select("cell_id", "gene_id", F.log1p(tf * F.col("idf") * self.scale).alias("value"))

    def transform(self, rows: DataFrame) -> DataFrame:
        """(cell_id, scores)."""
        spark = rows.sparkSession
        k = len(next(iter(self.components.values()), []))
        table = F.broadcast(spark.createDataFrame([(g, list(v)) for g, v in self.components.items()], "gene_id string, c array<double>"))
        x = self.scaled(rows).join(table, "gene_id")
        return x.groupBy("cell_id").agg(F.array(*[F.sum(F.col("value") * F.col("c")[i]) for i in range(k)]).alias("scores"))


def fit_tfidf(counts: DataFrame, k: int, scale: float = 1e4) -> TFIDFReduction:
    """Fit on training counts (cell_id, gene_id, value): idf = cells / gene total, then k singular vectors after the first.

    The Gram matrix over genes is summed from pairs of genes within a cell, so its size is the genes', not the cells'.
    """
    n = counts.select("cell_id").distinct().count()
    sums = counts.groupBy("gene_id").agg(F.sum("value").alias("t")).collect()
    out = TFIDFReduction({r["gene_id"]: n / (r["t"] or 1.0) for r in sums}, scale, {})
    x = out.scaled(counts)
    listed = x.groupBy("cell_id").agg(F.collect_list(F.struct("gene_id", "value")).alias("xs"))
    pairs = listed.select(F.explode("xs").alias("a"), "xs").select("a", F.explode("xs").alias("b"))
    cells = pairs.groupBy(F.col("a.gene_id").alias("a"), F.col("b.gene_id").alias("b")).agg(F.sum(F.col("a.value") * F.col("b.value")).alias("s")).collect()
    genes = sorted(out.idf)
    at = {g: i for i, g in enumerate(genes)}
    m = np.zeros((len(genes), len(genes)))
    for r in cells:
        m[at[r["a"]], at[r["b"]]] = r["s"]
    values, vectors = np.linalg.eigh(m)
    v = signed(vectors[:, np.argsort(-values)[1 : k + 1]])
    out.components = {g: v[i].tolist() for g, i in at.items()}
    return out


def phate(distances: np.ndarray, k: int = 5, t: int = 10, n_components: int = 2, decay: float = 40.0, eps: float = 1e-7) -> np.ndarray:
    """Embedding of n points from their distances: adaptive alpha-decay affinity, diffusion by the cut spectrum, log potential, classical scaling.

    Points number what one eigenproblem takes (landmarks or cluster means), not the cells.
    """
    n = len(distances)
    sigma = np.sort(distances, 1)[:, min(k, n - 1)]
    a = np.exp(-(decay / 2) * (distances / np.maximum(sigma[:, None], 1e-12)) ** 2)
    a = (a + a.T) / 2
    d = a.sum(1)
    symmetric = a / np.sqrt(np.outer(d, d))
    values, vectors = np.linalg.eigh(symmetric)
    values = np.clip(values, 0, None)
    values = (values / max(values.max(), 1e-12)) ** t
    walk = (vectors * values) @ vectors.T * np.sqrt(d)[None, :] / np.sqrt(d)[:, None]
    walk = np.clip(walk, 0, None)
    walk /= np.maximum(walk.sum(1, keepdims=True), 1e-12)
    potential = -np.log(walk + eps)
    potential = (potential + potential.T) / 2
    centre = np.eye(n) - 1 / n
    b = -0.5 * centre @ (potential**2) @ centre
    values, vectors = np.linalg.eigh((b + b.T) / 2)
    order = np.argsort(-values)[:n_components]
    return signed(vectors[:, order]) * np.sqrt(np.clip(values[order], 0, None))


def lloyd(points: DataFrame, centres: DataFrame, rounds: int = 10) -> DataFrame:
    """(cluster, centre) after rounds of assignment to the nearest centre (ties: the smaller number) and of means; empty clusters stay."""
    from strandlake.operators.cells import cluster_assignments, cluster_means
    from strandlake.session import cut_lineage

    for _ in range(rounds):
        hard = cluster_assignments(points, centres).filter("hard").select("id", "cluster")
        moved = cluster_means(points.join(hard, "id"), "cluster")
        kept = centres.join(moved.select("cluster"), "cluster", "left_anti").select("cluster", "centre")
        centres = cut_lineage(moved.select("cluster", "centre").unionByName(kept))
    return centres


def harmony(points: DataFrame, centroids: DataFrame, rounds: int = 10, **step) -> DataFrame:
    """The correction step repeated, the centroids fixed; each round is written down."""
    from strandlake.operators.cells import harmony_step
    from strandlake.session import cut_lineage

    points, centroids = cut_lineage(points), cut_lineage(centroids)
    for _ in range(rounds):
        points = cut_lineage(harmony_step(points, centroids, **step))
    return points
