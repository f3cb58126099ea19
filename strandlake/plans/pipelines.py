"""Compositions of operators: preprocessing, variant calling, single-cell, expression tests, perturbation set-up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators import cells as C
from strandlake.operators import signals as X
from strandlake.operators import splitting as S


def preprocess_reads(reads: DataFrame, threshold: float = 20.0, adapter: str | None = None, duplicates: bool = True) -> DataFrame:
    """Quality weights, then adapter trimming, then duplicate weights, each switchable; weight is their product over its maximum."""
    out = X.quality_filter(reads, threshold).withColumnRenamed("weight", "quality_weight")
    if adapter:
        out = X.adapter_trim(out, adapter)
    if duplicates:
        out = X.duplicate_weights(out, "sequence").withColumnRenamed("weight", "duplicate_weight")
    weight = F.col("quality_weight") * (F.col("duplicate_weight") if duplicates else 1.0)
    top = out.agg(F.max(weight).alias("top"))
    return out.join(F.broadcast(top), F.lit(True)).withColumn("weight", weight / F.col("top")).drop("top")


def call_variants(reads: DataFrame, reference: DataFrame, length: int, threshold: float = 20.0, least_depth: float = 1.0) -> DataFrame:
    """(position, called, p, genotype): quality filter, pileup, then the most likely base against the reference."""
    p = X.pileup(X.quality_filter(reads, threshold, mode="hard"), length)
    best = F.greatest(*[F.col(b) for b in "ACGT"])
    called = F.when(F.col("A") == best, "A").when(F.col("C") == best, "C").when(F.col("G") == best, "G").otherwise("T")
    found = p.filter(F.col("coverage") >= least_depth).select("position", called.alias("called"), best.alias("p"), "coverage").join(reference, "position")
    return found.withColumn("genotype", (F.col("called") != F.col("ref")).cast("long"))


def recalibrated_features(pileup: DataFrame) -> DataFrame:
    """(position, depth, top, entropy, balance): inputs of the quality recalibration."""
    h = sum([-F.col(b) * F.log(F.col(b) + 1e-10) for b in "CGT"], -F.col("A") * F.log(F.col("A") + 1e-10))
    return pileup.select(
        "position", F.col("coverage").alias("depth"), F.greatest(*[F.col(b) for b in "ACGT"]).alias("top"), h.alias("entropy"),
        (F.abs(F.col("A") - F.col("C")) / F.greatest("coverage", F.lit(1e-8))).alias("balance"),
    )


def joint_preprocessing(counts: DataFrame, cells: DataFrame, n_top: int, clip: float = 10.0) -> DataFrame:
    """Normalise, keep highly variable genes, scale."""
    norm = C.normalize_counts(counts)
    genes = C.highly_variable_genes(norm, cells.count(), n_top).filter("selected = 1").select("gene_id")
    return C.standardize(norm.join(F.broadcast(genes), "gene_id", "left_semi"), cells, clip)


def differential_expression(counts: DataFrame, obs: DataFrame, condition: str) -> DataFrame:
    """(gene_id, log2_fold, z, p, significance): size factors, log means of two conditions, Wald statistics."""
    f = C.size_factors(counts, 0)
    x = counts.join(f, "cell_id").join(obs.select("cell_id", F.col(condition).alias("k")), "cell_id").withColumn("v", F.log1p(F.col("value") / F.col("size_factor")))
    n = obs.groupBy(F.col(condition).alias("k")).agg(F.count("*").alias("n"))
    sums = x.groupBy("gene_id", "k").agg(F.sum("v").alias("s"), F.sum(F.col("v") ** 2).alias("q")).join(F.broadcast(n), "k")
    mean = F.col("s") / F.col("n")
    m = sums.select("gene_id", "k", mean.alias("m"), ((F.col("q") / F.col("n") - mean * mean) / F.col("n")).alias("se2"))
    pick = lambda c, k: F.sum(F.when(F.col("k") == k, F.col(c)))
    e = m.groupBy("gene_id").agg((pick("m", 1) - pick("m", 0)).alias("beta"), F.sqrt(pick("se2", 1) + pick("se2", 0)).alias("se"))
    return C.wald(e)


@dataclass
class PerturbationSetup:
    """What a perturbation experiment trains on: cells with their splits, control mapping and batches of the training cells."""

    cells: DataFrame
    mapping: DataFrame
    batches: DataFrame


def perturbation_setup(counts: DataFrame, obs: DataFrame, held_out: list[str], control: str = "non-targeting", **knockdown) -> PerturbationSetup:
    """Knockdown filter, few-shot split, controls for every perturbed cell, and batches over the kept training cells."""
    kept = C.knockdown_filter(counts, obs, control, **knockdown)
    split = S.few_shot_split(obs, "cell_id", "perturbation", held_out, control).select("cell_id", "split")
    cells = obs.join(kept, "cell_id").join(split, "cell_id")
    train = cells.filter((F.col("split") == "train") & F.col("kept"))
    return PerturbationSetup(cells, S.control_mapping(obs, 1, control), S.perturbation_batches(train, "cell_id", "perturbation"))


def single_cell(counts: DataFrame, points: DataFrame, centroids: DataFrame, contamination: float = 0.05) -> dict[str, DataFrame]:
    """Ambient removal and normalisation of counts; batch correction and soft clusters of an embedding."""
    clean = C.normalize_counts(C.ambient_removal(counts, contamination))
    corrected = C.harmony_step(points, centroids)
    return {"normalized": clean, "corrected": corrected, "clusters": C.cluster_assignments(corrected, centroids)}


def minibatches(rows: DataFrame, key: str, size: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Seeded shuffled batches without the last incomplete one."""
    n = S._numbered(rows, seed + epoch, key)
    return n.withColumn("batch", F.floor(F.col("rn") / size)).filter(F.col("batch") < F.floor(F.col("n") / size)).drop("rn", "n")


def rename_field(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def ensemble_summary(runs: DataFrame, key: str, value: str, alpha: float = 0.05) -> DataFrame:
    """Mean, deviation and interval of repeated runs of an operator."""
    return runs.groupBy(key).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.percentile(value, F.lit(alpha / 2)).alias("low"), F.percentile(value, F.lit(1 - alpha / 2)).alias("high")
    )


def running_total(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    return rows.withColumn("total", F.sum(value).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
