"""Relational parts of learned operators: edges and their features by join, spatial neighbours, pixel channels, likelihoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.numeric import hash_uniform, lgamma
from strandlake.operators import graph as G


def signalling_edges(counts: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(i, j, pair, ligand, receptor): for each edge and ligand-receptor pair the ligand at the source and the receptor at the target.

    counts (cell_id, gene_id, value), edges (i, j), pairs (pair, ligand, receptor), a small table; absent counts are zeros.
    """
    grid = edges.join(F.broadcast(pairs.withColumnRenamed("ligand", "lg").withColumnRenamed("receptor", "rg")), F.lit(True))
    at = lambda cell, gene, name: counts.select(F.col("cell_id").alias(cell), F.col("gene_id").alias(gene), F.col("value").alias(name))
    out = grid.join(at("i", "lg", "ligand"), ["i", "lg"], "left").join(at("j", "rg", "receptor"), ["j", "rg"], "left")
    return out.select("i", "j", "pair", F.coalesce("ligand", F.lit(0.0)).alias("ligand"), F.coalesce("receptor", F.lit(0.0)).alias("receptor"))


def spatial_edges(points: DataFrame, k: int) -> DataFrame:
    """(i, j, d, mutual): the k nearest neighbours in space, mutual being 1 where the reverse edge is one too."""
    near = G.knn(points, k).select("i", "j", "d")
    back = near.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(1.0).alias("mutual"))
    return near.join(back, ["i", "j"], "left").select("i", "j", "d", F.coalesce("mutual", F.lit(0.0)).alias("mutual"))


def factor_edges(counts: DataFrame, n_cells: int, factors: DataFrame) -> DataFrame:
    """(source, target, tf_mean, gene_mean, difference): every factor with every gene, by mean expression over all cells."""
    means = counts.groupBy("gene_id").agg((F.sum("value") / n_cells).alias("m"))
    tf = means.join(F.broadcast(factors.select("gene_id")), "gene_id", "left_semi").select(F.col("gene_id").alias("source"), F.col("m").alias("tf_mean"))
    grid = means.select(F.col("gene_id").alias("target"), F.col("m").alias("gene_mean")).join(F.broadcast(tf), F.lit(True))
    return grid.select("source", "target", "tf_mean", "gene_mean", F.abs(F.col("tf_mean") - F.col("gene_mean")).alias("difference"))


def factor_activity(counts: DataFrame, strengths: DataFrame) -> DataFrame:
    """(cell_id, source, activity): expression weighted by a factor's strengths (source, target, w)."""
    s = strengths.select("source", F.col("target").alias("gene_id"), "w")
    return counts.join(s, "gene_id").groupBy("cell_id", "source").agg(F.sum(F.col("value") * F.col("w")).alias("activity"))


def learnable_pixels(image: DataFrame, gains: dict[str, tuple[float, float]]) -> DataFrame:
    """Image channels through their own gain and bias, then a hyperbolic tangent."""
    return image.withColumns({c: F.tanh(F.col(c) * g + b) for c, (g, b) in gains.items()})


def bernoulli_gate(rows: DataFrame, probability: float, key: str, seed: int = 42, name: str = "applied") -> DataFrame:
    """A column that says, by a hash of the key, whether an operator is applied to the row."""
    return rows.withColumn(name, hash_uniform(seed, key) < probability)


def apply_with_probability(rows: DataFrame, operator, probability: float, key: str, seed: int = 42) -> DataFrame:
    """The operator's output for the rows that the gate picks, the others as they were; it must keep the columns it got."""
    gated = bernoulli_gate(rows, probability, key, seed, "__on")
    changed = operator(gated.filter("__on").drop("__on"))
    return changed.select(*rows.columns).unionByName(gated.filter("not __on").drop("__on"))


def nb_log_likelihood(counts: DataFrame, design: DataFrame, coefficients: DataFrame, dispersion: float = 0.1) -> DataFrame:
    """(gene_id, log_likelihood) of negative binomial counts with mean exp(x . beta + log size factor).

    counts (cell_id, gene_id, value); design (cell_id, x array, size_factor); coefficients (gene_id, beta array), a model.
    Cells without a count row have value 0.
    """
    grid = design.join(F.broadcast(coefficients), F.lit(True)).join(counts, ["cell_id", "gene_id"], "left").withColumn("y", F.coalesce("value", F.lit(0.0)))
    dot = F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    mu, r = F.exp(dot + F.log("size_factor")), 1.0 / dispersion
    y = F.col("y")
    ll = lgamma(y + r) - lgamma(F.lit(r)) - lgamma(y + 1.0) + r * F.log(F.lit(r) / (mu + r)) + y * F.log(mu / (mu + r))
    return grid.groupBy("gene_id").agg(F.sum(ll).alias("log_likelihood"))


def nb_fit(counts: DataFrame, design: DataFrame, dispersion: float = 0.1, rounds: int = 6) -> DataFrame:
    """(gene_id, intercept, slope): coefficients of a negative binomial regression on one covariate, by weighted least squares.

    Every round is one aggregate by gene; design (cell_id, x double, size_factor).
    """
    from strandlake.session import cut_lineage

    genes = counts.select("gene_id").distinct()
    rows = cut_lineage(design.join(F.broadcast(genes), F.lit(True)).join(counts, ["cell_id", "gene_id"], "left").select("gene_id", "x", "size_factor", F.coalesce("value", F.lit(0.0)).alias("y")))
    fit = rows.groupBy("gene_id").agg(F.log(F.greatest(F.sum("y") / F.sum("size_factor"), F.lit(1e-8))).alias("a"), F.lit(0.0).alias("b"))
    for _ in range(rounds):
        eta = F.col("a") + F.col("b") * F.col("x")
        mu = F.greatest(F.exp(eta) * F.col("size_factor"), F.lit(1e-10))
        w = mu / (1 + dispersion * mu)
        z = eta + (F.col("y") - mu) / mu
        s = rows.join(F.broadcast(fit), "gene_id").groupBy("gene_id").agg(
            F.sum(w).alias("w"), F.sum(w * F.col("x")).alias("wx"), F.sum(w * F.col("x") * F.col("x")).alias("wxx"), F.sum(w * z).alias("wz"), F.sum(w * F.col("x") * z).alias("wxz")
        )
        det = F.greatest(F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx"), F.lit(1e-12))
        b = (F.col("w") * F.col("wxz") - F.col("wx") * F.col("wz")) / det
        fit = cut_lineage(s.select("gene_id", ((F.col("wz") - b * F.col("wx")) / F.col("w")).alias("a"), b.alias("b")))
    return fit.select("gene_id", F.col("a").alias("intercept"), F.col("b").alias("slope"))


def masked_distribution(rows: DataFrame, probabilities: str, masked: Column) -> DataFrame:
    """Arrays of probabilities, uniform where masked."""
    p = F.col(probabilities)
    return rows.withColumn(probabilities, F.when(masked, F.transform(p, lambda _: F.lit(1.0) / F.size(p))).otherwise(p))


def invalid_sequences(rows: DataFrame, sequence: str, letters: int = 4) -> DataFrame:
    """Rows whose array of letter distributions has another width than the alphabet, is empty or null: an empty result means valid."""
    s = F.col(sequence)
    return rows.filter(s.isNull() | (F.size(s) == 0) | F.exists(s, lambda v: F.size(v) != letters))


def gap_pattern_loss(weights: DataFrame, continuity: float = 1.0) -> DataFrame:
    """(pair_id, loss) of alignment weights (pair_id, i, j, w): mass that no column takes, and distance from the diagonal."""
    row = weights.groupBy("pair_id", "i").agg(F.sum("w").alias("mass"), F.max("j").alias("j"))
    loose = row.groupBy("pair_id").agg(F.avg(F.abs(1 - F.col("mass"))).alias("unaligned"), F.max("i").alias("n"), F.max("j").alias("m"))
    off = weights.join(loose.select("pair_id", "n", "m"), "pair_id")
    place = F.abs(F.col("i") / F.greatest("n", F.lit(1)) - F.col("j") / F.greatest("m", F.lit(1)))
    spread = off.groupBy("pair_id").agg((F.sum(F.col("w") * place) / F.greatest(F.sum("w"), F.lit(1e-8))).alias("off"))
    return loose.join(spread, "pair_id").select("pair_id", (F.col("unaligned") + continuity * F.col("off")).alias("loss"))


def plausibility_loss(parts: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(id, loss): weighted sum of named loss columns."""
    terms = [F.col(c) * w for c, w in weights.items()]
    return parts.select("id", sum(terms[1:], terms[0]).alias("loss"))


def pair_features(pairs: DataFrame) -> DataFrame:
    """Numeric features of drug-target pairs (pair_id, protein_sequence, drug_smiles): lengths, residue classes, atom marks."""
    p, s = F.upper(F.col("protein_sequence")), F.col("drug_smiles")
    share = lambda x, letters: (F.length(x) - F.length(F.translate(x, letters, ""))) / F.greatest(F.length(x), F.lit(1))
    return pairs.withColumns({
        "protein_length": F.length(p).cast("double"), "hydrophobic": share(p, "AVILMFWY"), "charged": share(p, "DEKR"),
        "drug_length": F.length(s).cast("double"), "hetero": share(s, "NOSnos"), "rings": (F.length(s) - F.length(F.translate(s, "123456789", ""))) / 2.0,
    })
