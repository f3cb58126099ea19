"""Single-cell operators over the star schema: counts(cell_id, gene_id, value), zeros omitted, and obs(cell_id, ...)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import soft as S
from strandlake.functions.numeric import hash_uniform, normal_cdf
from strandlake.functions.order import global_running, top_k_mask
from strandlake.operators import graph as G
from strandlake.session import cut_lineage


def library_sizes(counts: DataFrame) -> DataFrame:
    return counts.groupBy("cell_id").agg(F.sum("value").alias("library_size"))


def normalize_counts(counts: DataFrame, target: float = 1e4, exponent: float = 1.0, pseudocount: float = 1.0) -> DataFrame:
    """value becomes ln(value * (target / library) ^ exponent + pseudocount). With pseudocount 1 absent zeros stay 0."""
    library = F.greatest(F.sum("value").over(Window.partitionBy("cell_id")), F.lit(1.0))
    return counts.withColumn("value", F.log(F.col("value") * F.pow(F.lit(target) / library, F.lit(exponent)) + pseudocount))


def gene_moments(counts: DataFrame, n_cells: int) -> DataFrame:
    """(gene_id, mean, variance) over all cells, absent rows being zeros; population variance."""
    mean = F.sum("value") / n_cells
    return counts.groupBy("gene_id").agg(mean.alias("mean"), F.greatest(F.sum(F.col("value") * F.col("value")) / n_cells - mean * mean, F.lit(0.0)).alias("variance"))


def gene_dispersion(counts: DataFrame, n_cells: int) -> DataFrame:
    """(gene_id, mean, variance, dispersion): variance over mean, a zero mean counting as one."""
    m = gene_moments(counts, n_cells)
    return m.withColumn("dispersion", F.col("variance") / F.when(F.col("mean") == 0, 1.0).otherwise(F.col("mean")))


def highly_variable_genes(counts: DataFrame, n_cells: int, n_top: int, weight: float = 0.0) -> DataFrame:
    """Dispersion times softplus(weight), and a mask of its n_top greatest."""
    d = gene_dispersion(counts, n_cells).withColumn("score", F.col("dispersion") * S.softplus(F.lit(weight)))
    return top_k_mask(d, "score", n_top, "gene_id", name="selected")


def standardize(counts: DataFrame, cells: DataFrame, clip: float = 10.0) -> DataFrame:
    """Dense z-scores per gene (population variance; a zero deviation counts as one), clipped to +-clip.

    Gene moments are a small table by gene; the dense grid is cells x genes by definition of the result.
    """
    n = cells.count()
    m = gene_moments(counts, n)
    grid = cells.select("cell_id").crossJoin(F.broadcast(m)).join(counts, ["cell_id", "gene_id"], "left")
    z = (F.coalesce("value", F.lit(0.0)) - F.col("mean")) / F.when(F.col("variance") > 1e-12, F.sqrt("variance")).otherwise(1.0)
    return grid.select("cell_id", "gene_id", S.soft_clip(z, -clip, clip, mode="hard").alias("z"))


def arcsinh_transform(counts: DataFrame, cofactor: float = 5.0) -> DataFrame:
    return counts.withColumn("value", F.asinh(F.col("value") / cofactor))


def tfidf(counts: DataFrame, n_cells: int, scale: float = 1e4) -> DataFrame:
    """log1p(tf * idf * scale) of stored entries: tf = value / cell total, idf = cells / gene total."""
    tf = F.col("value") / F.sum("value").over(Window.partitionBy("cell_id"))
    genes = counts.groupBy("gene_id").agg(F.sum("value").alias("t"))
    idf = F.lit(float(n_cells)) / F.when(F.col("t") == 0, 1.0).otherwise(F.col("t"))
    return counts.withColumn("tf", tf).join(genes, "gene_id").select("cell_id", "gene_id", F.log1p(F.col("tf") * idf * scale).alias("value"))


def cluster_assignments(points: DataFrame, centroids: DataFrame, temperature: float = 1.0) -> DataFrame:
    """(id, cluster, p, hard): softmax of minus squared distance to each centroid; hard is the most likely one.

    centroids (cluster, centre array) is a model: its rows are fixed by the caller, not by the data.
    """
    d = F.aggregate(F.zip_with("vec", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)
    pairs = points.select("id", "vec").join(F.broadcast(centroids), F.lit(True)).select("id", "cluster", (-d / temperature).alias("s"))
    w = Window.partitionBy("id")
    e = pairs.withColumn("e", F.exp(F.col("s") - F.max("s").over(w)))
    first = F.row_number().over(w.orderBy(F.col("s").desc(), F.col("cluster")))
    return e.select("id", "cluster", (F.col("e") / F.sum("e").over(w)).alias("p"), (first == 1).alias("hard"))


def cluster_means(points: DataFrame, by: str = "label") -> DataFrame:
    """(cluster, centre): mean vector of each label."""
    long = points.select(F.col(by).alias("cluster"), F.posexplode("vec").alias("k", "v"))
    m = long.groupBy("cluster", "k").agg(F.avg("v").alias("v"))
    return m.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("centre"))


def harmony_step(points: DataFrame, centroids: DataFrame, sigma: float = 1.0, temperature: float = 1.0, pull: float = 0.1) -> DataFrame:
    """One correction: a pull toward the soft centroid, scaled by the batch's share in the top cluster against its global share."""
    a = cluster_assignments(points, centroids, sigma * temperature)
    total = points.count()
    top = a.filter("hard").select("id", F.col("cluster").alias("top"))
    batches = points.select("id", "batch").join(top, "id")
    in_top = batches.groupBy("top", "batch").count().withColumnRenamed("count", "n")
    sizes = batches.groupBy("top").agg(F.count("*").alias("m"))
    overall = points.groupBy("batch").agg((F.count("*") / total).alias("share"))
    ratio = F.least(F.greatest((F.col("n") / F.col("m")) / F.col("share"), F.lit(0.5)), F.lit(2.0))
    factor = batches.join(in_top, ["top", "batch"]).join(sizes, "top").join(F.broadcast(overall), "batch").select("id", ratio.alias("factor"))
    mixed = a.join(F.broadcast(centroids), "cluster").select("id", F.posexplode(F.transform("centre", lambda c: c * F.col("p"))).alias("k", "v"))
    target = mixed.groupBy("id", "k").agg(F.sum("v").alias("v")).groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("target")
    )
    moved = F.zip_with("vec", "target", lambda x, t: x + F.col("factor") * pull * (t - x))
    return points.join(target, "id").join(factor, "id").select("id", moved.alias("vec"), "batch", "label")


def ambient_removal(counts: DataFrame, contamination: float = 0.1) -> DataFrame:
    """max(value - contamination * profile * library, 0), the profile being each gene's share of all counts."""
    total = counts.agg(F.sum("value").alias("t"))
    profile = counts.groupBy("gene_id").agg(F.sum("value").alias("g")).join(F.broadcast(total), F.lit(True)).select("gene_id", (F.col("g") / F.col("t")).alias("profile"))
    library = F.sum("value").over(Window.partitionBy("cell_id"))
    left = F.greatest(F.col("value") - contamination * F.col("profile") * F.col("library"), F.lit(0.0))
    return counts.withColumn("library", library).join(profile, "gene_id").select("cell_id", "gene_id", left.alias("value"))


def doublet_scores(cells: DataFrame, simulated: DataFrame, k: int, rate: float = 0.06, ratio: float = 2.0) -> DataFrame:
    """(id, simulated_neighbours, score) of real cells from the share of simulated doublets among k_adj neighbours."""
    n, m = cells.count(), simulated.count()
    k_adj = round(k * (1 + m / n))
    both = cells.select("id", "vec", F.lit(True).alias("real")).unionByName(simulated.select("id", "vec", F.lit(False).alias("real")))
    near = G.knn(cut_lineage(both), k_adj, asked="real")
    marked = near.join(simulated.select(F.col("id").alias("j"), F.lit(1.0).alias("fake")), "j", "left")
    got = marked.groupBy("i").agg(F.coalesce(F.sum("fake"), F.lit(0.0)).alias("c"))
    q = (F.col("c") + 1) / (k_adj + 2)
    score = q * rate / ratio / F.greatest(1 - rate - q * (1 - rate - rate / ratio), F.lit(1e-8))
    return cells.join(got, F.col("id") == F.col("i")).select("id", F.col("c").alias("simulated_neighbours"), score.alias("score"))


def simulate_doublets(counts: DataFrame, cells: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """(cell_id, gene_id, value) of n summed random pairs of cells, numbered -1, -2, ...; pairs come from a hash order."""
    ids = global_running(cells.select("cell_id"), [F.col("cell_id")], position="r").withColumn("r", F.col("r") - 1)
    total = cells.count()
    draw = lambda s: F.floor(hash_uniform(s, "k") * total)
    pairs = cells.sparkSession.range(1, n + 1).withColumnRenamed("id", "k")
    pairs = pairs.select("k", F.explode(F.array(draw(seed), draw(seed + 1))).alias("r"))
    return pairs.join(ids, "r").join(counts, "cell_id").groupBy((-F.col("k")).alias("cell_id"), "gene_id").agg(F.sum("value").alias("value"))


def diffusion_affinity(points: DataFrame, k: int, decay: float = 1.0) -> DataFrame:
    """(i, j, w): row-stochastic affinities exp(-(d / sigma_i) ^ decay), sigma the k-th neighbour's distance, symmetrised by the mean."""
    pairs = G.pairwise_distances(points)
    place = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    sigma = pairs.withColumn("r", place).filter(F.col("r") == k + 1).select("i", F.col("d").alias("sigma"))
    a = pairs.join(sigma, "i").select("i", "j", F.exp(-F.pow(F.col("d") / F.greatest("sigma", F.lit(1e-8)), F.lit(decay))).alias("a"))
    both = a.join(a.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("a").alias("b")), ["i", "j"]).select("i", "j", ((F.col("a") + F.col("b")) / 2).alias("a"))
    return both.select("i", "j", (F.col("a") / F.sum("a").over(Window.partitionBy("i"))).alias("w"))


def diffuse(values: DataFrame, weights: DataFrame, steps: int = 1) -> DataFrame:
    """(id, feature, value): weights applied `steps` times to (id, feature, value)."""
    for _ in range(steps):
        values = weights.join(values, weights["j"] == values["id"]).groupBy("i", "feature").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
        values = values.withColumnRenamed("i", "id")
    return values


def diffuse_points(points: DataFrame, features: list[str], k: int, decay: float = 1.0, steps: int = 1) -> DataFrame:
    """(id, features): columns of (id, vec, features) after `steps` of diffuse with the weights of diffusion_affinity.

    Each step is a pass over pairs of blocks, whose kernels weigh and sum; no weight is ever listed.
    """
    rows = cut_lineage(points.select(F.col("id").cast("long").alias("id"), "vec", *[F.col(f).cast("double").alias(f) for f in features]))
    width = G.kth_distance(rows, k).select("id", F.greatest("sigma", F.lit(1e-8)).alias("sigma"))
    fixed = cut_lineage(rows.select("id", "vec").join(width, "id"))
    names, tiles = [*features, "__total"], G.met_tiles

    def kernel(left, right):
        other = left if right is None else right
        p, q = (x.column("sigma").to_numpy() for x in (left, other))
        v, u = (np.column_stack([*[x.column(f).to_numpy() for f in features], np.ones(x.num_rows)]) for x in (left, other))
        there, back = np.zeros_like(v), np.zeros_like(u)
        for s, t, d, _ in tiles(left, right):
            x, y = d / p[s][:, None], d / q[t][None, :]
            a = np.exp(-(x if decay == 1 else x**decay))
            a += np.exp(-(y if decay == 1 else y**decay))
            a *= 0.5
            there[s] += a @ u[t]
            back[t] += a.T @ v[s]
        sums = [(left, there)] + ([(other, back)] if right is not None else [])
        got = np.concatenate([x for _, x in sums])
        return pa.table({"id": np.concatenate([x.column("id").to_numpy() for x, _ in sums]), **{n: np.ascontiguousarray(got[:, i]) for i, n in enumerate(names)}})

    values = rows.select("id", *features)
    for _ in range(steps):
        met = G.meet_in_pairs(fixed.join(values, "id"), kernel, "id long, " + ", ".join(f"{n} double" for n in names))
        whole = met.groupBy("id").agg(*[F.sum(n).alias(n) for n in names])
        values = cut_lineage(whole.select("id", *[(F.col(f) / F.col("__total")).alias(f) for f in features]))
    return values


def rna_velocity(layers: DataFrame, beta: float = 1.0, gamma: float = 0.5, dt: float = 0.1, steps: int = 3) -> DataFrame:
    """(cell_id, gene_id, velocity, projected): beta u - gamma s, and Euler steps of s with floor 0."""
    v = lambda s: beta * F.col("unspliced") - gamma * s
    s = F.col("spliced")
    for _ in range(steps):
        s = F.greatest(s + dt * v(s), F.lit(0.0))
    return layers.select("cell_id", "gene_id", v(F.col("spliced")).alias("velocity"), s.alias("projected"))


def switch_expression(times: DataFrame, genes: DataFrame, temperature: float = 0.1) -> DataFrame:
    """amplitude * logistic((t - t_switch) / T) + baseline for each cell and gene of a parameter table."""
    p = times.join(F.broadcast(genes), F.lit(True))
    return p.select("cell_id", "gene_id", (F.col("amplitude") * S.logistic((F.col("t") - F.col("t_switch")) / temperature) + F.col("baseline")).alias("expected"))


def ligand_receptor(counts: DataFrame, edges: DataFrame, pairs: DataFrame, kh: float = 0.5, n: float = 2.0, temperature: float = 1.0, eps: float = 1e-8) -> DataFrame:
    """(i, ligand, receptor, score): neighbours' mean ligand times own receptor through a Hill function."""
    degree = edges.groupBy("i").agg(F.count("*").alias("deg"))
    near = edges.join(counts.withColumnRenamed("cell_id", "j"), "j").groupBy("i", "gene_id").agg(F.sum("value").alias("v")).join(degree, "i")
    ligand = near.select("i", F.col("gene_id").alias("ligand"), (F.col("v") / F.col("deg")).alias("l"))
    own = counts.select(F.col("cell_id").alias("i"), F.col("gene_id").alias("receptor"), F.col("value").alias("r"))
    both = ligand.join(F.broadcast(pairs), "ligand").join(own, ["i", "receptor"])
    p = F.pow(F.col("l") * F.col("r"), F.lit(n))
    return both.select("i", "ligand", "receptor", (p / (kh**n + p + eps)).alias("score"))


def downsample(counts: DataFrame, target: float, seed: int = 13) -> DataFrame:
    """Expected counts value * min(target / library, 1), rounded at random by a hash of the entry."""
    f = F.least(F.lit(target) / F.sum("value").over(Window.partitionBy("cell_id")), F.lit(1.0))
    e = F.col("value") * f
    up = hash_uniform(seed, "cell_id", "gene_id") < (e - F.floor(e))
    return counts.select("cell_id", "gene_id", (F.floor(e) + up.cast("long")).cast("double").alias("value"))


def knockdown_filter(counts: DataFrame, obs: DataFrame, control: str = "non-targeting", residual: float = 0.3, cell_residual: float = 0.5, least_cells: int = 30) -> DataFrame:
    """(cell_id, kept): controls always; perturbed cells by the mean and own residual expression of their target gene."""
    own = obs.join(
        counts.withColumnRenamed("gene_id", "perturbation").withColumnRenamed("value", "target"), ["cell_id", "perturbation"], "left"
    ).select("cell_id", "perturbation", F.coalesce("target", F.lit(0.0)).alias("target"))
    known = counts.select(F.col("gene_id").alias("perturbation")).distinct()
    n_control = obs.filter(F.col("perturbation") == control).count()
    base = counts.join(obs.filter(F.col("perturbation") == control).select("cell_id"), "cell_id", "left_semi")
    base = base.groupBy(F.col("gene_id").alias("perturbation")).agg((F.sum("value") / n_control).alias("base"))
    perturbed = own.filter(F.col("perturbation") != control).join(known, "perturbation", "left_semi").join(F.broadcast(base), "perturbation", "left")
    w = Window.partitionBy("perturbation")
    mean = F.avg("target").over(w)
    good = F.coalesce((F.col("base") > 1e-8) & (F.col("mean") / F.col("base") < residual) & (F.col("target") / F.col("base") < cell_residual), F.lit(False))
    kept = perturbed.withColumn("mean", mean).withColumn("good", good).withColumn("n", F.sum(F.col("good").cast("long")).over(w))
    kept = kept.filter(F.col("good") & (F.col("n") >= least_cells)).select("cell_id", F.lit(True).alias("k"))
    return obs.join(kept, "cell_id", "left").select("cell_id", (F.coalesce("k", F.lit(False)) | (F.col("perturbation") == control)).alias("kept"))


def stochastic_gate(mu: DataFrame, sigma: float = 0.5, seed: int = 3) -> DataFrame:
    """(gene_id, gate, penalty): clip(mu + noise, 0, 1) and the normal CDF of mu / sigma."""
    from strandlake.functions.numeric import hash_normal

    noise = sigma * hash_normal(seed, "gene_id")
    return mu.select("gene_id", F.least(F.greatest(F.col("mu") + noise, F.lit(0.0)), F.lit(1.0)).alias("gate"), normal_cdf(F.col("mu") / sigma).alias("penalty"))


def marker_annotation(counts: DataFrame, markers: DataFrame, eps: float = 1e-8) -> DataFrame:
    """(cell_id, cell_type, p): softmax over types of the Poisson log-likelihood of marker genes (markers: cell_type, gene_id, rate)."""
    grid = counts.select("cell_id").distinct().join(F.broadcast(markers), F.lit(True)).join(counts, ["cell_id", "gene_id"], "left")
    ll = F.sum(F.coalesce("value", F.lit(0.0)) * F.log(F.col("rate") + eps) - F.col("rate"))
    s = grid.groupBy("cell_id", "cell_type").agg(ll.alias("s"))
    w = Window.partitionBy("cell_id")
    e = s.withColumn("e", F.exp(F.col("s") - F.max("s").over(w)))
    return e.select("cell_id", "cell_type", (F.col("e") / F.sum("e").over(w)).alias("p"))


def size_factors(counts: DataFrame, n_genes: int) -> DataFrame:
    """(cell_id, size_factor): exp of the median over genes of log(x + 1) minus the gene's mean, scaled to geometric mean 1."""
    n = counts.select("cell_id").distinct().count()
    genes = counts.groupBy("gene_id").agg((F.sum(F.log1p("value")) / n).alias("m"))
    grid = counts.select("cell_id").distinct().join(F.broadcast(genes), F.lit(True)).join(counts, ["cell_id", "gene_id"], "left")
    med = grid.groupBy("cell_id").agg(F.median(F.log1p(F.coalesce("value", F.lit(0.0))) - F.col("m")).alias("lf"))
    return med.join(F.broadcast(med.agg(F.avg("lf").alias("centre"))), F.lit(True)).select("cell_id", F.exp(F.col("lf") - F.col("centre")).alias("size_factor"))


def wald(effects: DataFrame, threshold: float = 0.05, temperature: float = 0.01) -> DataFrame:
    """(gene_id, z, p, log2_fold, significance) from beta and its standard error, by a logistic normal tail."""
    z = F.col("beta") / F.col("se")
    p = 2 * (1 - S.logistic(1.7 * F.abs(z)))
    return effects.select(
        "gene_id", z.alias("z"), p.alias("p"), (F.col("beta") / math.log(2)).alias("log2_fold"), S.logistic((threshold - p) / temperature).alias("significance")
    )


def fate_probabilities(steps: DataFrame, n_terminal: int) -> DataFrame:
    """(state, terminal, p): the chance that a walk over observed steps (source, target) ends in each terminal state.

    The n_terminal greatest states are terminal. Transitions are counted by Spark; their table has a row for each pair of
    states, which are clusters, and its small linear system is solved by the driver.
    """
    import numpy as np

    from strandlake.operators.kernels import absorption_probabilities

    n = steps.groupBy("source", "target").count().collect()
    states = sorted({r["source"] for r in n} | {r["target"] for r in n})
    at = {s: i for i, s in enumerate(states)}
    m = np.zeros((len(states), len(states)))
    for r in n:
        m[at[r["source"]], at[r["target"]]] = r["count"]
    m /= np.maximum(m.sum(1, keepdims=True), 1)
    ends = np.arange(len(states)) >= len(states) - n_terminal
    p = absorption_probabilities(m, ends)
    rows = [(s, states[t], float(p[i, k])) for i, s in enumerate(states) for k, t in enumerate(np.nonzero(ends)[0])]
    return steps.sparkSession.createDataFrame(rows, f"state {steps.schema['source'].dataType.simpleString()}, terminal {steps.schema['target'].dataType.simpleString()}, p double")


def sparse_dynamics(rows: DataFrame, columns: list[str], change: str, degree: int = 2, threshold: float = 0.1, rounds: int = 10, ridge: float = 1e-3) -> DataFrame:
    """(term, weight): the change regressed on a polynomial library of the columns, by one ridge solve and repeated soft thresholds.

    The library has the columns and, for degree 2, their products; its Gram matrix is one aggregate, whatever the rows.
    """
    import numpy as np

    terms = [(c, F.col(c)) for c in columns]
    if degree > 1:
        terms += [(f"{a}*{b}", F.col(a) * F.col(b)) for i, a in enumerate(columns) for b in columns[i:]]
    cols = [t.cast("double") for _, t in terms] + [F.col(change).cast("double")]
    n = len(cols)
    sums = rows.agg(*[F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    m = np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    xi = np.linalg.solve(m[:-1, :-1] + ridge * np.eye(n - 1), m[:-1, -1])
    for _ in range(rounds):
        xi = xi / (1 + np.exp(-(np.abs(xi) - threshold) / 0.01))
    return rows.sparkSession.createDataFrame([(name, float(v)) for (name, _), v in zip(terms, xi)], "term string, weight double")
