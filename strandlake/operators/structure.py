"""Structure, dynamics, molecules, multi-omics, losses: relational forms over long tables."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import soft as S
from strandlake.functions.numeric import dot


def tanimoto(a, b, eps: float = 1e-8) -> Column:
    """Continuous Tanimoto similarity of two arrays, in [0, 1]."""
    ab = dot(a, b)
    return F.least(F.greatest(ab / (dot(a, a) + dot(b, b) - ab + eps), F.lit(0.0)), F.lit(1.0))


def cosine(a, b, eps: float = 1e-8) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + eps)


def dice(a, b, eps: float = 1e-8) -> Column:
    return 2 * dot(a, b) / (dot(a, a) + dot(b, b) + eps)


def bit_tanimoto(a, b) -> Column:
    """Tanimoto similarity of fingerprints held as 64-bit words."""
    both = F.bit_count(S.col(a).bitwiseAND(S.col(b)))
    return S.safe_div(both.cast("double"), F.bit_count(S.col(a).bitwiseOR(S.col(b))).cast("double"))


def circular_fingerprint(nodes: DataFrame, edges: DataFrame, radius: int = 2, n_bits: int = 1024) -> DataFrame:
    """(graph_id, bit): hashes of growing neighbourhoods, folded to n_bits. The hash is this library's own."""
    codes = nodes.select("graph_id", "node_id", F.xxhash64("kind").alias("code"))
    seen = codes
    for _ in range(radius):
        near = edges.join(codes.select("graph_id", F.col("node_id").alias("dst"), "code"), ["graph_id", "dst"])
        ring = near.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.array_sort(F.collect_list(F.xxhash64("kind", "code"))).alias("ring"))
        codes = codes.join(ring, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.xxhash64("code", F.coalesce("ring", F.array().cast("array<bigint>"))).alias("code"))
        seen = seen.unionByName(codes)
    return seen.select("graph_id", F.pmod("code", F.lit(n_bits)).alias("bit")).distinct()


def pair_energy(particles: DataFrame, kind: str = "lennard_jones", sigma: float = 1.0, epsilon: float = 1.0, alpha: float = 5.0, cutoff: float | None = 2.5, box: float | None = None) -> DataFrame:
    """(i, energy, fx, fy): potential energy and force of each particle (id, x, y) from those within the cutoff.

    Particles are dealt into cells as wide as the cutoff, so each meets its own and the neighbouring cells only.
    """
    reach = (cutoff or 1e9) * sigma
    a = particles.select(F.col("id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"))
    if cutoff:
        n = max(1, int(box // reach)) if box else None
        cell = lambda c: F.floor(F.col(c) / (box / n if box else reach)).cast("long")
        wrap = (lambda c: F.pmod(c, F.lit(n))) if box else (lambda c: c)
        a = a.withColumns({"cx": wrap(cell("xi")), "cy": wrap(cell("yi"))})
        b = particles.select(F.col("id").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), cell("x").alias("ux"), cell("y").alias("uy"))
        steps = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in (-1, 0, 1) for q in (-1, 0, 1)])
        b = b.withColumn("s", F.explode(steps)).select("j", "xj", "yj", wrap(F.col("ux") + F.col("s.p")).alias("cx"), wrap(F.col("uy") + F.col("s.q")).alias("cy")).distinct()
        pairs = a.join(b, ["cx", "cy"])
    else:
        pairs = a.join(particles.select(F.col("id").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj")), F.lit(True))
    near = lambda d: d - box * F.rint(d / box) if box else d
    p = pairs.filter("i <> j").withColumns({"dx": near(F.col("xi") - F.col("xj")), "dy": near(F.col("yi") - F.col("yj"))})
    p = p.withColumn("r", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)).filter(F.col("r") < reach)
    r = F.col("r")
    if kind == "lennard_jones":
        s6 = F.pow(sigma / r, F.lit(6.0))
        e, slope = 4 * epsilon * (s6 * s6 - s6), -24 * epsilon * (2 * s6 * s6 - s6) / r
    elif kind == "soft_sphere":
        u = F.greatest(1 - r / sigma, F.lit(0.0))
        e, slope = epsilon / 2 * u * u, -epsilon / sigma * u
    elif kind == "morse":
        w = 1 - F.exp(-alpha * (r - sigma))
        e, slope = epsilon * w * w - epsilon, 2 * epsilon * alpha * w * (1 - w)
    else:
        raise ValueError(f"unknown potential {kind}")
    got = p.groupBy("i").agg((F.sum(e) / 2).alias("energy"), F.sum(-slope * F.col("dx") / r).alias("fx"), F.sum(-slope * F.col("dy") / r).alias("fy"))
    return particles.select(F.col("id").alias("i")).join(got, "i", "left").na.fill(0.0)


def hbond_map(residues: DataFrame, cutoff: float = -0.5, margin: float = 1.0, reach: float = 10.0, by: list[str] | None = None) -> DataFrame:
    """(by, donor, acceptor, h): continuous Kabsch-Sander hydrogen bonds between backbone residues whose N and O are within reach.

    residues (by, pos, n, ca, c, o), each an array of three coordinates; `by` names a chain or model, whose residues bond
    with each other only. The hydrogen lies 1 A from N, opposite to the mean direction of CA and the previous C. Beyond
    10 A the energy is far above any cutoff in use, so residues meet in neighbouring cells of that width.
    """
    by = by or []
    sub = lambda p, q: F.zip_with(p, q, lambda u, v: u - v)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))

    def unit(v):
        return F.transform(v, lambda x: x / (size(v) + 1e-8))

    d = residues.withColumn("c0", F.lag("c").over(Window.partitionBy(*by).orderBy("pos"))).filter(F.col("c0").isNotNull())
    d = d.withColumn("u", unit(sub("ca", "n"))).withColumn("v", unit(sub("c0", "n")))
    d = d.withColumn("dir", F.zip_with("u", "v", lambda a, b: -(a + b)))
    d = d.withColumn("h", F.zip_with("n", unit(F.col("dir")), lambda a, b: a + b))
    cell = lambda v, i: F.floor(F.col(v)[i] / reach)
    donors = d.select(*by, F.col("pos").alias("donor"), F.col("n").alias("dn"), F.col("h").alias("dh"), *[cell("n", i).alias(f"k{i}") for i in range(3)])
    around = F.array(*[F.struct(*[F.lit(v).alias(f"d{i}") for i, v in enumerate(s)]) for s in itertools.product((-1, 0, 1), repeat=3)])
    acceptors = residues.select(*by, F.col("pos").alias("acceptor"), F.col("c").alias("ac"), F.col("o").alias("ao"), F.explode(around).alias("s"))
    acceptors = acceptors.select(*by, "acceptor", "ac", "ao", *[(cell("ao", i) + F.col(f"s.d{i}")).alias(f"k{i}") for i in range(3)])
    pairs = donors.join(acceptors, [*by, "k0", "k1", "k2"]).filter((F.abs(F.col("donor") - F.col("acceptor")) >= 2) & (size(sub("dn", "ao")) + 1e-8 < reach))
    inv = lambda p, q: 1 / (size(sub(p, q)) + 1e-8)
    e = 27.9 * (inv("ao", "dn") + inv("ac", "dh") - inv("ao", "dh") - inv("ac", "dn"))
    x = F.least(F.greatest((cutoff - e - margin) / margin, F.lit(-1.0)), F.lit(1.0))
    return pairs.select(*by, "donor", "acceptor", ((1 + F.sin(x * math.pi / 2)) / 2).alias("h"))


def secondary_structure(residues: DataFrame, bonds: DataFrame, temperature: float = 0.1) -> DataFrame:
    """(pos, loop, helix, strand): soft classes from i to i-3 and i-4 bonds, and the strongest bond beyond four residues."""
    helix = bonds.filter((F.col("donor") - F.col("acceptor")).isin(3, 4)).groupBy(F.col("donor").alias("pos")).agg((F.sum("h") / 2).alias("helix"))
    far = bonds.filter(F.abs(F.col("donor") - F.col("acceptor")) > 4)
    ends = far.select(F.col("donor").alias("pos"), "h").unionByName(far.select(F.col("acceptor").alias("pos"), "h"))
    strand = ends.groupBy("pos").agg(F.max("h").alias("strand"))
    s = residues.select("pos").join(helix, "pos", "left").join(strand, "pos", "left").na.fill(0.0)
    s = s.withColumn("loop", 1 - F.greatest("helix", "strand"))
    e = {c: F.exp(F.col(c) / temperature) for c in ("loop", "helix", "strand")}
    total = e["loop"] + e["helix"] + e["strand"]
    return s.select("pos", *[(v / total).alias(c) for c, v in e.items()])


def base_pair_softmax(sequences: DataFrame, least_loop: int = 3, temperature: float = 1.0) -> DataFrame:
    """(seq_id, i, j, p): a softmax of minus pairing energy over all pairs further apart than a loop, both orders; sums to 1."""
    from strandlake.operators.kernels import PAIR_ENERGY

    letters = sequences.select("seq_id", F.posexplode(F.filter(F.split(F.translate(F.upper("sequence"), "T", "U"), ""), lambda c: c != "")).alias("i", "a"))
    other = letters.select("seq_id", F.col("i").alias("j"), F.col("a").alias("b"))
    pairs = letters.join(other, "seq_id").filter(F.abs(F.col("i") - F.col("j")) > least_loop)
    e = F.lit(0.0)
    for (x, y), v in PAIR_ENERGY.items():
        e = F.when(((F.col("a") == x) & (F.col("b") == y)) | ((F.col("a") == y) & (F.col("b") == x)), v).otherwise(e)
    w = pairs.select("seq_id", "i", "j", F.exp(-e / temperature).alias("w"))
    total = w.groupBy("seq_id").agg(F.sum("w").alias("t"))
    return w.join(total, "seq_id").select("seq_id", "i", "j", (F.col("w") / F.col("t")).alias("p"))


def product_of_experts(rows: DataFrame, sample: str, mean: str, logvar: str) -> DataFrame:
    """Precision-weighted mean and log-variance over the modalities of each sample."""
    p = F.exp(-F.col(logvar))
    return rows.groupBy(sample).agg((F.sum(F.col(mean) * p) / F.sum(p)).alias("mean"), (-F.log(F.sum(p))).alias("logvar"))


def spatial_variance_fraction(values: DataFrame, smooth: DataFrame) -> DataFrame:
    """(feature, fraction, p): share of each feature's variance that smoothing over space explains."""
    both = values.join(smooth.withColumnRenamed("value", "fitted"), ["id", "feature"])
    r = F.var_pop(F.col("value") - F.col("fitted"))
    t = F.var_pop("value")
    g = both.groupBy("feature").agg(t.alias("t"), r.alias("r"), F.count("*").alias("n"))
    f = F.greatest(F.col("t") - F.col("r"), F.lit(0.0)) / (F.col("t") + 1e-8)
    return g.select("feature", f.alias("fraction"), S.logistic(2.0 - f * F.col("n")).alias("p"))


def ks_distance(values: DataFrame, gene: str, value: str, condition: str) -> DataFrame:
    """(gene, ks, mean_shift, variance_ratio, zero_difference) between conditions 0 and 1, by cumulative counts."""
    g = values.groupBy(gene, F.col(value).alias("v")).agg(F.sum((F.col(condition) == 0).cast("long")).alias("a"), F.sum((F.col(condition) == 1).cast("long")).alias("b"))
    w = Window.partitionBy(gene).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(gene)
    gap = F.abs(F.sum("a").over(w) / F.sum("a").over(whole) - F.sum("b").over(w) / F.sum("b").over(whole))
    ks = g.withColumn("gap", gap).groupBy(gene).agg(F.max("gap").alias("ks"))
    side = lambda k: F.when(F.col(condition) == k, F.col(value))
    m = values.groupBy(gene).agg(
        (F.avg(side(1)) - F.avg(side(0))).alias("mean_shift"),
        (F.var_pop(side(1)) / (F.var_pop(side(0)) + 1e-8)).alias("variance_ratio"),
        (F.avg((side(1) == 0).cast("double")) - F.avg((side(0) == 0).cast("double"))).alias("zero_difference"),
    )
    return ks.join(m, gene)


def markov_chain(edges: DataFrame) -> DataFrame:
    """(i, j, p): weights normalised by row."""
    return edges.select("i", "j", (F.col("w") / F.sum("w").over(Window.partitionBy("i"))).alias("p"))


def rbf_mmd(pairs: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Squared maximum mean discrepancy from pair distances (bi, bj, d): batch 0 against batch 1."""
    k = F.exp(-gamma * F.col("d") ** 2)
    mean = lambda a, b: F.avg(F.when((F.col("bi") == a) & (F.col("bj") == b), k))
    return pairs.agg((mean(0, 0) + mean(1, 1) - 2 * mean(0, 1)).alias("mmd"))


# Losses
def masked_loss(rows: DataFrame, predicted: str, target: str, mask: str, kind: str = "mse", eps: float = 1e-8) -> DataFrame:
    d = F.col(predicted) - F.col(target)
    e = d * d if kind == "mse" else F.abs(d)
    return rows.agg((F.sum(e * F.col(mask)) / (F.sum(mask) + eps)).alias("loss"))


def soft_edit_distance(pairs: DataFrame, temperature: float = 0.1, normalise: bool = True) -> DataFrame:
    """(pair_id, distance) of strings a and b: expected unmatched positions under row and column softmaxes of equality.

    Every position of one side has the same weight for equal letters of the other, so letter counts suffice.
    """
    n = lambda s: F.length(s).cast("double")

    def matched(s, t):
        per = lambda c: n(t) - F.length(F.replace(t, c, F.lit("")))
        hit = math.exp(1.0 / temperature)
        return F.aggregate(
            F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0.0), lambda acc, c: acc + per(c) * hit / (per(c) * hit + (n(t) - per(c)))
        )

    a, b = F.col("a"), F.col("b")
    total = F.greatest((n(a) - matched(a, b) + n(b) - matched(b, a)) / 2, F.lit(0.0)) + F.abs(n(a) - n(b))
    return pairs.select("pair_id", (total / (n(a) + n(b)) if normalise else total).alias("distance"))


def gc_regularisation(sequences: DataFrame, target: float = 0.5, tolerance: float = 0.1) -> DataFrame:
    from strandlake.functions.sequence import gc_content

    x = S.softrelu(F.abs(gc_content("sequence") - target) - tolerance, 0.1)
    return sequences.select("seq_id", (x * x).alias("loss"))


def complexity_loss(sequences: DataFrame, least: float = 1.0) -> DataFrame:
    """(seq_id, loss): squared shortfall of the letter entropy."""
    n = F.length("sequence")
    terms = []
    for b in "ACGT":
        p = (n - F.length(F.replace("sequence", F.lit(b), F.lit("")))) / n
        terms.append(F.when(p > 0, -p * F.log(p)).otherwise(0.0))
    h = sum(terms[1:], terms[0])
    return sequences.filter(n > 0).select("seq_id", F.pow(F.greatest(least - h, F.lit(0.0)), F.lit(2.0)).alias("loss"))


def shannon_diversity(assignments: DataFrame, key: str = "id", p: str = "p") -> DataFrame:
    per = assignments.groupBy(key).agg((-F.sum(F.col(p) * F.log(F.col(p) + 1e-10))).alias("h"), F.sum(F.col(p) ** 2).alias("s"))
    return per.agg(F.avg("h").alias("shannon"), F.avg("s").alias("simpson"))


def compactness_loss(assignments: DataFrame, distances: DataFrame, centres: DataFrame, separation: float = 1.0, weight: float = 1.0) -> DataFrame:
    """Mean assigned squared distance plus the mean hinge of too-near centres (i, j, d)."""
    n = distances.select("id").distinct().count()
    inside = assignments.join(distances, ["id", "cluster"]).agg((F.sum(F.col("p") * F.col("d2")) / n).alias("inside"))
    apart = centres.filter("i < j").agg(F.avg(F.greatest(separation - F.col("d"), F.lit(0.0))).alias("apart"))
    return inside.join(apart, F.lit(True)).select((F.col("inside") + weight * F.col("apart")).alias("loss"))


def velocity_consistency(rows: DataFrame) -> DataFrame:
    """Cosine loss of velocity against the step to the future, plus the squared difference of their lengths."""
    step = F.zip_with("future", "expression", lambda a, b: a - b)
    nv, ns = F.sqrt(dot("velocity", "velocity")), F.sqrt(dot(step, step))
    loss = 1 - dot("velocity", step) / (nv * ns + 1e-8) + F.pow(nv - ns, F.lit(2.0))
    return rows.agg(F.avg(loss).alias("loss"))


def vae_loss(rows: DataFrame, beta: float = 1.0) -> DataFrame:
    """Mean squared reconstruction plus beta times the divergence from a standard normal."""
    d = F.zip_with("x", "x_recon", lambda a, b: (a - b) * (a - b))
    recon = F.aggregate(d, F.lit(0.0), lambda acc, v: acc + v) / F.size("x")
    kl = F.zip_with("mean", "logvar", lambda m, v: -0.5 * (1 + v - m * m - F.exp(v)))
    return rows.agg(F.avg(recon + beta * F.aggregate(kl, F.lit(0.0), lambda acc, v: acc + v)).alias("loss"))
