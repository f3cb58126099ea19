"""Reads, pileups, variants, coverage, peaks, motifs, spectra and statistics over long tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import soft as S
from strandlake.functions.numeric import array_softmax, dot, let, lgamma
from strandlake.functions.sequence import BASES, phred_to_probability


def quality_filter(reads: DataFrame, threshold: float = 20.0, temperature: float = 1.0, mode: str = "smooth") -> DataFrame:
    """A weight for each base: soft q > threshold; mode hard filters instead, which pushes down."""
    if mode == "hard":
        return reads.filter(F.col("quality") > threshold).withColumn("weight", F.lit(1.0))
    return reads.withColumn("weight", S.greater("quality", threshold, temperature, mode))


def adapter_trim(reads: DataFrame, adapter: str, least_overlap: int = 3, least_score: float = 0.8) -> DataFrame:
    """Hard adapter removal: cut at the first start whose overlap with the adapter matches well enough."""
    s, n = F.col("sequence"), F.length("sequence")
    letters, own = F.filter(F.split(s, ""), lambda c: c != ""), F.array(*[F.lit(c) for c in adapter])

    def fits(text, start):
        k = F.least(F.lit(len(adapter)), n - start)
        pairs = F.zip_with(F.slice(text, start + 1, k), F.slice(own, F.lit(1), k), lambda a, b: (a == b).cast("int"))
        return (k >= least_overlap) & (F.aggregate(pairs, F.lit(0), lambda acc, v: acc + v) / k >= least_score)

    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    # An array of letters, made once: places of a string would be sought from its start each time.
    hits = let(letters, lambda text: F.filter(starts, lambda i: fits(text, i)))
    cut = F.coalesce(F.try_element_at(hits, F.lit(1)), n)
    return reads.withColumn("trim_at", cut.cast("long")).withColumn("trimmed", F.substring(s, F.lit(1), cut))


def soft_adapter(reads: DataFrame, adapter: str, least_overlap: int = 3, threshold: float = 0.5, temperature: float = 1.0, match: float = 2.0, mismatch: float = -1.0) -> DataFrame:
    """Soft adapter removal: trim_at and retained, an array with a weight for each base.

    Every start has the score of its overlap with the adapter, over twice the overlap's length (0 if that is too short).
    The trim position is the mean start under a softmax of what exceeds the threshold, or the read's end where nothing
    does; a base is retained by a logistic of the trim position less its own.
    """
    n = F.length("sequence")
    letters = F.filter(F.split("sequence", ""), lambda c: c != "")
    own = F.array(*[F.lit(c) for c in adapter])

    def score(s, start):
        k = F.least(F.lit(len(adapter)), n - start)
        pairs = F.zip_with(F.slice(s, start + 1, k), F.slice(own, F.lit(1), k), lambda a, b: F.when(a == b, match).otherwise(mismatch))
        return F.when(k >= least_overlap, F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v) / (2.0 * k)).otherwise(0.0)

    scores = let(letters, lambda s: F.transform(F.sequence(F.lit(0), n - 1), lambda i: score(s, i)))
    out = reads.withColumn("__s", F.when(n > 0, scores).otherwise(F.array().cast("array<double>")))
    weights = array_softmax(F.transform("__s", lambda v: F.greatest(v - threshold, F.lit(0.0))), temperature)
    mean = F.aggregate(F.transform(weights, lambda w, i: w * i), F.lit(0.0), lambda acc, v: acc + v)
    out = out.withColumn("trim_at", F.when(F.exists("__s", lambda v: v > threshold), mean).otherwise(n.cast("double")))
    return out.withColumn("retained", F.transform("__s", lambda _, i: S.logistic((F.col("trim_at") - i) / temperature))).drop("__s")


def soft_duplicate_weights(reads: DataFrame, by: str, key: str = "id", vec: str = "vec", threshold: float = 0.9, temperature: float = 0.05) -> DataFrame:
    """(by, key, weight): 1 / soft number of similar reads of the same batch, scaled to mean 1 in the batch.

    Similar by the cosine of embeddings; `by` names the batch, which the caller bounds, since its reads meet in pairs.
    """
    norm = F.sqrt(dot(vec, vec)) + 1e-8
    x = reads.select(by, key, F.transform(vec, lambda v: v / norm).alias("x"))
    y = x.select(by, F.col("x").alias("y"))
    size = F.sum(S.logistic((dot("x", "y") - threshold) / temperature))
    sizes = x.join(y, by).groupBy(by, key).agg((1.0 / F.greatest(size, F.lit(1.0))).alias("w"))
    return sizes.select(by, key, (F.col("w") / F.avg("w").over(Window.partitionBy(by))).alias("weight"))


def duplicate_weights(reads: DataFrame, sequence: str = "sequence") -> DataFrame:
    """1 / copies of each sequence, scaled to mean 1."""
    copies = reads.groupBy(sequence).agg(F.count("*").alias("copies"))
    total = copies.agg(F.sum("copies").alias("n"), F.count("*").alias("d"))
    out = reads.join(copies, sequence).join(F.broadcast(total), F.lit(True))
    return out.withColumn("weight", (1.0 / F.col("copies")) * F.col("n") / F.col("d")).drop("copies", "n", "d")


def pileup(reads: DataFrame, length: int, eps: float = 1e-8, temperature: float | None = None) -> DataFrame:
    """(position, A, C, G, T, coverage) for every position below `length`: shares of quality-weighted bases."""
    w = 1.0 - phred_to_probability("quality")
    held = reads.filter((F.col("position") >= 0) & (F.col("position") < length) & F.col("base").isin(*BASES)).withColumn("w", w)
    sums = held.groupBy("position").agg(*[F.sum(F.when(F.col("base") == b, F.col("w")).otherwise(0.0)).alias(b) for b in BASES], F.sum("w").alias("coverage"))
    grid = reads.sparkSession.range(length).withColumnRenamed("id", "position")
    full = grid.join(sums, "position", "left").na.fill(0.0)
    share = {b: F.col(b) / F.greatest("coverage", F.lit(eps)) for b in BASES}
    if temperature:
        top = F.greatest(*share.values())
        e = {b: F.exp((v - top) / temperature) for b, v in share.items()}
        total = sum(list(e.values())[1:], e["A"])
        share = {b: v / total for b, v in e.items()}
    return full.select("position", *[v.alias(b) for b, v in share.items()], "coverage")


def pileup_image(reads: DataFrame, reference: DataFrame, centre: int, width: int, max_reads: int = 100) -> DataFrame:
    """(row, position, quality, mismatch, strand): pixels of a read image around a site, reads beyond max_reads dropped in input order."""
    low = centre - width // 2
    w = Window.partitionBy("position").orderBy("read_id")
    held = reads.filter((F.col("position") >= low) & (F.col("position") < low + width)).withColumn("row", F.row_number().over(w) - 1)
    px = held.filter(F.col("row") < max_reads).join(F.broadcast(reference.filter((F.col("position") >= low) & (F.col("position") < low + width))), "position")
    return px.select(
        "row", "position", F.least(F.col("quality") / 40.0, F.lit(1.0)).alias("quality"), (F.col("base") != F.col("ref")).cast("double").alias("mismatch"), F.col("strand").cast("double").alias("strand")
    )


def candidates(reads: DataFrame, reference: DataFrame, least_depth: int = 8, least_fraction: float = 0.12) -> DataFrame:
    """Positions whose share of non-reference bases reaches a threshold at sufficient depth."""
    d = reads.filter(F.col("base").isin(*BASES)).join(reference, "position")
    g = d.groupBy("position").agg(F.count("*").alias("depth"), F.avg((F.col("base") != F.col("ref")).cast("double")).alias("fraction"))
    return g.filter((F.col("depth") >= least_depth) & (F.col("fraction") >= least_fraction))


def _track(by: list[str] | None, *order: str):
    """A window over one track: the rows of one combination of `by` (chromosome, spectrum), in order."""
    return Window.partitionBy(*(by or [])).orderBy(*order)


def triangular_smooth(signal: DataFrame, width: int = 5, by: list[str] | None = None) -> DataFrame:
    """Convolution with a triangular kernel of sum 1, zeros beyond the ends, along each track."""
    h = width // 2
    w = _track(by, "pos")
    weights = [h + 1 - abs(k) for k in range(-h, h + 1)]
    total = float(sum(weights))
    parts = [F.coalesce(F.lag("value", -k).over(w), F.lit(0.0)) * (c / total) for k, c in zip(range(-h, h + 1), weights)]
    return signal.withColumn("smooth", sum(parts[1:], parts[0]))


def segments(signal: DataFrame, jump: float, by: list[str] | None = None) -> DataFrame:
    """(by, segment, start, end, mean, n): runs between jumps larger than a threshold, as gaps and islands of each track."""
    w = _track(by, "pos")
    flag = (F.abs(F.col("value") - F.lag("value").over(w)) > jump).cast("long")
    s = signal.withColumn("f", F.coalesce(flag, F.lit(0))).withColumn("segment", F.sum("f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(*(by or []), "segment").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.avg("value").alias("mean"), F.count("*").alias("n"))


def copy_number_posterior(segments_: DataFrame, states=(0, 1, 2, 3, 4), base: float = 2.0, scale: float = 0.5) -> DataFrame:
    """Expected copy number: sum of k p_k with p a softmax of minus squared distance of 2 mean / base to each state.

    The greatest term is taken out first, so ratios far from every state get the nearest one.
    """
    x = F.col("ratio") * 2.0
    logs = [-((x - k) ** 2) / scale for k in states]
    top = F.greatest(*logs)
    e = [F.exp(v - top) for v in logs]
    total = sum(e[1:], e[0])
    return segments_.withColumn("copies", sum((v * k for v, k in zip(e[1:], states[1:])), e[0] * states[0]) / total)


def call_peaks(signal: DataFrame, threshold: float, temperature: float = 1.0, width: int = 5, edge: float = 0.1, by: list[str] | None = None) -> DataFrame:
    """(pos, p, summit, start, end): soft threshold, windowed softmax centre, and signs of the first difference, along each track."""
    w = _track(by, "pos")
    h = width // 2
    p = signal.withColumn("p", S.logistic((F.col("value") - threshold) / temperature))
    frame = w.rowsBetween(-h, h)
    p = p.withColumn("top", F.max("value").over(frame))
    shifts = range(-h, h + 1)
    e = [F.coalesce(F.exp((F.lead("value", k).over(w) if k >= 0 else F.lag("value", -k).over(w)) - F.col("top")), F.lit(0.0)) for k in shifts]
    total = sum(e[1:], e[0])
    centre = sum((v * k for v, k in zip(e[1:], list(shifts)[1:])), e[0] * -h) / total
    d = F.coalesce(F.col("p") - F.lag("p").over(w), F.lit(0.0))
    return p.withColumn("summit", centre).withColumn("start", S.logistic(d / edge)).withColumn("end", S.logistic(-d / edge)).drop("top")


def motif_scan(sequences: DataFrame, pwm: list[dict[str, float]], threshold: float = 0.0, temperature: float = 1.0, background: float = 0.25) -> DataFrame:
    """(seq_id, start, score, weight): log-odds of a position weight matrix at every offset of each sequence."""
    k, s = len(pwm), F.upper(F.col("sequence"))
    starts = F.when(F.length(s) >= k, F.sequence(F.lit(1), F.length(s) - k + 1)).otherwise(F.array().cast("array<int>"))
    rows = sequences.select("seq_id", s.alias("s"), F.explode(starts).alias("at"))
    score = F.lit(0.0)
    for i, column in enumerate(pwm):
        c = F.substring("s", F.col("at") + i, F.lit(1))
        hit = F.lit(0.0)
        for b, v in column.items():
            hit = F.when(c == b, math.log(v / background)).otherwise(hit)
        score = score + hit
    return rows.select("seq_id", (F.col("at") - 1).alias("start"), score.alias("score")).withColumn("weight", S.logistic((F.col("score") - threshold) / temperature))


def splicing_psi(rows: DataFrame, pseudocount: float = 1.0, least: float = 10.0, temperature: float = 1.0) -> DataFrame:
    """psi, confidence and variance from inclusion and exclusion counts."""
    i, e, pc = F.col("inclusion"), F.col("exclusion"), abs(pseudocount) + 1e-6
    psi = (i + pc) / (i + e + 2 * pc)
    return rows.withColumns(
        {"psi": psi, "confidence": S.logistic((i + e - least) / (temperature * least + 1e-6)), "variance": psi * (1 - psi) / (i + e + 2 * abs(pseudocount) + 1)}
    )


def em_quantify(compat: DataFrame, lengths: DataFrame, rounds: int = 10, temperature: float = 1.0) -> DataFrame:
    """(transcript, abundance, tpm) by EM over a table (read, transcript, c): a fixed number of rounds.

    Zero or absent compatibilities of a listed pair keep the floor 1e-10.
    """
    from strandlake.session import cut_lineage

    compat = cut_lineage(compat.join(lengths, "transcript"))
    n = lengths.count()
    abundance = lengths.select("transcript", F.lit(1.0 / n).alias("a"))
    w = Window.partitionBy("read")
    for r in range(rounds):
        x = compat.join(abundance, "transcript").withColumn("l", F.log(F.col("c") * F.col("a") / F.col("length") + 1e-10) / temperature)
        x = x.withColumn("e", F.exp(F.col("l") - F.max("l").over(w))).withColumn("p", F.col("e") / F.sum("e").over(w))
        got = x.groupBy("transcript").agg((F.sum("p") / F.first("length")).alias("g"))
        total = got.agg(F.sum("g").alias("t"))
        abundance = got.join(F.broadcast(total), F.lit(True)).select("transcript", (F.col("g") / F.col("t")).alias("a"))
        if r % 3 == 2:
            abundance = cut_lineage(abundance)
    rate = abundance.join(lengths, "transcript").withColumn("rate", F.col("a") / F.col("length"))
    total = rate.agg(F.sum("rate").alias("t"))
    return rate.join(F.broadcast(total), F.lit(True)).select("transcript", F.col("a").alias("abundance"), (F.col("rate") / F.col("t") * 1e6).alias("tpm"))


def nb_log_likelihood(counts, mu, theta):
    """Log-probability of a count under a negative binomial of mean mu and inverse dispersion theta."""
    x, m, t = S.col(counts), S.col(mu), S.col(theta)
    return lgamma(x + t) - lgamma(t) - lgamma(x + 1) + t * F.log(t / (t + m)) + x * F.log((m + 1e-8) / (t + m))


def zinb_log_likelihood(counts, mu, theta, logit):
    """Zero-inflated negative binomial, its mixture in log space."""
    nb, pi = nb_log_likelihood(counts, mu, theta), S.logistic(S.col(logit))
    return F.when(S.col(counts) == 0, F.log(pi + (1 - pi) * F.exp(nb))).otherwise(F.log(1 - pi) + nb)


def gmm_quality(rows: DataFrame, components: list[tuple[float, list[float], list[float]]], features: list[str]) -> DataFrame:
    """Log-density under a diagonal Gaussian mixture, and each component's responsibility r0, r1, ...

    At infinite features the density is zero: its logarithm is minus infinity, and the responsibilities are NaN.
    """
    logs = []
    for weight, mean, var in components:
        l = F.lit(math.log(weight))
        for f, m, v in zip(features, mean, var):
            l = l - 0.5 * (math.log(2 * math.pi * v) + (F.col(f) - m) ** 2 / v)
        logs.append(l)
    top = F.greatest(*logs)
    total = sum((F.exp(x - top) for x in logs[1:]), F.exp(logs[0] - top))
    density = F.when(top == float("-inf"), top).otherwise(top + F.log(total))
    return rows.withColumns({"log_density": density, **{f"r{i}": F.exp(x - top) / total for i, x in enumerate(logs)}})


def centroid_spectrum(signal: DataFrame, signal_noise: float = 3.0, quantile: float = 0.5, temperature: float = 0.1, kernel: int = 5, by: list[str] | None = None) -> DataFrame:
    """(by, pos, smooth, peak): smoothed intensities of each spectrum, weighted by soft threshold over its noise and soft local maximum."""
    by = by or []
    noise = signal.groupBy(*by).agg(F.percentile("value", F.lit(quantile)).alias("noise"))
    smooth = triangular_smooth(signal, kernel, by)
    sm = smooth.join(noise, by) if by else smooth.join(F.broadcast(noise), F.lit(True))
    w = _track(by, "pos")
    s = F.col("smooth")
    left, right = F.coalesce(F.lag("smooth").over(w), s), F.coalesce(F.lead("smooth").over(w), s)
    above = S.logistic((s - signal_noise * F.col("noise")) / temperature)
    local = S.logistic((s - left) / temperature) * S.logistic((s - right) / temperature)
    return sm.select(*by, "pos", "smooth", (above * local).alias("peak"))


def bin_spectrum(peaks: DataFrame, bins: int, low: float, high: float, normalise: bool = True) -> DataFrame:
    """(spectrum, bin, intensity): fixed-width bins, outliers in the edge bins, scaled by the greatest (1e-8 at least)."""
    b = F.least(F.greatest(((F.col("mz") - low) / ((high - low) / bins)).cast("int"), F.lit(0)), F.lit(bins - 1))
    g = peaks.groupBy("spectrum", b.alias("bin")).agg(F.sum("intensity").alias("intensity"))
    if normalise:
        g = g.withColumn("intensity", F.col("intensity") / F.greatest(F.max("intensity").over(Window.partitionBy("spectrum")), F.lit(1e-8)))
    return g


def spectral_cosine(binned: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, cosine) of listed pairs of binned spectra."""
    norm = binned.groupBy("spectrum").agg(F.sqrt(F.sum(F.col("intensity") ** 2)).alias("norm"))
    x = pairs.join(binned.select(F.col("spectrum").alias("a"), "bin", F.col("intensity").alias("ia")), "a")
    x = x.join(binned.select(F.col("spectrum").alias("b"), "bin", F.col("intensity").alias("ib")), ["b", "bin"])
    d = x.groupBy("a", "b").agg(F.sum(F.col("ia") * F.col("ib")).alias("dot"))
    d = d.join(norm.select(F.col("spectrum").alias("a"), F.col("norm").alias("na")), "a").join(norm.select(F.col("spectrum").alias("b"), F.col("norm").alias("nb")), "b")
    return d.select("a", "b", (F.col("dot") / F.greatest(F.col("na") * F.col("nb"), F.lit(1e-12))).alias("cosine"))


def isotope_charge(peaks: DataFrame, grid: DataFrame, charges=(1, 2, 3), isotopes: int = 4, decay: float = 0.5, spacing: float = 1.00335, temperature: float = 0.1) -> DataFrame:
    """(spectrum, expected_charge): how well a geometric isotope envelope fits at each charge, sampled by interpolation.

    peaks (spectrum, mz) are candidate monoisotopic places on the regular grid (pos, value) of step 1.
    """
    total = sum(decay**k for k in range(isotopes))
    spots = [(z, k, decay**k / total) for z in charges for k in range(isotopes)]
    t = F.explode(F.array(*[F.struct(F.lit(z).alias("z"), F.lit(k).alias("k"), F.lit(w).alias("w")) for z, k, w in spots])).alias("t")
    want = peaks.select("spectrum", "mz", t).select("spectrum", F.col("t.z").alias("z"), F.col("t.w").alias("w"), (F.col("mz") + F.col("t.k") * spacing / F.col("t.z")).alias("x"))
    want = want.withColumn("lo", F.floor("x")).withColumn("frac", F.col("x") - F.floor("x"))
    g = grid.select(F.col("pos").alias("lo"), F.col("value").alias("v0"))
    h = grid.select((F.col("pos") - 1).alias("lo"), F.col("value").alias("v1"))
    s = want.join(g, "lo", "left").join(h, "lo", "left").na.fill(0.0, ["v0", "v1"])
    v = F.col("v0") * (1 - F.col("frac")) + F.col("v1") * F.col("frac")
    fit = s.groupBy("spectrum", "z").agg(F.sum(F.col("w") * v).alias("fit"))
    win = Window.partitionBy("spectrum")
    e = fit.withColumn("e", F.exp((F.col("fit") - F.max("fit").over(win)) / temperature))
    return e.groupBy("spectrum").agg((F.sum(F.col("e") * F.col("z")) / F.sum("e")).alias("expected_charge"))


def densest_region(peaks: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """The shortest span of each track that holds n consecutive peaks (start, end), the first on ties."""
    by = by or []
    s = peaks.withColumn("stop", F.lead("end", n - 1).over(_track(by, "start", "end"))).filter(F.col("stop").isNotNull())
    s = s.withColumn("span", F.col("stop") - F.col("start"))
    best = s.groupBy(*by).agg(F.min(F.struct("span", "start", "stop")).alias("b")).filter("b is not null")
    return best.select(*by, "b.start", "b.stop", "b.span")


def coverage_from_peaks(peaks: DataFrame, low: int, high: int) -> DataFrame:
    """(pos, value) of a region: summed signal of the peaks over each base, by running sums of starts and ends.

    One row a base: the region is a window of one track, which the caller bounds.
    """
    inside = peaks.filter((F.col("end") > low) & (F.col("start") < high))
    edge = inside.select(F.greatest("start", F.lit(low)).alias("pos"), F.col("signal").alias("d")).unionByName(
        inside.filter(F.col("end") < high).select(F.col("end").alias("pos"), (-F.col("signal")).alias("d"))
    )
    steps = edge.groupBy("pos").agg(F.sum("d").alias("d"))
    grid = peaks.sparkSession.range(low, high).withColumnRenamed("id", "pos").join(steps, "pos", "left")
    w = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return grid.select("pos", F.sum(F.coalesce("d", F.lit(0.0))).over(w).alias("value"))
