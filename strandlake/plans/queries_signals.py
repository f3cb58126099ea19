"""Queries over reads, signals, structures, molecules, kernels and losses, with their SQL where SQL can express them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions.numeric import ieee_log, rounded
from strandlake.operators import cells as C
from strandlake.operators import graph as G
from strandlake.operators import kernels as K
from strandlake.operators import signals as X
from strandlake.operators import structure as M
from strandlake.plans import derive as D

QUERIES, SQL = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


_add(
    "quality_filter",
    lambda s, d: X.quality_filter(D.reads(s, d), 20.0, 2.0).select("read_id", rounded("weight").alias("weight")),
    f"WITH {D.READS} SELECT read_id, round(1 / (1 + exp(-(quality - 20 - 1e-10) / 2.0)), 6) AS weight FROM reads",
)
_add("quality_filter_hard", lambda s, d: X.quality_filter(D.reads(s, d), 20.0, mode="hard").select("read_id"), f"WITH {D.READS} SELECT read_id FROM reads WHERE quality > 20")


def adapters(spark, sf_dir):
    return X.adapter_trim(D.sequences(spark, sf_dir), "ATTC", 3, 0.75).select("seq_id", "trim_at", "trimmed")


_add(
    "adapter_removal",
    adapters,
    f"""WITH {D.SEQUENCES}, p AS (SELECT seq_id, sequence, unnest(range(length(sequence))) AS i FROM sequences), o AS (SELECT *, least(4, length(sequence) - i) AS k FROM p),
    m AS (SELECT seq_id, i, k, list_sum([CAST(substr(sequence, i + x, 1) = substr('ATTC', x, 1) AS INT) FOR x IN range(1, k + 1)]) / k AS s FROM o),
    c AS (SELECT seq_id, min(i) AS cut FROM m WHERE k >= 3 AND s >= 0.75 GROUP BY 1)
    SELECT seq_id, CAST(coalesce(cut, length(sequence)) AS BIGINT) AS trim_at, substr(sequence, 1, coalesce(cut, length(sequence))) AS trimmed FROM sequences LEFT JOIN c USING (seq_id)""",
)
_add(
    "duplicate_weighting",
    lambda s, d: X.duplicate_weights(D.table(s, d, "events").select(F.col("event_id").alias("id"), F.concat_ws("", "event_type", (F.col("user_id") % 9).cast("string")).alias("sequence"))).select("id", rounded("weight").alias("weight")),
    "WITH c AS (SELECT event_id AS id, count(*) OVER (PARTITION BY event_type || CAST(user_id % 9 AS VARCHAR)) AS c FROM events) SELECT id, round(1 / c / (SELECT avg(1 / c) FROM c), 6) AS weight FROM c",
)


def pile(temperature=None):
    def query(spark, sf_dir):
        p = X.pileup(D.reads(spark, sf_dir), 720, temperature=temperature)
        return p.select("position", *[rounded(c).alias(c) for c in ("A", "C", "G", "T")], rounded("coverage", 5).alias("coverage"))

    return query


_PILE = f"""WITH {D.READS}, w AS (SELECT position, base, 1 - pow(10, -quality / 10) AS w FROM reads WHERE position BETWEEN 0 AND 719 AND base <> 'N'),
    s AS (SELECT position, {", ".join(f"coalesce(sum(w) FILTER (base = '{b}'), 0) AS {b}" for b in "ACGT")}, sum(w) AS cov FROM w GROUP BY 1),
    f AS (SELECT p.position, {", ".join(f"coalesce({b}, 0) / greatest(coalesce(cov, 0), 1e-8) AS {b}" for b in "ACGT")}, coalesce(cov, 0) AS cov FROM (SELECT unnest(range(720)) AS position) p LEFT JOIN s USING (position))"""
_add("pileup", pile(), _PILE + f" SELECT position, {', '.join(f'round({b}, 6) AS {b}' for b in 'ACGT')}, round(cov, 5) AS coverage FROM f")
_add("pileup_softmax", pile(0.5), _PILE + f" SELECT position, {', '.join(f'round(exp({b} / 0.5) / (exp(A / 0.5) + exp(C / 0.5) + exp(G / 0.5) + exp(T / 0.5)), 6) AS {b}' for b in 'ACGT')}, round(cov, 5) AS coverage FROM f")


def reference(spark):
    return spark.range(720).select(F.col("id").alias("position"), F.element_at(F.array(*[F.lit(b) for b in "ACGT"]), (F.col("id") % 4 + 1).cast("int")).alias("ref"))


_REF = "ref AS (SELECT position, substr('ACGT', CAST(position % 4 + 1 AS INT), 1) AS ref FROM (SELECT unnest(range(720)) AS position))"
_add(
    "pileup_image",
    lambda s, d: X.pileup_image(D.reads(s, d), reference(s), 360, 41, 12).select(F.col("row").cast("long").alias("row"), "position", rounded("quality").alias("quality"), "mismatch", "strand"),
    f"""WITH {D.READS}, {_REF}, r AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY read_id) - 1 AS row FROM reads WHERE position >= 340 AND position < 381)
    SELECT row, position, round(least(quality / 40, 1), 6) AS quality, CAST(base <> ref AS DOUBLE) AS mismatch, CAST(strand AS DOUBLE) AS strand FROM r JOIN ref USING (position) WHERE row < 12""",
)
_add(
    "variant_candidates",
    lambda s, d: X.candidates(D.reads(s, d), reference(s), 8, 0.8).select("position", "depth", rounded("fraction").alias("fraction")),
    f"""WITH {D.READS}, {_REF} SELECT position, count(*) AS depth, round(avg(CAST(base <> ref AS DOUBLE)), 6) AS fraction FROM reads JOIN ref USING (position) WHERE base <> 'N' GROUP BY 1 HAVING count(*) >= 8 AND avg(CAST(base <> ref AS DOUBLE)) >= 0.8""",
)
_SMOOTH = "sm AS (SELECT pos, value, (coalesce(lag(value, 2) OVER w, 0) + 2 * coalesce(lag(value) OVER w, 0) + 3 * value + 2 * coalesce(lead(value) OVER w, 0) + coalesce(lead(value, 2) OVER w, 0)) / 9 AS smooth FROM signal WINDOW w AS (ORDER BY pos))"
_add(
    "pyramidal_smoothing",
    lambda s, d: X.triangular_smooth(D.signal(s, d)).select("pos", rounded("smooth").alias("smooth")),
    f"WITH {D.SIGNAL}, {_SMOOTH} SELECT pos, round(smooth, 6) AS smooth FROM sm",
)
_SEG = "sg AS (SELECT segment, min(pos) AS \"start\", max(pos) AS \"end\", avg(value) AS mean, count(*) AS n FROM (SELECT *, sum(f) OVER (ORDER BY pos) AS segment FROM (SELECT *, CAST(coalesce(abs(value - lag(value) OVER (ORDER BY pos)) > 6, false) AS INT) AS f FROM signal)) GROUP BY 1)"
_add(
    "cnv_segmentation",
    lambda s, d: X.segments(D.signal(s, d), 6.0).select(F.col("segment").cast("long").alias("segment"), "start", "end", rounded("mean").alias("mean"), "n"),
    f'WITH {D.SIGNAL}, {_SEG} SELECT CAST(segment AS BIGINT) AS segment, "start", "end", round(mean, 6) AS mean, n FROM sg',
)


def copy_number(spark, sf_dir):
    """As the SQL, which divides the plain sums: NaN where all five terms underflow, while the operator has a value there."""
    found = X.copy_number_posterior(X.segments(D.signal(spark, sf_dir), 6.0).withColumn("ratio", F.col("mean") / 14.0))
    gap = F.least(*[F.abs(F.col("ratio") * 2.0 - k) for k in range(5)])
    return found.select("start", F.when(F.exp(-(gap**2) / 0.5) == 0, float("nan")).otherwise(rounded("copies")).alias("copies"))


_add(
    "copy_number",
    copy_number,
    f'WITH {D.SIGNAL}, {_SEG}, e AS (SELECT "start", k, exp(-pow(2 * mean / 14.0 - k, 2) / 0.5) AS e FROM sg, (VALUES (0), (1), (2), (3), (4)) v(k)) SELECT "start", round(sum(e * k) / sum(e), 6) AS copies FROM e GROUP BY 1',
)
_shift = {k: (f"lead(value, {k}) OVER w" if k >= 0 else f"lag(value, {-k}) OVER w") for k in range(-2, 3)}
_add(
    "peak_calling",
    lambda s, d: X.call_peaks(D.signal(s, d), 15.0, 2.0).select("pos", *[rounded(c).alias(c) for c in ("p", "summit", "start", "end")]),
    f"""WITH {D.SIGNAL}, e AS (SELECT pos, 1 / (1 + exp(-(value - 15) / 2)) AS p, max(value) OVER (ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top, {", ".join(f"{v} AS v{k + 2}" for k, v in _shift.items())} FROM signal WINDOW w AS (ORDER BY pos)),
    x AS (SELECT pos, p, coalesce(p - lag(p) OVER (ORDER BY pos), 0) AS d, {", ".join(f"coalesce(exp(v{k} - top), 0) AS e{k}" for k in range(5))} FROM e)
    SELECT pos, round(p, 6) AS p, round((2 * e4 + e3 - e1 - 2 * e0) / (e0 + e1 + e2 + e3 + e4), 6) + 0.0 AS summit, round(1 / (1 + exp(-d / 0.1)), 6) AS "start", round(1 / (1 + exp(d / 0.1)), 6) AS "end" FROM x""",
)
PWM = [{"A": 0.7, "C": 0.1, "G": 0.1, "T": 0.1}, {"A": 0.1, "C": 0.1, "G": 0.1, "T": 0.7}, {"A": 0.1, "C": 0.6, "G": 0.2, "T": 0.1}]
_pwm = ", ".join(f"({i}, '{b}', {v})" for i, c in enumerate(PWM) for b, v in c.items())
_add(
    "motif_scan",
    lambda s, d: X.motif_scan(D.sequences(s, d), PWM, 1.0).groupBy("seq_id").agg(F.count("*").alias("n"), rounded(F.max("score")).alias("best"), rounded(F.sum("weight"), 3).alias("weight")),
    f"""WITH {D.SEQUENCES}, o AS (SELECT seq_id, sequence, unnest(range(1, length(sequence) - 1)) AS pos FROM sequences), m(k, b, p) AS (VALUES {_pwm}),
    s AS (SELECT seq_id, pos, sum(ln(p / 0.25)) AS s FROM o JOIN m ON substr(sequence, pos + k, 1) = b GROUP BY 1, 2)
    SELECT seq_id, count(*) AS n, round(max(s), 6) AS best, round(sum(1 / (1 + exp(-(s - 1)))), 3) AS weight FROM s GROUP BY 1""",
)


def psi(spark, sf_dir):
    li = D.table(spark, sf_dir, "lineitem")
    rows = li.groupBy(F.col("l_partkey").alias("id")).agg(F.sum((F.col("l_returnflag") == "R").cast("double")).alias("inclusion"), F.sum((F.col("l_returnflag") != "R").cast("double")).alias("exclusion"))
    return X.splicing_psi(rows).select("id", *[rounded(c).alias(c) for c in ("psi", "confidence", "variance")])


_add(
    "splicing_psi",
    psi,
    """WITH c AS (SELECT l_partkey AS id, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS i, CAST(count(*) FILTER (l_returnflag <> 'R') AS DOUBLE) AS e FROM lineitem GROUP BY 1),
    p AS (SELECT *, (i + 1.000001) / (i + e + 2.000002) AS psi FROM c) SELECT id, round(psi, 6) AS psi, round(1 / (1 + exp(-(i + e - 10) / 10.000001)), 6) AS confidence, round(psi * (1 - psi) / (i + e + 3), 6) AS variance FROM p""",
)


def em(spark, sf_dir):
    li = D.table(spark, sf_dir, "lineitem")
    compat = li.groupBy(F.col("l_orderkey").alias("read"), (F.col("l_suppkey") % 12).alias("transcript")).agg((F.count("*") / 4.0).alias("c"))
    lengths = spark.range(12).select(F.col("id").alias("transcript"), (500.0 + F.col("id") * 37).alias("length"))
    return X.em_quantify(compat, lengths, 3).select("transcript", rounded("abundance").alias("abundance"), rounded("tpm", 2).alias("tpm"))


_em = []
for _r in range(1, 4):
    _em.append(
        f"""l{_r} AS (SELECT read, transcript, length, ln(c * a / length + 1e-10) AS l FROM compat JOIN lengths USING (transcript) JOIN a{_r - 1} USING (transcript)),
    e{_r} AS (SELECT *, exp(l - max(l) OVER (PARTITION BY read)) AS e FROM l{_r}), p{_r} AS (SELECT transcript, length, e / sum(e) OVER (PARTITION BY read) AS p FROM e{_r}),
    g{_r} AS (SELECT transcript, sum(p) / first(length) AS g FROM p{_r} GROUP BY 1), a{_r} AS (SELECT transcript, g / sum(g) OVER () AS a FROM g{_r})"""
    )
_add(
    "em_quantification",
    em,
    "WITH compat AS (SELECT l_orderkey AS read, l_suppkey % 12 AS transcript, count(*) / 4.0 AS c FROM lineitem GROUP BY 1, 2), lengths AS (SELECT t AS transcript, 500.0 + t * 37 AS length FROM (SELECT unnest(range(12)) AS t)), a0 AS (SELECT transcript, 1.0 / 12 AS a FROM lengths), "
    + ", ".join(_em)
    + " SELECT transcript, round(a, 6) AS abundance, round(a / length / sum(a / length) OVER () * 1e6, 2) AS tpm FROM a3 JOIN lengths USING (transcript)",
)


def nb(spark, sf_dir):
    p = D.counts(spark, sf_dir).withColumn("mu", 40.0 + F.pmod("cell_id", F.lit(13)) * 7)
    return p.select("cell_id", "gene_id", rounded(X.nb_log_likelihood("value", "mu", 3.5), 5).alias("nb"), rounded(X.zinb_log_likelihood("value", "mu", 3.5, -1.0), 5).alias("zinb"))


_NB = "lgamma(value + 3.5) - lgamma(3.5) - lgamma(value + 1) + 3.5 * ln(3.5 / (3.5 + mu)) + value * ln((mu + 1e-8) / (3.5 + mu))"
_add(
    "nb_zinb_loss",
    nb,
    f"WITH {D.COUNTS}, m AS (SELECT *, 40.0 + cell_id % 13 * 7 AS mu FROM counts), n AS (SELECT *, {_NB} AS nb FROM m) SELECT cell_id, gene_id, round(nb, 5) AS nb, round(CASE WHEN value = 0 THEN ln(1 / (1 + exp(1)) + (1 - 1 / (1 + exp(1))) * exp(nb)) ELSE ln(1 - 1 / (1 + exp(1))) + nb END, 5) AS zinb FROM n",
)


def gmm(spark, sf_dir):
    """As the SQL, which takes the logarithm of the plain density: minus infinity and NaN where that is zero or underflows."""
    e = D.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), ieee_log("value").alias("a"), (F.col("user_id") / 30).alias("b"))
    found = X.gmm_quality(e, [(0.6, [3.0, 2.0], [1.0, 2.0]), (0.4, [5.0, 3.0], [0.5, 1.5])], ["a", "b"])
    none = F.exp("log_density") == 0
    return found.select("id", F.when(none, float("-inf")).otherwise(rounded("log_density")).alias("log_density"), F.when(none, float("nan")).otherwise(rounded("r0")).alias("r0"))


_add(
    "variant_quality_gmm",
    gmm,
    """WITH e AS (SELECT event_id AS id, ln(value) AS a, user_id / 30 AS b FROM events), l AS (SELECT id, ln(0.6) - 0.5 * (ln(2 * pi() * 1.0) + pow(a - 3, 2) / 1.0) - 0.5 * (ln(2 * pi() * 2.0) + pow(b - 2, 2) / 2.0) AS x,
    ln(0.4) - 0.5 * (ln(2 * pi() * 0.5) + pow(a - 5, 2) / 0.5) - 0.5 * (ln(2 * pi() * 1.5) + pow(b - 3, 2) / 1.5) AS y FROM e)
    SELECT id, round(ln(exp(x) + exp(y)), 6) + 0.0 AS log_density, round(exp(x) / (exp(x) + exp(y)), 6) AS r0 FROM l""",
)
_add(
    "spectrum_centroiding",
    lambda s, d: X.centroid_spectrum(D.signal(s, d), 1.1, 0.5, 0.7).select("pos", rounded("smooth").alias("smooth"), rounded("peak").alias("peak")),
    f"""WITH {D.SIGNAL}, {_SMOOTH}, n AS (SELECT quantile_cont(value, 0.5) AS noise FROM signal), b AS (SELECT pos, smooth, coalesce(lag(smooth) OVER (ORDER BY pos), smooth) AS l, coalesce(lead(smooth) OVER (ORDER BY pos), smooth) AS r, noise FROM sm, n)
    SELECT pos, round(smooth, 6) AS smooth, round(1 / (1 + exp(-(smooth - 1.1 * noise) / 0.7)) / (1 + exp(-(smooth - l) / 0.7)) / (1 + exp(-(smooth - r) / 0.7)), 6) AS peak FROM b""",
)


def _peaks(spark, sf_dir):
    return D.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("spectrum"), (F.col("l_extendedprice") / 100).alias("mz"), F.col("l_quantity").alias("intensity"))


_BINS = "b AS (SELECT l_suppkey % 40 AS spectrum, least(greatest(CAST(trunc((l_extendedprice / 100 - 50.0) / ((800.0 - 50) / 100)) AS BIGINT), 0), 99) AS bin, sum(l_quantity) AS i FROM lineitem GROUP BY 1, 2), n AS (SELECT spectrum, bin, i / greatest(max(i) OVER (PARTITION BY spectrum), 1e-8) AS intensity FROM b)"
_add("bin_spectrum", lambda s, d: X.bin_spectrum(_peaks(s, d), 100, 50.0, 800.0).select("spectrum", F.col("bin").cast("long").alias("bin"), rounded("intensity").alias("intensity")), f"WITH {_BINS} SELECT spectrum, bin, round(intensity, 6) AS intensity FROM n")


def spectra(spark, sf_dir):
    b = X.bin_spectrum(_peaks(spark, sf_dir), 100, 50.0, 800.0)
    pairs = spark.range(39).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return X.spectral_cosine(b, pairs).select("a", "b", rounded("cosine").alias("cosine"))


_add("spectral_similarity", spectra, f"WITH {_BINS} SELECT x.spectrum AS a, y.spectrum AS b, round(sum(x.intensity * y.intensity) / sqrt((SELECT sum(intensity * intensity) FROM n WHERE spectrum = x.spectrum) * (SELECT sum(intensity * intensity) FROM n WHERE spectrum = y.spectrum)), 6) AS cosine FROM n x JOIN n y ON y.spectrum = x.spectrum + 1 AND x.bin = y.bin GROUP BY 1, 2")


def isotopes(spark, sf_dir):
    g = D.signal(spark, sf_dir)
    p = g.filter("value > 12").select(F.col("pos").alias("spectrum"), F.col("pos").cast("double").alias("mz"))
    return X.isotope_charge(p, g, temperature=2.0).select("spectrum", rounded("expected_charge").alias("expected_charge"))


_add(
    "isotope_envelope",
    isotopes,
    f"""WITH {D.SIGNAL}, p AS (SELECT pos AS sp, z, k, pow(0.5, k) / 1.875 AS w, pos + k * 1.00335 / z AS x FROM signal, (VALUES (1), (2), (3)) a(z), (VALUES (0), (1), (2), (3)) b(k) WHERE value > 12),
    f AS (SELECT sp, z, sum(w * (coalesce(s.value, 0) * (1 - (x - floor(x))) + coalesce(t.value, 0) * (x - floor(x)))) AS f FROM p LEFT JOIN signal s ON s.pos = floor(x) LEFT JOIN signal t ON t.pos = floor(x) + 1 GROUP BY 1, 2),
    e AS (SELECT *, exp((f - max(f) OVER (PARTITION BY sp)) / 2) AS e FROM f) SELECT sp AS spectrum, round(sum(e * z) / sum(e), 6) AS expected_charge FROM e GROUP BY 1""",
)


def _regions(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders")
    return o.select((F.col("o_orderkey") * 3 % 5000).alias("start"), (F.col("o_orderkey") * 3 % 5000 + 20 + F.col("o_custkey") % 50).alias("end"), (F.col("o_custkey") % 7 + 1.0).alias("signal"))


_REG = 'rg AS (SELECT o_orderkey * 3 % 5000 AS s, o_orderkey * 3 % 5000 + 20 + o_custkey % 50 AS e, o_custkey % 7 + 1.0 AS v FROM orders)'
_add("coverage_signal", lambda s, d: X.coverage_from_peaks(_regions(s, d), 1000, 1500), f"WITH {_REG} SELECT pos, CAST(coalesce(sum(v), 0) AS DOUBLE) AS value FROM (SELECT unnest(range(1000, 1500)) AS pos) LEFT JOIN rg ON pos >= s AND pos < e GROUP BY 1")
_add("densest_region", lambda s, d: X.densest_region(_regions(s, d), 20), f'WITH {_REG}, n AS (SELECT s, lead(e, 19) OVER (ORDER BY s, e) AS t FROM rg) SELECT s AS "start", t AS stop, t - s AS span FROM n WHERE t IS NOT NULL ORDER BY t - s, s LIMIT 1')

# Molecules, structures, dynamics
_add(
    "molecular_similarity",
    lambda s, d: _similarities(s, d),
    f"""WITH {D.POINTS}, p AS (SELECT a.id, list_dot_product(a.vec, b.vec) AS ab, list_dot_product(a.vec, a.vec) AS aa, list_dot_product(b.vec, b.vec) AS bb FROM points a JOIN points b ON b.id = a.id + 1)
    SELECT id, round(least(greatest(ab / (aa + bb - ab + 1e-8), 0), 1), 6) + 0.0 AS tanimoto, round(ab / (sqrt(aa) * sqrt(bb) + 1e-8), 6) + 0.0 AS cosine, round(2 * ab / (aa + bb + 1e-8), 6) + 0.0 AS dice FROM p""",
)


def _similarities(spark, sf_dir):
    p = D.points(spark, sf_dir)
    other = p.select((F.col("id") - 1).alias("id"), F.col("vec").alias("vec2"))
    return p.join(other, "id").select("id", *[rounded(f("vec", "vec2")).alias(f.__name__) for f in (M.tanimoto, M.cosine, M.dice)])


def fingerprints(spark, sf_dir):
    li = D.table(spark, sf_dir, "lineitem")
    nodes = li.select(F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").alias("node_id"), F.col("l_returnflag").alias("kind"))
    a = li.select(F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").alias("src"), (F.col("l_linenumber") + 1).alias("dst"), F.col("l_linestatus").alias("kind"))
    edges = a.unionByName(a.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "kind"))
    return M.circular_fingerprint(nodes, edges, 2, 512)


_add("circular_fingerprint", fingerprints)


def _particles(spark, sf_dir):
    c = D.table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 40 * 1.1).alias("x"), (F.floor(F.col("c_custkey") / 40) * 1.13).alias("y"))


_add(
    "force_field",
    lambda s, d: M.pair_energy(_particles(s, d)).select("i", rounded("energy").alias("energy"), rounded("fx", 5).alias("fx"), rounded("fy", 5).alias("fy")),
    """WITH p AS (SELECT c_custkey AS id, c_custkey % 40 * 1.1 AS x, floor(c_custkey / 40) * 1.13 AS y FROM customer),
    q AS (SELECT a.id AS i, a.x - b.x AS dx, a.y - b.y AS dy, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS r FROM p a JOIN p b ON a.id <> b.id WHERE abs(a.x - b.x) < 2.5 AND abs(a.y - b.y) < 2.5),
    e AS (SELECT i, sum(4 * (pow(r, -12) - pow(r, -6))) / 2 AS energy, sum(24 * (2 * pow(r, -12) - pow(r, -6)) / r * dx / r) AS fx, sum(24 * (2 * pow(r, -12) - pow(r, -6)) / r * dy / r) AS fy FROM q WHERE r < 2.5 GROUP BY 1)
    SELECT id AS i, round(coalesce(energy, 0), 6) + 0.0 AS energy, round(coalesce(fx, 0), 5) + 0.0 AS fx, round(coalesce(fy, 0), 5) + 0.0 AS fy FROM p LEFT JOIN e ON i = id""",
)


def backbone(spark, sf_dir):
    """A helix-like backbone whose residues are the benchmark's rows."""
    i = F.col("item_id")
    at = lambda shift, r, rise: F.array(r * F.cos((i + shift) * 1.745), r * F.sin((i + shift) * 1.745), (i + shift) * 1.5 + rise)
    b = D.table(spark, sf_dir, "benchmark")
    return b.select(i.alias("pos"), at(0.0, 1.55, 0.0).alias("n"), at(0.3, 2.3, 0.1).alias("ca"), at(0.65, 1.65, 0.2).alias("c"), at(0.7, 2.0, 1.3).alias("o"))


_add("hbond_map", lambda s, d: M.hbond_map(backbone(s, d)).select("donor", "acceptor", rounded("h").alias("h")))
_add("secondary_structure", lambda s, d: M.secondary_structure(backbone(s, d), M.hbond_map(backbone(s, d))).select("pos", *[rounded(c).alias(c) for c in ("loop", "helix", "strand")]))
_PAIR = "CASE WHEN (x.a = 'A' AND y.a = 'T') OR (x.a = 'T' AND y.a = 'A') THEN 2 WHEN (x.a = 'C' AND y.a = 'G') OR (x.a = 'G' AND y.a = 'C') THEN 3 WHEN (x.a = 'G' AND y.a = 'T') OR (x.a = 'T' AND y.a = 'G') THEN 1 ELSE 0 END"
_add(
    "rna_base_pairs",
    lambda s, d: M.base_pair_softmax(D.item_sequences(s, d)).select("seq_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), rounded("p", 8).alias("p")),
    f"""WITH {D.ITEM_SEQUENCES}, l AS (SELECT seq_id, i, substr(sequence, i + 1, 1) AS a FROM (SELECT seq_id, sequence, unnest(range(length(sequence))) AS i FROM sequences)),
    w AS (SELECT x.seq_id, x.i, y.i AS j, exp({_PAIR}) AS w FROM l x JOIN l y ON x.seq_id = y.seq_id AND abs(x.i - y.i) > 3) SELECT seq_id, i, j, round(w / sum(w) OVER (PARTITION BY seq_id), 8) AS p FROM w""",
)
_add(
    "product_of_experts",
    lambda s, d: M.product_of_experts(D.table(s, d, "lineitem").select("l_orderkey", "l_tax", (F.col("l_discount") * 10).alias("lv")), "l_orderkey", "l_tax", "lv").select("l_orderkey", rounded("mean").alias("mean"), rounded("logvar").alias("logvar")),
    "SELECT l_orderkey, round(sum(l_tax * exp(-10 * l_discount)) / sum(exp(-10 * l_discount)), 6) + 0.0 AS mean, round(-ln(sum(exp(-10 * l_discount))), 6) + 0.0 AS logvar FROM lineitem GROUP BY 1",
)
_add(
    "differential_distribution",
    lambda s, d: M.ks_distance(D.counts(s, d).withColumn("k", F.col("cell_id") % 2), "gene_id", "value", "k").select("gene_id", *[rounded(c).alias(c) for c in ("ks", "mean_shift", "variance_ratio", "zero_difference")]),
    f"""WITH {D.COUNTS}, g AS (SELECT gene_id, value, count(*) FILTER (cell_id % 2 = 0) AS a, count(*) FILTER (cell_id % 2 = 1) AS b FROM counts GROUP BY 1, 2),
    c AS (SELECT gene_id, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY gene_id) - sum(b) OVER w / sum(b) OVER (PARTITION BY gene_id)) AS gap FROM g WINDOW w AS (PARTITION BY gene_id ORDER BY value)),
    k AS (SELECT gene_id, max(gap) AS ks FROM c GROUP BY 1) SELECT gene_id, round(first(ks), 6) AS ks, round(avg(value) FILTER (cell_id % 2 = 1) - avg(value) FILTER (cell_id % 2 = 0), 6) + 0.0 AS mean_shift,
    round(var_pop(value) FILTER (cell_id % 2 = 1) / (var_pop(value) FILTER (cell_id % 2 = 0) + 1e-8), 6) AS variance_ratio, 0.0 AS zero_difference FROM counts JOIN k USING (gene_id) GROUP BY 1""",
)


def mmd(spark, sf_dir):
    p = D.points(spark, sf_dir)
    b = p.select("id", "batch")
    d = G.pairwise_distances(p).join(b.select(F.col("id").alias("i"), F.col("batch").alias("bi")), "i").join(b.select(F.col("id").alias("j"), F.col("batch").alias("bj")), "j")
    return M.rbf_mmd(d, 0.5).select(rounded("mmd").alias("mmd"))


_add(
    "batch_mmd",
    mmd,
    f"""WITH {D.POINTS}, k AS (SELECT a.batch AS x, b.batch AS y, exp(-0.5 * pow(CASE WHEN a.id = b.id THEN 0 ELSE round(sqrt(list_sum([pow(a.vec[k] - b.vec[k], 2) FOR k IN range(1, 65)]) + 1e-16), 6) END, 2)) AS k FROM points a, points b)
    SELECT round(avg(k) FILTER (x = 0 AND y = 0) + avg(k) FILTER (x = 1 AND y = 1) - 2 * avg(k) FILTER (x = 0 AND y = 1), 6) + 0.0 AS mmd FROM k""",
)
# Losses
_add(
    "masked_value_loss",
    lambda s, d: M.masked_loss(D.table(s, d, "lineitem").withColumn("m", (F.col("l_returnflag") == "R").cast("double")), "l_discount", "l_tax", "m").select(rounded("loss").alias("loss")),
    "SELECT round(sum(pow(l_discount - l_tax, 2)) FILTER (l_returnflag = 'R') / (count(*) FILTER (l_returnflag = 'R') + 1e-8), 6) AS loss FROM lineitem",
)


def edit(spark, sf_dir):
    s = D.item_sequences(spark, sf_dir)
    pairs = s.select("seq_id", F.col("sequence").alias("a")).join(s.select((F.col("seq_id") - 1).alias("seq_id"), F.col("sequence").alias("b")), "seq_id")
    return M.soft_edit_distance(pairs.withColumnRenamed("seq_id", "pair_id")).select("pair_id", rounded("distance").alias("distance"))


_HIT = "(exp(10) * {c} / (exp(10) * {c} + ({n} - {c})))"
_add(
    "soft_edit_distance",
    edit,
    f"""WITH {D.ITEM_SEQUENCES}, p AS (SELECT x.seq_id AS pair_id, x.sequence AS a, y.sequence AS b, length(x.sequence) AS n, length(y.sequence) AS m FROM sequences x JOIN sequences y ON y.seq_id = x.seq_id + 1),
    c AS (SELECT pair_id, n, m, (length(a) - length(replace(a, l, ''))) AS ca, (length(b) - length(replace(b, l, ''))) AS cb FROM p, (VALUES ('A'), ('C'), ('G'), ('T')) v(l)),
    h AS (SELECT pair_id, n, m, sum(ca * {_HIT.format(c='cb', n='m')}) AS ha, sum(cb * {_HIT.format(c='ca', n='n')}) AS hb FROM c GROUP BY 1, 2, 3)
    SELECT pair_id, round((greatest((n - ha + m - hb) / 2, 0) + abs(n - m)) / (n + m), 6) AS distance FROM h""",
)
_add(
    "sequence_regularisation",
    lambda s, d: M.gc_regularisation(D.sequences(s, d)).join(M.complexity_loss(D.sequences(s, d)).withColumnRenamed("loss", "complexity"), "seq_id").select("seq_id", rounded("loss").alias("gc_loss"), rounded("complexity").alias("complexity")),
    f"""WITH {D.SEQUENCES}, g AS (SELECT seq_id, length(sequence) AS n, {", ".join(f"(length(sequence) - length(replace(sequence, '{b}', ''))) / length(sequence) AS {b}" for b in "ACGT")} FROM sequences WHERE length(sequence) > 0)
    SELECT seq_id, round(pow(0.1 * ln(1 + exp((abs((C + G) * n / (n + 1e-10) - 0.5) - 0.1) / 0.1)), 2), 6) AS gc_loss,
    round(pow(greatest(1 - ({" + ".join(f"CASE WHEN {b} > 0 THEN -{b} * ln({b}) ELSE 0 END" for b in "ACGT")}), 0), 2), 6) AS complexity FROM g""",
)


def diversity(spark, sf_dir):
    p = D.points(spark, sf_dir)
    a = C.cluster_assignments(p, C.cluster_means(p), 5.0)
    return M.shannon_diversity(a).select(rounded("shannon", 5).alias("shannon"), rounded("simpson", 5).alias("simpson"))


_MEANS = f"{D.POINTS}, l AS (SELECT id, label, unnest(range(64)) AS k, vec FROM points), cm AS (SELECT label AS cluster, k, avg(vec[k + 1]) AS c FROM l GROUP BY 1, 2), dd AS (SELECT id, cluster, sum(pow(vec[l.k + 1] - c, 2)) AS d FROM l JOIN cm ON l.k = cm.k GROUP BY 1, 2), ee AS (SELECT *, exp((min(d) OVER (PARTITION BY id) - d) / 5) AS z FROM dd), a AS (SELECT id, cluster, d, z / sum(z) OVER (PARTITION BY id) AS p FROM ee)"
_add("diversity_losses", diversity, f"WITH {_MEANS}, h AS (SELECT id, -sum(p * ln(p + 1e-10)) AS h, sum(p * p) AS s FROM a GROUP BY 1) SELECT round(avg(h), 5) + 0.0 AS shannon, round(avg(s), 5) AS simpson FROM h")


def velocity_loss(spark, sf_dir):
    p = D.points(spark, sf_dir)
    nxt = p.select((F.col("id") - 1).alias("id"), F.col("vec").alias("future"))
    third = p.select((F.col("id") - 2).alias("id"), F.col("vec").alias("velocity"))
    return M.velocity_consistency(p.withColumnRenamed("vec", "expression").join(nxt, "id").join(third, "id")).select(rounded("loss", 5).alias("loss"))


_add(
    "velocity_consistency",
    velocity_loss,
    f"""WITH {D.POINTS}, t AS (SELECT a.id, c.vec AS v, [b.vec[k] - a.vec[k] FOR k IN range(1, 65)] AS s FROM points a JOIN points b ON b.id = a.id + 1 JOIN points c ON c.id = a.id + 2),
    n AS (SELECT list_dot_product(v, s) AS vs, sqrt(list_dot_product(v, v)) AS nv, sqrt(list_dot_product(s, s)) AS ns FROM t) SELECT round(avg(1 - vs / (nv * ns + 1e-8) + pow(nv - ns, 2)), 5) AS loss FROM n""",
)


def vae(spark, sf_dir):
    p = D.points(spark, sf_dir).select(F.slice("vec", 1, 8).alias("x"), F.slice("vec", 9, 8).alias("x_recon"), F.slice("vec", 17, 4).alias("mean"), F.slice("vec", 21, 4).alias("logvar"))
    return M.vae_loss(p, 0.5).select(rounded("loss").alias("loss"))


_add("vae_loss", vae, f"""WITH {D.POINTS} SELECT round(avg(list_sum([pow(vec[k] - vec[k + 8], 2) FOR k IN range(1, 9)]) / 8 + 0.5 * list_sum([-0.5 * (1 + vec[k + 4] - pow(vec[k], 2) - exp(vec[k + 4])) FOR k IN range(17, 21)])), 6) AS loss FROM points""")


# Kernels
def smith_waterman(spark, sf_dir):
    s = D.item_sequences(spark, sf_dir)
    pairs = s.select("seq_id", F.col("sequence").alias("a")).join(s.select((F.col("seq_id") - 1).alias("seq_id"), F.col("sequence").alias("b")), "seq_id")
    return K.per_row(pairs, ["a", "b"], {"score": T.DoubleType()}, lambda a, b: (round(K.smooth_local_alignment(a, b), 6),)).select("seq_id", "score")


_add("smith_waterman", smith_waterman)
_INIT, _TRANS = np.array([0.6, 0.4]), np.array([[0.9, 0.1], [0.2, 0.8]])
_EMIT = np.array([[0.4, 0.1, 0.1, 0.4], [0.1, 0.4, 0.4, 0.1]])


def _codes(text):
    return ["ACGT".index(c) for c in text]


def hmm(spark, sf_dir):
    def run(text):
        p = K.hmm_posteriors(_codes(text), _INIT, _TRANS, _EMIT)
        return (round(K.hmm_forward(_codes(text), _INIT, _TRANS, _EMIT), 5), round(float(p[:, 0].sum()), 5) if len(p) else 0.0)

    return K.per_row(D.sequences(spark, sf_dir), ["sequence"], {"log_likelihood": T.DoubleType(), "first_state": T.DoubleType()}, run).select("seq_id", "log_likelihood", "first_state")


_add("hmm_forward_backward", hmm)


def profile(spark, sf_dir):
    m = np.array([[c[b] for b in "ACGT"] for c in PWM])
    return K.per_row(D.sequences(spark, sf_dir), ["sequence"], {"score": T.DoubleType()}, lambda s: (round(K.profile_forward(_codes(s), m, np.full(4, 0.25)), 6),)).select("seq_id", "score")


_add("profile_hmm", profile)
_add("rna_partition_function", lambda s, d: K.per_row(D.item_sequences(s, d), ["sequence"], {"log_z": T.DoubleType()}, lambda t: (round(K.pair_partition(K.pair_energies(t)), 6),)).select("seq_id", "log_z"))


def soft_mask(spark, sf_dir):
    p = D.points(spark, sf_dir).select("id", F.slice("vec", 1, 12).alias("x"))

    def run(x):
        m = K.soft_top_k_mask(np.array(x), 3, 0.5)
        return ([round(float(v), 6) + 0.0 for v in m], [round(float(v), 6) + 0.0 for v in K.sorting_network(np.array(x), 0.01)])

    arr = T.ArrayType(T.DoubleType())
    return K.per_row(p, ["x"], {"mask": arr, "sorted": arr}, run).select("id", "mask", "sorted")


_add("soft_top_k_and_network", soft_mask)
