"""Queries over learned operators (seeded parameters), their relational parts, training and dynamics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions.numeric import rounded
from strandlake.functions.sequence import kmer_dimension, kmer_features
from strandlake.operators import kernels as K
from strandlake.operators import learned as L
from strandlake.operators import network as E
from strandlake.operators import neural as N
from strandlake.operators import signals as X
from strandlake.operators import training as R
from strandlake.plans import derive as D

QUERIES, SQL = {}, {}
_DOUBLES = T.ArrayType(T.DoubleType())


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _plain(values) -> list[float]:
    return [round(float(v), 6) + 0.0 for v in np.ravel(values)]


def _outputs(df: DataFrame, inputs: list[str], kernel, key: str = "id") -> DataFrame:
    """(key, place, value): a kernel's numbers for each row, one row each."""
    out = K.per_row(df, inputs, {"out": _DOUBLES}, lambda *a: (_plain(kernel(*a)),))
    return out.select(key, F.posexplode("out").alias("place", "value"))


# Relational parts, with SQL
_LR = [("p0", "Brand#11", "Brand#21"), ("p1", "Brand#31", "Brand#12")]


def signalling(spark, sf_dir):
    edges = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), (F.col("c_custkey") + 1 + F.col("c_nationkey") % 3).alias("j"))
    return E.signalling_edges(D.counts(spark, sf_dir), edges, spark.createDataFrame(_LR, "pair string, ligand string, receptor string"))


_add(
    "signalling_edges",
    signalling,
    f"""WITH {D.COUNTS}, e AS (SELECT c_custkey AS i, c_custkey + 1 + c_nationkey % 3 AS j FROM customer), p AS (SELECT * FROM (VALUES {", ".join(map(str, _LR))}) v(pair, lg, rg))
    SELECT i, j, pair, coalesce(a.value, 0) AS ligand, coalesce(b.value, 0) AS receptor FROM e CROSS JOIN p LEFT JOIN counts a ON a.cell_id = i AND a.gene_id = lg LEFT JOIN counts b ON b.cell_id = j AND b.gene_id = rg""",
)
_XY = "points AS (SELECT vec_id AS id, [CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE)] AS vec FROM embeddings)"
_places = lambda s, d: D.points(s, d).select("id", F.slice("vec", 1, 2).alias("vec"))
_add(
    "spatial_neighbours",
    lambda s, d: E.spatial_edges(_places(s, d), 4),
    f"""WITH {_XY}, d AS (SELECT a.id AS i, b.id AS j, round(sqrt(pow(a.vec[1] - b.vec[1], 2) + pow(a.vec[2] - b.vec[2], 2) + 1e-16), 6) AS d FROM points a, points b WHERE a.id <> b.id),
    k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 4) SELECT k.i, k.j, k.d, CASE WHEN b.i IS NULL THEN 0.0 ELSE 1.0 END AS mutual FROM k LEFT JOIN k b ON b.i = k.j AND b.j = k.i""",
)


def _factors(spark, sf_dir):
    n = D.table(spark, sf_dir, "customer").count()
    tf = D.table(spark, sf_dir, "part").select(F.col("p_brand").alias("gene_id")).distinct().filter("gene_id < 'Brand#14'")
    return E.factor_edges(D.counts(spark, sf_dir), n, tf)


_FACTORS = f"""{D.COUNTS}, m AS (SELECT gene_id, sum(value) / (SELECT count(*) FROM customer) AS m FROM counts GROUP BY 1),
  f AS (SELECT a.gene_id AS source, b.gene_id AS target, a.m AS tf, b.m AS g FROM m a, m b WHERE a.gene_id < 'Brand#14')"""
_add("factor_edges", lambda s, d: _factors(s, d).select("source", "target", *[rounded(c, 5).alias(c) for c in ("tf_mean", "gene_mean", "difference")]),
    f"WITH {_FACTORS} SELECT source, target, round(tf, 5) AS tf_mean, round(g, 5) AS gene_mean, round(abs(tf - g), 5) AS difference FROM f")
_add(
    "factor_activity",
    lambda s, d: E.factor_activity(D.counts(s, d), _factors(s, d).withColumn("w", F.col("difference") / 100)).select("cell_id", "source", rounded("activity", 4).alias("activity")),
    f"WITH {_FACTORS} SELECT cell_id, source, round(sum(value * (abs(tf - g) / 100)), 4) AS activity FROM counts JOIN f ON target = gene_id GROUP BY 1, 2",
)


def _image(spark, sf_dir):
    ref = spark.range(720).select(F.col("id").alias("position"), F.element_at(F.array(*[F.lit(b) for b in "ACGT"]), (F.col("id") % 4 + 1).cast("int")).alias("ref"))
    return X.pileup_image(D.reads(spark, sf_dir), ref, 300, 24, 12)


_GAINS = {"quality": (1.5, -0.2), "mismatch": (0.8, 0.1), "strand": (-0.5, 0.3)}
_IMAGE = f"""{D.READS}, px AS (SELECT row_number() OVER (PARTITION BY position ORDER BY read_id) - 1 AS row, position, least(quality / 40, 1) AS quality, CAST(base <> substr('ACGT', CAST(position % 4 + 1 AS INT), 1) AS DOUBLE) AS mismatch, CAST(strand AS DOUBLE) AS strand
  FROM reads WHERE position >= 288 AND position < 312)"""
_add(
    "learnable_pileup",
    lambda s, d: E.learnable_pixels(_image(s, d), _GAINS).select(F.col("row").cast("long").alias("row"), "position", *[rounded(c).alias(c) for c in _GAINS]),
    f"WITH {_IMAGE} SELECT row, position, " + ", ".join(f"round(tanh({c} * {g} + {b}), 6) + 0.0 AS {c}" for c, (g, b) in _GAINS.items()) + " FROM px WHERE row < 12",
)


def gated(spark, sf_dir):
    rows = D.reads(spark, sf_dir).select("read_id", "quality")
    return E.apply_with_probability(rows, lambda r: r.withColumn("quality", F.col("quality") / 2), 0.3, "read_id", 9)


_U = "((CAST('0x' || substr(md5('9|' || read_id), 1, 12) AS BIGINT) + 0.5) / 281474976710656)"
_add("probabilistic_wrapper", gated, f"WITH {D.READS} SELECT read_id, CASE WHEN {_U} < 0.3 THEN quality / 2 ELSE quality END AS quality FROM reads")


def _design(spark, sf_dir):
    return D.obs(spark, sf_dir).select("cell_id", (F.col("cell_id") % 2).cast("double").alias("x"), (1 + F.col("cell_id") % 3 / 2).alias("size_factor"))


def nb_likelihood(spark, sf_dir):
    beta = D.table(spark, sf_dir, "part").select(F.col("p_brand").alias("gene_id")).distinct().withColumn("beta", F.array(F.lit(1.5), F.lit(0.25)))
    design = _design(spark, sf_dir).withColumn("x", F.array(F.lit(1.0), F.col("x")))
    return E.nb_log_likelihood(D.counts(spark, sf_dir), design, beta, 0.2).select("gene_id", rounded("log_likelihood", 3).alias("log_likelihood"))


_add(
    "nb_log_likelihood",
    nb_likelihood,
    f"""WITH {D.COUNTS}, g AS (SELECT DISTINCT p_brand AS gene_id FROM part), r AS (SELECT g.gene_id, coalesce(value, 0) AS y, exp(1.5 + 0.25 * (c_custkey % 2)) * (1 + c_custkey % 3 / 2) AS mu FROM customer CROSS JOIN g LEFT JOIN counts n ON n.cell_id = c_custkey AND n.gene_id = g.gene_id)
    SELECT gene_id, round(sum(lgamma(y + 5) - lgamma(5) - lgamma(y + 1) + 5 * ln(5 / (mu + 5)) + y * ln(mu / (mu + 5))), 3) AS log_likelihood FROM r GROUP BY 1""",
)
_add("nb_fit", lambda s, d: E.nb_fit(D.counts(s, d), _design(s, d), 0.2).select("gene_id", rounded("intercept", 4).alias("intercept"), rounded("slope", 4).alias("slope")))
_LETTERS = "transform(split(sequence, ''), c -> array(if(c = 'A', 1.0D, 0.0D), if(c = 'C', 1.0D, 0.0D), if(c = 'G', 1.0D, 0.0D), if(c = 'T', 1.0D, 0.0D)))"
_add(
    "sequence_validation",
    lambda s, d: E.invalid_sequences(D.sequences(s, d).withColumn("x", F.when(F.col("seq_id") % 7 != 0, F.when(F.col("sequence") != "", F.expr(_LETTERS)).otherwise(F.expr("array()")))), "x").select("seq_id"),
    f"WITH {D.SEQUENCES} SELECT seq_id FROM sequences WHERE seq_id % 7 = 0 OR sequence = ''",
)
_add(
    "masked_distribution",
    lambda s, d: E.masked_distribution(D.points(s, d).select("id", F.array(F.lit(0.7), F.lit(0.1), F.lit(0.1), F.lit(0.1)).alias("p")), "p", F.col("id") % 3 == 0).select("id", F.col("p")[0].alias("a")),
    f"WITH {D.POINTS} SELECT id, CASE WHEN id % 3 = 0 THEN 0.25 ELSE 0.7 END AS a FROM points",
)


def gaps(spark, sf_dir):
    w = D.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").alias("i"), (F.col("l_partkey") % 6 + 1).alias("j"), (F.col("l_quantity") / 49).alias("w"))
    return E.gap_pattern_loss(w, 0.5).select("pair_id", rounded("loss").alias("loss"))


_GAP = """w AS (SELECT l_orderkey AS pair_id, l_linenumber AS i, l_partkey % 6 + 1 AS j, l_quantity / 49 AS w FROM lineitem), r AS (SELECT pair_id, i, sum(w) AS mass, max(j) AS j FROM w GROUP BY 1, 2),
  l AS (SELECT pair_id, avg(abs(1 - mass)) AS un, max(i) AS n, max(j) AS m FROM r GROUP BY 1), o AS (SELECT pair_id, sum(w * abs(i / greatest(n, 1) - j / greatest(m, 1))) / greatest(sum(w), 1e-8) AS o FROM w JOIN l USING (pair_id) GROUP BY 1),
  gap AS (SELECT pair_id, un + 0.5 * o AS loss FROM l JOIN o USING (pair_id))"""
_add("gap_pattern_loss", gaps, f"WITH {_GAP} SELECT pair_id, round(loss, 6) + 0.0 AS loss FROM gap")
_add(
    "plausibility_loss",
    lambda s, d: E.plausibility_loss(D.table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_discount", "l_tax"), {"l_discount": 0.7, "l_tax": 0.3}).select("id", rounded("loss").alias("loss")),
    "SELECT l_orderkey * 10 + l_linenumber AS id, round(l_discount * 0.7 + l_tax * 0.3, 6) + 0.0 AS loss FROM lineitem",
)


def _pairs(spark, sf_dir):
    p = D.table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("pair_id"), F.upper("p_name").alias("protein_sequence"), F.concat(F.lower("p_type"), F.col("p_size").cast("string")).alias("drug_smiles"), F.col("p_retailprice").alias("target"))


_FEATURES = ["protein_length", "hydrophobic", "charged", "drug_length", "hetero", "rings"]
_share = lambda x, letters: f"(length({x}) - length(translate({x}, '{letters}', ''))) / greatest(length({x}), 1)"
_add(
    "pair_features",
    lambda s, d: E.pair_features(_pairs(s, d)).select("pair_id", *[rounded(c).alias(c) for c in _FEATURES]),
    f"""WITH p AS (SELECT p_partkey AS pair_id, upper(p_name) AS p, lower(p_type) || p_size AS s FROM part) SELECT pair_id, CAST(length(p) AS DOUBLE) AS protein_length, round({_share("p", "AVILMFWY")}, 6) AS hydrophobic, round({_share("p", "DEKR")}, 6) AS charged,
    CAST(length(s) AS DOUBLE) AS drug_length, round({_share("s", "NOSnos")}, 6) AS hetero, round((length(s) - length(translate(s, '123456789', ''))) / 2.0, 6) AS rings FROM p""",
)


def ridge_baseline(spark, sf_dir):
    """Fit and residual of the target's closed-form ridge on one feature: two columns, so SQL can write the solution down."""
    f = E.pair_features(_pairs(spark, sf_dir))
    w = R.ridge_fit(f, ["drug_length"], "target", 1.0)
    return f.select("pair_id", rounded(F.col("drug_length") * float(w[0]) + float(w[1]), 3).alias("predicted"))


_add(
    "ridge_baseline",
    ridge_baseline,
    """WITH p AS (SELECT p_partkey AS pair_id, CAST(length(lower(p_type) || p_size) AS DOUBLE) AS x, p_retailprice AS y FROM part), s AS (SELECT count(*) + 1.0 AS n, sum(x) AS sx, sum(x * x) + 1.0 AS sxx, sum(y) AS sy, sum(x * y) AS sxy FROM p),
    w AS (SELECT (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b, (sxx * sy - sx * sxy) / (n * sxx - sx * sx) AS a FROM s) SELECT pair_id, round(x * b + a, 3) AS predicted FROM p, w""",
)
_add("cross_entropy", lambda s, d: R.cross_entropy(D.points(s, d).select("label", F.slice("vec", 1, 16).alias("z")), "z", "label").select(rounded("loss").alias("loss")),
    f"WITH {D.POINTS}, x AS (SELECT vec[1:16] AS z, label FROM points) SELECT round(avg(ln(list_sum(list_transform(z, lambda v: exp(v)))) - z[label + 1]), 6) AS loss FROM x")


def training(spark, sf_dir):
    """Loss history of a small classifier of the embeddings' labels."""
    p = D.points(spark, sf_dir)
    t = R.Trainer(L.dense(7, 64, 16, 16), rate=0.05).fit(p, epochs=6)
    return spark.createDataFrame([(i, round(v, 5)) for i, v in enumerate(t.history)], "epoch long, loss double")


_add("trainer_history", training)

# Networks over items
_ERR = L.dense(101, 25, 16, 4)


def error_correction(spark, sf_dir):
    def run(text):
        return L.correct_errors(L.one_hot(text), np.array([10.0 + 3 * (i % 8) for i in range(len(text))]), _ERR).sum(0)

    return _outputs(D.sequences(spark, sf_dir).withColumnRenamed("seq_id", "id"), ["sequence"], run)


_add("soft_error_correction", error_correction)
_MAP = {"q": N.seeded(111, 4, 8), "k": N.seeded(112, 4, 8), "c": N.seeded(113, 8)}


def read_mapping(spark, sf_dir):
    """Reads of 20 letters from each document against the first 64 letters of the same."""

    def run(text):
        if len(text) < 20:
            return [-1.0, 0.0]
        _, place, quality = L.map_read(L.one_hot(text[-20:]), L.one_hot(text[:64]), _MAP)
        return [place, quality]

    return _outputs(D.sequences(spark, sf_dir).withColumnRenamed("seq_id", "id"), ["sequence"], run)


_add("read_mapping", read_mapping)


def star(spark, sf_dir):
    """Consensus of each language and source: every document's first 24 letters laid on those of the first, then averaged by place."""
    docs = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.concat_ws("/", "lang", "source").alias("family"))
    s = D.sequences(spark, sf_dir).filter(F.length("sequence") >= 24).select("seq_id", F.substring("sequence", 1, 24).alias("s")).join(docs, "seq_id")
    first = s.groupBy("family").agg(F.min(F.struct("seq_id", "s")).alias("a")).select("family", F.col("a.seq_id").alias("anchor_id"), F.col("a.s").alias("anchor"))
    embed = N.seeded(121, 4, 6)

    def run(i, anchor_id, anchor, text):
        x = L.one_hot(text)
        return (_plain(x if i == anchor_id else L.align_to_anchor(L.one_hot(anchor), x, embed)),)

    out = K.per_row(s.join(first, "family"), ["seq_id", "anchor_id", "anchor", "s"], {"out": _DOUBLES}, run)
    long = out.select("family", F.posexplode("out").alias("place", "value"))
    return long.groupBy("family", "place").agg(rounded(F.avg("value"), 5).alias("value"))


_add("star_alignment", star)
_BIN = {"encoder": L.dense(131, 137, 32), "mean": N.seeded(132, 32, 4), "centres": N.seeded(133, 5, 4)}


def binning(spark, sf_dir):
    """Contigs from documents: canonical tetranucleotide spectra and lengths as abundance."""
    s = D.sequences(spark, sf_dir)
    spectra = kmer_features(s, 4, canonical=True).groupBy("seq_id").agg(F.map_from_entries(F.collect_list(F.struct("kmer", "frequency"))).alias("f"), F.sum("n").cast("double").alias("a"))
    kmers = sorted({min(k, k.translate(str.maketrans("ACGT", "TGCA"))[::-1], key=lambda x: sum("ACGT".index(c) * 4**i for i, c in enumerate(x))) for k in ("".join("ACGT"[(v >> (2 * i)) & 3] for i in range(4)) for v in range(256))})
    assert len(kmers) == kmer_dimension(4, True)
    x = spectra.select(F.col("seq_id").alias("id"), F.array(*[F.coalesce(F.col("f")[k], F.lit(0.0)) for k in kmers]).alias("x"), "a")
    return _outputs(x, ["x", "a"], lambda f, a: L.bin_contigs(np.array([f]), np.array([[a]]), _BIN)[1][0])


_add("metagenomic_binning", binning)
_GUIDE = {"kernel": N.seeded(141, 5, 4, 8), "bias": np.zeros(8), "head": L.dense(142, 8, 8, 1)}
_add("guide_scores", lambda s, d: _outputs(D.sequences(s, d).filter(F.length("sequence") >= 23).select(F.col("seq_id").alias("id"), F.substring("sequence", 1, 23).alias("g")), ["g"], lambda g: [L.guide_score(g, _GUIDE)]))
_CNN = {"convolutions": [(N.seeded(151, 3, 3, 3, 4), np.zeros(4)), (N.seeded(152, 3, 3, 4, 6), np.zeros(6))], "head": L.dense(153, 6, 3)}


def image_classifier(spark, sf_dir):
    px = _image(spark, sf_dir).withColumn("id", F.floor(F.col("position") / 8))
    img = px.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("row", (F.col("position") % 8).alias("c"), "quality", "mismatch", "strand"))).alias("px"))
    flat = img.select("id", F.flatten(F.transform("px", lambda p: F.array(p["row"].cast("double"), p["c"].cast("double"), p["quality"], p["mismatch"], p["strand"]))).alias("x"))

    def run(x):
        v, image = np.array(x).reshape(-1, 5), np.zeros((12, 8, 3))
        image[v[:, 0].astype(int), v[:, 1].astype(int)] = v[:, 2:]
        return L.classify_image(image, _CNN)

    return _outputs(flat, ["x"], run)


_add("image_variant_classifier", image_classifier)
_FNO = {"lift": N.seeded(161, 1, 4), "layers": [(N.seeded(162, 6, 4, 4) + 1j * N.seeded(163, 6, 4, 4), N.seeded(164, 4, 4))], "project": N.seeded(165, 4, 1)}
_MARKS = (np.array([0.5, 0.3, 0.2]), np.array([[0.9, 0.05, 0.05], [0.1, 0.8, 0.1], [0.1, 0.2, 0.7]]), np.array([[0.9, 0.2], [0.3, 0.7], [0.1, 0.1]]))


def _tracks(spark, sf_dir):
    """Hourly event signals of each event type, in pieces of 96 hours."""
    h = D.reads(spark, sf_dir).groupBy("base", F.floor(F.col("position") / 96).alias("part"), (F.col("position") % 96).alias("at")).agg(F.count("*").cast("double").alias("n"))
    m = h.groupBy(F.concat_ws(":", "base", "part").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("m"))
    return m.select("id", F.transform(F.sequence(F.lit(0), F.lit(95)), lambda i: F.coalesce(F.col("m")[i.cast("long")], F.lit(0.0))).alias("x"))


_add("fourier_peaks", lambda s, d: _outputs(_tracks(s, d), ["x"], lambda x: L.fourier_peaks(np.array(x), _FNO)))
_add("chromatin_states", lambda s, d: _outputs(_tracks(s, d), ["x"], lambda x: L.chromatin_states(np.stack([np.array(x) > 0, np.array(x) > 1], 1).astype(float), *_MARKS)[1]))
_SOLO = {"encoder": L.dense(171, 64, 16), "mean": N.seeded(172, 16, 4), "logvar": N.seeded(173, 16, 4), "head": L.dense(174, 4, 1)}
_add("doublet_classifier", lambda s, d: N.apply_model(D.points(s, d).select("id", "vec"), "vec", "out", lambda x: L.doublet_probability(np.abs(x), _SOLO)[:, None]).select("id", rounded(F.col("out")[0]).alias("p")))
_DENOISE = {"genes": N.seeded(181, 64, 8), "value": N.seeded(182, 8), "block": N.block_params(183, 8, 16), "out": N.seeded(184, 8, 1)}
_add("masked_denoiser", lambda s, d: _outputs(D.points(s, d), ["id", "vec"], lambda i, v: L.denoise(np.array(v), (np.arange(64) + i) % 8 == 0, _DENOISE)))


def domains(spark, sf_dir):
    """Domains of each label's points as one tissue: neighbours in two coordinates, features in the others."""
    p = D.points(spark, sf_dir)
    params = {"whole": L.block_parameters(191, 6, 1, 4), "pruned": L.block_parameters(192, 6, 1, 4), "prototypes": N.seeded(193, 3, 4)}
    t = p.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("id", F.slice("vec", 1, 8).alias("v")))).alias("cells"))
    t = t.select(F.col("label").alias("id"), F.flatten(F.transform("cells", lambda c: c["v"])).alias("x"))

    def run(x):
        v = np.array(x).reshape(-1, 8)
        d = ((v[:, None, :2] - v[None, :, :2]) ** 2).sum(-1) + np.diag(np.full(len(v), np.inf))
        k = min(4, len(v) - 1)
        edges = np.array([(j, i) for i in range(len(v)) for j in np.argsort(d[i], kind="stable")[:k]]).reshape(-1, 2)
        known = {tuple(e) for e in edges.tolist()}
        mutual = np.array([(t, s) in known for s, t in edges.tolist()])
        return L.spatial_domains(v[:, 2:], edges, mutual, params)[1][:, :2]

    return _outputs(t, ["x"], run)


_add("spatial_domains", domains)


def communication(spark, sf_dir):
    """Pathway scores of each order's items as cells in a chain, with two signals on every edge."""
    params = {"block": L.block_parameters(201, 3, 2, 4), "decoder": L.dense(202, 4, 3)}
    g = D.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_discount", "l_tax"))).alias("items"))
    g = g.select("id", F.flatten(F.transform("items", lambda s: F.array(s["l_quantity"] / 50, s["l_discount"], s["l_tax"]))).alias("x"))

    def run(x):
        v = np.array(x).reshape(-1, 3)
        n = len(v)
        e = np.array([(i, i + 1) for i in range(n - 1)] + [(i + 1, i) for i in range(n - 1)]).reshape(-1, 2)
        return L.pathway_scores(v, e, np.stack([v[e[:, 0], 0], v[e[:, 1], 1]], 1) if n > 1 else np.zeros((0, 2)), params)[1].mean(0)

    return _outputs(g, ["x"], run)


_add("cell_communication", communication)


def grn(spark, sf_dir):
    """Strengths of three factors over all genes, from the genes' mean expression: one row of means."""
    n = D.table(spark, sf_dir, "customer").count()
    params = {"node": N.seeded(211, 1, 4), "block": L.block_parameters(212, 4, 3, 4), "score": N.seeded(213, 8)}
    m = D.counts(spark, sf_dir).groupBy("gene_id").agg((F.sum("value") / n).alias("m")).agg(F.array_sort(F.collect_list(F.struct("gene_id", "m"))).alias("g"))
    m = m.select(F.lit(0).alias("id"), F.transform("g", lambda x: x["m"]).alias("m"))
    return _outputs(m, ["m"], lambda means: L.regulatory_matrix(np.array(means) / 100, np.arange(min(3, len(means))), params))


_add("regulatory_network", grn)


def slices(spark, sf_dir):
    """Two tissue slices of each label, of its points by parity."""
    p = D.points(spark, sf_dir)
    t = p.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("id", F.slice("vec", 1, 8).alias("v")))).alias("cells"))
    t = t.select(F.col("label").alias("id"), F.flatten(F.transform("cells", lambda c: c["v"])).alias("x"))

    def run(x):
        v = np.array(x).reshape(-1, 8)
        a, b = v[::2], v[1::2]
        return L.paste_alignment(a[:, 2:], b[:, 2:], a[:, :2], b[:, :2])[1][:4] if len(b) else []

    return _outputs(t, ["x"], run)


_add("slice_alignment", slices)
_ANC = {"encoder": L.dense(221, 64, 3), "frequencies": N.seeded(222, 3, 64)}
_add("ancestry", lambda s, d: _outputs(D.points(s, d), ["vec"], lambda v: L.ancestry(np.clip(np.round(np.abs(np.array([v])) * 2), 0, 2), _ANC)[0]))


def molecules(spark, sf_dir):
    """Fingerprints and properties of each order's items as atoms in a chain."""
    layers = [{"message": N.seeded(231, 4, 4), "update": N.seeded(232, 7, 4)}, {"message": N.seeded(233, 5, 4), "update": N.seeded(234, 8, 4)}]
    fp = {"layers": layers, "out": N.seeded(235, 4, 6)}
    at = {"embed": N.seeded(241, 3, 4), "gate": L.block_parameters(242, 4, 1, 4), "atom": L.gru_parameters(243, 4), "mol": L.gru_parameters(251, 4), "align": N.seeded(261, 8), "value": N.seeded(262, 4, 4)}
    heads = {t: L.dense(271 + 3 * i, 6, 4, 1) for i, t in enumerate([*L.ADMET_REGRESSION, *L.ADMET_CLASSIFICATION])}
    patterns = N.seeded(281, 5, 3)
    g = D.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_discount", "l_tax"))).alias("items"))
    g = g.select("id", F.flatten(F.transform("items", lambda s: F.array(s["l_quantity"] / 50, s["l_discount"], s["l_tax"]))).alias("x"))

    def run(x):
        v = np.array(x).reshape(-1, 3)
        n = len(v)
        e = np.array([(i, i + 1) for i in range(n - 1)] + [(i + 1, i) for i in range(n - 1)]).reshape(-1, 2)
        f = np.ones((len(e), 1))
        print_ = L.graph_fingerprint(v, e, f, fp)
        admet = L.predict_properties(print_, heads, set(L.ADMET_CLASSIFICATION))
        return np.r_[print_, L.attentive_fingerprint(v, e, f, at), L.soft_keys(v, patterns, np.full(5, 0.2)), [admet["caco2"], admet["herg"]]]

    return _outputs(g, ["x"], run)


_add("molecular_networks", molecules)
_DTI = {"embed": N.seeded(291, 20, 8), "block": N.block_params(292, 8, 16), "head": L.dense(299, 11, 8, 1)}
_add("drug_target_scores", lambda s, d: _outputs(_pairs(s, d).select(F.col("pair_id").alias("id"), F.regexp_replace("protein_sequence", "[^A-Z]", "").alias("p"), F.array(F.length("drug_smiles").cast("double") / 10, F.lit(0.5), F.col("target") / 1000).alias("d")), ["p", "d"], lambda p, d: [L.pair_affinity(p, np.array(d), _DTI)]))


def dynamics(spark, sf_dir):
    """Five steps of eight particles for each label, started from its points: Verlet energy drift is in the tests."""
    t = D.points(spark, sf_dir).groupBy("label").agg(F.slice(F.array_sort(F.collect_list(F.struct("id", F.slice("vec", 1, 3).alias("v")))), 1, 8).alias("c"))
    t = t.select(F.col("label").alias("id"), F.flatten(F.transform("c", lambda c: c["v"])).alias("x"))

    def run(x):
        grid = np.stack(np.meshgrid([0, 1.5], [0, 1.5], [0, 1.5]), -1).reshape(-1, 3)
        v = np.array(x).reshape(-1, 3)
        return L.integrate(grid[: len(v)] + 0.05 * np.tanh(v), np.zeros_like(v), L.lennard_jones_force, 5, 0.002)[-1]

    return _outputs(t, ["x"], run)


_add("molecular_dynamics", dynamics)
