"""Queries over single-cell and graph operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions.numeric import rounded
from strandlake.operators import cells as C
from strandlake.operators import graph as G
from strandlake.plans import derive as D

QUERIES, SQL = {}, {}
N_CELLS = "(SELECT count(*) FROM customer)"


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _n(spark, sf_dir):
    return D.table(spark, sf_dir, "customer").count()


_LIB = f"{D.COUNTS}, lib AS (SELECT cell_id, sum(value) AS lib FROM counts GROUP BY 1)"
_NORM = f"{_LIB}, norm AS (SELECT cell_id, gene_id, ln(value * (10000 / greatest(lib, 1)) + 1) AS value FROM counts JOIN lib USING (cell_id))"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count normalisation, gene dispersion over all cells and the mask of highly variable genes."""
    norm = C.normalize_counts(D.counts(spark, sf_dir))
    v = C.highly_variable_genes(norm, _n(spark, sf_dir), 10)
    return v.select("gene_id", rounded("mean").alias("mean"), rounded("variance").alias("variance"), rounded("dispersion").alias("dispersion"), "selected")


_add(
    "highly_variable_genes",
    flagship,
    f"""WITH {_NORM}, m AS (SELECT gene_id, sum(value) / {N_CELLS} AS mean, sum(value * value) / {N_CELLS} - pow(sum(value) / {N_CELLS}, 2) AS var FROM norm GROUP BY 1)
    SELECT gene_id, round(mean, 6) AS mean, round(var, 6) AS variance, round(var / mean, 6) AS dispersion,
    CAST(row_number() OVER (ORDER BY var / mean DESC, gene_id DESC) <= 10 AS DOUBLE) AS selected FROM m""",
)
_add(
    "normalize_counts",
    lambda s, d: C.normalize_counts(D.counts(s, d)).select("cell_id", "gene_id", rounded("value").alias("value")),
    f"WITH {_NORM} SELECT cell_id, gene_id, round(value, 6) AS value FROM norm",
)
_add("library_size", lambda s, d: C.library_sizes(D.counts(s, d)), f"WITH {_LIB} SELECT cell_id, lib AS library_size FROM lib")


def scaled(spark, sf_dir):
    cells = D.obs(spark, sf_dir)
    return C.standardize(C.normalize_counts(D.counts(spark, sf_dir)), cells, 2.0).select("cell_id", "gene_id", rounded("z").alias("z"))


_add(
    "standardize_features",
    scaled,
    f"""WITH {_NORM}, m AS (SELECT gene_id, sum(value) / {N_CELLS} AS mean, greatest(sum(value * value) / {N_CELLS} - pow(sum(value) / {N_CELLS}, 2), 0) AS var FROM norm GROUP BY 1)
    SELECT c_custkey AS cell_id, m.gene_id, round(least(greatest((coalesce(value, 0) - mean) / CASE WHEN var > 1e-12 THEN sqrt(var) ELSE 1 END, -2), 2), 6) + 0.0 AS z
    FROM customer CROSS JOIN m LEFT JOIN norm n ON n.cell_id = c_custkey AND n.gene_id = m.gene_id""",
)
_add(
    "arcsinh_transform",
    lambda s, d: C.arcsinh_transform(D.counts(s, d)).select("cell_id", "gene_id", rounded("value").alias("value")),
    f"WITH {D.COUNTS} SELECT cell_id, gene_id, round(asinh(value / 5), 6) AS value FROM counts",
)
_add(
    "tfidf_reduction",
    lambda s, d: C.tfidf(D.counts(s, d), _n(s, d)).select("cell_id", "gene_id", rounded("value").alias("value")),
    f"""WITH {_LIB}, g AS (SELECT gene_id, sum(value) AS t FROM counts GROUP BY 1)
    SELECT cell_id, gene_id, round(ln(1 + value / lib * ({N_CELLS} / t) * 10000), 6) AS value FROM counts JOIN lib USING (cell_id) JOIN g USING (gene_id)""",
)
_MEANS = f"{D.POINTS}, l AS (SELECT id, label, unnest(range(64)) AS k, vec FROM points), cm AS (SELECT label AS cluster, k, avg(vec[k + 1]) AS c FROM l GROUP BY 1, 2)"


def clustering(spark, sf_dir):
    p = D.points(spark, sf_dir)
    a = C.cluster_assignments(p, C.cluster_means(p), 5.0)
    return a.select("id", "cluster", rounded("p").alias("p"), "hard")


_SOFT = f"{_MEANS}, dd AS (SELECT id, cluster, sum(pow(vec[l.k + 1] - c, 2)) AS d FROM l JOIN cm ON l.k = cm.k GROUP BY 1, 2), e AS (SELECT *, exp((min(d) OVER (PARTITION BY id) - d) / 5) AS z FROM dd), a AS (SELECT id, cluster, d, z / sum(z) OVER (PARTITION BY id) AS p FROM e)"
_add("soft_kmeans_clustering", clustering, f"WITH {_SOFT} SELECT id, cluster, round(p, 6) AS p, row_number() OVER (PARTITION BY id ORDER BY d, cluster) = 1 AS hard FROM a")


def harmony(spark, sf_dir):
    p = D.points(spark, sf_dir)
    h = C.harmony_step(p, C.cluster_means(p), 5.0)
    return h.select("id", *[rounded(F.col("vec")[i], 5).alias(f"v{i}") for i in range(4)])


_add(
    "harmony_correction",
    harmony,
    f"""WITH {_SOFT}, top AS (SELECT id, cluster AS top FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cluster) = 1),
    b AS (SELECT id, batch, top, count(*) OVER (PARTITION BY top, batch) AS n, count(*) OVER (PARTITION BY top) AS m, count(*) OVER (PARTITION BY batch) / (SELECT count(*) FROM points) AS share FROM points JOIN top USING (id)),
    t AS (SELECT id, k, sum(p * c) AS t FROM a JOIN cm USING (cluster) WHERE k < 4 GROUP BY 1, 2),
    o AS (SELECT id, k, vec[k + 1] + least(greatest(n / m / share, 0.5), 2) * 0.1 * (t - vec[k + 1]) AS v FROM points JOIN b USING (id) JOIN t USING (id))
    SELECT id, """
    + ", ".join(f"round(max(v) FILTER (k = {i}), 5) + 0.0 AS v{i}" for i in range(4))
    + " FROM o GROUP BY id",
)
_add(
    "ambient_removal",
    lambda s, d: C.ambient_removal(D.counts(s, d)).select("cell_id", "gene_id", rounded("value").alias("value")),
    f"""WITH {_LIB}, g AS (SELECT gene_id, sum(value) AS g FROM counts GROUP BY 1)
    SELECT cell_id, gene_id, round(greatest(value - 0.1 * (g / (SELECT sum(value) FROM counts)) * lib, 0), 6) AS value FROM counts JOIN lib USING (cell_id) JOIN g USING (gene_id)""",
)
_PAIRS = "d AS (SELECT a.id AS i, b.id AS j, round(sqrt(list_sum(list_transform(range(1, 65), lambda k: pow(a.vec[k] - b.vec[k], 2))) + 1e-16), 6) AS d FROM points a, points b WHERE a.id <> b.id)"
_KNN = f"{D.POINTS}, {_PAIRS}, knn AS (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM d QUALIFY rank <= 5)"
_add("knn_graph", lambda s, d: G.knn(D.points(s, d), 5), f"WITH {_KNN} SELECT i, j, d, rank FROM knn")
_add(
    "pairwise_distances",
    lambda s, d: G.pairwise_distances(D.points(s, d)).groupBy("i").agg(rounded(F.sum("d"), 3).alias("total"), F.max("d").alias("farthest")),
    f"WITH {D.POINTS}, {_PAIRS} SELECT i, round(sum(d), 3) AS total, max(d) AS farthest FROM d GROUP BY i",
)
_add(
    "pairwise_cosine",
    lambda s, d: G.pairwise_distances(D.points(s, d), "cosine").groupBy("i").agg(rounded(F.sum("d"), 3).alias("total"), F.max("d").alias("farthest")),
    f"""WITH {D.POINTS}, c AS (SELECT a.id AS i, b.id AS j, round(least(greatest(1 - list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec) * list_dot_product(b.vec, b.vec)), 0), 2), 6) AS d
    FROM points a, points b WHERE a.id <> b.id) SELECT i, round(sum(d), 3) AS total, max(d) AS farthest FROM c GROUP BY i""",
)


def fuzzy(spark, sf_dir):
    return G.fuzzy_weights(D.points(spark, sf_dir), 6).select("i", rounded("weight", 4).alias("weight"), "n")


_FUZZY = f"{D.POINTS}, {_PAIRS}, sg AS (SELECT i, d AS sigma FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 5), m AS (SELECT i, j, exp(-d / sigma) AS w FROM d JOIN sg USING (i))"
_add(
    "fuzzy_simplicial_set",
    fuzzy,
    f"WITH {_FUZZY} SELECT a.i, round(sum(a.w + b.w - a.w * b.w), 4) AS weight, count(*) + 1 AS n FROM m a JOIN m b ON a.i = b.j AND a.j = b.i GROUP BY a.i",
)
_add(
    "mutual_neighbours",
    lambda s, d: G.mutual_edges(G.knn(D.points(s, d), 5).select("i", "j", "d")),
    f"WITH {_KNN} SELECT a.i, a.j, a.d FROM knn a JOIN knn b ON a.i = b.j AND a.j = b.i",
)


def scattered(how):
    def query(spark, sf_dir):
        orders = D.table(spark, sf_dir, "orders")
        return G.scatter(orders, D.table(spark, sf_dir, "customer"), "c_custkey", "o_custkey", "o_totalprice", how).select("c_custkey", rounded("value", 3).alias("value"))

    return query


for _how, _agg in (("sum", "sum(o_totalprice)"), ("mean", "sum(o_totalprice) / (count(o_totalprice) + 1e-8)"), ("max", "max(o_totalprice)")):
    _add(f"scatter_{_how}", scattered(_how), f"SELECT c_custkey, round(coalesce({_agg}, 0), 3) AS value FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
_add(
    "global_pool",
    lambda s, d: G.global_pool(D.table(s, d, "customer").filter("c_acctbal is not null"), "c_nationkey", "c_acctbal").select(
        F.col("c_nationkey").cast("long").alias("graph"), rounded("sum", 3).alias("sum"), rounded("mean", 4).alias("mean"), "max"
    ),
    "SELECT CAST(c_nationkey AS BIGINT) AS graph, round(sum(c_acctbal), 3) AS sum, round(avg(c_acctbal), 4) AS mean, max(c_acctbal) AS max FROM customer GROUP BY 1",
)


def attention(spark, sf_dir):
    e = G.knn(D.points(spark, sf_dir), 5).withColumn("s", -F.col("d"))
    return G.edge_softmax(e, "s", "j").select("i", "j", rounded("a").alias("a"))


_add(
    "graph_attention_weights",
    attention,
    f"WITH {_KNN}, e AS (SELECT i, j, exp(min(d) OVER (PARTITION BY j) - d) AS z FROM knn) SELECT i, j, round(z / (sum(z) OVER (PARTITION BY j) + 1e-10), 6) AS a FROM e",
)


def batch_mixing(spark, sf_dir):
    """Negative mean normalised entropy of the batches among each point's neighbours."""
    p = D.points(spark, sf_dir)
    near = G.knn(p, 10).join(p.select(F.col("id").alias("j"), "batch"), "j")
    share = near.groupBy("i", "batch").agg(F.count("*").alias("c")).withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("i")))
    h = share.groupBy("i").agg((-F.sum(F.col("p") * F.log("p"))).alias("h"))
    return h.agg(rounded(-F.avg(F.col("h") / F.log(F.lit(2.0)))).alias("loss"))


_add(
    "batch_mixing_loss",
    batch_mixing,
    f"""WITH {D.POINTS}, {_PAIRS}, n AS (SELECT i, j FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 10),
    s AS (SELECT i, batch, count(*) / 10.0 AS p FROM n JOIN points ON j = id GROUP BY 1, 2), h AS (SELECT i, -sum(p * ln(p)) AS h FROM s GROUP BY 1)
    SELECT round(-avg(h / ln(2)), 6) + 0.0 AS loss FROM h""",
)


def doublets(spark, sf_dir):
    p = D.points(spark, sf_dir)
    other = p.select((F.col("id") - 7).alias("id"), F.col("vec").alias("vec2"))
    fake = p.join(other, "id").select((-F.col("id") - 1).alias("id"), F.zip_with("vec", "vec2", lambda x, y: (x + y) / 2).alias("vec"))
    s = C.doublet_scores(p.select("id", "vec"), fake, 8)
    return s.select("id", "simulated_neighbours", rounded("score").alias("score"))


_add("doublet_scores", doublets)


def simulated(spark, sf_dir):
    c = C.simulate_doublets(D.counts(spark, sf_dir), D.obs(spark, sf_dir), 200)
    return c


_add("synthetic_doublets", simulated)


def diffusion(spark, sf_dir):
    p = D.points(spark, sf_dir)
    v = C.diffuse_points(p.select("id", "vec", *[F.col("vec")[i].alias(f"f{i}") for i in range(3)]), ["f0", "f1", "f2"], 5, steps=2)
    return v.select("id", F.posexplode(F.array("f0", "f1", "f2")).alias("feature", "value")).select("id", "feature", rounded("value", 5).alias("value"))


_add(
    "diffusion_imputation",
    diffusion,
    f"""WITH {D.POINTS}, d AS (SELECT a.id AS i, b.id AS j, CASE WHEN a.id = b.id THEN 0 ELSE round(sqrt(list_sum(list_transform(range(1, 65), lambda k: pow(a.vec[k] - b.vec[k], 2))) + 1e-16), 6) END AS d FROM points a, points b),
    sg AS (SELECT i, d AS sigma FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 6), a AS (SELECT i, j, exp(-d / sigma) AS a FROM d JOIN sg USING (i)),
    b AS (SELECT x.i, x.j, (x.a + y.a) / 2 AS a FROM a x JOIN a y ON x.i = y.j AND x.j = y.i), w AS (SELECT i, j, a / sum(a) OVER (PARTITION BY i) AS w FROM b),
    v AS (SELECT id, f AS feature, vec[f + 1] AS value FROM points, (VALUES (0), (1), (2)) t(f)),
    one AS (SELECT i AS id, feature, sum(w * value) AS value FROM w JOIN v ON j = id GROUP BY 1, 2)
    SELECT i AS id, feature, round(sum(w * value), 5) + 0.0 AS value FROM w JOIN one ON j = id GROUP BY 1, 2""",
)


def velocity(spark, sf_dir):
    layers = D.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell_id"), F.col("l_returnflag").alias("gene_id")).agg(
        F.avg("l_quantity").alias("unspliced"), F.avg("l_extendedprice").alias("spliced")
    )
    return C.rna_velocity(layers).select("cell_id", "gene_id", rounded("velocity", 3).alias("velocity"), rounded("projected", 3).alias("projected"))


_E1 = "greatest({s} + 0.1 * (u - 0.5 * {s}), 0)"
_add(
    "rna_velocity",
    velocity,
    """WITH l AS (SELECT l_suppkey AS cell_id, l_returnflag AS gene_id, avg(l_quantity) AS u, avg(l_extendedprice) AS s FROM lineitem GROUP BY 1, 2),
    a AS (SELECT *, greatest(s + 0.1 * (u - 0.5 * s), 0) AS s1 FROM l), b AS (SELECT *, greatest(s1 + 0.1 * (u - 0.5 * s1), 0) AS s2 FROM a)
    SELECT cell_id, gene_id, round(u - 0.5 * s, 3) AS velocity, round(greatest(s2 + 0.1 * (u - 0.5 * s2), 0), 3) AS projected FROM b""",
)


def switches(spark, sf_dir):
    t = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id"), (F.pmod("c_custkey", F.lit(97)) / 97.0).alias("t"))
    g = spark.createDataFrame([("g1", 2.0, 0.3, 0.1), ("g2", -1.0, 0.7, 1.5)], "gene_id string, amplitude double, t_switch double, baseline double")
    return C.switch_expression(t, g).select("cell_id", "gene_id", rounded("expected").alias("expected"))


_add(
    "switch_de",
    switches,
    """SELECT c_custkey AS cell_id, gene_id, round(a / (1 + exp(-((c_custkey % 97) / 97.0 - w) / 0.1)) + b, 6) AS expected
    FROM customer, (VALUES ('g1', 2.0, 0.3, 0.1), ('g2', -1.0, 0.7, 1.5)) v(gene_id, a, w, b)""",
)


def communication(spark, sf_dir):
    c = C.normalize_counts(D.counts(spark, sf_dir))
    ids = D.obs(spark, sf_dir).select(F.col("cell_id").alias("i"))
    edges = ids.select("i", F.explode(F.array(F.col("i") + 1, F.col("i") + 2)).alias("j"))
    pairs = spark.createDataFrame([("Brand#11", "Brand#21"), ("Brand#12", "Brand#31")], "ligand string, receptor string")
    return C.ligand_receptor(c, edges, pairs).select("i", "ligand", "receptor", rounded("score").alias("score"))


_add(
    "ligand_receptor",
    communication,
    f"""WITH {_NORM}, lr(ligand, receptor) AS (VALUES ('Brand#11', 'Brand#21'), ('Brand#12', 'Brand#31')),
    l AS (SELECT c_custkey AS i, n.gene_id AS ligand, sum(value) / 2 AS l FROM customer JOIN norm n ON n.cell_id IN (c_custkey + 1, c_custkey + 2) GROUP BY 1, 2)
    SELECT i, ligand, receptor, round(pow(l * value, 2) / (0.25 + pow(l * value, 2) + 1e-8), 6) AS score FROM l JOIN lr USING (ligand) JOIN norm ON cell_id = i AND gene_id = receptor""",
)
_U = "((CAST(('0x' || substr(md5('13|' || cell_id || '|' || gene_id), 1, 12)) AS BIGINT) + 0.5) / 281474976710656)"
_add(
    "read_downsampling",
    lambda s, d: C.downsample(D.counts(s, d), 500.0),
    f"""WITH {_LIB}, e AS (SELECT cell_id, gene_id, value * least(500 / lib, 1) AS e FROM counts JOIN lib USING (cell_id))
    SELECT cell_id, gene_id, floor(e) + CAST({_U} < e - floor(e) AS DOUBLE) AS value FROM e""",
)


def knockdown(spark, sf_dir):
    return C.knockdown_filter(D.counts(spark, sf_dir), D.obs(spark, sf_dir), residual=1.05, cell_residual=0.8, least_cells=5)


_add(
    "knockdown_filter",
    knockdown,
    f"""WITH {D.COUNTS}, {D.OBS}, nc AS (SELECT count(*) AS n FROM obs WHERE perturbation = 'non-targeting'),
    base AS (SELECT gene_id AS perturbation, sum(value) / (SELECT n FROM nc) AS base FROM counts WHERE cell_id IN (SELECT cell_id FROM obs WHERE perturbation = 'non-targeting') GROUP BY 1),
    own AS (SELECT o.cell_id, o.perturbation, coalesce(c.value, 0) AS target FROM obs o LEFT JOIN counts c ON c.cell_id = o.cell_id AND c.gene_id = o.perturbation WHERE o.perturbation <> 'non-targeting'),
    g AS (SELECT own.*, coalesce(base > 1e-8 AND avg(target) OVER (PARTITION BY own.perturbation) / base < 1.05 AND target / base < 0.8, false) AS good FROM own LEFT JOIN base USING (perturbation)),
    k AS (SELECT cell_id, good AND sum(CAST(good AS INT)) OVER (PARTITION BY perturbation) >= 5 AS kept FROM g)
    SELECT cell_id, coalesce(kept, false) OR perturbation = 'non-targeting' AS kept FROM obs LEFT JOIN k USING (cell_id)""",
)


def annotation(spark, sf_dir):
    c = C.normalize_counts(D.counts(spark, sf_dir))
    rows = [(t, f"Brand#{a}{b}", 1.0 + ((a * 3 + b * 5 + k * 7) % 4)) for k, t in enumerate(("alpha", "beta", "gamma")) for a in (1, 2, 3) for b in (1, 2)]
    m = spark.createDataFrame(rows, "cell_type string, gene_id string, rate double")
    return C.marker_annotation(c, m).select("cell_id", "cell_type", rounded("p").alias("p"))


_add(
    "marker_annotation",
    annotation,
    f"""WITH {_NORM}, mk AS (SELECT t AS cell_type, 'Brand#' || a || b AS gene_id, 1.0 + (a * 3 + b * 5 + k * 7) % 4 AS rate
    FROM (VALUES (0, 'alpha'), (1, 'beta'), (2, 'gamma')) x(k, t), (VALUES (1), (2), (3)) y(a), (VALUES (1), (2)) z(b)),
    s AS (SELECT c.cell_id, cell_type, sum(coalesce(value, 0) * ln(rate + 1e-8) - rate) AS s FROM (SELECT DISTINCT cell_id FROM counts) c CROSS JOIN mk
    LEFT JOIN norm n ON n.cell_id = c.cell_id AND n.gene_id = mk.gene_id GROUP BY 1, 2), e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY cell_id)) AS z FROM s)
    SELECT cell_id, cell_type, round(z / sum(z) OVER (PARTITION BY cell_id), 6) AS p FROM e""",
)
_add(
    "size_factors",
    lambda s, d: C.size_factors(D.counts(s, d), 25).select("cell_id", rounded("size_factor", 5).alias("size_factor")),
    f"""WITH {D.COUNTS}, n AS (SELECT count(DISTINCT cell_id) AS n FROM counts), g AS (SELECT gene_id, sum(ln(1 + value)) / (SELECT n FROM n) AS m FROM counts GROUP BY 1),
    f AS (SELECT c.cell_id, quantile_cont(ln(1 + coalesce(value, 0)) - m, 0.5) AS lf FROM (SELECT DISTINCT cell_id FROM counts) c CROSS JOIN g
    LEFT JOIN counts k ON k.cell_id = c.cell_id AND k.gene_id = g.gene_id GROUP BY 1)
    SELECT cell_id, round(exp(lf - avg(lf) OVER ()), 5) AS size_factor FROM f""",
)


def wald_test(spark, sf_dir):
    p = D.table(spark, sf_dir, "part")
    e = p.groupBy(F.col("p_brand").alias("gene_id")).agg((F.avg("p_size") / 10 - 2.5).alias("beta"), (F.stddev_samp("p_size") / F.sqrt(F.count("*")) / 10).alias("se"))
    return C.wald(e).select("gene_id", *[rounded(c).alias(c) for c in ("z", "p", "log2_fold", "significance")])


_add(
    "wald_test",
    wald_test,
    """WITH e AS (SELECT p_brand AS gene_id, avg(p_size) / 10 - 2.5 AS beta, stddev_samp(p_size) / sqrt(count(*)) / 10 AS se FROM part GROUP BY 1),
    z AS (SELECT *, beta / se AS z, 2 * (1 - 1 / (1 + exp(-1.7 * abs(beta / se)))) AS p FROM e)
    SELECT gene_id, round(z, 6) + 0.0 AS z, round(p, 6) AS p, round(beta / ln(2), 6) + 0.0 AS log2_fold, round(1 / (1 + exp(-(0.05 - p) / 0.01)), 6) AS significance FROM z""",
)
_add("stochastic_gates", lambda s, d: C.stochastic_gate(D.counts(s, d).groupBy("gene_id").agg((F.avg("value") / 100).alias("mu"))))


_add("sinkhorn_transport", lambda s, d: label_transport(s, d))


def label_transport(spark, sf_dir):
    """Plan between the label centres of the two batches: marginals are uniform over labels."""
    p = D.points(spark, sf_dir)
    side = lambda b: C.cluster_means(p.filter(F.col("batch") == b)).select(F.col("cluster").alias("id"), F.col("centre").alias("vec"))
    plan = G.sinkhorn(G.pairwise_distances(side(0), "squared", side(1)).select("i", "j", (F.col("d") / 20).alias("c")), 1.0, 10)
    return plan.select("i", "j", rounded("p").alias("p"))


_half = lambda r, by, on, have: f"{by}{r} AS (SELECT {by}, -ln(10) - ln(sum(exp(k + v))) AS v FROM k JOIN {on}{have} USING ({on}) GROUP BY {by})"
_chain = ["j0 AS (SELECT DISTINCT j, 0.0 AS v FROM k)"]
for _r in range(1, 11):
    _chain += [_half(_r, "i", "j", _r - 1), _half(_r, "j", "i", _r)]
SQL["sinkhorn_transport"] = (
    f"""WITH {D.POINTS}, l AS (SELECT batch, label, unnest(range(64)) AS k, vec FROM points), m AS (SELECT batch, label, k, avg(vec[k + 1]) AS c FROM l GROUP BY 1, 2, 3),
    k AS (SELECT a.label AS i, b.label AS j, -round(sum(pow(a.c - b.c, 2)), 6) / 20 AS k FROM m a JOIN m b ON a.k = b.k AND a.batch = 0 AND b.batch = 1 GROUP BY 1, 2), """
    + ", ".join(_chain)
    + " SELECT i, j, round(exp(k + i10.v + j10.v), 6) AS p FROM k JOIN i10 USING (i) JOIN j10 USING (j)"
)
