"""Queries over embedding-level operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions.numeric import dot, rounded
from strandlake.operators import cells as C
from strandlake.operators import embedding as E
from strandlake.operators import graph as G
from strandlake.operators import structure as M
from strandlake.plans import derive as D

QUERIES, SQL = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


_D64 = "round(sqrt(list_sum([pow(a.vec[k] - b.vec[k], 2) FOR k IN range(1, 65)]) + 1e-16), 6)"
_D2 = "round(sqrt(list_sum([pow(a.vec[k] - b.vec[k], 2) FOR k IN range(1, 3)]) + 1e-16), 6)"


def umap(spark, sf_dir):
    return E.umap_loss_of_points(D.points(spark, sf_dir), 6).select(rounded("loss", 2).alias("loss"))


_add(
    "umap_loss",
    umap,
    f"""WITH {D.POINTS}, d AS (SELECT a.id AS i, b.id AS j, {_D64} AS d, {_D2} AS e FROM points a, points b WHERE a.id <> b.id), sg AS (SELECT i, d AS s FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 5),
    m AS (SELECT d.i, j, exp(-d / s) AS w, e FROM d JOIN sg ON d.i = sg.i), u AS (SELECT a.w + b.w - a.w * b.w AS w, 1 / (1 + 1.577 * pow(a.e, 1.79)) AS q FROM m a JOIN m b ON a.i = b.j AND a.j = b.i)
    SELECT round(-sum(w * ln(q + 1e-6) + (1 - w) * ln(1 - q + 1e-6)), 2) AS loss FROM u""",
)


def gates(spark, sf_dir):
    v = D.points(spark, sf_dir).select(F.posexplode("vec").alias("component", "x")).groupBy("component").agg(F.var_samp("x").alias("variance"))
    return E.component_gates(v).select(F.col("component").cast("long").alias("component"), rounded("share").alias("share"), rounded("gate").alias("gate"))


_add(
    "soft_component_selection",
    gates,
    f"""WITH {D.POINTS}, v AS (SELECT k, var_samp(x) AS v FROM (SELECT unnest(range(64)) AS k, unnest(vec) AS x FROM points) GROUP BY 1), s AS (SELECT k, sum(v) OVER (ORDER BY v DESC, k) / sum(v) OVER () AS s FROM v)
    SELECT k AS component, round(s, 6) AS share, round(1 / (1 + exp(-(0.8 - s) / 0.05)), 6) AS gate FROM s""",
)


def _label_moves(spark, sf_dir):
    p = D.points(spark, sf_dir)
    nxt = p.select((F.col("id") - 1).alias("id"), F.col("label").alias("j"))
    return E.row_normalised(p.select("id", F.col("label").alias("i")).join(nxt, "id").groupBy("i", "j").agg(F.count("*").cast("double").alias("v")))


_MOVES = f"{D.POINTS}, mv AS (SELECT a.label AS i, b.label AS j, CAST(count(*) AS DOUBLE) AS c FROM points a JOIN points b ON b.id = a.id + 1 GROUP BY 1, 2), t AS (SELECT i, j, c / sum(c) OVER (PARTITION BY i) AS v FROM mv)"
_pow = ", ".join(f"p{k} AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM p{k - 1} a JOIN p1 b ON a.j = b.i GROUP BY 1, 2)" for k in range(2, 5))
_add(
    "pseudotime",
    lambda s, d: E.pseudotime(_label_moves(s, d), 0, 4).select("i", rounded("t", 5).alias("t")),
    f"""WITH {_MOVES}, p1 AS (SELECT i, j, sum(v) / 2 AS v FROM (SELECT i, j, v FROM t UNION ALL SELECT j, i, v FROM t) GROUP BY 1, 2), {_pow},
    m AS (SELECT i, j, sum(v) AS v FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4) GROUP BY 1, 2)
    SELECT a.i, round(sqrt(sum(pow(a.v - b.v, 2))), 5) + 0.0 AS t FROM m a JOIN m b ON b.i = 0 AND a.j = b.j GROUP BY 1""",
)


def _plan(spark, sf_dir):
    p = D.points(spark, sf_dir)
    side = lambda b: C.cluster_means(p.filter(F.col("batch") == b)).select(F.col("cluster").alias("id"), F.col("centre").alias("vec"))
    plan = G.sinkhorn(G.pairwise_distances(side(0), "squared", side(1)).select("i", "j", (F.col("d") / 20).alias("c")), 1.0, 3)
    return plan, side(0), side(1)


def trajectory(spark, sf_dir):
    plan, a, b = _plan(spark, sf_dir)
    long = lambda t: t.select("id", F.posexplode(F.slice("vec", 1, 3)).alias("k", "v"))
    x = E.transport_interpolation(plan, long(a), long(b)).join(E.transport_growth(plan), "i")
    return x.select("i", F.col("k").cast("long").alias("k"), rounded("v", 5).alias("v"), rounded("growth", 5).alias("growth"))


_add("transport_trajectory", trajectory)


def spatial(spark, sf_dir):
    p = D.points(spark, sf_dir)
    v = p.select("id", F.posexplode(F.slice("vec", 1, 6)).alias("feature", "value"))
    s = E.neighbour_mean(v, G.knn(p, 5))
    return M.spatial_variance_fraction(v, s).select(F.col("feature").cast("long").alias("feature"), rounded("fraction").alias("fraction"), rounded("p").alias("p"))


_KNN = f"{D.POINTS}, knn AS (SELECT a.id AS i, b.id AS j FROM points a JOIN points b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {_D64}, b.id) <= 5)"
_add(
    "spatial_gene_detection",
    spatial,
    f"""WITH {_KNN}, v AS (SELECT id, f AS feature, vec[f + 1] AS x FROM points, (SELECT unnest(range(6)) AS f)), s AS (SELECT i AS id, feature, avg(x) AS y FROM knn JOIN v ON j = id GROUP BY 1, 2),
    g AS (SELECT feature, greatest(var_pop(x) - var_pop(x - y), 0) / (var_pop(x) + 1e-8) AS f, count(*) AS n FROM v JOIN s USING (id, feature) GROUP BY 1) SELECT feature, round(f, 6) AS fraction, round(1 / (1 + exp(f * n - 2)), 6) AS p FROM g""",
)


def deconvolution(spark, sf_dir):
    p = D.points(spark, sf_dir)
    r = C.cluster_means(p).select(F.col("cluster").alias("cell_type"), F.col("centre").alias("signature"))
    return E.deconvolve(p, r, 0.2).select("id", "cell_type", rounded("p").alias("p"))


_CENTRES = f"{D.POINTS}, l AS (SELECT id, label, unnest(range(64)) AS k, vec FROM points), cm AS (SELECT label AS cell_type, k, avg(vec[k + 1]) AS c FROM l GROUP BY 1, 2), sc AS (SELECT id, cell_type, sum(vec[l.k + 1] * c) / 0.2 AS s FROM l JOIN cm ON l.k = cm.k GROUP BY 1, 2), pr AS (SELECT id, cell_type, exp(s - max(s) OVER (PARTITION BY id)) AS e FROM sc), pp AS (SELECT id, cell_type, e / sum(e) OVER (PARTITION BY id) AS p FROM pr)"
_add("spatial_deconvolution", deconvolution, f"WITH {_CENTRES} SELECT id, cell_type, round(p, 6) AS p FROM pp")


def deconvolution_quality(spark, sf_dir):
    p = D.points(spark, sf_dir)
    r = C.cluster_means(p).select(F.col("cluster").alias("cell_type"), F.col("centre").alias("signature"))
    got = E.deconvolve(p, r, 0.2)
    truth = got.join(p.select("id", "label"), "id").select("id", "cell_type", (F.col("cell_type") == F.col("label")).cast("double").alias("p"))
    return E.deconvolution_metrics(got, truth).select(rounded("pearson", 5).alias("pearson"), rounded("rmse", 5).alias("rmse"))


_add("deconvolution_metrics", deconvolution_quality, f"WITH {_CENTRES}, t AS (SELECT pp.id, corr(p, CAST(cell_type = label AS DOUBLE)) AS c, avg(pow(p - CAST(cell_type = label AS DOUBLE), 2)) AS se FROM pp JOIN points USING (id) GROUP BY 1) SELECT round(avg(c), 5) + 0.0 AS pearson, round(sqrt(avg(se)), 5) AS rmse FROM t")


def guidance(spark, sf_dir):
    p = D.points(spark, sf_dir)
    other = p.select((F.col("id") - 1).alias("id"), F.col("vec").alias("vec2"), F.col("label").alias("label2"))
    x = p.join(other, "id").select((dot("vec", "vec2") / F.sqrt(dot("vec", "vec") * dot("vec2", "vec2"))).alias("cosine"), (F.col("label") == F.col("label2")).cast("double").alias("contact"))
    return E.chromatin_guidance(x).select(rounded("loss").alias("loss"))


_add("chromatin_guidance", guidance, f"WITH {D.POINTS} SELECT round(avg(pow(1 / (1 + exp(-list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec) * list_dot_product(b.vec, b.vec)))) - CAST(a.label = b.label AS DOUBLE), 2)), 6) AS loss FROM points a JOIN points b ON b.id = a.id + 1")


def _matrix(spark, sf_dir, a, b):
    li = D.table(spark, sf_dir, "lineitem")
    return li.groupBy((F.col(a) % 12).alias("i"), (F.col(b) % 12).alias("j")).agg(F.count("*").cast("double").alias("v"))


_mat = lambda name, a, b: f"{name} AS (SELECT {a} % 12 AS i, {b} % 12 AS j, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2)"
_add(
    "alignment_score_loss",
    lambda s, d: E.alignment_score_loss(_matrix(s, d, "l_partkey", "l_suppkey"), s.range(12).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))).select(rounded("loss").alias("loss")),
    f"WITH {_mat('m', 'l_partkey', 'l_suppkey')} SELECT round(1 - sum(v) FILTER (i = j) / sum(v), 6) AS loss FROM m",
)
_add(
    "alignment_consistency",
    lambda s, d: E.alignment_consistency(_matrix(s, d, "l_partkey", "l_suppkey"), _matrix(s, d, "l_suppkey", "l_orderkey"), _matrix(s, d, "l_partkey", "l_orderkey")).select(rounded("loss", 8).alias("loss")),
    f"""WITH {_mat('ab', 'l_partkey', 'l_suppkey')}, {_mat('bc', 'l_suppkey', 'l_orderkey')}, {_mat('ac', 'l_partkey', 'l_orderkey')}, pr AS (SELECT ab.i, bc.j, sum(ab.v * bc.v) AS v FROM ab JOIN bc ON ab.j = bc.i GROUP BY 1, 2),
    p AS (SELECT i, j, v / sum(v) OVER (PARTITION BY i) AS p FROM pr), q AS (SELECT i, j, v / sum(v) OVER (PARTITION BY i) AS q FROM ac), x AS (SELECT i, coalesce(q, 0) + 1e-8 AS a, coalesce(p, 0) + 1e-8 AS b FROM p FULL JOIN q USING (i, j)),
    k AS (SELECT i, sum(a * ln(a / b) + b * ln(b / a)) AS k FROM x GROUP BY 1) SELECT round(avg(k) / 2, 8) AS loss FROM k""",
)
_add(
    "assembly_navigation",
    lambda s, d: E.assembly_paths(D.table(s, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_discount") * 20 - 1).alias("score"))).select("src", rounded("confidence").alias("confidence")),
    "SELECT l_suppkey AS src, round(avg(abs(l_discount * 20 - 1) / (1 + exp(-(l_discount * 20 - 1)))), 6) AS confidence FROM lineitem GROUP BY 1",
)
_add(
    "fragment_tiles",
    lambda s, d: E.tile_counts(D.table(s, d, "lineitem").select(F.col("l_suppkey").alias("cell"), F.col("l_returnflag").alias("group"), F.col("l_partkey").alias("start")), 100, 3, 10),
    """WITH f AS (SELECT l_suppkey AS cell, l_returnflag AS g, l_partkey AS s FROM lineitem), k AS (SELECT g FROM f GROUP BY 1 HAVING count(DISTINCT cell) >= 3), t AS (SELECT cell, CAST(floor(s / 100) AS BIGINT) AS tile, count(*) AS n FROM f WHERE g IN (SELECT g FROM k) GROUP BY 1, 2),
    b AS (SELECT tile FROM t GROUP BY 1 ORDER BY count(*) DESC, tile LIMIT 10) SELECT cell, tile, n FROM t WHERE tile IN (SELECT tile FROM b)""",
)
_u = lambda seed, *k: "((CAST('0x' || substr(md5('" + str(seed) + "|' || " + " || '|' || ".join(k) + "), 1, 12) AS BIGINT) + 0.5) / 281474976710656)"
_add(
    "gumbel_softmax",
    lambda s, d: E.gumbel_softmax(D.counts(s, d).withColumn("l", F.col("value") / 100), "cell_id", "gene_id", "l").select("cell_id", "gene_id", rounded("p").alias("p")),
    f"WITH {D.COUNTS}, z AS (SELECT cell_id, gene_id, value / 100 - ln(-ln({_u(9, 'cell_id', 'gene_id')})) AS z FROM counts), e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY cell_id)) AS e FROM z) SELECT cell_id, gene_id, round(e / sum(e) OVER (PARTITION BY cell_id), 6) AS p FROM e",
)
_add(
    "masked_gene_mask",
    lambda s, d: E.random_mask(D.counts(s, d), 0.15, 4, "cell_id", "gene_id").select("cell_id", "gene_id", "masked"),
    f"WITH {D.COUNTS} SELECT cell_id, gene_id, {_u(4, 'cell_id', 'gene_id')} < 0.15 AS masked FROM counts",
)
_add(
    "reparameterize_kl",
    lambda s, d: E.reparameterize(D.points(s, d).select("id", F.col("vec")[0].alias("m"), F.col("vec")[1].alias("lv")), "id", "m", "lv").select("id", rounded("z", 5).alias("z"), rounded("kl").alias("kl")),
    f"WITH {D.POINTS} SELECT id, round(vec[1] + exp(vec[2] / 2) * sqrt(-2 * ln({_u(1, 'id')})) * cos(2 * pi() * {_u(7920, 'id')}), 5) + 0.0 AS z, round(-0.5 * (1 + vec[2] - pow(vec[1], 2) - exp(vec[2])), 6) + 0.0 AS kl FROM points",
)
_add("count_simulation", lambda s, d: E.simulate_counts(D.obs(s, d), 40).groupBy("gene_id").agg(F.count("*").alias("n"), rounded(F.avg("value"), 4).alias("mean")))


def contacts(spark, sf_dir):
    p = D.points(spark, sf_dir)
    other = p.select((F.col("id") - 3).alias("id"), F.col("vec").alias("vec2"))
    return p.join(other, "id").select("id", rounded(E.contact_strength(dot("vec", "vec2"))).alias("contact"))


_add("hic_contacts", contacts, f"WITH {D.POINTS} SELECT a.id, round(ln(1 + exp(list_dot_product(a.vec, b.vec))), 6) AS contact FROM points a JOIN points b ON b.id = a.id + 3")
_add(
    "marker_table",
    lambda s, d: E.marker_table(D.table(s, d, "customer").withColumn("donor", F.concat(F.lit("d"), (F.col("c_custkey") % 7).cast("string"))), "c_mktsegment", "donor", ["c_custkey", "c_acctbal"], ["BUILDING"]),
    "SELECT c_custkey, c_acctbal, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS label_code, dense_rank() OVER (ORDER BY 'd' || CAST(c_custkey % 7 AS VARCHAR)) - 1 AS donor_code FROM customer WHERE c_mktsegment <> 'BUILDING'",
)
_add("gene_weight_sparsity", lambda s, d: D.points(s, d).agg(rounded(F.avg(F.abs(F.col("vec")[0]))).alias("loss")), f"WITH {D.POINTS} SELECT round(avg(abs(vec[1])), 6) AS loss FROM points")
