"""Queries over integration metrics, evaluation and reductions, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.numeric import rounded
from strandlake.operators import cells as C
from strandlake.operators import graph as G
from strandlake.operators import integration as I
from strandlake.operators import reduction as R
from strandlake.plans import derive as D
from strandlake.session import cut_lineage

QUERIES, SQL = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


_PAIRS = f"{D.POINTS}, d AS (SELECT a.id AS i, b.id AS j, round(sqrt(list_sum(list_transform(range(1, 65), lambda k: pow(a.vec[k] - b.vec[k], 2))) + 1e-16), 6) AS d FROM points a, points b WHERE a.id <> b.id)"
_SIL = """{p}, m AS (SELECT i, {g} AS g, avg(d) AS m FROM d JOIN points p ON p.id = j GROUP BY 1, 2),
  ab AS (SELECT i, o.own, max(m) FILTER (g = o.own) AS a, min(m) FILTER (g <> o.own) AS b FROM m JOIN (SELECT id, {own} AS own FROM points) o ON o.id = i GROUP BY 1, 2),
  sil AS (SELECT i, own, coalesce((b - a) / greatest(a, b), 0) AS s FROM ab)"""
_KNN = f"{_PAIRS}, knn AS (SELECT i, j FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 10)"
_near = lambda s, d: cut_lineage(G.knn(D.points(s, d).select("id", "vec"), 10))
_codes = lambda s, d: D.points(s, d).select("id", "label", "batch")

_add(
    "silhouettes",
    lambda s, d: I.silhouettes(D.points(s, d), "label").select("id", rounded("s", 5).alias("s")),
    f"WITH {_SIL.format(p=_PAIRS, g='p.label', own='label')} SELECT i AS id, round(s, 5) + 0.0 AS s FROM sil",
)
_add(
    "silhouette_label",
    lambda s, d: I.silhouette_label(D.points(s, d)).select(rounded("silhouette_label", 5).alias("silhouette_label")),
    f"WITH {_SIL.format(p=_PAIRS, g='p.label', own='label')} SELECT round(avg((s + 1) / 2), 5) AS silhouette_label FROM sil",
)
_add(
    "silhouette_batch",
    lambda s, d: I.silhouette_batch(D.points(s, d)).select(rounded("silhouette_batch", 5).alias("silhouette_batch")),
    f"""WITH {_PAIRS}, m AS (SELECT i, x.label, x.batch AS own, y.batch AS g, avg(d) AS m FROM d JOIN points x ON x.id = i JOIN points y ON y.id = j AND y.label = x.label GROUP BY ALL),
    ab AS (SELECT i, label, max(m) FILTER (g = own) AS a, min(m) FILTER (g <> own) AS b FROM m GROUP BY 1, 2)
    SELECT round(avg(v), 5) AS silhouette_batch FROM (SELECT label, avg(1 - abs(coalesce((b - a) / greatest(a, b), 0))) AS v FROM ab WHERE b IS NOT NULL GROUP BY 1)""",
)
_LISI = "{g}_n AS (SELECT i, {g} AS c, count(*) AS n FROM knn JOIN points ON id = j GROUP BY 1, 2), {g}_l AS (SELECT i, pow(sum(n), 2) / sum(n * n) AS l FROM {g}_n GROUP BY 1)"
_add(
    "lisi_scores",
    lambda s, d: I.lisi_scores(_near(s, d), _codes(s, d)).select(rounded("ilisi", 5).alias("ilisi"), rounded("clisi", 5).alias("clisi")),
    f"""WITH {_KNN}, {_LISI.format(g='batch')}, {_LISI.format(g='label')} SELECT round(((SELECT median(l) FROM batch_l) - 1) / greatest((SELECT count(DISTINCT batch) FROM points) - 1, 1), 5) AS ilisi,
    round(((SELECT count(DISTINCT label) FROM points) - (SELECT median(l) FROM label_l)) / greatest((SELECT count(DISTINCT label) FROM points) - 1, 1), 5) AS clisi""",
)
_add(
    "graph_connectivity",
    lambda s, d: I.graph_connectivity(_near(s, d), _codes(s, d)).select(rounded("graph_connectivity", 5).alias("graph_connectivity")),
    f"""WITH RECURSIVE {_KNN}, e AS (SELECT i, j FROM knn JOIN points x ON x.id = i JOIN points y ON y.id = j WHERE x.label = y.label), u AS (SELECT i, j FROM e UNION SELECT j, i FROM e),
    r AS (SELECT id AS i, id AS j FROM points UNION SELECT r.i, u.j FROM r JOIN u ON u.i = r.j), c AS (SELECT i, min(j) AS c FROM r GROUP BY 1),
    n AS (SELECT label, c, count(*) AS n FROM c JOIN points ON id = i GROUP BY 1, 2) SELECT round(avg(v), 5) AS graph_connectivity FROM (SELECT label, max(n) / sum(n) AS v FROM n GROUP BY 1)""",
)


def components(spark, sf_dir):
    """Parts and suppliers that line items link, as one undirected graph of every third line."""
    li = D.table(spark, sf_dir, "lineitem").filter("l_linenumber = 7")
    return G.components(li.select(F.col("l_partkey").alias("i"), (F.col("l_orderkey") + 1_000_000_000).alias("j"))).filter("node < 1000000000").withColumnRenamed("label", "component")


_add(
    "connected_components",
    components,
    """WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS i, l_orderkey AS o FROM lineitem WHERE l_linenumber = 7), u AS (SELECT DISTINCT a.i, b.i AS j FROM e a JOIN e b USING (o)),
    r AS (SELECT DISTINCT i, i AS j FROM e UNION SELECT r.i, u.j FROM r JOIN u ON u.i = r.j) SELECT i AS node, min(j) AS component FROM r GROUP BY 1""",
)
_SCORES = """c AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {t} GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS rb, sum(n) OVER () AS t FROM c),
  z AS (SELECT sum(n / t * ln(n * t / (ra * rb))) AS mi, -sum(n / t * ln(ra / t)) AS ha, -sum(n / t * ln(rb / t)) AS hb, sum(n * (n - 1) / 2) AS bo, max(t * (t - 1) / 2) AS al, sum(n * (ra - 1) / 2) AS ia, sum(n * (rb - 1) / 2) AS ib FROM r)"""
_add(
    "clustering_agreement",
    lambda s, d: I.contingency_scores(D.obs(s, d), "cell_type", "batch").select(rounded("nmi").alias("nmi"), rounded("ari").alias("ari")),
    f"WITH {D.OBS}, {_SCORES.format(a='cell_type', b='batch', t='obs')} SELECT round(mi / ((ha + hb) / 2), 6) + 0.0 AS nmi, round((bo - ia * ib / al) / ((ia + ib) / 2 - ia * ib / al), 6) + 0.0 AS ari FROM z",
)
_add(
    "kbet",
    lambda s, d: I.kbet(_near(s, d), _codes(s, d)).select(rounded("kbet", 5).alias("kbet")),
    f"""WITH {_KNN}, e AS (SELECT i, x.label, y.batch FROM knn JOIN points x ON x.id = i JOIN points y ON y.id = j WHERE x.label = y.label),
    s AS (SELECT label, batch, count(*) / sum(count(*)) OVER (PARTITION BY label) AS share FROM points GROUP BY 1, 2), k AS (SELECT i, label, count(*) AS k FROM e GROUP BY 1, 2), o AS (SELECT i, batch, count(*) AS o FROM e GROUP BY 1, 2),
    x AS (SELECT k.i, k.label, sum(pow(coalesce(o, 0) - k * share, 2) / (k * share)) AS x FROM k JOIN s USING (label) LEFT JOIN o ON o.i = k.i AND o.batch = s.batch GROUP BY 1, 2)
    SELECT round(avg(v), 5) AS kbet FROM (SELECT label, avg(CAST(x <= 3.841458820694124 AS DOUBLE)) AS v FROM x GROUP BY 1)""",
)
_add(
    "isolated_labels",
    lambda s, d: I.isolated_labels(D.points(s, d).withColumn("batch", F.when(F.col("label") == 3, 0).otherwise(F.col("batch")))).select(rounded("isolated_labels", 5).alias("isolated_labels")),
    f"""WITH {_SIL.format(p=_PAIRS, g='CAST(p.label = 3 AS BIGINT)', own='CAST(label = 3 AS BIGINT)')} SELECT round(avg((s + 1) / 2), 5) AS isolated_labels FROM sil WHERE own = 1""",
)


def suite(spark, sf_dir):
    p = D.points(spark, sf_dir)
    hard = C.cluster_assignments(p, R.lloyd(p, C.cluster_means(p), 3)).filter("hard").select("id", "cluster")
    out = I.integration_suite(p, cut_lineage(hard), 10)
    return out.select(*[rounded(c, 5).alias(c) for c in out.columns])


_add("integration_suite", suite)
_add(
    "calinski_harabasz",
    lambda s, d: I.calinski_harabasz(D.points(s, d), "label").select(rounded("calinski_harabasz", 4).alias("calinski_harabasz")),
    f"""WITH {D.POINTS}, l AS (SELECT id, label, unnest(range(1, 65)) AS k, vec FROM points), g AS (SELECT label, k, avg(vec[k]) AS m, var_pop(vec[k]) AS s2, count(*) AS n FROM l GROUP BY 1, 2), w AS (SELECT k, avg(vec[k]) AS mean FROM l GROUP BY 1)
    SELECT round(sum(n * pow(m - mean, 2)) / (count(DISTINCT label) - 1) / (sum(n * s2) / ((SELECT count(*) FROM points) - count(DISTINCT label))), 4) AS calinski_harabasz FROM g JOIN w USING (k)""",
)
_add(
    "batch_divergence",
    lambda s, d: I.batch_divergence(D.points(s, d)).select(rounded("kl", 7).alias("kl")),
    f"""WITH {D.POINTS}, l AS (SELECT batch, unnest(range(1, 65)) AS k, vec FROM points), m AS (SELECT batch, k, exp(avg(vec[k])) AS e FROM l GROUP BY 1, 2), p AS (SELECT batch, k, e / sum(e) OVER (PARTITION BY batch) AS p FROM m)
    SELECT round(sum(a.p * ln(a.p / b.p)), 7) + 0.0 AS kl FROM p a JOIN p b ON a.k = b.k AND a.batch = 0 AND b.batch = 1""",
)
_Q3 = lambda s, d: D.table(s, d, "lineitem").select((F.col("l_partkey") % 3).alias("called"), (F.col("l_suppkey") % 3).alias("truth"))
_add(
    "q3_metrics",
    lambda s, d: I.q3_metrics(_Q3(s, d), "called", "truth").select(*[rounded(c).alias(c) for c in ("q3_overall", "q3_helix", "q3_strand", "q3_coil")]),
    "WITH r AS (SELECT l_partkey % 3 AS c, l_suppkey % 3 AS t FROM lineitem) SELECT round(avg(CAST(c = t AS DOUBLE)), 6) AS q3_overall, "
    + ", ".join(f"round(coalesce(avg(CAST(c = t AS DOUBLE)) FILTER (t = {k}), 0), 6) AS q3_{n}" for k, n in ((1, "helix"), (2, "strand"), (0, "coil")))
    + " FROM r",
)
_add(
    "chromatin_state_accuracy",
    lambda s, d: I.chromatin_state_accuracy(D.points(s, d).select(F.slice("vec", 1, 10).alias("logits"), "label"), "logits", "label").select(rounded("accuracy").alias("accuracy")),
    f"WITH {D.POINTS}, x AS (SELECT vec[1:10] AS l, label FROM points) SELECT round(avg(CAST(list_position(l, list_max(l)) - 1 = label AS DOUBLE)), 6) AS accuracy FROM x",
)


def consistency(spark, sf_dir):
    """Contacts between consecutive points and their embeddings: mean squared distance of contact partners, as a score."""
    p = D.points(spark, sf_dir).select("id", F.slice("vec", 1, 8).alias("vec"))
    from strandlake.functions.numeric import squared_distance

    pairs = p.join(p.select((F.col("id") - 1).alias("id"), F.col("vec").alias("w")), "id").select(squared_distance("vec", "w").alias("d"))
    return I.consistency_score(pairs.agg(F.avg("d").alias("loss"))).select(rounded("consistency").alias("consistency"))


_add(
    "chromatin_consistency",
    consistency,
    f"WITH {D.POINTS} SELECT round(1 / (1 + avg(list_sum(list_transform(range(1, 9), lambda k: pow(a.vec[k] - b.vec[k], 2))))), 6) AS consistency FROM points a JOIN points b ON b.id = a.id + 1",
)


# Answers and the problem runner
def _solvers(spark: SparkSession, sf_dir: str) -> dict:
    p = D.points(spark, sf_dir)
    lfc = D.counts(spark, sf_dir).groupBy("gene_id").agg((F.sum("value") - 1000).alias("lfc"))

    def broken():
        raise ValueError("no such operator")

    return {
        "clustering": lambda: I.grader_answer(p, "clustering"),
        "cell_annotation": lambda: I.grader_answer(p, "cell_annotation"),
        "spatial_analysis": lambda: I.grader_answer(p, "spatial_analysis"),
        "qc_filtering": lambda: I.grader_answer(p.select((F.col("id") % 3 / 2).alias("weight")), "qc_filtering"),
        "differential_expression": lambda: I.grader_answer(lfc, "differential_expression"),
        "normalization": lambda: I.grader_answer(D.counts(spark, sf_dir), "normalization"),
        "trajectory": lambda: I.grader_answer(p.select((F.col("id") / 7).alias("pseudotime")), "trajectory"),
        "batch_correction": broken,
    }


_TASKS = ["clustering", "cell_annotation", "spatial_analysis", "qc_filtering", "differential_expression", "normalization", "trajectory", "batch_correction"]


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, out = _solvers(spark, sf_dir), None
    for task in _TASKS[:-1]:
        one = made[task]().withColumn("task", F.lit(task))
        out = one if out is None else out.unionByName(one)
    return out.select("task", "answer")


_ANSWERS = f"""{D.POINTS}, {D.COUNTS}, l AS (SELECT label, count(*) AS n FROM points GROUP BY 1), g AS (SELECT gene_id, abs(sum(value) - 1000) AS a FROM counts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)
  , answers AS (SELECT 'cell_annotation' AS task, (SELECT CAST(label AS VARCHAR) FROM l ORDER BY n DESC, CAST(label AS VARCHAR) LIMIT 1) AS answer
  UNION ALL SELECT 'spatial_analysis', (SELECT string_agg(CAST(label AS VARCHAR), ',' ORDER BY CAST(label AS VARCHAR)) FROM l)
  UNION ALL SELECT 'qc_filtering', (SELECT CAST(count(*) FILTER (id % 3 = 2) AS VARCHAR) FROM points)
  UNION ALL SELECT 'differential_expression', (SELECT string_agg(gene_id, ',' ORDER BY a DESC, gene_id) FROM g))"""
_add("grader_answers", lambda s, d: answers(s, d).filter(F.col("task").isin("cell_annotation", "spatial_analysis", "qc_filtering", "differential_expression")), f"WITH {_ANSWERS} SELECT * FROM answers")


def benchmark_run(spark, sf_dir):
    """Problems from the benchmark table: item_id picks the task, the grader and the expected answer."""
    tasks = F.array(*[F.lit(t) for t in _TASKS])
    items = D.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("problem_id"), F.element_at(tasks, (F.col("item_id") % 8 + 1).cast("int")).alias("task_type"),
        F.when(F.col("item_id") % 5 == 0, "unknown").when(F.col("item_id") % 8 == 3, "numeric").otherwise("exact").alias("grader_type"),
        F.when(F.col("item_id") % 8 == 3, "160").when(F.col("item_id") % 2 == 0, "0,1,10,11,12,13,14,15,2,3,4,5,6,7,8,9").otherwise("0").alias("expected_answer"),
    )
    exact = lambda a, e: F.struct((a == e).alias("passed"), (a == e).cast("double").alias("score"))
    near = lambda a, e: F.struct((F.abs(a.cast("double") - e.cast("double")) <= 10).alias("passed"), (F.abs(a.cast("double") - e.cast("double")) <= 10).cast("double").alias("score"))
    return I.run_benchmark(items, _solvers(spark, sf_dir), {"exact": exact, "numeric": near})


_add("benchmark_run", lambda s, d: benchmark_run(s, d).filter(F.col("task_type").isin("cell_annotation", "spatial_analysis", "qc_filtering", "batch_correction")).select("problem_id", "task_type", "passed", "score", "error"),
    f"""WITH {_ANSWERS}, p AS (SELECT item_id AS problem_id, ['clustering', 'cell_annotation', 'spatial_analysis', 'qc_filtering', 'differential_expression', 'normalization', 'trajectory', 'batch_correction'][item_id % 8 + 1] AS task,
    CASE WHEN item_id % 5 = 0 THEN 'unknown' WHEN item_id % 8 = 3 THEN 'numeric' ELSE 'exact' END AS grader, CASE WHEN item_id % 8 = 3 THEN '160' WHEN item_id % 2 = 0 THEN '0,1,10,11,12,13,14,15,2,3,4,5,6,7,8,9' ELSE '0' END AS e FROM benchmark),
    j AS (SELECT p.*, answer, CASE WHEN task = 'batch_correction' THEN 'solve error: ValueError' WHEN grader = 'unknown' THEN 'grading error: unknown grader' END AS error FROM p LEFT JOIN answers USING (task) WHERE task IN ('cell_annotation', 'spatial_analysis', 'qc_filtering', 'batch_correction')),
    gr AS (SELECT *, CASE WHEN error IS NOT NULL THEN false WHEN grader = 'exact' THEN answer = e ELSE abs(CAST(answer AS DOUBLE) - CAST(e AS DOUBLE)) <= 10 END AS passed FROM j)
    SELECT problem_id, task AS task_type, passed, CAST(passed AS DOUBLE) AS score, error FROM gr""")  # fmt: skip
_add(
    "clustering_quality",
    lambda s, d: I.quality_metrics("clustering", D.points(s, d)).select(rounded("silhouette", 5).alias("silhouette"), rounded("calinski_harabasz", 4).alias("calinski_harabasz")),
    f"""WITH {_SIL.format(p=_PAIRS, g='p.label', own='label')}, l AS (SELECT id, label, unnest(range(1, 65)) AS k, vec FROM points), g AS (SELECT label, k, avg(vec[k]) AS m, var_pop(vec[k]) AS s2, count(*) AS n FROM l GROUP BY 1, 2), w AS (SELECT k, avg(vec[k]) AS mean FROM l GROUP BY 1)
    SELECT (SELECT round(avg(s), 5) + 0.0 FROM sil) AS silhouette, round(sum(n * pow(m - mean, 2)) / (count(DISTINCT label) - 1) / (sum(n * s2) / ((SELECT count(*) FROM points) - count(DISTINCT label))), 4) AS calinski_harabasz FROM g JOIN w USING (k)""",
)


# Reductions: subspaces and signs come from an eigen solver, so their SQL checks what does not depend on it
def pca_scores(spark, sf_dir):
    p = D.points(spark, sf_dir).select("id", "vec")
    train = p.filter("id % 4 <> 0")
    return R.fit_pca(train, 3).transform(p).select("id", *[rounded(F.col("scores")[k], 5).alias(f"pc{k}") for k in range(3)])


_add("pca_reduction", pca_scores)


def robust(spark, sf_dir):
    scores, _, values = R.robust_pca(D.points(spark, sf_dir).select("id", "vec"), 3)
    return scores.select("id", *[rounded(F.col("scores")[k], 5).alias(f"pc{k}") for k in range(3)])


_add("robust_pca", robust)


def total_variance(spark, sf_dir):
    """All variances of a complete decomposition add up to the features' own."""
    p = D.points(spark, sf_dir).select("id", "vec")
    _, values = R.matrix_free_pca(p, 64, rounds=3)
    return spark.createDataFrame([(round(float(values.sum()), 5),)], "total double")


_add("matrix_free_pca", total_variance, f"WITH {D.POINTS}, l AS (SELECT unnest(range(1, 65)) AS k, vec FROM points) SELECT round(sum(v), 5) AS total FROM (SELECT var_samp(vec[k]) AS v FROM l GROUP BY k)")


def tfidf_svd(spark, sf_dir):
    c = D.counts(spark, sf_dir)
    return R.fit_tfidf(c.filter("cell_id % 4 <> 0"), 2).transform(c).select("cell_id", *[rounded(F.col("scores")[k], 4).alias(f"s{k}") for k in range(2)])


_add("tfidf_svd", tfidf_svd)


def phate_of_labels(spark, sf_dir):
    p = D.points(spark, sf_dir)
    m = C.cluster_means(p).select(F.col("cluster").alias("id"), F.col("centre").alias("vec"))
    rows = sorted((r.i, r.j, r.d) for r in G.pairwise_distances(m).collect())
    n = round(len(rows) ** 0.5)
    y = R.phate(np.array([r[2] for r in rows]).reshape(n, n), 3, 4)
    return spark.createDataFrame([(i, round(float(a), 5), round(float(b), 5)) for i, (a, b) in enumerate(y)], "label long, x double, y double")


_add("phate_of_clusters", phate_of_labels)


def kmeans(spark, sf_dir):
    """One round of means from the labels' means: what SQL can write down without recursion."""
    p = D.points(spark, sf_dir)
    c = R.lloyd(p, C.cluster_means(p), 1)
    return c.select(F.col("cluster").cast("long").alias("cluster"), *[rounded(F.col("centre")[k], 5).alias(f"c{k}") for k in range(4)])


_add(
    "lloyd_round",
    kmeans,
    f"""WITH {D.POINTS}, l AS (SELECT id, label, unnest(range(64)) AS k, vec FROM points), cm AS (SELECT label AS cluster, k, avg(vec[k + 1]) AS c FROM l GROUP BY 1, 2), dd AS (SELECT id, cluster, sum(pow(vec[l.k + 1] - c, 2)) AS d FROM l JOIN cm ON l.k = cm.k GROUP BY 1, 2),
    a AS (SELECT id, cluster FROM dd QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cluster) = 1) SELECT cluster, """
    + ", ".join(f"round(avg(vec[{k + 1}]), 5) + 0.0 AS c{k}" for k in range(4))
    + " FROM a JOIN points USING (id) GROUP BY 1",
)


def harmony_rounds(spark, sf_dir):
    p = D.points(spark, sf_dir)
    return R.harmony(p, C.cluster_means(p), 3, sigma=5.0).select("id", *[rounded(F.col("vec")[k], 5).alias(f"v{k}") for k in range(4)])


_add("harmony_rounds", harmony_rounds)
