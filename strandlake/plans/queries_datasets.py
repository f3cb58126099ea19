"""Queries over datasets on the star schema, generators, registries and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.numeric import rounded
from strandlake.operators import neural as N
from strandlake.plans import derive as D
from strandlake.plans import registries as G
from strandlake.plans.queries_io import _fresh
from strandlake.plans.sql_twins import uniform
from strandlake.sources import datasets as T
from strandlake.sources import readers as R

QUERIES, SQL = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _star(spark, sf_dir, **more: DataFrame) -> str:
    path = _fresh(spark, "dataset")
    R.write_star(path, counts=D.counts(spark, sf_dir), obs=D.obs(spark, sf_dir), **more)
    return path


_SUB = "sub AS (SELECT * FROM obs QUALIFY row_number() OVER (ORDER BY md5('42|' || cell_id), cell_id) <= 60)"
_CODE = lambda c, n: f"dense_rank() OVER (ORDER BY {c}) - 1 AS {n}"


def benchmark(spark, sf_dir):
    t = T.load_benchmark(spark, _star(spark, sf_dir), 60)
    return t["obs"].join(t["counts"].groupBy("cell_id").agg(F.sum("value").alias("total")), "cell_id", "left").select("cell_id", "cell_type", "total")


_add("benchmark_subsample", benchmark, f"WITH {D.OBS}, {D.COUNTS}, {_SUB}, t AS (SELECT cell_id, sum(value) AS total FROM counts GROUP BY 1) SELECT cell_id, cell_type, total FROM sub LEFT JOIN t USING (cell_id)")


def immune(spark, sf_dir):
    """A dataset that brings its embedding: the codes and the stored vectors."""
    vec = D.obs(spark, sf_dir).select("cell_id", F.lit("X_pca").alias("key"), F.array(F.col("cell_id") / 2, F.col("batch") + 0.5).alias("vec"))
    t = T.immune_human(spark, _star(spark, sf_dir, obsm=vec), 60)
    return t["obs"].join(t["embedding"], "cell_id").select("cell_id", "batch_code", "label_code", F.col("vec")[0].alias("v0"), F.col("vec")[1].alias("v1"))


_add("immune_source", immune, f"WITH {D.OBS}, {_SUB} SELECT cell_id, {_CODE('batch', 'batch_code')}, {_CODE('cell_type', 'label_code')}, cell_id / 2 AS v0, batch + 0.5 AS v1 FROM sub")


def immune_embedding(spark, sf_dir):
    """A dataset without one: squared lengths of the complete projection are those of the centred profiles."""
    e = T.immune_human(spark, _star(spark, sf_dir))["embedding"]
    return e.select("cell_id", rounded(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v), 3).alias("length"))


_add(
    "immune_embedding",
    immune_embedding,
    f"""WITH {D.COUNTS}, lib AS (SELECT cell_id, sum(value) AS lib FROM counts GROUP BY 1), x AS (SELECT cell_id, gene_id, ln(value * (10000 / greatest(lib, 1)) + 1) AS v FROM counts JOIN lib USING (cell_id)),
    m AS (SELECT gene_id, sum(v) / (SELECT count(*) FROM lib) AS m FROM x GROUP BY 1) SELECT cell_id, round(sum(pow(coalesce(v, 0) - m, 2)), 3) AS length FROM lib CROSS JOIN m LEFT JOIN x USING (cell_id, gene_id) GROUP BY 1""",
)


def pancreas(spark, sf_dir):
    path, c = _fresh(spark, "pancreas"), D.counts(spark, sf_dir)
    layers = c.withColumn("layer", F.lit("spliced")).unionByName(c.filter("value > 30").withColumns({"layer": F.lit("unspliced"), "value": F.col("value") / 3}))
    R.write_star(path, layers=layers, obs=D.obs(spark, sf_dir))
    t = T.pancreas(spark, path, 60)
    return t["layers"].join(t["obs"].select("cell_id", "cluster"), "cell_id").join(t["embedding"], "cell_id").select("cell_id", "gene_id", "spliced", rounded("unspliced").alias("unspliced"), "cluster", F.size("vec").cast("long").alias("width"))


_add(
    "pancreas_source",
    pancreas,
    f"WITH {D.OBS}, {D.COUNTS}, {_SUB}, c AS (SELECT cell_id, {_CODE('cell_type', 'cluster')} FROM sub) SELECT cell_id, gene_id, CAST(value AS DOUBLE) AS spliced, round(CASE WHEN value > 30 THEN value / 3 ELSE 0 END, 6) AS unspliced, cluster, CAST(50 AS BIGINT) AS width FROM counts JOIN c USING (cell_id)",
)


def seqfish(spark, sf_dir):
    path = _fresh(spark, "seqfish")
    obs = D.obs(spark, sf_dir).withColumns({"x": F.when(F.col("cell_id") % 9 != 0, F.col("cell_id") % 12 / 2), "y": F.col("cell_id") / 12})
    R.write_star(path, counts=D.counts(spark, sf_dir), obs=obs)
    t = T.seqfish(spark, path)
    return t["obs"].join(t["counts"].groupBy("cell_id").agg(F.count("*").alias("genes")), "cell_id", "left").select("cell_id", "x", rounded("y").alias("y"), "label_code", "genes")


_add("seqfish_source", seqfish, f"WITH {D.OBS}, {D.COUNTS}, p AS (SELECT * FROM obs WHERE cell_id % 9 <> 0), g AS (SELECT cell_id, count(*) AS genes FROM counts GROUP BY 1) SELECT cell_id, cell_id % 12 / 2 AS x, round(cell_id / 12, 6) AS y, {_CODE('cell_type', 'label_code')}, genes FROM p LEFT JOIN g USING (cell_id)")


def metadata(spark, sf_dir):
    cache, path = T.metadata_cache(spark), _star(spark, sf_dir)
    names = cache.categories(path, "cell_type")
    out = cache.get(path).groupBy("batch").agg(F.count("*").alias("n"), F.countDistinct("perturbation").alias("kinds")).withColumn("cell_types", F.lit(len(names)).cast("long"))
    return out


_add("metadata_cache", metadata, f"WITH {D.OBS} SELECT batch, count(*) AS n, count(DISTINCT perturbation) AS kinds, (SELECT count(DISTINCT cell_type) FROM obs) AS cell_types FROM obs GROUP BY 1")

# Generators
_letter = lambda seed, *ids: f"substr('ACGT', CAST(floor({uniform(seed, *ids)} * 4) AS INT) + 1, 1)"
_shift = lambda base, seed, *ids: f"substr('ACGT', (instr('ACGT', {base}) + CAST(floor({uniform(seed, *ids)} * 3) AS INT)) % 4 + 1, 1)"
_READS = f"""s0 AS (SELECT sample, position, {_letter(42, "sample", "position")} AS ref FROM (SELECT unnest(range(6)) AS sample), (SELECT unnest(range(80)) AS position)),
  s1 AS (SELECT *, CASE WHEN {uniform(43, "sample", "position")} < 0.1 THEN {_shift("ref", 44, "sample", "position")} END AS alt FROM s0),
  sites AS (SELECT *, CASE WHEN alt IS NULL THEN 0 WHEN {uniform(45, "sample", "position")} < 0.4 THEN 1 ELSE 2 END AS genotype FROM s1),
  st AS (SELECT sample, read, floor({uniform(46, "sample", "read")} * 61) AS start FROM (SELECT unnest(range(6)) AS sample), (SELECT unnest(range(30)) AS read)),
  bs AS (SELECT st.sample, read, s.position, ref, alt, genotype FROM st JOIN sites s ON s.sample = st.sample AND s.position >= start AND s.position < start + 20),
  tr AS (SELECT *, CASE WHEN genotype = 2 OR (genotype = 1 AND {uniform(47, "sample", "read", "position")} < 0.5) THEN alt ELSE ref END AS t, {uniform(48, "sample", "read", "position")} < 0.05 AS wrong FROM bs),
  reads AS (SELECT sample, read, position, CASE WHEN wrong THEN {_shift("t", 49, "sample", "read", "position")} ELSE t END AS base, CASE WHEN wrong THEN 10.0 ELSE 30.0 END + floor({uniform(50, "sample", "read", "position")} * 10) AS quality FROM tr)"""
_made = lambda s: T.training_reads(s, 6, 30, 20, 80, 0.1, 0.4, 0.05)
_add("training_reads", lambda s, d: _made(s)["reads"], f"WITH {_READS} SELECT sample, read, position, base, CAST(quality AS DOUBLE) AS quality FROM reads")
_add("training_variants", lambda s, d: _made(s)["variants"].withColumn("genotype", F.col("genotype").cast("long")), f"WITH {_READS} SELECT sample, position, alt, CAST(genotype AS BIGINT) AS genotype FROM sites WHERE alt IS NOT NULL")
_add(
    "motif_sequences",
    lambda s, d: T.motif_sequences(s, 40, 30),
    f"""WITH r AS (SELECT i AS sequence_id, i % 2 AS label, ['TATAAA', 'GCGCGC'][i % 2 + 1] AS m FROM (SELECT unnest(range(80)) AS i)), l AS (SELECT sequence_id, string_agg({_letter(42, "sequence_id", "k")}, '' ORDER BY k) AS t FROM (SELECT sequence_id, unnest(range(30)) AS k FROM r) GROUP BY 1),
    p AS (SELECT r.*, t, CAST(floor({uniform(43, "sequence_id")} * 25) AS INT) AS p FROM r JOIN l USING (sequence_id)) SELECT sequence_id, label, substr(t, 1, p) || m || substr(t, p + 7) AS sequence FROM p""",
)


def contextual(spark, sf_dir):
    t = T.contextual_epigenomics(spark, 4, 24)
    good = T.contextual_violations(t["positions"], t["contacts"], 4, 2)
    broken = T.contextual_violations(t["positions"].withColumn("target", F.col("target") + F.col("pos") % 2), t["contacts"].withColumn("v", F.col("v") + (F.col("i") < 2).cast("int")), 4, 2)
    return good.withColumn("data", F.lit("made")).unionByName(broken.withColumn("data", F.lit("broken"))).select("data", "rule", "n")


_add(
    "contextual_contract",
    contextual,
    f"""WITH p AS (SELECT e, p, least(floor(({" + ".join(uniform(43, "e", "p", str(k)) for k in range(4))}) / 4 * 2), 1) AS t FROM (SELECT unnest(range(4)) AS e), (SELECT unnest(range(24)) AS p))
    SELECT 'broken' AS data, 'target class' AS rule, count(*) AS n FROM p WHERE t + p % 2 > 1 UNION ALL SELECT 'broken', 'symmetric contacts', 4 * 2 * 22 * 2""",
)


def contextual_targets(spark, sf_dir):
    p = T.contextual_epigenomics(spark, 4, 24)["positions"]
    return p.select("example", "pos", "base", "target", rounded(F.col("tf")[3]).alias("tf3"))


_add(
    "contextual_dataset",
    contextual_targets,
    f"""SELECT e AS example, p AS pos, {_letter(42, "e", "p")} AS base, CAST(least(floor(({" + ".join(uniform(43, "e", "p", str(k)) for k in range(4))}) / 4 * 2), 1) AS BIGINT) AS target, round({uniform(43, "e", "p", "3")}, 6) AS tf3 FROM (SELECT unnest(range(4)) AS e), (SELECT unnest(range(24)) AS p)""",
)


# Registries and reports
def registered(spark, sf_dir):
    """Adapters by name, and what each gives for the embeddings."""
    p = D.points(spark, sf_dir).select("id", "vec")
    one = G.ADAPTERS.create("precomputed_sequence", p).embed(p.select("id", F.col("id").alias("position")), "position")
    two = G.ADAPTERS.create("frozen_encoder", lambda x: N.relu(x[:, :3])).embed(p)
    rows = [(n, G.ADAPTERS.get(n).__name__) for n in sorted(G.ADAPTERS.held)]
    named = spark.createDataFrame(rows, "name string, factory string")
    both = one.agg(F.count("*").alias("n"), rounded(F.sum(F.col("vec")[0]), 3).alias("total")).withColumn("factory", F.lit("PrecomputedAdapter"))
    both = both.unionByName(two.agg(F.count("*").alias("n"), rounded(F.sum(F.col("vec")[0]), 3).alias("total")).withColumn("factory", F.lit("FrozenEncoder")))
    return named.join(both, "factory").select("name", "factory", "n", "total")


_add(
    "foundation_adapters",
    registered,
    f"""WITH {D.POINTS}, a AS (SELECT count(*) AS n, round(sum(vec[1]), 3) + 0.0 AS p, round(sum(greatest(vec[1], 0)), 3) + 0.0 AS f FROM points)
    SELECT v.name, v.factory, n, CASE WHEN v.factory = 'FrozenEncoder' THEN f ELSE p END AS total FROM (VALUES ('frozen_encoder', 'FrozenEncoder'), ('precomputed_multiomics', 'PrecomputedAdapter'), ('precomputed_sequence', 'PrecomputedAdapter'), ('precomputed_single_cell', 'PrecomputedAdapter')) v(name, factory), a""",
)


def provenance(spark, sf_dir):
    spec = G.ArtifactSpec("encoder", "base", "cls")
    rows = [(k, v) for k, v in G.benchmark_metadata(spec, "embeddings", "probe").items()] + [("key", G.comparison_key(["dataset", "task"], {"task": "probe", "dataset": "embeddings"}))]
    rows += [(k, str(G.is_experimental(k)).lower()) for k in ("sequence_generation", "unknown")]
    return spark.createDataFrame(rows, "name string, value string")


_add(
    "foundation_metadata",
    provenance,
    "SELECT * FROM (VALUES ('model_family', 'encoder'), ('checkpoint', 'base'), ('pooling', 'cls'), ('frozen', 'true'), ('dataset', 'embeddings'), ('task', 'probe'), ('key', 'dataset=embeddings|task=probe'), ('sequence_generation', 'true'), ('unknown', 'false')) v(name, value)",
)


def _runs(spark, sf_dir):
    li = D.table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("task"), F.concat(F.lit("m"), (F.col("l_suppkey") % 4).cast("string")).alias("model")).agg(F.avg("l_discount").alias("value")).withColumn("metric", F.lit("score"))


_REPORT = """r AS (SELECT l_returnflag AS task, 'm' || (l_suppkey % 4) AS model, avg(l_discount) AS value FROM lineitem GROUP BY 1, 2), b AS (SELECT task, max(value) AS baseline FROM r WHERE model IN ('m0', 'm1') GROUP BY 1),
  p AS (SELECT task, 'score' AS metric, model, value, baseline, value - baseline AS difference, row_number() OVER (PARTITION BY task ORDER BY value DESC, model) AS rank FROM r LEFT JOIN b USING (task)),
  s AS (SELECT model, count(DISTINCT task) AS tasks, CAST(sum(CAST(rank = 1 AS BIGINT)) AS BIGINT) AS wins, avg(difference) AS mean_difference, CAST(sum(CAST(difference < -0.05 * abs(baseline) AS BIGINT)) AS BIGINT) AS regressions FROM p GROUP BY 1)"""
_add("foundation_task_report", lambda s, d: G.task_report(_runs(s, d), ["m0", "m1"]).select("task", "metric", "model", *[rounded(c, 8).alias(c) for c in ("value", "baseline", "difference")], "rank"),
    f"WITH {_REPORT} SELECT task, metric, model, round(value, 8) + 0.0 AS value, round(baseline, 8) + 0.0 AS baseline, round(difference, 8) + 0.0 AS difference, rank FROM p")
_add("foundation_promotion_report", lambda s, d: G.promotion_report(G.suite_report(G.task_report(_runs(s, d), ["m0", "m1"]))).withColumn("mean_difference", rounded("mean_difference", 8)),
    f"WITH {_REPORT} SELECT model, tasks, wins, round(mean_difference, 8) + 0.0 AS mean_difference, regressions, wins >= 1 AND regressions = 0 AND mean_difference >= 0 AS promoted FROM s")
