"""Queries over splitters, samplers, control matching, graders and metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.numeric import rounded
from strandlake.operators import grading as R
from strandlake.operators import splitting as S
from strandlake.plans import derive as D

QUERIES, SQL = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _cells(s, d):
    return D.obs(s, d)


def _h(seed, key):
    return f"md5('{seed}|' || {key})"


_RN = f"r AS (SELECT *, row_number() OVER (ORDER BY {_h(42, 'cell_id')}, cell_id) - 1 AS rn, count(*) OVER () AS n FROM obs)"
_SPLIT = "CASE WHEN rn < floor(n * 0.8) THEN 'train' WHEN rn < floor(n * 0.9) THEN 'valid' ELSE 'test' END AS split"
_add("random_split", lambda s, d: S.random_split(_cells(s, d), "cell_id").select("cell_id", "split"), f"WITH {D.OBS}, {_RN} SELECT cell_id, {_SPLIT} FROM r")
_add("k_fold_split", lambda s, d: S.k_fold(_cells(s, d), "cell_id", 7).select("cell_id", F.col("fold").cast("long").alias("fold")), f"WITH {D.OBS}, {_RN} SELECT cell_id, CAST(least(floor(rn / floor(n / 7)), 6) AS BIGINT) AS fold FROM r")
_add(
    "stratified_split",
    lambda s, d: S.stratified_split(_cells(s, d), "cell_id", "cell_type").select("cell_id", "split"),
    f"WITH {D.OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY {_h(42, 'cell_id')}, cell_id) - 1 AS rn, count(*) OVER (PARTITION BY cell_type) AS n FROM obs) SELECT cell_id, {_SPLIT} FROM r",
)
_add(
    "deterministic_split",
    lambda s, d: S.clamped_split(_cells(s, d), "cell_id").select("cell_id", "split"),
    f"WITH {D.OBS}, {_RN}, c AS (SELECT *, least(greatest(floor(n * 0.8), 1), n - 2) AS a FROM r) SELECT cell_id, CASE WHEN rn < a THEN 'train' WHEN rn < least(greatest(a + floor(n * 0.1), a + 1), n - 1) THEN 'valid' ELSE 'test' END AS split FROM c",
)
_add(
    "order_split",
    lambda s, d: S.order_split(D.table(s, d, "benchmark"), "item_id").select("item_id", "split"),
    "SELECT item_id, CASE WHEN item_id < floor(count(*) OVER () * 0.8) THEN 'train' WHEN item_id < floor(count(*) OVER () * 0.8) + floor(count(*) OVER () * 0.1) THEN 'valid' ELSE 'test' END AS split FROM benchmark",
)
_add(
    "group_split",
    lambda s, d: S.group_split(D.table(s, d, "part"), "p_brand").select("p_partkey", "split"),
    """WITH g AS (SELECT p_brand, count(*) AS g FROM part GROUP BY 1), b AS (SELECT p_brand, coalesce(sum(g) OVER (ORDER BY g DESC, p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(g) OVER () AS n FROM g)
    SELECT p_partkey, CASE WHEN b < 0.8 * n THEN 'train' WHEN b < 0.9 * n THEN 'valid' ELSE 'test' END AS split FROM part JOIN b USING (p_brand)""",
)
_add(
    "zero_shot_split",
    lambda s, d: S.zero_shot_split(_cells(s, d), "cell_id", "cell_type", ["BUILDING"]).select("cell_id", "split"),
    f"""WITH {D.OBS}, r AS (SELECT *, row_number() OVER (ORDER BY {_h(42, 'cell_id')}, cell_id) - 1 AS rn, count(*) OVER () AS n FROM obs WHERE cell_type <> 'BUILDING')
    SELECT cell_id, CASE WHEN rn < floor(n * (0.8 / (0.8 + 0.1))) THEN 'train' ELSE 'valid' END AS split FROM r UNION ALL SELECT cell_id, 'test' FROM obs WHERE cell_type = 'BUILDING'""",
)
_add(
    "few_shot_split",
    lambda s, d: S.few_shot_split(_cells(s, d), "cell_id", "perturbation", ["Brand#11"], "non-targeting").select("cell_id", "split"),
    f"""WITH {D.OBS}, r AS (SELECT *, row_number() OVER (ORDER BY {_h(42, 'cell_id')}, cell_id) - 1 AS rn, count(*) OVER () AS n FROM obs WHERE perturbation NOT IN ('Brand#11', 'non-targeting'))
    SELECT cell_id, CASE WHEN rn < greatest(1, floor(n * 0.1)) THEN 'valid' ELSE 'train' END AS split FROM r
    UNION ALL SELECT cell_id, CASE perturbation WHEN 'Brand#11' THEN 'test' ELSE 'train' END FROM obs WHERE perturbation IN ('Brand#11', 'non-targeting')""",
)


def _mapping(by_batch):
    return lambda s, d: S.control_mapping(_cells(s, d), 2, by_batch=by_batch).select("cell_id", F.col("slot").cast("long").alias("slot"), "control_id")


_POOL = "row_number() OVER (PARTITION BY {keys} ORDER BY " + _h(42, "cell_id") + ", cell_id) - 1 AS rn, count(*) OVER (PARTITION BY {keys}) AS size"
_MAP = f"""{D.OBS}, t AS (SELECT cell_id, cell_type, batch, slot, CAST('0x' || substr({_h(43, 'cell_id')}, 1, 8) AS BIGINT) AS st FROM obs, (VALUES (0), (1)) v(slot) WHERE perturbation <> 'non-targeting'),
    p1 AS (SELECT cell_id AS c, cell_type, {_POOL.format(keys='cell_type')} FROM obs WHERE perturbation = 'non-targeting'),
    p2 AS (SELECT cell_id AS c, cell_type, batch, {_POOL.format(keys='cell_type, batch')} FROM obs WHERE perturbation = 'non-targeting')"""
_add("random_control_mapping", _mapping(False), f"WITH {_MAP} SELECT t.cell_id, CAST(slot AS BIGINT) AS slot, coalesce(c, -1) AS control_id FROM t LEFT JOIN p1 ON p1.cell_type = t.cell_type AND (st + slot) % size = rn")
_add(
    "batch_control_mapping",
    _mapping(True),
    f"""WITH {_MAP} SELECT t.cell_id, CAST(slot AS BIGINT) AS slot, coalesce(p2.c, p1.c, -1) AS control_id FROM t LEFT JOIN p1 ON p1.cell_type = t.cell_type AND (st + slot) % p1.size = p1.rn
    LEFT JOIN p2 ON p2.cell_type = t.cell_type AND p2.batch = t.batch AND (st + slot) % p2.size = p2.rn""",
)
_add(
    "perturbation_batches",
    lambda s, d: S.perturbation_batches(_cells(s, d), "cell_id", "perturbation", most=100).select("cell_id", "sentence_id", F.col("batch").cast("long").alias("batch")),
    f"""WITH {D.OBS}, r AS (SELECT cell_id, perturbation, row_number() OVER (PARTITION BY perturbation ORDER BY {_h(42, 'cell_id')}, cell_id) - 1 AS rn FROM obs),
    q AS (SELECT cell_id, perturbation || ':' || CAST(floor(rn / 8) AS BIGINT) AS sentence_id FROM r WHERE rn < 100),
    b AS (SELECT sentence_id, CAST(floor((row_number() OVER (ORDER BY {_h(42, 'sentence_id')}, sentence_id) - 1) / 4) AS BIGINT) AS batch FROM (SELECT DISTINCT sentence_id FROM q))
    SELECT cell_id, sentence_id, batch FROM q JOIN b USING (sentence_id)""",
)
_add(
    "deterministic_subsample",
    lambda s, d: S.deterministic_sample(_cells(s, d), "cell_id", 100).select("cell_id"),
    f"WITH {D.OBS} SELECT cell_id FROM obs ORDER BY {_h(42, 'cell_id')}, cell_id LIMIT 100",
)
_add("sequential_batches", lambda s, d: S.sequential_batches(D.table(s, d, "events").select("event_id"), "event_id", 64).select("event_id", F.col("batch").cast("long").alias("batch")), "SELECT event_id, CAST(floor(event_id / 64) AS BIGINT) AS batch FROM events")
_add("label_codes", lambda s, d: S.label_codes(_cells(s, d), "cell_type").select("cell_id", "code"), f"WITH {D.OBS} SELECT cell_id, dense_rank() OVER (ORDER BY cell_type) - 1 AS code FROM obs")
_add(
    "one_hot_map",
    lambda s, d: S.one_hot_map(_cells(s, d), "cell_type").select(F.col("cell_type"), F.array_join(F.transform("vec", lambda v: v.cast("int").cast("string")), "").alias("bits")),
    f"WITH {D.OBS}, c AS (SELECT DISTINCT cell_type FROM obs), k AS (SELECT cell_type, row_number() OVER (ORDER BY cell_type) - 1 AS code, (SELECT count(*) FROM c) AS n FROM c) SELECT cell_type, repeat('0', code) || '1' || repeat('0', n - code - 1) AS bits FROM k",
)
_add(
    "perturbation_source",
    lambda s, d: S.perturbation_table(_cells(s, d)).select("cell_id", "pert_code", "cell_type_code", "batch_code", "is_control", "group_code"),
    f"""WITH {D.OBS}, c AS (SELECT cell_id, perturbation, dense_rank() OVER (ORDER BY perturbation) - 1 AS pert_code, dense_rank() OVER (ORDER BY cell_type) - 1 AS cell_type_code, dense_rank() OVER (ORDER BY batch) - 1 AS batch_code FROM obs)
    SELECT cell_id, pert_code, cell_type_code, batch_code, perturbation = 'non-targeting' AS is_control, CAST(cell_type_code * (SELECT count(DISTINCT perturbation) FROM obs) + pert_code AS BIGINT) AS group_code FROM c""",
)


def aligned(spark, sf_dir):
    e = D.points(spark, sf_dir)
    ref = e.select("id", (F.lit(100000) - F.col("id")).alias("position"))
    return S.align_to_reference(e, ref, "id", "position").select("position", "id", rounded(F.col("vec")[0]).alias("v0"))


_add("align_embeddings", aligned, f"WITH {D.POINTS} SELECT 100000 - id AS position, id, round(vec[1], 6) + 0.0 AS v0 FROM points")
_add(
    "concat_sources",
    lambda s, d: S.label_codes(S.concat_sources([_cells(s, d).filter("batch < 2"), _cells(s, d).filter("batch >= 2")]), "perturbation", "code").select("cell_id", F.col("source_idx").cast("long").alias("source_idx"), "code"),
    f"WITH {D.OBS} SELECT cell_id, CAST(batch >= 2 AS BIGINT) AS source_idx, dense_rank() OVER (ORDER BY perturbation) - 1 AS code FROM obs",
)


# Graders
def tolerances(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 997).alias("p"), (F.pmod("o_custkey", F.lit(300)) + 1.0).alias("t"))
    cols = []
    for m, tol in (("absolute", 60.0), ("relative", 0.5), ("min", 0.0), ("max", 0.0)):
        ok, score = R.numeric_tolerance("p", "t", tol, m)
        cols += [ok.alias(f"ok_{m}"), rounded(score).alias(f"score_{m}")]
    return o.select("id", *cols)


_add(
    "grade_numeric_tolerance",
    tolerances,
    """WITH o AS (SELECT o_orderkey AS id, o_totalprice / 997 AS p, o_custkey % 300 + 1.0 AS t FROM orders)
    SELECT id, abs(p - t) <= 60 AS ok_absolute, round(greatest(0, 1 - abs(p - t) / 60), 6) + 0.0 AS score_absolute, abs(p - t) / t <= 0.5 AS ok_relative, round(greatest(0, 1 - abs(p - t) / t / 0.5), 6) + 0.0 AS score_relative,
    p >= t AS ok_min, round(CASE WHEN p >= t THEN 1 ELSE greatest(0, least(1, p / t)) END, 6) AS score_min, p <= t AS ok_max, round(CASE WHEN p <= t THEN 1 ELSE greatest(0, least(1, t / p)) END, 6) AS score_max FROM o""",
)
_add(
    "grade_multiple_choice",
    lambda s, d: D.table(s, d, "orders").withColumn("a", F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit(" "))).withColumn("b", F.when(F.pmod("o_custkey", F.lit(3)) == 0, "1-URGENT").otherwise(F.col("o_orderpriority"))).select(F.col("o_orderkey").alias("id"), R.multiple_choice("a", "b").alias("passed")),
    "SELECT o_orderkey AS id, upper(trim(' ' || lower(o_orderpriority) || ' ')) = upper(trim(CASE WHEN o_custkey % 3 = 0 THEN '1-URGENT' ELSE o_orderpriority END)) AS passed FROM orders",
)


def _answers(spark, sf_dir):
    c = D.counts(spark, sf_dir)
    from strandlake.functions.order import hard_rank

    ordered = hard_rank(c, "value", "gene_id", ["cell_id"])
    lists = ordered.groupBy(F.col("cell_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "gene_id"))), lambda x: x["gene_id"]).alias("predicted"))
    truth = c.filter(F.col("gene_id") < "Brand#30").groupBy(F.col("cell_id").alias("id")).agg(F.array_sort(F.collect_set("gene_id")).alias("truth"))
    return lists.join(truth, "id")


_ANS = f"{D.COUNTS}, p AS (SELECT cell_id AS id, list(gene_id ORDER BY value DESC, gene_id) AS predicted FROM counts GROUP BY 1), t AS (SELECT cell_id AS id, list(DISTINCT gene_id) AS truth FROM counts WHERE gene_id < 'Brand#30' GROUP BY 1), a AS (SELECT * FROM p JOIN t USING (id))"
_add(
    "grade_marker_precision_recall",
    lambda s, d: R.marker_precision_recall(_answers(s, d)).select("id", rounded("precision").alias("precision"), rounded("recall").alias("recall"), rounded("f1").alias("f1"), "passed"),
    f"""WITH {_ANS}, h AS (SELECT id, len(list_intersect(predicted[1:len(truth)], truth)) AS h, len(truth) AS n FROM a)
    SELECT id, round(h / n, 6) AS precision, round(h / n, 6) AS recall, round(h / n, 6) AS f1, h / n >= 0.5 AS passed FROM h""",
)


def jaccard(spark, sf_dir):
    a = _answers(spark, sf_dir)
    ok, score = R.label_jaccard("predicted", "truth")
    return a.select("id", ok.alias("passed"), rounded(score).alias("score"))


_add("grade_label_set_jaccard", jaccard, f"WITH {_ANS} SELECT id, len(truth) / len(predicted) >= 0.5 AS passed, round(len(truth) / len(predicted), 6) AS score FROM a")


def distributions(spark, sf_dir):
    o = D.obs(spark, sf_dir)
    share = lambda b: o.filter(F.col("batch") == b).groupBy("cell_type").count().select(F.lit("q").alias("key"), "cell_type", (F.col("count") / o.filter(F.col("batch") == b).count()).alias("share"))
    return R.distribution_comparison(share(0), share(1), "key", "cell_type", "share", 0.02).select("key", rounded("score").alias("score"), "passed")


_add(
    "grade_distribution_comparison",
    distributions,
    f"""WITH {D.OBS}, s AS (SELECT batch, cell_type, count(*) / sum(count(*)) OVER (PARTITION BY batch) AS p FROM obs WHERE batch < 2 GROUP BY 1, 2),
    m AS (SELECT avg(CAST(abs(coalesce(a.p, 0) - coalesce(b.p, 0)) <= 0.02 AS DOUBLE)) AS s FROM (SELECT * FROM s WHERE batch = 0) a FULL JOIN (SELECT * FROM s WHERE batch = 1) b USING (cell_type)) SELECT 'q' AS key, round(s, 6) AS score, s >= 0.8 AS passed FROM m""",
)
_add(
    "evaluation_summary",
    lambda s, d: R.summarize(D.table(s, d, "orders").select(F.col("o_orderpriority").alias("task_type"), (F.col("o_orderstatus") == "F").alias("passed"), F.when((F.pmod("o_custkey", F.lit(7)) == 0) & (F.col("o_orderstatus") != "F"), "x").alias("error"))).withColumn("pass_rate", rounded("pass_rate")),
    """SELECT o_orderpriority AS task_type, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS passed, count(*) FILTER (o_custkey % 7 = 0 AND o_orderstatus <> 'F') AS errored,
    count(*) FILTER (o_custkey % 7 <> 0 AND o_orderstatus <> 'F') AS failed, round(avg(CAST(o_orderstatus = 'F' AS DOUBLE)), 6) AS pass_rate FROM orders GROUP BY 1""",
)


# Metrics: scored rows are orders, labelled by status and scored by price
def _scored(spark, sf_dir):
    return D.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 100000 - 1).alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("label"), F.col("o_orderpriority").alias("grp"),
        F.substring("o_orderpriority", 1, 1).alias("truth"), F.when(F.pmod("o_custkey", F.lit(3)) == 0, "1").otherwise(F.substring("o_orderpriority", 1, 1)).alias("guess"), F.pmod("o_custkey", F.lit(11)).cast("double").alias("y"),
    )


_SC = """sc AS (SELECT o_orderkey AS id, o_totalprice / 100000 - 1 AS score, CAST(o_orderstatus = 'F' AS INT) AS label, o_orderpriority AS grp, substr(o_orderpriority, 1, 1) AS truth,
    CASE WHEN o_custkey % 3 = 0 THEN '1' ELSE substr(o_orderpriority, 1, 1) END AS guess, CAST(o_custkey % 11 AS DOUBLE) AS y FROM orders)"""
_add(
    "classification_metrics",
    lambda s, d: R.classification_metrics(_scored(s, d), "truth", "guess").select(rounded("accuracy").alias("accuracy"), rounded("macro_f1").alias("macro_f1")),
    f"""WITH {_SC}, l AS (SELECT DISTINCT truth AS l FROM sc), f AS (SELECT l, 2.0 * count(*) FILTER (truth = l AND guess = l) / (count(*) FILTER (truth = l) + count(*) FILTER (guess = l)) AS f1 FROM l, sc GROUP BY 1)
    SELECT round((SELECT avg(CAST(truth = guess AS DOUBLE)) FROM sc), 6) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM f""",
)
_add(
    "per_class_f1",
    lambda s, d: R.per_class_f1(_scored(s, d), "truth", "guess").select("label", rounded("f1").alias("f1"), "support"),
    f"WITH {_SC}, l AS (SELECT DISTINCT truth AS l FROM sc) SELECT l AS label, round(2.0 * count(*) FILTER (truth = l AND guess = l) / (count(*) FILTER (truth = l) + count(*) FILTER (guess = l)), 6) AS f1, count(*) FILTER (truth = l) AS support FROM l, sc GROUP BY 1",
)
_add(
    "mask_metrics",
    lambda s, d: R.mask_metrics(_scored(s, d).select((F.col("score") > 0).alias("p"), (F.col("label") == 1).alias("t")), "p", "t").select(*[rounded(c).alias(c) for c in ("precision", "recall", "f1", "jaccard")]),
    f"""WITH {_SC}, n AS (SELECT count(*) FILTER (score > 0 AND label = 1) AS tp, count(*) FILTER (score > 0 AND label = 0) AS fp, count(*) FILTER (score <= 0 AND label = 1) AS fn FROM sc)
    SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp + fn), 6) AS jaccard FROM n""",
)
_add(
    "auroc_exact",
    lambda s, d: R.auroc(_scored(s, d).withColumn("score", F.floor(F.col("score") * 20)), "score", "label", ["grp"]).select("grp", rounded("auroc").alias("auroc")),
    f"""WITH {_SC}, r AS (SELECT grp, label, rank() OVER w + (count(*) OVER (PARTITION BY grp, floor(score * 20)) - 1) / 2 AS r FROM sc WINDOW w AS (PARTITION BY grp ORDER BY floor(score * 20)))
    SELECT grp, round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS auroc FROM r GROUP BY 1""",
)
_add(
    "auroc_soft",
    lambda s, d: R.soft_auroc(_scored(s, d).withColumn("score", F.floor(F.col("score") * 50) / 50), "id", "score", "label").select(rounded("auroc").alias("auroc")),
    f"""WITH {_SC}, g AS (SELECT label, floor(score * 50) / 50 AS s, count(*) AS n FROM sc GROUP BY 1, 2)
    SELECT round(sum(a.n * b.n / (1 + exp(-(a.s - b.s) / 0.1))) / sum(a.n * b.n), 6) AS auroc FROM g a JOIN g b ON a.label = 1 AND b.label = 0""",
)
_add(
    "precision_recall_area",
    lambda s, d: R.precision_recall_area(_scored(s, d), "id", "score", "label").select(rounded("average_precision").alias("average_precision"), rounded("auprc").alias("auprc")),
    f"""WITH {_SC}, c AS (SELECT sum(label) OVER w AS tp, row_number() OVER w AS k, sum(label) OVER () AS t FROM sc WINDOW w AS (ORDER BY score DESC, id)), p AS (SELECT k, tp / k AS p, tp / t AS r FROM c),
    q AS (SELECT p, r, coalesce(lag(p) OVER (ORDER BY k), 1) AS p0, coalesce(lag(r) OVER (ORDER BY k), 0) AS r0 FROM p) SELECT round(sum((r - r0) * p), 6) AS average_precision, round(sum((r - r0) * (p + p0) / 2), 6) AS auprc FROM q""",
)
_add(
    "early_precision_ratio",
    lambda s, d: R.early_precision_ratio(_scored(s, d), "id", "score", "label").select(rounded("epr").alias("epr")),
    f"WITH {_SC}, c AS (SELECT label, row_number() OVER (ORDER BY score DESC, id) AS k, sum(label) OVER () AS t, count(*) OVER () AS n FROM sc) SELECT round(avg(label) / (max(t) / max(n)), 6) AS epr FROM c WHERE k <= t",
)
_add(
    "regression_metrics",
    lambda s, d: R.regression_metrics(_scored(s, d), "id", "y", "score").select(*[rounded(c).alias(c) for c in ("rmse", "pearson", "spearman")]),
    f"""WITH {_SC}, r AS (SELECT *, row_number() OVER (ORDER BY y, id) AS a, row_number() OVER (ORDER BY score, id) AS b FROM sc) SELECT round(sqrt(avg(pow(score - y, 2))), 6) AS rmse, round(corr(y, score), 6) + 0.0 AS pearson, round(corr(a, b), 6) + 0.0 AS spearman FROM r""",
)
_add(
    "calibration_metrics",
    lambda s, d: R.calibration_metrics(_scored(s, d), "score", "label").select(rounded("brier").alias("brier"), rounded("ece").alias("ece")),
    f"""WITH {_SC}, p AS (SELECT 1 / (1 + exp(-score)) AS p, label AS y FROM sc), b AS (SELECT least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS mp, avg(y) AS my, sum(pow(p - y, 2)) AS se FROM p GROUP BY 1) SELECT round(sum(se) / sum(n), 6) AS brier, round(sum(n * abs(mp - my)) / sum(n), 6) AS ece FROM b""",
)
_add(
    "ranking_metrics",
    lambda s, d: R.ranking_metrics(D.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("grp"), F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("label")), "id", "grp", "score", "label").select(*[rounded(c).alias(c) for c in ("mrr", "recall_at_1", "recall_at_5")]),
    """WITH r AS (SELECT o_custkey AS g, o_orderstatus = 'F' AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders), b AS (SELECT g, min(k) FILTER (y) AS b FROM r GROUP BY 1)
    SELECT round(avg(coalesce(1 / b, 0)), 6) AS mrr, round(avg(CAST(coalesce(b, 1000000) <= 1 AS DOUBLE)), 6) AS recall_at_1, round(avg(CAST(coalesce(b, 1000000) <= 5 AS DOUBLE)), 6) AS recall_at_5 FROM b""",
)


def structures(spark, sf_dir):
    """Nested hairpins whose depth follows the id."""
    k = F.pmod("c_custkey", F.lit(6)).cast("int") + 1
    c = D.table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("seq_id"), F.concat(F.expr("repeat('(', pmod(c_custkey, 6) + 1)"), F.lit("..."), F.expr("repeat(')', pmod(c_custkey, 6) + 1)"), F.lit("(.)")).alias("structure"), k.alias("k"))


_add(
    "bracket_pairs",
    lambda s, d: R.bracket_pairs(structures(s, d)).select("seq_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")),
    """WITH s AS (SELECT c_custkey AS seq_id, c_custkey % 6 + 1 AS k FROM customer) SELECT seq_id, i, 2 * k + 2 - i AS j FROM (SELECT seq_id, k, unnest(range(k)) AS i FROM s) UNION ALL SELECT seq_id, 2 * k + 3, 2 * k + 5 FROM s""",
)


def pairs_f1(spark, sf_dir):
    t = R.bracket_pairs(structures(spark, sf_dir))
    p = t.select("seq_id", "i", F.when(F.pmod(F.col("seq_id") + F.col("i"), F.lit(3)) == 0, F.col("j") + 1).otherwise(F.col("j")).alias("j"))
    return R.pair_metrics(p, t).select("seq_id", *[rounded(c).alias(c) for c in ("sensitivity", "ppv", "f1")])


_add(
    "base_pair_metrics",
    pairs_f1,
    """WITH s AS (SELECT c_custkey AS seq_id, c_custkey % 6 + 1 AS k FROM customer), t AS (SELECT seq_id, i FROM (SELECT seq_id, unnest(range(k)) AS i FROM s) UNION ALL SELECT seq_id, 2 * k + 3 FROM s),
    m AS (SELECT seq_id, avg(CAST((seq_id + i) % 3 <> 0 AS DOUBLE)) AS r FROM t GROUP BY 1) SELECT seq_id, round(r, 6) AS sensitivity, round(r, 6) AS ppv, round(r, 6) AS f1 FROM m""",
)


def alignments(spark, sf_dir):
    n = D.table(spark, sf_dir, "nation")
    ref = n.select(F.col("n_regionkey").alias("family"), F.col("n_name").alias("name"), F.rpad(F.regexp_replace("n_name", "[^A-Z]", ""), 20, ".").alias("aligned"))
    got = n.select(F.col("n_regionkey").alias("family"), F.col("n_name").alias("name"), F.rpad(F.concat(F.when(F.col("n_nationkey") % 4 == 0, ".").otherwise(""), F.regexp_replace("n_name", "[^A-Z]", "")), 20, ".").alias("aligned"))
    return R.alignment_scores(got, ref).select(F.col("family").cast("long").alias("family"), rounded("sp").alias("sp"), rounded("tc").alias("tc"))


_add("alignment_sp_tc", alignments)
