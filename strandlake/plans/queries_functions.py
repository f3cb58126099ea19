"""Queries over scalar functions: soft predicates, order statistics and sequences, with their SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import order as O
from strandlake.functions import sequence as Q
from strandlake.functions import soft as S
from strandlake.functions.numeric import array_softmax, dot, erf, lgamma, normal_cdf, rounded
from strandlake.plans import derive as D

SOFT = 0.25
MODES = ("smooth", "c0", "c1", "c2")
_ALL = ("hard", *MODES)
_EVENTS = "x AS (SELECT event_id AS id, sqrt(value + 0.3717) / 5 - 2 AS x, CAST(user_id % 5 AS DOUBLE) / 2 - 1 AS y, user_id % 4 / 3.0 AS p, user_id % 3 / 2.0 AS q FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return D.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        (F.sqrt(F.col("value") + 0.3717) / 5 - 2).alias("x"),
        ((u % 5).cast("double") / 2 - 1).alias("y"),
        (u % 4 / F.lit(3.0)).alias("p"),
        (u % 3 / F.lit(2.0)).alias("q"),
    )


# SQL text of the soft functions, written apart from the expressions that it checks.
def _sig(x, mode, s=SOFT):
    u = f"(({x}) / {5 * s})"
    curve = {
        "c0": f"0.5 + 0.5 * {u}",
        "c1": f"0.5 + 0.75 * {u} - 0.25 * pow({u}, 3)",
        "c2": f"0.5 + 0.9375 * {u} - 0.625 * pow({u}, 3) + 0.1875 * pow({u}, 5)",
    }
    if mode == "smooth":
        return f"(1 / (1 + exp(-({x}) / {s})))"
    return f"(CASE WHEN {u} < -1 THEN 0 WHEN {u} < 1 THEN {curve[mode]} ELSE 1 END)"


def _relu(x, mode, s=SOFT):
    u = f"(({x}) / {5 * s})"
    curve = {
        "c0": f"0.25 + 0.5 * {u} + 0.25 * pow({u}, 2)",
        "c1": f"0.1875 + 0.5 * {u} + 0.375 * pow({u}, 2) - 0.0625 * pow({u}, 4)",
        "c2": f"0.15625 + 0.5 * {u} + 0.46875 * pow({u}, 2) - 0.15625 * pow({u}, 4) + 0.03125 * pow({u}, 6)",
    }
    if mode == "smooth":
        return f"({s} * ln(1 + exp(({x}) / {s})))"
    return f"(CASE WHEN {u} < -1 THEN 0 WHEN {u} < 1 THEN {5 * s} * ({curve[mode]}) ELSE ({x}) END)"


def _abs(x, mode):
    return f"(({x}) * (2 * {_sig(x, mode)} - 1))"


def _gt(x, y, mode):
    return _sig(f"({x}) - ({y}) - 1e-10", mode)


def _round_sql(x, mode):
    parts = [f"(floor({x}) + {k}) * ({_sig(f'({x}) - (floor({x}) + {k} - 0.5)', mode)} - {_sig(f'({x}) - (floor({x}) + {k} + 0.5)', mode)})" for k in range(-5, 6)]
    return "(" + " + ".join(parts) + ")"


def _by_mode(make, modes=_ALL):
    def query(spark, sf_dir):
        return _events(spark, sf_dir).select("id", *[rounded(make(m)).alias(f"v_{m}") for m in modes])

    return query


def _by_mode_sql(make, modes=_ALL):
    return f"WITH {_EVENTS} SELECT id, " + ", ".join(f"round({make(m)}, 6) + 0.0 AS v_{m}" for m in modes) + " FROM x"


QUERIES, SQL = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


_hard = lambda soft, hard: lambda m: hard if m == "hard" else soft(m)
_add("soft_sigmoidal", _by_mode(lambda m: S.sigmoidal("x", SOFT, m), MODES), _by_mode_sql(lambda m: _sig("x", m), MODES))
_add("soft_relu", _by_mode(lambda m: S.relu("x", SOFT, m)), _by_mode_sql(_hard(lambda m: _relu("x", m), "greatest(x, 0)")))
_add("soft_relu_gated", _by_mode(lambda m: S.softrelu("x", SOFT, m, gated=True), MODES), _by_mode_sql(lambda m: f"x * {_sig('x', m)}", MODES))
_add("soft_heaviside", _by_mode(lambda m: S.heaviside("x", SOFT, m)), _by_mode_sql(_hard(lambda m: _sig("x", m), "CASE WHEN x < 0 THEN 0.0 WHEN x > 0 THEN 1.0 ELSE 0.5 END")))
_add("soft_round", _by_mode(lambda m: S.soft_round("x", SOFT, m)), _by_mode_sql(_hard(lambda m: _round_sql("x", m), "round_even(x, 0)")))
_add("soft_sign", _by_mode(lambda m: S.soft_sign("x", SOFT, m)), _by_mode_sql(_hard(lambda m: f"2 * {_sig('x', m)} - 1", "CAST(sign(x) AS DOUBLE)")))
_add("soft_abs", _by_mode(lambda m: S.soft_abs("x", SOFT, m)), _by_mode_sql(_hard(lambda m: _abs("x", m), "abs(x)")))
_add("soft_clip", _by_mode(lambda m: S.soft_clip("x", -0.5, 1.5, SOFT, m)), _by_mode_sql(_hard(lambda m: f"-0.5 + {_relu('x + 0.5', m)} - {_relu('x - 1.5', m)}", "least(greatest(x, -0.5), 1.5)")))
_add("soft_greater", _by_mode(lambda m: S.greater("x", "y", SOFT, m)), _by_mode_sql(_hard(lambda m: _gt("x", "y", m), "CAST(x > y AS DOUBLE)")))
_add("soft_greater_equal", _by_mode(lambda m: S.greater_equal("x", "y", SOFT, m)), _by_mode_sql(_hard(lambda m: _sig("x - y + 1e-10", m), "CAST(x >= y AS DOUBLE)")))
_add("soft_less", _by_mode(lambda m: S.less("x", "y", SOFT, m)), _by_mode_sql(_hard(lambda m: f"1 - {_sig('x - y + 1e-10', m)}", "CAST(x < y AS DOUBLE)")))
_add("soft_less_equal", _by_mode(lambda m: S.less_equal("x", "y", SOFT, m)), _by_mode_sql(_hard(lambda m: f"1 - {_gt('x', 'y', m)}", "CAST(x <= y AS DOUBLE)")))
_add("soft_equal", _by_mode(lambda m: S.equal("x", "y", SOFT, m)), _by_mode_sql(_hard(lambda m: f"2 * (1 - {_gt(_abs('x - y', m), '0', m)})", "CAST(x = y AS DOUBLE)")))
_add("soft_not_equal", _by_mode(lambda m: S.not_equal("x", "y", SOFT, m)), _by_mode_sql(_hard(lambda m: f"2 * {_gt(_abs('x - y', m), '0', m)} - 1", "CAST(x <> y AS DOUBLE)")))
_add(
    "soft_isclose",
    _by_mode(lambda m: S.isclose("x", "y", SOFT, 0.1, 0.05, m)),
    _by_mode_sql(_hard(lambda m: f"2 * (1 - {_gt(_abs('x - y', m), f'0.05 + 0.1 * {_abs("y", m)}', m)})", "CAST(abs(x - y) <= 0.05 + 0.1 * abs(y) AS DOUBLE)")),
)


def soft_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    out = {
        "v_not": S.soft_not("p"), "v_and": S.soft_and("p", "q"), "v_or": S.soft_or("p", "q"), "v_xor": S.soft_xor("p", "q"),
        "g_and": S.soft_and("p", "q", True), "g_or": S.soft_or("p", "q", True), "v_where": S.soft_where("p", "x", "y"),
        "v_all": S.array_all(F.array("p", "q", "q")), "v_any": S.array_any(F.array("p", "q", "q")), "g_all": S.array_all(F.array("p", "q", "q"), True),
    }
    return e.select("id", *[rounded(c).alias(k) for k, c in out.items()])


_add(
    "soft_logic",
    soft_logic,
    f"""WITH {_EVENTS} SELECT id, round(1 - p, 6) AS v_not, round(p * q, 6) AS v_and, round(1 - (1 - p) * (1 - q), 6) AS v_or,
    round(1 - (1 - p * (1 - q)) * (1 - (1 - p) * q), 6) AS v_xor, round(exp((ln(greatest(p, 1e-10)) + ln(greatest(q, 1e-10))) / 2), 6) AS g_and,
    round(1 - exp((ln(greatest(1 - p, 1e-10)) + ln(greatest(1 - q, 1e-10))) / 2), 6) + 0.0 AS g_or, round(x * p + y * (1 - p), 6) + 0.0 AS v_where,
    round(p * q * q, 6) AS v_all, round(1 - (1 - p) * (1 - q) * (1 - q), 6) AS v_any,
    round(exp((ln(greatest(p, 1e-10)) + 2 * ln(greatest(q, 1e-10))) / 3), 6) AS g_all FROM x""",
)


def soft_reduce_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events").withColumn("p", F.lit(1.0) - F.col("value") / 50000)
    return e.groupBy("user_id").agg(rounded(S.group_all("p")).alias("v_all"), rounded(1 - S.group_all(1 - F.col("p"))).alias("v_any"))


_add(
    "soft_reduce_columns",
    soft_reduce_columns,
    """SELECT user_id, round(product(1 - value / 50000), 6) AS v_all, round(1 - product(1 - (1 - value / 50000)), 6) AS v_any FROM events GROUP BY 1""",
)


def safe_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    out = {
        "v_sqrt": S.safe_sqrt("x"), "v_arcsin": S.safe_arcsin("y"), "v_arccos": S.safe_arccos("y"), "v_div": S.safe_div("x", "y"),
        "v_log": S.safe_log("x"), "v_norm": S.safe_norm(F.array("x", "y", "p")),
    }
    return e.select("id", *[rounded(c).alias(k) for k, c in out.items()])


_add(
    "safe_math",
    safe_math,
    f"""WITH {_EVENTS} SELECT id, round(CASE WHEN x > 0 THEN sqrt(greatest(x, 0)) ELSE 0 END, 6) AS v_sqrt,
    round(CASE WHEN abs(y) < 1 THEN asin(least(greatest(y, -1), 1)) ELSE sign(y) * pi() / 2 END, 6) AS v_arcsin,
    round(CASE WHEN abs(y) < 1 THEN acos(least(greatest(y, -1), 1)) WHEN y >= 1 THEN 0 ELSE pi() END, 6) AS v_arccos,
    round(CASE WHEN y <> 0 THEN x / y ELSE 0 END, 6) + 0.0 AS v_div, round(CASE WHEN x > 0 THEN ln(x) ELSE 0 END, 6) + 0.0 AS v_log,
    round(sqrt(x * x + y * y + p * p), 6) AS v_norm FROM x""",
)


def squash_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("y")
    e = _events(spark, sf_dir).withColumn("m", F.avg("x").over(w)).withColumn("v", F.var_pop("x").over(w))
    e = e.withColumn("z", S.standardize_and_squash("x", "m", "v"))
    back = S.unsquash_and_destandardize("z", "m", F.sqrt(F.col("v") + 1e-6))
    return e.select("id", rounded("z").alias("squashed"), rounded(back, 4).alias("back"))


_add(
    "squash_round_trip",
    squash_round_trip,
    f"""WITH {_EVENTS}, s AS (SELECT *, avg(x) OVER w AS m, var_pop(x) OVER w AS v FROM x WINDOW w AS (PARTITION BY y))
    SELECT id, round(1 / (1 + exp(-(x - m) / sqrt(v + 1e-6))), 6) AS squashed, round(x, 4) + 0.0 AS back FROM s""",
)


def soft_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.points(spark, sf_dir).withColumn("few", F.slice("vec", 1, 8)).withColumn("w", array_softmax(F.slice("vec", 9, 8)))
    sliced = S.soft_slice("few", "w", 3)
    return p.select("id", rounded(S.take("few", "w")).alias("taken"), *[rounded(sliced[i]).alias(f"s{i}") for i in range(3)])


_add(
    "soft_gather",
    soft_gather,
    f"""WITH {D.POINTS}, t AS (SELECT id, unnest(range(8)) AS i, vec FROM points),
    e AS (SELECT id, i, vec, exp(vec[i + 9]) AS z FROM t), w AS (SELECT *, z / sum(z) OVER (PARTITION BY id) AS w FROM e)
    SELECT id, round(sum(w * vec[i + 1]), 6) + 0.0 AS taken, round(sum(w * vec[i + 1]), 6) + 0.0 AS s0,
    round(sum(w * vec[(i + 1) % 8 + 1]), 6) + 0.0 AS s1, round(sum(w * vec[(i + 2) % 8 + 1]), 6) + 0.0 AS s2 FROM w GROUP BY id""",
)


def special_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 100).alias("x"))
    return p.select("id", rounded(lgamma("x")).alias("v_lgamma"), rounded(erf(F.col("x") / 20)).alias("v_erf"), rounded(normal_cdf(F.col("x") / 10)).alias("v_cdf"))


_add("special_functions", special_functions)
SQL["special_functions_lgamma"] = "SELECT p_partkey AS id, round(lgamma(p_retailprice / 100), 6) AS v_lgamma FROM part"
QUERIES["special_functions_lgamma"] = lambda spark, sf_dir: special_functions(spark, sf_dir).select("id", "v_lgamma")


# Order statistics
def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.counts(spark, sf_dir)
    out = O.hard_rank(c, "value", "gene_id", ["cell_id"])
    w = Window.partitionBy("cell_id").orderBy(F.col("value"), F.col("gene_id"))
    return out.withColumn("ascending", F.row_number().over(w)).select("cell_id", "gene_id", F.col("rank").cast("long"), F.col("ascending").cast("long"))


_add(
    "sort_rank",
    ranked,
    f"""WITH {D.COUNTS} SELECT cell_id, gene_id, row_number() OVER (PARTITION BY cell_id ORDER BY value DESC, gene_id) AS rank,
    row_number() OVER (PARTITION BY cell_id ORDER BY value, gene_id) AS ascending FROM counts""",
)


def gene_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank-value tokenisation: the genes of a cell by falling expression."""
    r = O.hard_rank(D.counts(spark, sf_dir), "value", "gene_id", ["cell_id"])
    return r.groupBy("cell_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "gene_id"))), lambda s: s["gene_id"]), " ").alias("tokens"))


_add("gene_tokenizer", gene_tokens, f"WITH {D.COUNTS} SELECT cell_id, string_agg(gene_id, ' ' ORDER BY value DESC, gene_id) AS tokens FROM counts GROUP BY 1")
_add(
    "top_k_mask",
    lambda spark, sf_dir: O.top_k_mask(D.counts(spark, sf_dir), "value", 5, "gene_id", ["cell_id"]).select("cell_id", "gene_id", "mask"),
    f"WITH {D.COUNTS} SELECT cell_id, gene_id, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY value DESC, gene_id DESC) <= 5 AS DOUBLE) AS mask FROM counts",
)
_add(
    "top_k",
    lambda spark, sf_dir: O.top_k(D.counts(spark, sf_dir), "value", 3, "gene_id", ["cell_id"]).select("cell_id", "gene_id", "value", F.col("rank").cast("long")),
    f"WITH {D.COUNTS} SELECT cell_id, gene_id, value, row_number() OVER (PARTITION BY cell_id ORDER BY value DESC, gene_id) AS rank FROM counts QUALIFY rank <= 3",
)
_add(
    "soft_argmax",
    lambda spark, sf_dir: O.soft_argmax(D.counts(spark, sf_dir), "value", ["cell_id"], 50.0).select("cell_id", "gene_id", rounded("p").alias("p")),
    f"WITH {D.COUNTS}, e AS (SELECT *, exp((value - max(value) OVER (PARTITION BY cell_id)) / 50) AS z FROM counts) SELECT cell_id, gene_id, round(z / sum(z) OVER (PARTITION BY cell_id), 6) AS p FROM e",
)


def array_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.points(spark, sf_dir).withColumn("x", F.slice("vec", 1, 6))
    out = {
        "v_max": O.array_soft_max("x", 0.5), "v_sort1": O.array_soft_sort("x", 0.5)[0], "v_sort6": O.array_soft_sort("x", 0.5)[5],
        "v_rank1": O.array_soft_rank("x", 0.5)[0], "h_max": F.array_max("x"), "h_argmax": F.array_position("x", F.array_max("x")).cast("double") - 1,
    }
    return p.select("id", *[rounded(c).alias(k) for k, c in out.items()])


_add(
    "soft_sort_rank_max",
    array_order,
    f"""WITH {D.POINTS}, t AS (SELECT id, unnest(range(6)) AS i, vec FROM points), v AS (SELECT id, i, vec[i + 1] AS x, list_sort(vec[1:6]) AS o FROM t)
    SELECT id, round(sum(x * exp(x / 0.5)) / sum(exp(x / 0.5)), 6) + 0.0 AS v_max,
    round(sum(x * exp(-abs(x - o[1]) / 0.5)) / sum(exp(-abs(x - o[1]) / 0.5)), 6) + 0.0 AS v_sort1,
    round(sum(x * exp(-abs(x - o[6]) / 0.5)) / sum(exp(-abs(x - o[6]) / 0.5)), 6) + 0.0 AS v_sort6,
    round(0.5 + sum(1 / (1 + exp(-(x - f) / 0.5))), 6) + 0.0 AS v_rank1, round(max(x), 6) + 0.0 AS h_max, CAST(arg_max(i, x) AS DOUBLE) AS h_argmax
    FROM (SELECT *, first(x) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f FROM v) GROUP BY id""",
)


def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.counts(spark, sf_dir).groupBy("cell_id").agg(F.collect_list("value").alias("xs"))
    kinds = {m: O.array_quantile("xs", 0.3, m) for m in ("linear", "lower", "higher", "nearest", "midpoint")}
    return c.select("cell_id", rounded(O.array_median("xs")).alias("median"), *[rounded(v).alias(f"q_{k}") for k, v in kinds.items()])


_add(
    "quantile_methods",
    quantiles,
    f"""WITH {D.COUNTS}, s AS (SELECT cell_id, list_sort(list(value)) AS xs, quantile_cont(value, 0.5) AS med FROM counts GROUP BY 1),
    p AS (SELECT *, 0.3 * (len(xs) - 1) AS p FROM s), k AS (SELECT *, CAST(floor(p) AS INT) AS lo, CAST(ceil(p) AS INT) AS hi FROM p)
    SELECT cell_id, round(med, 6) AS median, round(xs[lo + 1] + (p - lo) * (xs[hi + 1] - xs[lo + 1]), 6) AS q_linear, xs[lo + 1] AS q_lower, xs[hi + 1] AS q_higher,
    CASE WHEN p - lo <= 0.5 THEN xs[lo + 1] ELSE xs[hi + 1] END AS q_nearest, (xs[lo + 1] + xs[hi + 1]) / 2 AS q_midpoint FROM k""",
)
_add(
    "column_quantiles",
    lambda spark, sf_dir: D.counts(spark, sf_dir).groupBy("gene_id").agg(rounded(F.median("value")).alias("median"), rounded(O.quantile("value", 0.9)).alias("p90")),
    f"WITH {D.COUNTS} SELECT gene_id, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM counts GROUP BY 1",
)


def simplex(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.points(spark, sf_dir).withColumn("x", F.slice("vec", 1, 5))
    both = p.select("id", O.simplex_softmax("x", 0.5).alias("a"), O.simplex_euclidean("x", 0.5).alias("b"))
    return both.select("id", *[rounded(F.col(k)[i]).alias(f"{k}{i}") for k in "ab" for i in range(5)])


_add(
    "simplex_projection",
    simplex,
    f"""WITH {D.POINTS}, t AS (SELECT id, unnest(range(5)) AS i, vec FROM points), v AS (SELECT id, i, vec[i + 1] / 0.5 AS z FROM t),
    o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY z DESC, i) AS r, sum(z) OVER (PARTITION BY id ORDER BY z DESC, i ROWS UNBOUNDED PRECEDING) AS s FROM v),
    k AS (SELECT id, max(r) AS k, max_by(s, r) AS s FROM o WHERE 1 + r * z > s GROUP BY id),
    w AS (SELECT id, i, exp(z) / sum(exp(z)) OVER (PARTITION BY id) AS a, greatest(z - (k.s - 1) / k.k, 0) AS b FROM v JOIN k USING (id))
    SELECT id, """
    + ", ".join(f"round(max({k}) FILTER (i = {i}), 6) + 0.0 AS {k}{i}" for k in "ab" for i in range(5))
    + " FROM w GROUP BY id",
)


# Sequences
def dna_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.sequences(spark, sf_dir)
    return s.select(
        "seq_id", Q.complement("sequence").alias("complement"), Q.reverse_complement("sequence").alias("reverse_complement"), rounded(Q.gc_content("sequence")).alias("gc")
    )


_add(
    "dna_complement_gc",
    dna_scalars,
    f"""WITH {D.SEQUENCES} SELECT seq_id, translate(sequence, 'ACGT', 'TGCA') AS complement, reverse(translate(sequence, 'ACGT', 'TGCA')) AS reverse_complement,
    round((length(sequence) - length(translate(sequence, 'GC', ''))) / (length(sequence) + 1e-10), 6) AS gc FROM sequences""",
)


def dna_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.sequences(spark, sf_dir).withColumn("e", Q.one_hot("sequence"))
    mass = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.aggregate("e", F.lit(0.0), lambda acc, p: acc + p[j]))
    return s.select("seq_id", Q.decode_one_hot("e").alias("decoded"), *[mass[i].alias(f"n_{b}") for i, b in enumerate(Q.BASES)])


_add(
    "dna_encode_decode",
    dna_codec,
    f"WITH {D.SEQUENCES} SELECT seq_id, sequence AS decoded, "
    + ", ".join(f"CAST(length(sequence) - length(replace(sequence, '{b}', '')) AS DOUBLE) AS n_{b}" for b in "ACGT")
    + " FROM sequences",
)


def phred(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = D.reads(spark, sf_dir)
    return r.select("read_id", rounded(Q.phred_to_probability("quality")).alias("p"), rounded(Q.probability_to_phred(Q.phred_to_probability("quality"), 30.0)).alias("q"))


_add("phred_scores", phred, f"WITH {D.READS} SELECT read_id, round(pow(10, -quality / 10), 6) AS p, round(least(greatest(quality, 0), 30), 6) AS q FROM reads")


def soft_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = D.reads(spark, sf_dir).select("read_id", Q.soft_encode("base", F.array("quality"), 0.7)[0].alias("e"))
    return r.select("read_id", *[rounded(F.col("e")[i]).alias(b) for i, b in enumerate(Q.BASES)])


_add(
    "dna_soft_encode",
    soft_dna,
    f"""WITH {D.READS}, l AS (SELECT read_id, b, ln((CASE WHEN base = 'N' THEN 0.25 WHEN base = b THEN 1 ELSE 0 END) * (1 - pow(10, -quality / 10)) + 0.25 * pow(10, -quality / 10) + 1e-10) / 0.7 AS l
    FROM reads, (VALUES ('A'), ('C'), ('G'), ('T')) AS v(b)), e AS (SELECT *, exp(l - max(l) OVER (PARTITION BY read_id)) AS z FROM l)
    SELECT read_id, """
    + ", ".join(f"round(sum(z) FILTER (b = '{b}') / sum(z), 6) AS {b}" for b in "ACGT")
    + " FROM e GROUP BY read_id",
)


def kmers(canonical: bool):
    def query(spark, sf_dir):
        f = Q.kmer_features(D.sequences(spark, sf_dir), 3, canonical=canonical)
        return f.select("seq_id", "kmer", Q.kmer_index("kmer").alias("code"), "n", rounded("frequency", 8).alias("frequency"))

    return query


_CODE = " + ".join(f"(position(substr(kmer, {i + 1}, 1) IN 'ACGT') - 1) * {4**i}" for i in range(3))


def _kmer_sql(canonical):
    rc = "reverse(translate(kmer, 'ACGT', 'TGCA'))"
    code = lambda e: _CODE.replace("kmer", e)
    pick = f"CASE WHEN {code('kmer')} <= {code('(' + rc + ')')} THEN kmer ELSE {rc} END" if canonical else "kmer"
    return f"""WITH {D.SEQUENCES}, w AS (SELECT seq_id, substr(sequence, i, 3) AS kmer FROM (SELECT seq_id, sequence, unnest(range(1, length(sequence) - 1)) AS i FROM sequences)),
    c AS (SELECT seq_id, {pick} AS kmer FROM w), g AS (SELECT seq_id, kmer, count(*) AS n FROM c GROUP BY 1, 2)
    SELECT seq_id, kmer, CAST({_CODE} AS BIGINT) AS code, n, round(n / sum(n) OVER (PARTITION BY seq_id), 8) AS frequency FROM g"""


_add("kmer_featurize", kmers(False), _kmer_sql(False))
_add("kmer_featurize_canonical", kmers(True), _kmer_sql(True))
_add(
    "scoring_matrix",
    lambda spark, sf_dir: Q.scoring_table(spark, 2.0, -1.0).unionByName(Q.scoring_table(spark, 1.0, -1.0, "ACGU")),
    """SELECT a, b, CASE WHEN a = b THEN 2.0 ELSE -1.0 END AS score FROM (VALUES ('A'), ('C'), ('G'), ('T')) x(a), (VALUES ('A'), ('C'), ('G'), ('T')) y(b)
    UNION ALL SELECT a, b, CASE WHEN a = b THEN 1.0 ELSE -1.0 END FROM (VALUES ('A'), ('C'), ('G'), ('U')) x(a), (VALUES ('A'), ('C'), ('G'), ('U')) y(b)""",
)


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.points(spark, sf_dir).select("id", F.posexplode(Q.centred_windows("vec", 5)).alias("pos", "w"))
    return p.select("id", F.col("pos").cast("long"), *[rounded(F.col("w")[i]).alias(f"w{i}") for i in range(5)])


_add(
    "extract_windows",
    windows,
    f"WITH {D.POINTS}, t AS (SELECT id, vec, unnest(range(64)) AS pos FROM points) SELECT id, pos, "
    + ", ".join(f"round(vec[least(greatest(pos + {i} - 2, 0), 63) + 1], 6) + 0.0 AS w{i}" for i in range(5))
    + " FROM t",
)
_add(
    "cosine_of_neighbours",
    lambda spark, sf_dir: _cosines(spark, sf_dir),
    f"""WITH {D.POINTS} SELECT a.id, round(list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec) * list_dot_product(b.vec, b.vec)), 6) + 0.0 AS cosine
    FROM points a JOIN points b ON b.id = a.id + 1""",
)


def _cosines(spark, sf_dir):
    p = D.points(spark, sf_dir)
    a, b = p.alias("a"), p.alias("b")
    pair = a.join(b, F.col("b.id") == F.col("a.id") + 1)
    return pair.select("a.id", rounded(dot("a.vec", "b.vec") / F.sqrt(dot("a.vec", "a.vec") * dot("b.vec", "b.vec"))).alias("cosine"))


