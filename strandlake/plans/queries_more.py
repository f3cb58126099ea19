"""Queries over relational operators, soft positions, splits of molecules, and readers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import soft_index as X
from strandlake.functions.numeric import rounded
from strandlake.functions.sequence import dna_element
from strandlake.operators import relational as R
from strandlake.operators import splitting as S
from strandlake.operators import structure as T
from strandlake.plans import derive as D
from strandlake.plans import pipelines as P
from strandlake.plans.queries_io import _fresh
from strandlake.sources import readers as I

QUERIES, SQL = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


# SQL text and categories
_TEXT = """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 1000 GROUP BY l_returnflag, l_linestatus"""


def sql_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query as text, over tables of the folder that are bound as arguments, not as global views."""
    tables = {name: D.table(spark, sf_dir, name) for name in ("lineitem", "orders")}
    return spark.sql(_TEXT.replace("FROM lineitem JOIN orders", "FROM {lineitem} AS lineitem JOIN {orders} AS orders"), **tables)


_add("sql_text", sql_text, _TEXT)
_grouped = lambda kind: lambda s, d: R.grouping_totals(D.table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", kind).withColumn("level", F.col("level").cast("long"))
for _kind in ("cube", "rollup"):
    _add(
        f"grouping_{_kind}", _grouped(_kind),
        f"SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY {_kind}(l_returnflag, l_linestatus)",
    )
_BASES = ["A", "C", "G", "T", "N"]
_add(
    "base_pivot",
    lambda s, d: R.pivot_counts(D.reads(s, d), "position", "base", _BASES),
    f"WITH {D.READS} SELECT position, " + ", ".join(f"count(*) FILTER (base = '{b}') AS \"{b}\"" for b in _BASES) + " FROM reads GROUP BY 1",
)
_parts = lambda s, d, cut: D.table(s, d, "lineitem").filter(cut).select(F.col("l_partkey").alias("gene_id"))
_add("common_genes", lambda s, d: _parts(s, d, "l_quantity > 45").intersect(_parts(s, d, "l_discount > 0.08")), "SELECT l_partkey AS gene_id FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08")
_add("missing_genes", lambda s, d: D.table(s, d, "part").select(F.col("p_partkey").alias("gene_id")).subtract(_parts(s, d, "l_quantity > 10")), "SELECT p_partkey AS gene_id FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 10")


def as_of(slices):
    def query(spark, sf_dir):
        e = D.table(spark, sf_dir, "events")
        bought = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
        clicks = e.filter("event_type = 'click'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("click"))
        return R.as_of_join(bought, clicks, ["user_id"], "ts", "at", "click", "last_click", slices).select("event_id", "last_click")

    return query


_ASOF = """WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts, max(event_id) AS click FROM events WHERE event_type = 'click' GROUP BY 1, 2)
  SELECT p.event_id, c.click AS last_click FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts"""
_add("as_of_join", as_of(1), _ASOF)
_add("as_of_join_sliced", as_of(7), _ASOF)
_add(
    "interval_join",
    lambda s, d: R.interval_counts(D.reads(s, d).select("read_id", "position"), D.table(s, d, "customer").select(F.col("c_custkey").alias("peak"), (F.col("c_custkey") % 700).alias("a"), (F.col("c_custkey") % 700 + F.col("c_nationkey")).alias("b")), "peak", "position", "a", "b", 16),
    f"WITH {D.READS} SELECT c_custkey AS peak, count(*) AS n FROM reads JOIN customer ON position >= c_custkey % 700 AND position < c_custkey % 700 + c_nationkey GROUP BY 1",
)

# Soft positions: SQL in steps over the same arrays
_SHORT = 12
_FEW = f"{D.POINTS}, x AS (SELECT id, vec[1:{_SHORT}] AS x FROM points)"


def _few(spark, sf_dir):
    return D.points(spark, sf_dir).select("id", F.slice("vec", 1, _SHORT).alias("x"))


def _weights(name, z, t="x", s=0.1):
    """A CTE that adds the softmax of an array expression."""
    return f"{name}_z AS (SELECT *, {z} AS {name}_z FROM {t}), {name}_e AS (SELECT *, list_transform({name}_z, lambda u: exp((u - list_max({name}_z)) / {s})) AS {name}_e FROM {name}_z), {name} AS (SELECT *, list_transform({name}_e, lambda u: u / list_sum({name}_e)) AS {name} FROM {name}_e)"


def _at(place, method):
    if method == "softsort":
        return f"list_transform(x, lambda v: -abs(v - list_sort(x)[{place} + 1]))"
    return f"list_transform(x, lambda v: -(({_SHORT} - 1 - 2 * ({place})) * v + list_sum(list_transform(x, lambda u: abs(u - v)))))"


_DOT = lambda w: f"list_sum(list_transform(range(1, {_SHORT + 1}), lambda k: x[k] * {w}[k]))"
for _m in ("softsort", "neuralsort"):
    _top, _low = ("x", "list_transform(x, lambda v: -v)") if _m == "softsort" else (_at(_SHORT - 1, _m), f"list_transform(x, lambda v: (({_SHORT} - 1 - 2 * ({_SHORT} - 1)) * v - list_sum(list_transform(x, lambda u: abs(u - v)))))")
    _add(
        f"soft_extremes_{_m}",
        lambda s, d, m=_m: _few(s, d).select("id", rounded(X.soft_max("x", m), 5).alias("high"), rounded(X.soft_min("x", m), 5).alias("low"), rounded(X.soft_argmin("x", m)[0], 5).alias("p0"), rounded(X.soft_argmax("x", m)[1], 5).alias("p1")),
        f"WITH {_FEW}, {_weights('a', _top)}, {_weights('b', _low, 'a')} SELECT id, round({_DOT('a')}, 5) + 0.0 AS high, round({_DOT('b')}, 5) + 0.0 AS low, round(b[1], 5) + 0.0 AS p0, round(a[2], 5) + 0.0 AS p1 FROM b",
    )
    _p = 0.3 * (_SHORT - 1)
    _add(
        f"soft_quantile_{_m}",
        lambda s, d, m=_m: _few(s, d).select("id", rounded(X.soft_quantile("x", 0.3, m), 5).alias("q"), rounded(X.soft_median("x", m), 5).alias("median"), rounded(X.soft_argquantile("x", 0.3, m)[4], 5).alias("p4"), rounded(X.soft_quantile("x", 0.3, m, how="nearest"), 5).alias("near")),
        f"WITH {_FEW}, {_weights('a', _at(3, _m))}, {_weights('b', _at(4, _m), 'a')}, {_weights('c', _at(5, _m), 'b')}, {_weights('e', _at(6, _m), 'c')} "
        f"SELECT id, round({1 - (_p - 3)} * {_DOT('a')} + {_p - 3} * {_DOT('b')}, 5) + 0.0 AS q, round(0.5 * {_DOT('c')} + 0.5 * {_DOT('e')}, 5) + 0.0 AS median, round({1 - (_p - 3)} * a[5] + {_p - 3} * b[5], 5) + 0.0 AS p4, round({_DOT('a')}, 5) + 0.0 AS near FROM e",
    )
    _add(
        f"soft_argsort_{_m}",
        lambda s, d, m=_m: _few(s, d).select("id", F.posexplode(X.soft_argsort("x", m)).alias("place", "w"), F.col("x")).select("id", F.col("place").cast("long").alias("place"), rounded(F.col("w")[2], 5).alias("w2"), rounded(X.dot("x", "w"), 5).alias("value")),
        f"WITH {D.POINTS}, x AS (SELECT id, vec[1:{_SHORT}] AS x, unnest(range({_SHORT})) AS place FROM points), {_weights('a', _at('place', _m))} SELECT id, place, round(a[3], 5) + 0.0 AS w2, round({_DOT('a')}, 5) + 0.0 AS value FROM a",
    )
_add(
    "hard_positions",
    lambda s, d: _few(s, d).select("id", X.soft_argmax("x", mode="hard")[0].alias("first"), rounded(X.soft_median("x", mode="hard"), 5).alias("median"), rounded(X.soft_percentile("x", 30, mode="hard"), 5).alias("p30")),
    f"WITH {_FEW} SELECT id, CAST(x[1] = list_max(x) AS DOUBLE) AS first, round(list_aggregate(x, 'median'), 5) + 0.0 AS median, round(list_aggregate(x, 'quantile_cont', 0.3), 5) + 0.0 AS p30 FROM x",
)
_add(
    "soft_top_k_mask",
    lambda s, d: _few(s, d).select("id", *[rounded(X.soft_top_k_mask("x", 2)[i], 5).alias(f"m{i}") for i in range(3)]),
    f"WITH {_FEW}, {_weights('a', _at(_SHORT - 2, 'neuralsort'))}, {_weights('b', _at(_SHORT - 1, 'neuralsort'), 'a')} SELECT id, " + ", ".join(f"round(a[{i + 1}] + b[{i + 1}], 5) + 0.0 AS m{i}" for i in range(3)) + " FROM b",
)
_add(
    "soft_permutation",
    lambda s, d: _few(s, d).select("id", *[rounded(X.soft_permutation("x")[0][i], 5).alias(f"p{i}") for i in range(3)]),
    f"WITH {_FEW}, {_weights('a', _at(_SHORT - 1, 'softsort'))} SELECT id, " + ", ".join(f"round(a[{i + 1}], 5) + 0.0 AS p{i}" for i in range(3)) + " FROM a",
)

# Splits
_add(
    "scaffold_split",
    lambda s, d: R.scaffold_split(D.table(s, d, "part").withColumn("scaffold", F.when(F.col("p_size") % 9 != 0, F.col("p_type"))), "p_partkey", "scaffold").select("p_partkey", "split"),
    """WITH r AS (SELECT p_partkey, CASE WHEN p_size % 9 <> 0 THEN p_type ELSE '' END AS s FROM part), g AS (SELECT s, count(*) AS g FROM r GROUP BY 1),
    b AS (SELECT s, coalesce(sum(g) OVER (ORDER BY g DESC, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g)
    SELECT p_partkey, CASE WHEN b < 0.8 * (SELECT count(*) FROM part) THEN 'train' WHEN b < (0.8 + 0.1) * (SELECT count(*) FROM part) THEN 'valid' ELSE 'test' END AS split FROM r JOIN b USING (s)""",
)


def molecule_bits(spark, sf_dir):
    """Parts as molecules: the words of a name and a type, hashed by their letters; parts of size 7 are invalid."""
    words = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")
    bits = F.array_distinct(F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int")))
    return D.table(spark, sf_dir, "part").filter("p_size <> 7").select(F.col("p_partkey").alias("id"), bits.alias("bits"))


_BITS = """bits AS (SELECT p_partkey AS id, list_distinct(list_transform(string_split(lower(p_name || ' ' || p_type), ' '), lambda w: CAST('0x' || substr(md5(w), 1, 4) AS INT))) AS b FROM part WHERE p_size <> 7)"""
_add(
    "similar_molecules",
    lambda s, d: R.similar_molecules(molecule_bits(s, d), 0.75).select("i", "j", rounded("tanimoto").alias("tanimoto")),
    f"""WITH {_BITS}, p AS (SELECT x.id AS i, y.id AS j, len(list_intersect(x.b, y.b)) AS c, len(x.b) + len(y.b) AS t FROM bits x JOIN bits y ON x.id < y.id)
    SELECT i, j, round(c / (t - c), 6) AS tanimoto FROM p WHERE c / (t - c) >= 0.75 - 1e-12""",
)


def tanimoto_split(spark, sf_dir):
    bits = molecule_bits(spark, sf_dir)
    clusters = R.molecule_clusters(bits, 0.75)
    return R.cluster_split(D.table(spark, sf_dir, "part").select("p_partkey"), clusters, "p_partkey").select("p_partkey", "split")


_add("tanimoto_cluster_split", tanimoto_split)
_add(
    "cell_fraction_split",
    lambda s, d: R.cell_fraction_split(D.table(s, d, "part").withColumnRenamed("p_brand", "perturbation"), "perturbation", 0.2),
    """WITH RECURSIVE g AS (SELECT p_brand AS p, count(*) AS n, row_number() OVER (ORDER BY md5('42|' || p_brand), p_brand) AS k FROM part GROUP BY 1),
    t AS (SELECT 0.2 * count(*) AS t FROM part),
    w AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS held, false AS took UNION ALL
      SELECT g.k, CASE WHEN abs(held + n - t) < abs(held - t) THEN held + n ELSE held END, abs(held + n - t) < abs(held - t) FROM w JOIN g ON g.k = w.k + 1, t)
    SELECT p AS perturbation, n, CASE WHEN took THEN 'valid' ELSE 'train' END AS split FROM g JOIN w USING (k)""",
)
_add(
    "count_checks",
    lambda s, d: R.count_checks(D.counts(s, d)),
    f"""WITH {D.COUNTS}, f AS (SELECT DISTINCT cell_id FROM counts ORDER BY 1 LIMIT 100), r AS (SELECT sum(value) AS s FROM counts JOIN f USING (cell_id) GROUP BY cell_id)
    SELECT (SELECT bool_and(abs(s - floor(s)) < 1e-7) FROM r) AS is_discrete, (SELECT max(value) < 15 FROM counts) AS is_log_transformed""",
)

# Readers and small operators that had no query
_add(
    "dna_element_data",
    lambda s, d: D.sequences(s, d).select("seq_id", dna_element("sequence").alias("e")).select("seq_id", F.length("e.sequence").cast("long").alias("n"), F.aggregate("e.quality_scores", F.lit(0.0), lambda a, v: a + v).alias("quality"), F.aggregate("e.mask", F.lit(0.0), lambda a, v: a + v).alias("mask")),
    f"WITH {D.SEQUENCES} SELECT seq_id, length(sequence) AS n, length(sequence) * 40.0 AS quality, length(sequence) * 1.0 AS mask FROM sequences",
)


def network(spark, sf_dir):
    """A regulatory network as files: an expression table of genes by cells, a list of factors and gold edges."""
    root = _fresh(spark, "network")
    wide = D.table(spark, sf_dir, "part").withColumn("size", F.col("p_size") % 5).groupBy(F.col("p_brand").alias("gene")).pivot("size", list(range(5))).count().na.fill(0)
    wide.coalesce(1).write.csv(f"{root}/expression", header=True, sep="\t", compression="gzip")
    D.table(spark, sf_dir, "part").select("p_brand").distinct().filter("p_brand < 'Brand#30'").unionByName(spark.createDataFrame([("Brand#99",)], "p_brand string")).write.text(f"{root}/factors")
    edge = F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 5 + 1).cast("string"), (F.col("l_partkey") % 6 + 1).cast("string"))
    D.table(spark, sf_dir, "lineitem").join(D.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("TF"), edge.alias("Target")).write.csv(f"{root}/edges", header=True, sep="\t")
    n = I.read_network(spark, f"{root}/expression", f"{root}/factors", f"{root}/edges")
    return n["edges"].join(n["factors"].withColumnRenamed("gene_id", "source"), "source", "left_semi").join(n["n_edges"], F.lit(True)).select("source", "target", "n_edges")


_add(
    "gold_network_source",
    network,
    """WITH e AS (SELECT p_brand AS source, 'Brand#' || (l_suppkey % 5 + 1) || (l_partkey % 6 + 1) AS target FROM lineitem JOIN part ON l_partkey = p_partkey),
    k AS (SELECT * FROM e WHERE target IN (SELECT p_brand FROM part)) SELECT DISTINCT source, target, (SELECT count(*) FROM k) AS n_edges FROM k WHERE source < 'Brand#30'""",
)


def artifact(spark, sf_dir):
    path = _fresh(spark, "artifact") + ".parquet"
    D.points(spark, sf_dir).select(F.col("id").alias("row"), "vec").write.parquet(path)
    return I.read_embeddings(spark, path).select("row", rounded(F.col("vec")[0]).alias("v0"), F.size("vec").cast("long").alias("width"))


_add("embedding_artifact", artifact, f"WITH {D.POINTS} SELECT id AS row, round(vec[1], 6) + 0.0 AS v0, len(vec) AS width FROM points")
_add(
    "indexed_view",
    lambda s, d: S.indexed_view(D.points(s, d).select(F.col("id").alias("position"), "label"), "position", D.table(s, d, "lineitem").select(F.col("l_partkey").alias("position"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k")), "k"),
    f"WITH {D.POINTS} SELECT id AS position, l_orderkey * 10 + l_linenumber AS k, label FROM points JOIN lineitem ON l_partkey = id",
)


def problems(spark, sf_dir):
    """Problems as a JSON array, read back and counted by task and grader."""
    path = _fresh(spark, "problems")
    p = D.table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("p"), F.col("item_id").cast("string")).alias("problem_id"), F.when(F.col("item_id") % 2 == 0, "clustering").otherwise("qc").alias("task_type"),
        F.when(F.col("item_id") % 3 == 0, "multiple_choice").otherwise("numeric_tolerance").alias("grader_type"), F.col("item_id").cast("string").alias("expected_answer"),
        F.lit("{}").alias("grader_config"), F.lit("{}").alias("task_config"), F.lit("x").alias("data_path"), F.col("text").alias("description"), F.lit("benchmark").alias("source"),
    )
    whole = p.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*p.columns)))).alias("value"))
    whole.coalesce(1).write.text(path)
    return I.read_problems(spark, path).groupBy("task_type", "grader_type").agg(F.count("*").alias("n"), F.sum(F.length("expected_answer")).alias("letters"))


_add(
    "problem_source",
    problems,
    "SELECT CASE WHEN item_id % 2 = 0 THEN 'clustering' ELSE 'qc' END AS task_type, CASE WHEN item_id % 3 = 0 THEN 'multiple_choice' ELSE 'numeric_tolerance' END AS grader_type, count(*) AS n, sum(length(CAST(item_id AS VARCHAR))) AS letters FROM benchmark GROUP BY 1, 2",
)
_add("rename_field", lambda s, d: P.rename_field(D.table(s, d, "nation").select("n_nationkey", "n_name"), "n_name", "cell_type"), "SELECT n_nationkey, n_name AS cell_type FROM nation")


def compactness(spark, sf_dir):
    from strandlake.functions.numeric import squared_distance
    from strandlake.operators import cells as C
    from strandlake.operators import graph as G

    p = D.points(spark, sf_dir)
    c = C.cluster_means(p)
    a = C.cluster_assignments(p, c, 5.0)
    d = p.join(F.broadcast(c), F.lit(True)).select("id", "cluster", squared_distance("vec", "centre").alias("d2"))
    apart = G.pairwise_distances(c.select(F.col("cluster").alias("id"), F.col("centre").alias("vec")))
    return T.compactness_loss(a, d, apart, 3.0).select(rounded("loss", 4).alias("loss"))


_add(
    "compactness_loss",
    compactness,
    f"""WITH {D.POINTS}, l AS (SELECT id, label, unnest(range(64)) AS k, vec FROM points), cm AS (SELECT label AS cluster, k, avg(vec[k + 1]) AS c FROM l GROUP BY 1, 2),
    dd AS (SELECT id, cluster, sum(pow(vec[l.k + 1] - c, 2)) AS d FROM l JOIN cm ON l.k = cm.k GROUP BY 1, 2), e AS (SELECT *, exp((min(d) OVER (PARTITION BY id) - d) / 5) AS z FROM dd), a AS (SELECT id, d, z / sum(z) OVER (PARTITION BY id) AS p FROM e),
    cc AS (SELECT x.cluster AS i, y.cluster AS j, round(sqrt(sum(pow(x.c - y.c, 2)) + 1e-16), 6) AS d FROM cm x JOIN cm y ON x.k = y.k AND x.cluster < y.cluster GROUP BY 1, 2)
    SELECT round((SELECT sum(p * d) FROM a) / (SELECT count(*) FROM points) + (SELECT avg(greatest(3.0 - d, 0)) FROM cc), 4) AS loss""",
)


def single_cell(spark, sf_dir):
    from strandlake.operators import cells as C

    p = D.points(spark, sf_dir)
    out = P.single_cell(D.counts(spark, sf_dir), p, C.cluster_means(p), 0.1)
    return out["normalized"].select("cell_id", "gene_id", rounded("value", 5).alias("value"))


_add(
    "single_cell_pipeline",
    single_cell,
    f"""WITH {D.COUNTS}, lib AS (SELECT cell_id, sum(value) AS lib FROM counts GROUP BY 1), g AS (SELECT gene_id, sum(value) AS g FROM counts GROUP BY 1),
    a AS (SELECT cell_id, gene_id, greatest(value - 0.1 * (g / (SELECT sum(value) FROM counts)) * lib, 0) AS value FROM counts JOIN lib USING (cell_id) JOIN g USING (gene_id)),
    m AS (SELECT cell_id, sum(value) AS lib FROM a GROUP BY 1) SELECT cell_id, gene_id, round(ln(value * (10000 / greatest(lib, 1)) + 1), 5) AS value FROM a JOIN m USING (cell_id)""",
)
_add("json_fields", lambda s, d: D.table(s, d, "nation").select("n_nationkey", F.get_json_object(F.to_json(F.struct("n_name", "n_regionkey")), "$.n_name").alias("name"), F.map_from_arrays(F.array(F.lit("r")), F.array("n_regionkey"))["r"].cast("long").alias("region")), "SELECT n_nationkey, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation")
