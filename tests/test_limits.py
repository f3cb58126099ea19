"""Rows at the limits of floating-point numbers, and forms of the pair operators that never list all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions.numeric import ieee_log
from strandlake.operators import cells as C
from strandlake.operators import embedding as E
from strandlake.operators import graph as G
from strandlake.operators import integration as I
from strandlake.operators import relational as B
from strandlake.operators import signals as X
from strandlake.plans import registry
from strandlake.streaming import windows as W

SF = "/root/testdata/sf0.001"


def events_with(spark, tmp_path, change):
    """A copy of the smallest events with changed rows."""
    change(spark.read.parquet(f"{SF}/events.parquet")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_mixture_of_a_zero_value_equals_its_sql(spark, tmp_path):
    at = events_with(spark, tmp_path, lambda e: e.withColumn("value", F.when(F.col("event_id") % 10 == 0, 0.0).otherwise(F.col("value"))))
    rows = registry.queries()["variant_quality_gmm"](spark, at).collect()
    zero = [r for r in rows if r.id % 10 == 0]
    assert len(zero) == 100 and all(r.log_density == -math.inf and math.isnan(r.r0) for r in zero)
    assert all(math.isfinite(r.log_density) and 0 <= r.r0 <= 1 for r in rows if r.id % 10)
    assert math.isnan(spark.range(1).select(ieee_log(F.lit(-1.0))).first()[0])


def test_copies_far_from_every_state(spark, tmp_path):
    t = spark.createDataFrame([(1.0,), (50.0,), (-50.0,)], "ratio double")
    got = [r.copies for r in X.copy_number_posterior(t).orderBy("ratio").collect()]
    assert abs(got[0]) < 1e-9 and abs(got[1] - 2) < 1e-9 and got[2] == 4.0
    # 1,000 events in one hour: the SQL's sums underflow.
    at = events_with(spark, tmp_path, lambda e: e.withColumn("ts", F.lit("2024-01-01 05:30:00").cast("timestamp_ntz")))
    (row,) = registry.queries()["copy_number"](spark, at).collect()
    assert row.start == 5 and math.isnan(row.copies)


@pytest.fixture(scope="module")
def cloud(spark):
    """120 points with copies and near copies, their matrix, and the rounded distances by definition."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 5)).round(2)
    x[40:70] = x[5]
    x[70:80] = x[6] + 1e-5
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2) + 1e-16), 6)
    np.fill_diagonal(d, 0)
    return spark.createDataFrame([(i, v.tolist(), i % 3, i % 2) for i, v in enumerate(x)], "id long, vec array<double>, label long, batch long"), x, d


def test_neighbours_in_blocks_equal_all_pairs(cloud):
    points, _, d = cloud
    want = {(i, r + 1): (j, e) for i in range(120) for r, (e, j) in enumerate(sorted((d[i, j], j) for j in range(120) if j != i)[:6])}
    for asked in (None, "some"):
        p = points.withColumn("some", F.col("id") % 4 == 0)
        got = {(r.i, r["rank"]): (r.j, r.d) for r in G.knn(p, 6, block_rows=31, asked=asked).collect()}
        assert got == {k: v for k, v in want.items() if not asked or k[0] % 4 == 0}


def test_block_sums_equal_all_pairs(cloud, monkeypatch):
    points, x, d = cloud
    monkeypatch.setattr(G, "BLOCK_ROWS", 40)
    monkeypatch.setattr(G, "TILE", 16)
    got = {(r.id, r.label): (r.total, r.n) for r in G.distance_sums(points, "label", 29).collect()}
    for i in range(120):
        for g in range(3):
            of = [j for j in range(120) if j % 3 == g and j != i]
            assert abs(got[i, g][0] - d[i, of].sum()) < 1e-9 and got[i, g][1] == len(of)
    inside = {(r.id, r.batch) for r in G.distance_sums(points, "batch", 29, within="label").collect()}
    assert len(inside) == 240


def test_forms_without_pairs_equal_those_with_pairs(cloud):
    points, _, d = cloud
    whole = G.symmetrize(G.fuzzy_membership(G.pairwise_distances(points), 6))
    want = {r.i: (r.w, r.n) for r in whole.groupBy("i").agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()}
    got = {r.i: (r.weight, r.n) for r in G.fuzzy_weights(points, 6).collect()}
    assert got.keys() == want.keys() and all(abs(got[i][0] - w) < 1e-9 and got[i][1] == n for i, (w, n) in want.items())
    low = G.pairwise_distances(points.select("id", F.slice("vec", 1, 2).alias("vec")))
    assert abs(E.umap_loss_of_points(points, 6).first().loss - E.umap_loss(whole, low).first().loss) < 1e-6
    v = points.select("id", F.posexplode(F.slice("vec", 1, 2)).alias("feature", "value"))
    slow = {(r.id, r.feature): r.value for r in C.diffuse(v, C.diffusion_affinity(points, 5), 2).collect()}
    fast = C.diffuse_points(points.select("id", "vec", F.col("vec")[0].alias("a"), F.col("vec")[1].alias("b")), ["a", "b"], 5, steps=2).collect()
    assert len(fast) == 120 and all(abs(r.a - slow[r.id, 0]) < 1e-9 and abs(r.b - slow[r.id, 1]) < 1e-9 for r in fast)


def test_isolated_labels_from_one_table_of_sums(cloud):
    points, _, _ = cloud
    each = [I.silhouettes(points.withColumn("two", (F.col("label") == g).cast("long")), "two").filter("two = 1").agg(F.avg((F.col("s") + 1) / 2)).first()[0] for g in range(3)]
    assert abs(I.isolated_labels(points).first()[0] - sum(each) / 3) < 1e-9


def test_molecules_by_classes_equal_those_by_rows(spark):
    rows = [(i, [[1, 2, 3, 4], [2, 1, 3, 4], [1, 2, 3, 5], [1, 2, 3], [9], []][i * 7 % 6]) for i in range(60)]
    bits = spark.createDataFrame(rows, "id long, bits array<int>")
    share = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    want = {(i, j) for i, x in rows for j, y in rows if i < j and x and y and share(x, y) >= 0.7}
    pairs = B.similar_molecules(bits, 0.7, slice_rows=3)
    got = [(r.i, r.j) for r in pairs.collect()]
    assert len(got) == len(want) and set(got) == want
    key = lambda t: {r.id: r.cluster for r in t.collect()}
    assert key(B.molecule_clusters(bits, 0.7)) == key(B.butina_clusters(bits, pairs))


def test_interval_counts_equal_the_join(spark):
    points, spans = spark.range(40).select((F.col("id") % 9).alias("p")), spark.range(20).select("id", (F.col("id") % 4).alias("a"), (F.col("id") % 4 + F.col("id") % 5).alias("b"))
    joined = B.interval_join(points, spans, "p", "a", "b", 3).groupBy("id").count().collect()
    assert {(r.id, r["count"]) for r in joined} == {(r.id, r.n) for r in B.interval_counts(points, spans, "id", "p", "a", "b", 3).collect()}


def test_appended_rows_of_a_stream_are_files(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    got = W.consume(W.first_of_each(stream), "kept", "append")
    assert got.inputFiles() and got.count() == 1000
