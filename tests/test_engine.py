import pytest
from pyspark.sql import functions as F

from strandlake.functions import order as O
from strandlake.functions import sequence as Q
from strandlake.functions import soft as S
from strandlake.operators import cells as C
from strandlake.operators import graph as G
from strandlake.operators import grading as R
from strandlake.operators import signals as X
from strandlake.operators import splitting as P
from strandlake.sources import readers as I
from strandlake.streaming import windows as W


@pytest.fixture(scope="module")
def xs(spark):
    return spark.createDataFrame([(i, (i - 10) / 3) for i in range(21)], "id long, x double")


def test_soft_predicates_approach_hard_ones(xs):
    for f in (S.greater, S.less, S.greater_equal, S.less_equal):
        rows = xs.filter("x <> 0").select(f("x", 0.0, 1e-4).alias("s"), f("x", 0.0, mode="hard").alias("h")).collect()
        assert all(abs(r.s - r.h) < 1e-6 for r in rows)
    for mode in ("smooth", "c0", "c1", "c2"):
        r = xs.select(F.min(S.sigmoidal("x", 0.2, mode)).alias("a"), F.max(S.sigmoidal("x", 0.2, mode)).alias("b")).first()
        assert 0 <= r.a < 1e-3 and 1 - 1e-3 < r.b <= 1
    with pytest.raises(ValueError):
        S.sigmoidal("x", 0.0)


def test_top_k_ties_and_bounds(spark):
    t = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 1.0), (3, 0.0)], "pos long, v double")
    on = lambda k: sorted(r.pos for r in O.top_k_mask(t, "v", k, "pos").filter("mask = 1").collect())
    assert on(2) == [1, 2] and on(0) == [] and on(9) == [0, 1, 2, 3]


def test_global_positions_equal_one_sorted_list(spark):
    t = spark.range(500).select("id", (F.col("id") * 7919 % 83).alias("v"), F.lit(2.0).alias("y"))
    got = {r.id: (r.k, r.y_sum) for r in O.global_running(t.repartition(9), [F.col("v").desc(), F.col("id")], ["y"]).collect()}
    want = sorted(((i * 7919 % 83, i) for i in range(500)), key=lambda p: (-p[0], p[1]))
    assert got == {i: (k + 1, 2.0 * (k + 1)) for k, (_, i) in enumerate(want)}
    assert O.global_running(t.limit(0), [F.col("v"), F.col("id")], ["y"]).count() == 0


def test_dna_round_trip_and_bad_letters(spark):
    t = spark.createDataFrame([(1, "ACGTN"), (2, "")], "seq_id long, sequence string")
    assert [r[0] for r in t.orderBy("seq_id").select(Q.decode_one_hot(Q.one_hot("sequence"))).collect()] == ["ACGTN", ""]
    with pytest.raises(Exception, match="not a DNA sequence"):
        spark.createDataFrame([("AXG",)], "sequence string").select(Q.one_hot("sequence")).collect()
    assert Q.kmer_dimension(4, True) == 136 and Q.kmer_features(t, 6).count() == 0


def test_zero_variance_gene_and_empty_counts(spark):
    counts = spark.createDataFrame([(1, "a", 2.0), (2, "a", 2.0), (1, "b", 4.0)], "cell_id long, gene_id string, value double")
    cells = spark.createDataFrame([(1,), (2,)], "cell_id long")
    z = {(r.cell_id, r.gene_id): r.z for r in C.standardize(counts, cells).collect()}
    assert z[1, "a"] == z[2, "a"] == 0 and abs(z[1, "b"] - 1) < 1e-9
    assert C.normalize_counts(counts.limit(0)).count() == 0


def test_knn_is_the_same_in_any_blocks(spark):
    p = spark.range(60).select("id", F.array((F.col("id") * 7 % 13).cast("double"), (F.col("id") * 5 % 11).cast("double")).alias("vec"))
    key = lambda t: sorted((r.i, r.j, r["rank"]) for r in t.collect())
    assert key(G.knn(p, 4)) == key(G.knn(p, 4, block_rows=17))


def test_sinkhorn_marginals(spark):
    cost = spark.createDataFrame([(i, j, abs(i - j) / 3) for i in range(4) for j in range(5)], "i long, j long, c double")
    plan = G.sinkhorn(cost, 0.5, 30)
    assert all(abs(r[1] - 0.25) < 1e-6 for r in plan.groupBy("i").sum("p").collect())
    assert all(abs(r[1] - 0.2) < 1e-6 for r in plan.groupBy("j").sum("p").collect())


def test_splits_cover_all_rows_and_ignore_partitions(spark):
    t = spark.range(1000)
    a = {r.id: r.split for r in P.random_split(t.repartition(7), "id").collect()}
    b = {r.id: r.split for r in P.random_split(t.coalesce(1), "id").collect()}
    assert a == b and len(a) == 1000 and sorted(map(list(a.values()).count, ("train", "valid", "test"))) == [100, 100, 800]


def test_controls_of_small_and_missing_pools(spark):
    obs = spark.createDataFrame([(1, "T", 0, "p"), (2, "T", 0, "non-targeting"), (3, "B", 0, "p"), (4, "T", 1, "p")], "cell_id long, cell_type string, batch long, perturbation string")
    got = {(r.cell_id, r.slot): r.control_id for r in P.control_mapping(obs, 2, by_batch=True).collect()}
    assert got == {(1, 0): 2, (1, 1): 2, (3, 0): -1, (3, 1): -1, (4, 0): 2, (4, 1): 2}


def test_controls_of_a_large_pool_do_not_repeat(spark):
    obs = spark.range(60).select(F.col("id").alias("cell_id"), F.lit("T").alias("cell_type"), F.lit(0).alias("batch"), F.when(F.col("id") < 20, "non-targeting").otherwise("p").alias("perturbation"))
    rows = P.control_mapping(obs, 5).groupBy("cell_id").agg(F.countDistinct("control_id").alias("n")).collect()
    assert len(rows) == 40 and all(r.n == 5 for r in rows)


def test_alignment_of_ids_reports_differences(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    with pytest.raises(ValueError, match=r"missing \[3\]"):
        P.align_to_reference(a, spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "id long, position long"), "id", "position")


def test_auroc_with_ties_is_the_pair_share(spark):
    rows = [(i, float(i * 7 % 5), i % 3 == 0) for i in range(60)]
    t = spark.createDataFrame([(a, b, int(c)) for a, b, c in rows], "id long, s double, y int")
    pairs = [(p[1], n[1]) for p in rows if p[2] for n in rows if not n[2]]
    want = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    assert abs(R.auroc(t, "s", "y").first()[0] - want) < 1e-12


def test_unbalanced_brackets_raise(spark):
    with pytest.raises(Exception, match="unbalanced"):
        R.bracket_pairs(spark.createDataFrame([(1, "(()")], "seq_id long, structure string")).collect()


def test_hard_quality_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, 30.0)], "read_id long, quality double").write.parquet(str(tmp_path / "r"))
    plan = X.quality_filter(spark.read.parquet(str(tmp_path / "r")), 20.0, mode="hard")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(quality), GreaterThan(quality,20.0)]" in plan


def test_fasta_records(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first one\nACG\nTNN\n>s2\nacgt\n")
    rows = [tuple(r) for r in I.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("sequence_id").collect()]
    assert rows == [("s1", "first one", "ACGTNN"), ("s2", "", "ACGT")]


def test_streams_equal_their_batch_twins(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    got = W.consume(W.tumbling_counts(stream), "twin")
    key = lambda t: sorted((str(r.start), r.event_type, r.n) for r in t.collect())
    assert key(got) == key(W.tumbling_counts(events))


def test_nothing_but_the_entry_imports_the_llm_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "strandlake"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "strandlake.llm" in p.read_text()]


def test_entry_works_without_the_training_data_operators(tmp_path):
    """In a copy without the two llm folders, with and without the pipeline's file."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    say = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); e.oracle_sql()"
    for gone in (None, "corpus_pipeline.py"):
        if gone:
            (copy / gone).unlink(missing_ok=True)
        subprocess.run([sys.executable, "-c", say], cwd=copy, check=True, timeout=120)
