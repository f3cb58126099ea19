"""Metrics of batch integration and of clusterings, from neighbour tables and distance sums; evaluation of answers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.operators import graph as G


def silhouettes(points: DataFrame, by: str, sums: DataFrame | None = None) -> DataFrame:
    """(id, by, s): (b - a) / max(a, b) with a the mean distance to the own group's others and b to the nearest other group; 0 for singletons. sums: distance_sums, if known."""
    sums = (G.distance_sums(points, by) if sums is None else sums).withColumnRenamed(by, "other")
    own = points.select("id", F.col(by).cast("long").alias(by))
    per = sums.filter("n > 0").join(own, "id").withColumn("m", F.col("total") / F.col("n"))
    mine = F.max(F.when(F.col("other") == F.col(by), F.col("m")))
    theirs = F.min(F.when(F.col("other") != F.col(by), F.col("m")))
    ab = per.groupBy("id", by).agg(mine.alias("a"), theirs.alias("b"))
    return ab.select("id", by, F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0)).alias("s"))


def silhouette_label(points: DataFrame, label: str = "label", sums: DataFrame | None = None) -> DataFrame:
    """One row: the mean silhouette of labels, scaled to 0..1."""
    return silhouettes(points, label, sums).agg(F.avg((F.col("s") + 1) / 2).alias("silhouette_label"))


def _coded(points: DataFrame, label: str, batch: str) -> DataFrame:
    """Label and batch as one code g, whose millions are the label."""
    return points.withColumn("g", F.col(label).cast("long") * 1_000_000 + F.col(batch).cast("long"))


def silhouette_batch(points: DataFrame, label: str = "label", batch: str = "batch", sums: DataFrame | None = None) -> DataFrame:
    """One row: the mean over labels of 1 - |silhouette of batches within the label|.

    Batches of one label are compared with each other only: label and batch are coded together, and other labels' rows
    are left out of the distances. sums: distance_sums of all those codes, if known.
    """
    codes = _coded(points, label, batch)
    sums = (G.distance_sums(codes, "g", within=label) if sums is None else sums).filter("n > 0")
    own = codes.select("id", F.col(label).cast("long").alias("l"), F.col("g").alias("mine"))
    near = sums.join(own, "id").filter(F.floor(F.col("g") / 1_000_000) == F.col("l")).withColumn("m", F.col("total") / F.col("n"))
    a, b = F.max(F.when(F.col("g") == F.col("mine"), F.col("m"))), F.min(F.when(F.col("g") != F.col("mine"), F.col("m")))
    each = near.groupBy("id", "l").agg(a.alias("a"), b.alias("b")).filter("b is not null")
    s = F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0))
    return each.groupBy("l").agg(F.avg(1 - F.abs(s)).alias("v")).agg(F.avg("v").alias("silhouette_batch"))


def lisi(neighbours: DataFrame, codes: DataFrame, by: str) -> DataFrame:
    """(i, lisi): inverse Simpson index of the neighbours' codes, every neighbour counting alike."""
    seen = neighbours.join(codes.select(F.col("id").alias("j"), F.col(by).alias("c")), "j").groupBy("i", "c").agg(F.count("*").alias("n"))
    n = F.sum("n")
    return seen.groupBy("i").agg((n * n / F.sum(F.col("n") * F.col("n"))).alias("lisi"))


def lisi_scores(neighbours: DataFrame, codes: DataFrame, label: str = "label", batch: str = "batch") -> DataFrame:
    """One row: ilisi (batches mix: 1) and clisi (labels stay apart: 1), from the median index."""
    sizes = codes.agg(F.countDistinct(label).alias("l"), F.countDistinct(batch).alias("b"))
    mid = lambda by: lisi(neighbours, codes, by).agg(F.median("lisi").alias(by))
    both = mid(batch).withColumnRenamed(batch, "mb").join(mid(label).withColumnRenamed(label, "ml"), F.lit(True)).join(sizes, F.lit(True))
    return both.select(((F.col("mb") - 1) / F.greatest(F.col("b") - 1, F.lit(1))).alias("ilisi"), ((F.col("l") - F.col("ml")) / F.greatest(F.col("l") - 1, F.lit(1))).alias("clisi"))


def graph_connectivity(neighbours: DataFrame, codes: DataFrame, label: str = "label") -> DataFrame:
    """One row: the mean over labels of the share of its cells in the label's largest component of the neighbour graph."""
    l_of = lambda c: codes.select(F.col("id").alias(c), F.col(label).alias(f"l{c}"))
    inside = neighbours.select("i", "j").join(l_of("i"), "i").join(l_of("j"), "j").filter("li = lj").select("i", "j")
    found = codes.select(F.col("id").alias("node"), F.col(label).alias("l")).join(G.components(inside), "node", "left").withColumn("label", F.coalesce("label", "node"))
    parts = found.groupBy("l", "label").agg(F.count("*").alias("n"))
    return parts.groupBy("l").agg((F.max("n") / F.sum("n")).alias("v")).agg(F.avg("v").alias("graph_connectivity"))


def contingency_scores(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: nmi (arithmetic mean of the entropies) and ari of two labelings."""
    cells = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    cells = cells.withColumns({"ra": F.sum("n").over(Window.partitionBy("a")), "rb": F.sum("n").over(Window.partitionBy("b"))})
    total = F.broadcast(rows.agg(F.count("*").alias("t")))
    c = cells.join(total, F.lit(True))
    n, ra, rb, t = (F.col(x).cast("double") for x in ("n", "ra", "rb", "t"))
    pairs = lambda x: x * (x - 1) / 2
    sums = c.agg(
        F.sum(n / t * F.log(n * t / (ra * rb))).alias("mi"), (-F.sum(n / t * F.log(ra / t))).alias("ha"), (-F.sum(n / t * F.log(rb / t))).alias("hb"),
        F.sum(pairs(n)).alias("both"), F.max(pairs(t)).alias("all"), F.sum(n * (ra - 1) / 2).alias("in_a"), F.sum(n * (rb - 1) / 2).alias("in_b"),
    )
    chance = F.col("in_a") * F.col("in_b") / F.col("all")
    top = (F.col("in_a") + F.col("in_b")) / 2
    ari = F.when(top == chance, 1.0).otherwise((F.col("both") - chance) / (top - chance))
    mean = (F.col("ha") + F.col("hb")) / 2
    return sums.select(F.when(mean == 0, 1.0).otherwise(F.col("mi") / mean).alias("nmi"), ari.alias("ari"))


def chi_square_critical(df: int, alpha: float = 0.05) -> float:
    """The value that a chi-square variable of `df` degrees exceeds with chance alpha, by bisection of its series."""

    def tail(x):
        a, z = df / 2, x / 2
        term = total = math.exp(a * math.log(z) - z - math.lgamma(a + 1)) if z > 0 else 0.0
        k = 1
        while term > 1e-16 * max(total, 1e-300):
            term *= z / (a + k)
            total += term
            k += 1
        return 1 - total

    low, high = 0.0, 1000.0 + 10 * df
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > alpha else (low, mid)
    return (low + high) / 2


def kbet(neighbours: DataFrame, codes: DataFrame, label: str = "label", batch: str = "batch", alpha: float = 0.05) -> DataFrame:
    """One row: the mean over labels of the share of cells whose neighbours' batches pass a chi-square test against the label's batch shares."""
    l_of = lambda c: codes.select(F.col("id").alias(c), F.col(label).alias(f"l{c}"), F.col(batch).alias(f"b{c}"))
    inside = neighbours.join(l_of("i"), "i").join(l_of("j"), "j").filter("li = lj")
    shares = codes.groupBy(F.col(label).alias("li"), F.col(batch).alias("b")).agg(F.count("*").alias("m")).withColumn("share", F.col("m") / F.sum("m").over(Window.partitionBy("li")))
    seen = inside.groupBy("i", F.col("bj").alias("b")).agg(F.count("*").alias("o"))
    each = inside.groupBy("i", "li").agg(F.count("*").alias("k")).join(F.broadcast(shares), "li").join(seen, ["i", "b"], "left")
    expected = F.col("k") * F.col("share")
    stat = each.groupBy("i", "li").agg(F.sum(F.pow(F.coalesce("o", F.lit(0)) - expected, F.lit(2.0)) / expected).alias("x"))
    df = max(codes.select(batch).distinct().count() - 1, 1)
    passed = (F.col("x") <= chi_square_critical(df, alpha)).cast("double")
    return stat.groupBy("li").agg(F.avg(passed).alias("v")).agg(F.avg("v").alias("kbet"))


def isolated_labels(points: DataFrame, label: str = "label", batch: str = "batch", sums: DataFrame | None = None) -> DataFrame:
    """One row: the mean scaled silhouette, against all other cells, of the labels that the fewest batches hold.

    One table of distance sums by label, `sums` if known, serves every label: all other cells are the other labels' sums.
    """
    held = points.groupBy(label).agg(F.countDistinct(batch).alias("b"))
    names = held.join(F.broadcast(held.agg(F.min("b").alias("least"))), F.col("b") == F.col("least")).select(F.col(label).cast("long").alias("own"))
    sums = (G.distance_sums(points, label) if sums is None else sums).select("id", F.col(label).alias("other"), "total", "n")
    own = points.select("id", F.col(label).cast("long").alias("own")).join(F.broadcast(names), "own")
    per = sums.filter("n > 0").join(own, "id").groupBy("id", "own", (F.col("other") == F.col("own")).alias("inside")).agg((F.sum("total") / F.sum("n")).alias("m"))
    ab = per.groupBy("id", "own").agg(F.max(F.when(F.col("inside"), F.col("m"))).alias("a"), F.max(F.when(~F.col("inside"), F.col("m"))).alias("b"))
    s = F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0))
    return ab.groupBy("own").agg(F.avg((s + 1) / 2).alias("v")).agg(F.avg("v").alias("isolated_labels"))


def integration_suite(points: DataFrame, clusters: DataFrame, k: int = 15, label: str = "label", batch: str = "batch") -> DataFrame:
    """One row of all metrics and the scores: bio and batch means, and 0.6 bio + 0.4 batch. clusters: (id, cluster) of the corrected points."""
    from strandlake.session import cut_lineage

    near, codes = cut_lineage(G.knn(points.select("id", "vec"), k)), points.select("id", label, batch)
    named = codes.join(clusters.select("id", "cluster"), "id")
    # One pass over all pairs serves the three silhouettes.
    sums = cut_lineage(G.distance_sums(_coded(points, label, batch), "g"))
    by_label = sums.groupBy("id", F.floor(F.col("g") / 1_000_000).alias(label)).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    parts = [
        silhouette_label(points, label, by_label), silhouette_batch(points, label, batch, sums), contingency_scores(named, label, "cluster").select(F.col("nmi").alias("nmi_kmeans"), F.col("ari").alias("ari_kmeans")),
        lisi_scores(near, codes, label, batch), graph_connectivity(near, codes, label), isolated_labels(points, label, batch, by_label), kbet(near, codes, label, batch),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, F.lit(True))
    mean = lambda names: sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)
    bio = mean(["silhouette_label", "nmi_kmeans", "ari_kmeans", "clisi", "isolated_labels"])
    mixed = mean(["silhouette_batch", "ilisi", "graph_connectivity"])
    out = out.withColumns({"bio_score": bio, "batch_score": mixed})
    return out.withColumn("aggregate_score", 0.6 * F.col("bio_score") + 0.4 * F.col("batch_score"))


def calinski_harabasz(points: DataFrame, by: str) -> DataFrame:
    """One row: between-group over within-group variance, each by its degrees of freedom."""
    long = points.select("id", F.col(by).alias("g"), F.posexplode("vec").alias("k", "v"))
    per = long.groupBy("g", "k").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s2"), F.count("*").alias("n"))
    whole = long.groupBy("k").agg(F.avg("v").alias("mean"))
    c = per.join(F.broadcast(whole), "k").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), F.lit(2.0))).alias("between"), F.sum(F.col("n") * F.col("s2")).alias("within"), F.countDistinct("g").alias("groups"))
    n = F.broadcast(points.agg(F.count("*").alias("n")))
    return c.join(n, F.lit(True)).select((F.col("between") / (F.col("groups") - 1) / (F.col("within") / (F.col("n") - F.col("groups")))).alias("calinski_harabasz"))


def batch_divergence(points: DataFrame, batch: str = "batch") -> DataFrame:
    """One row: Kullback-Leibler divergence of the softmaxed mean vectors of the first two batches."""
    two = points.select(batch).distinct().orderBy(batch).limit(2).withColumn("r", F.row_number().over(Window.orderBy(batch)))
    means = points.select(batch, F.posexplode("vec").alias("k", "v")).join(F.broadcast(two), batch).groupBy("r", "k").agg(F.avg("v").alias("m"))
    w = Window.partitionBy("r")
    e = means.withColumn("e", F.exp(F.col("m") - F.max("m").over(w))).withColumn("p", F.col("e") / F.sum("e").over(w))
    wide = e.groupBy("k").agg(F.max(F.when(F.col("r") == 1, F.col("p"))).alias("p"), F.max(F.when(F.col("r") == 2, F.col("p"))).alias("q"))
    return wide.agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"))


def q3_metrics(rows: DataFrame, predicted: str, truth: str) -> DataFrame:
    """One row: accuracy over all residues and by class (0 coil, 1 helix, 2 strand); 0 for absent classes."""
    right = (F.col(predicted) == F.col(truth)).cast("double")
    per = lambda k: F.coalesce(F.avg(F.when(F.col(truth) == k, right)), F.lit(0.0))
    return rows.agg(F.coalesce(F.avg(right), F.lit(0.0)).alias("q3_overall"), per(1).alias("q3_helix"), per(2).alias("q3_strand"), per(0).alias("q3_coil"))


def chromatin_state_accuracy(rows: DataFrame, logits: str, truth: str) -> DataFrame:
    """One row: the share of positions whose greatest logit (the first of equals) is the true state."""
    called = F.array_position(F.col(logits), F.array_max(logits)) - 1
    return rows.agg(F.avg((called == F.col(truth)).cast("double")).alias("accuracy"))


def consistency_score(loss: DataFrame, column: str = "loss") -> DataFrame:
    """A guidance loss as a score that is higher for better: 1 / (1 + loss)."""
    return loss.select((1.0 / (1.0 + F.col(column))).alias("consistency"))


# Answers and evaluation
def grader_answer(output: DataFrame, task: str) -> DataFrame:
    """One row (answer string): what an operator's table says, in the form that a grader takes.

    qc_filtering: cells of weight above 0.5; clustering: share of each label; differential_expression: 20 genes of the
    greatest absolute fold change (ties by name); batch_correction and normalization: mean value; trajectory: greatest
    pseudotime; spatial_analysis: the labels; cell_annotation: the most frequent label (ties by name).
    """
    text = lambda c: c.cast("string").alias("answer")
    if task == "qc_filtering":
        return output.agg(text(F.sum((F.col("weight") > 0.5).cast("long"))))
    if task == "clustering":
        n = output.groupBy(F.col("label").cast("string").alias("label")).agg(F.count("*").alias("n"))
        share = F.round(F.col("n") / F.col("t"), 6).cast("string")
        s = n.join(n.agg(F.sum("n").alias("t")), F.lit(True)).agg(F.array_sort(F.collect_list(F.concat_ws(":", "label", share))).alias("all"))
        return s.select(F.concat_ws(",", "all").alias("answer"))
    if task == "differential_expression":
        top = output.orderBy(F.abs("lfc").desc(), "gene_id").limit(20)
        s = top.agg(F.array_sort(F.collect_list(F.struct((-F.abs("lfc")).alias("k"), F.col("gene_id").alias("g")))).alias("all"))
        return s.select(F.concat_ws(",", F.transform("all", lambda x: x["g"])).alias("answer"))
    if task in ("batch_correction", "normalization"):
        return output.agg(text(F.round(F.avg("value"), 6)))
    if task == "trajectory":
        return output.agg(text(F.round(F.max("pseudotime"), 6)))
    if task == "spatial_analysis":
        return output.agg(F.concat_ws(",", F.array_sort(F.collect_set(F.col("label").cast("string")))).alias("answer"))
    if task == "cell_annotation":
        n = output.groupBy(F.col("label").cast("string").alias("label")).agg(F.count("*").alias("n"))
        return n.agg(F.max_by("label", F.struct("n", F.expr("-ascii(label)"))).alias("answer"))
    raise ValueError(f"unknown task {task}")


def quality_metrics(task: str, points: DataFrame, by: str = "label", batch: str = "batch") -> DataFrame | None:
    """One row of quality metrics that suit a task; None for tasks without any."""
    if task in ("clustering", "cell_annotation"):
        return silhouettes(points, by).agg(F.avg("s").alias("silhouette")).join(calinski_harabasz(points, by), F.lit(True))
    if task == "batch_correction":
        return batch_divergence(points, batch)
    return None


def run_benchmark(problems: DataFrame, solvers: dict, graders: dict) -> DataFrame:
    """(problem_id, task_type, grader_type, answer, passed, score, error): every problem solved and graded.

    solvers: task -> function of no arguments that returns a table with one row (answer); graders: grader type -> function
    of (answer, expected) columns that returns a struct (passed, score). A task whose solver raises is an error of all its
    problems, as is a task or grader that nobody knows; others go on.
    """
    spark: SparkSession = problems.sparkSession
    found = []
    for (task,) in problems.select("task_type").distinct().orderBy("task_type").collect():
        try:
            found.append((task, str(solvers[task]().first()[0]), None))
        except Exception as e:  # noqa: BLE001
            found.append((task, None, f"solve error: {type(e).__name__}"))
    answers = spark.createDataFrame(found, "task_type string, answer string, solve_error string")
    rows = problems.join(F.broadcast(answers), "task_type")
    grade, known = F.lit(None).cast("struct<passed:boolean,score:double>"), F.lit(False)
    for name, grader in graders.items():
        made = grader(F.col("answer"), F.col("expected_answer"))
        grade = F.when(F.col("grader_type") == name, F.struct(made["passed"].cast("boolean").alias("passed"), made["score"].cast("double").alias("score"))).otherwise(grade)
        known = known | (F.col("grader_type") == name)
    error = F.when(F.col("solve_error").isNotNull(), F.col("solve_error")).when(~known, "grading error: unknown grader").when(grade["score"].isNull(), "grading error: no score")
    graded = rows.withColumns({"error": error, "grade": grade})
    ok = F.col("error").isNull()
    return graded.select(
        "problem_id", "task_type", "grader_type", "answer", F.when(ok, F.col("grade.passed")).otherwise(False).alias("passed"), F.when(ok, F.col("grade.score")).otherwise(0.0).alias("score"), "error"
    )
