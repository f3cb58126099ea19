"""Graders, classification, ranking, calibration, network, structure and alignment metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.order import global_running
from strandlake.functions.soft import col, logistic, safe_div


def numeric_tolerance(predicted, truth, tolerance: float, mode: str = "absolute") -> tuple[Column, Column]:
    """(passed, score) of a number: within an absolute or relative tolerance, or on the right side of a bound."""
    p, t = col(predicted), col(truth)
    if mode == "min":
        passed = p >= t
        score = F.when(passed, 1.0).when(t == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p / F.nullif(t, F.lit(0.0)))))
        return passed, score
    if mode == "max":
        passed = p <= t
        score = F.when(passed, 1.0).when(p == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t / F.nullif(p, F.lit(0.0)))))
        return passed, score
    error = F.abs(p - t) if mode == "absolute" else F.abs(p - t) / F.greatest(F.abs(t), F.lit(1e-10))
    return error <= tolerance, F.greatest(F.lit(0.0), 1.0 - error / F.lit(max(tolerance, 1e-10)))


def multiple_choice(predicted, truth) -> Column:
    return F.upper(F.trim(F.col(predicted))) == F.upper(F.trim(F.col(truth)))


def label_jaccard(predicted, truth, threshold: float = 0.5) -> tuple[Column, Column]:
    """(passed, score) of two sets as arrays; both empty pass."""
    p, t = F.array_distinct(F.col(predicted)), F.array_distinct(F.col(truth))
    union = F.size(F.array_union(p, t))
    score = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(p, t)) / union)
    return score >= threshold, score


def marker_precision_recall(answers: DataFrame, k: int | None = None) -> DataFrame:
    """(id, precision, recall, f1, passed) of ranked gene lists: columns id, predicted and truth arrays."""
    size = F.lit(k) if k else F.size("truth")
    hits = F.size(F.array_intersect(F.array_distinct(F.slice("predicted", F.lit(1), size)), F.array_distinct("truth")))
    p, r = safe_div(hits, size.cast("double")), safe_div(hits, F.size(F.array_distinct("truth")).cast("double"))
    f1 = safe_div(2 * p * r, p + r)
    return answers.select("id", p.alias("precision"), r.alias("recall"), f1.alias("f1"), (p >= 0.5).alias("passed"))


def distribution_comparison(predicted: DataFrame, truth: DataFrame, key: str, category: str, share: str, tolerance: float = 0.1) -> DataFrame:
    """(key, score, passed): share of categories of either side whose shares agree within the tolerance."""
    both = predicted.select(key, category, F.col(share).alias("p")).join(truth.select(key, category, F.col(share).alias("t")), [key, category], "full")
    ok = (F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("t", F.lit(0.0))) <= tolerance).cast("double")
    return both.groupBy(key).agg(F.avg(ok).alias("score")).withColumn("passed", F.col("score") >= 0.8)


def summarize(results: DataFrame, task: str = "task_type") -> DataFrame:
    """Counts and pass rate by task: failed are those neither passed nor in error."""
    error = F.col("error").isNotNull()
    return results.groupBy(task).agg(
        F.count("*").alias("total"),
        F.sum(F.col("passed").cast("long")).alias("passed"),
        F.sum(error.cast("long")).alias("errored"),
        F.sum((~F.col("passed") & ~error).cast("long")).alias("failed"),
        F.avg(F.col("passed").cast("double")).alias("pass_rate"),
    )


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, tp, fp, fn) for every label of either side."""
    t = rows.groupBy(F.col(truth).alias("label")).agg(F.count("*").alias("n_true"), F.sum((F.col(truth) == F.col(predicted)).cast("long")).alias("tp"))
    p = rows.groupBy(F.col(predicted).alias("label")).agg(F.count("*").alias("n_pred"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return t.join(p, "label", "full").select("label", z("tp").alias("tp"), (z("n_pred") - z("tp")).alias("fp"), (z("n_true") - z("tp")).alias("fn"))


def per_class_f1(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    c = confusion(rows, truth, predicted)
    return c.select("label", safe_div(2.0 * F.col("tp"), (2.0 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def classification_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: accuracy, and macro-F1 over the truth's labels only."""
    f = per_class_f1(rows, truth, predicted).filter("support > 0").agg(F.avg("f1").alias("macro_f1"))
    a = rows.agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))
    return a.join(f, F.lit(True))


def mask_metrics(rows: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Precision, recall, F1 and Jaccard of boolean masks; 0 where nothing is to be divided."""
    p, t = F.col(predicted), F.col(truth)
    n = rows.agg(*[F.sum(c.cast("double")).alias(k) for k, c in {"tp": p & t, "fp": p & ~t, "fn": ~p & t}.items()])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select(
        safe_div(tp, tp + fp).alias("precision"), safe_div(tp, tp + fn).alias("recall"), safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"), safe_div(tp, tp + fp + fn).alias("jaccard")
    )


def auroc(rows: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve from ranks, ties averaged. Scores are counted first, so equal ones travel as one row."""
    by = by or []
    s = rows.groupBy(*by, F.col(score).alias("s")).agg(F.sum((F.col(label) == 1).cast("double")).alias("pos"), F.count("*").cast("double").alias("n"))
    if by:
        w = Window.partitionBy(*by).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
        r = s.withColumn("rank", F.coalesce(F.sum("n").over(w), F.lit(0.0)) + (F.col("n") + 1) / 2)
    else:
        r = global_running(s, [F.col("s")], ["n"]).withColumn("rank", F.col("n_sum") - F.col("n") + (F.col("n") + 1) / 2)
    pos = F.sum("pos")
    neg = F.sum("n") - pos
    area = safe_div(F.sum(F.col("pos") * F.col("rank")) - pos * (pos + 1) / 2, pos * neg)
    return r.groupBy(*by).agg(area.alias("auroc"))


def soft_auroc(rows: DataFrame, key: str, score: str, label: str, temperature: float = 0.1) -> DataFrame:
    """Mean logistic of score differences over positive-negative pairs, both sides first folded to distinct scores.

    The logistic is 0 or 1 to machine precision beyond 40 temperatures. Scores go into bins of that width: only equal and
    neighbouring bins meet pair by pair, pairs of bins further apart count as right or wrong by running totals of the bins.
    """
    width = 40.0 * temperature
    folded = rows.groupBy(F.col(score).alias("s")).agg(F.sum((F.col(label) == 1).cast("double")).alias("p"), F.sum((F.col(label) == 0).cast("double")).alias("q"))
    folded = folded.withColumn("bin", F.floor(F.col("s") / width))
    pos = folded.filter("p > 0").select("s", "p", "bin")
    neg = folded.filter("q > 0").select(F.col("s").alias("t"), "q", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    near = pos.join(neg, "bin").agg(F.sum(F.col("p") * F.col("q") * logistic((F.col("s") - F.col("t")) / temperature)).alias("near"))
    bins = global_running(folded.groupBy("bin").agg(F.sum("p").alias("p"), F.sum("q").alias("q")), [F.col("bin")], ["q"])
    below = bins.select(F.col("bin").alias("b"), F.col("q_sum").alias("upto"), F.col("q").alias("own"))
    # Negatives of all bins before the neighbouring one.
    before = bins.join(below.select((F.col("b") + 1).alias("bin"), F.col("own").alias("beside")), "bin", "left")
    far = before.agg(F.sum(F.col("p") * (F.col("q_sum") - F.col("q") - F.coalesce("beside", F.lit(0.0)))).alias("far"), (F.sum("p") * F.sum("q")).alias("all"))
    return near.join(far, F.lit(True)).select(((F.coalesce("near", F.lit(0.0)) + F.col("far")) / F.col("all")).alias("auroc"))


def precision_recall_area(rows: DataFrame, key: str, score: str, label: str) -> DataFrame:
    """Average precision and trapezoid area under precision-recall, by falling score with ties broken by id."""
    y = (F.col(label) == 1).cast("double")
    total = rows.agg(F.sum(y).alias("total"))
    c = global_running(rows.select(key, score, y.alias("y")), [F.col(score).desc(), F.col(key)], ["y"]).join(F.broadcast(total), F.lit(True))
    tp, k, before = F.col("y_sum"), F.col("k"), F.col("y_sum") - F.col("y")
    p, p0 = tp / k, F.when(k > 1, before / F.greatest(k - 1, F.lit(1))).otherwise(1.0)
    step = F.col("y") / F.col("total")
    return c.agg(F.sum(step * p).alias("average_precision"), F.sum(step * (p + p0) / 2).alias("auprc"))


def early_precision_ratio(rows: DataFrame, key: str, score: str, label: str) -> DataFrame:
    """Precision among the k best, k being the number of positives, over the share of positives."""
    n = rows.agg(F.count("*").alias("n"), F.sum((F.col(label) == 1).cast("long")).alias("k"))
    placed = global_running(rows, [F.col(score).desc(), F.col(key)], position="place")
    c = placed.join(F.broadcast(n), F.lit(True)).filter("place <= k")
    return c.groupBy("n", "k").agg(F.avg((F.col(label) == 1).cast("double")).alias("p")).select((F.col("p") / (F.col("k") / F.col("n"))).alias("epr"))


def regression_metrics(rows: DataFrame, key: str, target: str, predicted: str) -> DataFrame:
    """RMSE, Pearson, and Spearman on ordinal ranks (ties broken by id)."""
    r = global_running(rows.select(key, target, predicted), [F.col(target), F.col(key)], position="rt")
    r = global_running(r, [F.col(predicted), F.col(key)], position="rp").withColumns({"rt": F.col("rt").cast("double"), "rp": F.col("rp").cast("double")})
    e = F.col(predicted) - F.col(target)
    return r.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.corr(target, predicted).alias("pearson"), F.corr("rt", "rp").alias("spearman"))


def calibration_metrics(rows: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error of logistic(score) over equal bins, the last one closed."""
    p = rows.select(logistic(F.col(score)).alias("p"), F.col(label).cast("double").alias("y"))
    b = p.withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)))
    g = b.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mp"), F.avg("y").alias("my"), F.sum((F.col("p") - F.col("y")) ** 2).alias("se"))
    n = F.sum("n")
    return g.agg((F.sum("se") / n).alias("brier"), (F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / n).alias("ece"))


def ranking_metrics(rows: DataFrame, key: str, group: str, score: str, label: str, ks=(1, 5)) -> DataFrame:
    """Mean reciprocal rank (0 for groups without a positive) and the share of groups with a hit among the k best."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(key)))
    best = rows.withColumn("place", place).groupBy(group).agg(F.min(F.when(F.col(label) == 1, F.col("place"))).alias("best"))
    hits = [F.avg((F.coalesce("best", F.lit(1 << 30)) <= k).cast("double")).alias(f"recall_at_{k}") for k in ks]
    return best.agg(F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0))).alias("mrr"), *hits)


def bracket_pairs(structures: DataFrame, key: str = "seq_id", text: str = "structure") -> DataFrame:
    """(key, i, j): matching brackets of dot-bracket strings, 0-based, by running depth; unbalanced ones raise."""
    t = F.col(text)
    letters = structures.select(key, F.posexplode(F.filter(F.split(t, ""), lambda c: c != "")).alias("pos", "c"))
    w = Window.partitionBy(key).orderBy("pos")
    step = F.when(F.col("c") == "(", 1).when(F.col("c") == ")", -1).otherwise(0)
    d = letters.withColumn("s", step).withColumn("depth", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    level = F.when(F.col("c") == "(", F.col("depth")).otherwise(F.col("depth") + 1)
    b = d.filter(F.col("s") != 0).withColumn("level", level)
    m = b.withColumn("order", F.row_number().over(Window.partitionBy(key, "level").orderBy("pos")))
    pair = m.groupBy(key, "level", F.floor((F.col("order") - 1) / 2).alias("nth")).agg(
        F.min(F.when(F.col("c") == "(", F.col("pos"))).alias("i"), F.max(F.when(F.col("c") == ")", F.col("pos"))).alias("j")
    )
    ok = F.col("i").isNotNull() & F.col("j").isNotNull() & (F.col("i") < F.col("j"))
    return pair.select(key, F.when(ok, F.col("i")).otherwise(F.raise_error(F.lit("unbalanced structure")).cast("int")).alias("i"), "j")


def pair_metrics(predicted: DataFrame, truth: DataFrame, key: str = "seq_id") -> DataFrame:
    """Sensitivity, positive predictive value and F1 of base pairs by sequence."""
    p = predicted.select(key, "i", "j").distinct().withColumn("p", F.lit(1))
    t = truth.select(key, "i", "j").distinct().withColumn("t", F.lit(1))
    both = p.join(t, [key, "i", "j"], "full")
    n = both.groupBy(key).agg(F.count("p").alias("np"), F.count("t").alias("nt"), F.sum((F.col("p").isNotNull() & F.col("t").isNotNull()).cast("double")).alias("tp"))
    s, v = safe_div(F.col("tp"), F.col("nt")), safe_div(F.col("tp"), F.col("np"))
    return n.select(key, s.alias("sensitivity"), v.alias("ppv"), safe_div(2 * s * v, s + v).alias("f1"))


def aligned_residues(rows: DataFrame, family: str = "family", name: str = "name", text: str = "aligned") -> DataFrame:
    """(family, name, column, residue): upper-case residues of alignment rows; every letter advances the residue number."""
    letters = rows.select(family, name, F.posexplode(F.filter(F.split(F.col(text), ""), lambda c: c != "")).alias("column", "c"))
    w = Window.partitionBy(family, name).orderBy("column").rowsBetween(Window.unboundedPreceding, 0)
    numbered = letters.withColumn("residue", F.sum(F.col("c").rlike("[A-Za-z]").cast("long")).over(w))
    return numbered.filter(F.col("c").rlike("[A-Z]")).select(family, name, "column", "residue")


def alignment_scores(predicted: DataFrame, reference: DataFrame, family: str = "family") -> DataFrame:
    """(family, sp, tc): share of the reference's residue pairs, and of its columns, that the prediction keeps."""

    def pairs(rows):
        r = aligned_residues(rows, family)
        other = r.select(family, "column", F.col("name").alias("name2"), F.col("residue").alias("residue2"))
        return r.join(other, [family, "column"]).filter(F.col("name") < F.col("name2"))

    ref, got = pairs(reference), pairs(predicted).withColumnRenamed("column", "at")
    m = ref.join(got, [family, "name", "residue", "name2", "residue2"], "left")
    by_column = m.groupBy(family, "column").agg(F.count("*").alias("n"), F.count("at").alias("hit"), F.countDistinct("at").alias("cols"))
    whole = ((F.col("n") == F.col("hit")) & (F.col("cols") == 1)).cast("double")
    return by_column.groupBy(family).agg((F.sum("hit") / F.sum("n")).alias("sp"), F.avg(whole).alias("tc"))
