"""Ranks, top-k, quantiles and their soft forms, over groups of rows (windows) or over array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.numeric import array_softmax, array_sum
from strandlake.functions.soft import col


def top_k_mask(rows: DataFrame, value: str, k: int, pos: str, by: list[str] | None = None, name: str = "mask") -> DataFrame:
    """A column of ones for the k greatest values of each group, zeros else; ties at the boundary favour later places."""
    order = [F.col(value).desc(), F.col(pos).desc()]
    if not by:
        return global_running(rows, order, position="__k").withColumn(name, (F.col("__k") <= k).cast("double")).drop("__k")
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) <= k).cast("double"))


def top_k(rows: DataFrame, value: str, k: int, pos: str, by: list[str] | None = None) -> DataFrame:
    """The k greatest rows of each group, numbered from 1 in column rank; ties keep the order of `pos`."""
    by = by or []
    if not by:
        best = rows.orderBy(F.col(value).desc(), F.col(pos)).limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col(value).desc(), F.col(pos))))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).desc(), F.col(pos)))
    return rows.withColumn("rank", place).filter(F.col("rank") <= k)


def hard_rank(rows: DataFrame, value: str, pos: str, by: list[str] | None = None, descending: bool = True) -> DataFrame:
    """1-based ranks in column rank; ties are broken by place."""
    key = F.col(value).desc() if descending else F.col(value).asc()
    if not by:
        return global_running(rows, [key, F.col(pos)], position="rank")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(key, F.col(pos))))


def soft_argmax(rows: DataFrame, value: str, by: list[str], softness: float = 0.1, name: str = "p") -> DataFrame:
    """Softmax of value / softness within each group."""
    w = Window.partitionBy(*by)
    rows = rows.withColumn("__e", F.exp((F.col(value) - F.max(value).over(w)) / softness))
    return rows.withColumn(name, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def array_soft_max(xs, softness: float = 0.1) -> Column:
    """Soft maximum of an array: its softmax-weighted mean."""
    xs = col(xs)
    w = array_softmax(xs, softness)
    return F.aggregate(F.zip_with(xs, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def array_soft_sort(xs, softness: float = 0.1, descending: bool = False) -> Column:
    """SoftSort: each sorted value replaced by the mean under a softmax of minus its distance to every element."""
    xs = col(xs)
    order = F.reverse(F.array_sort(xs)) if descending else F.array_sort(xs)

    def near(anchor):
        w = array_softmax(F.transform(xs, lambda v: -F.abs(v - anchor)), softness)
        return F.aggregate(F.zip_with(xs, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)

    return F.transform(order, near)


def array_soft_rank(xs, softness: float = 0.1, descending: bool = True) -> Column:
    """NeuralSort-free soft rank: one half plus the summed logistic of pairwise differences."""
    xs = col(xs)
    sign = 1.0 if descending else -1.0

    def rank(x):
        return 0.5 + F.aggregate(xs, F.lit(0.0), lambda acc, v: acc + 1 / (1 + F.exp(-sign * (v - x) / softness)))

    return F.transform(xs, rank)


def array_quantile(xs, q: float, method: str = "linear") -> Column:
    """Quantile of an array; method linear, lower, higher, nearest (halves go down) or midpoint."""
    xs = F.array_sort(col(xs))
    p = F.lit(min(max(q, 0.0), 1.0)) * (F.size(xs) - 1)
    low, high = F.floor(p), F.ceil(p)

    def at(i):
        return F.element_at(xs, (i + 1).cast("int"))

    if method == "linear":
        return at(low) + (p - low) * (at(high) - at(low))
    if method == "lower":
        return at(low)
    if method == "higher":
        return at(high)
    if method == "nearest":
        return at(F.when(p - low <= 0.5, low).otherwise(high))
    if method == "midpoint":
        return (at(low) + at(high)) / 2
    raise ValueError(f"unknown quantile method {method}")


def array_median(xs) -> Column:
    return array_quantile(xs, 0.5)


def quantile(value, q: float) -> Column:
    """Linear quantile down a column, as an aggregate."""
    return F.percentile(col(value), F.lit(q))


def simplex_softmax(xs, softness: float = 0.1) -> Column:
    """Entropic projection of an array onto the simplex."""
    return array_softmax(col(xs), softness)


def simplex_euclidean(xs, softness: float = 0.1) -> Column:
    """Euclidean projection of an array / softness onto the simplex (sparsemax)."""
    z = F.transform(col(xs), lambda v: v / softness)
    order = F.reverse(F.array_sort(z))
    sums = F.transform(order, lambda v, i: F.aggregate(F.slice(order, F.lit(1), (i + 1).cast("int")), F.lit(0.0), lambda acc, u: acc + u))
    # 1-based sizes of the supports that satisfy the optimality condition; the largest is the support.
    fits = F.zip_with(F.transform(order, lambda v, i: v * (i + 1) + 1.0), sums, lambda a, s: (a > s).cast("int"))
    size = F.aggregate(fits, F.lit(0), lambda acc, v: acc + v)
    theta = (F.element_at(sums, size) - 1.0) / size
    return F.transform(z, lambda v: F.greatest(v - theta, F.lit(0.0)))


def global_running(rows: DataFrame, order: list, sums: list[str] | None = None, position: str = "k") -> DataFrame:
    """A 1-based position in a total order over the whole table, and running sums <name>_sum, without a single sorting task.

    Rows are dealt by ranges of the whole order, each range is numbered by itself, and the ranges' totals are added up;
    those are one row a range.
    """
    from strandlake.session import cut_lineage

    dealt = cut_lineage(rows.repartitionByRange(*order).withColumn("__r", F.spark_partition_id()))
    made = {position: F.count(F.lit(1)), **{f"{c}_sum": F.sum(c) for c in sums or []}}
    totals = dealt.groupBy("__r").agg(*[v.alias(f"__t_{n}") for n, v in made.items()])
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__r", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in made])
    inside = Window.partitionBy("__r").orderBy(*order)
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({position: F.row_number().over(inside), **{f"{c}_sum": F.sum(c).over(run) for c in sums or []}})
    out = out.join(F.broadcast(starts), "__r")
    return out.withColumns({n: F.col(n) + F.col(f"__s_{n}") for n in made}).drop("__r", *[f"__s_{n}" for n in made])


def cumulative(rows: DataFrame, value: str, order: list[str], by: list[str] | None = None, name: str = "total") -> DataFrame:
    """Running sum in a given order."""
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(value).over(w))


def share_of_total(xs) -> Column:
    """An array divided by its sum; zeros if the sum is zero."""
    xs = col(xs)
    total = array_sum(xs)
    return F.transform(xs, lambda v: F.when(total == 0, 0.0).otherwise(v / total))
