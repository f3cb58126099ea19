"""Soft positions over array columns: probability vectors for arg-max, arg-sort and quantiles, and the values they pick.

Two methods: `softsort` weighs every element by its distance to the sorted value at a place; `neuralsort` by the place's
coefficient times the element less the element's summed distances. Either score becomes a distribution by an entropic
(smooth) or Euclidean (c0) projection onto the simplex, or a one-hot vector (hard).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions.numeric import array_softmax, dot, let
from strandlake.functions.order import simplex_euclidean
from strandlake.functions.soft import col


def _project(z: Column, softness: float, mode: str) -> Column:
    if mode == "smooth":
        return array_softmax(z, softness)
    if mode == "c0":
        return simplex_euclidean(z, softness)
    raise ValueError(f"unknown mode {mode}")


def _one_hot(xs: Column, place: Column) -> Column:
    """Ones at the element that stands at a 0-based place of the ascending order; ties keep the order of the array."""
    pairs = F.array_sort(F.transform(xs, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    at = F.element_at(pairs, (place + 1).cast("int"))["i"]
    return F.transform(xs, lambda _, i: (i == at).cast("double"))


def place_weights(xs, place, method: str = "neuralsort", mode: str = "smooth", softness: float = 0.1) -> Column:
    """Distribution over the elements that stand at a 0-based place of the ascending order."""
    xs = col(xs)
    place = place if isinstance(place, Column) else F.lit(place)
    if mode == "hard":
        return _one_hot(xs, place)
    if method == "softsort":
        anchor = F.element_at(F.array_sort(xs), (place + 1).cast("int"))
        return let(anchor, lambda a: _project(F.transform(xs, lambda v: -F.abs(v - a)), softness, mode))
    if method == "neuralsort":
        coefficient = F.size(xs) - 1 - 2 * place
        far = lambda v: F.aggregate(xs, F.lit(0.0), lambda acc, u: acc + F.abs(u - v))
        return _project(F.transform(xs, lambda v: -(coefficient * v + far(v))), softness, mode)
    raise ValueError(f"unknown method {method}")


def soft_argmax(xs, method: str = "softsort", mode: str = "smooth", softness: float = 0.1) -> Column:
    """Distribution over the elements that may be the greatest."""
    xs = col(xs)
    if method == "softsort" and mode != "hard":
        return _project(xs, softness, mode)
    if mode == "hard":
        first = F.array_position(xs, F.array_max(xs)) - 1
        return F.transform(xs, lambda _, i: (i == first).cast("double"))
    return place_weights(xs, F.size(xs) - 1, method, mode, softness)


def soft_argmin(xs, method: str = "softsort", mode: str = "smooth", softness: float = 0.1) -> Column:
    return soft_argmax(F.transform(col(xs), lambda v: -v), method, mode, softness)


def soft_max(xs, method: str = "softsort", mode: str = "smooth", softness: float = 0.1) -> Column:
    return dot(xs, soft_argmax(xs, method, mode, softness))


def soft_min(xs, method: str = "softsort", mode: str = "smooth", softness: float = 0.1) -> Column:
    return dot(xs, soft_argmin(xs, method, mode, softness))


def soft_argsort(xs, method: str = "softsort", mode: str = "smooth", softness: float = 0.1, descending: bool = False) -> Column:
    """Array of distributions, one for each place of the order."""
    xs = col(xs)
    last = F.size(xs) - 1
    places = F.sequence(F.lit(0), last)
    if mode != "hard" and method == "softsort":
        order = F.reverse(F.array_sort(xs)) if descending else F.array_sort(xs)
        return F.transform(order, lambda a: _project(F.transform(xs, lambda v: -F.abs(v - a)), softness, mode))
    return F.transform(places, lambda p: place_weights(xs, last - p if descending else p, method, mode, softness))


def soft_sort(xs, method: str = "softsort", mode: str = "smooth", softness: float = 0.1, descending: bool = False) -> Column:
    return F.transform(soft_argsort(xs, method, mode, softness, descending), lambda w: dot(xs, w))


def _cut(n: Column, q: float, how: str) -> tuple[Column, Column]:
    """(place, weight of the next place) of a quantile; nearest rounds halves down."""
    p = F.lit(min(max(q, 0.0), 1.0)) * (n - 1)
    low = F.least(F.floor(p), n - 1)
    if how == "linear":
        return low, p - low
    if how == "lower":
        return low, F.lit(0.0)
    if how == "higher":
        return F.ceil(p), F.lit(0.0)
    if how == "nearest":
        return F.when(p - low <= 0.5, low).otherwise(F.ceil(p)), F.lit(0.0)
    if how == "midpoint":
        return low, F.when(F.ceil(p) == low, 0.0).otherwise(0.5)
    raise ValueError(f"unknown quantile method {how}")


def soft_argquantile(xs, q: float, method: str = "neuralsort", mode: str = "smooth", softness: float = 0.1, how: str = "linear") -> Column:
    """Distribution over the elements that stand at a quantile: two places' distributions, mixed by the interpolation."""
    xs = col(xs)
    place, share = _cut(F.size(xs), q, how)
    after = F.least(place + 1, F.size(xs) - 1)
    return F.zip_with(place_weights(xs, place, method, mode, softness), place_weights(xs, after, method, mode, softness), lambda a, b: (1 - share) * a + share * b)


def soft_quantile(xs, q: float, method: str = "neuralsort", mode: str = "smooth", softness: float = 0.1, how: str = "linear") -> Column:
    return dot(xs, soft_argquantile(xs, q, method, mode, softness, how))


def soft_median(xs, method: str = "neuralsort", mode: str = "smooth", softness: float = 0.1) -> Column:
    return soft_quantile(xs, 0.5, method, mode, softness)


def soft_argmedian(xs, method: str = "neuralsort", mode: str = "smooth", softness: float = 0.1) -> Column:
    return soft_argquantile(xs, 0.5, method, mode, softness)


def soft_percentile(xs, p: float, method: str = "neuralsort", mode: str = "smooth", softness: float = 0.1) -> Column:
    return soft_quantile(xs, p / 100, method, mode, softness)


def soft_top_k_mask(xs, k: int, method: str = "neuralsort", mode: str = "smooth", softness: float = 0.1) -> Column:
    """Each element's probability of being among the k greatest: the distributions of the last k places, summed."""
    xs = col(xs)
    n = F.size(xs)
    rows = F.transform(F.sequence(F.greatest(n - k, F.lit(0)), n - 1), lambda p: place_weights(xs, p, method, mode, softness))
    return F.aggregate(rows, F.transform(xs, lambda _: F.lit(0.0)), lambda acc, w: F.zip_with(acc, w, lambda a, b: a + b))


def soft_rank(xs, method: str = "neuralsort", mode: str = "smooth", softness: float = 0.1, descending: bool = True) -> Column:
    """Expected 1-based place of each element under the distributions of all places, each element's share normalised."""
    xs = col(xs)
    rows = soft_argsort(xs, method, mode, softness, descending)
    zero = F.transform(xs, lambda _: F.lit(0.0))
    total = F.aggregate(rows, zero, lambda acc, w: F.zip_with(acc, w, lambda a, b: a + b))
    placed = F.aggregate(F.transform(rows, lambda w, i: F.transform(w, lambda v: v * (i + 1))), zero, lambda acc, w: F.zip_with(acc, w, lambda a, b: a + b))
    return F.zip_with(placed, total, lambda a, b: a / F.greatest(b, F.lit(1e-12)))


def soft_permutation(xs, softness: float = 0.1) -> Column:
    """SoftSort's row-stochastic matrix in descending order, as a gene tokenizer orders genes by expression."""
    return soft_argsort(xs, "softsort", "smooth", softness, descending=True)
