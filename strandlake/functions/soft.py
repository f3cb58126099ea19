"""Soft predicates and smooth mathematics as Catalyst expressions.

Every function takes and returns columns. `mode` is hard, smooth (logistic), or c0, c1, c2 (piecewise polynomials that
are constant beyond five softnesses). With mode hard the plain predicate comes out, so filters push down.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the S-curves on [-1, 1], from the highest power down.
CURVES = {"c0": (0.5, 0.5), "c1": (-0.25, 0.0, 0.75, 0.5), "c2": (0.1875, 0.0, -0.625, 0.0, 0.9375, 0.5)}
EPSILON = 1e-10


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def check_softness(softness: float) -> None:
    if softness <= 0:
        raise ValueError(f"softness must be positive, not {softness}")


def _poly(u: Column, falling) -> Column:
    return reduce(lambda acc, c: acc * u + F.lit(c), falling[1:], F.lit(falling[0]))


def _integral(falling) -> tuple[float, ...]:
    """Coefficients of the antiderivative that is 0 at -1."""
    n = len(falling)
    raised = [c / (n - k) for k, c in enumerate(falling)]
    return (*raised, -sum(c * (-1) ** (n - k) for k, c in enumerate(raised)))


def logistic(x) -> Column:
    """1 / (1 + exp(-x)), never overflowing."""
    x = col(x)
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def softplus(x) -> Column:
    x = col(x)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigmoidal(x, softness: float = 0.1, mode: str = "smooth") -> Column:
    check_softness(softness)
    x = col(x)
    if mode == "smooth":
        return logistic(x / softness)
    u = x / (5.0 * softness)
    return F.when(u < -1, F.lit(0.0)).when(u < 1, _poly(u, CURVES[mode])).otherwise(F.lit(1.0))


def softrelu(x, softness: float = 0.1, mode: str = "smooth", gated: bool = False) -> Column:
    check_softness(softness)
    x = col(x)
    if gated:
        return x * sigmoidal(x, softness, mode)
    if mode == "smooth":
        return softplus(x / softness) * softness
    u = x / (5.0 * softness)
    return F.when(u < -1, F.lit(0.0)).when(u < 1, 5.0 * softness * _poly(u, _integral(CURVES[mode]))).otherwise(x)


def relu(x, softness: float = 0.1, mode: str = "smooth", gated: bool = False) -> Column:
    return F.greatest(col(x), F.lit(0.0)) if mode == "hard" else softrelu(x, softness, mode, gated)


def heaviside(x, softness: float = 0.1, mode: str = "smooth") -> Column:
    if mode == "hard":
        return F.when(col(x) < 0, 0.0).when(col(x) > 0, 1.0).otherwise(0.5)
    return sigmoidal(x, softness, mode)


def soft_round(x, softness: float = 0.1, mode: str = "smooth", radius: int = 5) -> Column:
    x = col(x)
    if mode == "hard":
        return F.rint(x)
    base, total = F.floor(x), F.lit(0.0)
    for k in range(-radius, radius + 1):
        n = base + k
        total = total + n * (sigmoidal(x - (n - 0.5), softness, mode) - sigmoidal(x - (n + 0.5), softness, mode))
    return total


def soft_sign(x, softness: float = 0.1, mode: str = "smooth") -> Column:
    return F.signum(col(x)) if mode == "hard" else 2.0 * sigmoidal(x, softness, mode) - 1.0


def soft_abs(x, softness: float = 0.1, mode: str = "smooth") -> Column:
    return F.abs(col(x)) if mode == "hard" else col(x) * soft_sign(x, softness, mode)


def soft_clip(x, a, b, softness: float = 0.1, mode: str = "smooth", gated: bool = False) -> Column:
    x, a, b = col(x), col(a), col(b)
    if mode == "hard":
        return F.least(F.greatest(x, a), b)
    return a + softrelu(x - a, softness, mode, gated) - softrelu(x - b, softness, mode, gated)


def _as_number(condition: Column) -> Column:
    return condition.cast("double")


def greater(x, y, softness: float = 0.1, mode: str = "smooth", epsilon: float = EPSILON) -> Column:
    d = col(x) - col(y)
    return _as_number(d > 0) if mode == "hard" else sigmoidal(d - epsilon, softness, mode)


def greater_equal(x, y, softness: float = 0.1, mode: str = "smooth", epsilon: float = EPSILON) -> Column:
    d = col(x) - col(y)
    return _as_number(d >= 0) if mode == "hard" else sigmoidal(d + epsilon, softness, mode)


def less(x, y, softness: float = 0.1, mode: str = "smooth", epsilon: float = EPSILON) -> Column:
    return _as_number(col(x) < col(y)) if mode == "hard" else 1.0 - greater_equal(x, y, softness, mode, epsilon)


def less_equal(x, y, softness: float = 0.1, mode: str = "smooth", epsilon: float = EPSILON) -> Column:
    return _as_number(col(x) <= col(y)) if mode == "hard" else 1.0 - greater(x, y, softness, mode, epsilon)


def equal(x, y, softness: float = 0.1, mode: str = "smooth", epsilon: float = EPSILON) -> Column:
    if mode == "hard":
        return _as_number(col(x) == col(y))
    return 2.0 * less_equal(soft_abs(col(x) - col(y), softness, mode), 0.0, softness, mode, epsilon)


def not_equal(x, y, softness: float = 0.1, mode: str = "smooth", epsilon: float = EPSILON) -> Column:
    if mode == "hard":
        return _as_number(col(x) != col(y))
    return 2.0 * greater(soft_abs(col(x) - col(y), softness, mode), 0.0, softness, mode, epsilon) - 1.0


def isclose(x, y, softness: float = 0.1, rtol: float = 1e-5, atol: float = 1e-8, mode: str = "smooth", epsilon: float = EPSILON) -> Column:
    x, y = col(x), col(y)
    if mode == "hard":
        return _as_number(F.abs(x - y) <= atol + rtol * F.abs(y))
    return 2.0 * less_equal(soft_abs(x - y, softness, mode), atol + rtol * soft_abs(y, softness, mode), softness, mode, epsilon)


def soft_not(x) -> Column:
    return 1.0 - col(x)


def all_of(xs, geometric: bool = False, epsilon: float = EPSILON) -> Column:
    """AND of several soft booleans: their product, or geometric mean."""
    xs = [col(x) for x in xs]
    if geometric:
        return F.exp(reduce(lambda a, b: a + b, [F.log(F.greatest(x, F.lit(epsilon))) for x in xs]) / len(xs))
    return reduce(lambda a, b: a * b, xs)


def any_of(xs, geometric: bool = False) -> Column:
    return soft_not(all_of([soft_not(x) for x in xs], geometric))


def soft_and(x, y, geometric: bool = False) -> Column:
    return all_of([x, y], geometric)


def soft_or(x, y, geometric: bool = False) -> Column:
    return any_of([x, y], geometric)


def soft_xor(x, y, geometric: bool = False) -> Column:
    x, y = col(x), col(y)
    return soft_or(soft_and(x, soft_not(y), geometric), soft_and(soft_not(x), y, geometric), geometric)


def array_all(xs, geometric: bool = False, epsilon: float = EPSILON) -> Column:
    """AND over an array column."""
    xs = col(xs)
    if geometric:
        return F.exp(F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + F.log(F.greatest(x, F.lit(epsilon)))) / F.size(xs))
    return F.aggregate(xs, F.lit(1.0), lambda acc, x: acc * x)


def array_any(xs, geometric: bool = False) -> Column:
    return soft_not(array_all(F.transform(col(xs), lambda x: 1.0 - x), geometric))


def group_all(x) -> Column:
    """AND down a column, as an aggregate: the product of values in [0, 1]; 0 as soon as one is 0."""
    x = col(x)
    return F.when(F.min(x) <= 0, 0.0).otherwise(F.exp(F.sum(F.log(F.greatest(x, F.lit(1e-300))))))


def soft_where(condition, x, y) -> Column:
    c = col(condition)
    return col(x) * c + col(y) * (1.0 - c)


def take(xs, weights) -> Column:
    """Soft gather: dot product of an array with a soft index."""
    return F.aggregate(F.zip_with(col(xs), col(weights), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def take_each(xs, indexes) -> Column:
    """Soft gather by each of an array of soft indexes."""
    xs = col(xs)
    return F.transform(col(indexes), lambda w: F.aggregate(F.zip_with(xs, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v))


def soft_slice(xs, start, size: int) -> Column:
    """Soft slice of `size` elements from a soft start, wrapping round the end."""
    xs, start = col(xs), col(start)
    n = F.size(xs)

    def rolled(t):
        return F.aggregate(
            F.transform(start, lambda w, i: w * F.element_at(xs, ((i + t) % n + 1).cast("int"))), F.lit(0.0), lambda acc, v: acc + v
        )

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), rolled)


def safe_sqrt(x) -> Column:
    return F.when(col(x) > 0, F.sqrt(F.greatest(col(x), F.lit(0.0)))).otherwise(0.0)


def safe_arcsin(x) -> Column:
    x = col(x)
    return F.when(F.abs(x) < 1, F.asin(x)).otherwise(F.signum(x) * (math.pi / 2))


def safe_arccos(x) -> Column:
    x = col(x)
    return F.when(F.abs(x) < 1, F.acos(x)).when(x >= 1, 0.0).otherwise(math.pi)


def safe_div(x, y) -> Column:
    return F.coalesce(F.try_divide(col(x), F.nullif(col(y), F.lit(0.0))), F.lit(0.0))


def safe_log(x) -> Column:
    return F.when(col(x) > 0, F.log(col(x))).otherwise(0.0)


def safe_norm(xs) -> Column:
    return F.sqrt(F.aggregate(col(xs), F.lit(0.0), lambda acc, v: acc + v * v))


def standardize_and_squash(x, mean, variance, eps: float = 1e-6, temperature: float = 1.0) -> Column:
    """Logistic of the z-score; mean and population variance come from a window or a join."""
    return logistic((col(x) - col(mean)) / F.sqrt(col(variance) + eps) / temperature)


def unsquash_and_destandardize(y, mean, deviation, eps: float = 1e-10, temperature: float = 1.0) -> Column:
    low = max(eps, 10 * 2.220446049250313e-16)
    y = F.least(F.greatest(col(y), F.lit(low)), F.lit(1.0 - low))
    return F.log(y / (1.0 - y)) * temperature * col(deviation) + col(mean)
