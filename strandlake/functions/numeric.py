"""Numbers Spark lacks or that must come out alike everywhere: gamma, erf, array algebra, rounding, hash order."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions.soft import col

#: Lanczos coefficients for g = 7.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905,
    -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def lgamma(x) -> Column:
    """Natural logarithm of the gamma function for positive x, to about 1e-13."""
    z = col(x) - 1.0
    series = reduce(lambda a, b: a + b, [F.lit(c) / (z + k) for k, c in enumerate(LANCZOS) if k], F.lit(LANCZOS[0]))
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(series)


def ieee_log(x) -> Column:
    """Natural logarithm by IEEE rules: minus infinity at zero and NaN below it, where Spark's is null."""
    x = col(x)
    return F.when(x == 0, float("-inf")).when(x < 0, float("nan")).otherwise(F.log(x))


def erf(x) -> Column:
    """The error function: a power series near zero, a continued fraction beyond; to about 1e-12."""
    x = col(x)
    a = F.abs(x)
    small = F.lit(1.0)
    for n in reversed(range(39)):
        small = 1.0 + small * (a * a) * F.lit(-(2 * n + 1) / ((n + 1) * (2 * n + 3)))
    near = 2 / math.sqrt(math.pi) * a * small
    fraction = F.lit(0.0)
    for k in reversed(range(1, 40)):
        fraction = F.lit(k / 2) / (a + fraction)
    far = 1.0 - F.exp(-a * a) / (math.sqrt(math.pi) * (a + fraction))
    return F.signum(x) * F.when(a < 2.5, near).otherwise(far)


def normal_cdf(x) -> Column:
    return 0.5 * (1.0 + erf(col(x) / math.sqrt(2)))


def array_sum(xs) -> Column:
    return F.aggregate(col(xs), F.lit(0.0), lambda acc, v: acc + v.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def squared_distance(a, b) -> Column:
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def array_logsumexp(xs) -> Column:
    xs = col(xs)
    top = F.array_max(xs)
    return top + F.log(F.aggregate(xs, F.lit(0.0), lambda acc, v: acc + F.exp(v - top)))


def let(value, make) -> Column:
    """make(value) with the value computed once: inside array functions Spark would repeat it for every element."""
    return F.element_at(F.transform(F.array(value), make), 1)


def array_softmax(xs, temperature: float = 1.0) -> Column:
    def scaled(e):
        return let(array_sum(e), lambda total: F.transform(e, lambda v: v / total))

    def shifted(x):
        return let(F.array_max(x), lambda top: let(F.transform(x, lambda v: F.exp((v - top) / temperature)), scaled))

    return let(col(xs), shifted)


def array_argmax(xs) -> Column:
    """0-based place of the first greatest element."""
    return F.array_position(col(xs), F.array_max(col(xs))).cast("long") - 1


def hash_order(seed: int, *ids) -> Column:
    """A reproducible order key: md5 over seed and ids, the same in any SQL engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(i).cast("string") for i in ids]))


def hash_uniform(seed: int, *ids) -> Column:
    """A reproducible uniform number in (0, 1), from 48 bits of the order key."""
    return (F.conv(F.substring(hash_order(seed, *ids), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def hash_normal(seed: int, *ids) -> Column:
    """A reproducible standard normal number, by the Box-Muller transform of two uniforms."""
    u, v = hash_uniform(seed, *ids), hash_uniform(seed + 7919, *ids)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2 * math.pi * v)


def rounded(x, digits: int = 6) -> Column:
    """For results that two engines must agree on: rounded, and never minus zero."""
    return F.round(col(x), digits) + F.lit(0.0)
