"""Tail probabilities as column expressions: the normal tail, and the two-sided p of a correlation by Student's t."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the series and of the fractions, and degrees of freedom from which Student's t is turned into a normal value.
TERMS, MANY = 160, 1_000


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normal_tail(z: Column) -> Column:
    """P(Z >= z) for z >= 0, about 1e-14 off: the power series below 3, the continued fraction above."""
    density = lambda x: F.exp(-x * x / 2) / math.sqrt(2 * math.pi)

    def series(x: Column) -> Column:
        first = F.struct(x.alias("term"), x.alias("sum"))
        step = lambda s, k: _let(s["term"] * x * x / (2 * k + 1), lambda t: F.struct(t.alias("term"), (s["sum"] + t).alias("sum")))
        return 0.5 - density(x) * F.aggregate(F.sequence(F.lit(1), F.lit(60)), first, step, lambda s: s["sum"])

    def fraction(x: Column) -> Column:
        return density(x) / F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), x, lambda acc, k: x + k / acc)

    return _let(z.cast("double"), lambda x: F.when(x < 3, series(x)).otherwise(fraction(x)))


def _log_ratio(a: Column) -> Column:
    """ln(gamma(a + 1/2) / gamma(a)): its asymptotic series at a + 60, brought back to a."""
    far = a + 60
    at_far = F.log(far) / 2 - 1 / (8 * far) + 1 / (192 * F.pow(far, F.lit(3.0))) - 1 / (640 * F.pow(far, F.lit(5.0)))
    return F.aggregate(F.sequence(F.lit(0), F.lit(59)), at_far, lambda acc, k: acc + F.log((a + k) / (a + k + 0.5)))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its far end back."""

    def term(m: Column) -> Column:
        k = F.floor(m / 2)
        even = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        odd = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        return F.when(m % 2 == 0, even).otherwise(odd)

    return 1 / F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), F.lit(1.0), lambda acc, m: 1 + term(m) / acc)


def correlation_p(rho: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs by Student's t with n - 2 degrees of freedom, null for null; 0 if perfect.

    Below MANY degrees it is the incomplete beta function at 1 - rho^2; from there on t becomes a normal value by Hill's
    expansion, which is closer than 1e-10 there.
    """
    half = F.lit(0.5)

    def beta(r: Column, df: Column) -> Column:
        a, x = df / 2, 1 - r * r
        front = F.exp(a * F.log1p(-r * r) + F.log(F.abs(r)) + _log_ratio(a)) / math.sqrt(math.pi)
        return F.when(x < (a + 1) / (a + 2.5), front / a * _beta_fraction(a, half, x)).otherwise(1 - front * 2 * _beta_fraction(half, a, r * r))

    def hill(r: Column, df: Column) -> Column:
        a = df - 0.5
        return _let(-a * F.log1p(-r * r), lambda y: _let(48 * a * a, lambda b: 2 * normal_tail(((((-0.4 * y - 3.3) * y - 24) * y - 85.5) / (0.8 * y * y + 100 + b) + y + 3) / b * F.sqrt(y) + F.sqrt(y))))

    p = lambda r: _let((n - 2).cast("double"), lambda df: F.when(df < MANY, beta(r, df)).otherwise(hill(r, df)))
    return F.when(n >= 3, _let(rho.cast("double"), lambda r: F.when(F.abs(r) >= 1, 0.0).when(r == 0, 1.0).when(r.isNotNull(), p(r))))
