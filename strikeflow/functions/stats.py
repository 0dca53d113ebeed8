"""Normal cumulative distribution as a plain Column expression.

Spark has no erf/normal-CDF function, so the double-precision rational
approximation of Hart (1968), as given by West (2005), is written out with
``F.when``; absolute error is about 1e-16.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published coefficients of the approximation, highest degree first.
_NUM = (
    0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
_DEN = (
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
_SPLIT = 7.07106781186547
_CUTOFF = 37.0
_SQRT_2PI = 2.506628274631


def _horner(coeffs, z: Column) -> Column:
    acc = F.lit(coeffs[0])
    for c in coeffs[1:]:
        acc = acc * z + F.lit(c)
    return acc


def std_normal_cdf(x: Column) -> Column:
    """Standard normal CDF; NULL for NULL input.

    ``x`` is used many times: a column will do best.  The terms in between are never NULL, which keeps the
    generated code small enough to be compiled."""
    z = F.abs(F.coalesce(x, F.lit(0.0)))
    e = F.exp(-(z * z) / F.lit(2.0))
    cont = z + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        cont = z + F.lit(k) / cont
    tail = (
        F.when(z < F.lit(_SPLIT), e * _horner(_NUM, z) / _horner(_DEN, z))
        .when(z <= F.lit(_CUTOFF), e / cont / F.lit(_SQRT_2PI))
        .when(z > F.lit(_CUTOFF), F.lit(0.0))
    )
    # 1 - tail above zero, else tail, with the tail written out once
    side = F.when(x > F.lit(0.0), F.lit(-1.0)).when(x.isNotNull(), F.lit(1.0))
    return F.when(x > F.lit(0.0), F.lit(1.0)).otherwise(F.lit(0.0)) + side * tail


def standardized(x: Column, mu: Column, sigma: Column) -> Column:
    """(x - mu) / sigma; NULL when sigma <= 0 or any input is NULL."""
    return F.when(sigma > F.lit(0.0), (x - mu) / sigma)


def normal_cdf(x: Column, mu: Column, sigma: Column) -> Column:
    """P(X <= x) for X ~ N(mu, sigma); NULL when sigma <= 0 or any input is NULL."""
    return std_normal_cdf(standardized(x, mu, sigma))
