"""Tail probabilities as column expressions: built-in functions only, inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the series and of the continued fraction.
TERMS = 200
#: Largest number of degrees of freedom the map of ln Gamma covers; beyond it Stirling's series is exact to a double.
MOST_DF = 64


def _log_gamma_half(df: Column) -> Column:
    """ln Gamma(df / 2) for df of 1 or more."""
    a = df.cast("double") / 2
    series = (a - 0.5) * F.log(a) - a + 0.5 * math.log(2 * math.pi) + 1 / (12 * a) - 1 / (360 * a * a * a) + 1 / (1260 * F.pow(a, 5))
    known = F.create_map(*[F.lit(x) for n in range(1, MOST_DF + 1) for x in (n, math.lgamma(n / 2))])
    return F.coalesce(F.try_element_at(known, df.cast("int")), series)


def upper_gamma(df: Column, x: Column) -> Column:
    """Q(df / 2, x): regularised upper incomplete gamma function.

    Series for x < df / 2 + 1, else the continued fraction, evaluated from its far end; within [0, 1].
    NULL where x or df is NULL, 1 where x is not positive.
    """
    a = df.cast("double") / 2
    head = F.exp(a * F.log(x) - x - _log_gamma_half(df))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct((1 / a).alias("term"), (1 / a).alias("sum")),
        lambda s, k: F.struct((s["term"] * x / (a + k)).alias("term"), (s["sum"] + s["term"] * x / (a + k)).alias("sum")),
        lambda s: s["sum"],
    )
    fraction = F.aggregate(
        F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), x + 2 * TERMS + 1 - a, lambda f, i: x + 2 * i - 1 - a - i * (i - a) / f
    )
    q = F.when(x <= 0, 1.0).when(x < a + 1, 1 - head * series).otherwise(head / fraction)
    return F.when(x.isNotNull() & df.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), q)))


def chi2_tail(statistic: Column, df: Column) -> Column:
    """Upper tail probability of the chi-square distribution; NULL for df < 1."""
    return F.when(df >= 1, upper_gamma(df, statistic / 2))


def erfc(z: Column) -> Column:
    """Complementary error function of |z|: Q(1/2, z^2)."""
    return upper_gamma(F.lit(1), z * z)
