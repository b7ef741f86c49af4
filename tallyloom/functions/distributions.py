"""Tail probabilities of the normal, Student's and the chi-squared distribution, in numpy and as columns."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's evaluation of the continued fraction of the incomplete beta function."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + step / c
            c = c if abs(c) > _TINY else _TINY
            h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return h


def regularised_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    if math.isnan(t) or df <= 0:
        return math.nan
    return 0.0 if math.isinf(t) else regularised_beta(df / 2, 0.5, df / (df + t * t))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_sf(x: float, df: float) -> float:
    """Upper tail by the series or the continued fraction of the incomplete gamma function."""
    if math.isnan(x) or df <= 0:
        return math.nan
    a, y = df / 2, x / 2
    if y <= 0:
        return 1.0
    front = math.exp(a * math.log(y) - y - math.lgamma(a))
    if y < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= y / n
            total += term
        return 1.0 - total * front
    b = y + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def _column(f, *arguments: Column) -> Column:
    """f over columns in Arrow batches; null where an argument is null or the result NaN."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            values = [np.nan if any(pd.isna(v) for v in row) else f(*row) for row in zip(*columns, strict=True)]
            yield pd.Series(values, dtype="float64").astype(object).where(~np.isnan(np.array(values, float)), None) if values else pd.Series([], dtype="float64")

    return run(*[a.cast("double") for a in arguments])


def t_pvalue(t: Column, df: Column) -> Column:
    return _column(t_two_sided, t, df)


def chi2_pvalue(x: Column, df: Column) -> Column:
    return _column(chi2_sf, x, df)


def normal_pvalue(z: Column) -> Column:
    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else normal_two_sided(v)).astype("float64")

    return run(z.cast("double"))
