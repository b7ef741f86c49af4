"""Regressions and group tests."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.distributions import chi2_pvalue, normal_two_sided, t_pvalue
from tallyloom.operators.agreement import complete_pairs, correlation
from tallyloom.operators.ranking import midrank

#: Tuning constant of Huber's weights, and what makes the median deviation a standard one.
HUBER_T, MAD_SCALE = 1.345, 0.6744897501960817


def linear(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """(by, n, slope, intercept, r, stderr) of y on x; null where x is constant."""
    pairs = complete_pairs(df, x, y)
    xs, ys = F.col(x), F.col(y)
    fit = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(ys, xs).alias("slope"), F.regr_intercept(ys, xs).alias("intercept"), correlation(xs, ys).alias("r"), F.var_pop(xs).alias("__vx"), F.var_pop(ys).alias("__vy"))
    spread = F.sqrt(F.try_divide((1 - F.col("r") * F.col("r")) * F.col("__vy"), F.col("__vx") * (F.col("n") - 2)))
    return fit.withColumn("stderr", F.when(F.col("n") > 2, spread)).drop("__vx", "__vy")


def with_slope_pvalue(df: DataFrame) -> DataFrame:
    return df.withColumn("pvalue", t_pvalue(F.try_divide(F.col("slope"), F.col("stderr")), F.col("n") - 2))


def kruskal(df: DataFrame, by: Sequence[str], group: str, value: str) -> DataFrame:
    """(by, n, k, h): the Kruskal-Wallis statistic over the groups, corrected for ties; null if all values are equal."""
    rows = midrank(df.where(F.col(value).isNotNull() & F.col(group).isNotNull()), by, value, "__r")
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    rows = rows.withColumn("__t", ties)
    groups = rows.groupBy(*by, group).agg(F.count(F.lit(1)).alias("__n"), F.sum("__r").alias("__s"), F.sum(F.col("__t") * F.col("__t") - 1).alias("__c"))
    totals = groups.groupBy(*by).agg(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("__s") * F.col("__s") / F.col("__n")).alias("__q"), F.sum("__c").alias("__c"))
    n = F.col("n").cast("double")
    raw = 12.0 / (n * (n + 1)) * F.col("__q") - 3 * (n + 1)
    return totals.select(*by, "n", "k", F.try_divide(raw, 1 - F.col("__c") / (n * n * n - n)).alias("h"))


def with_kruskal_pvalue(df: DataFrame) -> DataFrame:
    return df.withColumn("pvalue", chi2_pvalue(F.col("h"), F.col("k") - 1))


def huber(x: np.ndarray, y: np.ndarray, t: float = HUBER_T, rounds: int = 50, tolerance: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and two-sided normal p-values of y on the columns of x, by reweighted least squares.

    The scale is the median absolute residual, taken anew each round; a round
    ends the fit when the sum of Huber's loss changes by `tolerance` or less.
    """
    n, k = x.shape
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    before = np.inf
    for _ in range(rounds):
        r = y - x @ beta
        s = np.median(np.abs(r)) / MAD_SCALE
        if s == 0:
            break
        u = np.abs(r / s)
        loss = float(np.where(u <= t, 0.5 * u * u, t * u - 0.5 * t * t).sum())
        if abs(before - loss) <= tolerance:
            break
        before = loss
        root = np.sqrt(np.minimum(1.0, t / np.maximum(u, 1e-300)))
        beta = np.linalg.lstsq(x * root[:, None], y * root, rcond=None)[0]
    r = y - x @ beta
    s = np.median(np.abs(r)) / MAD_SCALE
    if s == 0 or n <= k:
        return beta, np.full(k, np.nan)
    psi, flat = np.clip(r / s, -t, t), (np.abs(r / s) <= t).astype(float)
    m = flat.mean()
    inflation = 1 + k / n * flat.var() / m**2
    cov = inflation**2 * ((psi**2).sum() / (n - k)) * s**2 / m**2 * np.linalg.inv(x.T @ x)
    return beta, np.array([normal_two_sided(z) for z in beta / np.sqrt(np.diag(cov))])


def huber_resampled(x: np.ndarray, y: np.ndarray, at: np.ndarray, t: float = HUBER_T, rounds: int = 50, tolerance: float = 1e-8) -> np.ndarray:
    """The coefficients of `huber` for each row of drawn positions, all fitted side by side; NaN where the columns drawn are dependent.

    Each round solves the weighted normal equations of the fits that go on, in
    columns that are centred and scaled, so that they are well conditioned.
    """
    middle, scale = x[:, 1:].mean(0), x[:, 1:].std(0)
    scale = np.where(scale > 0, scale, 1.0)
    z = np.column_stack([np.ones(len(x)), (x[:, 1:] - middle) / scale])
    a, b, k = z[at], y[at], z.shape[1]
    beta, before, open_ = np.full((len(at), k), np.nan), np.full(len(at), np.inf), np.arange(len(at))

    def solved(which: np.ndarray, weight: np.ndarray) -> np.ndarray:
        weighted = a[which] * weight[:, :, None]
        left, right = np.einsum("dni,dnj->dij", weighted, a[which]), np.einsum("dni,dn->di", weighted, b[which])
        whole = np.linalg.cond(left) < 1e12
        out = np.full((len(which), k), np.nan)
        out[whole] = np.linalg.solve(left[whole], right[whole][:, :, None])[:, :, 0]
        return out

    if not at.size:
        return beta
    beta = solved(open_, np.ones(at.shape))
    open_ = open_[np.isfinite(beta[:, 0])]
    for _ in range(rounds):
        if not len(open_):
            break
        r = b[open_] - np.einsum("dni,di->dn", a[open_], beta[open_])
        s = np.median(np.abs(r), axis=1) / MAD_SCALE
        going = s > 0
        open_, r, s = open_[going], r[going], s[going]
        u = np.abs(r / s[:, None])
        loss = np.where(u <= t, 0.5 * u * u, t * u - 0.5 * t * t).sum(1)
        going = np.abs(before[open_] - loss) > tolerance
        before[open_] = loss
        open_, u = open_[going], u[going]
        if len(open_):
            beta[open_] = solved(open_, np.minimum(1.0, t / np.maximum(u, 1e-300)))
    slopes = beta[:, 1:] / scale
    return np.column_stack([beta[:, 0] - slopes @ middle, slopes])


def huber_by_group(df: DataFrame, by: Sequence[str], predictors: Sequence[str], response: str) -> DataFrame:
    """(by, term, coefficient, pvalue): a robust regression with intercept for each group; groups are small by nature."""
    rows = df.select(*by, *[F.col(c).cast("double").alias(c) for c in [*predictors, response]]).dropna(subset=[*predictors, response])
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(by)])
    terms = ["intercept", *predictors]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*predictors, response])
        if len(pdf) < len(terms):
            beta = p = np.full(len(terms), np.nan)
        else:
            beta, p = huber(np.column_stack([np.ones(len(pdf)), pdf[list(predictors)].to_numpy()]), pdf[response].to_numpy())
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(terms) for c in by}, "term": terms, "coefficient": beta, "pvalue": p})

    return rows.groupBy(*by).applyInPandas(run, f"{head}, term string, coefficient double, pvalue double")
