"""Rank agreement of paired scores within groups: Spearman, Kendall, rank-biased overlap, Pearson."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.distributions import normal_pvalue, t_pvalue
from tallyloom.operators.draws import large_groups, of_groups
from tallyloom.operators.ranking import midrank, positions
from tallyloom.operators.relational import is_number
from tallyloom.operators.scan import Running, running
from tallyloom.session import cut

#: Pairs from which p-values are asymptotic.
LARGE = 30


def complete_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(is_number(F.col(x)) & is_number(F.col(y)))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r as an aggregate; null, not an error, if a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pearson(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    return complete_pairs(df, x, y).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation(F.col(x), F.col(y)).alias("r"))


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """(by, n, rho): Pearson's r of the midranks of complete pairs; null for fewer than two pairs or a constant side."""
    pairs = midrank(midrank(complete_pairs(df, x, y), by, x, "__rx"), by, y, "__ry")
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("__rx"), F.col("__ry")).alias("rho"))


def with_t_pvalue(df: DataFrame, r: str, n: str, out: str) -> DataFrame:
    """Add the two-sided p of r from Student's t with n - 2 degrees of freedom."""
    r_, n_ = F.col(r), F.col(n).cast("double")
    t = F.when(F.abs(r_) >= 1, F.lit(float("inf"))).otherwise(r_ * F.sqrt(F.try_divide(n_ - 2, 1 - r_ * r_)))
    return df.withColumn(out, t_pvalue(t, n_ - 2))


def fisher_interval(df: DataFrame, r: str, n: str, z: float = 1.96) -> DataFrame:
    """Add ci_lower and ci_upper by Fisher's transformation; null for three pairs or fewer, or |r| = 1."""
    half = F.lit(z) / F.sqrt(F.col(n) - 3)
    fit = (F.col(n) > 3) & (F.abs(F.col(r)) < 1)
    bound = lambda sign: F.when(fit, F.tanh(F.atanh(F.col(r)) + sign * half))
    return df.withColumns({"ci_lower": bound(-1), "ci_upper": bound(1)})


def _descents(y: np.ndarray) -> int:
    """Pairs i < j with y[i] > y[j], by merging sorted blocks of doubling width."""
    _, codes = np.unique(y, return_inverse=True)
    n, width, total = len(codes), 1, 0
    values = codes.astype(np.int64)
    span = int(values.max(initial=0)) + 1
    while width < n:
        pair = np.arange(n) // (2 * width)
        right = (np.arange(n) // width) % 2 == 1
        keyed = pair * span + values
        left_keys = keyed[~right]  # sorted: blocks are, and pairs ascend
        left_count = np.searchsorted(pair[~right], pair[right], side="right")
        total += int((left_count - np.searchsorted(left_keys, keyed[right], side="right")).sum())
        values = values[np.lexsort((values, pair))]
        width *= 2
    return total


def _ties(values: np.ndarray) -> np.ndarray:
    counts = np.unique(values, return_counts=True)[1].astype(np.int64)
    return counts[counts > 1]


def kendall_counts(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int, int, int]:
    """n, concordant minus discordant pairs, pairs tied in x, in y and in both, in n log^2 n steps."""
    n = len(x)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    pairs = lambda t: int((t * (t - 1) // 2).sum())
    tx, ty = pairs(_ties(x)), pairs(_ties(y))
    both = 0
    if n:
        new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        both = pairs(np.diff(np.append(np.flatnonzero(new), n)))
    return n, n * (n - 1) // 2 - tx - ty + both - 2 * _descents(y), tx, ty, both


def kendall_tau(x: np.ndarray, y: np.ndarray) -> float:
    n, s, tx, ty, _ = kendall_counts(x, y)
    total = n * (n - 1) // 2
    scale = float(total - tx) * float(total - ty)
    return s / scale**0.5 if scale > 0 else np.nan


def _kendall_variance(x: np.ndarray, y: np.ndarray) -> float:
    n = float(len(x))
    t, u = _ties(x).astype(float), _ties(y).astype(float)
    if n < 3:
        return np.nan
    m = n * (n - 1)
    spread = (m * (2 * n + 5) - (t * (t - 1) * (2 * t + 5)).sum() - (u * (u - 1) * (2 * u + 5)).sum()) / 18
    return spread + (t * (t - 1)).sum() * (u * (u - 1)).sum() / (2 * m) + (t * (t - 1) * (t - 2)).sum() * (u * (u - 1) * (u - 2)).sum() / (9 * m * (n - 2))


#: Pairs that a task counts at once; a larger group is counted in blocks. At most so many blocks are cut along either side.
KENDALL_ROWS, KENDALL_CUTS = 1 << 17, 512


def _kendall_in_blocks(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, s, tx, ty, ...) as sums over the cluster, for groups that no task could hold; rows: by, __x and __y, complete.

    Cuts at quantiles part each side into blocks: a cut's own value is a block,
    so many equal values are one of their own, and what lies between two cuts
    is one.  Two pairs are in order or not
    - by their blocks alone, if they differ on both sides: from the table of
      how many pairs lie in each two blocks;
    - within a block of x, counted there, whatever their y;
    - within a block of y but not of x: all of that block less those that also
      share their block of x.
    """
    keys = [F.col(c).alias(f"__g{i}") for i, c in enumerate(by)]
    names = [f"__g{i}" for i in range(len(by))]
    rows = rows.select(*keys, "__x", "__y") if by else rows.select(F.lit(0).alias("__g0"), "__x", "__y")
    names = names or ["__g0"]
    at = [k / KENDALL_CUTS for k in range(1, KENDALL_CUTS)]
    cuts = rows.groupBy(*names).agg(*[F.array_sort(F.array_distinct(F.percentile_approx(c, at, 20 * KENDALL_CUTS))).alias(f"{c}c") for c in ("__x", "__y")])
    on = None
    other = cuts.select(*[F.col(c).alias(f"{c}k") for c in names], "__xc", "__yc")
    for c in names:
        equal = rows[c].eqNullSafe(other[f"{c}k"])
        on = equal if on is None else on & equal
    block = lambda v, c: (2 * F.size(F.filter(c, lambda k: k < F.col(v))) + F.array_contains(c, F.col(v)).cast("int")).cast("int")
    placed = rows.join(F.broadcast(other), on).select(*names, "__x", "__y", block("__x", "__xc").alias("__p"), block("__y", "__yc").alias("__q"))
    placed = cut(placed)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields[: len(names)])
    even = lambda c: F.col(c) % 2 == 0

    def out(t: pa.Table, s: int) -> pa.Table:
        return pa.table({c: t.column(c).slice(0, 1) for c in names} | {"s": pa.array([s], pa.int64())})

    def within(t: pa.Table) -> pa.Table:
        return out(t, kendall_counts(t.column("__x").to_numpy(), t.column("__y").to_numpy())[1])

    def across(t: pa.Table) -> pa.Table:
        x, y, p = (t.column(c).to_numpy() for c in ("__x", "__y", "__p"))
        order = np.argsort(p, kind="stable")
        x, y, p = x[order], y[order], p[order]
        parts = np.split(np.arange(len(p)), np.flatnonzero(np.diff(p)) + 1)
        return out(t, kendall_counts(x, y)[1] - sum(kendall_counts(x[i], y[i])[1] for i in parts if len(i) > 1))

    def table(t: pa.Table) -> pa.Table:
        p, q, n = (t.column(c).to_numpy() for c in ("__p", "__q", "__n"))
        grid = np.zeros((p.max() + 1, q.max() + 1), np.int64)
        grid[p, q] = n
        below = np.zeros((grid.shape[0] + 1, grid.shape[1] + 1), np.int64)
        below[1:, 1:] = grid.cumsum(0).cumsum(1)
        left, right = below[:-1, :-1], below[:-1, -1:] - below[:-1, 1:]  # of smaller p: those of smaller and of larger q
        return out(t, int((grid * (left - right)).sum()))

    schema = f"{head}, s long"
    parts = placed.where(even("__p")).groupBy(*names, "__p").applyInArrow(within, schema)
    parts = parts.union(placed.where(even("__q")).groupBy(*names, "__q").applyInArrow(across, schema))
    parts = parts.union(placed.groupBy(*names, "__p", "__q").agg(F.count(F.lit(1)).alias("__n")).groupBy(*names).applyInArrow(table, schema))
    tied = []
    t = F.col("t").cast("double")
    for c in ("__x", "__y"):
        counts = placed.groupBy(*names, c).agg(F.count(F.lit(1)).alias("t"))
        tied.append(counts.groupBy(*names).agg(F.sum("t").alias("n"), F.sum(t * (t - 1) / 2).alias(f"t{c}"), F.sum(t * (t - 1) * (2 * t + 5)).alias(f"v{c}"), F.sum(t * (t - 1) * (t - 2)).alias(f"w{c}")))
    s = parts.groupBy(*names).agg(F.sum("s").alias("s"))
    every = [s, tied[0], tied[1].drop("n")]
    joined = every[0]
    for k, e in enumerate(every[1:]):
        e = e.select(*[F.col(c).alias(f"{c}_{k}") for c in names], *[c for c in e.columns if c not in names])
        on = None
        for c in names:
            equal = joined[c].eqNullSafe(e[f"{c}_{k}"])
            on = equal if on is None else on & equal
        joined = joined.join(e, on).drop(*[f"{c}_{k}" for c in names])
    n = F.col("n").cast("double")
    total, m = n * (n - 1) / 2, n * (n - 1)
    tau = F.try_divide(F.col("s").cast("double"), F.sqrt((total - F.col("t__x")) * (total - F.col("t__y"))))
    var = (m * (2 * n + 5) - F.col("v__x") - F.col("v__y")) / 18 + 2 * F.col("t__x") * F.col("t__y") / m + F.col("w__x") * F.col("w__y") / (9 * m * (n - 2))
    return joined.select(*[F.col(f"__g{i}").alias(c) for i, c in enumerate(by)], "n", tau.alias("tau"), F.when(var > 0, F.col("s") / F.sqrt(var)).alias("z"))


def kendall(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """(by, n, tau, z): tau-b and its normal score with the variance corrected for ties; null where undefined.

    A group of KENDALL_ROWS pairs or fewer is counted in one task, a larger one
    in blocks over the cluster.
    """
    rows = complete_pairs(df, x, y).select(*by, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    head = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(by)]]

    def run(t: pa.Table) -> pa.Table:
        a, b = t.column("__x").to_numpy(), t.column("__y").to_numpy()
        n, s, _, _, _ = kendall_counts(a, b)
        tau, var = kendall_tau(a, b), _kendall_variance(a, b)
        z = s / var**0.5 if var > 0 else np.nan
        keys = {c: t.column(c).slice(0, 1) for c in by}
        null = lambda v: [None if np.isnan(v) else float(v)]
        return pa.table(keys | {"n": pa.array([n], pa.int64()), "tau": pa.array(null(tau), pa.float64()), "z": pa.array(null(z), pa.float64())})

    schema = ", ".join([*head, "n long", "tau double", "z double"])
    keys = large_groups(rows, by, KENDALL_ROWS)
    if keys is None:
        return rows.groupBy(*by).applyInArrow(run, schema)
    small = of_groups(rows, keys, by, "left_anti").groupBy(*by).applyInArrow(run, schema)
    return small.unionByName(_kendall_in_blocks(of_groups(rows, keys, by, "left_semi"), by))


def with_kendall_pvalue(df: DataFrame) -> DataFrame:
    return df.withColumn("pvalue", normal_pvalue(F.col("z")))


def rbo(ranked: DataFrame, by: Sequence[str], first: str, second: str, p: float = 0.9, large: bool = False) -> DataFrame:
    """(by, k, rbo): extrapolated rank-biased overlap of two rankings 1..k of the same items.

    An item is in both prefixes of depth d from d = the worse of its two ranks
    on; a running count of those gives each depth's overlap without any list,
    in one task a group or, if `large` or without a key, in many.
    """
    if not 0 < p < 1:
        raise ValueError("p must lie between 0 and 1")
    if large or not by:  # at each depth one row, with how many items enter there
        entering = ranked.groupBy(*by, F.greatest(first, second).cast("int").alias("__depth")).agg(F.count(F.lit(1)).alias("__in"))
        depths = ranked.select(*by, F.col(first).cast("int").alias("__depth"), F.lit(0).cast("long").alias("__in"))
        each = entering.unionByName(depths).groupBy(*by, "__depth").agg(F.sum("__in").alias("__in"))
        runs = running(each, by, ["__depth"], {"__overlap": Running("sum", F.col("__in"))})
    else:
        enters = ranked.select(*by, F.greatest(first, second).alias("__d"), F.lit(1).alias("__in"), F.lit(None).cast("int").alias("__depth"))
        depths = ranked.select(*by, F.col(first).alias("__d"), F.lit(0).alias("__in"), F.col(first).cast("int").alias("__depth"))
        upto = Window.partitionBy(*by).orderBy("__d").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        runs = enters.unionByName(depths).withColumn("__overlap", F.sum("__in").over(upto)).where(F.col("__depth").isNotNull())
    term = F.lit(1 - p) * F.pow(F.lit(p), F.col("__depth") - 1) * F.col("__overlap") / F.col("__depth")
    total = F.sum(term) + F.pow(F.lit(p), F.max("__depth"))
    return runs.groupBy(*by).agg(F.max("__depth").alias("k"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)).alias("rbo"))


def rbo_of_scores(df: DataFrame, by: Sequence[str], model: str, rank: str, elo: str, p: float = 0.9) -> DataFrame:
    """Overlap of the order by (rank, model) and that by (Elo downwards, model), of the models that have both."""
    both = df.where(F.col(rank).isNotNull() & is_number(F.col(elo)))
    ranked = positions(positions(both, by, [rank, model], "__first"), by, [F.desc(elo), model], "__second")
    return rbo(ranked, by, "__first", "__second", p)

