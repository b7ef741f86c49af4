"""Bootstrap, permutation and Monte Carlo, each seeded and independent of the partitioning.

All of them compute blocks of draws side by side (see draws.py).
`resampled_agreement` draws from one generator a group, over rows sorted by an
id, as published tables were drawn: a block passes over what the blocks before
it have drawn.  `bootstrap_quantiles`, `bootstrap_rho`, `permutation_rho` and
`monte_carlo_rho` draw by an integer generator that SQL can repeat and that
gives each draw directly; groups too large to be packed take their draws as
joins over the cluster, with the same numbers.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.agreement import correlation, kendall_tau, spearman
from tallyloom.operators.draws import large_groups, map_blocks, of_groups
from tallyloom.operators.ranking import midrank
from tallyloom.operators.relational import is_number, quantiles

SEED = 42
#: Random numbers of a simulation that are held at once, unless one trial has more.
NUMBERS = 1 << 20


def midranks(values: np.ndarray) -> np.ndarray:
    """Midranks along the last axis."""
    # only NaN have ranks that depend on the order of equals
    order = np.argsort(values, axis=-1, kind="stable" if np.isnan(values).any() else None)
    ordered = np.take_along_axis(values, order, -1)
    n = values.shape[-1]
    place = np.broadcast_to(np.arange(n), values.shape)
    new = np.ones(values.shape, bool)
    new[..., 1:] = ordered[..., 1:] != ordered[..., :-1]
    if new.all():
        out = np.empty(values.shape)
        np.put_along_axis(out, order, place + 1.0, -1)
        return out
    first = np.maximum.accumulate(np.where(new, place, 0), axis=-1)
    last_flag = np.ones(values.shape, bool)
    last_flag[..., :-1] = new[..., 1:]
    last = np.flip(np.minimum.accumulate(np.flip(np.where(last_flag, place, n), -1), axis=-1), -1)
    out = np.empty(values.shape)
    np.put_along_axis(out, order, (first + last) / 2 + 1, -1)
    return out


def row_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pearson's r of each pair of rows; NaN where one is constant."""
    a, b = a - a.mean(-1, keepdims=True), b - b.mean(-1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (a * b).sum(-1) / np.sqrt((a * a).sum(-1) * (b * b).sum(-1))


def spearman_rho(x: np.ndarray, y: np.ndarray) -> float:
    return float(row_correlation(midranks(x), midranks(y)))


STATISTICS: dict[str, Callable[[np.ndarray, np.ndarray], float]] = {"spearman": spearman_rho, "kendall": kendall_tau}
_BUILT_IN = dict(STATISTICS)


def register_statistic(name: str, f: Callable[[np.ndarray, np.ndarray], float]) -> None:
    """Make a statistic of paired arrays known to the resamplers by name."""
    STATISTICS[name] = f


def bootstrap_vector(columns: Sequence[np.ndarray], f: Callable[..., np.ndarray], size: int, draws: int = 2000, seed: int = SEED, level: float = 0.95, progress: Callable[[int], None] | None = None) -> list[tuple[float, float]]:
    """Percentile intervals of a vector of `size` statistics over paired resamples.

    A resample whose statistic raises is dropped whole, one that isn't finite
    in that statistic only; no rows give NaN.
    """
    n = len(columns[0])
    if draws < 1 or not 0 < level < 1 or any(len(c) != n for c in columns):
        raise ValueError("draws, level or the lengths of the columns don't fit")
    if n == 0:
        return [(np.nan, np.nan)] * size
    state, found = np.random.RandomState(seed), []
    for k in range(draws):
        at = state.choice(n, n, replace=True)
        try:
            value = np.asarray(f(*[c[at] for c in columns]), float)
        except (ArithmeticError, np.linalg.LinAlgError, ValueError):
            continue
        if value.shape != (size,):
            raise TypeError(f"the statistic has shape {value.shape}, not ({size},)")
        found.append(value)
        if progress:
            progress(k + 1)
    values = np.array(found).reshape(-1, size)
    tails = [50 * (1 - level), 100 - 50 * (1 - level)]
    out = []
    for c in values.T:
        c = c[np.isfinite(c)]
        out.append(tuple(np.percentile(c, tails).tolist()) if len(c) else (np.nan, np.nan))
    return out


def bootstrap(x: np.ndarray, y: np.ndarray, f: Callable[[np.ndarray, np.ndarray], float], draws: int = 2000, seed: int = SEED) -> tuple[float, float]:
    return bootstrap_vector([x, y], lambda a, b: np.array([f(a, b)]), 1, draws, seed)[0]


def permutation_pvalue(x: np.ndarray, y: np.ndarray, f: Callable[[np.ndarray, np.ndarray], float], draws: int = 2000, seed: int = SEED) -> float:
    """Two-sided p of random pairings, the observed one counted in."""
    seen, rng = f(x, y), np.random.default_rng(seed)
    if not np.isfinite(seen):
        return np.nan
    if f is spearman_rho:
        rx, ry = midranks(x), midranks(y)
        null = row_correlation(rx[None, :], rng.permuted(np.tile(ry, (draws, 1)), axis=1))
    else:
        null = np.array([f(x, rng.permutation(y)) for _ in range(draws)])
    slack = 1e-14 * max(1.0, abs(seen))
    high, low = (null >= seen - slack).sum() + 1, (null <= seen + slack).sum() + 1
    return float(min(1.0, 2 * min(high, low) / (draws + 1)))


#: Models up to which the signs of all pairs are held, for Kendall's tau of many resamples at once.
SIGNS = 4096


def _codes(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1]


def _resampled_ranks(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Midranks within each row of drawn positions, by counting how often each value was drawn."""
    kinds, drawn = int(codes.max(initial=0)) + 1, codes[at]
    place = np.arange(len(at))[:, None] * kinds + drawn
    count = np.bincount(place.ravel(), minlength=len(at) * kinds).reshape(len(at), kinds)
    return np.take_along_axis(np.cumsum(count, axis=1) - (count - 1) / 2.0, drawn, 1)


def _spearman_of(x: np.ndarray, y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    x, y = _codes(x), _codes(y)
    return lambda at: row_correlation(_resampled_ranks(x, at), _resampled_ranks(y, at))


def _spearman_resampled(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _spearman_of(x, y)(at)


class _Weighed:
    """tau-b of pairs that are weighed, as resamples are: what doesn't depend on the weights is worked out once.

    Pairs stand in the order of x and, within equal x, of y.  A discordant pair
    is one with the larger y first.  Of two unequal codes of y the highest bit
    in which they differ tells which is larger, so for each bit, from the
    highest, the pairs are parted by the bits above it and in each part the
    weight of ones before a zero is counted: as many passes as a code of y has
    bits.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        x, y = _codes(x), _codes(y)
        if x.max(initial=0) < y.max(initial=0):  # tau is the same either way round
            x, y = y, x
        self.order = order = np.lexsort((y, x))
        x, y = x[order], y[order]
        new = np.append(True, x[1:] != x[:-1])
        self.x_starts, self.both_starts = np.flatnonzero(new), np.flatnonzero(new | np.append(True, y[1:] != y[:-1]))
        self.levels, at = [], np.arange(len(y))
        for bit in reversed(range(int(y.max(initial=0)).bit_length())):
            one = ((y[at] >> bit) & 1).astype(bool)
            above = y[at] >> (bit + 1)
            starts = np.flatnonzero(np.append(True, above[1:] != above[:-1]))
            turn = np.lexsort((one, above))  # stable: within a part zeros, then ones, each in the order of x
            self.levels.append((at, one, starts))
            at = at[turn]
        self.y_order, y = at, y[at]
        self.y_starts = np.flatnonzero(np.append(True, y[1:] != y[:-1]))

    @staticmethod
    def _tied(weight: np.ndarray, starts: np.ndarray) -> int:
        t = np.add.reduceat(weight, starts)
        return int((t * (t - 1) // 2).sum())

    def tau(self, weight: np.ndarray) -> float:
        """weight: whole numbers, one for each pair."""
        w = weight[self.order].astype(np.int64)
        n, discordant = int(w.sum()), 0
        for at, one, starts in self.levels:
            v = w[at]
            ones = np.where(one, v, 0)
            zeros = v - ones
            before = np.cumsum(ones)
            base = before[starts] - ones[starts]
            discordant += int((zeros * before).sum()) - int((np.add.reduceat(zeros, starts) * base).sum())
        tx, ty, both = self._tied(w, self.x_starts), self._tied(w[self.y_order], self.y_starts), self._tied(w, self.both_starts)
        total = n * (n - 1) // 2
        scale = float(total - tx) * float(total - ty)
        return (total - tx - ty + both - 2 * discordant) / scale**0.5 if scale > 0 else np.nan


def _kendall_of(x: np.ndarray, y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """tau-b of each row of drawn positions: a resample weighs each model by how often it was drawn."""
    n = len(x)
    if n <= SIGNS:
        return _kendall_by_signs(x, y)
    weighed = _Weighed(x, y)
    return lambda at: np.array([weighed.tau(np.bincount(p, minlength=n)) for p in at])


def _kendall_resampled(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _kendall_of(x, y)(at)


def _kendall_by_signs(x: np.ndarray, y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    n = len(x)
    sign = lambda v: np.sign(v[:, None] - v[None, :]).astype(np.float32)
    signs = sign(x) * sign(y)
    total = n * (n - 1) / 2

    def tied(weight: np.ndarray, v: np.ndarray) -> np.ndarray:
        order = np.argsort(v, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(v[order]) != 0))
        count = np.add.reduceat(weight[:, order], starts, axis=1)
        return (count * (count - 1)).sum(1) / 2

    def tau(at: np.ndarray) -> np.ndarray:
        weight = np.bincount((np.arange(len(at))[:, None] * n + at).ravel(), minlength=len(at) * n).reshape(len(at), n)
        agree = (weight.astype(np.float32) @ signs).astype(float)  # whole numbers of at most n
        excess = (agree * weight).sum(1) / 2
        with np.errstate(invalid="ignore", divide="ignore"):
            return excess / np.sqrt((total - tied(weight, x)) * (total - tied(weight, y)))

    return tau


#: Statistics of all rows of drawn positions at once; one without such a form is called row by row.
RESAMPLED: dict[str, Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]] = {"spearman": _spearman_resampled, "kendall": _kendall_resampled}
#: The same for two given sides, of which what no draw changes is worked out once.
RESAMPLED_OF: dict[str, Callable[[np.ndarray, np.ndarray], Callable[[np.ndarray], np.ndarray]]] = {"spearman": _spearman_of, "kendall": _kendall_of}


def drawn_rows(n: int, first: int, last: int, seed: int = SEED) -> np.ndarray:
    """The positions of draws first to last of a seeded generator, a row each."""
    return Drawn(n, seed)(first, last)


class Drawn:
    """The positions of a seeded generator's draws, a row each: asked in order it goes on, else it passes over what comes before."""

    def __init__(self, n: int, seed: int = SEED):
        self.n, self.seed = n, seed
        self.state, self.next = np.random.RandomState(seed), 0

    def __call__(self, first: int, last: int) -> np.ndarray:
        if first < self.next:
            self.state, self.next = np.random.RandomState(self.seed), 0
        step = max(1, NUMBERS // max(1, self.n))
        for k in range(self.next, first, step):
            self.state.randint(0, self.n, size=(min(step, first - k), self.n))
        self.next = last
        return self.state.randint(0, self.n, size=(last - first, self.n))


def _one(f: Callable[[np.ndarray, np.ndarray], float], x: np.ndarray, y: np.ndarray) -> float:
    try:
        return float(f(x, y))
    except (ArithmeticError, np.linalg.LinAlgError, ValueError):
        return np.nan


def _tails(f: Callable[[np.ndarray, np.ndarray], float], x: np.ndarray, y: np.ndarray, seen: float, first: int, last: int, seed: int) -> tuple[int, int]:
    """How many of a block's random pairings reach the statistic seen from above and from below."""
    rng = np.random.default_rng(seed)
    if f is spearman_rho:
        null = row_correlation(midranks(x)[None, :], rng.permuted(np.tile(midranks(y), (last, 1)), axis=1)[first:])
    else:
        turned = [rng.permutation(y) for _ in range(last)][first:]
        if f is kendall_tau and len(x) <= 64:
            i, j = np.triu_indices(len(x), 1)
            agree = np.sign(np.array(turned)[:, i] - np.array(turned)[:, j]) @ np.sign(x[i] - x[j])
            scale = (np.count_nonzero(x[i] != x[j]) * float(np.count_nonzero(y[i] != y[j]))) ** 0.5
            null = agree / scale
        else:
            null = np.array([f(x, t) for t in turned])
    slack = 1e-14 * max(1.0, abs(seen))
    return int((null >= seen - slack).sum()), int((null <= seen + slack).sum())


def resampled_agreement(df: DataFrame, by: Sequence[str], model: str, x: str, y: str, statistics: Sequence[str] = ("spearman", "kendall"), draws: int = 2000, small: int = 30, progress: Callable[[int], None] | None = None) -> DataFrame:
    """(by, statistic, n, value, ci_lower, ci_upper, permutation_p): p only below `small` pairs; progress: told of the finished draws."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    chosen, resampled = {s: STATISTICS[s] for s in statistics}, {s: RESAMPLED_OF[s] for s in statistics if STATISTICS[s] is _BUILT_IN.get(s)}
    held: dict = {}  # of the stretch that a task is at: the generator and what no draw changes

    def work(values: list[np.ndarray], first: int, last: int, _: int) -> dict[str, np.ndarray]:
        a, b = values
        n, parts = len(a), []
        if held.get("values") is not values:
            held.update(values=values, drawn=Drawn(n), seen={s: _one(f, a, b) if n > 1 else np.nan for s, f in chosen.items()}, forms={s: of(a, b) for s, of in resampled.items()} if n > 1 else {})
        at = held["drawn"](first, last)
        for name, f in chosen.items():
            seen = held["seen"][name]
            if n < 2:
                drawn = np.array([np.nan])
            elif name in resampled:
                drawn = held["forms"][name](at)
            else:
                drawn = np.array([_one(f, a[p], b[p]) for p in at])
            high, low = np.zeros(len(drawn), int), np.zeros(len(drawn), int)
            if 1 < n < small and np.isfinite(seen):
                high[0], low[0] = _tails(f, a, b, seen, first, last, SEED)
            parts.append({"statistic": np.full(len(drawn), name, object), "value": np.full(len(drawn), seen), "drawn": drawn, "high": high, "low": low})
        return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}

    found = map_blocks(rows, by, [model], [x, y], draws, work, "statistic string, value double, drawn double, high long, low long", progress=progress)
    good = F.when(is_number(F.col("drawn")), F.col("drawn"))
    sums = found.groupBy(*by, "statistic").agg(F.max("n").alias("n"), F.max("value").alias("value"), F.percentile(good, F.array(F.lit(0.025), F.lit(0.975))).alias("__q"), F.sum("high").alias("__high"), F.sum("low").alias("__low"))
    p = F.least(F.lit(1.0), 2.0 * (F.least("__high", "__low") + 1) / F.lit(draws + 1.0))
    return sums.select(*by, "statistic", "n", "value", F.col("__q")[0].alias("ci_lower"), F.col("__q")[1].alias("ci_upper"), F.when((F.col("n") < small) & F.col("value").isNotNull(), p).alias("permutation_p"))


def monte_carlo(score: np.ndarray, score_sd: np.ndarray, elo: np.ndarray, elo_sd: np.ndarray, trials: int, rng: np.random.Generator) -> np.ndarray:
    """Spearman's rho of each trial; a trial draws all scores, then all Elo values; NUMBERS of them are held at once."""
    n, found = len(score), []
    step = max(1, NUMBERS // max(1, 2 * n))
    for k in range(0, trials, step):
        noise = rng.standard_normal((min(step, trials - k), 2, n))
        found.append(row_correlation(midranks(score + score_sd * noise[:, 0]), midranks(elo + elo_sd * noise[:, 1])))
    return np.concatenate(found)


def summary_of_trials(rho: np.ndarray) -> dict[str, float | bool]:
    good = rho[np.isfinite(rho)]
    if not len(good):
        return {"simulated_rho": np.nan, "ci_lower": np.nan, "ci_upper": np.nan, "nonpositive_fraction": np.nan, "stable": None}
    low, high = np.percentile(good, [2.5, 97.5])
    return {"simulated_rho": float(good.mean()), "ci_lower": float(low), "ci_upper": float(high), "nonpositive_fraction": float((good <= 0).mean()), "stable": bool(low > 0)}


#: Trials that share a generator.
TRIALS_A_STREAM = 250


def _summary_of_rho(found: DataFrame, by: Sequence[str]) -> DataFrame:
    good = F.when(is_number(F.col("rho")), F.col("rho"))
    sums = found.groupBy(*by).agg(F.max("n").alias("n"), F.avg(good).alias("simulated_rho"), F.percentile(good, F.array(F.lit(0.025), F.lit(0.975))).alias("__q"), F.avg((good <= 0).cast("int")).alias("nonpositive_fraction"))
    return sums.select(*by, "n", "simulated_rho", F.col("__q")[0].alias("ci_lower"), F.col("__q")[1].alias("ci_upper"), "nonpositive_fraction", (F.col("__q")[0] > 0).alias("stable"))


def uncertainty(df: DataFrame, by: Sequence[str], model: str, score: str, score_sd: str, elo: str, elo_sd: str, trials: int = 10_000, seed: int = SEED, least: int = 0, progress: Callable[[int], None] | None = None) -> DataFrame:
    """Monte Carlo of rho for each group; every TRIALS_A_STREAM trials have a generator of their own, seeded by the group's key; a group of fewer than `least` rows is an error."""
    rows = df.dropna(subset=[score, score_sd, elo, elo_sd])
    key = F.pmod(F.xxhash64(*by), F.lit(1 << 31)) if by else F.lit(0)

    def work(values: list[np.ndarray], first: int, last: int, own: int) -> dict[str, np.ndarray]:
        if len(values[0]) < least:
            raise ValueError(f"a group has fewer than {least} models: {len(values[0])}")
        streams = range(first // TRIALS_A_STREAM, -(-last // TRIALS_A_STREAM))
        return {"rho": np.concatenate([monte_carlo(*values, min(TRIALS_A_STREAM, trials - TRIALS_A_STREAM * k), np.random.default_rng([seed, own, k])) for k in streams])}

    found = map_blocks(rows, by, [model], [score, score_sd, elo, elo_sd], trials, work, "rho double", TRIALS_A_STREAM, key, progress=progress)
    return _summary_of_rho(found, by)


def binomial_sd(score: Column, questions: Column) -> Column:
    """Standard error, in points of 100, of a share of right answers."""
    p = score / 100.0
    return F.sqrt(F.try_divide(p * (1 - p), questions)) * 100.0


def interval_sd(half_width: Column) -> Column:
    """The standard deviation behind a 95 % interval's half width."""
    return half_width / 1.96


# Multiplier, increment and modulus of the integer generator, and what sets draws, places and streams apart.
_A, _C, _M, _DRAW, _PLACE, _STREAM = 1103515245, 12345, 2147483648, 104729, 7919, 15485863


def state(draw: Column, place: Column, stream: int = 0) -> Column:
    """A number below 2^31 for a place of a draw, by two rounds of an integer generator; streams differ by what they add."""
    x = (draw * _DRAW + place * _PLACE + (SEED + stream * _STREAM)) % _M
    for _ in range(2):
        x = (x * _A + _C) % _M
    return x


def drawn_position(draw: Column, place: Column, n: Column) -> Column:
    """The position 0..n-1 that a draw has at a place."""
    return (state(draw, place) / F.lit(64)).cast("long") % n


def normal(draw: Column, place: Column, stream: int) -> Column:
    """A standard normal number for a place of a draw, from two streams."""
    u, v = (((state(draw, place, 2 * stream + k) + 0.5) / F.lit(float(_M))) for k in (0, 1))
    return F.sqrt(-2.0 * F.ln(u)) * F.cos(2.0 * math.pi * v)


def _state_of(draw: np.ndarray, place: np.ndarray, stream: int = 0) -> np.ndarray:
    """The same numbers as `state`, a row for each draw."""
    x = (draw[:, None] * _DRAW + place[None, :] * _PLACE + (SEED + stream * _STREAM)) & (_M - 1)  # a power of two
    for _ in range(2):
        x *= _A
        x += _C
        x &= _M - 1
    return x


def _positions_of(first: int, last: int, n: int) -> np.ndarray:
    return (_state_of(np.arange(first, last), np.arange(n)) // 64) % n


def _normal_of(first: int, last: int, n: int, stream: int) -> np.ndarray:
    u, v = ((_state_of(np.arange(first, last), np.arange(n), 2 * stream + k) + 0.5) / float(_M) for k in (0, 1))
    return np.sqrt(-2.0 * np.log(u)) * np.cos(2.0 * math.pi * v)


def _placed(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The complete rows with their place __at in the order, from 0, and the size __n of their group."""
    rows = df.where(functools.reduce(lambda a, b: a & b, [is_number(F.col(c)) for c in columns]))
    placed = rows.withColumn("__at", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
    return placed.select(*by, "__at", F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("__n"), *columns)


def _draws(df: DataFrame, draws: int) -> DataFrame:
    return df.withColumn("__draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("__draw", F.col("__draw").cast("long"))


def _complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(functools.reduce(lambda a, b: a & b, [is_number(F.col(c)) for c in columns]))


def _by_size(rows: DataFrame, by: Sequence[str], small: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Groups that can be packed by `small`, the others by `large`."""
    keys = large_groups(rows, by)
    if keys is None:
        return small(rows)
    return small(of_groups(rows, keys, by, "left_anti")).unionByName(large(of_groups(rows, keys, by, "left_semi")))


def bootstrap_rho(df: DataFrame, by: Sequence[str], order: Sequence[str], x: str, y: str, draws: int = 2000, progress: Callable[[int], None] | None = None) -> DataFrame:
    """(by, ci_lower, ci_upper) of Spearman's rho over paired resamples."""

    def work(values: list[np.ndarray], first: int, last: int, _: int) -> dict[str, np.ndarray]:
        return {"rho": _spearman_resampled(*values, _positions_of(first, last, len(values[0])))}

    def small(rows: DataFrame) -> DataFrame:
        return map_blocks(rows, by, order, [x, y], draws, work, "rho double", progress=progress).select(*by, "rho")

    def large(rows: DataFrame) -> DataFrame:
        placed = _placed(rows, by, order, [x, y])
        asked = _draws(placed.select(*by, "__at", "__n"), draws).select(*by, "__draw", drawn_position(F.col("__draw"), F.col("__at"), F.col("__n")).alias("__at"))
        return spearman(asked.join(placed.drop("__n"), [*by, "__at"]), [*by, "__draw"], x, y).select(*by, "rho")

    return quantiles(_by_size(_complete(df, [x, y]), by, small, large), by, "rho", names=("ci_lower", "ci_upper"))


def permutation_rho(df: DataFrame, by: Sequence[str], order: Sequence[str], x: str, y: str, draws: int = 2000, progress: Callable[[int], None] | None = None) -> DataFrame:
    """(by, n, rho, permutation_p): two-sided p of random pairings, the observed one counted in; a shuffle is an order by random numbers."""
    slack = 1e-9

    def work(values: list[np.ndarray], first: int, last: int, _: int) -> dict[str, np.ndarray]:
        rx, ry = (midranks(v) for v in values)
        seen = row_correlation(rx[None, :], ry[None, :])
        turned = np.argsort(_state_of(np.arange(first, last), np.arange(len(rx))), axis=1, kind="stable")
        null = row_correlation(rx[turned], ry[None, :])
        return {"rho": seen, "high": np.array([(null >= seen - slack).sum()]), "low": np.array([(null <= seen + slack).sum()])}

    def small(rows: DataFrame) -> DataFrame:
        return map_blocks(rows, by, order, [x, y], draws, work, "rho double, high long, low long", progress=progress).select(*by, "n", "rho", "high", "low")

    def large(rows: DataFrame) -> DataFrame:
        ranked = midrank(midrank(_placed(rows, by, order, [x, y]), by, x, "__rx"), by, y, "__ry")
        seen = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("__rx"), F.col("__ry")).alias("rho"))
        shuffled = Window.partitionBy(*by, "__draw").orderBy(state(F.col("__draw"), F.col("__at")), "__at")
        turned = _draws(ranked.select(*by, "__at", "__rx"), draws).select(*by, "__draw", "__rx", (F.row_number().over(shuffled) - 1).cast("long").alias("__at"))
        null = turned.join(ranked.select(*by, "__at", "__ry"), [*by, "__at"]).groupBy(*by, "__draw").agg(correlation(F.col("__rx"), F.col("__ry")).alias("__null"))
        counts = null.join(seen, list(by)).groupBy(*by, "n", "rho").agg(F.count_if(F.col("__null") >= F.col("rho") - slack).alias("high"), F.count_if(F.col("__null") <= F.col("rho") + slack).alias("low"))
        return counts.select(*by, "n", "rho", "high", "low")

    counts = _by_size(_complete(df, [x, y]), by, small, large).groupBy(*by).agg(F.max("n").alias("n"), F.max("rho").alias("rho"), F.sum("high").alias("__high"), F.sum("low").alias("__low"))
    p = F.least(F.lit(1.0), 2.0 * (F.least("__high", "__low") + 1) / F.lit(draws + 1.0))
    return counts.select(*by, "n", "rho", F.when(F.col("rho").isNotNull(), p).alias("permutation_p"))


def monte_carlo_rho(df: DataFrame, by: Sequence[str], order: Sequence[str], score: str, score_sd: str, elo: str, elo_sd: str, trials: int = 10_000, progress: Callable[[int], None] | None = None) -> DataFrame:
    """(by, n, simulated_rho, ci_lower, ci_upper, nonpositive_fraction, stable) of trials spread over the cluster."""
    columns = [score, score_sd, elo, elo_sd]

    def work(values: list[np.ndarray], first: int, last: int, _: int) -> dict[str, np.ndarray]:
        n = len(values[0])
        a, b = (v + sd * _normal_of(first, last, n, k) for k, v, sd in ((1, *values[:2]), (2, *values[2:])))
        return {"rho": row_correlation(midranks(a), midranks(b))}

    def small(rows: DataFrame) -> DataFrame:
        return map_blocks(rows, by, order, columns, trials, work, "rho double", progress=progress).select(*by, "n", "rho")

    def large(rows: DataFrame) -> DataFrame:
        at = (F.col("__draw"), F.col("__at"))
        noisy = _draws(_placed(rows, by, order, columns), trials).select(*by, "__draw", (F.col(score) + F.col(score_sd) * normal(*at, 1)).alias("__x"), (F.col(elo) + F.col(elo_sd) * normal(*at, 2)).alias("__y"))
        return spearman(noisy, [*by, "__draw"], "__x", "__y").select(*by, "n", "rho")

    return _summary_of_rho(_by_size(_complete(df, columns), by, small, large), by)


def bootstrap_quantiles(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, draws: int, statistic: Callable[[np.ndarray], np.ndarray] | None = None, progress: Callable[[int], None] | None = None) -> DataFrame:
    """(by, ci_lower, ci_upper) of the mean over resamples, or of another statistic of the rows of a matrix, which takes packed groups only."""
    of_rows = statistic or (lambda drawn: drawn.mean(1))

    def work(values: list[np.ndarray], first: int, last: int, _: int) -> dict[str, np.ndarray]:
        return {"s": of_rows(values[0][_positions_of(first, last, len(values[0]))])}

    def small(rows: DataFrame) -> DataFrame:
        return map_blocks(rows, by, order, [value], draws, work, "s double", progress=progress).select(*by, "s")

    def large(rows: DataFrame) -> DataFrame:
        if statistic:
            raise ValueError("a group is too large for a statistic of one's own")
        placed = _placed(rows, by, order, [value])
        asked = _draws(placed.select(*by, "__at", "__n"), draws).select(*by, "__draw", drawn_position(F.col("__draw"), F.col("__at"), F.col("__n")).alias("__at"))
        return asked.join(placed.drop("__n"), [*by, "__at"]).groupBy(*by, "__draw").agg(F.avg(value).alias("s")).select(*by, "s")

    return quantiles(_by_size(_complete(df, [value]), by, small, large), by, "s", names=("ci_lower", "ci_upper"))
