"""Five hypotheses on what goes with agreement, for each of its three measures, and Holm's correction over all tests.

The input is one row a benchmark; a metric's rows are packed into arrays, and
blocks of draws are computed by the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import cleaning
from tallyloom.functions.distributions import chi2_sf, t_two_sided
from tallyloom.operators import correction, regression, resampling
from tallyloom.operators.draws import large_groups, map_blocks
from tallyloom.operators.relational import is_number

METRICS = ("spearman_rho", "kendall_tau", "rbo")
DRAWS = 5000
#: Rows that the input may have: benchmarks, not scores.
MOST_ROWS = 100_000

#: What a block of draws gives: a test's results once, and a row for each draw.
FOUND = {"hypothesis": "string", "primary_test": "string", "statistic": "double", "effect_size": "double", "effect_size_type": "string", "slope": "double", "intercept": "double", "p_raw": "double", "sample_size": "int", "drawn": "double"}
SCHEMA = "test string, hypothesis string, metric string, primary_test string, statistic double, effect_size double, effect_size_type string, slope double, intercept double, ci_lower double, ci_upper double, p_raw double, sample_size int"


def _pearson(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    r, n = float(resampling.row_correlation(x, y)), len(x)
    return r, t_two_sided(r * math.sqrt((n - 2) / max(1e-300, 1 - r * r)), n - 2)


def _kruskal(groups: Sequence[np.ndarray]) -> tuple[float, float]:
    values = np.concatenate(groups)
    n, ranks = len(values), resampling.midranks(values)
    cuts = np.split(ranks, np.cumsum([len(g) for g in groups])[:-1])
    h = 12 / (n * (n + 1)) * sum(c.sum() ** 2 / len(c) for c in cuts) - 3 * (n + 1)
    ties = np.unique(values, return_counts=True)[1].astype(float)
    h /= 1 - (ties**3 - ties).sum() / (n**3 - n)
    return float(h), chi2_sf(float(h), len(groups) - 1)


def _scale(rows: dict[str, np.ndarray], y: np.ndarray) -> dict:
    r, p = _pearson(rows["log_questions"], y)
    return {"primary_test": "pearson", "statistic": r, "effect_size": r, "effect_size_type": "pearson_r", "p_raw": p}


def _complexity(rows: dict[str, np.ndarray], y: np.ndarray) -> dict:
    level = rows["complexity_rank"]
    groups = [y[level == k] for k in sorted(cleaning.COMPLEXITY.values())]
    if any(not len(g) for g in groups):
        raise ValueError("a level of complexity has no benchmark")
    h, p = _kruskal(groups)
    slope, intercept = np.polyfit(level, y, 1)
    r, _ = _pearson(level, y)
    return {"primary_test": "kruskal", "statistic": h, "effect_size": r * r, "effect_size_type": "r_squared", "slope": float(slope), "intercept": float(intercept), "p_raw": p}


def _recency(rows: dict[str, np.ndarray], y: np.ndarray) -> dict:
    x = rows["day"]
    rho = resampling.spearman_rho(x, y)
    n = len(x)
    p = resampling.permutation_pvalue(x, y, resampling.spearman_rho) if n < 30 else t_two_sided(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)
    return {"primary_test": "spearman", "statistic": rho, "effect_size": rho, "effect_size_type": "spearman_rho", "p_raw": p}


def _design(rows: dict[str, np.ndarray]) -> np.ndarray:
    return np.column_stack([np.ones(len(rows["difficulty"])), rows["difficulty"], rows["cv"]])


def _difficulty_and_variation(rows: dict[str, np.ndarray], y: np.ndarray) -> tuple[dict, dict]:
    """H5 and H4, two coefficients of one fit."""
    beta, p = regression.huber(_design(rows), y)
    one = lambda k: {"primary_test": "huber", "statistic": float(beta[k]), "effect_size": float(beta[k]), "effect_size_type": "beta_coefficient", "intercept": float(beta[0]), "p_raw": float(p[k])}
    return one(1), one(2)


#: Draws of a block: a robust fit takes far more than its random numbers.
FITS = 250
PREDICTORS = ("log_questions", "complexity_rank", "day", "difficulty", "cv")


def test_table(spark: SparkSession, features: DataFrame, order: str = "benchmark_id", draws: int = DRAWS, metrics: Sequence[str] = METRICS, progress: Callable[[int], None] | None = None) -> DataFrame:
    """A row for each of H1 to H5 and each metric; rows of `features` in the given order feed the resamplers.

    A metric is a group; its resamples, which H4 and H5 share, are drawn in
    blocks over the cluster, and the first block does the tests themselves.
    A result that isn't finite, or a level of complexity without a benchmark,
    is an error.
    """
    chosen = features.withColumns({"log_questions": F.ln("question_count"), "complexity_rank": cleaning.complexity_rank(F.col("complexity")), "day": cleaning.day_number(F.col("release_date"))})
    measures = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("y")) for m in metrics]))
    rows = chosen.select(F.col(order).alias("__order"), *PREDICTORS, measures.alias("m")).select("__order", *PREDICTORS, "m.*")
    if large_groups(rows, ["metric"], MOST_ROWS) is not None:
        raise ValueError("too many benchmarks for one table of tests")

    def work(values: list[np.ndarray], first: int, last: int, _: int) -> dict[str, np.ndarray]:
        whole = dict(zip([*PREDICTORS, "y"], values, strict=True))

        def subset(*needed: str) -> tuple[dict[str, np.ndarray], np.ndarray]:
            good = np.all([np.isfinite(whole[c]) for c in (*needed, "y")], axis=0)
            return {c: whole[c][good] for c in needed}, whole["y"][good]

        scale, level, day, robust = subset("log_questions"), subset("complexity_rank"), subset("day"), subset("difficulty", "cv")
        out = []
        if not first:
            h5, h4 = _difficulty_and_variation(*robust)
            for h, result, used in (("H1", _scale(*scale), scale), ("H2", _complexity(*level), level), ("H3", _recency(*day), day), ("H4", h4, robust), ("H5", h5, robust)):
                if not (math.isfinite(result["p_raw"]) and math.isfinite(result["effect_size"])):
                    raise ValueError(f"{h} isn't finite")
                out.append({"hypothesis": h, "sample_size": len(used[1]), **result})
        h3 = resampling.RESAMPLED["spearman"](day[0]["day"], day[1], resampling.drawn_rows(len(day[1]), first, last))
        both = regression.huber_resampled(_design(robust[0]), robust[1], resampling.drawn_rows(len(robust[1]), first, last))[:, 1:]
        out += [{"hypothesis": h, "drawn": float(v)} for h, x in (("H3", h3), ("H5", both[:, 0]), ("H4", both[:, 1])) for v in x]
        return {c: np.array([r.get(c) for r in out], object) for c in FOUND}

    schema = ", ".join(f"{c} {t}" for c, t in FOUND.items())
    found = map_blocks(rows, ["metric"], ["__order"], [*PREDICTORS, "y"], draws, work, schema, most=FITS, progress=progress)
    good = F.when(is_number(F.col("drawn")), F.col("drawn"))
    sums = found.groupBy("metric", "hypothesis").agg(*[F.max(c).alias(c) for c in FOUND if c not in ("hypothesis", "drawn")], F.percentile(good, F.array(F.lit(0.025), F.lit(0.975))).alias("__q"))
    test = F.concat("hypothesis", F.lit("_"), "metric").alias("test")
    made = sums.select(test, "*", F.col("__q")[0].alias("ci_lower"), F.col("__q")[1].alias("ci_upper"))
    return made.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in SCHEMA.split(", ")])


def corrected(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Tests with corrected p-values, significance and a sentence on each."""
    return correction.holm(tests, [], "p_raw", ["test"], alpha).withColumn("conclusion", conclusion())


def conclusion():
    """A test's outcome in words."""
    head = F.when(F.col("is_significant"), "Statistically significant after correction").otherwise("Not statistically significant after correction")
    # How each effect size is called.
    called = {"beta_coefficient": "Effect size (β)", "spearman_rho": "Spearman correlation (ρ)", "pearson_r": "Pearson correlation (r)", "r_squared": "Ordinal-regression effect size (R²)", "median_difference": "Median difference"}
    name = F.coalesce(F.create_map(*[F.lit(x) for kv in called.items() for x in kv])[F.col("effect_size_type")], F.lit("Effect size"))
    effect = F.when(F.col("effect_size").isNotNull(), F.format_string("%s = %.3f.", name, F.col("effect_size"))).otherwise("")
    return F.when(F.col("p_raw").isNull(), "Insufficient data for statistical testing.").otherwise(F.concat(head, F.format_string(" (p_corrected = %.4f). ", F.col("p_corrected")), effect))
