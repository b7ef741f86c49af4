"""Monte Carlo of agreement under the uncertainty of scores and of Elo values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import cleaning
from tallyloom.operators import ranking, relational, resampling

TRIALS, LEAST_MODELS = 10_000, 5
SCHEMA = "benchmark_id string, n long, simulated_rho double, ci_lower double, ci_upper double, nonpositive_fraction double, stable boolean"


def arena_with_sd(arena: DataFrame) -> DataFrame:
    """(category, model_id, elo, elo_sd) of raw (category, row_no, model_raw, score_raw, ci_raw); of a model's rows the last counts, one without a number is left out."""
    parsed = arena.select("category", "row_no", F.col("model_raw").alias("model_id"), cleaning.parse_digits(F.col("score_raw")).alias("elo"), resampling.interval_sd(cleaning.parse_digits(F.col("ci_raw"))).alias("elo_sd"))
    return ranking.first_per_key(parsed.where(F.col("elo").isNotNull() & F.col("elo_sd").isNotNull()), ["category", "model_id"], [F.desc("row_no")]).drop("row_no")


def in_range(df: DataFrame, score: str, name: str, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """The rows, if every score lies within the bounds; one outside is an error that names its row's `name`."""
    outside = (F.col(score) < low) | (F.col(score) > high)
    error = F.raise_error(F.concat(F.col(name).cast("string"), F.lit(f": a score is outside {low:g} to {high:g}")))
    return df.withColumn(score, F.when(outside, error.cast(df.schema[score].dataType)).otherwise(F.col(score)))


def inputs(scores: DataFrame, arena: DataFrame, metadata: DataFrame) -> DataFrame:
    """Common models of each benchmark and its category's arena, with both standard deviations; scores must be 0 to 100."""
    meta = relational.small(metadata.select("benchmark_id", "category", "question_count"))
    joined = scores.join(meta, "benchmark_id").join(arena, ["category", "model_id"])
    uncounted = F.when(F.coalesce(F.col("question_count"), F.lit(0)) <= 0, F.raise_error(F.concat(F.col("benchmark_id"), F.lit(": no positive question count"))))
    checked = in_range(joined, "score", "benchmark_id").withColumn("score", F.coalesce(uncounted.cast("double"), F.col("score")))
    return checked.withColumn("score_sd", resampling.binomial_sd(F.col("score"), F.col("question_count")))


def too_few(rows: DataFrame, least: int = LEAST_MODELS) -> DataFrame:
    """(benchmark_id, n, error) of benchmarks that `simulate` refuses: fewer than `least` common models."""
    n = F.col("n").cast("string")
    counts = rows.groupBy("benchmark_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least)
    return counts.select("benchmark_id", "n", F.concat(F.lit(f"a group has fewer than {least} models: "), n).alias("error"))


def simulate(rows: DataFrame, trials: int = TRIALS, seed: int = resampling.SEED) -> DataFrame:
    """Every benchmark with a generator of its own, side by side; fewer than LEAST_MODELS common models are an error."""
    return resampling.uncertainty(rows, ["benchmark_id"], "model_id", "score", "score_sd", "elo", "elo_sd", trials, seed, LEAST_MODELS)


def simulate_in_order(rows: DataFrame, order: DataFrame, trials: int = TRIALS, seed: int = resampling.SEED) -> DataFrame:
    """One generator for all benchmarks, in the order of (benchmark_id, pos), as published tables were drawn.

    The stream is sequential, so this is one task, over at most a board's
    models for each benchmark; `simulate` is the form that scales.
    """
    ordered = rows.join(relational.small(order.select("benchmark_id", "pos")), "benchmark_id").select("benchmark_id", "pos", "model_id", "score", "score_sd", "elo", "elo_sd").withColumn("all", F.lit(0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng, out = np.random.default_rng(seed), []
        for _, group in pdf.sort_values(["pos", "model_id"]).groupby("pos", sort=True):
            if len(group) < LEAST_MODELS:
                raise ValueError(f"{group['benchmark_id'].iloc[0]} has fewer than {LEAST_MODELS} common models")
            rho = resampling.monte_carlo(*[group[c].to_numpy(float) for c in ("score", "score_sd", "elo", "elo_sd")], trials, rng)
            out.append({"benchmark_id": group["benchmark_id"].iloc[0], "n": len(group), **resampling.summary_of_trials(rho)})
        return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return ordered.groupBy("all").applyInPandas(run, SCHEMA)
