"""Report tables and the data behind the figures, as text or number columns; drawing is left to others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.cleaning import complexity_rank, day_number, format_pvalue, short_category
from tallyloom.operators import agreement, ranking, relational
from tallyloom.plans.features import ELO_SCORED

ALPHA = 0.05


def bold(text: Column, when: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.concat(F.lit(r"\textbf{"), text, F.lit("}"))).otherwise(text)


def italic(text: Column, when: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.concat(F.lit(r"\textit{"), text, F.lit("}"))).otherwise(text)


def number(c: Column, digits: int = 3) -> Column:
    return F.when(c.isNull() | F.isnan(c), "N/A").otherwise(F.format_string(f"%.{digits}f", c))


def hypothesis_name(test: Column) -> Column:
    # What the hypotheses are about.
    about = {"H1": "Scale", "H2": "Complexity", "H3": "Recency", "H4": "Variance", "H5": "Difficulty"}
    code = F.substring(test, 1, 2)
    return F.coalesce(F.concat(code, F.lit(" ("), F.create_map(*[F.lit(x) for kv in about.items() for x in kv])[code], F.lit(")")), test)


def hypothesis_results(report: DataFrame, metric: str = "spearman_rho") -> DataFrame:
    """Name, effect size, interval, raw and corrected p of the tests on one metric."""
    rows = report.where(F.col("metric") == metric)
    interval = F.when(F.col("ci_lower").isNull(), "--").otherwise(F.format_string("[%.3f, %.3f]", "ci_lower", "ci_upper"))
    return rows.select(hypothesis_name(F.col("test")).alias("hypothesis"), number(F.col("effect_size")).alias("effect"), interval.alias("interval"), format_pvalue(F.col("p_raw")).alias("p_raw"), format_pvalue(F.col("p_corrected")).alias("p_corrected"))


def correlation_summary(features: DataFrame) -> DataFrame:
    """All measures; the least of a measure is bold, those not significant italic, and so is the name where neither correlation is."""
    least = lambda c: F.col(c) == features.agg(F.min(c)).scalar()
    weak = lambda p: F.col(p) > ALPHA
    return features.select(
        italic(F.col("benchmark_id"), weak("spearman_pvalue") & weak("kendall_pvalue")).alias("benchmark"),
        short_category(F.col("category")).alias("category"),
        F.col("n").cast("string").alias("n"),
        italic(bold(number(F.col("spearman_rho")), least("spearman_rho")), weak("spearman_pvalue")).alias("spearman"),
        italic(bold(number(F.col("kendall_tau")), least("kendall_tau")), weak("kendall_pvalue")).alias("kendall"),
        bold(number(F.col("rbo")), least("rbo")).alias("rbo"),
    )


def overall_correlations(features: DataFrame) -> DataFrame:
    """Agreement with the overall board; negative values are bold."""
    shown = lambda c: bold(number(F.col(c)), F.col(c) < 0).alias(c)
    return features.orderBy(F.desc("spearman_rho_overall")).select("benchmark_id", short_category(F.col("category")).alias("category"), shown("spearman_rho_overall"), shown("kendall_tau_overall"), shown("rbo_overall"))


def reference_difficulties(comparison: DataFrame) -> DataFrame:
    """The difficulties of each benchmark and, below, their Pearson correlation, its interval and p."""
    rows = comparison.select(F.col("benchmark_id").alias("row"), number(F.col("difficulty"), 1).alias("difficulty"), number(F.col("reference_difficulty"), 1).alias("reference_difficulty"))
    r = agreement.fisher_interval(agreement.with_t_pvalue(agreement.pearson(comparison, [], "difficulty", "reference_difficulty"), "r", "n", "p"), "r", "n")
    line = lambda name, text: F.struct(F.lit(name).alias("row"), F.coalesce(text, F.lit("N/A")).alias("v"))
    lines = F.explode(F.array(line("Pearson r", number(F.col("r"))), line("95% CI", F.format_string("[%.3f, %.3f]", "ci_lower", "ci_upper")), line("p", format_pvalue(F.col("p")))))
    return rows.unionByName(r.select(lines.alias("l")).select("l.row", F.col("l.v").alias("difficulty"), F.lit("").alias("reference_difficulty")))


def uncertainties(simulated: DataFrame) -> DataFrame:
    """Simulated rho with its interval and the share of trials that aren't positive, italic above 5 %; the strongest original rho first."""
    share = F.col("nonpositive_fraction")
    interval = F.when(F.col("ci_lower").isNull(), "N/A").otherwise(F.format_string("[%.3f, %.3f]", "ci_lower", "ci_upper"))
    return simulated.orderBy(F.desc("spearman_rho")).select("benchmark_id", bold(number(F.col("spearman_rho")), F.col("spearman_rho") < 0).alias("spearman"), bold(number(F.col("simulated_rho")), F.col("simulated_rho") < 0).alias("simulated"), interval.alias("interval"), italic(number(share, 4), share > ALPHA).alias("nonpositive"))


def rank_pairs(scores: DataFrame, elo: DataFrame, benchmark: str, names: DataFrame | None = None) -> DataFrame:
    """(model_id, display_name, board_rank, arena_rank): midranks among the models that both have, the best first."""
    both = scores.where(F.col("benchmark_id") == benchmark).join(elo, "model_id")
    ranked = ranking.midrank(ranking.midrank(both, [], "score", "board_rank", True), [], "elo", "arena_rank", True)
    named = ranked.join(names, "model_id", "left") if names is not None else ranked.withColumn("display_name", F.lit(None).cast("string"))
    return named.select("model_id", F.coalesce("display_name", "model_id").alias("display_name"), "board_rank", "arena_rank").orderBy("board_rank", "arena_rank", "model_id")


def check_rank_pairs(pairs: DataFrame) -> DataFrame:
    """The pairs, if both columns are midranks of 1 to n: within bounds and with their sum."""
    n, a, b, low, high = pairs.agg(F.count(F.lit(1)), F.sum("board_rank"), F.sum("arena_rank"), F.least(F.min("board_rank"), F.min("arena_rank")), F.greatest(F.max("board_rank"), F.max("arena_rank"))).first()
    if n == 0 or low < 1 or high > n or abs(a - n * (n + 1) / 2) > 1e-9 or abs(b - n * (n + 1) / 2) > 1e-9:
        raise ValueError("the ranks aren't midranks of 1 to n")
    return pairs


def figure_scale(features: DataFrame, metric: str = "spearman_rho") -> DataFrame:
    return features.select("benchmark_id", F.ln("question_count").alias("x"), F.col(metric).alias("y"))


def figure_complexity(features: DataFrame, metric: str = "spearman_rho") -> DataFrame:
    level = complexity_rank(F.col("complexity"))
    return features.select("benchmark_id", "complexity", level.alias("x"), F.col(metric).alias("y"), F.median(metric).over(Window.partitionBy("complexity")).alias("group_median"))


def figure_recency(features: DataFrame, metric: str = "spearman_rho") -> DataFrame:
    return features.select("benchmark_id", day_number(F.col("release_date")).alias("x"), F.col(metric).alias("y"))


def figure_difficulty(features: DataFrame, metric: str = "spearman_rho") -> DataFrame:
    """Difficulty against agreement, parted at the median coefficient of variation; without boards scored by Elo."""
    rows = relational.without(features, "benchmark_id", [ELO_SCORED])
    median = rows.agg(F.median("cv")).scalar()
    return rows.select("benchmark_id", F.col("difficulty").alias("x"), F.col(metric).alias("y"), "cv", (F.col("cv") > median).alias("high_variation"))


FIGURES: dict[int, Callable[..., DataFrame]] = {1: rank_pairs, 2: figure_scale, 3: figure_complexity, 4: figure_recency, 5: figure_difficulty}
TABLES: dict[int, Callable[..., DataFrame]] = {1: hypothesis_results, 2: correlation_summary, 3: reference_difficulties, 4: overall_correlations, 5: uncertainties}


def check_features(features: DataFrame, benchmarks: int | None = None) -> DataFrame:
    """The table, if benchmarks are distinct (and as many as told), measures are numbers and question counts positive."""
    bad = F.col("spearman_rho").isNull() | F.col("kendall_tau").isNull() | F.col("rbo").isNull() | F.coalesce(F.col("question_count") <= 0, F.lit(True))
    n, distinct, wrong = features.agg(F.count(F.lit(1)), F.count_distinct("benchmark_id"), F.count_if(bad)).first()
    if n != distinct or wrong or (benchmarks is not None and n != benchmarks):
        raise ValueError(f"{n} rows, {distinct} benchmarks, {wrong} of them incomplete")
    return features
