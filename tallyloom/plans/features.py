"""Cleaned boards and mappings to one row of agreement features for each benchmark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.cleaning import category_column
from tallyloom.operators import agreement, relational, resampling
from tallyloom.operators.ranking import competition_rank
from tallyloom.session import cut

OVERALL = "Overall"
ELO_SCORED = "Creative Writing v3"
DRAWS = 2000


def board_scores(cleaned: DataFrame, mapping: DataFrame, universe: DataFrame, least: int = 6) -> DataFrame:
    """(benchmark_id, model_id, score, rank) in the universe, ranked there, of benchmarks with at least `least` models."""
    mapped = cleaned.join(mapping, ["benchmark_id", "model_name"]).select("benchmark_id", "model_id", "score")
    inside = relational.within(mapped, universe, ["model_id"])
    enough = relational.with_overlap(inside, ["benchmark_id"], least).select("benchmark_id")
    return competition_rank(inside.join(relational.small(enough), "benchmark_id"), ["benchmark_id"], "score")


def paired(scores: DataFrame, elo: DataFrame, metadata: DataFrame) -> DataFrame:
    """Scores with the Elo of the benchmark's category (target "category") and of the overall board ("overall"); elo: (model_id, category, elo)."""
    with_category = scores.join(relational.small(metadata.select("benchmark_id", "category")), "benchmark_id")
    own = with_category.join(elo, ["model_id", "category"]).select("benchmark_id", "model_id", "score", "rank", "elo", F.lit("category").alias("target"))
    overall = scores.join(elo.where(F.col("category") == OVERALL).drop("category"), "model_id").select("benchmark_id", "model_id", "score", "rank", "elo", F.lit("overall").alias("target"))
    return own.unionByName(overall)


def agreement_table(pairs: DataFrame, draws: int = DRAWS) -> DataFrame:
    """(benchmark_id, target, n, Spearman, Kendall, overlap, p-values; intervals for the category only)."""
    by = ["benchmark_id", "target"]
    pairs = cut(pairs)  # five measures read them
    rho = agreement.with_t_pvalue(agreement.spearman(pairs, by, "elo", "score"), "rho", "n", "__pt")
    tau = agreement.with_kendall_pvalue(agreement.kendall(pairs, by, "elo", "score")).select(*by, "tau", F.col("pvalue").alias("__pz"))
    overlap = agreement.rbo_of_scores(pairs, by, "model_id", "rank", "elo").select(*by, "rbo")
    drawn = resampling.resampled_agreement(pairs, by, "model_id", "elo", "score", draws=draws)
    one = lambda s, p: drawn.where(F.col("statistic") == s).select(*by, F.col("ci_lower").alias(f"{p}_ci_lower"), F.col("ci_upper").alias(f"{p}_ci_upper"), F.col("permutation_p").alias(f"__{p}_perm"))
    joined = reduce(lambda a, b: a.join(b, by, "left"), [tau, overlap, one("spearman", "spearman"), one("kendall", "kendall")], rho)
    small = F.col("n") < agreement.LARGE
    finite = lambda c: F.nanvl(c, F.lit(None).cast("double"))
    own = F.col("target") == "category"
    bounds = [F.when(own, finite(F.col(f"{p}_ci_{b}"))).alias(f"{p}_ci_{b}") for p in ("spearman", "kendall") for b in ("lower", "upper")]
    return joined.select(*by, "n", F.col("rho").alias("spearman_rho"), F.when(small, finite(F.col("__spearman_perm"))).otherwise(F.col("__pt")).alias("spearman_pvalue"), F.col("tau").alias("kendall_tau"), F.when(small, finite(F.col("__kendall_perm"))).otherwise(F.col("__pz")).alias("kendall_pvalue"), "rbo", *bounds)


def features(scores: DataFrame, elo: DataFrame, metadata: DataFrame, draws: int = DRAWS) -> DataFrame:
    """The analysis-ready table: difficulty, variation, agreement with the category's and the overall Elo, and metadata."""
    metadata = metadata.withColumn("elo_column", category_column(F.col("category")))
    overall = elo.where(F.col("category") == OVERALL).select("model_id", F.col("elo").alias("elo_overall"))
    base = scores.join(overall, "model_id", "left")
    difficulty = relational.difficulty(base, ["benchmark_id"], "score", "elo_overall")
    scored = F.col("benchmark_id") == ELO_SCORED
    difficulty = difficulty.withColumns({"difficulty": F.when(~scored, F.col("difficulty")), "is_estimated_difficulty": F.col("is_estimated_difficulty") & ~scored})
    variation = relational.coefficient_of_variation(scores, ["benchmark_id"], "score")
    table = agreement_table(paired(scores, elo, metadata), draws)
    own = table.where(F.col("target") == "category").drop("target")
    names = ("spearman_rho", "spearman_pvalue", "kendall_tau", "kendall_pvalue", "rbo")
    beside = table.where(F.col("target") == "overall").select("benchmark_id", *[F.col(c).alias(f"{c}_overall") for c in names])
    found = difficulty.drop("n_band").join(variation, "benchmark_id", "left").join(own, "benchmark_id", "left").join(beside, "benchmark_id", "left")
    extra = metadata.select("benchmark_id", "category", "release_date", "complexity", "question_count")
    return found.withColumns({"coefficient_of_variation": F.col("cv"), "sample_size": F.col("n")}).join(extra, "benchmark_id", "left")


def reference_comparison(scores: DataFrame, feature_table: DataFrame, references: list[str]) -> DataFrame:
    """(benchmark_id, difficulty, reference_difficulty, reference_avg_score), hardest first, of benchmarks that all references took; a reference that is nowhere is an error."""
    present = {r[0] for r in scores.where(F.col("model_id").isin(*references)).select("model_id").distinct().collect()}
    if missing := sorted(set(references) - present):
        raise ValueError("reference models are missing: " + ", ".join(missing))
    found = relational.reference_difficulty(scores, ["benchmark_id"], "model_id", "score", references)
    return found.join(feature_table.select("benchmark_id", "difficulty"), "benchmark_id", "left").orderBy(F.desc("reference_difficulty"))
