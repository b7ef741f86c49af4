"""The leaderboard operators on the driver's tables.

The tables hold no leaderboards, so suppliers stand for models, part types for
benchmarks, a supplier's mean line price within a type for its score, its
whole revenue for its Elo, and the customers' regions for categories.  Sums
are taken in whole cents, so that no result depends on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import cleaning, identity
from tallyloom.operators import agreement, correction, ranking, regression, relational, resampling
from tallyloom.plans import clean, features, hypotheses, match, report, uncertainty
from tallyloom.session import cut, scratch
from tallyloom.sources import embedded_json, html, registry, sinks, tables

REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
#: The revenue, in thousands, from which a supplier is studied, and the band of the difficulty measure.
UNIVERSE, BAND = 31000.0, (31000.0, 32500.0)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def scores(spark: SparkSession, d: str) -> DataFrame:
    """benchmark_id, model_id, n_lines and score, 0 to 100: tenths, by the mean line price in thousands."""
    lines = read(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("model_id"), _cents("l_extendedprice").alias("c"))
    parts = read(spark, d, "part").select("p_partkey", F.col("p_type").alias("benchmark_id"))
    sums = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("benchmark_id", "model_id").agg(F.sum("c").alias("s"), F.count(F.lit(1)).alias("n_lines"))
    return sums.select("benchmark_id", "model_id", "n_lines", (F.expr("(s div n_lines) div 10000").cast("double") / 10.0).alias("score"))


def elo(spark: SparkSession, d: str) -> DataFrame:
    """model_id and elo: whole thousands of its revenue."""
    lines = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("model_id")).agg(F.sum(_cents("l_extendedprice")).alias("s"))
    return lines.select("model_id", F.expr("cast(s div 100000 as double)").alias("elo"))


def category_elo(spark: SparkSession, d: str) -> DataFrame:
    """model_id, category and elo: whole thousands of its revenue from the customers of a region."""
    lines = read(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("model_id"), _cents("l_extendedprice").alias("c"))
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    customers = read(spark, d, "customer").select("c_custkey", "c_nationkey")
    nations = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("category"))
    placed = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "category")
    sums = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(placed, F.col("o_custkey") == F.col("c_custkey")).groupBy("model_id", "category").agg(F.sum("c").alias("s"))
    return sums.select("model_id", "category", F.expr("cast(s div 100000 as double)").alias("elo"))


def scores_with_elo(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).join(elo(spark, d), "model_id")


def _r(c: str, digits: int = 8) -> Column:
    return F.round(F.col(c), digits).alias(c)


def universe(spark: SparkSession, d: str) -> DataFrame:
    return relational.study_universe(elo(spark, d), "model_id", "elo", UNIVERSE)


# 2.3 to 2.5: filters, joins, aggregates


def q_scores_long(spark, d):
    return scores(spark, d)


def q_universe_threshold(spark, d):
    return universe(spark, d)


def q_universe_semi(spark, d):
    return relational.within(scores(spark, d), universe(spark, d), ["model_id"]).select("benchmark_id", "model_id", "score")


def q_common_subset_between(spark, d):
    return elo(spark, d).where(F.col("elo").between(*BAND))


def q_filter_trim_equal(spark, d):
    """Parts as rows of boards, every other one on the board that has a row for each task."""
    k = F.col("p_partkey") % 6
    rows = read(spark, d, "part").select(F.when(k % 2 == 0, clean.AVERAGED).otherwise(F.col("p_type")).alias("benchmark_id"), F.when(k == 0, " Average ").when(k != 4, "Other").alias("task_name"))
    return clean.averaged_only(rows).groupBy("benchmark_id").agg(F.count(F.lit(1)).alias("n"))


def q_filter_nonempty_score(spark, d):
    value = F.trim(F.get_json_object("props", "$.k").cast("string"))
    return read(spark, d, "events").select("event_id", "event_type", value.alias("score_text")).where(~F.lower("score_text").isin("", "--", "nan"))


def q_filter_exclude_id(spark, d):
    return relational.without(scores(spark, d), "benchmark_id", ["ECONOMY"]).groupBy("benchmark_id").agg(F.count(F.lit(1)).alias("n"))


def q_pairwise_complete(spark, d):
    pairs = read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).alias("x"), F.when(F.col("p_retailprice") > 950, F.col("p_retailprice")).alias("y"))
    return agreement.complete_pairs(pairs, "x", "y")


def q_filter_finite(spark, d):
    ratio = F.col("s_acctbal") / F.when(F.col("s_nationkey") % 5 == 0, F.lit(None)).otherwise(F.col("s_nationkey"))
    return read(spark, d, "supplier").select("s_suppkey", F.round(ratio, 6).alias("ratio")).where(relational.is_number(F.col("ratio")))


def q_range_check(spark, d):
    lines = uncertainty.in_range(read(spark, d, "lineitem").select("l_orderkey", "l_discount"), "l_discount", "l_orderkey")
    return lines.agg(F.abs(F.min("l_discount")).alias("least"), F.max("l_discount").alias("most"), F.count(F.lit(1)).alias("n"))


def q_overlap_having(spark, d):
    return relational.with_overlap(relational.within(scores(spark, d), universe(spark, d), ["model_id"]), ["benchmark_id"])


def q_overlap_statistics(spark, d):
    found = relational.overlap_statistics(scores(spark, d), universe(spark, d), ["benchmark_id"], "model_id")
    return found.select("benchmark_id", "n_models", "n_overlap", _r("overlap_pct"))


def q_elo_outer_pivot(spark, d):
    wide = relational.pivot_outer(category_elo(spark, d), "model_id", "category", "elo", REGIONS)
    return wide.toDF("model_id", *["elo_" + r.lower().replace(" ", "_") for r in REGIONS])


def q_left_benchmark_wide(spark, d):
    types = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
    ranked = ranking.competition_rank(relational.within(scores(spark, d), universe(spark, d), ["model_id"]), ["benchmark_id"], "score")
    wide = relational.left_wide(universe(spark, d), ranked, "model_id", "benchmark_id", ["score", "rank"], types)
    return wide.toDF("model_id", *[f"{t.lower()}_{k}" for t in types for k in ("score", "rank")])


def q_map_lookup_coalesce(spark, d):
    mapping = read(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("model_id"), F.col("s_name").alias("display_name"))
    return relational.look_up(elo(spark, d), relational.small(mapping), "model_id", "display_name", F.lit("unknown"))


def q_inner_lookup_first(spark, d):
    orders = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    return relational.inner_first(read(spark, d, "customer").select("c_custkey", "c_name"), orders, "c_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey"])


def q_intersection_keys(spark, d):
    a = scores(spark, d).where("benchmark_id = 'PROMO'").select("model_id")
    return relational.common_keys(a, scores(spark, d).where("benchmark_id = 'ECONOMY' and score >= 53"), "model_id")


def q_merge_back(spark, d):
    corrected = correction.holm(_tests(spark, d), [], "p", ["test"])
    records = _tests(spark, d).withColumn("is_significant", F.lit(None).cast("boolean"))
    return relational.merge_back(records, corrected.select("test", F.round("p_corrected", 10).alias("p_corrected"), "is_significant"), "test")


def q_difficulty(spark, d):
    found = relational.difficulty(scores_with_elo(spark, d), ["benchmark_id"], "score", "elo", *BAND)
    return found.select("benchmark_id", "n_band", _r("subset_avg_score"), _r("difficulty"), "is_estimated_difficulty")


def q_cv(spark, d):
    return relational.coefficient_of_variation(scores(spark, d), ["benchmark_id"], "score").select("benchmark_id", _r("cv"))


def q_ref_difficulty(spark, d):
    found = relational.reference_difficulty(scores(spark, d), ["benchmark_id"], "model_id", "score", (1, 2, 3))
    return found.select("benchmark_id", _r("reference_avg_score"), _r("reference_difficulty"))


def q_count_names(spark, d):
    per_name = Window.partitionBy("p_name")
    return read(spark, d, "part").select("p_partkey", "p_name", F.count(F.lit(1)).over(per_name).alias("n_same_name"))


def q_count_distinct(spark, d):
    return scores(spark, d).agg(F.count_distinct("benchmark_id").alias("n_benchmarks"), F.count_distinct("model_id").alias("n_models"))


def q_distinct_names(spark, d):
    return read(spark, d, "part").where("p_size > 5").select("p_name").union(read(spark, d, "part").where("p_retailprice > 950").select("p_name")).distinct()


def q_median_by_group(spark, d):
    return scores(spark, d).groupBy("benchmark_id").agg(F.median("score").alias("median_score"))


def q_min_max(spark, d):
    return scores(spark, d).groupBy("benchmark_id").agg(F.min("score").alias("min_score"), F.max("score").alias("max_score"))


def q_quantile_by_group(spark, d):
    found = relational.quantiles(scores(spark, d), ["benchmark_id"], "score")
    return found.select("benchmark_id", _r("lower"), _r("upper"))


def q_fraction(spark, d):
    return scores(spark, d).groupBy("benchmark_id").agg(F.round(F.avg((F.col("score") <= 53).cast("int")), 8).alias("low_fraction"))


def q_match_statistics(spark, d):
    """Matched names by how many candidates their parts have, which are counted, not listed; a part is no candidate of its own."""
    rows = _named(spark, d).where(F.col("p_partkey").isNotNull())
    kinds = rows.groupBy("name", "family", "version", F.lower("parameters").alias("parameters")).agg(F.count(F.lit(1)).alias("parts"))
    counted = relational.count_matches(kinds, rows, [("family", "family"), ("version", "version")], ("parameters", "parameters"))
    names = counted.groupBy("name").agg(F.sum(F.col("parts") * (F.col("matches") - 1)).alias("n")).where(F.col("n") > 0)
    return match.statistics_of_counts(names.select(F.lit("parts").alias("benchmark_id"), F.col("name").alias("model_name"), "n"))


def q_summary(spark, d):
    rho = agreement.spearman(scores_with_elo(spark, d), ["benchmark_id"], "score", "elo")
    return rho.agg(F.round(F.avg("rho"), 8).alias("mean_rho"), F.round(F.avg("n"), 8).alias("mean_n"), F.count("rho").alias("n_rho"))


# 2.6 and 2.7: ranks, orders, sets


def q_competition_rank(spark, d):
    return ranking.competition_rank(scores(spark, d), ["benchmark_id"], "score").select("benchmark_id", "model_id", "score", "rank")


def q_min_rank_in_universe(spark, d):
    inside = relational.within(scores(spark, d), universe(spark, d), ["model_id"])
    return ranking.competition_rank(inside, ["benchmark_id"], "score").select("benchmark_id", "model_id", "rank")


def q_midrank(spark, d):
    return ranking.midrank(scores(spark, d), ["benchmark_id"], "score", descending=True).select("benchmark_id", "model_id", "rank")


def q_dup_suffix(spark, d):
    parts = read(spark, d, "part").select("p_partkey", "p_type", F.col("p_name").alias("name"))
    return ranking.number_duplicates(parts, ["p_type"], "name", ["p_partkey"])


def q_position_tiebreak(spark, d):
    placed = ranking.positions(scores_with_elo(spark, d), ["benchmark_id"], [F.desc("score"), "model_id"], "by_score")
    return ranking.positions(placed, ["benchmark_id"], [F.desc("elo"), "model_id"], "by_elo").select("benchmark_id", "model_id", "by_score", "by_elo")


def q_first_per_key(spark, d):
    return ranking.first_per_key(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], ["o_orderkey"])


def q_column_min_flag(spark, d):
    return ranking.column_minimum_flag(scores(spark, d).select("benchmark_id", "model_id", "score"), ["benchmark_id"], "score")


def q_set_union(spark, d):
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).union(read(spark, d, "supplier").select("s_nationkey")).distinct()


def q_set_except(spark, d):
    return read(spark, d, "nation").select("n_nationkey").exceptAll(read(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey").distinct())


def q_union_all(spark, d):
    rows = relational.coefficient_of_variation(scores(spark, d), ["benchmark_id"], "score").select("benchmark_id", F.round("cv", 8).alias("value"))
    return rows.unionByName(rows.agg(F.lit("mean").alias("benchmark_id"), F.round(F.avg("value"), 6).alias("value")))


def q_top_report(spark, d):
    rho = agreement.spearman(scores_with_elo(spark, d), ["benchmark_id"], "score", "elo").select("benchmark_id", "n", _r("rho"))
    return rho.orderBy(F.desc("rho"), "benchmark_id").limit(3)


# 2.8: agreement, regression, tests


def q_spearman(spark, d):
    return agreement.spearman(scores_with_elo(spark, d), ["benchmark_id"], "score", "elo").select("benchmark_id", "n", _r("rho"))


def q_spearman_category(spark, d):
    rows = scores(spark, d).join(category_elo(spark, d), "model_id")
    return agreement.spearman(rows, ["benchmark_id", "category"], "score", "elo").select("benchmark_id", "category", "n", _r("rho"))


def q_spearman_pvalue(spark, d):
    rho = agreement.spearman(scores_with_elo(spark, d), ["benchmark_id"], "score", "elo")
    return agreement.with_t_pvalue(rho, "rho", "n", "pvalue").select("benchmark_id", "n", _r("rho"), _r("pvalue"))


def q_pearson_pvalue(spark, d):
    r = agreement.pearson(scores_with_elo(spark, d), ["benchmark_id"], "score", "elo")
    return agreement.with_t_pvalue(r, "r", "n", "pvalue").select("benchmark_id", "n", _r("r"), _r("pvalue"))


def q_kendall_pvalue(spark, d):
    tau = agreement.kendall(scores_with_elo(spark, d), ["benchmark_id"], "score", "elo")
    return agreement.with_kendall_pvalue(tau).select("benchmark_id", _r("tau"), _r("pvalue", 6))


def q_pearson(spark, d):
    return agreement.pearson(scores_with_elo(spark, d), ["benchmark_id"], "score", "elo").select("benchmark_id", "n", _r("r"))


def q_fisher_ci(spark, d):
    r = agreement.pearson(scores_with_elo(spark, d), ["benchmark_id"], "score", "elo")
    return agreement.fisher_interval(r, "r", "n").select("benchmark_id", _r("ci_lower"), _r("ci_upper"))


def q_kendall(spark, d):
    return agreement.kendall(scores_with_elo(spark, d), ["benchmark_id"], "score", "elo").select("benchmark_id", "n", _r("tau"), _r("z", 6))


def q_rbo(spark, d):
    ranked = ranking.competition_rank(scores_with_elo(spark, d), ["benchmark_id"], "score")
    return agreement.rbo_of_scores(ranked, ["benchmark_id"], "model_id", "rank", "elo").select("benchmark_id", "k", _r("rbo"))


def q_linregress(spark, d):
    found = regression.linear(scores_with_elo(spark, d), ["benchmark_id"], "elo", "score")
    return found.select("benchmark_id", "n", _r("slope", 9), _r("intercept", 6), _r("r"), _r("stderr", 9))


def q_linregress_pvalue(spark, d):
    found = regression.with_slope_pvalue(regression.linear(scores_with_elo(spark, d), ["benchmark_id"], "elo", "score"))
    return found.select("benchmark_id", _r("slope", 9), _r("pvalue"))


def q_kruskal(spark, d):
    rows = read(spark, d, "supplier").select("s_nationkey", F.expr("cast(floor(s_acctbal / 100) as double)").alias("value"))
    grouped = rows.withColumn("grp", F.col("s_nationkey") % 4)
    return regression.kruskal(grouped.withColumn("all", F.lit("suppliers")), ["all"], "grp", "value").select("all", "n", "k", _r("h"))


def q_kruskal_pvalue(spark, d):
    rows = read(spark, d, "supplier").select((F.col("s_nationkey") % 4).alias("grp"), F.expr("cast(floor(s_acctbal / 100) as double)").alias("value"), F.lit("suppliers").alias("all"))
    return regression.with_kruskal_pvalue(regression.kruskal(rows, ["all"], "grp", "value")).select("all", _r("h"), _r("pvalue"))


def q_huber(spark, d):
    found = regression.huber_by_group(scores_with_elo(spark, d), ["benchmark_id"], ["elo"], "score")
    return found.select("benchmark_id", "term", _r("coefficient", 6), _r("pvalue"))


def _tests(spark, d):
    """A table of made-up p-values, one for each nation."""
    return read(spark, d, "nation").select(F.col("n_name").alias("test"), (F.pmod(F.col("n_nationkey") * 37 + 11, F.lit(97)) / F.lit(2000.0)).alias("p"))


def q_holm(spark, d):
    return correction.holm(_tests(spark, d), [], "p", ["test"]).select("test", "p", _r("p_corrected", 10), "is_significant")


def q_correction_statistics(spark, d):
    return correction.holm(_tests(spark, d), [], "p", ["test"]).agg(F.count_if("is_significant").alias("n_significant"), F.count(F.lit(1)).alias("n_tests"))


# 2.9: resampling


def q_bootstrap_ci(spark, d):
    found = resampling.bootstrap_quantiles(scores(spark, d), ["benchmark_id"], ["model_id"], "score", 2000)
    return found.select("benchmark_id", _r("ci_lower"), _r("ci_upper"))


def q_bootstrap_agreement(spark, d):
    found = resampling.resampled_agreement(scores_with_elo(spark, d), ["benchmark_id"], "model_id", "score", "elo")
    return found.select("benchmark_id", "statistic", "n", _r("value"), _r("ci_lower"), _r("ci_upper"))


def q_permutation(spark, d):
    """All models in groups of 25 neighbouring ids, as p is given below 30 pairs only."""
    few = scores_with_elo(spark, d).withColumn("model_group", F.expr("model_id div 25"))
    return resampling.resampled_agreement(few, ["benchmark_id", "model_group"], "model_id", "score", "elo").select("benchmark_id", "model_group", "statistic", "n", _r("value"), _r("permutation_p"))


def q_monte_carlo(spark, d):
    rows = scores_with_elo(spark, d).withColumns({"score_sd": resampling.binomial_sd(F.col("score"), F.col("n_lines")), "elo_sd": resampling.interval_sd(F.col("elo") / 20)})
    found = resampling.uncertainty(rows, ["benchmark_id"], "model_id", "score", "score_sd", "elo", "elo_sd")
    return found.select("benchmark_id", "n", _r("simulated_rho"), _r("ci_lower"), _r("ci_upper"), _r("nonpositive_fraction"), "stable")


def q_bootstrap_rho(spark, d):
    found = resampling.bootstrap_rho(scores_with_elo(spark, d), ["benchmark_id"], ["model_id"], "score", "elo")
    return found.select("benchmark_id", _r("ci_lower"), _r("ci_upper"))


def q_permutation_rho(spark, d):
    found = resampling.permutation_rho(scores_with_elo(spark, d), ["benchmark_id"], ["model_id"], "score", "elo")
    return found.select("benchmark_id", "n", _r("rho"), _r("permutation_p"))


def q_monte_carlo_rho(spark, d):
    rows = scores_with_elo(spark, d).withColumns({"score_sd": resampling.binomial_sd(F.col("score"), F.col("n_lines")), "elo_sd": resampling.interval_sd(F.col("elo") / 20)})
    found = resampling.monte_carlo_rho(rows, ["benchmark_id"], ["model_id"], "score", "score_sd", "elo", "elo_sd")
    return found.select("benchmark_id", "n", _r("simulated_rho"), _r("ci_lower"), _r("ci_upper"), _r("nonpositive_fraction"), "stable")


def q_binomial_se(spark, d):
    rows = scores(spark, d).where("score <= 100")
    return rows.select("benchmark_id", "model_id", F.round(resampling.binomial_sd(F.col("score"), F.col("n_lines")), 8).alias("score_sd"), F.round(resampling.interval_sd(F.col("score")), 8).alias("elo_sd"))


# the study's steps


def q_agreement_table(spark, d):
    """All measures of each board with the Elo of its category and with the overall one; p from 30 pairs on."""
    rows = ranking.competition_rank(scores(spark, d), ["benchmark_id"], "score")
    arena = category_elo(spark, d).where("category = 'ASIA'").unionByName(elo(spark, d).withColumn("category", F.lit(features.OVERALL)))
    metadata = rows.select("benchmark_id").distinct().withColumn("category", F.lit("ASIA"))
    found = features.agreement_table(features.paired(rows, arena, metadata))
    large = lambda c, digits: F.when(F.col("n") >= agreement.LARGE, F.round(c, digits)).alias(c)
    return found.select("benchmark_id", "target", "n", _r("spearman_rho"), large("spearman_pvalue", 8), _r("kendall_tau"), large("kendall_pvalue", 6), _r("rbo"))


def _sizes(spark, d):
    """Sizes of parts as benchmarks, with features made of their parts."""
    cents = F.col("p_retailprice").cast("decimal(18,2)")
    whole = read(spark, d, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("question_count"), F.sum(cents).alias("s"), F.max(cents).alias("hi"), F.min(cents).alias("lo"), F.sum((F.col("p_partkey") * 37 % 101)).alias("k"), F.sum((F.col("p_partkey") * F.col("p_partkey") % 89)).alias("l"))
    number = lambda e: F.expr(f"cast({e} as double)")
    levels = F.array(*map(F.lit, cleaning.COMPLEXITY))
    return whole.select(
        F.lpad(F.col("p_size").cast("string"), 3, "0").alias("benchmark_id"), "question_count", F.get(levels, F.col("p_size") % 4).alias("complexity"), F.concat(F.lit("2025-"), F.lpad((F.col("p_size") % 12 + 1).cast("string"), 2, "0"), F.lit("-1"), (F.col("p_size") % 7).cast("string")).alias("release_date"),
        (number("s") / F.col("question_count") / 100).alias("difficulty"), ((number("hi") - number("lo")) / number("s")).alias("cv"), (F.col("k") / F.col("question_count") / 101).alias("spearman_rho"), (F.col("l") / F.col("question_count") / 89).alias("kendall_tau"), (F.col("k") * 7 % 97 / 97.0).alias("rbo"),
    )


def q_hypotheses(spark, d):
    """H1 to H5 for each of the three measures, with all draws."""
    found = hypotheses.corrected(hypotheses.test_table(spark, _sizes(spark, d)))
    return found.select("test", "hypothesis", "metric", "primary_test", _r("statistic", 6), _r("effect_size", 6), _r("ci_lower", 6), _r("ci_upper", 6), _r("p_raw", 6), _r("p_corrected", 6), "is_significant", "sample_size", "conclusion")


def q_hypothesis_tests(spark, d):
    """The tests of H1 to H3, whose results have a closed form."""
    found = hypotheses.test_table(spark, _sizes(spark, d), draws=250)
    return found.where(F.col("hypothesis").isin("H1", "H2", "H3")).select("test", "primary_test", _r("statistic", 6), _r("effect_size", 6), F.round("p_raw", 6).alias("p_raw"), "sample_size")


def q_hypothesis_results(spark, d):
    """The table of results of one measure, of made-up tests."""
    judged = correction.holm(_tests(spark, d), [], "p", ["test"])
    at = F.regexp_extract("test", "([0-9]+)$", 1).cast("int")
    rows = judged.select(F.concat(F.lit("H"), (at % 7 + 1).cast("string"), F.lit("_"), at.cast("string")).alias("test"), F.when(at % 2 == 0, "spearman_rho").otherwise("rbo").alias("metric"), (at / 8.0).alias("effect_size"), F.when(at % 3 > 0, at / 16.0).alias("ci_lower"), F.when(at % 3 > 0, at / 4.0).alias("ci_upper"), F.col("p").alias("p_raw"), "p_corrected")
    return report.hypothesis_results(rows)


def q_uncertainty_report(spark, d):
    """The table of simulated agreement, the strongest rank correlation first, with each row's place."""
    rows = scores_with_elo(spark, d).withColumns({"score_sd": resampling.binomial_sd(F.col("score"), F.col("n_lines")), "elo_sd": resampling.interval_sd(F.col("elo") / 20)})
    simulated = resampling.monte_carlo_rho(rows, ["benchmark_id"], ["model_id"], "score", "score_sd", "elo", "elo_sd")
    rho = agreement.spearman(scores_with_elo(spark, d), ["benchmark_id"], "score", "elo").select("benchmark_id", F.col("rho").alias("spearman_rho"))
    whole = cut(simulated.join(rho, "benchmark_id").withColumns({c: F.round(c, 6) for c in ("spearman_rho", "simulated_rho", "ci_lower", "ci_upper")}))
    place = ranking.positions(whole.select("benchmark_id", "spearman_rho"), [], [F.desc("spearman_rho"), F.col("benchmark_id")], "place").drop("spearman_rho")
    return report.uncertainties(whole).join(place, "benchmark_id")


def q_too_few_models(spark, d):
    """Which benchmarks a simulation refuses, as they share fewer than five models with their arena, and with what error."""
    few = scores_with_elo(spark, d).where(F.col("model_id") % 25 == F.length("benchmark_id")).select(F.concat("benchmark_id", F.lit(" "), (F.col("model_id") % 2).cast("string")).alias("benchmark_id"), "model_id")
    return uncertainty.too_few(few)


def q_review_table(spark, d):
    """A review row for each name: its candidates in order, and the automatic choice."""
    parts = read(spark, d, "part")
    arena = parts.groupBy((F.col("p_size") % 6 + 1).alias("v"), (F.col("p_size") % 2).alias("b")).agg(F.min("p_partkey").alias("row_no"))
    arena = arena.select("row_no", F.concat(F.lit("gpt-"), F.col("v").cast("string"), F.when(F.col("b") == 0, " 7B").otherwise("")).alias("model_raw"), F.lit("1400").alias("score_raw"))
    names = parts.select(F.col("p_type").alias("benchmark_id"), F.concat(F.lit("GPT-"), (F.col("p_size") % 7).cast("string"), F.when(F.col("p_size") % 3 == 0, " 7B").when(F.col("p_size") % 3 == 1, " 9B").otherwise("")).alias("model_name")).distinct()
    found = match.review(match.candidates(names, match.arena_identities(arena)))
    return found.select("benchmark_id", "model_name", F.array_join(F.transform("candidates", lambda c: c["lmarena_model"]), "; ").alias("candidates"), "untrusted", "selected")


def q_board_layouts(spark, d):
    """Boards of several layouts: which columns hold the model and the score depends on the source and the headings."""
    root = f"{scratch(spark, 'layouts')}/raw"
    k, name = F.col("n_nationkey").cast("string"), F.col("n_name")
    # The folder of a source and a board, its headings, and how many columns stand before the model.
    layouts = {
        "lmarena": ("Rank,Model,Votes,Score", F.concat_ws(",", F.lit("1"), name, F.lit("9"), k)),
        "vals_ai": ("latency,Model,accuracy,cost", F.concat_ws(",", F.lit("3"), name, F.concat(k, F.lit("%")), F.lit("8"))),
        "frontiermath": ("score,name,score_value", F.concat_ws(",", F.lit("77"), name, k)),
        "artificial_analysis": ("Agent,Speed,Share", F.concat_ws(",", name, F.lit("12"), F.concat(k, F.lit("%")))),
        "elsewhere": ("AI System,note,Final Result", F.concat_ws(",", name, F.lit(""), k)),
    }
    rows = read(spark, d, "nation")
    for source, (head, line) in layouts.items():
        listed = rows.groupBy((F.col("n_regionkey") % 2).alias("b")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))).alias("x"))
        board = listed.select(F.concat(F.lit(f"{source} "), F.col("b").cast("string")).alias("board"), F.array_join(F.concat(F.array(F.lit(head)), F.col("x.line")), "\n").alias("text"))
        sinks.write_files(board, "board", "text", f"{root}/{source}")
    found = clean.read_boards(spark, root, "*.txt")
    return found.select("benchmark_id", F.col("row_no").cast("int").alias("row_no"), "model_raw", "score_raw")


def q_combined_table(spark, d):
    """Boards side by side, a row for each model, in order of its name."""
    boards = scores(spark, d).select("benchmark_id", F.concat(F.lit("m"), F.col("model_id").cast("string")).alias("Model"), "score")
    return registry.combine_boards(boards, "Model", "benchmark_id", "score", TYPES)


# 2.10: cleaning


def q_parse_score(spark, d):
    """Every form of score text, made from the account balances."""
    b = F.col("c_acctbal").cast("decimal(12,1)").cast("string")
    k = F.col("c_custkey") % 8
    made = F.when(k == 0, F.concat(b, F.lit("%"))).when(k == 1, F.concat(b, F.lit(" ±6"))).when(k == 2, F.lit("--")).when(k == 3, F.concat(b, F.lit("Preliminary"))).when(k == 4, F.concat(F.lit(" "), b, F.lit("%±2.9%"))).when(k == 5, F.lit("1_000")).when(k == 6, F.lit("")).otherwise(b)
    rows = read(spark, d, "customer").select("c_custkey", made.alias("score_text"))
    text = F.col("score_text")
    return rows.select("c_custkey", "score_text", cleaning.parse_score(text).alias("score"), cleaning.parse_preliminary_score(text).alias("preliminary_score"), cleaning.parse_digits(text).alias("digits_score"))


def q_scale_score(spark, d):
    named = F.when(F.col("benchmark_id") == "PROMO", "GPQA").when(F.col("benchmark_id") == "SMALL", "IFEval").otherwise(F.col("benchmark_id"))
    return scores(spark, d).select(named.alias("benchmark_id"), "model_id", cleaning.scaled_score(named, F.col("score")).alias("scaled"))


def q_strip_prefix(spark, d):
    k = F.col("p_partkey") % 4
    made = F.concat(F.when(k == 0, "OpenAI/").when(k == 1, "google/").when(k == 2, "nobody/").otherwise(""), F.col("p_name"))
    return read(spark, d, "part").select("p_partkey", cleaning.strip_prefix(made).alias("name"))


def q_strip_suffix(spark, d):
    k = F.col("p_partkey") % 4
    made = F.concat(F.col("p_name"), F.when(k == 0, "OpenAI").when(k == 1, " Mistral AI").when(k == 2, "GoogleNVIDIA").otherwise(""))
    return read(spark, d, "part").select("p_partkey", cleaning.strip_suffixes(made).alias("name"))


def q_sanitize_id(spark, d):
    return read(spark, d, "pages").select("page_id", cleaning.sanitize_id(F.col("url")).alias("id"))


def q_path_id(spark, d):
    made = F.concat(F.lit("file:/data/raw/x/"), F.col("p_brand"), F.lit("/data.csv"))
    return read(spark, d, "part").select("p_partkey", cleaning.benchmark_id_from_path(made).alias("id"))


def q_date_ordinal(spark, d):
    text = F.when(F.col("o_orderkey") % 5 == 0, F.lit("2025-02-31")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return read(spark, d, "orders").select("o_orderkey", cleaning.day_number(text).alias("day_number"))


def q_log(spark, d):
    return read(spark, d, "part").select("p_partkey", F.round(F.ln(F.col("p_size").cast("double")), 10).alias("log_size"))


def q_json_field(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


def q_ordinal_map(spark, d):
    k = F.col("c_custkey") % 5
    level = F.when(k == 0, "Applying").when(k == 1, "Analyzing").when(k == 2, "Evaluating").when(k == 3, "Creating")
    return read(spark, d, "customer").select("c_custkey", cleaning.complexity_rank(level).alias("level"))


def q_category_to_elo(spark, d):
    names = F.array(*map(F.lit, cleaning.CATEGORY_COLUMNS))
    category = F.get(names, (F.col("c_custkey") % 7).cast("int"))
    return read(spark, d, "customer").select("c_custkey", cleaning.category_column(category).alias("elo_column"), cleaning.short_category(category).alias("short"))


def q_clean_model_name(spark, d):
    k = F.col("p_partkey") % 3
    source = F.when(k == 0, "raw/vals_ai/x").when(k == 1, "raw/Selenium/x").otherwise("raw/lmarena/x")
    made = F.concat(F.lit(" openai/"), F.col("p_name"), F.lit("Mistral AI "))
    return read(spark, d, "part").select("p_partkey", cleaning.clean_model_name(made, source).alias("name"))


# 2.11: matching


def _named(spark, d):
    """Part names as models: the first word is the family, the number of words modulo 3 the version, brand the parameter."""
    words = F.split(F.lower("p_name"), r"[\s#]+")
    n = F.col("p_size") % 3
    first, day = F.element_at(words, 1), F.col("p_size") % 5
    return read(spark, d, "part").select(
        "p_partkey",
        F.col("p_name").alias("name"),
        identity.normal_tokens(words).alias("tokens"),
        first.alias("family"),
        F.when(n > 0, n).alias("version"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("parameters"),
        F.when(day > 0, F.concat(F.when(day < 3, "2025-0").otherwise("2024-0"), day.cast("string"))).alias("date"),
        F.when(F.col("p_partkey") % 4 == 0, F.lit(None)).when(F.col("p_partkey") % 3 == 0, first).otherwise(F.array_join(words, "-")).alias("subfamily"),
    )


def _candidates(spark, d):
    """Pairs of matching parts with unequal ids."""
    rows = _named(spark, d)
    left = rows.select("name", "tokens", "family", "version", "parameters", "date", "subfamily", F.col("p_partkey").alias("key"))
    right = rows.select(F.col("name").alias("candidate"), F.col("tokens").alias("c_tokens"), F.col("family").alias("c_family"), F.col("version").alias("c_version"), F.col("parameters").alias("c_parameters"), F.col("date").alias("c_date"), F.col("subfamily").alias("c_subfamily"), F.col("p_partkey").alias("c_key"))
    either = left["parameters"].isNull() | right["c_parameters"].isNull() | (F.lower(left["parameters"]) == F.lower(right["c_parameters"]))
    return relational.null_safe_match(left, right, [("family", "c_family"), ("version", "c_version")], either & (left["key"] != right["c_key"]))


def q_null_safe_match(spark, d):
    """All pairs of `_candidates`, written out from blocks of parts."""
    rows = _named(spark, d)
    left = rows.select("family", "version", "parameters", F.col("p_partkey").alias("key"))
    right = rows.select(F.col("family").alias("c_family"), F.col("version").alias("c_version"), F.col("parameters").alias("c_parameters"), F.col("p_partkey").alias("c_key"))
    pairs = relational.list_matches(left, right, [("family", "c_family"), ("version", "c_version")], ("parameters", "c_parameters"), ("key", "c_key"))
    return pairs.select("key", "c_key", "version", "parameters", "c_parameters")


def q_match_top1_similarity(spark, d):
    """The best of the candidates, found between kinds of parts; from a list of all pairs if ids of parts repeat."""
    parts = _named(spark, d)
    if parts.groupBy("p_partkey").count().where("count > 1").isEmpty():
        return match.best_of_kinds(parts.select(F.col("p_partkey").alias("key"), "family", "subfamily", "version", "date", "parameters", F.col("tokens").alias("other_info")), "key", ["family", "version"])
    info = lambda c: F.struct(*[F.col(c + f).alias(f) for f in ("family", "subfamily", "date", "parameters")], F.col(c + "tokens").alias("other_info"))
    rows = _candidates(spark, d).select("key", "c_key", F.round(identity.similarity(info(""), info("c_"), True), 10).alias("similarity"))
    return ranking.best_candidate(rows, ["key"], "similarity", ["c_key"])


def _unparsed(spark, d):
    """(pos, text, other) names of six words that belong to no family, made of the ids of parts; in `other` the third word is another."""
    word = lambda c, n: F.concat(F.lit("x"), F.translate((F.col("p_partkey") * c % n).cast("string"), "0123456789", "bcfhjvwzkq"))
    names = lambda third: F.concat_ws(" ", word(1, 3), word(7, 40), third, word(11, 90), word(13, 700), word(17, 50))
    return read(spark, d, "part").select(F.col("p_partkey").alias("pos"), names(word(5, 9)).alias("text"), names(word(5, 11)).alias("other"))


def q_match_unparsed(spark, d):
    """The automatic choice for names that share no family, against an arena of such names, by words in common."""
    rows = _unparsed(spark, d)
    names = rows.select(F.lit("parts").alias("benchmark_id"), F.col("text").alias("model_name")).distinct()
    arena = rows.select(F.col("pos").alias("row_no"), F.col("other").alias("model_raw"), F.lit("1400").alias("score_raw"))
    return match.best_matches(names, match.arena_identities(arena))


def q_parse_identity(spark, d):
    """Names of six forms, made of the sizes of parts."""
    k, a, b, c = F.col("p_partkey") % 6, F.col("p_size") % 6 + 1, F.col("p_size") % 9 + 1, F.col("p_size") % 3
    text = lambda x: x.cast("string")
    name = F.when(k == 0, F.concat(F.lit("gpt-"), text(b), F.lit("-pro-2025-01-1"), text(c)))
    name = name.when(k == 1, F.concat(F.lit("Qwen"), text(a), F.when(c == 0, "-Coder 70B").when(c == 1, "-coder 80 B").otherwise(" Coder 7B")))
    name = name.when(k == 2, F.concat(F.lit("claude-opus-4-"), text(b), F.lit("-20250805-thinking")))
    name = name.when(k == 3, F.concat(F.lit("o"), text(F.col("p_size") % 5 + 1), F.lit("-mini-high")))
    name = name.when(k == 4, F.concat(F.lit("google/gemini-"), text(a), F.lit(".5-flash-lite non thinking")))
    names = read(spark, d, "part").select(name.otherwise(F.concat(F.lit("mystery thing "), text(b))).alias("name"))
    return identity.identities(names, "name").select("name", "info.family", "info.subfamily", "info.version", "info.date", "info.parameters", F.array_join("info.other_info", " ").alias("other_info"))


def q_norm_version(spark, d):
    k = F.col("p_partkey") % 4
    made = F.when(k == 0, F.col("p_size").cast("string")).when(k == 1, F.concat(F.col("p_size").cast("string"), F.lit(".0"))).when(k == 2, F.concat(F.col("p_size").cast("string"), F.lit(".5"))).otherwise("x")
    return read(spark, d, "part").select("p_partkey", identity.normal_version(made).alias("version"))


# 2.12: report columns


def q_report_format_p(spark, d):
    rows = _tests(spark, d).withColumn("p", F.when(F.col("p") > 0.04, F.lit(None)).otherwise(F.col("p") / 7))
    return rows.select("test", cleaning.format_pvalue(F.col("p")).alias("p_text"))


def q_fig1_ranks(spark, d):
    text = F.col("model_id").cast("string").alias("model_id")
    names = read(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("model_id"), F.col("s_name").alias("display_name"))
    board = scores(spark, d).select("benchmark_id", text, "score")
    return report.check_rank_pairs(report.rank_pairs(board, elo(spark, d).select(text, "elo"), "PROMO", names))


# 2.1, 2.2 and the steps: pages and documents are made from the tables, so that their rows are known


def q_html_table(spark, d):
    """A page for each region with a table of its nations, read back."""
    row = F.concat(F.lit("<tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td>"), F.col("n_name"), F.lit("</td></tr>"))
    listed = read(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("tr")))).alias("rows"))
    page = F.concat(F.lit("<html><table><tr><th>Key</th><th>Model</th></tr>"), F.array_join(F.transform("rows", lambda r: r["tr"]), ""), F.lit("</table></html>"))
    cells = html.html_rows(listed.select("n_regionkey", page.alias("page")), "n_regionkey", "page", "best")
    return html.wide(cells, ["Key", "Model"]).select("n_regionkey", "row_no", F.col("Key").alias("key"), F.col("Model").alias("model"))


def q_css_rows(spark, d):
    row = F.concat(F.lit('<div class="table-row" data-model-key="'), F.col("r_name"), F.lit('"><div class="cell score-cell"><b class="score-value">'), F.col("r_regionkey").cast("string"), F.lit('%</b><i class="score-error">±1%</i></div><div class="cell chart-cell">x</div></div>'))
    cells = html.html_rows(read(spark, d, "region").select("r_regionkey", row.alias("page")), "r_regionkey", "page", "css")
    return html.wide(cells, ["model_key", "score", "score_value", "score_error"])


def q_embedded_json(spark, d):
    """A document for each nation with its suppliers' balances in nested [tag, value] lists, read back."""
    entry = F.concat(F.lit('"'), F.col("s_name"), F.lit('":[0,{"accuracy":[0,'), F.col("s_suppkey").cast("string"), F.lit('],"plain":"p"}]'))
    listed = read(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(entry), ",").alias("e"))
    document = F.concat(F.lit('{"benchmarkView":[0,{"tasks":[0,{"overall":[0,{'), F.col("e"), F.lit("}]}]}]}"))
    page = F.concat(F.lit('<x props="'), F.replace(document, F.lit('"'), F.lit("&quot;")), F.lit('">'))
    return embedded_json.metric_rows(listed.select("s_nationkey", page.alias("page")), "s_nationkey", "page")


def q_split_boards(spark, d):
    combined = read(spark, d, "supplier").select(F.col("s_suppkey").alias("row_no"), F.col("s_name").alias("Model"), F.col("s_nationkey").cast("string").alias("Board A (x)"))
    return registry.split_boards(combined, {"a": "Board A (x)", "b": "Board B"})


def q_mapping_first_wins(spark, d):
    rows = read(spark, d, "customer").select(F.lit("b").alias("benchmark_id"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("model_name"), F.when(F.col("c_custkey") % 7 == 0, "0").when(F.col("c_custkey") % 7 == 1, " ").otherwise(F.concat(F.lit("id"), F.col("c_nationkey").cast("string"))).alias("selected"))
    return match.mapping(rows)


def q_arena_last_row(spark, d):
    rows = read(spark, d, "customer").select(F.col("c_mktsegment").alias("category"), F.col("c_custkey").alias("row_no"), F.concat(F.lit("m"), F.col("c_nationkey").cast("string")).alias("model_raw"), F.concat(F.col("c_custkey").cast("string"), F.lit("Preliminary")).alias("score_raw"), F.when(F.col("c_custkey") % 5 == 0, "none").otherwise("±6").alias("ci_raw"))
    return uncertainty.arena_with_sd(rows).select("category", "model_id", "elo", _r("elo_sd"))


def _raw_board(spark, d):
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, "openai/").otherwise(""), F.col("p_name"))
    text = F.when(F.col("p_partkey") % 9 == 0, "--").otherwise(F.concat(F.col("p_size").cast("string"), F.lit("% ±2")))
    return read(spark, d, "part").select(F.lit("raw/vals_ai/x/data.csv").alias("source"), F.col("p_type").alias("benchmark_id"), F.col("p_partkey").alias("row_no"), name.alias("model_raw"), text.alias("score_raw"), F.lit(None).cast("string").alias("task_name"))


def q_clean_boards(spark, d):
    return clean.clean(_raw_board(spark, d))


def q_model_list(spark, d):
    return clean.model_list(_raw_board(spark, d))


def q_duplicate_review(spark, d):
    cleaned = clean.clean(_raw_board(spark, d))
    decisions = cleaned.where("row_no < 40").select("benchmark_id", "model_name", F.when(F.col("row_no") % 2 == 0, "drop").otherwise("rename").alias("action"), F.concat(F.lit("new "), F.col("model_name")).alias("new_name"))
    return clean.review_duplicates(cleaned, decisions).select("benchmark_id", "model_name", "rank", "row_no")


def q_review_candidates(spark, d):
    """All part names against those of all parts, by parsed identity; names have no ids, so a name meets its own part too."""
    parts = read(spark, d, "part")
    arena = parts.select(F.col("p_partkey").alias("row_no"), F.concat(F.lit("gpt-"), F.col("p_size").cast("string"), F.lit(" "), F.col("p_name")).alias("model_raw"), F.lit("1400").alias("score_raw"))
    names = parts.select(F.col("p_type").alias("benchmark_id"), F.concat(F.lit("GPT-"), F.col("p_size").cast("string"), F.lit(" "), F.col("p_name")).alias("model_name")).distinct()
    found = match.candidates(names, match.arena_identities(arena))
    return match.statistics(found)


def q_report_summary(spark, d):
    """Formatted agreement of the boards, the least values marked."""
    rows = scores_with_elo(spark, d)
    rho = agreement.with_t_pvalue(agreement.spearman(rows, ["benchmark_id"], "score", "elo"), "rho", "n", "spearman_pvalue").withColumnRenamed("rho", "spearman_rho")
    tau = agreement.with_kendall_pvalue(agreement.kendall(rows, ["benchmark_id"], "score", "elo")).select("benchmark_id", F.col("tau").alias("kendall_tau"), F.col("pvalue").alias("kendall_pvalue"))
    overlap = agreement.rbo_of_scores(ranking.competition_rank(rows, ["benchmark_id"], "score"), ["benchmark_id"], "model_id", "rank", "elo").select("benchmark_id", "rbo")
    return report.correlation_summary(rho.join(tau, "benchmark_id").join(overlap, "benchmark_id").withColumn("category", F.lit("Hard Prompts")))


def q_conclusions(spark, d):
    """A sentence on each of the tests, their effect sizes of all kinds."""
    kinds = F.array(*map(F.lit, ("beta_coefficient", "spearman_rho", "pearson_r", "r_squared", "median_difference", "another")))
    tests = correction.holm(_tests(spark, d), [], "p", ["test"])
    at = F.regexp_extract("test", "([0-9]+)$", 1).cast("int")
    rows = tests.select(F.concat(F.lit("H"), (at % 7 + 1).cast("string"), F.lit("_"), at.cast("string")).alias("test"), F.when(at != 3, F.col("p")).alias("p_raw"), "p_corrected", "is_significant", F.when(at % 5 > 0, at / 8.0).alias("effect_size"), F.get(kinds, at % 6).alias("effect_size_type"))
    return rows.select("test", report.hypothesis_name(F.col("test")).alias("name"), hypotheses.conclusion().alias("conclusion"))


def q_overall_correlations(spark, d):
    rows = scores_with_elo(spark, d).withColumn("elo", F.when(F.col("benchmark_id") == "PROMO", -F.col("elo")).otherwise(F.col("elo")))
    rho = agreement.spearman(rows, ["benchmark_id"], "score", "elo").select("benchmark_id", F.col("rho").alias("spearman_rho_overall"))
    r = agreement.pearson(rows, ["benchmark_id"], "score", "elo").select("benchmark_id", F.col("r").alias("kendall_tau_overall"))
    return report.overall_correlations(rho.join(r, "benchmark_id").withColumns({"rbo_overall": F.lit(None).cast("double"), "category": F.lit("Creative Writing")}))


def q_reference_report(spark, d):
    both = relational.reference_difficulty(scores(spark, d), ["benchmark_id"], "model_id", "score", (1, 2, 3)).join(relational.difficulty(scores_with_elo(spark, d), ["benchmark_id"], "score", "elo", *BAND), "benchmark_id", "left")
    return report.reference_difficulties(both.select("benchmark_id", "difficulty", "reference_difficulty"))


def q_uncertainty_inputs(spark, d):
    board = scores(spark, d).where("score <= 100").select("benchmark_id", "model_id", "score")
    arena = category_elo(spark, d).withColumn("elo_sd", F.col("elo") / 20)
    metadata = scores(spark, d).groupBy("benchmark_id").agg(F.lit("ASIA").alias("category"), F.count(F.lit(1)).alias("question_count"))
    return uncertainty.inputs(board, arena, metadata).select("benchmark_id", "model_id", "score", _r("score_sd"), "elo", "elo_sd")


def _figures(spark, d):
    """Parts as benchmarks."""
    levels = F.array(*map(F.lit, cleaning.COMPLEXITY))
    day = F.when(F.col("p_size") % 7 == 0, "2025-02-31").otherwise(F.concat(F.lit("2025-01-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0")))
    return read(spark, d, "part").select(F.when(F.col("p_partkey") % 50 == 0, "Creative Writing v3").otherwise(F.col("p_partkey").cast("string")).alias("benchmark_id"), F.col("p_size").alias("question_count"), F.get(levels, F.col("p_size") % 4).alias("complexity"), day.alias("release_date"), F.col("p_retailprice").alias("spearman_rho"), (F.col("p_size") * 2.0).alias("difficulty"), (F.col("p_size") / 64.0).alias("cv"))


def q_figure_scale(spark, d):
    return report.figure_scale(_figures(spark, d)).select("benchmark_id", _r("x"), "y")


def q_figure_complexity(spark, d):
    return report.figure_complexity(_figures(spark, d)).select("benchmark_id", "complexity", "x", "y", _r("group_median"))


def q_figure_recency(spark, d):
    return report.figure_recency(_figures(spark, d))


def q_figure_difficulty(spark, d):
    return report.figure_difficulty(_figures(spark, d))


# 2.1 and 2.2: files are written to a shared folder and read back


def q_csv_round_trip(spark, d):
    path = scratch(spark, "csv")
    rows = read(spark, d, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 3 > 0, F.col("s_acctbal")).alias("s_acctbal"))
    sinks.write_csv(rows, path, ["s_suppkey"])
    return tables.require_columns(tables.read_csv(spark, path, "s_suppkey long, s_name string, s_acctbal double"), ["s_suppkey", "s_acctbal"])


def _write_boards(spark, d):
    """A file for each region with its nations as models, that of region 0 in GBK."""
    root = f"{scratch(spark, 'boards')}/raw"
    rows = read(spark, d, "nation").join(F.broadcast(read(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.concat(F.lit('"'), F.when(F.col("n_regionkey") == 0, "模型 ").otherwise(""), "n_name", F.lit('",'), F.col("n_nationkey").cast("string"), F.lit(".5%"))
    listed = rows.groupBy("r_name", "n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))).alias("x"))
    text = F.array_join(F.concat(F.array(F.lit("Model,Final Score")), F.col("x.line"), F.array(F.lit("nobody,--"))), "\n")
    boards = listed.select(F.concat("r_name", F.lit(" board")).alias("folder"), text.alias("text"), "n_regionkey")
    sinks.write_files(boards, "folder", "text", root, F.when(F.col("n_regionkey") == 0, "gbk").otherwise("utf-8"))
    return root


def q_board_files(spark, d):
    """Boards of two encodings found below a folder, read and cleaned."""
    return clean.clean(clean.read_boards(spark, _write_boards(spark, d), "*.txt"))


def q_source_csv(spark, d):
    """The same files by the registered source."""
    tables_of = registry.READERS["csv"](spark, _write_boards(spark, d), "*.txt")
    return html.wide(tables_of, ["Model", "Final Score"]).select("benchmark_id", "row_no", F.col("Model").alias("model"), F.col("Final Score").alias("score_text"))


def q_source_best_table(spark, d):
    """A saved page for each of two boards, of which one wants other columns than the default."""
    root = scratch(spark, "pages")
    row = F.concat(F.lit("<tr><td>"), "n_name", F.lit("</td><td>"), F.col("n_nationkey").cast("string"), F.lit("</td></tr>"))
    listed = read(spark, d, "nation").groupBy().agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("tr")))).alias("x"))
    one = "<html><table><tr><th>Model</th></tr><tr><td>none</td></tr></table><table><tr><th>Team</th><th>Score</th></tr>"
    page = F.concat(F.lit(one), F.array_join(F.col("x.tr"), ""), F.lit("</table></html>"))
    sinks.write_files(listed.select(F.explode(F.array(F.lit("ARC-AGI-2"), F.lit("Other"))).alias("board"), page.alias("page")), "board", "page", root)
    found = registry.read_source("best_table", spark, root)
    return html.wide(found, ["Model", "Team", "Score"]).select("benchmark_id", "row_no", F.col("Model").alias("model"), F.col("Team").alias("team"), F.col("Score").alias("score_text"))


def q_source_combined(spark, d):
    """A table with a column for each board, split to boards."""
    root = scratch(spark, "combined")
    rows = read(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("Model"), F.col("n_regionkey").alias("A"), F.concat(F.col("n_nationkey").cast("string"), F.lit("%")).alias("B (x)"))
    rows.coalesce(1).sortWithinPartitions("n_nationkey").drop("n_nationkey").write.option("header", "true").csv(f"{root}/data.csv")
    return registry.read_source("combined", spark, root).select("benchmark_id", F.col("row_no").cast("int").alias("row_no"), "model_raw", "score_raw")


def q_json_mapping(spark, d):
    path = scratch(spark, "mapping")
    entry = F.concat(F.lit('"'), "n_name", F.lit('": "id '), F.col("n_regionkey").cast("string"), F.lit('"'))
    listed = read(spark, d, "nation").groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col("n_nationkey")).alias("o"), entry.alias("e")))).alias("x"))
    listed.select(F.concat(F.lit("{"), F.array_join(F.col("x.e"), ", "), F.lit("}"))).write.text(path)
    return tables.read_mapping(spark, path)


def q_json_metadata(spark, d):
    path = scratch(spark, "metadata")
    entry = F.to_json(F.struct(F.col("n_name").alias("benchmark_id"), F.col("n_nationkey").alias("question_count"), F.lit("Math").alias("category"), F.when(F.col("n_nationkey") % 4 == 0, "e").alias("elo_column")))
    listed = read(spark, d, "nation").groupBy().agg(F.collect_list(entry).alias("x"))
    listed.select(F.concat(F.lit('[{"meta_info": {"version": 1}}, '), F.array_join("x", ", "), F.lit("]"))).write.text(path)
    return tables.read_metadata(spark, path).select("benchmark_id", "question_count", "category")


def q_json_document(spark, d):
    """A document written and its entries read back, nulls left out."""
    path = f"{scratch(spark, 'document')}/out.json"
    rows = read(spark, d, "nation").select(F.col("n_name").alias("test"), (F.col("n_nationkey") / 4.0).alias("p"), F.when(F.col("n_regionkey") > 1, F.col("n_regionkey")).alias("region"))
    sinks.write_json_document(rows, "test", path)
    return tables.read_json_map(spark, path).select(F.col("key").alias("test"), F.expr("try_variant_get(value, '$.p', 'double')").alias("p"), F.expr("try_variant_get(value, '$.region', 'long')").alias("region"))


def q_wide_csv(spark, d):
    """All suppliers as models, those without a board too, with a column for each board, by way of a file."""
    path = scratch(spark, "wide")
    models = read(spark, d, "supplier").select(F.col("s_suppkey").alias("model_id"))
    sinks.write_wide(models, scores(spark, d), "model_id", "benchmark_id", ["score"], TYPES, path)
    return tables.read_csv(spark, path, "model_id long, " + ", ".join(f"{t}_score double" for t in TYPES)).toDF("model_id", *map(str.lower, TYPES))


def q_benchmark_scores(spark, d):
    """Scores of one benchmark out of the wide table of all, by its sanitised id, and how many score columns there are."""
    wide = relational.left_wide(universe(spark, d), scores(spark, d), "model_id", "benchmark_id", ["score"], TYPES).withColumnRenamed("PROMO_score", "promo_x_score").withColumn("elo_all_score", F.lit(1.0))
    columns = relational.score_columns(wide.columns)
    return relational.benchmark_scores(wide, "model_id", "promo (x)", "promo_x").withColumn("columns", F.lit(len(columns)))


def q_model_list_csv(spark, d):
    path = scratch(spark, "models")
    sinks.write_model_list(clean.model_list(_raw_board(spark, d)), path)
    return tables.read_csv(spark, path, "model_name string")


def q_cleaned_csv(spark, d):
    """Cleaned boards as CSV files, a folder for each benchmark, read back in one scan."""
    path = scratch(spark, "cleaned")
    sinks.write_cleaned(clean.clean(_raw_board(spark, d)), path, "csv")
    return tables.read_cleaned(spark, path, "benchmark_id").select("benchmark_id", "model_name", "score", "rank")


def q_missing_names(spark, d):
    return tables.missing_names(read(spark, d, "nation").select(F.col("n_nationkey").alias("k")), read(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("k")), "k")


def q_latex_table(spark, d):
    rows = _tests(spark, d).select("test", cleaning.format_pvalue(F.when(F.col("p") > 0.01, F.col("p"))).alias("p"))
    return sinks.latex_table(rows, {"test": "Test", "p": "p"}, "Tests", "tab:tests", ["test"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}
