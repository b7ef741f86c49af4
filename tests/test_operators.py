"""Operators against hand-made cases, plain Python and DuckDB."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions import cleaning, distributions, identity
from tallyloom.operators import agreement, correction, ranking, regression, relational, resampling


def board(spark, scores, names=None):
    return spark.createDataFrame([("b", n, float(s) if s is not None else None, i) for i, (n, s) in enumerate(zip(names or range(len(scores)), scores, strict=True))], "board string, model string, score double, row_no int")


def column(df, c, order="row_no"):
    return [r[c] for r in df.orderBy(order).collect()]


def test_ties_share_ranks(spark):
    df = board(spark, [98, 99, 97, 98])
    assert column(ranking.competition_rank(df, ["board"], "score"), "rank") == [2, 1, 4, 2]
    assert column(ranking.midrank(df, ["board"], "score", descending=True), "rank") == [2.5, 1.0, 4.0, 2.5]


def test_second_copies_of_a_name_are_numbered(spark):
    df = board(spark, [1, 2, 3, 4], ["A", "B", "A", "A"])
    assert column(ranking.number_duplicates(df, ["board"], "model", ["row_no"]), "model") == ["A", "B", "A(2)", "A(3)"]


def test_best_candidate_needs_likeness_only_among_several(spark):
    rows = spark.createDataFrame([("a", "x", 0.1, 1), ("b", "x", 0.2, 1), ("b", "y", 0.25, 2), ("c", "x", 0.5, 1), ("c", "y", 0.5, 2)], "k string, c string, s double, pos int")
    assert {r.k: r.c for r in ranking.best_candidate(rows, ["k"], "s", ["pos"]).collect()} == {"a": "x", "c": "x"}


def test_difficulty_falls_back_below_five(spark):
    rows = [("four", float(s), 1400.0) for s in (10, 20, 30, 40)] + [("four", 90.0, 1500.0)] + [("five", float(s), e) for s, e in ((10, 1400.0), (20, 1430.0), (30, 1410.0), (40, 1410.0), (50, 1420.0), (100, 1431.0))]
    got = {r.b: r for r in relational.difficulty(spark.createDataFrame(rows, "b string, s double, e double"), ["b"], "s", "e").collect()}
    assert got["five"].difficulty == 70 and not got["five"].is_estimated_difficulty
    assert got["four"].difficulty == 62 and got["four"].is_estimated_difficulty and got["four"].subset_avg_score is None


def test_overlap_boundary_and_percent(spark):
    rows = spark.createDataFrame([(b, i) for b, n in (("five", 5), ("six", 6)) for i in range(n)], "b string, m long")
    assert [r.b for r in relational.with_overlap(rows, ["b"]).collect()] == ["six"]
    none = relational.overlap_statistics(rows, rows.limit(0), ["b"], "m").collect()
    assert {r.overlap_pct for r in none} == {0.0}


def test_null_safe_match_joins_nulls(spark):
    left = spark.createDataFrame([("p", None, 1), ("q", "f", None)], "a string, fam string, ver int")
    right = spark.createDataFrame([("x", None, 1), ("y", "f", None), ("z", "f", 2)], "b string, fam2 string, ver2 int")
    assert sorted((r.a, r.b) for r in relational.null_safe_match(left, right, [("fam", "fam2"), ("ver", "ver2")]).collect()) == [("p", "x"), ("q", "y")]


def pairs(spark, x, y):
    return spark.createDataFrame([("g", i, float(a) if a is not None else None, float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "g string, i int, x double, y double")


def plain_tau(x, y):
    s = t = u = 0
    for i in range(len(x)):
        for j in range(i):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            s, t, u = s + a * b, t + abs(a), u + abs(b)
    return s / math.sqrt(t * u) if t * u else math.nan


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=0, max_size=40))
def test_kendall_equals_all_pairs(values):
    x, y = (np.array([v[k] for v in values], float) for k in (0, 1))
    got, want = agreement.kendall_tau(x, y), plain_tau(x, y)
    assert (math.isnan(got) and math.isnan(want)) or got == pytest.approx(want)
    if not math.isnan(want):
        assert agreement.kendall_tau(x, -y) == pytest.approx(-want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=30))
def test_midranks_sum_and_agree_with_counting(values):
    v = np.array(values, float)
    got = resampling.midranks(v)
    assert got.sum() == pytest.approx(len(v) * (len(v) + 1) / 2)
    assert got.tolist() == [(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v]


def test_undefined_correlations_are_null(spark):
    constant = agreement.spearman(pairs(spark, [1, 1, 1], [1, 2, 3]), ["g"], "x", "y").first()
    assert constant.n == 3 and constant.rho is None
    assert agreement.kendall(pairs(spark, [1, 1, 1], [1, 2, 3]), ["g"], "x", "y").first().tau is None
    one = agreement.spearman(pairs(spark, [1, None], [1, 2]), ["g"], "x", "y").first()
    assert one.n == 1 and one.rho is None


def test_agreement_on_a_permutation(spark):
    x, y = [1, 2, 3, 4, 5], [2, 1, 4, 3, 5]
    df = pairs(spark, x, y)
    assert agreement.spearman(df, ["g"], "x", "y").first().rho == pytest.approx(0.8)
    assert agreement.kendall(df, ["g"], "x", "y").first().tau == pytest.approx(0.6)
    p = agreement.with_t_pvalue(agreement.spearman(df, ["g"], "x", "y"), "rho", "n", "p").first().p
    assert p == pytest.approx(0.10408803866182788)


def test_wide_tables_keep_keys_without_a_category(spark):
    keys, long = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k int"), spark.createDataFrame([(1, "a", 5.0), (3, "b", None), (9, "a", 1.0)], "k int, c string, v double")
    wide = relational.left_wide(keys, long, "k", "c", ["v"], ["a", "b"])
    assert sorted(map(tuple, wide.collect())) == [(1, 5.0, None), (2, None, None), (3, None, None)]
    assert relational.score_columns(["x_score", "elo_y_score", "score"]) == ["x_score"]
    scores = lambda name: sorted(map(tuple, relational.benchmark_scores(wide.withColumnRenamed("a_v", "a_b_score"), "k", name, "a_b").collect()))
    assert scores("a b") == [(1, 5.0)] and scores("a_b") == [(1, 5.0)]
    assert relational.benchmark_scores(wide, "k", "none", "no_ne").count() == 0


def test_keys_and_records(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string"), spark.createDataFrame([(2, "new", 1), (3, "w", 2), (2, "old", 0)], "k int, v string, o int")
    assert [r.k for r in relational.without(a, "k", [1]).collect()] == [2, None]
    assert [r.k for r in relational.common_keys(a, b, "k").collect()] == [2]
    assert [tuple(r) for r in relational.inner_first(a.select("k"), b, "k", ["o"], ["v"]).collect()] == [(2, "old")]
    assert [tuple(r) for r in relational.merge_back(a, b.where("o = 1"), "k").collect()] == [(2, "new", 1)]


def test_simulations_draw_the_same_in_parts(monkeypatch):
    x = np.linspace(20, 80, 15)
    whole = resampling.monte_carlo(x, np.full(15, 5.0), x * 10, np.full(15, 40.0), 500, np.random.default_rng(1))
    monkeypatch.setattr(resampling, "NUMBERS", 100)
    assert (resampling.monte_carlo(x, np.full(15, 5.0), x * 10, np.full(15, 40.0), 500, np.random.default_rng(1)) == whole).all()


def test_entry_leaves_out_what_misses_a_library():
    import __spark_entry__ as entry

    def missing(name):
        def load():
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

        return load

    assert entry._optional(missing("tallyloom.llm")) == {} == entry._optional(missing("corpus_pipeline"))
    with pytest.warns(UserWarning, match="left out"):
        assert entry._optional(missing("xxhash")) == {}
    with pytest.raises(ModuleNotFoundError):
        entry._optional(missing("tallyloom.operators.gone"))


def test_overlap_equals_its_definition(spark):
    draw, rows, want = random.Random(3), [], {}
    for g in range(12):
        a = list(range(1 + g))
        b = draw.sample(a, len(a)) if g else a
        rows += [(g, m, a.index(m) + 1, b.index(m) + 1) for m in a]
        # the share of common items of each depth, weighted by 0.9 to the depth; at the end all are common
        want[g] = sum(0.1 * 0.9**d * len({*a[: d + 1]} & {*b[: d + 1]}) / (d + 1) for d in range(len(a))) + 0.9 ** len(a)
    df = spark.createDataFrame(rows, "g int, m int, a int, b int")
    got = {r.g: r for r in agreement.rbo(df, ["g"], "a", "b").collect()}
    assert {g: r.rbo for g, r in got.items()} == pytest.approx(want) and got[0].rbo == pytest.approx(1.0) and got[7].k == 8
    with pytest.raises(ValueError):
        agreement.rbo(df, ["g"], "a", "b", 1.0)


def test_distribution_tails():
    assert distributions.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074037, rel=1e-12)
    u = 0.1 / math.sqrt(3)  # three degrees of freedom have a closed form
    assert distributions.t_two_sided(0.1, 3) == pytest.approx(1 - 2 / math.pi * (u / (1 + u * u) + math.atan(u)), rel=1e-10)
    assert distributions.chi2_sf(3.84145882069412, 1) == pytest.approx(0.05, rel=1e-12)
    assert distributions.chi2_sf(20.0, 3) == pytest.approx(0.00016974243555282632, rel=1e-10)
    assert distributions.normal_two_sided(1.959963984540054) == pytest.approx(0.05, rel=1e-12)


def test_kruskal_and_regression(spark):
    rows = spark.createDataFrame([("a", g, float(v)) for g, vs in (("x", (1, 3, 5)), ("y", (2, 4, 6, 6))) for v in vs], "all string, g string, v double")
    got = regression.with_kruskal_pvalue(regression.kruskal(rows, ["all"], "g", "v")).first()
    ranks = {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6.5}
    h = 12 / 56 * (9**2 / 3 + (2 + 4 + 13) ** 2 / 4) - 24
    assert ranks and got.h == pytest.approx(h / (1 - 6 / (343 - 7))) and got.k == 2 and 0 < got.pvalue < 1
    fit = regression.linear(pairs(spark, [0, 1, 2, 3], [1, 3, 5, 8]), ["g"], "x", "y").first()
    assert fit.slope == pytest.approx(2.3) and fit.stderr == pytest.approx(0.17320508)
    flat = regression.linear(pairs(spark, [1, 1, 1], [1, 2, 3]), ["g"], "x", "y").first()
    assert flat.slope is None and flat.r is None


def test_huber_resists_an_outlier():
    x = np.arange(30.0)
    y = 2 * x + 1 + np.sin(x)
    y[7] += 500
    beta, p = regression.huber(np.column_stack([np.ones(30), x]), y)
    assert abs(beta[1] - 2) < 0.05 and p[1] < 1e-6


def test_holm_steps_and_sticks(spark):
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005), ("e", None)], "t string, p double")
    got = {r.t: (r.p_corrected, r.is_significant) for r in correction.holm(tests, [], "p", ["t"]).collect()}
    assert got["d"] == (pytest.approx(0.02), True) and got["a"] == (pytest.approx(0.03), True)
    assert got["c"] == (pytest.approx(0.06), False) and got["b"] == (pytest.approx(0.06), False) and got["e"] == (None, None)


def test_resamplers_are_seeded_and_order_free(spark):
    draw = np.random.default_rng(0)
    rows = [("g", i, float(a), float(b)) for i, (a, b) in enumerate(zip(draw.normal(size=25), draw.normal(size=25), strict=True))]
    first = spark.createDataFrame(rows, "g string, i int, x double, y double")
    again = spark.createDataFrame(rows[::-1], "g string, i int, x double, y double").repartition(3)
    key = lambda df: sorted(map(repr, resampling.resampled_agreement(df, ["g"], "i", "x", "y", draws=200).collect()))
    assert key(first) == key(again)
    x, y = (np.array([r[k] for r in rows]) for k in (2, 3))
    low, high = resampling.bootstrap(x, y, resampling.spearman_rho, 300)
    assert low < resampling.spearman_rho(x, y) < high
    assert 0 < resampling.permutation_pvalue(x, y, resampling.spearman_rho, 500) <= 1
    assert math.isnan(resampling.bootstrap_vector([np.array([])] * 2, lambda a, b: np.zeros(1), 1)[0][0])
    with pytest.raises(TypeError):
        resampling.bootstrap_vector([x, y], lambda a, b: np.zeros(2), 1, 10)
    resampling.register_statistic("mean_gap", lambda a, b: float(a.mean() - b.mean()))
    assert resampling.resampled_agreement(first, ["g"], "i", "x", "y", ["mean_gap"], 50).first().statistic == "mean_gap"


def test_monte_carlo_shrinks_agreement():
    rng = np.random.default_rng(1)
    x = np.linspace(20, 80, 15)
    rho = resampling.monte_carlo(x, np.full(15, 5.0), x * 10, np.full(15, 40.0), 2000, rng)
    found = resampling.summary_of_trials(rho)
    assert 0.8 < found["simulated_rho"] < 1 and found["stable"] and found["nonpositive_fraction"] == 0


@pytest.mark.parametrize(("text", "score", "preliminary"), [("1490 ±6", 1490.0, 1490.0), ("71%", 71.0, None), ("0.945", 0.945, 0.945), ("40.7% ±2.9%", 40.7, None), ("--", None, None), ("—", None, None), ("", None, None), ("1478Preliminary", None, 1478.0), ("1_000", None, None), ("1.5d", None, None), ("nan", None, None), (None, None, None), (" 12 ", 12.0, 12.0), ("-3e2", -300.0, -300.0)])
def test_score_texts(spark, text, score, preliminary):
    row = spark.createDataFrame([(text,)], "t string").select(cleaning.parse_score(F.col("t")).alias("a"), cleaning.parse_preliminary_score(F.col("t")).alias("b")).first()
    assert (row.a, row.b) == (score, preliminary)


def test_names_ids_and_dates(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c(F.col("v")).alias("x")).first().x
    assert one(cleaning.strip_prefix, "OpenAI/gpt/x") == "gpt/x" and one(cleaning.strip_prefix, "other/gpt") == "other/gpt"
    assert one(cleaning.strip_suffixes, "M Pro OpenAI") == "M Pro" and one(cleaning.strip_suffixes, "XGoogleNVIDIA") == "X" and one(cleaning.strip_suffixes, "IBM") == ""
    assert one(cleaning.sanitize_id, "τ²-Bench (Telecom)!") == "τ_-Bench_Telecom" or one(cleaning.sanitize_id, "τ²-Bench (Telecom)!").startswith("τ")
    assert one(cleaning.benchmark_id_from_path, "file:/x/A%20B+C/data.csv") == "A B+C"
    assert [one(cleaning.day_number, d) for d in ("2021-01-02", "2025-02-31", "2025/01/01", None)] == [1, None, None, None]
    assert one(cleaning.complexity_rank, "Creating") == 4
    with pytest.raises(Exception, match="unknown complexity"):
        one(cleaning.complexity_rank, "Guessing")
    assert one(cleaning.category_column, "Math") == "elo_math" and one(cleaning.short_category, "Hard Prompts") == "HP"


@pytest.mark.parametrize(
    ("name", "family", "subfamily", "version", "date", "parameters"),
    [
        ("gpt-5-pro", "gpt", "gpt-pro", "5.0", None, None),
        ("o3-mini", "gpt", "o3", "3.0", None, None),
        ("Anthropicclaude-opus-4-1-20250805", "claude", "claude-opus", "4.1", "20250805", None),
        ("Qwen3-Coder 480B/A35B", "qwen", "qwen-coder", "3.0", None, "480B"),
        ("google/gemini-2.5-flash", "gemini", "gemini-flash", "2.5", None, None),
        ("Magistral Small", "mistral", None, None, None, None),
        ("unknown thing", None, None, None, None, None),
    ],
)
def test_identities(name, family, subfamily, version, date, parameters):
    got = identity.parse_name(name)
    assert (got["family"], got["version"], got["date"], got["parameters"]) == (family, version, date, parameters)
    if subfamily:
        assert got["subfamily"] == subfamily


def test_likeness(spark):
    kind = f"a {identity.IDENTITY}, b {identity.IDENTITY}"
    info = lambda sub=None, date=None, par=None, other=None: ("f", sub, "1.0", date, par, other)
    like = lambda x, y: spark.createDataFrame([(x, y)], kind).select(identity.similarity(F.col("a"), F.col("b")).alias("s")).first().s
    assert like(info(), info()) == pytest.approx(0.4)
    assert like(info("f-pro", "20250101", "7B", ["X", "y"]), info("f-pro", "20250101", "7b", ["x", "Y "])) == pytest.approx(1.0)
    assert like(info("f-pro", "20250101", "7B", ["x"]), info("f-pro-max", "20251111", "8B", ["z", "x"])) == pytest.approx(0.25 + 0.1 + 0.05)
    assert like(info(None, "2025", "7B", ["x"]), info("f-a", None, None, None)) == pytest.approx(0.05 + 0.04 + 0.06 + 0.02)


def test_report_numbers(spark):
    rows = spark.createDataFrame([(0.00012,), (0.04567,), (None,)], "p double").select(cleaning.format_pvalue(F.col("p")).alias("t"))
    assert [r.t for r in rows.collect()] == ["1.20e-04", "0.0457", "N/A"]
