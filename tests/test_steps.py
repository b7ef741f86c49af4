"""The study's steps as queries: robust fits of all resamples at once, hypothesis tests by the executors, the review table."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom import queries
from tallyloom.operators import regression, resampling
from tallyloom.plans import hypotheses, uncertainty


def test_fits_of_resamples_equal_single_fits():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(30), rng.normal(50, 9, 30), rng.normal(0.02, 0.004, 30)])
    y = 0.3 + 0.01 * x[:, 1] - 4 * x[:, 2] + 0.1 * rng.standard_t(2, 30)
    at = resampling.drawn_rows(30, 0, 120)
    want = np.array([regression.huber(x[p], y[p])[0] for p in at])
    np.testing.assert_allclose(regression.huber_resampled(x, y, at), want, rtol=1e-8)
    same = np.zeros((1, 30), int)  # one row drawn thirty times can't be fitted
    assert np.isnan(regression.huber_resampled(x, y, same)).all()
    exact = x @ np.array([1.0, 2.0, 3.0])
    np.testing.assert_allclose(regression.huber_resampled(x, exact, at), np.tile([1.0, 2.0, 3.0], (120, 1)), rtol=1e-6)


def test_draws_equal_one_generator(spark, small):
    table = queries._sizes(spark, small).cache()
    told = []
    found = {r.test: r for r in hypotheses.test_table(spark, table, draws=600, progress=told.append).collect()}
    assert len(found) == 15 and told[-1] == 3 * 600 and len(set(told)) > 3
    rows = table.orderBy("benchmark_id").select("benchmark_id", "difficulty", "cv", "rbo", hypotheses.cleaning.day_number(F.col("release_date")).alias("day")).collect()
    x, y = np.array([[1.0, r.difficulty, r.cv] for r in rows]), np.array([r.rbo for r in rows])
    both = resampling.bootstrap_vector([x[:, 1], x[:, 2], y], lambda a, b, c: regression.huber(np.column_stack([np.ones(len(c)), a, b]), c)[0][1:], 2, 600)
    for h, (low, high) in zip(("H5", "H4"), both, strict=True):
        assert (found[f"{h}_rbo"].ci_lower, found[f"{h}_rbo"].ci_upper) == (pytest.approx(low, rel=1e-6), pytest.approx(high, rel=1e-6))
    low, high = resampling.bootstrap(np.array([float(r.day) for r in rows]), y, resampling.spearman_rho, 600)
    assert (found["H3_rbo"].ci_lower, found["H3_rbo"].ci_upper) == (pytest.approx(low), pytest.approx(high))
    assert found["H1_rbo"].ci_lower is None and found["H2_rbo"].slope is not None and found["H4_rbo"].sample_size == len(rows)


def test_too_few_is_what_simulate_refuses(spark):
    rows = spark.createDataFrame([(b, f"m{i}", 50.0 + i, 1.0, 1000.0 + i, 5.0) for b, n in (("few", 4), ("enough", 5)) for i in range(n)], "benchmark_id string, model_id string, score double, score_sd double, elo double, elo_sd double")
    refused = uncertainty.too_few(rows).collect()
    assert [(r.benchmark_id, r.n) for r in refused] == [("few", 4)]
    with pytest.raises(Exception, match=refused[0].error):
        uncertainty.simulate(rows, 20).collect()
    assert uncertainty.simulate(rows.where("benchmark_id = 'enough'"), 20).count() == 1
