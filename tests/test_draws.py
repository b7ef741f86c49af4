"""Resamplers in blocks of draws: the same numbers as one after another, whatever the block, and as joins for large groups."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tallyloom.operators import draws, resampling


def boards(spark, sizes=((1, 40), (2, 25), (3, 7), (None, 12))):
    rng, rows = np.random.default_rng(3), []
    for g, n in sizes:
        x = rng.integers(0, 15, n).astype(float)
        y = np.round(x + rng.normal(0, 4, n))
        rows += [(g, f"m{i:03}", float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return rows, spark.createDataFrame(rows, "g int, m string, x double, y double").repartition(5)


def near(a, b):
    return (a is None or math.isnan(a)) and (b is None or math.isnan(b)) or a == pytest.approx(b, abs=1e-12)


def test_blocks_equal_one_after_another(spark, monkeypatch):
    rows, df = boards(spark)
    monkeypatch.setattr(draws, "BLOCK", 40 * 30)  # several blocks a group
    got = {(r.g, r.statistic): r for r in resampling.resampled_agreement(df, ["g"], "m", "x", "y", draws=200).collect()}
    assert len(got) == 8
    for (g, name), r in got.items():
        x, y = (np.array([row[c] for row in rows if row[0] == g]) for c in (2, 3))
        f = resampling.STATISTICS[name]
        low, high = resampling.bootstrap(x, y, f, 200)
        assert r.n == len(x) and near(r.value, f(x, y)) and near(r.ci_lower, low) and near(r.ci_upper, high)
        assert near(r.permutation_p, resampling.permutation_pvalue(x, y, f, 200) if len(x) < 30 else None)


def forms(df):
    return [
        resampling.bootstrap_rho(df, ["g"], ["m"], "x", "y", 60),
        resampling.permutation_rho(df, ["g"], ["m"], "x", "y", 60),
        resampling.monte_carlo_rho(df.selectExpr("*", "1.5 sx", "2.5 sy"), ["g"], ["m"], "x", "sx", "y", "sy", 60),
        resampling.bootstrap_quantiles(df, ["g"], ["m"], "x", 60),
    ]


def test_large_groups_give_the_same(spark, monkeypatch):
    _, df = boards(spark)
    packed = [f.collect() for f in forms(df)]
    monkeypatch.setattr(draws, "PACKED", 20)  # two groups are joins now, two are packed
    for a, b in zip(packed, forms(df), strict=True):
        a, b = (sorted(x, key=lambda r: str(r.g)) for x in (a, b.collect()))
        assert [r.g for r in a] == [r.g for r in b] and len(a) == 4
        for r, s in zip(a, b, strict=True):
            assert all(near(u, v) for u, v in zip(r[1:], s[1:], strict=True))


def test_blocks_do_not_change_results(spark, monkeypatch):
    _, df = boards(spark)
    every = lambda: [sorted(f.collect(), key=lambda r: str(r.g)) for f in (*forms(df), resampling.uncertainty(df.selectExpr("*", "1.5 sx", "2.5 sy"), ["g"], "m", "x", "sx", "y", "sy", 900))]
    one = every()
    monkeypatch.setattr(draws, "BLOCK", 100)
    for a, b in zip(one, every(), strict=True):
        assert len(a) == 4 and all(near(u, v) for r, s in zip(a, b, strict=True) for u, v in zip(r[1:], s[1:], strict=True))


def test_shuffle_is_independent_of_the_draws(spark):
    """No operator makes a row for each draw and model: only the packed groups are dealt."""
    _, df = boards(spark)
    plan = resampling.bootstrap_rho(df, ["g"], ["m"], "x", "y", 2000)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Window" not in plan


def test_progress_counts_all_draws(spark, monkeypatch):
    _, df = boards(spark)
    monkeypatch.setattr(draws, "BLOCK", 40 * 30)
    told: list[int] = []
    resampling.resampled_agreement(df, ["g"], "m", "x", "y", draws=200, progress=told.append).collect()
    assert told[-1] == 4 * 200 and told == sorted(told) and len(set(told)) > 2


def test_empty_and_tiny_groups(spark):
    empty = spark.createDataFrame([], "g int, m string, x double, y double")
    assert all(f.collect() == [] for f in forms(empty))
    assert resampling.resampled_agreement(empty, ["g"], "m", "x", "y").collect() == []
    one = spark.createDataFrame([(1, "a", 1.0, 2.0), (2, "a", 1.0, 1.0), (2, "b", 1.0, 3.0), (3, "a", None, 2.0)], empty.schema)
    found = {r.g: r for r in resampling.resampled_agreement(one, ["g"], "m", "x", "y", ["kendall"], 20).collect()}
    assert sorted(found) == [1, 2] and found[1].value is None and found[1].ci_lower is None and found[2].permutation_p is None
    assert [r.ci_lower for r in resampling.bootstrap_rho(one, ["g"], ["m"], "x", "y", 20).collect()] == [None, None]
    with pytest.raises(Exception, match="fewer than 5"):
        resampling.uncertainty(one.selectExpr("*", "1.0 s"), ["g"], "m", "x", "s", "y", "s", 10, least=5).collect()


def test_kendall_of_large_resamples_equals_that_of_the_rows():
    """The weighed form, which isn't called row by row, gives the very same numbers."""
    rng = np.random.default_rng(5)
    for n, kx, ky in ((2, 1, 2), (9, 3, 4), (300, 7, 290), (300, 290, 7), (resampling.SIGNS + 1, 40, 900)):
        x, y = rng.integers(0, kx, n) / 2, rng.integers(0, ky, n) / 4
        at = rng.integers(0, n, (5, n))
        weighed = resampling._Weighed(x, y)
        got = [weighed.tau(np.bincount(p, minlength=n)) for p in at]
        assert np.array_equal(got, [resampling.kendall_tau(x[p], y[p]) for p in at], equal_nan=True)


def test_generator_goes_on_from_block_to_block():
    one = resampling.Drawn(11)
    blocks = [one(a, b) for a, b in ((0, 3), (3, 4), (9, 12), (2, 5))]
    assert all(np.array_equal(b, resampling.drawn_rows(11, 0, 12)[i:j]) for b, (i, j) in zip(blocks, ((0, 3), (3, 4), (9, 12), (2, 5)), strict=True))


def test_copies_of_a_group_are_bounded(spark, monkeypatch):
    """However small a block, a group is dealt to at most SPREAD stretches, not to each block; each draw comes once."""
    _, df = boards(spark)
    monkeypatch.setattr(draws, "BLOCK", 10)  # a draw a block
    monkeypatch.setattr(draws, "SPREAD", 6)

    def work(values, first, last, seed):
        return {"first": np.arange(first, last)}

    found = draws.map_blocks(df, ["g"], ["m"], ["x", "y"], 100, work, "first long")
    assert sorted((str(r.g), r.first) for r in found.collect()) == sorted((str(g), i) for g in (1, 2, 3, None) for i in range(100))
    assert dealt(found) == 4 * 6


def dealt(df):
    """Rows that the plan's explode of stretches gave."""

    def walk(node):
        own = [node.metrics().apply("numOutputRows").value()] if node.nodeName().startswith("Generate") else []
        inner = [node.children().apply(i) for i in range(node.children().size())]
        if "AdaptiveSparkPlan" in node.nodeName():
            inner.append(node.executedPlan())
        if "QueryStage" in node.nodeName():
            inner.append(node.plan())
        return own + [n for i in inner for n in walk(i)]

    return sum(walk(df._jdf.queryExecution().executedPlan()))
