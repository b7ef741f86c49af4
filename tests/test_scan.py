"""Running values, ranks, Holm and overlap over ranges of rows: equal to windows, with one group in many tasks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import agreement, correction, ranking
from tallyloom.operators.scan import Running, running


@pytest.fixture(autouse=True, scope="module")
def many_tasks(spark):
    """Small tables stay in as many tasks as large ones would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    # one group holds most rows and one value a third of all; some keys and values are null or NaN
    made = [(rng.choice(["big"] * 8 + ["a", "b", None]), i, rng.choice([7.0, None, float("nan"), *[float(rng.randint(0, 400)) for _ in range(3)]] if i % 3 else [7.0])) for i in range(6000)]
    return spark.createDataFrame(made, "g string, i int, v double").repartition(6).cache()


def collected(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("by", [["g"], []])
def test_running_values_equal_windows(spark, rows, by):
    good = F.when(~F.isnan("v"), F.col("v"))
    got = running(rows, by, ["i"], {"n": Running("sum", F.lit(1)), "s": Running("sum", good.cast("long")), "hi": Running("max", good), "lo": Running("min", good)})
    upto = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = rows.select("*", F.count(F.lit(1)).over(upto).alias("n"), F.coalesce(F.sum(good.cast("long")).over(upto), F.lit(0)).alias("s"), F.max(good).over(upto).alias("hi"), F.min(good).over(upto).alias("lo"))
    assert collected(got) == collected(want)


def test_a_group_is_in_many_tasks(spark, rows):
    got = running(rows, [], ["i"], {"n": Running("sum", F.lit(1))})
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 0.6 * 6000
    plan = got._jdf.queryExecution().executedPlan().toString()
    # what one task sees are the totals, a row for each task
    assert plan.count("SinglePartition") == 1 and "HashAggregate(keys=[__part" in plan.split("SinglePartition")[1].split("\n")[1]


@pytest.mark.parametrize("by", [["g"], []])
def test_ranks_equal_windows(spark, rows, by):
    every = lambda: (Window.partitionBy(*by), F.count(F.lit(1)).over(Window.partitionBy(*by, "v")))
    group, ties = every()
    down, up = group.orderBy(F.col("v").desc_nulls_last()), group.orderBy(F.col("v").asc_nulls_first())
    assert collected(ranking.competition_rank(rows, by, "v", large=True)) == collected(rows.withColumn("rank", F.rank().over(down)))
    assert collected(ranking.midrank(rows, by, "v", large=True)) == collected(rows.withColumn("rank", F.rank().over(up) + (ties - 1) / F.lit(2.0)))
    assert collected(ranking.midrank(rows, by, "v", descending=True, large=True)) == collected(rows.withColumn("rank", F.rank().over(down) + (ties - 1) / F.lit(2.0)))
    order = [F.col("v").desc_nulls_last(), F.col("i")]
    assert collected(ranking.positions(rows, by, order, large=True)) == collected(rows.withColumn("position", F.row_number().over(group.orderBy(*order))))


def test_board_of_a_million_in_many_tasks(spark):
    board = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003 % 250_000).cast("double").alias("score"), "id")
    ranked = ranking.competition_rank(board, [], "score")
    found = ranked.agg(F.min("rank"), F.max("rank"), F.count("rank"), F.countDistinct("rank")).first()
    assert found[0] == 1 and found[2] == 1_000_000 and found[3] == board.select("score").distinct().count()
    best = ranked.where("rank = 1").select(F.max("score"), F.count("score")).first()
    assert best[0] == 249_999.0 and ranked.where("score = 249998").first()["rank"] == 1 + best[1]


def holm_brute(ps, alpha=0.05):
    order = sorted(range(len(ps)), key=lambda i: (ps[i], i))
    out, high, fine = {}, 0.0, True
    for k, i in enumerate(order):
        high = max(high, ps[i] * (len(ps) - k))
        fine = fine and ps[i] <= alpha / (len(ps) - k)
        out[i] = (min(1.0, high), fine)
    return out


def test_holm_over_tasks(spark):
    rng = random.Random(8)
    ps = [(k % 3 if k % 50 else None, k, None if k % 17 == 0 else rng.choice([0.0, 1e-9, 1e-6 * rng.random(), rng.random()])) for k in range(3000)]
    df = spark.createDataFrame(ps, "f int, k int, p double").repartition(5)
    for by, families in ((["f"], {r[0] for r in ps}), ([], {"all"})):
        got = {r.k: (r.p_corrected, r.is_significant) for r in correction.holm(df, by, "p", ["k"]).collect()}
        assert len(got) == 3000
        for f in families:
            mine = [r for r in ps if r[2] is not None and (not by or r[0] == f)]
            for j, (raised, fine) in holm_brute([r[2] for r in mine]).items():
                assert got[mine[j][1]] == (pytest.approx(raised, rel=1e-12), fine)
        assert all(got[k] == (None, None) for _, k, p in ps if p is None)
    empty = correction.holm(df.limit(0), [], "p", ["k"])
    assert empty.collect() == [] and empty.columns == ["f", "k", "p", "p_corrected", "is_significant"]


def test_overlap_over_tasks(spark):
    rng = random.Random(5)
    made = []
    for g, n in (("x", 700), (None, 9), ("y", 1)):
        a, b = rng.sample(range(1, n + 1), n), rng.sample(range(1, n + 1), n)
        made += [(g, u, v) for u, v in zip(a, b, strict=True)]
    df = spark.createDataFrame(made, "g string, a int, b int").repartition(4)
    near = lambda rows: {r.g: (r.k, round(r.rbo, 12)) for r in rows.collect()}
    assert near(agreement.rbo(df, ["g"], "a", "b", large=True)) == near(agreement.rbo(df, ["g"], "a", "b"))
    one = df.where("g = 'x'")
    assert agreement.rbo(one, [], "a", "b").first().rbo == pytest.approx(agreement.rbo(one, ["g"], "a", "b").first().rbo, abs=1e-12)
