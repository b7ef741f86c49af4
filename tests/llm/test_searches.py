"""Exact top-k and hard negatives against a scan of all pairs, and hard cases."""

from __future__ import annotations

import math

import numpy as np
import pytest

pytest.importorskip("tallyloom.llm.topk")

from pyspark.sql import functions as F  # noqa: E402

from tallyloom.llm import negatives, topk  # noqa: E402

SCHEMA = "vec_id long, label int, embedding array<float>"


def whole(v, scale):
    return [math.floor(float(x) * scale) for x in v]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def top_brute(rows, k, every, scale):
    good = {i: whole(v, scale) for i, _, v in rows if i is not None and usable(v)}
    out = []
    for q in good:
        if q % every == 0:
            ranked = sorted((-dot(good[q], v), i) for i, v in good.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(ranked)]
    return sorted(out)


def mine_brute(rows, every, scale):
    good = {i: (c, whole(v, scale)) for i, c, v in rows if i is not None and c is not None and usable(v)}
    out = []
    for a in good:
        if a % every:
            continue
        label, v = good[a]
        scored = sorted((-dot(v, w), i, c) for i, (c, w) in good.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            fit = [(t, i) for t, i, c in scored if c != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(fit)]
    return sorted(out)


def clustered(n, d, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, d))
    at = rng.integers(0, 12, n)
    v = (centres[at] + 0.4 * rng.standard_normal((n, d))).astype(np.float32) / math.sqrt(d)
    return [(i, int(at[i] % labels), v[i].tolist()) for i in range(n)]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def small(monkeypatch):
    """So small that there are many annuli, parts, stripes and blocks."""
    for module, sizes in ((negatives, {"ANNULUS": 64, "PART": 40, "ASKED": 16, "PAIRS": 2000, "SAMPLE": 500}), (topk, {"STRIPE": 300, "LEAST_STRIPE": 100, "ASKED": 16})):
        for name, value in sizes.items():
            monkeypatch.setattr(module, name, value)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, small, seed):
    rows = clustered(1500, 24, seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_of(topk.top_k(df, F.col("vec_id") % 20 == 0, k=10, scale=1024.0)) == top_brute(rows, 10, 20, 1024)
    assert rows_of(negatives.mine(df, F.col("vec_id") % 20 == 0, scale=256.0)) == mine_brute(rows, 20, 256)


def test_annuli_are_left_out(spark, small):
    """A query near its cluster scans a part of the annuli only."""
    rows = [(i, c, [x * (1 if j % 3 else 8) for j, x in enumerate(v)]) for i, c, v in clustered(3000, 4, 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    index = negatives.Index(df.select(F.col("vec_id").alias("id"), F.col("label").cast("long"), F.col("embedding").alias("v")), 256.0)
    keys = index.keys.value
    v = np.array([whole(r[2], 256) for r in rows[:50]], float)
    assert len(keys.pivots) > 4 and keys.annuli > 4
    assert keys.met(v, np.full(50, 40.0)).mean() < 0.6
    inside = keys.place(v)[2]
    assert keys.met(v, np.full(50, 2 * math.sqrt(keys.most)))[np.arange(50), inside].all()


def test_hard_rows(spark, small):
    nan, inf = float("nan"), float("inf")
    ties = [(100 + i, i % 3, [0.5, 0.25, 0.0]) for i in range(60)]
    odd = [(0, 1, [0.5, 0.5, 0.5]), (1, 1, None), (2, 1, [nan, 0.0, 1.0]), (3, 2, [inf, 0.0, 0.0]), (4, None, [1.0, 1.0, 1.0]), (5, 2, [None, 1.0, 2.0]), (6, 2, [0.0, 0.0, 0.0]), (7, 3, [-1.0, -0.5, -0.25]), (20, 9, [1.0, 0.0, 0.0]), (None, 1, [1.0, 1.0, 1.0]), (9, 1, [1.0])]
    rows = ties + odd
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"query_id": F.lit(1), "score": F.lit("x"), "v": F.lit(1), "annulus": F.lit(2)})
    padded = [(i, c, None if v is None else [*v, *[0.0] * (3 - len(v))]) for i, c, v in rows]
    for frame in (df, df.union(df)):  # equal rows count once
        assert rows_of(topk.top_k(frame, F.col("vec_id") % 20 == 0, k=10, scale=1024.0)) == top_brute(padded, 10, 20, 1024)
        assert rows_of(negatives.mine(frame, F.col("vec_id") % 20 == 0, scale=256.0)) == mine_brute(padded, 20, 256)


def test_few_rows_empty_and_large_numbers(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(empty, F.col("vec_id") % 2 == 0).collect() == [] and negatives.mine(empty, F.col("vec_id") % 2 == 0).collect() == []
    rows = [(0, 1, [3e8, 1.0]), (1, 1, [2e8, 7.0]), (2, 0, [1.5e8, 3.0]), (4, 0, [1.9e8, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert rows_of(topk.top_k(df, F.col("vec_id") % 2 == 0, k=3, scale=1.0)) == top_brute(rows, 3, 2, 1)
    assert rows_of(negatives.mine(df, F.col("vec_id") % 2 == 0, scale=1.0)) == mine_brute(rows, 2, 1)
    huge = spark.createDataFrame([(0, 1, [1e200]), (1, 1, [1e200]), (2, 0, [-1e200])], "vec_id long, label int, embedding array<double>")
    assert [r.score for r in topk.top_k(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1 << 63) - 1, -(1 << 63)]
    assert negatives.mine(huge, F.col("vec_id") == 0).count() == 0
    one = spark.createDataFrame([(0, 1, [1.0])], SCHEMA)
    assert topk.top_k(one, F.lit(True)).count() == 0 and negatives.mine(one, F.lit(True)).count() == 0


def test_one_vector_in_a_third_of_all_rows(spark, small):
    rows = [(i, i % 5, [0.5, 0.5, 0.1]) if i % 3 == 0 else (i, i % 5, [math.sin(i), math.cos(i), math.sin(3 * i)]) for i in range(1200)]
    df = spark.createDataFrame(rows, SCHEMA)
    exact = [(i, c, np.float32(v).tolist()) for i, c, v in rows]
    assert rows_of(topk.top_k(df, F.col("vec_id") % 50 == 0, scale=1024.0)) == top_brute(exact, 10, 50, 1024)
    assert rows_of(negatives.mine(df, F.col("vec_id") % 50 == 0, scale=256.0)) == mine_brute(exact, 50, 256)
