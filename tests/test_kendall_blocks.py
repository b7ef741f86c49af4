"""Kendall's tau of a group in blocks over many tasks equals that of one task."""

from __future__ import annotations

import random

import pytest

from tallyloom.operators import agreement


def compared(df, by, monkeypatch, rows, cuts):
    want = {tuple(r[c] for c in by): r for r in agreement.kendall(df, by, "x", "y").collect()}
    monkeypatch.setattr(agreement, "KENDALL_ROWS", rows)
    monkeypatch.setattr(agreement, "KENDALL_CUTS", cuts)
    plan = agreement.kendall(df, by, "x", "y")
    got = {tuple(r[c] for c in by): r for r in plan.collect()}
    assert got.keys() == want.keys()
    for k, r in want.items():
        for c in ("n", "tau", "z"):
            assert (got[k][c] is None and r[c] is None) or got[k][c] == pytest.approx(r[c], rel=1e-9, abs=1e-12), (k, c)
    return got


def test_blocks_equal_one_task(spark, monkeypatch):
    rng = random.Random(6)
    made = []
    for g, n, kinds in (("continuous", 900, 10**6), ("ties", 900, 12), ("one value", 400, 1), (None, 500, 60), ("small", 20, 5)):
        for _ in range(n):
            x = rng.randrange(kinds) if rng.random() < 0.7 else 3  # a third of the values are one
            made.append((g, float(x), float(x + rng.randrange(max(1, kinds))) if rng.random() < 0.9 else None))
    df = spark.createDataFrame(made, "g string, x double, y double").repartition(5)
    got = compared(df, ["g"], monkeypatch, 100, 7)
    assert got[("continuous",)].tau > 0.3


def test_without_a_key_and_at_size(spark, monkeypatch):
    df = spark.range(300_000).selectExpr("cast(id * 7919 % 100003 as double) x", "cast(id * 7919 % 100003 * 3 + id * 31 % 50021 as double) y")
    got = compared(df, [], monkeypatch, 1 << 17, 32)
    assert got[()].n == 300_000 and 0 < got[()].tau < 1
