"""Matching of names without a family: the choice without the list of pairs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tallyloom.functions import identity
from tallyloom.plans import match


def frames(spark, names, arena):
    info = lambda x: (None, None, *x)
    left = spark.createDataFrame([(n, info(i)) for n, i in names], f"model_name string, info {identity.IDENTITY}")
    right = spark.createDataFrame([(k, f"a{k}", info(i)) for k, i in enumerate(arena)], f"pos int, lmarena_model string, c_info {identity.IDENTITY}")
    return left, right


def listed(left, right):
    """The choice from the list of all pairs."""
    version = lambda c: identity.normal_version(F.col(f"{c}.version"))
    either = F.col("info.parameters").isNull() | F.col("c_info.parameters").isNull() | (F.lower("info.parameters") == F.lower("c_info.parameters"))
    pairs = left.join(right, version("info").eqNullSafe(version("c_info")) & either).withColumn("similarity", identity.similarity(F.col("info"), F.col("c_info")))
    return {(r.model_name, r.lmarena_model) for r in match.choose(pairs.withColumn("benchmark_id", F.lit("b"))).collect()}


def made(rng, words):
    date = rng.choice([None, None, "2025-01-01", "2025-02-02", "2024-03-03", "dec", "DEC"])
    parameters = rng.choice([None, None, "7B", "7b", "70B"])
    tokens = rng.choice([None, [], [""], *[rng.sample(words, rng.randint(1, 6)) for _ in range(6)]])
    return (rng.choice([None, None, None, "3", "3.0", "4.5"]), date, parameters, tokens)


def test_choice_equals_that_from_all_pairs(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(9)] + ["Hot", "hot", " hot "]
    for size in (60, 3):  # of a small arena many names have one candidate only
        names = [(f"n{i}", made(rng, words)) for i in range(150)]
        left, right = frames(spark, names, [made(rng, words) for _ in range(size)])
        got = match._best_unparsed(left, right).collect()
        assert len(got) == len({r.model_name for r in got}) and {(r.model_name, r.lmarena_model) for r in got} == listed(left, right)


def test_unparsed_names_do_not_go_quadratic(spark):
    """20,000 names of one key against as many, half of them with a word of all: no join makes rows near the square, and copies are one."""
    rows = [(f"n{i}", (None, None, None, ["common"] * (i % 2) + [f"a{i % 5000}", f"b{i % 4999}", f"c{i % 4000}"])) for i in range(20_000)]
    left, right = frames(spark, rows, [r[1] for r in rows])
    status = match._best_unparsed(left, right)
    assert len(status.collect()) == 20_000
    plan = status._jdf.queryExecution().executedPlan()
    assert "CartesianProduct" not in plan.toString() and "NestedLoop" not in plan.toString()

    def most(node):
        metrics = node.metrics()
        own = metrics.apply("numOutputRows").value() if metrics.contains("numOutputRows") else 0
        inner = [node.children().apply(i) for i in range(node.children().size())]
        if "AdaptiveSparkPlan" in node.nodeName():
            inner.append(node.executedPlan())
        if "QueryStage" in node.nodeName():
            inner.append(node.plan())
        return max([own, *map(most, inner)])

    assert 20_000 <= most(plan) < 2_000_000  # all pairs are 400,000,000


def test_whole_path_with_and_without_families(spark):
    names = spark.createDataFrame([("b", "gpt-5-high"), ("b", "strange thing one"), ("c", "strange thing one"), ("c", "nothing alike"), ("b", "claude-opus-4-1")], "benchmark_id string, model_name string")
    arena = match.arena_identities(spark.createDataFrame([(0, "one thing strange", "1400"), (1, "gpt-5-high", "1450"), (2, "other words here", "1400"), (3, "strange thing one", "1350"), (4, "claude-opus-4-1-thinking", "1400")], "row_no int, model_raw string, score_raw string"))
    got = sorted(tuple(r) for r in match.best_matches(names, arena).collect())
    assert got == sorted(tuple(r) for r in match.choose(match.candidates(names, arena)).collect())
    assert ("b", "strange thing one", "one thing strange") in got and ("b", "gpt-5-high", "gpt-5-high") in got


def test_long_names_meet_by_one_word(spark, monkeypatch):
    """Names above LONG words and those that they may meet; a name of 600 words has no key for each two of them."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(9)]
    names = [(f"n{i}", made(rng, words)) for i in range(150)]
    left, right = frames(spark, names, [made(rng, words) for _ in range(60)])
    monkeypatch.setattr(match, "LONG", 3)
    assert {(r.model_name, r.lmarena_model) for r in match._best_unparsed(left, right).collect()} == listed(left, right)
    monkeypatch.undo()
    one = spark.createDataFrame([(0, None, None, [f"w{i}" for i in range(600)])], "m_id long, m_date string, m_parameters string, by_rarity array<string>")
    assert match._word_keys(one, "m", [((False, False), (False, False))]).count() == 241
