"""Matching of all parts against all others without rows for their pairs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tallyloom import queries
from tallyloom.functions import identity
from tallyloom.operators import ranking, relational
from tallyloom.plans import match


def most_rows(df):
    """The most rows that any step of the executed plan gave."""

    def most(node):
        metrics = node.metrics()
        own = metrics.apply("numOutputRows").value() if metrics.contains("numOutputRows") else 0
        inner = [node.children().apply(i) for i in range(node.children().size())]
        if "AdaptiveSparkPlan" in node.nodeName():
            inner.append(node.executedPlan())
        if "QueryStage" in node.nodeName():
            inner.append(node.plan())
        return max([own, *map(most, inner)])

    return most(df._jdf.queryExecution().executedPlan())


def generated(df):
    """The rows that each explode of the executed plan gave, the last one first."""

    def walk(node):
        inner = [node.children().apply(i) for i in range(node.children().size())]
        if "AdaptiveSparkPlan" in node.nodeName():
            inner.append(node.executedPlan())
        if "QueryStage" in node.nodeName():
            inner.append(node.plan())
        own = [node.metrics().apply("numOutputRows").value()] if "Generate" in node.nodeName() and "CodeGen" not in node.nodeName() else []
        return own + [n for x in inner for n in walk(x)]

    return walk(df._jdf.queryExecution().executedPlan())


def parts(spark, folder, n, names):
    rng = random.Random(3)
    rows = [(k, rng.choice(names), f"Brand#{rng.randint(1, 3)}", "PROMO", rng.randint(1, 12)) for k in range(n)]
    df = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    df.write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_candidates_are_counted_not_listed(spark, tmp_path):
    """3,000 parts have over a million pairs; no step makes rows near that, and the counts are those of the list."""
    d = parts(spark, tmp_path, 3000, ["hot bolt", "hot rod", "old rod"])
    found = queries.q_match_statistics(spark, d)
    listed = queries._candidates(spark, d)
    assert listed.count() > 1_000_000
    assert found.collect() == match.statistics(listed.select(F.lit("parts").alias("benchmark_id"), F.col("name").alias("model_name"), F.col("candidate").alias("lmarena_model"))).collect()
    assert most_rows(found) <= 3000


def test_names_without_candidates_and_names_of_one(spark, tmp_path):
    rows = [(1, "a x", "B", "T", 1), (2, "a x", "B", "T", 4), (3, "b y", "B", "T", 2), (4, "c z", "B", "T", 2), (5, "c w", "C", "T", 8), (6, None, "C", "T", 3), (7, None, "B", "T", 3)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = queries.q_match_statistics(spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == [("parts", 2, 0, 2)]


def test_count_matches_counts_nulls_as_equal(spark):
    left = spark.createDataFrame([("l", None, "7b"), ("m", "f", None), ("n", "g", "7B"), ("o", None, None)], "id string, k string, p string")
    right = spark.createDataFrame([(None, "7B"), (None, None), (None, "8b"), ("f", "7b"), ("f", None)], "k string, p string")
    got = {r.id: r.matches for r in relational.count_matches(left, right, [("k", "k")], ("p", "p")).collect()}
    assert got == {"l": 2, "m": 2, "n": 0, "o": 3}


def test_best_of_kinds_is_that_of_the_list(spark, tmp_path):
    """Of 3,000 parts and over a million pairs the same best matches, from kinds; ties go to the least key, never to a part itself."""
    d = parts(spark, tmp_path, 3000, ["hot bolt", "hot rod", "old rod", "old old bolt"])
    found = queries.q_match_top1_similarity(spark, d)
    got = sorted(map(tuple, found.collect()))
    assert most_rows(found) <= 200_000
    info = lambda c: F.struct(*[F.col(c + f).alias(f) for f in ("family", "subfamily", "date", "parameters")], F.col(c + "tokens").alias("other_info"))
    listed = queries._candidates(spark, d).select("key", "c_key", F.round(identity.similarity(info(""), info("c_"), True), 10).alias("similarity"))
    assert got == sorted(map(tuple, ranking.best_candidate(listed, ["key"], "similarity", ["c_key"]).collect())) and len(got) == 3000


def test_only_and_poor_matches_and_repeated_ids(spark, tmp_path):
    schema = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"
    rows = [(1, "a x", "B", "T", 1), (5, "a x", "B", "T", 1), (2, "b y", "B", "T", 2), (3, "b z", "C", "T", 2), (7, "c z", "C", "T", 2), (9, None, "C", "T", 3), (10, None, "B", "T", 3)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/a/part.parquet")
    spark.createDataFrame([*rows, (5, "a x", "B", "T", 1)], schema).write.parquet(f"{tmp_path}/b/part.parquet")
    one, two = ({r.key: r.c_key for r in queries.q_match_top1_similarity(spark, f"{tmp_path}/{x}").collect()} for x in "ab")
    assert one == {1: 5, 5: 1, 9: 10, 10: 9} and two == one


def test_listed_pairs_are_dealt_over_tasks(spark, tmp_path):
    """Parts of one file and three kinds have over a million pairs; they are those of the plain join, and no task lists half of them."""
    spark.read.parquet(f"{parts(spark, tmp_path / 'a', 3000, ['hot bolt', 'hot rod', 'old rod'])}/part.parquet").coalesce(1).write.parquet(f"{tmp_path}/b/part.parquet")
    d = str(tmp_path / "b")
    found = queries.q_null_safe_match(spark, d)
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    listed = queries._candidates(spark, d).select(*found.columns)
    assert sum(tasks) == listed.count() > 1_000_000 and max(tasks) < sum(tasks) / 2
    assert found.exceptAll(listed).isEmpty() and listed.exceptAll(found).isEmpty()


def test_few_pairs_are_held_at_once(spark, tmp_path):
    """Spark holds what two explodes make of a row: parts of one kind, over a million pairs, come from rows of 1,024 pairs or fewer."""
    rows = [(k, "hot bolt", "Brand#1", "PROMO", 3) for k in range(1200)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = queries.q_null_safe_match(spark, str(tmp_path))
    assert len(found.collect()) == 1200 * 1199
    pairs, _, held, *_ = generated(found)
    assert pairs >= 1200 * 1199 and held >= pairs / 1024


def test_listed_pairs_of_nulls_cases_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(relational, "BLOCK", 8)
    monkeypatch.setattr(relational, "SLICE", 3)
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, "f", "g"]), rng.choice([None, 1]), rng.choice([None, "7b", "7B", "8b"])) for _ in range(200)]
    left = spark.createDataFrame(rows, "key long, k string, v int, p string")
    right = left.toDF("c_key", "c_k", "c_v", "c_p")
    keys = [("k", "c_k"), ("v", "c_v")]
    got = relational.list_matches(left, right, keys, ("p", "c_p"), ("key", "c_key")).select("key", "c_key", "k", "v", "p", "c_p").collect()
    either = left["p"].isNull() | right["c_p"].isNull() | (F.lower(left["p"]) == F.lower(right["c_p"]))
    want = relational.null_safe_match(left, right, keys, either & (left["key"] != right["c_key"])).select("key", "c_key", "k", "v", "p", "c_p").collect()
    order = lambda rows: sorted(map(repr, map(tuple, rows)))
    assert len(want) > 1000 and order(got) == order(want)
    nothing = relational.list_matches(left.limit(0), right, keys, ("p", "c_p"), ("key", "c_key"))
    assert nothing.collect() == []


def test_names_of_common_words_make_few_pairs(spark, tmp_path):
    """1,500 names of six words each, all but one of which many share: the choice is that from all pairs, and pairs that can't be chosen aren't made."""
    spark.createDataFrame([(k,) for k in range(1500)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    found = queries.q_match_unparsed(spark, str(tmp_path))
    got = sorted(map(tuple, found.collect()))
    assert most_rows(found) <= 30_000  # all pairs are 2,250,000
    rows = queries._unparsed(spark, str(tmp_path))
    names = rows.select(F.lit("parts").alias("benchmark_id"), F.col("text").alias("model_name")).distinct()
    arena = match.arena_identities(rows.select(F.col("pos").alias("row_no"), F.col("other").alias("model_raw"), F.lit("1400").alias("score_raw")))
    assert got == sorted(map(tuple, match.choose(match.candidates(names, arena)).collect())) and got
