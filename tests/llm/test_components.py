"""Components with and without hot nodes split, and no broadcasts where the graph is small."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.llm import graph


def test_hot_nodes_split_or_not(spark, monkeypatch):
    edges = spark.createDataFrame([*((0, i) for i in range(1, 400)), (500, 501), (501, 502)], "a long, b long")
    whole = sorted(map(tuple, graph.components(edges).collect()))
    assert dict(whole) == {**dict.fromkeys(range(400), 0), 500: 500, 501: 500, 502: 500}
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree"))
    assert "broadcast" not in graph._tied(edges, least, 401)._jdf.queryExecution().logical().toString().lower()
    monkeypatch.setattr(graph, "FEW_EDGES", 10)
    assert sorted(map(tuple, graph.components(edges).collect())) == whole
