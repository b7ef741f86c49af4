"""Scores in a JSON document that a page carries in an attribute.

All steps are column functions over variants: the document is parsed once, its
nested [tag, value] lists are walked by paths, models and metrics explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embedded_document(content: Column) -> Column:
    """The variant in the first props="..." of a text, else the text itself; null if neither is JSON."""
    inner = F.replace(F.regexp_extract(content, r'props="([^"]+)"', 1), F.lit("&quot;"), F.lit('"'))
    return F.coalesce(F.try_parse_json(F.when(inner != "", inner)), F.try_parse_json(content))


def metric_rows(pages: DataFrame, key: str, content: str, task: str = "overall") -> DataFrame:
    """(key, model_name, metric, value) in long form, from the first view with tasks."""
    views = F.try_variant_get(embedded_document(F.col(content)), "$.benchmarkView", "array<variant>")
    view = F.try_element_at(F.filter(views, lambda v: F.try_variant_get(v, "$.tasks", "variant").isNotNull()), F.lit(1))
    models = F.try_variant_get(view, f"$.tasks[1].{task}[1]", "map<string,variant>")
    rows = pages.select(F.col(key), F.explode(models).alias("model_name", "info"))
    metrics = rows.select(key, "model_name", F.explode(F.try_variant_get("info", "$[1]", "map<string,variant>")).alias("metric", "v"))
    value = F.coalesce(F.try_variant_get("v", "$[1]", "string"), F.try_variant_get("v", "$", "string"))
    return metrics.select(key, "model_name", "metric", value.alias("value"))


def metric_table(rows: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """A row for each model, a column for each metric."""
    return rows.groupBy(key, "model_name").pivot("metric", metrics).agg(F.first("value"))
