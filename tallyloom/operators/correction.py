"""Holm's correction for many tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ranking import positions
from tallyloom.operators.scan import Running, running


def holm(df: DataFrame, by: Sequence[str], p: str, order: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Add p_corrected and is_significant to the tests of each family, a family in as many tasks as it needs.

    Equal p-values keep the given order; once a test isn't significant, none
    after it is.  Null p-values take no part and get nulls.
    """
    tested = df.where(F.col(p).isNotNull())
    placed = positions(tested, by, [p, *order], "__place", large=True)
    if by:
        sizes, on = tested.groupBy(*by).agg(F.count(F.lit(1)).alias("__m")), None
        sizes = sizes.select("__m", *[F.col(c).alias(f"__f{i}") for i, c in enumerate(by)])
        for i, c in enumerate(by):
            equal = placed[c].eqNullSafe(sizes[f"__f{i}"])
            on = equal if on is None else on & equal
        sized = placed.join(sizes, on).drop(*[f"__f{i}" for i in range(len(by))])
    else:
        sized = placed.withColumn("__m", F.lit(tested.count()))
    left = F.col("__m") - F.col("__place") + 1
    missed = F.col(p) > F.lit(alpha) / left
    steps = running(sized, by, [p, *order], {"__raised": Running("max", F.col(p) * left), "__missed": Running("max", missed.cast("int"))})
    found = steps.select(*[F.col(f"`{c}`") for c in df.columns], F.least(F.lit(1.0), "__raised").alias("p_corrected"), (F.col("__missed") == 0).alias("is_significant"))
    untested = df.where(F.col(p).isNull()).select(*[F.col(f"`{c}`") for c in df.columns], F.lit(None).cast("double").alias("p_corrected"), F.lit(None).cast("boolean").alias("is_significant"))
    return found.unionByName(untested)
