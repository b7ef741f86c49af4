"""Ranks, positions and first-of-key selection.

A group is a window, which one task sorts.  With no key to group by, or where
`large` says that groups are too large for a task, ranks come from running
counts over the distinct values and positions from running counts over the
rows, in as many tasks as those need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.scan import Running, running


def _places(df: DataFrame, by: Sequence[str], value: str, descending: bool, out: str, place: Column) -> DataFrame:
    """The rows with `place`, made of the number __upto of rows up to their value and __n with it.

    Equal values are one row of the scan, so a value of very many rows is no
    burden; the join back to the rows is one that adaptive execution splits.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_first()
    places = running(counts, by, [order], {"__upto": Running("sum", F.col("__n"))})
    keys = [*by, value]
    named = places.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], place.alias(out))
    on = None
    for i, c in enumerate(keys):
        equal = df[c].eqNullSafe(named[f"__k{i}"])
        on = equal if on is None else on & equal
    kept = [F.col(f"`{c}`") for c in df.columns if c != out]
    return df.join(named, on).select(*kept, named[out])


def _columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def competition_rank(df: DataFrame, by: Sequence[str], score: str, out: str = "rank", large: bool = False) -> DataFrame:
    """1, 2, 2, 4: the highest score first, equal scores the best rank of the tie; null scores last."""
    if large or not by:
        return _places(df, by, score, True, out, (F.col("__upto") - F.col("__n") + 1).cast("int"))
    order = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last())
    return df.withColumn(out, F.rank().over(order))


def midrank(df: DataFrame, by: Sequence[str], value: str, out: str = "rank", descending: bool = False, large: bool = False) -> DataFrame:
    """1, 2.5, 2.5, 4: equal values share the mean of their places; nulls stand at the end if descending, else at the start."""
    if large or not by:
        return _places(df, by, value, descending, out, F.col("__upto") - (F.col("__n") - 1) / F.lit(2.0))
    key = F.col(value).desc() if descending else F.col(value).asc()
    least = F.rank().over(Window.partitionBy(*by).orderBy(key))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return df.withColumn(out, least + (ties - 1) / F.lit(2.0))


def positions(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], out: str = "position", large: bool = False) -> DataFrame:
    """1, 2, 3, 4 in an order that the caller makes total."""
    if large or not by:
        numbered = running(df, by, _columns(order), {"__place": Running("sum", F.lit(1))})
        return numbered.select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.col("__place").cast("int").alias(out))
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*_columns(order))))


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return positions(df, key, order, "__n").where(F.col("__n") == 1).drop("__n")


def number_duplicates(df: DataFrame, by: Sequence[str], name: str, order: Sequence[str | Column]) -> DataFrame:
    """The second and later rows of a name get "(2)", "(3)" and so on, in the given order."""
    numbered = positions(df, [*by, name], order, "__n")
    suffixed = F.concat(F.col(name), F.lit("("), F.col("__n").cast("string"), F.lit(")"))
    return numbered.withColumn(name, F.when(F.col("__n") > 1, suffixed).otherwise(F.col(name))).drop("__n")


def best_candidate(df: DataFrame, key: Sequence[str], similarity: str, order: Sequence[str | Column], least: float = 0.3) -> DataFrame:
    """Of each key the row of highest similarity, the first in order among equals.

    A key's only row is taken whatever its similarity; the best of several
    only from `least` on.
    """
    if all(isinstance(o, str) for o in order) and not any("map<" in t or "variant" in t for _, t in df.dtypes):
        # an aggregate, which combines before it shuffles
        rest = [c for c in df.columns if c not in key]
        place = F.struct(F.coalesce(-F.col(similarity), F.lit(float("inf"))).alias("o"), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
        best = df.groupBy(*key).agg(F.min(place).alias("__best"), F.count(F.lit(1)).alias("__several"))
        fit = (F.col("__several") == 1) | (F.col("__best.row")[similarity] >= least)
        return best.where(fit).select(*[F.col(f"`{c}`") if c in key else F.col("__best.row")[c].alias(c) for c in df.columns])
    several = F.count(F.lit(1)).over(Window.partitionBy(*key))
    ranked = positions(df.withColumn("__several", several), key, [F.col(similarity).desc_nulls_last(), *_columns(order)], "__n")
    return ranked.where((F.col("__n") == 1) & ((F.col("__several") == 1) | (F.col(similarity) >= least))).drop("__n", "__several")


def column_minimum_flag(df: DataFrame, by: Sequence[str], value: str, out: str = "is_minimum") -> DataFrame:
    """Whether a value is the least of its group; null for null values."""
    return df.withColumn(out, F.col(value) == F.min(value).over(Window.partitionBy(*by)))
