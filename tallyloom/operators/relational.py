"""Filters, joins and aggregates of score tables in long form."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ranking import first_per_key
from tallyloom.session import cut

#: Rows of a table that is still broadcast by `join_small`; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Ids of a block of `list_matches`: two blocks, 16 kB of long ids, are shuffled for a million pairs.
BLOCK = 1024
#: Ids of a block on the left, and on the right, that are listed against each other at once: Spark holds their pairs, 1,024 rows.
SLICE, RIGHT_SLICE = 16, 64


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if a look at rows + 1 of its rows shows that it is small, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def is_number(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def above(df: DataFrame, score: str, least: float) -> DataFrame:
    return df.where(F.col(score) >= least)


def study_universe(overall: DataFrame, model: str, score: str, least: float = 1330.0) -> DataFrame:
    """The distinct models whose overall score reaches `least`."""
    return above(overall, score, least).select(model).distinct()


def within(df: DataFrame, universe: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is in `universe`."""
    return df.join(universe.select(*key), list(key), "left_semi")


def without(df: DataFrame, key: str, values: Sequence) -> DataFrame:
    """Rows whose key is none of the values; a null key stays."""
    return df.where(F.coalesce(~F.col(key).isin(*values), F.lit(True)))


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The distinct keys that both sides have, in order."""
    return a.select(key).intersect(b.select(key)).orderBy(key)


def merge_back(records: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Records with the results of the same key; of a column that both have the result's counts."""
    return records.drop(*[c for c in results.columns if c != key]).join(results, key)


def inner_first(left: DataFrame, right: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Each row of `left` with the given columns of the first row of its key in `right`; keys without one go."""
    return left.join(first_per_key(right.select(key, *dict.fromkeys([*order, *columns])), [key], order).select(key, *columns), key)


def left_wide(keys: DataFrame, long: DataFrame, key: str, category: str, values: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """A row for each of `keys`, those without any category too, and for each category a column of each value: {category}_{value}."""
    wide = long.groupBy(key).pivot(category, list(categories)).agg(*[F.max(v).alias(v) for v in values])
    if len(values) == 1:  # Spark names the columns after the categories alone
        wide = wide.toDF(key, *[f"{c}_{values[0]}" for c in categories])
    return keys.select(key).distinct().join(wide, key, "left")


def score_columns(columns: Sequence[str]) -> list[str]:
    """The score columns of a wide table: those that end in _score and aren't an Elo."""
    return [c for c in columns if c.endswith("_score") and not c.startswith("elo_")]


def benchmark_scores(wide: DataFrame, key: str, benchmark: str, sanitized: str) -> DataFrame:
    """(key, score) of one benchmark in a wide table, by its id or its sanitised id; no rows if it has no column."""
    names = [f"{b}_score" for b in (benchmark, sanitized) if f"{b}_score" in wide.columns]
    if not names:
        return wide.select(key, F.lit(None).cast("double").alias("score")).limit(0)
    return wide.select(key, F.col(f"`{names[0]}`").try_cast("double").alias("score")).where(is_number(F.col("score")))


def look_up(df: DataFrame, mapping: DataFrame, on: str, value: str, default: Column | None = None) -> DataFrame:
    """Add the mapped value, `default` (null) where there is none."""
    joined = df.join(mapping.select(on, value), on, "left")
    return joined if default is None else joined.withColumn(value, F.coalesce(value, default))


def pivot_outer(long: DataFrame, key: str, category: str, value: str, categories: Sequence[str], prefix: str = "elo_") -> DataFrame:
    """A row for each key of any category and a column for each category, null where the key has none: a full outer join of the categories in one shuffle."""
    wide = long.groupBy(key).pivot(category, list(categories)).agg(F.max(value))
    return wide.select(key, *[F.col(f"`{c}`").alias(prefix + c) for c in categories])


def with_overlap(scores: DataFrame, by: Sequence[str], least: int = 6) -> DataFrame:
    """Groups of at least `least` rows, with their count."""
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def overlap_statistics(scores: DataFrame, universe: DataFrame, by: Sequence[str], model: str) -> DataFrame:
    """For each group the models, those in the universe, and their share of it in per cent (0 for an empty universe)."""
    members = universe.select(model).distinct()
    size = members.count()
    marked = scores.join(members.withColumn("__in", F.lit(1)), model, "left")
    counts = marked.groupBy(*by).agg(F.count(F.lit(1)).alias("n_models"), F.count("__in").alias("n_overlap"))
    return counts.select(*by, "n_models", "n_overlap", F.coalesce(F.try_divide(F.col("n_overlap") * 100.0, F.lit(size)), F.lit(0.0)).alias("overlap_pct"))


def difficulty(scores: DataFrame, by: Sequence[str], score: str, elo: str, low: float = 1400.0, high: float = 1430.0, least: int = 5) -> DataFrame:
    """100 less the mean score of the models within the Elo band; of all, and marked as an estimate, if the band has fewer than `least`."""
    inside = F.when(F.col(elo).between(low, high), F.col(score))
    found = scores.where(is_number(F.col(score))).groupBy(*by).agg(F.count(inside).alias("n_band"), F.avg(inside).alias("band_mean"), F.avg(score).alias("all_mean"))
    enough = F.col("n_band") >= least
    return found.select(*by, "n_band", F.when(enough, F.col("band_mean")).alias("subset_avg_score"), (100.0 - F.when(enough, F.col("band_mean")).otherwise(F.col("all_mean"))).alias("difficulty"), (~enough).alias("is_estimated_difficulty"))


def coefficient_of_variation(scores: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """Sample standard deviation over mean; null for fewer than two scores or mean zero."""
    return scores.where(is_number(F.col(score))).groupBy(*by).agg(F.try_divide(F.stddev_samp(score), F.avg(score)).alias("cv"))


def reference_difficulty(scores: DataFrame, by: Sequence[str], model: str, score: str, references: Sequence) -> DataFrame:
    """100 less the mean score of the reference models, of groups that have all of them."""
    chosen = scores.where(F.col(model).isin(*references) & is_number(F.col(score)))
    return chosen.groupBy(*by).agg(F.avg(score).alias("reference_avg_score"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(references)).withColumn("reference_difficulty", 100.0 - F.col("reference_avg_score")).drop("n")


def quantiles(df: DataFrame, by: Sequence[str], value: str, at: Sequence[float] = (0.025, 0.975), names: Sequence[str] = ("lower", "upper")) -> DataFrame:
    """Percentiles with linear interpolation over the finite values."""
    good = F.when(is_number(F.col(value)), F.col(value))
    return df.groupBy(*by).agg(F.percentile(good, F.array(*map(F.lit, at))).alias("__q")).select(*by, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])


def null_safe_match(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], residual: Column | None = None) -> DataFrame:
    """Join where all keys are equal, two nulls included, and the residual holds; a hash join, not a loop over pairs."""
    on = None
    for a, b in keys:
        equal = left[a].eqNullSafe(right[b])
        on = equal if on is None else on & equal
    return left.join(right, on if residual is None else on & residual)


def _blocks(rows: DataFrame, keys: Sequence[str], soft: str, identity: str, side: str) -> DataFrame:
    """The ids of rows of equal keys and soft value in arrays of at most BLOCK; rows are sorted and numbered, so a kind of any size is dealt over tasks."""
    names = [*[f"{side}k{i}" for i in range(len(keys))], f"{side}soft"]
    kept = rows.where(F.col(identity).isNotNull()).select(*[F.col(c).alias(n) for c, n in zip((*keys, soft), names, strict=True)], F.col(identity).alias(f"{side}id"))
    order = [*names, f"{side}id"]
    placed = kept.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(f"{side}block", F.expr(f"monotonically_increasing_id() div {BLOCK}"))
    return cut(placed.groupBy(*names, f"{side}block").agg(F.collect_list(f"{side}id").alias(f"{side}ids")))


def list_matches(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], soft: tuple[str, str], ids: tuple[str, str]) -> DataFrame:
    """Every pair of unequal ids whose rows have equal keys, two nulls included, and an equal soft value, in either case, or a null on either side: ids, keys as on the left, soft values.

    The pairs are those of `null_safe_match`, of which there may be the square
    of the rows.  Rows of one kind are alike but for their ids, so blocks of ids
    are joined, block pairs are dealt over all cores, and only there written out
    as rows: a task holds a block of either side, and what is shuffled is two
    blocks for up to BLOCK * BLOCK pairs.
    """
    a, b = (_blocks(df, [k[side] for k in keys], soft[side], ids[side], "__l" if side == 0 else "__r") for side, df in enumerate((left, right)))
    same = functools.reduce(lambda x, y: x & y, [F.col(f"__lk{i}").eqNullSafe(F.col(f"__rk{i}")) for i in range(len(keys))])
    mine, theirs = F.col("__lsoft"), F.col("__rsoft")
    b = b.hint("merge")  # a block is wide: nothing that grows with the table is broadcast
    equal = a.join(b, same & F.lower(mine).eqNullSafe(F.lower(theirs)))
    open_left = a.where(mine.isNull()).join(b.where(theirs.isNotNull()), same)
    open_right = a.where(mine.isNotNull()).join(b.where(theirs.isNull()), same)
    spark = left.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = equal.union(open_left).union(open_right).repartition(tasks, "__lblock", "__lsoft", "__rblock", "__rsoft")
    names = [F.col(f"__lk{i}").alias(k) for i, (k, _) in enumerate(keys)] + [mine.alias(soft[0]), theirs.alias(soft[1])]
    # Spark holds the rows that two explodes in one stage make of a row, so a row has a slice of either block
    slices = lambda c, n: F.explode(F.transform(F.sequence(F.lit(1), F.size(c), F.lit(n)), lambda i: F.slice(c, i, F.lit(n)))).alias(c)
    outer = dealt.select(*names, "__lids", slices("__rids", RIGHT_SLICE))
    sliced = outer.select(*[c for c in outer.columns if c != "__lids"], slices("__lids", SLICE))
    pairs = sliced.select("*", F.explode("__lids").alias(ids[0])).select("*", F.explode("__rids").alias(ids[1]))
    return pairs.where(F.col(ids[0]) != F.col(ids[1])).drop("__lids", "__rids")


def count_matches(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], soft: tuple[str, str]) -> DataFrame:
    """Each row of `left` with `matches`: how many rows of `right` have equal keys, two nulls included, and an equal soft value, in either case, or a null on either side.

    Rows of `right` are counted by keys and soft value and never listed beside
    those of `left`, so the work grows with the two sides, not with their pairs.
    """
    kinds = right.groupBy(*[F.col(r).alias(f"__k{i}") for i, (_, r) in enumerate(keys)], F.lower(soft[1]).alias("__soft")).agg(F.count(F.lit(1)).alias("__n"))
    names = [f"__k{i}" for i in range(len(keys))]
    every = kinds.groupBy(*names).agg(F.sum("__n").alias("__every"), F.sum(F.when(F.col("__soft").isNull(), F.col("__n"))).alias("__plain"))
    equal = kinds.where(F.col("__soft").isNotNull()).select(*[F.col(c).alias(f"{c}e") for c in names], F.col("__soft").alias("__softe"), F.col("__n").alias("__equal"))
    same = lambda df, end: functools.reduce(lambda a, b: a & b, [left[a].eqNullSafe(df[f"{c}{end}"]) for c, (a, _) in zip(names, keys, strict=True)])
    joined = left.join(every, same(every, ""), "left").join(equal, same(equal, "e") & (F.lower(left[soft[0]]) == equal["__softe"]), "left")
    some = F.coalesce("__plain", F.lit(0)) + F.coalesce("__equal", F.lit(0))
    return joined.select(*[left[c] for c in left.columns], F.when(left[soft[0]].isNull(), F.coalesce("__every", F.lit(0))).otherwise(some).alias("matches"))
