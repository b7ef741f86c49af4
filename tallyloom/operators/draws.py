"""Draws in blocks: a group's rows are packed into arrays once, and each task computes a block of its draws in numpy.

What is shuffled is a copy of a group for each stretch of its draws, not a row
for every draw; of a draw only its result goes on.  There are at most SPREAD
stretches or one for each core, however large the group: a task takes the
blocks of its stretch, of about BLOCK numbers each, one after another.  A group
of more rows than PACKED isn't packed: the callers spread its draws over the
cluster as joins instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a group that are packed, random numbers that a block of draws takes, and stretches of a group's draws.
PACKED, BLOCK, SPREAD = 1 << 19, 1 << 20, 32

#: From a group's arrays, a block's first draw, the one after its last and the group's seed: arrays of one length by column.
Work = Callable[[list[np.ndarray], int, int, int], dict[str, np.ndarray]]


class _Reported(AccumulatorParam):
    """A sum whose growth is told to a callback of the driver; executors have no callback."""

    def __init__(self, tell: Callable[[int], None]):
        self.tell: Callable[[int], None] | None = tell

    def __getstate__(self) -> dict:
        return {"tell": None}

    def zero(self, value: int) -> int:
        return 0

    def addInPlace(self, value1: int, value2: int) -> int:  # noqa: N802
        if self.tell:
            self.tell(value1 + value2)
        return value1 + value2


def counter(context: SparkContext, tell: Callable[[int], None] | None):
    """An accumulator of finished draws that tells the driver their number as tasks end; a task that runs again counts again."""
    return context.accumulator(0, _Reported(tell)) if tell else None


def large_groups(rows: DataFrame, by: Sequence[str], most: int | None = None) -> DataFrame | None:
    """The keys of groups that have more than `most` rows, PACKED unless given, if there are any."""
    found = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > (PACKED if most is None else most)).drop("__n")
    return None if found.isEmpty() else found


def of_groups(rows: DataFrame, keys: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    """The rows whose key is (left_semi) or isn't (left_anti) among the keys, null keys included."""
    if not by:
        return rows if how == "left_semi" else rows.limit(0)
    other = keys.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)])
    on = None
    for i, c in enumerate(by):
        equal = rows[c].eqNullSafe(other[f"__k{i}"])
        on = equal if on is None else on & equal
    return rows.join(other, on, how)


def map_blocks(rows: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], draws: int, work: Work, schema: str, unit: int = 1, seed: Column | None = None, most: int | None = None, progress: Callable[[int], None] | None = None) -> DataFrame:
    """(by, n, schema): what `work` gives for each block of each group's draws; blocks begin at multiples of `unit`.

    The arrays are the columns as doubles, null as NaN, in the given order of
    rows.  most: draws a block at most, where a draw takes much more than its
    random numbers.  Blocks of one stretch are worked out in order, so that
    `work` may go on with a generator where the block before it stopped.
    """
    item = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    packed = rows.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("__rows")).where(F.size("__rows") > 0)
    values = [F.col("__rows").getField(f"v{i}").alias(f"__{i}") for i in range(len(columns))]
    own = seed if seed is not None else F.lit(0)
    sized = packed.select(*by, F.size("__rows").cast("long").alias("n"), own.cast("long").alias("__seed"), *values)
    each = F.expr(f"{unit} * greatest(1, {BLOCK} div (n * {unit}))")
    context = rows.sparkSession.sparkContext
    spread = max(SPREAD, context.defaultParallelism)
    stretched = sized.withColumn("__each", F.least(F.lit(draws), F.lit(most or draws), each)).withColumn("__stretch", F.expr(f"__each * greatest(1, ceil({draws} / (__each * {spread})))"))
    blocks = stretched.withColumn("__first", F.explode(F.expr(f"sequence(0, {draws} - 1, __stretch)")))
    done = counter(context, progress)
    names = [*by, "n"]
    arrow = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64()}
    types = {c: arrow[t] for c, t in (f.split() for f in schema.split(", "))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts, stretches, each_, seeds = (b.column(c).to_pylist() for c in ("__first", "__stretch", "__each", "__seed"))
            for i in range(b.num_rows):
                arrays = [b.column(f"__{k}")[i].values.to_numpy(zero_copy_only=False) for k in range(len(columns))]
                end = min(draws, starts[i] + stretches[i])
                for first in range(starts[i], end, each_[i]):
                    last = min(end, first + each_[i])
                    found = work(arrays, first, last, seeds[i])
                    if done is not None:
                        done.add(last - first)
                    many = len(next(iter(found.values())))
                    keys = [b.column(c).take(pa.array(np.full(many, i))) for c in names]
                    yield pa.RecordBatch.from_arrays([*keys, *[pa.array(v, types.get(c), from_pandas=True) for c, v in found.items()]], [*names, *found])

    head = "".join(f"`{c}` {blocks.schema[c].dataType.simpleString()}, " for c in names)
    # each row is a block of its own: dealt one by one, as hashing few keys would leave cores idle
    tasks = max(context.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return blocks.repartition(tasks).mapInArrow(run, head + schema)
