"""Running sums, maxima and minima over sorted rows, in as many tasks as the rows need, also for one group.

The rows are dealt by ranges of (group, order), so a group may lie in several
tasks, each of which scans its stretch as a stream.  Of each stretch the total
is kept; the totals before it are its carry.  Only a stretch at whose start a
group goes on has one, so there are fewer carries than tasks, and they are
broadcast.  The scanned rows are written to the checkpoint folder, as another
evaluation might cut the ranges elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import cut


@dataclass(frozen=True)
class Running:
    """A running "sum" of whole numbers, "max" or "min" of numbers, up to and with each row; null values change nothing."""

    kind: str
    value: Column


_NONE = {"sum": 0, "max": -np.inf, "min": np.inf}
_STEP = {"sum": np.add, "max": np.maximum, "min": np.minimum}


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each row but the first differs from the one before it; nulls are equal, and so are NaN."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    unequal = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    if pa.types.is_floating(column.type):
        nan = lambda x: pc.fill_null(pc.is_nan(x), False).to_numpy(zero_copy_only=False)
        unequal &= ~(nan(a) & nan(b))
    return unequal | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))


class _Scan:
    """The running values of a stream of sorted rows, group by group."""

    def __init__(self, keys: Sequence[str], kinds: Sequence[str]):
        self.keys, self.kinds = keys, kinds
        self.last: pa.RecordBatch | None = None
        self.state: list = []

    def __call__(self, batch: pa.RecordBatch) -> list[pa.Array]:
        n = batch.num_rows
        new = np.zeros(n, bool)
        new[0] = self.last is None
        for c in self.keys:
            new[1:] |= _changes(batch.column(c))
            if self.last is not None:
                new[0] |= bool(_changes(pa.concat_arrays([self.last.column(c), batch.column(c).slice(0, 1)]))[0])
        starts = np.flatnonzero(np.append(True, new[1:]))
        ends = np.append(starts[1:], n)
        out = []
        for k, kind in enumerate(self.kinds):
            values = batch.column(f"__v{k}").to_numpy(zero_copy_only=False)
            if kind != "sum":
                values = np.where(np.isnan(values), _NONE[kind], values)
            running = np.empty(n, np.int64 if kind == "sum" else float)
            for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
                _STEP[kind].accumulate(values[a:b], out=running[a:b])
                if not i and not new[0]:
                    _STEP[kind](running[a:b], self.state[k], out=running[a:b])
            out.append(pa.array(running))
        self.last, self.state = batch.slice(n - 1, 1), [x[n - 1].as_py() for x in out]
        return out


def _on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    on = left["__part"] == right["__c_part"]
    for i, k in enumerate(keys):
        on = on & left[k].eqNullSafe(right[f"__c{i}"])
    return on


def running(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], columns: dict[str, Running]) -> DataFrame:
    """The rows with a running value for each of `columns` over their group in the given order.

    The order has to be total: rows that are equal in it, a million equal keys
    say, stand in one task, in no certain order.
    """
    sort = [*[F.col(c).asc_nulls_first() for c in by], *[F.col(o).asc_nulls_first() if isinstance(o, str) else o for o in order]]
    kinds = [r.kind for r in columns.values()]
    values = [F.coalesce(r.value, F.lit(0)).cast("long") if r.kind == "sum" else r.value.cast("double") for r in columns.values()]
    rows = df.select("*", *[v.alias(f"__v{k}") for k, v in enumerate(values)])
    dealt = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__part", F.spark_partition_id())
    names, outs = dealt.columns, [f"__r{k}" for k in range(len(kinds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _Scan(list(by), kinds)
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, *scan(batch)], [*names, *outs])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    types = ", ".join(f"{o} {'long' if k == 'sum' else 'double'}" for o, k in zip(outs, kinds, strict=True))
    scanned = cut(dealt.mapInArrow(run, f"{fields}, {types}"))
    # the last running value of each stretch: the greatest, or for a minimum the least
    total = [(F.sum(f"__v{k}") if kind == "sum" else F.max(f"__r{k}") if kind == "max" else F.min(f"__r{k}")).alias(f"__t{k}") for k, kind in enumerate(kinds)]
    totals = scanned.groupBy("__part", *by).agg(*total)
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = [{"sum": F.sum, "max": F.max, "min": F.min}[kind](f"__t{k}").over(before).alias(f"__b{k}") for k, kind in enumerate(kinds)]
    carries = totals.select(F.col("__part").alias("__c_part"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(by)], *carried, F.count(F.lit(1)).over(before).alias("__earlier"))
    carries = F.broadcast(carries.where("__earlier > 0"))  # at most one for each task
    joined = scanned.join(carries, _on(scanned, carries, by), "left")
    merged = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "max": lambda a, b: F.greatest(a, b), "min": lambda a, b: F.least(a, b)}
    found = [merged[kind](F.col(f"__r{k}"), F.col(f"__b{k}")) for k, kind in enumerate(kinds)]
    finite = [x if kind == "sum" else F.when(F.abs(x) < float("inf"), x) for x, kind in zip(found, kinds, strict=True)]
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[x.alias(name) for x, name in zip(finite, columns, strict=True)])
