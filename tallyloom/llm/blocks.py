"""Queries that meet rows in blocks: each pair of blocks is one stretch of a sorted stream, so no task holds a block of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Above this, sums of products of doubles aren't sure to be whole numbers any more.
WHOLE = float(1 << 53)
LONG = (1 << 63) - 1


class Meeting(Protocol):
    """What one pair of blocks does: it is asked first, then scans rows as they come, then says what it has found."""

    def ask(self, rows: pa.Table) -> None: ...

    def scan(self, rows: pa.Table) -> None: ...

    def found(self) -> pa.RecordBatch: ...


def meet(asked: DataFrame, rows: DataFrame, keys: Sequence[str], meeting: Callable[[], Meeting], schema: str) -> DataFrame:
    """A `meeting` for each value of the keys, which both sides have; the asked side of a key has to be small, the rows are streamed."""
    both = asked.withColumn("__kind", F.lit(0)).unionByName(rows.withColumn("__kind", F.lit(1)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_ = None, None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            marks = np.column_stack([t.column(c).to_numpy() for c in (*keys, "__kind")])
            starts = np.flatnonzero(np.append(True, (marks[1:] != marks[:-1]).any(1)))[: len(marks)]
            for a, b in zip(starts, np.append(starts[1:], len(marks)), strict=True):
                key, kind = tuple(marks[a, :-1]), marks[a, -1]
                if key != now:
                    if open_ is not None:
                        yield open_.found()
                    now, open_ = key, meeting()
                (open_.scan if kind else open_.ask)(t.slice(a, b - a))
        if open_ is not None:
            yield open_.found()

    return both.repartition(*keys).sortWithinPartitions(*keys, "__kind").mapInArrow(run, schema)


def matrix(column: pa.ChunkedArray, scale: float, width: int = 0) -> np.ndarray:
    """floor(scale * x) of lists of numbers, a row each, filled up with zeros to the longest or to `width`."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.float64()))
    offsets = lists.offsets.to_numpy()
    flat = np.floor(lists.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    lengths = np.diff(offsets)
    width = max(width, int(lengths.max(initial=0)))
    if len(lengths) and (lengths == width).all():
        return flat[offsets[0] : offsets[-1]].reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    inside = np.arange(width) < lengths[:, None]
    out[inside] = flat[offsets[0] : offsets[-1]]
    return out


def widened(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] >= width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether inner products of the rows are whole numbers that doubles hold."""
    return np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]) < WHOLE


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all of b as longs; what a long can't hold becomes its end."""
    if exact(a, b):
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, -LONG - 1, LONG).astype(np.int64)


def numbers(vector: Column, kind: str) -> Column:
    """The vector as it is stored if of floats, else of doubles."""
    return vector if kind == "array<float>" else vector.cast("array<double>")


def usable(vector: Column, scale: float) -> Column:
    """Whether the vector is there and every component, scaled, is a finite number."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) * scale < float("inf")), F.lit(False)))


def block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def every_block(blocks: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
