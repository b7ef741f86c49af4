"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker handles at once; a longer document is a slice of its own.
SLICE_BYTES = 4 << 20

#: What separates words in every operator: the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset a local session gets a folder of its own; on a cluster
    it is an error, as no machine's own folder is seen by the others.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = context.getConf().get("spark.checkpoint.dir")
        if not where and context.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="tallyloom-checkpoint-"))
    return context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with reliable files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """The frame with a broadcast hint if it has at most `rows` rows, else as it is, so that the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """The frame, dealt anew over all cores if its scan has fewer splits than there are cores, as for a table of one small file."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def fold(key: str | Column) -> Column:
    """The cross-validation remainder of a row: crc32 of its key as text, mod 4."""
    key = F.col(key) if isinstance(key, str) else key
    return (F.crc32(key.cast("string").cast("binary")) % 4).cast("int")


def share_hash(key: Column, seed: int) -> Column:
    """A reproducible number in [0, 1) for each key, for bounded samples."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(1 << 32)) / float(1 << 32)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of the named string column each, so memory is bounded by the longest row."""
    lengths = batch.column(column)
    sizes = [0 if x is None else x for x in pc.binary_length(lengths).to_pylist()]
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield batch.slice(begin)


def map_text(df: DataFrame, column: str, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch], most: int = SLICE_BYTES) -> DataFrame:
    """Apply `work` to slices of bounded size of each partition; no shuffle, no state between slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, most):
                yield work(part)

    return df.mapInArrow(run, schema)
