"""A leaderboard over a stream of scored events: windows with a watermark, and each batch ranked at its sink.

Not a feature of the batch study; the same board kept up to date as events come.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallyloom.operators.ranking import competition_rank


def read_events(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive at a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_board(events: DataFrame, time: str, board: str, model: str, score: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, board, model, n, mean score) of each window; events later than the watermark are left out."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), board, model)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("score"))


def keep_ranked(board: DataFrame, by: list[str], checkpoint: str, sink: Callable[[DataFrame, int], None], once: bool = False) -> StreamingQuery:
    """Rank every finished window within its board and hand the rows to a sink, which must not mind a batch given twice."""
    writer = board.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda rows, k: sink(competition_rank(rows, by, "score"), k))
    return (writer.trigger(availableNow=True) if once else writer).start()
