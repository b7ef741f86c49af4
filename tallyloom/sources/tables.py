"""CSV and JSON sources.

All files below a folder are one scan, of any store that Spark reads: small
files share a task, and each is decoded, by the first encoding that fits, and
parsed where it is read.
"""

from __future__ import annotations

import csv
import io
import itertools
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.cleaning import benchmark_id_from_path

ENCODINGS = ("utf-8", "gbk", "latin-1", "cp1252")

METADATA = "benchmark_id string, leaderboard_url string, question_count int, question_type string, category string, release_date string, task_type string, scraping_method string, complexity string, elo_column string"


def encoding_of(raw: bytes, encodings: Sequence[str] = ENCODINGS) -> str:
    """The first encoding that decodes the bytes."""
    for name in encodings:
        try:
            raw.decode(name)
        except UnicodeDecodeError:
            continue
        return name
    raise ValueError(f"none of {', '.join(encodings)} decodes the file")


def discover(spark: SparkSession, root: str, name: str = "data.csv") -> DataFrame:
    """(path, benchmark_id, content) of every file of that name (a glob) below `root`; the id is the folder's name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    return files.select("path", benchmark_id_from_path(F.col("path")).alias("benchmark_id"), "content")


def encodings(files: DataFrame) -> DataFrame:
    """(path, benchmark_id, encoding) of discovered files; a file that no encoding decodes is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [encoding_of(raw) for raw in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], ["path", "benchmark_id", "encoding"])

    return files.select("path", "benchmark_id", "content").mapInArrow(run, "path string, benchmark_id string, encoding string")


def read_text_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """All columns as text, with row_no in file order; the encoding is found by trial unless given."""
    if encoding is None:
        files = spark.read.format("binaryFile").load(path).select("path", F.lit("").alias("benchmark_id"), "content")
        encoding = encodings(files).first()["encoding"]
    if encoding != "utf-8":  # Spark's own reader knows none of the others by name
        return _decoded_csv(spark, path, encoding)
    reader = spark.read.option("header", "true").option("inferSchema", "false").option("encoding", encoding).option("multiLine", "true").option("escape", '"')
    # one file, read by one task: ids increase in its order
    return reader.csv(path).coalesce(1).withColumn("row_no", F.monotonically_increasing_id())


def _decoded_csv(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """The same for a file that an executor decodes; blanks are null, as there."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                rows = [[c or None for c in r] for r in csv.reader(io.StringIO(raw.decode(encoding), newline="")) if r]
                yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(rows) - 1), pa.int64()), pa.array(rows, pa.list_(pa.string()))], ["row_no", "cells"])

    rows = files.mapInArrow(run, "row_no long, cells array<string>")
    head = rows.where("row_no = -1").first()
    names = [c or f"_c{i}" for i, c in enumerate(head["cells"] if head else [])]
    return rows.where("row_no >= 0").select(*[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(names)], "row_no")


#: Rows of a board that are held at once.
ROWS = 8192


def _headings(row: Sequence[str]) -> list[str]:
    """Names of all columns: a blank one by its place, a repeated one numbered."""
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(row):
        name = name or f"_c{i}"
        k = seen[name] = seen.get(name, -1) + 1
        out.append(f"{name}.{k}" if k else name)
    return out


def parsed_csv(raw: bytes) -> Iterator[tuple[list[str], list[list[str | None]]]]:
    """The headings and the rows, ROWS at a time, of a CSV file in any of the encodings; blanks are null, short rows filled up, long ones cut."""
    lines = csv.reader(io.StringIO(raw.decode(encoding_of(raw)).removeprefix("\ufeff"), newline=""))
    rows = (r for r in lines if r)
    names = _headings(next(rows, []))
    n, sent = len(names), False
    while part := list(itertools.islice(rows, ROWS)):
        yield names, [[c or None for c in r[:n]] + [None] * (n - len(r)) for r in part]
        sent = True
    if not sent:
        yield names, []


def map_board_files(spark: SparkSession, root: str, name: str, schema: str, work: Callable[[str, str, list[str], list[list[str | None]], int], dict[str, pa.Array]]) -> DataFrame:
    """(path, benchmark_id, schema): what `work` makes of (path, id, headings, rows, number of the first row) of every file of that name below `root`."""
    files = discover(spark, root, name)
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"no {name} below {root}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, ids, contents = batch.columns
            for i in range(batch.num_rows):
                path, benchmark, first = paths[i].as_py(), ids[i].as_py(), 0
                for names, rows in parsed_csv(contents[i].as_py()):
                    if not names:
                        continue
                    made = work(path, benchmark, names, rows, first)
                    keys = [pa.array([x] * len(rows), pa.string()) for x in (path, benchmark)]
                    yield pa.RecordBatch.from_arrays([*keys, *made.values()], ["path", "benchmark_id", *made])
                    first += len(rows)

    return files.mapInArrow(run, f"path string, benchmark_id string, {schema}")


def _as_cells(path: str, benchmark: str, names: list[str], rows: list[list[str | None]], first: int) -> dict[str, pa.Array]:
    cells = pa.array([list(zip(names, r, strict=True)) for r in rows], pa.map_(pa.string(), pa.string()))
    return {"row_no": pa.array(range(first, first + len(rows)), pa.int32()), "cells": cells}


def read_board_files(spark: SparkSession, root: str, name: str = "data.csv") -> DataFrame:
    """(benchmark_id, row_no, cells) of every file of that name below `root`, each in its own encoding; cells: a map of text by column."""
    return map_board_files(spark, root, name, "row_no int, cells map<string,string>", _as_cells).drop("path")


def read_csv(spark: SparkSession, path: str, schema: str, encoding: str = "utf-8") -> DataFrame:
    """Typed columns; NaN and blanks are null."""
    frame = spark.read.schema(schema).option("header", "true").option("nullValue", "NaN").option("encoding", encoding).option("escape", '"').csv(path)
    return frame.select(*[F.when(~F.isnan(f.name), F.col(f"`{f.name}`")).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in frame.schema.fields])


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError("columns are missing: " + ", ".join(missing))
    return df


def read_cleaned(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """(model_name, score, rank) of a cleaned board, or of all boards below a folder with the keys that name their folders; scores must be numbers and ranks whole."""
    found = spark.read.option("header", "true").option("escape", '"').csv(path)
    rows = require_columns(found, [*keys, "model_name", "score", "rank"])
    return rows.select(*keys, "model_name", F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank"))


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """(pos, key, value) of a JSON object's entries in document order; value is a variant."""
    whole = spark.read.text(path, wholetext=True)
    entries = F.map_entries(F.from_json("value", "map<string,variant>"))
    return whole.select(F.posexplode(entries).alias("pos", "e")).select("pos", "e.key", "e.value")


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(model_name, model_id) of a JSON object of texts, in document order."""
    return read_json_map(spark, path).select("pos", F.col("key").alias("model_name"), F.expr("cast(value as string)").alias("model_id"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The benchmark entries of a metadata array: those with an id and without an Elo column."""
    rows = spark.read.schema(METADATA).option("multiLine", "true").json(path)
    return rows.where(F.col("benchmark_id").isNotNull() & F.col("elo_column").isNull()).drop("elo_column")


def missing_names(wanted: DataFrame, present: DataFrame, on: str) -> DataFrame:
    """What `wanted` has and `present` lacks, for error messages."""
    return wanted.select(on).distinct().join(present.select(on), on, "left_anti")
