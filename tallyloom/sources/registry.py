"""Sources by name: each takes a session and a folder and returns long raw scores."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.cleaning import benchmark_id_from_path
from tallyloom.operators.ranking import positions
from tallyloom.sources import embedded_json, html, pages, tables

Reader = Callable[[SparkSession, str], DataFrame]
READERS: dict[str, Reader] = {}

# The folder of raw data that each way of getting boards fills.
PATHS = {"lmarena": "raw/lmarena", "artificial_analysis": "raw/artificial_analysis", "vals_ai": "raw/vals_ai", "frontiermath": "raw/frontiermath", "pandas_read_html": "raw/pandas_read_html", "selenium": "raw/selenium"}

#: Columns that a browsed page's table should have, by folder; the default is overlaid.
BROWSED = {"default": ("Model",), "arc_agi_2": ("Team", "Score"), "swe_bench_verified": ("Model", "Resolved"), "swe_bench_bash_only": ("Model", "Resolved")}


def register_source(name: str, reader: Reader) -> None:
    READERS[name] = reader


def read_source(name: str, spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a registered source; an unknown name is an error."""
    if name not in READERS:
        raise KeyError(f"no source named {name}; there are {', '.join(sorted(READERS))}")
    return READERS[name](spark, folder)


def _saved(spark: SparkSession, folder: str) -> DataFrame:
    """(benchmark_id, content) of the saved pages below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{*.html,*.txt}").load(folder)
    return files.select(benchmark_id_from_path(F.col("path")).alias("benchmark_id"), F.col("content").cast("string").alias("content"))


def _tables(mode: str) -> Reader:
    return lambda spark, folder: html.html_rows(_saved(spark, folder), "benchmark_id", "content", mode)


def required_columns(benchmark: str) -> tuple[str, ...]:
    """The columns that a board's table should have; its folder may be spelled with blanks, signs and capitals."""
    return BROWSED.get(re.sub(r"[^a-z0-9]+", "_", benchmark.lower()).strip("_"), BROWSED["default"])


def browsed_tables(pages: DataFrame, key: str = "benchmark_id", content: str = "content") -> DataFrame:
    """Rows of each page's best table by the columns that its board requires, in one scan of the pages."""
    folder = F.trim(F.regexp_replace(F.lower(key), "[^a-z0-9]+", "_"), F.lit("_"))
    lists = {k: F.array(*map(F.lit, columns)) for k, columns in BROWSED.items()}
    own = F.create_map(*[x for k, columns in lists.items() for x in (F.lit(k), columns)])
    return html.html_rows(pages, key, content, "best", F.coalesce(F.try_element_at(own, folder), lists["default"]))


def read_urls(listed: DataFrame, best: bool = False, skip: bool = False) -> DataFrame:
    """Rows of the first table, or of the best one by what each board requires, at the addresses of (benchmark_id, url).

    The executors fetch; a page that can't be fetched is an error, or with
    `skip` gives no rows.
    """
    found = pages.fetch_pages(listed.select("benchmark_id", "url"))
    found = found.where(F.col("error").isNull()) if skip else pages.or_raise(found)
    return browsed_tables(found) if best else html.html_rows(found, "benchmark_id", "content")


def _listed_urls(spark: SparkSession, folder: str) -> DataFrame:
    """The first table at each address; the folder's urls.json maps benchmarks to addresses."""
    return read_urls(tables.read_mapping(spark, f"{folder}/urls.json").toDF("pos", "benchmark_id", "url"))


def _combined(spark: SparkSession, folder: str) -> DataFrame:
    """(benchmark_id, row_no, model_raw, score_raw) of the folder's data.csv, with a board for each column that isn't the model's."""
    frame = tables.read_text_csv(spark, f"{folder}/data.csv")
    model = next((c for c in ("Model", "model") if c in frame.columns), frame.columns[0])
    return split_boards(frame, {c: c for c in frame.columns if c not in (model, "row_no")}, model)


def read_url(spark: SparkSession, benchmark: str, url: str) -> DataFrame:
    """Rows of the first table at an address."""
    return read_urls(spark.createDataFrame([(benchmark, url)], "benchmark_id string, url string"))


def choose_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that there are, in the wanted order."""
    return df.select(*[F.col(f"`{c}`") for c in wanted if c in df.columns])


def combine_boards(long: DataFrame, model: str, board: str, score: str, boards: Sequence[str]) -> DataFrame:
    """(position, model, a column for each board): a row for each model, in order of its name, from 1."""
    wide = long.groupBy(model).agg(*[F.max(F.when(F.col(board) == b, F.col(score))).alias(b) for b in boards])
    return positions(wide, [], [model], "position", large=True).select("position", model, *[F.col(f"`{b}`") for b in boards])


def split_boards(combined: DataFrame, boards: dict[str, str], model: str = "Model") -> DataFrame:
    """(benchmark_id, row_no, model_raw, score_raw) of a table with a column for each board; a board whose column is absent has null scores."""
    score = lambda c: F.col(f"`{c}`").cast("string") if c in combined.columns else F.lit(None).cast("string")
    pairs = F.array(*[F.struct(F.lit(b).alias("benchmark_id"), score(c).alias("score_raw")) for b, c in boards.items()])
    rows = combined.select("row_no", F.col(f"`{model}`").alias("model_raw"), F.explode(pairs).alias("b"))
    return rows.select("b.benchmark_id", "row_no", "model_raw", "b.score_raw")


register_source("first_table", _tables("first"))
register_source("best_table", lambda spark, folder: browsed_tables(_saved(spark, folder)))
register_source("csv", tables.read_board_files)
register_source("combined", _combined)
register_source("url", _listed_urls)
register_source("css_rows", _tables("css"))
register_source("embedded_json", lambda spark, folder: embedded_json.metric_rows(_saved(spark, folder), "benchmark_id", "content"))
