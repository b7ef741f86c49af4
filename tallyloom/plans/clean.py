"""Raw boards to cleaned boards: columns chosen, scores parsed and scaled, names cleaned, duplicates numbered, ranks given."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import cleaning
from tallyloom.operators.ranking import competition_rank, number_duplicates
from tallyloom.operators.relational import small
from tallyloom.sources import tables
from tallyloom.sources.html import find_column

# Names of the model column in order of preference; (part of the path, part of the folder or "", columns) of the score column.
MODEL_COLUMNS = ("Model", "model", "Model Name", "model_name", "AI System", "name", "Agent")
SCORE_COLUMNS = (
    ("lmarena", "", ("Score", "score")),
    ("frontiermath", "", ("score_value", "score")),
    ("manual_direct", "facts", ("Numerical_Result",)),
    ("manual_direct", "writingbench", ("Overall",)),
    ("pandas_read_html", "aider polyglot", ("Percent correct",)),
    ("pandas_read_html", "terminal-bench v2.0", ("Accuracy",)),
    ("selenium", "arc-agi-2", ("ARC-AGI-2",)),
    ("selenium", "creative writing v3", ("Elo Score",)),
    ("selenium", "swe-bench bash only", ("% Resolved",)),
    ("vals_ai", "", ("accuracy",)),
)
BROWSED_SCORES = ("Score", "score")
SCORE_WORDS = ("score", "result", "accuracy", "correct")
AVERAGED = "FACTS"


@dataclass(frozen=True)
class BoardColumns:
    model: str
    score: str
    task: str | None = None


def model_column(columns: Sequence[str]) -> str | None:
    return next((c for c in MODEL_COLUMNS if c in columns), columns[0] if columns else None)


def score_column(columns: Sequence[str], path: str, first_row: dict[str, str | None] | None = None) -> str | None:
    """The score column by the board's source, its folder and, for percentages, its first row."""
    place = path.lower().replace("_", " ")
    source = lambda s: s.replace("_", " ") in place
    if source("artificial_analysis"):
        share = next((c for c in columns if "%" in str((first_row or {}).get(c) or "")), None)
        share = share or next((c for c in columns if any(w in c.lower() for w in SCORE_WORDS[:2])), None)
        if share:
            return share
    special = False
    for part, folder, names in SCORE_COLUMNS:
        if source(part) and folder in place:
            special |= part == "selenium"
            if found := next((c for c in names if c in columns), None):
                return found
    if source("selenium") and not special and (found := next((c for c in BROWSED_SCORES if c in columns), None)):
        return found
    return next((c for c in columns if any(w in c.lower() for w in SCORE_WORDS)), None)


def columns_of(names: Sequence[str], path: str, first_row: Sequence[str | None] | None = None) -> BoardColumns:
    """Model, score and task columns of a board read as text."""
    model, score = model_column(names), score_column(names, path, dict(zip(names, first_row or (), strict=False)))
    if not model or not score:
        raise ValueError(f"{path} has no model or no score column")
    return BoardColumns(model, score, find_column(names, "task_name"))


class _RawScores:
    """The raw scores of a board's rows; its columns are chosen by its first rows."""

    def __init__(self) -> None:
        self.path, self.at = "", BoardColumns("", "")

    def __call__(self, path: str, benchmark: str, names: list[str], rows: list[list[str | None]], first: int) -> dict[str, pa.Array]:
        if not first or path != self.path:
            self.path, self.at = path, columns_of(names, path, rows[0] if rows else None)
        place = {c: i for i, c in reversed(list(enumerate(names)))}
        text = lambda c: pa.array([r[place[c]] if c else None for r in rows], pa.string())
        return {"row_no": pa.array(range(first, first + len(rows)), pa.int64()), "model_raw": text(self.at.model), "score_raw": text(self.at.score), "task_name": text(self.at.task)}


def read_boards(spark: SparkSession, root: str, name: str = "data.csv", canonical: dict[str, str] | None = None) -> DataFrame:
    """(source, benchmark_id, row_no, model_raw, score_raw, task_name) of every board below a folder, in one scan; canonical: lower-case folder names to ids."""
    rows = tables.map_board_files(spark, root, name, "row_no long, model_raw string, score_raw string, task_name string", _RawScores())
    own = F.create_map(*[F.lit(x) for pair in (canonical or {"": ""}).items() for x in pair])
    benchmark = F.coalesce(F.try_element_at(own, F.lower("benchmark_id")), F.col("benchmark_id"))
    return rows.select(F.col("path").alias("source"), benchmark.alias("benchmark_id"), "row_no", "model_raw", "score_raw", "task_name")


def averaged_only(raw: DataFrame) -> DataFrame:
    """Of the board with a row for each task the average alone; other boards whole."""
    return raw.where((F.col("benchmark_id") != AVERAGED) | F.col("task_name").isNull() | (F.trim("task_name") == "Average"))


def clean(raw: DataFrame) -> DataFrame:
    """(benchmark_id, model_name, score, rank, row_no) of raw scores; rows without model or score go."""
    named = averaged_only(raw).select("benchmark_id", "row_no", cleaning.clean_model_name(F.col("model_raw"), F.col("source")).alias("model_name"), cleaning.scaled_score(F.col("benchmark_id"), cleaning.parse_score(F.col("score_raw"))).alias("score"))
    kept = named.where(F.col("score").isNotNull() & (F.coalesce("model_name", F.lit("")) != ""))
    numbered = number_duplicates(kept, ["benchmark_id"], "model_name", ["row_no"])
    return competition_rank(numbered, ["benchmark_id"], "score").select("benchmark_id", "model_name", "score", "rank", "row_no")


def review_duplicates(cleaned: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply a reviewer's (benchmark_id, model_name, action, new_name): "rename" or "drop", and rank anew."""
    joined = cleaned.join(small(decisions), ["benchmark_id", "model_name"], "left").where(F.coalesce("action", F.lit("")) != "drop")
    renamed = joined.withColumn("model_name", F.when(F.col("action") == "rename", F.col("new_name")).otherwise(F.col("model_name")))
    return competition_rank(renamed.drop("action", "new_name", "rank"), ["benchmark_id"], "score").select(*cleaned.columns)


def model_list(raw: DataFrame) -> DataFrame:
    """Sorted distinct models with any score text but blanks, "--" and "nan"."""
    some = ~F.lower(F.trim("score_raw")).isin("", "--", "nan")
    return raw.where(F.col("model_raw").isNotNull() & some).select(F.trim("model_raw").alias("model_name")).distinct().orderBy("model_name")
