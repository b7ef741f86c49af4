"""Writers: tables and documents, all by the executors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from tallyloom.operators.relational import left_wide


def write_cleaned(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Cleaned boards as Parquet or CSV, a folder for each benchmark, the best score first."""
    rows = df.repartition("benchmark_id").sortWithinPartitions("benchmark_id", F.desc("score"), "row_no").drop("row_no")
    rows.write.partitionBy("benchmark_id").mode("overwrite").format(form).options(**({"header": "true", "lineSep": "\n"} if form == "csv" else {})).save(path)


def write_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """One CSV with NaN for nulls and LF line ends; for results, not for corpora."""
    rows = df.orderBy(*order) if order else df
    rows.coalesce(1).write.mode("overwrite").option("header", "true").option("nullValue", "NaN").option("lineSep", "\n").csv(path)


def write_model_list(df: DataFrame, path: str) -> None:
    write_csv(df.select("model_name").distinct(), path, ["model_name"])


def write_wide(keys: DataFrame, long: DataFrame, key: str, category: str, values: Sequence[str], categories: Sequence[str], path: str) -> None:
    """A row for each of `keys`, whether `long` has it or not, and, for each category, a column of each value."""
    write_csv(left_wide(keys, long, key, category, values, categories), path, [key])


def write_files(rows: DataFrame, folder: str, text: str, path: str, encoding: Column | None = None) -> None:
    """A file for each row, in a folder `path`/folder=<its folder>, in the row's encoding (UTF-8 unless given), written by the executors."""
    named = rows.select(F.col(folder).alias("folder"), F.col(text).alias("value"), (F.lit("utf-8") if encoding is None else encoding).alias("encoding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [None if t is None else t.encode(e) for t, e in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["folder", "value"])

    # the text writer puts out the bytes of a text as they are
    encoded = named.mapInArrow(run, "folder string, value binary").select("folder", F.col("value").cast("string").alias("value"))
    encoded.write.partitionBy("folder").text(path)


def _finite(value: Column, kind: DataType) -> Column | None:
    """Whether all numbers in a value are finite; None if it can't hold any."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(True))
    if isinstance(kind, ArrayType) and _finite(value, kind.elementType) is not None:
        return F.coalesce(F.forall(value, lambda x: _finite(x, kind.elementType)), F.lit(True))
    if isinstance(kind, MapType) and _finite(value, kind.valueType) is not None:
        return F.coalesce(F.forall(F.map_values(value), lambda x: _finite(x, kind.valueType)), F.lit(True))
    if isinstance(kind, StructType):
        parts = [p for f in kind.fields if (p := _finite(value.getField(f.name), f.dataType)) is not None]
        return reduce(lambda a, b: a & b, parts) if parts else None
    return None


def json_lines(df: DataFrame, key: str) -> DataFrame:
    """(value) lines that make one JSON object with an entry for each row, in order of key, nulls left out; numbers must be finite."""
    fields = [c for c in df.columns if c != key]
    entry = F.struct(*[F.col(f"`{c}`").alias(c) for c in fields])
    good = _finite(entry, df.select(entry.alias("e")).schema["e"].dataType)
    text = F.to_json(entry) if fields else F.lit("{}")
    if good is not None:
        text = F.when(good, text).otherwise(F.raise_error(F.concat(F.lit("a result isn't finite: "), F.col(key).cast("string"))).cast("string"))
    name = F.regexp_extract(F.to_json(F.array(F.col(key).cast("string"))), r"(?s)^\[(.*)\]$", 1)
    sorted_ = df.select(F.lit(1).alias("part"), F.col(key).cast("string").alias("name"), F.concat(F.lit("  "), name, F.lit(": "), text).alias("value"))
    ends = df.sparkSession.createDataFrame([(0, None, "{"), (2, None, "}")], "part int, name string, value string")
    one = ends.union(sorted_).coalesce(1).sortWithinPartitions("part", "name")
    # of the one sorted partition the rows are numbered from 0, the brace; a comma stands before every entry but the first
    return one.withColumn("at", F.monotonically_increasing_id()).select(F.concat(F.when((F.col("part") == 1) & (F.col("at") > 1), ",").otherwise(""), "value").alias("value"))


def write_json_document(df: DataFrame, key: str, path: str) -> None:
    """A JSON object with an entry for each row, nulls left out; numbers must be finite.

    One task sorts and writes the lines, as a document is one file; they pass
    through neither the driver nor a single row.
    """
    spark = df.sparkSession
    part = f"{path}.parts"
    json_lines(df, key).write.mode("overwrite").text(part)
    jvm = spark.sparkContext._jvm
    folder, place = jvm.org.apache.hadoop.fs.Path(part), jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    written = [f.getPath() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-")]
    files.delete(place, False)
    files.rename(written[0], place)
    files.delete(folder, True)


def latex_table(df: DataFrame, columns: dict[str, str], caption: str, label: str, order: Sequence[str] = (), rows: int = 1000) -> DataFrame:
    """(text) a LaTeX table of formatted text columns in the given order; columns: name to heading; more than `rows` rows raise."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("--")) for c in columns]
    line = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.concat_ws(" & ", *cells).alias("line"))
    head = " & ".join(columns.values()) + r" \\"
    top = [r"\begin{table}", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{'l' * len(columns)}}}", r"\toprule", head, r"\midrule"]
    found = df.limit(rows + 1).groupBy().agg(F.array_sort(F.collect_list(line)).alias("x"))
    lines = F.concat(F.array(*map(F.lit, top)), F.transform("x", lambda x: F.concat(x["line"], F.lit(r" \\"))), F.array(F.lit(r"\bottomrule"), F.lit(r"\end{tabular}"), F.lit(r"\end{table}")))
    return found.select(F.when(F.size("x") > rows, F.raise_error(F.lit("too many rows for one LaTeX table")).cast("string")).otherwise(F.array_join(lines, "\n")).alias("text"))
