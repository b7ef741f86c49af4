"""Tables in saved web pages.

Parsing is by the standard library, a page in a worker at a time; pages go in
as a column of text and come out as rows of a map from column to text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Tables(HTMLParser):
    """Rows of all tables, nested ones apart; each cell is (text, is header, columns, rows)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[tuple[str, bool, int, int]]]] = []
        self.open: list[list[list[tuple[str, bool, int, int]]]] = []
        self.cell: list[tuple[list[str], bool, int, int]] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self.tables.append([])
            self.open.append(self.tables[-1])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open:
            if not self.open[-1]:
                self.open[-1].append([])
            span = lambda k: int(a[k]) if (a.get(k) or "").isdigit() and int(a[k]) > 0 else 1
            self.cell.append(([], tag == "th", span("colspan"), span("rowspan")))
        elif tag in ("script", "style"):
            self.silent += 1

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.open.pop()
        elif tag in ("td", "th") and self.cell and self.open:
            parts, header, columns, rows = self.cell.pop()
            self.open[-1][-1].append((" ".join("".join(parts).split()), header, columns, rows))
        elif tag in ("script", "style") and self.silent:
            self.silent -= 1

    def handle_data(self, data):
        if self.cell and not self.silent:
            self.cell[-1][0].append(data)


def _grid(rows: list[list[tuple[str, bool, int, int]]]) -> list[list[tuple[str, bool]]]:
    """Cells repeated over the columns and rows that they span."""
    grid: list[list[tuple[str, bool]]] = []
    falling: dict[int, tuple[int, str, bool]] = {}
    for row in rows:
        line: list[tuple[str, bool]] = []
        cells = iter(row)
        while True:
            k = len(line)
            if k in falling:
                left, text, header = falling.pop(k)
                line.append((text, header))
                if left > 1:
                    falling[k] = (left - 1, text, header)
                continue
            cell = next(cells, None)
            if cell is None:
                if falling and max(falling) > k:
                    line.append(("", False))
                    continue
                break
            text, header, columns, height = cell
            for j in range(columns):
                line.append((text, header))
                if height > 1:
                    falling[k + j] = (height - 1, text, header)
        grid.append(line)
    return [line for line in grid if line]


def parse_tables(html: str) -> list[tuple[list[str], list[list[str]]]]:
    """(columns, rows) of each table; several header rows are joined by blanks, repeated names get ".1", ".2"."""
    parser = _Tables()
    parser.feed(html)
    parser.close()
    found = []
    for rows in parser.tables:
        grid = _grid(rows)
        if not grid:
            continue
        heads = 0
        while heads < len(grid) and all(h for _, h in grid[heads]):
            heads += 1
        heads = max(1, heads)
        width = max(map(len, grid))
        names = []
        for k in range(width):
            parts = [grid[r][k][0] if k < len(grid[r]) else "" for r in range(heads)]
            parts = [p for i, p in enumerate(parts) if p and "Unnamed" not in p and p not in parts[:i]]
            names.append(" ".join(parts).strip() or f"Unnamed: {k}")
        seen: dict[str, int] = {}
        for k, n in enumerate(names):
            seen[n] = seen.get(n, -1) + 1
            names[k] = f"{n}.{seen[n]}" if seen[n] else n
        found.append((names, [[t for t, _ in line] + [""] * (width - len(line)) for line in grid[heads:]]))
    return found


def best_table(tables: Sequence[tuple[list[str], list[list[str]]]], required: Sequence[str] = ("Model",)) -> tuple[list[str], list[list[str]]] | None:
    """The first table with all required columns (names that contain the text, in either case) in it, else that with the most, one with rows before one without."""
    best, most = None, -1.0
    for columns, rows in tables:
        lower = [c.lower() for c in columns]
        score = sum(any(r.lower() in c for c in lower) for r in required) + 0.5 * bool(rows) if required else len(rows)
        if required and score >= len(required):
            return columns, rows
        if score > most:
            best, most = (columns, rows), score
    return best


class _Cells(HTMLParser):
    """Rows marked by class: `.table-row` with `.cell` inside."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict[str, str]] = []
        self.path: list[tuple[str, str | None]] = []
        self.texts: dict[str, list[str]] = {}
        self.inside: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        field = None
        if "table-row" in classes:
            self._flush()
            self.rows.append({"model_key": a["data-model-key"]} if "data-model-key" in a else {})
            field = "row"
        elif "cell" in classes and self.rows:
            name = next((c.removesuffix("-cell") for c in classes if c.endswith("-cell") and c not in ("cell", "column-cell")), "unknown")
            field = "" if "chart-cell" in classes else name
        elif "score" in self.inside:
            field = "score_value" if "score-value" in classes else "score_error" if "score-error" in classes else None
        if tag not in _VOID:
            self.path.append((tag, field))
            if field:
                self.inside.append(field)
                if field != "row":
                    self.texts[field] = []

    def handle_endtag(self, tag):
        while self.path:
            opened, field = self.path.pop()
            if field:
                self.inside.remove(field)
                if field == "row":
                    self._flush()
            if opened == tag:
                break

    def handle_data(self, data):
        text = data.strip()
        if text and not any(f == "" for _, f in self.path):
            for field in self.inside:
                if field != "row":
                    self.texts[field].append(text)

    def _flush(self):
        if self.rows:
            self.rows[-1].update({f: ("" if f.startswith("score_") else " ").join(t) for f, t in self.texts.items()})
        self.texts = {}


def parse_css_rows(html: str) -> list[dict[str, str]]:
    parser = _Cells()
    parser.feed(html)
    parser.close()
    parser._flush()
    return [r for r in parser.rows if r]


def _rows_of(html: str | None, mode: str, required: Sequence[str]) -> list[dict[str, str]]:
    if not html:
        return []
    if mode == "css":
        return parse_css_rows(html)
    tables = parse_tables(html)
    chosen = best_table(tables, required) if mode == "best" else tables[0] if tables else None
    return [dict(zip(chosen[0], r, strict=True)) for r in chosen[1]] if chosen else []


def html_rows(pages: DataFrame, key: str, html: str, mode: str = "first", required: Sequence[str] | Column = ("Model",)) -> DataFrame:
    """(key, row_no, cells) of a table of each page.

    mode: "first" table, "best" by the required columns, the same for all pages
    or each page's own, or "css" rows.  Pages without a table give no row.
    """
    if mode not in ("first", "best", "css"):
        raise ValueError(f"unknown mode {mode}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (text, columns) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                rows = _rows_of(text, mode, columns or ())
                if rows:
                    keys = batch.column(0).take(pa.array([i] * len(rows)))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(range(len(rows)), pa.int32()), pa.array([list(r.items()) for r in rows], pa.map_(pa.string(), pa.string()))], [key, "row_no", "cells"])

    wanted = required if isinstance(required, Column) else F.array(*map(F.lit, required)).cast("array<string>")
    rows = pages.select(F.col(key).alias(key), F.col(html).cast("string").alias("__html"), wanted.alias("__required"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, row_no int, cells map<string,string>")


def wide(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One column of text for each name; absent ones are null."""
    return rows.select(*[c for c in rows.columns if c != "cells"], *[F.col("cells").getItem(c).alias(c) for c in columns])


def find_column(columns: Sequence[str], text: str) -> str | None:
    """The first column whose name contains the text, in either case."""
    return next((c for c in columns if re.search(re.escape(text), c, re.IGNORECASE)), None)
