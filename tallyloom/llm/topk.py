"""Exact top-k inner products by columnar branch and bound.

The components of a block of rows are held dimension by dimension.  A query's
scores are accumulated a few dimensions at a time, those with the largest mass
first.  After each step the mass that a query and a row have left bounds what
the row can still gain (Cauchy and Schwarz); rows that can't reach the query's
k-th best score any more are dropped and the others moved together, so later
steps touch few rows.  The bound is exact, so is the result.  The best partial
sums of the first rows are finished at once to have a k-th best early.

Rows are dealt into stripes and queries into blocks; a task takes in one block
of queries and streams a stripe of rows past it, with the k best so far of each
query as its state.  Of each stripe the k best a query are shuffled.

Components are floor(scale * x), scores whole numbers.  Cases: vectors that
are null or hold null or non-finite components, and rows without an id, take no
part; a shorter vector counts as filled up with zeros; equal scores go to the
smaller id; of rows that repeat an id the one with the least vector counts; a
query with fewer than k candidates gets them all; empty tables give an empty
result; extra columns are ignored; scores beyond a long become its end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.blocks import block, every_block, exact, matrix, meet, numbers, products, usable, widened
from tallyloom.llm.common import table

#: Rows a stripe and queries a block; a table too small to give every core a stripe has smaller ones, of LEAST_STRIPE at least.
STRIPE, LEAST_STRIPE, ASKED = 1 << 20, 2048, 1 << 13
#: Dimensions a step, queries whose scores are accumulated side by side, and the share of rows from which each query goes on with its own.
STEP, SIDE_BY_SIDE, FEW = 8, 16, 0.25
#: What rounding may take from a bound, relative to the mass.
SLACK = 1e-9


class BranchAndBound:
    """The k best of each of a block of queries over the rows scanned so far."""

    def __init__(self, k: int, scale: float):
        self.k, self.scale = k, scale
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def ask(self, rows: pa.Table) -> None:
        self.parts.append((rows.column("id").to_numpy(), matrix(rows.column("v"), self.scale)))

    def _begin(self) -> None:
        width = max((v.shape[1] for _, v in self.parts), default=0)
        self.queries = np.concatenate([i for i, _ in self.parts]) if self.parts else np.zeros(0, np.int64)
        self.vectors = np.concatenate([widened(v, width) for _, v in self.parts]) if self.parts else np.zeros((0, 0))
        n = len(self.queries)
        self.ids, self.scores, self.count = np.zeros((n, self.k), np.int64), np.zeros((n, self.k), np.int64), np.zeros(n, int)
        self.parts = []

    def mark(self, i: int) -> float:
        """The score that a row has to reach."""
        return float(self.scores[i, -1]) if self.count[i] == self.k else -np.inf

    def keep(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        n = self.count[i]
        ids, scores = np.append(self.ids[i, :n], ids), np.append(self.scores[i, :n], scores)
        best = np.lexsort((ids, ~scores))[: self.k]
        self.count[i] = len(best)
        self.ids[i, : len(best)], self.scores[i, : len(best)] = ids[best], scores[best]

    def scan(self, rows: pa.Table) -> None:
        if self.parts or not hasattr(self, "queries"):
            self._begin()
        if not len(self.queries):
            return
        ids, v = rows.column("id").to_numpy(), matrix(rows.column("v"), self.scale)
        width = max(v.shape[1], self.vectors.shape[1])
        v, queries = widened(v, width), widened(self.vectors, width)
        if not exact(queries, v):
            for i, q in enumerate(queries):
                other = ids != self.queries[i]
                self.keep(i, ids[other], products(q[None, :], v[other])[0])
            return
        order = np.argsort(-(v * v).sum(0), kind="stable")
        steps = [slice(a, a + STEP) for a in range(0, width, STEP)]
        vertical, queries = np.ascontiguousarray(v[:, order].T), np.ascontiguousarray(queries[:, order])
        left = [np.sqrt((vertical[s.stop :] ** 2).sum(0)) * (1 + SLACK) for s in steps]
        for a in range(0, len(queries), SIDE_BY_SIDE):
            self._scan_some(a, queries[a : a + SIDE_BY_SIDE], ids, vertical, steps, left)

    def _scan_some(self, first: int, queries: np.ndarray, ids: np.ndarray, vertical: np.ndarray, steps: list[slice], left: list[np.ndarray]) -> None:
        sums = np.zeros((len(queries), len(ids)))
        sums[self.queries[first : first + len(queries), None] == ids[None, :]] = -np.inf
        rest = [np.sqrt((queries[:, s.stop :] ** 2).sum(1)) * (1 + SLACK) for s in steps]
        alive, done = sums > -np.inf, 0
        while done < len(steps) and alive.mean() > FEW:
            sums += queries[:, steps[done]] @ vertical[steps[done]]
            if not done:
                self._lead(first, queries, ids, vertical, sums)
            marks = np.array([self.mark(first + i) for i in range(len(queries))])
            alive &= sums + rest[done][:, None] * left[done][None, :] >= marks[:, None]
            done += 1
        for i, q in enumerate(queries):
            at = np.flatnonzero(alive[i])
            got = sums[i, at]
            for s in range(done, len(steps)):
                got = got + q[steps[s]] @ vertical[steps[s]][:, at]
                near = got + rest[s][i] * left[s][at] >= self.mark(first + i)
                at, got = at[near], got[near]
            at, got = self._new(first + i, ids, at, got)
            if len(at):
                self.keep(first + i, ids[at], got.astype(np.int64))

    def _new(self, i: int, ids: np.ndarray, at: np.ndarray, got: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without what is among the best already."""
        new = ~np.isin(ids[at], self.ids[i, : self.count[i]])
        return at[new], got[new]

    def _lead(self, first: int, queries: np.ndarray, ids: np.ndarray, vertical: np.ndarray, sums: np.ndarray) -> None:
        """Finish the best partial sums of queries that haven't k rows yet."""
        n = min(4 * self.k, sums.shape[1])
        for i, q in enumerate(queries):
            if self.count[first + i] < self.k:
                at = np.argpartition(sums[i], sums.shape[1] - n)[-n:]
                at = at[sums[i, at] > -np.inf]
                self.keep(first + i, ids[at], (q @ vertical[:, at]).astype(np.int64))

    def found(self) -> pa.RecordBatch:
        if self.parts or not hasattr(self, "queries"):
            self._begin()
        some = np.arange(self.k) < self.count[:, None]
        arrays = [np.repeat(self.queries, self.count), self.ids[some], self.scores[some]]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in arrays], ["query_id", "id", "score"])


def top_k(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, scale: float = 1.0) -> DataFrame:
    """(query_id, rank, id, score) of the k rows of largest inner product with each row where `is_query` holds, itself left out."""
    kind = df.schema[vector].dataType.simpleString()
    rows = df.select(F.col(key).cast("long").alias("id"), numbers(F.col(vector), kind).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"), scale))
    n, distinct, n_queries = rows.agg(F.count(F.lit(1)), F.countDistinct("id"), F.count_if("q")).first()
    if distinct < n:
        rows = rows.groupBy("id").agg(F.min("v").alias("v"), F.bool_or("q").alias("q"))
    cores = df.sparkSession.sparkContext.defaultParallelism
    stripes = max(1, -(-distinct // STRIPE), min(cores, -(-distinct // LEAST_STRIPE)))
    blocks = max(1, -(-n_queries // ASKED))
    asked = rows.where("q").select("id", "v", block("id", blocks).alias("b")).select("id", "v", every_block(stripes).alias("s"), "b")
    dealt = rows.select("id", "v", block("id", stripes).alias("s")).select("id", "v", "s", every_block(blocks).alias("b"))
    found = meet(asked, dealt, ["s", "b"], lambda: BranchAndBound(k, scale), "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return top_k(embeddings, F.col("vec_id") % 100 == 0, scale=1024.0).withColumnRenamed("id", "vec_id")


ORACLES = {
    "op13_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 10""",
}
QUERIES = {"op13_topk": op13_topk}
