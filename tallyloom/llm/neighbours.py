"""Nearest neighbours by randomly rotated one-bit codes with error bounds.

Each vector is scaled to length 1 and turned by a random rotation, the same
for all; its code is the sign of each coordinate, packed to bits, and its
correction scalar the inner product of the vector with its own code.  The
inner product of a query with a code, divided by that scalar, estimates the
cosine without bias, and its error is within BOUND standard deviations of
sqrt(1 - c^2) / c / sqrt(d - 1) but for a small chance.  The exact cosines of
the LEAD best estimates give a query its mark, the k-th best of them; it then
reranks, by the cosine of the original vectors, all candidates whose upper
bound reaches the mark.

The table is dealt into blocks of about BLOCK_ROWS rows and the queries into
blocks of about BLOCK_QUERIES; each pair of blocks is one group, so a task
holds one of each whatever the size of the table.  A block gives the best row
of k ids a query, of which the k best of all blocks are kept.

Cases: vectors that are null, zero or hold null or non-finite components take
no part; vectors of different lengths are no neighbours; equal scores go to
the smaller id; rows that repeat an id count once with their best score and
are not their own neighbours; a query with fewer than k candidates gets them
all; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import table

BLOCK_ROWS, BLOCK_QUERIES = 8192, 32768
#: Standard deviations of the error bound.
BOUND = 3.0
#: Best estimates whose exact cosines set the mark, and what rounding may change in an inner product.
LEAD, SLACK = 32, 1e-6
SEED = 20
#: Pairs whose estimates are held at once: 128 queries with a block keep a table's rows within two lines of cache.
PAIRS = 1 << 20


#: The signs that each byte of a code stands for.
_PATTERNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1


@functools.lru_cache(maxsize=8)
def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


class Codes:
    """Packed sign bits and correction scalars of vectors."""

    def __init__(self, vectors: np.ndarray):
        d = self.d = vectors.shape[1]
        turned = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ rotation(d)
        self.bits = np.packbits(turned > 0, axis=1)
        self.scalar = np.maximum(np.abs(turned).sum(1) / math.sqrt(d), 1e-9)
        self.error = BOUND * np.sqrt(np.maximum(0, 1 - self.scalar**2)) / self.scalar / math.sqrt(max(1, d - 1))

    def estimate(self, queries: np.ndarray) -> np.ndarray:
        """Estimated cosines, a row for each query.

        A query's inner product with each of the 256 patterns of a byte of code
        is worked out once; a code's is then the sum over its packed bytes of
        what the tables hold.
        """
        turned = (queries / np.linalg.norm(queries, axis=1, keepdims=True)) @ rotation(self.d)
        padded = np.zeros((len(queries), 8 * self.bits.shape[1]), np.float32)
        padded[:, : self.d] = turned
        out = np.zeros((len(self.bits), len(queries)), np.float32)
        for k in range(self.bits.shape[1]):
            table = _PATTERNS @ padded[:, 8 * k : 8 * k + 8].T
            out += table[self.bits[:, k]]
        out /= (self.scalar * math.sqrt(self.d)).astype(np.float32)[:, None]
        return out.T


def _squares(vectors: np.ndarray) -> np.ndarray:
    out = np.zeros(len(vectors))
    for x in vectors.T:
        out += x * x
    return out


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, summed coordinate by coordinate, so equal pairs give equal results."""
    dot = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        dot += x * y
    return np.clip(dot / np.sqrt(_squares(a) * _squares(b)), -1.0, 1.0)


def _about(a: np.ndarray, b: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Inner products of pairs of unit vectors, right to SLACK."""
    out = np.empty(len(row))
    for i in range(0, len(row), 1 << 15):
        part = slice(i, i + (1 << 15))
        out[part] = np.einsum("ij,ij->i", a[row[part]], b[col[part]])
    return out


def nearest(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, cosine) of the k nearest ids of each query, each with its best vector, ties to the smaller id."""
    codes, found = Codes(vectors), []
    error = codes.error.astype(np.float32)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    step, n = max(1, PAIRS // max(1, len(ids))), len(ids)
    repeated = len(np.unique(ids)) < n
    for i in range(0, len(queries), step):
        mine = queries[i : i + step]
        unit_mine = mine / np.linalg.norm(mine, axis=1, keepdims=True)
        about = codes.estimate(mine)
        own = ids[None, :] == query_ids[i : i + step, None]
        about[own] = -np.inf
        chosen = np.ones(about.shape, bool)
        if n > LEAD:  # the exact cosines of the best estimates set the mark that upper bounds have to reach
            lead = np.argpartition(about, n - LEAD, axis=1)[:, n - LEAD :]
            row = np.repeat(np.arange(len(mine)), LEAD)
            exact = np.where(np.take_along_axis(own, lead, 1), -np.inf, _about(unit_mine, unit, row, lead.ravel()).reshape(lead.shape))
            if repeated:  # the mark counts each id once; too few ids in the lead set no mark
                exact = _once(ids[lead], exact)
            mark = np.partition(exact, LEAD - k, axis=1)[:, LEAD - k] - SLACK
            chosen = about + error >= mark[:, None].astype(np.float32)
            np.put_along_axis(chosen, lead, True, 1)
        row, col = np.nonzero(chosen & ~own)
        exact = _about(unit_mine, unit, row, col)
        # of the chosen, those that rounding can't keep out of the k best get the cosine of the original vectors
        best = _first_of_each(row, ids[col], exact) if repeated else np.lexsort((-exact, row))
        first = np.searchsorted(row[best], np.arange(len(mine)))
        count = np.searchsorted(row[best], np.arange(len(mine)), side="right") - first
        least = np.full(len(mine), -np.inf)
        some = count > 0
        least[some] = exact[best[first[some] + np.minimum(count[some], k) - 1]] - SLACK
        near = exact >= least[row]
        row, col = row[near], col[near]
        exact = cosines(mine[row], vectors[col])
        order = _first_of_each(row, ids[col], exact) if repeated else np.lexsort((ids[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        top = np.arange(len(row)) - np.searchsorted(row, row) < k
        found.append((query_ids[i + row[top]], ids[col[top]], exact[top]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _once(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The scores of each row with all but the best of an id put to -inf."""
    order = np.lexsort((-scores, ids), axis=1)
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = np.diff(np.take_along_axis(ids, order, 1), axis=1) == 0
    out = np.take_along_axis(scores, order, 1)
    out[again] = -np.inf
    return out


def _first_of_each(row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Places of the best score of each row and id, by row, score and id."""
    order = np.lexsort((-scores, ids, row))
    r, i = row[order], ids[order]
    new = np.ones(len(order), bool)
    new[1:] = (r[1:] != r[:-1]) | (i[1:] != i[:-1])
    order = order[new]
    return order[np.lexsort((ids[order], -scores[order], row[order]))]


def _read(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors, by length."""
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    ids = t.column("id").to_numpy()
    lists = t.column("v").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.float64()))
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        out[d] = ids[at], flat[offsets[at][:, None] + np.arange(d)].astype(np.float64)
    return out


def search(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id, rank, id, score) of the k nearest rows of each row where `is_query` holds."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    some = F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & finite & some)
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()
    data_blocks, query_blocks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n_queries // BLOCK_QUERIES))
    place = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    spread = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    data = rows.select("id", "v", place(data_blocks).alias("b")).select("id", "v", "b", spread(query_blocks).alias("c"))
    asked = rows.where("q").select("id", "v", place(query_blocks).alias("c")).select("id", "v", spread(data_blocks).alias("b"), "c")

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [[], [], []]
        if left.num_rows and right.num_rows:
            there, queries = _read(left), _read(right)
            for d in queries.keys() & there.keys():
                for p, x in zip(parts, nearest(*there[d], *queries[d], k), strict=True):
                    p.append(x)
        arrays = [np.concatenate(p) if p else np.zeros(0) for p in parts]
        return pa.table([pa.array(arrays[0].astype(np.int64)), pa.array(arrays[1].astype(np.int64)), pa.array(arrays[2].astype(np.float64))], ["query_id", "id", "score"])

    found = data.groupBy("b", "c").cogroup(asked.groupBy("b", "c")).applyInArrow(pair, "query_id long, id long, score double")
    once = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return search(embeddings, F.col("vec_id") % 50 == 0).withColumnRenamed("id", "vec_id")


ORACLES = {
    "op10_neighbours": """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(list_cosine_similarity(q.e, c.e)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0 GROUP BY ALL
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5""",
}
QUERIES = {"op10_neighbours": op10_neighbours}
