"""Hard negatives by one-dimensional distance keys.

Each vector x gets one more component, sqrt(M - |x|^2) with M the largest
squared norm, so all have the same norm, and a query gets a zero there: a
larger inner product is then a smaller distance.  Pivots are fitted on a sample
of at most SAMPLE rows.  Every row is stored under its nearest pivot, sorted by
(pivot, distance to the pivot), in annuli of about ANNULUS rows.

By the triangle inequality a row within r of a query at distance D from a pivot
has a key between D - r and D + r.  A search scans the query's home annulus,
then those that interval scans of growing radius meet and that it hasn't
scanned, and stops as soon as the radius is certified: the rows not seen lie
beyond it and so score less than the k-th best found, or than the least score
that is asked for.  Rounds go over all queries at once, as a shuffle of queries
and of the annuli asked for; most queries end after two or three.

A query may ask for several windows of scores at once.  An anchor first asks
for its nearest rows of the same label, the positives, and then for the
nearest rows of other labels in a window below each positive's score.

Components are floor(scale * x), scores whole numbers, exact.  Cases: rows
whose id or label is null, or whose vector is null or holds null or non-finite
components, take no part; a shorter vector counts as filled up with zeros;
equal scores go to the smaller id; of rows that repeat an id the one with the
least label and vector counts; fewer rows than asked for are all returned; a
positive with a negative score has no negatives; an anchor alone in its label
gives no rows; empty tables give an empty result; extra columns are ignored;
scores beyond a long become its end, and a table whose squared norms overflow
is scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.blocks import LONG, block, every_block, matrix, meet, numbers, products, usable, widened
from tallyloom.llm.common import checkpointed, new_folder, table

#: Rows that pivots and the borders of annuli are fitted on, rows an annulus is meant to have, and annuli at most.
SAMPLE, ANNULUS, MOST_ANNULI = 8192, 2048, 4096
#: An annulus above so many rows is scanned in parts; queries that a task holds; scores held at once.
PART, ASKED, PAIRS = 1 << 18, 1 << 14, 1 << 20
#: Shares of the radius that the best rows so far call for, in the order of the rounds.
GROWTH = (0.5, 1.0)
#: What rounding may take from a distance, relative to the largest.
SLACK = 1e-9


class Keys:
    """Pivots and, for each, the borders of its annuli."""

    def __init__(self, sample: np.ndarray, most: float, rows: int):
        self.most = most
        annuli = min(MOST_ANNULI, max(1, -(-rows // ANNULUS)), max(1, len(sample)))
        if not np.isfinite(most) or most > 1e300:
            annuli, sample = 1, sample[:0]
        points = self.augmented(sample)
        pivots = max(1, round(annuli**0.5))
        rng, self.pivots = np.random.default_rng(12), points[:pivots] if len(points) >= pivots else np.zeros((1, sample.shape[1] + 1))
        if len(points) > pivots:
            self.pivots = points[np.sort(rng.choice(len(points), pivots, replace=False))]
            for _ in range(8):
                near = self.distances(points).argmin(1)
                self.pivots = np.array([points[near == p].mean(0) if (near == p).any() else self.pivots[p] for p in range(pivots)])
        self.annuli = max(1, annuli // len(self.pivots))
        self.borders = np.zeros((len(self.pivots), self.annuli - 1))
        if self.annuli > 1:
            far = self.distances(points)
            near = far.argmin(1)
            for p in range(len(self.pivots)):
                mine = far[near == p, p]
                self.borders[p] = np.quantile(mine if len(mine) else far[:, p], np.arange(1, self.annuli) / self.annuli)

    def augmented(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.sqrt(np.maximum(0, self.most - (v * v).sum(1)))])

    def distances(self, points: np.ndarray) -> np.ndarray:
        """From each point, a missing component being zero, to each pivot; the last column of a point is the added one."""
        width = max(points.shape[1], self.pivots.shape[1])
        out = np.zeros((len(points), len(self.pivots)))
        spread = lambda x: np.column_stack([widened(x[:, :-1], width - 1), x[:, -1]])
        a, b = spread(points), spread(self.pivots)
        for p, pivot in enumerate(b):
            out[:, p] = np.sqrt(((a - pivot) ** 2).sum(1))
        return out

    def place(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest pivot, the distance to it and the annulus, numbered through all pivots, of stored vectors."""
        far = self.distances(self.augmented(v))
        pivot = far.argmin(1)
        key = far[np.arange(len(v)), pivot]
        return pivot, key, pivot * self.annuli + (key[:, None] > self.borders[pivot]).sum(1)

    def met(self, v: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Whether a query's interval of a radius meets each annulus; a row for each query, none below a radius of 0."""
        far = self.distances(np.column_stack([v, np.zeros(len(v))]))
        edge = np.full((len(self.pivots), 1), np.inf)
        low, high = np.hstack([-edge, self.borders]), np.hstack([self.borders, edge])
        wide = (radius + SLACK * (np.sqrt(self.most) + radius))[:, None]
        out = np.zeros((len(v), len(self.pivots), self.annuli), bool)
        with np.errstate(invalid="ignore"):
            for p in range(len(self.pivots)):
                d = far[:, p, None]
                out[:, p] = (d + wide >= low[p]) & (d - wide <= high[p]) & (radius[:, None] >= 0)
        return out.reshape(len(v), -1)

    def home(self, v: np.ndarray) -> np.ndarray:
        """The annulus of the nearest pivot into which a query itself falls, as met() has it."""
        far = self.distances(np.column_stack([v, np.zeros(len(v))]))
        pivot = far.argmin(1)
        at = pivot * self.annuli + (far[np.arange(len(v)), pivot][:, None] > self.borders[pivot]).sum(1)
        return np.arange(len(self.pivots) * self.annuli)[None, :] == at[:, None]


class Index:
    """Rows stored by (pivot, distance), with what is needed to search them."""

    def __init__(self, rows: DataFrame, scale: float):
        spark = rows.sparkSession
        square = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x.cast("double") * scale).cast("double"), F.lit(2.0)))
        n, most = rows.agg(F.count(F.lit(1)), F.max(square)).first()
        sample = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
        self.scale, self.rows = scale, n
        keys = Keys(matrix(sample.column("v"), scale), float(most or 0), n)
        self.keys = spark.sparkContext.broadcast(keys)
        broadcast = self.keys

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                pivot, key, annulus = broadcast.value.place(matrix(pa.chunked_array([b.column("v")]), scale))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot.astype(np.int32)), pa.array(key), pa.array(annulus.astype(np.int32))], [*b.schema.names, "pivot", "key", "annulus"])

        kind = rows.schema["v"].dataType.simpleString()
        placed = rows.select("id", "label", "v").mapInArrow(place, f"id long, label long, v {kind}, pivot int, key double, annulus int")
        where = new_folder(spark, "distance-keys")
        placed.repartitionByRange("pivot", "key", "id").sortWithinPartitions("pivot", "key").write.parquet(where)
        self.stored = spark.read.parquet(where)
        sizes = {r.annulus: r["count"] for r in self.stored.groupBy("annulus").count().collect()}
        self.parts = spark.sparkContext.broadcast(np.array([-(-sizes.get(a, 0) // PART) for a in range(len(keys.pivots) * keys.annuli)]))

    def asks(self, queries: DataFrame, first: bool) -> DataFrame:
        """The queries once for each part of an annulus that they have to scan and haven't; `radius` and `before` bound the rounds."""
        keys, parts, scale = self.keys, self.parts, self.scale
        names = queries.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = matrix(pa.chunked_array([b.column("v")]), scale)
                want = keys.value.home(v)
                if not first:
                    radius = [b.column(c).to_numpy(zero_copy_only=False) for c in ("radius", "before")]
                    want = keys.value.met(v, radius[0]) & ~keys.value.met(v, radius[1]) & ~want
                query, annulus = np.nonzero(want)
                times = parts.value[annulus]
                at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                out = b.take(pa.array(np.repeat(query, times)))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.repeat(annulus, times).astype(np.int32)), pa.array(at.astype(np.int32))], [*names, "annulus", "part"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields)
        return queries.mapInArrow(run, f"{fields}, annulus int, part int")

    def scan(self, asks: DataFrame, blocks: int, k: int) -> DataFrame:
        """(query, window, id, score) of the k best rows that each part has for each window."""
        parts = self.parts.value.tolist()
        most = max([1, *parts])
        part = F.lit(0) if most == 1 else F.pmod(F.xxhash64("id"), F.element_at(F.array(*[F.lit(max(1, p)) for p in parts]), F.col("annulus") + 1)).cast("int")
        asked_for = F.broadcast(asks.select("annulus").distinct())  # at most MOST_ANNULI rows
        rows = self.stored.join(asked_for, "annulus", "left_semi").select("annulus", part.alias("part"), "id", "label", "v").withColumn("b", every_block(blocks))
        scale = self.scale
        return meet(asks.withColumn("b", block("query", blocks)), rows, ["annulus", "part", "b"], lambda: Scan(k, scale), "query long, window int, id long, score long")


class Scan:
    """The k best rows of each window of each query that asks, over the rows of a part."""

    def __init__(self, k: int, scale: float):
        self.k, self.scale = k, scale
        self.asked: list[pa.Table] = []
        self.out: list[np.ndarray] = []

    def ask(self, rows: pa.Table) -> None:
        self.asked.append(rows)

    def scan(self, rows: pa.Table) -> None:
        if not self.asked:
            return
        asked = pa.concat_tables(self.asked)
        ids, labels, v = rows.column("id").to_numpy(), rows.column("label").to_numpy(), matrix(rows.column("v"), self.scale)
        step = max(1, PAIRS // max(1, len(ids)))
        for a in range(0, asked.num_rows, step):
            mine = asked.slice(a, step)
            query, own, same = mine.column("query").to_numpy(), mine.column("label").to_numpy(), mine.column("same").to_numpy()
            q = matrix(mine.column("v"), self.scale)
            width = max(q.shape[1], v.shape[1])
            scores = products(widened(q, width), widened(v, width))
            fits = ((own[:, None] == labels[None, :]) == same[:, None]) & (query[:, None] != ids[None, :])
            windows = mine.column("windows").to_pylist()
            for w in range(max((len(x) for x in windows), default=0)):
                low, high = (np.array([x[w][c] if w < len(x) else d for x in windows], np.int64) for c, d in (("low", LONG), ("high", -LONG)))
                inside = fits & (scores >= low[:, None]) & (scores <= high[:, None])
                row, col = np.nonzero(inside)
                got = scores[row, col]
                order = np.lexsort((ids[col], ~got, row))
                order = order[np.arange(len(order)) - np.searchsorted(row, row) < self.k]  # row is sorted, and so is row[order]
                self.out.append(np.stack([query[row[order]], np.full(len(order), w), ids[col[order]], got[order]]))

    def found(self) -> pa.RecordBatch:
        x = np.concatenate(self.out, axis=1) if self.out else np.zeros((4, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1].astype(np.int32)), pa.array(x[2]), pa.array(x[3])], ["query", "window", "id", "score"])


def nearest(index: Index, queries: DataFrame, k: int, n_queries: int) -> DataFrame:
    """(query, window, rank, id, score) of the k rows of highest score in each window of each query.

    queries: query (an id, whose own row is left out), label, v, same (whether
    rows of the same label are asked for, or those of others) and windows, an
    array of (low, high) scores, of which low > high asks for none.
    """
    blocks = max(1, -(-n_queries // ASKED))
    best = Window.partitionBy("query", "window").orderBy(F.desc("score"), "id")
    top = lambda df: df.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    most = float(index.keys.value.most)
    found = checkpointed(top(index.scan(index.asks(queries, True), blocks, k)))
    if len(index.parts.value) == 1:
        return found
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x.cast("double") * index.scale).cast("double"), F.lit(2.0)))
    now = queries.select("*", F.lit(-1.0).alias("before"))
    for share in GROWTH:
        kth = found.where(F.col("rank") == k).groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))
        # a row at distance r scores (|q|^2 + M - r^2) / 2: the radius of a window is that of its k-th best, or of the least score that it takes
        window = lambda x, w: F.when(x.low > x.high, F.lit(None)).otherwise(F.greatest(x.low, F.coalesce(F.try_element_at("kth", w), F.lit(-LONG - 1))))
        least = F.array_min(F.transform("windows", window)).cast("double")
        reach = F.sqrt(F.greatest(F.lit(0.0), square + most - 2.0 * least))
        step = now.join(kth, "query", "left").select(*queries.columns, "before", F.coalesce(reach * share, F.lit(-1.0)).alias("radius"))
        step = step.where(F.col("radius") > F.col("before"))
        more = index.scan(index.asks(step, False), blocks, k)
        found = checkpointed(top(found.drop("rank").union(more)))
        now = step.select(*queries.columns, F.col("radius").alias("before"))
    return found


def mine(df: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: float = 1.0, positives: int = 5, negatives: int = 5, share: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each anchor and each of its nearest `positives` of the same label: the
    first `negatives` rows of other labels that score at least `share` per cent
    of the positive and no more than it.
    """
    kind = df.schema[vector].dataType.simpleString()
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), numbers(F.col(vector), kind).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"), scale))
    n, distinct, n_anchors = rows.agg(F.count(F.lit(1)), F.countDistinct("id"), F.count_if("anchor")).first()
    if distinct < n:
        rows = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x"), F.bool_or("anchor").alias("anchor")).select("id", "x.label", "x.v", "anchor")
    index = Index(rows, scale)
    anchors = rows.where("anchor").select(F.col("id").alias("query"), "label", "v")
    every = F.array(F.struct(F.lit(-LONG - 1).cast("long").alias("low"), F.lit(LONG).cast("long").alias("high")))
    near = nearest(index, anchors.select("*", F.lit(True).alias("same"), every.alias("windows")), positives, n_anchors)
    # low: the least whole score of at least `share` per cent; a negative positive score gives an empty window
    score = F.col("score")
    low = F.when(score < 0, F.lit(LONG)).otherwise(score - F.floor(score.cast("decimal(38,0)") * (100 - share) / 100).cast("long"))
    # windows stand in the order of rank, so a window's number is the rank less one
    windows = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", low.alias("low"), score.alias("high"), F.col("id").alias("positive_id")))).alias("found"))
    asked = anchors.join(windows, "query")
    cut = F.transform("found", lambda x: F.struct(x.low.alias("low"), x.high.alias("high")))
    against = nearest(index, asked.select("query", "label", "v", F.lit(False).alias("same"), cut.alias("windows")), negatives, n_anchors)
    positive = near.select("query", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return against.join(positive, ["query", "window"]).select(F.col("query").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    embeddings = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return mine(embeddings, F.col("vec_id") % 100 == 0, scale=256.0)


ORACLES = {
    "op12_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5""",
}
QUERIES = {"op12_negatives": op12_negatives}
