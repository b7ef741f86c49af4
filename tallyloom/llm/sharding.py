"""Weighted rendezvous hashing of stable record keys; DataFrame functions only.

Each (key, shard) pair gets a pseudo-random number u in (0, 1) from its MD5
digest, and the shard with the greatest -weight / ln(u) takes the row.  The
decision for a row uses nothing but its key and the shard list, so adding a
shard moves only the rows that the new shard wins, and changing one weight
moves rows only to or from that shard.

Cases: a null key counts as the text "null key" (its rows share a shard), a
null text has no bytes and the CRC of an empty text, repeated keys share a
shard and get different slots, an empty table gives an empty result, extra
columns are ignored or kept; a column of the caller's that has the name of a
result is kept as that name followed by "_in".
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import table

#: Digits of the digest that make the number: 52 bits fit a double exactly.
HEX_DIGITS = 13
NULL_KEY = "null key"


def _score(key: Column, shard: int, weight: float) -> Column:
    digest = F.md5(F.concat(key, F.lit(f"/{shard}")).cast("binary"))
    number = F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("double")
    return F.lit(float(weight)) / -F.ln((number + 0.5) / F.lit(float(16**HEX_DIGITS)))


def _winner(key: Column, shards: Sequence[int], weights: Sequence[float]) -> Column:
    """(score, shard) of the winning shard; equal scores go to the smaller number."""
    bids = [F.struct(_score(key, s, w).alias("score"), F.lit(-s).alias("minus")) for s, w in zip(shards, weights, strict=True)]
    return F.greatest(*bids) if len(bids) > 1 else bids[0]


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard", grown: str | None = None, grown_weight: float = 1.0) -> DataFrame:
    """Add column `out`, the shard 0..len(weights)-1 of each row, and `grown`, its shard once a further one exists."""
    if not weights or any(not w > 0 for w in [*weights, grown_weight]):
        raise ValueError("every shard needs a weight above zero")
    for name in {out, grown} & {*df.columns}:
        df, key = df.withColumnRenamed(name, f"{name}_in"), f"{name}_in" if key == name else key
    text = F.coalesce(F.col(key).cast("string"), F.lit(NULL_KEY))
    best = df.withColumn("__bid", _winner(text, range(len(weights)), weights))
    best = best.withColumn(out, (-F.col("__bid.minus")).cast("int"))
    if grown:
        more = _score(text, len(weights), grown_weight)
        best = best.withColumn(grown, F.when(more > F.col("__bid.score"), F.lit(len(weights))).otherwise(F.col(out)).cast("int"))
    return best.drop("__bid")


def number_slots(df: DataFrame, shard: str, order: Sequence[str], out: str = "slot") -> DataFrame:
    """Add column `out`: the rows of each shard numbered from 0 without gaps; `order` has to tell unequal rows apart.

    Equal rows are counted before the shuffle and told apart after it, so a
    row that repeats a million times is one row on the way.  A shard is dealt
    over 256 parts by two digest digits of the columns in `order`, and each
    part is sorted by itself; the counts of the parts (256 rows a shard, fit
    for a broadcast) give each part its offset, so no task sorts a shard.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    text = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit(NULL_KEY)) for c in order], F.lit("slot"))
    part = F.substring(F.md5(text.cast("binary")), 1, 2)
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")).withColumn("__part", part)
    counts = counted.groupBy(F.col(shard).alias("__shard"), F.col("__part").alias("__p")).agg(F.sum("__n").alias("__size"))
    before = Window.partitionBy("__shard").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__shard", "__p", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy(shard, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = counted.withColumn("__first", F.coalesce(F.sum("__n").over(within), F.lit(0)))
    joined = numbered.join(F.broadcast(offsets), (F.col(shard) == F.col("__shard")) & (F.col("__part") == F.col("__p")))
    start = (F.col("__offset") + F.col("__first")).cast("long")
    return joined.select(*columns, F.explode(F.sequence(start, start + F.col("__n") - 1)).alias(out))


def write_shards(df: DataFrame, key: str, weights: Sequence[float], path: str) -> None:
    """Write all columns of the rows as Parquet with a folder for each shard."""
    assign_shards(df, key, weights).write.partitionBy("shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    dealt = assign_shards(rows, "doc_id", [1.0] * 40, grown="grown_shard")
    numbered = number_slots(dealt, "shard", ["doc_id", "text_crc32", "size"])  # these columns decide the others
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


ORACLES = {
    "op1_sharding": """
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::UBIGINT, range(8)::UBIGINT[]),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384::UBIGINT, c // 2) ELSE c // 2 END)) AS t
), docs AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, 'null key') AS k FROM documents
), texts AS (
  SELECT DISTINCT text, hex(encode(text)) AS h FROM docs
), sums AS (
  SELECT text, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT,
      list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::UBIGINT)),
    lambda c, b: xor(c // 256, t[(xor(c, b) % 256 + 1)::BIGINT])))::BIGINT AS text_crc32
  FROM texts, crc
), bids AS (
  SELECT k, s, 1.0::DOUBLE / -ln((('0x' || substr(md5(k || '/' || s), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) AS score
  FROM (SELECT DISTINCT k FROM docs), range(41) r(s)
), won AS (
  SELECT k, arg_max(s, (score, -s)) FILTER (s < 40) AS shard, arg_max(s, (score, -s)) AS grown_shard FROM bids GROUP BY k
), dealt AS (
  SELECT d.doc_id, (octet_length(encode(d.text)) + 16)::BIGINT AS size, text_crc32, shard::INT AS shard, grown_shard::INT AS grown_shard
  FROM docs d JOIN sums USING (text) JOIN won USING (k)
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(coalesce(doc_id::VARCHAR, 'null key') || '/' || text_crc32 || '/' || size || '/slot'), 1, 2), doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  grown_shard FROM dealt""",
}
QUERIES = {"op1_sharding": op1_sharding}
