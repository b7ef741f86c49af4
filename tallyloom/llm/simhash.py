"""Near-duplicates by 64-bit SimHash, with candidates from the pigeonring principle.

Two fingerprints with at most 2 differing bits, cut into a ring of three
segments, have a segment from which every chain of consecutive segments stays
within its share of the budget: no difference in the first segment, at most
one in the first two, at most two in all three.  The first two segments of
such a chain are a key of about 43 bits; a fingerprint is filed under its own
key and looked up under the keys that its second segment has with one bit
flipped.  As a flip changes the parity of a segment, only fingerprints whose
second segment is odd look up flipped keys.  The full Hamming check follows on
the candidates.

Equal fingerprints are one node before any link is sought, so groups of
copies, however large, are no pairs; links between different fingerprints are
contracted to components by stars.

Cases: a null or empty text has fingerprint zero and is linked like any other;
texts of one or two words are one shingle; repeated rows share a component; a
null doc_id takes part with its text and bridges others, but names no
component (null if a component has no other); a doc_id with several texts is
in the component of each; an empty table gives an empty result; very long texts
are hashed whole, SHINGLES at a time; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import checkpointed, map_text, spread, table
from tallyloom.llm.graph import HOT, MOST_HOT, components

#: Words of a shingle, seed of its hash and bits in which linked fingerprints differ at most.
WORDS, SEED, RADIUS = 3, 42, 2
#: Bits of the ring's segments, from the high end.
SEGMENTS = (22, 21, 21)
#: Shingles of a text that are hashed at once.
SHINGLES = 1 << 18
#: Keys up to which `keep_one` broadcasts those that go, 8 bytes each in a set of some tens of MB.
FEW = 500_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    flat, digest = b" ".join(words), xxhash.xxh64_intdigest
    width = min(WORDS, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for i in range(0, len(starts), SHINGLES):
        hashes = np.array([digest(flat[a:b], SEED) for a, b in zip(starts[i : i + SHINGLES], ends[i : i + SHINGLES], strict=True)], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, bits) of each row; bits is the fingerprint as a signed long."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], [key, "bits"])

    rows = df.select(F.col(key).cast("long").alias(key), F.col(text).alias("__text"))
    return map_text(rows, "__text", f"{key} long, bits long", work)


def _segment(bits: Column, i: int) -> Column:
    low = sum(SEGMENTS[i + 1 :])
    return F.shiftrightunsigned(bits, low).bitwiseAND(F.lit((1 << SEGMENTS[i]) - 1))


def _chains(bits: Column) -> list[tuple[Column, Column, int]]:
    """First and second segment, and the bits of the second, of the chain from each start."""
    return [(_segment(bits, i), _segment(bits, (i + 1) % 3), SEGMENTS[(i + 1) % 3]) for i in range(3)]


def _keys(bits: Column, flips: bool) -> Column:
    """(start, key) structs: the own chains, or those of the odd second segments with one bit flipped."""
    own, flipped = [], []
    for start, (first, second, width) in enumerate(_chains(bits)):
        entry = lambda other, start=start, first=first: F.struct(F.lit(start).alias("start"), F.shiftleft(first, 22).bitwiseOR(other).alias("key"))
        own.append(entry(second))
        odd = F.array(*[entry(second.bitwiseXOR(F.lit(1 << j))) for j in range(width)])
        flipped.append(F.when(F.bit_count(second) % 2 == 1, odd).otherwise(F.slice(odd, 1, 0)))
    return F.concat(*flipped) if flips else F.array(*own)


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes (bits, node) whose fingerprints differ in 1 or 2 bits; bits are distinct."""
    filed = nodes.select("bits", "node", F.explode(_keys(F.col("bits"), False)).alias("k")).select(F.col("bits").alias("bits_a"), F.col("node").alias("a"), "k.start", "k.key")
    own = filed.select(F.col("bits_a").alias("bits_b"), F.col("a").alias("b"), "start", "key", F.lit(False).alias("flipped"))
    looked = nodes.select("bits", "node", F.explode(_keys(F.col("bits"), True)).alias("k")).select(F.col("bits").alias("bits_b"), F.col("node").alias("b"), "k.start", "k.key", F.lit(True).alias("flipped"))
    once = F.col("flipped") | (F.col("bits_a") < F.col("bits_b"))
    near = F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= RADIUS
    return filed.join(own.unionByName(looked), ["start", "key"]).where(once & near).select("a", "b")


def _grouped(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bits, component_id, first_bits) of each row; first_bits is the fingerprint of the component's document to keep."""
    prints = checkpointed(fingerprints(df, key, text))
    nodes = checkpointed(prints.groupBy("bits").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("copies")))
    # a fingerprint is its own node, so those of null keys alone link and bridge like others; each gives some 35 keys, so
    # the few and small partitions that adaptive execution made are dealt anew first
    dealt = nodes.select("bits", F.col("bits").alias("node")).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bits")
    found = components(links(dealt)).withColumnRenamed("node", "bits")
    first = F.min(F.when(F.col("least").isNotNull(), F.struct("least", "bits"))).alias("first")
    firsts = found.join(nodes, "bits").groupBy("component").agg(first)
    named = nodes.join(found.join(firsts, "component"), "bits", "left")
    named = named.select("bits", F.coalesce("first.least", "least").alias("component_id"), F.coalesce("first.bits", "bits").alias("first_bits"), "copies")
    # a fingerprint of very many copies, of which there are MOST_HOT at most, is sent to its rows
    many = F.col("copies") > max(HOT, (nodes.agg(F.sum("copies")).first()[0] or 0) // MOST_HOT)
    hot = F.broadcast(named.where(many))
    cold = prints.join(F.broadcast(nodes.where(many).select("bits")), "bits", "left_anti").join(named.where(~many), "bits")
    columns = (key, "bits", "component_id", "first_bits")
    return cold.select(*columns).unionByName(prints.join(hot, "bits").select(*columns))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, bits, component_id) of each row; component_id is the least key that links reach."""
    return _grouped(df, key, text).select(key, "bits", "component_id")


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `df` with one document of each group, that with the least key; rows with a null key stay.

    A key that repeats with different texts may be kept once in each of several
    groups; of rows with the same key and fingerprint the one with the least
    text stays, of equal texts that with the least other columns.

    Rows of keys that occur once need no more than to know whether they go.
    While the keys that go or repeat are FEW at most they are broadcast, and
    only rows of repeated keys are shuffled; beyond that the rows are shuffled
    to them once.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    grouped = checkpointed(_grouped(df, key, text).where(F.col(key).isNotNull()))
    wanted = grouped.where((F.col(key) == F.col("component_id")) & (F.col("bits") == F.col("first_bits"))).select(F.col(key).alias("__kept"), F.col("bits").alias("__bits")).distinct()
    every = grouped.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__rows"), F.bool_or((F.col(key) == F.col("component_id")) & (F.col("bits") == F.col("first_bits"))).alias("__some"))
    moved = checkpointed(every.where(~F.col("__some") | (F.col("__rows") > 1)))
    lost, repeats = moved.select("__key"), moved.where("__some").select("__key")
    if moved.limit(FEW + 1).count() <= FEW:
        lost, repeats = F.broadcast(lost), F.broadcast(repeats)
    here = F.col(key) == F.col("__key")
    again = df.join(repeats, here, "left_semi").withColumn("__print", F.arrow_udf(_fingerprints, "long")(F.col(text)))
    again = again.join(wanted, (F.col(key) == F.col("__kept")) & (F.col("__print") == F.col("__bits")), "left_semi")
    # the rows of one key and fingerprint are cut to the least where they are, before any is moved
    ordered = [F.col(text), *(F.col(f"`{f.name}`") for f in df.schema if not re.search(r"map<|variant", f.dataType.simpleString()))]
    once = again.groupBy(F.col(key).alias("__key"), "__print").agg(F.min_by(F.struct(*columns), F.struct(*ordered)).alias("__row"))
    return df.join(lost, here, "left_anti").join(repeats, here, "left_anti").select(*columns).unionByName(once.select(*(F.col(f"__row.`{c}`") for c in df.columns)))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spread(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


# The primes of XXH64.
_PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _xxh64_sql() -> str:
    """CTEs from shingles(s) to hashed(s, h): XXH64 with 128-bit arithmetic, lists of 8-byte lanes, and one step a SELECT."""
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in _PRIMES)
    wide = "18446744073709551616::UHUGEINT"
    mul = lambda a, b: f"(({a}) * {b} % {wide})"
    rotated = lambda x, r: f"(({x}) * {1 << r}::UHUGEINT % {wide} + ({x}) // {1 << 64 - r}::UHUGEINT)"
    reduced = lambda first, values, step: f"list_reduce(list_prepend({first}, {values}), lambda v, k: {step})"
    lane = "('0x' || " + " || ".join(f"x[2 * i + {2 * b + 1}:2 * i + {2 * b + 2}]" for b in reversed(range(8))) + ")::UBIGINT::UHUGEINT"
    seeds = [f"{(SEED + d) % (1 << 64)}::UHUGEINT" for d in (_PRIMES[0] + _PRIMES[1], _PRIMES[1], 0, -_PRIMES[0])]
    turn = mul(rotated(f"(v + k) % {wide}", 31), p1)
    stripes = ", ".join(reduced(seed, f"list_transform(range({8 * q}, n // 32 * 32, 32), lambda i: {mul(lane, p2)})", turn) + f" AS v{q}" for q, seed in enumerate(seeds))
    merged = reduced(
        f"({rotated('v0', 1)} + {rotated('v1', 7)} + {rotated('v2', 12)} + {rotated('v3', 18)}) % {wide}",
        "list_transform(list_transform([v0, v1, v2, v3], lambda v: " + mul("v", p2) + "), lambda v: " + mul(rotated("v", 31), p1) + ")",
        f"({mul('xor(v, k)', p1)} + {p4}) % {wide}",
    )
    four = "('0x' || " + " || ".join(f"x[2 * o + {2 * b + 1}:2 * o + {2 * b + 2}]" for b in reversed(range(4))) + ")::UBIGINT::UHUGEINT"
    eights = f"list_transform(list_transform(range(n // 32 * 32, n // 8 * 8, 8), lambda i: {mul(lane, p2)}), lambda v: {mul(rotated('v', 31), p1)})"
    return f"""bytes AS (
  SELECT s, hex(encode(s)) AS x, octet_length(encode(s))::BIGINT AS n FROM shingles
), stripes AS (
  SELECT *, {stripes} FROM bytes
), started AS (
  SELECT s, x, n, ((CASE WHEN n >= 32 THEN {merged} ELSE {(SEED + _PRIMES[4]) % (1 << 64)}::UHUGEINT END) + n::UHUGEINT) % {wide} AS h FROM stripes
), eights AS (
  SELECT s, x, n, n // 8 * 8 AS o, {reduced("h", eights, f"({mul(rotated('xor(v, k)', 27), p1)} + {p4}) % {wide}")} AS h FROM started
), fours AS (
  SELECT s, x, n, n // 4 * 4 AS o, CASE WHEN n % 8 >= 4 THEN xor(h, {mul(four, p1)}) END AS f, h FROM eights
), ones AS (
  SELECT s, {reduced(f"CASE WHEN f IS NULL THEN h ELSE ({mul(rotated('f', 23), p2)} + {p3}) % {wide} END", f"list_transform(range(o, n), lambda i: {mul("('0x' || x[2 * i + 1:2 * i + 2])::UBIGINT::UHUGEINT", p5)})", mul(rotated("xor(v, k)", 11), p1))} AS h FROM fours
), mixed AS (
  SELECT s, {mul("xor(h, h // 8589934592::UHUGEINT)", p2)} AS h FROM ones
), again AS (
  SELECT s, {mul("xor(h, h // 536870912::UHUGEINT)", p3)} AS h FROM mixed
), hashed AS (
  SELECT s, xor(h, h // 4294967296::UHUGEINT)::UBIGINT AS h FROM again
)"""


ORACLES = {
    "op9_simhash": rf"""
WITH RECURSIVE texts AS (
  SELECT DISTINCT text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), held AS (
  SELECT text, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM texts
), shingles AS (
  SELECT DISTINCT s FROM held
), {_xxh64_sql()}, prints AS (
  SELECT text, ({" + ".join(f"(2 * sum((h >> {b}) & 1) > count(*))::UHUGEINT * {1 << b}::UHUGEINT" for b in range(64))})::UBIGINT AS bits FROM held JOIN hashed USING (s) GROUP BY text
), docs AS (
  SELECT doc_id, coalesce(bits, 0::UBIGINT) AS bits FROM documents d LEFT JOIN prints p ON d.text IS NOT DISTINCT FROM p.text
), nodes AS (
  SELECT bits, min(doc_id) AS least FROM docs GROUP BY bits
), links AS (
  SELECT a.bits AS a, b.bits AS b FROM nodes a JOIN nodes b ON a.bits <> b.bits AND bit_count(xor(a.bits, b.bits)::BIT) <= 2
), reached(a, b) AS (
  SELECT bits, bits FROM nodes UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), named AS (
  SELECT a, min(least) AS component_id FROM reached JOIN nodes ON b = bits GROUP BY a
)
SELECT doc_id, lower(lpad(hex(bits), 16, '0')) AS fingerprint, component_id FROM docs JOIN named ON bits = a""",
}
QUERIES = {"op9_simhash": op9_simhash}
