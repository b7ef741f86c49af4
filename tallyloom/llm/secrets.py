"""Incremental secret scans over a content-addressed ledger of blobs.

Every version of every document is a blob, named by the SHA-256 of its text.
The ledger, a Parquet table, holds the (blob, rule version) pairs that have
been scanned and their findings.  A run scans only the pairs that the ledger
lacks, once each however many paths hold the blob, appends them, and joins the
findings of all blobs back to all their paths.

1. `screened` reads the texts once: the blob of each row and a necessary
   condition of all rules.  Only the texts that meet it, the suspects, are
   kept; what they are narrows a table of 100 TB to a few per cent of it.
2. `update_ledger` matches the suspects whose blob is unseen and appends them,
   and all other unseen blobs without findings.
3. `findings_by_path` joins the findings of one rule version to the suspects.

A pair that was appended twice, by a run that was tried again, counts once.
The ledger is parted by rule version, and within one by whether a blob has
findings: a run reads the names of its own version's blobs to tell which are
unseen, and the spans of those with findings alone.

Rules: the kinds `assign`, `access` and `hex` of the contract, found leftmost
and without overlap kind by kind, and two kinds that this operator adds, `pem`
(headers of private keys) and `jwt` (three base64url parts, the first at the
start of its run of base64url characters, so that a scan takes linear time).

Cases: a null text counts as empty and has no findings, repeated rows each get
the findings of their shared blob, an empty table gives an empty result, very
long texts are scanned whole, extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import checkpointed, map_text, new_folder, spread, table

#: Raised with every change of RULES, so that old ledger entries no longer count.
RULE_VERSION = 2

# Kind, pattern, the group whose length counts, its least length.
RULES = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), 0, 1),
    ("jwt", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), 0, 1),
)
BASE = ("assign", "access", "hex")
#: What every finding contains, for Java's engine.
SCREEN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|-----BEGIN |\.eyJ[A-Za-z0-9_-]"
SPANS = "array<struct<kind:string,start:int,end:int>>"
FINDINGS = f"blob binary, spans {SPANS}"
LEDGER = f"blob binary, spans {SPANS}, rule_version int, found int"
#: Blobs with findings up to which `redact` broadcasts them, some 100 bytes each.
FEW = 200_000


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each finding in code points, by start and then by kind as listed in RULES."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(RULES):
        for m in (re.finditer(r"[0-9a-f]{24,}", text) if kind == "hex" else pattern.finditer(text)):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """(blob, spans) of (blob, text) rows; a null text has none."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[{"kind": k, "start": a, "end": e} for k, a, e in find_secrets(t)] if t else [] for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["blob", "spans"])

    return map_text(blobs.select("blob", "text"), "text", FINDINGS, work)


def screened(versions: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, blob, suspect, text) of every row in a table of its own; text is null unless the row is a suspect."""
    suspect = F.coalesce(F.col(text).rlike(SCREEN), F.lit(False))
    rows = versions.select(F.col(key).alias(key), F.col(text).alias("__text"), blob_of(F.col(text)).alias("blob"), suspect.alias("suspect"))
    return checkpointed(rows.select(key, "blob", "suspect", F.when(F.col("suspect"), F.col("__text")).alias("text")))


def _empty() -> Column:
    return F.from_json(F.lit("[]"), SPANS)


def scan_unseen(rows: DataFrame, ledger: DataFrame | None = None, rule_version: int = RULE_VERSION) -> DataFrame:
    """Ledger rows of the blobs in screened `rows` whose pair with the rule version the ledger lacks."""
    blobs = rows.groupBy("blob").agg(F.first("text", ignorenulls=True).alias("text"))
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    return scan_blobs(blobs).select("blob", "spans", F.lit(rule_version).alias("rule_version"), (F.size("spans") > 0).cast("int").alias("found"))


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the ledger at `path` as they were appended; none if there is none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at `path`, each pair once; an empty one if there is none.

    Its files are parted by rule version and by whether the blob has findings;
    a filter on either reaches them through the grouping.
    """
    return entries(spark, path).groupBy("blob", "rule_version", "found").agg(F.first("spans").alias("spans"))


def _findings(ledger: DataFrame, rule_version: int) -> DataFrame:
    return ledger.where((F.col("rule_version") == rule_version) & (F.col("found") == 1)).select("blob", "spans")


def update_ledger(rows: DataFrame, path: str, rule_version: int = RULE_VERSION) -> DataFrame:
    """Append what the ledger at `path` lacks of the screened `rows` and return the whole ledger."""
    spark = rows.sparkSession
    scan_unseen(rows, entries(spark, path), rule_version).write.mode("append").partitionBy("rule_version", "found").parquet(path)
    return read_ledger(spark, path)


def findings_by_path(rows: DataFrame, ledger: DataFrame, key: str = "doc_id", rule_version: int = RULE_VERSION) -> DataFrame:
    """key, blob and spans (empty where none) of every one of the screened `rows`.

    Copies of one blob may hold a third of the rows: only suspects are joined,
    and adaptive execution splits the partitions of a hot blob.
    """
    suspects = rows.where("suspect").join(_findings(ledger, rule_version), "blob", "left")
    return suspects.select(key, "blob", F.coalesce("spans", _empty()).alias("spans")).unionByName(rows.where(~F.col("suspect")).select(key, "blob", _empty().alias("spans")))


def scan(versions: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The screened rows and the ledger after they were entered."""
    rows = screened(versions, key, text)
    return rows, update_ledger(rows, path)


def redacted(text: str, spans: list[dict]) -> str:
    """The text with each span, in order of their starts, replaced by [redacted:kind]; spans that overlap become one, of the first's kind."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[redacted:{s['kind']}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def _redacted(texts: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array([None if t is None else redacted(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())


def redact(versions: DataFrame, ledger: DataFrame, text: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """The rows with each finding's span replaced by [redacted:kind]; overlapping spans become one.

    While the blobs with findings are few they are broadcast and no text is
    moved; beyond FEW the texts that pass the screen are shuffled to them.
    Only texts with findings reach Python, which cuts each in one walk.
    """
    columns = versions.columns
    found = _findings(ledger, rule_version).select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))
    few = found.limit(FEW + 1).count() <= FEW
    cut = F.arrow_udf(_redacted, "string")(F.when(F.col("__spans").isNotNull(), F.col(text)), F.col("__spans"))
    clean = F.coalesce(cut, F.col(text))
    kept = [F.col(f"`{c}`") for c in columns]
    if few:
        return versions.withColumn("__blob", blob_of(F.col(text))).join(F.broadcast(found), "__blob", "left").withColumn(text, clean).select(*kept)
    marked = versions.withColumn("__suspect", F.coalesce(F.col(text).rlike(SCREEN), F.lit(False)))
    suspects = marked.where("__suspect").withColumn("__blob", blob_of(F.col(text))).join(found, "__blob", "left")
    return suspects.withColumn(text, clean).select(*kept).unionByName(marked.where(~F.col("__suspect")).select(*kept))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda span: span["kind"] == kind


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents come in two deliveries, by a hash of their id: the second scans only what the ledger of the first lacks."""
    rows, path = screened(spread(table(spark, sf_dir, "documents"))), new_folder(spark, "secret-ledger")
    delivery = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)), F.lit(0))
    update_ledger(rows.where(delivery == 0), path)
    found = findings_by_path(rows, update_ledger(rows.where(delivery == 1), path))
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_ASSIGN_SQL = "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + """)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""

# A match's text can't stand before the place where it was found, or it would have been found there.
ORACLES = {
    "op7_secrets": rf"""
WITH RECURSIVE rules(k, kind, pat, grp, least) AS (
  VALUES (0, 'assign', '{_ASSIGN_SQL.replace("'", "''").replace(chr(92) * 2, chr(92))}', 2, 6), (1, 'access', 'AKIA[A-Z0-9]+', 0, 20), (2, 'hex', '[0-9a-f]{{24,}}', 0, 24),
    (3, 'pem', '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0, 1), (4, 'jwt', '(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+)', 1, 1)
), texts AS (
  SELECT DISTINCT coalesce(text, '') AS text FROM documents
), found AS (
  SELECT text, 0 AS k, regexp_extract_all(text, (SELECT pat FROM rules WHERE k = 0)) AS ms, regexp_extract_all(text, (SELECT pat FROM rules WHERE k = 0), 2) AS gs FROM texts
  UNION ALL SELECT text, 1, regexp_extract_all(text, 'AKIA[A-Z0-9]+') AS ms, ms FROM texts
  UNION ALL SELECT text, 2, regexp_extract_all(text, '[0-9a-f]{{24,}}') AS ms, ms FROM texts
  UNION ALL SELECT text, 3, regexp_extract_all(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') AS ms, ms FROM texts
  UNION ALL SELECT text, 4, regexp_extract_all(text, (SELECT pat FROM rules WHERE k = 4)) AS ms, regexp_extract_all(text, (SELECT pat FROM rules WHERE k = 4), 1) AS gs FROM texts
), placed AS (
  SELECT text, k, ms, gs, 0 AS i, 0 AS a, 0 AS e FROM found WHERE len(ms) > 0
  UNION ALL
  SELECT text, k, ms, gs, i + 1, e + strpos(substr(text, e + 1), ms[i + 1]) - 1, e + strpos(substr(text, e + 1), ms[i + 1]) - 1 + length(ms[i + 1]) FROM placed WHERE i < len(ms)
), spans AS (
  SELECT text, k, kind, b AS a, kind || ':' || b || ':' || e AS span
  FROM (SELECT *, CASE WHEN k = 4 THEN e - length(gs[i]) ELSE a END AS b FROM placed WHERE i > 0) JOIN rules USING (k) WHERE length(gs[i]) >= least
), joined AS (
  SELECT text, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(span, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY a, k) AS spans FROM spans GROUP BY text
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN joined j ON coalesce(d.text, '') = j.text""",
}
QUERIES = {"op7_secrets": op7_secrets}
