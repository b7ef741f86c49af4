"""The corpus pipeline: quality, near-duplicates, decontamination, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it
returns is written as Parquet and read again as the next one's docs.  All but
the last return the columns of `documents`.

1. quality: documents that the co-trained classifier rejects go.
2. near_duplicates: of each group of SimHash links one document stays, that
   with the least id.
3. decontaminate: documents that align with a benchmark item go.
4. secrets: the blobs enter a ledger in the shared folder; its findings are
   replaced by [redacted:kind] and n_chars counted anew.
5. bpe: doc_id, ids and the digests of ids and of the decoded text.

Cases: nulls, empty and very long texts, ties, repeated rows, empty tables and
extra columns are treated as each stage's operator says; a null text passes
secrets as null and is encoded as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, decontaminate, quality, secrets, simhash
from tallyloom.llm.common import new_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _, ledger = secrets.scan(docs, new_folder(spark, "secret-ledger"))
    clean = secrets.redact(docs, ledger)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_documents(docs, bpe.default_vocabulary())
    return bpe.digests(encoded, also=["ids"])


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secret_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, writing and rereading what each returns."""
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs


ORACLE_SQL = None
