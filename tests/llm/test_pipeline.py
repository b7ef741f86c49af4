"""The pipeline's stages, each by itself and one after another."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import bpe, secrets, simhash
from tallyloom.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, small, tmp_path_factory):
    """What goes into each stage and what comes out of the last."""
    folder, docs = tmp_path_factory.mktemp("stages"), table(spark, small, "documents")
    found = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, found[-1], small).write.parquet(f"{folder}/{k}")
        found.append(spark.read.parquet(f"{folder}/{k}"))
    return found


def test_the_stages_come_in_order(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "secrets", "bpe"]
    assert all(s.columns == COLUMNS for s in steps[:-1])


def test_each_stage_takes_effect_and_leaves_the_rest(spark, small, steps):
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in steps]
    assert ids[0] > ids[1] > ids[2] >= ids[3] == ids[4] == ids[5]
    bad = {r.doc_id for r in table(spark, small, "labels").where("quality = 0").collect()}
    good = {r.doc_id for r in table(spark, small, "labels").where("quality = 1").collect()}
    assert len(bad & ids[1]) <= 0.1 * len(bad) and len(good & ids[1]) >= 0.97 * len(good)
    groups = simhash.near_duplicates(steps[1]).toPandas()
    assert ids[2] == set(groups.component_id)
    items = [r.text for r in table(spark, small, "benchmark").collect()]
    left = [r.text for r in steps[3].collect()]
    assert not any(i in t for i in items for t in left)
    assert secrets.scan_unseen(secrets.screened(steps[4])).where(F.size("spans") > 0).count() == 0
    changed = steps[4].where(F.col("text").contains("[redacted:"))
    assert changed.where(F.length("text") != F.col("n_chars")).count() == 0


def test_the_last_stage_decodes_to_its_input(steps):
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        encoder = bpe.Encoder(f.read())
    for row in steps[5].collect():
        assert encoder.decode(row.ids) == texts[row.doc_id] and row.n_tokens == len(row.ids)


def test_run_equals_the_stages(spark, small, steps):
    got = {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, small).collect()}
    assert got == {(r.doc_id, r.ids_sha256) for r in steps[5].collect()}


def test_hard_rows_pass_the_stages(spark, small, tmp_path):
    rows = [(None, None, None, None, None), (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "word " * 50_000, "de", "b", 250_000), (4, "password=abcdefgh", "en", "a", 17), (4, "password=abcdefgh", "en", "a", 17)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, docs_in in (("rows", docs), ("none", docs.limit(0))):
        now = docs_in
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, now, small).write.parquet(f"{tmp_path}/{name}-{k}")
            now = spark.read.parquet(f"{tmp_path}/{name}-{k}")
        assert now.count() <= docs_in.count()
