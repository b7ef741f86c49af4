"""Stock phrases, repeated rows, many findings and short items at sizes where a group could fill one task."""

import io
import random
import time
from contextlib import redirect_stdout

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, secrets, simhash, substring

STOCK = "the quick brown fox jumps over dogs"


def _texts(n: int, seed: int = 5) -> list[str]:
    """Texts of random words around one stock phrase of seven words; every fortieth repeats the one before it."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        side = [" ".join(f"w{r.randrange(10**6)}" for _ in range(9)) for _ in range(2)]
        out.append(out[-1] if i % 40 == 39 else f"{side[0]} {STOCK} {side[1]}")
    return out


def _brute(rows: list[tuple[int, str]]) -> dict[tuple[int, str], tuple[int, str]]:
    least: dict[tuple, int] = {}
    split = {(i, t): t.split() for i, t in rows}
    for (i, _), ws in split.items():
        for k in range(len(ws) - 12):
            w = tuple(ws[k : k + 13])
            least[w] = min(i, least.get(w, i))
    out = {}
    for (i, t), ws in split.items():
        gone = set()
        for k in range(len(ws) - 12):
            if least[tuple(ws[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        out[i, t] = len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)
    return out


def test_a_stock_run_in_all_texts_leaves_no_shard_above_twice_the_mean():
    texts, shards, parts = _texts(12_000), 16, 24
    buckets = [substring.Bucket(list(range(b, len(texts), parts)), texts[b::parts], shards) for b in range(parts)]
    sent: dict[int, list] = {}
    for b, held in enumerate(buckets):
        for shard, *rest in held.anchors_by_shard():
            sent.setdefault(shard, []).append((b, *rest))
    live: list[dict] = [{} for _ in buckets]
    hot: list[dict] = [{} for _ in buckets]
    for shard, rows in sent.items():
        for (b, *_), a, h in zip(rows, *substring.judged_anchors(*([r[k] for r in rows] for k in (1, 2, 3))), strict=True):
            live[b][shard], hot[b][shard] = a, h
    assert any(h.any() for one in hot for h in one.values())
    words = np.zeros(shards)
    for held, a, h in zip(buckets, live, hot, strict=True):
        held.choose(a, h)
        for shard, _, _, lengths, _ in held.segments_by_shard():
            words[shard] += np.frombuffer(lengths, np.uint8).sum()
    assert words.max() < 2 * words.mean()


def test_a_stock_run_changes_no_result(spark):
    rows = list(enumerate(_texts(12_000, 6)))
    got = {(r.doc_id, r.n_removed, r.kept) for r in substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, n, kept) for (i, _), (n, kept) in _brute(rows).items()}


def test_equal_rows_are_worked_on_once(spark, monkeypatch):
    monkeypatch.setattr(substring, "COPIES", 30_000)
    text = " ".join(f"w{k}" for k in range(400))
    others = [(3, "a " + text), (9, text), (9, text), (9, "b " + text), (None, text), (None, text)]
    df = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text")).unionByName(spark.createDataFrame(others, "doc_id long, text string"))
    got = {(r.doc_id, r.n_words, r.n_removed): r["count"] for r in substring.deduplicate(df).groupBy("doc_id", "n_words", "n_removed").count().collect()}
    assert got == {(7, 400, 400): 100_000, (3, 401, 0): 1, (9, 400, 400): 2, (9, 401, 400): 1, (None, 400, 0): 2}


def test_redaction_takes_linear_time(spark, tmp_path):
    unit = "0123456789abcdef01234567 "
    df = spark.createDataFrame([(1, unit * 80_000), (2, "password=abcdef0123456789abcdef01234567 x"), (3, "plain"), (4, None)], "doc_id long, text string")
    _, ledger = secrets.scan(df, str(tmp_path / "ledger"))
    started = time.time()
    got = {r.doc_id: r.text for r in secrets.redact(df, ledger).collect()}
    assert time.time() - started < 10
    assert got == {1: "[redacted:hex] " * 80_000, 2: "[redacted:assign] x", 3: "plain", 4: None}


def test_a_scan_reads_its_own_rule_version(spark, tmp_path):
    path = str(tmp_path / "ledger")
    df = spark.createDataFrame([(i, f"token=abc{i:06d}" if i % 2 else f"text {i}") for i in range(40)], "doc_id long, text string")
    rows, _ = secrets.scan(df, path)
    ledger = secrets.update_ledger(rows, path, rule_version=secrets.RULE_VERSION + 1)
    assert ledger.count() == 80 and ledger.where("found = 1").count() == 40
    text = io.StringIO()
    with redirect_stdout(text):
        secrets.findings_by_path(rows, ledger).explain("formatted")
    filters = next(x for x in text.getvalue().splitlines() if "PartitionFilters" in x)
    assert "rule_version" in filters and "found" in filters


def test_the_rows_of_one_id_are_cut_where_they_are(spark):
    text = "some words that stand in very many rows of one id"
    df = spark.range(100_000).select(F.lit(4).cast("long").alias("doc_id"), F.lit(text).alias("text"), (F.col("id") % 1000 + 5).alias("n_chars"), F.create_map(F.lit("k"), F.lit(1)).alias("extra"))
    kept = simhash.keep_one(df).collect()
    assert [(r.doc_id, r.text, r.n_chars, r.extra) for r in kept] == [(4, text, 5, {"k": 1})]


def test_items_without_a_seed_need_a_line_of_their_own(spark):
    items = spark.createDataFrame([(1, "Paris"), (2, "Blue whale!"), (3, "paris"), (4, ""), (5, None), (6, "...")], "item_id long, text string")
    texts = ["He went to Paris and saw a blue whale", "question\n  PARIS.\nmore", "blue whale\nParis", "Paris Paris", "", None, "a line\nblue-whale\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.score, r.first_word, r.end_word) for r in decontaminate.contaminations(docs, items, lines=True).collect())
    assert got == [(1, 1, 1.0, 1, 2), (1, 3, 1.0, 1, 2), (2, 1, 1.0, 2, 3), (2, 2, 1.0, 0, 2), (2, 3, 1.0, 2, 3), (6, 2, 1.0, 2, 4)]
    assert sorted(r.doc_id for r in decontaminate.decontaminated(docs, items).collect()) == [0, 3, 4, 5]
