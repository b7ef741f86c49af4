"""Cross-tokenizer alignment against a plain walk over token pairs, and hard cases."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tallyloom.llm.alignment")

import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from tallyloom.llm import alignment  # noqa: E402
from tallyloom.llm.bpe import byte_letters  # noqa: E402


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte_of = {c: x for x, c in byte_letters().items()}

    def one(text):
        if not text:
            return [], []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        left = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in x]
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in y]
        raw = (" " + text).encode()
        return (left, right) if all(b"".join(t for _, t in side) == raw for side in (left, right)) else ([], [])

    return one


def places(side):
    at, out = 0, []
    for i, raw in side:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(rows, one):
    """The contract's columns, pair by pair and offset by offset."""
    found, held = [], Counter()
    for _, text in rows:
        a, b = (places(x) for x in one(text))
        links, groups, first_a, first_b = [], [], 0, 0
        for i, s, e in a:
            links += [(i, j) for j, t, f in b if s < f and t < e]
        for cut in sorted({e for _, _, e in a} & {f for _, _, f in b}):
            last_a, last_b = sum(e <= cut for _, _, e in a), sum(f <= cut for _, _, f in b)
            groups.append((a[first_a:last_a], b[first_b:last_b]))
            first_a, first_b = last_a, last_b
        held.update(set(links))
        found.append((len(a), len(b), groups, links))
    most = {}
    for (i, _), n in held.items():
        most[i] = max(n, most.get(i, 0))
    out = []
    for (key, _), (n_a, n_b, groups, links) in zip(rows, found, strict=True):
        text = ";".join(",".join(str(x[0]) for x in g) + "|" + ",".join(str(x[0]) for x in h) for g, h in groups)
        out.append((key, n_a, n_b, len(groups), len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if n_a else ""))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


HARD = ["plain words", "", None, "a", "  two  spaces\n\nand lines ", "<|endoftext|> is text", "▁ is not a space", "漢字 and 🙂🙂", "\x00\x01 bytes <0x41>", "1234567890" * 30, "naïve ﬁ ½ ﻿", "same text", "same text", "don't can't we'll", "   ", "é" * 40]


def test_hard_cases(spark, sides):
    rows = list(enumerate(HARD)) + [(None, "no id"), (3, "a repeated id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = alignment.digests(df, alignment.default_vocabulary(), alignment.default_pieces())
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert result(got) == brute(rows, sides)


def test_tables_and_a_small_head(spark, sides, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1500")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows, sides)
    assert len(rows) > 90
    assert result(alignment.digests(docs, alignment.default_vocabulary(), alignment.default_pieces())) == want
    whole = alignment.scored
    monkeypatch.setattr(alignment, "scored", lambda *a: whole(*a, head=50))  # most pairs are joined by a shuffle
    assert result(alignment.digests(docs, alignment.default_vocabulary(), alignment.default_pieces())) == want


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id string, text string, pairs int, n_a int, __row int, __key int, groups int")
    assert alignment.digests(df, alignment.default_vocabulary(), alignment.default_pieces()).collect() == []
    df = spark.createDataFrame([("x", "one two", 1, 2, 3, 4, 5)], df.schema)
    row = alignment.digests(df, alignment.default_vocabulary(), alignment.default_pieces()).first()
    assert row.doc_id == "x" and row.n_a == 2 and row.n_groups == row.n_links == row.n_best == row.count_sum == 2


def test_long_text_and_union_find():
    a = alignment.Aligner(open(alignment.default_vocabulary(), encoding="utf-8").read(), open(alignment.default_pieces(), "rb").read())
    text = "many words of a very long text, 12345 " * 20_000
    x = a.align([None, text, "short"])
    assert x["n_groups"][0] == 0 and x["n_groups"][1] > 150_000 and x["n_links"][1] >= max(x["n_a"][1], x["n_b"][1])
    rng = np.random.default_rng(1)
    left, right = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    root, least = alignment.union_find(300, left, right), list(range(300))
    for _ in range(300):
        for i, j in zip(left, right, strict=True):
            least[i] = least[j] = min(least[i], least[j])
    assert root.tolist() == least
    chain = np.arange(99_999)
    assert not alignment.union_find(100_000, chain, chain + 1).any()
