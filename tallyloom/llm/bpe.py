"""Byte-level BPE encoding and decoding with a contiguous rank array.

A short word is held as an array of part boundaries and, beside it, the rank
of each pair of neighbours.  The least rank is found by a scan, its boundary
deleted, and the two neighbouring ranks looked up anew, until no pair has a
rank.  A scan is quadratic in the word, so words above SHORT bytes merge from
a heap of pairs instead, with the same result.

The vocabulary is a file of the `tokenizers` library whose path is a
parameter; nothing is trained.  Executors load it once a worker, from the file
contents that the driver sends, so they need no copy of the file.

Cases: a null text counts as empty, an empty text has no tokens, text of any
length is encoded whole, repeated rows are encoded each, an empty table gives
an empty result, extra columns are ignored.  The strings of special tokens
become their ids, as the library does by default.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import map_text, spread, table

#: Bytes up to which a word is merged by scanning its rank array.
SHORT = 128
#: Words whose encoding a worker remembers.
REMEMBERED = 400_000
NO_RANK = 1 << 60

# The public pre-tokenizer pattern of byte-level BPE, and its form for text below U+0250 with the classes spelled out.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\\t-\\r \x85\xa0"

_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")
_ANY = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in vocabulary files: itself where printable, else the next one from U+0100."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """One vocabulary: text to ids and back."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        self.start = [vocab[letters[b]] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.specials = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def merge_short(self, word: bytes) -> list[int]:
        merges, bounds, ids = self.merges, list(range(len(word) + 1)), [self.start[b] for b in word]

        def rank_at(i: int) -> int:
            return merges.get((ids[i], ids[i + 1]), (NO_RANK,))[0] if i + 2 < len(bounds) else NO_RANK

        ranks = [rank_at(i) for i in range(len(ids))]
        while len(ids) > 1 and (least := min(ranks)) < NO_RANK:
            i = ranks.index(least)
            ids[i : i + 2] = [merges[ids[i], ids[i + 1]][1]]
            del bounds[i + 1], ranks[i + 1]
            ranks[i] = rank_at(i)
            if i:
                ranks[i - 1] = rank_at(i - 1)
        return ids

    def merge_long(self, word: bytes) -> list[int]:
        merges, ids = self.merges, [self.start[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(merges[p][0], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in merges]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = merges[left, right][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if b < n and (pair := (ids[a], ids[b])) in merges:
                    heapq.heappush(heap, (merges[pair][0], a, *pair))
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> bytes:
        """The ids of a word as packed 32-bit numbers."""
        raw = word.encode("utf-8", "surrogatepass")
        found = np.array(self.merge_short(raw) if len(raw) <= SHORT else self.merge_long(raw), np.int32).tobytes()
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if len(raw) <= SHORT:
            self.known[word] = found
        return found

    def _plain(self, text: str) -> list[bytes]:
        words = (_ANY if _BEYOND_LATIN.search(text) else _LATIN).findall(text)
        known = self.known.get
        return [known(w) or self.word(w) for w in words]

    def encode(self, text: str) -> np.ndarray:
        if self.specials and any(s in text for s in self.special):
            parts = [p for x in self.specials.split(text) if x for p in ([np.int32(self.special[x]).tobytes()] if x in self.special else self._plain(x))]
        else:
            parts = self._plain(text)
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    @functools.cached_property
    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All token bytes in one array, with the start and the length of each id."""
        size = max(self.bytes_of) + 1
        every = [self.bytes_of.get(i, b"") for i in range(size)]
        lengths = np.array([len(b) for b in every], np.int64)
        return np.frombuffer(b"".join(every), np.uint8), np.cumsum(lengths) - lengths, lengths

    def decode_many(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Decode documents whose ids stand one after another; counts: ids of each."""
        flat, starts, lengths = self.pieces
        size = lengths[ids]
        ends = np.cumsum(size)
        index = np.repeat(starts[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        raw = flat[index].tobytes()
        cuts = np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(counts)]]) if len(counts) else np.zeros(1, np.int64)
        return [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_loaded: dict[int, Encoder] = {}


def _encoder(definition) -> Encoder:
    """The encoder of a broadcast vocabulary, built once a worker."""
    key = definition.id if hasattr(definition, "id") else hash(definition.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(definition.value)
    return _loaded[key]


def encode_documents(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array of int) and decoded (the text that the ids give back) of each row.

    The vocabulary file is broadcast: its size is fixed, 1.5 MB here.
    """
    definition = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _encoder(definition)
        encoded = [encoder.encode(t or "") for t in batch.column(1).to_pylist()]
        counts = np.array([len(x) for x in encoded], np.int64)
        ids = np.concatenate(encoded) if encoded else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
        decoded = pa.array(encoder.decode_many(ids, counts), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), lists, decoded], ["__key", "ids", "decoded"])

    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    kind = rows.schema["__key"].dataType.simpleString()
    return map_text(rows, "__text", f"__key {kind}, ids array<int>, decoded string", work).withColumnRenamed("__key", key)


def digests(encoded: DataFrame, key: str = "doc_id", also: Sequence[str] = ()) -> DataFrame:
    """key, n_tokens and the SHA-256 of the ids, joined by commas, and of the decoded text; also: columns to keep."""
    return encoded.select(
        key,
        *also,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(spread(table(spark, sf_dir, "documents")), default_vocabulary()))


ORACLES: dict[str, str] = {}
QUERIES = {"op6_bpe": op6_bpe}
