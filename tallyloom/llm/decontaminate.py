"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, lower case.  Every run of SEED_WORDS
words of a test item is a seed.  A first pass counts the documents that hold
each seed; the rare seeds of an item are those no more frequent than
RARE_TIMES the median of its seeds.  A second pass joins the documents with
the seeds, aligns the surroundings of the hits with their item and keeps the
pairs whose score is high enough.  Surroundings that hold frequent seeds only
are aligned too, unless the words they share with the item prove that no
alignment in them can reach the least score; so how often a passage occurs
costs no match.

The score is that of the best local alignment (a match 1, a mismatch or an
inserted or missing word -PENALTY) over the number of the item's words; it has
to reach THRESHOLD, and LEAST_SCORE before the division, as a common phrase is
much of a short item.  An item of LEAST_SCORE words or fewer is matched by an
untouched copy only.  One of fewer than SEED_WORDS words, which holds no seed,
is matched where `lines` asks for it, by a line of its words alone: within a
sentence it says nothing.

Items are broadcast in blocks of at most BLOCK_WORDS words (some tens of MB),
with one pair of passes a block, so no broadcast grows with the benchmark.

Cases: null and empty texts match nothing, nor do items that are null or have
no words, nor, without `lines`, those of fewer than SEED_WORDS words; repeated items are matched each, repeated rows alike; a document of any length is searched whole; empty tables give no
match; extra columns are ignored, or kept by `decontaminated`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import slices, spread, table

SEED_WORDS, RARE_TIMES = 3, 4
PENALTY, THRESHOLD, LEAST_SCORE = 0.5, 0.3, 5.0
BLOCK_WORDS = 500_000
#: Pairs that are aligned at once.
PAIRS = 256
#: Words of windows looked at together, and places of seeds held at once unless one text has more.
CELLS, HITS = 1 << 20, 1 << 21

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def align(items: np.ndarray, item_lengths: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and end (in the window) of the best local alignment of each row; items padded by -1, windows by -2."""
    n, width = windows.shape
    slope = PENALTY * np.arange(width, dtype=np.float32)
    row = np.zeros((n, width + 1), np.float32)
    best, end = np.zeros(n, np.float32), np.zeros(n, np.int64)
    for i in range(items.shape[1]):
        step = np.where(windows == items[:, i : i + 1], np.float32(1), np.float32(-PENALTY))
        new = np.maximum(row[:, :-1] + step, row[:, 1:] - np.float32(PENALTY))
        np.maximum(new, 0, out=new)
        # a gap in the item runs along the row
        new = np.maximum.accumulate(new + slope, axis=1) - slope
        row[:, 1:] = np.where((i < item_lengths)[:, None], new, np.float32(0))
        top = row[:, 1:].argmax(1)
        value = row[np.arange(n), top + 1]
        better = value > best
        best[better], end[better] = value[better], top[better]
    return best, end


class Items:
    """Test items with their seeds; `rare` marks the seeds in use, all at first."""

    def __init__(self, rows: list[tuple[int, str | None]], lines: bool = False):
        self.vocabulary: dict[str, int] = {}
        self.ids, self.words = [], []
        #: Items without a seed by their words.
        self.short: dict[tuple[str, ...], list[int]] = {}
        for item, text in rows:
            words = words_of(text)
            if lines and 0 < len(words) < SEED_WORDS:
                self.short.setdefault(tuple(words), []).append(item)
            if len(words) >= SEED_WORDS:
                self.ids.append(item)
                self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64))
        codes, item, at = [], [], []
        for k, words in enumerate(self.words):
            found = self.codes(words)
            codes.append(found)
            item.append(np.full(len(found), k))
            at.append(np.arange(len(found)))
        every = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (codes, item, at)]
        order = np.argsort(every[0], kind="stable")
        self.code, self.item, self.at = (x[order] for x in every)
        self.seeds, self.first = np.unique(self.code, return_index=True)
        self.count = np.diff(np.append(self.first, len(self.code)))
        self.rare = np.ones(len(self.code), bool)
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        #: What a match has to reach before it is divided by the item's length.
        self.least = np.maximum(THRESHOLD * self.lengths, np.minimum(self.lengths, LEAST_SCORE))
        owner = np.repeat(np.arange(len(self.words)), self.lengths)
        #: The words of each item as item * (size of the vocabulary + 1) + word.
        self.held = np.unique(owner * (len(self.vocabulary) + 1) + (np.concatenate(self.words) if self.words else owner))

    @staticmethod
    def codes(words: np.ndarray) -> np.ndarray:
        """A number for each run of SEED_WORDS known words, -1 for the others."""
        n = len(words) - SEED_WORDS + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        code, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(SEED_WORDS):
            part = words[k : n + k]
            code = (code << 21) | part
            known &= part > 0
        return np.where(known, code, -1)

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in one array, 0 for words of no item, and where each text begins; three zeros part texts."""
        get, gap = self.vocabulary.get, [0] * SEED_WORDS
        flat: list[int] = []
        starts = []
        for text in texts:
            starts.append(len(flat))
            flat += [get(w, 0) for w in words_of(text)]
            flat += gap
        starts.append(len(flat))
        return np.array(flat, np.int64), np.array(starts, np.int64)

    def hits(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions that hold a seed, and which."""
        codes = self.codes(flat)
        at = np.flatnonzero(codes >= 0)
        if not len(at) or not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.seeds, codes[at]), len(self.seeds) - 1)
        same = self.seeds[place] == codes[at]
        return at[same], place[same]

    def keep_rare(self, counts: np.ndarray) -> None:
        """Mark the rare seeds by the document counts of all seeds; the others need proof that an alignment is worth it."""
        each = np.repeat(counts, self.count)
        order = np.lexsort((each, self.item))
        size = np.bincount(self.item, minlength=len(self.ids))
        first, some = np.cumsum(size) - size, size > 0
        median = np.zeros(len(self.ids))
        median[some] = (each[order[first[some] + (size[some] - 1) // 2]] + each[order[first[some] + size[some] // 2]]) / 2
        self.rare = each <= RARE_TIMES * np.maximum(1.0, median)[self.item]

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, float, int, int]]:
        """(text, item, score, first word, word after the last) of the best alignment of each pair that is close enough."""
        return sorted(self._aligned_items(texts) + self._lines(texts), key=lambda m: m[:2])

    def _lines(self, texts: list[str | None]) -> list[tuple[int, int, float, int, int]]:
        """The matches of items without a seed: the first line of each text that holds an item's words and no other."""
        out = []
        for t, text in enumerate(texts if self.short else []):
            found: dict[tuple[str, ...], int] = {}
            n = 0
            for line in (text or "").splitlines():
                words = words_of(line)
                if 0 < len(words) < SEED_WORDS and tuple(words) in self.short:
                    found.setdefault(tuple(words), n)
                n += len(words)
            out += [(t, item, 1.0, at, at + len(words)) for words, at in found.items() for item in self.short[words]]
        return out

    def _aligned_items(self, texts: list[str | None]) -> list[tuple[int, int, float, int, int]]:
        flat, starts = self.read(texts)
        at, seed = self.hits(flat)
        if not len(at):
            return []
        # each hit with every place of its seed
        times = self.count[seed]
        if len(texts) > 1 and int(times.sum()) > HITS:
            half = len(texts) // 2
            return self._aligned_items(texts[:half]) + [(t + half, *rest) for t, *rest in self._aligned_items(texts[half:])]
        entry = np.repeat(self.first[seed] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        at = np.repeat(at, times)
        text = np.searchsorted(starts, at, side="right") - 1
        item = self.item[entry]
        lengths = self.lengths
        begin, rare = at - self.at[entry], self.rare[entry]
        order = np.lexsort((begin, item, text))
        text, item, begin, rare = text[order], item[order], begin[order], rare[order]
        slack = lengths[item] // 2
        # hits whose windows start within the slack share one alignment
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > slack[1:])
        group = np.flatnonzero(new)
        last = np.append(group[1:], len(text)) - 1
        text, item, low, high, rare = text[group], item[group], begin[group], begin[last], np.logical_or.reduceat(rare, group)
        low = np.maximum(low - slack[group], starts[text])
        high = np.minimum(high + lengths[item] + slack[group], starts[text + 1] - SEED_WORDS)
        can = rare.copy()
        can[~rare] = self._reachable(flat, item[~rare], low[~rare], high[~rare])
        text, item, low, high = text[can], item[can], low[can], high[can]
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        size = np.argsort(high - low, kind="stable")
        for i in range(0, len(size), PAIRS):
            part = size[i : i + PAIRS]
            width = int((high - low)[part].max())
            if width * len(part) > 1 << 22:  # few and long
                runs = [part[j : j + 1] for j in range(len(part))]
            else:
                runs = [part]
            for run in runs:
                for k, s, a, e in self._aligned(flat, item[run], low[run], high[run]):
                    if s > best.get((int(text[run[k]]), int(item[run[k]])), (0.0,))[0]:
                        base = int(starts[text[run[k]]])
                        best[int(text[run[k]]), int(item[run[k]])] = (s, a - base, e - base)
        return [(t, self.ids[k], s, a, e) for (t, k), (s, a, e) in sorted(best.items())]

    def _reachable(self, flat: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether an alignment in each window may reach the least score.

        A window's word in an alignment adds 1 at most if the item holds it and
        -PENALTY else, so no score is above the largest sum over a stretch.
        """
        can, size = np.zeros(len(item), bool), np.argsort(high - low, kind="stable")
        least, words = self.least[item], len(self.vocabulary) + 1
        i = 0
        while i < len(size):
            # as many windows as fit into CELLS, the widest last
            part = size[i : i + PAIRS]
            part = part[: max(1, CELLS // max(1, int((high - low)[part[-1]])))]
            i += len(part)
            place = low[part][:, None] + np.arange(max(1, int((high - low)[part[-1]])))
            inside = place < high[part][:, None]
            code = item[part][:, None] * words + flat[np.where(inside, place, 0)]
            found = self.held[np.minimum(np.searchsorted(self.held, code), len(self.held) - 1)] == code
            total = np.cumsum(np.where(found & inside, 1.0, -PENALTY), axis=1)
            before = np.minimum(np.minimum.accumulate(np.pad(total, ((0, 0), (1, 0)))[:, :-1], axis=1), 0)
            can[part] = (total - before).max(1) >= least[part]
        return can

    def _aligned(self, flat: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        lengths = np.array([len(self.words[k]) for k in item])
        items = np.full((len(item), int(lengths.max())), -1, np.int64)
        windows = np.full((len(item), max(1, int((high - low).max()))), -2, np.int64)
        back_items, back = items.copy(), windows.copy()
        for r, (k, a, b) in enumerate(zip(item, low, high, strict=True)):
            items[r, : lengths[r]] = self.words[k]
            windows[r, : b - a] = flat[a:b]
            back_items[r, : lengths[r]] = self.words[k][::-1]
            back[r, : b - a] = flat[a:b][::-1]
        score, end = align(items, lengths, windows)
        near = np.flatnonzero(score >= self.least[item])
        if len(near):
            _, first = align(back_items[near], lengths[near], back[near])
            for r, f in zip(near, first, strict=True):
                a, b = int(high[r] - 1 - f), int(low[r] + end[r]) + 1
                yield int(r), float(score[r] / lengths[r]), min(a, b - 1), b


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of at most BLOCK_WORDS words, streamed to the driver one partition at a time."""
    block, words = [], 0
    for row in benchmark.select(F.col(item).cast("long"), text).orderBy(item, text).toLocalIterator():
        n = len(words_of(row[1]))
        if block and words + n > BLOCK_WORDS:
            yield block
            block, words = [], 0
        block.append((row[0], row[1]))
        words += n
    if block:
        yield block


def _with_rare_seeds(documents: DataFrame, block: list[tuple[int, str]], text: str, lines: bool) -> Items:
    """The items of a block, their rare seeds marked by counts over all documents."""
    items = Items(block, lines)
    sent = documents.sparkSession.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        total = np.zeros(len(held.seeds), np.int64)
        for batch in batches:
            for part in slices(batch, "__text"):
                flat, starts = held.read(part.column(0).to_pylist())
                at, seed = held.hits(flat)
                text_of = np.searchsorted(starts, at, side="right") - 1
                once = np.unique(text_of * len(total) + seed)
                total += np.bincount(once % max(1, len(total)), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["seed", "n"])

    counts = np.zeros(len(items.seeds), np.float64)
    if len(items.seeds):
        found = documents.select(F.col(text).alias("__text")).mapInArrow(count, "seed long, n long")
        for row in found.groupBy("seed").agg(F.sum("n").alias("n")).collect():  # at most a row for each seed of the block
            counts[row["seed"]] = row["n"]
    sent.unpersist()
    items.keep_rare(counts)
    return items


MATCHES = "item_id long, score double, first_word int, end_word int"


def contaminations(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", lines: bool = False) -> DataFrame:
    """A row (key, item_id, score, first_word, end_word) for each document and item that align; with `lines` also for items without a seed."""
    spark, out = documents.sparkSession, None
    rows = documents.select(F.col(text).alias("__text"), F.col(key).cast("long").alias(key))
    for block in _blocks(benchmark, item, item_text):
        sent = spark.sparkContext.broadcast(_with_rare_seeds(documents, block, text, lines))

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "__text"):
                    found = sent.value.matches(part.column(0).to_pylist())
                    ids = part.column(1).take(pa.array([f[0] for f in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array([f[i] for f in found], t) for i, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int32()), (4, pa.int32())))], [key, "item_id", "score", "first_word", "end_word"])

        more = rows.mapInArrow(find, f"{key} long, {MATCHES}")
        out = more if out is None else out.unionByName(more)
    return spark.createDataFrame([], f"{key} long, {MATCHES}") if out is None else out


def decontaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", lines: bool = True) -> DataFrame:
    """The rows of `documents`, all columns, that align with no test item; each block is one more filter, without a shuffle."""
    out = documents
    for block in _blocks(benchmark, item, item_text):
        sent = documents.sparkSession.sparkContext.broadcast(_with_rare_seeds(documents, block, text, lines))

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text):
                    leaked = {f[0] for f in sent.value.matches(part.column(text).to_pylist())}
                    yield part.filter(pa.array([i not in leaked for i in range(part.num_rows)], pa.bool_()))

        out = out.mapInArrow(clean, out.schema)
    return out


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), lines=True)


ORACLES: dict[str, str] = {}
QUERIES = {"op2_decontaminate": op2_decontaminate}
