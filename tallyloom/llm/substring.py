"""Exact substring deduplication with an FM-index per shard.

A window is WIDTH consecutive words of one document; a window goes if its
words also start in a document with a smaller id.  Windows are dealt to shards
by their content, not by their document, so equal windows meet in one shard
and every window is looked up in one shard only, however many there are: the
anchor of a window is the least of the hashes of its runs of ANCHOR words, and
consecutive windows with the same anchor travel as one segment of at most
2 * WIDTH - ANCHOR words.

1. Buckets of documents (by a hash of id and text) send each shard its anchors.
2. A shard answers which anchors at least two documents have; windows with
   any other anchor are unique, and only segments with a shared one go on.  It
   also answers which anchors are hot, those that more than HOT different
   segments have in all, as a stock phrase in ever new surroundings does: their
   windows travel one by one, each to the shard that its whole content names.
3. Buckets send each such segment once, as words, with the least id that has it.
4. A shard cuts its segments, in order of their ids, into LAYERS layers, and
   each layer's index holds that layer alone.  The windows of a layer are
   streamed through the indexes of the smaller ids, one after another:
   matching statistics by backward search over the wavelet tree tell how far
   a window matches, and an interval of the whole width with a smaller id ends
   its search.  What is left goes through its own layer's index, where the
   least id over its interval decides.  One bit a window goes back.
5. Buckets put the bits together and cut the words out.

A passage that a third of all documents share is sent at most once a bucket,
whatever the number of copies; equal rows are counted, worked on once and
repeated at the end.  Buckets and shards hold BUCKET_BYTES and
SHARD_BYTES of text, so their number follows the input.

Hashes only choose shards and sort; words, segments and windows are compared
by content.  Cases: null and empty texts have no words and null ids take no
part: nothing is removed from their rows, and they remove nothing; rows that
repeat an id don't remove from one another; equal rows of different ids leave
the least; very long texts are one document like any other; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import broadcast_if_small, checkpointed, map_text, table
from tallyloom.llm.fm_index import FMIndex

WIDTH, ANCHOR = 13, 7
BUCKET_BYTES, SHARD_BYTES, LEAST_BYTES = 8 << 20, 8 << 20, 1 << 20
#: Indexes of a shard, and windows searched at once.
LAYERS, SEARCHED = 4, 1 << 18
#: Different segments of an anchor above which its windows are dealt one by one; a shard has some 100,000.
HOT = 8192
#: Keys up to which those of repeated rows are broadcast, and copies of a row that are made at once.
FEW, COPIES = 200_000, 1 << 20

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _runs(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of the `width` values from each position."""
    n = max(0, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * _FACTOR + h[k : n + k]
    return _mixed(out)


def _in_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key begins in the stable order of the keys, and that order."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    begins = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return begins, order


def _segment_keys(run: np.ndarray, first: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """A hash of each segment, of the hashes `run` of its first and last window and its length."""
    return _mixed(run[first] * _FACTOR + run[first + windows - 1] * _MIX + windows.astype(np.uint64))


def _groups(keys: np.ndarray, values: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of equal content: the group of each, and the groups as (begins, order) of a sort.

    values: the words' numbers; first, lengths: of each segment.  Keys bring
    equal segments together; their words then confirm it, and where a key
    stands for several contents its segments are sorted by content.
    """
    begins, order = _in_order(keys)
    sizes = np.diff(np.append(begins, len(keys)))
    head = np.repeat(order[begins], sizes)  # of each place in the order, the first segment of its key
    same = lengths[order] == lengths[head]
    checked = np.flatnonzero(same & (order != head))
    for i in range(0, len(checked), SEARCHED):
        at = checked[i : i + SEARCHED]
        n = lengths[order[at]]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        equal = values[np.repeat(first[order[at]], n) + step] == values[np.repeat(first[head[at]], n) + step]
        same[at] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    if not same.all():  # two contents with one key
        spoilt = np.repeat(np.logical_or.reduceat(~same, begins), sizes)
        fresh = np.zeros(len(keys), bool)
        fresh[begins] = True
        places = np.flatnonzero(spoilt)
        content = [(int(b), values[first[s] : first[s] + lengths[s]].tobytes(), int(s)) for s, b in zip(order[places], np.repeat(np.arange(len(begins)), sizes)[places], strict=True)]
        content.sort()
        order[places] = [s for _, _, s in content]
        fresh[places] = [i == 0 or content[i][:2] != content[i - 1][:2] for i in range(len(content))]
        begins = np.flatnonzero(fresh)
    group = np.empty(len(keys), np.int64)
    group[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(keys))))
    return group, begins, order


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at once; more only where one word is longer.
HASHED = 1 << 20
#: An odd base and its inverse modulo 2^64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n - 1 and its inverse's."""
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x)])) for x in (_BASE, _INVERSE))


def words_in(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last and a hash of each word of a buffer that ends in white space.

    The hash is a polynomial in the word's bytes: a running sum of bytes times
    powers, taken between the word's ends and divided by the power at its start.
    """
    starts, ends, hashes = [], [], []
    begin = 0
    while begin < len(raw):
        piece = raw[begin : begin + HASHED]
        gap = _SPACE[piece]
        stop = len(piece) - int(np.argmax(gap[::-1]))
        if not gap[stop - 1]:  # a word longer than the piece
            rest = raw[begin + len(piece) :]
            stop = len(piece) + int(np.argmax(_SPACE[rest])) + 1
            piece = raw[begin : begin + stop]
            gap = _SPACE[piece]
        piece, gap = piece[:stop], gap[:stop]
        edge = np.flatnonzero(np.diff(gap, prepend=True))
        first, last = edge[::2], edge[1::2]
        power, inverse = (x[:stop] for x in _powers(max(HASHED, stop)))
        total = np.cumsum(piece * power)
        before = np.where(first > 0, total[first - 1], np.uint64(0))
        hashes.append(_mixed((total[last - 1] - before) * inverse[first] + (last - first).astype(np.uint64) * _FACTOR))
        starts.append(first + begin)
        ends.append(last + begin)
        begin += stop
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(starts or empty), np.concatenate(ends or empty), np.concatenate(hashes or [np.zeros(0, np.uint64)])


class Bucket:
    """The words and segments of a bucket's documents."""

    def __init__(self, ids: list[int], texts: list[str | None], shards: int):
        self.texts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.raw = b"\n".join([*self.texts, b""])
        self.begin, self.end, self.hash = words_in(np.frombuffer(self.raw, np.uint8))
        sizes = np.array([len(t) + 1 for t in self.texts], np.int64)
        self.ends = np.searchsorted(self.begin, np.cumsum(sizes))
        self.counts = np.diff(self.ends, prepend=0)
        doc_ids = np.array(ids, np.int64)
        document = np.repeat(np.arange(len(ids)), self.counts)
        room = self.ends[document] - np.arange(len(self.hash))
        starts = np.flatnonzero(room >= WIDTH)
        # the least of the anchors from each start, the first of equal ones: of 1, 2, 4 and then all of them
        least, place = _runs(self.hash, ANCHOR), np.arange(max(0, len(self.hash) - ANCHOR + 1))
        span, wanted = 1, WIDTH - ANCHOR + 1
        while span < wanted and len(starts):
            step = min(span, wanted - span)
            better = least[step:] < least[:-step]
            least, place = np.where(better, least[step:], least[:-step]), np.where(better, place[step:], place[:-step])
            span += step
        least, place = least[starts] if len(starts) else least[:0], place[starts] if len(starts) else place[:0]
        #: Segments: first word, number of windows, document's id and anchor of each.
        new = np.ones(len(starts), bool)
        new[1:] = (place[1:] != place[:-1]) | (np.diff(starts) != 1)
        first = np.flatnonzero(new)
        self.first = starts[first]
        self.windows = np.diff(np.append(first, len(starts)))
        self.doc = doc_ids[document[self.first]]
        anchor = least[first]
        self.shards = shards
        # anchors are least hashes, so their high bits are low: the shard comes from the low ones
        self.shard_of = (_mixed(anchor) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((anchor, self.shard_of))
        fresh = np.ones(len(order), bool)
        fresh[1:] = anchor[order][1:] != anchor[order][:-1]
        begins = np.flatnonzero(fresh)
        self.anchor = anchor[order][begins]
        self.anchor_shard = self.shard_of[order][begins]
        self.anchor_of = np.empty(len(order), np.int64)
        self.anchor_of[order] = np.cumsum(fresh) - 1
        if len(begins):
            docs = self.doc[order]
            self.several = np.minimum.reduceat(docs, begins) != np.maximum.reduceat(docs, begins)
        else:
            self.several = np.zeros(0, bool)

    def anchors_by_shard(self) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Shard, its distinct anchors in order, which of them several documents here have, and how many different segments each has here, 65,535 at most."""
        keys = _segment_keys(_runs(self.hash, WIDTH), self.first, self.windows) if len(self.first) else np.zeros(0, np.uint64)
        order = np.lexsort((keys, self.anchor_of))
        new = np.ones(len(keys), bool)
        new[1:] = (self.anchor_of[order][1:] != self.anchor_of[order][:-1]) | (keys[order][1:] != keys[order][:-1])
        counts = np.minimum(np.bincount(self.anchor_of[order][new], minlength=len(self.anchor)), 65535).astype(np.uint16)
        cuts = np.flatnonzero(np.diff(self.anchor_shard)) + 1
        parts = np.split(np.arange(len(self.anchor)), cuts)
        return [(int(self.anchor_shard[p[0]]), self.anchor[p], self.several[p], counts[p]) for p in parts if len(p)]

    def _flags(self, said: dict[int, np.ndarray]) -> np.ndarray:
        """What the shards said of each distinct anchor."""
        flags = np.zeros(len(self.anchor), bool)
        for shard, bits in said.items():
            a, b = np.searchsorted(self.anchor_shard, [shard, shard + 1])
            flags[a:b] = bits[: b - a]
        return flags

    def choose(self, shared: dict[int, np.ndarray], hot: dict[int, np.ndarray] | None = None) -> None:
        """Keep the segments whose anchors are shared, those of hot anchors as single windows; find the distinct ones, by shard, and the least id of each."""
        live, single = self._flags(shared), self._flags(hot or {})
        kept = np.flatnonzero((live & ~single)[self.anchor_of]) if len(self.first) else np.zeros(0, np.int64)
        split = np.flatnonzero((live & single)[self.anchor_of]) if single.any() else np.zeros(0, np.int64)
        run = _runs(self.hash, WIDTH)
        times = self.windows[split]
        alone = np.repeat(self.first[split], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        #: First word, number of windows, document and shard of what is kept.
        self.kept_first = first = np.concatenate([self.first[kept], alone])
        self.kept_windows = windows = np.concatenate([self.windows[kept], np.ones(len(alone), np.int64)])
        self.kept_doc = np.concatenate([self.doc[kept], np.repeat(self.doc[split], times)])
        shard_of = np.concatenate([self.shard_of[kept], (_mixed(run[alone]) % np.uint64(self.shards)).astype(np.int64)])
        # the words of kept segments get numbers by content
        edge = np.bincount(first, minlength=len(self.hash) + 1) - np.bincount(first + windows + WIDTH - 1, minlength=len(self.hash) + 1)
        at = np.flatnonzero(np.cumsum(edge[:-1]))
        numbers: dict[bytes, int] = defaultdict(itertools.count().__next__)
        raw = self.raw
        self.value = np.full(len(self.hash), -1, np.int32)
        self.value[at] = np.fromiter((numbers[raw[a:b]] for a, b in zip(self.begin[at].tolist(), self.end[at].tolist(), strict=True)), np.int32, len(at))
        self.dictionary = np.array(list(numbers), object)
        keys = _segment_keys(run, first, windows)
        group, begins, order = _groups(keys, self.value, first, windows + WIDTH - 1)
        least = np.minimum.reduceat(self.kept_doc[order], begins) if len(begins) else np.zeros(0, np.int64)
        sample = order[begins]
        by_shard = np.argsort(shard_of[sample], kind="stable")
        turn = np.empty(len(sample), np.int64)
        turn[by_shard] = np.arange(len(sample))
        #: Of each kept segment, its distinct one; of the distinct ones, least id, first word, windows and shard.
        self.distinct = turn[group]
        self.least, self.sample = least[by_shard], first[sample[by_shard]]
        self.sample_windows, self.sample_shard = windows[sample[by_shard]], shard_of[sample[by_shard]]

    def segments_by_shard(self) -> list[tuple[int, bytes, bytes, bytes, bytes]]:
        """Shard, dictionary of words, word codes, lengths and least ids of its distinct segments."""
        out = []
        cuts = np.flatnonzero(np.diff(self.sample_shard)) + 1
        for p in np.split(np.arange(len(self.sample)), cuts):
            if len(p):
                lengths = self.sample_windows[p] + WIDTH - 1
                begins = np.cumsum(lengths) - lengths
                at = np.repeat(self.sample[p] - begins, lengths) + np.arange(int(lengths.sum()))
                held, codes = np.unique(self.value[at], return_inverse=True)
                small = codes.astype(np.uint16 if len(held) <= 1 << 16 else np.uint32)
                out.append((int(self.sample_shard[p[0]]), b" ".join(self.dictionary[held]), small.tobytes(), lengths.astype(np.uint8).tobytes(), self.least[p].tobytes()))
        return out

    def removed(self, bits: dict[int, np.ndarray]) -> np.ndarray:
        """Which words go; bits: for each shard a flag for each window of its distinct segments."""
        offset = np.cumsum(self.sample_windows) - self.sample_windows
        flags = np.zeros(int(self.sample_windows.sum()), bool)
        for shard, found in bits.items():
            a, b = np.searchsorted(self.sample_shard, [shard, shard + 1])
            if b > a:
                n = int(self.sample_windows[a:b].sum())
                flags[offset[a] : offset[a] + n] = found[:n]
        windows = self.kept_windows
        within = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        start = np.repeat(self.kept_first, windows) + within
        later = np.repeat(self.kept_doc > self.least[self.distinct], windows) if len(windows) else np.zeros(0, bool)
        gone = start[later | flags[np.repeat(offset[self.distinct], windows) + within]] if len(windows) else start
        edge = np.bincount(gone, minlength=len(self.hash) + 1) - np.bincount(gone + WIDTH, minlength=len(self.hash) + 1)
        return np.cumsum(edge[:-1]) > 0


def judged_anchors(lists: list[np.ndarray], several: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each bucket's distinct anchors at a shard, which of them at least two documents have and which are hot."""
    every = np.concatenate(lists)
    begins, order = _in_order(every)
    times = np.diff(np.append(begins, len(every)))
    live, hot = np.empty(len(every), bool), np.empty(len(every), bool)
    live[order] = np.repeat((times > 1) | np.logical_or.reduceat(np.concatenate(several)[order], begins), times)
    hot[order] = np.repeat(np.add.reduceat(np.concatenate(counts).astype(np.int64)[order], begins) > HOT, times)
    ends = np.cumsum([0, *map(len, lists)])
    return tuple([flags[a:b] for a, b in itertools.pairwise(ends)] for flags in (live, hot))


def repeated_windows(parts: list[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each part (dictionary, codes, lengths, least ids) of a shard a flag for each of its windows: does a smaller document have it?"""
    lengths = np.concatenate([p[2] for p in parts]).astype(np.int64)
    least = np.concatenate([p[3] for p in parts])
    numbers: dict[bytes, int] = defaultdict(itertools.count().__next__)
    maps = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words, _, _, _ in parts]
    value = np.concatenate([m[p[1]] for m, p in zip(maps, parts, strict=True)])
    begins = np.cumsum(lengths) - lengths
    run = _runs(_mixed(value.astype(np.uint64) + _FACTOR), WIDTH)
    group, group_begins, order = _groups(_segment_keys(run, begins, lengths - WIDTH + 1), value, begins, lengths)
    ids = np.minimum.reduceat(least[order], group_begins)
    # distinct segments in order of their ids, then by place, so layers ascend
    rank = np.argsort(ids, kind="stable")
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    group, ids, first_of = place[group], ids[rank], order[group_begins][rank]
    size = lengths[first_of]
    inner = np.cumsum(size) - size
    values = value[np.repeat(begins[first_of] - inner, size) + np.arange(int(size.sum()))]
    windows = size - WIDTH + 1
    offset = np.cumsum(windows) - windows
    start = np.repeat(inner - offset, windows) + np.arange(int(windows.sum()))
    owner = np.repeat(ids, windows)
    repeated = np.zeros(len(start), bool)
    cuts = np.unique(np.searchsorted(np.cumsum(size), np.arange(1, LAYERS) * size.sum() / LAYERS))
    layers: list[Layer] = []
    for low, high in itertools.pairwise([0, *(int(c) for c in cuts if 0 < c < len(size)), len(size)]):
        inside = slice(int(inner[low]), int(inner[high - 1] + size[high - 1]))
        layers.append(Layer(values[inside], size[low:high], ids[low:high]))
        for i in range(int(offset[low]), int(offset[high - 1] + windows[high - 1]), SEARCHED):
            open_ = np.arange(i, min(i + SEARCHED, int(offset[high - 1] + windows[high - 1])))
            for layer in layers:
                patterns = values[start[open_, None] + np.arange(WIDTH)]
                found = layer.smaller(patterns, owner[open_])
                repeated[open_[found]] = True
                open_ = open_[~found]
    # back to the segments as they were sent: one with a greater id than another of equal content goes whole
    sent = lengths - WIDTH + 1
    source = np.repeat(offset[group] - (np.cumsum(sent) - sent), sent) + np.arange(int(sent.sum()))
    flags = repeated[source] | np.repeat(ids[group] < least, sent)
    ends = np.cumsum([0, *(int((p[2].astype(np.int64) - WIDTH + 1).sum()) for p in parts)])
    return [flags[a:b] for a, b in itertools.pairwise(ends)]


class Layer:
    """An FM-index over some segments, with the id of each."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray, ids: np.ndarray):
        self.words, codes = np.unique(values, return_inverse=True)
        self.index = FMIndex(codes.astype(np.int64) + 1, lengths)
        self.owner = np.append(ids[self.index.sequence], np.iinfo(np.int64).max)

    def smaller(self, patterns: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Whether each pattern stands, whole, in a segment whose id is smaller than its owner's."""
        code = np.minimum(np.searchsorted(self.words, patterns), len(self.words) - 1)
        code = np.where(self.words[code] == patterns, code + 1, 0)
        matched, low, high = self.index.backward(code)
        out = np.zeros(len(patterns), bool)
        whole = np.flatnonzero(matched == patterns.shape[1])
        if len(whole):
            # intervals of equal windows are equal: each is looked through once
            one, where = np.unique(low[whole], return_inverse=True)
            top = np.zeros(len(one), np.int64)
            top[where] = high[whole]
            least = np.minimum.reduceat(self.owner, np.stack([one, top], axis=1).ravel())[::2]
            out[whole] = least[where] < owner[whole]
        return out


def _whole(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows that take no part."""
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column(1).to_pylist()]
    counts = pa.array([len(w) for w in words], pa.int64())
    return pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array([0] * len(words), pa.int64()), pa.array([b" ".join(w) for w in words], pa.binary()).cast(pa.string())], ["__key", "n_words", "n_removed", "kept"])


_REPLY = "bucket int, kind int, shard int, bits binary"


def _counted(rows: DataFrame) -> DataFrame:
    """(__key, __text, __copies) of the different rows; only rows of keys that repeat are grouped."""
    repeats = checkpointed(rows.groupBy("__key").count().where("count > 1").select("__key"))
    few = broadcast_if_small(repeats, FEW)
    again = rows.join(few, "__key", "left_semi").groupBy("__key", "__text").agg(F.count(F.lit(1)).alias("__copies"))
    return rows.join(few, "__key", "left_anti").withColumn("__copies", F.lit(1).cast("long")).unionByName(again)


def _repeated(rows: DataFrame) -> DataFrame:
    """Each row as often as __copies says, COPIES at a time."""
    columns = [c for c in rows.columns if c != "__copies"]
    parts = rows.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__copies") - 1) / COPIES))))
    most = F.least(F.lit(COPIES).cast("long"), F.col("__copies") - F.col("__part") * COPIES)
    return parts.withColumn("__part", F.explode(F.sequence(F.lit(1).cast("long"), most))).select(*columns)


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept) of each row; kept is the text that is left, its words joined by a blank."""
    spark = df.sparkSession
    every = df.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text"))
    rows = every.where(F.col("__key").isNotNull())
    size = rows.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    # a small table is cut finer, so that every core has a part
    cores = min(spark.sparkContext.defaultParallelism, -(-size // LEAST_BYTES))
    buckets, shards = max(1, cores, -(-size // BUCKET_BYTES)), max(1, cores, -(-size // SHARD_BYTES))
    bucket = F.pmod(F.xxhash64("__key", "__text"), F.lit(buckets)).cast("int")
    documents = _counted(rows).withColumn("bucket", bucket)

    def load(t: pa.Table) -> Bucket:
        return Bucket(t.column("__key").to_pylist(), t.column("__text").to_pylist(), shards)

    def anchors(t: pa.Table) -> pa.Table:
        found, own = load(t).anchors_by_shard(), t.column("bucket")[0].as_py()
        return pa.table({"shard": pa.array([f[0] for f in found], pa.int32()), "bucket": pa.array([own] * len(found), pa.int32()), "anchors": pa.array([f[1].tobytes() for f in found], pa.binary()), "several": pa.array([np.packbits(f[2]).tobytes() for f in found], pa.binary()), "counts": pa.array([f[3].tobytes() for f in found], pa.binary())})

    def shared(t: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint64) for x in t.column("anchors").to_pylist()]
        several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(a)).astype(bool) for x, a in zip(t.column("several").to_pylist(), lists, strict=True)]
        live, hot = judged_anchors(lists, several, [np.frombuffer(x, np.uint16) for x in t.column("counts").to_pylist()])
        said = [(b, k, s, np.packbits(flags).tobytes()) for k, kind in ((0, live), (2, hot)) for b, s, flags in zip(t.column("bucket").to_pylist(), t.column("shard").to_pylist(), kind, strict=True) if k == 0 or flags.any()]
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*said, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "kind", "shard", "bits"])

    def replies(t: pa.Table, kind: int) -> dict[int, np.ndarray]:
        return {s: np.unpackbits(np.frombuffer(b, np.uint8)).astype(bool) for k, s, b in zip(t.column("kind").to_pylist(), t.column("shard").to_pylist(), t.column("bits").to_pylist(), strict=True) if k == kind}

    def segments(docs: pa.Table, said: pa.Table) -> pa.Table:
        out = []
        if docs.num_rows:
            held = load(docs)
            held.choose(replies(said, 0), replies(said, 2))
            out = held.segments_by_shard()
        own = docs.column("bucket")[0].as_py() if docs.num_rows else 0
        columns = [pa.array([f[i] for f in out], pa.binary()) for i in range(1, 5)]
        return pa.table([pa.array([f[0] for f in out], pa.int32()), pa.array([own] * len(out), pa.int32()), *columns], ["shard", "bucket", "dictionary", "codes", "lengths", "least"])

    def look_up(t: pa.Table) -> pa.Table:
        parts = []
        for d, c, n, m in zip(*(t.column(x).to_pylist() for x in ("dictionary", "codes", "lengths", "least")), strict=True):
            words = d.split()
            parts.append((words, np.frombuffer(c, np.uint16 if len(words) <= 1 << 16 else np.uint32), np.frombuffer(n, np.uint8), np.frombuffer(m, np.int64)))
        found = repeated_windows(parts)
        return pa.table({"bucket": t.column("bucket"), "kind": pa.array([1] * t.num_rows, pa.int32()), "shard": t.column("shard"), "bits": pa.array([np.packbits(f).tobytes() for f in found], pa.binary())})

    def cut(docs: pa.Table, said: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"__key": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string()), "__copies": pa.array([], pa.int64())})
        held = load(docs)
        held.choose(replies(said, 0), replies(said, 2))
        gone = held.removed(replies(said, 1))
        ends, kept, removed = held.ends, [], []
        for text, n, end in zip(held.texts, held.counts, ends, strict=True):
            mine, words = gone[end - n : end], text.split()
            removed.append(int(mine.sum()))
            kept.append(b" ".join(itertools.compress(words, (~mine).tolist()) if removed[-1] else words))
        return pa.table({"__key": docs.column("__key"), "n_words": pa.array(held.counts), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string()), "__copies": docs.column("__copies")})

    by_bucket = documents.groupBy("bucket")
    # one plan: the exchanges of the documents and of the anchors are written once and read again
    live = by_bucket.applyInArrow(anchors, "shard int, bucket int, anchors binary, several binary, counts binary").groupBy("shard").applyInArrow(shared, _REPLY)
    sent = by_bucket.cogroup(live.groupBy("bucket")).applyInArrow(segments, "shard int, bucket int, dictionary binary, codes binary, lengths binary, least binary")
    found = sent.groupBy("shard").applyInArrow(look_up, _REPLY)
    out = by_bucket.cogroup(live.unionByName(found).groupBy("bucket")).applyInArrow(cut, "__key long, n_words long, n_removed long, kept string, __copies long")
    nameless = map_text(every.where(F.col("__key").isNull()), "__text", "__key long, n_words long, n_removed long, kept string", _whole)
    return _repeated(out).unionByName(nameless).withColumnRenamed("__key", key)


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLES = {
    "op3_substring": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d
), g AS (
  SELECT doc_id, pos, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o
    || ' ' || lead(word, 5) OVER o || ' ' || lead(word, 6) OVER o || ' ' || lead(word, 7) OVER o || ' ' || lead(word, 8) OVER o
    || ' ' || lead(word, 9) OVER o || ' ' || lead(word, 10) OVER o || ' ' || lead(word, 11) OVER o || ' ' || lead(word, 12) OVER o AS win
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), f AS (
  SELECT win, min(doc_id) AS least FROM g WHERE win IS NOT NULL GROUP BY win
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM g JOIN f USING (win) WHERE least < doc_id
), kept AS (
  SELECT w.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY w.pos) AS kept FROM w ANTI JOIN gone USING (doc_id, pos) GROUP BY w.doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
}
QUERIES = {"op3_substring": op3_substring}
