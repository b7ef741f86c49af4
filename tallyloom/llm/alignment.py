"""Alignment of two tokenizers' tokens by union-find over the overlapping-token graph.

A text is encoded twice, as byte-level BPE (A) and as pieces (B); both cut the
same bytes, a space and the text.  The tokens of both sides are the nodes of a
bipartite graph and every pair that shares a byte is an edge.  Its connected
components, found by union-find, are exactly the smallest groups in which both
sides cover the same bytes.  Each edge is a link of two ids; how many rows of
the corpus hold an id pair linked is counted over the cluster.

Union-find runs on all documents of a slice at once: the higher of two roots is
hung under the lower for every edge that still joins two trees, and paths are
halved until they are flat.  The trees of a component at least halve in number
each round.

The distinct pairs of each row are written once to the shared folder with
their multiplicity; counting and scoring read them from there, so texts are
encoded once.  Pair counts are partial sums before the shuffle.  To score the
rows, the commonest pairs, HEAD at most, are broadcast with their counts, so
the rows of those pairs stay where they are; all other pairs, each of fewer
rows than the rarest of the head, are joined by a shuffle.

Cases: a null or empty text, and one whose joined tokens of either side differ
from a space and the text, has no tokens: zeros and empty groups.  The strings
of special tokens are plain text.  A row is a document: repeated rows and ids,
null ids too, count each.  An empty table gives an empty result; columns other
than key and text are ignored.  A text of any length is aligned whole; a
worker needs about 200 times the bytes of the longest, or of SLICE.
"""

from __future__ import annotations

import itertools
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.bpe import PATTERN, Encoder, default_vocabulary
from tallyloom.llm.common import map_text, new_folder, spread, table

#: Text bytes that are aligned at once; a longer text is a slice of its own.
SLICE = 1 << 20
#: Pairs whose counts are broadcast at most, the commonest first.
HEAD = 1 << 18
#: A pair's code is the id of A times this plus the id of B.
PAIR = 1 << 20


class ByteSide:
    """Byte-level BPE from a file of the `tokenizers` library, without its special tokens."""

    def __init__(self, definition: str):
        import tiktoken

        encoder = Encoder(definition)
        bytes_of = {i: b for i, b in encoder.bytes_of.items() if i not in encoder.special.values()}
        merged = [made for _, made in sorted(encoder.merges.values())]
        if merged != sorted(merged):
            raise ValueError("the ids of the vocabulary don't follow the order of its merges")
        self.encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks={b: i for i, b in bytes_of.items()}, special_tokens={})
        self.bytes_of = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(" " + text)


class PieceSide:
    """Pieces of a `sentencepiece` model, which puts a space before the text itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of tokens that share a byte, given where each side's tokens end in the same bytes.

    Between two neighbouring ends of either side lies one token of each, and no
    two such stretches lie in the same pair.
    """
    ends = np.concatenate([ends_a, ends_b])
    ends.sort(kind="stable")
    ends = ends[np.diff(ends, prepend=-1) > 0]
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


def union_find(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least node of each node's component in the graph of the edges (left, right)."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        root[np.maximum(a, b)] = np.minimum(a, b)
        while True:
            above = root[root]
            if np.array_equal(above, root):
                break
            root = above
    return root


class Aligner:
    """Both sides and what belongs to their ids."""

    def __init__(self, definition: str, model: bytes):
        self.sides = ByteSide(definition), PieceSide(model)
        self.sizes = [np.array([len(b) for b in s.bytes_of], np.int64) for s in self.sides]
        self.names = [np.array([str(i) for i in range(len(s.bytes_of))], object) for s in self.sides]
        if len(self.names[1]) > PAIR:
            raise ValueError("the vocabulary of pieces is too large")

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        if not text:
            return [], []
        ids, raw = [s.encode(text) for s in self.sides], (" " + text).encode()
        same = all(b"".join(map(s.bytes_of.__getitem__, x)) == raw for s, x in zip(self.sides, ids, strict=True))
        return (ids[0], ids[1]) if same else ([], [])

    def align(self, texts: list[str | None]) -> dict[str, list | np.ndarray]:
        """For each text: tokens of A and B, groups, links, the groups written out, and distinct pairs with their number of links."""
        encoded, docs = [self.encode(t) for t in texts], len(texts)
        count = [np.array([len(x[s]) for x in encoded], np.int64) for s in (0, 1)]
        ids = [np.fromiter(itertools.chain.from_iterable(x[s] for x in encoded), np.int64, int(c.sum())) for s, c in enumerate(count)]
        del encoded
        a, b = overlaps(*[np.cumsum(size[x]) for size, x in zip(self.sizes, ids, strict=True)])
        n_a = len(ids[0])
        root = union_find(n_a + len(ids[1]), a, n_a + b)
        # both sides of a component are stretches, so components in order are numbered by where the root changes
        group = [np.cumsum(np.diff(r, prepend=-1) != 0) - 1 for r in (root[:n_a], root[n_a:])]
        doc = [np.repeat(np.arange(docs), c) for c in count]
        links = np.bincount(doc[0][a], minlength=docs)
        starts = np.flatnonzero(np.diff(group[0], prepend=-1))
        groups = np.bincount(doc[0][starts], minlength=docs)
        codes, times = np.unique((doc[0][a] << 40) | (ids[0][a] * PAIR + ids[1][b]), return_counts=True)
        return {"n_a": count[0], "n_b": count[1], "n_groups": groups, "n_links": links, "groups": self._written(ids, group, count), "distinct": np.bincount(codes >> 40, minlength=docs), "pairs": codes & ((1 << 40) - 1), "times": times}

    def _written(self, ids: list[np.ndarray], group: list[np.ndarray], count: list[np.ndarray]) -> list[str]:
        """a1,a2|b1;a3|b2,b3: groups in order, ids of A and then of B."""
        place = np.concatenate([2 * group[0], 2 * group[1] + 1])
        order = np.argsort(place, kind="stable")
        place = place[order]
        parts = np.empty(2 * len(order), object)
        parts[0::2] = np.concatenate([n[x] for n, x in zip(self.names, ids, strict=True)])[order]
        parts[1::2] = np.array([",", "|", ";"], object)[np.diff(place, append=-1).clip(-1, 1) * (1 + place % 2)]
        ends = 2 * np.cumsum(count[0] + count[1])
        return ["".join(parts[e - 2 * n : max(e - 1, 0)].tolist()) if n else "" for e, n in zip(ends.tolist(), (count[0] + count[1]).tolist(), strict=True)]


_loaded: dict[int, Aligner] = {}


def _aligner(definition, model) -> Aligner:
    """The aligner of broadcast vocabularies, built once a worker."""
    key = hash((definition.value, model.value))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Aligner(definition.value, model.value)
    return _loaded[key]


def align_documents(df: DataFrame, vocabulary: str, pieces: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, groups, pairs, times) of each row.

    groups: the ids of each group, written as `a1,a2|b1;a3|b2,b3`; pairs: the
    distinct linked id pairs as a * PAIR + b; times: links of each.  Both
    vocabulary files are broadcast: their sizes are fixed, 2 MB here.
    """
    context = df.sparkSession.sparkContext
    definition, model = context.broadcast(Path(vocabulary).read_text(encoding="utf-8")), context.broadcast(Path(pieces).read_bytes())

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _aligner(definition, model).align(batch.column(1).to_pylist())
        offsets = pa.array(np.concatenate([[0], np.cumsum(x["distinct"])]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[c].astype(t))) for c, t in (("pairs", np.int64), ("times", np.int32))]
        columns = [batch.column(0), *[pa.array(x[c].astype(np.int64)) for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(x["groups"], pa.string()), *lists]
        return pa.RecordBatch.from_arrays(columns, ["__key", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    kind = rows.schema["__key"].dataType.simpleString()
    out = map_text(rows, "__text", f"__key {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>", work, SLICE)
    return out.withColumnRenamed("__key", key)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, a, b, documents, best) of each linked id pair: the rows that hold it, and whether no other pair of its A id has more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("documents"))
    counts = counts.withColumns({"a": F.shiftright("pair", 20), "b": F.col("pair") % PAIR})
    most = counts.groupBy("a").agg(F.max("documents").alias("__most"))
    return counts.join(most, "a").select("pair", "a", "b", "documents", (F.col("documents") == F.col("__most")).alias("best"))


def _head_from(counts: DataFrame, most: int) -> int:
    """The least number of rows from which pairs are in the head, so that it has at most `most`: of 64 powers of two."""
    sizes = counts.groupBy(F.floor(F.log2("documents")).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, total = 1 << 62, 0
    for p, n in sorted(((r.p, r.n) for r in sizes), reverse=True):
        total += n
        if total > most:
            break
        least = 1 << p
    return least


def scored(aligned: DataFrame, counts: DataFrame, row: str, head: int = HEAD) -> DataFrame:
    """(row, n_best, count_sum) of each row that has links; `row` names the rows of `aligned`."""
    least = _head_from(counts, head)
    links = aligned.select(row, F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(row, F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    known = counts.select("pair", "documents", "best")
    common, rare = F.broadcast(known.where(F.col("documents") >= least)), known.where(F.col("documents") < least)
    sums = (F.sum(F.col("times") * F.col("best").cast("int")).alias("n_best"), F.sum(F.col("times") * F.col("documents")).alias("count_sum"))
    found = links.join(common, "pair").groupBy(row).agg(*sums)
    if rare.isEmpty():
        return found
    others = links.join(common.select("pair"), "pair", "left_anti").join(rare, "pair").groupBy(row).agg(*sums)
    return found.union(others).groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def digests(df: DataFrame, vocabulary: str, pieces: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row."""
    spark = df.sparkSession
    place, counted = new_folder(spark, "alignment"), new_folder(spark, "alignment-pairs")
    own = align_documents(df, vocabulary, pieces, key, text).withColumnRenamed(key, "__key")
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    own.withColumns({"groups_sha256": digest, "__row": F.monotonically_increasing_id()}).drop("groups").write.parquet(place)
    aligned = spark.read.parquet(place)
    pair_counts(aligned).write.parquet(counted)
    scores = scored(aligned, spark.read.parquet(counted), "__row")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return aligned.join(scores, "__row", "left").select(F.col("__key").alias(key), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spread(table(spark, sf_dir, "documents")), default_vocabulary(), default_pieces())


ORACLES: dict[str, str] = {}
QUERIES = {"op11_alignment": op11_alignment}
