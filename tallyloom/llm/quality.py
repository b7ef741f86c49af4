"""Quality scores by co-training a text view and a page-metadata view.

The text view is hashed byte n-grams of the whole text, case and signs
included, and its make-up; the metadata view is the page's source, language and size: characters,
bytes a character, lines.  Each view has a linear SVM.  In each round either
machine judges every unlabelled document; those beyond its margin are its
marks, and the other one learns from a bounded draw of them too, in the
classes' own proportion.  Both are then calibrated, and combined by a logistic
regression, on labelled rows that neither was trained on: rows of fold 2 are
no training rows, labelled or marked.

Training takes at most SAMPLE labelled rows of each class and MARKS marks of
each machine and round, on average, drawn by a hash; a round reads all
documents once, and all are scored, over whole texts.

Cases: null and empty texts have no n-grams and are judged by the rest; null
metadata is a value of its own; without labels of both classes every document
gets score 1 and is kept; repeated rows are scored alike, and of the texts of
a repeated labelled id the least one teaches; an empty table gives an empty
result; labels that are null or have no document teach nothing; extra columns
are ignored, or kept by `accepted`.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import broadcast_if_small, checkpointed, fold, map_text, share_hash, slices, spread, table
from tallyloom.llm.features import DIMENSIONS, fit_logistic, fit_platt, ngram_features, sigmoid, train_svm

#: Labelled rows of each class, and marks of each machine and round, to train on, at most on average.
SAMPLE, MARKS, ROUNDS = 700, 300, 2
#: The margin beyond which a machine is sure.
SURE = 1.0
#: Keys of labelled rows up to which they are broadcast.
FEW = 200_000
THRESHOLD = 0.5
#: Bytes below which n-grams are damped, and further columns of the text view: shares of kinds of byte, repetition, word length.
SHORT, SHAPE = 400, 6
#: Small letters, capitals, digits and signs; bytes above ASCII count as small letters, white space as such too.
_KINDS = np.array([0 if b >= 128 or chr(b).islower() or chr(b).isspace() else 1 if chr(b).isupper() else 2 if chr(b).isdigit() else 3 for b in range(256)])
#: Slots that the values of source and of language are hashed into.
SOURCES, LANGS = 64, 32


def text_features(texts: list[str | None]) -> np.ndarray:
    """N-grams, damped in texts so short that a few of them are the whole vector, and the make-up of the text."""
    out = np.zeros((len(texts), DIMENSIONS + SHAPE), np.float32)
    out[:, :DIMENSIONS] = ngram_features(texts, False)
    for row, t in zip(out, texts, strict=True):
        t = t or ""
        raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
        row[:DIMENSIONS] *= min(1.0, (len(raw) / SHORT) ** 0.5)
        if len(raw):
            words = t.split()
            kinds = np.bincount(_KINDS[raw], minlength=4) / len(raw)
            row[DIMENSIONS:-2] = np.sqrt(kinds)
            row[-2] = 1 - len(set(words)) ** 0.5 / max(1, len(words)) ** 0.5
            row[-1] = min(1.0, sum(map(len, words)) / max(1, len(words)) / 20)
    return out


def metadata_features(source: list, lang: list, texts: list[str | None]) -> np.ndarray:
    """Hashed source and language, and the size and layout of the page."""
    out = np.zeros((len(texts), SOURCES + LANGS + 4), np.float32)
    for row, s, g, t in zip(out, source, lang, texts, strict=True):
        t = t or ""
        n, lines, size = len(t), t.count("\n") + 1, len(t.encode("utf-8", "surrogatepass"))
        row[zlib.crc32(repr(s).encode("utf-8", "surrogatepass")) % SOURCES] = 1
        row[SOURCES + zlib.crc32(repr(g).encode("utf-8", "surrogatepass")) % LANGS] = 1
        row[-4:] = np.log1p(n) / 10, np.log1p(lines) / 5, np.log1p(n / lines) / 10, size / max(1, n) - 1
    return out


class _View:
    """A linear SVM and its Platt scaling."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.w = train_svm(x, np.where(y > 0, 1.0, -1.0), cost=30.0).astype(np.float32)
        self.platt = (2.0, 0.0)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.w[:-1] + self.w[-1]).astype(np.float64)

    def logit(self, x: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return np.clip(a * self.margin(x) + b, -15, 15)


class QualityModel:
    def __init__(self, views: tuple[_View, _View] | None = None, combined: np.ndarray | None = None):
        self.views, self.combined = views, combined

    def score(self, texts: list[str | None], source: list, lang: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of high quality by text, by metadata and by both."""
        if self.views is None:
            return (np.ones(len(texts)),) * 3
        logits = np.stack([self.views[0].logit(text_features(texts)), self.views[1].logit(metadata_features(source, lang, texts))], axis=1)
        both = sigmoid(logits @ self.combined[:-1] + self.combined[-1])
        return sigmoid(logits[:, 0]), sigmoid(logits[:, 1]), both


#: What a round of marking gives: features of both views, and what each view's machine learns of each row: +1, -1 or 0 for nothing.
Marks = tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def co_train(labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, held: np.ndarray, mark: Callable[[tuple[_View, _View], float, int], Marks], odds: float, rounds: int = ROUNDS) -> QualityModel:
    """labelled: features of both views; y: 0 or 1; held: rows for calibration only; mark: the marks of two machines at a share of class 1 in a round; odds: of class 1 among all labels, as the sample has its own."""
    if min(y.sum(), len(y) - y.sum()) < 1:
        return QualityModel()
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:  # too few labels to hold any back
        held, train = np.ones(len(y), bool), np.ones(len(y), bool)
    else:
        train = ~held
    x, sign = [[v[train]] for v in labelled], [[y[train] * 2 - 1], [y[train] * 2 - 1]]
    for k in range(rounds + 1):
        views = tuple(_View(np.concatenate(a), np.concatenate(b)) for a, b in zip(x, sign, strict=True))
        if k < rounds:
            for more, taught, a, b in zip(*mark(views, float(y[train].mean()), k), x, sign, strict=True):
                a.append(more[taught != 0])
                b.append(taught[taught != 0])
    for view, v in zip(views, labelled, strict=True):
        view.platt = fit_platt(view.margin(v[held]), y[held])
    logits = np.stack([w.logit(v[held]) for w, v in zip(views, labelled, strict=True)], axis=1)
    combined = fit_logistic(logits, y[held])
    combined[-1] += np.log(odds) - np.log(y[held].sum() / (1 - y[held]).sum())
    return QualityModel(views, combined)


def _inputs(df: DataFrame, text: str, source: str, lang: str, *more) -> DataFrame:
    return df.select(F.col(text).alias("__text"), F.col(source).cast("string").alias("__source"), F.col(lang).cast("string").alias("__lang"), *more)


def _features(rows: DataFrame, also: str) -> list:
    """Features of rows (__text, __source, __lang and those that `also` declares), at the driver; `rows` are few."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, sources, langs = (batch.column(i).to_pylist() for i in range(3))
        x = [a.tobytes() + b.tobytes() for a, b in zip(text_features(texts), metadata_features(sources, langs, texts), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(x, pa.binary())], [*batch.schema.names[3:], "x"])

    return map_text(rows, "__text", f"{also}, x binary", work).collect()


def _views(found: list) -> tuple[np.ndarray, np.ndarray]:
    wide = SOURCES + LANGS + 4
    x = np.array([np.frombuffer(r["x"], np.float32) for r in found]) if found else np.zeros((0, DIMENSIONS + SHAPE + wide), np.float32)
    return x[:, :-wide], x[:, -wide:]


def margins(rows: DataFrame, views: tuple[_View, _View]) -> DataFrame:
    """(__key, __row, text, metadata): both machines' margins of every one of the rows (__text, __source, __lang, __key, __row)."""
    sent = rows.sparkSession.sparkContext.broadcast(views)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, sources, langs = (batch.column(i).to_pylist() for i in range(3))
        x = text_features(texts), metadata_features(sources, langs, texts)
        return pa.RecordBatch.from_arrays([*batch.columns[3:], *(pa.array(v.margin(f), pa.float64()) for v, f in zip(sent.value, x, strict=True))], ["__key", "__row", "text", "metadata"])

    return map_text(rows, "__text", f"__key {rows.schema['__key'].dataType.simpleString()}, __row long, text double, metadata double", work)


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", label: str = "quality", sample: int = SAMPLE, marks: int = MARKS) -> QualityModel:
    """Fit on a bounded sample of the labelled `documents` and on marks of all others."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(label).alias("__y"))
    counts = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    if len(counts) < 2:
        return QualityModel()
    whole = F.struct("__text", "__source", "__lang")
    rows = _inputs(documents, text, source, lang, F.col(key).alias("__key"))
    share = F.when(F.col("__y") == 1, F.lit(min(1.0, sample / counts[1]))).otherwise(F.lit(min(1.0, sample / counts[0])))
    drawn = known.where(share_hash(F.col("__key"), 8) < share)
    # at most 2 * SAMPLE keys: fit for a broadcast; of a key's rows one is left before anything is moved
    taught = rows.join(F.broadcast(drawn), "__key").groupBy("__key").agg(F.min(whole).alias("w"), F.first("__y").cast("int").alias("__y"))
    held_out = F.coalesce(fold(F.col("__key")) == 2, F.lit(False))
    found = _features(taught.select("w.*", F.col("__key").cast("string").alias("__key"), "__y", held_out.alias("__held")), "__key string, __y int, __held boolean")
    found.sort(key=lambda r: r["__key"])
    y, held = np.array([r["__y"] for r in found], np.float64), np.array([r["__held"] for r in found], bool)
    # rows are told apart by their content, as a key may be null or repeat
    free = rows.where(~held_out).withColumn("__row", F.xxhash64("__key", "__text", "__source", "__lang"))
    labelled_keys = broadcast_if_small(known.select("__key"), FEW)

    def mark(views: tuple[_View, _View], rate: float, k: int) -> Marks:
        sure = (F.abs("text") > SURE) | (F.abs("metadata") > SURE)
        judged = checkpointed(margins(free, views).where(sure).join(labelled_keys, "__key", "left_anti"))
        sides = [(m, s) for m in ("text", "metadata") for s in (1, -1)]
        beyond = {(m, s): F.col(m) * s > SURE for m, s in sides}
        many = judged.agg(*[F.count_if(beyond[x]).alias(f"{x[0]}{x[1]}") for x in sides]).first()
        draw = share_hash(F.col("__row"), 90 + k)
        wanted = {(m, s): marks * (rate if s > 0 else 1 - rate) / max(1, many[f"{m}{s}"]) for m, s in sides}
        sign = lambda m: F.when(beyond[m, 1] & (draw < wanted[m, 1]), 1).when(beyond[m, -1] & (draw < wanted[m, -1]), -1).otherwise(0)
        chosen = judged.select("__row", sign("text").alias("by_text"), sign("metadata").alias("by_metadata")).where("by_text != 0 or by_metadata != 0").distinct()
        # some 2 * MARKS rows: fit for a broadcast
        one = free.join(F.broadcast(chosen), "__row").groupBy("__row", "by_text", "by_metadata").agg(F.min(whole).alias("w"))
        told = _features(one.select("w.*", "__row", "by_text", "by_metadata"), "__row long, by_text int, by_metadata int")
        told.sort(key=lambda r: r["__row"])
        by_text, by_metadata = (np.array([r[c] for r in told], np.float64) for c in ("by_text", "by_metadata"))
        return _views(told), (by_metadata, by_text)  # each machine learns what the other one marked

    return co_train(_views(found), y, held, mark, counts[1] / counts[0])


def score(df: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """key, text_score, metadata_score, score and keep of each row."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = sent.value.score(*(batch.column(i).to_pylist() for i in range(3)))
        return pa.RecordBatch.from_arrays([batch.column(3), *(pa.array(f, pa.float64()) for f in found)], [key, "text_score", "metadata_score", "score"])

    rows = _inputs(df, text, source, lang, F.col(key).alias(key))
    kind = rows.schema[key].dataType.simpleString()
    return map_text(rows, "__text", f"{key} {kind}, text_score double, metadata_score double, score double", work).withColumn("keep", F.col("score") >= THRESHOLD)


def accepted(df: DataFrame, model: QualityModel, text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """The rows of `df`, all columns, that the model keeps."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                _, _, both = sent.value.score(*(part.column(c).to_pylist() for c in (text, source, lang)))
                yield part.filter(pa.array(both >= THRESHOLD, pa.bool_()))

    return df.mapInArrow(clean, df.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents"))
    return score(documents, fit(documents, table(spark, sf_dir, "labels")))


ORACLES: dict[str, str] = {}
QUERIES = {"op8_quality": op8_quality}
