"""Language identification by hierarchical discrimination.

A first set of linear SVMs, one against the rest, picks the language family of
a text; within it, one-versus-one linear SVMs for each pair of its languages
vote.  Features are hashed byte n-grams of the whole lower-cased text with all
ASCII but letters blanked.

Training takes at most SAMPLE labelled rows in all, shared evenly by the
languages and drawn by a hash of the key; their feature vectors (16 KB each)
go to the driver, which fits the models.

Cases: a text that is null or has no letter is `und` with score 0, as is every
text if nothing was labelled; with one labelled language that is the answer;
labels that are null teach nothing; repeated rows are predicted alike; very
long texts are counted whole; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import fold, map_text, share_hash, spread, table
from tallyloom.llm.features import ngram_features, sigmoid, train_svm

#: Labelled rows that the models are fitted on, at most on average.
SAMPLE = 2000
UNKNOWN = "und"

# Families of related languages by ISO 639-1 code; a code that is missing here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "semitic": "ar he mt am",
    "indic": "hi ur bn mr gu pa ne si",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv",
    "celtic": "ga cy gd br",
}
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter of any script; the pattern also finds other numerals, such as superscripts."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text or ""))


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.lower().split("-")[0] in codes.split()), lang)


class LanguageModel:
    """Weights of the family SVMs and of the pair SVMs, as columns of one matrix."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        self.langs = sorted(set(langs.tolist()))
        self.members: dict[str, list[str]] = {}
        for lang in self.langs:
            self.members.setdefault(family_of(lang), []).append(lang)
        self.families = sorted(self.members)
        columns, self.pairs = [], []
        family = np.array([family_of(x) for x in langs.tolist()])
        if len(self.families) > 1:
            columns += [train_svm(x, np.where(family == f, 1.0, -1.0)) for f in self.families]
        for f in self.families:
            for a, b in itertools.combinations(self.members[f], 2):
                rows = (langs == a) | (langs == b)
                columns.append(train_svm(x[rows], np.where(langs[rows] == a, 1.0, -1.0)))
                self.pairs.append((a, b))
        self.weights = np.array(columns, np.float32).T if columns else None

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = np.array([has_letter(t) for t in texts], bool)
        n = len(texts)
        scores = {lang: np.ones(n) for lang in self.langs}
        if self.weights is not None:
            margins = ngram_features(texts) @ self.weights[:-1] + self.weights[-1]
            k = len(self.families) if len(self.families) > 1 else 0
            top = np.zeros(n, int)
            share = np.ones((n, 1))
            if k:
                share = np.exp(3.0 * (margins[:, :k] - margins[:, :k].max(1, keepdims=True)))
                share /= share.sum(1, keepdims=True)
                top = share.argmax(1)
            votes = {lang: np.zeros(n) for lang in self.langs}
            for (a, b), m in zip(self.pairs, margins[:, k:].T, strict=True):
                p = sigmoid(3.0 * m)
                votes[a] += p
                votes[b] += 1 - p
            for f, name in enumerate(self.families):
                inside = self.members[name]
                for lang in inside:
                    within = votes[lang] * 2 / (len(inside) * (len(inside) - 1)) if len(inside) > 1 else 1.0
                    scores[lang] = np.where(top == f, share[:, f] * within, -1.0)
        table_ = np.array([scores[lang] for lang in self.langs])
        best = table_.argmax(0)
        return [self.langs[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, np.clip(table_.max(0), 0, 1), 0.0)


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Fit on a bounded sample of the rows of `labelled` whose language isn't null."""
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.col(lang).alias("__lang"))
    counts = {r["__lang"]: r["count"] for r in rows.groupBy("__lang").count().collect()}
    if not counts:
        return LanguageModel(np.zeros((0, 1)), np.array([], object))
    each = max(1, sample // len(counts))
    share = F.create_map(*[F.lit(x) for lang_, n in sorted(counts.items()) for x in (lang_, min(1.0, each / n))])
    drawn = rows.where(share_hash(F.col("__key"), 4) < F.element_at(share, F.col("__lang")))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = ngram_features([t or "" for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["__key", "__lang", "x"])

    kind = rows.schema["__key"].dataType.simpleString()
    found = map_text(drawn, "__text", f"__key {kind}, __lang string, x binary", work).collect()
    found.sort(key=lambda r: (str(r["__key"]), r["__lang"], bytes(r["x"])))
    if not found:
        return LanguageModel(np.zeros((0, 1)), np.array([], object))
    return LanguageModel(np.array([np.frombuffer(r["x"], np.float32) for r in found]), np.array([r["__lang"] for r in found], object))


def predict(df: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", also: dict[str, Column] | None = None) -> DataFrame:
    """key, lang_pred and score of each row, and the columns of `also`."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = sent.value.predict(batch.column(0).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[1:], "lang_pred", "score"])

    rows = df.select(F.col(text).alias("__text"), F.col(key).alias(key), *[c.alias(n) for n, c in (also or {}).items()])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return map_text(rows, "__text", f"{kept}, lang_pred string, score double", work)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents"))
    out = F.coalesce(fold("doc_id") == 2, F.lit(False))
    model = fit(documents.where(~out))
    return predict(documents, model, also={"held_out": out})


ORACLES: dict[str, str] = {}
QUERIES = {"op4_language": op4_language}
