"""Toxicity scores from a subsequence string kernel with Nyström landmarks.

The kernel of two words is the product of their counts of common
three-letter subsequences, those within five letters, each gap weighing GAP;
so a word still resembles itself with letters inserted ("idxiot").  It is
divided by the roots of the words' lengths.  Landmarks are words of the
labelled texts; the support vector machine is trained in the space that they
span.  As the kernel has explicit features, a trained machine is one weight
for each of 64^3 subsequences: a text of any length is scored by table
look-ups over its bytes, which gives what the landmark sum would.

A text is read in two ways.  In the one, words are runs of letters and digits.
In the other, signs between letters are gaps of no weight ("id.iot",
"i**d**i**o**t"), and letters that stand alone one after another are one word
("i d i o t").  Digits and signs that look like letters are read as them.

Two machines judge a text.  A score is the higher of what the first says alone
and of what a logistic regression makes of both.

The one takes the text as a sentence: the mean of its words' features, each
subsequence scaled by the root of how often it occurs.  Its landmarks are
labelled texts.  It learns what shows in how often something is said.  A text
of few words is drawn towards the mean of all.

The other looks for an insult, a word or two.  Training therefore looks for the witness in each toxic text: at first the word with
the piece that most sets toxic texts apart, in later rounds the word with the
highest margin.  A witness weighs by the toxic texts that hold it, and copies
of it with one and two letters put in weigh alike; a clean word weighs by the
clean texts.  A text's margin is that of its worst word, in any of its
sentences.

The first machine's scaling and the regression are fitted on its margins on
texts that didn't teach it, the regression on clean texts that didn't teach the
second one either.  With too few labels for that, the worst word alone counts.

Training takes at most SAMPLE toxic and CLEAN times as many clean texts on
average, drawn by a hash of the key, with all their words; scores cover whole
texts.

Cases: null and empty texts have no word and get the score of an empty text;
without labels of both classes every score is 0; repeated rows are scored
alike, and of the texts of a repeated labelled id the least one teaches; an
empty table gives an empty result; labels that are null or have no document
teach nothing; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import fold, map_text, share_hash, spread, table
from tallyloom.llm.features import fit_platt, newton_svm, sigmoid

#: Toxic texts to train on, at most on average, and how many times as many clean ones; the insult machine learns from SAMPLE of these or two thirds, the others judge.
SAMPLE, CLEAN = 800, 4
#: Bounds of the training set: landmarks, words of either class, witnesses that get letters put in, hardest clean words
#: that a round adds; rounds, and words by which near copies of a text are told.
LANDMARKS, EXAMPLES, BENT, HARDEST, ROUNDS, SKETCH = 300, 6000, 100, 1000, 4, 16
#: Words whose subsequences are held at once, and subsequences multiplied at once.
WORDS, ENTRIES = 50_000, 1 << 15
#: Landmarks of the sentence machine, folds that set its scaling, words of no account that a text is filled up with, texts that
#: have to hold a subsequence, its least rate, and the machine's cost.
TEXT_LANDMARKS, FOLDS, FILLED, HELD, RATE, COST = 1000, 4, 30, 3, 1e-5, 1e5
#: Texts of either class below which only the worst word counts: from fewer a machine over whole texts can't be told from chance.
LEAST = 100
#: Weight of each letter that a subsequence skips.
GAP = 0.6
THRESHOLD = 0.3
#: Bytes of a text that are scored at once; cuts are made at white space.
PIECE = 1 << 20
#: The offsets of the second and third letter, and the letters skipped.
SUBSEQUENCES = tuple((i, j, j - 2) for j in (2, 3, 4) for i in range(1, j))

# Digits and signs that stand for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
BLANK, MARK = 0, 63


def _symbol(byte: int) -> int:
    c = LOOKALIKES.get(chr(byte), chr(byte)).lower()
    if byte in b" \t\n\r\x0b\x0c":
        return BLANK
    if byte >= 128:
        return 27 + byte % 32
    return ord(c) - 96 if "a" <= c <= "z" else 59 + byte % 4 if c.isdigit() else MARK


_SYMBOLS = bytes(map(_symbol, range(256)))
#: Bytes that consecutive pieces of a long text share, so that what is read together stands whole in one of them.
OVERLAP = 256


def _words_of(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and place after the last of each run of letters."""
    edge = np.flatnonzero(np.diff((s != BLANK) & (s != MARK), prepend=False, append=False))
    return edge[::2], edge[1::2]


def _parted(s: np.ndarray) -> list[bytes]:
    """The words that signs part, without the signs."""
    marks = np.flatnonzero(s == MARK)
    if not len(marks):
        return []
    new = np.diff(marks, prepend=-2) > 1
    first, last = marks[new], marks[np.append(np.flatnonzero(new)[1:] - 1, len(marks) - 1)]
    letter = np.zeros(len(s) + 2, bool)  # of the place before each one
    letter[1:-1] = (s != BLANK) & (s != MARK)
    inner = letter[first] & letter[last + 2]
    if not inner.any():
        return []
    first, last = first[inner], last[inner]
    gone = np.zeros(len(s) + 1, np.int64)
    gone[first] += 1
    gone[last + 1] -= 1
    whole = s[np.cumsum(gone[:-1]) == 0]
    begin, end = _words_of(whole)
    at = first - (np.cumsum(last - first + 1) - (last - first + 1))  # where the signs stood, in the shorter text
    return [whole[begin[w] : end[w]].tobytes() for w in np.unique(np.searchsorted(begin, at, side="right") - 1)]


def _spaced(s: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    """Three or more letters that stand alone one after another, as one word."""
    lone = np.diff(end - begin == 1, prepend=False, append=False)
    edge = np.flatnonzero(lone)
    return [s[begin[a:b]].tobytes() for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a > 2]


def _symbols(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(_SYMBOLS)


def _readings(raw: bytes) -> tuple[bytes, bytes]:
    """Symbols as words parted by blanks: the runs of letters, and the words that signs or blanks part."""
    s = np.frombuffer(raw, np.uint8)
    plain = np.where(s == MARK, np.uint8(BLANK), s)
    return plain.tobytes(), bytes([BLANK]).join(_parted(s) + _spaced(plain, *_words_of(plain)))


def units(text: str) -> set[bytes]:
    """The distinct words of both readings."""
    return {u for reading in _readings(_symbols(text)) for u in reading.split(bytes([BLANK])) if u}


class _Words:
    """The subsequences of words, each between two blanks: `row`, `code` and `value` of each occurrence, by row."""

    def __init__(self, words: list[bytes]):
        s = np.frombuffer(b"\0" + b"\0\0".join(words) + b"\0" * 5, np.uint8).astype(np.int32)
        lengths = np.array([len(w) + 2 for w in words], np.int64)
        ends = np.cumsum(lengths)
        row = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        room = np.repeat(ends, lengths) - np.arange(len(row)) - 1
        scale = np.repeat(lengths**-0.5, lengths)
        rows, codes, values = [], [], []
        for i, j, gaps in SUBSEQUENCES:
            at = np.flatnonzero(room >= j)
            rows.append(row[at])
            codes.append((s[at] << 12) | (s[at + i] << 6) | s[at + j])
            values.append((scale[at] * GAP**gaps).astype(np.float32))
        order = np.argsort(np.concatenate(rows), kind="stable")
        self.row, self.code, self.value = (np.concatenate(x)[order] for x in (rows, codes, values))
        self.n = len(words)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.code], self.n)

    def kernel(self, landmarks: _Words) -> np.ndarray:
        """A row for each word: its subsequences that landmarks have, times the landmarks' counts of them."""
        held, place = np.unique(landmarks.code, return_inverse=True)
        table = np.zeros((len(held), landmarks.n), np.float32)
        np.add.at(table, (place, landmarks.row), landmarks.value)
        where = np.full(1 << 18, -1, np.int32)
        where[held] = np.arange(len(held))
        at = np.flatnonzero(where[self.code] >= 0)
        row, code, value = self.row[at], where[self.code[at]], self.value[at]
        out = np.zeros((self.n, landmarks.n), np.float32)
        for i in range(0, len(row), ENTRIES):
            part = slice(i, i + ENTRIES)
            new = np.flatnonzero(np.diff(row[part], prepend=-1))
            out[row[part][new]] += np.add.reduceat(table[code[part]] * value[part, None], new, axis=0)
        return out


class ToxicityModel:
    def __init__(self, weights: np.ndarray | None = None, bias: float = 0.0, platt: tuple[float, float] = (0.0, 0.0)):
        self.weights, self.bias, self.platt = weights, bias, platt
        #: The sentence machine, weights and bias, what the two margins, kept within bounds, weigh, and the first one's scaling; none if it could not be trained.
        self.sentence: tuple[np.ndarray, float] | None = None
        self.both: tuple[np.ndarray, np.ndarray, np.ndarray, tuple[float, float]] | None = None

    def margin(self, text: str) -> float:
        return self.margins(text)[0]

    def margins(self, text: str) -> tuple[float, float]:
        """The highest margin of a word of the text in either reading, or of the empty word if there is none, and the margin of the text as a sentence."""
        raw, best, begin, counted = _symbols(text), float(self.bias), 0, 0
        total, words = 0.0, 0
        blank = bytes([BLANK])
        while begin < len(raw):
            end = min(len(raw), begin + PIECE)
            if end < len(raw):
                cut = raw.rfind(blank, begin, end)
                end = cut if cut > begin else end
            plain, parted = _readings(raw[begin:end])
            worst, part, n = self._piece(plain, counted - begin)
            best, total, words, counted = max(best, worst, self._piece(parted, len(parted))[0]), total + part, words + n, end
            if end == len(raw):
                break
            again = raw.find(blank, max(begin + 1, end - OVERLAP), end)
            begin = again if again > begin else end
        return best, total / (words + FILLED) + self.sentence[1] if self.sentence else 0.0

    def _piece(self, raw: bytes, skip: int) -> tuple[float, float, int]:
        """The highest margin of a word, and, of the words that begin from `skip` on, the sum for the sentence and the number."""
        s = np.frombuffer(b"\0" + raw + b"\0\0\0\0\0", np.uint8)
        n = len(s) - 4
        wide = s.astype(np.int32)
        first = wide[:n] << 12
        # a subsequence belongs to the word that it starts in, the blank before the word included
        total, said = np.zeros(n, np.float32), np.zeros(n, np.float32)
        as_sentence = self.sentence is not None and skip < len(raw)
        letter = s != BLANK
        starts = np.flatnonzero(letter[1:n] & ~letter[: n - 1]) + 1
        if not len(starts):
            return -1e9, 0.0, 0
        ends_in = np.flatnonzero(~letter)
        limit = ends_in[np.searchsorted(ends_in, np.arange(1, n + 1))]
        room = limit - np.arange(n)
        for i, j, gaps in SUBSEQUENCES:
            code = first | (wide[i : n + i] << 6) | wide[j : n + j]
            part = self.weights[code]
            if gaps:
                part = part * np.float32(GAP**gaps)
            total += np.where(room >= j, part, np.float32(0))
            if as_sentence:
                said += np.where(room >= j, self.sentence[0][code] * np.float32(GAP**gaps), np.float32(0))
        begins = starts - 1
        sums = np.add.reduceat(total, begins)
        root = np.sqrt(limit[begins] - begins + 1)
        new = begins >= skip
        of_all = float((np.add.reduceat(said, begins) / root)[new].sum()) if as_sentence else 0.0
        return float((sums / root).max()) + self.bias, of_all, int(new.sum())

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        a, b = self.platt
        found = np.array([self.margins(t or "") for t in texts]).reshape(-1, 2)
        if self.both is None:
            return sigmoid(a * found[:, 0] + b)
        weights, low, high, (a, b) = self.both
        p, q = sigmoid(np.clip(found, low, high) @ weights[:-1] + weights[-1]), sigmoid(a * found[:, 1] + b)
        return np.maximum(p, q)


def _pieces(word: bytes) -> list[bytes]:
    s = b"\0" + word + b"\0"
    return [*{s[i : i + 4] for i in range(len(s) - 3)} | {s}]


def _separation(toxic: np.ndarray, clean: np.ndarray, n: tuple[int, int]) -> np.ndarray:
    """Log-likelihood ratio of document counts in toxic and clean texts; 0 for what is no commoner in toxic ones."""
    rate, g = (clean + toxic) / (n[0] + n[1]), np.zeros(len(toxic))
    with np.errstate(divide="ignore", invalid="ignore"):
        for k, m in ((clean, n[0]), (toxic, n[1])):
            for x, e in ((k, m * rate), (m - k, m * (1 - rate))):
                g += np.where((x > 0) & (e > 0), 2 * x * np.log(x / e), 0.0)
    # a rare word in clean texts is worth little, however often it is in toxic ones
    return np.where(toxic / n[1] > clean / n[0], g * (1 - np.minimum(1.0, 10 * clean / np.maximum(1, clean + toxic))), 0.0)


def _with_letters(word: bytes) -> list[bytes]:
    """The word with a letter put in, and with two, at each of its inner places; the letters follow from the word."""
    seed, out = zlib.crc32(word), []
    for a in range(1, len(word)):
        one = word[:a] + bytes([1 + (seed + 7 * a) % 26]) + word[a:]
        b = 1 + (a + 1 + seed) % (len(one) - 1)
        out += [one, one[:b] + bytes([1 + (seed // 26 + 11 * a) % 26]) + one[b:]]
    return out


def _without_copies(documents: list[tuple]) -> list[tuple]:
    """Near copies teach once: a text that shares half of the SKETCH words with the least hashes with an earlier one goes."""
    holders: dict[int, list[int]] = {}
    kept = []
    for document in documents:
        sketch = sorted(zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in document[0])[:SKETCH]
        shared = Counter(k for h in sketch for k in holders.get(h, ()))
        if shared and 2 * max(shared.values()) >= len(sketch):
            continue
        for h in sketch:
            holders.setdefault(h, []).append(len(kept))
        kept.append(document)
    return kept


def _held_by(documents: list[np.ndarray], n: int) -> np.ndarray:
    """How many of the documents, arrays of distinct numbers below n, hold each number."""
    return np.bincount(np.concatenate(documents), minlength=n).astype(float) if documents else np.zeros(n)


class _Vocabulary:
    """The words of the labelled texts, as numbers, and what sets each apart."""

    def __init__(self, documents: list[tuple[list[str], int]]):
        numbers: dict[bytes, int] = {}
        found = [(sorted(units(" ".join(words))), y) for words, y in documents]
        number = lambda us: np.array([numbers.setdefault(u, len(numbers)) for u in us], np.int64)
        held = {side: [number(us) for us, y in found if y == side and us] for side in (0, 1)}
        self.clean, self.toxic, self.words = held[0], held[1], list(numbers)
        n = len(self.words)
        self.in_clean, self.in_toxic = _held_by(self.clean, n), _held_by(self.toxic, n)
        if not self.toxic or not self.clean:
            return
        pieces: dict[bytes, int] = {}
        of_word = [np.array([pieces.setdefault(p, len(pieces)) for p in _pieces(w)], np.int64) for w in self.words]
        count = lambda side: _held_by([np.unique(np.concatenate([of_word[i] for i in d])) for d in side], len(pieces))
        toxic, clean = count(self.toxic), count(self.clean)
        apart = np.where(toxic > 2, _separation(toxic, clean, (len(self.clean), len(self.toxic))), 0.0)  # rarer ones can't stand out
        #: What the best of so many pieces reaches by chance.
        self.chance = 2.0 * np.log(max(2, np.count_nonzero(toxic)))
        free = self.in_clean == 0
        self.value = np.where(free, [apart[p].max() for p in of_word], 0.0)
        self.whole = np.where(free, [apart[pieces[b"\0" + w + b"\0"]] for w in self.words], 0.0)

    def margins(self, weights: np.ndarray) -> np.ndarray:
        parts = [_Words(self.words[i : i + WORDS]).times(weights) for i in range(0, len(self.words), WORDS)]
        return np.concatenate(parts)


def _best(documents: Iterable[np.ndarray], margin: np.ndarray) -> np.ndarray:
    """The word of each document with the highest margin."""
    return np.array([d[np.argmax(margin[d])] for d in documents], np.int64)


def said_in(text: str) -> Counter[bytes]:
    """How often each word of the plain reading occurs."""
    return Counter(w for w in _readings(_symbols(text))[0].split(bytes([BLANK])) if w)


#: The distinct words of a text's plain reading and how often each occurs.
Said = tuple[list[bytes], np.ndarray]


def _sentence_machine(said: list[Said], y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray] | None:
    """Weights of all subsequences and bias of the machine over texts as sentences, and each text's margin by a machine that it didn't teach."""
    if len(set(y.tolist())) < 2 or min(np.bincount(y)) < FOLDS:
        return None

    def rates(text: Said) -> tuple[np.ndarray, np.ndarray]:
        """The subsequences of a text and their rates, worked out anew where they are needed: all texts' at once would be large."""
        words = _Words(text[0])
        codes, place = np.unique(words.code, return_inverse=True)
        return codes, np.bincount(place, words.value * text[1][words.row], len(codes)) / (int(text[1].sum()) + FILLED)

    held, total = np.zeros(1 << 18, np.int32), np.zeros(1 << 18)
    for c in said:
        code, value = rates(c)
        held[code] += 1
        total[code] += value
    # what few texts hold weighs nothing
    scale = np.where(held >= HELD, 1 / np.sqrt(total / len(said) + RATE), 0.0).astype(np.float32)
    used = np.flatnonzero(scale)
    if not len(used):
        return None
    place = np.full(1 << 18, -1, np.int32)
    place[used] = np.arange(len(used))
    draw = np.random.default_rng(7)
    chosen = np.concatenate([draw.permutation(np.flatnonzero(y == k))[: TEXT_LANDMARKS // 2] for k in (0, 1)])
    landmarks = np.zeros((len(used), len(chosen)), np.float32)
    for k, i in enumerate(chosen):
        code, value = rates(said[i])
        known = place[code] >= 0
        landmarks[place[code[known]], k] = value[known] * scale[code[known]]
    values, vectors = np.linalg.eigh((landmarks.T @ landmarks).astype(np.float64))
    some = values > 1e-6 * values[-1]
    root = vectors[:, some] / np.sqrt(values[some])
    like = np.zeros((len(said), len(chosen)))
    for row, c in zip(like, said, strict=True):
        code, value = rates(c)
        known = place[code] >= 0
        row[:] = (value[known] * scale[code[known]]).astype(np.float32) @ landmarks[place[code[known]]]
    z, sign = like @ root, np.where(y == 1, 1.0, -1.0)
    del like
    fold_of = draw.permutation(len(y)) % FOLDS
    apart = np.zeros(len(y))
    for k in range(FOLDS):
        rest = fold_of != k
        machine = newton_svm(z[rest], sign[rest], np.ones(rest.sum()), COST)
        apart[~rest] = z[~rest] @ machine[:-1] + machine[-1]
    machine = newton_svm(z, sign, np.ones(len(y)), COST)
    weights = np.zeros(1 << 18, np.float32)
    weights[used] = landmarks @ (root @ machine[:-1]) * scale[used]
    return weights, float(machine[-1]), apart


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights and, last, the intercept of a logistic regression on columns of about unit size, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-9])
    for _ in range(50):
        p = sigmoid(x @ w)
        step = np.linalg.solve(penalty + x.T @ (x * (weight * p * (1 - p) + 1e-12)[:, None]), x.T @ (weight * (y - p)) - penalty @ w)
        w = w + step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(documents: list[tuple], odds: float = 0.0) -> ToxicityModel:
    """Fit on (distinct lower-case words, label 0 or 1) of labelled texts, or with how often words are said as a third part, which the sentence machine needs.

    odds: by how much, as a logarithm, the sample prefers toxic texts.
    """
    kept = _without_copies(documents)
    y = np.array([d[1] for d in kept], int)
    if not kept or len(kept[0]) < 3 or min(np.bincount(y, minlength=2)) < LEAST:
        return _word_machine([d[:2] for d in kept])
    clean = np.random.default_rng(9).permutation(np.flatnonzero(y == 0))
    judges = clean[: max(len(clean) // 3, len(clean) - SAMPLE)]
    teach = np.setdiff1d(np.arange(len(y)), judges)
    model, found = _word_machine([kept[i][:2] for i in teach]), _sentence_machine([d[2] for d in kept], y)
    if model.weights is None or found is None:
        return model
    at = np.append(judges, np.flatnonzero(y == 1))
    words = [sorted(units(" ".join(kept[i][0]))) for i in at]
    worst = np.array([model.bias + (_Words(w).times(model.weights).max() if w else 0.0) for w in words])
    both = np.column_stack([worst, found[2][at]])
    low, high = np.quantile(both, 0.001, axis=0), np.quantile(both, 0.999, axis=0)
    size = np.where(high > low, high - low, 1.0)
    weight = np.where(y[at] == 1, 1.0, len(clean) / max(1, len(judges)))
    w = _logistic((np.clip(both, low, high) - low) / size, y[at], weight)
    scaled = w[:-1] / size
    model.sentence = found[:2]
    a, b = fit_platt(found[2], y)
    model.both = np.append(scaled, w[-1] - low @ scaled - odds), low, high, (a, b - odds)
    return model


def _word_machine(documents: list[tuple[list[str], int]]) -> ToxicityModel:
    v = _Vocabulary(documents)
    if not v.toxic or not v.clean:
        return ToxicityModel()
    plain = v.whole >= v.chance
    top = _best(v.toxic, v.value)
    witness = plain.copy()
    witness[top[v.value[top] >= v.chance]] = True
    if not witness.any():
        return ToxicityModel()
    draw = np.random.default_rng(5)
    clean = np.flatnonzero(v.in_clean)
    tie = np.array([zlib.crc32(v.words[i]) for i in clean])
    common = clean[np.lexsort((tie, -v.in_clean[clean]))]
    negative = np.zeros(len(v.words), bool)
    negative[common[: EXAMPLES // 2]] = True
    negative[draw.choice(clean, min(EXAMPLES // 2, len(clean)), replace=False)] = True
    hard, y_doc, best_loss = common, np.array([0] * len(v.clean) + [1] * len(v.toxic)), np.inf
    for _ in range(ROUNDS):
        positive = np.flatnonzero(witness)
        if len(positive) > EXAMPLES:  # those that most toxic texts hold
            positive = np.sort(positive[np.argsort(-v.in_toxic[positive], kind="stable")[:EXAMPLES]])
        weight = v.in_toxic[positive] ** 0.75
        # all places of the witnesses that most texts hold
        bent = [(w, x) for i, x in sorted(zip(positive.tolist(), weight.tolist(), strict=True), key=lambda p: (-p[1], p[0]))[:BENT] if len(v.words[i]) > 3 for w in _with_letters(v.words[i])]
        # half of the landmarks are insults, half the clean words that look most like them so far
        chosen = [*positive[np.argsort(-weight, kind="stable")[: LANDMARKS // 2]], *hard[: LANDMARKS // 2]]
        landmarks = _Words([v.words[i] for i in chosen])
        values, vectors = np.linalg.eigh(landmarks.kernel(landmarks).astype(np.float64))
        use = values > 1e-6 * values[-1]
        root = vectors[:, use] / np.sqrt(values[use])
        others = np.flatnonzero(negative)
        examples = _Words([v.words[i] for i in positive] + [w for w, _ in bent] + [v.words[i] for i in others])
        y = np.concatenate([np.ones(len(positive) + len(bent)), -np.ones(len(others))])
        # a word in many clean texts would spoil them all
        machine = newton_svm(examples.kernel(landmarks) @ root, y, np.concatenate([weight, [x for _, x in bent], v.in_clean[others] ** 0.75]))
        beta, bias = root @ machine[:-1], float(machine[-1])
        weights = np.bincount(landmarks.code, landmarks.value * beta[landmarks.row], 1 << 18)
        margin = v.margins(weights) + bias
        likely = clean[np.argsort(-margin[clean], kind="stable")[:HARDEST]]
        negative[likely] = True
        hard = np.array(list(dict.fromkeys([*likely[: LANDMARKS // 4].tolist(), *hard.tolist()])))
        trial = ToxicityModel(weights.astype(np.float32), bias)
        found = np.array([margin[d].max() for d in v.clean + v.toxic])
        trial.platt = fit_platt(found, y_doc)
        p = np.clip(sigmoid(trial.platt[0] * found + trial.platt[1]), 1e-9, 1 - 1e-9)
        loss = -float((y_doc * np.log(p) + (1 - y_doc) * np.log(1 - p)).mean())
        if loss < best_loss:
            best_loss, model = loss, trial
        best = _best(v.toxic, margin)
        witness = plain.copy()
        witness[best[(margin[best] > max(0.0, np.quantile(margin[clean], 0.9999))) & (v.value[best] >= v.chance / 2)]] = True
        if not witness.any():
            witness[positive] = True
    return model


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Fit on a bounded sample of `documents` that `labels` marks; only distinct words reach the driver."""
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("__key")).agg(F.max(label).alias("__y"))
    counts = {r["__y"]: r["count"] for r in marks.groupBy("__y").count().collect()}
    if len(counts) < 2:
        return ToxicityModel()
    share = F.when(F.col("__y") == 1, F.lit(min(1.0, sample / counts[1]))).otherwise(F.lit(min(1.0, CLEAN * sample / counts[0])))
    drawn = marks.where(share_hash(F.col("__key"), 5) < share)
    rows = documents.select(F.col(key).alias("__key"), F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    # at most 2 * SAMPLE keys: fit for a broadcast; of a key's rows one is left before anything is moved
    one = rows.join(F.broadcast(drawn), "__key").groupBy("__key").agg(F.min("__text").alias("__text"), F.first("__y").alias("__y"))
    words = F.array_distinct(F.split(F.lower("__text"), r"[\x20\x09-\x0D]+"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        said = [said_in(t) for t in batch.column(0).to_pylist()]
        lists = [pa.array([list(c) for c in said], pa.list_(pa.binary())), pa.array([list(c.values()) for c in said], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([*batch.columns[1:], *lists], ["__key", "__y", "words", "said", "times"])

    kind = one.schema["__key"].dataType.simpleString()
    counted = map_text(one.select("__text", "__key", "__y", words.alias("words")), "__text", f"__key {kind}, __y {one.schema['__y'].dataType.simpleString()}, words array<string>, said array<binary>, times array<int>", count)
    # a word that many texts hold is one object
    held: dict[str | bytes, str | bytes] = {}
    once = lambda words: [held.setdefault(w, w) for w in words]
    documents_ = []
    for batch in counted.toArrow().to_batches(max_chunksize=64):
        for k, y, w, said, times in zip(*[c.to_pylist() for c in batch.columns[:4]], batch.column(4), strict=True):
            documents_.append((str(k), (once(sorted(x for x in w if x)), int(y), (once(said), times.values.to_numpy(zero_copy_only=False).astype(np.float32)))))
    documents_.sort(key=lambda d: d[0])
    shares = [min(1.0, CLEAN * sample / counts[0]), min(1.0, sample / counts[1])]
    return train([d[1] for d in documents_], float(np.log(shares[1] / shares[0])))


def score(df: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", also: dict[str, Column] | None = None) -> DataFrame:
    """key, score and predicted of each row, and the columns of `also`."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sent.value.score(batch.column(0).to_pylist()), pa.float64())], [*batch.schema.names[1:], "score"])

    rows = df.select(F.col(text).alias("__text"), F.col(key).alias(key), *[c.alias(n) for n, c in (also or {}).items()])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return map_text(rows, "__text", f"{kept}, score double", work).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents"))
    out = F.coalesce(fold("doc_id") == 2, F.lit(False))
    model = fit(documents.where(~out), table(spark, sf_dir, "labels").where(~out))
    return score(documents, model, also={"held_out": out})


ORACLES: dict[str, str] = {}
QUERIES = {"op5_toxicity": op5_toxicity}
