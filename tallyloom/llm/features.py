"""Hashed n-gram features of whole texts and a linear support vector machine, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Slots that the n-grams of one to three bytes are hashed into.
DIMENSIONS = 4096
#: Texts whose counts are held at once, and bytes of them.
TEXTS, BYTES = 128, 1 << 22
#: Letters as they are (lower case), everything else in ASCII as a blank; bytes above stay.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))

_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def _hashed(raw: np.ndarray, order: int) -> np.ndarray:
    """A slot for the n-gram of `order` bytes that starts at each position."""
    code = raw[: len(raw) - order + 1].astype(np.uint32)
    for k in range(1, order):
        code = code * np.uint32(257) + raw[k : len(raw) - order + 1 + k]
    code = (code + np.uint32(order)) * _MIX[order - 1]
    return (code >> np.uint32(20)).astype(np.int64)


def _groups(raws: list[bytes]) -> Iterator[list[bytes]]:
    group, total = [], 0
    for raw in raws:
        if group and (len(group) == TEXTS or total + len(raw) > BYTES):
            yield group
            group, total = [], 0
        group.append(raw)
        total += len(raw)
    if group:
        yield group


def ngram_features(texts: list[str | None], letters: bool = True) -> np.ndarray:
    """Unit vectors of the square roots of the n-gram counts, a row for each text, counted over the whole text.

    letters: count the lower-case letters only, not signs, digits and case.
    """
    if letters:
        raws = [(t or "").lower().encode("utf-8", "surrogatepass").translate(LETTERS) for t in texts]
    else:
        raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    rows = []
    for group in _groups(raws):
        counts = np.zeros((len(group), DIMENSIONS), np.float32)
        for row, raw in zip(counts, group, strict=True):
            if len(raw) <= BYTES:
                pieces = [raw]
            else:  # pieces overlap by what an n-gram needs
                pieces = [raw[i : i + BYTES + 2] for i in range(0, len(raw), BYTES)]
            for piece in pieces:
                buffer = np.frombuffer(piece, np.uint8)
                for order in (1, 2, 3):
                    if len(buffer) >= order:
                        row += np.bincount(_hashed(buffer, order), minlength=DIMENSIONS)
        np.sqrt(counts, out=counts)
        counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-12)
        rows.append(counts)
    return np.concatenate(rows) if rows else np.zeros((0, DIMENSIONS), np.float32)


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 200, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights and, last, the bias of a linear SVM with squared hinge loss; y is +1 or -1.

    Accelerated gradient descent from zero, so equal data give equal weights.
    Classes weigh alike unless `weight` says otherwise.
    """
    x = np.hstack([x.astype(np.float32), np.ones((len(x), 1), np.float32)])
    y = np.asarray(y, np.float32)
    if weight is None:
        weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    weight = weight.astype(np.float32)
    v = np.ones(x.shape[1], np.float32) / np.float32(np.sqrt(x.shape[1]))
    for _ in range(12):
        v = x.T @ (weight * (x @ v))
        v /= max(np.linalg.norm(v), 1e-300)
    steep = 1.0 / cost + 2.2 * float(v @ (x.T @ (weight * (x @ v))))
    w = ahead = np.zeros(x.shape[1], np.float32)
    t = 1.0
    for _ in range(rounds):
        slack = np.maximum(np.float32(0), 1 - y * (x @ ahead))
        slope = ahead / cost - 2.0 * (x.T @ (weight * y * slack))
        slope[-1] += -ahead[-1] / cost  # the bias is free
        new = ahead - slope / np.float32(steep)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + np.float32((t - 1) / t_new) * (new - w), new, t_new
    return w


def newton_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1e4, rounds: int = 50) -> np.ndarray:
    """The machine of train_svm for few columns, by Newton's method on the rows inside the margin; both classes weigh alike in all."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    weight = np.where(y > 0, weight / weight[y > 0].sum(), weight / weight[y <= 0].sum()) / 2
    ridge = np.full(x.shape[1], 1.0 / cost)
    ridge[-1] = 1e-9  # the bias is free
    w, active = np.zeros(x.shape[1]), None
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        if active is not None and (inside == active).all():
            break
        active, xs = inside, x[inside]
        side = 2 * weight[inside]
        new = np.linalg.solve(np.diag(ridge) + xs.T @ (xs * side[:, None]), xs.T @ (side * y[inside]))

        def loss(v: np.ndarray) -> float:
            return float(0.5 * (ridge * v * v).sum() + (weight * np.maximum(0, 1 - y * (x @ v)) ** 2).sum())

        step, base = 1.0, loss(w)
        while step > 1e-3 and loss(w + step * (new - w)) > base:
            step /= 2
        w = w + step * (new - w)
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights and, last, the bias of a logistic regression on few columns, by Newton's method; y is 0 or 1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        slope = x.T @ (p - y) + ridge * w
        bend = (x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit_platt(margin: np.ndarray, label: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """(a, b) with probability sigmoid(a * margin + b) by Newton's method on smoothed targets; label is 0 or 1."""
    n1, n0 = float(label.sum()), float(len(label) - label.sum())
    target = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 0.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(rounds):
        p = sigmoid(a * margin + b)
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        ga, gb = float((d * margin).sum()) + 1e-6 * a, float(d.sum())
        haa, hab, hbb = float((h * margin * margin).sum()) + 1e-6, float((h * margin).sum()), float(h.sum()) + 1e-9
        det = max(haa * hbb - hab * hab, 1e-12)
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = min(1.0, 5.0 / max(abs(da), abs(db), 1e-12))
        a, b = a - scale * da, b - scale * db
        if max(abs(da), abs(db)) < 1e-8:
            break
    return a, b
