"""Toxic spans by a linear-chain conditional random field over words.

The chain has two states, clean and toxic. A word's emission is the sum of the weights of its
features (the word, its beginnings and endings); transitions are free. Training words get their
labels from the labelled documents: in a toxic one, the words with a feature far more frequent in
toxic documents; in a clean one, none. The weights maximise the likelihood of these labels
(forward-backward gradients). On every whole text, forward-backward gives each word's marginal
probability; a logistic curve over the largest marginal and their sum, fitted on the training
documents, makes the document's score, and neighbouring words with a marginal of SPAN or more make
a span of character offsets.

Learned from a bounded sample of labelled rows in the training folds: the `per_label` rows of each
label with the smallest hashes of doc_id, up to `sample_chars` characters of each. Labels, lang,
source and doc_id don't enter a score; doc_id only tells the fold.

Results: null and empty texts have no words and get the curve's value for that. Without any toxic
training row all scores are 0. Several labels of one doc_id count as toxic if one is. Repeated rows
are scored each; a null doc_id has no label and isn't held out. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, fold, small_batches, tidied
from .token_ids import Recent, groups

FOLDS, HELD_OUT = 3, 1
THRESHOLD, SPAN = 0.7, 0.5
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_spans int, spans string"
#: Texts, and cells of the table of their words, that one call of forward-backward takes; words of a training window.
ROWS, CELLS, WINDOW = 256, 500_000, 256


#: A feature has a weight if it tells toxic documents or occurs in so many; chance weights of rare ones would mark clean words.
COMMON = 40


def features(word: str) -> list[str]:
    w = word.lower().strip(".,;:!?\"'()[]{}<>*_-")
    if not w:
        return []
    return ["=" + w, *("^" + w[:k] for k in range(3, 7) if len(w) > k), *("$" + w[-k:] for k in (3, 4, 5) if len(w) > k)]


def padded(emissions: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps x texts, longest first; lengths; the order)."""
    sizes = np.array([len(e) for e in emissions])
    order = np.argsort(-sizes, kind="stable")
    out = np.zeros((sizes.max(initial=0), len(sizes)))
    for k, i in enumerate(order):
        out[: sizes[i], k] = emissions[i]
    return out, sizes[order], order


def forward_backward(e: np.ndarray, sizes: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of the toxic state from the left (with the own word) and from the right.

    t: log potentials of clean-toxic, toxic-clean, toxic-toxic and of beginning toxic; clean-clean is 0.
    """
    t01, t10, t11, first = t
    steps = len(e)
    active = (sizes[None, :] > np.arange(steps)[:, None]).sum(axis=1)
    left, right = np.zeros_like(e), np.zeros_like(e)
    if steps:
        left[0] = e[0] + first
    for k in range(1, steps):
        n = active[k]
        r = left[k - 1, :n]
        left[k, :n] = e[k, :n] + np.logaddexp(r + t11, t01) - np.logaddexp(r + t10, 0)
    for k in range(steps - 2, -1, -1):
        n = active[k + 1]
        r = e[k + 1, :n] + right[k + 1, :n]
        right[k, :n] = np.logaddexp(r + t11, t10) - np.logaddexp(r + t01, 0)
    return left, right


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class Model:
    def __init__(self, weights: dict[str, float], bias: float, transitions, curve):
        self.weights, self.bias, self.transitions, self.curve = weights, bias, np.asarray(transitions, float), curve
        self.cache = Recent(self.emission, 200_000)

    def __getstate__(self):
        return self.weights, self.bias, self.transitions, self.curve

    def __setstate__(self, state):
        self.__init__(*state)

    def emission(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))

    def marginals(self, texts: list[str]) -> list[np.ndarray]:
        """The marginal log odds of each word of each text."""
        self.cache.trim()
        emissions = [np.fromiter(map(self.cache.__getitem__, w), float, len(w)) for w in map(str.split, texts)]
        out: list = [None] * len(texts)
        by_size = np.argsort([-len(e) for e in emissions], kind="stable")
        a = 0
        while a < len(by_size):
            part = by_size[a : a + max(1, min(ROWS, CELLS // max(1, len(emissions[by_size[a]]))))]
            a += len(part)
            e, sizes, order = padded([emissions[i] for i in part])
            left, right = forward_backward(e, sizes, self.transitions)
            for k, i in enumerate(part[order]):
                out[i] = left[: sizes[k], k] + right[: sizes[k], k]
        return out

    def score(self, odds: np.ndarray) -> float:
        return float(sigmoid(np.dot(self.curve, aggregates(odds)))) if self.curve is not None else 0.0


def aggregates(odds: np.ndarray) -> np.ndarray:
    """What the curve sees: 1, the largest marginal's log odds and the logarithm of the sum of marginals."""
    return np.array([1.0, np.clip(odds.max(initial=-12.0), -12, 12), math.log(1e-3 + sigmoid(odds).sum())])


def tells(toxic: int, clean: int, n_toxic: int, n_clean: int) -> bool:
    """Is a feature of so many documents of each kind far more frequent among the toxic ones, and surely so?"""
    odds = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
    share, usual = toxic / (toxic + clean), n_toxic / (n_toxic + n_clean)
    evidence = toxic * math.log(share / usual) + (clean * math.log((1 - share) / (1 - usual)) if clean else 0.0)
    return odds > 3.0 and evidence > 9.0


def fit(texts: list[str], toxic: list[int], rounds: int = 25, rate: float = 0.4, ridge: float = 1e-3) -> Model:
    if not any(toxic) or all(toxic):
        return Model({}, 0.0, np.zeros(4), None)
    words = [t.split() for t in texts]
    seen: list[Counter] = [Counter(), Counter()]
    for ws, y in zip(words, toxic):
        seen[y].update({f for w in set(ws) for f in features(w)})
    n = [len(toxic) - sum(toxic), sum(toxic)]
    sure = {f for f, a in seen[1].items() if a >= 3 and tells(a, seen[0][f], n[1], n[0])}
    names = {f: k for k, f in enumerate(f for f in seen[0] | seen[1] if f in sure or seen[0][f] + seen[1][f] >= COMMON)}
    kinds = {w: k for k, w in enumerate({w for ws in words for w in ws})}
    own = [[names[f] for f in features(w) if f in names] for w in kinds]
    at_kind = np.repeat(np.arange(len(own)), [len(x) for x in own])
    at_name = np.array([k for x in own for k in x], np.int64)
    taught = np.array([any(f in sure for f in features(w)) for w in kinds])
    whole = [(np.array([kinds[w] for w in ws], np.int32), bool(y)) for ws, y in zip(words, toxic)]
    del words, seen
    # windows of the whole texts, so that a long one doesn't widen a block
    coded = [c[a : a + WINDOW] for c, _ in whole for a in range(0, len(c), WINDOW)]
    labels = [taught[c[a : a + WINDOW]] & y for c, y in whole for a in range(0, len(c), WINDOW)]
    order = np.argsort([-len(c) for c in coded], kind="stable")
    blocks = [order[a : a + 512] for a in range(0, len(order), 512)]
    w, bias, t = np.zeros(len(names)), -3.0, np.array([-2.0, 0.0, 0.0, -2.0])
    moment = [np.zeros(len(names) + 5), np.zeros(len(names) + 5)]
    for step in range(1, rounds + 1):
        by_kind = bias + np.bincount(at_kind, w[at_name], len(kinds))
        grad_kind, grad_t, total = np.zeros(len(kinds)), np.zeros(4), 0
        for block in blocks:
            e, sizes, order_ = padded([by_kind[coded[i]] for i in block])
            y = padded([labels[i].astype(float) for i in block])[0]
            k = padded([coded[i].astype(float) for i in block])[0].astype(np.int64)
            left, right = forward_backward(e, sizes, t)
            real = np.arange(len(e))[:, None] < sizes[None, :]
            p = sigmoid(left + right) * real
            grad_kind += np.bincount(k[real], (y - p)[real], len(kinds))
            if len(e):
                grad_t[3] += ((y - p)[0] * real[0]).sum()
            if len(e) > 1:
                both, r, s = real[1:], left[:-1], (e + right)[1:]
                z = np.stack([np.zeros_like(r), t[0] + s, r + t[1], r + t[2] + s])
                z -= z.max(axis=0)
                z = np.exp(z)
                z = z[1:] / z.sum(axis=0) * both
                was, now = y[:-1] * both, y[1:] * both
                grad_t[:3] += [((both - was) * now).sum() - z[0].sum(), (was * (both - now)).sum() - z[1].sum(), (was * now).sum() - z[2].sum()]
            total += int(sizes.sum())
        gradient = np.concatenate([np.bincount(at_name, grad_kind[at_kind], len(names)) - ridge * len(texts) * w, [grad_kind.sum()], grad_t]) / len(texts)
        moment[0] = 0.8 * moment[0] + 0.2 * gradient
        moment[1] = 0.95 * moment[1] + 0.05 * gradient**2
        move = rate * (moment[0] / (1 - 0.8**step)) / (np.sqrt(moment[1] / (1 - 0.95**step)) + 1e-6)
        w, bias, t = w + move[: len(names)], bias + move[len(names)], t + move[len(names) + 1 :]
    kept = {f: float(w[k]) for f, k in names.items() if abs(w[k]) > 1e-3}
    model = Model(kept, float(bias), t, None)
    x = np.stack([aggregates(o) for o in model.marginals(texts)])
    y, curve = np.array(toxic, float), np.zeros(3)
    weight = np.where(y == 1, 0.5 / n[1], 0.5 / n[0]) * len(y)
    for _ in range(30):  # Newton steps; the ridge keeps separable samples finite
        p = sigmoid(x @ curve)
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3)
        curve = curve + np.linalg.solve(hessian, x.T @ (weight * (y - p)) - 0.5 * curve)
    model.curve = curve
    return model


def train(docs: DataFrame, labels: DataFrame, per_label: int = 1500, sample_chars: int = 5_000_000) -> Model:
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    )
    found, ys = [], []
    for y in (0, 1):
        # at most per_label ids, so the broadcast is bounded
        ids = known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        rows = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")
        used = 0
        for r in bounded_rows(rows):
            if used < sample_chars:
                found.append(r.text)
                ys.append(y)
                used += len(r.text)
    return fit(found, ys)


def spans(text: str, odds: np.ndarray) -> list[tuple[int, int]]:
    """Character offsets of runs of words whose marginal is SPAN or more."""
    out: list[tuple[int, int]] = []
    if not len(odds) or odds.max() < math.log(SPAN / (1 - SPAN)):
        return out
    before = False
    for (a, b), o in zip(places(text), odds):
        hot = o >= math.log(SPAN / (1 - SPAN))
        if hot and before:
            out[-1] = (out[-1][0], b)
        elif hot:
            out.append((a, b))
        before = hot
    return out


def places(text: str):
    """Where the words of text.split() stand."""
    at = 0
    for w in text.split():
        at = text.index(w, at)
        yield at, at + len(w)
        at += len(w)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = F.coalesce(fold(F.col("doc_id").cast("long"), FOLDS) == HELD_OUT, F.lit(False))

    def run(batches):
        model = shared.value
        for batch in batches:
            found, scores, marks = [t or "" for t in batch.column(2).to_pylist()], [], []
            for a, b in groups([len(t) for t in found], 8_000_000):
                for text, odds in zip(found[a:b], model.marginals(found[a:b])):
                    scores.append(model.score(odds))
                    marks.append(spans(text, odds))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()),
                    pa.array([len(m) for m in marks], pa.int32()),
                    pa.array([",".join(f"{a}:{b}" for a, b in m) for m in marks], pa.string()),
                ],
                names=[c.split()[0] for c in SCHEMA.split(", ")],
            )

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(tidied(run), SCHEMA)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_spans and spans of each document."""
    return predict(docs, train(docs, labels))
