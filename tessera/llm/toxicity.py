"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its own vector (unknown words share one) beside the scaled sum of the vectors of its hashed
character trigrams and fourgrams. The first entry of each vector starts at the log-odds of the labels among
the training texts that hold the word or gram; the rest starts at random, and all of it is trained on.
Windows of words overlap and cover the whole text; a text scores as its worst window. Only the text is
labelled, so training runs all windows of a text forward and corrects the worst one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import bounded_batches, slices
from tessera.llm.labelled import held_out, training_rows

WINDOW, STRIDE = 48, 32
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 12, 12, 12, 8
VOCABULARY, GRAMS = 3000, 8192
#: Characters of a step; a longer word is several steps that overlap by three, so that each gram is in one.
LONGEST, OVERLAP = 32, 3
#: Documents of each label to learn from, at most, and the largest of them.
PER_CLASS, MOST_BYTES = 1200, 100_000
#: Corrections that even a small sample gets, within 40 passes.
STEPS = 240
#: Words whose projections a worker keeps before it starts anew.
KEPT_WORDS = 200_000

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Words, long ones in overlapping pieces."""
    out = []
    for w in _WORD.findall(text.lower()):
        if len(w) <= LONGEST:
            out.append(w)
        else:
            out.extend(w[i : i + LONGEST] for i in range(0, len(w) - OVERLAP, LONGEST - OVERLAP))
    return out


def gram_ids(words: list[str]) -> np.ndarray:
    """For each word the buckets, from 1, of the trigrams and fourgrams of its bytes with its ends marked,
    padded with 0."""
    coded = [f"<{w}>".encode("utf-8", "replace") for w in words]
    size = np.fromiter(map(len, coded), np.int64, len(coded))
    data = np.frombuffer(b"".join(coded) + bytes(4), np.uint8).astype(np.uint32)
    three = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16)
    bucket = [1 + (x * np.uint32(0x9E3779B1) >> np.uint32(19)) % GRAMS for x in (three, three * np.uint32(31) + data[3:] * np.uint32(0x85EBCA77))]
    start, n = np.cumsum(size) - size, 2 * size - 5
    j = np.arange(n.max(initial=0))[None]
    first = (size - 2)[:, None]
    fours = j >= first
    at = np.where(j < n[:, None], start[:, None] + np.where(fours, j - first, j), 0)
    return np.where(j < n[:, None], np.where(fours, bucket[1][at], bucket[0][at]), 0).astype(np.int16)


def windows(n: int) -> np.ndarray:
    """Starts of the windows over n words: every ``STRIDE`` until one reaches the end."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _scale(grams: np.ndarray) -> np.ndarray:
    return (1 / np.sqrt(np.maximum(1, (grams > 0).sum(1))))[:, None].astype(np.float32)


def _sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """``values`` summed by ``rows``, as an array of n rows."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(rows):
        order = np.argsort(rows, kind="stable")
        own, first = np.unique(rows[order], return_index=True)
        out[own] = np.add.reduceat(values[order], first)
    return out


def _odds(of: list[np.ndarray], y: np.ndarray, n: int) -> np.ndarray:
    """Log-odds of the labels among the texts that hold each of n things."""
    seen = np.zeros((2, n))
    for own, label in zip(of, y):
        seen[int(label), own] += 1
    total = np.bincount(y.astype(np.int64), minlength=2)[:, None]
    share = np.log((seen + 0.5) / (total + 1))
    return np.clip(share[1] - share[0], -3, 3) * (seen.sum(0) > 1)


class Network:
    """Parameters, a forward pass over windows of projected words, and its gradients."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        small = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.p = {
            "word": (r.standard_normal((VOCABULARY + 1, WORD_DIM)) * 0.3).astype(np.float32),
            "char": (r.standard_normal((GRAMS + 1, CHAR_DIM)) * 0.5).astype(np.float32),
            "in": small(d, 6 * h), "bias": np.zeros(6 * h, np.float32),
            "fore": small(h, 3 * h), "back": small(h, 3 * h),
            "att": small(2 * h, ATTENTION), "pick": small(ATTENTION), "out": small(2 * h), "out_bias": np.zeros(1, np.float32),
        }
        self.p["char"][0] = 0
        self.vocabulary: dict[str, int] = {}

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers, and gram buckets padded with 0."""
        return np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words)), gram_ids(words)

    def inputs(self, numbers: np.ndarray, grams: np.ndarray) -> np.ndarray:
        return np.concatenate([self.p["word"][numbers], self.p["char"][grams].sum(1) * _scale(grams)], axis=1)

    def project(self, numbers: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """What each word brings to the gates of both directions."""
        return self.inputs(numbers, grams) @ self.p["in"] + self.p["bias"]

    def _run(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list | None) -> np.ndarray:
        """One direction; x: projected words (this direction's columns), at: their rows by step, mask by step."""
        steps, n = at.shape
        h, k = np.zeros((n, HIDDEN), np.float32), HIDDEN
        states = np.empty((steps, n, k), np.float32)
        for t in range(steps):
            a, b = x[at[t]], h @ u
            gates = sigmoid(a[:, : 2 * k] + b[:, : 2 * k])
            z, r = gates[:, :k], gates[:, k:]
            new = np.tanh(a[:, 2 * k :] + r * b[:, 2 * k :])
            m = mask[t][:, None]
            if keep is not None:
                keep.append((h, z, r, new, b[:, 2 * k :]))
            h = h + m * (1 - z) * (new - h)
            states[t] = h
        return states

    def forward(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; at, mask: steps x windows."""
        k = 3 * HIDDEN
        kept = ([], []) if keep is not None else (None, None)
        fore = self._run(x[:, :k], at, mask, self.p["fore"], kept[0])
        back = self._run(x[:, k:], at[::-1], mask[::-1], self.p["back"], kept[1])[::-1]
        h = np.concatenate([fore, back], axis=2)
        u = np.tanh(h @ self.p["att"])
        e = np.where(mask > 0, u @ self.p["pick"], np.float32(-1e9))
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = (w[..., None] * h).sum(0)
        if keep is not None:
            keep |= {"fore": kept[0], "back": kept[1], "h": h, "u": u, "w": w, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["out_bias"]

    def gradients(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: dict, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters behind ``x``, and of ``x`` itself."""
        p, g, h, u, w = self.p, {}, keep["h"], keep["u"], keep["w"]
        g["out"], g["out_bias"] = keep["pooled"].T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["out"]
        d_h = w[..., None] * d_pooled
        d_w = (h * d_pooled).sum(2)
        d_e = w * (d_w - (w * d_w).sum(0))
        g["pick"] = np.einsum("tn,tna->a", d_e, u)
        d_u = d_e[..., None] * p["pick"] * (1 - u * u)
        g["att"] = np.einsum("tnh,tna->ha", h, d_u)
        d_h = d_h + d_u @ p["att"].T
        d_x, k = np.zeros_like(x), HIDDEN
        for name, part, states, order in (("fore", 0, d_h[..., :k], range(at.shape[0] - 1, -1, -1)), ("back", 3 * k, d_h[..., k:], range(at.shape[0]))):
            g[name], carried = np.zeros_like(p[name]), np.zeros((at.shape[1], k), np.float32)
            for t in order:
                h0, z, r, new, b = keep[name][t if name == "fore" else at.shape[0] - 1 - t]
                m = mask[t][:, None]
                d = (carried + states[t]) * m
                d_new = d * (1 - z) * (1 - new * new)
                gate = np.concatenate([d * (h0 - new) * z * (1 - z), d_new * b * r * (1 - r)], axis=1)
                d_b = np.concatenate([gate, d_new * r], axis=1)
                np.add.at(d_x[:, part : part + 3 * k], at[t], np.concatenate([gate, d_new], axis=1))
                g[name] += h0.T @ d_b
                carried = (carried + states[t]) * (1 - m) + d * z + d_b @ p[name].T
        return g, d_x


def _bags(texts: list[list[str]]) -> tuple[list[str], list[np.ndarray]]:
    """Distinct words in order of appearance, and each text as rows of them."""
    number: dict[str, int] = {}
    rows = [np.array([number.setdefault(w, len(number)) for w in ws], np.int64) for ws in texts]
    return list(number), rows


def _window_rows(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps x windows of word rows, their mask, and the text of each window."""
    starts = [windows(len(r)) for r in rows]
    of = np.repeat(np.arange(len(rows)), [len(s) for s in starts])
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate([*rows, np.zeros(1, np.int64)])
    at = np.concatenate([s + ends[i] for i, s in enumerate(starts)])[None] + np.arange(WINDOW)[:, None]
    inside = at < ends[1:][of][None]
    return np.where(inside, flat[np.minimum(at, len(flat) - 1)], 0), inside.astype(np.float32), of


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, p: dict, g: dict) -> None:
        self.t += 1
        for k, d in g.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * d
            v = self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * d * d
            p[k] -= (self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-7)).astype(np.float32)


def fit(texts: list[str], y: np.ndarray, epochs: int = 5, batch: int = 48, rate: float = 0.01, seed: int = 1) -> Network:
    """Without texts of both labels the network is constant: near that label, or one half."""
    net, r = Network(seed), np.random.default_rng(seed)
    if len(texts) == 0 or y.min() == y.max():
        net.p["out"][:] = 0
        net.p["out_bias"][:] = 0 if len(texts) == 0 else 6.0 * (2 * y[0] - 1)
        return net
    bags = [words_of(t) for t in texts]
    often = Counter(w for ws in bags for w in set(ws))
    net.vocabulary = {w: i + 1 for i, (w, n) in enumerate(sorted(often.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY]) if n > 2}
    words, rows = _bags(bags)
    numbers, grams = net.features(words)
    kinds = [np.unique(r) for r in rows]
    net.p["word"][:, 0] = _odds([np.unique(numbers[k]) for k in kinds], y, VOCABULARY + 1) * 0.5
    net.p["word"][0] = 0
    net.p["char"][1:, 0] = _odds([np.unique(grams[k]) for k in kinds], y, GRAMS + 1)[1:] * 0.5
    adam, batches = Adam(rate), max(1, len(rows) // batch)
    epochs = max(epochs, min(40, -(-STEPS // batches)))
    for epoch in range(epochs):
        adam.rate = rate * (1 if epoch < epochs * 0.6 else 0.3)
        for some in np.array_split(r.permutation(len(rows)), batches):
            at, mask, of = _window_rows([rows[i] for i in some])
            own, at = np.unique(at, return_inverse=True)
            at = at.reshape(mask.shape)
            x = net.project(numbers[own], grams[own])
            logits = net.forward(x, at, mask)
            worst = np.array([j[np.argmax(logits[j])] for j in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1)])
            at, mask = at[:, worst], mask[:, worst]
            keep: dict = {}
            p = sigmoid(net.forward(x, at, mask, keep))
            g, d_x = net.gradients(x, at, mask, keep, ((p - y[some]) / len(some)).astype(np.float32))
            used = np.flatnonzero(np.any(d_x, axis=1))
            d_x, own = d_x[used], own[used]
            inputs = net.inputs(numbers[own], grams[own])
            g["in"], g["bias"] = inputs.T @ d_x, d_x.sum(0)
            back = d_x @ net.p["in"].T
            g["word"] = _sums(numbers[own], back[:, :WORD_DIM], VOCABULARY + 1)
            word, place = np.nonzero(grams[own])
            g["char"] = _sums(grams[own][word, place], (back[:, WORD_DIM:] * _scale(grams[own]))[word], GRAMS + 1)
            adam.step(net.p, g)
    return net


class _Numbers(dict):
    """Numbers words as they come and lists the new ones."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Scorer:
    """Scores texts with a network; a worker keeps the projections of words it has met."""

    def __init__(self, net: Network, together: int = 1024):
        self.net, self.together = net, together
        self._fresh()

    def _fresh(self) -> None:
        self.number, self.x = _Numbers(), np.zeros((1024, 6 * HIDDEN), np.float32)

    def score(self, texts: list[str]) -> np.ndarray:
        """The worst window's probability; a text without words is one empty window."""
        if not texts:
            return np.zeros(0)
        if len(self.number) > KEPT_WORDS:
            self._fresh()
        bags = [words_of(t) for t in texts]
        rows = [np.fromiter(map(self.number.__getitem__, ws), np.int64, len(ws)) for ws in bags]
        if new := self.number.new:
            n = len(self.number)
            if n > len(self.x):
                self.x = np.concatenate([self.x, np.zeros((max(n - len(self.x), len(self.x)), self.x.shape[1]), np.float32)])
            for i in range(0, len(new), 2_000):
                some = new[i : i + 2_000]
                first = n - len(new) + i
                self.x[first : first + len(some)] = self.net.project(*self.net.features(some))
            new.clear()
        at, mask, of = _window_rows(rows)
        logits = np.concatenate([self.net.forward(self.x, at[:, i : i + self.together], mask[:, i : i + self.together]) for i in range(0, at.shape[1], self.together)])
        return sigmoid(np.maximum.reduceat(logits.astype(np.float64), np.flatnonzero(np.r_[True, np.diff(of) > 0])))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network:
    """A network fitted on at most ``per_class`` documents of each label (``training_rows``)."""
    rows = training_rows(docs, labels, "toxic", per_class, MOST_BYTES).toPandas().sort_values("doc_id", kind="stable")
    return fit(rows["text"].tolist(), rows["y"].to_numpy(np.float32))


def toxicity_scores(docs: DataFrame, net: Network, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Null texts score as empty ones; repeated rows repeat; other columns are ignored; long texts have as many
    windows as they need.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for b in slices(batches, 256):
            score = scorer.score([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    bounded_batches(docs.sparkSession)
    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.withColumn("held_out", held_out()).select("doc_id", "held_out", "score", "predicted")
