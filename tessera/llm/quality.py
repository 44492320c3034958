"""Quality scores: document statistics and histogram gradient-boosted trees, both plain numpy."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import bounded_batches, doc_text, slices, sole_cache
from tessera.llm.labelled import held_out, training_rows

#: Documents of each label to learn from, at most, and the largest of them.
PER_CLASS, MOST_BYTES = 6000, 1 << 20

FEATURES = (
    "log_chars", "log_words", "word_length", "word_length_spread", "longest_word", "distinct_words", "top_word", "long_words",
    "upper", "lower", "digits", "white", "other_ascii", "beyond_ascii", "exclamations", "bars", "rare_marks", "stops", "quotes",
    "lines", "distinct_lines", "top_line", "line_words", "capital_words", "bare_words", "repeated_pairs", "repeated_fives", "byte_entropy", "compressed",
)

_KIND = np.full(256, 5, np.int64)  # upper, lower, digit, white, other ASCII, beyond ASCII
_KIND[:128] = 4
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 0, 1, 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_BARE = re.compile(r"[^\w\s]+")


def statistics(text: str) -> list[float]:
    """``FEATURES`` of one text; an empty or blank text gives zeros but for its length."""
    out = [0.0] * len(FEATURES)
    data = np.frombuffer(text.encode(), np.uint8)
    words = text.split()
    if not words:
        out[0] = float(np.log1p(len(data)))
        return out
    n, counts = len(words), np.bincount(data, minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, n)
    kinds = np.bincount(_KIND, counts, 6) / len(data)
    share = counts / len(data)
    low = Counter(map(str.lower, words))
    lines = [x for x in text.split("\n") if x.strip()]
    by_line = Counter(lines)
    pairs = len(set(zip(words, words[1:])))
    fives = len(set(zip(words, words[1:], words[2:], words[3:], words[4:])))
    p = share[share > 0]
    return [
        float(np.log1p(len(data))), float(np.log1p(n)), float(lengths.mean()), float(lengths.std()), float(np.log1p(lengths.max())),
        len(low) / n, max(low.values()) / n, float((lengths > 12).mean()), *map(float, kinds),
        float(share[33]), float(share[124]), float(share[[35, 36, 37, 38, 42]].sum()), float(share[46]), float(share[34]),
        float(np.log1p(len(lines))), len(by_line) / len(lines), max(by_line.values()) / len(lines), n / len(lines),
        sum(map(str.istitle, words)) / n, sum(_BARE.fullmatch(w) is not None for w in words) / n,
        1 - pairs / (n - 1) if n > 1 else 0.0, 1 - fives / (n - 4) if n > 4 else 0.0,
        float(-(p * np.log2(p)).sum()), len(zlib.compress(data, 1)) / len(data),
    ]


def statistics_of(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


class BoostedTrees:
    """Logistic gradient boosting on histograms of binned features.

    Trees grow level by level. They are kept flattened: of all trees, one array each of a node's feature,
    threshold, left child (the right one follows it) and value; a leaf is its own child. Scoring walks all
    trees for all rows together, one step of depth at a time.
    """

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 2.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least
        self.bias = 0.0
        self.feature = self.left = np.zeros(0, np.int64)
        self.threshold = self.value = np.zeros(0)
        self.roots = np.zeros(0, np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Without rows every score is one half; with one label alone, near that label."""
        n = len(y)
        mean = (y.sum() + 0.5) / (n + 1) if n else 0.5
        self.bias = float(np.log(mean / (1 - mean)))
        if n == 0 or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(x[:, f], np.arange(1, self.bins) / self.bins)) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        margin = np.full(n, self.bias)
        nodes: list[list] = []  # feature, threshold, left, value
        roots = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            roots.append(len(nodes))
            margin += self._grow(nodes, binned, cuts, p - y, p * (1 - p))
        self.roots = np.array(roots, np.int64)
        self.feature, self.left = (np.array([v[k] for v in nodes], np.int64) for k in (0, 2))
        self.threshold, self.value = (np.array([v[k] for v in nodes], np.float64) for k in (1, 3))
        return self

    def _grow(self, nodes: list, binned: np.ndarray, cuts: list, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        n, columns = binned.shape
        at = np.zeros(n, np.int64)  # the open node of each row, by place in ``level``
        level, out = [len(nodes)], np.zeros(n)
        nodes.append([0, 0.0, len(nodes), 0.0])
        rows = np.arange(n)
        for depth in range(self.depth + 1):
            k, size = len(level), len(level) * self.bins
            total_g, total_h = np.bincount(at, g[rows], k), np.bincount(at, h[rows], k)
            best, split = np.full(k, 1e-6), np.full((k, 2), -1)
            if depth < self.depth:
                for f in range(columns):
                    key = at * self.bins + binned[rows, f]
                    lg = np.bincount(key, g[rows], size).reshape(k, -1).cumsum(1)[:, :-1]
                    lh = np.bincount(key, h[rows], size).reshape(k, -1).cumsum(1)[:, :-1]
                    rg, rh = total_g[:, None] - lg, total_h[:, None] - lh
                    gain = lg**2 / (lh + self.ridge) + rg**2 / (rh + self.ridge) - (total_g**2 / (total_h + self.ridge))[:, None]
                    gain[(lh < self.least) | (rh < self.least)] = 0
                    b = gain.argmax(1)
                    better = gain[np.arange(k), b] > best
                    best[better] = gain[np.arange(k), b][better]
                    split[better] = np.stack([np.full(k, f), b], axis=1)[better]
            leaf = np.zeros(k)
            children, place = [], np.full(k, -1)
            for i, node in enumerate(level):
                f, b = split[i]
                if f < 0 or b >= len(cuts[f]):
                    leaf[i] = nodes[node][3] = -self.rate * total_g[i] / (total_h[i] + self.ridge)
                else:
                    nodes[node][:3] = int(f), float(cuts[f][b]), len(nodes)
                    place[i] = len(children)
                    for _ in range(2):
                        children.append(len(nodes))
                        nodes.append([0, 0.0, len(nodes), 0.0])
            ended = place[at] < 0
            out[rows[ended]] = leaf[at[ended]]
            rows, at = rows[~ended], at[~ended]
            if not children:
                break
            at = place[at] + (binned[rows, split[at, 0]] > split[at, 1])
            level = children
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        margin = np.full(len(x), self.bias)
        if len(self.roots) and len(x):
            node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
            row = np.arange(len(x))[:, None]
            for _ in range(self.depth):
                left = self.left[node]
                node = np.where(left == node, node, left + (x[row, self.feature[node]] > self.threshold[node]))
            margin += self.value[node].sum(1)
        return 1 / (1 + np.exp(-margin))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> BoostedTrees:
    """Trees fitted on at most ``per_class`` documents of each label (``training_rows``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = statistics_of(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    rows = training_rows(docs, labels, "quality", per_class, MOST_BYTES).mapInArrow(run, "doc_id long, y int, x array<double>").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist(), np.float64).reshape(len(rows), len(FEATURES))
    y = rows["y"].to_numpy(np.float64)
    # both labels weigh as in the sample; the share of each is bounded, not the number of the rarer one
    return BoostedTrees().fit(x, y)


def quality_scores(docs: DataFrame, model: BoostedTrees) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Null texts score as empty ones; repeated rows repeat; other columns are ignored; no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("quality", lambda: None)
        for b in slices(batches):
            score = model.score(statistics_of(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = doc_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.withColumn("held_out", held_out()).select("doc_id", "held_out", "score", "predicted")


def keep_good(docs: DataFrame, model: BoostedTrees) -> DataFrame:
    """The rows of ``docs`` whose text the model predicts to be good, all columns unchanged, whatever their names."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("quality", lambda: None)
        for b in slices(batches):
            score = model.score(statistics_of([t or "" for t in b.column(at).to_pylist()]))
            yield b.filter(pa.array(score >= 0.5))

    return docs.mapInArrow(run, docs.schema)
