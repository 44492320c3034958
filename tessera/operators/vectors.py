"""Vectors: tables of ``key, element, vector array<double>, attr`` and the index recipe over partitions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import upsert

KEYS = ["key", "element"]


def _lit(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector, within -1 and 1."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size)))


def l2(a: Column, b: Column) -> Column:
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def vadd(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Writes rows of ``key, element, vector``; a replaced element keeps its attribute."""
    new = rows.join(table.select(*KEYS, "attr"), KEYS, "left").select("key", "element", "vector", "attr")
    return upsert(table, new, KEYS)


def vrem(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.join(rows.select(*KEYS).distinct(), KEYS, "left_anti")


def vcard(table: DataFrame) -> DataFrame:
    return table.groupBy("key").agg(F.count("*").alias("n"))


def vdim(table: DataFrame) -> DataFrame:
    return table.groupBy("key").agg(F.max(F.size("vector")).alias("dim"))


def vsetattr(table: DataFrame, key: str, element: str, attr: str | None) -> DataFrame:
    hit = (F.col("key") == key) & (F.col("element") == element)
    return table.withColumn("attr", F.when(hit, F.lit(attr)).otherwise(F.col("attr")))


def vgetattr(table: DataFrame, key: str, element: str) -> DataFrame:
    return table.filter((F.col("key") == key) & (F.col("element") == element)).select("attr")


def vsim(table: DataFrame, query: Sequence[float], count: int = 10, element: str = "element", vector: str = "vector") -> DataFrame:
    """The most similar elements by (cosine + 1) / 2, ties by element."""
    score = (cosine(F.col(vector), _lit(query)) + 1) / 2
    return table.select(element, score.alias("score")).orderBy(F.desc("score"), element).limit(count)


def knn(table: DataFrame, query: Sequence[float], k: int, element: str = "element", vector: str = "vector") -> DataFrame:
    """The nearest elements by distance, ties by element, with score 1 / (1 + distance)."""
    rows = table.select(element, l2(F.col(vector), _lit(query)).alias("dist"))
    return rows.orderBy("dist", element).limit(k).select(element, "dist", (1 / (1 + F.col("dist"))).alias("score"))


def fp16(data: Column) -> Column:
    """Little-endian half floats in a binary as doubles."""

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else np.frombuffer(b, "<f2").astype(np.float64))

    return run(data)


# scalar quantization: one byte an axis
def sq8_fit(table: DataFrame, vector: str = "vector") -> DataFrame:
    """``axis, lo, scale``: one row an axis."""
    axes = table.select(F.posexplode(vector).alias("axis", "x"))
    return axes.groupBy("axis").agg(F.min("x").cast("double").alias("lo"), F.greatest((F.max("x") - F.min("x")).cast("double") / 255, F.lit(1e-9)).alias("scale"))


def _calibration(fit: DataFrame) -> tuple[Column, Column]:
    rows = sorted(fit.collect(), key=lambda r: r["axis"])  # one row an axis
    return _lit([r["lo"] for r in rows]), _lit([r["scale"] for r in rows])


def sq8_encode(vector: Column, lo: Column, scale: Column) -> Column:
    """Codes from 0 to 255, halves away from zero, outside values clamped."""
    shifted = F.zip_with(F.zip_with(vector, lo, lambda x, a: x.cast("double") - a), scale, lambda x, s: F.round(x / s))
    return F.transform(shifted, lambda c: F.greatest(F.lit(0.0), F.least(F.lit(255.0), c)).cast("int"))


def sq8_decode(codes: Column, lo: Column, scale: Column) -> Column:
    return F.zip_with(F.zip_with(codes, scale, lambda c, s: c * s), lo, lambda x, a: x + a)


# partitions: k-means, then a probe of the nearest of them
class _Draws:
    """A linear congruential generator; the multiplier and increment are fixed values."""

    def __init__(self, seed: int):
        self.state = seed | 1

    def next(self) -> int:
        self.state = (self.state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        return self.state >> 33


def kmeans(points: np.ndarray, k: int, iterations: int = 8, seed: int = 0) -> np.ndarray:
    """Centroids of a sample of points: spread-out seeding, then Lloyd's steps; an empty cluster keeps its own."""
    x, draws = np.asarray(points, np.float64), _Draws(seed)
    k = min(max(k, 1), len(x))
    if k == 0:
        return np.zeros((0, x.shape[1] if x.ndim == 2 else 0), np.float32)
    chosen = [draws.next() % len(x)]
    nearest = np.sqrt(((x - x[chosen[0]]) ** 2).sum(1))
    while len(chosen) < k:
        # a point weighs its squared distance, cut to a whole number of 1 at least; chosen ones weigh nothing
        weights = np.maximum(np.minimum(nearest, 1e6) ** 2, 1).astype(np.uint64)
        weights[chosen] = 0
        ends = np.cumsum(weights)
        chosen.append(int(np.searchsorted(ends, np.uint64(draws.next() % int(ends[-1])), side="right")))
        nearest = np.minimum(nearest, np.sqrt(((x - x[chosen[-1]]) ** 2).sum(1)))
    c = x[chosen]
    for _ in range(max(1, iterations)):
        own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        for j in range(k):
            if (own == j).any():
                c[j] = x[own == j].mean(0)
    return c.astype(np.float32)


def assign(table: DataFrame, centroids: np.ndarray, vector: str = "vector", name: str = "cid") -> DataFrame:
    """With the number of the nearest centroid; the centroids travel as a literal (k x dimensions numbers)."""
    dist = [l2(F.col(vector), _lit(c)) for c in centroids]
    return table.withColumn(name, F.array_position(F.array(*dist), F.array_min(F.array(*dist))) - 1)


def probe(table: DataFrame, centroids: np.ndarray, query: Sequence[float], k: int, nprobe: int = 4, element: str = "element", vector: str = "vector") -> DataFrame:
    """Approximate nearest elements of a table with ``cid`` and ``codes``: the nearest partitions, a shortlist
    by the codes, then exact distances. With all partitions probed it finds what ``knn`` finds, but for the
    shortlist's length of max(4 k, k + 16)."""
    near = np.argsort(((centroids.astype(np.float64) - np.asarray(query)) ** 2).sum(1), kind="stable")[:nprobe]
    rows = table.filter(F.col("cid").isin([int(n) for n in near]))
    short = rows.withColumn("_d", l2(F.col("decoded"), _lit(query))).orderBy("_d", element).limit(max(4 * k, k + 16))
    return knn(short, query, k, element, vector)


def build(table: DataFrame, k: int = 32, iterations: int = 8, seed: int = 0, sample: int = 10_000, element: str = "element", vector: str = "vector") -> tuple[DataFrame, np.ndarray]:
    """The index: every row with its partition and codes. Centroids come from at most ``sample`` rows, the
    first by hash of their element; the calibration covers all rows."""
    some = table.orderBy(F.xxhash64(element), element).limit(sample).select(vector).collect()
    centroids = kmeans(np.array([r[0] for r in some], np.float64), k, iterations, seed)
    lo, scale = _calibration(sq8_fit(table, vector))
    out = assign(table, centroids, vector).withColumn("codes", sq8_encode(F.col(vector), lo, scale))
    return out.withColumn("decoded", sq8_decode(F.col("codes"), lo, scale)), centroids
