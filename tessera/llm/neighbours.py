"""Nearest neighbours by collision counting over query-centred hashing.

Largest inner product becomes smallest distance in one more dimension: with M the largest norm, x goes to
(x, sqrt(M^2 - |x|^2)) and a query q to (q M / |q|, 0). An index is, for each of m random directions, the
array of projections in order. A search opens in every array a window around the query's own projection and
widens it as its radius grows (virtual rehashing: nothing is hashed anew); a vector that has come into
``threshold`` of the windows is verified by its exact product. It ends when the k-th best verified vector lies
within the radius, for by then a closer one has come into about 68 % of the windows.

A vector belongs to one block and is shuffled once; a task builds the index of its block once, and all queries
stream through it. Only queries are repeated, once a block, and each block answers with its best k.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Directions, the part of them whose windows a candidate must share, and how far beyond the radius the k-th
#: best may lie at the end.
DIRECTIONS, SHARE, SLACK = 64, 0.5, 1.25
#: The first radius and its growth, in parts of the largest norm.
FIRST, GROWTH = 0.5, 1.1
#: Vectors of a block, about, and queries searched together.
BLOCK, QUERIES = 16_384, 256


class CollisionIndex:
    """Sorted projections of one block of vectors (rows of ``x``)."""

    def __init__(self, x: np.ndarray, seed: int = 7, directions: int = DIRECTIONS, share: float = SHARE, slack: float = SLACK):
        self.x = np.ascontiguousarray(x, np.float64)
        norms = np.sqrt((self.x * self.x).sum(1))
        self.most = float(norms.max()) if len(norms) else 0.0
        self.near = (self.x / (self.most or 1.0)).astype(np.float32)
        extra = np.sqrt(np.maximum(0.0, self.most**2 - norms**2))
        self.lines = np.random.default_rng(seed).standard_normal((directions, self.x.shape[1] + 1))
        y = self.lines @ np.concatenate([self.x.T, extra[None]])
        self.order = np.argsort(y, axis=1, kind="stable")
        self.sorted = np.take_along_axis(y, self.order, axis=1)
        self.slack, self.threshold = slack, math.ceil(directions * share)

    def search(self, queries: np.ndarray, k: int, own: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """For each query the rows that may be its best ``k``: those of the verified rows, without the rows
        listed in ``own``, whose single-precision product is not clearly below the k-th.

        Where there are no more than ``k`` rows, all are verified.
        """
        norms = np.sqrt((queries * queries).sum(1))
        unit = queries / norms[:, None]
        centres = self.lines[:, :-1] @ (unit * self.most).T
        radii = [FIRST * self.most * GROWTH**t for t in range(1 + math.ceil(math.log(4 / FIRST) / math.log(GROWTH)))]
        left = np.empty((len(radii), len(self.lines), len(queries)), np.int64)
        right = np.empty_like(left)
        for j, (s, c) in enumerate(zip(self.sorted, centres)):
            for t, radius in enumerate(radii):
                left[t, j], right[t, j] = np.searchsorted(s, c - radius), np.searchsorted(s, c + radius, side="right")
        return [self._one(unit[i].astype(np.float32), k, radii, left[..., i], right[..., i], own[i] if own else ()) for i in range(len(queries))]

    def _one(self, q: np.ndarray, k: int, radii: list, left: np.ndarray, right: np.ndarray, own) -> np.ndarray:
        n = len(self.x)
        count, seen, order = np.zeros(n, np.int64), np.zeros(n, bool), self.order
        seen[own] = True
        rows, products, best, met = [], [], np.zeros(0, np.float32), int(seen.sum())
        for t, radius in enumerate(radii):
            if t:
                new = [o[a:b] for o, a, b in zip(order, left[t], left[t - 1])] + [o[a:b] for o, a, b in zip(order, right[t - 1], right[t])]
            else:
                new = [o[a:b] for o, a, b in zip(order, left[0], right[0])]
            count += np.bincount(np.concatenate(new), minlength=n)
            fresh = np.flatnonzero((count >= self.threshold) & ~seen)
            if len(fresh):
                seen[fresh] = True
                met += len(fresh)
                rows.append(fresh)
                products.append(self.near[fresh] @ q)
                best = np.concatenate([best, products[-1]])
                best = np.partition(best, len(best) - k)[-k:] if len(best) > k else best
            # products are cosines scaled by |x| / M, so the squared distance is 2 M^2 (1 - product)
            if met == n or len(best) == k and 2 * (1 - best.min()) * self.most**2 <= (self.slack * radius) ** 2:
                break
        else:
            rows.append(np.flatnonzero(~seen))
            products.append(self.near[rows[-1]] @ q)
        if not rows:
            return np.zeros(0, np.int64)
        rows, found = np.concatenate(rows), np.concatenate(products)
        return rows if len(rows) <= k else rows[found >= np.partition(found, len(found) - k)[len(found) - k] - 1e-5]


def _usable(vector: str) -> Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.col("vec_id").isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda v: v != 0)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the ``k`` rows of largest product found, exact double
    scores, ties to the smaller id.

    Both tables have ``vec_id`` and the vector. Rows without an id, and vectors that are null, empty, zero or
    hold a null or non-finite entry, take no part; a query meets vectors of its own length only, and never
    rows of its own id. A query id that repeats is asked once. Fewer candidates than ``k``: all of them.
    """
    vectors, queries = (df.select("vec_id", _vector(df, vector).alias("v")).filter(_usable("v")) for df in (vectors, queries))
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, math.ceil(vectors.count() / BLOCK))
    names = ["dim", "block", "asked", "vec_id", "v"]
    held = vectors.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.lit(False).alias("asked"), "vec_id", "v")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    asked = queries.select(F.size("v").alias("dim"), each.alias("block"), F.lit(True).alias("asked"), "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, ids, parts, index = None, [], [], None
        for b in batches:
            keys = np.stack([np.asarray(b.column(k).cast(pa.int64())) for k in range(3)], axis=1)
            starts = np.flatnonzero(np.r_[True, np.any(keys[1:] != keys[:-1], axis=1)]) if len(keys) else []
            for at, end in zip(starts, [*starts[1:], len(keys)]):
                dim, block, query = keys[at].tolist()
                if (dim, block) != unit:
                    unit, ids, parts, index = (dim, block), [], [], None
                own, values = np.asarray(b.column(3)[at:end]), b.column(4)[at:end].flatten().to_numpy().reshape(-1, dim)
                if not query:
                    ids.append(own)
                    parts.append(values)
                elif parts:
                    if index is None:
                        index, ids = CollisionIndex(np.concatenate(parts)), np.concatenate(ids)
                    for i in range(0, len(own), QUERIES):
                        yield _found(index, ids, own[i : i + QUERIES], values[i : i + QUERIES].astype(np.float64), k)

    # the sort puts a block's vectors before the queries that it answers
    dealt = held.unionByName(asked).repartition(3 * blocks, "dim", "block").sortWithinPartitions(*names[:4])
    found = dealt.select(*names).mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _vector(df: DataFrame, vector: str) -> Column:
    """The column as it is if it holds floats, else as doubles."""
    kind = df.schema[vector].dataType.simpleString()
    return F.col(vector) if kind == "array<float>" else F.col(vector).cast("array<double>")


def _found(index: CollisionIndex, ids: np.ndarray, asked: np.ndarray, values: np.ndarray, k: int) -> pa.RecordBatch:
    """The best ``k`` of one block for some queries, by exact product and id."""
    out = ([], [], [])
    by_id = np.argsort(ids, kind="stable")
    first, last = (np.searchsorted(ids[by_id], asked, side=x) for x in ("left", "right"))
    for i, rows in enumerate(index.search(values, k, [by_id[a:b] for a, b in zip(first, last)])):
        score = (index.x[rows] * values[i]).sum(1)
        best = np.lexsort((ids[rows], -score))[:k]
        for part, found in zip(out, (np.full(len(best), asked[i]), ids[rows][best], score[best])):
            part.append(found)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v), t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])
