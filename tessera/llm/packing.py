"""Best-fit packing of documents into sequences of bounded length, planned on the histogram of lengths.

Lengths lie between 1 and the capacity, so the histogram has at most ``capacity`` rows however many documents
there are. The driver packs its counts; runs of equally filled sequences stand for themselves. A piece then
finds its place from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import doc_text, slices, stage
from tessera.llm.tokens import Encoder, loaded

#: Pieces of one length are ranked in groups of about so many.
GROUP = 50_000


def pack_plan(counts: Mapping[int, int], capacity: int) -> np.ndarray:
    """Rows ``length, first rank, first sequence, pieces a sequence, offset`` that place every piece.

    Large lengths (over a third of the capacity) go first, two to a sequence at most: the largest left is
    matched with the largest that fits beside it, which needs the fewest sequences for them. The others
    follow in falling length, each into the smallest gap that takes it, and open sequences where none does.
    A row's pieces of rank r lie in sequence ``first + (r - first rank) // pieces`` at ``offset + length x
    ((r - first rank) % pieces)``. Every step splits at most one run, so rows are bounded by the capacity.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a length lies outside 1 to the capacity")
    rows, ranks, bins = [], defaultdict(int), 0
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def place(n: int, at: int, sequences: int, each: int, offset: int, pieces: int) -> None:
        rows.append((n, ranks[n], at, each, offset))
        ranks[n] += pieces
        left[n] -= pieces
        if sequences and (gap := capacity - offset - n * each):
            gaps[gap].append((at, sequences))

    for n in sorted((n for n in left if 3 * n > capacity), reverse=True):
        fit = min(n, capacity - n)
        while left[n]:
            while fit * 3 > capacity and not (left.get(fit, 0) >= (2 if fit == n else 1)):
                fit -= 1
            if fit * 3 <= capacity:
                at, bins = bins, bins + left[n]
                place(n, at, left[n], 1, 0, left[n])
            elif fit == n:
                m = left[n] // 2
                at, bins = bins, bins + m
                place(n, at, m, 2, 0, 2 * m)
            else:
                m = min(left[n], left[fit])
                at, bins = bins, bins + m
                place(n, at, 0, 1, 0, m)
                place(fit, at, m, 1, n, m)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        gap = n
        while left[n]:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            if gap > capacity:
                each = capacity // n
                full, rest = divmod(left[n], each)
                at, bins = bins, bins + full + (rest > 0)
                if full:
                    place(n, at, full, each, 0, full * each)
                if rest:
                    place(n, at + full, 1, rest, 0, rest)
                break
            at, m = gaps[gap].pop()
            each = gap // n
            full = min(m, left[n] // each)
            rest = min(each, left[n] - full * each) if full < m else 0
            if full:
                place(n, at, full, each, capacity - gap, full * each)
            if rest:
                place(n, at + full, 1, rest, capacity - gap, rest)
            if m > full + (rest > 0):
                gaps[gap].append((at + full + (rest > 0), m - full - (rest > 0)))
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and the end id, cut only beyond the
    capacity. Null and empty texts are the end id alone; a repeated row is a document of its own."""
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = loaded(Encoder, path).ids
        for b in slices(batches):
            at, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                data = ids(text) + last
                for k, x in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[x : x + 4 * capacity]
                    at.append(i)
                    piece.append(k)
                    start.append(x // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            own = b.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([own, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return doc_text(docs).mapInArrow(run, PIECES)


def place_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Rows with a ``length`` from 1 to the capacity, with ``sequence_id`` and ``offset`` besides.

    ``pieces`` must be a staged table with ``doc_id``. Ranks within a length come from ranks within salted
    groups and the groups' sizes, so that no task sees all pieces of a frequent length.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = pack_plan(histogram, capacity)
    salts = max(32, sum(histogram.values()) // GROUP)
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("_salt", "length").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_salt", "length", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_salt", "length").orderBy(*order))
    ranked = salted.withColumn("_rank", rank).join(sizes, ["_salt", "length"])
    ranked = ranked.select(*pieces.columns, (F.col("_before") + F.col("_rank") - 1).alias("_rank"))
    first, names = plan[:, 0] << 48 | plan[:, 1], pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, r = (np.asarray(b.column(c).cast(pa.int64())) for c in ("length", "_rank"))
            row = plan[np.searchsorted(first, n << 48 | r, side="right") - 1]
            k = r - row[:, 1]
            each = row[:, 3] if len(row) else np.ones(0, np.int64)
            extra = [pa.array(row[:, 2] + k // each), pa.array(row[:, 4] + n * (k % each))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *extra], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """``token_pieces`` and the place of each: no sequence is over the capacity, none has a hole. Without
    documents there are no rows."""
    return place_pieces(stage(token_pieces(docs, path, capacity, end), "pieces"), capacity)
