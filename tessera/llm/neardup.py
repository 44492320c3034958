"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified exactly.

A text is the set of its runs of five words with weights (1 + ln tf) x idf. The idf falls only for shingles
in over 1 % of the texts, and to 0.8 at least, so a large group of copies does not lose its links through being
large. At most (mean length / 1 %) shingles can be that frequent, which bounds the one table that is sent to
the executors.

Consistent weighted sampling picks, for each of K hash functions, one shingle with the probability of the
weighted Jaccard similarity that another text picks the same. Bands of four picks make buckets; two texts of
similarity 0.8 share none of 20 with a chance of 3 in 100,000. Buckets propose pairs, by an estimate from the
picks' bytes; proposed pairs get their exact weighted Jaccard similarity from the whole texts; links make
classes. A large bucket is dealt to blocks; in each the texts meet the block's most central one, and the
central ones meet in the same way until one is left. Then each text that is not in the bucket's main class by
verified links meets all others, pair of blocks by pair of blocks, exactly. Texts that are equal are one node
from the start, and no join or group puts all copies of a text, or all texts of a class, into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import doc_text, join_hot, slices, sole_cache, stage, unstage
from tessera.llm.components import components

WORDS, BANDS, ROWS = 5, 20, 4
PICKS = BANDS * ROWS
#: A shingle is frequent in so many of the texts, and its idf is at least the floor.
FREQUENT, FLOOR = 0.01, 0.8
#: Buckets up to this size are compared pair by pair; in larger ones each text meets the most central one of its
#: block of about so many, and what that leaves outside the main class meets all, in pairs of smaller blocks of
#: about so many texts and bytes.
SMALL, BLOCK, PAIRED, PAIRED_BYTES = 64, 1024, 256, 1 << 20
#: Pairs whose estimate lies under this are not verified: over four deviations below 0.8.
ESTIMATE = 0.6

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: All but what str.split takes as space; nothing beyond is.
_INK = np.array([not chr(i).isspace() for i in range(0x3001)])
_CHARS = _mix(np.arange(1, 0x3002, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> list[np.ndarray]:
    """The base's powers and those of its inverse, n at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        _powers[:] = [np.cumprod(np.full(size, x % (1 << 64), _U)) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers


def word_hashes(text: str) -> np.ndarray:
    """A hash for each of the text's words, lower-cased: differences of a running polynomial sum over all of its
    characters, so that no word is touched alone."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(chars):
        return np.zeros(0, _U)
    known = np.minimum(chars, 0x3000)
    inside = np.zeros(len(chars) + 2, np.bool_)
    inside[1:-1] = _INK[known]
    value = _CHARS[known]
    if chars.max() > 0x3000:
        far = chars > 0x3000
        inside[1:-1] |= far
        value[far] = _mix((chars[far].astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
    power, inverse = _powers_to(len(chars))
    total = np.empty(len(chars) + 1, _U)
    total[0] = 0
    np.cumsum(value * power[: len(chars)], out=total[1:])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    return _mix((total[end] - total[start]) * inverse[start])


def shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the runs of ``words`` lower-cased words, and how often each occurs.

    A shorter text is one shingle; a text without words has none.
    """
    h = word_hashes(text)
    if not len(h):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    width, out = min(words, len(h)), None
    for i in range(width):
        part = h[i : len(h) - width + 1 + i]
        out = part.copy() if out is None else out * _U(0x9E3779B97F4A7C15) + part
    return np.unique(_mix(out + _U(width)), return_counts=True)


class Weights:
    """TF-IDF weights from the table of frequent shingles: sorted hashes and their idf."""

    def __init__(self, hashes: np.ndarray, idf: np.ndarray):
        self.hashes, self.idf = hashes, idf

    def of(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = np.where(tf > 1, 1 + np.log(tf), 1.0)
        if len(self.hashes) and len(h):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            w = np.where(self.hashes[at] == h, w * self.idf[at], w)
        return w


class Sampler:
    """K consistent weighted samples of a set. The random numbers of a shingle come from tables of 65,536 rows
    by 16 bits of its hash, differently for each sample."""

    #: Shingles looked at together.
    MOST = 1024

    def __init__(self, picks: int = PICKS, seed: int = 11):
        g = np.random.default_rng(seed)
        n = 1 << 16
        self.odd = g.integers(0, 1 << 63, picks, dtype=_U) * _U(2) + _U(1)
        self.r, c = g.gamma(2.0, 1.0, n), g.gamma(2.0, 1.0, n)
        self.beta, self.ln_c = g.random(n), np.log(c)
        # ln a of a shingle of weight 1, where the level t is 0
        self.unit = (self.ln_c + self.r * self.beta - self.r).astype(np.float32)
        self.place, self.level = np.empty((picks, self.MOST), _U), np.empty((picks, self.MOST), np.float32)

    def picks(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """One 64-bit value a sample, for shingle and level; equal values mean equal picks."""
        k = len(self.odd)
        best, out = np.full(k, np.inf, np.float32), np.zeros(k, _U)
        plain = w == 1.0
        row = np.arange(k)
        for own, weight in ((h[plain], None), (h[~plain], w[~plain])):
            for at in range(0, len(own), self.MOST):
                some = own[at : at + self.MOST]
                i = np.multiply(some[None], self.odd[:, None], out=self.place[:, : len(some)])
                i = np.right_shift(i, _U(48), out=i).view(np.int64)
                if weight is None:
                    a, t = self.unit.take(i, mode="wrap", out=self.level[:, : len(some)]), None
                else:
                    r = self.r[i]
                    t = np.floor(np.log(weight[at : at + self.MOST])[None] / r + self.beta[i])
                    a = (self.ln_c[i] - r * (t - self.beta[i]) - r).astype(np.float32)
                j = a.argmin(1)
                found = some[j] if t is None else some[j] + t[row, j].astype(np.int64).view(_U) * _U(0xD6E8FEB86659FD93)
                better = a[row, j] < best
                best = np.where(better, a[row, j], best)
                out = np.where(better, found, out)
        return _mix(out)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of smaller over sum of larger weights; two sets without shingles are alike."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    return both / (float(a[1].sum()) + float(b[1].sum()) - both)


def frequent_shingles(docs: DataFrame) -> Weights:
    """Shingles that occur in over ``FREQUENT`` of the rows of ``docs``, with their idf.

    Exact: tasks count in batches and pass on what a quarter of the share does not bound there, so what a sum
    lacks is known; whatever can still be frequent is counted in a second pass over all rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("neardup", _powers.clear)
        for b in slices(batches, 4000):
            h, n = np.unique(np.concatenate([shingles(t)[0] for t in b.column(1).to_pylist()]), return_counts=True)
            least = int(FREQUENT / 4 * b.num_rows)
            h, n = h[n > least].view(np.int64), n[n > least]
            # a row of no shingle carries the batch's size and what others may lack
            columns = np.r_[h, 0], np.r_[n, 0], np.r_[np.zeros_like(n), b.num_rows], np.r_[np.zeros_like(n), least]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["h", "n", "rows", "lacks"])

    plain = docs.select("doc_id", "text")
    counted = stage(plain.mapInArrow(run, "h long, n long, rows long, lacks long"), "frequent")
    total, lacks = (x or 0 for x in counted.agg(F.sum("rows"), F.sum("lacks")).first())
    least = max(FREQUENT * total, 3)
    found = counted.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") + lacks > least).filter("n > 0").toPandas()
    unstage(counted)
    if lacks and len(found):
        wanted = np.sort(found["h"].to_numpy(np.int64).view(_U))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sole_cache("neardup", _powers.clear)
            n = np.zeros(len(wanted), np.int64)
            for b in slices(batches):
                for text in b.column(1).to_pylist():
                    h = shingles(text)[0]
                    at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                    n[at[wanted[at] == h]] += 1
            yield pa.RecordBatch.from_arrays([pa.array(wanted.view(np.int64)), pa.array(n)], names=["h", "n"])

        found = plain.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).toPandas()
    found = found[found["n"] > least]
    h = found["h"].to_numpy(np.int64).view(_U)
    idf = FLOOR + (1 - FLOOR) * np.clip(np.log(total / found["n"].to_numpy(np.float64)) / np.log(1 / FREQUENT), 0, 1)
    order = np.argsort(h)
    return Weights(h[order], idf[order])


def _propose(sig: np.ndarray, star: bool) -> tuple[np.ndarray, int]:
    """Pairs of one block's texts worth verifying, as rows of places, and the place of the most central text.
    As a star they are that text's pairs only."""
    # the text that agrees most with the commonest bytes is the most central one
    common = np.array([np.bincount(c, minlength=256).argmax() for c in sig.T], np.uint8)
    centre = int((sig == common).sum(1).argmax())
    if not star:
        return np.argwhere(np.triu((sig[:, None] == sig[None]).mean(2) >= ESTIMATE, 1)), centre
    near = np.flatnonzero((sig == sig[centre]).mean(1) >= ESTIMATE)
    near = near[near != centre]
    return np.stack([np.full_like(near, centre), near], axis=1), centre


def _features(h: np.ndarray, tf: np.ndarray, weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    """A set as features that are there or not: shingle and count from 1 to tf, with what each count adds, so
    that the weights of common features sum to the sum of smaller weights."""
    level = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf) + 1
    more = np.log(level / np.maximum(level - 1, 1))
    more[level == 1] = 1
    name = np.repeat(h, tf)
    again = level > 1
    name[again] = _mix(name[again] + level[again].astype(_U) * _U(0xD6E8FEB86659FD93))
    return name, more * np.repeat(weights.of(h, np.ones_like(tf)), tf)


def block_links(texts: list[str], labels: list[bytes], rows: list[int], cols: list[int], weights: Weights, threshold: float) -> Iterator[tuple[int, int]]:
    """Links between ``rows`` and ``cols`` that connect whatever pairs at or above the threshold connect, beyond
    the classes in ``labels``. All pairs are computed; those near the threshold or above get their exact value."""
    sets = [shingles(t) for t in texts]
    parts = [_features(h, tf, weights) for h, tf in sets]
    total = np.array([w.sum() for _, w in parts])
    names, first, col, n = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True, return_counts=True)
    worth = np.concatenate([p[1] for p in parts])[first].astype(np.float32)
    of = np.repeat(np.arange(len(texts)), [len(p[0]) for p in parts])
    del parts, names
    shared = n > 1
    number = np.cumsum(shared) - 1
    here = shared[col]
    of, col, worth = of[here], number[col[here]], worth[shared]
    order = np.argsort(col, kind="stable")
    of, col = of[order], col[order]
    both = np.zeros((len(rows), len(cols)), np.float32)
    for at in range(0, len(worth), 2048):
        some = slice(*np.searchsorted(col, [at, at + 2048]))
        dense = np.zeros((len(texts), min(2048, len(worth) - at)), np.float32)
        dense[of[some], col[some] - at] = 1
        both += (dense[rows] * worth[at : at + 2048]) @ dense[cols].T
    alike = both / np.maximum(total[rows][:, None] + total[cols][None] - both, 1e-9)
    up: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    i, j = np.nonzero(alike >= threshold - 1e-3)
    exact: dict[int, tuple] = {}
    for k in np.argsort(-alike[i, j], kind="stable"):
        a, b = rows[i[k]], cols[j[k]]
        x, y = root(labels[a]), root(labels[b])
        if x != y:
            for one in (a, b):
                if one not in exact:
                    exact[one] = sets[one][0], weights.of(*sets[one])
            if weighted_jaccard(exact[a], exact[b]) >= threshold:
                up[x] = y
                yield a, b


def _texts_of(keys: DataFrame, nodes: DataFrame, keyed: DataFrame) -> DataFrame:
    """``key, text`` for each of the keys, from the row of ``keyed`` that names its node."""
    wanted = keys.join(nodes.select("key", "doc_id"), "key").select(F.col("key").alias("k"), F.col("doc_id").alias("d"))
    found = keyed.join(wanted, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")))
    return stage(found.groupBy("key").agg(F.first("text").alias("text")), "texts")


def _proposals(pool: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` worth verifying of the buckets in ``pool`` (band, key, n: the bucket's size).

    A bucket of over ``BLOCK`` texts is dealt to blocks, whose central texts make the bucket of the next round;
    a round makes them about ``BLOCK`` times fewer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, keys, sigs, out = None, [], [], []

        def done() -> None:
            if not keys:
                return
            band, _, n = unit
            pairs, centre = _propose(np.frombuffer(b"".join(sigs), np.uint8).reshape(len(keys), PICKS), n > SMALL) if len(keys) > 1 else ((), 0)
            out.extend((*sorted((keys[i], keys[j])), None) for i, j in pairs)
            if n > BLOCK:
                out.append((keys[centre], None, band))

        def flush() -> pa.RecordBatch:
            own = list(set(out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in own], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64()))], names=["a", "b", "band"])

        for b in batches:
            for band, block, n, key, sig in zip(*(c.to_pylist() for c in b.columns)):
                if (band, block, n) != unit:
                    done()
                    unit, keys, sigs = (band, block, n), [], []
                    if len(out) > 20_000:
                        yield flush()
                keys.append(key)
                sigs.append(sig)
        done()
        yield flush()

    rounds = []
    while True:
        block = F.when(F.col("n") > BLOCK, F.pmod(F.xxhash64("key", F.lit(len(rounds))), F.ceil(F.col("n") / BLOCK))).otherwise(0)
        dealt = pool.join(nodes.select("key", "sig"), "key").select("band", block.cast("long").alias("block"), "n", "key", "sig")
        made = stage(dealt.repartition("band", "block").sortWithinPartitions("band", "block", "key").mapInArrow(run, "a binary, b binary, band long"), "proposed")
        rounds.append(made)
        centres = made.filter("b is null").select(F.col("a").alias("key"), "band")
        sizes = stage(centres.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "centres")
        left = sizes.agg(F.sum("n")).first()[0]
        if not left:
            break
        pool = join_hot(centres, sizes, "band", "n", left)
    pairs = rounds[0]
    for made in rounds[1:]:
        pairs = pairs.unionAll(made)
    pairs = stage(pairs.filter("b is not null").select("a", "b").distinct(), "pairs")
    unstage(*rounds)
    return pairs


def _verified(pairs: DataFrame, nodes: DataFrame, keyed: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """The pairs whose exact similarity reaches the threshold."""
    found = _texts_of(pairs.select(F.col("a").alias("key")).unionAll(pairs.select(F.col("b").alias("key"))).distinct(), nodes, keyed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("neardup", _powers.clear)
        kept: dict[bytes, tuple] = {}

        def weighed(key: bytes, text: str) -> tuple:
            if key not in kept:
                if len(kept) >= 256:
                    kept.clear()
                h, tf = shingles(text)
                kept[key] = h, weights.of(h, tf)
            return kept[key]

        for b in slices(batches, 500):
            cols = [c.to_pylist() for c in b.columns]
            ok = [weighted_jaccard(weighed(a, x), weighed(c, y)) >= threshold for a, c, x, y in zip(*cols)]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    one = pairs.join(found.select(F.col("key").alias("a"), F.col("text").alias("x")), "a")
    two = one.join(found.select(F.col("key").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
    links = stage(two.mapInArrow(run, "a binary, b binary"), "links")
    unstage(found, pairs)
    return links


def _rest_links(keyed: DataFrame, nodes: DataFrame, inside: DataFrame, labels: DataFrame, weights: Weights, threshold: float) -> DataFrame | None:
    """Links that large buckets (``inside``: band, key) still lack beyond the classes in ``labels``, or None if
    each is one class: the texts outside a bucket's commonest class meet all its texts. Both sides are dealt to
    blocks; a unit of work is a pair of blocks."""
    own = inside.join(nodes.select("key", "size"), "key").join(labels.withColumnRenamed("node", "key"), "key", "left")
    own = stage(own.select("band", "key", "size", F.coalesce("label", "key").alias("label")), "inside")
    by = own.groupBy("band", "label").agg(F.count("*").alias("m"), F.sum("size").alias("s"))
    most = F.max_by(F.struct("label", "m", "s"), F.struct("m", "label"))
    main = by.groupBy("band").agg(most.alias("main"), F.sum("m").alias("n"), F.sum("s").alias("bytes"), F.count("*").alias("classes")).filter("classes > 1")

    def blocks(texts: str, size: str) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.expr(texts) / PAIRED), F.ceil(F.expr(size) / PAIRED_BYTES)).cast("int")

    main = stage(main.select("band", "n", F.col("main.label").alias("main"), blocks("n - main.m", "bytes - main.s").alias("p"), blocks("main.m", "main.s").alias("q")), "main")
    total = main.agg(F.sum("n")).first()[0]
    if not total:
        unstage(own, main)
        return None
    dealt = stage(join_hot(own, main, "band", "n", total).withColumn("rest", F.col("label") != F.col("main")), "rest")
    texts = _texts_of(dealt.select("key").distinct(), nodes, keyed)
    h = F.xxhash64("key")
    dealt = dealt.withColumn("block", F.when(F.col("rest"), F.pmod(h, F.col("p"))).otherwise(F.col("p") + F.pmod(h, F.col("q"))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("rest"), F.col("p") + F.col("q")).otherwise(F.col("p")) - 1)))
    units = dealt.select("band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "key", "label")
    units = units.join(texts, "key").select("band", "low", "high", "block", "key", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("neardup", _powers.clear)
        unit, held = None, []

        def done() -> pa.RecordBatch:
            block, key, label, text = zip(*held)
            rows = [i for i, x in enumerate(block) if x == unit[1]]
            cols = rows if unit[1] == unit[2] else [i for i, x in enumerate(block) if x == unit[2]]
            found = [sorted((key[a], key[b])) for a, b in block_links(text, label, rows, cols, weights, threshold)] if rows and cols else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:3] != unit:
                    if held:
                        yield done()
                    unit, held = row[:3], []
                held.append(row[3:])
        if held:
            yield done()

    found = units.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "key").mapInArrow(run, "a binary, b binary")
    found = stage(found.distinct(), "rest_links")
    unstage(texts, own, main, dealt)
    return found


def near_links(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (``doc_id``, ``key`` of the text), the different texts (``key``, smallest ``doc_id``, number
    ``n`` of rows) and the label of each text that a verified link joins (``node``, ``label``)."""
    texts = doc_text(docs)
    keyed = texts.select("doc_id", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), F.octet_length("text").cast("long").alias("size"))
    weights = frequent_shingles(texts)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("neardup", _powers.clear)
        sampler = Sampler()
        for b in slices(batches):
            bands, sigs = [], []
            for text in b.column(1).to_pylist():
                h, tf = shingles(text)
                p = sampler.picks(h, weights.of(h, tf))
                band = p.reshape(BANDS, ROWS) * (np.arange(1, ROWS + 1, dtype=_U) * _U(2) + _U(1))
                bands.append(_mix(band.sum(1, dtype=_U) + np.arange(BANDS, dtype=_U)).view(np.int64) if len(h) else np.zeros(0, np.int64))
                sigs.append((p & _U(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["doc_id", "key", "size", "bands", "sig"])

    sampled = stage(keyed.mapInArrow(sample, "doc_id long, key binary, size long, bands array<long>, sig binary"), "sampled")
    nodes = stage(sampled.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "nodes")
    rows = nodes.select("key", F.explode("bands").alias("band"))
    shared = stage(rows.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    pool = join_hot(rows, shared, "band", "n", shared.agg(F.sum("n")).first()[0] or 0)
    links = _verified(_proposals(pool, nodes), nodes, keyed, weights, threshold)
    labels = components(links)
    if shared.filter(F.col("n") > SMALL).limit(1).count():
        inside = rows.join(shared.filter(F.col("n") > SMALL).select("band"), "band", "left_semi")
        rest = _rest_links(keyed, nodes, inside, labels, weights, threshold)
        if rest is not None:
            labels = components(links.unionAll(rest))
    unstage(shared)
    return sampled.select("doc_id", "key"), nodes.select("key", "doc_id", "n"), labels


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """``doc_id, key, class_id, kept`` for each row; ``kept`` where the text is that of the class's smallest id."""
    members, nodes, labels = near_links(docs, threshold)
    linked = labels.join(nodes, labels["node"] == nodes["key"]).select("key", "doc_id", "label")
    first = F.min_by("key", F.struct(F.isnull("doc_id"), "doc_id", "key"))
    names = stage(linked.groupBy("label").agg(F.min("doc_id").alias("class_id"), first.alias("first"), F.count("*").alias("n")), "names")
    named = join_hot(linked, names, "label", "n", names.agg(F.sum("n")).first()[0] or 0)
    named = named.select("key", "class_id", (F.col("key") == F.col("first")).alias("kept"))
    whole = nodes.join(named, "key", "left").select("key", "n", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("kept", F.lit(True)).alias("kept"))
    whole = stage(whole, "text_classes")
    return join_hot(members, whole, "key", "n", whole.agg(F.sum("n")).first()[0] or 0).select("doc_id", "key", "class_id", "kept")


def near_classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``doc_id, class_id, key`` for each row of ``docs``; the class id is the smallest doc_id of its class.

    Null and empty texts are equal texts, and so one class; blank ones are alike only if equal. A class is
    what verified links connect. Repeated rows are one class; rows without an id count but never name it.
    """
    return _classes(docs, threshold).select("doc_id", "class_id", "key")


def one_of_each(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay when each class keeps the row of its smallest id, columns unchanged.

    One row of a class stays, also of repeated rows, of a class without ids, and of each of two classes whose
    smallest ids are equal."""
    classes = stage(_classes(docs, threshold), "classes")
    first = classes.filter(F.col("kept") & F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("key", "doc_id").agg(F.count("*").alias("_neardup_rows"))
    first = first.select(F.col("doc_id").alias("_neardup_id"), F.col("key").alias("_neardup_key"), "_neardup_rows")
    key = F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")))
    kept = docs.join(first, docs["doc_id"].eqNullSafe(first["_neardup_id"]) & (key == first["_neardup_key"]))
    rest = kept.filter("_neardup_rows > 1").dropDuplicates(["_neardup_id", "_neardup_key"])
    return kept.filter("_neardup_rows = 1").unionAll(rest).select(*[docs[c] for c in docs.columns])
