"""Sorted sets: tables of ``key, member, score``, in order of score and then member.

-0.0 comes before 0.0; inclusive bounds take the two for equal, exclusive ones do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from tessera.errors import CommandError
from tessera.functions.columns import score_order, upsert
from tessera.operators.hashes import random_members
from tessera.operators.strings import page

KEYS = ["key", "member"]


def by_key(*order: Column) -> WindowSpec:
    return Window.partitionBy("key").orderBy(*order) if order else Window.partitionBy("key")

def _order(reverse: bool = False) -> list[Column]:
    parts = [*score_order(F.col("score")), F.col("member")]
    return [c.desc() for c in parts] if reverse else parts


#: So many ranges of scores make a factor of two, and so many parts a range.
OCTAVE, PARTS = 4, 1024


def _range(score: Column) -> Column:
    """An ordered whole number of a score's sign and size, null for no score."""
    size = F.floor(F.least(F.log2(F.abs(score)), F.lit(2000.0)) * OCTAVE).cast("long")  # infinity is a range too
    return F.when(score > 0, size + (1 << 20)).when(score < 0, -size - (1 << 20)).when(score == 0, F.lit(0).cast("long"))


def ranked(table: DataFrame, reverse: bool = False) -> DataFrame:
    """With ``rank`` from 0, and the set's size ``n``.

    Scores fall into ranges by their size, and each range of a set is cut into equal parts between its least and
    its largest score; a rank is that within the part and the sizes of the parts before. Both tables are exact
    and bounded a set, so parts do not change from run to run, and a set may have any size; only members of
    equal scores are ordered in one task.
    """
    rows = table.withColumn("_range", _range(F.col("score")))
    ends = rows.groupBy("key", "_range").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    ends = ends.select(F.col("key").alias("_key"), F.col("_range").alias("_own"), "_lo", "_hi")
    rows = rows.join(ends, F.col("key").eqNullSafe(F.col("_key")) & F.col("_range").eqNullSafe(F.col("_own")))
    part = F.floor((F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * PARTS)
    rows = rows.select(*table.columns, "_range", F.when(F.col("_hi") > F.col("_lo"), part).otherwise(0).alias("_part"))
    sizes = rows.groupBy("key", "_range", "_part").agg(F.count("*").alias("_size"))
    down = (lambda c: F.desc(c)) if reverse else (lambda c: F.asc(c))
    before = F.sum("_size").over(by_key(down("_range"), down("_part"))) - F.col("_size")
    sizes = sizes.select(F.col("key").alias("_key"), F.col("_range").alias("_r"), F.col("_part").alias("_p"), before.alias("_before"), F.sum("_size").over(by_key()).alias("n"))
    place = F.row_number().over(Window.partitionBy("key", "_range", "_part").orderBy(*_order(reverse))) - 1
    same = F.col("key").eqNullSafe(F.col("_key")) & F.col("_range").eqNullSafe(F.col("_r")) & (F.col("_part") == F.col("_p"))
    return rows.withColumn("_place", place).join(sizes, same).select(*table.columns, (F.col("_before") + F.col("_place")).alias("rank"), "n")


def bound(text: str) -> tuple[float, bool]:
    """A score bound: a number, ``-inf``, ``+inf``, or one of them after ``(`` for exclusive."""
    exclusive = text.startswith("(")
    value = float(text[1:] if exclusive else text)
    if value != value:
        raise CommandError("a bound is not a number")
    return value, exclusive


def in_scores(low: str, high: str) -> Column:
    (a, no_a), (b, no_b) = bound(low), bound(high)
    s = F.col("score")
    below, above = (s > a if no_a else s >= a), (s < b if no_b else s <= b)
    zero = F.startswith(s.cast("string"), F.lit("-"))
    if no_a and a == 0 and str(a).startswith("-"):  # beyond -0.0 lies 0.0
        below = below | ((s == 0) & ~zero)
    if no_b and b == 0 and not str(b).startswith("-"):
        above = above | ((s == 0) & zero)
    return below & above


def in_members(low: str, high: str) -> Column:
    """``-``, ``+``, ``[m`` and ``(m`` bounds on the member's bytes."""
    for x in (low, high):
        if x not in ("-", "+") and x[:1] not in ("[", "("):
            raise CommandError("a bound of members begins with [ or (, or is - or +")
    if low == "+" or high == "-":
        return F.lit(False)
    m, out = F.col("member"), F.lit(True)
    if low != "-":
        out = out & (m >= low[1:] if low[0] == "[" else m > low[1:])
    if high != "+":
        out = out & (m <= high[1:] if high[0] == "[" else m < high[1:])
    return out


def _paged(rows: DataFrame, reverse: bool, offset: int, count: int | None) -> DataFrame:
    if count is None or count < 0:
        return ranked(rows, reverse).withColumn("at", F.col("rank") - offset).filter(F.col("at") >= 0).drop("rank", "n")
    n = F.row_number().over(by_key(*_order(reverse)))
    rows = rows.withColumn("_m", n).filter(F.col("_m") <= offset + count)
    return rows.withColumn("at", F.col("_m") - 1 - offset).filter(F.col("at") >= 0).drop("_m")


def zadd(table: DataFrame, rows: DataFrame, nx: bool = False, xx: bool = False, gt: bool = False, lt: bool = False, incr: bool = False) -> DataFrame:
    """Writes rows of ``pos, key, member, score``, folding equal members in order, and tells what happened:
    ``key, member, score, old, outcome`` with outcome ``added``, ``updated`` or ``same``.

    NX keeps what is there, XX adds nothing, GT and LT only replace by a larger or smaller score and never keep
    a new member out; INCR adds to the old score. The table that results is ``zapply`` of this.
    """
    if nx and (xx or gt or lt) or gt and lt:
        raise CommandError("NX, XX, GT and LT contradict each other")
    old = table.select("key", "member", F.col("score").alias("old"))
    batch = rows.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("pos", "score"))).alias("_b")).join(old, KEYS, "left")

    def fold(now: Column, entry: Column) -> Column:
        s = now + entry["score"] if incr else entry["score"]
        s = F.when(now.isNull(), entry["score"]).otherwise(s)
        new = F.lit(None).cast("double") if xx else entry["score"]
        kept = now if nx else F.when(s > now, s).otherwise(now) if gt else F.when(s < now, s).otherwise(now) if lt else s
        return F.when(now.isNull(), new).otherwise(kept)

    out = batch.withColumn("score", F.aggregate("_b", F.col("old"), fold)).filter(F.col("score").isNotNull() | F.col("old").isNotNull())
    out = out.withColumn("score", F.when(F.isnan("score"), F.raise_error(F.lit("resulting score is not a number"))).otherwise(F.col("score")))
    outcome = F.when(F.col("old").isNull(), "added").when(F.col("old") == F.col("score"), "same").otherwise("updated")
    return out.select(*KEYS, "score", "old", outcome.alias("outcome"))


def zapply(table: DataFrame, outcome: DataFrame) -> DataFrame:
    return upsert(table, outcome.select(*KEYS, "score"), KEYS)


def zadd_reply(outcome: DataFrame, ch: bool = False) -> DataFrame:
    counted = F.col("outcome").isin("added", "updated") if ch else F.col("outcome") == "added"
    return outcome.groupBy("key").agg(F.sum(F.when(counted, 1).otherwise(0)).alias("n"))


def zincrby(table: DataFrame, rows: DataFrame) -> DataFrame:
    return zadd(table, rows, incr=True)


def zcard(table: DataFrame) -> DataFrame:
    return table.groupBy("key").agg(F.count("*").alias("n"))


def zmscore(table: DataFrame, asked: DataFrame) -> DataFrame:
    """``key, pos, member, score`` for rows of ``key, pos, member``, null where absent."""
    return asked.join(table, KEYS, "left").select("key", "pos", "member", "score")


def zscore(table: DataFrame, key: str, member: str) -> DataFrame:
    return table.filter((F.col("key") == key) & (F.col("member") == member)).select("score")


def zcount(table: DataFrame, low: str, high: str) -> DataFrame:
    return table.filter(in_scores(low, high)).groupBy("key").agg(F.count("*").alias("n"))


def zlexcount(table: DataFrame, low: str, high: str) -> DataFrame:
    return table.filter(in_members(low, high)).groupBy("key").agg(F.count("*").alias("n"))


def zrank(table: DataFrame, reverse: bool = False) -> DataFrame:
    return ranked(table, reverse).drop("n")


def zrange(table: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """The inclusive window of ranks, counted from the other end when reversed: ``key, rank, member, score``."""
    n = F.col("n")
    a = F.greatest(n + start, F.lit(0)) if start < 0 else F.lit(start)
    b = n + stop if stop < 0 else F.lit(stop)
    return ranked(table, reverse).filter((F.col("rank") >= a) & (F.col("rank") <= b)).drop("n")


def zrangebyscore(table: DataFrame, low: str, high: str, reverse: bool = False, offset: int = 0, count: int | None = None) -> DataFrame:
    """Scores between two bounds, lower one first whatever the order: ``key, member, score, at``."""
    return _paged(table.filter(in_scores(low, high)), reverse, offset, count)


def zrangebylex(table: DataFrame, low: str, high: str, reverse: bool = False, offset: int = 0, count: int | None = None) -> DataFrame:
    """Members between two bounds; they come in the order of scores."""
    return _paged(table.filter(in_members(low, high)), reverse, offset, count)


def zrandmember(table: DataFrame, count: int, seed: int) -> DataFrame:
    return random_members(table, "member", count, seed)


def zrem(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.join(rows.select(*KEYS).distinct(), KEYS, "left_anti")


def zpop(table: DataFrame, count: int = 1, highest: bool = False) -> tuple[DataFrame, DataFrame]:
    """Per key the popped members with their ``rank`` in pop order, and the rest."""
    nth = F.row_number().over(by_key(*_order(highest)))
    taken = table.withColumn("_m", nth).filter(F.col("_m") <= count).withColumn("rank", F.col("_m") - 1).drop("_m")
    return taken, zrem(table, taken)


def bzpop(table: DataFrame, keys: list[str], highest: bool = False) -> tuple[DataFrame, DataFrame]:
    """A blocking pop that finds something: ``key, member, score`` from the first key, in the given order, that
    has members, and the table without it."""
    place = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key"))
    taken = table.filter(F.col("key").isin(keys)).orderBy(place, *_order(highest)).limit(1).select("key", "member", "score")
    return taken, zrem(table, taken)


def zremrangebyrank(table: DataFrame, start: int, stop: int) -> DataFrame:
    return zrem(table, zrange(table, start, stop))


def zremrangebyscore(table: DataFrame, low: str, high: str) -> DataFrame:
    return table.filter(~in_scores(low, high))


def zremrangebylex(table: DataFrame, low: str, high: str) -> DataFrame:
    return table.filter(~in_members(low, high))


def zscan(table: DataFrame, cursor: str | None = None, glob: str = "*", count: int = 10) -> DataFrame:
    return page(table, ["key"], "member", cursor, glob, count)


def combine(table: DataFrame, keys: list[str], weights: list[float] | None = None, how: str = "sum", every: bool = False) -> DataFrame:
    """``member, score`` of the union, or with ``every`` the intersection, of weighted sets.

    One aggregation over the sets' rows, with map-side sums. A result that is not a number is an error.
    """
    weights = weights or [1.0] * len(keys)
    listed = table.sparkSession.createDataFrame([(i, k, float(w)) for i, (k, w) in enumerate(zip(keys, weights))], T.StructType.fromDDL("_i int, key string, _w double"))
    rows = table.join(F.broadcast(listed), "key").withColumn("_s", F.col("score") * F.col("_w"))
    score = {"sum": F.sum("_s"), "min": F.min("_s"), "max": F.max("_s")}[how]
    out = rows.groupBy("member").agg(score.alias("score"), F.count("*").alias("_n"))
    out = out.filter(F.col("_n") == len(keys)) if every else out
    return out.select("member", F.when(F.isnan("score"), F.raise_error(F.lit("resulting score is not a number"))).otherwise(F.col("score")).alias("score"))


def zdiff(table: DataFrame, keys: list[str]) -> DataFrame:
    first = table.filter(F.col("key") == keys[0]).select("member", "score")
    return first.join(table.filter(F.col("key").isin(keys[1:])).select("member").distinct(), "member", "left_anti")


def zstore(table: DataFrame, target: str, rows: DataFrame) -> DataFrame:
    return table.filter(F.col("key") != target).select(*KEYS, "score").unionByName(rows.select(F.lit(target).alias("key"), "member", "score"))
