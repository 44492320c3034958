"""Lists: tables of ``key, pos, elem``; positions order a key's elements and need not be dense."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tessera.functions.places import places


def by_key(*order: str | Column) -> WindowSpec:
    return Window.partitionBy("key").orderBy(*order) if order else Window.partitionBy("key")


def ranked(table: DataFrame) -> DataFrame:
    """With ``i`` from 0 at the head, and the list's length ``n``."""
    return places(table, "key", "pos", "i", "n")


def _without(table: DataFrame, gone: DataFrame) -> DataFrame:
    """The table without the rows at the places of ``gone``."""
    gone = gone.select(F.col("key").alias("_key"), F.col("pos").alias("_pos"))
    return table.join(gone, F.col("key").eqNullSafe(F.col("_key")) & (F.col("pos") == F.col("_pos")), "left_anti")


def _window(start: int, stop: int) -> Column:
    """Is ``i`` in the inclusive window? Negatives count from the end; a start before the head is the head."""
    n = F.col("n")
    a = F.greatest(n + start, F.lit(0)) if start < 0 else F.lit(start)
    b = n + stop if stop < 0 else F.lit(stop)
    return (F.col("i") >= a) & (F.col("i") <= b)


def push(table: DataFrame, rows: DataFrame, left: bool = False, only_existing: bool = False) -> DataFrame:
    """Adds rows of ``key, pos, elem`` in their order to one end; from the left they end up reversed."""
    if only_existing:
        rows = rows.join(table.select("key").distinct(), "key", "left_semi")
    ends = table.groupBy("key").agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi"))
    n = F.row_number().over(by_key("pos"))
    new = rows.withColumn("_n", n).join(ends, "key", "left")
    at = F.coalesce("_lo", F.lit(0)) - F.col("_n") if left else F.coalesce("_hi", F.lit(-1)) + F.col("_n")
    return table.unionByName(new.select("key", at.cast("long").alias("pos"), "elem"))


def llen(table: DataFrame) -> DataFrame:
    return table.groupBy("key").agg(F.count("*").alias("n"))


def lindex(table: DataFrame, index: int) -> DataFrame:
    rows = ranked(table)
    return rows.filter(F.col("i") == (F.lit(index) if index >= 0 else F.col("n") + index)).select("key", "elem")


def lrange(table: DataFrame, start: int, stop: int) -> DataFrame:
    """``key, i, elem`` of the inclusive window of every list."""
    return ranked(table).filter(_window(start, stop)).select("key", "i", "elem")


def ltrim(table: DataFrame, start: int, stop: int) -> DataFrame:
    return ranked(table).filter(_window(start, stop)).select(*table.columns)


def lset(table: DataFrame, key: str, index: int, elem: str) -> DataFrame:
    hit = (F.col("key") == key) & (F.col("i") == (F.lit(index) if index >= 0 else F.col("n") + index))
    return ranked(table).withColumn("elem", F.when(hit, F.lit(elem)).otherwise(F.col("elem"))).select(*table.columns)


def linsert(table: DataFrame, pivot: str, elem: str, after: bool = False) -> DataFrame:
    """Each list with ``elem`` beside its first ``pivot``; lists without it stay as they are."""
    spread = ranked(table).select("key", (F.col("i") * 2).cast("long").alias("pos"), "elem")
    first = spread.filter(F.col("elem") == pivot).groupBy("key").agg(F.min("pos").alias("pos"))
    new = first.select("key", (F.col("pos") + (1 if after else -1)).alias("pos"), F.lit(elem).alias("elem"))
    return spread.unionByName(new)


def lpos(table: DataFrame, elem: str, rank: int = 1, count: int | None = None, maxlen: int = 0) -> DataFrame:
    """``key, at, i`` of matches: from match ``rank`` on (from the tail if negative), ``count`` of them (all for
    0, one if absent), among the first ``maxlen`` elements that are visited."""
    rows = ranked(table)
    if maxlen:
        rows = rows.filter(F.col("i") < maxlen if rank > 0 else F.col("i") >= F.col("n") - maxlen)
    hits = rows.filter(F.col("elem") == elem).select("key", "pos", F.col("i").alias("found"))
    if count == 0:
        hits = ranked(hits)
        nth = F.col("i") + 1 if rank > 0 else F.col("n") - F.col("i")
    else:
        nth = F.col("_m")
        hits = hits.withColumn("_m", F.row_number().over(by_key("pos" if rank > 0 else F.desc("pos")))).filter(nth < abs(rank) + (count or 1))
    return hits.withColumn("at", nth - abs(rank)).filter("at >= 0").select("key", "at", F.col("found").alias("i"))


def lrem(table: DataFrame, elem: str, count: int) -> DataFrame:
    """Without the first ``count`` matches from the head, the last ones if negative, all for 0."""
    match = F.col("elem") == elem
    if count == 0:
        return table.filter(~match)
    nth = F.row_number().over(by_key("pos" if count > 0 else F.desc("pos")))
    return _without(table, table.filter(match).select("key", "pos").withColumn("_m", nth).filter(F.col("_m") <= abs(count)))


def pop(table: DataFrame, count: int = 1, left: bool = True) -> tuple[DataFrame, DataFrame]:
    """Per key the popped elements in pop order (``key, at, elem``), and the rest."""
    nth = F.row_number().over(by_key("pos" if left else F.desc("pos")))
    taken = table.withColumn("_m", nth).filter(F.col("_m") <= count)
    return taken.select("key", (F.col("_m") - 1).alias("at"), "elem"), _without(table, taken)


def lmove(table: DataFrame, source: str, target: str, from_left: bool, to_left: bool) -> DataFrame:
    """One element from an end of ``source`` to an end of ``target``; with one key the list turns."""
    order = F.asc("pos") if from_left else F.desc("pos")
    taken = table.filter(F.col("key") == source).orderBy(order).limit(1)
    rest = table.join(taken.select("key", "pos"), ["key", "pos"], "left_anti")
    return push(rest, taken.withColumn("key", F.lit(target)), left=to_left)


def rpoplpush(table: DataFrame, source: str, target: str) -> DataFrame:
    return lmove(table, source, target, from_left=False, to_left=True)


def bpop(table: DataFrame, keys: list[str], left: bool = True) -> tuple[DataFrame, DataFrame]:
    """A blocking pop that finds something: the popped ``key, elem`` and the table without it."""
    place = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key"))
    taken = table.filter(F.col("key").isin(keys)).orderBy(place, F.asc("pos") if left else F.desc("pos")).limit(1)
    return taken.select("key", "elem"), table.join(taken.select("key", "pos"), ["key", "pos"], "left_anti").select(*table.columns)


def blmove(table: DataFrame, source: str, target: str, from_left: bool, to_left: bool) -> tuple[DataFrame, DataFrame]:
    """The moved ``elem`` and the table after it; an empty source moves nothing, where a client would wait."""
    order = F.asc("pos") if from_left else F.desc("pos")
    return table.filter(F.col("key") == source).orderBy(order).limit(1).select("elem"), lmove(table, source, target, from_left, to_left)


def brpoplpush(table: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    return blmove(table, source, target, from_left=False, to_left=True)


def first_waiting(table: DataFrame, keys: list[str], left: bool = True) -> DataFrame:
    """What a blocking pop gives at once: the end of the first key, in the given order, that has elements."""
    place = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key"))
    rows = table.filter(F.col("key").isin(keys))
    return rows.orderBy(place, F.asc("pos") if left else F.desc("pos")).limit(1).select("key", "elem")
