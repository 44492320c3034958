"""Hashes: tables of ``key, field, value``. A hash without fields is not there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import last_of, number_text, upsert
from tessera.operators.strings import page

KEYS = ["key", "field"]


def hset(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Writes rows of ``pos, key, field, value``; the last of equal fields stays."""
    return upsert(table, last_of(rows, KEYS).select(*KEYS, "value"), KEYS)


def hset_new(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``key, n``: how many fields ``hset`` would add."""
    return rows.select(*KEYS).distinct().join(table, KEYS, "left_anti").groupBy("key").agg(F.count("*").alias("n"))


def hsetnx(table: DataFrame, rows: DataFrame) -> DataFrame:
    new = rows.select(*KEYS, "value").join(table.select(*KEYS), KEYS, "left_anti")
    return table.unionByName(new)


def hget(table: DataFrame, key: str, field: str) -> DataFrame:
    return table.filter((F.col("key") == key) & (F.col("field") == field))


def hmget(table: DataFrame, asked: DataFrame) -> DataFrame:
    """``key, pos, field, value`` for rows of ``key, pos, field``, null where absent."""
    return asked.join(table, KEYS, "left").select("key", "pos", "field", "value")


def hdel(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.join(rows.select(*KEYS).distinct(), KEYS, "left_anti")


def hlen(table: DataFrame) -> DataFrame:
    return table.groupBy("key").agg(F.count("*").alias("n"))


def hexists(table: DataFrame, asked: DataFrame) -> DataFrame:
    found = table.select(*KEYS, F.lit(1).alias("found"))
    return asked.join(found, KEYS, "left").select(*asked.columns, F.coalesce("found", F.lit(0)).alias("found"))


def hstrlen(table: DataFrame, asked: DataFrame) -> DataFrame:
    """Bytes of each asked value, 0 where absent."""
    return asked.join(table, KEYS, "left").select(*KEYS, F.coalesce(F.octet_length("value"), F.lit(0)).alias("n"))


def hgetall(table: DataFrame) -> DataFrame:
    """``key, pairs``: fields with values, by field. One hash must fit a row; for larger ones read the table."""
    pairs = F.sort_array(F.collect_list(F.struct("field", "value")))
    return table.groupBy("key").agg(pairs.alias("pairs"))


def hkeys(table: DataFrame) -> DataFrame:
    return hgetall(table).select("key", F.col("pairs.field").alias("fields"))


def hvals(table: DataFrame) -> DataFrame:
    return hgetall(table).select("key", F.col("pairs.value").alias("values"))


def _added(table: DataFrame, rows: DataFrame, kind: str, shown) -> DataFrame:
    """Sums of ``delta`` per field on the old value; text that is no number is an error, as is a sum that
    overflows, is infinite or is no number."""
    total = rows.groupBy(*KEYS).agg(F.try_sum(F.col("delta").cast(kind)).alias("_d"))
    text = F.col("value")
    number = F.when(text.isNull(), F.lit(0).cast(kind)).when(text.try_cast(kind).isNotNull(), text.try_cast(kind)).otherwise(F.raise_error(F.lit("hash value is not a number")).cast(kind))
    summed = F.call_function("try_add", number, F.col("_d")) if kind == "bigint" else number + F.col("_d")
    bad = summed.isNull() if kind == "bigint" else summed.isNull() | F.isnan(summed) | (F.abs(summed) == float("inf"))
    checked = F.when(bad, F.raise_error(F.lit("increment would overflow, or be infinite or no number")).cast(kind)).otherwise(summed)
    new = total.join(table, KEYS, "left").select(*KEYS, shown(checked).alias("value"))
    return upsert(table, new, KEYS)


def hincrby(table: DataFrame, rows: DataFrame) -> DataFrame:
    return _added(table, rows, "bigint", lambda c: c.cast("string"))


def hincrbyfloat(table: DataFrame, rows: DataFrame) -> DataFrame:
    return _added(table, rows, "double", number_text)


def random_members(table: DataFrame, column: str, count: int, seed: int) -> DataFrame:
    """Per key ``count`` distinct members in hashed order, or for a negative count so many with repetition."""
    order = Window.partitionBy("key").orderBy(F.xxhash64(column, F.lit(seed)), column)
    ranked = table.withColumn("_n", F.row_number().over(order))
    if count >= 0:
        return ranked.filter(F.col("_n") <= count).drop("_n")
    sizes = table.groupBy("key").agg(F.count("*").alias("_size"))
    draws = sizes.select("key", "_size", F.explode(F.sequence(F.lit(1), F.lit(-count))).alias("_draw"))
    draw: Column = F.pmod(F.xxhash64("key", "_draw", F.lit(seed)), F.col("_size")) + 1
    return draws.select("key", "_draw", draw.alias("_n")).join(ranked, ["key", "_n"]).drop("_n", "_draw")


def hrandfield(table: DataFrame, count: int, seed: int) -> DataFrame:
    return random_members(table, "field", count, seed)


def hscan(table: DataFrame, cursor: str | None = None, glob: str = "*", count: int = 10) -> DataFrame:
    return page(table, ["key"], "field", cursor, glob, count)
