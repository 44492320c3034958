"""Sets: tables of ``key, member`` without repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.hashes import random_members
from tessera.operators.strings import page

KEYS = ["key", "member"]


def sadd(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.select(*KEYS).union(rows.select(*KEYS)).distinct()


def sadd_new(table: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS).distinct().join(table, KEYS, "left_anti").groupBy("key").agg(F.count("*").alias("n"))


def srem(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.join(rows.select(*KEYS).distinct(), KEYS, "left_anti")


def smembers(table: DataFrame, key: str) -> DataFrame:
    return table.filter(F.col("key") == key).select("member").orderBy("member")


def smismember(table: DataFrame, asked: DataFrame) -> DataFrame:
    """``key, pos, member, flag`` for rows of ``key, pos, member``."""
    found = table.select(*KEYS, F.lit(1).alias("_f"))
    return asked.join(found, KEYS, "left").select("key", "pos", "member", F.coalesce("_f", F.lit(0)).alias("flag"))


def sismember(table: DataFrame, key: str, member: str) -> DataFrame:
    return table.filter((F.col("key") == key) & (F.col("member") == member)).agg(F.count("*").cast("int").alias("flag"))


def scard(table: DataFrame) -> DataFrame:
    return table.groupBy("key").agg(F.count("*").alias("n"))


def srandmember(table: DataFrame, count: int, seed: int) -> DataFrame:
    return random_members(table, "member", count, seed)


def spop(table: DataFrame, count: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """What is popped, and the table without it."""
    popped = random_members(table, "member", count, seed)
    return popped, srem(table, popped)


def smove(table: DataFrame, source: str, target: str, member: str) -> DataFrame:
    moved = table.filter((F.col("key") == source) & (F.col("member") == member))
    return srem(table, moved).unionByName(moved.withColumn("key", F.lit(target))).distinct()


def sscan(table: DataFrame, cursor: str | None = None, glob: str = "*", count: int = 10) -> DataFrame:
    return page(table, ["key"], "member", cursor, glob, count)


def _one(table: DataFrame, key: str) -> DataFrame:
    return table.filter(F.col("key") == key).select("member")


def sunion(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.filter(F.col("key").isin(keys)).select("member").distinct()


def sinter(table: DataFrame, keys: list[str]) -> DataFrame:
    """Members of all the keys: one aggregation, whatever their number."""
    keys = list(dict.fromkeys(keys))
    some = table.filter(F.col("key").isin(keys)).groupBy("member").agg(F.count("*").alias("n"))
    return some.filter(F.col("n") == len(keys)).select("member")


def sdiff(table: DataFrame, keys: list[str]) -> DataFrame:
    return _one(table, keys[0]).join(table.filter(F.col("key").isin(keys[1:])).select("member").distinct(), "member", "left_anti")


def store(table: DataFrame, target: str, members: DataFrame) -> DataFrame:
    """The result of an operation in place of a key; nothing stored leaves no key."""
    return table.filter(F.col("key") != target).select(*KEYS).unionByName(members.select(F.lit(target).alias("key"), "member"))
