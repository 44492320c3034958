"""Strings, keys and deadlines: tables of ``key, value, expire_ms`` (and ``kind`` for whole keyspaces).

Every function takes ``now_ms``; a row whose deadline has passed is not there. Writers return the new table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import CommandError
from tessera.functions.columns import glob_regex, last_of, live, ttl_seconds, upsert

#: A key's kind and what TYPE calls it.
TYPE_NAMES = {"string": "string", "hash": "hash", "set": "set", "list": "list", "zset": "zset", "stream": "stream", "json": "ReJSON-RL", "vector": "vectorset", "search": "search"}


def alive(table: DataFrame, now_ms: int) -> DataFrame:
    return table.filter(live(F.col("expire_ms"), now_ms))


def get(table: DataFrame, key: str, now_ms: int) -> DataFrame:
    return alive(table, now_ms).filter(F.col("key") == key).select("key", "value")


def mget(table: DataFrame, keys: DataFrame, now_ms: int) -> DataFrame:
    """``pos, key, value`` for rows of ``pos, key``; null where there is no such key."""
    found = alive(table, now_ms).select(F.col("key").alias("_k"), "value")
    return keys.join(found, F.col("key") == F.col("_k"), "left").select("pos", "key", "value")


def set_(table: DataFrame, rows: DataFrame, now_ms: int, nx: bool = False, xx: bool = False, keep_ttl: bool = False) -> DataFrame:
    """Writes rows of ``key, value, expire_ms``: any, only new (``nx``) or only existing (``xx``) keys."""
    if nx and xx:
        raise CommandError("NX and XX exclude each other")
    there = alive(table, now_ms)
    if nx or xx:
        rows = rows.join(there.select("key"), "key", "left_anti" if nx else "left_semi")
    if keep_ttl:
        old = there.select("key", F.col("expire_ms").alias("_old"))
        rows = rows.join(old, "key", "left").withColumn("expire_ms", F.coalesce("_old", F.lit(0))).drop("_old")
    return upsert(there, rows.select(*table.columns), ["key"])


def mset(table: DataFrame, rows: DataFrame, now_ms: int) -> DataFrame:
    """Writes rows of ``pos, key, value``; of a key that repeats the last stays; deadlines are cleared."""
    last = last_of(rows, ["key"]).select("key", "value").withColumn("expire_ms", F.lit(0).cast("long"))
    return upsert(alive(table, now_ms), last, ["key"])


def delete(table: DataFrame, keys: DataFrame, now_ms: int) -> DataFrame:
    return alive(table, now_ms).join(keys.select("key").distinct(), "key", "left_anti")


def exists(table: DataFrame, keys: DataFrame, now_ms: int) -> DataFrame:
    """How many of the asked keys are there, each as often as it is asked."""
    return keys.join(alive(table, now_ms).select("key").distinct(), "key").agg(F.count("*").alias("n"))


def type_of(table: DataFrame, keys: DataFrame, now_ms: int) -> DataFrame:
    """``key, type`` by the keyspace's ``kind``; ``none`` where the key is missing."""
    name = F.create_map(*[F.lit(x) for kv in TYPE_NAMES.items() for x in kv])
    kinds = alive(table, now_ms).select("key", "kind").distinct()
    return keys.join(kinds, "key", "left").select("key", F.coalesce(name[F.col("kind")], F.lit("none")).alias("type"))


def expire(table: DataFrame, keys: DataFrame, deadline_ms: Column, now_ms: int, when: str = "") -> DataFrame:
    """Sets the deadline of the given keys; a deadline that has passed deletes.

    ``when``: NX only without one, XX only with one, GT only later than one, LT only earlier than one; a key
    without a deadline passes neither GT nor LT.
    """
    old = F.col("expire_ms")
    allowed = {"": F.lit(True), "NX": old == 0, "XX": old > 0, "GT": (old > 0) & (deadline_ms > old), "LT": (old > 0) & (deadline_ms < old)}[when]
    asked = keys.select(F.col("key").alias("_k")).distinct()
    marked = alive(table, now_ms).join(asked, F.col("key") == F.col("_k"), "left")
    new = F.when(F.col("_k").isNotNull() & allowed, deadline_ms).otherwise(old)
    return alive(marked.withColumn("expire_ms", new).select(*table.columns), now_ms)


def persist(table: DataFrame, keys: DataFrame, now_ms: int) -> DataFrame:
    asked = keys.select(F.col("key").alias("_k")).distinct()
    marked = alive(table, now_ms).join(asked, F.col("key") == F.col("_k"), "left")
    return marked.withColumn("expire_ms", F.when(F.col("_k").isNotNull(), F.lit(0)).otherwise(F.col("expire_ms"))).select(*table.columns)


def ttl(table: DataFrame, keys: DataFrame, now_ms: int, milliseconds: bool = False) -> DataFrame:
    """``key, ttl``: -2 missing, -1 without a deadline, else what remains, in seconds rounded half up."""
    left = ttl_seconds(F.col("expire_ms"), now_ms)
    if milliseconds:
        left = F.when(F.col("expire_ms") == 0, F.lit(-1).cast("long")).otherwise(F.col("expire_ms") - F.lit(now_ms))
    found = alive(table, now_ms).select(F.col("key").alias("_k"), left.alias("_t"))
    return keys.join(found, F.col("key") == F.col("_k"), "left").select("key", F.coalesce("_t", F.lit(-2).cast("long")).alias("ttl"))


def keys(table: DataFrame, glob: str, now_ms: int) -> DataFrame:
    return alive(table, now_ms).filter(F.col("key").rlike(glob_regex(glob))).select("key")


def scan(table: DataFrame, now_ms: int, cursor: str | None = None, glob: str = "*", count: int = 10, kind: str | None = None) -> DataFrame:
    """A page of keys after ``cursor`` in key order; the page's last key is the next cursor."""
    rows = alive(table, now_ms)
    rows = rows.filter(F.col("key") > cursor) if cursor is not None else rows
    rows = rows.filter(F.col("kind") == kind) if kind else rows
    return rows.filter(F.col("key").rlike(glob_regex(glob))).select("key").orderBy("key").limit(count)


def random_key(table: DataFrame, now_ms: int, seed: int) -> DataFrame:
    return alive(table, now_ms).select("key").orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(1)


def rename(table: DataFrame, source: str, target: str, now_ms: int, nx: bool = False) -> DataFrame:
    """Moves a key with its deadline, over another one unless ``nx``; a missing source is an error to the
    caller, and leaves the table as it is."""
    rows = alive(table, now_ms)
    moved = rows.filter(F.col("key") == source)
    if nx:
        moved = moved.join(rows.filter(F.col("key") == target).select(F.lit(source).alias("_s")).distinct(), F.col("key") == F.col("_s"), "left_anti")
    taken = moved.select(F.explode(F.array(F.lit(source), F.lit(target))).alias("key")).distinct()
    return rows.join(taken, "key", "left_anti").unionByName(moved.withColumn("key", F.lit(target)))


def strlen(table: DataFrame, now_ms: int) -> DataFrame:
    return alive(table, now_ms).select("key", F.octet_length("value").alias("n"))


def page(rows: DataFrame, by: list[str], column: str, cursor: str | None, glob: str, count: int) -> DataFrame:
    """The cursor scan of hashes, sets and sorted sets: per ``by`` the next ``count`` of ``column``."""
    rows = rows.filter(F.col(column) > cursor) if cursor is not None else rows
    n = F.row_number().over(Window.partitionBy(*by).orderBy(column))
    return rows.filter(F.col(column).rlike(glob_regex(glob))).withColumn("_n", n).filter(F.col("_n") <= count).drop("_n")
