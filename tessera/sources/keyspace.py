"""A stored keyspace: one table a kind of collection, and batches that commit together or not at all.

A batch queues transforms (DataFrame to DataFrame) and applies them in order on one snapshot; its commit is the
creation of one manifest. A transform that names its keys sees and writes the rows of these only: they become a
delta, and a kind of over eight deltas is folded into a new base in the order of its keys. Watched keys are compared
by a hash of all their rows, so a change anywhere in them since the watch ends the batch without effect.

A key has one deadline whatever its kind, in the table ``ttl``; who reads gives the time. A string may carry one of
its own besides, in ``expire_ms``, and is gone when either has come.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import CommandError
from tessera.sources.storage import MOST_DELTAS, Conflict, Storage

#: The columns of each kind.
SCHEMAS = {
    "string": "key string, value string, expire_ms long",
    "hash": "key string, field string, value string",
    "set": "key string, member string",
    "list": "key string, pos long, elem string",
    "zset": "key string, member string, score double",
    "json": "key string, doc string",
    "vector": "key string, element string, vector array<double>, attr string",
    "stream": "stream string, ms long, seq long, fields array<struct<name:string,value:string>>",
    "ttl": "key string, expire_ms long",
}

Transform = Callable[[DataFrame], DataFrame]


def key_of(kind: str) -> str:
    return "stream" if kind == "stream" else "key"


def ended(deadline: str, now_ms: int) -> Column:
    return F.coalesce(F.col(deadline) <= now_ms, F.lit(False))


class Keyspace:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.storage = spark, Storage(spark, root)

    def table(self, kind: str, at: int | None = None) -> DataFrame:
        """A kind's rows, at the latest commit or an earlier one."""
        return self.rows(kind, self.storage.manifest(self.storage.latest() if at is None else at)["tables"].get(kind))

    def rows(self, kind: str, entry: dict | None) -> DataFrame:
        """The rows of a manifest's entry. Its deltas are pairs of folders: the keys that are replaced, which may
        have no rows any more, and their rows. A key's newest pair counts, and the base where there is none."""
        if entry is None:
            return self.spark.createDataFrame([], SCHEMAS[kind])
        read = self.spark.read
        base, deltas, key = read.schema(SCHEMAS[kind]).parquet(entry["base"]), entry["deltas"], key_of(kind)
        if not deltas:
            return base
        keys, rows = None, None
        for n in range(0, len(deltas), 2):
            own = read.schema("_key string").parquet(deltas[n]).withColumn("_turn", F.lit(n))
            new = read.schema(SCHEMAS[kind]).parquet(deltas[n + 1]).withColumn("_turn", F.lit(n))
            keys, rows = (own, new) if keys is None else (keys.unionAll(own), rows.unionAll(new))
        newest = keys.groupBy("_key").agg(F.max("_turn").alias("_last"))
        rows = rows.join(newest, (F.col(key) == F.col("_key")) & (F.col("_turn") == F.col("_last"))).select(*base.columns)
        return base.join(newest, F.col(key) == F.col("_key"), "left_anti").unionAll(rows)

    def live(self, kind: str, now_ms: int) -> DataFrame:
        """A kind's rows without those of keys whose deadline has come."""
        at = self.storage.latest()
        rows, gone = self.table(kind, at), self.table("ttl", at).filter(ended("expire_ms", now_ms)).select(F.col("key").alias("_key"))
        rows = rows.join(gone, F.col(key_of(kind)) == F.col("_key"), "left_anti")
        return rows.filter(~ended("expire_ms", now_ms)) if kind == "string" else rows

    def types(self, now_ms: int) -> DataFrame:
        """``key, type`` of each living key; ``deadline`` is null where it has none."""
        out = None
        for kind in SCHEMAS:
            if kind != "ttl":
                some = self.live(kind, now_ms).select(F.col(key_of(kind)).alias("key")).distinct().withColumn("type", F.lit(kind))
                out = some if out is None else out.unionAll(some)
        return out.join(self.table("ttl").withColumnRenamed("expire_ms", "deadline"), "key", "left")

    def apply(self, kind: str, change: Transform, *keys: str) -> None:
        self.batch().queue(kind, change, *keys).execute()

    def batch(self) -> Batch:
        return Batch(self)

    def _held(self) -> list[str]:
        """The kinds that have ever had rows."""
        tables = self.storage.manifest(self.storage.latest())["tables"]
        return [k for k in SCHEMAS if k in tables]

    def expire(self, deadlines: dict[str, int], now_ms: int) -> int:
        """Sets the deadlines of those keys that live, of whatever kind; how many."""
        while True:
            batch = self.batch()
            for kind in self._held():
                batch.watch(kind, *deadlines)
            found = [r[0] for r in self.types(now_ms).filter(F.col("key").isin(*deadlines)).select("key").distinct().collect()]
            if not found:
                return 0
            new = self.spark.createDataFrame([(k, deadlines[k]) for k in found], SCHEMAS["ttl"])
            if batch.queue("ttl", lambda t, new=new: new, *found).execute():
                return len(found)

    def persist(self, *keys: str) -> None:
        """Takes the keys' deadlines away."""
        batch = self.batch().queue("ttl", lambda t: t.limit(0), *keys)
        if "string" in self._held():
            batch.queue("string", lambda t: t.withColumn("expire_ms", F.lit(None).cast("long")), *keys)
        batch.execute()

    def delete(self, *keys: str) -> None:
        """The keys go, in every kind, with their deadlines."""
        batch = self.batch()
        for kind in self._held():
            batch.queue(kind, lambda t: t.limit(0), *keys)
        batch.execute()

    def rename(self, old: str, new: str, now_ms: int, nx: bool = False) -> bool:
        """All that ``old`` holds goes to ``new``, with its deadline, in place of what is there. A key that does
        not live is an error; with ``nx`` a living ``new`` stays, and the answer is False."""
        while True:
            batch = self.batch()
            for kind in self._held():
                batch.watch(kind, old, new)
            there = {r[0] for r in self.types(now_ms).filter(F.col("key").isin(old, new)).select("key").distinct().collect()}
            if old not in there:
                raise CommandError("no such key")
            if old == new or nx and new in there:
                return not nx
            for kind in self._held():
                key = key_of(kind)
                batch.queue(kind, lambda t, key=key: t.filter(F.col(key) == old).withColumn(key, F.lit(new)), old, new)
            if batch.execute():
                return True

    def purge(self, now_ms: int) -> None:
        """Takes the keys whose deadline has come out of every kind, so that their names are free again; a change
        of such a key's old rows would else stay hidden."""
        batch, gone = self.batch(), self.table("ttl").filter(ended("expire_ms", now_ms)).select(F.col("key").alias("_key"))
        for kind in self._held():
            batch.queue(kind, lambda t, key=key_of(kind): t.join(gone, F.col(key) == F.col("_key"), "left_anti"))
        batch.execute()

    def vacuum(self, keep: int = 10, older_s: float = 86_400) -> int:
        """Deletes what only commits before the newest ``keep`` can see, and what writers left behind."""
        return self.storage.vacuum(keep, older_s)


class Batch:
    """Queue, then ``execute`` or ``discard``; ``watch`` comes before."""

    def __init__(self, space: Keyspace):
        self.space, self.queued, self.watched = space, [], {}

    def _print(self, kind: str, key: str) -> tuple:
        rows = self.space.table(kind)
        own = rows.filter(F.col(key_of(kind)) == key)
        found = own.agg(F.count("*"), F.bit_xor(F.xxhash64(*own.columns)), F.sum(F.xxhash64(*own.columns).cast("decimal(38,0)"))).first()
        return tuple(found)

    def watch(self, kind: str, *keys: str) -> Batch:
        if self.queued:
            raise CommandError("WATCH inside MULTI is not allowed")
        for k in keys:
            self.watched[kind, k] = self._print(kind, k)
        return self

    def unwatch(self) -> Batch:
        self.watched.clear()
        return self

    def queue(self, kind: str, change: Transform, *keys: str) -> Batch:
        """A change of a kind's table; with ``keys``, of the rows of these only, which is all it sees and gives."""
        if kind not in SCHEMAS:
            raise CommandError(f"no kind {kind!r}")
        self.queued.append((kind, change, keys))
        return self

    def discard(self) -> None:
        self.queued.clear()
        self.watched.clear()

    def _changed(self, kind: str, entry: dict | None, changes: list[tuple[Transform, tuple]]) -> dict:
        """The entry after a kind's changes: a delta if all of them name their keys, else a new base."""
        space, key = self.space, key_of(kind)
        names = [f.split()[0] for f in SCHEMAS[kind].split(", ")]
        named = sorted({k for _, keys in changes for k in keys}) if all(keys for _, keys in changes) else None
        rows = space.rows(kind, entry)
        if named is not None:
            rows = rows.filter(F.col(key).isin(*named))
        for change, keys in changes:
            if keys:
                rest = rows.filter(~F.col(key).isin(*keys))
                own = change(rows.filter(F.col(key).isin(*keys))).select(*names)
                strange = F.raise_error(F.concat(F.lit("a change writes a key that it does not name: "), key))
                rows = rest.unionByName(own.withColumn(key, F.when(F.col(key).isin(*keys), F.col(key)).otherwise(strange)))
            else:
                rows = change(rows).select(*names)
        if named is None or entry is None:
            return {"base": space.storage.write(kind, rows, key), "deltas": []}
        own = space.spark.createDataFrame([(k,) for k in named], "_key string").coalesce(1)
        entry = entry | {"deltas": [*entry["deltas"], space.storage.write(kind, own), space.storage.write(kind, rows)]}
        if len(entry["deltas"]) > 2 * MOST_DELTAS:
            return {"base": space.storage.write(kind, space.rows(kind, entry), key), "deltas": []}
        return entry

    def execute(self) -> bool:
        """True once committed; False, without effect, if a watched key has changed."""
        while True:
            n = self.space.storage.latest()
            if any(self._print(kind, key) != was for (kind, key), was in self.watched.items()):
                self.discard()
                return False
            kinds: dict[str, list] = {}
            for kind, change, keys in self.queued:
                kinds.setdefault(kind, []).append((change, keys))
            manifest = self.space.storage.manifest(n)
            for kind, changes in kinds.items():
                manifest["tables"][kind] = self._changed(kind, manifest["tables"].get(kind), changes)
            try:
                self.space.storage.commit(n + 1, manifest)
            except Conflict:
                continue
            self.discard()
            return True
