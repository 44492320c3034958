"""Batches over a stored keyspace: order, atomicity, watches."""

import pytest
from pyspark.sql import functions as F

from tessera.errors import CommandError
from tessera.operators import sets, zsets
from tessera.sources.keyspace import Keyspace


def test_batches(spark, tmp_path):
    space = Keyspace(spark, str(tmp_path / "kv"))
    rows = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "2")], "key string, member string")
    scores = spark.createDataFrame([(0, "z", "m", 1.5)], "pos int, key string, member string, score double")
    done = space.batch().queue("set", lambda t: sets.sadd(t, rows)).queue("set", lambda t: sets.store(t, "b", sets.sdiff(t, ["a", "b"]))).queue("zset", lambda t: zsets.zapply(t, zsets.zadd(t, scores))).execute()
    assert done and sorted(map(tuple, space.table("set").collect())) == [("a", "1"), ("a", "2"), ("b", "1")]
    assert [tuple(r) for r in space.table("zset").collect()] == [("z", "m", 1.5)]
    with pytest.raises(Exception, match="stop"):
        space.batch().queue("set", lambda t: t.limit(0)).queue("zset", lambda t: t.withColumn("score", F.raise_error(F.lit("stop")).cast("double"))).execute()
    assert space.table("set").count() == 3


def test_watches(spark, tmp_path):
    space = Keyspace(spark, str(tmp_path / "kv"))
    one = spark.createDataFrame([("a", "1")], "key string, member string")
    space.apply("set", lambda t: sets.sadd(t, one))
    batch = space.batch().watch("set", "a")
    space.apply("set", lambda t: sets.srem(t, one))
    assert not batch.queue("set", lambda t: sets.sadd(t, one)).execute() and space.table("set").count() == 0
    batch = space.batch().watch("set", "other")
    space.apply("set", lambda t: sets.sadd(t, one))
    assert batch.queue("set", lambda t: t.limit(0)).execute() and space.table("set").count() == 0
    with pytest.raises(CommandError):
        space.batch().queue("set", lambda t: t).watch("set", "a")


def test_changes_of_named_keys(spark, tmp_path):
    space = Keyspace(spark, str(tmp_path / "kv"))
    expected = {(f"k{i % 20}", str(i)) for i in range(100)}
    space.apply("set", lambda t: spark.createDataFrame(sorted(expected), "key string, member string"))
    base = space.storage.manifest(1)["tables"]["set"]["base"]
    for n in range(10):
        one, gone = f"k{n % 4}", f"k{10 + n % 3}"
        new = spark.createDataFrame([(one, f"x{n}")], "key string, member string")
        assert space.batch().queue("set", lambda t, new=new: sets.sadd(t, new), one).queue("set", lambda t: t.limit(0), gone).execute()
        expected = {r for r in expected if r[0] != gone} | {(one, f"x{n}")}
        assert set(map(tuple, space.table("set").collect())) == expected
        entry = space.storage.manifest(space.storage.latest())["tables"]["set"]
        assert (entry["base"] == base, len(entry["deltas"])) == ((True, 2 * n + 2) if n < 8 else (False, 2 * (n - 8)))
    assert space.table("set", 2).filter("key = 'k0'").count() == 6
    with pytest.raises(Exception, match="does not name: k9"):
        space.apply("set", lambda t: t.unionAll(spark.createDataFrame([("k9", "y")], "key string, member string")), "k1")
    space.vacuum(keep=1, older_s=-60)
    assert set(map(tuple, space.table("set").collect())) == expected


def test_keys_of_every_kind(spark, tmp_path):
    space = Keyspace(spark, str(tmp_path / "kv"))
    members = spark.createDataFrame([("s", "1"), ("s", "2"), ("o", "3")], "key string, member string")
    fields = spark.createDataFrame([("h", "f", "v")], "key string, field string, value string")
    space.batch().queue("set", lambda t: members).queue("hash", lambda t: fields).execute()

    def types(now):
        return sorted(map(tuple, space.types(now).select("key", "type", "deadline").collect()), key=str)

    assert space.expire({"s": 100, "h": 200, "none": 5}, now_ms=10) == 2
    assert types(10) == [("h", "hash", 200), ("o", "set", None), ("s", "set", 100)]
    assert types(100) == [("h", "hash", 200), ("o", "set", None)]
    assert space.live("set", 99).count() == 3 and space.live("set", 100).count() == 1
    assert space.expire({"s": 300}, now_ms=100) == 0  # a key whose deadline has come is not there
    space.purge(100)
    assert space.table("set").count() == 1 and types(10) == [("h", "hash", 200), ("o", "set", None)]
    space.apply("set", lambda t: t.unionAll(members.filter("key = 's'")), "s")
    assert not space.rename("h", "o", 10, nx=True)
    assert space.rename("h", "o", 10)
    assert types(10) == [("o", "hash", 200), ("s", "set", None)]
    space.persist("o")
    space.delete("s")
    assert types(10) == [("o", "hash", None)]
    with pytest.raises(CommandError, match="no such key"):
        space.rename("s", "o", 10)
