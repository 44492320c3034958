"""Queries of keyed commands that change collections, each over a whole table; see ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import json_paths as J
from tessera.operators import hashes, lists, sets, strings, vectors, zsets
from tessera.queries import _LIST, _LIVE, _X, _Z, NOW, _by_priority, _entries, _hash, _lists, _strings, _zset, query, read
from tessera.streaming import log

# hashes: the customers of a segment
_H = "WITH h AS (SELECT c_custkey, c_mktsegment AS key, c_name AS field, CAST(c_nationkey AS VARCHAR) AS value FROM customer) "


def _some(spark: SparkSession, sf: str, where: str) -> DataFrame:
    return read(spark, sf, "customer").filter(where).select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("field"))


@query("kv_hash_hset", _H + "SELECT key, field, CASE WHEN c_custkey % 2 = 0 THEN 'last' ELSE value END AS value FROM h UNION ALL SELECT 'fresh', field, 'last' FROM h WHERE c_custkey % 2 = 0")
def _(spark, sf):
    some = _some(spark, sf, "c_custkey % 2 = 0")
    twice = some.unionByName(some.withColumn("key", F.lit("fresh")))
    rows = twice.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("pos"), F.lit(v).alias("value")) for n, v in enumerate(("first", "last"))])).alias("w")).select("key", "field", "w.*")
    return hashes.hset(_hash(spark, sf), rows)


@query("kv_hash_hsetnx", _H + "SELECT key, field, value FROM h UNION ALL SELECT 'fresh', field, 'x' FROM h WHERE c_custkey % 5 = 0")
def _(spark, sf):
    some = _some(spark, sf, "c_custkey % 5 = 0").withColumn("value", F.lit("x"))
    return hashes.hsetnx(_hash(spark, sf), some.unionByName(some.withColumn("key", F.lit("fresh"))))


@query("kv_hash_hdel", _H + "SELECT key, field, value FROM h WHERE c_custkey % 3 <> 0")
def _(spark, sf):
    return hashes.hdel(_hash(spark, sf), _some(spark, sf, "c_custkey % 3 = 0"))


@query("kv_hash_hlen", _H + "SELECT key, count(*) AS n FROM h GROUP BY key")
def _(spark, sf):
    return hashes.hlen(_hash(spark, sf))


@query("kv_hash_hstrlen", _H + "SELECT key, field, CAST(strlen(value) AS INTEGER) AS n FROM h UNION ALL SELECT key, field || '!', 0 FROM h")
def _(spark, sf):
    some = _some(spark, sf, "true")
    return hashes.hstrlen(_hash(spark, sf), some.unionByName(some.withColumn("field", F.concat("field", F.lit("!")))))


@query("kv_hash_hexists", _H + "SELECT key, field, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS found FROM h")
def _(spark, sf):
    return hashes.hexists(hashes.hdel(_hash(spark, sf), _some(spark, sf, "c_custkey % 2 = 1")), _some(spark, sf, "true"))


@query("kv_hash_hincrbyfloat", _H + "SELECT key, field, CASE c_custkey % 3 WHEN 0 THEN value || '.0001' WHEN 1 THEN '10000000000000000000000' ELSE value END AS value FROM h")
def _(spark, sf):
    delta = F.when(F.col("c_custkey") % 3 == 0, 0.0001).otherwise(1e22)
    some = read(spark, sf, "customer").filter("c_custkey % 3 <> 2").select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("field"), delta.alias("delta"))
    return hashes.hincrbyfloat(_hash(spark, sf), some)


# sets: the customers of a priority
_S = "WITH s AS (SELECT DISTINCT o_orderpriority AS key, CAST(o_custkey AS VARCHAR) AS member FROM orders) "


@query("kv_set_sadd", _S + "SELECT key, member FROM s UNION SELECT '5-LOW', CAST(c_custkey AS VARCHAR) FROM customer")
def _(spark, sf):
    return sets.sadd(_by_priority(spark, sf), read(spark, sf, "customer").select(F.lit("5-LOW").alias("key"), F.col("c_custkey").cast("string").alias("member")))


@query("kv_set_srem", _S + "SELECT key, member FROM s WHERE NOT (key = '2-HIGH' AND CAST(member AS BIGINT) % 2 = 0)")
def _(spark, sf):
    t = _by_priority(spark, sf)
    return sets.srem(t, t.filter("cast(member as bigint) % 2 = 0").withColumn("key", F.lit("2-HIGH")))


@query("kv_set_scard", _S + "SELECT key, count(*) AS n FROM s GROUP BY key")
def _(spark, sf):
    return sets.scard(_by_priority(spark, sf))


@query("kv_set_smove", _S + "SELECT key, member FROM s WHERE NOT (key = '2-HIGH' AND member = '7') UNION SELECT '5-LOW', member FROM s WHERE key = '2-HIGH' AND member = '7'")
def _(spark, sf):
    return sets.smove(_by_priority(spark, sf), "2-HIGH", "5-LOW", "7")


@query("kv_set_diffstore", _S + "SELECT key, member FROM s WHERE key <> '5-LOW' UNION ALL (SELECT '5-LOW', member FROM s WHERE key = '1-URGENT' EXCEPT SELECT '5-LOW', member FROM s WHERE key = '2-HIGH')")
def _(spark, sf):
    t = _by_priority(spark, sf)
    return sets.store(t, "5-LOW", sets.sdiff(t, ["1-URGENT", "2-HIGH"]))


# lists: the events of a user
@query("kv_list_llen", _LIST + "SELECT key, count(*) AS n FROM l GROUP BY key")
def _(spark, sf):
    return lists.llen(_lists(spark, sf))


@query("kv_list_lindex", _LIST + "SELECT key, elem FROM l WHERE i = n - 2")
def _(spark, sf):
    return lists.lindex(_lists(spark, sf), -2)


@query("kv_list_lset", _LIST + "SELECT key, pos, CASE WHEN key = 7 AND i = n - 1 THEN 'set' ELSE elem END AS elem FROM l")
def _(spark, sf):
    return lists.lset(_lists(spark, sf), "7", -1, "set")


@query("kv_list_lmove", _LIST + "SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) AS i, elem FROM (SELECT key, pos, elem FROM l WHERE NOT (key = 7 AND i = 0) UNION ALL SELECT 8, (SELECT max(pos) + 1 FROM l), elem FROM l WHERE key = 7 AND i = 0)")
def _(spark, sf):
    moved = lists.lmove(_lists(spark, sf).withColumn("key", F.col("key").cast("string")), "7", "8", True, False)
    return lists.ranked(moved).select(F.col("key").cast("long").alias("key"), (F.col("i") + 1).cast("long").alias("i"), "elem")


@query("kv_list_bpop", _LIST + "SELECT CAST(key AS VARCHAR) AS key, elem FROM l WHERE key = 9 AND i = n - 1")
def _(spark, sf):
    return lists.bpop(_lists(spark, sf).withColumn("key", F.col("key").cast("string")), ["none", "9", "8"], left=False)[0]


# sorted sets: balances by nation
@query("kv_zset_zincrby", _Z + "SELECT key, member, score + CASE WHEN key = 3 THEN 2.5 ELSE 0 END AS score FROM z")
def _(spark, sf):
    t = _zset(spark, sf)
    some = t.filter("key = 3").select("key", "member", F.lit(0).alias("pos"), F.lit(2.5).alias("score"))
    return zsets.zapply(t, zsets.zincrby(t, some)).select("key", "member", "score")


@query("kv_zset_zrem", _Z + "SELECT key, member, score FROM z WHERE NOT member LIKE '%7'")
def _(spark, sf):
    t = _zset(spark, sf)
    return zsets.zrem(t, t.filter("member like '%7'"))


@query("kv_zset_zmscore", _Z + "SELECT key, CAST(0 AS INTEGER) AS pos, member, score FROM z UNION ALL SELECT key, 1, member || '?', NULL FROM z")
def _(spark, sf):
    t = _zset(spark, sf)
    asked = t.select("key", F.lit(0).alias("pos"), "member").unionByName(t.select("key", F.lit(1).alias("pos"), F.concat("member", F.lit("?")).alias("member")))
    return zsets.zmscore(t, asked)


@query("kv_zset_remrangebyscore", _Z + "SELECT key, member, score FROM z WHERE NOT (score >= -100 AND score < 5000)")
def _(spark, sf):
    return zsets.zremrangebyscore(_zset(spark, sf), "-100", "(5000")


@query("kv_zset_remrangebylex", _Z + "SELECT key, member, score FROM z WHERE NOT (member > 'Customer#000000200' AND member <= 'Customer#000000400')")
def _(spark, sf):
    return zsets.zremrangebylex(_zset(spark, sf), "(Customer#000000200", "[Customer#000000400")


@query("kv_zset_lexcount", _Z + "SELECT key, count(*) AS n FROM z WHERE member >= 'Customer#000000200' GROUP BY key")
def _(spark, sf):
    return zsets.zlexcount(_zset(spark, sf), "[Customer#000000200", "+")


@query("kv_zset_revrange", _Z + "SELECT key, member, score, n - 1 - rank AS rank FROM z WHERE n - 1 - rank BETWEEN 0 AND 3")
def _(spark, sf):
    return zsets.zrange(_zset(spark, sf), 0, 3, reverse=True)


@query("kv_zset_bzpopmax", _Z + "SELECT CAST(key AS VARCHAR) AS key, member, score FROM z WHERE key = 5 AND rank = n - 1")
def _(spark, sf):
    return zsets.bzpop(_zset(spark, sf).withColumn("key", F.col("key").cast("string")), ["none", "5", "4"], highest=True)[0]


# keys and deadlines
@query("kv_del", _LIVE + "SELECT key, value FROM live WHERE key NOT LIKE '%5'")
def _(spark, sf):
    t = _strings(spark, sf)
    return strings.delete(t, t.filter("key like '%5'"), NOW).select("key", "value")


@query("kv_exists", _LIVE + "SELECT 2 * count(*) AS n FROM live WHERE key LIKE '%5'")
def _(spark, sf):
    t = _strings(spark, sf)
    asked = t.filter("key like '%5'").select("key")
    return strings.exists(t, asked.unionAll(asked), NOW)


@query("kv_persist", _LIVE + "SELECT key, CASE WHEN key LIKE '%3' THEN 0 ELSE expire_ms END AS expire_ms FROM live")
def _(spark, sf):
    t = _strings(spark, sf)
    return strings.persist(t, t.filter("key like '%3'"), NOW).select("key", "expire_ms")


@query("kv_rename", _LIVE + "SELECT CASE WHEN key = 'Customer#000000001' THEN 'Customer#000000002' ELSE key END AS key, value FROM live WHERE key <> 'Customer#000000002'")
def _(spark, sf):
    return strings.rename(_strings(spark, sf), "Customer#000000001", "Customer#000000002", NOW).select("key", "value")


@query("kv_keys_glob", _LIVE + "SELECT key FROM live WHERE regexp_matches(key, '^Customer#.*[13]7$')")
def _(spark, sf):
    return strings.keys(_strings(spark, sf), "Customer#*[13]7", NOW)


@query("kv_strlen", _LIVE + "SELECT key, CAST(strlen(value) AS INTEGER) AS n FROM live")
def _(spark, sf):
    return strings.strlen(_strings(spark, sf), NOW)


# JSON: a document for each part, with text, numbers, a nested object and an array
_PART = "WITH p AS (SELECT p_partkey AS k, p_name AS name, p_size AS size, p_brand AS brand, p_type AS type, p_partkey % 7 AS m FROM part) "


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part")
    doc = F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.struct(F.col("p_brand").alias("brand"), F.lit(True).alias("new")).alias("of"), F.array("p_size", F.col("p_partkey") % 7, F.lit(5)).alias("list"))
    return p.select(F.col("p_partkey").alias("k"), F.to_json(doc).alias("doc"))


_LISTED = "[size, m, 5]"


@query("json_del", _PART + "SELECT k, name, brand, CAST(NULL AS VARCHAR) AS size FROM p")
def _(spark, sf):
    d = _parts(spark, sf).withColumn("doc", J.json_del(F.col("doc"), ".size"))
    return d.select("k", *[F.get_json_object("doc", p).alias(n) for n, p in (("name", "$.name"), ("brand", "$.of.brand"), ("size", "$.size"))])


@query("json_strappend", _PART + "SELECT k, to_json(brand || '!\"') AS brand, strlen(name) AS n FROM p")
def _(spark, sf):
    return _parts(spark, sf).select("k", J.json_get(J.json_strappend(F.col("doc"), ".of.brand", '!"'), ".of.brand").alias("brand"), J.json_strlen(F.col("doc"), ".name").alias("n"))


@query("json_arrappend", _PART + "SELECT k, '[' || size || ',' || m || ',5,\"x\",null]' AS list, CAST(5 AS BIGINT) AS n FROM p")
def _(spark, sf):
    doc = J.json_arrappend(F.col("doc"), ".list", "x", None)
    return _parts(spark, sf).select("k", J.json_get(doc, ".list").alias("list"), J.json_arrlen(doc, ".list").alias("n"))


@query("json_arrtrim", _PART + "SELECT k, '[' || m || ',5]' AS list FROM p")
def _(spark, sf):
    return _parts(spark, sf).select("k", J.json_get(J.json_arrtrim(F.col("doc"), ".list", 1, -1), ".list").alias("list"))


@query("json_arrindex", _PART + f"SELECT k, CAST(coalesce(list_position({_LISTED}, 5), 0) - 1 AS BIGINT) AS at FROM p")
def _(spark, sf):
    return _parts(spark, sf).select("k", J.json_arrindex(F.col("doc"), ".list", 5).cast("long").alias("at"))


@query("json_set_nested", _PART + "SELECT k, '{\"brand\":' || to_json(brand) || ',\"new\":false}' AS of, CAST(size + 10 AS VARCHAR) AS size FROM p")
def _(spark, sf):
    doc = J.json_numincrby(J.json_set(F.col("doc"), ".of.new", False), ".size", 10)
    return _parts(spark, sf).select("k", J.json_get(doc, ".of").alias("of"), J.json_get(doc, ".size").alias("size"))


@query("json_types", _PART + "SELECT k, 'string' AS name, 'integer' AS size, 'object' AS of, 'boolean' AS new, 'array' AS list, CAST(4 AS BIGINT) AS n FROM p")
def _(spark, sf):
    doc = F.col("doc")
    kinds = [J.json_type(doc, p).alias(n) for n, p in (("name", ".name"), ("size", ".size"), ("of", ".of"), ("new", ".of.new"), ("list", ".list"))]
    return _parts(spark, sf).select("k", *kinds, J.json_objlen(doc).alias("n"))


# vector sets, a set for each label
def _vset(spark: SparkSession, sf: str, where: str) -> DataFrame:
    return read(spark, sf, "embeddings").filter(where).select(F.col("label").cast("string").alias("key"), F.col("vec_id").cast("string").alias("element"), F.col("embedding").alias("vector"), F.lit(None).cast("string").alias("attr"))


@query("vec_add_rem", "SELECT CAST(label AS VARCHAR) AS key, count(*) AS n, 64 AS dim FROM embeddings WHERE vec_id % 5 <> 4 GROUP BY label")
def _(spark, sf):
    t = vectors.vadd(_vset(spark, sf, "vec_id % 2 = 0"), _vset(spark, sf, "vec_id % 3 = 0 OR vec_id % 2 = 1").drop("attr"))
    t = vectors.vrem(t, _vset(spark, sf, "vec_id % 5 = 4"))
    return vectors.vcard(t).join(vectors.vdim(t), "key")


# streams
@query("mq_xdel", _X + "SELECT stream, ms, seq FROM x WHERE event_id % 4 <> 1")
def _(spark, sf):
    rows = _entries(spark, sf)
    return log.xdel(rows, rows.filter("event_id % 4 = 1")).select("stream", "ms", "seq")


@query("mq_xinfo_stream", _X + "SELECT stream, count(*) AS length, min(ms) AS first_ms, max(ms) AS last_ms FROM x GROUP BY stream")
def _(spark, sf):
    return log.xinfo_stream(_entries(spark, sf)).select("stream", "length", F.col("first.ms").alias("first_ms"), F.col("last.ms").alias("last_ms"))


@query("mq_xidle", _X + "SELECT stream FROM (SELECT stream, max(ms) AS last, row_number() OVER (ORDER BY stream) AS i FROM x GROUP BY stream) WHERE i % 2 = 0 AND last + 1000 <= 1800000000000")
def _(spark, sf):
    rows = _entries(spark, sf)
    names = rows.select("stream").distinct()
    place = names.join(F.broadcast(names.withColumnRenamed("stream", "other"))).groupBy("stream").agg(F.sum(F.when(F.col("other") <= F.col("stream"), 1)).alias("i"))  # five streams
    return log.idle_streams(rows, place.select("stream", F.when(F.col("i") % 2 == 0, 1000).otherwise(0).alias("idle_ms")), 1_800_000_000_000)
