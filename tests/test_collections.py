"""Keyed collections, JSON, vectors, search and streams on small fixtures with exact results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.errors import CommandError
from tessera.functions import columns as C
from tessera.functions import json_paths as J
from tessera.operators import hashes, lists, search, sets, strings, vectors, zsets
from tessera.streaming import groups, log


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def kv(spark):
    return spark.createDataFrame([("a", "1", 0, "string"), ("b", "2", 500, "string"), ("c", "3", 2000, "list")], "key string, value string, expire_ms long, kind string")


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def test_strings(spark, kv):
    t = kv.drop("kind")
    assert rows(strings.get(t, "a", 1000)) == [("a", "1")] and rows(strings.get(t, "b", 1000)) == []
    asked = spark.createDataFrame([(0, "c"), (1, "b"), (2, "a")], "pos int, key string")
    assert rows(strings.mget(t, asked, 1000)) == [(0, "c", "3"), (1, "b", None), (2, "a", "1")]
    new = spark.createDataFrame([("a", "x", 0), ("z", "y", 0)], "key string, value string, expire_ms long")
    assert rows(strings.set_(t, new, 1000, nx=True)) == [("a", "1", 0), ("c", "3", 2000), ("z", "y", 0)]
    assert rows(strings.set_(t, new, 1000, xx=True)) == [("a", "x", 0), ("c", "3", 2000)]
    with pytest.raises(CommandError):
        strings.set_(t, new, 1000, nx=True, xx=True)
    keep = strings.set_(t, spark.createDataFrame([("c", "n", 0)], "key string, value string, expire_ms long"), 1000, keep_ttl=True)
    assert ("c", "n", 2000) in rows(keep)
    batch = spark.createDataFrame([(0, "a", "p"), (1, "a", "q")], "pos int, key string, value string")
    assert ("a", "q", 0) in rows(strings.mset(t, batch, 1000))
    assert rows(strings.exists(t, keys(spark, "a", "a", "b", "c"), 1000)) == [(3,)]
    assert rows(strings.delete(t, keys(spark, "a"), 1000)) == [("c", "3", 2000)]
    assert rows(strings.type_of(kv, keys(spark, "a", "b", "c"), 1000)) == [("a", "string"), ("b", "none"), ("c", "list")]
    assert rows(strings.rename(t, "a", "c", 1000)) == [("c", "1", 0)]
    assert rows(strings.rename(t, "a", "c", 1000, nx=True)) == [("a", "1", 0), ("c", "3", 2000)]
    assert rows(strings.rename(t, "a", "n", 1000, nx=True)) == [("c", "3", 2000), ("n", "1", 0)]


def test_deadlines(spark, kv):
    t = kv.drop("kind")
    asked = keys(spark, "a", "b", "c")
    assert rows(strings.ttl(t, asked, 501)) == [("a", -1), ("b", -2), ("c", 1)]
    assert rows(strings.ttl(t, asked, 400, milliseconds=True)) == [("a", -1), ("b", 100), ("c", 1600)]
    deadline = F.lit(1500).cast("long")
    assert rows(strings.expire(t, asked, deadline, 1000, "LT")) == [("a", "1", 0), ("c", "3", 1500)]
    assert rows(strings.expire(t, asked, deadline, 1000, "NX")) == [("a", "1", 1500), ("c", "3", 2000)]
    assert rows(strings.expire(t, asked, F.lit(900).cast("long"), 1000)) == []
    assert rows(strings.persist(t, asked, 1000)) == [("a", "1", 0), ("c", "3", 0)]


def test_globs_slots_and_order(spark):
    df = spark.createDataFrame([("h[llo",), ("hello",), ("hallo",), ("heello",), ("123456789",), ("{u}1",), ("u",)], "key string")
    like = lambda g: sorted(r[0] for r in df.filter(F.col("key").rlike(C.glob_regex(g))).collect())
    assert like("h?llo") == ["h[llo", "hallo", "hello"] and like("h[ae]llo") == ["hallo", "hello"] and like("h[^e]llo") == ["h[llo", "hallo"]
    assert like("h*llo") == ["h[llo", "hallo", "heello", "hello"] and like("h\\[llo") == ["h[llo"]
    crc = {r[0]: (r[1], r[2]) for r in df.select("key", C.crc16(F.col("key")), C.slot(F.col("key"))).collect()}
    assert crc["123456789"] == (0x31C3, 0x31C3 % 16384) and crc["{u}1"][1] == crc["u"][1]


def test_hashes(spark):
    t = spark.createDataFrame([("h", "f", "5"), ("h", "g", "é")], "key string, field string, value string")
    new = spark.createDataFrame([(0, "h", "f", "6"), (1, "h", "f", "7"), (2, "k", "x", "1")], "pos int, key string, field string, value string")
    assert rows(hashes.hset(t, new)) == [("h", "f", "7"), ("h", "g", "é"), ("k", "x", "1")]
    assert rows(hashes.hset_new(t, new)) == [("k", 1)]
    assert rows(hashes.hsetnx(t, new.drop("pos").filter("key = 'k'"))) == [("h", "f", "5"), ("h", "g", "é"), ("k", "x", "1")]
    by = spark.createDataFrame([("h", "f", 2), ("h", "new", 3)], "key string, field string, delta int")
    assert ("h", "f", "7") in rows(hashes.hincrby(t, by)) and ("h", "new", "3") in rows(hashes.hincrby(t, by))
    half = spark.createDataFrame([("h", "f", 0.5)], "key string, field string, delta double")
    assert ("h", "f", "5.5") in rows(hashes.hincrbyfloat(t, half))
    with pytest.raises(Exception, match="not a number"):
        hashes.hincrby(t, spark.createDataFrame([("h", "g", 1)], "key string, field string, delta int")).collect()
    asked = spark.createDataFrame([("h", "g"), ("h", "no")], "key string, field string")
    assert rows(hashes.hstrlen(t, asked)) == [("h", "g", 2), ("h", "no", 0)]
    assert rows(hashes.hkeys(t)) == [("h", ["f", "g"])] and rows(hashes.hlen(t)) == [("h", 2)]
    assert hashes.hrandfield(t, 1, 3).count() == 1 and hashes.hrandfield(t, -5, 3).count() == 5
    assert rows(hashes.hscan(t, "f")) == [("h", "g", "é")]


def test_numbers_are_written_plainly(spark):
    values = [0.0, -0.0, 1.0, -2.5, 0.0001, 1e-7, 123456.789, 1e20, -3.25e22, 1e15, 123456789012345680.0, 5e-324]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(C.number_text(F.col("x"))).collect()]
    for v, text in zip(values, got):
        assert "e" not in text.lower() and float(text) == v and (v != int(v) or "." not in text), text
    t = spark.createDataFrame([("h", "f", "1e308")], "key string, field string, value string")
    with pytest.raises(Exception, match="infinite"):
        hashes.hincrbyfloat(t, spark.createDataFrame([("h", "f", 1.7e308)], "key string, field string, delta double")).collect()


def test_blocking_commands_take_what_they_give(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "key string, pos long, elem string")
    got, rest = lists.bpop(t, ["none", "a", "b"], left=False)
    assert rows(got) == [("a", "y")] and rows(rest.select("key", "elem")) == [("a", "x"), ("b", "z")]
    got, after = lists.blmove(t, "a", "b", True, False)
    assert rows(got) == [("x",)] and rows(lists.ranked(after).select("key", "i", "elem")) == [("a", 0, "y"), ("b", 0, "z"), ("b", 1, "x")]
    got, after = lists.brpoplpush(t, "none", "b")
    assert rows(got) == [] and after.count() == 3
    z = spark.createDataFrame([("a", "m", 1.0), ("a", "n", 2.0)], "key string, member string, score double")
    got, rest = zsets.bzpop(z, ["none", "a"], highest=True)
    assert rows(got) == [("a", "n", 2.0)] and rows(rest) == [("a", "m", 1.0)]


def test_sets(spark):
    t = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "3"), ("b", "2"), ("b", "3"), ("c", "3")], "key string, member string")
    assert rows(sets.sinter(t, ["a", "b", "c"])) == [("3",)] and rows(sets.sdiff(t, ["a", "b"])) == [("1",)] and len(rows(sets.sunion(t, ["a", "b"]))) == 3
    assert rows(sets.smove(t, "a", "c", "1").filter("key = 'c'")) == [("c", "1"), ("c", "3")]
    popped, rest = sets.spop(t, 2, 1)
    assert popped.count() == 5 and rest.count() == 1 and popped.join(rest, ["key", "member"]).count() == 0
    assert rows(sets.store(t, "b", sets.sinter(t, ["a", "c"])).filter("key = 'b'")) == [("b", "3")]
    assert rows(sets.sadd_new(t, t.unionByName(spark.createDataFrame([("c", "9")], "key string, member string")))) == [("c", 1)]


def test_lists(spark):
    t = spark.createDataFrame([("l", i, e) for i, e in enumerate("abcab")], "key string, pos long, elem string")
    show = lambda df, c="pos": "".join(r["elem"] for r in df.orderBy(c).collect())
    new = spark.createDataFrame([("l", 0, "x"), ("l", 1, "y"), ("m", 0, "z")], "key string, pos long, elem string")
    assert show(lists.push(t, new).filter("key = 'l'")) == "abcabxy" and show(lists.push(t, new, left=True).filter("key = 'l'")) == "yxabcab"
    assert lists.push(t, new, only_existing=True).filter("key = 'm'").count() == 0
    assert show(lists.lrange(t, -3, -2), "i") == "ca" and show(lists.lrange(t, -99, 1), "i") == "ab" and show(lists.ltrim(t, 3, 1)) == ""
    assert show(lists.linsert(t, "c", "!")) == "ab!cab" and show(lists.lset(t, "l", -1, "z")) == "abcaz"
    assert show(lists.lrem(t, "a", 1)) == "bcab" and show(lists.lrem(t, "a", -1)) == "abcb" and show(lists.lrem(t, "b", 0)) == "aca"
    assert rows(lists.lpos(t, "a", -1, 0)) == [("l", 0, 3), ("l", 1, 0)] and rows(lists.lpos(t, "b", 2)) == [("l", 0, 4)] and rows(lists.lpos(t, "b", 1, 0, 3)) == [("l", 0, 1)]
    popped, rest = lists.pop(t, 2, left=False)
    assert show(popped, "at") == "ba" and show(rest) == "abc"
    assert show(lists.rpoplpush(t, "l", "l")) == "babca" and show(lists.lmove(t, "l", "n", True, False).filter("key = 'n'")) == "a"
    assert rows(lists.first_waiting(t, ["none", "l"])) == [("l", "a")]


def test_sorted_sets(spark):
    t = spark.createDataFrame([("z", "a", 1.0), ("z", "b", 2.0), ("z", "c", 3.0), ("z", "d", 3.0)], "key string, member string, score double")
    assert [r["member"] for r in zsets.zrank(t).orderBy("rank").collect()] == list("abcd")
    popped, rest = zsets.zpop(t)
    assert rows(popped) == [("z", "a", 1.0, 0)] and rest.count() == 3
    assert [r["member"] for r in zsets.zrangebyscore(t, "(1", "3").orderBy("at").collect()] == list("bcd")
    assert [r["member"] for r in zsets.zrangebyscore(t, "-inf", "+inf", reverse=True, offset=1, count=2).orderBy("at").collect()] == list("cb")
    assert rows(zsets.zlexcount(t, "[a", "(d")) == [("z", 3)] and zsets.zrangebylex(t, "+", "-").count() == 0
    assert zsets.zremrangebyrank(t, 0, 1).count() == 2 and zsets.zremrangebyscore(t, "2", "3").count() == 1
    zero = spark.createDataFrame([("z", "p", 0.0), ("z", "m", -0.0)], "key string, member string, score double")
    assert [r["member"] for r in zsets.zrank(zero).orderBy("rank").collect()] == ["m", "p"]
    assert zsets.zcount(zero, "0", "0").collect()[0]["n"] == 2
    assert [r["member"] for r in zsets.zrangebyscore(zero, "(-0.0", "5").collect()] == ["p"]


def test_zadd_flags(spark):
    t = spark.createDataFrame([("m", "a", 2.0)], "key string, member string, score double")
    add = lambda table, *pairs, **flags: zsets.zadd(table, spark.createDataFrame([(i, "m", m, s) for i, (s, m) in enumerate(pairs)], "pos int, key string, member string, score double"), **flags)
    n = lambda out, ch=False: zsets.zadd_reply(out, ch).collect()[0]["n"]
    assert n(add(t, (3.0, "a"), gt=True), ch=True) == 1
    t = zsets.zapply(t, add(t, (9.0, "a"), gt=True))
    assert n(add(t, (1.0, "a"), gt=True), ch=True) == 0 and n(add(t, (9.0, "a")), ch=True) == 0 and n(add(t, (5.0, "zz"), gt=True)) == 1
    assert rows(zsets.zapply(t, zsets.zincrby(t, spark.createDataFrame([(0, "m", "a", 1.5)], "pos int, key string, member string, score double")))) == [("m", "a", 10.5)]
    assert rows(add(t, (1.0, "new"), xx=True)) == [] and rows(add(t, (1.0, "a"), nx=True)) == [("m", "a", 9.0, 9.0, "same")]
    with pytest.raises(CommandError):
        add(t, (1.0, "a"), nx=True, gt=True)


def test_zset_algebra(spark):
    t = spark.createDataFrame([("1", "a", 1.0), ("1", "b", 2.0), ("2", "a", 10.0), ("2", "c", 20.0)], "key string, member string, score double")
    assert rows(zsets.combine(t, ["1", "2"])) == [("a", 11.0), ("b", 2.0), ("c", 20.0)]
    assert ("a", 12.0) in rows(zsets.combine(t, ["1", "2"], [2.0, 1.0])) and rows(zsets.combine(t, ["1", "2"], how="min", every=True)) == [("a", 1.0)]
    assert rows(zsets.zdiff(t, ["1", "2"])) == [("b", 2.0)]
    assert rows(zsets.zstore(t, "2", zsets.zdiff(t, ["1", "2"])).filter("key = '2'")) == [("2", "b", 2.0)]


def test_json(spark):
    df = spark.createDataFrame([('{"b":1,"a":[true,null]}',)], "doc string")
    one = lambda c: df.select(c).collect()[0][0]
    d = F.col("doc")
    assert one(J.json_get(d)) == '{"b":1,"a":[true,null]}' and one(J.json_get(d, ".a[0]")) == "true" and one(J.json_get(d, ".b", "$.none")) == "[1,null]"
    assert one(J.json_type(d, ".b")) == "integer" and one(J.json_type(d, ".a[1]")) == "null" and one(J.json_type(d, ".x")) is None
    nested = J.json_set(J.json_set(d, ".x.y", [1]), ".x.y[1]", {"z": 3})
    assert one(J.json_get(nested, ".x")) == '{"y":[1,{"z":3}]}'
    with pytest.raises(Exception, match="out of range"):
        one(J.json_set(nested, ".x.y[9]", 1))
    assert one(J.json_numincrby(d, ".b", 2)) == '{"b":3,"a":[true,null]}' and one(J.json_get(J.json_numincrby(d, ".b", 0.5), ".b")) == "1.5"
    assert one(J.json_del(d, ".a[0]")) == '{"b":1,"a":[null]}' and one(J.json_del(d, ".")) is None
    assert one(J.json_arrlen(d, ".a")) == 2 and one(J.json_objlen(d)) == 2 and one(J.json_objkeys(d)) == ["b", "a"]
    assert one(J.json_get(J.json_arrappend(d, ".a", 1, "x"), ".a")) == '[true,null,1,"x"]'
    assert one(J.json_arrindex(d, ".a", None)) == 1 and one(J.json_arrindex(d, ".a", 1)) == -1
    assert one(J.json_get(J.json_arrtrim(d, ".a", -1, -1), ".a")) == "[null]"
    assert one(J.json_strlen(J.json_strappend(J.json_set(d, ".s", "é"), ".s", "b"), ".s")) == 3


def test_vectors(spark):
    t = spark.createDataFrame([("k", "e1", [1.0, 0.0], None), ("k", "e2", [0.0, 1.0], "t"), ("k", "e3", [1.0, 1.0], None)], "key string, element string, vector array<double>, attr string")
    assert [(r[0], round(r[1], 10)) for r in vectors.vsim(t, [1.0, 0.0]).collect()] == [("e1", 1.0), ("e3", round(0.8535533905932737, 10)), ("e2", 0.5)]
    new = spark.createDataFrame([("k", "e2", [2.0, 2.0])], "key string, element string, vector array<double>")
    assert ("k", "e2", [2.0, 2.0], "t") in [tuple(r) for r in vectors.vadd(t, new).collect()]
    assert rows(vectors.vgetattr(vectors.vsetattr(t, "k", "e1", "{}"), "k", "e1")) == [("{}",)] and rows(vectors.vdim(t)) == [("k", 2)]
    assert [r[0] for r in vectors.knn(t, [0.1, 0.0], 2).collect()] == ["e1", "e2"]
    half = spark.createDataFrame([(bytearray(b"\x00\x3c\x00\xc0"),)], "b binary").select(vectors.fp16(F.col("b"))).collect()[0][0]
    assert half == [1.0, -2.0]
    index, centroids = vectors.build(t, k=2, iterations=3, seed=7)
    assert [r[0] for r in vectors.probe(index, centroids, [0.1, 0.0], 2, nprobe=2).collect()] == ["e1", "e2"]
    assert (vectors.build(t, k=2, iterations=3, seed=7)[1] == centroids).all()


def test_search(spark):
    docs = spark.createDataFrame([("d1", "redis quickstart", "hello redis world"), ("d2", "full text", "hello hello hello redis"), ("d3", "mp3", None)], "doc_id string, title string, body string")
    fields = ["title", "body"]
    found = lambda q, **o: [r["doc"] for r in search.text_search(docs, fields, q, **o).collect()]
    assert found("@body:hello") == ["d2", "d1"] and set(found("quickstart full")) == {"d1", "d2"} and found("quickstart full", mode="all") == []
    assert found("*") == ["d1", "d2", "d3"] and found("*", offset=1, count=1) == ["d2"] and found("...") == []
    assert search.prefilter(docs, fields, "redis").count() == 1 and search.prefilter(docs, fields, "@body:redis").count() == 2
    with pytest.raises(CommandError):
        found("@none:x")
    replaced = search.add_documents(docs, spark.createDataFrame([("d1", "t", "bye")], "doc_id string, title string, body string"))
    assert [r["doc"] for r in search.text_search(replaced, fields, "@body:hello").collect()] == ["d2"]
    check = spark.range(1).select(search.bm25(search.idf(F.lit(4), F.lit(2)), F.lit(3), F.lit(10), F.lit(10.0))).collect()[0][0]
    import math

    assert abs(check - math.log(1 + 2.5 / 2.5) * 3 * 2.2 / 4.2) < 1e-12
    han = spark.createDataFrame([("中文字 Ab1 单",)], "t string").select(search.tokens(F.col("t"))).collect()[0][0]
    assert han == ["ab1", "中文", "文字", "单"]


def test_streams_and_groups(spark):
    entries = spark.createDataFrame([("t", 1, i, i) for i in (1, 2, 3)], "stream string, ms long, seq long, event_id long")
    assert rows(log.xrange(entries, "(1-1", "+", 1).select("seq")) == [(2,)] and rows(log.xtrim(entries, 1).select("seq")) == [(3,)]
    empty = spark.createDataFrame([], "stream string, grp string, created_ms long, delivered_ms long, delivered_seq long, committed_ms long, committed_seq long")
    g = groups.create(empty, entries, entries.select("stream"), "g", "0", 5)
    with pytest.raises(CommandError):
        groups.create(g, entries, entries.select("stream"), "g", "$", 5)
    p = groups.deliver(entries, g, "c1", 100)
    g = groups.advance(g, p)
    assert rows(groups.deliver(entries, g, "c1", 101)) == []
    s = groups.pending_summary(p).collect()[0]
    assert (s["total"], tuple(s["first"]), tuple(s["last"]), [tuple(c) for c in s["consumers"]]) == (3, (1, 1), (1, 3), [("c1", 3)])
    ids = spark.createDataFrame([("t", "g", 1, 1), ("t", "g", 1, 2)], "stream string, grp string, ms long, seq long")
    reply, g, p = groups.ack(g, p, ids)
    assert rows(reply) == [("t", "g", 2)] and rows(p.select("seq")) == [(3,)]
    assert rows(groups.ack(g, p, ids)[0]) == [("t", "g", 0)] and rows(groups.backlog(entries, g)) == [("t", "g", 1)]
    assert rows(groups.deliver(entries, groups.restarted(g), "c2", 200).select("seq")) == [(3,)]
    claimed, p2 = groups.claim(entries, p, p, "c2", 50, 200)
    assert rows(claimed.select("consumer", "times")) == [("c2", 2)] and rows(p2.select("consumer")) == [("c2",)]
    gone = entries.filter("seq < 3")
    assert groups.claim(gone, p, p, "c2", 50, 200)[1].count() == 0
    page = groups.autoclaim(gone, p, "c2", 50, "-", 200)
    assert rows(page.select("seq", "outcome")) == [(3, "deleted")] and rows(groups.next_cursor(page)) == [("t", "g", 1, 4)]
    idle = spark.createDataFrame([("t", "g", 5, 0, "a", 100, 1), ("t", "g", 5, 1, "b", 600, 2), ("t", "g", 6, 0, "a", 900, 1)], "stream string, grp string, ms long, seq long, consumer string, delivered_at long, times int")
    assert rows(groups.pending_range(idle, "5-0", "(6-0", 10, 1000, 500).select("ms", "seq")) == [(5, 0)]
    new = spark.createDataFrame([(0, "t", 1, 3), (1, "t", 2, 0), (2, "t", 1, 9), (3, "u", 1, 0)], "pos int, stream string, ms long, seq long")
    assert rows(log.accept(entries, new).select("stream", "ms", "seq")) == [("t", 2, 0), ("u", 1, 0)]


def test_ranks_of_long_lists_and_large_sets(spark):
    """Ranks put together from buckets equal those of one sort a key: sparse and negative positions, scores of every
    size, ties, infinities, zeros of both signs, a null key."""
    draw = random.Random(7)
    at = draw.sample(range(-300_000, 300_000), 400)
    lists_ = [(k, p, draw.choice("xyz")) for k, ps in (("a", at[:300]), ("b", at[300:]), (None, at[:20])) for p in ps]
    t = spark.createDataFrame(lists_, "key string, pos long, elem string")
    own = {k: sorted(r[1:] for r in lists_ if r[0] == k) for k in ("a", "b", None)}
    got = {(r["key"], r["pos"]): (r["i"], r["n"]) for r in lists.ranked(t).collect()}
    assert got == {(k, p): (i, len(v)) for k, v in own.items() for i, (p, _) in enumerate(v)}
    where = {k: [i for i, (_, e) in enumerate(v) if e == "x"] for k, v in own.items()}
    for rank, count in ((2, 0), (-3, 0), (1, 4), (-1, 2)):
        want = {(k, a, i) for k, v in where.items() for a, i in enumerate((v if rank > 0 else v[::-1])[abs(rank) - 1 :][: count or None])}
        assert {tuple(r) for r in lists.lpos(t, "x", rank, count).collect()} == want
    left = {(r["key"], r["pos"]) for r in lists.lrem(t, "x", -2).collect()}
    assert left == {(k, p) for k, v in own.items() for i, (p, _) in enumerate(v) if i not in where[k][-2:]}

    scores = [draw.uniform(-1, 1) * 10.0 ** draw.randint(-12, 12) for _ in range(200)] + [1.7e12 + draw.random() * 1e9 for _ in range(200)]
    scores += [0.0, -0.0, 5e-324, -5e-324, math.inf, -math.inf, 1.7976931348623157e308] + [3.0] * 20
    z = [(k, f"m{i}", s) for k in ("a", None) for i, s in enumerate(scores)]
    t = spark.createDataFrame(z, "key string, member string, score double")
    want = sorted({r[1:] for r in z}, key=lambda r: (r[1], math.copysign(1, r[1]) if r[1] == 0 else 0, r[0]))
    for reverse in (False, True):
        for k in ("a", None):
            got = zsets.ranked(t, reverse).filter(F.col("key").eqNullSafe(F.lit(k))).orderBy("rank").collect()
            assert [(r["member"], r["rank"], r["n"]) for r in got] == [(m, i, len(want)) for i, (m, _) in enumerate(want[::-1] if reverse else want)]


def test_appends_and_turns_of_a_long_stream(spark):
    """What buckets of positions say equals one pass in order; equal and falling ids are refused."""
    draw = random.Random(3)
    at = sorted(draw.sample(range(400_000), 300))
    events = [("s", p, draw.randint(0, 400), draw.randint(0, 2)) for p in at]
    t = spark.createDataFrame(events, "stream string, pos long, ms long, seq long")
    old = spark.createDataFrame([("s", 50, 1)], "stream string, ms long, seq long")
    want, top = [], (-1, -1)
    for _, p, ms, seq in events:
        if (ms, seq) > max(top, (50, 1)):
            want.append(p)
        top = max(top, (ms, seq))
    assert sorted(r["pos"] for r in log.accept(old, t).collect()) == want
    assert {r["pos"]: r["child"] for r in log.pick_round_robin(t, 7, "pos").collect()} == {p: i % 7 for i, p in enumerate(at)}
