"""Queries by name over the driver's tables, each with DuckDB's SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import json_paths as J
from tessera.functions.columns import slot
from tessera.operators import hashes, lists, search, sets, strings, vectors, zsets
from tessera.operators.textindex import TextIndex
from tessera.sources.database import Database
from tessera.streaming import groups, log, structured

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": None, "events": "event_id", "documents": "doc_id"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def database(spark: SparkSession, sf: str) -> Database:
    db = Database(spark)
    for t, key in KEYS.items():
        db.register(t, f"{sf}/{t}.parquet", key)
    return db


def sql(name: str, text: str, oracle: str | None = None) -> None:
    query(name, oracle or text)(lambda spark, sf: database(spark, sf).execute(text))


# the SQL dialect
sql("sql_flagship", "SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem WHERE l_discount > 0.05 GROUP BY l_returnflag ORDER BY l_returnflag")
sql("sql_filter_project", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice FROM lineitem WHERE l_quantity > 45 AND l_discount BETWEEN 0.02 AND 0.04")
sql("sql_or_not", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'O' OR o_totalprice < 50000)")
sql(
    "sql_three_valued",
    "SELECT o_orderkey, NOT (NULL AND o_orderkey > 3) AS a, o_orderkey IN (NULL, 7) AS b, o_orderkey IN (7, NULL) AS c, o_orderkey BETWEEN NULL AND 3 AS d, o_orderkey NOT IN (5, 7) AS e FROM orders",
    "SELECT o_orderkey, true AS a, CAST(NULL AS BOOLEAN) AS b, CASE WHEN o_orderkey = 7 THEN true END AS c, CAST(NULL AS BOOLEAN) AS d, o_orderkey NOT IN (5, 7) AS e FROM orders",
)
sql("sql_int_div_mod", "SELECT p_partkey, p_size / (p_partkey % 5) AS d, p_size % (p_partkey % 5) AS m, -p_size / 3 AS t FROM part", "SELECT p_partkey, p_size // nullif(p_partkey % 5, 0) AS d, p_size % nullif(p_partkey % 5, 0) AS m, -p_size // 3 AS t FROM part")
sql("sql_wrapping", "SELECT o_orderkey, o_orderkey + 9223372036854775807 AS w FROM orders", "SELECT o_orderkey, CAST((CAST(o_orderkey AS HUGEINT) + 18446744073709551615) % 18446744073709551616 - 9223372036854775808 AS BIGINT) AS w FROM orders")
sql("sql_like", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%1_' AND c_mktsegment NOT LIKE 'B%'")
sql("sql_scalar_funcs", "SELECT n_nationkey, LENGTH(n_name) AS l, UPPER(n_name) AS u, LOWER(n_name) AS w, ABS(0 - n_nationkey) AS a FROM nation")
sql("sql_truthy", "SELECT n_nationkey FROM nation WHERE n_regionkey", "SELECT n_nationkey FROM nation WHERE n_regionkey <> 0")
sql("sql_inner_join", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
sql("sql_theta_join", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a INNER JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("sql_cross_join", "SELECT r_name, n_name FROM region JOIN nation", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("sql_self_join", "SELECT a.r_name AS x, b.r_name AS y FROM region a JOIN region b ON a.r_regionkey = b.r_regionkey + 1")
sql("sql_join3", "SELECT n_name, COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
sql("sql_group_agg", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders GROUP BY o_orderstatus, o_orderpriority")
sql("sql_agg_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n, SUM(DISTINCT l_linenumber) AS s, AVG(DISTINCT l_linenumber) AS a FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n, CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS s, AVG(DISTINCT l_linenumber) AS a FROM lineitem GROUP BY l_returnflag")
sql("sql_having_hidden", "SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 60 AND MAX(c_acctbal) > 9000")
sql("sql_agg_arithmetic", "SELECT l_returnflag, MAX(l_linenumber) * 2 + COUNT(*) AS x FROM lineitem GROUP BY l_returnflag")
sql("sql_global_empty", "SELECT COUNT(*) AS n, SUM(o_orderkey) AS s FROM orders WHERE o_orderkey < 0", "SELECT COUNT(*) AS n, CAST(SUM(o_orderkey) AS BIGINT) AS s FROM orders WHERE o_orderkey < 0")
sql("sql_first_row_col", "SELECT c_nationkey, c_name, COUNT(*) AS n FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, arg_min(c_name, c_custkey) AS c_name, COUNT(*) AS n FROM customer GROUP BY c_nationkey")
sql("sql_order_limit", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 25 OFFSET 5")
sql("sql_order_stable", "SELECT o_orderkey FROM orders ORDER BY o_orderstatus LIMIT 40", "SELECT o_orderkey FROM orders ORDER BY o_orderstatus, o_orderkey LIMIT 40")
sql("sql_distinct_order", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer ORDER BY c_nationkey, c_mktsegment LIMIT 30")
sql("sql_explain", "EXPLAIN SELECT n_name, COUNT(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey > 0 GROUP BY n_name", "SELECT unnest(['SeqScan (nation JOIN region)', 'Join On: n_regionkey = r_regionkey', 'Filter: r_regionkey > 0', 'Group: n_name', 'Aggregate: COUNT(*)', 'Project: n_name, COUNT(*) AS n']) AS plan")
sql("sql_variables", "SELECT @@autocommit, @@lower_case_table_names", "SELECT 1 AS autocommit, 1 AS lower_case_table_names")
sql("sql_show_columns", "SHOW COLUMNS FROM region", "SELECT 'r_regionkey' AS Field, 'bigint' AS Type, 'NO' AS \"Null\", 'PRI' AS \"Key\", 'NULL' AS \"Default\", '' AS Extra UNION ALL SELECT 'r_name', 'varchar', 'YES', '', 'NULL', ''")


# versions: an event is a version of its user's row, errors are tombstones; three commits by thirds of the ids
def _own(spark: SparkSession) -> Database:
    """A new database with tables of its own, in the shared folder."""
    return Database(spark, structured.work_folder(spark, "db"))


def _versioned(spark: SparkSession, sf: str) -> tuple[Database, list[int]]:
    db, e = _own(spark), read(spark, sf, "events")
    db.execute("CREATE TABLE users (pk BIGINT PRIMARY KEY, ts BIGINT, value DOUBLE)")
    last, commits = e.agg(F.max("event_id")).first()[0], []
    newest = F.max_by(F.struct(F.col("event_id").alias("ts"), "value", (F.col("event_type") == "error").alias("_deleted")), "event_id")
    for n in range(3):
        some = e.filter((F.col("event_id") > last * n // 3 if n else F.lit(True)) & (F.col("event_id") <= last * (n + 1) // 3))
        db.write("users", some.groupBy(F.col("user_id").alias("pk")).agg(newest.alias("v")).select("pk", "v.*"))
        commits.append(db.storage.latest())
    return db, commits


_V = "WITH e AS (SELECT user_id AS pk, event_id AS ts, event_type = 'error' AS dead, value, (SELECT max(event_id) FROM events) AS last FROM events), v AS (SELECT *, CASE WHEN ts <= last // 3 THEN 1 WHEN ts <= last * 2 // 3 THEN 2 ELSE 3 END AS part FROM e) "


@query("mvcc_snapshot_read", _V + "SELECT pk, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY ts DESC) AS n FROM v WHERE part <= 2) WHERE n = 1 AND NOT dead")
def _(spark, sf):
    db, commits = _versioned(spark, sf)
    return db.snapshot(commits[1]).execute("SELECT pk, ts, value FROM users")


@query("mvcc_gc_survivors", _V + "SELECT pk, ts, false AS dead FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY ts DESC) AS n FROM v WHERE part <= 2) WHERE n = 1 AND NOT dead UNION ALL SELECT pk, ts, dead FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY ts DESC) AS n FROM v WHERE part = 3) WHERE n = 1")
def _(spark, sf):
    db, commits = _versioned(spark, sf)
    db.compact("users", commits[1])
    db.vacuum(keep=1)
    return db.versions("users").select("pk", "ts", F.col("_deleted").alias("dead"))


def _customers(spark: SparkSession, sf: str) -> Database:
    db = _own(spark)
    db.execute("CREATE TABLE c (c_custkey BIGINT PRIMARY KEY, c_nationkey BIGINT, c_acctbal DOUBLE)")
    db.write("c", read(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal"))
    return db


_ALL = "SELECT c_custkey, c_acctbal FROM c"


@query("txn_overlay", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 10 <> 7")
def _(spark, sf):
    db = _customers(spark, sf)
    db.execute("BEGIN")
    db.execute("UPDATE c SET c_acctbal = 0.0 WHERE c_custkey % 10 = 3")
    db.execute("DELETE FROM c WHERE c_custkey % 10 = 7")
    return db.execute(_ALL)


@query("txn_rollback", "SELECT c_custkey, c_acctbal FROM customer")
def _(spark, sf):
    db = _customers(spark, sf)
    for statement in ("BEGIN", "UPDATE c SET c_acctbal = 0.0", "DELETE FROM c WHERE c_custkey > 5", "ROLLBACK"):
        db.execute(statement)
    return db.execute(_ALL)


@query("txn_commit_merges", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(spark, sf):
    db = _customers(spark, sf)
    other = Database(spark, db.storage.root)
    db.execute("BEGIN")
    db.execute("UPDATE c SET c_acctbal = 1.0 WHERE c_custkey % 3 = 0")
    other.execute("UPDATE c SET c_acctbal = 2.0 WHERE c_custkey % 3 = 1")
    db.execute("COMMIT")
    return other.execute(_ALL)


@query("idx_unique_violations", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 1")
def _(spark, sf):
    return _customers(spark, sf).repeated("c", "c_nationkey")


@query("dml_insert_replaces", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey <> 1 UNION ALL SELECT unnest([1, 90000000]), unnest([6.5, -1.0])")
def _(spark, sf):
    db = _customers(spark, sf)
    db.execute("INSERT INTO c (c_custkey, c_acctbal) VALUES (1, 5.5), (90000000, 0 - 1), (1, ?)", [6.5])
    return db.execute(_ALL)


@query("dml_update_expr", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(spark, sf):
    db = _customers(spark, sf)
    db.execute("UPDATE c SET c_acctbal = c_acctbal + 100 WHERE c_acctbal < 0")
    return db.execute(_ALL)


@query("dml_update_key", "SELECT CASE WHEN c_nationkey = 4 THEN c_custkey + 90000000 ELSE c_custkey END AS c_custkey, c_acctbal FROM customer")
def _(spark, sf):
    db = _customers(spark, sf)
    db.execute("UPDATE c SET c_custkey = c_custkey + 90000000 WHERE c_nationkey = 4")
    return db.execute(_ALL)


@query("dml_delete_limit", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 20)")
def _(spark, sf):
    db = _customers(spark, sf)
    db.execute("DELETE FROM c WHERE c_acctbal > 0 ORDER BY c_acctbal DESC LIMIT 20")
    return db.execute("SELECT c_custkey FROM c")


# strings, hashes and deadlines
def _strings(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer")
    return c.select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") * 1000).otherwise(F.lit(0)).cast("long").alias("expire_ms"))


NOW = 300_000
_LIVE = "WITH kv AS (SELECT c_name AS key, c_mktsegment AS value, CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 1000 ELSE 0 END AS expire_ms FROM customer), live AS (SELECT * FROM kv WHERE expire_ms = 0 OR expire_ms > 300000) "


@query("ttl_live_filter", _LIVE + "SELECT key FROM live")
def _(spark, sf):
    return strings.alive(_strings(spark, sf), NOW).select("key")


@query("ttl_rounding", _LIVE + "SELECT kv.key, CASE WHEN live.key IS NULL THEN -2 WHEN live.expire_ms = 0 THEN -1 ELSE (live.expire_ms - 300000 + 500) // 1000 END AS ttl FROM kv LEFT JOIN live ON kv.key = live.key")
def _(spark, sf):
    t = _strings(spark, sf)
    return strings.ttl(t, t.select("key"), NOW)


@query("ttl_expire_gt", _LIVE + "SELECT key, CASE WHEN expire_ms > 0 AND 700000 > expire_ms THEN 700000 ELSE expire_ms END AS expire_ms FROM live")
def _(spark, sf):
    t = _strings(spark, sf)
    return strings.expire(t, t.select("key"), F.lit(700_000).cast("long"), NOW, "GT").select("key", "expire_ms")


@query("kv_string_mget", _LIVE + "SELECT n.n_nationkey AS pos, 'Customer#' || lpad(CAST(n.n_nationkey * 40 AS VARCHAR), 9, '0') AS key, live.value FROM nation n LEFT JOIN live ON live.key = 'Customer#' || lpad(CAST(n.n_nationkey * 40 AS VARCHAR), 9, '0')")
def _(spark, sf):
    asked = read(spark, sf, "nation").select(F.col("n_nationkey").alias("pos"), F.concat(F.lit("Customer#"), F.lpad((F.col("n_nationkey") * 40).cast("string"), 9, "0")).alias("key"))
    return strings.mget(_strings(spark, sf), asked, NOW)


@query("kv_set_nx", _LIVE + "SELECT key, value FROM live UNION ALL SELECT DISTINCT c_name, 'new' FROM customer WHERE c_custkey % 2 = 0 AND c_name NOT IN (SELECT key FROM live)")
def _(spark, sf):
    t = _strings(spark, sf)
    rows = read(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_name").alias("key"), F.lit("new").alias("value"), F.lit(0).cast("long").alias("expire_ms"))
    return strings.set_(t, rows, NOW, nx=True).select("key", "value")


@query("kv_mset_last_wins", "SELECT CAST(o_custkey AS VARCHAR) AS key, arg_max(o_orderpriority, o_orderkey) AS value FROM orders GROUP BY o_custkey")
def _(spark, sf):
    o = read(spark, sf, "orders")
    empty = o.select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderpriority").alias("value"), F.lit(0).cast("long").alias("expire_ms")).limit(0)
    return strings.mset(empty, o.select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").cast("string").alias("key"), F.col("o_orderpriority").alias("value")), NOW).select("key", "value")


@query("kv_scan_glob", _LIVE + "SELECT key FROM live WHERE regexp_matches(key, '^Customer#0000.[0-4]..7$') AND key > 'Customer#000000100' ORDER BY key LIMIT 50")
def _(spark, sf):
    return strings.scan(_strings(spark, sf), NOW, "Customer#000000100", "Customer#0000?[0-4]??7", 50)


def _crc_sql(text: str) -> str:
    """CRC-16/XMODEM of an ASCII text, byte by byte without a table."""
    x = "xor(xor((c // 256) % 256, b), xor((c // 256) % 256, b) // 16)"
    step = f"xor(xor((c * 256) % 65536, ({x} * 4096) % 65536), xor(({x} * 32) % 65536, {x}))"
    return f"list_reduce(list_concat([0::BIGINT], list_transform(range(1, strlen({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))), lambda c, b: {step})"


@query("kv_slot_crc16", f"SELECT c_name, CAST({_crc_sql('c_name')} % 16384 AS INTEGER) AS slot FROM customer")
def _(spark, sf):
    return read(spark, sf, "customer").select("c_name", slot(F.col("c_name")).alias("slot"))


def _hash(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer")
    return c.select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("field"), F.col("c_nationkey").cast("string").alias("value"))


@query("kv_hash_hgetall", "SELECT c_mktsegment AS key, count(*) AS n, min(c_name) AS first_field, max(c_name) AS last_field FROM customer GROUP BY c_mktsegment")
def _(spark, sf):
    rows = hashes.hgetall(_hash(spark, sf))
    return rows.select("key", F.size("pairs").cast("long").alias("n"), F.col("pairs")[0]["field"].alias("first_field"), F.element_at("pairs", -1)["field"].alias("last_field"))


@query("kv_hash_hincrby", "SELECT c_mktsegment AS key, c_name AS field, CAST(c_nationkey + CASE WHEN c_custkey % 4 = 0 THEN 5 ELSE 0 END AS VARCHAR) AS value FROM customer")
def _(spark, sf):
    some = read(spark, sf, "customer").filter("c_custkey % 4 = 0").select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("field"), F.lit(5).alias("delta"))
    return hashes.hincrby(_hash(spark, sf), some)


@query("kv_hash_hmget", "SELECT r.r_regionkey AS pos, c.c_mktsegment AS key, c.c_name AS field, CASE WHEN r.r_regionkey = 0 THEN CAST(c.c_nationkey AS VARCHAR) END AS value FROM customer c CROSS JOIN region r WHERE r.r_regionkey = 0 UNION ALL SELECT 1, c_mktsegment, c_name || '?', NULL FROM customer")
def _(spark, sf):
    c = read(spark, sf, "customer")
    asked = c.select(F.col("c_mktsegment").alias("key"), F.lit(0).alias("pos"), F.col("c_name").alias("field")).unionByName(c.select(F.col("c_mktsegment").alias("key"), F.lit(1).alias("pos"), F.concat("c_name", F.lit("?")).alias("field")))
    return hashes.hmget(_hash(spark, sf), asked)


# sets: the customers of each year
def _sets(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select(F.year("o_orderdate").cast("string").alias("key"), F.col("o_custkey").cast("string").alias("member")).distinct()


_YEARS = "WITH s AS (SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) AS key, CAST(o_custkey AS VARCHAR) AS member FROM orders), y AS (SELECT key, row_number() OVER (ORDER BY key) AS i FROM (SELECT DISTINCT key FROM s)) "


#: The customers that ordered with each priority are a set, too.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _by_priority(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_custkey").cast("string").alias("member")).distinct()


for _name, _f, _o in (("kv_set_inter", sets.sinter, "INTERSECT"), ("kv_set_union", sets.sunion, "UNION"), ("kv_set_diff", sets.sdiff, "EXCEPT")):
    _parts = f" {_o} ".join(f"SELECT CAST(o_custkey AS VARCHAR) AS member FROM orders WHERE o_orderpriority = '{p}'" for p in PRIORITIES)
    query(_name, f"SELECT DISTINCT member FROM ({_parts})")(lambda spark, sf, f=_f: f(_by_priority(spark, sf), PRIORITIES))


@query("kv_set_smismember", _YEARS + "SELECT y.key, CAST(c.c_custkey AS INTEGER) AS pos, CAST(c.c_custkey AS VARCHAR) AS member, CASE WHEN s.member IS NULL THEN 0 ELSE 1 END AS flag FROM y CROSS JOIN customer c LEFT JOIN s ON s.key = y.key AND s.member = CAST(c.c_custkey AS VARCHAR)")
def _(spark, sf):
    s = _sets(spark, sf)
    each = read(spark, sf, "customer").select(F.col("c_custkey").cast("int").alias("pos"), F.col("c_custkey").cast("string").alias("member"))
    return sets.smismember(s, each.join(F.broadcast(s.select("key").distinct())))  # one row a year


# lists: the events of each user
def _lists(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("pos"), F.col("event_type").alias("elem"))


_LIST = "WITH l AS (SELECT user_id AS key, event_id AS pos, event_type AS elem, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) "


@query("kv_list_lrange", _LIST + "SELECT key, i, elem FROM l WHERE i >= greatest(n - 5, 0) AND i <= n - 2")
def _(spark, sf):
    return lists.lrange(_lists(spark, sf), -5, -2)


@query("kv_list_ltrim", _LIST + "SELECT key, pos, elem FROM l WHERE i BETWEEN 2 AND n - 3")
def _(spark, sf):
    return lists.ltrim(_lists(spark, sf), 2, -3)


@query("kv_list_lpos", _LIST + "SELECT key, m - 2 AS at, i FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY i DESC) AS m FROM l WHERE elem = 'click') WHERE m BETWEEN 2 AND 4")
def _(spark, sf):
    return lists.lpos(_lists(spark, sf), "click", rank=-2, count=3)


@query("kv_list_lrem", _LIST + "SELECT key, pos, elem FROM (SELECT *, sum(CASE WHEN elem = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY i DESC) AS m FROM l) WHERE elem <> 'view' OR m > 2")
def _(spark, sf):
    return lists.lrem(_lists(spark, sf), "view", -2)


@query("kv_list_linsert", _LIST + ", f AS (SELECT key, min(i) AS i FROM l WHERE elem = 'purchase' GROUP BY key) SELECT key, i * 2 AS pos, elem FROM l UNION ALL SELECT key, i * 2 + 1, 'gift' FROM f")
def _(spark, sf):
    return lists.linsert(_lists(spark, sf), "purchase", "gift", after=True)


@query("kv_list_push", _LIST + "SELECT key, pos, elem FROM l UNION ALL SELECT key, min(pos) - 1, 'new' FROM l GROUP BY key")
def _(spark, sf):
    t = _lists(spark, sf)
    return lists.push(t, t.select("key").distinct().select("key", F.lit(0).cast("long").alias("pos"), F.lit("new").alias("elem")), left=True)


@query("kv_list_pop", _LIST + "SELECT key, n - 1 - i AS at, elem FROM l WHERE i >= n - 2")
def _(spark, sf):
    return lists.pop(_lists(spark, sf), 2, left=False)[0]


# sorted sets: balances by nation
def _zset(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("member"), F.col("c_acctbal").alias("score"))


_Z = "WITH z AS (SELECT c_nationkey AS key, c_name AS member, c_acctbal AS score, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_name) - 1 AS rank, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) "


@query("kv_zset_rank", _Z + "SELECT key, member, score, n - 1 - rank AS rank FROM z")
def _(spark, sf):
    return zsets.zrank(_zset(spark, sf), reverse=True)


@query("kv_zset_range_rank", _Z + "SELECT key, member, score, rank FROM z WHERE rank >= 1 AND rank <= n - 3")
def _(spark, sf):
    return zsets.zrange(_zset(spark, sf), 1, -3)


@query("kv_zset_byscore", _Z + 'SELECT key, member, score, "at" FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank DESC) - 2 AS "at" FROM z WHERE score > 0 AND score <= 5000) WHERE "at" BETWEEN 0 AND 2')
def _(spark, sf):
    return zsets.zrangebyscore(_zset(spark, sf), "(0", "5000", reverse=True, offset=1, count=3)


@query("kv_zset_bylex", _Z + "SELECT key, member, score FROM z WHERE member > 'Customer#000000100' AND member <= 'Customer#000000300'")
def _(spark, sf):
    return zsets.zrangebylex(_zset(spark, sf), "(Customer#000000100", "[Customer#000000300").drop("at")


@query("kv_zset_popmin", _Z + "SELECT key, member, score, rank FROM z WHERE rank < 2")
def _(spark, sf):
    return zsets.zpop(_zset(spark, sf), 2)[0]


@query("kv_zset_count", _Z + "SELECT key, count(*) AS n FROM z WHERE score >= 1000 AND score < 7000 GROUP BY key")
def _(spark, sf):
    return zsets.zcount(_zset(spark, sf), "1000", "(7000")


@query("kv_zset_remrange", _Z + "SELECT key, member, score FROM z WHERE NOT (rank >= n - 3)")
def _(spark, sf):
    return zsets.zremrangebyrank(_zset(spark, sf), -3, -1).select("key", "member", "score")


def _totals(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("key"), F.col("o_custkey").alias("member")).agg(F.max("o_totalprice").alias("score"))


_T = "WITH t AS (SELECT o_orderstatus AS key, o_custkey AS member, max(o_totalprice) AS score FROM orders GROUP BY 1, 2) "


@query("kv_zset_unionstore", _T + "SELECT member, max(score * CASE key WHEN 'F' THEN 2 ELSE 1 END) AS score FROM t WHERE key IN ('F', 'O') GROUP BY member")
def _(spark, sf):
    return zsets.combine(_totals(spark, sf), ["F", "O"], [2.0, 1.0], "max")


@query("kv_zset_interstore", _T + "SELECT member, min(score) AS score FROM t WHERE key IN ('F', 'O') GROUP BY member HAVING count(*) = 2")
def _(spark, sf):
    return zsets.combine(_totals(spark, sf), ["F", "O"], None, "min", every=True)


@query("kv_zset_diffstore", _T + "SELECT member, score FROM t WHERE key = 'F' AND member NOT IN (SELECT member FROM t WHERE key = 'P')")
def _(spark, sf):
    return zsets.zdiff(_totals(spark, sf), ["F", "P"])


@query("kv_zadd_flags", "SELECT CAST(user_id AS VARCHAR) AS key, event_type AS member, max(value) AS score FROM events GROUP BY 1, 2")
def _(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("member"), F.col("event_id").alias("pos"), F.col("value").alias("score"))
    empty = e.select("key", "member", "score").limit(0)
    return zsets.zadd(empty, e, gt=True).select("key", "member", "score")


# JSON
def _props(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", "props")


@query("json_get_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS v FROM events")
def _(spark, sf):
    return _props(spark, sf).select("event_id", J.json_get(F.col("props"), ".k").alias("v"))


@query("json_type", "SELECT event_id, 'integer' AS t, 'object' AS root FROM events")
def _(spark, sf):
    return _props(spark, sf).select("event_id", J.json_type(F.col("props"), ".k").alias("t"), J.json_type(F.col("props")).alias("root"))


@query("json_numincrby", "SELECT event_id, '{\"k\":' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) + 2 AS VARCHAR) || '}' AS props FROM events")
def _(spark, sf):
    return _props(spark, sf).select("event_id", J.json_numincrby(F.col("props"), ".k", 2).alias("props"))


@query("json_arrlen", "SELECT event_id, CAST(3 AS BIGINT) AS n, 'k' AS key FROM events")
def _(spark, sf):
    doc = J.json_set(F.col("props"), ".a", [1, 2, 3])
    return _props(spark, sf).select("event_id", J.json_arrlen(doc, ".a").alias("n"), J.json_objkeys(doc)[0].alias("key"))


@query("json_arr_edit", "SELECT event_id, '[1,9,2]' AS a FROM events")
def _(spark, sf):
    doc = J.json_arrpop(J.json_arrinsert(J.json_set(F.col("props"), ".a", [1, 2, 3]), ".a", 1, 9), ".a")
    return _props(spark, sf).select("event_id", J.json_get(doc, ".a").alias("a"))


# streams: one for each event type
def _log(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    return e.select(F.col("event_type").alias("stream"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_id", "user_id")


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return log.assign_ids(_log(spark, sf)).select("stream", "ms", "seq", "event_id", "user_id")


_X = "WITH e AS (SELECT event_type AS stream, event_id, user_id, max(epoch_us(ts) // 1000) OVER (PARTITION BY event_type ORDER BY event_id) AS ms FROM events), x AS (SELECT stream, ms, row_number() OVER (PARTITION BY stream, ms ORDER BY event_id) - 1 AS seq, event_id, user_id FROM e), o AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ms, seq) AS i, count(*) OVER (PARTITION BY stream) AS n FROM x) "


@query("mq_xadd_ids", _X + "SELECT stream, ms, seq, event_id FROM x")
def _(spark, sf):
    return _entries(spark, sf).drop("user_id")


@query("mq_xrange", _X + "SELECT stream, ms, seq FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ms, seq) AS j FROM x WHERE ms >= 1704500000000 AND ms <= 1705500000000) WHERE j <= 20")
def _(spark, sf):
    return log.xrange(_entries(spark, sf), "1704500000000", "1705500000000", 20).select("stream", "ms", "seq")


@query("mq_xlen", "SELECT event_type AS stream, count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf):
    return log.xlen(_entries(spark, sf))


def _positions(rows: DataFrame) -> DataFrame:
    n = F.row_number().over(log.by_stream())
    return rows.withColumn("_n", n).filter("_n = 10").select("stream", F.col("ms").alias("after_ms"), F.col("seq").alias("after_seq"))


@query("mq_xread_count", _X + "SELECT stream, ms, seq FROM o WHERE i BETWEEN 11 AND 25")
def _(spark, sf):
    rows = _entries(spark, sf)
    return log.xread(rows, _positions(rows), 15).select("stream", "ms", "seq")


@query("mq_xtrim", _X + "SELECT stream, ms, seq FROM o WHERE i > n - 30")
def _(spark, sf):
    return log.xtrim(_entries(spark, sf), 30).select("stream", "ms", "seq")


@query("mq_xpick_least_backlog", "SELECT 'users' AS parent, arg_min(event_type, struct_pack(n := n, t := event_type)) AS child FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)")
def _(spark, sf):
    return log.pick_least_backlog(log.xlen(_entries(spark, sf)).select(F.lit("users").alias("parent"), F.col("stream").alias("child"), "n"))


def _groups(rows: DataFrame) -> DataFrame:
    p = _positions(rows)
    mark = [F.col("after_ms").alias("delivered_ms"), F.col("after_seq").alias("delivered_seq"), F.col("after_ms").alias("committed_ms"), F.col("after_seq").alias("committed_seq")]
    return p.select("stream", F.lit("g").alias("grp"), F.lit(0).cast("long").alias("created_ms"), *mark)


def _pending(rows: DataFrame) -> DataFrame:
    """All entries of each stream past the tenth, owned in turn by the users' last digit, delivered at their own
    time."""
    some = rows.withColumn("i", F.row_number().over(log.by_stream())).filter("i > 10")
    owner: Column = F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string"))
    return some.select("stream", F.lit("g").alias("grp"), "ms", "seq", owner.alias("consumer"), F.col("ms").alias("delivered_at"), F.lit(1).alias("times"))


_P = _X + ", p AS (SELECT stream, ms, seq, 'c' || CAST(user_id % 3 AS VARCHAR) AS consumer, ms AS delivered_at, i FROM o WHERE i > 10) "
CLOCK = 1_705_000_000_000


@query("mq_group_deliver", _X + "SELECT stream, 'g' AS grp, ms, seq, 'c1' AS consumer, CAST(5 AS BIGINT) AS delivered_at, 1 AS times FROM o WHERE i BETWEEN 11 AND 17")
def _(spark, sf):
    rows = _entries(spark, sf)
    return groups.deliver(rows, _groups(rows), "c1", 5, 7)


@query("mq_ack_count", _X + "SELECT stream, 'g' AS grp, CAST(sum(CASE WHEN i > 10 THEN 1 ELSE 0 END) AS BIGINT) AS acked FROM o WHERE i BETWEEN 6 AND 14 GROUP BY stream")
def _(spark, sf):
    rows = _entries(spark, sf)
    ids = rows.withColumn("i", F.row_number().over(log.by_stream())).filter("i BETWEEN 6 AND 14").select("stream", F.lit("g").alias("grp"), "ms", "seq")
    return groups.ack(_groups(rows), _pending(rows), ids)[0]


@query("mq_group_backlog", _X + "SELECT stream, 'g' AS grp, greatest(count(*) - 10, 0) AS n FROM o GROUP BY stream HAVING count(*) >= 10")
def _(spark, sf):
    rows = _entries(spark, sf)
    return groups.backlog(rows, _groups(rows))


@query("mq_xinfo_groups", _X + "SELECT stream, 'g' AS grp, max(i) AS delivered, CAST(10 AS BIGINT) AS committed FROM o WHERE i <= 17 GROUP BY stream")
def _(spark, sf):
    rows = _entries(spark, sf)
    first = _groups(rows)
    info = groups.xinfo_groups(groups.advance(first, groups.deliver(rows, first, "c1", 5, 7)))
    placed = rows.select("stream", log.entry_id().alias("id"), F.row_number().over(log.by_stream()).cast("long").alias("i"))
    info = info.withColumnsRenamed({"last_delivered": "_last", "committed": "_done"})
    for mark, name in (("_last", "delivered"), ("_done", "committed")):
        info = info.join(placed.select("stream", F.col("id").alias(mark), F.col("i").alias(name)), ["stream", mark])
    return info.select("stream", "grp", "delivered", "committed")


@query("mq_xinfo_totals", "SELECT count(*) AS messages, count(DISTINCT event_type) AS streams_live FROM events")
def _(spark, sf):
    return log.xinfo_totals(_log(spark, sf))


@query("mq_xinfo_children", "SELECT event_type AS parent, CAST(user_id % 5 AS VARCHAR) AS child, count(*) AS length FROM events GROUP BY 1, 2")
def _(spark, sf):
    child: Column = F.concat("stream", F.lit("/"), (F.col("user_id") % 5).cast("string"))
    return log.xinfo_children(_log(spark, sf).withColumn("stream", child))


@query("mq_pending_summary", _P + "SELECT stream, count(*) AS total, min(ms) AS first_ms, max(ms) AS last_ms, count(DISTINCT consumer) AS consumers FROM p GROUP BY stream")
def _(spark, sf):
    s = groups.pending_summary(_pending(_entries(spark, sf)))
    return s.select("stream", "total", F.col("first.ms").alias("first_ms"), F.col("last.ms").alias("last_ms"), F.size("consumers").cast("long").alias("consumers"))


@query("mq_pending_range", _P + "SELECT stream, ms, seq, 1705000000000 - delivered_at AS idle FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ms, seq) AS j FROM p WHERE consumer = 'c1' AND 1705000000000 - delivered_at >= 1000) WHERE j <= 5")
def _(spark, sf):
    return groups.pending_range(_pending(_entries(spark, sf)), "-", "+", 5, CLOCK, 1000, "c1").select("stream", "ms", "seq", "idle")


@query("mq_claim", _P + "SELECT stream, ms, seq, 'c9' AS consumer, 2 AS times FROM p WHERE 1705000000000 - delivered_at >= 1000 AND i % 2 = 0")
def _(spark, sf):
    rows = _entries(spark, sf)
    ids = rows.withColumn("i", F.row_number().over(log.by_stream())).filter("i % 2 = 0").select("stream", F.lit("g").alias("grp"), "ms", "seq")
    return groups.claim(rows, _pending(rows), ids, "c9", 1000, CLOCK)[0].select("stream", "ms", "seq", "consumer", "times")


@query("mq_autoclaim", _P + "SELECT stream, ms, seq, outcome FROM (SELECT *, sum(CASE WHEN outcome = 'claimed' THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, row_number() OVER (PARTITION BY stream ORDER BY ms, seq) AS s FROM (SELECT *, CASE WHEN 1705000000000 - delivered_at < 1000 THEN 'busy' WHEN i % 5 = 0 THEN 'deleted' ELSE 'claimed' END AS outcome FROM p)) WHERE coalesce(b, 0) < 8 AND s <= 80")
def _(spark, sf):
    rows = _entries(spark, sf)
    kept = rows.withColumn("i", F.row_number().over(log.by_stream())).filter("i % 5 <> 0").drop("i")
    return groups.autoclaim(kept, _pending(rows), "c9", 1000, "-", CLOCK, 8).select("stream", "ms", "seq", "outcome")


# search
_TOKENS = r"WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents), "


@query("ft_postings", _TOKENS + "u AS (SELECT doc_id, unnest(t) AS term FROM d) SELECT doc_id AS doc, 'text' AS field, term, count(*) AS tf FROM u GROUP BY doc_id, term")
def _(spark, sf):
    return search.postings(read(spark, sf, "documents"), ["text"]).select("doc", "field", "term", "tf")


@query("ft_df", _TOKENS + "u AS (SELECT doc_id, unnest(t) AS term FROM d), p AS (SELECT doc_id, term, count(*) AS tf FROM u GROUP BY doc_id, term) SELECT 'text' AS field, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf FROM p GROUP BY term")
def _(spark, sf):
    return search.term_stats(search.postings(read(spark, sf, "documents"), ["text"]))


def _bm25(terms: list[str], every: bool = False) -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{t}')) AS f{i}" for i, t in enumerate(terms))
    df = ", ".join(f"sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END) AS d{i}" for i in range(len(terms)))
    one = "CASE WHEN f{i} > 0 THEN ln(1 + (n - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)) * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * greatest(l, 1) / a)) ELSE 0 END"
    score = " + ".join(one.format(i=i) for i in range(len(terms)))
    hit = (" AND " if every else " OR ").join(f"f{i} > 0" for i in range(len(terms)))
    return _TOKENS + f"c AS (SELECT doc_id, len(t) AS l, {tf} FROM d), s AS (SELECT count(*) AS n, avg(l) AS a, {df} FROM c) SELECT doc_id AS doc, round({score}, 6) AS score FROM c CROSS JOIN s WHERE {hit} ORDER BY round({score}, 9) DESC, doc_id LIMIT 20"


def _searched(text: str, mode: str = "any", count: int = 20):
    def run(spark, sf):
        rows = search.text_search(read(spark, sf, "documents"), ["text"], text, 0, count, mode=mode)
        return rows.select("doc", F.round("score", 6).alias("score"))

    return run


query("ft_bm25_any", _bm25(["the", "license", "and"]))(_searched("the license and"))
query("ft_bm25_field", _bm25(["idiot"]))(_searched("@text:idiot"))
query("ft_bm25_all", _bm25(["the", "license"], True))(_searched("the license", "all"))


@query("ft_match_all_page", "SELECT doc_id AS doc, 1.0::DOUBLE AS score FROM documents ORDER BY length(CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR) LIMIT 15 OFFSET 5")
def _(spark, sf):
    return search.text_search(read(spark, sf, "documents"), ["text"], "*", 5, 15)


@query("ft_info", _TOKENS + "x AS (SELECT count(*) AS num_docs, CAST(sum(len(t)) AS BIGINT) AS sum_doclen, avg(len(t)) AS avg_doclen, 'text' AS fields FROM d) SELECT num_docs, sum_doclen, round(avg_doclen, 6) AS avg_doclen, fields FROM x")
def _(spark, sf):
    return search.index_info(read(spark, sf, "documents"), ["text"]).withColumn("avg_doclen", F.round("avg_doclen", 6))


# the query of vector searches is a fixed one
QUERY = [((i * 37) % 11 - 5) / 10.0 for i in range(64)]
_Q = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY) + "]"


# the stored index: two additions, some documents replaced and some deleted, so that segments overlap
_indexes: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf: str, name: str, make: Callable[[SparkSession, str], TextIndex]) -> TextIndex:
    """An index is made for the first query that searches it."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _indexes:
        _indexes[key] = make(spark, sf).storage.root
    return TextIndex(spark, _indexes[key])


def _stored(spark: SparkSession, sf: str) -> TextIndex:
    docs = read(spark, sf, "documents").select("doc_id", "text", "source")
    index = TextIndex.create(spark, structured.work_folder(spark, "index"), ["text", "source"])
    index.add(docs.withColumn("text", F.when(F.col("doc_id") % 4 == 1, F.lit("the license and nothing more")).otherwise(F.col("text"))))
    index.add(docs.filter("doc_id % 4 = 1"))
    index.delete(docs.filter("doc_id % 9 = 5").select("doc_id"))
    return index


_KEPT = _TOKENS.replace("lower(text)", "lower(text || ' ' || source)").replace("FROM documents", "FROM documents WHERE doc_id % 9 <> 5")


@query("ft_index_search", _bm25(["the", "license"]).replace("FROM documents)", "FROM documents WHERE doc_id % 9 <> 5)").replace("AS t FROM", "AS t, regexp_extract_all(lower(source), '[\\p{L}\\p{N}]+') AS s FROM").replace("len(t) AS l", "len(t) + len(s) AS l"))
def _(spark, sf):
    return _once(spark, sf, "text", _stored).search("@text:the @text:license", 0, 20).select("doc", F.round("score", 6).alias("score"))


@query("ft_index_info", _KEPT + "x AS (SELECT count(*) AS num_docs, CAST(sum(len(t)) AS BIGINT) AS sum_doclen FROM d) SELECT num_docs, sum_doclen, 'text,source' AS fields, false AS ann_built, CAST(0 AS BIGINT) AS ann_centroids FROM x")
def _(spark, sf):
    return _once(spark, sf, "text", _stored).info().drop("avg_doclen")


@query("ft_index_terms", _TOKENS.replace("FROM documents", "FROM documents WHERE doc_id % 9 <> 5") + "u AS (SELECT DISTINCT doc_id, unnest(t) AS term FROM d) SELECT 'text' AS field, term, count(*) AS df FROM u GROUP BY term")
def _(spark, sf):
    return search.term_stats(_once(spark, sf, "text", _stored).postings().filter("field = 'text'")).drop("total_tf")


def _vector_index(spark: SparkSession, sf: str) -> TextIndex:
    v = read(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("label "), "label").alias("t"), "embedding")
    index = TextIndex.create(spark, structured.work_folder(spark, "index"), ["t"], "embedding", doc="vec_id")
    index.add(v.filter("vec_id % 3 <> 0"))
    index.build(k=8, iterations=4, seed=3)
    index.add(v.filter("vec_id % 3 = 0"))  # goes to the partitions that are there
    index.delete(v.filter("vec_id % 10 = 7").select("vec_id"))
    return index


_KNN_DOC = "SELECT doc, round(list_distance(v, {q}), 6) AS dist FROM (SELECT vec_id AS doc, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 10 <> 7 {where}) ORDER BY round(list_distance(v, {q}), 9), doc LIMIT 12"


@query("ft_index_knn_probe_all", _KNN_DOC.format(q=_Q, where=""))
def _(spark, sf):
    return _once(spark, sf, "vector", _vector_index).knn(QUERY, 12, nprobe=8).select("doc", F.round("dist", 6).alias("dist"))


@query("ft_index_knn_prefilter", _KNN_DOC.format(q=_Q, where="AND label = 3"))
def _(spark, sf):
    return _once(spark, sf, "vector", _vector_index).search("@t:3", 0, 12, knn=(12, QUERY)).select("doc", F.round("dist", 6).alias("dist"))


# vectors
def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("element"), F.col("embedding").alias("vector"), "label")


@query("vec_vsim_cosine", f"SELECT element, round((list_cosine_similarity(v, {_Q}) + 1) / 2, 6) AS score FROM (SELECT vec_id AS element, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) ORDER BY round((list_cosine_similarity(v, {_Q}) + 1) / 2, 9) DESC, element LIMIT 15")
def _(spark, sf):
    return vectors.vsim(_vectors(spark, sf), QUERY, 15).select("element", F.round("score", 6).alias("score"))


_KNN = "SELECT element, round(list_distance(v, {q}), 6) AS dist FROM (SELECT vec_id AS element, CAST(embedding AS DOUBLE[]) AS v FROM embeddings {where}) ORDER BY round(list_distance(v, {q}), 9), element LIMIT 15"


@query("vec_knn_l2", _KNN.format(q=_Q, where=""))
def _(spark, sf):
    return vectors.knn(_vectors(spark, sf), QUERY, 15).select("element", F.round("dist", 6).alias("dist"))


@query("vec_knn_prefilter", _KNN.format(q=_Q, where="WHERE label = 3"))
def _(spark, sf):
    docs = _vectors(spark, sf).withColumn("t", F.concat(F.lit("Label-"), "label"))
    return vectors.knn(search.prefilter(docs, ["t"], "@t:3 label"), QUERY, 15).select("element", F.round("dist", 6).alias("dist"))


@query("vec_spann_full_probe", _KNN.format(q=_Q, where=""))
def _(spark, sf):
    index, centroids = vectors.build(_vectors(spark, sf), k=8, iterations=4, seed=3)
    return vectors.probe(index, centroids, QUERY, 15, nprobe=8).select("element", F.round("dist", 6).alias("dist"))


@query("vec_sq8_calibration", "WITH a AS (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS axis FROM embeddings) SELECT axis, round(CAST(min(x) AS DOUBLE), 6) AS lo, round(greatest((CAST(max(x) AS DOUBLE) - CAST(min(x) AS DOUBLE)) / 255, 1e-9), 6) AS scale FROM a GROUP BY axis")
def _(spark, sf):
    fit = vectors.sq8_fit(_vectors(spark, sf).withColumn("vector", F.col("vector").cast("array<double>")))
    return fit.select("axis", F.round("lo", 6).alias("lo"), F.round("scale", 6).alias("scale"))


# Structured Streaming twins: the events file as a stream, run over what is there
def _stream(spark: SparkSession, sf: str) -> DataFrame:
    # as a pattern, for a stream's source takes a folder or a pattern and the table may be one file
    e = structured.read_log(spark, f"{sf}/events.parque[t]", read(spark, sf, "events").schema)
    ts = F.col("ts").cast("timestamp")
    return e.select(F.col("event_type").alias("stream"), F.unix_millis(ts).alias("ms"), "event_id", ts.alias("ts"))


@query("stream_xadd_ids", ORACLES["mq_xadd_ids"])
def _(spark, sf):
    folder = structured.work_folder(spark, "xadd")
    return structured.run_available(structured.numbered(_stream(spark, sf)), f"{folder}/out", f"{folder}/mark").select("stream", "ms", "seq", "event_id")


@query("stream_xlen", ORACLES["mq_xlen"])
def _(spark, sf):
    folder = structured.work_folder(spark, "xlen")
    return structured.complete(structured.lengths(_stream(spark, sf)), f"{folder}/out", f"{folder}/mark").select("stream", "n")


@query("stream_tumbling", "SELECT event_type AS stream, epoch_us(date_trunc('day', ts)) AS start_us, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    folder = structured.work_folder(spark, "tumbling")
    rows = structured.complete(structured.windowed(_stream(spark, sf), "60 days", "1 day"), f"{folder}/out", f"{folder}/mark")
    return rows.select("stream", F.unix_micros("start").alias("start_us"), "n")
