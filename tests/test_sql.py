"""SQL over versioned tables: the dialect's rules, changes, transactions, and what is rejected."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from tessera.errors import SqlError
from tessera.sources.database import Database
from tessera.sources.storage import Conflict


@pytest.fixture()
def db(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    db.execute("CREATE TABLE parcels (code BIGINT PRIMARY KEY, town VARCHAR(40) NULL, kilos DOUBLE NOT NULL, fragile BOOL NOT NULL, shelf BIGINT NULL)")
    db.execute("INSERT INTO parcels VALUES (10,'lyon',2.5,0,1), (20,'bern',8.0,1,2), (30,NULL,0.75,1,1), (40,'oslo',8.0,0,NULL), (50,'bern',1.25,0,2), (60,'riga',4.5,1,3)")
    return db


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_grouping_takes_the_first_row_for_bare_columns(db):
    q = "SELECT shelf, COUNT(*), SUM(kilos), town FROM parcels GROUP BY shelf HAVING COUNT(*) > 1 ORDER BY shelf DESC"
    assert rows(db.execute(q)) == [(2, 2, 9.25, "bern"), (1, 2, 3.25, "lyon")]
    assert rows(db.execute("SELECT COUNT(*), MAX(kilos) FROM parcels WHERE shelf = 99")) == [(0, None)]
    assert rows(db.execute("SELECT COUNT(DISTINCT town), COUNT(town), COUNT(*) FROM parcels")) == [(4, 5, 6)]


def test_null_rules(db):
    assert [r[0] for r in rows(db.execute("SELECT code FROM parcels WHERE NOT (town = 'bern') ORDER BY code"))] == [10, 30, 40, 60]
    assert rows(db.execute("SELECT shelf IN (NULL, 2), shelf IN (2, NULL), shelf BETWEEN NULL AND 1 FROM parcels WHERE code = 50")) == [(None, True, None)]
    assert [r[0] for r in rows(db.execute("SELECT town FROM parcels ORDER BY town"))] == [None, "bern", "bern", "lyon", "oslo", "riga"]
    assert rows(db.execute("SELECT code FROM parcels ORDER BY shelf DESC LIMIT 3 OFFSET 2")) == [(50,), (10,), (30,)]
    assert rows(db.execute("SELECT code FROM parcels WHERE shelf IS NULL OR town IS NULL")) == [(30,), (40,)]


def test_arithmetic(db):
    assert rows(db.execute("SELECT -7 / 2, -7 % 3, 7 / 0, 7 % 0, 7.0 / 2, 9223372036854775807 + 1 FROM parcels LIMIT 1")) == [(-3, -1, None, None, 3.5, -(1 << 63))]
    assert rows(db.execute("SELECT LENGTH(town), UPPER(town), ABS(-code) FROM parcels WHERE code = 40")) == [(4, "OSLO", 40)]


def test_joins_and_names(db):
    db.execute("CREATE TABLE shelves (shelf BIGINT PRIMARY KEY, hall VARCHAR(8))")
    db.execute("INSERT INTO shelves VALUES (1,'north'), (3,'south'), (9,'east')")
    q = "SELECT code, hall FROM parcels JOIN shelves ON parcels.shelf = shelves.shelf ORDER BY code"
    assert rows(db.execute(q)) == [(10, "north"), (30, "north"), (60, "south")]
    assert len(rows(db.execute("SELECT * FROM parcels a JOIN parcels b JOIN shelves"))) == 108
    with pytest.raises(SqlError) as e:
        db.execute("SELECT shelf FROM parcels JOIN shelves ON parcels.shelf = shelves.shelf")
    assert e.value.kind == "bad_field"


@pytest.mark.parametrize(
    ("sql", "kind"),
    [
        ("SELECT nope FROM parcels", "bad_field"),
        ("SELECT * FROM nope", "no_such_table"),
        ("SELECT code + TRUE FROM parcels", "unknown"),
        ("SELECT code FROM parcels WHERE town = 1", "unknown"),
        ("SELECT code FROM parcels WHERE town", "unknown"),
        ("SELECT code AS x FROM parcels ORDER BY x", "bad_field"),
        ("SELECT ABS(SUM(code)) FROM parcels", "unknown"),
        ("SELECT SUM(MAX(code)) FROM parcels", "unknown"),
        ("SELECT a.* FROM parcels a", "not_supported"),
        ("SELECT code FROM parcels a LEFT JOIN parcels b ON a.code = b.code", "not_supported"),
        ("SELECT CAST(code AS CHAR) FROM parcels", "not_supported"),
        ("SELECT COUNT(DISTINCT *) FROM parcels", "parse"),
        ("INSERT INTO parcels VALUES (1)", "wrong_value_count"),
        ("INSERT INTO parcels VALUES (9, 'x', NULL, 1, 1)", "bad_null"),
        ("INSERT INTO parcels VALUES (9, 5, 1.0, 1, 1)", "unknown"),
        ("CREATE TABLE parcels (code BIGINT PRIMARY KEY)", "table_exists"),
        ("CREATE TABLE d (id BIGINT PRIMARY KEY, x DATETIME)", "not_supported"),
        ("CREATE TABLE d (id BIGINT)", "not_supported"),
        ("SELECT @@nope", "unknown"),
        ("REPLACE INTO parcels VALUES (1)", "not_supported"),
    ],
)
def test_errors(db, sql, kind):
    with pytest.raises(SqlError) as e:
        db.execute(sql)
    assert e.value.kind == kind


def test_changes(db):
    assert rows(db.execute("UPDATE parcels SET kilos = kilos * 2, town = 'kiel' WHERE code = ?", [50])) == [(1,)]
    assert rows(db.execute("UPDATE parcels SET town = 'kiel' WHERE code = 50")) == [(0,)]
    assert rows(db.execute("SELECT kilos, town FROM parcels WHERE code = 50")) == [(2.5, "kiel")]
    assert rows(db.execute("UPDATE parcels SET code = 55 WHERE code = 50")) == [(1,)]
    assert rows(db.execute("DELETE FROM parcels ORDER BY kilos DESC LIMIT 2")) == [(2,)]  # ties by key: 20 and 40
    assert sorted(rows(db.execute("SELECT code FROM parcels"))) == [(10,), (30,), (55,), (60,)]
    db.execute("INSERT INTO parcels (code, kilos, fragile) VALUES (30, 1, 0), (30, 2, 0)")
    assert rows(db.execute("SELECT town, kilos FROM parcels WHERE code = 30")) == [(None, 2.0)]


def test_many_changes_fold(db):
    for n in range(12):
        db.execute(f"UPDATE parcels SET kilos = {n}.5 WHERE code = 10")
    assert rows(db.execute("SELECT kilos FROM parcels WHERE code = 10")) == [(11.5,)]


def test_indexes(db):
    db.execute("DELETE FROM parcels WHERE code = 50")
    db.execute("CREATE UNIQUE INDEX by_town ON parcels (town)")
    db.execute("INSERT INTO parcels VALUES (70, NULL, 1, 1, 1)")
    with pytest.raises(SqlError) as e:
        db.execute("INSERT INTO parcels VALUES (80, 'oslo', 1, 1, 1)")
    assert e.value.code == 1062
    db.execute("INSERT INTO parcels VALUES (40, 'oslo', 1, 1, 1)")  # its own key is replaced
    assert rows(db.execute("EXPLAIN SELECT code FROM parcels WHERE town = 'oslo'"))[0] == ("IndexScan by_town on parcels -> 1 pks",)
    assert rows(db.execute("SHOW INDEX FROM parcels"))[1] == ("parcels", 1, "by_town", 1, "town", "BTREE")
    assert [r[3] for r in rows(db.execute("SHOW COLUMNS FROM parcels"))] == ["PRI", "UNI", "", "", ""]
    db.execute("DROP INDEX by_town ON parcels")
    with pytest.raises(SqlError):
        db.execute("CREATE UNIQUE INDEX i ON parcels (fragile)")
    assert rows(db.repeated("parcels", "fragile").orderBy("n"))[-1] == (True, 5)


def test_reads_by_index(db, spark):
    db.write("parcels", spark.range(1000, 9000).selectExpr("id AS code", "concat('t', id % 400) AS town", "double(id % 7) AS kilos", "false AS fragile", "id % 50 AS shelf"))
    db.compact("parcels", db.storage.latest())
    db.execute("CREATE INDEX by_town ON parcels (town)")
    queries = ["SELECT code FROM parcels WHERE town = 't17' ORDER BY code", "SELECT COUNT(*) FROM parcels WHERE kilos > 2 AND town BETWEEN 't3' AND 't5'", "SELECT code FROM parcels WHERE town IN ('bern', 't9') ORDER BY code", "SELECT code FROM parcels WHERE NOT town = 't17' AND shelf = 3 ORDER BY code"]

    def copy():
        return db._entry("parcels")["indexes"][0]["copy"]

    def check():
        index = db._entry("parcels")["indexes"][0]
        for n, q in enumerate(queries):
            found = db.execute(q)
            assert any(index["copy"] in f for f in found.inputFiles()) == (n < 3)
            plain = found if n == 3 else db.execute(q.replace("town", "UPPER(town)").replace("'t", "'T").replace("'bern'", "'BERN'"))
            assert rows(found) == rows(plain)

    check()
    found = db.execute(queries[0])
    assert len(rows(found)) == 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(town,t17)" in plan
    stored = spark.read.parquet(copy()).groupBy(F.input_file_name()).agg(F.min("town"), F.max("town")).orderBy(F.min("town")).collect()
    assert all(a[2] <= b[1] for a, b in zip(stored, stored[1:]))
    # what is not folded yet, changed and deleted rows, and a transaction's own
    db.execute("INSERT INTO parcels VALUES (1, 't17', 1.0, 0, 1)")
    assert db.execute("UPDATE parcels SET town = 'gone' WHERE town = 't17' AND code > 8000").first()[0] == 3
    assert db.execute("DELETE FROM parcels WHERE town = 't9' LIMIT 4").first()[0] == 4
    check()
    assert len(rows(db.execute(queries[0]))) == 18
    db.execute("BEGIN")
    db.execute("INSERT INTO parcels VALUES (2, 't17', 1.0, 0, 1)")
    assert [r[0] for r in rows(db.execute(queries[0]))][:2] == [1, 2]
    db.execute("ROLLBACK")
    # folds make the copy anew; the key's own order serves conditions on the key
    old = copy()
    db.compact("parcels", db.storage.latest())
    assert copy() != old
    check()
    assert not any(copy() in f for f in db.execute("SELECT * FROM parcels WHERE town = 't17' AND code = 1").inputFiles())
    db.vacuum(keep=1, older_s=-60)
    check()
    assert not os.path.exists(old)


def test_explain(db):
    plan = rows(db.execute("EXPLAIN SELECT shelf, COUNT(*) AS n FROM parcels WHERE code > 10 GROUP BY shelf HAVING COUNT(*) > 1 ORDER BY shelf DESC LIMIT 3"))
    assert [r[0] for r in plan] == ["SeqScan parcels", "Filter: code > 10", "Group: shelf", "Aggregate: COUNT(*)", "Having: COUNT(*) > 1", "Project: shelf, COUNT(*) AS n", "Order: shelf DESC", "Limit: 3 Offset: 0"]
    assert rows(db.execute("EXPLAIN DELETE FROM parcels")) == [("Direct execution (delete)",)]


def test_transactions(db, spark, tmp_path):
    other = Database(spark, str(tmp_path / "db"))
    db.execute("BEGIN")
    db.execute("UPDATE parcels SET kilos = 100 WHERE code = 10")
    assert rows(db.execute("SELECT kilos FROM parcels WHERE code = 10")) == [(100.0,)]
    assert rows(other.execute("SELECT kilos FROM parcels WHERE code = 10")) == [(2.5,)]
    other.execute("UPDATE parcels SET kilos = 50 WHERE code = 20")
    assert rows(db.execute("SELECT kilos FROM parcels WHERE code = 20")) == [(8.0,)]  # the snapshot stays
    with pytest.raises(SqlError) as e:
        db.execute("DROP TABLE parcels")
    assert e.value.kind == "txn_ddl"
    db.execute("COMMIT")
    assert sorted(rows(other.execute("SELECT kilos FROM parcels WHERE code IN (10, 20)"))) == [(50.0,), (100.0,)]
    db.execute("BEGIN")
    db.execute("DELETE FROM parcels WHERE code = 30")
    other.execute("UPDATE parcels SET kilos = 1 WHERE code = 30")
    with pytest.raises(SqlError) as e:
        db.execute("COMMIT")
    assert e.value.code == 1213
    db.execute("BEGIN")
    db.execute("DELETE FROM parcels")
    db.execute("ROLLBACK")
    assert rows(db.execute("SELECT COUNT(*) FROM parcels")) == [(6,)]


def test_two_transactions_cannot_share_a_unique_value(db, spark, tmp_path):
    db.execute("CREATE TABLE badge (id BIGINT PRIMARY KEY, word VARCHAR(8))")
    db.execute("CREATE UNIQUE INDEX one ON badge (word)")
    other = Database(spark, str(tmp_path / "db"))
    db.execute("BEGIN")
    other.execute("BEGIN")
    db.execute("INSERT INTO badge VALUES (1, 'x'), (5, 'y')")
    other.execute("INSERT INTO badge VALUES (2, 'x')")
    db.execute("COMMIT")
    with pytest.raises(SqlError) as e:
        other.execute("COMMIT")
    assert e.value.kind == "dup_entry" and sorted(rows(db.execute("SELECT id, word FROM badge"))) == [(1, "x"), (5, "y")]
    # an index that is made after a transaction began holds for it as well
    db.execute("DROP INDEX one ON badge")
    other.execute("BEGIN")
    other.execute("INSERT INTO badge VALUES (3, 'y')")
    db.execute("CREATE UNIQUE INDEX one ON badge (word)")
    with pytest.raises(SqlError):
        other.execute("COMMIT")


def test_a_change_by_itself_is_not_lost(db, spark, tmp_path):
    other = Database(spark, str(tmp_path / "db"))
    write, done = db.storage.write, []

    def between(*args):
        path = write(*args)
        if not done:
            done.append(other.execute("UPDATE parcels SET shelf = shelf + 10 WHERE code = 10"))
        return path

    db.storage.write = between
    assert rows(db.execute("UPDATE parcels SET shelf = shelf + 1 WHERE code = 10")) == [(1,)]
    assert rows(db.execute("SELECT shelf FROM parcels WHERE code = 10")) == [(12,)]
    sessions = [Database(spark, str(tmp_path / "db")) for _ in range(3)]
    threads = [threading.Thread(target=s.execute, args=("UPDATE parcels SET shelf = shelf + 1 WHERE code = 20",)) for s in sessions]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert rows(db.execute("SELECT shelf FROM parcels WHERE code = 20")) == [(5,)]


def test_a_manifest_is_whole_or_not_there(db):
    store = db.storage
    n = store.latest()
    with pytest.raises(Conflict):
        store.commit(n, {"tables": {}})
    assert store.latest() == n and store.manifest(n)["tables"]
    store.local = False  # as on other file systems: a rename that fails if the name is taken
    store.commit(n + 1, store.manifest(n))
    with pytest.raises(Conflict):
        store.commit(n + 1, {"tables": {}})
    assert sorted(x for x in os.listdir(f"{store.root}/manifest") if not x.endswith(".crc")) == [f"{i:012d}.json" for i in range(1, n + 2)]
    store.root = "/proc/nowhere"  # an error that is no conflict is not taken for one
    with pytest.raises(Exception) as e:
        store.commit(n + 2, {"tables": {}})
    assert not isinstance(e.value, Conflict)


def test_snapshots_versions_and_vacuum(db, spark):
    first = db.storage.latest()
    db.execute("UPDATE parcels SET kilos = 9 WHERE code = 10")
    middle = db.storage.latest()
    db.execute("DELETE FROM parcels WHERE code = 20")
    db.write("parcels", spark.createDataFrame([(10, "lyon", 7.0, False, 1)], "code long, town string, kilos double, fragile boolean, shelf long"))
    kilos = lambda d: dict(rows(d.execute("SELECT code, kilos FROM parcels WHERE code <= 20")))
    assert [kilos(db.snapshot(n)) for n in (first, middle, None)] == [{10: 2.5, 20: 8.0}, {10: 9.0, 20: 8.0}, {10: 7.0}]
    seen = db.versions("parcels").filter("code <= 20").select("code", "kilos", "_deleted", "_turn")
    assert sorted(rows(seen)) == [(10, 2.5, False, 1), (10, 7.0, False, 4), (10, 9.0, False, 2), (20, 8.0, False, 1), (20, 8.0, True, 3)]
    db.compact("parcels", middle)
    seen = db.versions("parcels").filter("code <= 20").select("code", "kilos", "_deleted", "_turn")
    assert sorted(rows(seen)) == [(10, 7.0, False, 2), (10, 9.0, False, 0), (20, 8.0, False, 0), (20, 8.0, True, 1)]
    assert kilos(db) == {10: 7.0}
    assert db.vacuum(keep=1, older_s=3600) == 0  # a running writer's files stay
    db.storage.write("orphan", spark.range(3))
    assert db.vacuum(keep=1, older_s=-1) >= 4 and kilos(db) == {10: 7.0}
    assert len(db.storage.numbers()) == 1


def test_catalog(db):
    db.execute("CREATE TABLE IF NOT EXISTS parcels (id BIGINT PRIMARY KEY)")
    db.execute("CREATE TABLE seals (k BIGINT PRIMARY KEY, v BLOB NOT NULL)")
    db.execute("INSERT INTO seals VALUES (1, ?)", [b"\x80\x00'\\\r\xfe"])
    assert bytes(rows(db.execute("SELECT v FROM seals"))[0][0]) == b"\x80\x00'\\\r\xfe"
    assert [r[0] for r in rows(db.execute("SHOW TABLES"))] == ["parcels", "seals"]
    db.execute("DROP TABLE seals")
    db.execute("DROP TABLE IF EXISTS seals")
    assert rows(db.execute("SELECT @@max_allowed_packet, @@socket LIMIT 1")) == [(67108864, "")]
