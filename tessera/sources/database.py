"""A database session: statements in, DataFrames out, with snapshot transactions over versioned tables."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import SqlError, unsupported
from tessera.plans import ir
from tessera.plans.lower import VERSION, Known, Lowering, Scope, Source, family, select, truthy
from tessera.plans.parser import parse
from tessera.plans.render import plan_lines, source_text
from tessera.sources.storage import DELETED, MOST_DELTAS, Conflict, Storage

_SPARK = {"bool": T.BooleanType(), "bigint": T.LongType(), "double": T.DoubleType(), "varchar": T.StringType(), "blob": T.BinaryType()}
_SQL = {"bool": "bool", "int": "bigint", "double": "double", "str": "varchar", "bytes": "blob"}
#: Index lookups of more keys than this scan instead.
MOST_KEYS = 1000
#: How often a change outside a transaction runs where others keep writing its keys.
ATTEMPTS = 20

#: What clients ask a server for when they connect.
VARIABLES = {
    "max_allowed_packet": 67108864, "wait_timeout": 28800, "interactive_timeout": 28800, "net_read_timeout": 30, "net_write_timeout": 60,
    "socket": "", "version": VERSION, "version_comment": "tessera", "autocommit": 1, "sql_mode": "", "time_zone": "SYSTEM", "lower_case_table_names": 1,
    "character_set_client": "utf8mb4", "character_set_connection": "utf8mb4", "character_set_results": "utf8mb4", "transaction_isolation": "READ-COMMITTED", "tx_isolation": "READ-COMMITTED",
}


def constant(e: Any) -> Any:
    """The value of an expression without columns, as INSERT takes it."""
    if isinstance(e, ir.Lit):
        return e.value
    if isinstance(e, ir.Neg):
        v = constant(e.expr)
        return None if v is None else -v
    if isinstance(e, ir.Binary) and e.op in "+-*/%":
        a, b = constant(e.left), constant(e.right)
        if a is None or b is None:
            return None
        if isinstance(a, bool) or isinstance(b, bool) or isinstance(a, str) or isinstance(b, str):
            raise SqlError("unknown", "arithmetic takes numbers")
        if e.op in "/%" and b == 0:
            return None
        if isinstance(a, int) and isinstance(b, int):
            whole = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1) if e.op in "/%" else 0
            v = {"+": a + b, "-": a - b, "*": a * b, "/": whole, "%": a - b * whole if e.op == "%" else 0}[e.op]
            return (v + (1 << 63)) % (1 << 64) - (1 << 63)
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: math.fmod(a, b)}[e.op]()
    raise unsupported("INSERT values other than constants")


def coerce(v: Any, kind: str, column: str) -> Any:
    """A value on its way into a column."""
    if v is None:
        return None
    match kind, v:
        case "bool", bool():
            return v
        case "bool", int():
            return v != 0
        case "bigint", bool() | int():
            return int(v)
        case "double", float():
            return v
        case "double", int() if not isinstance(v, bool):
            return float(v)
        case "varchar", str():
            return v
        case "varchar", bytes() | bytearray():
            return bytes(v).decode()
        case "blob", bytes() | bytearray():
            return bytearray(v)
        case "blob", str():
            return bytearray(v.encode())
    raise SqlError("unknown", f"a {type(v).__name__} does not fit column '{column}' of type {kind}")


def coerced(c: Column, kind: str, to: str, column: str) -> Column:
    """The same for an expression."""
    if kind == "null":
        return c.cast(_SPARK[to])
    have = _SQL.get(kind)
    if have != to and (have, to) not in (("bool", "bigint"), ("bigint", "double"), ("bigint", "bool"), ("varchar", "blob"), ("blob", "varchar")):
        raise SqlError("unknown", f"a {have} does not fit column '{column}' of type {to}")
    return c.cast(_SPARK[to])


class Database:
    """``execute`` takes a statement and gives a DataFrame.

    Parquet tables from elsewhere are read with ``register`` and stay read-only; tables of CREATE TABLE live
    under ``root``. The session runs with ANSI mode off, so integers wrap as the dialect asks.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, name: str = "test"):
        self.spark = spark.newSession()
        self.spark.conf.set("spark.sql.ansi.enabled", "false")
        self.storage = Storage(self.spark, root) if root else None
        self.name, self.outside, self.txn = name, {}, None

    # catalog
    def register(self, name: str, path: str, key: str | None = None) -> None:
        """A Parquet table by path, with the column that orders it."""
        self.outside[name.lower()] = (name, path, key)

    def _manifest(self) -> tuple[int, dict]:
        if self.storage is None:
            return 0, {"tables": {}}
        n = self.storage.latest() if self.txn is None else self.txn["at"]  # a transaction's snapshot stays
        return n, self.storage.manifest(n)

    def _entry(self, name: str, manifest: dict | None = None) -> dict:
        entry = (manifest or self._manifest()[1])["tables"].get(name.lower())
        if entry is None:
            if name.lower() in self.outside:
                raise SqlError("access_denied", f"table '{name}' is read-only")
            raise SqlError("no_such_table", f"table '{name}' doesn't exist")
        return entry

    @staticmethod
    def _schema(entry: dict) -> T.StructType:
        return T.StructType([T.StructField(c["name"], _SPARK[c["type"]]) for c in entry["columns"]])

    def _rows(self, entry: dict, name: str) -> DataFrame:
        staged = self.txn["staged"].get(name.lower(), []) if self.txn else []
        return self.storage.read({"base": entry["base"], "deltas": [*entry["deltas"], *staged]}, self._schema(entry), entry["key"])

    def _lookup(self, name: str) -> Source:
        if name.lower() in self.outside:
            _, path, key = self.outside[name.lower()]
            return Source(self.spark.read.parquet(path), key)
        entry = self._entry(name)
        return Source(self._rows(entry, name), entry["key"])

    def _small(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    # statements
    def execute(self, sql: str, params: list | None = None) -> DataFrame:
        return self._run(parse(sql, params))

    def _run(self, s: Any) -> DataFrame:
        if isinstance(s, ir.Select):
            return select(s, self._reader(s))
        do = getattr(self, f"_do_{s.kind}")
        return self._alone(lambda: do(**s.args)) if s.kind in ("insert", "update", "delete") else do(**s.args)

    def _alone(self, change: Callable[[], Any]) -> Any:
        """A change outside a transaction is one by itself: it reads one snapshot, and if another session has
        written one of its keys meanwhile, it runs again on what is there then."""
        if self.txn is not None or self.storage is None:
            return change()
        for n in range(ATTEMPTS):
            self._do_begin()
            try:
                done = change()
                self._do_commit()
                return done
            except SqlError as e:
                if e.kind != "write_conflict" or n == ATTEMPTS - 1:
                    raise
            finally:
                self.txn = None

    # beyond SQL: tables as DataFrames
    def write(self, table: str, df: DataFrame) -> None:
        """The rows of ``df`` in place of those of equal key; where a boolean column ``_deleted`` is true, the
        key's row goes. ``df`` has the table's columns, one row a key."""
        entry = self._entry(table)
        rows = df if DELETED in df.columns else df.withColumn(DELETED, F.lit(False))
        rows = rows.select(*[F.col(c["name"]).cast(_SPARK[c["type"]]) for c in entry["columns"]], DELETED)
        self._alone(lambda: self._change(table, self._entry(table), rows, rows.select(entry["key"])))

    def _change(self, table: str, entry: dict, delta: DataFrame, replaced: DataFrame) -> None:
        self._unique(table, entry, delta.filter(~F.col(DELETED)), replaced)
        self._stage(table, entry, delta)

    def snapshot(self, number: int | None = None) -> Database:
        """A session that reads the tables as commit ``number`` left them (the latest without one)."""
        other = Database(self.spark, self.storage.root, self.name)
        other.outside, other.txn = dict(self.outside), {"at": self.storage.latest() if number is None else number, "staged": {}}
        return other

    def versions(self, table: str) -> DataFrame:
        """Every stored version of the table's rows, with ``_deleted`` and ``_turn``, the order of commits."""
        entry = self._entry(table)
        return self.storage.versions(entry, self._schema(entry))

    def repeated(self, table: str, column: str) -> DataFrame:
        """``column, n`` for the values that forbid a unique index on it."""
        rows = self._rows(self._entry(table), table)
        return rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")

    def compact(self, table: str, number: int) -> None:
        """Folds what commit ``number`` saw of the table into a new base: older versions and tombstones go from
        the newest manifest, later versions stay as they are."""

        def change(m: dict) -> bool | None:
            entry, then = self._entry(table, m), self._entry(table, self.storage.manifest(number))
            n = len(then["deltas"])
            if (then["id"], then["base"], then["deltas"]) != (entry["id"], entry["base"], entry["deltas"][:n]) or not n:
                return False  # folded since
            self._fold(entry, self.storage.read(then, self._schema(entry), entry["key"]))
            entry["deltas"] = entry["deltas"][n:]

        self._define(change)

    def vacuum(self, keep: int = 10, older_s: float = 86_400) -> int:
        """Deletes what only commits before the newest ``keep`` can see, and what writers left behind over
        ``older_s`` ago; sessions that still read older snapshots lose them."""
        return self.storage.vacuum(keep, older_s)

    def _affected(self, n: int) -> DataFrame:
        return self._small([(n,)], "affected long")

    def _do_variables(self, names: list[str]) -> DataFrame:
        for n in names:
            if n not in VARIABLES:
                raise SqlError("unknown", f"Unknown system variable '{n}'")
        schema = T.StructType([T.StructField(n, T.LongType() if isinstance(VARIABLES[n], int) else T.StringType()) for n in names])
        return self.spark.createDataFrame([tuple(VARIABLES[n] for n in names)], schema)

    def _do_use(self, database: str) -> DataFrame:
        self.name = database
        return self._affected(0)

    def _do_set(self) -> DataFrame:
        return self._affected(0)

    def _do_show_tables(self) -> DataFrame:
        names = sorted([e["name"] for e in self._manifest()[1]["tables"].values()] + [v[0] for v in self.outside.values()])
        return self._small([(n,) for n in names], f"`Tables_in_{self.name}` string")

    def _described(self, table: str) -> tuple[str, list[tuple[str, str, bool]], str | None, list[dict]]:
        if table.lower() in self.outside:
            name, path, key = self.outside[table.lower()]
            fields = self.spark.read.parquet(path).schema
            return name, [(f.name, _SQL.get(family(f.dataType), f.dataType.simpleString()), f.name != key) for f in fields], key, []
        e = self._entry(table)
        return e["name"], [(c["name"], c["type"], c["nullable"]) for c in e["columns"]], e["key"], e["indexes"]

    def _do_show_columns(self, table: str) -> DataFrame:
        _, columns, key, indexes = self._described(table)
        by = {}
        for i in reversed(indexes):
            by[i["column"].lower()] = "UNI" if i["unique"] else "MUL"
        rows = [(n, t, "YES" if nullable else "NO", "PRI" if key and n.lower() == key.lower() else by.get(n.lower(), ""), "NULL", "") for n, t, nullable in columns]
        return self._small(rows, "Field string, Type string, `Null` string, `Key` string, `Default` string, Extra string")

    def _do_show_index(self, table: str) -> DataFrame:
        """``Non_unique`` of a secondary index is 1 where it is unique, as clients of the dialect get it."""
        name, _, key, indexes = self._described(table)
        rows = [(name, 0, "PRIMARY", 1, key, "BTREE")] if key else []
        rows += [(name, int(i["unique"]), i["name"], 1, i["column"], "BTREE") for i in indexes]
        return self._small(rows, "Table string, Non_unique long, Key_name string, Seq_in_index long, Column_name string, Index_type string")

    def _do_explain(self, statement: Any) -> DataFrame:
        if isinstance(statement, ir.Select):
            select(statement, self._lookup)  # names and types are checked
            lines = plan_lines(statement, self._access(statement))
        else:
            lines = [f"Direct execution ({statement.kind})"]
        return self._small([(x,) for x in lines], "plan string")

    def _access(self, q: ir.Select) -> str | None:
        """The line of an index lookup, if the first usable conjunct is narrow enough."""
        if not isinstance(q.source, ir.Table) or q.source.name.lower() in self.outside:
            return None
        entry = self._entry(q.source.name)
        for c, p in self._conjuncts(q.where):
            index = self._index(entry, c)
            if index is not None:
                df = self._rows(self._narrow(entry, q.where), q.source.name)
                n = df.filter(self._low(entry).condition(p)).limit(MOST_KEYS + 1).count()
                return f"IndexScan {index['name']} on {source_text(q.source)} -> {n} pks" if n <= MOST_KEYS else None
        return None

    # indexes
    @staticmethod
    def _conjuncts(where: Any) -> list[tuple[str, Any]]:
        """The conjuncts that compare a column with constants (=, IN, BETWEEN), each with the column's name."""
        parts = [] if where is None else [where]
        while any(isinstance(p, ir.Binary) and p.op == "AND" for p in parts):
            parts = [x for p in parts for x in ([p.left, p.right] if isinstance(p, ir.Binary) and p.op == "AND" else [p])]
        out = []
        for p in parts:
            match p:
                case ir.Binary(ir.Col() as c, "=", ir.Lit()) | ir.Binary(ir.Lit(), "=", ir.Col() as c):
                    out.append((c.name.lower(), p))
                case ir.InList(ir.Col() as c, items, False) if all(isinstance(i, ir.Lit) for i in items):
                    out.append((c.name.lower(), p))
                case ir.Between(ir.Col() as c, ir.Lit(), ir.Lit(), False):
                    out.append((c.name.lower(), p))
        return out

    @staticmethod
    def _index(entry: dict, column: str) -> dict | None:
        return next((i for i in entry["indexes"] if i["column"].lower() == column), None)

    def _narrow(self, entry: dict, where: Any) -> dict:
        """The entry with that base in which WHERE's rows lie together: the base itself, which is in the key's
        order, or the copy that an index keeps in the order of its column. The scan gets the filter, and skips
        files and row groups by it; the deltas, which are few, are read whole."""
        columns = [c for c, _ in self._conjuncts(where)]
        if entry["key"].lower() not in columns:
            for c in columns:
                index = self._index(entry, c)
                if index is not None and "copy" in index:
                    return entry | {"base": index["copy"]}
        return entry

    def _reader(self, q: ir.Select) -> Callable[[str], Source]:
        """How the tables of a query are looked up; that of a query of one table by its indexes."""
        if not isinstance(q.source, ir.Table) or q.source.name.lower() in self.outside:
            return self._lookup

        def look(name: str) -> Source:
            entry = self._entry(name)
            return Source(self._rows(self._narrow(entry, q.where), name), entry["key"])

        return look

    def _copy(self, entry: dict, column: str) -> str:
        return self.storage.write(entry["id"], self.spark.read.schema(self._schema(entry)).parquet(entry["base"]), column)

    def _fold(self, entry: dict, rows: DataFrame) -> None:
        """These rows as the entry's new base, and the copies of its indexes."""
        entry["base"] = self.storage.write(entry["id"], rows, entry["key"])
        for i in entry["indexes"]:
            i["copy"] = self._copy(entry, i["column"])

    # transactions
    def _do_begin(self) -> DataFrame:
        if self.txn is not None:
            self._do_commit()
        self.txn = {"at": self.storage.latest() if self.storage else 0, "staged": {}}
        return self._affected(0)

    def _do_rollback(self) -> DataFrame:
        self.txn = None
        return self._affected(0)

    def _do_commit(self) -> DataFrame:
        """First committer wins: a key that another session has written since BEGIN is a conflict."""
        if self.txn is None:
            return self._affected(0)
        txn, self.txn = self.txn, None
        if txn["staged"]:
            self._publish(txn["staged"], txn["at"])
        return self._affected(0)

    def _publish(self, staged: dict[str, list[str]], since: int) -> None:
        """Adds the deltas to the newest manifest, checked against what others have committed since."""
        was = self.storage.manifest(since)["tables"]
        while True:
            n, manifest = self._manifest()
            for name, paths in staged.items():
                entry, then = self._entry(name, manifest), was[name]
                if then["id"] != entry["id"]:
                    raise SqlError("write_conflict", f"table '{name}' has been made anew; try again")
                moved = (then["base"], then["deltas"]) != (entry["base"], entry["deltas"])
                if moved:
                    self._conflicts(entry, then, paths)
                entry["deltas"] += paths
                if moved or then["indexes"] != entry["indexes"]:
                    self._still_unique(entry, paths)
                if len(entry["deltas"]) > MOST_DELTAS:
                    self._fold(entry, self.storage.read(entry, self._schema(entry), entry["key"]))
                    entry["deltas"] = []
            try:
                return self.storage.commit(n + 1, manifest)
            except Conflict:
                continue

    def _still_unique(self, entry: dict, mine: list[str]) -> None:
        """The rows that these deltas bring share no value of a unique index with any other row as it is now."""
        rows = self.storage.read(entry, self._schema(entry), entry["key"])
        keys = self.storage.deltas(mine, self._schema(entry).add(DELETED, "boolean")).select(entry["key"]).distinct()
        for i in entry["indexes"]:
            if i["unique"]:
                c = i["column"]
                new = rows.join(keys, entry["key"], "left_semi").filter(F.col(c).isNotNull()).select(c)
                if rows.join(new.distinct(), c, "left_semi").groupBy(c).count().filter("count > 1").limit(1).count():
                    raise SqlError("dup_entry", f"duplicate entry for index '{i['name']}'")

    def _conflicts(self, entry: dict, was: dict, mine: list[str]) -> None:
        full = self._schema(entry).add(DELETED, "boolean")
        theirs = [p for p in entry["deltas"] if p not in was["deltas"]]
        key = entry["key"]
        if was["base"] != entry["base"]:  # folded meanwhile: any difference between then and now counts
            schema = self._schema(entry)
            then, now = self.storage.read(was, schema, key), self.storage.read(entry, schema, key)
            changed = then.exceptAll(now).select(key).unionAll(now.exceptAll(then).select(key))
        else:
            changed = self.storage.deltas(theirs, full).select(key)
        if self.storage.deltas(mine, full).join(changed.distinct(), key, "left_semi").limit(1).count():
            raise SqlError("write_conflict", "another transaction has written a key of this one; try again")

    # definitions
    def _define(self, change) -> DataFrame:
        if self.storage is None:
            raise SqlError("access_denied", "this database has no folder of its own")
        if self.txn is not None:
            raise SqlError("txn_ddl", "definitions are not allowed inside a transaction")
        while True:
            n, manifest = self._manifest()
            if change(manifest) is False:
                return self._affected(0)
            try:
                self.storage.commit(n + 1, manifest)
                return self._affected(0)
            except Conflict:
                continue

    def _do_create_table(self, table: str, columns: list[ir.ColumnDef], if_not_exists: bool) -> DataFrame:
        def change(m: dict) -> bool | None:
            if table.lower() in m["tables"] or table.lower() in self.outside:
                if if_not_exists:
                    return False
                raise SqlError("table_exists", f"table '{table}' already exists")
            if len({c.name.lower() for c in columns}) < len(columns):
                raise SqlError("parse", "a column name repeats")
            entry = {"name": table, "id": uuid.uuid4().hex, "key": next(c.name for c in columns if c.primary), "columns": [{"name": c.name, "type": c.type, "nullable": c.nullable} for c in columns], "indexes": [], "deltas": []}
            entry["base"] = self.storage.write(entry["id"], self.spark.createDataFrame([], self._schema(entry)))
            m["tables"][table.lower()] = entry

        return self._define(change)

    def _do_drop_table(self, table: str, if_exists: bool) -> DataFrame:
        def change(m: dict) -> bool | None:
            if m["tables"].pop(table.lower(), None) is None:
                if if_exists:
                    return False
                raise SqlError("no_such_table", f"table '{table}' doesn't exist")

        return self._define(change)

    def _do_create_index(self, name: str, table: str, column: str, unique: bool) -> DataFrame:
        def change(m: dict) -> None:
            entry = self._entry(table, m)
            own = next((c["name"] for c in entry["columns"] if c["name"].lower() == column.lower()), None)
            if own is None:
                raise SqlError("bad_field", f"unknown column '{column}'")
            if any(i["name"].lower() == name.lower() for i in entry["indexes"]):
                raise SqlError("dup_entry", f"index '{name}' already exists")
            if unique:
                if self.repeated(table, own).limit(1).count():
                    raise SqlError("dup_entry", f"duplicate values in '{column}'")
            entry["indexes"].append({"name": name, "column": own, "unique": unique, "copy": self._copy(entry, own)})

        return self._define(change)

    def _do_drop_index(self, name: str, table: str, if_exists: bool) -> DataFrame:
        def change(m: dict) -> bool | None:
            entry = self._entry(table, m)
            kept = [i for i in entry["indexes"] if i["name"].lower() != name.lower()]
            if len(kept) == len(entry["indexes"]):
                if if_exists:
                    return False
                raise SqlError("unknown", f"index '{name}' doesn't exist")
            entry["indexes"] = kept

        return self._define(change)

    # changes
    def _stage(self, table: str, entry: dict, delta: DataFrame) -> None:
        path = self.storage.write(entry["id"], delta.select(*[c["name"] for c in entry["columns"]], DELETED))
        self.txn["staged"].setdefault(table.lower(), []).append(path)

    def _unique(self, table: str, entry: dict, new: DataFrame, replaced: DataFrame) -> None:
        """No two rows share a value of a unique index: first among the new rows, then against the rows that
        stay. NULLs never clash."""
        for i in entry["indexes"]:
            if i["unique"]:
                c = i["column"]
                values = new.filter(F.col(c).isNotNull())
                rest = self._rows(entry, table).join(replaced, entry["key"], "left_anti")
                if values.groupBy(c).count().filter("count > 1").limit(1).count() or rest.join(values.select(c), c, "left_semi").limit(1).count():
                    raise SqlError("dup_entry", f"duplicate entry for index '{i['name']}'")

    def _do_insert(self, table: str, columns: list[str] | None, rows: list[list]) -> DataFrame:
        """An upsert: a key that exists is replaced, and of one statement's equal keys the last stays."""
        entry = self._entry(table)
        own = {c["name"].lower(): n for n, c in enumerate(entry["columns"])}
        places = list(range(len(own))) if columns is None else []
        for c in columns or []:
            if c.lower() not in own:
                raise SqlError("bad_field", f"unknown column '{c}'")
            places.append(own[c.lower()])
        made: dict[Any, tuple] = {}
        key = own[entry["key"].lower()]
        for row in rows:
            if len(row) != len(places):
                raise SqlError("wrong_value_count", "the number of values differs from the number of columns")
            values: list = [None] * len(own)
            for at, e in zip(places, row):
                values[at] = coerce(constant(e), entry["columns"][at]["type"], entry["columns"][at]["name"])
            for c, v in zip(entry["columns"], values):
                if v is None and not c["nullable"]:
                    raise SqlError("bad_null", f"column '{c['name']}' cannot be null")
            k = bytes(values[key]) if isinstance(values[key], bytearray) else values[key]
            made.pop(k, None)
            made[k] = (*values, False)
        delta = self.spark.createDataFrame(list(made.values()), self._schema(entry).add(DELETED, "boolean"))
        self._change(table, entry, delta, delta.select(entry["key"]))
        return self._affected(len(rows))

    def _low(self, entry: dict) -> Lowering:
        return Lowering(Scope([Known(entry["name"], entry["name"], c["name"], c["name"], family(_SPARK[c["type"]])) for c in entry["columns"]]))

    def _matched(self, table: str, entry: dict, where: Any, order: list, limit: int | None) -> DataFrame:
        low = self._low(entry)
        df = self._rows(self._narrow(entry, where), table)
        if where is not None:
            low.check(where)
            df = df.filter(truthy(*low.expr(where)))
        if limit is not None:
            by = [low.expr(e)[0] for e, _ in order]
            df = df.orderBy(*[c.asc_nulls_first() if up else c.desc_nulls_last() for c, (_, up) in zip(by, order)], entry["key"]).limit(limit)
        return df

    def _do_update(self, table: str, sets: list, where: Any, order: list, limit: int | None) -> DataFrame:
        """Every SET sees the old row; rows that stay as they are do not count; a changed key moves the row."""
        entry = self._entry(table)
        low, new = self._low(entry), {}
        kinds = {c["name"].lower(): c for c in entry["columns"]}
        for column, e in sets:
            c = kinds.get(column.lower())
            if c is None:
                raise SqlError("bad_field", f"unknown column '{column}'")
            low.check(e)
            new[c["name"]] = coerced(*low.expr(e), c["type"], c["name"])
        names = [c["name"] for c in entry["columns"]]
        old = self._matched(table, entry, where, order, limit).select(*names, *[c.alias(f"_new_{n}") for n, c in new.items()])
        differs = None
        for n in new:
            d = ~F.col(n).eqNullSafe(F.col(f"_new_{n}"))
            differs = d if differs is None else differs | d
        old = old.filter(differs).persist()
        try:
            count = old.count()
            if count:
                for c in entry["columns"]:
                    if c["name"] in new and not c["nullable"] and old.filter(F.col(f"_new_{c['name']}").isNull()).limit(1).count():
                        raise SqlError("bad_null", f"column '{c['name']}' cannot be null")
                rows = old.select(*[(F.col(f"_new_{n}") if n in new else F.col(n)).alias(n) for n in names])
                self._unique(table, entry, rows, old.select(entry["key"]))
                delta = rows.withColumn(DELETED, F.lit(False))
                if entry["key"] in new:
                    gone = old.select(*names).join(rows.select(entry["key"]), entry["key"], "left_anti")
                    delta = delta.unionByName(gone.withColumn(DELETED, F.lit(True)))
                self._stage(table, entry, delta)
        finally:
            old.unpersist()
        return self._affected(count)

    def _do_delete(self, table: str, where: Any, order: list, limit: int | None) -> DataFrame:
        entry = self._entry(table)
        gone = self._matched(table, entry, where, order, limit).withColumn(DELETED, F.lit(True)).persist()
        try:
            count = gone.count()
            if count:
                self._stage(table, entry, gone)
        finally:
            gone.unpersist()
        return self._affected(count)
