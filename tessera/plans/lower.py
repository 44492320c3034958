"""SELECT to a lazy DataFrame: names and types are checked here, Catalyst plans the rest.

The rules that differ from Spark's are rewrites of expressions: NOT of NULL is true, IN scans its items in
order, BETWEEN with a NULL is NULL, integer division truncates and division by zero is NULL, WHERE takes any
non-zero number, a bare column of a grouped query is that of the group's first row. Integer overflow wraps,
for which the session that runs the query has ANSI mode off.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import SqlError
from tessera.plans import ir
from tessera.plans.render import aggregates, children, text_of

VERSION = "8.0.0-tessera"


def family(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "int"
    if isinstance(t, T.FloatType | T.DoubleType | T.DecimalType):
        return "double"
    if isinstance(t, T.StringType | T.CharType | T.VarcharType):
        return "str"
    if isinstance(t, T.BinaryType):
        return "bytes"
    if isinstance(t, T.NullType):
        return "null"
    return "time" if isinstance(t, T.DateType | T.TimestampType | T.TimestampNTZType) else "other"


@dataclass
class Source:
    """A table as the catalog gives it: its rows and its primary key, if it has one."""

    df: DataFrame
    key: str | None


@dataclass
class Known:
    table: str
    alias: str
    name: str
    column: str  # in the DataFrame
    family: str


class Scope:
    def __init__(self, known: list[Known]):
        self.known = known

    def find(self, c: ir.Col) -> Known:
        hits = [k for k in self.known if k.name.lower() == c.name.lower() and (c.table is None or c.table.lower() in (k.alias.lower(), k.table.lower()))]
        if not hits:
            raise SqlError("bad_field", f"unknown column '{text_of(c)}'")
        if len(hits) > 1:
            raise SqlError("bad_field", f"column '{text_of(c)}' is ambiguous")
        return hits[0]


def truthy(c: Column, kind: str) -> Column:
    if kind == "bool":
        return c
    if kind in ("int", "double"):
        return c != 0
    if kind == "null":
        return F.lit(None).cast("boolean")
    raise SqlError("unknown", "a condition must be a boolean or a number")


_COMPARE = {"=": "__eq__", "<>": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


class Lowering:
    """Expressions over a scope; ``made`` maps what an aggregation has already computed."""

    def __init__(self, scope: Scope, made: dict | None = None):
        self.scope, self.made = scope, made

    def check(self, e: Any) -> None:
        """Every column exists and is unambiguous."""
        if isinstance(e, ir.Col):
            self.scope.find(e)
        for x in children(e):
            self.check(x)

    def condition(self, e: Any) -> Column:
        return truthy(*self.expr(e))

    def expr(self, e: Any) -> tuple[Column, str]:
        if self.made is not None and e in self.made:
            return self.made[e]
        match e:
            case ir.Col():
                k = self.scope.find(e)
                return F.col(k.column), k.family
            case ir.Lit(v):
                return self.literal(v)
            case ir.Binary(a, op, b):
                return self.binary(a, op, b)
            case ir.Not(x):
                return ~F.coalesce(self.condition(x), F.lit(False)), "bool"
            case ir.Neg(x):
                c, kind = self.expr(x)
                self.numeric(kind)
                return -c, kind
            case ir.IsNull(x, negated):
                c, _ = self.expr(x)
                return (c.isNotNull() if negated else c.isNull()), "bool"
            case ir.InList():
                return self.among(e), "bool"
            case ir.Between(x, low, high, negated):
                (c, k), (a, ka), (b, kb) = map(self.expr, (x, low, high))
                self.comparable(k, ka)
                self.comparable(k, kb)
                inside = (c >= a) & (c <= b)
                if not (isinstance(low, ir.Lit) and low.value is not None and isinstance(high, ir.Lit) and high.value is not None):
                    inside = F.when(c.isNull() | a.isNull() | b.isNull(), F.lit(None)).otherwise(inside)
                return (~inside if negated else inside), "bool"
            case ir.Like(x, pattern, negated):
                (c, k), (p, kp) = self.expr(x), self.expr(pattern)
                if k != "str" or kp != "str":
                    raise SqlError("unknown", "LIKE takes strings")
                found = c.like(pattern.value) if isinstance(pattern, ir.Lit) else F.call_function("like", c, p)
                return (~found if negated else found), "bool"
            case ir.Func(name, args):
                return self.function(name, args)
            case ir.Agg():
                raise SqlError("unknown", f"misplaced aggregate {text_of(e)}")
        raise SqlError("parse", f"no expression: {e!r}")

    @staticmethod
    def literal(v: Any) -> tuple[Column, str]:
        if v is None:
            return F.lit(None), "null"
        if isinstance(v, bool):
            return F.lit(v), "bool"
        if isinstance(v, int):
            return F.lit(v).cast("long"), "int"
        if isinstance(v, float):
            return F.lit(v), "double"
        if isinstance(v, bytes | bytearray):
            return F.lit(bytearray(v)), "bytes"
        if isinstance(v, str):
            return F.lit(v), "str"
        raise SqlError("not_supported", f"a parameter of type {type(v).__name__}")

    @staticmethod
    def numeric(*kinds: str) -> None:
        for k in kinds:
            if k not in ("int", "double", "null"):
                raise SqlError("unknown", "arithmetic takes numbers")

    @staticmethod
    def comparable(a: str, b: str) -> None:
        sets = ({"int", "double"}, {"str", "bytes"}, {"time", "str"})
        if a != b and "null" not in (a, b) and not any(a in s and b in s for s in sets):
            raise SqlError("unknown", f"values of different types: {a} and {b}")

    def binary(self, a: Any, op: str, b: Any) -> tuple[Column, str]:
        if op in ("AND", "OR"):
            x, y = self.condition(a), self.condition(b)
            return (x & y if op == "AND" else x | y), "bool"
        (x, kx), (y, ky) = self.expr(a), self.expr(b)
        if op in _COMPARE:
            self.comparable(kx, ky)
            if {kx, ky} == {"str", "bytes"}:
                x, y = x.cast("binary"), y.cast("binary")
            return getattr(x, _COMPARE[op])(y), "bool"
        self.numeric(kx, ky)
        if "null" in (kx, ky):
            return F.lit(None).cast("long" if op == "%" or "double" not in (kx, ky) else "double"), "double" if "double" in (kx, ky) else "int"
        kind = "int" if kx == ky == "int" else "double"
        x, y = (c.cast("long" if kind == "int" else "double") for c in (x, y))
        if op == "/":
            return F.when(y != 0, F.call_function("div", x, y) if kind == "int" else x / y), kind
        if op == "%":
            return F.when(y != 0, x % y), kind
        return {"+": x + y, "-": x - y, "*": x * y}[op], kind

    def among(self, e: ir.InList) -> Column:
        c, kind = self.expr(e.expr)
        items = [(i, *self.expr(i)) for i in e.items]
        for _, _, k in items:
            self.comparable(kind, k)
        if all(isinstance(i, ir.Lit) and i.value is not None for i, _, _ in items):
            found = c.isin([i.value for i, _, _ in items])  # reaches the scan as it is
        else:
            case = F.when(c.isNull(), F.lit(None).cast("boolean"))
            for _, item, _ in items:
                case = case.when(item.isNull(), F.lit(None).cast("boolean")).when(c == item, F.lit(True))
            found = case.otherwise(F.lit(False))
        return ~found if e.negated else found

    def function(self, name: str, args: tuple) -> tuple[Column, str]:
        if name == "version":
            return F.lit(VERSION), "str"
        c, kind = self.expr(args[0])
        if kind == "null":
            return F.lit(None).cast("long" if "length" in name or name == "abs" else "string"), "int" if "length" in name or name == "abs" else "str"
        if name == "abs":
            self.numeric(kind)
            return F.abs(c), kind
        if name in ("length", "char_length"):
            if kind not in ("str", "bytes"):
                raise SqlError("unknown", f"{name} takes a string")
            return F.length(c).cast("long"), "int"
        if kind != "str":
            raise SqlError("unknown", f"{name} takes a string")
        return (F.upper(c) if name == "upper" else F.lower(c)), "str"

    def aggregate(self, a: ir.Agg) -> tuple[Column, str]:
        if a.arg is None:
            return F.count(F.lit(1)), "int"
        if aggregates(a.arg):
            raise SqlError("unknown", "nested aggregates")
        c, kind = self.expr(a.arg)
        if a.name == "count":
            return (F.count_distinct(c) if a.distinct else F.count(c)), "int"
        if a.name in ("min", "max"):
            return (F.min(c) if a.name == "min" else F.max(c)), kind
        if kind not in ("int", "double"):
            zero = F.when(F.count(c) > 0, F.lit(0.0)) if a.name == "sum" else F.lit(None).cast("double")
            return zero, "double"
        if a.name == "sum":
            c = c.cast("long") if kind == "int" else c.cast("double")
            return (F.sum_distinct(c) if a.distinct else F.sum(c)), kind
        c = c.cast("double")
        return (F.sum_distinct(c) / F.count_distinct(c) if a.distinct else F.avg(c)), "double"


def source_of(t: Any, lookup, at: list[int]) -> tuple[DataFrame, list[Known], list[str]]:
    """The FROM clause: its rows, what is known of their columns, and the primary keys in scan order."""
    if isinstance(t, ir.Table):
        s: Source = lookup(t.name)
        n, at[0] = at[0], at[0] + 1
        known = [Known(t.name, t.alias or t.name, f.name, f"t{n}_{f.name}", family(f.dataType)) for f in s.df.schema]
        df = s.df.select(*[F.col(f"`{k.name}`").alias(k.column) for k in known])
        return df, known, [f"t{n}_{s.key}"] if s.key else []
    left, known, keys = source_of(t.left, lookup, at)
    right, more, others = source_of(t.right, lookup, at)
    scope = Scope(known + more)
    if t.on is None:
        return left.crossJoin(right), known + more, keys + others
    return left.join(right, Lowering(scope).condition(t.on), "inner"), known + more, keys + others


def select(q: ir.Select, lookup) -> DataFrame:
    """The query's rows as a DataFrame; ``lookup`` gives the ``Source`` of a table's name."""
    df, known, keys = source_of(q.source, lookup, [0])
    scope = Scope(known)
    low = Lowering(scope)
    items = [x for i in q.items for x in ([ir.Item(ir.Col(k.alias, k.name), k.name) for k in known] if i.expr is None else [i])]
    exact = {id(x): k for i in q.items if i.expr is None for x, k in zip([y for y in items if isinstance(y.expr, ir.Col)], known)} if any(i.expr is None for i in q.items) else {}
    order = [(e, up) for e, up in q.order if not isinstance(e, ir.Lit)]  # a constant orders nothing
    for e in [i.expr for i in items if id(i) not in exact] + [e for e, _ in order] + q.group + [x for x in (q.where, q.having) if x is not None]:
        low.check(e)
    if q.where is not None:
        if aggregates(q.where):
            raise SqlError("unknown", "an aggregate in WHERE")
        df = df.filter(low.condition(q.where))
    shown = [i.expr for i in items]
    found = list(dict.fromkeys(a for e in [*shown, *([q.having] if q.having is not None else []), *[e for e, _ in order]] for a in aggregates(e)))
    scan = F.struct(*[F.col(k) for k in keys]) if keys else None
    if found or q.group or q.having is not None:
        made, by, aggs = {}, [], []
        for n, e in enumerate(q.group):
            c, kind = low.expr(e)
            by.append(c.alias(f"g{n}"))
            made[e] = F.col(f"g{n}"), kind
        for n, a in enumerate(found):
            c, kind = low.aggregate(a)
            aggs.append(c.alias(f"a{n}"))
            made[a] = F.col(f"a{n}"), kind
        bare = dict.fromkeys(c for e in [*shown, *([q.having] if q.having is not None else []), *[e for e, _ in order]] for c in _bare(e, made))
        for n, c in enumerate(bare):
            k = scope.find(c)
            first = F.col(k.column) if scan is None else F.min_by(F.col(k.column), scan)
            aggs.append((F.first(first) if scan is None else first).alias(f"f{n}"))
            made[c] = F.col(f"f{n}"), k.family
        if scan is not None:
            aggs.append(F.min(scan).alias("_scan"))
        df = df.groupBy(*by).agg(*(aggs or [F.count(F.lit(1)).alias("_n")]))
        low = Grouped(scope, made)
        scan = F.col("_scan") if scan is not None else None
        if q.having is not None:
            df = df.filter(low.condition(q.having))
    outs = [F.col(exact[id(i)].column) if id(i) in exact and not isinstance(low, Grouped) else low.expr(i.expr)[0] for i in items]
    names = [i.alias or (i.expr.name if isinstance(i.expr, ir.Col) else text_of(i.expr)) for i in items]
    sorts = [low.expr(e)[0] for e, _ in order]
    ordered = bool(order) or q.limit is not None or q.offset > 0
    parts = [c.alias(f"o{n}") for n, c in enumerate(outs)] + [c.alias(f"s{n}") for n, c in enumerate(sorts)]
    if (q.distinct or ordered) and scan is not None:
        parts.append(scan.alias("_at"))
    df = df.select(*parts)
    if q.distinct:
        cols = [f"o{n}" for n in range(len(outs))]
        rest = [F.min_by(f"s{n}", "_at").alias(f"s{n}") if scan is not None else F.min(f"s{n}").alias(f"s{n}") for n in range(len(sorts))]
        rest += [F.min("_at").alias("_at")] if scan is not None else []
        df = df.groupBy(*cols).agg(*rest) if rest else df.distinct()
    if ordered:
        by = [F.col(f"s{n}").asc_nulls_first() if up else F.col(f"s{n}").desc_nulls_last() for n, (_, up) in enumerate(order)]
        by += [F.col("_at").asc()] if scan is not None else []
        df = df.orderBy(*by) if by else df
        df = df.offset(q.offset) if q.offset else df
        df = df.limit(q.limit) if q.limit is not None else df
    return df.select(*[f"o{n}" for n in range(len(outs))]).toDF(*names)


class Grouped(Lowering):
    """After grouping: functions of aggregates are an error, as aggregates stand in arithmetic alone."""

    def function(self, name: str, args: tuple) -> tuple[Column, str]:
        if any(aggregates(a) for a in args):
            raise SqlError("unknown", f"misplaced aggregate in {name.upper()}")
        return super().function(name, args)


def _bare(e: Any, made: dict) -> list[ir.Col]:
    """Columns that stand outside of aggregates and group keys."""
    if e in made or isinstance(e, ir.Agg):
        return []
    if isinstance(e, ir.Col):
        return [e]
    return [c for x in children(e) for c in _bare(x, made)]
