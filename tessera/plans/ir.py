"""The statements and expressions that the parser makes."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Col:
    table: str | None
    name: str


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Param:
    pass


@dataclass(frozen=True)
class Binary:
    left: Any
    op: str
    right: Any


@dataclass(frozen=True)
class Not:
    expr: Any


@dataclass(frozen=True)
class Neg:
    expr: Any


@dataclass(frozen=True)
class IsNull:
    expr: Any
    negated: bool


@dataclass(frozen=True)
class InList:
    expr: Any
    items: tuple
    negated: bool


@dataclass(frozen=True)
class Between:
    expr: Any
    low: Any
    high: Any
    negated: bool


@dataclass(frozen=True)
class Like:
    expr: Any
    pattern: Any
    negated: bool


@dataclass(frozen=True)
class Func:
    name: str
    args: tuple


@dataclass(frozen=True)
class Agg:
    name: str
    arg: Any  # None for COUNT(*)
    distinct: bool = False


@dataclass
class Item:
    expr: Any  # None for *
    alias: str | None = None


@dataclass
class Table:
    name: str
    alias: str | None = None


@dataclass
class Join:
    left: Any
    right: Any
    on: Any  # None for a cross product


@dataclass
class Select:
    items: list
    source: Any
    where: Any = None
    group: list = field(default_factory=list)
    having: Any = None
    order: list = field(default_factory=list)  # (expr, ascending)
    limit: int | None = None
    offset: int = 0
    distinct: bool = False


@dataclass
class ColumnDef:
    name: str
    type: str  # bool, bigint, double, varchar, blob
    nullable: bool = True
    primary: bool = False


@dataclass
class Command:
    """Everything but SELECT: a kind with its arguments."""

    kind: str
    args: dict
