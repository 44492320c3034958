"""JSON documents as text, with deterministic paths: ``.a.b[0]``, ``$.a``, ``["a b"]``.

Reads of one value and all edits keep a document's own order of keys. Edits are Arrow-batched functions, since
Spark has no setter for JSON text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import CommandError

_STEP = re.compile(r"""\.?([^.\[\]"']+)|\[(-?\d+)\]|\[(?:"([^"]*)"|'([^']*)')\]""")


class _MISSING:
    """Stands for no value; a class, so that it stays itself in another process."""



def steps(path: str) -> list[str | int]:
    """A path's keys and indexes; ``.`` and ``$`` are the document itself."""
    rest = path[1:] if path.startswith("$") else path
    if rest in ("", "."):
        return []
    out, at = [], 0
    while at < len(rest):
        m = _STEP.match(rest, at)
        if not m or "*" in (m[1] or "") or rest[at : at + 2] == "..":
            raise CommandError(f"bad path {path!r}")
        out.append(int(m[2]) if m[2] is not None else next(g for g in (m[1], m[3], m[4]) if g is not None))
        at = m.end()
    return out


def find(doc: Any, path: list) -> Any:
    for s in path:
        if isinstance(s, int) and isinstance(doc, list) and -len(doc) <= s < len(doc):
            doc = doc[s]
        elif isinstance(s, str) and isinstance(doc, dict) and s in doc:
            doc = doc[s]
        else:
            return _MISSING
    return doc


def dump(v: Any) -> str:
    return json.dumps(v, separators=(",", ":"), ensure_ascii=False)


def type_name(v: Any) -> str:
    if v is None:
        return "null"
    for kind, name in ((bool, "boolean"), (dict, "object"), (list, "array"), (str, "string"), (int, "integer")):
        if isinstance(v, kind):
            return name
    return "number"


def put(doc: Any, path: list, value: Any) -> Any:
    """Sets a value, making objects on the way; an index equal to a list's length appends."""
    if not path:
        return value
    at = doc
    for n, s in enumerate(path):
        last = n == len(path) - 1
        if isinstance(s, int):
            if not isinstance(at, list) or not -len(at) <= s <= len(at):
                raise CommandError("index out of range")
            if s == len(at):
                at.append(value if last else {})
                at = at[-1]
                continue
        elif not isinstance(at, dict):
            raise CommandError("a key of something that is no object")
        elif not last and s not in at:
            at[s] = {}
        if last:
            at[s] = value
        else:
            at = at[s]
    return doc


def remove(doc: Any, path: list) -> tuple[Any, int]:
    if not path:
        return None, 1
    owner = find(doc, path[:-1])
    if owner is _MISSING or find(owner, path[-1:]) is _MISSING:
        return doc, 0
    del owner[path[-1]]
    return doc, 1


def _edit(change: Callable[[Any], Any]) -> Callable[[Column], Column]:
    """A column function of the document after ``change``; null stays null."""

    @F.pandas_udf("string")
    def run(docs: pd.Series) -> pd.Series:
        return docs.map(lambda d: None if d is None else dump(change(json.loads(d))))

    return run


def _value(at: Any, kind: type | tuple, name: str) -> Any:
    if at is _MISSING or not isinstance(at, kind) or isinstance(at, bool) and kind is not bool:
        raise CommandError(f"the path holds no {name}")
    return at


def json_set(doc: Column, path: str, value: Any) -> Column:
    p = steps(path)
    return _edit(lambda d: put(d, p, value))(doc)


def json_del(doc: Column, path: str) -> Column:
    """The document without the value; null when the root goes."""
    p = steps(path)
    if not p:
        return F.lit(None).cast("string")
    return _edit(lambda d: remove(d, p)[0])(doc)


def json_get(doc: Column, *paths: str) -> Column:
    """Without a path the text itself; one value's text; or the values of several paths as an array."""
    if not paths:
        return doc
    wanted = [steps(p) for p in paths]

    @F.pandas_udf("string")
    def run(docs: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            doc = json.loads(text)
            found = [find(doc, p) for p in wanted]
            if len(found) == 1:
                return None if found[0] is _MISSING else dump(found[0])
            return dump([None if f is _MISSING else f for f in found])

        return docs.map(one)

    return run(doc)


def json_type(doc: Column, path: str = ".") -> Column:
    p = steps(path)

    @F.pandas_udf("string")
    def run(docs: pd.Series) -> pd.Series:
        return docs.map(lambda d: None if d is None or (v := find(json.loads(d), p)) is _MISSING else type_name(v))

    return run(doc)


def _hadoop_path(path: str) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps(path))


def json_strlen(doc: Column, path: str = ".") -> Column:
    return F.octet_length(F.get_json_object(doc, _hadoop_path(path))).cast("long")


def json_arrlen(doc: Column, path: str = ".") -> Column:
    return F.json_array_length(F.get_json_object(doc, _hadoop_path(path))).cast("long")


def json_objkeys(doc: Column, path: str = ".") -> Column:
    return F.json_object_keys(F.get_json_object(doc, _hadoop_path(path)))


def json_objlen(doc: Column, path: str = ".") -> Column:
    keys = json_objkeys(doc, path)
    return F.when(keys.isNotNull(), F.size(keys)).cast("long")


def json_strappend(doc: Column, path: str, text: str) -> Column:
    p = steps(path)
    return _edit(lambda d: put(d, p, _value(find(d, p), str, "string") + text))(doc)


def added(old: Any, delta: float) -> Any:
    """Computed in double precision; whole results under 2^53 of two integers stay integers."""
    total = float(old) + float(delta)
    if total != total or total in (float("inf"), float("-inf")):
        raise CommandError("the result is not a finite number")
    return int(total) if isinstance(old, int) and isinstance(delta, int) and abs(total) < 1 << 53 else total


def json_numincrby(doc: Column, path: str, delta: float) -> Column:
    p = steps(path)
    return _edit(lambda d: put(d, p, added(_value(find(d, p), (int, float), "number"), delta)))(doc)


def json_arrappend(doc: Column, path: str, *values: Any) -> Column:
    p = steps(path)
    return _edit(lambda d: put(d, p, [*_value(find(d, p), list, "array"), *values]))(doc)


def json_arrinsert(doc: Column, path: str, index: int, *values: Any) -> Column:
    p = steps(path)

    def change(d: Any) -> Any:
        a = _value(find(d, p), list, "array")
        i = index + len(a) if index < 0 else index
        if not 0 <= i <= len(a):
            raise CommandError("index out of range")
        return put(d, p, [*a[:i], *values, *a[i:]])

    return _edit(change)(doc)


def json_arrpop(doc: Column, path: str = ".", index: int = -1) -> Column:
    """The document without one element."""
    p = steps(path)

    def change(d: Any) -> Any:
        a = _value(find(d, p), list, "array")
        if not -len(a) <= index < len(a):
            raise CommandError("index out of range")
        return put(d, p, [x for n, x in enumerate(a) if n != index % len(a)])

    return _edit(change)(doc)


def json_arrtrim(doc: Column, path: str, start: int, stop: int) -> Column:
    p = steps(path)

    def change(d: Any) -> Any:
        a = _value(find(d, p), list, "array")
        first = max(0, start + len(a)) if start < 0 else start
        return put(d, p, a[first : (stop + len(a) if stop < 0 else stop) + 1])

    return _edit(change)(doc)


def same(a: Any, b: Any) -> bool:
    """Equality of JSON values, where 1 and 1.0 and true are three values."""
    return type(a) is type(b) and dump(a) == dump(b)


def json_arrindex(doc: Column, path: str, value: Any, start: int = 0, stop: int = -1) -> Column:
    """First place of an equal element in [start, stop), -1 if none; a stop of -1 is the end."""
    p = steps(path)

    @F.pandas_udf("long")
    def run(docs: pd.Series) -> pd.Series:
        def one(text: str | None) -> int | None:
            a = _MISSING if text is None else find(json.loads(text), p)
            if a is _MISSING:
                return None
            _value(a, list, "array")
            first = max(0, start + len(a)) if start < 0 else start
            end = len(a) if stop == -1 else stop + len(a) if stop < 0 else min(stop, len(a))
            return next((i for i in range(first, end) if same(a[i], value)), -1)

        return docs.map(one).astype("Int64")

    return run(doc)
