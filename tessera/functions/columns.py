"""Column functions that several operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 16384


def live(expire_ms: Column, now_ms: int) -> Column:
    """A row lives while it has no deadline (0) or one after ``now_ms``."""
    return (expire_ms == 0) | (expire_ms > F.lit(now_ms))


def ttl_seconds(expire_ms: Column, now_ms: int) -> Column:
    """Remaining seconds, halves up; -1 without a deadline. A missing key is -2, which a join must add."""
    return F.when(expire_ms == 0, F.lit(-1).cast("long")).otherwise(F.floor((expire_ms - F.lit(now_ms) + 500) / 1000).cast("long"))


def glob_regex(glob: str) -> str:
    """``*``, ``?``, ``[a-z]``, ``[^a]`` and ``\\`` as an anchored regular expression."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("(?s:.*)")
        elif c == "?":
            out.append("(?s:.)")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        elif c == "[" and (end := glob.find("]", i + 1)) > 0:
            body = glob[i + 1 : end]
            negated = body[:1] in ("^", "!")
            out.append("[" + "^" * negated + body[negated:].replace("\\", "\\\\").replace("[", "\\[") + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def hash_tag(key: Column) -> Column:
    """What of a key decides its slot: the text in the first braces, if there is any, else all of it."""
    tag = F.regexp_extract(key, r"^[^{]*\{([^}]+)\}", 1)
    return F.when(F.length(tag) > 0, tag).otherwise(key)


def _crc16_table() -> list[int]:
    table = []
    for n in range(256):
        c = n << 8
        for _ in range(8):
            c = (c << 1 ^ 0x1021 if c & 0x8000 else c << 1) & 0xFFFF
        table.append(c)
    return table


def crc16(text: Column) -> Column:
    """CRC-16/XMODEM of the UTF-8 bytes, inside Spark: a fold over the bytes with the table as a literal."""
    table = F.array(*[F.lit(x) for x in _crc16_table()])
    digits = F.hex(text.cast("binary"))
    count = (F.length(digits) / 2).cast("int")
    bytes_ = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))

    def step(c: Column, b: Column) -> Column:
        at = F.shiftright(c, 8).bitwiseXOR(b).bitwiseAND(F.lit(255))
        return F.shiftleft(c, 8).bitwiseXOR(F.element_at(table, at + 1)).bitwiseAND(F.lit(0xFFFF))

    return F.aggregate(bytes_, F.lit(0), step)


def slot(key: Column) -> Column:
    return crc16(hash_tag(key)) % SLOTS


def score_order(score: Column) -> list[Column]:
    """Sort keys that put -0.0 before 0.0; Spark alone takes them for equal."""
    negative = F.when((score == 0) & F.startswith(score.cast("string"), F.lit("-")), 0).otherwise(1)
    return [score, negative]


def number_text(c: Column) -> Column:
    """A double as its shortest digits, plainly: no exponent, and no point where it is whole."""
    text = c.cast("string")
    sign, mantissa, exponent = (F.regexp_extract(text, r"^(-?)([0-9.]+)(?:E(-?[0-9]+))?$", i) for i in (1, 2, 3))
    power = F.coalesce(exponent.try_cast("int"), F.lit(0))
    whole, part = F.substring_index(mantissa, ".", 1), F.regexp_replace(F.substring_index(mantissa, ".", -1), "0+$", "")
    digits, point = F.concat(whole, part), F.length(whole) + power
    padded = F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)).when(point >= F.length(digits), F.rpad(digits, point, "0")).otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits))))
    plain = F.regexp_replace(padded, r"^0+(?=[0-9])", "")
    return F.when((F.abs(c) == float("inf")) | F.isnan(c), text).when(c == 0, F.when(F.startswith(text, F.lit("-")), "-0").otherwise("0")).otherwise(F.concat(sign, plain))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with ``rows`` in place of the rows of equal keys."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows.select(*table.columns))


def last_of(rows: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """Of rows with equal keys the last in order: what a batch of writes leaves."""
    values = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*values), F.col(order)).alias("_v")
    return rows.groupBy(*keys).agg(last).select(*keys, "_v.*").select(*rows.columns)
