"""Errors by kind; a kind's code is the number that MySQL clients know."""

from __future__ import annotations

#: Kinds and the numbers of the MySQL protocol.
CODES = {
    "parse": 1064, "no_such_table": 1146, "table_exists": 1050, "bad_field": 1054, "dup_entry": 1062, "bad_null": 1048,
    "wrong_value_count": 1136, "not_supported": 1235, "access_denied": 1045, "write_conflict": 1213, "txn_ddl": 1235, "unknown": 1105,
}


class SqlError(Exception):
    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind, self.code = kind, CODES[kind]


def unsupported(what: str) -> SqlError:
    return SqlError("not_supported", f"not supported in this version: {what}")


class WrongType(Exception):
    """A key holds another kind of value than the operation works on."""


class CommandError(Exception):
    """An operation's arguments contradict each other or name what isn't there."""
