"""The registry of queries, fragments of SQL, and small literal tables that both engines read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that must give the same rows."""

    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def registered_sql() -> dict[str, str]:
    return dict(_SQL)


# --- SQL fragments ---------------------------------------------------------------------------------


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')"


def sql_norm(x: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({x}), '^\s+|\s+$', '', 'g'), '[-\s]', '_', 'g')"


def sql_any(x: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, '{w.lower().replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def sql_hits(x: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({x}, '{w.lower().replace(chr(39), chr(39) * 2)}')::int" for w in words) + ")"


def sql_uniform(seed: int, key: str) -> str:
    return f"('0x' || substr(md5('{seed}|' || {key}), 1, 8))::bigint / 4294967296.0"


def sql_text(value) -> str:
    """A value as a SQL literal."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(sql_text, value)) + "]"
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


class Rows:
    """A small literal table, the same for Spark and for SQL: a schema such as ``id bigint, name string`` and its rows."""

    _TYPES = {"string": "varchar", "array<string>": "varchar[]"}

    def __init__(self, schema: str, *rows: tuple) -> None:
        self.schema, self.rows = schema, rows
        self.columns = [c.split(None, 1) for c in schema.split(", ")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    @property
    def sql(self) -> str:
        values = ", ".join("(" + ", ".join(map(sql_text, r)) + ")" for r in self.rows)
        casts = ", ".join(f"cast({n} as {self._TYPES.get(t, t)}) as {n}" for n, t in self.columns)
        return f"(select {casts} from (values {values}) as t({', '.join(n for n, _ in self.columns)}))"
