"""SQLite files, read-only: an authorizer lets SELECT pass and nothing else."""

from __future__ import annotations

import sqlite3
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import SparkSession

from ..functions import types as ty
from ..operators.table import Table

_ALLOWED = {sqlite3.SQLITE_SELECT, sqlite3.SQLITE_READ, sqlite3.SQLITE_FUNCTION, sqlite3.SQLITE_RECURSIVE}


def _connect(path: Path) -> sqlite3.Connection:
    c = sqlite3.connect(f"{path.as_uri()}?mode=ro", uri=True)
    c.execute("PRAGMA query_only = ON")
    return c


class SqliteProvider:
    """Queries one existing file by absolute path; the result's columns must be those of the given schema, in order."""

    def __init__(self, spark: SparkSession, path: str | Path):
        self._spark, self._path = spark, Path(path)
        if not self._path.is_absolute() or not self._path.is_file():
            raise ty.AdmissionError(f"not an absolute path of a file: {path}")
        try:
            with _connect(self._path) as c:
                if c.execute("PRAGMA quick_check").fetchone() != ("ok",):
                    raise ty.AdmissionError(f"{path} is damaged")
                names = [n for (n,) in c.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        except sqlite3.DatabaseError as e:
            raise ty.AdmissionError(f"{path} is no database: {e}") from e
        if not names:
            raise ty.AdmissionError(f"{path} has no relation")
        self.tables = tuple(names)

    def query(self, sql: str, columns: Mapping[str, object], params: Mapping[str, object] | None = None) -> Table:
        c = _connect(self._path)
        try:
            c.set_authorizer(lambda action, *_: sqlite3.SQLITE_OK if action in _ALLOWED else sqlite3.SQLITE_DENY)
            try:
                cursor = c.execute(sql, dict(params or {}))
            except (sqlite3.Error, sqlite3.Warning) as e:
                raise ty.AdmissionError(f"query refused: {e}") from e
            if cursor.description is None or [d[0] for d in cursor.description] != list(columns):
                raise ty.AdmissionError(f"columns {[d[0] for d in cursor.description or ()]} are not {list(columns)}")
            return Table.from_rows(self._spark, columns, (dict(zip(columns, r)) for r in cursor))
        finally:
            c.close()
