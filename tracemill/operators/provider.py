"""Reusable read-only SQL over named tables and at most one catalog; every query runs in a session of its own."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..functions import types as ty
from ..sources.catalog import NANOS, Catalog
from . import gate
from .table import Table

#: Settings of the caller's session that its query sessions inherit.
INHERITED = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.maxPartitionBytes")


def fresh_session(spark: SparkSession) -> SparkSession:
    out = spark.newSession()
    for key in INHERITED:
        if (value := spark.conf.get(key, None)) is not None:
            out.conf.set(key, value)
    out.conf.set("spark.sql.ansi.enabled", "true")
    out.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
    out.conf.set("spark.sql.runSQLOnFiles", "false")
    out.conf.set("spark.sql.cteRecursionLevelLimit", "10000")
    out.conf.set(NANOS, "true")
    return out


def moved(frame: DataFrame, to: SparkSession) -> DataFrame:
    """The same logical plan as a frame of another session of the application."""
    plan = frame._jdf.queryExecution().logical()
    return DataFrame(to._jvm.org.apache.spark.sql.classic.Dataset.ofRows(to._jsparkSession, plan), to)


class QueryProvider:
    """Bindings are fixed when it is made; a rejected query leaves it usable."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, Table] | None = None, catalog: Catalog | None = None):
        bound = dict(tables or {})
        for name, t in bound.items():
            ty.check_name(name, "relation name", devices=False)
            if type(t) is not Table:
                raise TypeError(f"{name}: not a Table")
        if catalog is not None and type(catalog) is not Catalog:
            raise TypeError("not a Catalog")
        if catalog is not None and (both := set(bound) & set(catalog.tables)):
            raise ty.AdmissionError(f"names bound twice: {sorted(both)}")
        if not bound and catalog is None:
            raise ty.AdmissionError("nothing is bound")
        self._spark, self._tables, self._catalog = spark, bound, catalog

    @property
    def relations(self) -> tuple[str, ...]:
        return tuple(sorted([*self._tables, *(self._catalog.tables if self._catalog else ())]))

    def frame(self, sql: str, params: Mapping[str, object] | None = None) -> DataFrame:
        """The admitted, not yet executed result."""
        text, args = gate.bind(sql, params)
        text = gate.series(text)
        session = fresh_session(self._spark)
        frames = {n: moved(t.frame, session) for n, t in self._tables.items()}
        return run(session, text, args, frames, self._catalog)

    def query(self, sql: str, params: Mapping[str, object] | None = None) -> Table:
        out = self.frame(sql, params)
        ty.admit_result(out.schema)
        return Table.from_frame(out)


def run(session: SparkSession, text: str, args: dict, frames: dict[str, DataFrame], catalog: Catalog | None = None, schema: str | None = None) -> DataFrame:
    """Gate, bind and plan one statement. With schema, relations stand below that name too."""
    names = [*frames, *(catalog.tables if catalog else ())]
    text = gate.qualified(text, "information_schema", ["tables", "columns"])
    if schema:
        text = gate.qualified(text, schema, names)
    prefix = f"{schema}__" if schema else ""
    views = {f"{prefix}{n}" for n in names}
    kind, used = gate.check(session, text, views | {"information_schema__tables", "information_schema__columns"})
    every = {**frames, **({n: catalog.read(session, n) for n in catalog.tables} if catalog else {})}
    for n, f in every.items():
        f.createOrReplaceTempView(f"{prefix}{n}")
    if kind.startswith("ShowTables"):
        return session.createDataFrame([(n,) for n in sorted(names)], "table_name string")
    rows = [(schema or "public", n, f.name, i + 1, f.dataType.simpleString(), "YES" if f.nullable else "NO") for n in sorted(every) for i, f in enumerate(every[n].schema)]
    columns = "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string"
    if kind.startswith("Describe"):
        plan = gate.parsed(session, text)
        target = gate._scala(plan.children().head().multipartIdentifier())[-1].removeprefix(prefix)
        return session.createDataFrame([r for r in rows if r[1] == target], columns).select("column_name", "data_type", "is_nullable")
    if any(u.startswith("information_schema__") for u in used):
        session.createDataFrame(rows, columns).createOrReplaceTempView("information_schema__columns")
        session.createDataFrame([(schema or "public", n) for n in sorted(every)], "table_schema string, table_name string").createOrReplaceTempView("information_schema__tables")
    out = session.sql(text, args=args) if args else session.sql(text)
    if text.lstrip().lower().startswith("values"):
        out = out.toDF(*[f"column{i + 1}" for i in range(len(out.columns))])
    return out
