"""What a PostgreSQL driver returns as Arrow, made fit for a Table.

No driver is part of this package: rows() takes any DB-API or ADBC connection whose cursor can fetch an Arrow table. The column
types that PostgreSQL has and this engine lacks are changed exactly or refused."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import SparkSession

from ..functions import types as ty
from ..operators.table import Table

#: Field metadata in which a driver names the server's type (fixed value).
TYPE_NAME = b"ADBC:postgresql:typname"
NUMERIC = pa.decimal128(38, 18)
INSTANT = pa.timestamp("ns", tz="UTC")


class UnsupportedResult(ty.AdmissionError):
    """A result with values that cannot be kept exactly."""


def type_name(field: pa.Field) -> str | None:
    """The server's name of a column's type, from the metadata or from an opaque extension type."""
    told = (field.metadata or {}).get(TYPE_NAME)
    if told is None and isinstance(field.type, pa.BaseExtensionType) and getattr(field.type, "vendor_name", None) == "PostgreSQL":
        return str(field.type.type_name).lower()
    if told is None and (field.metadata or {}).get(b"ARROW:extension:name") == b"arrow.opaque":
        facts = json.loads((field.metadata or {}).get(b"ARROW:extension:metadata", b"{}"))
        return str(facts.get("type_name", "")).lower() or None
    return told.decode("utf-8", "replace").lower() if told is not None else None


def normalised(data: pa.Table) -> pa.Table:
    """numeric as decimal(38,18) and instants as UTC nanoseconds, both exact; a timestamp without a zone is refused."""
    fields, columns = [], []
    for f, column in zip(data.schema, data.columns):
        want = NUMERIC if type_name(f) == "numeric" else INSTANT if pa.types.is_timestamp(f.type) else None
        if pa.types.is_timestamp(f.type) and f.type.tz is None:
            raise UnsupportedResult(f"{f.name}: a timestamp without a time zone needs a conversion in the SQL")
        if want is not None:
            if isinstance(f.type, pa.BaseExtensionType):
                column = pa.chunked_array([c.storage for c in column.chunks], f.type.storage_type)
            try:
                column = column.cast(want, safe=True)
            except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
                raise UnsupportedResult(f"{f.name}: a value does not fit {want} exactly") from e
        fields.append(pa.field(f.name, column.type, f.nullable))
        columns.append(column)
    return pa.table(columns, schema=pa.schema(fields))


def positional(params: object) -> tuple:
    """The parameters of a statement: one flat sequence."""
    flat = isinstance(params, Sequence) and not isinstance(params, (str, bytes, bytearray, memoryview))
    values = tuple(params) if flat else ()
    nested = [v for v in values if isinstance(v, (Mapping, pa.Array, pa.Table)) or (isinstance(v, Sequence) and not isinstance(v, (str, bytes, bytearray, memoryview)))]
    if params is not None and (not flat or nested):
        raise TypeError("parameters are one flat sequence")
    return values


def rows(spark: SparkSession, connection, sql: str, params: Sequence | None = None) -> Table:
    """The result of one statement as a Table. connection.cursor() must offer execute() and fetch_arrow_table()."""
    values = positional(params)
    with connection.cursor() as cursor:
        cursor.execute(sql, values) if values else cursor.execute(sql)
        return Table.from_arrow(spark, normalised(cursor.fetch_arrow_table()))
