"""Named immutable outputs and delivery of query results: inline when small, else as newline-delimited JSON."""

from __future__ import annotations

import ctypes
import errno
import json
import math
import os
import shutil
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions import types as ty
from . import gate
from .provider import fresh_session, run
from .table import Table

#: A result is inline if it has neither more rows nor more bytes (fixed values).
INLINE_ROWS = 100
INLINE_BYTES = 65_536


def publish(staging: Path, destination: Path) -> None:
    """Renames a folder to a name that must not exist; of several that try, one succeeds."""
    libc = ctypes.CDLL(None, use_errno=True)
    call = getattr(libc, "renameat2", None)
    if call is not None:
        if call(-100, os.fsencode(staging), -100, os.fsencode(destination), 1) == 0:
            return
        code = ctypes.get_errno()
        if code not in (errno.ENOSYS, errno.EINVAL):
            raise FileExistsError(code, os.strerror(code), str(destination)) if code == errno.EEXIST else OSError(code, os.strerror(code), str(destination))
    os.mkdir(destination)  # claims the name
    os.rename(staging, destination)


def materialise(result: object, destination: str | Path) -> dict[str, Path]:
    """Writes the outputs of a workflow: None, one Table (named main) or a dict of names to Tables. All or nothing."""
    if result is None:
        outputs: dict[str, Table] = {}
    elif type(result) is Table:
        outputs = {"main": result}
    elif type(result) is dict and result:
        outputs = result
    else:
        raise ty.AdmissionError("a workflow returns None, a Table or a dict of names to Tables that is not empty")
    for name, t in outputs.items():
        ty.check_name(name, "output name")
        if type(t) is not Table:
            raise ty.AdmissionError(f"output {name} is not a Table")
    to = Path(destination)
    staging = to.parent / f".{to.name}-{uuid.uuid4().hex}"
    try:
        staging.mkdir(parents=True)
        for name, t in outputs.items():
            t.frame.write.option("compression", "zstd").parquet(f"file://{(staging / f'{name}.parquet').resolve()}")
        publish(staging, to)
    finally:
        shutil.rmtree(staging, ignore_errors=True)
    return {name: to / f"{name}.parquet" for name in outputs}


def check_names(kind: T.DataType, where: str = "result") -> None:
    """Rejects equal names among the columns, or among the fields of a struct."""
    if isinstance(kind, T.StructType):
        names = kind.names
        if len(set(names)) != len(names):
            raise ty.AdmissionError(f"{where}: equal names in {names}")
        for f in kind:
            check_names(f.dataType, f"{where}.{f.name}")
    elif isinstance(kind, T.ArrayType):
        check_names(kind.elementType, where)
    elif isinstance(kind, T.MapType):
        check_names(kind.keyType, where)
        check_names(kind.valueType, where)


def to_json(value: object, kind: T.DataType) -> str:
    """JSON text of a value: nulls in structs are left out, binary is lower-case hexadecimal, NaN is null, decimals keep all digits."""
    if value is None:
        return "null"
    if isinstance(kind, T.StructType):
        pairs = [(f.name, v, f.dataType) for f, v in zip(kind, value) if v is not None]
        return "{" + ",".join(f"{json.dumps(n, ensure_ascii=False)}:{to_json(v, k)}" for n, v, k in pairs) + "}"
    if isinstance(kind, T.ArrayType):
        return "[" + ",".join(to_json(v, kind.elementType) for v in value) + "]"
    if isinstance(kind, T.MapType):
        return "{" + ",".join(f"{json.dumps(str(k), ensure_ascii=False)}:{to_json(v, kind.valueType)}" for k, v in value.items()) + "}"
    if isinstance(value, (bytes, bytearray)):
        return f'"{bytes(value).hex()}"'
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return json.dumps(value) if math.isfinite(value) else "null"
    if isinstance(value, Decimal):
        return f"{value:f}"
    if isinstance(value, datetime):
        return json.dumps(value.isoformat())
    if isinstance(value, date):
        return json.dumps(value.isoformat())
    return json.dumps(value, ensure_ascii=False)


@dataclass(frozen=True)
class Delivery:
    """columns: name and type in order; rows inline as JSON texts, or else the file that holds them."""

    columns: tuple[tuple[str, str], ...]
    n_rows: int
    rows: tuple[str, ...] | None
    file: Path | None

    @property
    def text(self) -> str:
        return "".join(f"{r}\n" for r in self.rows) if self.rows is not None else self.file.read_text("utf-8")


def deliver(frame: DataFrame, destination: str | Path) -> Delivery:
    """Writes rows as NDJSON and keeps the file only if the result is over a threshold; never cuts it.

    Rows come one partition at a time, so the driver's memory holds one partition at most."""
    check_names(frame.schema)
    columns = tuple((f.name, f.dataType.simpleString()) for f in frame.schema)
    to = Path(destination)
    if to.exists():
        raise FileExistsError(str(to))
    rows: list[str] = []
    n = size = 0
    with to.open("x", encoding="utf-8", newline="\n") as f:
        for r in frame.toLocalIterator():
            line = to_json(r, frame.schema)
            f.write(line + "\n")
            n += 1
            size += len(line.encode()) + 1
            if n <= INLINE_ROWS and size <= INLINE_BYTES:
                rows.append(line)
    if n <= INLINE_ROWS and size <= INLINE_BYTES:
        to.unlink()
        return Delivery(columns, n, tuple(rows), None)
    return Delivery(columns, n, None, to)


def query_outputs(spark: SparkSession, outputs: Mapping[str, str | Path], sql: str) -> DataFrame:
    """One read-only statement over published outputs, which stand below the schema `output`."""
    session = fresh_session(spark)
    frames = {n: session.read.parquet(f"file://{Path(p).resolve()}") for n, p in outputs.items()}
    return run(session, gate.series(sql), {}, frames, schema="output")


def archive(delivery: Delivery, sql: str, folder: str | Path) -> Path:
    """Keeps a query: its SQL, columns and rows."""
    to = Path(folder) / f"query-{uuid.uuid4()}"
    staging = to.with_name(f".{to.name}")
    staging.mkdir(parents=True)
    (staging / "query.sql").write_text(sql, "utf-8")
    (staging / "columns.json").write_text(json.dumps([{"name": n, "type": t} for n, t in delivery.columns]), "utf-8")
    (staging / "rows.ndjson").write_text(delivery.text, "utf-8")
    publish(staging, to)
    return to


def row_count(path: Path) -> int:
    """Rows by the footers of a Parquet file or folder."""
    return sum(pq.read_metadata(p).num_rows for p in ([path] if path.is_file() else path.rglob("*.parquet")))
