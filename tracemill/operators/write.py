"""Transactional writing of several relations: all of them are published together, or none.

Rows are gathered in batches; one thread of the writer's own encodes and writes them. At most one batch waits for it, so a
producer that is faster is held up at append().
"""

from __future__ import annotations

import queue
import shutil
import threading
import uuid
from collections.abc import Mapping
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame

from ..functions import types as ty
from .outputs import publish, row_count
from .table import Schema

#: A batch is written at so many rows or estimated bytes (fixed values).
BATCH_ROWS = 8192
BATCH_BYTES = 64 << 20


class Relation:
    """Where one relation's rows go."""

    def __init__(self, owner: Writer, name: str, columns: Mapping[str, object]):
        self._owner, self._name, self._columns = owner, name, columns
        self._rows: list[tuple] = []
        self._bytes = self._count = self._parts = 0

    def append(self, **row: object) -> None:
        """Adds one row; a row that is not admitted leaves the transaction as it was."""
        self._owner._check()
        if set(row) != set(self._columns):
            raise ty.AdmissionError(f"{self._name}: keys must equal the columns {list(self._columns)}")
        values = tuple(ty.normal(row[c], kind, f"{self._name}, {c}") for c, kind in self._columns.items())
        self._rows.append(values)
        self._bytes += sum(len(v) if isinstance(v, (str, bytes)) else 16 for v in values)
        if len(self._rows) >= BATCH_ROWS or self._bytes >= BATCH_BYTES:
            self._flush()

    def append_frame(self, frame: DataFrame) -> None:
        """Adds all rows of a frame with the relation's columns and types; its tasks write them."""
        self._owner._check()
        want = [(f.name, f.dataType) for f in self._owner._schema.struct(self._name)]
        if [(f.name, f.dataType) for f in frame.schema] != want:
            raise ty.AdmissionError(f"{self._name}: columns {frame.dtypes} are not {want}")
        strict = [c for c, kind in self._columns.items() if not ty.unwrapped(kind)[1]]
        if strict and not frame.filter(" or ".join(f"`{c}` is null" for c in strict)).isEmpty():
            raise ty.AdmissionError(f"{self._name}: null in a column that allows none")
        part = self._owner._staging / f"{self._name}.parquet" / f"part-{self._parts:05d}"
        frame.write.parquet(f"file://{part.resolve()}")
        self._parts += 1
        self._count += row_count(part)

    def schema(self) -> pa.Schema:
        """The declared columns as they stand in files."""
        kinds = [ty.unwrapped(k) for k in self._columns.values()]
        return pa.schema([pa.field(c, pa.int64() if t is ty.datetime else ty.LOGICAL[t][1], n) for c, (t, n) in zip(self._columns, kinds)])

    def _flush(self, last: bool = False) -> None:
        if not self._rows and not (last and not self._parts):
            return
        at = self._owner._staging / f"{self._name}.parquet"
        at.mkdir(exist_ok=True)
        self._owner._send((at / f"part-{self._parts:05d}.parquet", list(self._columns), self._rows, self.schema()))
        self._count += len(self._rows)
        self._parts += 1
        self._rows, self._bytes = [], 0

    def _verify(self) -> None:
        """Raises unless the footers hold the declared columns and the rows that were accepted."""
        at = self._owner._staging / f"{self._name}.parquet"
        want = [(f.name, f.type) for f in self.schema()]
        for part in sorted(at.rglob("*.parquet")):
            if part.is_file() and [(f.name, f.type) for f in pq.read_schema(part)] != want:
                raise OSError(f"{self._name}: {part.name} does not hold the declared columns")
        if row_count(at) != self._count:
            raise OSError(f"{self._name}: the files do not hold the rows that were accepted")


class Writer:
    """One-shot context manager. Only the thread that entered it may write.

    NEW, ACTIVE, DRAINING, COMMITTED; ABORTED after an error of the caller, FAILED after one of the writer itself."""

    def __init__(self, schema: Schema, destination: str | Path):
        self._schema, self._to, self._state = schema, Path(destination), "NEW"
        self._staging = self._to.parent / f".{self._to.name}-{uuid.uuid4().hex}"
        self._batches: queue.Queue = queue.Queue(maxsize=1)
        self._failure: BaseException | None = None

    def _work(self) -> None:
        while (job := self._batches.get()) is not None:
            if self._failure is None:
                path, names, rows, schema = job
                try:
                    pq.write_table(pa.Table.from_pylist([dict(zip(names, r)) for r in rows], schema=schema), path)
                except Exception as e:  # told to the caller's thread
                    self._failure = e

    def _send(self, job: tuple) -> None:
        while self._failure is None:
            try:
                return self._batches.put(job, timeout=0.05)
            except queue.Full:
                continue
        self._state = "FAILED"
        raise self._failure

    def _finish(self) -> None:
        """Waits until every batch is written."""
        self._batches.put(None)
        self._worker.join()
        if self._failure is not None:
            raise self._failure

    @property
    def state(self) -> str:
        return self._state

    def __enter__(self) -> Writer:
        if self._state != "NEW":
            raise RuntimeError("a writer is used once")
        if self._to.exists():
            raise FileExistsError(str(self._to))
        self._staging.mkdir(parents=True)
        self._thread, self._state = threading.get_ident(), "ACTIVE"
        self._relations = {n: Relation(self, n, c) for n, c in self._schema.tables.items()}
        self._worker = threading.Thread(target=self._work, daemon=True)
        self._worker.start()
        return self

    def _check(self) -> None:
        if self._state != "ACTIVE":
            raise RuntimeError(f"the writer is {self._state}")
        if threading.get_ident() != self._thread:
            raise RuntimeError("only the thread that opened the writer may use it")

    def __getitem__(self, name: str) -> Relation:
        self._check()
        return self._relations[name]

    def __exit__(self, kind, error, _) -> None:
        if self._state == "ACTIVE":
            self._check()
        try:
            if kind is None and self._state == "ACTIVE":
                self._state = "DRAINING"
                for r in self._relations.values():
                    r._flush(last=True)
                self._finish()
                for r in self._relations.values():
                    r._verify()
                publish(self._staging, self._to)
                self._state = "COMMITTED"
        except BaseException as e:
            self._state = "FAILED"
            e.add_note(f"nothing was published to {self._to}")
            raise
        finally:
            if self._state == "ACTIVE":
                self._state = "ABORTED"
                error.add_note(f"the transaction was aborted; nothing was published to {self._to}")
            if self._worker.is_alive():
                self._batches.put(None)
                self._worker.join()
            shutil.rmtree(self._staging, ignore_errors=True)


def write(schema: Schema, *, destination: str | Path) -> Writer:
    return Writer(schema, destination)
