"""Read-only catalogs over Parquet files: schemas are fixed by the footers when the catalog is opened."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from ..functions import types as ty

NANOS = "spark.sql.legacy.parquet.nanosAsLong"


class Catalog:
    """Named relations over Parquet files. Made by open_catalog only; every read sees the files as they then are."""

    _key = object()

    def __init__(self, relations: Mapping[str, tuple[tuple[str, ...], pa.Schema]], key: object = None):
        if key is not Catalog._key:
            raise TypeError("use open_catalog")
        self._relations = dict(relations)

    @property
    def tables(self) -> tuple[str, ...]:
        return tuple(sorted(self._relations))

    def schema(self, name: str) -> pa.Schema:
        return self._relations[name][1]

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """The relation; an explicit list of files adds no partition columns."""
        paths, schema = self._relations[name]
        spark.conf.set(NANOS, "true")
        frame = spark.read.option("mergeSchema", "false").option("recursiveFileLookup", "true").parquet(*paths)
        logical = {f.name for f in schema if pa.types.is_timestamp(f.type) and f.type.unit == "ns"}
        return frame.select(*[frame[f"`{c}`"].alias(c, metadata=ty.NS) if c in logical else frame[f"`{c}`"] for c in frame.columns])


def open_catalog(*, root: str | Path | None = None, tables: Mapping[str, str | Path] | None = None) -> Catalog:
    """A catalog of each direct *.parquet file of a folder (named by its stem), or of a mapping from names to files and folders of parts."""
    if (root is None) == (tables is None):
        raise TypeError("give exactly one of root and tables")
    found: dict[str, list[Path]] = {}
    if root is not None:
        top = Path(root)
        if top.is_symlink() or not top.is_dir():
            raise ty.AdmissionError(f"not a folder: {top}")
        for p in sorted(top.iterdir()):
            if p.suffix == ".parquet":
                if p.is_symlink():
                    raise ty.AdmissionError(f"links are not followed: {p}")
                if p.is_file():
                    found[ty.check_name(p.stem, "relation name")] = [p]
        if not found:
            raise ty.AdmissionError(f"no relation in {top}")
    else:
        for name, at in tables.items():
            found[ty.check_name(name, "relation name")] = _parts(Path(at))
    return Catalog({n: (tuple(map(str, ps)), _uniform(n, ps)) for n, ps in found.items()}, Catalog._key)


def _parts(at: Path) -> list[Path]:
    if at.is_symlink():
        raise ty.AdmissionError(f"links are not followed: {at}")
    if at.is_file():
        return [at]
    if not at.is_dir():
        raise ty.AdmissionError(f"no such file or folder: {at}")
    inner = sorted(at.rglob("*"), key=lambda p: p.relative_to(at).as_posix())
    if any(p.is_symlink() for p in inner):
        raise ty.AdmissionError(f"links are not followed: {at}")
    out = [p for p in inner if p.is_file() and p.suffix == ".parquet"]
    if not out:
        raise ty.AdmissionError(f"no part in {at}")
    return out


def _uniform(name: str, paths: list[Path]) -> pa.Schema:
    first: pa.Schema | None = None
    for p in paths:
        try:
            schema = pq.read_schema(p).remove_metadata()
        except (pa.ArrowInvalid, OSError) as e:
            raise ty.AdmissionError(f"{name}: {p} cannot be read: {e}") from e
        if first is None:
            first = schema
            if not schema.names or not all(schema.names) or len(set(schema.names)) != len(schema.names):
                raise ty.AdmissionError(f"{name}: column names must be unique and not empty")
            for f in schema:
                ty.admit_arrow(f.type, scan=True)
        elif not schema.equals(first):
            raise ty.AdmissionError(f"{name}: {p} has another schema than {paths[0]}")
    return first
