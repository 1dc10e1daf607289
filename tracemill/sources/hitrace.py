"""Binary profiler containers: sections of framed envelopes, whose payloads are shredded into relations by their descriptors.

A file is one sequence: frames can be found only one after the other, so one file is one task's work and many
files are spread over tasks by the caller. Rows are written in batches; nothing is published if anything is malformed.

Payload descriptors (protobuf message descriptors) are a parameter: root message by envelope name."""

from __future__ import annotations

import shutil
import struct
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

from ..operators.outputs import publish

HEADER_BYTES = 1024
MAGIC = 0x464F5250534F484F
PROTOBUF_SECTION = 0
BATCH_ROWS = 8192
VERSION = {b"materialization.version": b"hitrace-v1"}
#: Where the first header holds its clock readings, eight bytes each (fixed values).
CLOCKS = {"boottime": 60, "realtime": 68, "realtime_coarse": 76, "monotonic": 84, "monotonic_coarse": 92, "monotonic_raw": 100}
#: Fields of an envelope by number (fixed values).
ENVELOPE = {1: "name", 2: "status", 3: "data", 4: "clock_id", 5: "tv_sec", 6: "tv_nsec", 7: "version", 8: "sample_interval"}


class ContainerError(ValueError):
    """A file that is no intact container."""


@dataclass(frozen=True)
class Report:
    unsupported_section_types: tuple[int, ...]
    unsupported_plugins: tuple[str, ...]


def sections(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(data type, body) of each section."""
    at = 0
    while at < len(data) or at == 0:
        if len(data) - at < HEADER_BYTES:
            raise ContainerError(f"truncated header at byte {at}")
        magic, length = struct.unpack_from("<QQ", data, at)
        if magic != MAGIC:
            raise ContainerError(f"no section header at byte {at}")
        if length < HEADER_BYTES or at + length > len(data):
            raise ContainerError(f"invalid section length {length} at byte {at}")
        yield struct.unpack_from("<I", data, at + 56)[0], data[at + HEADER_BYTES : at + length]
        at += length


def frames(body: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(body):
        if len(body) - at < 4:
            raise ContainerError(f"truncated frame length at byte {at}")
        (n,) = struct.unpack_from("<I", body, at)
        at += 4
        if len(body) - at < n:
            raise ContainerError(f"truncated frame at byte {at}")
        yield body[at : at + n]
        at += n


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ContainerError("malformed number in an envelope")
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value & ((1 << 64) - 1), at
        shift += 7


def envelope(data: bytes) -> dict[str, object]:
    out: dict[str, object] = {"name": "", "status": 0, "data": b"", "clock_id": 0, "tv_sec": 0, "tv_nsec": 0, "version": "", "sample_interval": 0}
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        kind, name = tag & 7, ENVELOPE.get(tag >> 3)
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            n, at = varint(data, at)
            if at + n > len(data):
                raise ContainerError("truncated field in an envelope")
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ContainerError(f"wire type {kind} in an envelope")
        if name:
            out[name] = value.decode() if isinstance(out[name], str) and isinstance(value, bytes) else value
    return out


class Shape:
    """The relations of one root message: what becomes a column, a struct or a child relation."""

    _TYPES = {1: pa.float64(), 2: pa.float32(), 3: pa.int64(), 4: pa.uint64(), 5: pa.int32(), 6: pa.uint64(), 7: pa.uint32(), 8: pa.bool_(), 9: pa.string(), 12: pa.binary(), 13: pa.uint32(), 14: pa.int32(), 15: pa.int32(), 16: pa.int64(), 17: pa.int32(), 18: pa.int64()}

    def __init__(self, descriptor, name: str, repeated: bool = False, above: tuple = ()):
        if descriptor.full_name in above:
            raise ContainerError(f"recursive message {descriptor.full_name}")
        if descriptor.GetOptions().map_entry:
            raise ContainerError(f"map field in {name}")
        self.name, self.repeated, self.columns, self.children, above = name, repeated, [], [], (*above, descriptor.full_name)
        for f in sorted(descriptor.fields, key=lambda f: f.number):
            many = f.is_repeated if hasattr(f, "is_repeated") else f.label == 3
            if f.message_type is None:
                self.children.append((f, many, None, f"{name}_{f.name}")) if many else self.columns.append((f, self._TYPES[f.type]))
                continue
            choice = f.containing_oneof is not None and not getattr(f.containing_oneof, "name", "").startswith("_")
            child = Shape(f.message_type, f"{name}_{f.name}", many, above)
            if many or choice or child.children:
                self.children.append((f, many, child, child.name))
            else:
                self.columns.append((f, pa.struct([pa.field(c.name, t) for c, t in child.columns])))

    def schemas(self) -> dict[str, pa.Schema]:
        ids = [pa.field("_row_id", pa.uint64(), False)] * bool(self.children) + [pa.field("_parent_row_id", pa.uint64(), False)] + [pa.field("_repeated_index", pa.uint64(), False)] * self.repeated
        out = {self.name: pa.schema([*ids, *[pa.field(f.name, t) for f, t in self.columns]])}
        for f, _, child, name in self.children:
            if child is None:
                out[name] = pa.schema([pa.field("_parent_row_id", pa.uint64(), False), pa.field("_repeated_index", pa.uint64(), False), pa.field("value", self._TYPES[f.type])])
            else:
                out |= child.schemas()
        return out

    def _value(self, message, f):
        if f.message_type is not None:
            if not message.HasField(f.name):
                return None
            inner = getattr(message, f.name)
            return {c.name: self._value(inner, c) for c in f.message_type.fields}
        return None if f.has_presence and not message.HasField(f.name) else getattr(message, f.name)

    def rows(self, message, parent: int, index: int, put) -> None:
        """put(relation, row) returns the row's number there."""
        row = {"_parent_row_id": parent} | ({"_repeated_index": index} if self.repeated else {}) | {f.name: self._value(message, f) for f, _ in self.columns}
        number = put(self.name, row)
        for f, many, child, name in self.children:
            if child is None:
                for i, v in enumerate(getattr(message, f.name)):
                    put(name, {"_parent_row_id": number, "_repeated_index": i, "value": v})
            elif many:
                for i, m in enumerate(getattr(message, f.name)):
                    child.rows(m, number, i, put)
            elif message.HasField(f.name):
                child.rows(getattr(message, f.name), number, 0, put)


class _Sink:
    def __init__(self, folder: Path):
        self.folder, self.writers, self.batches, self.counts, self.schemas = folder, {}, {}, {}, {}

    def open(self, name: str, schema: pa.Schema) -> None:
        if name not in self.schemas:
            self.schemas[name] = schema.with_metadata(VERSION)
            self.writers[name] = pq.ParquetWriter(self.folder / f"{name}.parquet", self.schemas[name])
            self.batches[name], self.counts[name] = [], 0

    def put(self, name: str, row: dict) -> int:
        number = self.counts[name]
        if "_row_id" in self.schemas[name].names:
            row = {"_row_id": number} | row
        self.batches[name].append(row)
        self.counts[name] += 1
        if len(self.batches[name]) >= BATCH_ROWS:
            self.flush(name)
        return number

    def flush(self, name: str) -> None:
        self.writers[name].write_table(pa.Table.from_pylist(self.batches[name], schema=self.schemas[name]))
        self.batches[name] = []

    def close(self) -> None:
        for name, w in self.writers.items():
            self.flush(name)
            w.close()
            if pq.read_metadata(self.folder / f"{name}.parquet").num_rows != self.counts[name]:
                raise OSError(f"{name}: the file does not hold its rows")


def decode(source: str | Path, destination: str | Path, messages: Mapping[str, type]) -> Report:
    """Decodes one container into a folder of relations. messages: protobuf message class by envelope name."""
    to = Path(destination)
    if to.exists():
        raise FileExistsError(str(to))
    data = Path(source).read_bytes()
    shapes = {n: Shape(c.DESCRIPTOR, _snake(c.DESCRIPTOR.name)) for n, c in messages.items()}
    other_types, other_plugins = set(), set()
    staging = to.parent / f".{to.name}-{uuid.uuid4().hex}"
    try:
        staging.mkdir(parents=True)
        sink = _Sink(staging)
        sink.open("clock_domain", pa.schema([pa.field("clock_domain", pa.string(), False), pa.field("clock_type", pa.string(), False), pa.field("ticks_per_second", pa.uint64(), False)]))
        sink.open("clock_snapshot", pa.schema([pa.field("snapshot_id", pa.uint64(), False), pa.field("clock_domain", pa.string(), False), pa.field("clock_value", pa.uint64(), False)]))
        for kind, body in sections(data):
            if kind != PROTOBUF_SECTION:
                other_types.add(kind)
                continue
            for frame in frames(body):
                e = envelope(frame)
                if e["name"] not in messages:
                    other_plugins.add(e["name"].removesuffix("_config"))
                    continue
                shape = shapes[e["name"]]
                sink.open("profiler_payload_occurrence", pa.schema([pa.field("_row_id", pa.uint64(), False), pa.field("envelope_name", pa.string(), False), pa.field("status", pa.uint32(), False), pa.field("clock_id", pa.int32(), False), pa.field("tv_sec", pa.uint64(), False), pa.field("tv_nsec", pa.uint64(), False), pa.field("version", pa.string(), False), pa.field("sample_interval", pa.uint32(), False)]))
                for name, schema in shape.schemas().items():
                    sink.open(name, schema)
                number = sink.put("profiler_payload_occurrence", {"envelope_name": e["name"]} | {k: e[k] for k in ("status", "clock_id", "tv_sec", "tv_nsec", "version", "sample_interval")})
                try:
                    message = messages[e["name"]].FromString(e["data"])
                except Exception as x:
                    raise ContainerError(f"malformed payload of {e['name']}: {x}") from x
                shape.rows(message, number, 0, sink.put)
        for name, at in sorted(CLOCKS.items()):
            sink.put("clock_domain", {"clock_domain": name, "clock_type": name, "ticks_per_second": 10**9})
        for name, at in CLOCKS.items():
            sink.put("clock_snapshot", {"snapshot_id": 0, "clock_domain": name, "clock_value": struct.unpack_from("<Q", data, at)[0]})
        sink.close()
        publish(staging, to)
    finally:
        shutil.rmtree(staging, ignore_errors=True)
    return Report(tuple(sorted(other_types)), tuple(sorted(other_plugins)))


def _snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() and i else c.lower() for i, c in enumerate(name))
