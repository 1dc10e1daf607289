import struct

import pyarrow.parquet as pq
import pytest

pytest.importorskip("google.protobuf")
from google.protobuf import descriptor_pb2, descriptor_pool, message_factory  # noqa: E402

from tracemill.sources import hitrace  # noqa: E402


@pytest.fixture(scope="module")
def result():
    f = descriptor_pb2.FileDescriptorProto(name="t.proto", package="t", syntax="proto3")

    def message(name, *fields, oneof=False):
        m = f.message_type.add(name=name)
        if oneof:
            m.oneof_decl.add(name="event")
        for number, (n, kind, label, ref, choice) in enumerate(fields, 1):
            x = m.field.add(name=n, number=number, type=kind, label=label)
            if ref:
                x.type_name = f".t.{ref}"
            if choice:
                x.oneof_index = 0

    message("Inner", ("a", 5, 1, "", False), ("b", 9, 1, "", False))
    message("Alloc", ("size", 4, 1, "", False))
    message("Event", ("tid", 5, 1, "", False), ("alloc", 11, 1, "Alloc", True), oneof=True)
    message("TraceResult", ("id", 13, 1, "", False), ("inner", 11, 1, "Inner", False), ("events", 11, 3, "Event", False), ("calls", 4, 3, "", False))
    pool = descriptor_pool.DescriptorPool()
    pool.Add(f)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName("t.TraceResult"))


def field(number, value):
    if isinstance(value, int):
        out = bytes([number << 3])
        while value > 127:
            out, value = out + bytes([value & 127 | 128]), value >> 7
        return out + bytes([value])
    return bytes([number << 3 | 2, len(value)]) + value


def section(body, kind=0):
    head = bytearray(1024)
    struct.pack_into("<QQ", head, 0, hitrace.MAGIC, 1024 + len(body))
    struct.pack_into("<I", head, 56, kind)
    for i, at in enumerate(hitrace.CLOCKS.values()):
        struct.pack_into("<Q", head, at, 2**64 - 1 - i)
    return bytes(head) + body


def frame(name, data):
    e = field(1, name) + field(3, data) + field(5, 300)
    return struct.pack("<I", len(e)) + e


def test_relations(tmp_path, result):
    m = result(id=7, calls=[5, 2**63])
    m.inner.a = 1
    m.events.add(tid=1).alloc.size = 9
    m.events.add(tid=2)
    (tmp_path / "x").write_bytes(section(frame(b"plugin", m.SerializeToString()) + frame(b"other_config", b"")) + section(b"", 3))
    report = hitrace.decode(tmp_path / "x", tmp_path / "out", {"plugin": result})
    assert report == hitrace.Report((3,), ("other",))
    rows = lambda n: pq.read_table(tmp_path / "out" / f"{n}.parquet").to_pylist()
    assert rows("trace_result") == [{"_row_id": 0, "_parent_row_id": 0, "id": 7, "inner": {"a": 1, "b": ""}}]
    assert rows("trace_result_events") == [{"_row_id": 0, "_parent_row_id": 0, "_repeated_index": 0, "tid": 1}, {"_row_id": 1, "_parent_row_id": 0, "_repeated_index": 1, "tid": 2}]
    assert rows("trace_result_events_alloc") == [{"_parent_row_id": 0, "size": 9}]
    assert [r["value"] for r in rows("trace_result_calls")] == [5, 2**63]
    assert rows("profiler_payload_occurrence")[0]["tv_sec"] == 300 and rows("clock_snapshot")[0]["clock_value"] == 2**64 - 1


@pytest.mark.parametrize("data", [b"", b"x" * 2000, section(b"\x05\0\0\0ab"), section(b"")[:-1]])
def test_malformed_containers_publish_nothing(tmp_path, result, data):
    (tmp_path / "x").write_bytes(data)
    with pytest.raises(hitrace.ContainerError):
        hitrace.decode(tmp_path / "x", tmp_path / "out", {"plugin": result})
    assert [p.name for p in tmp_path.iterdir()] == ["x"]
