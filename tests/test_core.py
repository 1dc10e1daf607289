import sqlite3
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tracemill.functions import types as ty
from tracemill.operators import outputs, workflow as wf
from tracemill.operators.provider import QueryProvider
from tracemill.operators.table import Schema, Table
from tracemill.operators.write import write
from tracemill.sources import ftrace
from tracemill.sources.catalog import open_catalog
from tracemill.sources.sqlite import SqliteProvider


def test_durations_and_instants():
    assert ty.Duration.parse("1.5us").nanoseconds == 1500
    assert ty.Duration.parse("2h").nanoseconds == 7200 * 10**9
    for bad in ("0.1ns", "-1s", "1 s", "9" * 30 + "s", "1d"):
        with pytest.raises(ty.AdmissionError):
            ty.Duration.parse(bad)
    assert str(ty.WallClockTimestamp.parse("2024-02-29T12:00:00.123456789+02:00")) == "2024-02-29T10:00:00.123456789Z"
    for bad in ("2024-02-30T00:00:00Z", "2024-01-01T00:00:00-00:00", "2024-01-01T00:00:00", "2024-01-01T00:00:00.1234567890Z"):
        with pytest.raises(ty.AdmissionError):
            ty.WallClockTimestamp.parse(bad)


def test_tables_admit_exact_values_only(spark):
    at = datetime(2024, 1, 1, tzinfo=timezone(timedelta(hours=1)))
    t = Table.from_rows(spark, {"i": int, "f": float, "s": str | None, "b": bytes, "d": Decimal, "t": datetime, "x": bool}, [{"i": 1, "f": 0.5, "s": None, "b": b"\xff", "d": Decimal("1.5"), "t": at, "x": True}])
    row = t.to_rows()[0]
    assert row["b"] == b"\xff" and row["s"] is None and str(row["t"]) == "2023-12-31T23:00:00.000000000Z"
    assert t.to_arrow().schema.field("t").type == pa.timestamp("ns", tz="UTC")
    assert len(Table.from_rows(spark, {"i": int}, [])) == 0
    for kind, bad in ((int, True), (int, 1 << 63), (int, 1.0), (str, b"x"), (str, "\ud800"), (float, 1), (datetime, datetime(2024, 1, 1)), (Decimal, Decimal("NaN")), (Decimal, Decimal("1E-19")), (int, None)):
        with pytest.raises(ty.AdmissionError):
            Table.from_rows(spark, {"c": kind}, [{"c": bad}])
    with pytest.raises(ty.AdmissionError):
        Table.from_rows(spark, {"c": int}, [{"c": 1, "d": 2}])
    with pytest.raises(KeyError):
        t["nope"]
    with pytest.raises(AttributeError):
        t.frame = None


def test_arrow_admission(spark):
    ok = pa.table({"u": pa.array([2**64 - 1], pa.uint64()), "n": pa.array([5], pa.timestamp("ns", tz="UTC")), "h": pa.array([1.5], pa.float16())})
    assert Table.from_arrow(spark, ok)["u"] == (Decimal(2**64 - 1),)
    for bad in (pa.table({"l": [[1]]}), pa.table({"d": pa.array([1], pa.date32())}), pa.table({"t": pa.array([1], pa.timestamp("us"))})):
        with pytest.raises(ty.AdmissionError):
            Table.from_arrow(spark, bad)


@pytest.fixture
def files(tmp_path):
    """Readings of probes in one file, and remarks on them in a folder of parts."""
    pq.write_table(pa.table({"reading": [101, 102, 103, 104], "probe": [7, 7, 8, 9], "celsius": [-4, 31, 12, 77]}), tmp_path / "readings.parquet")
    parts = tmp_path / "remarks"
    (parts / "site=harbour" / "late").mkdir(parents=True)
    pq.write_table(pa.table({"reading": [104], "remark": ["sensor wet"]}), parts / "first.parquet")
    pq.write_table(pa.table({"reading": [102, 101], "remark": ["noon", "frost"]}), parts / "site=harbour" / "late" / "second.parquet")
    return tmp_path


def opened(files):
    return open_catalog(tables={"readings": files / "readings.parquet", "remarks": files / "remarks"})


def test_catalogs(spark, files):
    c = opened(files)
    assert c.tables == ("readings", "remarks") and c.read(spark, "remarks").columns == ["reading", "remark"]
    assert open_catalog(root=files).tables == ("readings",)
    for bad in (dict(), dict(root=files, tables={})):
        with pytest.raises(TypeError):
            open_catalog(**bad)
    pq.write_table(pa.table({"reading": pa.array([9], pa.int16()), "remark": ["narrow"]}), files / "remarks" / "third.parquet")
    with pytest.raises(ty.AdmissionError):
        open_catalog(tables={"remarks": files / "remarks"})


def test_fusion_query_and_parameters(spark, files):
    probes = Table.from_rows(spark, {"probe": int, "place": str}, [{"probe": 7, "place": "mast"}, {"probe": 8, "place": "cellar"}, {"probe": 9, "place": "quay"}])
    p = QueryProvider(spark, {"probes": probes}, opened(files))
    sql = "SELECT remark, place FROM readings JOIN remarks USING (reading) JOIN probes USING (probe) WHERE celsius >= $least AND remark <> '$least' ORDER BY reading DESC"
    assert p.query(sql, {"least": 0}).to_rows() == [{"remark": "sensor wet", "place": "quay"}, {"remark": "noon", "place": "mast"}]
    for value in (None, 1 << 63, float("inf"), bytearray(b"x"), datetime(2024, 1, 1), timedelta(1), float("nan"), [1], Decimal("1E-40")):
        with pytest.raises(ty.AdmissionError):
            p.query("SELECT $v AS v", {"v": value})
    for value in (True, 7, 0.5, "x", b"\x01", Decimal("1.50"), ty.Duration.parse("3ns")):
        assert len(p.query("SELECT $v AS v", {"v": value}))
    with pytest.raises(ty.AdmissionError):
        p.query("SELECT array(1) AS a")
    with pytest.raises(ty.AdmissionError):
        QueryProvider(spark, {"readings": probes}, opened(files))


def test_tables_are_values(spark, files):
    """What a query returned stays as it was when its files change; a later query sees the new rows."""
    p = QueryProvider(spark, catalog=opened(files))
    sql = "SELECT reading, rand() AS dice FROM readings WHERE celsius > 70"
    before = p.query(sql)
    rows = before.to_rows()
    pq.write_table(pa.table({"reading": [900, 901], "probe": [1, 1], "celsius": [99, 98]}), files / "readings.parquet")
    assert before.to_rows() == rows and before["reading"] == (104,) and len(before) == 1
    assert sorted(p.query(sql)["reading"]) == [900, 901]
    with pytest.raises(TypeError):
        Table(before.frame)
    before.release()


def test_names_of_with_queries_count_in_scope_only(spark):
    spark.sql("CREATE OR REPLACE GLOBAL TEMP VIEW ignored AS SELECT 1 AS a")
    spark.sql("CREATE TABLE IF NOT EXISTS unbound_ledger (pw STRING) USING parquet")
    try:
        p = QueryProvider(spark, {"t": Table.from_rows(spark, {"k": int}, [{"k": 1}])})
        inner = "(WITH unbound_ledger AS (SELECT 1 AS a) SELECT * FROM unbound_ledger) x"
        assert p.query(f"SELECT a FROM {inner}").to_rows() == [{"a": 1}]
        for sql in (
            f"SELECT s.pw FROM {inner} CROSS JOIN unbound_ledger s", "SELECT * FROM unbound_ledger", "WITH a AS (SELECT * FROM b), b AS (SELECT 1 AS x) SELECT * FROM a",
            "SELECT k FROM t WHERE k IN (WITH q AS (SELECT 1 AS k) SELECT k FROM q) OR EXISTS (SELECT * FROM q)", "WITH unbound_ledger AS (SELECT * FROM unbound_ledger) SELECT * FROM unbound_ledger",
            "SELECT current_catalog() AS c", "SELECT raise_error('x') AS c", "SELECT input_file_name() AS f", "SELECT default.f(1) AS c",
        ):
            with pytest.raises(ty.AdmissionError):
                p.frame(sql)
        assert p.query("WITH RECURSIVE n AS (SELECT 1 AS i UNION ALL SELECT i + 1 FROM n WHERE i < 3) SELECT i FROM n").to_rows() == [{"i": 1}, {"i": 2}, {"i": 3}]
        assert p.query("SELECT sum(value) AS s FROM generate_series(1, length('a)b(c')) g").to_rows() == [{"s": 15}]
        assert p.query("SELECT 'information_schema__tables' AS t").to_rows() == [{"t": "information_schema__tables"}]
    finally:
        spark.sql("DROP TABLE unbound_ledger")


ALLOWED = ["WITH a AS (SELECT 1 AS x) SELECT * FROM a", "DESCRIBE t", "EXPLAIN SELECT 1", "SHOW TABLES", "VALUES (1)", "SELECT * FROM range(3)", "SELECT * FROM generate_series(1, 3)", "SELECT * FROM information_schema.tables", 'SELECT "k" FROM t']
BLOCKED = [
    "SELECT 1; SELECT 2", "CREATE TABLE x AS SELECT 1", "INSERT INTO t SELECT 1", "SET a=b", "SELECT * FROM '/tmp/x.parquet'", "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM other", "DROP VIEW t",
    "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "CACHE TABLE t", "SELECT reflect('java.lang.System', 'exit', 0)", "SHOW FUNCTIONS", "ADD JAR '/x'", "SELECT * FROM t WHERE k IN (SELECT k FROM hidden)", "CREATE TEMP VIEW v AS SELECT 1",
]


def test_read_only_gate(spark):
    p = QueryProvider(spark, {"t": Table.from_rows(spark, {"k": int}, [{"k": 1}])})
    for sql in ALLOWED:
        p.frame(sql).collect()
    for sql in BLOCKED:
        with pytest.raises(ty.AdmissionError):
            p.frame(sql)
    assert p.query("VALUES (1)").columns == ("column1",)


def test_results_as_json(spark, tmp_path):
    main = Table.from_rows(spark, {"key": int}, [{"key": 2}, {"key": 1}])
    other = Table.from_rows(spark, {"key": int, "label": str}, [{"key": 1, "label": "one"}])
    p = QueryProvider(spark, {"main": main, "other": other})
    d = outputs.deliver(p.frame("SELECT key, label FROM main LEFT JOIN other USING (key) ORDER BY key"), tmp_path / "a.ndjson")
    assert d.text == '{"key":1,"label":"one"}\n{"key":2}\n' and d.file is None
    d = outputs.deliver(p.frame("SELECT X'DE00FF' AS binary, 1.25D AS finite, CAST('NaN' AS DOUBLE) AS nan, CAST(NULL AS STRING) AS gone, named_struct('x', 1, 'y', CAST(NULL AS INT)) AS nested, CAST(12345678901234567890.123456789012345678 AS DECIMAL(38,18)) AS d"), tmp_path / "b.ndjson")
    assert d.text == '{"binary":"de00ff","finite":1.25,"nan":null,"nested":{"x":1},"d":12345678901234567890.123456789012345678}\n'
    assert outputs.deliver(spark.range(100), tmp_path / "c").file is None and outputs.deliver(spark.range(101), tmp_path / "d").file is not None
    assert outputs.deliver(spark.range(0), tmp_path / "e").rows == ()
    row = lambda n: spark.sql(f"SELECT repeat('x', {n}) AS s")
    assert outputs.deliver(row(65_536 - 9), tmp_path / "f").file is None and outputs.deliver(row(65_537 - 9), tmp_path / "g").file is not None
    with pytest.raises(ty.AdmissionError):
        outputs.deliver(spark.sql("SELECT 1 AS a, 2 AS a"), tmp_path / "h")


def test_transactions(tmp_path, monkeypatch):
    schema = Schema({"loaves": {"number": int, "shape": str}, "empty_rows": {"payload": bytes | None}})
    with write(schema, destination=tmp_path / "out") as sink:
        for i in range(20_000):
            sink["loaves"].append(number=i, shape="round")
        with pytest.raises(ty.AdmissionError):
            sink["loaves"].append(number="no", shape="round")
    assert sink.state == "COMMITTED" and outputs.row_count(tmp_path / "out" / "loaves.parquet") == 20_000
    assert outputs.row_count(tmp_path / "out" / "empty_rows.parquet") == 0
    with pytest.raises(FileExistsError), write(schema, destination=tmp_path / "out"):
        pass
    with pytest.raises(ValueError) as told, write(schema, destination=tmp_path / "lost") as sink:
        raise ValueError
    assert sink.state == "ABORTED" and "nothing was published" in told.value.__notes__[0]

    def full(*_, **__):
        raise OSError("disk full")

    monkeypatch.setattr(pq, "write_table", full)
    with pytest.raises(OSError, match="disk full"), write(schema, destination=tmp_path / "lost") as sink:
        for i in range(40_000):
            sink["loaves"].append(number=i, shape="round")
    assert sink.state == "FAILED"
    with pytest.raises(RuntimeError):
        sink["loaves"]
    monkeypatch.undo()
    with pytest.raises(OSError, match="columns"), write(schema, destination=tmp_path / "lost") as sink:
        sink["loaves"].append(number=1, shape="round")
        part = sink._staging / "loaves.parquet" / "other.parquet"
        part.parent.mkdir(exist_ok=True)
        pq.write_table(pa.table({"number": [1]}), part)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]


#: The lines of the flags and columns are fixed by the format; all else is made up.
HEAD = """# tracer: lantern
#
# entries-in-buffer/entries-written: 31/44   #P:2
#
# _-----=> irqs-off/BH-disabled
# / _----=> need-resched
# | / _---=> hardirq/softirq
# || / _--=> preempt-depth
# ||| / _-=> migrate-disable
# |||| /     delay
# TASK-PID       TGID    CPU#  |||||  TIMESTAMP  FUNCTION
"""
EVENTS = """baker-oven-41 ( 40) [001] dN.2. 18.000000007: sched_switch: prev_comm=baker oven prev_pid=41 prev_prio=98 prev_state=R+ ==> next_comm=mixer:0 next_pid=55 next_prio=101
mixer:0-55 (-------) [001] d..1. 18.25: sched_wakeup: comm=scale pid=61 prio=97 target_cpu=001
mixer:0-55 ( 40) [000] ..... 18.5: dough_raised: height=12
scale-61 ( 60) [000] ..... 19.0: mm_filemap_add_to_page_cache: dev 8:17 ino beef pfn=0x5a ofs=12288 order=3
scale-61 ( 60) [000] ..... 20.0: mm_filemap_delete_from_page_cache: dev 8:18 ino c0de page=00000000feedface pfn=4711 ofs=0
scale-61 ( 60) [000] ..... 21.0: block_rq_issue: 8,32 RA 16384 () 7340 + 32 [flour silo]
scale-61 ( 60) [000] ..... 22.0: block_rq_complete: 8,32 RA () 7340 + 32 [-11]
scale-61 ( 60) [000] ..... 23.0: binder_transaction: transaction=-9 dest_node=14 dest_proc=15 dest_thread=16 reply=0 flags=0x3f code=18
scale-61 ( 60) [000] ..... 24.0: print: weigh: grams: 250
"""


def test_text_traces(spark, tmp_path):
    (tmp_path / "t.ftrace").write_text(HEAD + EVENTS)
    p = ftrace.FtraceProvider(spark, tmp_path / "t.ftrace", tmp_path / "ws", "boot")
    assert p.decode_report.unsupported_event_names == ("dough_raised",)
    one = lambda sql: p.query(sql).to_rows()
    assert one("SELECT tracer, has_tgid_column FROM text_ftrace_header") == [{"tracer": "lantern", "has_tgid_column": True}]
    assert [r["source_event_sequence"] for r in one("SELECT source_event_sequence FROM text_ftrace_event_occurrence ORDER BY _row_id")] == [0, 1, 3, 4, 5, 6, 7, 8]
    root = one("SELECT clock_value, cpu, emitter_thread_name, emitter_thread_id, emitter_process_id FROM text_ftrace_event ORDER BY _row_id")
    assert root[0] == {"clock_value": 18_000_000_007, "cpu": 1, "emitter_thread_name": "baker-oven", "emitter_thread_id": 41, "emitter_process_id": 40} and root[1]["emitter_process_id"] is None
    assert root[1]["clock_value"] == 18_250_000_000 and root[1]["emitter_thread_name"] == "mixer:0"
    assert one("SELECT previous_thread_name AS p, next_thread_id AS n, previous_state AS s FROM text_ftrace_event_sched_switch") == [{"p": "baker oven", "n": 55, "s": "R+"}]
    add = one("SELECT inode, page_frame_number, `order`, page_address, offset_bytes FROM text_ftrace_event_mm_filemap_add_to_page_cache")[0]
    assert add == {"inode": 0xBEEF, "page_frame_number": 0x5A, "order": 3, "page_address": None, "offset_bytes": 12288}
    gone = one("SELECT page_frame_number, `order`, page_address FROM text_ftrace_event_mm_filemap_delete_from_page_cache")[0]
    assert gone == {"page_frame_number": 4711, "order": None, "page_address": "00000000feedface"}
    assert one("SELECT sector, bytes, process_name FROM text_ftrace_event_block_rq_issue")[0] == {"sector": 7340, "bytes": 16384, "process_name": "flour silo"}
    assert one("SELECT error FROM text_ftrace_event_block_rq_complete")[0] == {"error": -11}
    assert one("SELECT transaction_id AS t, flags, code FROM text_ftrace_event_binder_transaction")[0] == {"t": -9, "flags": 63, "code": 18}
    assert one("SELECT instruction_pointer AS i, content AS c FROM text_ftrace_event_print")[0] == {"i": "weigh", "c": "grams: 250"}
    assert ftrace.FtraceProvider(spark, tmp_path / "t.ftrace", tmp_path / "ws", "boot").decode_report is None
    with pytest.raises(ty.AdmissionError):
        ftrace.FtraceProvider(spark, tmp_path / "t.ftrace", tmp_path / "ws", "mono")


def test_long_comments_before_the_column_header(spark, tmp_path):
    """Header lines count wherever they stand among the comments before the first event."""
    mark = "# TASK-PID"
    (tmp_path / "t.ftrace").write_text(HEAD.replace(mark, "# recipe note\n" * 12_000 + mark) + EVENTS)
    ftrace.decode(spark, tmp_path / "t.ftrace", tmp_path / "out", "boot")
    assert outputs.row_count(tmp_path / "out" / "text_ftrace_event.parquet") == 8


@pytest.mark.parametrize("text", [EVENTS, HEAD, HEAD + "nonsense\n", HEAD + "oven-3 ( 3) [001] ..... 1.0: sched_wakeup: comm=x\n", HEAD + EVENTS + "# tracer: lantern\n", HEAD + "oven-3 ( 3) [001] ..... 1.0000000001: x: y\n"])
def test_malformed_traces_publish_nothing(spark, tmp_path, text):
    (tmp_path / "t.ftrace").write_text(text)
    with pytest.raises(ftrace.TraceError):
        ftrace.decode(spark, tmp_path / "t.ftrace", tmp_path / "out", "boot")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t.ftrace"]


def test_sqlite(spark, tmp_path):
    path = tmp_path / "a.db"
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE event (value INTEGER NOT NULL)")
        c.executemany("INSERT INTO event VALUES (?)", [(1,), (2,), (3,)])
    p = SqliteProvider(spark, path)
    assert p.query("SELECT value FROM event WHERE value >= :minimum ORDER BY value", {"value": int}, {"minimum": 2})["value"] == (2, 3)
    for sql in ("DELETE FROM event", "PRAGMA user_version", "ATTACH ':memory:' AS x", "SELECT value AS v FROM event"):
        with pytest.raises(ty.AdmissionError):
            p.query(sql, {"value": int})


@wf.workflow(name="child", description="rows")
def child(ctx: wf.Context, *, n: int):
    return Table.from_rows(ctx.spark, {"i": int}, [{"i": i} for i in range(n)])


@wf.workflow(name="parent", description="sum of a child run")
def parent(ctx: wf.Context, *, n: int = 3, wait: ty.Duration | None = None, loud: bool = False):
    return {"total": QueryProvider(ctx.spark, catalog=ctx.run("demo", "child", n=n)).query("SELECT CAST(SUM(i) AS BIGINT) AS s FROM main")}


@wf.workflow(name="loop", description="calls itself")
def loop(ctx: wf.Context):
    ctx.run("demo", "loop")


def test_workflows(spark, tmp_path):
    store = wf.SessionStore(tmp_path)
    host = wf.Host(spark, store, {"demo": [child, parent, loop]})
    sid = store.create()
    done = host.run(sid, "demo", "parent", parent.tokens(["--n", "4", "--wait", "5ms", "--loud"]))
    assert outputs.query_outputs(spark, done.outputs, "SELECT s FROM output.total").collect()[0].s == 6
    m = store.manifest(sid, done.run_id)
    assert m["inputs"] == {"n": "4", "wait": "5000000ns", "loud": True} and len(m["child_runs"]) == 1 and m["outputs"] == ["total"]
    with pytest.raises(RecursionError):
        host.run(sid, "demo", "loop", {})
    for bad in ({"n": "4"}, {"n": True}, {"x": 1}):
        with pytest.raises(ty.AdmissionError):
            host.run(sid, "demo", "parent", bad)
    assert not list((tmp_path / sid / "scratch").iterdir())
    with store.lease(sid), pytest.raises(RuntimeError):
        store.delete(sid)
    store.delete(sid)
    record = wf.AnalysisRecord(tmp_path / "a.json")
    assert record.save(0, goal="x")["revision"] == 1
    with pytest.raises(RuntimeError):
        record.save(0, goal="y")
    assert wf.forest(["a", "b"], {"a": ["b"]}) == [{"run": "a", "children": [{"run": "b", "children": []}]}]
    with pytest.raises(ty.AdmissionError):
        wf.forest(["a", "b"], {"a": ["b"], "b": ["a"]})
