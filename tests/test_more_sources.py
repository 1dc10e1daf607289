"""Plain trace text, what a PostgreSQL driver returns, and the fixture for authors of workflows."""

import datetime as dt
from decimal import Decimal

import pyarrow as pa
import pytest

from tracemill.functions import types as ty
from tracemill.operators import workflow as wf
from tracemill.operators.table import Table
from tracemill.operators.testing import workflow_runner
from tracemill.sources import postgresql, tracefs
from tracemill.sources.ftrace import TraceError

TEXT = """# tracer: lantern
#
# entries-in-buffer/entries-written: 3/9   #P:2
#
baker oven-41 ( 40) [001] dN.2. 18.000000007: bake: tray=3: hot
mixer-a-55 (----) [000] ..... 19.25: stir: speed: 4
scale-61 [000] ..... 20: weigh:

"""


def test_plain_traces(spark, tmp_path):
    (tmp_path / "t.txt").write_text(TEXT)
    p = tracefs.TracefsProvider(spark, tmp_path / "t.txt", tmp_path / "out", " boot ")
    with pytest.raises(RuntimeError):
        p.query("SELECT 1 AS one")
    p.decode()
    assert p.query("SELECT * FROM capture").to_rows() == [{"tracer": "lantern", "clock_domain": "boot", "ticks_per_second": 10**9, "entries_in_buffer": 3, "entries_written": 9, "cpu_count": 2}]
    rows = p.query("SELECT event_index, clock_value, cpu, comm, pid, tgid, flags, event, details FROM events ORDER BY event_index").to_rows()
    assert [tuple(r.values()) for r in rows] == [
        (0, 18_000_000_007, 1, "baker oven", 41, 40, "dN.2.", "bake", "tray=3: hot"), (1, 19_250_000_000, 0, "mixer-a", 55, None, ".....", "stir", "speed: 4"), (2, 20_000_000_000, 0, "scale", 61, None, ".....", "weigh", ""),
    ]
    head = "# tracer: lantern\n# entries-in-buffer/entries-written: 3/9   #P:2\n"
    for bad in ("nonsense", "a-1 [000] . 1.0000000001: x: y", "a-99999999999999999999 [000] . 1: x: y", "a-1 [000] . 9999999999: x: y"):
        (tmp_path / "bad.txt").write_text(head + "a-1 [000] . 1: x: y\n" + bad + "\n")
        with pytest.raises(TraceError, match="line 4"):
            tracefs.decode(spark, tmp_path / "bad.txt", tmp_path / "out", "boot")
    for text in (TEXT.replace("tracer", "tracker"), TEXT.replace("#P:2", "")):
        (tmp_path / "bad.txt").write_text(text)
        with pytest.raises(TraceError, match="header"):
            tracefs.decode(spark, tmp_path / "bad.txt", tmp_path / "out", "boot")
    assert sorted(x.name for x in tmp_path.iterdir()) == ["bad.txt", "out", "t.txt"]


class Cursor:
    def __init__(self, data):
        self.data, self.seen = data, None

    def cursor(self):
        return self

    __enter__ = lambda self: self
    __exit__ = lambda self, *_: None

    def execute(self, *what):
        self.seen = what

    def fetch_arrow_table(self):
        return self.data


def test_postgresql_results(spark):
    numeric = pa.field("amount", pa.string(), metadata={"ADBC:postgresql:typname": "numeric"})
    when = dt.datetime(2024, 5, 1, 12, tzinfo=dt.timezone(dt.timedelta(hours=2)))
    data = pa.table([pa.array(["12.5", None, "-0.000000000000000001"]), pa.array([when] * 3, pa.timestamp("us", tz="Europe/Berlin")), pa.array([1, 2, 3])], schema=pa.schema([numeric, ("at", pa.timestamp("us", tz="Europe/Berlin")), ("n", pa.int64())]))
    c = Cursor(data)
    got = postgresql.rows(spark, c, "select 1", [5]).to_rows()
    assert c.seen == ("select 1", (5,)) and [r["amount"] for r in got] == [Decimal("12.5"), None, Decimal("-1E-18")] and str(got[0]["at"]) == "2024-05-01T10:00:00.000000000Z"
    for bad in (pa.table([pa.array(["1E-19"])], schema=pa.schema([numeric])), pa.table([pa.array(["NaN"])], schema=pa.schema([numeric])), pa.table({"t": pa.array([0], pa.timestamp("us"))}), pa.table({"t": pa.array([1 << 60], pa.timestamp("s", tz="UTC"))})):
        with pytest.raises(ty.AdmissionError):
            postgresql.normalised(bad)
    for bad in ({"a": 1}, "text", b"x", [[1]], [{"a": 1}], 5):
        with pytest.raises(TypeError):
            postgresql.positional(bad)
    assert postgresql.positional(None) == () and postgresql.positional(("a", None, 2)) == ("a", None, 2)


@wf.workflow(name="count-up", description="numbers")
def count_up(ctx: wf.Context, *, n: int = 2):
    if n < 0:
        raise ValueError("too few")
    return {"numbers": Table.from_rows(ctx.spark, {"i": int}, [{"i": i} for i in range(n)]), "none": Table.from_rows(ctx.spark, {"i": int}, [])}


run_workflow = workflow_runner({"demo": [count_up]})


def test_fixture_for_workflows(run_workflow):
    got = run_workflow(workflow="count-up", arguments=["--n", "3"])
    assert sorted(got["numbers"].column("i").to_pylist()) == [0, 1, 2] and got["none"].num_rows == 0
    assert run_workflow(workflow="count-up")["numbers"].num_rows == 2
    with pytest.raises(pytest.fail.Exception, match="too few"):
        run_workflow(workflow="count-up", arguments=["--n", "-1"])
