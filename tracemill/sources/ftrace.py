"""Text ftrace: a header automaton on the driver, events parsed by Spark expressions, one relation for each kind of payload.

Lines keep their order in the file: every split numbers its own lines, and the counts of the splits before it, a small table,
give the offset. Nothing runs through a single task. Any malformed event head, or malformed payload of a
supported event, fails the whole decode with its line number before anything is published."""

from __future__ import annotations

import shutil
import uuid
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import types as ty
from ..operators.outputs import publish
from ..operators.provider import QueryProvider
from ..operators.table import Table
from .catalog import Catalog, open_catalog

MAX_LINE_BYTES = 1 << 20
VERSION = {"materialization.version": "text-ftrace-v1"}
U64_MAX = (1 << 64) - 1

#: The context flag legends of a header, in their order; all but migrate-disable must be there (fixed values).
LEGENDS = ("=> irqs-off", "=> need-resched", "=> hardirq/softirq", "=> preempt-depth", "=> migrate-disable")


class TraceError(ValueError):
    """A text trace that cannot be decoded."""


@dataclass(frozen=True)
class Header:
    tracer: str
    has_tgid: bool


@dataclass(frozen=True)
class Report:
    tracer: str
    unsupported_event_names: tuple[str, ...]


@dataclass(frozen=True)
class Decoded:
    header: Header
    relations: dict[str, DataFrame]
    unsupported: tuple[str, ...]


def read_header(lines: list[tuple[int, str]]) -> Header:
    """The header from the (number, text) of the `#` lines before the first event."""
    tracer, stage, tgid = None, 0, None
    for number, line in lines:
        text = line.strip().removeprefix("#").strip()
        fail = lambda why: TraceError(f"line {number}: {why}")
        if text.startswith("tracer:"):
            if tracer is not None or stage or tgid is not None:
                raise fail("the tracer stands once and first")
            tracer = text.removeprefix("tracer:").strip()
            if not tracer:
                raise fail("empty tracer")
            continue
        if text.startswith("entries-in-buffer/entries-written:"):
            continue
        found = next((i for i, mark in enumerate(LEGENDS) if mark in text), 5 if "delay" in text and "/" in text else None)
        if found is not None:
            if tracer is None:
                raise fail("flag legend before the tracer")
            if found != stage and (stage, found) != (4, 5):
                raise fail("flag legends out of order")
            stage = found + 1
        elif any(word in text for word in ("TASK-PID", "CPU#", "TIMESTAMP", "FUNCTION")):
            at = [text.find(word) for word in ("TASK-PID", "CPU#", "TIMESTAMP", "FUNCTION")]
            if tgid is not None or stage != 6 or -1 in at or at != sorted(at):
                raise fail("invalid column header")
            group = text.find("TGID")
            if group >= 0 and not at[0] < group < at[1]:
                raise fail("TGID column out of order")
            tgid = group >= 0
    if tracer is None or stage != 6 or tgid is None:
        raise TraceError("incomplete header")
    return Header(tracer, tgid)


def told() -> Column:
    """Whether a comment (column value) is one that read_header looks at."""
    words = ["tracer:", "delay", "TASK-PID", "CPU#", "TIMESTAMP", "FUNCTION", *LEGENDS]
    return reduce(lambda x, y: x | y, [F.col("value").contains(w) for w in words])


# What parses a field: SQL that is null for a text the type cannot hold. x is the text.
I32 = "case when x rlike '^[+-]?[0-9]+$' then try_cast(x as int) end"
U32 = "case when x rlike '^[+]?[0-9]+$' and try_cast(x as decimal(38,0)) <= 4294967295 then cast(x as bigint) end"
U64 = "case when x rlike '^[+]?[0-9]+$' and try_cast(x as decimal(38,0)) <= 18446744073709551615BD then cast(x as decimal(20,0)) end"
HEX64 = "case when x rlike '^[+]?[0-9a-fA-F]+$' and length(ltrim('0', ltrim('+', x))) <= 16 then cast(conv(ltrim('+', x), 16, 10) as decimal(20,0)) end"
EITHER64 = f"case when x rlike '^0[xX]' then ({{hex}}) else ({U64}) end".format(hex=HEX64.replace("x rlike", "substring(x, 3) rlike").replace(", x)", ", substring(x, 3))"))
EITHER32 = f"case when ({EITHER64}) <= 4294967295 then cast(({EITHER64}) as bigint) end"
TEXT = "x"

_DEVICE = r"([^,: ]*)[,:]([^ ]*)"
_WAKE = (r"^comm=(.*?) pid=(.*?) prio=(.*?) target_cpu=(.*)$", (("thread_name", 1, TEXT), ("thread_id", 2, I32), ("priority", 3, I32), ("target_cpu", 4, U32)))
_PAGE = (
    r"^dev " + _DEVICE + r" ino (\S*)\s(.*)$",
    (("device_major", 1, U32), ("device_minor", 2, U32), ("inode", 3, HEX64), ("page_frame_number", "pfn", EITHER64), ("offset_bytes", "ofs", U64), ("order", "order?", U32), ("page_address", "page?", TEXT)),
)

#: Event name: pattern of the payload, and columns as (name, group or key=value field of the last group (? may lack), parser).
EVENTS: dict[str, tuple[str, tuple[tuple[str, int | str, str], ...]]] = {
    "sched_switch": (
        r"^prev_comm=(.*?) prev_pid=(.*?) prev_prio=(.*?) prev_state=(.*?) ==> next_comm=(.*?) next_pid=(.*?) next_prio=(.*)$",
        (("previous_thread_name", 1, TEXT), ("previous_thread_id", 2, I32), ("previous_priority", 3, I32), ("previous_state", 4, TEXT), ("next_thread_name", 5, TEXT), ("next_thread_id", 6, I32), ("next_priority", 7, I32)),
    ),
    "sched_wakeup": _WAKE,
    "sched_wakeup_new": _WAKE,
    "tracing_mark_write": (r"(?s)^(.*)$", (("content", 1, TEXT),)),
    "sched_blocked_reason": (r"^pid=(.*?) iowait=(.*?) caller=(.*)$", (("pid", 1, I32), ("io_wait", 2, U32), ("caller", 3, TEXT))),
    "mm_filemap_add_to_page_cache": _PAGE,
    "mm_filemap_delete_from_page_cache": _PAGE,
    "block_rq_issue": (
        r"^" + _DEVICE + r" ([^ ]*) ([^ ]*) \((.*?)\) (.*?) \+ (.*?) \[(.*)\]$",
        (("device_major", 1, U32), ("device_minor", 2, U32), ("rwbs", 3, TEXT), ("bytes", 4, U32), ("command", 5, TEXT), ("sector", 6, U64), ("sector_count", 7, U32), ("process_name", 8, TEXT)),
    ),
    "block_rq_complete": (
        r"^" + _DEVICE + r" ([^ ]*) \((.*?)\) (.*?) \+ (.*?) \[(.*)\]$",
        (("device_major", 1, U32), ("device_minor", 2, U32), ("rwbs", 3, TEXT), ("command", 4, TEXT), ("sector", 5, U64), ("sector_count", 6, U32), ("error", 7, I32)),
    ),
    "binder_transaction": (
        r"^transaction=(.*?) dest_node=(.*?) dest_proc=(.*?) dest_thread=(.*?) reply=(.*?) flags=(.*?) code=(.*)$",
        (("transaction_id", 1, I32), ("destination_node_id", 2, I32), ("destination_process_id", 3, I32), ("destination_thread_id", 4, I32), ("reply", 5, I32), ("flags", 6, EITHER32), ("code", 7, EITHER32)),
    ),
    "print": (r"(?s)^(.*?): (.*)$", (("instruction_pointer", 1, TEXT), ("content", 2, TEXT))),
}


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """n (line number from 0 over the file) and value of the lines of one file."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = raw.groupBy("block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.select("block", "first", before.alias("before"))  # a row for each split of the file
    return raw.join(F.broadcast(offsets), "block").select((F.col("before") + F.col("at") - F.col("first")).alias("n"), "value")


def parsed(x: Column | str, sql: str) -> Column:
    """The parser's SQL applied to a text column."""
    return F.element_at(F.transform(F.array(x), lambda v: v), 1) if sql == TEXT else F.expr(f"element_at(transform(array({x}), x -> {sql}), 1)")


def heads(lines: DataFrame, header: Header) -> DataFrame:
    """The common head of every event line (n, value): null in `cpu`, `clock_value`, `thread_id` or `event` where it is malformed."""
    v = lines.select("n", F.expr(r"regexp_replace(value, '^\\s+', '')").alias("v"))
    # The CPU stands behind the last " [" before the first ": ".
    split = v.withColumn("sep", F.expr("instr(v, ': ')")).withColumn("front", F.expr("case when sep > 0 then substring(v, 1, sep - 1) end"))
    cut = split.withColumn("open", F.expr("length(front) - length(substring_index(front, ' [', -1)) + 1")).withColumn("open", F.expr("case when contains(front, ' [') then open end"))
    body = cut.withColumn("inner", F.expr("substring(v, open, length(v))")).withColumn("emitter", F.expr(r"regexp_replace(substring(v, 1, open - 2), '\\s+$', '')"))
    got = body.withColumn("cpu_text", F.expr("case when contains(inner, '] ') then substring_index(inner, '] ', 1) end")).withColumn("tail", F.expr("substring(inner, length(cpu_text) + 3, length(inner))"))
    got = got.withColumn("fc", F.expr("case when contains(tail, ': ') then substring_index(tail, ': ', 1) end")).withColumn("ep", F.expr("substring(tail, length(fc) + 3, length(tail))"))
    got = got.withColumn("event", F.expr("case when contains(ep, ': ') then nullif(substring_index(ep, ': ', 1), '') end")).withColumn("payload", F.expr("substring(ep, length(event) + 3, length(ep))"))
    got = got.withColumn("context_flags", F.expr(r"nullif(regexp_extract(fc, '(?s)^(.*)\\s(\\S*)$', 1), '')")).withColumn("clock", F.expr(r"regexp_extract(fc, '(?s)^(.*)\\s(\\S*)$', 2)"))
    clock = r"case when clock rlike '^[+]?[0-9]+([.][0-9]{0,9}0*)?$' and length(substring_index(ltrim('+', clock), '.', 1)) <= 20 then cast(substring_index(ltrim('+', clock), '.', 1) as decimal(38,0)) * 1000000000 + cast(rpad(substring(regexp_extract(clock, '[.]([0-9]*)$', 1), 1, 9), 9, '0') as int) end"
    if header.has_tgid:
        thread = r"case when emitter rlike '(?s)^.* \\([^()]*\\)$' then regexp_extract(emitter, '(?s)^(.*) \\((.*)\\)$', 1) end"
        group = r"trim(regexp_extract(emitter, '(?s)^(.*) \\((.*)\\)$', 2))"
    else:
        thread, group = "emitter", "'-------'"
    got = got.withColumn("thread", F.expr(thread)).withColumn("tgid_text", F.expr(group)).withColumn("big", F.expr(clock))
    got = got.withColumn("name", F.expr(r"nullif(trim(regexp_extract(thread, '(?s)^(.*)-([^-]*)$', 1)), '')")).withColumn("tid_text", F.expr(r"trim(regexp_extract(thread, '(?s)^(.*)-([^-]*)$', 2))"))
    got = got.withColumn("cpu", parsed("cpu_text", U32)).withColumn("thread_id", parsed("tid_text", I32)).withColumn("process_id", parsed("tgid_text", I32))
    ok = F.expr("cpu is not null and context_flags is not null and event is not null and name is not null and thread_id is not null and coalesce(big, -1BD) between 0BD and 18446744073709551615BD and (process_id is not null or tgid_text = '-------')")
    return got.select("n", "event", "payload", F.expr("cast(big as decimal(20,0))").alias("clock_value"), "cpu", F.col("name").alias("emitter_thread_name"), F.col("thread_id").alias("emitter_thread_id"), F.col("process_id").alias("emitter_process_id"), "context_flags", F.coalesce(ok, F.lit(False)).alias("ok"))


def payload_columns(event: str) -> list[Column]:
    pattern, columns = EVENTS[event]
    sql = pattern.replace("\\", "\\\\").replace("'", "\\'")
    last = 4
    out = []
    for name, where, parse in columns:
        if isinstance(where, int):
            text = f"regexp_extract(payload, '{sql}', {where})"
        else:
            key = where.rstrip("?")
            text = rf"nullif(regexp_extract(regexp_extract(payload, '{sql}', {last}), '(?:^|\\s){key}=(\\S*)', 1), '')"
        out.append((F.expr(text) if parse == TEXT else parsed(text, parse)).alias(name))
    return out


def _malformed(rows: DataFrame, event: str) -> list[int]:
    """The first of the rows whose payload is malformed, if any."""
    pattern, columns = EVENTS[event]
    good = F.col("payload").rlike(pattern)
    for name, where, parse in columns:
        lacks = ~F.col("payload").rlike(rf"\s{str(where).rstrip('?')}=") if str(where).endswith("?") else F.lit(False)
        good = good & (F.col(f"_{name}").isNotNull() | lacks)
    cells = [c.alias(f"_{name}") for c, (name, _, _) in zip(payload_columns(event), columns)]
    first = rows.select("n", "payload", *cells).filter(~good).agg(F.min("n").alias("n")).first().n
    return [] if first is None else [first]


def decode_lines(events: DataFrame, header: Header, clock_domain: str) -> Decoded:
    """Relations of the event lines (n in order, value). Raises on the first malformed line; lines may have gaps in n."""
    spark = events.sparkSession
    head = heads(events, header).persist()
    facts = head.groupBy(F.when(F.col("ok"), F.col("event")).alias("event")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("first")).collect()  # a row for each event name
    if not facts:
        raise TraceError("no event record")
    bad = [r.first for r in facts if r.event is None]
    for event in EVENTS:
        if any(r.event == event for r in facts):
            bad += _malformed(head.filter(F.col("event") == event), event)
    if bad:
        raise TraceError(f"line {min(bad) + 1}: malformed event")
    seen = {r.event for r in facts}
    known = F.col("event").isin(*EVENTS)
    # Sequence numbers count all events; ids count the supported ones. Both come from ranges of lines, in order.
    order = spark_order(head.select("n", known.alias("known")))
    rows = head.filter(known).join(order, "n")
    ids = [F.col("row_id").alias("_row_id")]
    out = {
        "text_ftrace_header": spark.createDataFrame([(header.tracer, header.has_tgid)], "tracer string, has_tgid_column boolean"),
        "text_ftrace_event_occurrence": rows.select(*ids, F.col("sequence").alias("source_event_sequence")),
        "text_ftrace_event": rows.select(
            *ids, F.col("row_id").alias("_parent_row_id"), F.lit(clock_domain).alias("clock_domain"), "clock_value", "cpu", "emitter_thread_name", "emitter_thread_id", "emitter_process_id", "context_flags"
        ),
    }
    for event in EVENTS:
        if event in seen:
            per = rows.filter(F.col("event") == event)
            out[f"text_ftrace_event_{event}"] = per.select(*ids, F.col("row_id").alias("_parent_row_id"), *payload_columns(event))
    others = tuple(sorted(seen - set(EVENTS)))
    if others:
        out["text_ftrace_unsupported_event"] = spark.createDataFrame([(e,) for e in others], "event_name string")
    if not seen & set(EVENTS):
        out = {k: v for k, v in out.items() if k in ("text_ftrace_header", "text_ftrace_unsupported_event")}
    return Decoded(header, out, others)


def spark_order(lines: DataFrame, span: int = 100_000) -> DataFrame:
    """n, sequence and row_id (counts from 0 of all and of the known lines before) of lines (n, known), without one global sort."""
    block = F.floor(F.col("n") / span)
    tagged = lines.withColumn("b", block)
    sums = tagged.groupBy("b").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("known").cast("long")).alias("k"))
    w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each span of lines
    base = sums.select("b", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("c0"), F.coalesce(F.sum("k").over(w), F.lit(0)).alias("k0"))
    inner = Window.partitionBy("b").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return (
        tagged.withColumn("c1", F.count(F.lit(1)).over(inner)).withColumn("k1", F.coalesce(F.sum(F.col("known").cast("long")).over(inner), F.lit(0)))
        .join(F.broadcast(base), "b").select("n", (F.col("c0") + F.col("c1")).alias("sequence"), (F.col("k0") + F.col("k1")).alias("row_id"))
    )


def decode(spark: SparkSession, source: str | Path, destination: str | Path, clock_domain: str) -> Report:
    """Decodes one file into a folder of Parquet relations that must not exist."""
    to = Path(destination)
    if to.exists():
        raise FileExistsError(str(to))
    path = f"file://{Path(source).resolve()}"
    lines = numbered(spark, path).filter(F.trim("value") != "")
    wide = lines.filter(F.octet_length("value") >= MAX_LINE_BYTES).agg(F.min("n").alias("n")).first().n
    if wide is not None:
        raise TraceError(f"line {wide + 1}: over {MAX_LINE_BYTES} bytes")
    broken = lines.filter(F.col("value").contains("�")).agg(F.min("n").alias("n")).first().n
    if broken is not None and b"\xef\xbf\xbd" not in Path(source).read_bytes():
        raise TraceError(f"line {broken + 1}: not UTF-8")
    comment = F.expr(r"regexp_replace(value, '^\\s+', '')").startswith("#")
    first = lines.filter(~comment).agg(F.min("n").alias("n")).first().n
    early = lines.filter(comment & (F.col("n") < (first if first is not None else 1 << 62)) & told())
    # Of lines that say the same only the first two matter: the second of any kind is refused.
    rank = F.row_number().over(Window.partitionBy(F.trim("value")).orderBy("n"))
    header = read_header([(r.n + 1, r.value) for r in early.withColumn("k", rank).filter("k <= 2").orderBy("n").collect()])
    if first is None:
        raise TraceError("no event record")
    structured = F.col("value").contains("TASK-PID") | F.col("value").contains("=> irqs-off") | F.col("value").rlike(r"^\s*#+\s*tracer:")
    late = lines.filter(comment & (F.col("n") > first) & structured).agg(F.min("n").alias("n")).first().n
    if late is not None:
        raise TraceError(f"line {late + 1}: header after events")
    decoded = decode_lines(lines.filter(~comment), header, clock_domain)
    staging = to.parent / f".{to.name}-{uuid.uuid4().hex}"
    try:
        staging.mkdir(parents=True)
        for name, frame in decoded.relations.items():
            frame.write.parquet(f"file://{(staging / f'{name}.parquet').resolve()}")
        publish(staging, to)
    finally:
        shutil.rmtree(staging, ignore_errors=True)
    return Report(header.tracer, decoded.unsupported)


def source_stem(path: str | Path) -> str:
    """Name of a materialisation: the file's name less its last suffix."""
    stem = Path(path).stem
    if not stem or stem.lower() in ty.DEVICE_NAMES or stem[-1] in " ." or any(ord(c) < 32 or c in '<>:"/\\|?*' for c in stem):
        raise ty.AdmissionError(f"no usable name: {path}")
    return stem


class FtraceProvider:
    """Decodes a trace once below a folder, or reuses what is there, and answers SQL over it."""

    def __init__(self, spark: SparkSession, source: str | Path, workspace: str | Path, clock_domain: str):
        at = Path(workspace) / source_stem(source)
        self.decode_report: Report | None = None
        if not at.exists():
            try:
                self.decode_report = decode(spark, source, at, clock_domain)
            except FileExistsError:
                pass  # another one was first
        self._catalog = open_catalog(tables={p.name.removesuffix(".parquet"): p for p in sorted(at.iterdir()) if p.suffix == ".parquet"})
        self._provider = QueryProvider(spark, catalog=self._catalog)
        if "text_ftrace_event" in self._catalog.tables:
            domains = self._provider.query("SELECT DISTINCT clock_domain FROM text_ftrace_event")["clock_domain"]
            if domains != (clock_domain,):
                raise ty.AdmissionError(f"{at} has the clock domain {domains}, not {clock_domain}")

    @property
    def tables(self) -> tuple[str, ...]:
        return self._catalog.tables

    @property
    def catalog(self) -> Catalog:
        return self._catalog

    def query(self, sql: str, params: dict | None = None) -> Table:
        return self._provider.query(sql, params)
