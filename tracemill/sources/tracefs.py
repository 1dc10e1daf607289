"""Plain trace text by one pattern a line: a relation of the capture's facts and one of all events, whatever their kind.

Unlike the typed decoder (ftrace) nothing is known about an event's details; they stay text. Lines are parsed by Spark
expressions and keep their order by the numbers of their splits."""

from __future__ import annotations

import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import types as ty
from ..operators.outputs import publish
from ..operators.provider import QueryProvider
from ..operators.table import Table
from .catalog import open_catalog
from .ftrace import TraceError, numbered

TICKS = 1_000_000_000
#: An event: command and thread, group in brackets (may lack), CPU, flags, clock, name, details.
EVENT = r"^\s*(.+)-([0-9]+)\s+(?:\(\s*([0-9]+|-+)\s*\)\s+)?\[([0-9]+)\]\s+(\S+)\s+([0-9]+(?:\.[0-9]+)?):\s+([^:\s]+):\s?(.*)$"
TRACER = r"^#\s*tracer:\s*(\S.*?)\s*$"
ENTRIES = r"^#\s*entries-in-buffer/entries-written:\s*([0-9]+)/([0-9]+)\s+#P:([0-9]+)\s*$"

def _number(text: str) -> str:
    return f"try_cast({text} as bigint)"


def parsed(lines: DataFrame, clock_domain: str) -> DataFrame:
    """n and the columns of `events`, null where a value does not fit, of event lines (n, value)."""
    group = lambda i: f"regexp_extract(value, '{EVENT.replace(chr(92), chr(92) * 2)}', {i})"
    part = lines.select("n", F.col("value").rlike(EVENT).alias("ok"), *[F.expr(group(i)).alias(f"g{i}") for i in range(1, 9)])
    fraction = "substring_index(concat(g6, '.'), '.', 2)"
    seconds, digits = "substring_index(g6, '.', 1)", f"substring({fraction}, length(substring_index(g6, '.', 1)) + 2)"
    clock = f"case when length({digits}) <= 9 then try_cast(try_cast({seconds} as decimal(38,0)) * {TICKS} + cast(rpad({digits}, 9, '0') as bigint) as bigint) end"
    return part.select(
        "n", "ok", F.lit(clock_domain).alias("clock_domain"), F.expr(clock).alias("clock_value"), F.expr(_number("g4")).alias("cpu"), F.expr("trim(g1)").alias("comm"), F.expr(_number("g2")).alias("pid"),
        F.expr(f"case when g3 rlike '^[0-9]' then {_number('g3')} end").alias("tgid"), F.expr("g3 rlike '^[0-9]'").alias("has_tgid"), F.col("g5").alias("flags"), F.col("g7").alias("event"), F.col("g8").alias("details"),
    )


def last_match(comments: DataFrame, pattern: str, groups: int) -> tuple | None:
    """Groups of the last comment that matches."""
    got = comments.filter(F.col("value").rlike(pattern)).orderBy(F.desc("n")).select(*[F.regexp_extract("value", pattern, i).alias(f"g{i}") for i in range(1, groups + 1)]).first()
    return tuple(got) if got is not None else None


def decode(spark: SparkSession, source: str | Path, destination: str | Path, clock_domain: str) -> None:
    """Writes `capture` and `events` below a folder, which is replaced as a whole; any malformed line fails all of it."""
    domain = clock_domain.strip() if isinstance(clock_domain, str) else ""
    if not domain:
        raise ty.AdmissionError("a clock domain is needed")
    lines = numbered(spark, f"file://{Path(source).resolve()}").filter("value <> ''")
    rows = parsed(lines.filter(~F.col("value").startswith("#")), domain)
    bad = "not ok or clock_value is null or cpu is null or pid is null or (has_tgid and tgid is null)"
    first = rows.filter(bad).agg(F.min("n").alias("n")).first().n
    if first is not None:
        raise TraceError(f"line {first + 1}: malformed event")
    comments = lines.filter(F.col("value").startswith("#"))
    tracer, entries = last_match(comments, TRACER, 1), last_match(comments, ENTRIES, 3)
    if tracer is None or entries is None:
        raise TraceError("the header lacks the tracer" if tracer is None else "the header lacks the counts of entries")
    buffered, written, cpus = (int(x) for x in entries)
    if any(x not in ty.INT64 for x in (buffered, written, cpus)):
        raise TraceError("a count of entries is beyond 64 bits")
    capture = spark.createDataFrame([(tracer[0], domain, TICKS, buffered, written, cpus)], "tracer string, clock_domain string, ticks_per_second long, entries_in_buffer long, entries_written long, cpu_count long")
    # Numbers by spans of lines: a count for each span, and a window inside it.
    span = F.floor(F.col("n") / 100_000)
    counts = rows.groupBy(span.alias("span")).agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("span", F.coalesce(F.sum("c").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("span").orderBy("n")) - 1
    events = rows.withColumn("span", span).withColumn("k", within).join(F.broadcast(before), "span")
    events = events.select((F.col("before") + F.col("k")).alias("event_index"), "clock_domain", "clock_value", "cpu", "comm", "pid", "tgid", "flags", "event", "details")
    to = Path(destination)
    staging = to.parent / f".{to.name}-{uuid.uuid4().hex}"
    try:
        staging.mkdir(parents=True)
        for name, frame in (("capture", capture), ("events", events)):
            frame.write.parquet(f"file://{(staging / f'{name}.parquet').resolve()}")
        if to.is_symlink() or to.is_file():
            to.unlink()
        elif to.is_dir():
            shutil.rmtree(to)
        publish(staging, to)
    finally:
        shutil.rmtree(staging, ignore_errors=True)


class TracefsProvider:
    """decode() first, then SQL over `capture` and `events`."""

    def __init__(self, spark: SparkSession, source: str | Path, catalog_root: str | Path, clock_domain: str):
        self._spark, self._source, self._root, self._domain = spark, Path(source), Path(catalog_root), clock_domain
        self._provider: QueryProvider | None = None

    def decode(self) -> TracefsProvider:
        self._provider = None
        decode(self._spark, self._source, self._root, self._domain)
        self._provider = QueryProvider(self._spark, catalog=open_catalog(tables={n: self._root / f"{n}.parquet" for n in ("capture", "events")}))
        return self

    def query(self, sql: str, params: dict | None = None) -> Table:
        if self._provider is None:
            raise RuntimeError("decode() comes before query()")
        return self._provider.query(sql, params)
