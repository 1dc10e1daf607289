"""URL filters over dated lists with DataFrame functions only.

A list is a history: an entry says from when on a host name (and the names below it) is blocked, allowed or no
longer listed. The entries of a name become validity intervals, each ending where the next begins; an as-of join then
finds for every capture the interval that holds its fetch time. Captures and intervals meet on name and month, so
that a name with many captures or a long history is spread over the months, and at most one interval of a name holds any moment. Of
several names of a host that are listed the longest decides.

Defined results: null, empty or malformed URLs have a null host and verdict `none`, as has a null fetch time; of entries
for one name at one moment the strictest counts (block, allow, clear); entries with a null name, moment or action are no
entries; repeated captures give equal rows; an empty list gives `none` everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import with_row_id

ACTIONS = ("block", "allow", "clear")


def host(url: Column) -> Column:
    """Lower-case host of an absolute URL without user, port and trailing dot; null if there is none."""
    got = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    got = F.regexp_replace(got, r"\.+$", "")
    return F.when(got == "", None).otherwise(got)


def intervals(entries: DataFrame) -> DataFrame:
    """name, action, since, until (null: open) of entries (name, at, action); `clear` only ends what was before."""
    known = entries.filter(F.col("name").isNotNull() & F.col("at").isNotNull() & F.col("action").isin(*ACTIONS))
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    one = known.groupBy(F.lower("name").alias("name"), "at").agg(F.min(rank).alias("r"))
    nxt = F.lead("at").over(Window.partitionBy("name").orderBy("at"))
    spans = one.select("name", F.col("at").alias("since"), nxt.alias("until"), F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("r").cast("int")).alias("action"))
    return spans.filter("action <> 'clear'")


def month(at: Column) -> Column:
    return F.year(at) * 12 + F.month(at)


def verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, host, fetched_at, verdict (block, allow, none), listed_name and listed_since of captures (page_id, url, fetched_at)."""
    rows = with_row_id(captures, "page_id", keep=("page_id", "url", "fetched_at")).withColumn("host", host(F.col("url")))
    labels = F.split("host", r"\.")
    names = F.expr("transform(sequence(0, size(labels) - 1), i -> array_join(slice(labels, i + 1, size(labels)), '.'))")
    keys = rows.filter(F.col("host").isNotNull() & F.col("fetched_at").isNotNull()).withColumn("labels", labels)
    keys = keys.select("_rid", "fetched_at", month(F.col("fetched_at")).alias("month"), F.explode(names).alias("name"))
    span = captures.agg(F.min("fetched_at").alias("lo"), F.max("fetched_at").alias("hi")).first()
    if span.lo is None:
        found = None
    else:
        lo, hi = F.lit(span.lo), F.lit(span.hi)
        active = intervals(entries).filter((F.col("since") <= hi) & (F.col("until").isNull() | (F.col("until") > lo)))
        months = F.sequence(month(F.greatest("since", lo)), month(F.least(F.coalesce("until", hi), hi)))
        active = active.select(F.col("name").alias("listed"), "since", "until", "action", F.explode(months).alias("m"))
        hits = keys.join(active, (F.col("name") == F.col("listed")) & (F.col("month") == F.col("m")) & (F.col("since") <= F.col("fetched_at")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until"))))
        found = hits.groupBy("_rid").agg(F.max(F.struct(F.length("listed").alias("n"), "listed", "action", "since")).alias("w"))
    if found is None:
        out = rows.withColumn("w", F.lit(None).cast("struct<n:int,listed:string,action:string,since:timestamp>"))
    else:
        out = rows.join(found, "_rid", "left")
    return out.select("page_id", "url", "host", "fetched_at", F.coalesce("w.action", F.lit("none")).alias("verdict"), F.col("w.listed").alias("listed_name"), F.col("w.since").alias("listed_since"))


def sample_captures(pages: DataFrame) -> DataFrame:
    """Captures for tables that carry no fetch time: page_id spreads them over the days of 2024."""
    day = F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).cast("timestamp").alias("fetched_at"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """A list history for such tables: by the md5 of its name every third host is listed, and changes twice in 2024.

    Domains of two labels are listed likewise, so that the longest name has to win."""
    hosts = pages.select(host(F.col("url")).alias("name")).filter("name is not null")
    names = hosts.union(hosts.select(F.regexp_extract("name", r"([^.]+\.[^.]+)$", 1))).filter("name <> ''").distinct()
    digit = lambda at: F.conv(F.substring(F.md5("name"), at, 4), 16, 10).cast("int")
    listed = names.filter(F.pmod(digit(1), F.lit(3)) == 0).withColumn("first", F.pmod(digit(5), F.lit(300))).withColumn("gap", F.pmod(digit(9), F.lit(90)) + 1)
    steps = F.array(
        F.struct(F.col("first").alias("d"), F.when(F.pmod(digit(13), F.lit(2)) == 0, "block").otherwise("allow").alias("action")),
        F.struct((F.col("first") + F.col("gap")).alias("d"), F.lit("clear").alias("action")),
        F.struct((F.col("first") + 2 * F.col("gap")).alias("d"), F.lit("block").alias("action")),
    )
    each = listed.select("name", F.explode(steps).alias("s"))
    return each.select("name", F.date_add(F.lit("2024-01-01").cast("date"), F.col("s.d")).cast("timestamp").alias("at"), F.col("s.action").alias("action"))


SQL = r"""
with p as (
  select page_id, url, nullif(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.+$', ''), '') as host,
         cast(date '2024-01-01' + cast((page_id * 37) % 366 as integer) as timestamp) as fetched_at
  from pages),
names as (
  select distinct name from (
    select host as name from p where host is not null
    union all select regexp_extract(host, '([^.]+\.[^.]+)$', 1) from p where host is not null) where name <> ''),
h as (
  select name, cast('0x' || substr(md5(name), 1, 4) as integer) as a, cast('0x' || substr(md5(name), 5, 4) as integer) % 300 as first,
         cast('0x' || substr(md5(name), 9, 4) as integer) % 90 + 1 as gap, cast('0x' || substr(md5(name), 13, 4) as integer) as b from names),
entries as (
  select name, first as d, case when b % 2 = 0 then 'block' else 'allow' end as action from h where a % 3 = 0
  union all select name, first + gap, 'clear' from h where a % 3 = 0
  union all select name, first + 2 * gap, 'block' from h where a % 3 = 0),
spans as (
  select name, action, cast(date '2024-01-01' + d as timestamp) as since,
         lead(cast(date '2024-01-01' + d as timestamp)) over (partition by name order by d) as until from entries),
hits as (
  select p.page_id, s.name, s.action, s.since, row_number() over (partition by p.page_id order by length(s.name) desc, s.name desc) as k
  from p join spans s on (p.host = s.name or ends_with(p.host, '.' || s.name)) and s.action <> 'clear'
   and s.since <= p.fetched_at and (s.until is null or p.fetched_at < s.until))
select p.page_id, p.url, p.host, p.fetched_at, coalesce(t.action, 'none') as verdict, t.name as listed_name, t.since as listed_since
from p left join hits t on t.page_id = p.page_id and t.k = 1
"""
