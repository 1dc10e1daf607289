"""Personal data with DataFrame functions only: pattern spans, and terms that reveal protected entities.

Base spans are what the four patterns match, leftmost and without overlap within a kind, less those that fail
their test. The patterns below are written so that they match the same without backtracking: an address or number
that could only begin inside a run of its own first characters is looked for at the run's begin, or where the last
match ended.

Information-theoretic sanitisation: the values of the base spans are the protected entities, lines of text the
contexts. For an entity c and a term t of its lines, PMI(c; t) / IC(c) = log(n_ct N / (n_c n_t)) / log(N / n_c) says
how much of the entity's information t gives away (1: t occurs with c only). Counts cover all lines
of the corpus. An entity or term that occurs once is judged like any other: there is no floor of documents or lines. Numbers and
single cased letters are not terms. A term
at or over `threshold` is disclosing: wherever it stands in a line, it is a span of kind `term`, to be generalised or removed.

Defined results: null and empty texts have no spans; base_sha256 is then that of the empty string; repeated rows count
as documents of their own; a match that fails its test is dropped and not tried again from inside; null and repeated ids come back as
they are; two spans that begin at one place are listed by kind; an empty table gives an empty result; texts of any length are read whole,
in time that grows with their length and with n log n of their n matches; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, with_row_id, written

KINDS = ("email", "ip", "card", "phone", "term")
THRESHOLD = 0.9
#: So many ids or terms are broadcast at most (a term of a text is short: some 40 MB); beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000

_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that every text with a match passes.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\")


def luhn(digits: str) -> str:
    return (
        f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + case when i % 2 = 1 then cast(substring({digits}, length({digits}) - i + 1, 1) as int) "
        f"else case when cast(substring({digits}, length({digits}) - i + 1, 1) as int) > 4 then 2 * cast(substring({digits}, length({digits}) - i + 1, 1) as int) - 9 else 2 * cast(substring({digits}, length({digits}) - i + 1, 1) as int) end end) % 10 = 0"
    )


def valid(kind: str) -> str:
    """SQL condition on a match m."""
    digits = "regexp_replace(m, '[^0-9]', '')"
    if kind == "ip":
        return "m rlike '^(0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])\\\\.){3}0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$'"
    if kind == "card":
        return f"case when length({digits}) between 14 and 19 then {luhn(digits)} else false end"
    if kind == "phone":
        return f"length({digits}) between 10 and 15"
    return "true"


NO_SPANS = "cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)"


def running(array: str, step: str) -> str:
    """SQL array of step(x, y) folded over every prefix of an array, in log2(size) rounds of which each doubles the reach."""
    back = "shiftleft(1, k)"
    once = f"transform(a, (x, i) -> case when i >= {back} then {step.format(x='x', y=f'get(a, i - {back})')} else x end)"
    return f"aggregate(sequence(0, cast(ceil(log2(greatest(size({array}), 2))) as int)), {array}, (a, k) -> {once})"


def located(text: str, pattern: str, kind: int, test: str) -> str:
    """SQL array of (start, kind, end, value): the matches of pattern in text that pass test, from the pieces between them."""
    both = f"named_struct('p', split({text}, {pattern}, -1), 'v', regexp_extract_all({text}, {pattern}, 0))"
    ends = running("transform(z.v, (v, i) -> length(v) + length(get(z.p, i)))", "{x} + {y}")
    spans = f"zip_with(z.v, {ends}, (v, e) -> named_struct('start', e - length(v), 'kind', {kind}, 'end', e, 'value', v))"
    # The array of one binds what would otherwise be matched several times.
    return f"filter(transform(array({both}), z -> case when size(z.v) = 0 then {NO_SPANS} else {spans} end)[0], s -> exists(array(s.value), m -> {test}))"


def base_spans(text: str) -> Column:
    """All base spans of a text column, by start and then kind."""
    parts = []
    for i, kind in enumerate(KINDS[:4]):
        hint = f"contains({text}, '@')" if kind == "email" else f"{text} rlike '{_sql(HINTS[kind])}'"
        parts.append(f"case when {hint} then {located(text, chr(39) + _sql(PATTERNS[kind]) + chr(39), i, valid(kind))} else {NO_SPANS} end")
    return F.expr(f"array_sort(concat({', '.join(parts)}))")


def joined(spans: str) -> Column:
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(array({kinds})[s.kind], ':', s.start, ':', s.end)), ',')")


WORDS = r"split(lower({0}), '[^\\p{{L}}\\p{{N}}]+')"


def small(ids: DataFrame) -> DataFrame:
    """ids, a written table of an id or a term a row, marked for broadcast if its rows are counted few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def disclosing(rows: DataFrame, base: DataFrame, threshold: float = THRESHOLD) -> DataFrame | None:
    """entity, term and risk of the terms that disclose, a written table; None if nothing is protected.

    rows: _rid, text; base: _rid, spans."""
    held = written(base.filter("size(spans) > 0").select("_rid"), "holders")
    if held.isEmpty():
        dropped(held)
        return None
    own = rows.join(small(held), "_rid", "left_semi")
    lines = own.select("_rid", F.explode(F.expr("split(text, '\\n', -1)")).alias("l")).select("_rid", "l", base_spans("l").alias("s")).filter("size(s) > 0")
    values = "array_join(transform(s, x -> x.value), ' ')"
    terms = F.expr(f"filter({WORDS.format('l')}, w -> w <> '' and not w rlike '^([0-9]+|[\\\\p{{Lu}}\\\\p{{Ll}}])$')")
    parts = F.expr(WORDS.format(values))  # what the entities themselves are made of
    contexts = written(lines.select("_rid", F.expr("array_distinct(transform(s, x -> x.value))").alias("values"), F.array_except(terms, parts).alias("terms")), "contexts")
    each = contexts.select(F.explode("values").alias("entity"), "terms")
    n_c = each.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"))
    joint = written(each.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_ct")), "joint")
    cand = written(joint.select("term").distinct(), "terms")
    total = rows.select(F.sum(F.expr("cast(size(split(text, '\\n', -1)) as bigint)")).alias("n")).first().n
    every = rows.select(F.explode(F.expr("split(text, '\\n', -1)")).alias("l")).select(F.explode_outer(F.expr(f"array_distinct({WORDS.format('l')})")).alias("term"))
    few = cand.count() <= BROADCAST_ROWS
    # Beyond the broadcast the words are counted before they meet the terms, so that a frequent one is no hot key.
    n_t = (every.join(F.broadcast(cand), "term", "left_semi") if few else every).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    n = F.lit(float(total))
    risk = joint.join(n_c, "entity").join(n_t, "term").filter(F.col("n_c") < n)
    risk = risk.withColumn("risk", F.log(F.col("n_ct") * n / (F.col("n_c") * F.col("n_t"))) / F.log(n / F.col("n_c"))).filter(F.col("risk") >= threshold)
    risk = written(risk.select("entity", "term", "risk"), "risk")
    dropped(held, contexts, joint, cand)
    return risk


def spans(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """_rid, doc_id, base and extra (arrays of start, kind, end, value; kind is a number in KINDS) of every row of docs."""
    rows = with_row_id(docs, keep=("doc_id", "text")).withColumn("text", F.coalesce("text", F.lit("")))
    base = written(rows.select("_rid", "doc_id", base_spans("text").alias("spans")), "base-spans")
    risk = disclosing(rows.select("_rid", "text"), base.select("_rid", "spans"), threshold)
    none = F.expr(NO_SPANS)
    if risk is None:
        return base.select("_rid", "doc_id", F.col("spans").alias("base"), none.alias("extra"))
    bad = written(risk.select("term").distinct(), "bad-terms")
    words = rows.select("_rid", F.explode_outer(F.expr(f"array_distinct({WORDS.format('text')})")).alias("term"))
    # A term that discloses is rare: it stands in n_t <= n_c N^(1 - threshold) lines, so no term is a hot key here.
    spots = written(words.join(small(bad), "term").groupBy("_rid").agg(F.collect_set("term").alias("terms")), "spots")
    pattern = r"concat('(?iu)(?<![\\p{L}\\p{N}])(?:', array_join(terms, '|'), ')(?![\\p{L}\\p{N}])')"
    if (spots.agg(F.sum(F.size("terms"))).first()[0] or 0) <= BROADCAST_ROWS:
        ids, texts, near = None, rows.select("_rid", "text"), F.broadcast(spots)
    else:  # only the texts with such a term are moved to meet their terms
        ids = written(spots.select("_rid"), "spot-rows")
        texts, near = rows.select("_rid", "text").join(small(ids), "_rid", "left_semi"), spots
    extra = texts.join(near, "_rid").select("_rid", F.expr(located("text", pattern, 4, "true")).alias("extra"))
    out = written(base.join(extra, "_rid", "left").select("_rid", "doc_id", F.col("spans").alias("base"), F.coalesce("extra", none).alias("extra")), "spans")
    dropped(base, risk, bad, spots, *([ids] if ids is not None else []))
    return out


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of every row of docs (columns doc_id, text)."""
    got = spans(docs)
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    every = got.withColumn("every", F.array_sort(F.concat("base", "extra")))
    return every.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("every").alias("spans"), F.size("extra").cast("long").alias("n_term"),
    )


def sanitised(docs: DataFrame, generalise: bool = True) -> DataFrame:
    """doc_id and text of every row; each run of overlapping spans is replaced by the kind of its first in brackets, or removed."""
    rows = with_row_id(docs, keep=("doc_id", "text"))
    got = spans(rows.select(F.col("_rid").alias("doc_id"), "text")).select(F.col("doc_id").alias("_rid"), F.array_sort(F.concat("base", "extra")).alias("every"))
    reach = F.expr(running("transform(every, s -> s.end)", "greatest({x}, {y})"))
    both = rows.join(got, "_rid").withColumn("reach", F.when(F.size("every") > 0, reach))
    put = "concat('[', array('EMAIL', 'IP', 'CARD', 'PHONE', 'TERM')[s.kind], ']')" if generalise else "''"
    last = "coalesce(get(reach, i - 1), 0)"
    parts = f"transform(every, (s, i) -> case when i > 0 and s.start < {last} then '' else concat(substring(text, {last} + 1, s.start - {last}), {put}) end)"
    clean = F.expr(f"concat(array_join({parts}, ''), substring(text, element_at(reach, -1) + 1, length(text)))")
    return both.select("doc_id", F.when(F.col("text").isNull() | (F.size("every") == 0), F.col("text")).otherwise(clean).alias("text"))
