"""The read-only gate: one statement, no commands, bound relations only; parameters and names are rewritten outside of literals."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Mapping
from datetime import datetime
from decimal import Decimal

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

from ..functions import types as ty


class GateError(ty.AdmissionError):
    """SQL that the gate does not let through."""


#: Literals, quoted names and comments; the text between them is code.
_QUOTED = re.compile(r"""('(?:[^'\\]|''|\\.)*'|"(?:[^"]|"")*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/)""", re.S)
_PARAMETER = re.compile(r"\$([A-Za-z_][A-Za-z0-9_]*)")
_SERIES = re.compile(r"\bgenerate_series\s*\(", re.I)
#: Built-in functions may be called if they belong to one of these groups of Spark's registry, or are named besides. What
#: reads files, the session or the machine, or runs other code, is in none of them.
FUNCTION_GROUPS = {f"{g}_funcs" for g in "agg array bitwise collection conditional conversion csv date datetime generator hash json lambda map math predicate st string struct url variant window xml".split()} | {"operator", "operators"}
FUNCTIONS_BESIDES = {"typeof", "equal_null", "uuid", "monotonically_increasing_id", "try_add"}
FUNCTIONS_DENIED = {"read_files", "from_avro", "to_avro", "from_protobuf", "to_protobuf"}
TABLE_FUNCTIONS = {"range", "explode", "posexplode", "inline", "stack"}
ALLOWED_COMMANDS = {"DescribeRelation", "DescribeTableCommand", "ExplainCommand", "ShowTables", "ShowTablesCommand"}


def code_only(sql: str, change) -> str:
    """sql with change applied to what is neither literal nor quoted name nor comment."""
    parts = _QUOTED.split(sql)
    return "".join(p if i % 2 else change(p) for i, p in enumerate(parts))


def parameter(value: object) -> tuple[object, str]:
    """(value as Spark takes it, SQL around its placeholder)."""
    if isinstance(value, bool):
        return value, "{}"
    if isinstance(value, ty.Duration):
        return value.nanoseconds, "CAST({} AS BIGINT)"
    if isinstance(value, ty.WallClockTimestamp):
        return value.nanoseconds, "CAST({} AS BIGINT)"
    if isinstance(value, datetime):
        return ty.WallClockTimestamp.from_datetime(value).nanoseconds, "CAST({} AS BIGINT)"
    kind = type(value)
    if kind is int and value in ty.INT64:
        return value, "CAST({} AS BIGINT)"
    if kind is float and math.isfinite(value):
        return value, "{}"
    if kind is str:
        return ty.normal(value, str, "parameter"), "{}"
    if kind is bytes:
        return bytearray(value), "{}"
    if kind is Decimal and value.is_finite():
        sign, digits, exponent = value.as_tuple()
        number = "".join(map(str, digits)).lstrip("0")
        trimmed = number.rstrip("0")
        exponent += len(number) - len(trimmed)
        scale = max(-exponent, 0)
        precision = max(len(trimmed) + max(exponent, 0), scale, 1)
        if precision > 38:
            raise ty.AdmissionError(f"parameter: {value} needs more than 38 digits")
        return value, f"CAST({{}} AS DECIMAL({precision},{scale}))"
    raise ty.AdmissionError(f"parameter of type {kind.__name__} or value {value!r} is not admitted")


def bind(sql: str, params: Mapping[str, object] | None) -> tuple[str, dict[str, object]]:
    """Spark's SQL and arguments for SQL with $names."""
    given = {}
    for name, value in (params or {}).items():
        ty.check_name(name, "parameter name", devices=False)
        given[name] = parameter(value)
    used: set[str] = set()

    def put(m: re.Match) -> str:
        if m[1] not in given:
            raise GateError(f"parameter ${m[1]} has no value")
        used.add(m[1])
        return given[m[1]][1].format(f":{m[1]}")

    out = code_only(sql, lambda code: _PARAMETER.sub(put, code))
    return out, {n: given[n][0] for n in used}


def series(sql: str) -> str:
    """generate_series(a, b[, step]) as a subquery with the column value."""
    while m := _find_code(sql, _SERIES):
        code = "".join(" " * len(p) if k % 2 else p for k, p in enumerate(_QUOTED.split(sql)))
        depth, i = 1, m[1]
        while i < len(code) and depth:
            depth += {"(": 1, ")": -1}.get(code[i], 0)
            i += 1
        sql = f"{sql[: m[0]]}(SELECT explode(sequence({sql[m[1] : i - 1]})) AS value){sql[i:]}"
    return sql


def _find_code(sql: str, pattern: re.Pattern) -> tuple[int, int] | None:
    at = 0
    for i, p in enumerate(_QUOTED.split(sql)):
        if i % 2 == 0 and (m := pattern.search(p)):
            return at + m.start(), at + m.end()
        at += len(p)
    return None


def qualified(sql: str, schema: str, names: Iterable[str]) -> str:
    """schema.name as the plain view name schema__name."""
    pattern = re.compile(rf"\b{schema}\s*\.\s*({'|'.join(map(re.escape, names))})\b", re.I)
    return code_only(sql, lambda code: pattern.sub(lambda m: f"{schema}__{m[1].lower()}", code)) if names else sql


def _scala(seq) -> list:
    it, out = seq.iterator(), []
    while it.hasNext():
        out.append(it.next())
    return out


def parsed(spark: SparkSession, sql: str):
    """The parsed, unresolved plan under the settings of this very session."""
    sessions = spark._jvm.org.apache.spark.sql.classic.SparkSession
    before = sessions.getActiveSession()
    sessions.setActiveSession(spark._jsparkSession)
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    finally:
        if before.isDefined():
            sessions.setActiveSession(before.get())


def check_function(spark: SparkSession, name: str) -> None:
    """Raises unless a function may be called."""
    catalyst = spark._jvm.org.apache.spark.sql.catalyst
    info = catalyst.analysis.FunctionRegistry.builtin().lookupFunction(catalyst.FunctionIdentifier(name))
    group = info.get().getGroup() if info.isDefined() else None
    if name in FUNCTIONS_DENIED or not (group in FUNCTION_GROUPS or name in FUNCTIONS_BESIDES):
        raise GateError(f"function {name} is not allowed")


def check(spark: SparkSession, sql: str, relations: set[str]) -> tuple[str, set[str]]:
    """Simple class name of the statement's root and the bound relations it reads, once it may pass; nothing is executed.

    relations: names that may be read. The name of a WITH query counts only where it is in scope: in the queries after it
    and in the one it belongs to, and in itself if it is recursive."""
    try:
        plan = parsed(spark, sql)
    except ParseException as e:
        raise GateError(f"not one readable statement: {str(e)[:300]}") from e
    java, loader = spark._jvm.java.lang.Class, spark._jvm.Thread.currentThread().getContextClassLoader()
    kind = lambda c: java.forName(f"org.apache.spark.sql.catalyst.plans.logical.{c}", True, loader)
    commands, tree = [kind("Command"), kind("ParsedStatement")], kind("LogicalPlan")
    known = {r.lower() for r in relations}
    used: set[str] = set()
    functions: set[str] = set()

    def expressions(e, scope: frozenset) -> None:
        name = e.getClass().getSimpleName()
        if name == "UnresolvedFunction":
            called = [str(x).lower() for x in _scala(e.nameParts())]
            if len(called) > 1:
                raise GateError(f"function {'.'.join(called)} is not allowed")
            functions.add(called[0])
        if name in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            walk(e.plan(), scope)
        for c in _scala(e.children()):
            expressions(c, scope)
        if name == "InSubquery":
            expressions(e.query(), scope)

    def walk(p, scope: frozenset) -> None:
        name = p.getClass().getSimpleName().rstrip("$")
        if name not in ALLOWED_COMMANDS and any(c.isInstance(p) for c in commands):
            raise GateError(f"statement {name} is not read-only")
        if name == "UnresolvedWith":
            for cte in _scala(p.cteRelations()):
                own = str(cte._1()).lower()
                walk(cte._2(), scope | {own} if p.allowRecursion() else scope)
                scope = scope | {own}
            walk(p.child(), scope)
            return
        if name in ("UnresolvedRelation", "UnresolvedTableOrView"):
            wanted = ".".join(str(x) for x in _scala(p.multipartIdentifier())).lower()
            if wanted not in scope:
                if wanted not in known:
                    raise GateError(f"relation {wanted} is not bound")
                used.add(wanted)
        if name == "UnresolvedTableValuedFunction":
            called = [str(x).lower() for x in _scala(p.name())]
            if called[-1] not in TABLE_FUNCTIONS:
                raise GateError(f"table function {called[-1]} is not allowed")
        for c in (*_scala(p.children()), *_scala(p.innerChildren())):
            if tree.isInstance(c):
                walk(c, scope)
        for e in _scala(p.expressions()):
            expressions(e, scope)
        if name == "ExplainCommand":
            walk(p.logicalPlan(), scope)

    walk(plan, frozenset())
    for f in sorted(functions):
        check_function(spark, f)
    return plan.getClass().getSimpleName().rstrip("$"), used
