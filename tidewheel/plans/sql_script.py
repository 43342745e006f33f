"""Scripts of CREATE TABLE and CREATE VIEW statements on Spark SQL.

Tables are bound to DataFrames by name and cast to their declared types; views
become temporary views.  Types of other dialects are mapped; comments, quoted
texts and semicolons in them are respected.  Sliding windows of counts and of
decimal sums are computed as differences of running totals (``running_frames``).
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Type names of other dialects.
TYPES = {
    "FLOAT64": "DOUBLE", "DOUBLE PRECISION": "DOUBLE", "FLOAT": "FLOAT", "REAL": "FLOAT", "INTEGER": "INT", "INT64": "BIGINT", "VARCHAR": "STRING", "TEXT": "STRING", "NUMERIC": "DECIMAL(38,10)", "TIMESTAMP": "TIMESTAMP_NTZ", "BOOL": "BOOLEAN",
}
_PIECES = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|;|[^;'\"`/-]+|.", re.S)


def statements(script: str) -> list[str]:
    """The statements of a script, without comments."""
    out, now = [], ""
    for m in _PIECES.finditer(script):
        piece = m.group(0)
        if piece == ";":
            out.append(now.strip())
            now = ""
        elif not piece.startswith(("--", "/*")):
            now += piece
    return [s for s in [*out, now.strip()] if s]


def _columns(body: str) -> list[tuple[str, str]]:
    cols, depth, now = [], 0, ""
    for ch in body + ",":
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            words = re.sub(r"\s+", " ", now.strip())
            words = re.sub(r"(?i) (NOT NULL|NULL|PRIMARY KEY|UNIQUE|DEFAULT .*|REFERENCES .*)", "", words)
            if words and not re.match(r"(?i)(PRIMARY|FOREIGN|CONSTRAINT|UNIQUE)\b", words):
                name, _, kind = words.partition(" ")
                kind = re.sub(r"(?i)varchar\(\d+\)", "STRING", kind.strip())
                cols.append((name.strip('`"'), TYPES.get(kind.upper(), kind.upper())))
            now = ""
        else:
            now += ch
    return cols


# Functions that scripts may use, as SQL: name -> (parameters, result, body).
PLANAR = {
    "ST_POINT": ("x DOUBLE, y DOUBLE", "STRUCT<x: DOUBLE, y: DOUBLE>", "named_struct('x', x, 'y', y)"),
    "ST_DISTANCE": ("a STRUCT<x: DOUBLE, y: DOUBLE>, b STRUCT<x: DOUBLE, y: DOUBLE>", "DOUBLE", "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"),
}


def register_functions(spark: SparkSession, functions: Mapping[str, tuple[str, str, str]] = {}) -> None:  # noqa: B006
    """Registers the planar functions and others given as SQL; their bodies are inlined into plans."""
    for name, (parameters, result, body) in {**PLANAR, **functions}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")


_SLIDING = re.compile(
    r"\s*PARTITION\s+BY\s+(?P<keys>.+?)\s+ORDER\s+BY\s+(?P<at>[\w`.]+)\s+RANGE\s+BETWEEN\s+(?P<lo>\d+)\s+PRECEDING\s+AND\s+(?:(?P<hi>\d+)\s+(?P<side>PRECEDING|FOLLOWING)|CURRENT\s+ROW)\s*", re.I | re.S,
)
_DECIMAL = re.compile(r"\s*CAST\s*\(.*\bAS\s+DECIMAL\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)\s*\)\s*", re.I | re.S)
_LITERAL = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`")
_WHOLE = "('tinyint', 'smallint', 'int', 'bigint')"
_CARRY = 10  # digits that Spark's sums of decimals have on top


def _closing(text: str, at: int) -> int:
    """The place of the parenthesis that closes the one at ``at``; -1 if there is none.  Parentheses in quotes do not count."""
    depth, i = 0, at
    while i < len(text):
        if m := _LITERAL.match(text, i):
            i = m.end()
            continue
        depth += (text[i] == "(") - (text[i] == ")")
        if depth == 0:
            return i
        i += 1
    return -1


def _running(name: str, value: str, spec: str) -> str | None:
    m = _SLIDING.fullmatch(spec)
    decimal = _DECIMAL.fullmatch(value)
    if not m or re.match(r"\s*(DISTINCT|ALL)\b", value, re.I):
        return None
    lo, hi = -int(m["lo"]), 0 if m["hi"] is None else int(m["hi"]) * (-1 if m["side"].upper() == "PRECEDING" else 1)
    if lo > hi or (name == "sum" and (not decimal or value.find("(") < 0 or _closing(value, value.find("(")) != len(value.rstrip()) - 1 or int(decimal[1]) + _CARRY > 38)):
        return None
    over = f"PARTITION BY {m['keys']} ORDER BY {m['at']} RANGE BETWEEN UNBOUNDED PRECEDING AND "
    end = lambda n: f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}" if n else "CURRENT ROW"
    upto = lambda f, n: f"coalesce({f}({value}) OVER ({over}{end(n)}), 0)"
    # Rows without a time come first and have one another as their range.
    between = lambda f: f"({upto(f, hi)} - CASE WHEN {m['at']} IS NULL THEN 0 ELSE {upto(f, lo - 1)} END)"
    exact = between(name) if name == "count" else f"CASE WHEN {between('count')} > 0 THEN CAST({between(name)} AS DECIMAL({int(decimal[1]) + _CARRY}, {decimal[2]})) END"
    # The type of the time is known when the plan is made: only one of the two branches is left in it.
    return f"(CASE WHEN typeof({m['at']}) IN {_WHOLE} THEN {exact} ELSE {name}({value}) OVER ({spec}) END)"


def running_frames(statement: str) -> str:
    """A statement whose sliding counts and sums of decimals are differences of two frames that only grow.

    A sliding frame adds up its rows for every row anew, which is quadratic where a
    key has many rows in the range.  Only what the difference gives exactly is
    replaced: counts, and sums of values that are cast to decimals, over ranges of
    whole numbers.  Averages, sums of doubles, extremes and ranges over other types
    stay as they are written.
    """
    out, i, n = "", 0, len(statement)
    while i < n:
        if m := _LITERAL.match(statement, i):
            out, i = out + m.group(0), m.end()
            continue
        m = re.compile(r"\b(sum|count)\s*\(", re.I).match(statement, i) if i == 0 or not re.match(r"[\w.]", statement[i - 1]) else None
        done = _closing(statement, m.end() - 1) if m else -1
        over = re.compile(r"\s*OVER\s*\(", re.I).match(statement, done + 1) if done > 0 else None
        last = _closing(statement, over.end() - 1) if over else -1
        new = _running(m.group(1).lower(), statement[m.end() : done], statement[over.end() : last]) if last > 0 else None
        if new is None:
            out, i = out + statement[i], i + 1
        else:
            out, i = out + new, last + 1
    return out


def run_script(spark: SparkSession, script: str, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Runs the statements in order; returns the views by name."""
    register_functions(spark)
    bound = {k.lower(): v for k, v in tables.items()}
    views: dict[str, DataFrame] = {}
    for s in statements(script):
        if m := re.match(r"(?is)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w`\".]+)\s*\((.*)\)\s*$", s):
            name = m.group(1).strip('`"').lower()
            cols = _columns(m.group(2))
            df = bound[name] if name in bound else spark.createDataFrame([], ", ".join(f"`{c}` {k}" for c, k in cols))
            df.select(*[F.col(c).cast(k).alias(c) for c, k in cols]).createOrReplaceTempView(name)
        elif m := re.match(r"(?is)CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP\w*\s+)?VIEW\s+([\w`\".]+)\s+AS\s+(.*)$", s):
            name = m.group(1).strip('`"').lower()
            views[name] = spark.sql(running_frames(m.group(2)))
            views[name].createOrReplaceTempView(name)
        else:
            views[f"statement_{len(views)}"] = spark.sql(running_frames(s))
    return views
