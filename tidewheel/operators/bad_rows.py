"""Loading delimited records while setting broken ones aside, with the reason.

A record is cut into cells with SQL expressions only, in time linear in its
length: the text between quotes has its commas masked, so one split gives the
fields.  The cells of valid layout are exploded into (row, column, value) for
the columns that have a rule, joined with the rule table, checked, and the
failures gathered per row; valid rows are what an anti-join leaves, cast to the
target types.

The rule table is a literal of a few rows (one per checked column), which bounds
its broadcast.  Only failing rows are shuffled for the errors.

Defined cases: a null record has no fields (reason ``columns``); a final carriage
return is ignored; repeated records give one row per reason; a field that holds
only two quotes is empty; quoted fields may hold separators, line feeds and
doubled quotes; fields of other columns that do not fit their type load as null;
empty input gives no rows; further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The layout of the records and the two rules.
TRANSACTION_COLUMNS = (
    ("trans_date_trans_time", "timestamp_ntz"),
    ("cc_num", "double"),
    ("merchant", "string"),
    ("category", "string"),
    ("amt", "double"),
    ("trans_num", "string"),
    ("unix_time", "int"),
    ("merch_lat", "double"),
    ("merch_long", "double"),
    ("is_fraud", "int"),
)
TRANSACTION_RULES = ((0, "timestamp"), (4, "amount"))

# An escape that keeps any such character of the text apart: U+E000 a = itself, U+E000 b = a masked separator.
_ESC, _COMMA = "\ue000", "\ue000b"
_BLANKS = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def split_record(line: Column, sep: str = ",") -> Column:
    """array<string> of the fields, or null if the quoting is broken.

    Cut at the quotes, parts at even places lie outside of quotes.  The quoting
    is sound if the parts are odd in number and every outer part is empty (a
    doubled quote, or an end of the record) or borders its quotes with
    separators.
    """
    body = F.regexp_replace(line, "\r\\z", "")
    cut = F.split(F.replace(body, F.lit(_ESC), F.lit(_ESC + "a")), '"', -1)

    def fields_of(parts: Column) -> Column:
        n = F.size(parts)

        def sound(p: Column, i: Column) -> Column:
            return (i % 2 == 1) | (p == "") | (((i == 0) | p.startswith(sep)) & ((i == n - 1) | p.endswith(sep)))

        # Outer empty parts between two quotes are a literal quote; at the ends, nothing.
        masked = F.transform(
            parts,
            lambda p, i: F.when(i % 2 == 1, F.replace(p, F.lit(sep), F.lit(_COMMA)))
            .when((p == "") & (i > 0) & (i < n - 1), F.lit('"'))
            .otherwise(p),
        )
        fields = F.split(F.array_join(masked, ""), "\\Q" + sep + "\\E", -1)
        plain = F.transform(fields, lambda f: F.replace(F.replace(f, F.lit(_COMMA), F.lit(sep)), F.lit(_ESC + "a"), F.lit(_ESC)))
        good = (n % 2 == 1) & F.forall(F.transform(parts, sound), lambda x: x)
        return F.when(good, plain)

    # The parts are bound to a variable, so that they are cut once and not once per part.
    return F.get(F.transform(F.array(cut), fields_of), F.lit(0))


def valid_timestamp(v: Column) -> Column:
    """A real moment written YYYY-MM-DD HH:MM:SS in ASCII digits (year 1 to 9999)."""
    shape = v.rlike("\\A(?!0000)[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01]) ([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\\z")
    return F.when(shape, F.substring(v, 1, 10).try_cast("date").isNotNull()).otherwise(False)


def valid_amount(v: Column) -> Column:
    """Empty, null in any case, or a finite decimal number in ASCII; blanks around it are ignored."""
    t = trimmed(v)
    shape = t.rlike("\\A[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\z")
    finite = F.abs(t.try_cast("double")) < F.lit(float("inf"))
    return (t == "") | (F.lower(t) == "null") | (shape & F.coalesce(finite, F.lit(False)))


def trimmed(v: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(v, f"\\A{_BLANKS}+", ""), f"{_BLANKS}+\\z", "")


RULES = {"timestamp": valid_timestamp, "amount": valid_amount}


def _fields(raw: DataFrame, row_id: str, line: str) -> DataFrame:
    return raw.select(F.col(row_id).alias("row_id"), F.col(line).alias("line")).withColumn("fields", split_record(F.col("line")))


def find_errors(raw: DataFrame, row_id: str = "line_id", line: str = "line", width: int = 10, rules: Sequence[tuple[int, str]] = TRANSACTION_RULES) -> DataFrame:
    """(row_id, reason), each once: quoting, columns, or the name of a broken rule."""
    spark = raw.sparkSession
    rows = _fields(raw, row_id, line)
    layout = (
        F.when(F.col("line").isNull(), "columns").when(F.col("fields").isNull(), "quoting").when(F.size("fields") != width, "columns")
    )
    rows = rows.select("row_id", layout.alias("layout"), "fields")
    table = F.broadcast(spark.createDataFrame(list(rules), "col int, rule string"))
    cells = (
        rows.select("row_id", "layout", F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.get("fields", F.lit(c)).alias("value")) for c, _ in rules])).alias("cell"))
        .select("row_id", "layout", "cell.col", "cell.value")
        .join(table, "col")
    )
    ok = F.lit(None).cast("boolean")
    for name in {r for _, r in rules}:
        ok = F.when(F.col("rule") == name, RULES[name](F.col("value"))).otherwise(ok)
    reason = F.coalesce(F.col("layout"), F.when(~F.coalesce(ok, F.lit(False)), F.col("rule")))
    return cells.select("row_id", reason.alias("reason")).where("reason is not null").groupBy("row_id", "reason").agg(F.count(F.lit(1)).alias("n")).select("row_id", "reason")


def error_rows(errors: DataFrame) -> DataFrame:
    """One row per broken record with all its reasons, sorted."""
    return errors.groupBy("row_id").agg(F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))


def load_valid(raw: DataFrame, errors: DataFrame, row_id: str = "line_id", line: str = "line", columns: Sequence[tuple[str, str]] = TRANSACTION_COLUMNS) -> DataFrame:
    """The records without errors, typed; each ``row_id`` once."""
    good = _fields(raw, row_id, line).join(errors.select("row_id").distinct(), "row_id", "left_anti").dropDuplicates(["row_id"])

    def cell(i: int, kind: str) -> Column:
        v = F.get("fields", F.lit(i))
        if kind == "string":
            return v
        t = trimmed(v)
        return F.when((t != "") & (F.lower(t) != "null"), t.try_cast(kind))

    return good.select("row_id", *[cell(i, kind).alias(name) for i, (name, kind) in enumerate(columns)])
