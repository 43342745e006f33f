"""Scalar functions as Column expressions (nulls give null unless stated).

Everything runs in the JVM but for the Unicode normalization tests, which Spark
lacks; those are Arrow-batched and look at each distinct text of a batch once.
"""

from __future__ import annotations

import math
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# arithmetic


def _div(a: Column, b: Column) -> Column:
    """Integer quotient cut towards zero, exact for long integers."""
    return F.call_function("div", a, b)


def div_floor(a: Column, b: Column) -> Column:
    """Integer quotient rounded down, exact for long integers and any sign."""
    q = _div(a, b)
    return F.when((a % b != 0) & ((a < 0) != (b < 0)), q - 1).otherwise(q)


def mod_floor(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor."""
    r = a % b
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def mod_euclid(a: Column, b: Column) -> Column:
    """Remainder that is never negative."""
    return F.pmod(a, F.abs(b))


def trunc(x: Column) -> Column:
    """Towards zero, as a double."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def fdim(x: Column, y: Column) -> Column:
    return F.greatest(x - y, F.lit(0.0))


def exp2(x: Column) -> Column:
    return F.pow(F.lit(2.0), x)


def exp10(x: Column) -> Column:
    return F.pow(F.lit(10.0), x)


def ln(x: Column) -> Column:
    """Natural logarithm with -inf at 0 and NaN below, where Spark has null."""
    x = x.cast("double")
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.log(x))


def lgamma(x: Column) -> Column:
    """ln |gamma(x)|; infinite at 0 and negative integers, NaN for NaN."""
    x = x.cast("double")
    pi, infinite = F.lit(math.pi), F.lit(float("inf"))

    def positive(v: Column) -> Column:
        """For v > 0: shifted up by eight, where the asymptotic series is exact enough."""
        z = v + 8
        r = 1 / (z * z)
        series = (((((r * F.lit(-691.0 / 360360) + F.lit(1.0 / 1188)) * r - F.lit(1.0 / 1680)) * r + F.lit(1.0 / 1260)) * r - F.lit(1.0 / 360)) * r + F.lit(1.0 / 12)) / z
        down = F.lit(1.0)
        for k in range(8):
            down = down * (v + k)
        small = (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series - F.log(down)
        return F.when(v > 1e15, v * (F.log(v) - 1)).otherwise(small)

    mirrored = F.log(pi) - F.log(F.abs(F.sin(pi * (x - F.floor(x))))) - positive(1 - x)
    return F.when(F.isnan(x), x).when(F.abs(x) == infinite, infinite).when((x <= 0) & (x == F.floor(x)), infinite).when(x > 0, positive(x)).otherwise(mirrored)


def tgamma(x: Column) -> Column:
    """gamma(x); exact for integers up to 20, NaN at negative integers, infinite at 0 and beyond 171.6."""
    x = x.cast("double")
    whole = (x == F.floor(x)) & x.between(1, 20)
    sign = F.when((x < 0) & (F.pmod(F.floor(x), F.lit(2)) == 1), -1.0).otherwise(1.0)
    value = F.when(whole, F.factorial((F.when(whole, x).otherwise(1) - 1).cast("int")).cast("double")).otherwise(sign * F.exp(lgamma(x)))
    return F.when(F.isnan(x) | (x == F.lit(float("-inf"))), F.lit(float("nan"))).when((x < 0) & (x == F.floor(x)), F.lit(float("nan"))).when(x > 171.7, F.lit(float("inf"))).otherwise(value)


def is_power_of_two(x: Column) -> Column:
    return (x > 0) & (F.bit_count(x) == 1)


def is_sign_negative(x: Column) -> Column:
    """Also true of -0.0."""
    return x.cast("string").startswith("-")


def is_sign_positive(x: Column) -> Column:
    return ~is_sign_negative(x)


# bits (width in bits of the integer type)


def _bits(x: Column, width: int) -> Column:
    """The two's complement of ``width`` binary digits."""
    return F.substring(F.lpad(F.bin(x.cast("bigint")), 64, "0"), 65 - width, width)


def count_ones(x: Column, width: int = 64) -> Column:
    return F.length(F.replace(_bits(x, width), F.lit("0"), F.lit("")))


def count_zeroes(x: Column, width: int = 64) -> Column:
    return F.lit(width) - count_ones(x, width)


def leading_zeroes(x: Column, width: int = 64) -> Column:
    return F.length(F.regexp_extract(_bits(x, width), "^(0*)", 1))


def leading_ones(x: Column, width: int = 64) -> Column:
    return F.length(F.regexp_extract(_bits(x, width), "^(1*)", 1))


def trailing_zeroes(x: Column, width: int = 64) -> Column:
    return F.length(F.regexp_extract(_bits(x, width), "(0*)$", 1))


def trailing_ones(x: Column, width: int = 64) -> Column:
    return F.length(F.regexp_extract(_bits(x, width), "(1*)$", 1))


def _from_bits(digits: Column, width: int) -> Column:
    """Two's complement digits to a signed long."""
    low = F.conv(F.substring(digits, 2, width - 1), 2, 10).cast("bigint")
    top = F.when(F.substring(digits, 1, 1) == "1", F.lit(-(2 ** (width - 1)))).otherwise(F.lit(0)).cast("bigint")
    return low + top


def bit_reverse(x: Column, width: int = 64) -> Column:
    return _from_bits(F.reverse(_bits(x, width)), width)


def byte_reverse(x: Column, width: int = 64) -> Column:
    b = _bits(x, width)
    return _from_bits(F.concat(*[F.substring(b, width - 7 - 8 * i, 8) for i in range(width // 8)]), width)


def xor(a: Column, b: Column) -> Column:
    """Exclusive or of booleans."""
    return a != b


_INTEGERS, _FLOATS = ("tinyint", "smallint", "int", "bigint"), ("float", "double")


def cast_checked(c: Column, source: str, target: str) -> Column:
    """A cast that the type rules allow; others are a TypeError when the plan is built.

    Allowed: between numbers (floats to integers cut towards zero), booleans to
    integers, dates to and from days, timestamps to and from milliseconds since 1970.
    Texts are never cast, nothing becomes a boolean, and floats become no times.
    """
    numbers = _INTEGERS + _FLOATS
    if source == target or (source in numbers and target in numbers) or (source == "boolean" and target in _INTEGERS):
        return c.cast(target)
    if source == "date" and target in _INTEGERS:
        return F.unix_date(c).cast(target)
    if source in _INTEGERS and target == "date":
        return F.date_from_unix_date(c.cast("int"))
    if source == "timestamp" and target in _INTEGERS:
        return F.unix_millis(c).cast(target)
    if source in _INTEGERS and target == "timestamp":
        return F.timestamp_millis(c.cast("bigint"))
    raise TypeError(f"no cast from {source} to {target}")


# strings


def truncate_bytes(s: Column, n: int) -> Column:
    """The first n bytes; a character that is cut in half is dropped."""
    whole = F.substring(F.encode(s, "utf-8"), 1, n)
    return F.coalesce(*[F.try_validate_utf8(F.substring(whole, 1, n - k).cast("string")) for k in range(min(n, 3) + 1)])


def byte_length(s: Column) -> Column:
    return F.octet_length(s)


def char_length(s: Column) -> Column:
    return F.char_length(s)


def append(s: Column, value: Column) -> Column:
    """The text with a formatted value behind it."""
    return F.concat(s, value.cast("string"))


def concat(*parts: Column) -> Column:
    return F.concat(*parts)


def clear(s: Column) -> Column:
    """The empty text; null stays null."""
    return F.when(s.isNotNull(), F.lit(""))


def is_ascii(s: Column) -> Column:
    return F.octet_length(s) == F.char_length(s)


def _normal(form: str):
    @F.pandas_udf(T.BooleanType())
    def test(s: pd.Series) -> pd.Series:
        known = {v: unicodedata.is_normalized(form, v) for v in s.dropna().unique()}
        return s.map(known, na_action="ignore").astype(object)

    return test


is_nfc, is_nfd, is_nfkc, is_nfkd = (_normal(f) for f in ("NFC", "NFD", "NFKC", "NFKD"))


def is_lowercase(s: Column) -> Column:
    """All characters are lower case letters."""
    return s.rlike("\\A\\p{javaLowerCase}*\\z")


def is_uppercase(s: Column) -> Column:
    return s.rlike("\\A\\p{javaUpperCase}*\\z")


# times (timestamps count milliseconds)


def epoch(t: Column) -> Column:
    """Seconds since 1970, cut towards zero."""
    return _div(F.unix_millis(t), F.lit(1000))


def to_date(t: Column) -> Column:
    """The date by days since 1970 cut towards zero."""
    return F.date_from_unix_date(_div(F.unix_millis(t), F.lit(86_400_000)).cast("int"))


def date_epoch(d: Column) -> Column:
    return F.unix_date(d).cast("bigint") * 86_400


def millisecond(t: Column) -> Column:
    """Of the minute: seconds * 1000 and milliseconds."""
    return F.floor(F.date_part(F.lit("SECOND"), t) * 1000).cast("bigint")


def microsecond(t: Column) -> Column:
    return F.floor(F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("bigint")


def date_clock_part(d: Column) -> Column:
    """Hour, minute, second, millisecond and microsecond of a date: 0."""
    return F.when(d.isNotNull(), F.lit(0))


def decade(t: Column) -> Column:
    return _div(F.year(t), F.lit(10))


def century(t: Column) -> Column:
    return _div(F.year(t) + 99, F.lit(100))


def millennium(t: Column) -> Column:
    return _div(F.year(t) + 999, F.lit(1000))


def iso_year(t: Column) -> Column:
    return F.date_part(F.lit("YEAROFWEEK"), t)


def iso_day_of_week(t: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(t) + 1


def floor_week(t: Column) -> Column:
    """Midnight of the Sunday before or at t."""
    return F.date_trunc("day", t) - F.make_dt_interval(F.dayofweek(t) - 1)


def planar_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def abort(message: str) -> Column:
    """Fails the query when evaluated."""
    return F.raise_error(F.lit(message))
