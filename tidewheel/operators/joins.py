"""Joins of weighted collections: weights multiply.

``on`` names the key columns of both sides; other columns must not clash (rename
them first).  Null keys never match, as in SQL.  Which physical join runs is left
to the optimizer and its run-time statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.zset import W, data_columns, distinct

_L, _R = "__wl", "__wr"


def _sides(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    return a.withColumnRenamed(W, _L), b.withColumnRenamed(W, _R)


def equi_join(a: DataFrame, b: DataFrame, on: Sequence[str], residual: Column | str | None = None) -> DataFrame:
    """Inner join, with a further condition on the pair if given."""
    left, right = _sides(a, b)
    out = left.join(right, list(on))
    if residual is not None:
        out = out.where(residual)
    return out.withColumn(W, F.col(_L) * F.col(_R)).drop(_L, _R)


def monotonic_join(a: DataFrame, b: DataFrame, on: Sequence[str], residual: Column | str | None = None) -> DataFrame:
    """equi_join by merging: each partition of the output is in the order of the key."""
    return equi_join(a.hint("merge"), b.hint("merge"), on, residual)


def semijoin(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of a with a key in b, weighing the product of both weights (SQL's semi join if b is a set of keys)."""
    left, right = _sides(a, b.groupBy(*on).agg(F.sum(W).alias(W)).where(F.col(W) != 0))
    return left.join(right, list(on)).withColumn(W, F.col(_L) * F.col(_R)).drop(_L, _R)


def antijoin(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of a whose key is not in distinct(b); weights stay."""
    keys = distinct(b.select(*on, W)).drop(W)
    return a.join(keys, list(on), "left_anti")


def outer_join(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join; of rows without partner the missing side is null."""
    left, right = _sides(a, b)
    return left.join(right, list(on), "full_outer").withColumn(W, F.coalesce(F.col(_L), F.lit(1)) * F.coalesce(F.col(_R), F.lit(1))).drop(_L, _R)


def outer_join_default(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join; the missing side holds its types' defaults (0, empty, false) instead of nulls."""
    left, right = _sides(a, b)
    joined = left.join(right, list(on), "full_outer")
    cols = []
    for side, mark in ((a, _L), (b, _R)):
        for c in data_columns(side):
            if c not in on:
                zero = default_of(side.schema[c].dataType.simpleString())
                cols.append(F.when(F.col(mark).isNull(), zero).otherwise(F.col(c)).alias(c))
    weight = F.coalesce(F.col(_L), F.lit(1)) * F.coalesce(F.col(_R), F.lit(1))
    return joined.select(*on, *cols, weight.alias(W))


def default_of(kind: str) -> Column:
    """The default value of a Spark type."""
    if kind == "string":
        return F.lit("")
    if kind == "boolean":
        return F.lit(False)
    if kind == "date":
        return F.lit("1970-01-01").cast("date")
    if kind.startswith("timestamp"):
        return F.lit("1970-01-01 00:00:00").cast(kind)
    if kind.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")):
        return F.lit(0).cast(kind)
    return F.lit(None).cast(kind)


def range_join(a: DataFrame, b: DataFrame, lo: Column, hi: Column, key: str, width: float, on: Sequence[str] = ()) -> DataFrame:
    """Pairs whose ``key`` (of b) lies in [lo, hi) (of a).

    Both sides meet in buckets of ``width``: a row of a is copied to the buckets
    that its range touches, a row of b lies in one, so each pair is found once and
    the join is an equi-join.  Choose ``width`` near the usual length of ranges.
    """
    left, right = _sides(a, b)
    bucket = lambda c: F.floor(c.cast("double") / width)
    left = left.withColumn("__lo", lo).withColumn("__hi", hi).where("__lo < __hi")
    left = left.withColumn("__b", F.explode(F.sequence(bucket(F.col("__lo")), bucket(F.col("__hi")))))
    right = right.withColumn("__b", bucket(F.col(key)))
    out = left.join(right, [*on, "__b"]).where((F.col(key) >= F.col("__lo")) & (F.col(key) < F.col("__hi")))
    return out.withColumn(W, F.col(_L) * F.col(_R)).drop(_L, _R, "__b", "__lo", "__hi")


def div_join(a: DataFrame, b: DataFrame, on: Sequence[str], value: str, by: str, alias: str) -> DataFrame:
    """Joins and divides a value of a by one of b (ranks by degrees, for instance)."""
    left, right = _sides(a, b)
    return left.join(right, list(on)).withColumn(alias, F.col(value) / F.col(by)).withColumn(W, F.col(_L) * F.col(_R)).drop(_L, _R)


def hash_join(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """equi_join with a hint for a shuffled hash join (b is built)."""
    return equi_join(a, b.hint("shuffle_hash"), on)


def enrich_as_of_arrival(a: DataFrame, b: DataFrame, on: Sequence[str], arrived: str, known_since: str) -> DataFrame:
    """Join with a side table, keeping pairs in which the side row was known when the row arrived."""
    return equi_join(a, b, on, F.col(arrived) >= F.col(known_since))
