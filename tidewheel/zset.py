"""Weighted collections: a DataFrame with a signed weight column.

A collection maps records to integer weights; inserts weigh +1, deletes -1, and
a change of a collection is a collection.  Batch operators keep the column
``__w`` in step.  Records are equal if all columns but the weight are (NaN equals
NaN, null equals null); maps can't be compared, so columns of map type must be
turned into sorted arrays of entries first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

W = "__w"


def weighted(df: DataFrame, weight: Column | int = 1) -> DataFrame:
    """Gives every row a weight (1 unless given); a weight column that is there is kept."""
    if W in df.columns:
        return df
    return df.withColumn(W, (weight if isinstance(weight, Column) else F.lit(weight)).cast("bigint"))


def data_columns(df: DataFrame) -> list[str]:
    """The columns of the record."""
    return [c for c in df.columns if c != W]


def consolidate(df: DataFrame) -> DataFrame:
    """One row per record with the sum of its weights; records of weight 0 vanish."""
    return df.groupBy(*[F.col(f"`{c}`") for c in data_columns(df)]).agg(F.sum(W).alias(W)).where(F.col(W) != 0)


def neg(df: DataFrame) -> DataFrame:
    """All weights with the other sign."""
    return df.withColumn(W, -F.col(W))


def plus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Weights add up (UNION ALL)."""
    return a.unionByName(b)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Weights are subtracted; they may turn negative (this is not EXCEPT ALL)."""
    return plus(a, neg(b))


def sum_of(parts: Sequence[DataFrame]) -> DataFrame:
    """The sum of any number of collections of the same columns."""
    return reduce(plus, parts)


def distinct(df: DataFrame) -> DataFrame:
    """Records of positive weight, with weight 1."""
    return consolidate(df).where(F.col(W) > 0).withColumn(W, F.lit(1).cast("bigint"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Set union."""
    return distinct(plus(distinct(a), distinct(b)))


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records of a that are not in b, as sets."""
    return distinct(minus(distinct(a), distinct(b)))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records in both, as sets: an equi-join on the whole record."""
    left, right = distinct(a), distinct(b)
    cond = [left[c].eqNullSafe(right[c]) for c in data_columns(a)]
    return left.join(right, cond, "left_semi")


def weigh(df: DataFrame, keys: Sequence[str], by: Column) -> DataFrame:
    """Per key the weight sum(by * weight); keys of weight 0 vanish."""
    return df.groupBy(*keys).agg(F.sum(by * F.col(W)).alias(W)).where(F.col(W) != 0)


def expanded(df: DataFrame) -> DataFrame:
    """Plain rows: each record as often as it weighs (records of negative weight are an error)."""
    checked = F.when(F.col(W) < 0, F.raise_error(F.lit("a record of negative weight has no rows"))).otherwise(F.col(W)).cast("int")
    return df.withColumn("__n", F.explode(F.array_repeat(F.lit(1), checked))).drop("__n", W)
