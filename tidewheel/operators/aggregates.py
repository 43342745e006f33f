"""Aggregates of weighted collections.

Values count as often as they weigh; rows of weight 0 count for nothing.  A group
all of whose records cancel out is absent.  Every function takes consolidated or
unconsolidated input alike where that is stated, since weights are summed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.zset import W, consolidate, distinct


def w_count(where: Column | None = None) -> Column:
    """COUNT(*) [FILTER (WHERE ..)]: the sum of weights."""
    return F.coalesce(F.sum(F.col(W) if where is None else F.when(where, F.col(W))), F.lit(0))


def w_sum(value: Column, where: Column | None = None) -> Column:
    """SUM of value * weight."""
    return F.sum(value * F.col(W) if where is None else F.when(where, value * F.col(W)))


def w_avg(value: Column) -> Column:
    """AVG as sum over count (of integers see integer_average, which cuts towards zero)."""
    n = F.sum(F.when(value.isNotNull(), F.col(W)))
    return F.when(n != 0, F.sum(value * F.col(W)).cast("double") / n)


def integer_average(df: DataFrame, keys: Sequence[str], value: str, alias: str) -> DataFrame:
    """Average of an integer column per key, cut towards zero."""
    sums = df.groupBy(*keys).agg(F.sum(F.col(value) * F.col(W)).alias("__s"), F.sum(F.when(F.col(value).isNotNull(), F.col(W))).alias("__n"))
    return sums.where("__n <> 0").select(*keys, F.expr("__s div __n").alias(alias), F.lit(1).cast("bigint").alias(W))


def group(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Aggregates per key over the rows of a consolidated collection with weight <> 0; output weight 1."""
    return df.where(F.col(W) != 0).groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]).withColumn(W, F.lit(1).cast("bigint"))


@dataclass(frozen=True)
class Aggregator:
    """An aggregate of one's own: values that add up, weighted, and what is made of their sums.

    Sums are formed in part before the shuffle; ``finish`` names the results, as
    expressions over the sums.
    """

    partials: Mapping[str, Column]
    finish: Mapping[str, Column]


def by(df: DataFrame, keys: Sequence[str], agg: Aggregator) -> DataFrame:
    """The aggregator's results per key; keys whose weights cancel out are absent."""
    sums = df.groupBy(*keys).agg(*[F.sum(c * F.col(W)).alias(n) for n, c in agg.partials.items()], F.sum(W).alias(W)).where(F.col(W) != 0)
    return sums.select(*keys, *[c.alias(n) for n, c in agg.finish.items()], F.lit(1).cast("bigint").alias(W))


def aggregate_linear(df: DataFrame, keys: Sequence[str], value: Column, alias: str, drop_zero: bool = True) -> DataFrame:
    """sum(value * weight) per key; groups of sum 0 vanish unless ``drop_zero`` is off."""
    out = df.groupBy(*keys).agg(F.sum(value * F.col(W)).alias(alias))
    if drop_zero:
        out = out.where(F.col(alias) != 0)
    return out.withColumn(W, F.lit(1).cast("bigint"))


def minimum(df: DataFrame, keys: Sequence[str], value: Column, alias: str) -> DataFrame:
    """Least value of non-zero weight."""
    return group(consolidated_values(df, keys, value), keys, **{alias: F.min("__v")})


def maximum(df: DataFrame, keys: Sequence[str], value: Column, alias: str) -> DataFrame:
    """Largest value of non-zero weight; structs compare field by field."""
    return group(consolidated_values(df, keys, value), keys, **{alias: F.max("__v")})


def consolidated_values(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    return consolidate(df.select(*keys, value.alias("__v"), W))


def fold(df: DataFrame, keys: Sequence[str], value: Column, zero: Column, step: Callable[[Column, Column, Column], Column], alias: str, finish: Callable[[Column], Column] | None = None) -> DataFrame:
    """A left fold of step(acc, value, weight) over the values of a key in rising order.

    All values of a key come to one task; use an aggregate where one fits.
    """
    rows = consolidated_values(df, keys, value).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__v", W))).alias("__all"))
    folded = F.aggregate("__all", zero, lambda acc, x: step(acc, x["__v"], x[W]), finish) if finish else F.aggregate("__all", zero, lambda acc, x: step(acc, x["__v"], x[W]))
    return rows.select(*keys, folded.alias(alias), F.lit(1).cast("bigint").alias(W))


def count_distinct(df: DataFrame, keys: Sequence[str], value: Column, alias: str, where: Column | None = None) -> DataFrame:
    """COUNT(DISTINCT value) [FILTER (WHERE ..)]: distinct first, then a linear count."""
    rows = df if where is None else df.where(where)
    values = distinct(rows.select(*keys, value.alias("__v"), W)).where("__v is not null")
    return values.groupBy(*keys).agg(F.sum(W).alias(alias)).withColumn(W, F.lit(1).cast("bigint"))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key in the given order (which should be total)."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def last_k_by_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, k: int, alias: str) -> DataFrame:
    """Integer average of ``value`` over the k rows of each key that come last in ``order``."""
    return integer_average(top_k(df, keys, [F.desc(c) for c in order], k), keys, value, alias)


def stream_fold(values: Sequence, init, step: Callable):
    """The running fold of scalars, one per tick."""
    acc, out = init, []
    for v in values:
        acc = step(acc, v)
        out.append(acc)
    return out
