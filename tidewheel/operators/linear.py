"""Per-record operators on weighted collections; each works on changes as on whole collections."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.zset import W


def filter_rows(df: DataFrame, keep: Column | str) -> DataFrame:
    """Records for which ``keep`` is true; weights stay."""
    return df.where(keep)


def map_rows(df: DataFrame, *columns: Column | str) -> DataFrame:
    """One record per record; equal outputs add up on consolidation."""
    return df.select(*columns, W)


def flat_map(df: DataFrame, items: Column, alias: str, *columns: Column | str) -> DataFrame:
    """As many records as ``items`` has elements; of structs, use ``alias.field`` afterwards."""
    return df.select(*columns, F.explode(items).alias(alias), W)


def flat_map_index(df: DataFrame, items: Column, alias: str, keys: Sequence[Column], *columns: Column | str) -> DataFrame:
    """flat_map to keys and values, brought together by key."""
    out = flat_map(df, items, alias, *keys, *columns)
    return out.repartition(*out.columns[: len(keys)])


def exchange(df: DataFrame, by: Column, partitions: int | None = None) -> DataFrame:
    """Sends each record to the place that a value of one's own names: equal values meet."""
    return df.repartition(partitions, by) if partitions else df.repartition(by)


def filter_map(df: DataFrame, keep: Column | str, *columns: Column | str) -> DataFrame:
    """flat_map with zero or one output: filter, then map."""
    return df.where(keep).select(*columns, W)


def index_with(df: DataFrame, keys: Sequence[Column | str], partitions: int | None = None) -> DataFrame:
    """Brings records of a key together: a hash exchange that later operators on the keys reuse."""
    return df.repartition(partitions, *keys) if partitions else df.repartition(*keys)


def apply(df: DataFrame, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Any function of the whole collection."""
    return f(df)


def apply2(a: DataFrame, b: DataFrame, f: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Any function of two collections."""
    return f(a, b)


def gather(df: DataFrame) -> DataFrame:
    """Everything in one partition: for small results only."""
    return df.coalesce(1)
