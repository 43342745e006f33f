"""Table inputs by command: sets and keyed maps.

Commands carry a sequence number; of several for one key in a tick the last
counts.  A set ignores inserts of what it holds and deletes of what it does not; a
map overwrites, and a null value deletes.  Both return the change of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.zset import W


def set_delta(state: DataFrame, commands: DataFrame, keys: Sequence[str], insert: str = "insert", seq: str = "seq") -> DataFrame:
    """Change of a set (columns ``keys``, weight): +1 and -1 rows."""
    last = commands.groupBy(*keys).agg(F.max_by(insert, seq).alias("__want"))
    held = state.groupBy(*keys).agg((F.sum(W) > 0).alias("__has"))
    cond = [last[k].eqNullSafe(held[k]) for k in keys]
    both = last.join(held, cond, "left").select(*[last[k] for k in keys], "__want", F.coalesce("__has", F.lit(False)).alias("__has"))
    return both.where("__want <> __has").select(*keys, F.when(F.col("__want"), 1).otherwise(-1).cast("bigint").alias(W))


def map_delta(state: DataFrame, commands: DataFrame, keys: Sequence[str], values: Sequence[str], delete: str = "delete", seq: str = "seq") -> DataFrame:
    """Change of a map (columns ``keys`` and ``values``, weight); equal overwrites cancel out."""
    last = commands.groupBy(*keys).agg(F.max_by(F.struct(F.col(delete).alias("__gone"), *values), seq).alias("__new"))
    held = state.groupBy(*keys, *values).agg(F.sum(W).alias(W)).where(F.col(W) > 0)
    old = held.join(last, [held[k].eqNullSafe(last[k]) for k in keys]).select(*[held[k] for k in keys], *[held[v] for v in values], F.lit(-1).cast("bigint").alias(W))
    new = last.where(~F.col("__new.__gone")).select(*keys, *[F.col(f"__new.{v}").alias(v) for v in values], F.lit(1).cast("bigint").alias(W))
    return old.unionByName(new).groupBy(*keys, *values).agg(F.sum(W).alias(W)).where(F.col(W) != 0)
