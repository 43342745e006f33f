"""State of a circuit: written parts in the shared folder, and integrals made of them.

``Parts`` writes changes as parquet tables into the circuit's own folder under
``spark.checkpoint.dir`` and removes those that no state, held value or result of
the running tick needs any more, so a circuit that runs for long does not fill the
disk.  Results that were handed out are never removed.

``StateTable`` is the sum of all changes so far, a base and recent changes, which
are merged every ``compact_every`` ticks.  A base with keys is written in ranges of
the first key column, sorted by it.  A change with at most FEW_KEYS keys reads the
base through a literal filter on them, which prunes files and row groups; a larger
one reads the whole base once.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.session import cut_lineage, delete_path, ensure_checkpoint_dir, written_counted
from tidewheel.zset import W, consolidate, sum_of

FEW_KEYS = 1_000


class Parts:
    """The written parts of a circuit."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, ""
        self.owned: set[str] = set()

    def cut(self, df: DataFrame) -> DataFrame:
        """The rows as a written part; a part stays as it is."""
        if part_of(df):
            return df
        if any(isinstance(f.dataType, T.NullType) for f in df.schema):
            return cut_lineage(df)  # parquet has no column of nulls only
        if not self.folder:
            self.folder = f"{ensure_checkpoint_dir(self.spark)}/circuit-{uuid.uuid4()}"
        path = f"{self.folder}/{uuid.uuid4()}"
        out, _ = written_counted(df, path)
        out._part = path
        self.owned.add(path)
        return out

    def hand_out(self, df: DataFrame) -> DataFrame:
        """A result for the caller, who may keep it: no longer the circuit's to remove."""
        out = self.cut(df)
        self.owned.discard(part_of(out))
        return out

    def sweep(self, needed: set[str]) -> None:
        for path in self.owned - needed:
            delete_path(self.spark, path)
        self.owned &= needed


def part_of(df: object) -> str:
    """Where a part is written; empty for anything else."""
    return df.__dict__.get("_part", "") if isinstance(df, DataFrame) else ""


def keys_match(a: DataFrame, touched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a with a key in ``touched`` (null keys match)."""
    right = touched.select(*[F.col(k).alias(f"__t_{k}") for k in keys]).distinct()
    return a.join(right, [F.col(k).eqNullSafe(F.col(f"__t_{k}")) for k in keys], "left_semi")


class StateTable:
    """An integrated collection."""

    def __init__(self, empty: DataFrame, parts: Parts, compact_every: int = 8, keys: Sequence[str] = ()):
        self.empty, self.parts, self.keys = empty, parts, list(keys)
        self.base: DataFrame | None = None
        self.recent: list[DataFrame] = []
        self.compact_every = compact_every
        self.bound: tuple[str, int] | None = None
        self.merge = consolidate  # how rows of one record add up

    def _sum(self, base: DataFrame | None) -> DataFrame:
        parts = [*([base] if base is not None else []), *self.recent]
        return self._bounded(sum_of(parts) if parts else self.empty)

    def read(self) -> DataFrame:
        """All records; one may occur in several rows whose weights add up."""
        return self._sum(self.base)

    def touching(self, change: DataFrame, keys: Sequence[str], few: list | None = None) -> DataFrame:
        """Records that share a key with the change, and perhaps others: a part of the base if the keys are few.

        ``few`` are the values of the first key, if they are known to be few.
        """
        base = self.base
        if base is not None and few is not None and keys:
            c = F.col(keys[0])
            hit = c.isin([x for x in few if x is not None]) if any(x is not None for x in few) else F.lit(False)
            base = base.where(hit | c.isNull() if None in few else hit)
        return self._sum(base)

    def add(self, delta: DataFrame) -> None:
        """Takes a change that is written."""
        self.recent.append(delta)
        if len(self.recent) >= self.compact_every:
            self.compact()

    def compact(self) -> None:
        whole = self.merge(self.read())
        if self.keys:
            whole = whole.repartitionByRange(self.keys[0]).sortWithinPartitions(self.keys[0])
        self.base, self.recent = self.parts.cut(whole), []

    def reset(self) -> None:
        self.base, self.recent = None, []

    def keep_from(self, column: str, least: int) -> None:
        """Drops records below a bound, which may only rise, for good at the next compaction."""
        if self.bound is None or least > self.bound[1]:
            self.bound = (column, least)

    def _bounded(self, df: DataFrame) -> DataFrame:
        return df if self.bound is None else df.where(F.col(self.bound[0]) >= self.bound[1])

    def needed(self) -> set[str]:
        return {part_of(d) for d in [self.base, *self.recent]} - {""}

    def save(self, path: str) -> None:
        self.merge(self.read()).write.mode("overwrite").parquet(path)

    def load(self, spark: SparkSession, path: str) -> None:
        self.base, self.recent = spark.read.parquet(path).select(*[c for c in self.empty.columns if c != W], W), []


def few_values(change: DataFrame, key: str) -> list | None:
    """The distinct values of a column if there are at most FEW_KEYS, else None."""
    rows = change.select(key).distinct().limit(FEW_KEYS + 1).collect()
    return [r[0] for r in rows] if len(rows) <= FEW_KEYS else None
