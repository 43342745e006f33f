"""References to records that do not exist.

Child rows refer to keys of a parent table whose history is a change log of
inserts (+1) and deletes (-1).  References and the parent's changes are brought
to the same partitions by key, sorted by time and merged in one linear pass: a
running window carries the state of the parent key (the validity interval that
is open or closed at that moment) along the merged stream.

Hot keys.  Keys with ``hot_rows`` references and changes or more are cut into
calendar days, hot days into hours and hot hours into minutes; the state at the
start of each slice is carried in from the changes before it, so a slice is a
group of its own and nothing is replicated.  References without a time, which lie
before every change, are spread over slices by a hash of their id.  The threshold
is at least a ``MAX_HOT``-th of all rows, so no more than ``MAX_HOT`` keys, days or
hours can reach it: that bounds the broadcast lists without leaving out any.

Defined cases: a null key is no reference and never comes out; a null reference
time lies before every change; changes with a null key, time or weight are
ignored; changes at the same moment count in the order of ``seq``; a change at
the very moment of the reference counts; repeated rows of either side change
nothing; empty tables are fine; further columns of either table are not read.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.session import written

MAX_HOT = 10_000
_SPREAD = 64  # slices of a hot key for references without time
DEFAULT_HOT_ROWS = 100_000


@dataclass(frozen=True)
class References:
    """A child table: ``id`` names the row, ``key`` the parent, ``at`` the moment."""

    df: DataFrame
    id: str
    key: str
    at: str


@dataclass(frozen=True)
class ParentLog:
    """The parent's change log."""

    df: DataFrame
    key: str
    at: str
    seq: str
    weight: str


def _whole():
    """The slice of keys that are merged whole."""
    return F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")


def _merged(refs: DataFrame, log: DataFrame, hot_rows: int) -> DataFrame:
    """Rows of both streams with the group (k, slice) in which they are merged."""
    first = log.groupBy("k").agg(F.min(F.when(F.col("w") > 0, F.col("t"))).alias("first_t"))
    none = lambda kind: F.lit(None).cast(kind)
    header = lambda df: df.select("k", "slice", none("timestamp_ntz").alias("t"), F.lit(0).alias("kind"), none("bigint").alias("seq"), "w", "first_t", none("string").alias("id"), none("string").alias("src"))
    whole = first.select("k", _whole().alias("slice"), none("int").alias("w"), "first_t")

    per_key = written(refs.select("k").unionByName(log.select("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= hot_rows))
    least = hot_rows
    if not per_key.isEmpty():
        all_rows = refs.count() + log.count()
        least = max(hot_rows, -(-all_rows // MAX_HOT))
    hot = per_key.where(F.col("n") >= least).select("k", F.lit(True).alias("hot"))
    if hot.isEmpty():
        refs_s, log_s, headers = refs.withColumn("slice", _whole()), log.withColumn("slice", _whole()), header(whole)
    else:
        # Of hot keys: per minute how many rows, and the last change.
        spread = _whole() + F.make_dt_interval(mins=F.pmod(F.xxhash64("id"), F.lit(_SPREAD)).cast("int"))
        minute = F.coalesce(F.date_trunc("minute", "t").cast("timestamp_ntz"), spread)
        some = (
            refs.join(F.broadcast(hot), "k", "left_semi").select("k", minute.alias("minute"), none("struct<t:timestamp_ntz,seq:bigint,w:int>").alias("last"))
            .unionByName(log.join(F.broadcast(hot), "k", "left_semi").select("k", F.date_trunc("minute", "t").cast("timestamp_ntz").alias("minute"), F.struct("t", "seq", "w").alias("last")))
        )
        minutes = written(some.groupBy("k", "minute").agg(F.max("last").alias("last"), F.count(F.lit(1)).alias("n")))
        trunc = lambda unit, c: F.date_trunc(unit, c).cast("timestamp_ntz")
        busy = lambda unit: minutes.where(F.year("minute") > 1).groupBy("k", trunc(unit, F.col("minute")).alias(unit)).agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("k", unit, F.lit(True).alias(f"hot_{unit}"))
        days, hours = F.broadcast(written(busy("day"))), F.broadcast(written(busy("hour")))

        def sliced(df: DataFrame, at, timeless) -> DataFrame:
            """With ``slice``: the whole key, or the day, hour or minute, as busy as each is."""
            out = df.withColumns({"day": trunc("day", at), "hour": trunc("hour", at)}).join(days, ["k", "day"], "left").join(hours, ["k", "hour"], "left")
            part = F.when(F.col("hot_hour"), trunc("minute", at)).when(F.col("hot_day"), F.col("hour")).otherwise(F.col("day"))
            return out.withColumn("slice", F.when(F.col("hot"), F.coalesce(part, timeless)).otherwise(_whole())).drop("day", "hour", "hot_day", "hot_hour")

        marked = lambda df: df.join(F.broadcast(hot), "k", "left")
        refs_s, log_s = sliced(marked(refs), F.col("t"), spread), sliced(marked(log), F.col("t"), _whole())
        # State carried into each slice of a hot key: its last change in earlier slices.
        timed = F.when(F.year("minute") > 1, F.col("minute"))
        per_slice = sliced(minutes.withColumn("hot", F.lit(True)), timed, F.col("minute")).groupBy("k", "slice").agg(F.max("last").alias("last"))
        before = Window.partitionBy("k").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = per_slice.withColumn("w", F.last("last", ignorenulls=True).over(before)["w"]).join(first, "k", "left").select("k", "slice", "w", "first_t")
        headers = header(whole.join(F.broadcast(hot), "k", "left_anti").unionByName(carried))
    changes = log_s.select("k", "slice", "t", F.lit(1).alias("kind"), "seq", "w", none("timestamp_ntz").alias("first_t"), none("string").alias("id"), none("string").alias("src"))
    uses = refs_s.select("k", "slice", "t", F.lit(2).alias("kind"), none("bigint").alias("seq"), none("int").alias("w"), none("timestamp_ntz").alias("first_t"), "id", "src")
    return headers.unionByName(changes).unionByName(uses)


def classify_references(children: Mapping[str, References], parent: ParentLog, hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame:
    """Every reference with its ``status``: valid, missing, late or deleted.

    missing: the key was never inserted; late: inserted only afterwards;
    deleted: inserted before, but its latest change is a delete.
    Columns: ``src`` (the child table's name), ``id``, ``k``, ``t``, ``status``.
    """
    parts = [
        c.df.select(F.lit(name).alias("src"), F.col(c.id).cast("string").alias("id"), F.col(c.key).alias("k"), F.col(c.at).cast("timestamp_ntz").alias("t")).where(F.col("k").isNotNull())
        for name, c in children.items()
    ]
    refs = parts[0]
    for p in parts[1:]:
        refs = refs.unionByName(p)
    log = parent.df.select(
        F.col(parent.key).alias("k"), F.col(parent.at).cast("timestamp_ntz").alias("t"), F.col(parent.seq).cast("bigint").alias("seq"), F.col(parent.weight).cast("int").alias("w")
    ).where(F.col("k").isNotNull() & F.col("t").isNotNull() & F.col("w").isNotNull() & (F.col("w") != 0))
    group = Window.partitionBy("k", "slice")
    so_far = group.orderBy(F.col("kind") != 0, F.col("t").asc_nulls_first(), "kind", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = _merged(refs, log, hot_rows).withColumns(
        {"open": F.last("w", ignorenulls=True).over(so_far), "born": F.last("first_t", ignorenulls=True).over(so_far)}
    )
    status = (
        F.when(F.col("open") > 0, "valid")
        .when(F.col("born").isNull(), "missing")
        .when(F.col("t").isNull() | (F.col("t") < F.col("born")), "late")
        .otherwise("deleted")
    )
    return merged.where("kind = 2").select("src", "id", "k", "t", status.alias("status"))


def orphans(children: Mapping[str, References], parent: ParentLog, hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame:
    """References without a valid parent, each row of a child once."""
    found = classify_references(children, parent, hot_rows).where("status <> 'valid'")
    return found.dropDuplicates(["src", "id"])


def orphan_report(children: Mapping[str, References], parent: ParentLog, period: str = "yyyy-MM", hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame:
    """Orphans counted per child table, period and reason."""
    return (
        orphans(children, parent, hot_rows)
        .groupBy(F.col("src").alias("table_name"), F.date_format("t", period).alias("period"), F.col("status").alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
