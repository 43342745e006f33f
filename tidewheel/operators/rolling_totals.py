"""Totals and averages over trailing days, inactive days included.

Rows are summed to sparse daily totals in exact fixed point (amounts are
rounded to ``scale`` decimals and added as decimals of 38 digits, so no sum
depends on the order of addition).  Each sparse day is then stretched over the
inactive days up to the next active one (calendar rows with total 0), and RANGE
frames over the integer day number give the trailing totals.  Averages divide by
the fixed number of days of the period, also before the entity was that old.

Amounts whose units do not fit (10^28 of them or more, where a double knows no
units any more) are added up as doubles beside the units, in ``beyond``.

Two-step aggregation: repeated rows are removed in groups of (entity, day, id),
which spreads a hot entity over all tasks, then partial sums meet per day.  The
window per entity holds at most one row per calendar day.  ``only`` is reduced to
distinct entities and met in the partitioning by entity that the windows need
anyway; it is never broadcast.

Defined cases: rows with a null entity or moment are ignored; a null, NaN or
infinite amount adds nothing, but its day counts as active; days after ``until``
are ignored; repeated ids count once; empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_MOST_UNITS = 1e28


def daily_totals(rows: DataFrame, entity: str, seconds: str, amount: str, row_id: str, scale: int = 2) -> DataFrame:
    """(entity, day, units, beyond): the sum of each active day in units of 10^-scale."""
    amt = F.col(amount).cast("double")
    finite = amt.isNotNull() & ~F.isnan(amt) & (F.abs(amt) < F.lit(float("inf")))
    fits = finite & (F.abs(amt) < F.lit(_MOST_UNITS / 10**scale))
    return (
        rows.select(
            F.col(entity).alias("entity"),
            F.floor(F.col(seconds).cast("bigint") / 86400).cast("int").alias("day"),
            F.col(row_id).cast("string").alias("row_id"),
            F.when(finite, amt).alias("amt"),
            fits.alias("fits"),
        )
        .where(F.col("entity").isNotNull() & F.col("day").isNotNull())
        .dropDuplicates(["entity", "day", "row_id"])
        .groupBy("entity", "day").agg(
            F.coalesce(F.sum(F.when(F.col("fits"), F.round(F.col("amt") * 10**scale).cast("decimal(28,0)"))), F.lit(0)).cast("decimal(38,0)").alias("units"),
            F.coalesce(F.sum(F.when(~F.col("fits"), F.col("amt"))), F.lit(0.0)).alias("beyond"),
        )
    )


def trailing_totals(daily: DataFrame, until: date, periods: Sequence[int] = (7, 30), only: DataFrame | None = None) -> DataFrame:
    """A row per entity and day from its first day to ``until``.

    ``only`` (one column ``entity``) restricts to entities found there.
    Columns: entity, day (days since 1970), age (1 on the first day), units_P
    and beyond_P for each period.
    """
    last = (until - date(1970, 1, 1)).days
    daily = daily.where(F.col("day") <= last)
    if only is not None:
        daily = daily.join(only.select("entity").distinct().hint("shuffle_hash"), "entity", "left_semi")
    by_entity = Window.partitionBy("entity")
    stretched = daily.withColumns(
        {"next": F.lead("day").over(by_entity.orderBy("day")), "first": F.min("day").over(by_entity)}
    ).select(
        "entity", "first", "units", "beyond", F.col("day").alias("active"),
        F.explode(F.sequence(F.col("day"), F.coalesce(F.col("next") - 1, F.lit(last)))).alias("day"),
    )
    on_day = lambda c: F.when(F.col("day") == F.col("active"), F.col(c)).otherwise(F.lit(0)).alias(c)
    out = stretched.select("entity", "day", (F.col("day") - F.col("first") + 1).alias("age"), on_day("units"), on_day("beyond"))
    # Units are exact, so a period's total is the difference of two frames that only grow, one addition a row each.
    upto = lambda end: F.coalesce(F.sum("units").over(by_entity.orderBy("day").rangeBetween(Window.unboundedPreceding, end)), F.lit(0)).cast("decimal(38,0)")
    within = lambda p: F.sum("beyond").over(by_entity.orderBy("day").rangeBetween(-(p - 1), 0))
    totals = {"__now": upto(0)} | {f"__old_{p}": upto(-p) for p in periods} | {f"beyond_{p}": within(p) for p in periods}
    out = out.withColumns(totals)
    return out.withColumns({f"units_{p}": (F.col("__now") - F.col(f"__old_{p}")).cast("decimal(38,0)") for p in periods}).drop("units", "beyond", *[c for c in totals if c.startswith("__")])


def with_amounts(trailing: DataFrame, periods: Sequence[int] = (7, 30), scale: int = 2) -> DataFrame:
    """Adds total_P and avg_P (double) to the unit columns."""
    cols = {}
    for p in periods:
        total = F.col(f"units_{p}").cast("double") / F.lit(float(10**scale)) + F.col(f"beyond_{p}")
        cols[f"total_{p}"] = total
        cols[f"avg_{p}"] = F.when(F.col(f"beyond_{p}") == 0, F.col(f"units_{p}").cast("double") / F.lit(float(p * 10**scale))).otherwise(total / F.lit(float(p)))
    return trailing.withColumns(cols)
