"""Watermarks, windows and rolling aggregates over an integer time column.

Times are integers (milliseconds, say).  Bounds are scalars on the driver, one
pair per tick: the incremental forms are in :mod:`tidewheel.streaming`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.session import written
from tidewheel.zset import W


def watermark(df: DataFrame, ts: str, lag: int, before: int = 0) -> int:
    """max(before, largest time - lag): monotone over ticks if the last result is passed in."""
    top = df.agg(F.max(ts).alias("t")).first()["t"]
    return before if top is None else max(before, int(top) - lag)


def closed_window(mark: int, width: int, step: int) -> tuple[int, int]:
    """[lo, hi) of the latest window of ``width`` that ends at a multiple of ``step`` not after the mark."""
    hi = mark - mark % step
    return max(0, hi - width), hi


def in_window(df: DataFrame, ts: str, lo: int, hi: int) -> DataFrame:
    """Rows with lo <= ts < hi."""
    return df.where((F.col(ts) >= lo) & (F.col(ts) < hi))


def tumbling(ts: Column, size: int) -> Column:
    """Start of the tumbling window (floored, also before 0)."""
    return ts - F.pmod(ts, F.lit(size))


def hopping(df: DataFrame, ts: str, width: int, step: int, alias: str = "window_start") -> DataFrame:
    """Each row once per window [s, s + width), s a multiple of ``step``, that holds it."""
    last = tumbling(F.col(ts), step)
    first = tumbling(F.col(ts) - width, step) + step
    return df.withColumn(alias, F.explode(F.sequence(first, last, F.lit(step).cast("bigint"))))


def rolling(df: DataFrame, partition: Sequence[str], ts: str, aggs: Mapping[str, Column], from_: int, to: int, once: bool = True) -> DataFrame:
    """Aggregates over rows of the partition with time in [ts + from_, ts + to] (closed).

    One row per (partition, ts) if ``once``; over an empty range aggregates are
    null (counts 0).  Rows at the same time share their result.
    """
    frame = Window.partitionBy(*partition).orderBy(ts).rangeBetween(from_, to)
    out = df.select(*partition, ts, *[a.over(frame).alias(n) for n, a in aggs.items()])
    return out.dropDuplicates([*partition, ts]) if once else out


def rolling_sum(value: Column, partition: Sequence[str], ts: str, from_: int, to: int) -> Column:
    """sum(value) over [ts + from_, ts + to] as the difference of two running sums; 0 over an empty range.

    A sliding frame adds up its rows for every row anew, which is quadratic where a
    partition is dense; two frames that only grow cost one addition per row each.
    For linear aggregates (sums, counts) of integers, so that the difference is exact.
    Rows without a time come first and have one another as their range, as in SQL.
    """
    w = Window.partitionBy(*partition).orderBy(ts)
    upto = lambda end: F.coalesce(F.sum(value).over(w.rangeBetween(Window.unboundedPreceding, end)), F.lit(0))
    return upto(to) - F.when(F.col(ts).isNull(), F.lit(0)).otherwise(upto(from_ - 1))


_UNITS = 10_000.0


@dataclass(frozen=True)
class Sums:
    """What is known of values to be averaged: whole units of 1/10,000 whose sums fit a long integer; NaN or infinities among them."""

    units: bool = False
    odd: bool = True


def rolling_mean(value: Column, partition: Sequence[str], ts: str, from_: int, to: int, kind: Sums = Sums()) -> Column:
    """avg(value) over the same range; null over an empty range.

    Doubles are added as decimals (or, where ``kind`` says so, as whole units) with 18 digits on either side of the point, so
    the difference of two running sums is exact.  Values that such a decimal does not
    hold (of 10^18 and more, or with digits beyond the 18th decimal) are put into a
    second running sum of doubles, as what the decimal leaves of them.  NaN and
    infinities in the range give what adding them up would give.
    """
    value = value.cast("double")
    parts = _mean_parts(value, kind)
    sums = {k: rolling_sum(c, partition, ts, from_, to) for k, c in parts.items()}
    if kind.units:
        return _mean_of(sums, F.lit(0.0), kind)
    finite = ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    left = F.when(finite, F.coalesce(value - parts["exact"].cast("double"), value))
    # Where nothing was left over the sum of decimals stands; a frame of the range adds what was, so nothing cancels.
    frame = Window.partitionBy(*partition).orderBy(ts).rangeBetween(from_, to)
    rest = F.coalesce(F.sum(F.when(left != 0, left)).over(frame), F.lit(0.0))
    return _mean_of(sums, rest, kind)


MAX_HOT = 10_000
HOT_ROWS = 1_000_000


def rolling_features(
    df: DataFrame, partition: Sequence[str], ts: str, row_id: str, means: Mapping[str, tuple[Column, int, int]], counts: Mapping[str, tuple[int, int]], hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Adds means (value, from, to) and counts (from, to) over [ts + from, ts + to] of the partition.

    Partitions with ``hot_rows`` rows or more (and at least a MAX_HOT-th of all, which
    bounds their list) are cut into slices of time, each a group of its own: running
    sums are formed in a slice, on top of the totals before it, and looked up where a
    row's range begins and ends, which may lie in other slices.  They are found again
    by partition and time, so ``row_id`` may be null or repeated: nothing depends on
    it.  Partitions with values that the decimals of ``rolling_mean`` do not hold are
    not cut.
    """
    values = [v.cast("double") for v, _, _ in means.values()]
    finite = [F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v) for v in values]
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    some = lambda cs: reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in cs], F.lit(False))
    sizes = written(df.groupBy(*partition).agg(
        F.count(F.lit(1)).alias("__n"), F.min(ts).alias("__from"), F.max(ts).alias("__to"), flag(_any_left(values)).alias("__left"), flag(some([v.isNotNull() & f.isNull() for v, f in zip(values, finite, strict=True)])).alias("__odd"),
        flag(some([F.round(f * _UNITS) / _UNITS != f for f in finite])).alias("__fine"), F.greatest(F.lit(0.0), *[F.coalesce(F.max(F.abs(f)), F.lit(0.0)) for f in finite], F.lit(0.0)).alias("__most"),
    ))
    # One row: whether sums of whole units of 1/10,000 are exact and fit a long integer everywhere, and whether there are NaN and infinities.
    all_ = sizes.agg(F.bool_or("__fine"), F.max(F.col("__n") * F.col("__most") * _UNITS), F.bool_or("__odd")).first()
    kind = Sums(not all_[0] and (all_[1] or 0.0) < 9e18, bool(all_[2]))
    large = sizes.where(F.col("__n") >= hot_rows)
    if large.where("not __left").isEmpty():
        return _rolled(df, partition, ts, means, counts, kind)
    least = max(hot_rows, -(-df.count() // MAX_HOT))
    width = F.greatest(F.lit(1), F.ceil((F.col("__to") - F.col("__from") + 1) / F.ceil(F.col("__n") / hot_rows))).cast("bigint")
    hot = F.broadcast(large.where((F.col("__n") >= least) & ~F.col("__left")).select(*[F.col(p).alias(f"__p_{p}") for p in partition], F.col("__from"), width.alias("__width")))
    marked = df.join(hot, [F.col(p).eqNullSafe(F.col(f"__p_{p}")) for p in partition], "left").drop(*[f"__p_{p}" for p in partition])
    cut = F.col("__width").isNotNull() & F.col(ts).isNotNull()
    cold = _rolled(marked.where(~cut).drop("__from", "__width"), partition, ts, means, counts, kind)
    rows = marked.where(cut)

    # What is summed: per mean the parts of the sum, and one for the counts.
    summed: dict[str, Column] = {"one": F.lit(1)}
    for a, (v, _, _) in means.items():
        summed |= {f"{a}.{k}": c for k, c in _mean_parts(v, kind).items()}
    names = {k: f"__s{i}" for i, k in enumerate(summed)}
    offsets = sorted({x for _, f, t in means.values() for x in (f - 1, t)} | {x for f, t in counts.values() for x in (f - 1, t)})
    at = F.explode(F.array(F.struct(F.lit(-1).alias("which"), F.col(ts).cast("bigint").alias("t")), *[F.struct(F.lit(j).alias("which"), (F.col(ts) + off).cast("bigint").alias("t")) for j, off in enumerate(offsets)])).alias("__e")
    events = rows.select(*partition, F.col(ts).cast("bigint").alias("__at"), "__from", "__width", *[c.alias(names[k]) for k, c in summed.items()], at)
    events = events.select(
        *partition, "__at", F.floor((F.col("__e.t") - F.col("__from")) / F.col("__width")).alias("__slice"), F.col("__e.which").alias("__which"), F.col("__e.t").alias("__t"),
        *[F.when(F.col("__e.which") < 0, F.col(n)).alias(n) for n in names.values()],
    )
    slices = events.groupBy(*partition, "__slice").agg(*[F.sum(n).alias(n) for n in names.values()])
    before = Window.partitionBy(*partition).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    kinds = {f.name: f.dataType for f in events.schema}
    carried = slices.select(
        *partition, F.lit(None).cast("bigint").alias("__at"), "__slice", F.lit(-2).alias("__which"), F.lit(None).cast("bigint").alias("__t"), *[F.sum(n).over(before).cast(kinds[n]).alias(n) for n in names.values()]
    )
    running = Window.partitionBy(*partition, "__slice").orderBy(F.col("__t").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    upto = events.unionByName(carried).select(*partition, "__at", "__which", *[F.coalesce(F.sum(n).over(running), F.lit(0)).alias(n) for n in names.values()]).where("__which >= 0")
    seen = upto.groupBy(*[F.col(p).alias(f"__p_{p}") for p in partition], "__at").agg(*[F.max(F.when(F.col("__which") == j, F.col(n))).alias(f"{n}_{j}") for j in range(len(offsets)) for n in names.values()])
    found = rows.drop("__from", "__width").join(seen, [*[F.col(p).eqNullSafe(F.col(f"__p_{p}")) for p in partition], F.col(ts) == F.col("__at")])
    between = lambda key, f, t: F.col(f"{names[key]}_{offsets.index(t)}") - F.col(f"{names[key]}_{offsets.index(f - 1)}")
    out = {a: _mean_of({k: between(f"{a}.{k}", f, t) for k in _mean_parts(F.lit(0.0), kind)}, F.lit(0.0), kind) for a, (_, f, t) in means.items()}
    out |= {a: between("one", f, t) for a, (f, t) in counts.items()}
    return cold.unionByName(found.withColumns(out).select(*cold.columns))


def _rolled(df: DataFrame, partition: Sequence[str], ts: str, means: Mapping[str, tuple[Column, int, int]], counts: Mapping[str, tuple[int, int]], kind: Sums) -> DataFrame:
    out = {a: rolling_mean(v, partition, ts, f, t, kind) for a, (v, f, t) in means.items()}
    return df.withColumns(out | {a: rolling_sum(F.lit(1), partition, ts, f, t) for a, (f, t) in counts.items()})


def _mean_parts(value: Column, kind: Sums) -> dict[str, Column]:
    """Of a value: whether it counts, is NaN or infinite, and the decimal or whole units that are added up."""
    value = value.cast("double")
    infinite = F.lit(float("inf"))
    one = lambda c: F.when(c, 1)
    fits = ~F.isnan(value) & (F.abs(value) < F.lit(1e18))
    exact = F.when(fits, F.round(value * _UNITS)).cast("bigint") if kind.units else F.when(fits, value).cast("decimal(36,18)")
    odd = {"nan": one(F.isnan(value)), "up": one(value == infinite), "down": one(value == -infinite)} if kind.odd else {}
    return {"n": one(value.isNotNull()), **odd, "exact": exact}


def _any_left(values: Sequence[Column]) -> Column:
    out = F.lit(False)
    for v in values:
        exact = _mean_parts(v, Sums())["exact"]
        finite = ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
        out = out | F.coalesce(finite & (exact.isNull() | (exact.cast("double") != v)), F.lit(False))
    return out


def _mean_of(sums: Mapping[str, Column], rest: Column, kind: Sums) -> Column:
    infinite = F.lit(float("inf"))
    mean = (sums["exact"].cast("double") / _UNITS if kind.units else sums["exact"].cast("double") + rest) / sums["n"]
    if not kind.odd:
        return F.when(sums["n"] > 0, mean)
    odd = F.when((sums["nan"] > 0) | ((sums["up"] > 0) & (sums["down"] > 0)), F.lit(float("nan"))).when(sums["up"] > 0, infinite).when(sums["down"] > 0, -infinite)
    return F.when(sums["n"] > 0, F.coalesce(odd, mean))


def rolling_with_watermark(df: DataFrame, partition: Sequence[str], ts: str, aggs: Mapping[str, Column], from_: int, to: int, mark: int) -> DataFrame:
    """Rolling aggregates without rows that are too late to matter: state older than the mark less the range is dropped."""
    return rolling(df.where(F.col(ts) >= mark - (to - from_)), partition, ts, aggs, from_, to)


def rollup_tree(df: DataFrame, partition: Sequence[str], ts: str, value: str, levels: Sequence[int]) -> DataFrame:
    """Partial sums and counts over aligned ranges of several sizes: (level, range_start, total, n).

    A range query adds a few large ranges and the small ones at its ends.
    """
    per_level = F.explode(F.array(*[F.struct(F.lit(s).cast("bigint").alias("size"), tumbling(F.col(ts).cast("bigint"), s).alias("start")) for s in levels])).alias("l")
    weight = F.col(W) if W in df.columns else F.lit(1)
    return (
        df.select(*partition, per_level, F.col(value).alias("v"), weight.alias("w")).groupBy(*partition, F.col("l.size").alias("level"), F.col("l.start").alias("range_start"))
        .agg(F.sum(F.col("v") * F.col("w")).alias("total"), F.sum("w").alias("n"))
    )


def rollup_total(tree: DataFrame, partition: Sequence[str], levels: Sequence[int], lo: int, hi: int) -> DataFrame:
    """(partition, total, n) over [lo, hi), from the ranges of a rollup tree whose levels divide one another.

    Of each level the ranges are taken that lie inside and in no larger range inside:
    at most two runs of them per level, so few rows per partition are read.
    """
    sizes = sorted(levels)
    inside = lambda size: (F.col("range_start") >= lo) & (F.col("range_start") + size <= hi)
    keep = F.lit(False)
    for i, size in enumerate(sizes):
        own = (F.col("level") == size) & inside(size)
        if i + 1 < len(sizes):
            big = sizes[i + 1]
            up = tumbling(F.col("range_start"), big)
            own = own & ~((up >= lo) & (up + big <= hi))
        keep = keep | own
    return tree.where(keep).groupBy(*partition).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def previous(df: DataFrame, partition: Sequence[str], order: Sequence[str], value: str, alias: str, offset: int = 1) -> DataFrame:
    """LAG."""
    return df.withColumn(alias, F.lag(value, offset).over(Window.partitionBy(*partition).orderBy(*order)))
