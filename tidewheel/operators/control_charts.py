"""Implausible readings per source: control charts, run lengths, physical limits.

For each source and reading field a robust exponentially weighted control chart
follows level and scale of the logarithm of the reading through the periods
(days) of the source.  The readings of a period are judged by the level and scale
that the periods before it left behind; then they update both, suspected ones clipped
first, so spikes do not drag the chart along.  The chart
starts from the robust centre and spread of its first ``start`` readings (whole
periods) and is never re-based.  What lies beyond the control limits is out of
control; a limit is no wider than a factor ``alarm`` around the level.  Run-length
counters find values that stay stuck, and a caller's condition adds physical
limits.

The exact test.  ``ratio`` holds a reading that is out of control against a
multiple of the source's median; readings in control are never held against it.
So a source whose level wanders by more than ``ratio / alarm`` from its median
over all time is judged by where it stood at the time.

Scale.  The chart of a source is a recursion, but it runs on counts: readings are
first counted per source, period and 1/16 of an octave (with partial aggregation
before the shuffle), which bounds what one task sees of a source by its periods,
however many rows it has.  Its limits are joined back per source and period.
Runs are found in slices of a source's period of about ``slice_rows`` rows; a run
that crosses slices is put together from one row per slice and field.  The exact
median comes from the same counts: they name the 1/16 octave that holds it, and
only values of that one are counted by value.  Tables with a row per source or
per source and period are broadcast only after they were counted (BROADCAST_ROWS).

Defined cases: null readings are never flagged and end a run; NaN is flagged
``nan`` and takes no part in median and chart, but equals NaN in runs; readings
that are not positive or infinite are out of control and do not update the chart,
but take part in the median; where they are half of a source's readings or more
there is no chart and all are out of control; rows without source form a source
of their own; rows with a null time are the first period of their source, in
order of id; repeated rows count once; empty tables give no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.session import written

BROADCAST_ROWS = 100_000
_BINS = 16  # per octave
_BIN = np.log(2.0) / _BINS
_FAR = 1_000_000  # bins of readings that the logarithm can't place lie beyond


@dataclass(frozen=True)
class ChartConfig:
    """Parameters of the charts."""

    weight: float = 0.05  # of a new reading in level and scale
    limit: float = 3.5  # control limit in scales
    clip: float = 2.0  # a reading farther off than this many scales is clipped before it updates the chart
    least_scale: float = 0.05  # of the logarithm
    alarm: float = 3.0  # no control limit is wider than this factor
    start: int = 30  # readings that start a chart
    ratio: float = 6.0  # the exact test against the median
    stuck: int = 8  # equal readings in consecutive rows
    slice_rows: int = 100_000  # rows of a source and period that are looked through for runs at once


@dataclass(frozen=True)
class Readings:
    """A table of readings; ``fields`` are tested, ``limits`` are (field, condition) beyond which a reading can't be."""

    df: DataFrame
    id: str
    source: str
    at: str
    fields: Sequence[str]
    limits: Sequence[tuple[str, Column]] = field(default_factory=tuple)


def _prepared(r: Readings) -> DataFrame:
    """Each row once, with its group (source, period) and its place in the order of the group."""
    kind = r.df.schema[r.id].dataType.simpleString()
    numeric = kind in ("tinyint", "smallint", "int", "bigint")
    place = F.coalesce(F.unix_micros(F.col(r.at).cast("timestamp")), F.col(r.id).cast("bigint") if numeric else F.lit(0).cast("bigint"))
    cols = [
        F.col(r.source).alias("src"),
        F.coalesce(F.to_date(r.at), F.lit("0001-01-01").cast("date")).alias("period"),
        F.col(r.id).alias("id"),
        F.col(r.at).alias("at"),
        place.alias("place"),
        *[F.col(f).cast("double").alias(f"v{i}") for i, f in enumerate(r.fields)],
        *[_any([c for name, c in r.limits if name == f]).alias(f"l{i}") for i, f in enumerate(r.fields)],
    ]
    return r.df.where(F.col(r.id).isNotNull()).select(*cols).dropDuplicates(["src", "period", "id"])


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def _bin(v: Column) -> Column:
    """An integer that rises with the double v: sign, and 1/16 of an octave (infinities at the ends)."""
    finite = F.abs(v) < F.lit(float("inf"))
    size = F.when(finite, F.floor(F.log2(F.abs(v)) * _BINS).cast("int") + 2 * _FAR).otherwise(F.lit(3 * _FAR))
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size)


def _binned(rows: DataFrame, k: int) -> DataFrame:
    """(src, period, field, v, bin) of all readings but nulls and NaN."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.col(f"v{i}").alias("v")) for i in range(k)])).alias("x")
    return rows.select("src", "period", each).select("src", "period", "x.field", "x.v").where("v is not null and not isnan(v)").withColumn("bin", _bin(F.col("v")))


def charts(bins: np.ndarray, counts: np.ndarray, groups: np.ndarray, cfg: ChartConfig) -> tuple[np.ndarray, np.ndarray]:
    """Control limits of the periods of one chart, in logarithms.

    ``bins`` and ``counts`` are the usable readings, ``groups`` the number of the
    period of each, in order.  A period's limits come from the periods before it,
    those of the first ones from the start.
    """
    n = int(groups[-1]) + 1
    x = (bins - 2 * _FAR + 0.5) * _BIN
    ends = np.searchsorted(groups, np.arange(n), side="right")
    per_period = np.add.reduceat(counts, np.r_[0, ends[:-1]])
    first = int(np.searchsorted(np.cumsum(per_period), cfg.start)) + 1
    head = slice(0, int(ends[min(first, n) - 1]))
    level = _weighted_median(x[head], counts[head])
    scale = max(1.4826 * _weighted_median(np.abs(x[head] - level), counts[head]), cfg.least_scale)
    most = np.log(cfg.alarm)
    lo, hi = np.empty(n), np.empty(n)
    a = 0
    for i in range(n):
        cut = min(cfg.limit * scale, most)
        lo[i], hi[i] = level - cut, level + cut
        b = int(ends[i])
        most_dev = min(cfg.clip * scale, most)
        dev = np.clip(x[a:b] - level, -most_dev, most_dev)
        c = counts[a:b]
        total = c.sum()
        w = 1.0 - (1.0 - cfg.weight) ** float(total)
        level += w * float((dev * c).sum()) / total
        scale = max((1 - w) * scale + w * 1.2533 * float((np.abs(dev) * c).sum()) / total, cfg.least_scale)
        a = b
    return lo, hi


def _weighted_median(x: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(x, kind="stable")
    upto = np.cumsum(n[order])
    total = upto[-1]
    low, high = np.searchsorted(upto, (total + 1) // 2), np.searchsorted(upto, total // 2 + 1)
    return float(x[order][low] + x[order][high]) / 2


def _limits(counts: DataFrame, cfg: ChartConfig) -> DataFrame:
    """Per source, field and period the control limits, and where the source's median lies.

    ``counts`` are (src, field, period, bin, n).  Limits are those of the reading
    itself; where there is no chart they are null.
    """
    src_type = counts.schema["src"].dataType.simpleString()
    names = ["src", "field", "period", "lo", "hi", "low_bin", "low_below", "high_bin", "high_below", "total"]
    schema = f"src {src_type}, field int, period date, lo double, hi double, low_bin int, low_below bigint, high_bin int, high_below bigint, total bigint"

    def of_source(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["period", "bin"], kind="stable")
        bins, n = pdf["bin"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        periods, group = np.unique(pdf["period"].to_numpy(), return_inverse=True)
        lo, hi = np.full(len(periods), np.nan), np.full(len(periods), np.nan)
        usable = (bins > _FAR) & (bins < 3 * _FAR)
        total = int(n.sum())
        if 2 * int(n[usable].sum()) > total:
            own, inner = np.unique(group[usable], return_inverse=True)
            a, b = charts(bins[usable], n[usable], inner, cfg)
            # periods without a usable reading have nothing to judge
            lo[own], hi[own] = np.exp(a), np.exp(b)
        order = np.argsort(bins, kind="stable")
        upto = np.cumsum(n[order])
        places = [int(np.searchsorted(upto, k)) for k in ((total + 1) // 2, total // 2 + 1)]
        marks = []
        for at in places:
            one = bins[order][at]
            marks += [int(one), int(n[bins < one].sum())]
        out = pd.DataFrame({"src": pdf["src"].iloc[0], "field": pdf["field"].iloc[0], "period": periods, "lo": lo, "hi": hi})
        out["low_bin"], out["low_below"], out["high_bin"], out["high_below"] = marks
        out["total"] = total
        return out

    def of_sources(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A source and field at a time from rows sorted by them; a source has a bounded number of rows."""
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if pdf.empty:
                continue
            done: list[pd.DataFrame] = []
            bounds = [0, *(np.flatnonzero(_changes(pdf["src"]) | _changes(pdf["field"])) + 1).tolist(), len(pdf)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                part = pdf.iloc[a:b]
                if held and not (_equal(held[-1]["src"].iloc[-1], part["src"].iloc[0]) and held[-1]["field"].iloc[-1] == part["field"].iloc[0]):
                    done.append(of_source(pd.concat(held) if len(held) > 1 else held[0]))
                    held = []
                held.append(part)
            if done:
                yield pd.concat(done)[names]
        if held:
            yield of_source(pd.concat(held) if len(held) > 1 else held[0])[names]

    return counts.repartition("src", "field").sortWithinPartitions("src", "field").mapInPandas(of_sources, schema)


def _medians(binned: DataFrame, marks: DataFrame) -> DataFrame:
    """(src, field, median) from the values of the bins that ``marks`` names.

    The median of an even number of values is the mean of the two middle ones.
    """
    near = binned.alias("a").join(
        marks.alias("b"),
        F.col("a.src").eqNullSafe(F.col("b.src")) & (F.col("a.field") == F.col("b.field")) & ((F.col("a.bin") == F.col("b.low_bin")) | (F.col("a.bin") == F.col("b.high_bin"))),
    ).select("a.src", "a.field", "a.bin", "a.v", "b.low_bin", "b.low_below", "b.high_bin", "b.high_below", "b.total")
    keys = ["src", "field", "bin", "v", "low_bin", "low_below", "high_bin", "high_below", "total"]
    inside = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("src", "field", "bin").orderBy("v")
    placed = inside.withColumn("upto", F.sum("n").over(within) + F.when(F.col("bin") == F.col("low_bin"), F.col("low_below")).otherwise(F.col("high_below")))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    hit = lambda k: F.max(F.when((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k), F.col("v")))
    return placed.groupBy("src", "field").agg(((hit(low) + hit(high)) / 2).alias("median"))


def exact_medians(values: DataFrame) -> DataFrame:
    """(src, field, median) of rows (src, field, v) without nulls and NaN."""
    binned = values.withColumn("bin", _bin(F.col("v")))
    group = Window.partitionBy("src", "field")
    ranked = binned.groupBy("src", "field", "bin").agg(F.count(F.lit(1)).alias("n")).withColumns({"upto": F.sum("n").over(group.orderBy("bin")), "total": F.sum("n").over(group)})
    at = lambda k, c: F.max(F.when((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k), c))
    low, high, below = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1, F.col("upto") - F.col("n")
    marks = ranked.groupBy("src", "field").agg(
        at(low, F.col("bin")).alias("low_bin"), at(low, below).alias("low_below"), at(high, F.col("bin")).alias("high_bin"), at(high, below).alias("high_below"), F.max("total").alias("total")
    )
    return _medians(binned, marks)


def _bounded(small: DataFrame) -> DataFrame:
    """For joins: broadcast if it was counted and found small enough."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def implausible(r: Readings, cfg: ChartConfig = ChartConfig()) -> DataFrame:
    """Readings that can't be true: (id, field, nan, ratio, stuck, limit, out_of_control).

    nan, ratio, stuck and limit say which test a reading fails; rows that only
    leave the control limits of the chart come out with none of the four.
    """
    k = len(r.fields)
    rows = written(_prepared(r))
    binned = _binned(rows, k)
    limits = written(_limits(binned.groupBy("src", "field", "period", "bin").agg(F.count(F.lit(1)).alias("n")), cfg))
    marks = limits.select("src", "field", "low_bin", "low_below", "high_bin", "high_below", "total").distinct()
    medians = _bounded(written(_medians(binned, _bounded(marks))))

    of_field = lambda c, i: F.max(F.when(F.col("field") == i, F.col(c))).alias(f"{c}{i}")
    sized = rows.groupBy("src", "period").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("from"), F.max("place").alias("to"))
    wide = limits.groupBy("src", "period").agg(*[of_field(c, i) for i in range(k) for c in ("lo", "hi")])
    same_group = F.col("a.src").eqNullSafe(F.col("b.src")) & (F.col("a.period") == F.col("b.period"))
    groups = sized.alias("a").join(wide.alias("b"), same_group, "left").select("a.*", *[f"{c}{i}" for i in range(k) for c in ("lo", "hi")])
    # Slices are equal parts of the time (or of the ids) that a group covers.
    parts = F.ceil(F.col("n") / cfg.slice_rows)
    part = F.least(F.floor((F.col("place") - F.col("from")) / (F.col("to") - F.col("from") + 1) * parts), parts - 1).cast("int")
    charted = (
        rows.alias("a").join(_bounded(written(groups)).alias("b"), same_group, "left")
        .select("a.*", "b.n", "b.from", "b.to", *[f"{c}{i}" for i in range(k) for c in ("lo", "hi")])
        .withColumn("part", part).drop("n", "from", "to", "place")
    )
    slice_ = Window.partitionBy("src", "period", "part").orderBy(F.col("at").asc_nulls_first(), "id")
    upto, all_ = slice_.rowsBetween(Window.unboundedPreceding, 0), slice_.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fields = range(k)
    marked = {"row": F.row_number().over(slice_), "rows": F.count(F.lit(1)).over(all_)}
    for i in fields:
        v = F.col(f"v{i}")
        marked[f"f{i}"] = F.coalesce(v != F.lag(v).over(slice_), F.lit(True))  # NaN equals NaN; a null starts a run and ends one
        in_control = (v >= F.col(f"lo{i}")) & (v <= F.col(f"hi{i}"))
        marked[f"o{i}"] = v.isNotNull() & ~F.isnan(v) & ~F.coalesce(in_control, F.lit(False))
    runs = charted.withColumns(marked)
    # a: the row that a run starts with; b: how far into its run a row is; e: whether the run comes to ``stuck``;
    # h: length of the slice's first run; t: the row that its last run starts with.
    runs = runs.withColumns({f"a{i}": F.max(F.when(F.col(f"f{i}"), F.col("row"))).over(upto) for i in fields})
    runs = runs.withColumns({f"b{i}": F.col("row") - F.col(f"a{i}") + 1 for i in fields})
    ahead = slice_.rowsBetween(0, cfg.stuck - 1)  # a run that starts after this row is not that long in here
    runs = runs.withColumns({
        name: c for i in fields for name, c in (
            (f"e{i}", F.max(f"b{i}").over(ahead) >= cfg.stuck), (f"h{i}", F.max(F.when(F.col(f"a{i}") == 1, F.col(f"b{i}"))).over(all_)), (f"t{i}", F.max(f"a{i}").over(all_)),
        )
    })
    each = F.explode(F.array(*[
        F.struct(F.lit(i).alias("field"), *[F.col(f"{c}{i}").alias(n) for c, n in (("v", "v"), ("o", "out"), ("l", "limit"), ("a", "first"), ("e", "long"), ("h", "head_length"), ("t", "tail_first"))])
        for i in fields
    ])).alias("x")
    long = runs.select("src", "period", "part", "id", "row", "rows", each).select("src", "period", "part", "id", "row", "rows", "x.*")
    known = F.col("v").isNotNull()
    edge = F.when(F.col("first") == 1, 1).otherwise(0) + F.when(F.col("first") == F.col("tail_first"), 2).otherwise(0)
    length = F.when(F.col("first") == 1, F.col("head_length")).otherwise(F.col("rows") - F.col("tail_first") + 1)
    flagged = long.withColumns({"nan": F.coalesce(F.isnan("v"), F.lit(False)), "stuck": known & F.col("long"), "limit": known & F.col("limit"), "length": length, "edge": edge})
    # Kept are flagged readings, and the rows of short runs at the edges of a slice, which may go on in the next one.
    loose = (F.col("edge") > 0) & (F.col("length") < cfg.stuck)
    head = (F.col("edge") > 0) & (F.col("row") == F.col("first"))
    kept = written(flagged.where(F.col("nan") | F.col("stuck") | F.col("limit") | F.col("out") | loose | head).withColumn("head", head).drop("rows", "long", "head_length", "tail_first"))
    readings = kept.where("nan or stuck or limit or out").alias("a").join(
        medians.alias("b"), F.col("a.src").eqNullSafe(F.col("b.src")) & (F.col("a.field") == F.col("b.field")), "left"
    ).select("a.id", "a.field", "nan", (F.col("out") & ((F.col("v") > cfg.ratio * F.col("median")) | (F.col("v") < F.col("median") / cfg.ratio))).alias("ratio"), "stuck", "limit", "out")
    no = F.lit(False)
    extra = _stitch(kept, cfg.stuck).select("id", "field", no.alias("nan"), no.alias("ratio"), F.lit(True).alias("stuck"), no.alias("limit"), no.alias("out"))
    name = F.element_at(F.lit(list(r.fields)), F.col("field") + 1)
    return (
        readings.unionByName(extra).groupBy("id", "field").agg(*[F.max(F.coalesce(c, no)).alias(c) for c in ("nan", "ratio", "stuck", "limit", "out")])
        .select("id", name.alias("field"), "nan", "ratio", "stuck", "limit", F.col("out").alias("out_of_control"))
    )


def _changes(c: pd.Series) -> np.ndarray:
    """Where a value differs from the one before it (nulls are equal)."""
    a, b = c.iloc[1:].to_numpy(), c.iloc[:-1].to_numpy()
    return np.asarray(a != b, dtype=bool) & ~(pd.isna(a) & pd.isna(b))


def _equal(a, b) -> bool:
    return bool(a == b) or bool(pd.isna(a) and pd.isna(b))


def _stitch(kept: DataFrame, stuck: int) -> DataFrame:
    """Ids of short edge runs that are part of a run of ``stuck`` across slices.

    One row per edge run (its first reading), in order of source, period and
    slice.  Consecutive ones belong to one run if values are equal, the former
    touches the end of its slice and the latter the start of the next one.  A slice
    whose edges are nulls still has its edge rows, whose null equals nothing.
    """
    order = Window.partitionBy("src", "field").orderBy("period", "part", "row")
    heads = kept.where("head").select("src", "field", "period", "part", "row", "edge", "v", "length")
    goes_on = F.lag("edge").over(order).isin(2, 3) & F.col("edge").isin(1, 3) & (F.col("v") == F.lag("v").over(order))
    numbered = heads.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    whole = (
        numbered.withColumn("total", F.sum("length").over(Window.partitionBy("src", "field", "run")))
        .where((F.col("total") >= stuck) & (F.col("length") < stuck)).select("src", "field", "period", "part", F.col("row").alias("first"))
    )
    loose = kept.where((F.col("edge") > 0) & (F.col("length") < stuck) & F.col("v").isNotNull())
    same = F.col("a.src").eqNullSafe(F.col("b.src"))
    for c in ("field", "period", "part", "first"):
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return loose.alias("a").join(whole.alias("b"), same, "left_semi").select("id", "field")
