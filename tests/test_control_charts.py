"""Implausible readings against brute force; charts, medians and runs on their own."""

import math
import random
from datetime import datetime, timedelta
from statistics import median

import numpy as np
from pyspark.sql import functions as F

from tidewheel.operators.control_charts import ChartConfig, Readings, charts, exact_medians, implausible

SCHEMA = "trip bigint, loc bigint, at timestamp_ntz, dist double, fare double, src string, period string"
T0 = datetime(2024, 1, 1)


def brute(rows):
    rows = list({r[0]: r for r in rows if r[0] is not None}.values())
    out = {}
    for loc in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == loc), key=lambda r: (r[2] is not None, r[2] or T0, r[0]))
        for name, c in (("dist", 3), ("fare", 4)):
            known = [r[c] for r in own if r[c] is not None and not math.isnan(r[c])]
            m = median(known) if known else math.nan
            run = []

            def close(run=run):
                return len(run) >= 8

            groups, last = [], object()
            for r in own:
                v = r[c]
                same = v is not None and (v == last or (isinstance(last, float) and math.isnan(last) and math.isnan(v)))
                if not same:
                    groups.append([])
                groups[-1].append(r)
                last = v if v is not None else object()
            stuck = {r[0] for g in groups if len(g) >= 8 for r in g}
            for r in own:
                v = r[c]
                if v is None:
                    continue
                if math.isnan(v) or v > 6 * m or v < m / 6 or r[0] in stuck or (name == "dist" and v > 900):
                    out[r[0], name] = True
    return set(out)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = implausible(Readings(df, "trip", "loc", "at", ("dist", "fare"), (("dist", F.col("dist") > 900),)))
    return {(r.id, r.field) for r in got.where("nan or ratio or stuck or limit").collect()}


def test_against_brute_force(spark):
    rnd = random.Random(1)
    rows, i = [], 0
    for loc, level in ((1, 2.0), (2, 9.0), (3, 0.5), (None, 4.0)):
        for step in range(300 if loc != 1 else 900):
            i += 1
            dist = round(level * math.exp(rnd.gauss(0, 0.5)), 2)
            if rnd.random() < 0.03:
                dist = rnd.choice([0.0, -1.0, level * 7, level / 7, float("nan"), float("inf"), None, level * 5.9, level / 5.9, 1000.0])
            fare = round(level * 3 * math.exp(rnd.gauss(0, 0.3)), 2) if rnd.random() > 0.02 else None
            rows.append((i, loc, T0 + timedelta(hours=step * 0.7), dist, fare, "a", "b"))
    # stuck values: within a day, across days, cut by a null, across an empty day, of NaN
    for base, hours, values in ((10_000, 0.1, [5.5] * 8), (11_000, 5, [6.6] * 9), (12_000, 0.1, [7.7] * 7 + [None] + [7.7] * 7), (13_000, 30, [8.8] * 10), (14_000, 7, [float("nan")] * 9), (15_000, 20, [3.3] * 7)):
        for k, v in enumerate(values):
            rows.append((base + k, base, T0 + timedelta(hours=k * hours), v, v, "a", "b"))
    rows.append((20_000, 1, None, 2.0, 6.0, "a", "b"))
    rows += rows[:50]
    rnd.shuffle(rows)
    want = brute(rows)
    assert run(spark, rows) == want
    assert len(want) > 60


def test_empty_and_null_ids(spark):
    assert run(spark, []) == set()
    assert run(spark, [(None, 1, T0, 1.0, 1.0, "", "")]) == set()
    assert run(spark, [(1, 1, T0, None, float("nan"), "", "")]) == {(1, "fare")}


def test_medians_are_exact(spark):
    rnd = random.Random(2)
    values = {s: [rnd.choice([rnd.gauss(0, 10), 1.25, 0.0, -0.5, 1e300, -1e-300, float("inf")]) for _ in range(n)] for s, n in ((1, 101), (2, 100), (3, 1), (None, 2))}
    df = spark.createDataFrame([(s, 0, v) for s, vs in values.items() for v in vs], "src bigint, field int, v double")
    got = {r.src: r.median for r in exact_medians(df).collect()}
    assert got == {s: median(vs) for s, vs in values.items()}


def test_chart_clips_spikes_and_follows_the_source():
    cfg = ChartConfig()
    place = lambda v: np.floor(np.log2(np.array(v)) * 16).astype(np.int64) + 2_000_000
    # ten readings a period; a tenth of the readings of ten periods are spikes and do not drag the chart along
    v, groups = [], []
    for t in range(60):
        v += [10.0 * (1 + 0.1 * (i % 3)) for i in range(10)]
        if 20 <= t < 30:
            v[-1] = 1e6
        groups += [t] * 10
    lo, hi = charts(place(v), np.ones(len(v), dtype=np.int64), np.array(groups), cfg)
    assert (np.exp(lo) < 10).all() and (np.exp(hi) > 12).all() and (np.exp(hi) < 40).all() and (np.exp(lo) > 3).all()
    # a level that moves slowly is followed far beyond the first one, state going from period to period
    v = [2.0 * 1.05**t for t in range(100) for _ in range(10)]
    lo, hi = charts(place(v), np.ones(len(v), dtype=np.int64), np.repeat(np.arange(100), 10), cfg)
    assert np.exp(lo[-1]) < v[-1] < np.exp(hi[-1]) and np.exp(lo[-1]) > 10 * v[0]
    # no limit is wider than the alarm factor
    assert (hi - lo <= 2 * math.log(cfg.alarm) + 1e-9).all()


def test_the_chart_decides(spark):
    """What is in control at its time is not held against the median; without alarms nothing is."""
    rows = [(i, 1, T0 + timedelta(hours=i), round(2.0 * 1.02 ** (i / 4), 3), 1.0 + i % 2, "a", "b") for i in range(800)]
    rows[400] = (400, 1, rows[400][2], rows[400][3] * 40, 1.0, "a", "b")
    df = spark.createDataFrame(rows, SCHEMA)
    found = implausible(Readings(df, "trip", "loc", "at", ("dist", "fare")))
    got = {(r.id, r.field) for r in found.where("ratio").collect()}
    assert got == {(400, "dist")}
    level = median(r[3] for r in rows)
    assert sum(r[3] > 6 * level or r[3] < level / 6 for r in rows) > 50
    wide = implausible(Readings(df, "trip", "loc", "at", ("dist", "fare")), ChartConfig(alarm=1e9, limit=1e9))
    assert wide.where("ratio").count() == 0


def test_a_hot_source_is_cut_into_slices(spark):
    """Ninety percent of the rows at one source and day: the same rows, whatever the slices."""
    rnd = random.Random(6)
    rows = [(i, 1 if i % 10 else 2, T0 + timedelta(seconds=i * 20), rnd.choice([1.0, 1.5, 2.0, 2.0, 30.0]), None if i % 97 == 0 else 3.0, "a", "b") for i in range(3000)]
    rows += [(5000 + i, 1, None, rnd.choice([1.0, 2.0]), 3.0, "a", "b") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(i, f) for i, f in brute(rows)}
    for n in (7, 50, 100_000):
        got = implausible(Readings(df, "trip", "loc", "at", ("dist", "fare"), (("dist", F.col("dist") > 900),)), ChartConfig(slice_rows=n))
        assert {(r.id, r.field) for r in got.where("nan or ratio or stuck or limit").collect()} == want


def test_long_series_of_one_source(spark):
    rows = [(i, 7, T0 + timedelta(minutes=i), 2.0 + (i % 5) * 0.1, 5.0 + (i % 3), "a", "b") for i in range(20_000)]
    rows[777] = (777, 7, rows[777][2], 100.0, 5.0, "a", "b")
    assert run(spark, rows) == {(777, "dist")}
