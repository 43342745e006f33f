"""Rolling means and counts: brute force, hot keys in slices, values of any size."""

import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewheel.operators import timeseries as ts
from tidewheel.plans import features

SCHEMA = "id string, k string, t bigint, v double, __n string, __slice int"


def rolled(spark, rows, hot, ranges=((-50, -1), (-500, -1), (-5, 5))):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).drop("__n", "__slice")
    means = {f"m{i}": (F.col("v"), *r) for i, r in enumerate(ranges)}
    out = ts.rolling_features(df, ["k"], "t", "id", means, {"n": (-100, -1)}, hot)
    return {r.id: tuple(r[c] for c in (*means, "n")) for r in out.collect()}


def brute(rows, ranges=((-50, -1), (-500, -1), (-5, 5))):
    out = {}
    for i, k, t, _ in rows:
        if t is None:
            continue
        own = [(u, v) for _, q, u, v in rows if q == k and u is not None]
        got = []
        for a, b in ranges:
            inside = [v for u, v in own if t + a <= u <= t + b and v is not None]
            if any(math.isnan(v) for v in inside) or {math.inf, -math.inf} <= set(inside):
                got.append("nan")
            else:
                got.append(sum(inside) / len(inside) if inside else None)
        out[i] = (*got, sum(t - 100 <= u <= t - 1 for u, _ in own))
    return out


def same(a, b):
    assert set(b) <= set(a)
    for i, want in b.items():
        for x, y in zip(a[i], want):
            if y == "nan":
                assert math.isnan(x)
            elif y is None or math.isinf(y):
                assert x == y
            else:
                assert x == pytest.approx(y, rel=1e-12, abs=1e-15)


def data(n=400):
    rnd = random.Random(3)
    value = lambda: rnd.choice([round(rnd.uniform(-5, 300), 2)] * 20 + [None, float("nan"), float("inf"), -float("inf"), 1e-8])
    rows = [(f"r{i}", rnd.choice(["hot"] * 18 + ["a", None]), rnd.randrange(-300, 2000) if i % 9 else 77, value()) for i in range(n)]
    return [*rows, ("late", "hot", None, 5.0), ("later", None, None, 5.0)]


@pytest.mark.parametrize("hot", [20, 10**6])
def test_against_brute_force(spark, hot):
    rows = data()
    same(rolled(spark, rows, hot), brute(rows))


def test_no_group_grows_with_its_key(spark, monkeypatch):
    """Ninety percent of the rows at one key: the largest group of a window is a slice."""
    rows, seen = data(1000), []
    real = Window.partitionBy
    monkeypatch.setattr(ts.Window, "partitionBy", staticmethod(lambda *c: seen.append(c) or real(*c)))
    same(rolled(spark, rows, 50), brute(rows))
    assert ("k", "__slice") in seen
    assert rolled(spark, [], 50) == {}


def test_values_of_any_size(spark):
    rows = [("a", "k", 0, 1e14), ("b", "k", 1, 1e-8), ("c", "k", 2, 1e300), ("d", "k", 10, 3.0), ("e", "q", 0, 1e-30), ("f", "q", 1, 2.0), ("g", "q", 2, 2.0)]
    for hot in (1, 100):
        got = rolled(spark, rows, hot, ((-1, 0), (-2, -1)))
        assert got["a"][0] == 1e14 and got["b"][0] == (1e14 + 1e-8) / 2 and got["c"][0] == 1e300 / 2 and got["d"][0] == 3.0
        assert got["e"][0] == 1e-30 and got["f"][0] == 1.0 and got["g"][1] == 1.0


@pytest.mark.parametrize("hot", [2, 10**6])
def test_rows_without_time_have_one_another_as_range(spark, hot):
    rows = [("a", "k", None, 2.0), ("b", "k", None, 4.0), ("c", "k", 0, 10.0), ("d", "k", 1, 30.0), ("e", "k", 900, 1.0), ("f", "q", None, 7.0)]
    got = rolled(spark, rows, hot, ((-50, -1), (1, 5)))
    assert got["a"] == got["b"] == (3.0, 3.0, 2) and got["f"] == (7.0, 7.0, 1)
    assert got["c"] == (None, 30.0, 0) and got["d"] == (10.0, None, 1) and got["e"] == (None, None, 0)


TRIPS = "trip_id bigint, lpep_pickup_datetime timestamp_ntz, lpep_dropoff_datetime timestamp_ntz, pickup_location_id bigint, dropoff_location_id bigint, trip_distance double, fare_amount double"


def trips(spark, rows, hot):
    """(id, place, pickup, count, mean, count at the dropoff): pickups and dropoffs are the same moments and places."""
    out = features.trip_features(spark.createDataFrame([(i, at, at, k, k, away, fare) for i, k, at, away, fare in rows], TRIPS), hot)
    return [(r.trip_id, r.pickup_location_id, r.lpep_pickup_datetime, r.trip_distance, r.count_trips_window_1h_pickup_zip, r.mean_fare_window_1h_pickup_zip, r.count_trips_window_30m_dropoff_zip) for r in out.collect()]


@pytest.mark.parametrize("hot", [2, 10**6])
def test_trips_count_fractions_of_a_second_and_missing_times(spark, hot):
    noon, us = dt.datetime(2024, 1, 5, 12), lambda n: dt.timedelta(microseconds=n)
    rows = [
        (1, 7, noon + us(500_000), 1.0, 5.0), (2, 7, noon + us(1_000_000), 1.0, 6.0), (3, 7, noon + us(1_500_000), math.inf, 9.0), (4, 7, noon + us(3_600_500_000), 1.0, 1.0), (5, 7, noon + us(3_600_500_001), 1.0, 2.0),
        (6, 7, None, 1.0, 10.0), (7, 7, None, 1.0, 20.0),
    ]
    got = {r[0]: r[3:] for r in trips(spark, rows, hot)}
    assert got[2] == (1.0, 0, None, 0)  # half a second after the first
    assert got[3] == (math.inf, 1, 5.0, 1)  # a second after the first, half a second after the second
    assert got[4] == (1.0, 3, 20 / 3, 0) and got[5] == (1.0, 2, 7.5, 0)  # the first is an hour before, and a millionth more
    assert got[6] == got[7] == (1.0, 2, 15.0, 2)


def test_trips_of_hot_places_need_no_ids(spark):
    """Null and repeated ids: the rows of a place that is cut are those of one that is not."""
    rnd, noon = random.Random(5), dt.datetime(2024, 1, 5, 12)
    rows = [(rnd.choice([None, 1, 2, i]), rnd.choice([7, 7, 7, 8, None]), noon + dt.timedelta(seconds=rnd.randrange(20_000)), 1.0, float(i)) for i in range(300)]
    whole = trips(spark, rows, 10**6)
    assert len(whole) == 300 and Counter(trips(spark, rows, 20)) == Counter(whole)
    for i, k, at, _, n, mean, half in whole:
        own = [(at - u, v) for _, q, u, _, v in rows if q == k]
        fares = [v for s, v in own if 1 <= s.total_seconds() <= 3600]
        assert n == len(fares) and half == sum(1 <= s.total_seconds() <= 1800 for s, _ in own)
        assert mean == (pytest.approx(sum(fares) / n, rel=1e-12) if n else None)
