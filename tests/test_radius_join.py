"""The radius join against all pairs."""

import math
import random

import numpy as np
import pytest

from tidewheel.operators.radius_join import Places, VantageTree, haversine, radius_join, radius_join_report

L, R = "id string, lat double, lon double, cell string, d string", "id bigint, lat double, lon double, lb int, rb int"


def brute(left, right, km):
    def ok(p):
        return p[0] is not None and p[1] is not None and p[2] is not None and -90 <= p[1] <= 90 and -180 <= p[2] <= 180 and (p[1], p[2]) != (0, 0)

    out = set()
    for a in filter(ok, left):
        for b in filter(ok, right):
            d = haversine(*(np.array([math.radians(x)]) for x in (a[1], a[2], b[1], b[2])))[0]
            if d <= km:
                out.add((a[0], b[0]))
    return out


def run(spark, left, right, km, **kw):
    a = Places(spark.createDataFrame(left, L), "id", "lat", "lon")
    b = Places(spark.createDataFrame(right, R), "id", "lat", "lon")
    rows = [tuple(r) for r in radius_join(a, b, km, **kw).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("kw", [{}, {"block_rows": 20}, {"pivots": 3, "block_rows": 15}, {"pivots": 2, "cell_rows": 10}])
def test_against_all_pairs(spark, kw):
    rnd = random.Random(5)
    spots = [(40.0, -74.0), (89.99, 10.0), (-89.99, -170.0), (10.0, 179.99), (10.0, -179.99), (0.0, 0.01)]
    near = lambda s: (max(-90.0, min(90.0, s[0] + rnd.gauss(0, 0.01))), max(-180.0, min(180.0, s[1] + rnd.gauss(0, 0.01))))
    left = [(f"l{i}", *near(rnd.choice(spots)), "x", "y") for i in range(300)]
    right = [(i, *near(rnd.choice(spots)), 1, 2) for i in range(150)]
    right += [(1000 + i, 40.0, -74.0, 1, 2) for i in range(60)]  # many at one place
    left += [("null", None, 1.0, "", ""), ("zero", 0.0, 0.0, "", ""), ("far", 91.0, 0.0, "", ""), ("nan", float("nan"), 1.0, "", ""), (None, 40.0, -74.0, "", ""), left[0], left[0]]
    right += [(5000, None, None, 1, 1), (5001, 0.0, 0.0, 1, 1), (5002, 10.0, 181.0, 1, 1), right[0]]
    want = brute(left, right, 2.0)
    assert run(spark, left, right, 2.0, **kw) == {(a, b) for a, b in want}
    assert len(want) > 1000


def test_empty_sides(spark):
    assert run(spark, [], [(1, 1.0, 1.0, 1, 1)], 2.0) == set()
    assert run(spark, [("a", 1.0, 1.0, "", "")], [], 2.0) == set()
    assert run(spark, [("a", 50.0, 1.0, "", "")], [(1, 1.0, 1.0, 1, 1)], 2.0) == set()


def test_tree_with_equal_places():
    lat = np.r_[np.zeros(500), np.full(40, 0.1)]
    tree = VantageTree(lat, np.zeros(540))
    found = sum(len(i) for i, _ in tree.within(np.array([0.0, 0.1]), np.array([0.0, 0.0]), 1.0))
    assert found == 540


def test_ids_with_several_places(spark):
    # both places of an id in one cell or in different ones: each pair once
    assert run(spark, [("a", 10.0, 10.0, "", ""), ("b", 10.1, 10.1, "", "")], [(1, 10.0, 10.0, 1, 1), (1, 10.1, 10.1, 1, 1)], 2.0) == {("a", 1), ("b", 1)}
    right = [(1, 10.0, 10.0, 1, 1), (1, 10.005, 10.0, 1, 1), (2, 10.005, 10.0, 1, 1)]
    left = [("a", 10.0, 10.0, "", ""), ("a", 10.004, 10.0, "", "")]
    for pivots in (1, 2, 16):
        assert run(spark, left, right, 2.0, pivots=pivots) == {("a", 1), ("a", 2)}


def test_heavy_cells_are_cut_again(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.uniform(40.0, 41.0), rnd.uniform(-74.0, -73.0), 1, 2) for i in range(4000)]
    places = Places(spark.createDataFrame(rows, R), "id", "lat", "lon")
    one = radius_join_report(places, places, 1.0, pivots=2, cell_rows=10_000)
    two = radius_join_report(places, places, 1.0, pivots=2, cell_rows=100)
    assert one["cells"] == 2 and one["largest"] > 1000
    assert two["cells"] > 20 and two["largest"] < 600
