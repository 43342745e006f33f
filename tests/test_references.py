"""Orphan references against brute force, hot keys and odd input included."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewheel.operators.references import ParentLog, References, _merged, classify_references, orphan_report, orphans

T0 = datetime(2024, 1, 1)
REFS = "id string, key double, at timestamp_ntz, t string, w int, slice string"
LOG = "key double, at timestamp_ntz, seq bigint, weight int, k string"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def brute(refs, log):
    out = {}
    for i, key, t, *_ in refs:
        if key is None:
            continue
        own = [r for r in log if r[0] == key and r[1] is not None and r[3]]
        inserts = [r[1] for r in own if r[3] > 0]
        before = sorted((r[1], r[2], r[3]) for r in own if t is not None and r[1] <= t)
        if before and before[-1][2] > 0:
            status = "valid"
        elif not inserts:
            status = "missing"
        elif t is None or t < min(inserts):
            status = "late"
        else:
            status = "deleted"
        out[i] = status
    return out


def run(spark, refs, log, hot=100_000):
    child = {"uses": References(spark.createDataFrame(refs, REFS), "id", "key", "at")}
    parent = ParentLog(spark.createDataFrame(log, LOG), "key", "at", "seq", "weight")
    return child, parent, {r.id: r.status for r in classify_references(child, parent, hot).collect()}


@pytest.mark.parametrize("hot", [5, 100_000])
def test_against_brute_force(spark, hot):
    rnd = random.Random(3)
    keys = [1.0] * 6 + [2.0, 3.0, 4.0, 5.0, 99.0]
    refs = [(f"r{i}", rnd.choice(keys), at(rnd.randrange(0, 20_000)), "x", 1, "y") for i in range(400)]
    log = []
    for s in range(60):
        log.append((rnd.choice(keys[:-1]), at(rnd.randrange(0, 20_000)), s, rnd.choice([1, 1, -1]), "z"))
    refs += refs[:20]
    log += log[:5]
    _, _, got = run(spark, refs, log, hot)
    assert got == brute(refs, log)
    assert len(set(got.values())) == 4


@pytest.mark.parametrize("hot", [1, 100])
def test_edges(spark, hot):
    refs = [
        ("null key", None, at(1), "", 0, ""), ("null time", 1.0, None, "", 0, ""), ("at insert", 1.0, at(10), "", 0, ""), ("tie", 2.0, at(10), "", 0, ""), ("only deletes", 3.0, at(10), "", 0, ""), ("again", 1.0, at(5000), "", 0, ""), (None, 1.0, at(1), "", 0, ""),
    ]
    log = [(1.0, at(10), 1, 1, ""), (2.0, at(10), 1, -1, ""), (2.0, at(10), 2, 1, ""), (3.0, at(1), 3, -1, ""), (1.0, at(3000), 4, -1, ""), (1.0, at(4000), 5, 1, ""), (None, at(1), 6, 1, ""), (1.0, None, 7, -1, "")]
    _, _, got = run(spark, refs, log, hot)
    assert got == {"null time": "late", "at insert": "valid", "tie": "valid", "only deletes": "missing", "again": "valid", None: "late"}


def test_report_and_empty(spark):
    child, parent, got = run(spark, [], [])
    assert got == {}
    child, parent, got = run(spark, [("a", 1.0, at(1), "", 0, ""), ("a", 1.0, at(1), "", 0, ""), ("b", 1.0, at(60 * 24 * 40), "", 0, "")], [])
    assert {r.id for r in orphans(child, parent).collect()} == {"a", "b"}
    assert {(r.table_name, r.period, r.reason, r.n) for r in orphan_report(child, parent).collect()} == {("uses", "2024-01", "missing", 1), ("uses", "2024-02", "missing", 1)}


def test_a_hot_key_is_cut_down_to_minutes(spark):
    """Ninety percent of the rows at one key, most within two hours and many without time: no group stays large."""
    rnd = random.Random(12)
    refs = [(f"r{i}", 1.0 if i % 10 else 2.0, None if i % 9 == 0 else at(rnd.choice([rnd.randrange(0, 40_000), 1000 + rnd.randrange(0, 120)])), "x", 1, "y") for i in range(3000)]
    log = [(rnd.choice([1.0, 2.0]), at(rnd.choice([rnd.randrange(0, 40_000), 1000 + rnd.randrange(0, 120)])), s, rnd.choice([1, -1]), "z") for s in range(200)]
    _, _, want = run(spark, refs, log)
    assert want == brute(refs, log)
    child = spark.createDataFrame(refs, REFS).select(F.lit("uses").alias("src"), "id", F.col("key").alias("k"), F.col("at").alias("t"))
    parent = spark.createDataFrame(log, LOG).select(F.col("key").alias("k"), F.col("at").alias("t"), "seq", F.col("weight").alias("w"))
    for hot, most in ((100_000, 3000), (40, 60)):
        assert run(spark, refs, log, hot)[2] == want
        assert _merged(child, parent, hot).groupBy("k", "slice").count().agg(F.max("count")).first()[0] <= most
