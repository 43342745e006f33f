"""Draws against the distribution, shares and caps of mixtures."""

import math
import random

import numpy as np
import pytest

from tidewheel.llm.mixture import draw, expected, fit, mean_for, mix, plan_mixture, read_targets, shares, sizes_of, thresholds

DOCS = "doc bigint, src string, n int, source string, copy int, tokens string"
TARGETS = "source string, target_share double, max_repeats int"


def test_inverse_and_means():
    for mean, most in ((0.3, 1), (1.7, 3), (5.0, 4)):
        t = thresholds(mean, most)
        want = [math.exp(-mean) * mean**k / math.factorial(k) for k in range(most)]
        assert all(abs(a - sum(want[: i + 1])) < 1e-12 for i, a in enumerate(t))
    for most in (1, 2, 4):
        for rate in (0.01, 0.5, 0.9 * most):
            assert abs(expected(mean_for(rate, most), most) - rate) < 1e-9
        assert math.isinf(mean_for(most, most)) and expected(math.inf, most) == most


def frames(spark, docs, targets):
    return spark.createDataFrame([(i, s, n, "x", 9, "y") for i, s, n in docs], DOCS), spark.createDataFrame(targets, TARGETS)


def test_shares_and_caps(spark):
    rnd = random.Random(3)
    docs = [(i, "big", rnd.randrange(1, 400)) for i in range(6000)] + [(10_000 + i, "mid", rnd.randrange(1, 400)) for i in range(800)] + [(20_000 + i, "low", rnd.randrange(1, 400)) for i in range(300)]
    docs += docs[:500] + [(30_000, None, 5), (30_001, "unlisted", 5), (None, "big", 5), (30_002, "low", None)]
    docs.sort(key=lambda d: str(d))
    df, t = frames(spark, docs, [("big", 0.4, 1), ("mid", 0.35, 4), ("low", 0.2, 6), ("absent", 0.05, 2), (None, 0.5, 1), ("bad", -1.0, 1)])
    mixture, report = mix(df, t, "doc", "src", "n")
    rows = mixture.collect()
    most = {"big": 1, "mid": 4, "low": 6}
    seen = {}
    for r in rows:
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
        assert r.source in most and r.copy <= most[r.source]
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows)
    total = sum(r.tokens for r in rows)
    for s, share in (("big", 0.4), ("mid", 0.35), ("low", 0.2)):
        got = sum(r.tokens for r in rows if r.source == s) / total
        assert abs(got - share / 0.95) < 0.004
    rep = {r.source: r for r in report.collect()}
    assert set(rep) == {"big", "mid", "low", "absent"} and rep["absent"].mixed_tokens == 0 and rep["absent"].actual_share == 0
    assert abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-5
    assert rep["low"].most_repeats <= 6
    # the same draw again, in whatever partitions
    again = {(r.doc_id, r.copy) for r in mix(df.repartition(7), t, "doc", "src", "n")[0].collect()}
    assert again == {(r.doc_id, r.copy) for r in rows}


def test_draws_follow_poisson(spark):
    df, t = frames(spark, [(i, "a", 1) for i in range(20_000)] + [(50_000 + i, "b", 1) for i in range(20_000)], [("a", 0.3, 8), ("b", 0.7, 1)])
    plans = read_targets(t)
    sized = sizes_of(df, plans, "doc", "src", "n")
    plan_mixture(sized, plans, 1)
    counts = {}
    for r in draw(sized, plans, 1).where("source = 'a'").collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    mean = plans["a"].mean
    for k in range(3):
        share = (sum(1 for n in counts.values() if n == k) + (20_000 - len(counts) if k == 0 else 0)) / 20_000
        assert share == pytest.approx(math.exp(-mean) * mean**k / math.factorial(k), abs=0.015)


def test_total_and_empty(spark):
    df, t = frames(spark, [(i, "a", 10) for i in range(1000)], [("a", 1.0, 3)])
    m, _ = mix(df, t, "doc", "src", "n", total=5000)
    assert abs(sum(r.tokens for r in m.collect()) - 5000) <= 50
    for docs, targets in (([], [("a", 1.0, 1)]), ([(1, "a", 5)], []), ([(1, "a", 0)], [("a", 1.0, 1)])):
        d, t = frames(spark, docs, targets)
        m, rep = mix(d, t, "doc", "src", "n")
        assert m.count() == 0
        assert all(r.actual_share == 0 for r in rep.collect())
    assert shares(m, {}).count() == 0


def test_fitted_mean_draws_the_goal():
    rnd = random.Random(9)
    for n, most in ((50, 1), (5000, 3)):
        docs = [(rnd.random(), rnd.choice([1, 10, 500])) for _ in range(n)]
        tokens = np.zeros(65_536)
        for u, k in docs:
            tokens[int(u * 65_536)] += k
        goal = 0.4 * most * sum(k for _, k in docs)
        levels = thresholds(fit(tokens, goal, most), most)
        assert abs(sum(k * sum(u >= t for t in levels) for u, k in docs) - goal) <= 1000 * most


def test_report_shows_both_means(spark):
    df, t = frames(spark, [(i, "a", 1 + i % 50) for i in range(3000)] + [(5000 + i, "b", 9) for i in range(3000)], [("a", 0.9, 1), ("b", 0.1, 4)])
    rep = {r.source: r for r in mix(df, t, "doc", "src", "n")[1].collect()}
    assert math.isinf(rep["a"].poisson_mean) and math.isinf(rep["a"].fitted_mean)
    assert 0 < abs(rep["b"].fitted_mean / rep["b"].poisson_mean - 1) < 0.2
