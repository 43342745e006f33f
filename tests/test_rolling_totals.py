"""Trailing totals against brute force."""

import random
from datetime import date

from tidewheel.operators.rolling_totals import daily_totals, trailing_totals, with_amounts

SCHEMA = "card double, secs bigint, amt double, id string, day int, units string, entity string"
UNTIL = date(1970, 2, 15)  # day 45


def brute(rows):
    seen, sums = set(), {}
    for card, secs, amt, i, *_ in rows:
        if card is None or secs is None or i in seen:
            continue
        seen.add(i)
        day = secs // 86400
        if day > 45:
            continue
        ok = amt is not None and amt == amt and abs(amt) < float("inf")
        sums.setdefault(card, {}).setdefault(day, 0)
        sums[card][day] += round(amt * 100) if ok else 0
    out = {}
    for card, days in sums.items():
        for d in range(min(days), 46):
            out[card, d] = (d - min(days) + 1, sum(days.get(x, 0) for x in range(d - 6, d + 1)), sum(days.get(x, 0) for x in range(d - 29, d + 1)))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([1.0, 1.0, 2.0, 3.0, None]), rnd.choice([rnd.randrange(-86400 * 3, 86400 * 50), None]) if rnd.random() < 0.1 else rnd.randrange(0, 86400 * 50), rnd.choice([round(rnd.uniform(-50, 500), 2), None, float("nan"), float("inf"), 0.1, 0.2, 1e14]), f"t{i}", 1, "u", "e") for i in range(400)]
    rows.append((9.0, 86400 * 100, 1.0, "after", 1, "u", "e"))
    rows += rows[:30]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.entity, r.day): (r.age, r.units_7, r.units_30) for r in trailing_totals(daily_totals(df, "card", "secs", "amt", "id"), UNTIL).collect()}
    assert got == brute(rows)


def test_restriction_amounts_and_empty(spark):
    rows = [(1.0, 0, 10.0, "a", 1, "", ""), (2.0, 0, 10.0, "b", 1, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    only = spark.createDataFrame([(1.0,), (1.0,), (7.0,)], "entity double")
    out = with_amounts(trailing_totals(daily_totals(df, "card", "secs", "amt", "id"), date(1970, 1, 9), only=only)).collect()
    assert {r.entity for r in out} == {1.0} and len(out) == 9
    assert [(r.total_7, r.avg_7, r.total_30) for r in sorted(out, key=lambda r: r.day)][6:8] == [(10.0, 10.0 / 7, 10.0), (0.0, 0.0, 10.0)]
    assert trailing_totals(daily_totals(df.where("false"), "card", "secs", "amt", "id"), UNTIL).count() == 0


def test_vast_amounts_are_kept(spark):
    day = 86400
    rows = [(1.0, 0, 1e14, "a", 1, "", ""), (1.0, 5, 5.0, "b", 1, "", ""), (1.0, day, 1e300, "c", 1, "", ""), (1.0, 2 * day, -1e300, "d", 1, "", ""), (2.0, 0, 1e-8, "e", 1, "", "")]
    out = with_amounts(trailing_totals(daily_totals(spark.createDataFrame(rows, SCHEMA), "card", "secs", "amt", "id"), date(1970, 1, 4), (2,)), (2,)).collect()
    got = {(r.entity, r.day): r.total_2 for r in out}
    assert got[1.0, 0] == 1e14 + 5.0 and got[1.0, 1] == 1e300 and got[1.0, 2] == 0.0 and got[1.0, 3] == -1e300 and got[2.0, 0] == 0.0
    assert {r.units_2 for r in out if (r.entity, r.day) == (1.0, 0)} == {10**16 + 500}
