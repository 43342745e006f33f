"""Incremental operators: golden sequences of changes, and sums of changes against the batch operator."""

import random

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import aggregates, inputs, joins, recursion
from tidewheel.operators import timeseries as ts
from tidewheel.plans import galen, graph_plan
from tidewheel.streaming.circuit import Circuit, Operator
from tidewheel.zset import W, consolidate, distinct, minus, neg, plus, sum_of, weighted


def z(spark, rows, schema):
    """rows of (values.., weight)."""
    return spark.createDataFrame(rows, f"{schema}, {W} bigint")


def rows(df):
    return {tuple(r)[:-1]: r[-1] for r in consolidate(df).collect()}


def test_join_golden(spark):
    c = Circuit(spark, compact_every=2)
    a, b = c.add_input("a", "k int, x string"), c.add_input("b", "k int, y string")
    a.join(b, ["k"]).map("k", F.concat_ws(" ", "x", "y").alias("v")).output("out")
    A, B = "k int, x string", "k int, y string"  # noqa: N806
    ticks = [
        ([(1, "a", 1), (1, "b", 2), (2, "c", 3), (2, "d", 4), (3, "e", 5), (3, "f", -2)], [(2, "g", 3), (2, "h", 4), (3, "i", 5), (3, "j", -2), (4, "k", 5), (4, "l", -2)],
         {(2, "c g"): 9, (2, "c h"): 12, (2, "d g"): 12, (2, "d h"): 16, (3, "e i"): 25, (3, "e j"): -10, (3, "f i"): -10, (3, "f j"): 4}),
        ([(1, "a", 1)], [(1, "b", 1)], {(1, "a b"): 2, (1, "b b"): 2}),
        ([(1, "a", 1)], [(4, "m", 1)], {(1, "a b"): 1}),
        ([(4, "n", 2)], [], {(4, "n k"): 10, (4, "n l"): -4, (4, "n m"): 2}),
    ]
    for left, right, want in ticks:
        assert rows(c.step(a=z(spark, left, A), b=z(spark, right, B))["out"]) == want


def test_set_and_map_inputs_golden(spark):
    c = Circuit(spark)
    c.add_input_set("s", "k string").output("out")
    cmd = lambda *x: spark.createDataFrame([(k, ins, i) for i, (k, ins) in enumerate(x)], "k string, insert boolean, seq int")
    got = [rows(c.step(s=cmd(*x))["out"]) for x in ([("foo", True), ("bar", True)], [("foo", True), ("bar", False)], [("foo", False), ("foo", True)], [("foo", False), ("bar", False)])]
    assert got == [{("foo",): 1, ("bar",): 1}, {("bar",): -1}, {}, {("foo",): -1}]
    c = Circuit(spark)
    c.add_input_map("m", "k int, v string", ["k"]).output("out")
    cmd = lambda *x: spark.createDataFrame([(k, v, v is None, i) for i, (k, v) in enumerate(x)], "k int, v string, delete boolean, seq int")
    got = [rows(c.step(m=cmd(*x))["out"]) for x in ([(1, "foo"), (2, "bar")], [(1, "foo"), (2, "baz")], [(1, None), (2, "bar"), (2, None)])]
    assert got == [{(1, "foo"): 1, (2, "bar"): 1}, {(2, "bar"): -1, (2, "baz"): 1}, {(1, "foo"): -1, (2, "baz"): -1}]


@pytest.mark.parametrize("a1,a2,want", [([2001, 4000, 11000], [20000], {(1, 1)}), ([2001, 4000, 11000, 15000], [19000], {(1, 2)}), ([2000, 3999, 8000], [2000, 3999], {(1, 2), (2, 2)})])
def test_hot_items_golden(spark, a1, a2, want):
    from tidewheel.plans import auction

    bid = spark.createDataFrame([(1, t) for t in a1] + [(2, t) for t in a2], "auction bigint, date_time bigint")
    assert {tuple(r) for r in auction.q5({"bid": bid}).collect()} == want


def hot_items(c):
    e = c.add_input("bid", "auction bigint, t bigint")
    bounds = e.watermark("t", 4000).apply_scalar(lambda m: ts.closed_window(m, 10_000, 2_000))
    n = e.window("t", bounds).aggregate(["auction"], lambda d: aggregates.aggregate_linear(d, ["auction"], F.lit(1), "n"))
    top = n.map(F.lit(1).alias("all"), "n").aggregate(["all"], lambda d: aggregates.maximum(d, ["all"], F.col("n"), "n"))
    n.join(top.map("n"), ["n"]).map("auction", "n").output("out")


def test_hot_items_ticks_golden(spark):
    c = Circuit(spark)
    hot_items(c)
    tick = lambda a1, a2: rows(c.step(bid=spark.createDataFrame([(1, t) for t in a1] + [(2, t) for t in a2], "auction bigint, t bigint"))["out"])
    assert tick([2000, 4000, 6000], [2000, 4000, 8000, 12000]) == {(1, 3): 1}
    assert tick([20000], []) == {(2, 2): 1, (1, 3): -1}


def test_window_drops_late_rows(spark):
    c = Circuit(spark)
    e = c.add_input("e", "t bigint, x string")
    clock = c.add_scalar("clock", 1000)
    e.window("t", clock.apply_scalar(lambda n: (n - 100, n))).output("out")
    put = lambda clock, *r: rows(c.step(clock=clock, e=z(spark, [(*x, 1) for x in r], "t bigint, x string"))["out"])
    assert put(1000, (700, "late"), (900, "a"), (999, "b"), (1000, "soon")) == {(900, "a"): 1, (999, "b"): 1}
    assert put(1010, (900, "late"), (1005, "c")) == {(900, "a"): -1, (1000, "soon"): 1, (1005, "c"): 1}
    assert put(2000) == {(999, "b"): -1, (1000, "soon"): -1, (1005, "c"): -1}


def test_label_propagation_golden(spark):
    c = Circuit(spark)
    e, lab = c.add_input("e", "src int, dst int"), c.add_input("l", "id int, label string")
    f = lambda a, b: weighted(recursion.propagate_labels(distinct(a).drop(W), distinct(b).drop(W)))
    e.recursive2(lab, f).output("out")
    E, L = "src int, dst int", "id int, label string"  # noqa: N806
    t1 = c.step(e=z(spark, [(1, 2, 1), (2, 3, 1), (3, 4, 1), (4, 1, 1)], E), l=z(spark, [(1, "l1", 1)], L))["out"]
    t2 = c.step(e=z(spark, [(4, 5, 1)], E), l=z(spark, [(2, "l2", 1)], L))["out"]
    t3 = c.step(e=z(spark, [(1, 2, -1)], E))["out"]
    assert rows(t1) == {(i, "l1"): 1 for i in (1, 2, 3, 4)}
    assert rows(t2) == {**{(i, "l2"): 1 for i in (1, 2, 3, 4, 5)}, (5, "l1"): 1}
    assert rows(t3) == {(i, "l1"): -1 for i in (2, 3, 4, 5)}


KV = "k bigint, v bigint"


def _random_ticks(rnd, n=3):
    return [[(rnd.randrange(4), rnd.randrange(5), rnd.choice([-1, 1, 1, 2])) for _ in range(rnd.randrange(0, 25))] for _ in range(n)]


def _batch(spark, kind, a, b):
    if kind == "distinct":
        return distinct(a)
    if kind == "max":
        return aggregates.maximum(a, ["k"], F.col("v"), "m")
    if kind == "linear":
        return aggregates.aggregate_linear(a, ["k"], F.col("v"), "m")
    if kind == "antijoin":
        return joins.antijoin(consolidate(a), b.select("k", W), ["k"])
    if kind == "outer":
        return joins.outer_join_default(consolidate(a), consolidate(b.select("k", F.col("v").alias("u"), W)), ["k"])
    if kind == "delay":
        return a
    raise KeyError(kind)


@pytest.mark.parametrize("kind", ["distinct", "max", "linear", "antijoin", "outer"])
def test_sum_of_changes_is_batch(spark, kind):
    rnd = random.Random(kind)
    xs, ys = _random_ticks(rnd), _random_ticks(rnd)
    c = Circuit(spark, compact_every=2)
    a, b = c.add_input("a", KV), c.add_input("b", KV)
    stream = {
        "distinct": lambda: a.distinct(), "max": lambda: a.aggregate(["k"], lambda d: aggregates.maximum(d, ["k"], F.col("v"), "m")), "linear": lambda: a.aggregate(["k"], lambda d: aggregates.aggregate_linear(d, ["k"], F.col("v"), "m")),
        "antijoin": lambda: a.antijoin(b, ["k"]), "outer": lambda: a.outer_join_default(b.map("k", F.col("v").alias("u")), ["k"]),
    }[kind]()
    stream.output("out")
    outs = [c.step(a=z(spark, x, KV), b=z(spark, y, KV))["out"] for x, y in zip(xs, ys, strict=True)]
    all_a, all_b = (sum_of([z(spark, x, KV) for x in t]) for t in (xs, ys))
    assert rows(sum_of(outs)) == rows(_batch(spark, kind, all_a, all_b))


@pytest.mark.parametrize("lo,hi", [(-10, 0), (-5, 5), (-5, -1)])
def test_rolling_changes(spark, lo, hi):
    rnd = random.Random(lo * 7 + hi)
    ticks = [[(rnd.randrange(2), rnd.randrange(60), rnd.randrange(100), 1) for _ in range(15)] for _ in range(2)]
    ticks.append([(*r[:3], -1) for r in ticks[0][:5]])
    schema = "p bigint, t bigint, v bigint"
    c = Circuit(spark)
    c.add_input("x", schema).rolling(["p"], "t", {"s": F.sum(F.col("v") * F.col(W))}, lo, hi).output("out")
    outs = [c.step(x=z(spark, t, schema))["out"] for t in ticks]
    live = {}
    for r in (x for t in ticks for x in t):
        live[r[:3]] = live.get(r[:3], 0) + r[3]
    live = {k: n for k, n in live.items() if n}
    want = {}
    for p, t, _ in live:
        inside = [v * n for (q, s, v), n in live.items() if q == p and t + lo <= s <= t + hi]
        want[p, t, sum(inside) if inside else None] = 1
    assert rows(sum_of(outs)) == want


def test_integrate_differentiate_delay_and_restart(spark, tmp_path):
    c = Circuit(spark)
    a = c.add_input("a", KV)
    a.integrate().output("whole")
    a.integrate().differentiate().output("same")
    a.delay().output("before")
    t1, t2 = z(spark, [(1, 1, 1)], KV), z(spark, [(1, 1, 1), (2, 2, -1)], KV)
    o1, o2 = c.step(a=t1), c.step(a=t2)
    assert rows(o2["whole"]) == {(1, 1): 2, (2, 2): -1}
    assert rows(o2["same"]) == {(1, 1): 1, (2, 2): -1}
    assert rows(o1["before"]) == {} and rows(o2["before"]) == {(1, 1): 1}
    c.save(str(tmp_path))
    again = Circuit(spark)
    b = again.add_input("a", KV)
    b.integrate().output("whole")
    b.integrate()
    b.delay()
    again.load(str(tmp_path))
    assert rows(again.step(a=z(spark, [(2, 2, 1)], KV))["whole"]) == {(1, 1): 2}


def _stepped(spark, build, ticks, folder, restart):
    """The changes of all ticks, with a circuit built anew and loaded before each tick but the first if asked."""
    out, c = [], Circuit(spark, compact_every=2)
    build(c)
    for i, t in enumerate(ticks):
        if restart and i:
            c.save(f"{folder}/{i}")
            c = Circuit(spark, compact_every=2)
            build(c)
            c.load(f"{folder}/{i}")
        got = c.step(**t)["out"]
        out.append(rows(got) if hasattr(got, "columns") else got)
    return out


def _tc(x, e):
    return x.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")


class Highest(Operator):
    """The highest value so far, as a change; one number is kept."""

    def __init__(self):
        super().__init__()
        self.held["top"] = None

    def evaluate(self, change):
        now = change.agg(F.max("v")).first()[0]
        before, self.next = self.held["top"], max((x for x in (self.held["top"], now) if x is not None), default=None)
        spark = change.sparkSession
        return spark.createDataFrame([(self.next, 1)] * (self.next != before) + [(before, -1)] * (self.next != before and before is not None), f"v bigint, {W} bigint")

    def commit(self):
        self.held["top"] = self.next


@pytest.mark.parametrize("kind", ["window", "recursive", "closure", "differentiate", "rolling", "delay", "linear", "feedback", "operator", "constant"])
def test_a_restart_changes_nothing(spark, tmp_path, kind):
    T, E = "t bigint, v bigint", "src bigint, dst bigint"  # noqa: N806
    ticks = [[(5, 1, 1), (900, 2, 1)], [], [(1500, 3, 1), (900, 2, -1)], [(1600, 4, 2)]]
    if kind in ("recursive", "closure"):
        ticks = [[(1, 2, 1), (2, 3, 1), (3, 1, 1)], [], [(3, 4, 1), (2, 3, -1)], [(2, 3, 1)]]

    def build(c):
        x = c.add_input("x", E if kind in ("recursive", "closure") else T)
        s = None
        if kind == "window":
            s = x.window("t", x.watermark("t", 100).apply_scalar(lambda m: (m - 1000, m + 1000)))
        elif kind == "recursive":
            s = x.recursive(lambda d: weighted(recursion.transitive_closure(distinct(d).drop(W))))
        elif kind == "closure":
            s = x.closure(x, _tc)
        elif kind == "differentiate":
            s = x.integrate().differentiate()
        elif kind == "rolling":
            s = x.map(F.lit(1).cast("bigint").alias("p"), "t", "v").rolling(["p"], "t", {"s": F.sum(F.col("v") * F.col(W))}, -700, 0, mark=x.watermark("t", 100))
        elif kind == "delay":
            s = x.delay().delay()
        elif kind == "linear":
            s = x.map((F.col("t") % 2).alias("k"), "v").aggregate_linear(["k"], F.col("v"), "n")
        elif kind == "feedback":
            back, connect = c.feedback(T)
            s = x.plus(back.map((F.col("t") + 1).alias("t"), "v"))
            connect(s)
        elif kind == "operator":
            s = c.operator(Highest(), [x], z(spark, [], "v bigint"))
        elif kind == "constant":
            s = x.plus(c.add_constant(z(spark, [(7, 7, 1)], T)))
        s.output("out")

    steps = [{"x": z(spark, t, E if kind in ("recursive", "closure") else T)} for t in ticks]
    plain = _stepped(spark, build, steps, tmp_path, False)
    assert plain == _stepped(spark, build, steps, tmp_path, True)
    assert kind in ("delay", "feedback") or plain[0] and plain[1] == {}


@pytest.mark.parametrize("chain", [None, ("src", "dst")])
def test_closure_under_inserts_and_deletes_golden(spark, monkeypatch, chain):
    """Changes of a closure, tick by tick, against closures from scratch."""
    monkeypatch.setattr(recursion, "_SHORT_ROUNDS", 1)
    rnd = random.Random(5)
    E = "src bigint, dst bigint"  # noqa: N806
    c = Circuit(spark, compact_every=2)
    e = c.add_input("e", E)
    e.closure(e, _tc, chain=chain).output("out")
    live, before = set(), set()
    ticks = [{(1, 2): 1, (2, 3): 1, (3, 4): 1, (4, 2): 1}, {(2, 3): -1, (4, 5): 1}, {(5, 1): 1, (1, 3): 1}, {(3, 4): -1, (1, 2): -1}]
    ticks += [{(rnd.randrange(6), rnd.randrange(6)): 1 for _ in range(4)}]
    for t in ticks:
        t = {k: w for k, w in t.items() if (w > 0) != (k in live)}
        live = (live | {k for k, w in t.items() if w > 0}) - {k for k, w in t.items() if w < 0}
        paths = set(live)
        while more := {(a, d) for a, b in paths for x, d in live if b == x} - paths:
            paths |= more
        got = rows(c.step(e=z(spark, [(*k, w) for k, w in t.items()], E))["out"])
        assert got == {**{p: 1 for p in paths - before}, **{p: -1 for p in before - paths}}
        before = paths


def test_nested_circuits(spark):
    """A closure by rounds inside a tick; values of the same round over ticks."""
    E = "src bigint, dst bigint"  # noqa: N806
    c = Circuit(spark)
    e = c.add_input("e", E)

    def build(n, given):
        whole = given["e"].integrate()
        back, connect = n.feedback(E)
        found = given["e"].plus(whole.apply2(back, lambda a, b: weighted(_tc(b.drop(W), a.drop(W))))).integrate().apply(distinct).differentiate()
        connect(found)
        return found

    c.nested({"e": e}, build).output("out")
    got = rows(c.step(e=z(spark, [(1, 2, 1), (2, 3, 1), (3, 4, 1), (4, 2, 1)], E))["out"])
    assert got == {p: 1 for p in [(1, 2), (1, 3), (1, 4), *[(a, b) for a in (2, 3, 4) for b in (2, 3, 4)]]}
    assert rows(c.step(e=z(spark, [(7, 8, 1)], E))["out"]) == {(7, 8): 1}

    c = Circuit(spark)
    x = c.add_input("x", KV)
    seen = {}

    def rounds(n, given):
        back, connect = n.feedback(KV)
        now = given["x"].plus(back.map("k", (F.col("v") - 1).alias("v")).filter("v > 0"))
        connect(now)
        seen["before"], seen["sum"] = n.delay_nested(now), n.integrate_nested(now)
        seen["log"] = []
        n_sum = seen["sum"].inspect(lambda d: seen["log"].append((rows(seen["before"].value), rows(d))))
        return now.apply2(n_sum, lambda a, b: a)

    c.nested({"x": x}, rounds).output("out")
    assert rows(c.step(x=z(spark, [(1, 2, 1)], KV))["out"]) == {(1, 2): 1, (1, 1): 1}
    assert seen["log"] == [({}, {(1, 2): 1}), ({}, {(1, 1): 1}), ({}, {})]
    seen["log"].clear()
    assert rows(c.step(x=z(spark, [(5, 2, 3)], KV))["out"]) == {(5, 2): 3, (5, 1): 3}
    assert seen["log"][:2] == [({(1, 2): 1}, {(1, 2): 1, (5, 2): 3}), ({(1, 1): 1}, {(1, 1): 1, (5, 1): 3})]


def test_pushed_rows_and_generators(spark):
    c = Circuit(spark)
    a = c.add_input("a", KV)
    g = c.add_generator(lambda tick: z(spark, [(tick, tick, 1)], KV), KV)
    a.plus(g).output("out")
    c.push("a", [(1, 1), (2, 2, -3)])
    c.push("a", z(spark, [(1, 1, 4)], KV))
    assert rows(c.step(a=z(spark, [(9, 9, 1)], KV))["out"]) == {(1, 1): 5, (2, 2): -3, (9, 9): 1, (0, 0): 1}
    assert rows(c.step()["out"]) == {(1, 1): 1}


def test_parts_are_removed(spark):
    """State that was merged away is deleted; results handed out stay readable."""
    from tidewheel.session import list_names

    c = Circuit(spark, compact_every=2)
    a = c.add_input("a", KV)
    a.aggregate(["k"], lambda d: aggregates.maximum(d, ["k"], F.col("v"), "m")).output("out")
    a.delay().output("late")
    outs = [c.step(a=z(spark, [(i % 3, i, 1)], KV)) for i in range(7)]
    assert len(list_names(spark, c.parts.folder)) <= 2 * 7 + 6
    assert sum(len(rows(o["out"])) > 0 for o in outs) == 7 and rows(outs[3]["late"]) == {(2, 2): 1}


def test_small_changes_read_little_of_the_state(spark):
    from tidewheel.streaming.state import StateTable, few_values

    c = Circuit(spark)
    a = c.add_input("a", KV)
    state = StateTable(a.empty, c.parts, 1, ["k"])
    state.add(c.parts.cut(weighted(spark.range(0, 400_000, 1, 8).selectExpr("id AS k", "id % 7 AS v"))))
    change = z(spark, [(17, 1, 1), (399_000, 2, 1)], KV)
    near = state.touching(change, ["k"], few_values(change, "k"))
    assert near.count() == 2 and "PushedFilters: [In(k" in near._jdf.queryExecution().toString()


def test_galen_against_brute_force(spark):
    rnd = random.Random(11)
    some = lambda k, n: {tuple(rnd.randrange(6) for _ in range(k)) for _ in range(n)}
    rel = {"p": some(2, 6), "q": some(3, 6), "r": some(3, 6), "c": some(3, 6), "u": some(3, 6), "s": some(2, 4)}
    p, q = set(rel["p"]), set(rel["q"])
    while True:
        np_ = {(x, z) for x, y in p for y2, z in p if y == y2} | {(x, z) for y, w in p for w2, r, z in rel["u"] if w == w2 for x, r2, y2 in q if (r, y) == (r2, y2)} | {(x, z) for y, w, z in rel["c"] for x, w2 in p if w == w2 and (x, y) in p}
        nq = {(x, r, z) for x, y in p for y2, r, z in q if y == y2} | {(x, n, z) for x, r, z in q for r2, n in rel["s"] if r == r2} | {(x, e, o) for x, y, z in q for y2, u, e in rel["r"] if y == y2 for z2, u2, o in q if (z, u) == (z2, u2)}
        if np_ <= p and nq <= q:
            break
        p, q = p | np_, q | nq
    frames = {k: spark.createDataFrame(sorted(v), ", ".join(f"c{i} bigint" for i in range(len(next(iter(v)))))) for k, v in rel.items()}
    got = galen.closure(**frames)
    assert {tuple(r) for r in got["p"].collect()} == p and {tuple(r) for r in got["q"].collect()} == q


def test_graph_plan_kinds(spark):
    graph = {
        "nodes": {
            "a": {"source": {"table": "t", "schema": KV}},
            "k": {"constant": {"schema": KV, "rows": [[9, 9]]}},
            "s": {"sum": {"inputs": ["a", "k"]}},
            "m": {"max": {"input": "s", "keys": ["k"], "value": "v", "alias": "top"}},
            "f": {"fold": {"input": "s", "keys": ["k"], "value": "v", "zero": "''", "step": "concat($acc, $value)", "alias": "text"}},
            "o1": {"sink": {"input": "m", "name": "max"}},
            "o2": {"sink": {"input": "f", "name": "fold"}},
        }
    }
    c = graph_plan.build(spark, graph)
    o = c.step(t=z(spark, [(1, 2, 1), (1, 1, 1)], KV))
    assert rows(o["max"]) == {(1, 2): 1, (9, 9): 1} and rows(o["fold"]) == {(1, "12"): 1, (9, "9"): 1}
    o = c.step(t=z(spark, [(1, 2, -1)], KV))
    assert rows(o["max"]) == {(1, 2): -1, (1, 1): 1}


def test_weights_and_deltas(spark):
    a = z(spark, [(1, 1, 2), (1, 1, -2), (2, 2, 3), (None, 3, 1)], KV)
    assert rows(a) == {(2, 2): 3, (None, 3): 1}
    assert rows(minus(plus(a, a), neg(a))) == {(2, 2): 9, (None, 3): 3}
    state = z(spark, [(1, 1, 1)], KV)
    assert inputs.map_delta(state, spark.createDataFrame([], "k bigint, v bigint, delete boolean, seq int"), ["k"], ["v"]).count() == 0


def test_foreach_batch_host(spark, tmp_path):
    from tidewheel.streaming.host import drive

    src = tmp_path / "in"
    for i in range(2):
        spark.createDataFrame([(i, 1), (7, i)], KV).coalesce(1).write.mode("append").parquet(str(src))
    c, seen = Circuit(spark), []
    c.add_input("x", KV).aggregate(["k"], lambda d: aggregates.aggregate_linear(d, ["k"], F.lit(1), "n")).output("out")
    stream = spark.readStream.schema(KV).option("maxFilesPerTrigger", 1).parquet(str(src))
    drive(c, stream, "x", lambda out, tick: seen.append(out["out"]), str(tmp_path / "cp")).awaitTermination(60)
    assert len(seen) == 2 and rows(sum_of(seen)) == {(0, 1): 1, (1, 1): 1, (7, 2): 1}


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    """A new query and a new circuit take up the saved state; batches that were applied are passed over."""
    from tidewheel.streaming.host import drive

    src, seen = tmp_path / "in", []

    def go(first):
        for i in range(first, first + 2):
            spark.createDataFrame([(i, 1), (7, i)], KV).coalesce(1).write.mode("append").parquet(str(src))
        c = Circuit(spark)
        c.add_input("x", KV).aggregate_linear(["k"], F.lit(1), "n").output("out")
        stream = spark.readStream.schema(KV).option("maxFilesPerTrigger", 1).parquet(str(src))
        drive(c, stream, "x", lambda out, tick: seen.append((tick, out["out"])), str(tmp_path / "cp")).awaitTermination(90)
        return c

    go(0)
    c = go(2)
    assert [t for t, _ in seen] == [0, 1, 2, 3] and c.ticks == 4
    assert rows(sum_of([d for _, d in seen])) == {(0, 1): 1, (1, 1): 1, (2, 1): 1, (3, 1): 1, (7, 4): 1}
