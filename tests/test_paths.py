import random
from pathlib import Path

import pytest

from tidewheel.operators import paths, recursion
from tidewheel.session import ensure_checkpoint_dir
from tidewheel.streaming.circuit import Circuit
from tidewheel.zset import W


def closed(edges):
    found = set(edges)
    while more := {(a, d) for a, b in found for x, d in edges if b == x} - found:
        found |= more
    return found


def of(spark, edges, kind="bigint"):
    return spark.createDataFrame(sorted(edges), f"src {kind}, dst {kind}")


def test_a_closure_is_not_written(spark):
    """A cycle with a way in and a way out: its paths are the square of its edges, of which only the edges are written."""
    n = 1500
    edges = {(i, (i + 1) % n) for i in range(n)} | {(-1, 7), (9, n), (n, n + 1), (n + 2, n + 2)}
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = size()
    got = recursion.transitive_closure(of(spark, edges))
    counts = {r["src"]: (r["n"], r["d"]) for r in got.selectExpr("src", "dst").groupBy("src").agg({"dst": "count"}).toDF("src", "n").join(got.distinct().groupBy("src").agg({"dst": "count"}).toDF("src", "d"), "src").collect()}
    assert counts == {**{i: (n + 2, n + 2) for i in [-1, *range(n)]}, n: (1, 1), n + 2: (1, 1)}
    assert size() - before < 200_000


@pytest.mark.parametrize("kind", ["bigint", "int", "string"])
def test_changes_between_graphs(spark, monkeypatch, kind):
    monkeypatch.setattr(paths, "BLOCK", 3)
    monkeypatch.setattr(paths, "_ROWS", 2)
    rnd = random.Random(3)
    name = (lambda i: f"v{i}") if kind == "string" else (lambda i: i - 5)
    before = None
    for n, m in ((1, 1), (12, 14), (14, 30), (30, 31)):
        edges = {(name(rnd.randrange(n)), name(rnd.randrange(n))) for _ in range(m)}
        now = edges, paths.condensed(of(spark, edges, kind))
        whole = [tuple(r) for r in paths.change(None, now[1]).collect()]
        assert sorted(whole) == sorted((a, b, 1) for a, b in closed(edges))
        if before is not None:
            got = [tuple(r) for r in paths.change(before[1], now[1], ("x", "y")).select("x", "y", W).collect()]
            old, new = closed(before[0]), closed(edges)
            assert sorted(got) == sorted([*((a, b, 1) for a, b in new - old), *((a, b, -1) for a, b in old - new)])
        before = now


def test_graphs_beyond_one_task_and_of_other_kinds(spark, monkeypatch):
    edges = {(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)}
    assert paths.fits(of(spark, edges)) and not paths.fits(of(spark, edges), 4)
    assert not paths.fits(of(spark, {(1.0, 2.0)}, "double")) and not paths.fits(spark.createDataFrame([(1, None)], "src int, dst int"))
    assert recursion.transitive_closure(of(spark, edges).where("src > 9")).count() == 0
    monkeypatch.setattr(paths, "MOST_EDGES", 4)
    assert sorted(tuple(r) for r in recursion.transitive_closure(of(spark, edges)).collect()) == sorted(closed(edges))


def test_closures_of_circuits_are_condensed(spark, monkeypatch, tmp_path):
    """Changes and contents over ticks, an empty graph, a restart, and edges that no longer fit one task; no round of joins before."""
    rounds = []
    real = recursion.maintain
    monkeypatch.setattr(recursion, "maintain", lambda *a: rounds.append(1) or real(*a))
    step = lambda x, e: x.select("src", recursion.F.col("dst").alias("mid")).join(e.select(recursion.F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")

    def build():
        c = Circuit(spark, compact_every=2)
        e = c.add_input("e", "src bigint, dst bigint")
        e.closure(e, step, chain=("src", "dst")).output("change")
        e.closure(e, step, chain=("src", "dst"), whole=True).output("whole")
        return c

    c, live, before = build(), set(), set()
    ring = {(i, (i + 1) % 40) for i in range(40)}
    ticks = [(ring | {(40, 3)}, set()), ({(3, 50)}, {(5, 6), (30, 31)}), (set(), None), ({(1, 2), (2, 1)}, set()), ({(2, 3), (3, 4), (9, 9)}, {(1, 2)})]
    for k, (come, go) in enumerate(ticks):
        go = set(live) if go is None else go
        if k == 2:
            c.save(f"{tmp_path}/saved")
            c = build()
            c.load(f"{tmp_path}/saved")
        if k == 4:
            assert not rounds
            monkeypatch.setattr(paths, "MOST_EDGES", 3)
        live = (live | come) - go
        changes = [(*x, 1) for x in come] + [(*x, -1) for x in go]
        out = c.step(e=spark.createDataFrame(changes, f"src bigint, dst bigint, {W} bigint"))
        now = closed(live)
        assert sorted(tuple(r) for r in out["whole"].select("src", "dst", W).collect()) == sorted((*x, 1) for x in now)
        assert sorted(tuple(r) for r in out["change"].select("src", "dst", W).collect()) == sorted([*((*x, 1) for x in now - before), *((*x, -1) for x in before - now)])
        before = now
    assert len(rounds) == 2
