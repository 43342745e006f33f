"""Packings hold everything once, fit, and come near the bound; small ones are optimal."""

import itertools
import random

from tidewheel.llm.packing import Budget, best_fit_decreasing, bin_completion, fillings, lower_bound, pack, packing_report

ITEMS = "id bigint, n int, container string, bin_id string, piece int"
BOXES = "container string, capacity_tokens int"


def optimum(sizes, cap):
    best = len(sizes)

    def go(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(sizes):
            best = len(room)
            return
        for k in sorted(set(room)):
            if k >= sizes[i]:
                r = list(room)
                r[r.index(k)] -= sizes[i]
                go(i + 1, r)
        go(i + 1, [*room, cap - sizes[i]])

    go(0, [])
    return best


def test_small_packings_are_optimal():
    rnd = random.Random(1)
    better = 0
    for _ in range(120):
        cap = rnd.choice([10, 30, 100])
        sizes = [rnd.randrange(1, cap + 1) if rnd.random() < 0.3 else rnd.randrange(max(1, cap // 6), cap // 2 + 1) for _ in range(rnd.randrange(1, 11))]
        bins = bin_completion(sizes, cap)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= cap for b in bins)
        best = optimum(sorted(sizes, reverse=True), cap)
        assert lower_bound(sizes, cap) <= best == len(bins)
        better += len(best_fit_decreasing(sorted(sizes, reverse=True), cap)) > len(bins)
    # a case where best fit needs one more
    assert len(bin_completion([6, 5, 5, 4, 4, 3, 3], 10)) == 3


def all_fillings(values, counts, room):
    """Brute force: every feasible multiset that is maximal and has no single swap."""
    out = set()
    for pick in itertools.product(*[range(c + 1) for c in counts]):
        left = room - sum(n * v for n, v in zip(pick, values))
        if left < 0 or any(v <= left and n < c for n, v, c in zip(pick, values, counts)):
            continue
        if any(pick[k] and pick[j] < counts[j] and values[j] - values[k] <= left for k in range(len(values)) for j in range(k)):
            continue
        out.add((left, tuple(k for k, n in enumerate(pick) for _ in range(n))))
    return out


def test_fillings_are_all_undominated_ones():
    rnd = random.Random(7)
    for _ in range(200):
        values = sorted(rnd.sample(range(1, 30), rnd.randrange(1, 7)), reverse=True)
        counts = [rnd.randrange(0, 4) for _ in values]
        room, waste = rnd.randrange(0, 60), rnd.choice([0, 3, 100])
        got = [(w, tuple(f)) for w, f in fillings(values, counts, room, waste, Budget(None))]
        assert len(got) == len(set(got))
        assert set(got) == {f for f in all_fillings(values, counts, room) if f[0] <= waste}


def test_exact_mode_is_optimal():
    """Ten to sixteen items where best fit misses the bound: the complete search finds the optimum, the bounded one too at this size."""
    assert len(bin_completion([16, 33, 34, 24, 43, 16, 47, 35, 39, 16, 50, 45], 100)) == 4
    rnd = random.Random(11)
    hard = improved = 0
    while hard < 150:
        cap = rnd.choice([50, 100, 200])
        sizes = [rnd.randrange(max(1, cap // 7), cap // 2 + 2) for _ in range(rnd.randrange(10, 17))]
        falling = sorted(sizes, reverse=True)
        first = len(best_fit_decreasing(falling, cap))
        if first == lower_bound(sizes, cap):
            continue
        hard += 1
        exact = bin_completion(sizes, cap, None)
        assert sorted(i for b in exact for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= cap for b in exact)
        assert len(exact) == optimum(falling, cap) == len(bin_completion(sizes, cap))
        improved += len(exact) < first
    assert improved > 30


def test_lower_bound_looks_at_every_threshold():
    rnd = random.Random(3)
    for _ in range(200):
        cap = rnd.choice([20, 101, 1000])
        sizes = [rnd.randrange(1, cap + 1) for _ in range(rnd.randrange(1, 120))]
        best = -(-sum(sizes) // cap)
        for k in range(cap // 2 + 1):
            big, half = [s for s in sizes if s > cap - k], [s for s in sizes if cap - k >= s > cap / 2]
            small = sum(s for s in sizes if k <= s <= cap / 2)
            best = max(best, len(big) + len(half) + max(0, -(-(small - (len(half) * cap - sum(half))) // cap)))
        assert lower_bound(sizes, cap) == best


def check(spark, rows, boxes, **kw):
    out = pack(spark.createDataFrame([(i, n, "x", "y", 1) for i, n in rows], ITEMS), spark.createDataFrame(boxes, BOXES), "id", "n", **kw)
    got = out.collect()
    sizes = {i: n or 0 for i, n in rows if i is not None}
    for name, cap in {(a, b) for a, b in boxes if a and b and b > 0}:
        own = [r for r in got if r.container == name]
        loads = {}
        for r in own:
            loads[r.bin_id] = loads.get(r.bin_id, 0) + r.tokens
            assert 0 <= r.tokens <= cap
        assert all(v <= cap for v in loads.values())
        by = {k: sorted(g, key=lambda r: r.piece) for k, g in itertools.groupby(sorted(own, key=lambda r: r.item_id), key=lambda r: r.item_id)}
        assert set(by) == set(sizes)
        for i, parts in by.items():
            assert sum(r.tokens for r in parts) == sizes[i]
            at = 0
            for k, r in enumerate(parts):
                assert (r.piece, r.start_token) == (k, at)
                at += r.tokens
            assert len(parts) == max(1, -(-sizes[i] // cap))
    return got, out


def test_everything_is_packed_once(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([rnd.randrange(0, 60), rnd.randrange(0, 400), None])) for i in range(400)]
    rows += [(1000, 512), (1001, 1024), (1002, 513), (1003, 5000)] + rows[:20] + [(None, 7)]
    boxes = [("small", 128), ("large", 512), ("large", 512), (None, 9), ("none", 0), ("null", None)]
    got, out = check(spark, rows, boxes, group_items=40)
    report = {r.container: r for r in packing_report(out, spark.createDataFrame([b for b in boxes if b[1] and b[0]], BOXES)).collect()}
    assert report["large"].bins <= report["large"].least_bins + 2
    assert report["small"].filled > 0.97


def test_hot_size_ties_and_empty(spark):
    check(spark, [(i, 50) for i in range(300)], [("c", 100)], group_items=50)
    check(spark, [(i, 0) for i in range(10)], [("c", 100)], group_items=5)
    got, _ = check(spark, [], [("c", 100)])
    assert got == []
    assert pack(spark.createDataFrame([(1, 1, "", "", 1)], ITEMS), spark.createDataFrame([], BOXES), "id", "n").count() == 0
