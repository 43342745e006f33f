"""Filling containers of fixed capacity with whole items.

Items are dealt by a hash of their id into groups of about ``group_items`` and
every group is packed by bin completion: starting from a best-fit-decreasing
incumbent, a branch-and-bound takes the largest item left, enumerates the
undominated fillings of the room beside it and prunes where the room wasted so
far exceeds what any better packing may waste.  Fillings are enumerated lazily,
all of them if need be: ``look`` at a time, each such lot with the least waste
first.  A group ends when the lower bound is met, when nothing is left to try
(the incumbent is optimal then), or when its budget is spent: ``nodes`` fillings
tried, and STEPS times as many steps of their enumeration.  Half of the budget
goes to a search that tries only ``width`` fillings per branch, so that it does
not stay at the bottom of the tree, the rest to the complete one.  With
``nodes=None`` there is no budget and every group is packed optimally.

The emptiest container of each group stays open: its items move on to a next
round, in which FAN groups share one, until one group is left.  So the room lost
to partly filled last containers does not grow with the number of groups, and no
task ever holds more than a group.

Items larger than the container are cut into pieces of exactly the capacity, each
a container of its own, and a remainder that is packed as an item.

Defined cases: items of size 0 (null or empty text) go into the first container
of their group; null ids are ignored; repeated ids count once; containers with a
null or non-positive capacity are ignored; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence
from itertools import accumulate, islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.session import cut_lineage

GROUP_ITEMS = 2_000
FAN = 32
NODES = 2_000
MAX_CONTAINERS = 1_000
WIDTH = 6
LOOK = 60
STEPS = 200


def best_fit_decreasing(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Containers as lists of item positions; ``sizes`` in falling order."""
    room: list[tuple[int, int]] = []  # (room left, container), sorted
    bins: list[list[int]] = []
    for i, s in enumerate(sizes):
        k = bisect_left(room, (s, -1))
        if k == len(room):
            bins.append([i])
            insort(room, (capacity - s, len(bins) - 1))
        else:
            left, b = room.pop(k)
            bins[b].append(i)
            insort(room, (left - s, b))
    return bins


def lower_bound(sizes: Sequence[int], capacity: int) -> int:
    """Containers that any packing needs: by volume, and by items over half, for every threshold."""
    rising = sorted(sizes)
    upto = [0, *accumulate(rising)]
    best = -(-upto[-1] // capacity)
    half_at = bisect_right(rising, capacity // 2)  # from here on more than half
    for k in sorted({0, *rising[:half_at]}):
        # Items over capacity - k take a container each and no item of k or more beside them.
        big_at = max(half_at, bisect_right(rising, capacity - k))
        half = upto[big_at] - upto[half_at]
        small = upto[half_at] - upto[bisect_left(rising, k)]
        spare = (big_at - half_at) * capacity - half
        best = max(best, len(rising) - half_at + max(0, -(-(small - spare) // capacity)))
    return best


class Budget:
    """Fillings and steps left; without a limit if ``nodes`` is None."""

    def __init__(self, nodes: int | None):
        self.nodes = float("inf") if nodes is None else nodes
        self.steps = self.nodes * STEPS

    @property
    def spent(self) -> bool:
        return self.nodes <= 0 or self.steps <= 0


def fillings(values: list[int], counts: list[int], room: int, most_waste: int, budget: Budget) -> Iterator[tuple[int, list[int]]]:
    """All undominated fillings of ``room`` that waste at most ``most_waste``, as (waste, positions in ``values``).

    ``values`` are the distinct sizes in falling order, ``counts`` how many of each
    are left.  A filling is left out if another item still fits, or if one of its
    items can be swapped for a larger unused one.  Ends early only with the budget.
    """
    n, free = len(values), list(counts)
    rising = [-v for v in values]
    suffix = [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        suffix[k] = suffix[k + 1] + values[k] * counts[k]
    chosen: list[int] = []
    # Frames: next position, room left, least size skipped though it was there, whether anything fitted.
    stack = [[bisect_left(rising, -room), room, room + 1, False]]
    while stack and not budget.spent:
        budget.steps -= 1
        frame = stack[-1]
        k, left, skipped, _ = frame
        while k < n and not free[k]:
            k += 1
        # What is left of the room must end up below every size that was skipped.
        fill = (suffix[k + 1] + values[k] * free[k]) if k < n else 0
        if k == n or left - fill >= skipped or left - fill > most_waste:
            if k == n and not frame[3] and left < skipped and left <= most_waste and not _swappable(values, free, chosen, left):
                yield left, list(chosen)
            stack.pop()
            if chosen:
                free[chosen.pop()] += 1
            continue
        frame[0], frame[2], frame[3] = k + 1, values[k], True
        chosen.append(k)
        free[k] -= 1
        stack.append([max(k, bisect_left(rising, values[k] - left)), left - values[k], skipped, False])


def _swappable(values: list[int], free: list[int], chosen: list[int], left: int) -> bool:
    for k in set(chosen):
        for j in range(k - 1, -1, -1):
            if values[j] - values[k] > left:
                break
            if free[j]:
                return True
    return False


def bin_completion(sizes: Sequence[int], capacity: int, nodes: int | None = NODES, width: int = WIDTH, look: int = LOOK) -> list[list[int]]:
    """Containers as lists of positions of ``sizes`` (any order, all in 1..capacity)."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    falling = [sizes[i] for i in order]
    incumbent = best_fit_decreasing(falling, capacity)
    need = lower_bound(falling, capacity)
    searches = [(None, None)] if nodes is None else [(nodes // 2, width), (nodes - nodes // 2, None)]
    for part, most in searches:
        if len(incumbent) > need:
            incumbent = _search(falling, capacity, len(incumbent), need, Budget(part), most, look) or incumbent
    return [[order[i] for i in b] for b in incumbent]


def _search(falling: list[int], capacity: int, best: int, need: int, budget: Budget, width: int | None, look: int) -> list[list[int]] | None:
    """A packing into fewer than ``best`` containers, or None if there is none or the budget is spent."""
    values = sorted(set(falling), reverse=True)
    where: dict[int, list[int]] = {v: [] for v in values}
    for i, s in enumerate(falling):
        where[s].append(i)
    total, result = sum(falling), None
    counts = [len(where[v]) for v in values]
    path: list[list[int]] = []  # the sizes (positions in values) of each container chosen
    waste = 0

    def branch(spare: int) -> Iterator[tuple[int, list[int]]]:
        top = next(k for k, c in enumerate(counts) if c)
        own = list(counts)
        own[top] -= 1
        lazily = fillings(values, own, capacity - values[top], spare, budget)
        tried = 0
        while lot := list(islice(lazily, look)):
            lot.sort(key=lambda f: (f[0], len(f[1]), f[1]))
            for w, f in lot:
                if tried == width:
                    return
                tried += 1
                yield w, [top, *f]

    frames = [branch((best - 1) * capacity - total)]
    while frames and not budget.spent:
        option = next(frames[-1], None)
        if option is None:
            frames.pop()
            if path:
                done = path.pop()
                for k in done:
                    counts[k] += 1
                waste -= capacity - sum(values[k] for k in done)
            continue
        w, chosen = option
        budget.nodes -= 1
        if waste + w > (best - 1) * capacity - total:  # no better packing may waste that much
            continue
        path.append(chosen)
        waste += w
        for k in chosen:
            counts[k] -= 1
        if not any(counts):
            if len(path) < best:
                best, pools = len(path), {k: iter(where[v]) for k, v in enumerate(values)}
                result = [[next(pools[k]) for k in c] for c in path]
                if best <= need:
                    return result
            frames.append(iter(()))
        else:
            frames.append(branch((best - 1) * capacity - total - waste))
    return result


def _packed(pdf: pd.DataFrame, nodes: int | None, width: int, look: int, last: bool) -> pd.DataFrame:
    """One group: containers numbered, the emptiest one marked open."""
    pdf = pdf.sort_values(["tokens", "item_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    capacity = int(pdf["capacity"].iloc[0])
    sizes = pdf["tokens"].tolist()
    positive = sum(1 for s in sizes if s > 0)
    bins = bin_completion(sizes[:positive], capacity, nodes, width, look)
    if positive < len(sizes):
        bins = bins or [[]]
        bins[0] = [*bins[0], *range(positive, len(sizes))]
    number = [0] * len(sizes)
    for b, items in enumerate(bins):
        for i in items:
            number[i] = b
    loads = [sum(sizes[i] for i in items) for items in bins]
    emptiest = min(range(len(bins)), key=lambda b: (loads[b], b))
    pdf["bin"] = number
    pdf["open"] = False if last or loads[emptiest] == capacity else pdf["bin"] == emptiest
    return pdf


def _packer(nodes: int | None, width: int, look: int, last: bool):
    return lambda pdf: _packed(pdf, nodes, width, look, last)


def pack(items: DataFrame, containers: DataFrame, item_id: str, tokens: str, group_items: int = GROUP_ITEMS, nodes: int | None = NODES, width: int = WIDTH, look: int = LOOK) -> DataFrame:
    """(container, bin_id, item_id, piece, start_token, tokens), a row per item and piece."""
    kinds = [
        (r[0], int(r[1]))
        for r in containers.select(F.col("container").cast("string"), F.col("capacity_tokens").cast("bigint")).where("container is not null and capacity_tokens > 0").distinct().limit(MAX_CONTAINERS + 1).collect()
    ]
    if len(kinds) > MAX_CONTAINERS:
        raise ValueError(f"more than {MAX_CONTAINERS} kinds of containers")
    spark = items.sparkSession
    id_type = items.schema[item_id].dataType.simpleString()
    if not kinds:
        return spark.createDataFrame([], f"container string, bin_id string, item_id {id_type}, piece int, start_token bigint, tokens bigint")
    sized = cut_lineage(
        items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("size")).where("item_id is not null").dropDuplicates(["item_id"])
    )
    n = sized.count()
    kind = F.explode(F.array(*[F.struct(F.lit(a).alias("container"), F.lit(b).cast("bigint").alias("capacity")) for a, b in sorted(kinds)]))
    placed = sized.withColumn("k", kind).select("item_id", "size", "k.container", "k.capacity").withColumn("full", F.expr("size div capacity"))
    whole = placed.where("full > 0").select(
        "container", F.col("item_id"), F.posexplode(F.sequence(F.lit(1).cast("bigint"), F.col("full"))).alias("piece", "p"), "capacity"
    ).select(
        "container", F.concat_ws(":", F.lit("w"), F.col("item_id").cast("string"), "piece").alias("bin_id"), "item_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * F.col("capacity")).cast("bigint").alias("start_token"), F.col("capacity").alias("tokens")
    )
    rest = placed.where("size - full * capacity > 0 OR size = 0").select(
        "container", "capacity", "item_id", F.col("full").cast("int").alias("piece"), (F.col("full") * F.col("capacity")).alias("start_token"), (F.col("size") - F.col("full") * F.col("capacity")).alias("tokens")
    )
    groups, turn, out = max(1, -(-n // group_items)), 0, whole
    cols = ["container", "capacity", "item_id", "piece", "start_token", "tokens"]
    while True:
        last = groups == 1
        schema = f"container string, capacity bigint, item_id {id_type}, piece int, start_token bigint, tokens bigint, g bigint, bin int, open boolean"
        grouped = rest.withColumn("g", F.pmod(F.xxhash64("item_id", F.lit(turn)), F.lit(groups)) if turn == 0 else F.expr(f"g div {FAN}"))
        done = cut_lineage(grouped.select(*cols, "g").groupBy("container", "g").applyInPandas(_packer(nodes, width, look, last), schema))
        bin_id = F.concat_ws(":", F.lit(str(turn)), F.col("g").cast("string"), F.col("bin").cast("string"))
        out = out.unionByName(done.where("NOT open").select("container", bin_id.alias("bin_id"), "item_id", "piece", "start_token", "tokens"))
        if last:
            return out
        rest, groups, turn = done.where("open").select(*cols, "g"), -(-groups // FAN), turn + 1


def packing_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind of container: how many, how full, and the least number by volume."""
    per_bin = packed.groupBy("container", "bin_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("items"))
    return (
        per_bin.groupBy("container").agg(F.count(F.lit(1)).alias("bins"), F.sum("tokens").alias("tokens"), F.sum("items").alias("items"), F.max("tokens").alias("fullest"))
        .join(F.broadcast(containers.select("container", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct().limit(MAX_CONTAINERS)), "container")
        .select("container", "capacity", "bins", "items", "tokens", "fullest", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_bins"), F.round(F.col("tokens") / (F.col("bins") * F.col("capacity")), 6).alias("filled"))
    )
