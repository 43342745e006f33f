"""Closures of graphs whose edges fit one task, as rows that are made when they are read.

A closure has up to the square of the vertices as rows, where the graph has few
edges.  So only the graph is written: one row with its vertices, their strongly
connected components and the links between these.  Rows are made from it in blocks
of targets: a task goes once over the components, those that lead nowhere first,
and adds up which targets of its block each reaches, a bit per target.  Nothing of
the size of the result is written, shuffled or held.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.zset import W

MOST_EDGES = 500_000  # beyond, rounds of joins find the paths
BLOCK = 512  # targets of a task
_ROWS = 4_096  # sources of a row that a task gives
_VALUES = 1_000_000  # values of a batch
_KINDS = {"tinyint", "smallint", "int", "bigint", "string"}


def fits(edges: DataFrame, most: int | None = None) -> bool:
    """Whether edges (from, to) without repeats are few enough, of one type that is compared exactly, and without nulls."""
    (a, kind), (b, other) = edges.dtypes
    if kind != other or kind not in _KINDS:
        return False
    n, nulls = edges.agg(F.count(F.lit(1)), F.count_if(F.col(a).isNull() | F.col(b).isNull())).first()
    return n <= (MOST_EDGES if most is None else most) and not nulls


def _components(n: int, tails: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Numbers of the strongly connected components of vertices 0 to n - 1; links lead to smaller numbers (Tarjan, without recursion)."""
    order = np.argsort(tails, kind="stable")
    starts = np.searchsorted(tails[order], np.arange(n + 1)).tolist()
    to = heads[order].tolist()
    seen, low, comp, at, stack = [-1] * n, [0] * n, [-1] * n, starts[:n], []
    time = found = 0
    for root in range(n):
        if seen[root] >= 0:
            continue
        path = [root]
        while path:
            v = path[-1]
            if seen[v] < 0:
                seen[v] = low[v] = time
                time += 1
                stack.append(v)
            if at[v] < starts[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if seen[w] < 0:
                    path.append(w)
                elif comp[w] < 0:
                    low[v] = min(low[v], seen[w])
                continue
            path.pop()
            if low[v] == seen[v]:
                while True:
                    w = stack.pop()
                    comp[w] = found
                    if w == v:
                        break
                found += 1
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
    return np.asarray(comp, dtype=np.int32)


def condensed(edges: DataFrame) -> DataFrame:
    """One row for edges (from, to) that ``fits`` takes: vertices, their components, which of these have a cycle, links between them in order."""
    kind = edges.dtypes[0][1]

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        src, dst = (np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i in (0, 1))
        vertices, numbers = np.unique(np.concatenate([src, dst]), return_inverse=True)
        tails, heads = numbers[: len(src)], numbers[len(src) :]
        comp = _components(len(vertices), tails, heads)
        n = int(comp.max()) + 1 if len(comp) else 0
        ct, ch = comp[tails].astype(np.int64), comp[heads].astype(np.int64)
        cycle = np.zeros(n, dtype=bool)
        cycle[ct[ct == ch]] = True
        links = np.unique((ct * n + ch)[ct != ch])
        yield pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in (
            (vertices, pa.list_(parts[0].schema.field(0).type)), (comp, pa.list_(pa.int32())), (cycle, pa.list_(pa.bool_())), ((links // max(n, 1)).astype(np.int32), pa.list_(pa.int32())), ((links % max(n, 1)).astype(np.int32), pa.list_(pa.int32())),
        )], ["vertices", "comp", "cycle", "tails", "heads"])

    return edges.repartition(1).mapInArrow(one, f"vertices array<{kind}>, comp array<int>, cycle array<boolean>, tails array<int>, heads array<int>")


def _reached(graph: dict[str, np.ndarray], targets: np.ndarray) -> list[int]:
    """Per vertex of the graph the targets that paths from it lead to, as bits."""
    comp = graph["comp"].tolist()
    own = [0] * len(graph["cycle"])
    place = np.searchsorted(graph["vertices"], targets)
    for j, (i, t) in enumerate(zip(place.tolist(), targets, strict=True)):
        if i < len(comp) and graph["vertices"][i] == t:
            own[comp[i]] |= 1 << j
    upto = own[:]
    for t, h in zip(graph["tails"].tolist(), graph["heads"].tolist(), strict=True):  # in order: all links out of h were gone along
        upto[t] |= upto[h]
    for c in np.flatnonzero(~graph["cycle"]).tolist():
        upto[c] &= ~own[c]
    return [upto[c] for c in comp]


def change(before: DataFrame | None, after: DataFrame, names: tuple[str, str] = ("src", "dst")) -> DataFrame:
    """Paths that come (+1) and go (-1) from one graph of ``condensed`` to another; all paths of ``after`` where there is none before."""
    spark, kind = after.sparkSession, after.dtypes[0][1].removeprefix("array<").removesuffix(">")
    both = after.select(*[F.col(c).alias(f"a_{c}") for c in after.columns])
    if before is not None:
        both = both.join(before.select(*[F.col(c).alias(f"b_{c}") for c in before.columns]), F.lit(True), "full")
    n = both.agg(F.sum(sum((F.coalesce(F.size(c), F.lit(0)) for c in both.columns if c.endswith("_vertices")), F.lit(0)))).first()[0] or 0
    # Of small graphs too a few tasks; of two graphs with the same vertices blocks are half as large.
    blocks = max(1, min(8, n // 64), -(-n // BLOCK))
    number = spark.range(0, blocks, 1, blocks)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _block(batch.slice(i, 1), blocks)

    sets = number.crossJoin(F.broadcast(both)).mapInArrow(rows, f"a array<{kind}>, b array<{kind}>, {W} bigint")
    a, b = names
    return sets.select(F.explode("a").alias(a), "b", W).select(a, F.explode("b").alias(b), W)


def _block(row: pa.RecordBatch, blocks: int) -> Iterator[pa.RecordBatch]:
    """The changes of one block of targets: rows of sources and of the targets that each of these gains or loses."""
    graphs = []
    for p in ("b_", "a_"):
        cols = {n.removeprefix(p): row.column(n) for n in row.schema.names if n.startswith(p)}
        if cols and cols["vertices"][0].is_valid:
            graphs.append({n: c.flatten().to_numpy(zero_copy_only=False) for n, c in cols.items()})
        else:
            graphs.append(None)
    kind = next(row.schema.field(n).type.value_type for n in row.schema.names if n.endswith("_vertices"))
    given = [g["vertices"] for g in graphs if g is not None]
    if not given:
        return
    vertices = np.unique(np.concatenate(given)) if len(given) > 1 else given[0]
    k, n = row.column("id")[0].as_py(), len(vertices)
    targets = vertices[k * n // blocks : (k + 1) * n // blocks]
    bits = []
    for g in graphs:
        if g is None:
            bits.append([0] * n)
            continue
        at = [0] * n
        for i, x in zip(np.searchsorted(vertices, g["vertices"]).tolist(), _reached(g, targets), strict=True):
            at[i] = x
        bits.append(at)
    alike: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, x in enumerate(zip(*bits, strict=True)):
        if x[0] != x[1]:
            alike[x].append(i)
    sources, ends, weights, held = [], [], [], 0

    def out() -> pa.RecordBatch:
        lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x), kind)) for x in (sources, ends)]
        return pa.RecordBatch.from_arrays([*lists, pa.array(weights, pa.int64())], ["a", "b", W])

    size = (len(targets) + 7) // 8
    for (old, new), at in alike.items():
        for w, x in ((1, new & ~old), (-1, old & ~new)):
            if not x:
                continue
            to = targets[np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes(size, "little"), np.uint8), bitorder="little"))]
            for j in range(0, len(at), _ROWS):
                sources.append(vertices[at[j : j + _ROWS]])
                ends.append(to)
                weights.append(w)
                held += len(sources[-1]) + len(to)
                if held >= _VALUES:
                    yield out()
                    sources, ends, weights, held = [], [], [], 0
    if sources:
        yield out()
