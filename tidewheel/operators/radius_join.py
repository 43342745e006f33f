"""All pairs of a left and a right place at most a radius apart on a sphere.

Pivots (a sample of right places) cut the sphere into Voronoi cells.  A left
point belongs to the cell of its nearest pivot; a right point is copied to every
cell that may hold a point within the radius.  For a point x of cell c and a right
point s within r of x the triangle inequality gives

    d(s, p_c) <= d(x, p_c) + r <= d(x, p_near(s)) + r <= d(s, p_near(s)) + 2 r,

so s goes to the cells whose pivot is no farther than its nearest one plus 2 r.
Left points farther from (or nearer to) their pivot than all right points of the
cell, give or take r, can have no partner and are dropped before the shuffle.
Inside a cell a vantage-point tree over the right points answers all left points
at once with the exact great-circle distance.

Two levels.  A cell with more than ``cell_rows`` right points is cut again by
pivots of its own, by the same rule: the inequality holds among the pivots of one
cell as it does among all.  So a point is compared with at most MAX_PIVOTS pivots
and those of the cells it lies in, and cells stay small up to MAX_PIVOTS times
MAX_SUB of them.

Skew.  The cells of all points are computed once and written to the shared
folder.  Cells are counted before they are matched; one with more left points than
``block_rows`` is cut into blocks by a hash of the left id, one with more right
points than that (they share a place, or lie too dense for two levels) by a hash of
the right id, so no task holds more than about ``block_rows`` rows of each side.
The driver holds the pivots and three numbers per pivot, which MAX_PIVOTS and
MAX_SUB bound.

Defined cases: a place needs both coordinates, latitude within -90..90,
longitude within -180..180, neither NaN; 0, 0 is no place; rows without id are
ignored; repeated rows of either side give their pair once, as does an id with
several places of which more than one is near; ids that share a place all come
out; an empty side gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.session import written

EARTH_KM = 6371.0
MAX_PIVOTS = 1024
MAX_SUB = 256  # pivots of one cell
_SLACK = 0.01  # km, for rounding in bounds; the final test has none
_LEAF = 24


@dataclass(frozen=True)
class Places:
    """A table of places and the names of its columns."""

    df: DataFrame
    id: str
    lat: str
    lon: str

    def usable(self) -> DataFrame:
        lat, lon = F.col(self.lat).cast("double"), F.col(self.lon).cast("double")
        return self.df.where(F.col(self.id).isNotNull() & usable_place(lat, lon)).select(F.col(self.id).alias("id"), lat.alias("lat"), lon.alias("lon"))


def usable_place(lat: Column, lon: Column) -> Column:
    return lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0) & ~((lat == 0) & (lon == 0))


def haversine(lat1, lon1, lat2, lon2):
    """Great-circle distance in km of numpy arrays (radians)."""
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(a)))


def _unit(lat, lon):
    c = np.cos(lat)
    return np.stack([c * np.cos(lon), c * np.sin(lon), np.sin(lat)], axis=1)


class VantageTree:
    """A vantage-point tree over places, queried with whole arrays of places."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray):
        self.lat, self.lon = lat, lon
        self.root = self._build(np.arange(len(lat)))

    def _build(self, idx: np.ndarray):
        # An explicit stack: equal places can make the tree as deep as it is long.
        root: dict = {}
        todo = [(root, idx)]
        while todo:
            node, i = todo.pop()
            if len(i) <= _LEAF:
                node["leaf"] = i
                continue
            v = i[len(i) // 2]
            d = haversine(self.lat[v], self.lon[v], self.lat[i], self.lon[i])
            mu = float(np.median(d))
            near = d <= mu
            if near.all():  # ties at the median: cut off what is strictly nearer, or stop
                near = d < mu
                if not near.any():
                    node["leaf"] = i
                    continue
            node.update(v=v, lo_near=float(d[near].min()), hi_near=float(d[near].max()), lo_far=float(d[~near].min()), hi_far=float(d[~near].max()), near={}, far={})
            todo += [(node["near"], i[near]), (node["far"], i[~near])]
        return root

    def within(self, lat: np.ndarray, lon: np.ndarray, km: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (query position, place position) at most ``km`` apart."""
        todo = [(self.root, np.arange(len(lat)))]
        while todo:
            node, q = todo.pop()
            if not len(q):
                continue
            if "leaf" in node:
                p = node["leaf"]
                step = max(1, 2_000_000 // max(1, len(p)))
                for a in range(0, len(q), step):
                    b = q[a : a + step]
                    d = haversine(lat[b][:, None], lon[b][:, None], self.lat[p][None, :], self.lon[p][None, :])
                    i, j = np.nonzero(d <= km)
                    if len(i):
                        yield b[i], p[j]
                continue
            d = haversine(self.lat[node["v"]], self.lon[node["v"]], lat[q], lon[q])
            r = km + _SLACK
            todo.append((node["near"], q[(d >= node["lo_near"] - r) & (d <= node["hi_near"] + r)]))
            todo.append((node["far"], q[(d >= node["lo_far"] - r) & (d <= node["hi_far"] + r)]))


class Pivots:
    """Voronoi cells of one or two levels, numbered, with the range of pivot distances of their right points."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, km: float):
        self.km = km
        self.top = _unit(np.radians(lat), np.radians(lon))
        self.sub: dict[int, tuple[int, np.ndarray]] = {}  # of a cell that is cut: its first number and its pivots
        self.size = len(lat)
        self.lo = self.hi = np.empty(0)

    def cut(self, cell: int, lat: np.ndarray, lon: np.ndarray) -> None:
        self.sub[cell] = (self.size, _unit(np.radians(lat), np.radians(lon)))
        self.size += len(lat)

    def ranges(self, lo: np.ndarray, hi: np.ndarray) -> None:
        self.lo, self.hi = lo, hi

    def of_left(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cells of the points that a right point may be near to."""
        u = _unit(np.radians(lat), np.radians(lon))
        cell, d = np.empty(len(u), dtype=np.int64), np.empty(len(u))
        for a in range(0, len(u), 4096):
            cell[a : a + 4096], d[a : a + 4096] = _nearest(u[a : a + 4096], self.top)
        for c, (start, pivots) in self.sub.items():
            at = np.flatnonzero(cell == c)
            if len(at):
                near, d[at] = _nearest(u[at], pivots)
                cell[at] = start + near
        r = self.km + _SLACK
        keep = np.flatnonzero((d >= self.lo[cell] - r) & (d <= self.hi[cell] + r))
        return keep, cell[keep]

    def of_right(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, cells and pivot distances, a row per cell that a point is copied to."""
        u = _unit(np.radians(lat), np.radians(lon))
        parts = []
        for a in range(0, len(u), 2048):
            i, c, d = _copies(u[a : a + 2048], self.top, self.km)
            parts.append((i + a, c, d))
        i, c, d = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, dtype=np.int64) for k in range(3))
        out = [(i, c, d)] if not self.sub else []
        if self.sub:
            plain = ~np.isin(c, np.fromiter(self.sub, dtype=np.int64))
            out.append((i[plain], c[plain], d[plain]))
            for cell, (start, pivots) in self.sub.items():
                at = i[c == cell]
                if len(at):
                    j, k, e = _copies(u[at], pivots, self.km)
                    out.append((at[j], start + k, e))
        return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def _angles(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances in km, right to about a metre: for bounds that have slack."""
    return EARTH_KM * np.arccos(np.clip(u @ pivots.T, -1.0, 1.0))


def _nearest(u: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dots = u @ pivots.T
    c = dots.argmax(axis=1)
    return c, EARTH_KM * np.arccos(np.clip(dots[np.arange(len(u)), c], -1.0, 1.0))


def _copies(u: np.ndarray, pivots: np.ndarray, km: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d = _angles(u, pivots)
    i, c = np.nonzero(d <= d.min(axis=1, keepdims=True) + 2 * km + _SLACK)
    return i, c, d[i, c]


def _sample(right: DataFrame, want: int) -> list:
    """Distinct right places in the order of a hash of the place: the same for the same rows."""
    return right.select("lat", "lon").distinct().orderBy(F.xxhash64("lat", "lon"), "lat", "lon").limit(want).collect()


def _place_rows(side: DataFrame, place: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]], schema: str) -> DataFrame:
    """Rows with their cells (and what else ``place`` gives), in whole Arrow batches."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, *more = place(b.column("lat").to_numpy(zero_copy_only=False), b.column("lon").to_numpy(zero_copy_only=False))
            t = b.take(pa.array(i))
            cols = [t.column(k) for k in range(3)] + [pa.array(m) for m in more]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "lat", "lon", "cell", "d"][: len(cols)])

    return side.select("id", "lat", "lon").mapInArrow(placed, schema)


def _several_places(side: DataFrame) -> bool:
    """Whether an id has more than one place (ids that share a hash may say so for nothing)."""
    place = F.xxhash64("lat", "lon")
    return not side.groupBy(F.xxhash64("id").alias("h")).agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").isEmpty()


def cells_of(right: DataFrame, km: float, cell_rows: int, pivots: int | None) -> tuple[Pivots, DataFrame, np.ndarray] | None:
    """The cells, the right points placed in them, and how many each holds; None if there is no right point."""
    n = right.count()
    first = _sample(right, min(pivots or max(16, -(-n // cell_rows)), MAX_PIVOTS))
    if not first:
        return None
    cells = Pivots(np.array([r.lat for r in first]), np.array([r.lon for r in first]), km)
    kind = right.schema["id"].dataType.simpleString()
    schema = f"id {kind}, lat double, lon double, cell bigint, d double"
    placed = written(_place_rows(right, cells.of_right, schema))
    counts = lambda df: df.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).collect()  # noqa: E731  a row per pivot
    stats = counts(placed)
    heavy = {r.cell: min(MAX_SUB, -(-r.n // cell_rows)) for r in stats if r.n > 2 * cell_rows}
    if heavy:
        # A share of each heavy cell's places, drawn by a hash: as many as pivots are wanted, on average.
        n_of = {r.cell: r.n for r in stats}
        share = F.element_at(F.create_map(*[x for c, k in heavy.items() for x in (F.lit(c), F.lit(k / n_of[c]))]), F.col("cell"))
        drawn = placed.where(F.col("cell").isin(list(heavy))).select("cell", "lat", "lon").where(F.pmod(F.xxhash64("lat", "lon"), F.lit(1 << 30)) < share * (1 << 30)).distinct()
        found: dict[int, list] = {}
        for r in drawn.orderBy("cell", F.xxhash64("lat", "lon"), "lat", "lon").collect():
            found.setdefault(r.cell, []).append((r.lat, r.lon))
        for c, places in sorted(found.items()):
            if len(places) > 1:
                cells.cut(c, *np.array(places[: 2 * MAX_SUB]).T)
        placed = written(_place_rows(right, cells.of_right, schema))
        stats = counts(placed)
    lo, hi, right_n = np.full(cells.size, np.inf), np.full(cells.size, -np.inf), np.zeros(cells.size, dtype=np.int64)
    for r in stats:
        lo[r.cell], hi[r.cell], right_n[r.cell] = r.lo, r.hi, r.n
    cells.ranges(lo, hi)
    return cells, placed, right_n


def radius_join(left: Places, right: Places, km: float, block_rows: int = 100_000, pivots: int | None = None, cell_rows: int = 256) -> DataFrame:
    """Pairs (left_id, right_id) at most ``km`` apart, each once."""
    spark = left.df.sparkSession
    lft, rgt = left.usable(), right.usable()
    lt, rt = lft.schema["id"].dataType.simpleString(), rgt.schema["id"].dataType.simpleString()
    out_schema = f"left_id {lt}, right_id {rt}"
    got = cells_of(rgt, km, cell_rows, pivots)
    if got is None:
        return spark.createDataFrame([], out_schema)
    cells, placed, right_n = got
    near = written(_place_rows(lft, cells.of_left, f"id {lt}, lat double, lon double, cell bigint"))
    left_n = np.zeros(cells.size, dtype=np.int64)
    for r in near.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # a row per pivot
        left_n[r.cell] = r.n

    def blocks(counts: np.ndarray):
        """Blocks per cell: 1 but for those cells that a small map names."""
        many = {int(c): int(-(-counts[c] // block_rows)) for c in np.flatnonzero(counts > block_rows)}
        return F.coalesce(F.try_element_at(F.create_map(*[x for c, n in many.items() for x in (F.lit(c).cast("bigint"), F.lit(n))]), F.col("cell")), F.lit(1)) if many else F.lit(1)

    left_blocks, right_blocks = blocks(left_n), blocks(right_n)
    mine = lambda n: F.pmod(F.xxhash64(F.col("id")), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    a = near.withColumn("lb", mine(left_blocks)).withColumn("rb", every(right_blocks))
    b = placed.drop("d").withColumn("rb", mine(right_blocks)).withColumn("lb", every(left_blocks))

    def match(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"left_id": x["id"].iloc[:0], "right_id": y["id"].iloc[:0]})
        place = ["id", "lat", "lon"]
        x, y = x.drop_duplicates(place), y.drop_duplicates(place)
        tree = VantageTree(np.radians(y["lat"].to_numpy()), np.radians(y["lon"].to_numpy()))
        found = list(tree.within(np.radians(x["lat"].to_numpy()), np.radians(x["lon"].to_numpy()), km))
        i = np.concatenate([f[0] for f in found]) if found else np.empty(0, dtype=np.int64)
        j = np.concatenate([f[1] for f in found]) if found else np.empty(0, dtype=np.int64)
        return pd.DataFrame({"left_id": x["id"].to_numpy()[i], "right_id": y["id"].to_numpy()[j]})

    keys = ["cell", "lb", "rb"]
    pairs = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(match, out_schema)
    # Only an id with several places can give a pair twice: its places may lie in different cells.
    return pairs.distinct() if _several_places(near) or _several_places(rgt) else pairs


def radius_join_report(left: Places, right: Places, km: float, pivots: int | None = None, cell_rows: int = 256) -> dict[str, float]:
    """How the cells of a radius join turn out: cells, the largest one, and copies per right point."""
    rgt = right.usable()
    got = cells_of(rgt, km, cell_rows, pivots)
    if got is None:
        return {"cells": 0, "largest": 0, "copies": 0.0}
    cells, _, n = got
    return {"cells": int((n > 0).sum()), "largest": int(n.max()), "copies": round(float(n.sum()) / rgt.count(), 3)}
