"""Fixed points: semi-naive recursion, iteration, and the graph queries on top.

Rounds run on the driver; what is found in a round is cut from its lineage by
``checkpoint()`` in the shared folder, so a lost executor costs no recomputation
of earlier rounds.  Only counts come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators import paths
from tidewheel.session import cut_lineage, is_empty, written, written_counted
from tidewheel.zset import W

Relations = dict[str, DataFrame]
COMPACT_EVERY = 8
_SHORT_ROUNDS = 4  # rounds along single links before they are lengthened


def fixpoint(seeds: Mapping[str, DataFrame], rules: Callable[[Relations, Relations], Relations], max_rounds: int = 1000, compact_every: int = COMPACT_EVERY) -> Relations:
    """Least fixed point of mutually recursive set relations.

    ``rules(all, new)`` derives rows from what is known and what the last round
    added; each derivation must use ``new`` in at least one place, once for each
    recursive occurrence.  Duplicates and known rows are removed here.
    """
    known: Relations = {k: written(df.distinct()) for k, df in seeds.items()}
    new = dict(known)
    for i in range(1, max_rounds + 1):
        fresh: Relations = {}
        found = 0
        for name, derived in rules(known, new).items():
            cols = known[name].columns
            cond = [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in cols]
            fresh[name], n = written_counted(derived.select(*cols).distinct().alias("a").join(known[name].alias("b"), [x for x in cond], "left_anti"))
            found += n
        if not found:
            return known
        known = {k: df.unionByName(fresh[k]) if k in fresh else df for k, df in known.items()}
        if i % compact_every == 0:  # until then a union of parts that are cut from their lineage
            known = {k: written(df) for k, df in known.items()}
        new = {k: fresh.get(k, df.where("false")) for k, df in known.items()}
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def maintain(
    known: DataFrame, seeds: DataFrame, seed_change: DataFrame, links: DataFrame, link_change: DataFrame,
    step: Callable[[DataFrame, DataFrame], DataFrame], cut: Callable[[DataFrame], DataFrame] = cut_lineage, max_rounds: int = 1000, chain: tuple[str, str] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The least set X = seeds + step(X, links) after a change of both: (X, gained, lost).

    ``known``, ``seeds`` and ``links`` are the sets before; changes carry weights +1
    and -1 of rows that come and go.  ``step`` is linear in both arguments.

    Deletes: all that was derived through what is gone is taken out, round by round,
    then what has another derivation from the rest is put back.  Inserts: rounds go
    on from what is new only.  A round joins new rows with links and looks them up
    in ``known``; it never derives a known row again from known rows.

    ``chain`` names the columns from and to which a link leads, if links have no
    others and two steps along links are one step along their path: after a few
    rounds the rest then goes along lengthened links.
    """
    cols = known.columns
    rows = lambda df: df.select(*cols)

    def same(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
        cond = [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in cols]
        return a.alias("a").join(b.alias("b"), cond, how)

    def fresh(candidates: DataFrame, *sets: DataFrame) -> DataFrame:
        """Candidates in none of the sets: of these only what equals a candidate is looked at further."""
        out = rows(candidates).distinct()
        for s in sets:
            out = same(out, s, "left_anti")
        return cut(out)

    part = lambda d, sign, like: d.where(F.col(W) * sign > 0).select(*like.columns)
    seeds_in, seeds_out = part(seed_change, 1, seeds), part(seed_change, -1, seeds)
    seeds_out = cut(seeds_out)
    links_in, links_out = cut(part(link_change, 1, links)), cut(part(link_change, -1, links))
    seeds_now = same(rows(seeds), rows(seeds_out), "left_anti").unionByName(rows(seeds_in))
    link_cond = [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in links.columns]
    links_left = cut(links.alias("a").join(links_out.alias("b"), link_cond, "left_anti"))
    links_now = links_left.unionByName(links_in)

    def longer_links(df: DataFrame) -> DataFrame:
        a, b = chain
        return lengthened(df.select(F.col(a).alias("src"), F.col(b).alias("dst")))[0].select(F.col("src").alias(a), F.col("dst").alias(b))

    gone, kept, back = None, known, None
    if not (is_empty(links_out) and is_empty(seeds_out)):
        front = cut(same(rows(seeds_out).unionByName(rows(step(known, links_out))).distinct(), known, "left_semi"))
        gone, along = front, links
        for i in range(max_rounds):
            if is_empty(front):
                break
            if chain and i == _SHORT_ROUNDS:
                along = longer_links(links)
            front = cut(same(fresh(step(front, along), gone), known, "left_semi"))
            gone = gone.unionByName(front)
        gone = cut(gone)
        kept = cut(same(known, gone, "left_anti"))
        # Rows taken out that a seed or a step from what is left gives as well.
        back = cut(same(gone, rows(seeds_now).unionByName(rows(step(kept, links_left))), "left_semi"))

    start = rows(seeds_in).unionByName(rows(step(kept, links_in)))
    if back is not None:
        start = start.unionByName(back)
    new = fresh(start, kept)
    gained = new
    for i in range(max_rounds):
        if is_empty(new):
            break
        if chain and i == _SHORT_ROUNDS:
            links_now = longer_links(links_now)
        new = fresh(step(new, links_now), kept, gained)
        gained = gained.unionByName(new)
        if i % COMPACT_EVERY == COMPACT_EVERY - 1:
            gained = cut(gained)
    now = cut(kept.unionByName(gained))
    if gone is None:
        return now, gained, known.where("false")
    return now, same(gained, gone, "left_anti"), same(gone, gained, "left_anti")


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], until: Callable[[DataFrame, DataFrame], bool] | int, max_rounds: int = 1000) -> DataFrame:
    """Repeats ``step`` a fixed number of times, or until ``until(old, new)``."""
    rounds = until if isinstance(until, int) else max_rounds
    for i in range(rounds):
        nxt = cut_lineage(step(state, i))
        if not isinstance(until, int) and until(state, nxt):
            return nxt
        state = nxt
    return state


def _onward(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("src", F.col("dst").alias("mid")).join(b.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")


LONGER = 16


def lengthened(edges: DataFrame, longer: int = LONGER) -> tuple[DataFrame, int, bool]:
    """Edges (src, dst) replaced by paths of up to 2, 4, 8, .. of them: (paths, how many, whether they are all there are).

    It goes on for as long as there are at most ``longer`` times as many as edges;
    the pairs that a doubling would look at are counted before.
    """
    e, n = written_counted(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    most, before = longer * n, 0
    while n and n != before:
        ends = e.groupBy(F.col("dst").alias("v")).agg(F.count(F.lit(1)).alias("i")).join(e.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("o")), "v")
        if n + (ends.agg(F.sum(F.col("i") * F.col("o"))).first()[0] or 0) > most:
            return e, n, False
        before = n
        e, n = written_counted(e.unionByName(_onward(e, e)).distinct())
    return e, n, True


def transitive_closure(edges: DataFrame, longer: int = LONGER) -> DataFrame:
    """All (src, dst) with a path.

    Edges that fit one task are condensed there and the rows made when they are read
    (``paths``); of more, lengthened edges divide the number of rounds by their length.
    """
    e = written(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    if paths.fits(e):
        return paths.change(None, written(paths.condensed(e))).select("src", "dst")
    e, _, complete = lengthened(e, longer)
    return e if complete else fixpoint({"path": e}, lambda known, new: {"path": _onward(new["path"], e)})["path"]


def bfs(vertices: DataFrame, edges: DataFrame, source: int, unreachable: int = 2**63 - 1) -> DataFrame:
    """(id, distance) by number of edges; unreachable vertices get the given number."""
    spark = vertices.sparkSession
    links = written(edges.select("src", "dst"))
    found = spark.createDataFrame([(source, 0)], "id bigint, distance bigint")
    front, n, depth = found, 1, 0
    while n:
        depth += 1
        reached = front.select(F.col("id").alias("src")).join(links, "src").select(F.col("dst").alias("id")).distinct()
        front, n = written_counted(reached.join(found, "id", "left_anti").select("id", F.lit(depth).cast("bigint").alias("distance")))
        found = found.unionByName(front)
        if depth % COMPACT_EVERY == 0:  # until then a union of written parts
            found = written(found)
    return vertices.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("distance", F.lit(unreachable)).alias("distance"))


def pagerank(vertices: DataFrame, edges: DataFrame, rounds: int, damping: float = 0.85) -> DataFrame:
    """(id, rank) after a fixed number of rounds; the rank of vertices without out-edges is dealt to all."""
    v = cut_lineage(vertices.select("id").distinct())
    n = v.count()
    if n == 0:
        return v.select("id", F.lit(0.0).alias("rank"))
    e = edges.select("src", "dst").distinct()
    degree = e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    base = v.join(degree, "id", "left")
    links = cut_lineage(e.join(degree.withColumnRenamed("id", "src"), "src").select("src", "dst", "degree"))
    base = cut_lineage(base)

    def step(ranks: DataFrame, _: int) -> DataFrame:
        sent = links.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        lost = base.where("degree is null").join(ranks, "id").agg(F.sum("rank")).first()[0] or 0.0
        fixed = (1 - damping) / n + damping * lost / n
        return base.join(sent, "id", "left").select("id", (F.lit(fixed) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))

    return iterate(v.select("id", F.lit(1.0 / n).alias("rank")), step, rounds)


def propagate_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label): every label on each vertex that a path reaches from one that has it."""
    e = edges.select("src", "dst")
    step = lambda known, new: {"at": new["at"].join(e, new["at"]["id"] == e["src"]).select(F.col("dst").alias("id"), "label")}
    return fixpoint({"at": labels.select("id", "label")}, step)["at"]
