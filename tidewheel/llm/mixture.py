"""Mixing sources to target shares of the total size.

Every document of a source is repeated N times, N drawn from a Poisson
distribution cut at the source's ``max_repeats`` by inverting its distribution
function at a uniform number that is a hash of (document, seed): the draw is the
same wherever and however often it is evaluated, and no state is shared.  The
documents are exploded by their counts and shuffled globally by a second hash.

Total and rates.  The mixture is as large as the targets and caps allow: the
source that would have to be repeated most is used up to its cap, and the others
follow their shares of that total (or of ``total``, if given and smaller).
Sources that hold nothing take no part; their share is dealt to the others in
proportion.  The Poisson mean of a source is the one whose expected number of
repeats is the target rate; it is then fitted to the draws themselves, since
lengths are uneven: tokens are counted once per source and SLOTS equal parts of the
uniform number, which gives the tokens that any mean would draw, and the mean whose
tokens come nearest to the goal is taken.  The report shows both means.

The driver holds a few numbers per source; MAX_SOURCES bounds them.  Thresholds of
the draws are a small table that is joined, not literals of the plan.

Defined cases: documents with a null id, a null source or a source without target
are left out; repeated ids count once; a null size is 0; targets that are null,
not positive or without repeats are ignored, of a source listed twice the first in
order of share and repeats counts; empty tables give no rows; other columns are
not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.session import written

MAX_SOURCES = 10_000
SLOTS = 65_536


@dataclass
class Plan:
    """What is drawn of one source."""

    source: str
    share: float
    max_repeats: int
    available: int = 0
    goal: float = 0.0
    rate: float = 0.0
    mean: float = 0.0  # of the target rate
    fitted: float = 0.0  # of the draws


def thresholds(mean: float, most: int) -> list[float]:
    """Distribution function at 0 .. most-1: a uniform number at or above k of them means k repeats."""
    if math.isinf(mean):
        return [0.0] * most
    out, p, total = [], math.exp(-mean), 0.0
    for k in range(most):
        total += p
        out.append(min(total, 1.0))
        p *= mean / (k + 1)
    return out


def expected(mean: float, most: int) -> float:
    """The mean number of repeats of a Poisson distribution cut at ``most``."""
    return sum(1.0 - t for t in thresholds(mean, most))


def mean_for(rate: float, most: int) -> float:
    """The Poisson mean that, cut at ``most``, gives ``rate`` repeats on average."""
    if rate >= most * (1 - 1e-12):
        return math.inf
    lo, hi = 0.0, 1.0
    while expected(hi, most) < rate and hi < 1e6:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if expected(mid, most) < rate else (lo, mid)
    return (lo + hi) / 2


def _uniform(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(2**53)) / F.lit(float(2**53))


def fit(tokens: np.ndarray, goal: float, most: int) -> float:
    """The Poisson mean that draws about ``goal`` tokens, given those per slot of the uniform number."""
    n = len(tokens)
    tail = np.r_[np.cumsum(tokens[::-1])[::-1], 0]  # tokens at or above a slot

    def drawn(mean: float) -> float:
        at = np.array(thresholds(mean, most)) * n
        low = np.minimum(np.floor(at).astype(int), n - 1)
        return float((tail[low] - (at - low) * tokens[low]).sum())

    lo, hi = 0.0, 1.0
    while drawn(hi) < goal and hi < 1e6:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if drawn(mid) < goal else (lo, mid)
    return (lo + hi) / 2


def read_targets(targets: DataFrame) -> dict[str, Plan]:
    rows = targets.select(F.col("source").cast("string"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).where("source is not null and target_share > 0 and not isnan(target_share) and max_repeats > 0").distinct().orderBy("source", "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    out: dict[str, Plan] = {}
    for s, share, most in rows:
        out.setdefault(s, Plan(s, share, most))
    return out


def plan_mixture(sized: DataFrame, plans: dict[str, Plan], seed: int, total: float | None = None) -> dict[str, Plan]:
    """Rates and Poisson means from the sizes (doc_id, source, tokens), each document once."""
    for r in sized.groupBy("source").agg(F.sum("tokens").alias("n")).collect():  # a row per listed source
        plans[r.source].available = int(r.n)
    live = [p for p in plans.values() if p.available > 0]
    whole = sum(p.share for p in live)
    most = min((p.max_repeats * p.available / (p.share / whole) for p in live), default=0.0)
    size = min(most, total) if total else most
    for p in live:
        p.goal = size * p.share / whole
        p.rate = p.goal / p.available
        p.mean = mean_for(p.rate, p.max_repeats)
        p.fitted = p.mean
    goals = [(p.source, float(p.goal), p.max_repeats) for p in live if not math.isinf(p.mean)]
    if goals:
        slots = sized.withColumn("slot", F.floor(_uniform(seed) * SLOTS).cast("int")).groupBy("source", "slot").agg(F.sum("tokens").alias("tokens"))
        wanted = F.broadcast(sized.sparkSession.createDataFrame(goals, "source string, goal double, most int"))  # at most MAX_SOURCES rows

        def of_source(pdf: pd.DataFrame) -> pd.DataFrame:
            tokens = np.zeros(SLOTS)
            tokens[pdf["slot"].to_numpy()] = pdf["tokens"].to_numpy(dtype=float)
            return pd.DataFrame({"source": pdf["source"].iloc[:1], "fitted": [fit(tokens, pdf["goal"].iloc[0], int(pdf["most"].iloc[0]))]})

        for r in slots.join(wanted, "source").groupBy("source").applyInPandas(of_source, "source string, fitted double").collect():  # a row per source
            plans[r.source].fitted = r.fitted
    return plans


def sizes_of(docs: DataFrame, plans: dict[str, Plan], doc_id: str, source: str, tokens: str) -> DataFrame:
    """(doc_id, source, tokens) of the listed sources, each document once, cut from its lineage."""
    listed = docs.sparkSession.createDataFrame([(s,) for s in sorted(plans)], "source string")
    return written(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("tokens"))
        .where("doc_id is not null").join(F.broadcast(listed), "source", "left_semi")
        .select("doc_id", "source", "tokens").dropDuplicates(["doc_id"])
    )


def _levels(spark: SparkSession, plans: dict[str, Plan]) -> DataFrame:
    """The thresholds of each source that holds something; at most MAX_SOURCES rows."""
    live = [(p.source, thresholds(p.fitted, p.max_repeats)) for p in plans.values() if p.available > 0]
    return F.broadcast(spark.createDataFrame(live, "source string, levels array<double>"))


def draw(sized: DataFrame, plans: dict[str, Plan], seed: int) -> DataFrame:
    """(doc_id, copy, source, tokens, mix_key), shuffled globally in the order of mix_key."""
    drawn = sized.withColumn("u", _uniform(seed)).join(_levels(sized.sparkSession, plans), "source")
    n = F.size(F.filter("levels", lambda t: F.col("u") >= t))
    copies = drawn.withColumn("n", n).where("n > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"), "source", "tokens")
    keyed = copies.withColumn("mix_key", F.xxhash64("doc_id", "copy", F.lit(seed + 1)))
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key")


def mix(docs: DataFrame, targets: DataFrame, doc_id: str, source: str, tokens: str, seed: int = 7, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture and the report of the shares reached."""
    plans = read_targets(targets)
    sized = sizes_of(docs, plans, doc_id, source, tokens)
    plan_mixture(sized, plans, seed, total)
    mixture = draw(sized, plans, seed)
    return mixture, shares(mixture, plans)


def shares(mixture: DataFrame, plans: dict[str, Plan]) -> DataFrame:
    """Per listed source: target, what there is, what was taken and the share reached."""
    spark = mixture.sparkSession
    goal = spark.createDataFrame(
        [(p.source, p.share, p.max_repeats, p.available, p.rate, p.mean, p.fitted) for p in plans.values()],
        "source string, target_share double, max_repeats int, available_tokens bigint, target_repeats double, poisson_mean double, fitted_mean double",
    )
    per_doc = mixture.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))
    got = per_doc.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("copies"), F.max("n").alias("most_repeats"), F.sum("tokens").alias("mixed_tokens"))
    joined = goal.join(got, "source", "left").fillna(0, ["documents", "copies", "most_repeats", "mixed_tokens"])
    all_tokens = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))  # at most MAX_SOURCES rows
    share = F.when(F.col("all_tokens") > 0, F.col("mixed_tokens") / F.col("all_tokens")).otherwise(0.0)
    return joined.withColumn("all_tokens", all_tokens).withColumn("actual_share", F.round(share, 6)).drop("all_tokens")
