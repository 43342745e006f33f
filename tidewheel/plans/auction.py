"""The auction benchmark's queries (q0 to q9 and q12 to q22) over person, auction and bid tables.

Each takes a dict of the three DataFrames.  ``current`` queries (q5, q7, q8) show
the latest closed window only; ``all_windows`` variants give every window, as the
SQL text of the benchmark reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators import timeseries as ts

Tables = dict[str, DataFrame]
LAG_MS, WIDTH_MS, STEP_MS = 4_000, 10_000, 2_000


def q0(t: Tables) -> DataFrame:
    """Pass-through."""
    return t["bid"]


def q1(t: Tables) -> DataFrame:
    """Currency: integer price * 89 / 100."""
    return t["bid"].select("auction", "bidder", F.expr("price * 89 div 100").alias("price"), "date_time", "extra")


def q2(t: Tables) -> DataFrame:
    return t["bid"].where("auction % 123 = 0").select("auction", "price")


def q3(t: Tables) -> DataFrame:
    a = t["auction"].where("category = 10").select(F.col("id").alias("auction_id"), "seller")
    p = t["person"].where(F.col("state").isin("OR", "ID", "CA")).select(F.col("id").alias("seller"), "name", "city", "state")
    return a.join(p, "seller").select("name", "city", "state", F.col("auction_id").alias("id"))


def _valid_bids(t: Tables, *keep: str) -> DataFrame:
    a = t["auction"].select(F.col("id").alias("auction"), F.col("date_time").alias("opened"), "expires", *keep)
    b = t["bid"].select("auction", "bidder", "price", F.col("date_time").alias("bid_time"), F.col("extra").alias("bid_extra"))
    return b.join(a, "auction").where("bid_time >= opened AND bid_time <= expires")


def q4(t: Tables) -> DataFrame:
    """Integer average per category of the highest valid bid of each auction."""
    best = _valid_bids(t, "category").groupBy("auction", "category").agg(F.max("price").alias("final"))
    return best.groupBy("category").agg(F.sum("final").alias("s"), F.count("final").alias("n")).select("category", F.expr("s div n").alias("avg_final"))


def q5(t: Tables, all_windows: bool = False) -> DataFrame:
    """Auctions with most bids in the latest closed 10 s window (2 s steps are rounded to the width's clock as in the tumbling form)."""
    b = t["bid"].select("auction", "date_time")
    if all_windows:
        counts = ts.hopping(b, "date_time", WIDTH_MS, STEP_MS).groupBy("window_start", "auction").agg(F.count(F.lit(1)).alias("num"))
        top = F.max("num").over(Window.partitionBy("window_start"))
        return counts.withColumn("top", top).where("num = top").drop("top")
    lo, hi = ts.closed_window(ts.watermark(b, "date_time", LAG_MS), WIDTH_MS, STEP_MS)
    counts = ts.in_window(b, "date_time", lo, hi).groupBy("auction").agg(F.count(F.lit(1)).alias("num"))
    best = counts.agg(F.max("num").alias("num"))
    return counts.join(best, "num").select("auction", "num")


def q6(t: Tables) -> DataFrame:
    """Integer average per seller of the winning prices of the ten auctions with the highest ids."""
    best = _valid_bids(t, "seller").groupBy("seller", "auction").agg(F.max("price").alias("final"))
    w = Window.partitionBy("seller").orderBy(F.desc("auction"))
    ten = best.withColumn("r", F.row_number().over(w)).where("r <= 10")
    return ten.groupBy("seller").agg(F.sum("final").alias("s"), F.count("final").alias("n")).select("seller", F.expr("s div n").alias("avg_final"))


def q7(t: Tables, all_windows: bool = False) -> DataFrame:
    """Bids at the highest price of the latest closed 10 s window."""
    b = t["bid"].select("auction", "bidder", "price", "extra", "date_time")
    if all_windows:
        b = b.withColumn("window_start", ts.tumbling(F.col("date_time"), WIDTH_MS))
        return b.withColumn("top", F.max("price").over(Window.partitionBy("window_start"))).where("price = top").drop("top")
    lo, hi = ts.closed_window(ts.watermark(b, "date_time", LAG_MS), WIDTH_MS, WIDTH_MS)
    now = ts.in_window(b, "date_time", lo, hi)
    return now.join(now.agg(F.max("price").alias("price")), "price").select("auction", "bidder", "price", "extra")


def q8(t: Tables, all_windows: bool = False) -> DataFrame:
    """People who joined and opened an auction in the same (latest closed) 10 s window."""
    p, a = t["person"].select("id", "name", "date_time"), t["auction"].select("seller", F.col("date_time").alias("opened"))
    start = ts.tumbling(F.col("date_time"), WIDTH_MS).alias("starttime")
    if all_windows:
        a = a.select(F.col("seller").alias("id"), ts.tumbling(F.col("opened"), WIDTH_MS).alias("starttime"))
        return p.select("id", "name", start).join(a, ["id", "starttime"], "left_semi").distinct()
    lo, hi = ts.closed_window(ts.watermark(a, "opened", WIDTH_MS), WIDTH_MS, WIDTH_MS)
    now_a = ts.in_window(a, "opened", lo, hi).select(F.col("seller").alias("id"))
    return ts.in_window(p, "date_time", lo, hi).join(now_a, "id").select("id", "name", start)


def q9(t: Tables) -> DataFrame:
    """The winning bid of each auction: highest price, then highest bidder, then latest time."""
    cols = ("item_name", "description", "initial_bid", "reserve", "seller", "category", "extra")
    best = F.max(F.struct("price", "bidder", "bid_time", "bid_extra")).alias("b")
    won = _valid_bids(t, *cols).groupBy("auction", *cols, "opened", "expires").agg(best)
    return won.select(F.col("auction").alias("id"), *cols, F.col("opened").alias("date_time"), "expires", "b.bidder", "b.price", F.col("b.bid_time").alias("bid_time"), "b.bid_extra")


def q12(t: Tables, clock: Column | None = None) -> DataFrame:
    """Bids per bidder and 10 s of processing time; ``clock`` stands in for the arrival time in tests."""
    now = clock if clock is not None else F.unix_millis(F.current_timestamp())
    return t["bid"].select("bidder", ts.tumbling(now, WIDTH_MS).alias("starttime")).groupBy("bidder", "starttime").agg(F.count(F.lit(1)).alias("bid_count"))


def q13(t: Tables, side: DataFrame, arrived: Column | None = None) -> DataFrame:
    """Bids with the value of a side table (key, value, p_time) that was known when they arrived."""
    b = t["bid"].select("auction", "bidder", "price", "date_time", (F.col("auction") % 10_000).alias("key"), (arrived if arrived is not None else F.col("date_time")).alias("b_p_time"))
    return b.join(side, "key").where("b_p_time >= p_time").select("auction", "bidder", "price", "date_time", "value")


def q14(t: Tables) -> DataFrame:
    price = F.col("price").cast("decimal(18,0)") * F.lit("0.908").cast("decimal(4,3)")
    hour = F.call_function("div", F.pmod("date_time", F.lit(86_400_000)), F.lit(3_600_000))
    kind = F.when(hour.between(8, 18), "dayTime").when((hour <= 6) | (hour >= 20), "nightTime").otherwise("otherTime")
    count_c = F.length("extra") - F.length(F.replace("extra", F.lit("c"), F.lit("")))
    return t["bid"].select("auction", "bidder", price.alias("price"), kind.alias("bid_time_type"), "date_time", "extra", count_c.alias("c_counts")).where("price > 1000000 AND price < 50000000")


_RANKS = (("rank1", "price < 10000"), ("rank2", "price >= 10000 AND price < 1000000"), ("rank3", "price >= 1000000"))


def _day() -> Column:
    return F.date_format(F.timestamp_millis("date_time"), "yyyy-MM-dd").alias("day")


def _counts(bids: DataFrame, keys: list[str], *extra: Column) -> DataFrame:
    """Total and per rank: bids, bidders and auctions (12 counts).

    Distinct counts go through one row per (key, bidder) and (key, auction) with a
    flag per rank, instead of expanding every bid once per distinct count.
    """
    out = bids.groupBy(*keys).agg(*extra, F.count(F.lit(1)).alias("total_bids"), *[F.count_if(F.expr(c)).alias(f"{r}_bids") for r, c in _RANKS])
    for col, name in (("bidder", "bidders"), ("auction", "auctions")):
        seen = bids.groupBy(*keys, col).agg(*[F.max(F.expr(c)).alias(r) for r, c in _RANKS])
        per_key = seen.groupBy(*keys).agg(F.count(col).alias(f"total_{name}"), *[F.count_if(F.col(r) & F.col(col).isNotNull()).alias(f"{r}_{name}") for r, _ in _RANKS])
        out = out.join(per_key, keys)
    return out


def q15(t: Tables) -> DataFrame:
    return _counts(t["bid"].select("auction", "bidder", "price", _day()), ["day"])


def q16(t: Tables) -> DataFrame:
    minute = F.date_format(F.timestamp_millis("date_time"), "HH:mm").alias("minute")
    return _counts(t["bid"].select("auction", "bidder", "price", "channel", _day(), minute), ["channel", "day"], F.max("minute").alias("minute"))


def q17(t: Tables) -> DataFrame:
    stats = t["bid"].groupBy("auction", _day()).agg(
        F.count(F.lit(1)).alias("total_bids"), *[F.count_if(F.expr(c)).alias(f"{r}_bids") for r, c in _RANKS], F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.sum("price").alias("sum_price")
    )
    return stats.withColumn("avg_price", F.expr("sum_price div total_bids"))


def q18(t: Tables) -> DataFrame:
    """The latest bid of each (auction, bidder); on ties the least in column order."""
    w = Window.partitionBy("auction", "bidder").orderBy(F.desc("date_time"), "price", "channel", "url", "extra")
    return t["bid"].withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def q19(t: Tables) -> DataFrame:
    """The ten highest bids of each auction."""
    w = Window.partitionBy("auction").orderBy(F.desc("price"), F.desc("bidder"), F.desc("channel"), F.desc("url"), F.desc("date_time"), F.desc("extra"))
    return t["bid"].withColumn("r", F.row_number().over(w)).where("r <= 10").drop("r")


def q20(t: Tables) -> DataFrame:
    a = t["auction"].where("category = 10").select(F.col("id").alias("auction"), "item_name", "description", "initial_bid", "reserve", F.col("date_time").alias("auction_time"), "expires", "seller", "category", F.col("extra").alias("auction_extra"))
    return t["bid"].join(a, "auction")


def q21(t: Tables, of: str = "channel") -> DataFrame:
    """Channel ids: fixed ones of four channels, else from a parameter in column ``of`` (the SQL text reads ``url``)."""
    c = F.lower("channel")
    found = F.regexp_extract(of, "channel_id=([^&]*)", 1)
    cid = F.when(c == "apple", "0").when(c == "google", "1").when(c == "facebook", "2").when(c == "baidu", "3").when(F.col(of).rlike("channel_id=[^&]*"), found)
    return t["bid"].select("auction", "bidder", "price", "channel", cid.alias("channel_id")).where("channel_id IS NOT NULL")


def q22(t: Tables, of: str = "channel") -> DataFrame:
    """Three directories of column ``of`` (the SQL text reads ``url``); empty where there are fewer."""
    return t["bid"].select("auction", "bidder", "price", "channel", *[F.split_part(F.col(of), F.lit("/"), F.lit(i + 3)).alias(f"dir{i}") for i in (1, 2, 3)])
