"""The auction queries over a market made of the star schema, with their SQL.

People are customers, auctions are orders, bids are order lines.  A day of the
tables lasts a minute, so ten-second windows hold rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.plans import auction
from tidewheel.session import table
from tidewheel.sources.auctions import CHANNELS, CITIES, STATES

_PERSON = f"""person AS (SELECT c_custkey AS id, c_name AS name, {STATES}[c_nationkey % 6 + 1] AS state, {CITIES}[c_nationkey % 10 + 1] AS city, (8766 + c_custkey % 2400) * 60000 AS date_time FROM customer)"""
_AUCTION = """auction AS (SELECT o_orderkey AS id, 'item ' || o_orderkey AS item_name, o_orderpriority AS description, CAST(floor(o_totalprice) AS bigint) AS initial_bid, CAST(floor(o_totalprice) AS bigint) * 2 AS reserve,
  CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS date)) * 60000 AS bigint) AS date_time, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS date)) * 60000 + 3600000 AS bigint) AS expires, o_custkey AS seller, o_orderkey % 5 + 10 AS category, o_orderstatus AS extra FROM orders)"""
_BID = f"""bid AS (SELECT l_orderkey AS auction, l_suppkey AS bidder, CAST(floor(l_extendedprice * 100) AS bigint) AS price, CASE WHEN l_linenumber <= 4 THEN {CHANNELS}[l_linenumber] ELSE 'shop/' || l_suppkey || '/a/b?channel_id=' || l_linenumber || '&x' END AS channel,
  'https://auctions.example/' || l_suppkey || '/item/' || l_partkey AS url, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS date)) * 60000 + l_partkey % 60 * 1000 + l_linenumber * 100 AS bigint) AS date_time, 'c' || l_returnflag || 'cc' || l_partkey AS extra FROM lineitem)"""
_LATE = """, a8 AS (SELECT seller, date_time // 60000 * 1000 + id % 1000 AS date_time FROM auction),
  p8 AS (SELECT p.id, name, coalesce(last, p.date_time // 60) AS date_time FROM person p LEFT JOIN (SELECT seller, max(date_time) AS last FROM a8 GROUP BY 1) l ON l.seller = p.id) """
_ALL = f"WITH {_PERSON}, {_AUCTION}, {_BID}"


def market(spark: SparkSession, d: str) -> auction.Tables:
    """person, auction and bid tables."""
    pick = lambda words, n: F.element_at(F.lit(words), (n + 1).cast("int"))
    minutes = lambda c: F.unix_date(F.to_date(c)).cast("bigint") * 60_000
    n = F.col("c_nationkey")
    person = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), pick(STATES, n % 6).alias("state"), pick(CITIES, n % 10).alias("city"), ((F.col("c_custkey") % 2400 + 8766) * 60_000).alias("date_time"))
    first = F.floor("o_totalprice").cast("bigint")
    auctions = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("item "), F.col("o_orderkey")).alias("item_name"), F.col("o_orderpriority").alias("description"), first.alias("initial_bid"), (first * 2).alias("reserve"), minutes("o_orderdate").alias("date_time"),
        (minutes("o_orderdate") + 3_600_000).alias("expires"), F.col("o_custkey").alias("seller"), (F.col("o_orderkey") % 5 + 10).alias("category"), F.col("o_orderstatus").alias("extra"),
    )
    ln = F.col("l_linenumber")
    channel = F.when(ln <= 4, pick(CHANNELS, F.least(ln, F.lit(4)) - 1)).otherwise(F.concat(F.lit("shop/"), F.col("l_suppkey"), F.lit("/a/b?channel_id="), ln, F.lit("&x")))
    bid = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("auction"), F.col("l_suppkey").alias("bidder"), F.floor(F.col("l_extendedprice") * 100).cast("bigint").alias("price"), channel.alias("channel"),
        F.concat(F.lit("https://auctions.example/"), F.col("l_suppkey"), F.lit("/item/"), F.col("l_partkey")).alias("url"), (minutes("l_shipdate") + F.col("l_partkey") % 60 * 1000 + ln * 100).alias("date_time"), F.concat(F.lit("c"), F.col("l_returnflag"), F.lit("cc"), F.col("l_partkey")).alias("extra"),
    )
    return {"person": person, "auction": auctions, "bid": bid}


def side_input(spark: SparkSession, d: str) -> DataFrame:
    """q13's side table (key, value, p_time): parts."""
    return table(spark, d, "part").select((F.col("p_partkey") % 10_000).alias("key"), F.col("p_name").alias("value"), (F.col("p_partkey") % 1000 * 600_000).alias("p_time"))


def _run(f: Callable[..., DataFrame], spark: SparkSession, d: str, **kw) -> DataFrame:
    return f(market(spark, d), **kw)


def _joined_late(spark: SparkSession, d: str, **kw) -> DataFrame:
    """q8 on a market whose days last a second and whose people join when they open their last auction."""
    t = market(spark, d)
    a = t["auction"].withColumn("date_time", F.expr("date_time div 60000 * 1000 + id % 1000"))
    last = a.groupBy(F.col("seller").alias("id")).agg(F.max("date_time").alias("last"))
    p = t["person"].join(last, "id", "left").withColumn("date_time", F.coalesce("last", F.expr("date_time div 60"))).drop("last")
    return auction.q8({"person": p, "auction": a, "bid": t["bid"]}, **kw)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f"auction_q{i}": partial(_run, getattr(auction, f"q{i}")) for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 14, 15, 16, 17, 18, 19, 20, 21, 22)
}
QUERIES |= {f"auction_q{i}_all_windows": partial(_run, getattr(auction, f"q{i}"), all_windows=True) for i in (5, 7, 8)}
QUERIES |= {"auction_q8": _joined_late, "auction_q8_all_windows": partial(_joined_late, all_windows=True)}
QUERIES |= {f"auction_q{i}_url": partial(_run, getattr(auction, f"q{i}"), of="url") for i in (21, 22)}
QUERIES["auction_q12"] = lambda spark, d: auction.q12(market(spark, d), F.col("date_time") + 5)
QUERIES["auction_q13"] = lambda spark, d: auction.q13(market(spark, d), side_input(spark, d))

_VALID = "v AS (SELECT b.auction, b.bidder, b.price, b.date_time AS bid_time, b.extra AS bid_extra, a.item_name, a.description, a.initial_bid, a.reserve, a.date_time AS opened, a.expires, a.seller, a.category, a.extra FROM bid b JOIN auction a ON a.id = b.auction WHERE b.date_time BETWEEN a.date_time AND a.expires)"
_RANK = (("rank1", "price < 10000"), ("rank2", "price >= 10000 AND price < 1000000"), ("rank3", "price >= 1000000"))
_COUNTS = ", ".join(
    ["count(*) AS total_bids", *[f"count(*) FILTER (WHERE {c}) AS {r}_bids" for r, c in _RANK]]
    + [x for col, name in (("bidder", "bidders"), ("auction", "auctions")) for x in (f"count(DISTINCT {col}) AS total_{name}", *[f"count(DISTINCT {col}) FILTER (WHERE {c}) AS {r}_{name}" for r, c in _RANK])]
)
_DAY = "strftime(epoch_ms(date_time), '%Y-%m-%d') AS day"
_HI = "(SELECT (m - {lag}) - (m - {lag}) % {step} AS hi FROM (SELECT max(date_time) AS m FROM {of}))"


def _channel_id(of: str) -> str:
    return f"""SELECT * FROM (SELECT auction, bidder, price, channel, CASE lower(channel) WHEN 'apple' THEN '0' WHEN 'google' THEN '1' WHEN 'facebook' THEN '2' WHEN 'baidu' THEN '3'
      ELSE CASE WHEN regexp_matches({of}, 'channel_id=[^&]*') THEN regexp_extract({of}, 'channel_id=([^&]*)', 1) END END AS channel_id FROM bid) WHERE channel_id IS NOT NULL"""


def _dirs(of: str) -> str:
    return "SELECT auction, bidder, price, channel, " + ", ".join(f"split_part({of}, '/', {i + 3}) AS dir{i}" for i in (1, 2, 3)) + " FROM bid"


SQL: dict[str, str] = {
    f"auction_{k}": f"{_ALL}{s if s.startswith(',') else ' ' + s}"
    for k, s in {
        "q0": "SELECT * FROM bid",
        "q1": "SELECT auction, bidder, price * 89 // 100 AS price, date_time, extra FROM bid",
        "q2": "SELECT auction, price FROM bid WHERE auction % 123 = 0",
        "q3": "SELECT name, city, state, a.id FROM auction a JOIN person p ON p.id = a.seller WHERE category = 10 AND state IN ('OR', 'ID', 'CA')",
        "q4": f", {_VALID} SELECT category, CAST(sum(final) // count(*) AS bigint) AS avg_final FROM (SELECT auction, category, max(price) AS final FROM v GROUP BY 1, 2) GROUP BY 1",
        "q5": f", c AS (SELECT auction, count(*) AS num FROM bid, {_HI.format(lag=4000, step=2000, of='bid')} WHERE date_time >= hi - 10000 AND date_time < hi GROUP BY 1) SELECT * FROM c WHERE num = (SELECT max(num) FROM c)",
        "q5_all_windows": ", c AS (SELECT date_time - date_time % 2000 - 2000 * i AS window_start, auction, count(*) AS num FROM (SELECT *, unnest(range(0, 5)) AS i FROM bid) GROUP BY 1, 2) SELECT window_start, auction, num FROM (SELECT *, max(num) OVER (PARTITION BY window_start) AS top FROM c) WHERE num = top",
        "q6": f", {_VALID} SELECT seller, CAST(sum(final) // count(*) AS bigint) AS avg_final FROM (SELECT *, row_number() OVER (PARTITION BY seller ORDER BY auction DESC) AS r FROM (SELECT seller, auction, max(price) AS final FROM v GROUP BY 1, 2)) WHERE r <= 10 GROUP BY 1",
        "q7": f", w AS (SELECT auction, bidder, price, extra FROM bid, {_HI.format(lag=4000, step=10000, of='bid')} WHERE date_time >= hi - 10000 AND date_time < hi) SELECT * FROM w WHERE price = (SELECT max(price) FROM w)",
        "q7_all_windows": "SELECT * EXCLUDE (top) FROM (SELECT auction, bidder, price, extra, date_time, date_time - date_time % 10000 AS window_start, max(price) OVER (PARTITION BY date_time - date_time % 10000) AS top FROM bid) WHERE price = top",
        "q8": f"{_LATE}SELECT p.id, name, p.date_time - p.date_time % 10000 AS starttime FROM p8 p JOIN a8 a ON a.seller = p.id, {_HI.format(lag=10000, step=10000, of='a8')} WHERE p.date_time >= hi - 10000 AND p.date_time < hi AND a.date_time >= hi - 10000 AND a.date_time < hi",
        "q8_all_windows": f"{_LATE}SELECT DISTINCT p.id, name, p.date_time - p.date_time % 10000 AS starttime FROM p8 p JOIN a8 a ON a.seller = p.id AND p.date_time - p.date_time % 10000 = a.date_time - a.date_time % 10000",
        "q9": f", {_VALID} SELECT auction AS id, item_name, description, initial_bid, reserve, seller, category, extra, opened AS date_time, expires, bidder, price, bid_time, bid_extra FROM (SELECT *, row_number() OVER (PARTITION BY auction ORDER BY price DESC, bidder DESC, bid_time DESC, bid_extra DESC) AS r FROM v) WHERE r = 1",
        "q12": "SELECT bidder, (date_time + 5) - (date_time + 5) % 10000 AS starttime, count(*) AS bid_count FROM bid GROUP BY 1, 2",
        "q13": "SELECT auction, bidder, price, date_time, p_name AS value FROM bid JOIN part ON auction % 10000 = p_partkey % 10000 WHERE date_time >= p_partkey % 1000 * 600000",
        "q14": "SELECT auction, bidder, CAST(price * 0.908 AS decimal(23,3)) AS price, CASE WHEN h BETWEEN 8 AND 18 THEN 'dayTime' WHEN h <= 6 OR h >= 20 THEN 'nightTime' ELSE 'otherTime' END AS bid_time_type, date_time, extra, CAST(length(extra) - length(replace(extra, 'c', '')) AS int) AS c_counts FROM (SELECT *, date_time % 86400000 // 3600000 AS h FROM bid) WHERE price * 0.908 > 1000000 AND price * 0.908 < 50000000",
        "q15": f"SELECT {_DAY}, {_COUNTS} FROM bid GROUP BY 1",
        "q16": f"SELECT channel, {_DAY}, max(strftime(epoch_ms(date_time), '%H:%M')) AS minute, {_COUNTS} FROM bid GROUP BY 1, 2",
        "q17": f"SELECT auction, {_DAY}, count(*) AS total_bids, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {r}_bids" for r, c in _RANK) + ", min(price) AS min_price, max(price) AS max_price, CAST(sum(price) AS bigint) AS sum_price, CAST(sum(price) // count(*) AS bigint) AS avg_price FROM bid GROUP BY 1, 2",
        "q18": "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY auction, bidder ORDER BY date_time DESC, price, channel, url, extra) AS r FROM bid) WHERE r = 1",
        "q19": "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY auction ORDER BY price DESC, bidder DESC, channel DESC, url DESC, date_time DESC, extra DESC) AS r FROM bid) WHERE r <= 10",
        "q20": "SELECT b.*, item_name, description, initial_bid, reserve, a.date_time AS auction_time, expires, seller, category, a.extra AS auction_extra FROM bid b JOIN auction a ON a.id = b.auction WHERE category = 10",
        "q21": _channel_id("channel"), "q21_url": _channel_id("url"), "q22": _dirs("channel"), "q22_url": _dirs("url"),
    }.items()
}
