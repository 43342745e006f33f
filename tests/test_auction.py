"""Auction queries on small hand-written cases, and the generator's shape."""

from pyspark.sql import functions as F

from tidewheel.plans import auction
from tidewheel.sources.auctions import AuctionConfig, events, tables

A = "id bigint, item_name string, description string, initial_bid bigint, reserve bigint, date_time bigint, expires bigint, seller bigint, category bigint, extra string"
B = "auction bigint, bidder bigint, price bigint, channel string, url string, date_time bigint, extra string"
P = "id bigint, name string, city string, state string, date_time bigint"


def market(spark, bids=(), auctions=(), people=()):
    bid = [(a, b, p, c, u, t, e) for a, b, p, c, u, t, e in bids]
    auc = [(i, "item", "d", 1, 2, t, x, s, cat, "") for i, t, x, s, cat in auctions]
    return {"bid": spark.createDataFrame(bid, B), "auction": spark.createDataFrame(auc, A), "person": spark.createDataFrame(list(people), P)}


def bid(a, p, t, bidder=1, channel="Apple", url="https://x/y", extra="e"):
    return (a, bidder, p, channel, url, t, extra)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_per_record_queries(spark):
    t = market(spark, [bid(1, 100, 5), bid(123, 7, 6), bid(246, 9, 7)])
    assert [r[2] for r in got(auction.q1(t))] == [89, 6, 8]
    assert got(auction.q2(t)) == [(123, 7), (246, 9)]
    assert len(got(auction.q0(t))) == 3


def test_valid_bids_and_averages(spark):
    t = market(spark, [bid(1, 10, 50), bid(1, 99, 500), bid(1, 20, 99), bid(2, 31, 60), bid(3, 7, 70)], [(1, 10, 100, 5, 1), (2, 10, 100, 5, 1), (3, 10, 100, 6, 2), (4, 10, 100, 6, 2)])
    assert got(auction.q4(t)) == [(1, 25), (2, 7)]
    assert got(auction.q6(t)) == [(5, 25), (6, 7)]
    many = market(spark, [bid(i, i, 50) for i in range(1, 13)], [(i, 10, 100, 5, 1) for i in range(1, 13)])
    assert got(auction.q6(many)) == [(5, sum(range(3, 13)) // 10)]


def test_winning_bid_ties(spark):
    t = market(spark, [bid(1, 10, 50, bidder=3), bid(1, 10, 60, bidder=2), bid(1, 10, 70, bidder=3)], [(1, 10, 100, 5, 1)])
    (row,) = auction.q9(t).collect()
    assert (row.bidder, row.price, row.bid_time) == (3, 10, 70)


def test_windows(spark):
    t = market(spark, [bid(1, 10, 2_000), bid(1, 50, 9_999), bid(2, 50, 12_000), bid(2, 70, 13_000), bid(3, 1, 27_000)])
    assert got(auction.q7(t)) == [(2, 1, 70, "e")]
    t = market(spark, auctions=[(1, 11_000, 1, 7, 1), (2, 31_000, 1, 9, 1)], people=[(7, "n", "c", "s", 12_000), (9, "m", "c", "s", 12_500)])
    assert got(auction.q8(t)) == [(7, "n", 10_000)]
    assert got(auction.q12(market(spark, [bid(1, 1, 5), bid(1, 1, 9_999), bid(1, 1, 10_000)]), F.col("date_time"))) == [(1, 0, 2), (1, 10_000, 1)]


def test_texts_and_ranks(spark):
    t = market(spark, [bid(1, 2_000_000, 8 * 3_600_000, channel="channel-9/a/b", url="https://x/d1/d2/d3?channel_id=77&z", extra="ccxc"), bid(1, 10, 1)])
    assert [(str(r.price), r.bid_time_type, r.c_counts) for r in auction.q14(t).collect()] == [("1816000.000", "dayTime", 3)]
    assert got(auction.q21(t)) == [(1, 1, 10, "Apple", "0")]
    assert (1, 1, 2_000_000, "channel-9/a/b", "77") in got(auction.q21(t, of="url"))
    assert {tuple(r)[4:] for r in auction.q22(t, of="url").collect()} == {("d1", "d2", "d3?channel_id=77&z"), ("y", "", "")}
    assert {(r.day, r.total_bids, r.rank1_bids, r.rank3_bids, r.total_bidders) for r in auction.q15(t).collect()} == {("1970-01-01", 2, 1, 1, 1)}
    assert {(r.min_price, r.max_price, r.avg_price) for r in auction.q17(t).collect()} == {(10, 2_000_000, 1_000_005)}


def test_latest_and_top(spark):
    t = market(spark, [bid(1, i, i) for i in range(15)] + [bid(2, 5, 1)])
    assert {(r.auction, r.price) for r in auction.q18(t).collect()} == {(1, 14), (2, 5)}
    assert sorted(r.price for r in auction.q19(t).where("auction = 1").collect()) == list(range(5, 15))
    side = spark.createDataFrame([(1, "v", 3), (2, "w", 0)], "key bigint, value string, p_time bigint")
    assert {(r.auction, r.price, r.value) for r in auction.q13(t, side).collect()} == {(1, i, "v") for i in range(3, 15)} | {(2, 5, "w")}


def test_generator(spark):
    cfg = AuctionConfig(events=5_000)
    e = events(spark, cfg)
    assert {r.kind: r["count"] for r in e.groupBy("kind").count().collect()} == {"person": 100, "auction": 300, "bid": 4600}
    t = tables(e)
    assert t["person"].agg(F.min("id"), F.max("id")).first()[:] == (1000, 1099)
    assert t["auction"].agg(F.count_distinct("id"), F.min("id"), F.max("id")).first()[:] == (300, 1000, 1299)
    assert t["bid"].join(t["auction"], F.col("auction") == F.col("id"), "left_anti").count() < 460
    assert e.exceptAll(events(spark, cfg, 3)).count() == 0
    assert auction.q3(t).count() > 0 and auction.q20(t).count() > 0
