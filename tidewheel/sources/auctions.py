"""A generated stream of auction events: people, auctions and bids.

Events are a pure function of their number: ``spark.range`` and hashes of the
number, so any slice can be made anywhere, in parallel, and again.  Of 50 events
one is a person, three are auctions and 46 are bids.  Times are milliseconds,
prices cents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The shape of the public auction benchmark.
PERSON, AUCTION, TOTAL = 1, 3, 50
FIRST_ID, FIRST_CATEGORY, CATEGORIES = 1000, 10, 5
STATES = ["AZ", "CA", "ID", "OR", "WA", "WY"]
CITIES = ["Phoenix", "Los Angeles", "San Francisco", "Boise", "Portland", "Bend", "Redmond", "Seattle", "Kent", "Cheyenne"]
CHANNELS = ["Google", "Facebook", "Baidu", "Apple"]


@dataclass(frozen=True)
class AuctionConfig:
    """Size, speed and skew of the stream."""

    events: int = 100_000
    events_per_second: int = 10_000
    base_time: int = 1_700_000_000_000
    hot: int = 100  # one id in so many is hot
    hot_share: float = 0.9  # of bids and sellers
    in_flight: int = 100  # auctions open at a time
    channels: int = 10_000
    out_of_order: int = 1  # events per group that arrive shuffled
    seed: int = 0


def _u(salt: int, cfg: AuctionConfig) -> Column:
    """A uniform number in [0, 1) of (event, salt)."""
    return F.pmod(F.xxhash64(F.col("n"), F.lit(salt), F.lit(cfg.seed)), F.lit(2**40)) / F.lit(float(2**40))


def _price(salt: int, cfg: AuctionConfig) -> Column:
    return F.ceil(F.pow(F.lit(10.0), _u(salt, cfg) * 6) * 100).cast("bigint")


def _pick(words: list[str], salt: int, cfg: AuctionConfig) -> Column:
    return F.element_at(F.lit(words), F.floor(_u(salt, cfg) * len(words)).cast("int") + 1)


def events(spark: SparkSession, cfg: AuctionConfig = AuctionConfig(), partitions: int | None = None) -> DataFrame:
    """All events: ``kind`` and the columns of the three kinds, null where they don't apply."""
    n0 = spark.range(0, cfg.events, 1, partitions) if partitions else spark.range(cfg.events)
    g = cfg.out_of_order
    number = F.col("id") if g <= 1 else F.floor(F.col("id") / g) * g + F.pmod(F.col("id") * 953, F.lit(g))
    n = n0.select(number.cast("bigint").alias("n"))
    epoch, rest = F.floor(F.col("n") / TOTAL), F.pmod(F.col("n"), F.lit(TOTAL))
    n = n.withColumns(
        {
            "kind": F.when(rest < PERSON, "person").when(rest < PERSON + AUCTION, "auction").otherwise("bid"),
            "date_time": (F.lit(cfg.base_time) + F.floor(F.col("n") * (1000.0 / cfg.events_per_second))).cast("bigint"),
            "last_person": epoch.cast("bigint"),
            "last_auction": F.greatest(F.lit(0), F.when(rest < PERSON, epoch * AUCTION - 1).otherwise(epoch * AUCTION + F.least(rest - PERSON, F.lit(AUCTION - 1)))).cast("bigint"),
        }
    )
    person = F.when(F.col("kind") == "person", F.struct(
        (F.col("last_person") + FIRST_ID).alias("id"), F.concat(F.lit("Person "), F.col("last_person")).alias("name"), F.concat(F.lit("p"), F.col("last_person"), F.lit("@mail.example")).alias("email_address"),
        F.lpad(F.abs(F.xxhash64("n")).cast("string"), 16, "0").substr(1, 16).alias("credit_card"), _pick(CITIES, 1, cfg).alias("city"), _pick(STATES, 2, cfg).alias("state"), F.col("date_time"), F.lit("").alias("extra"),
    ))
    hot = lambda last, salt, shift: F.when(_u(salt, cfg) < cfg.hot_share, F.floor(last / cfg.hot) * cfg.hot + shift).otherwise(F.greatest(F.lit(0), last - F.floor(_u(salt + 1, cfg) * cfg.in_flight)))
    first = _price(5, cfg)
    auction = F.when(F.col("kind") == "auction", F.struct(
        (F.col("last_auction") + FIRST_ID).alias("id"), F.concat(F.lit("item "), F.col("last_auction")).alias("item_name"), F.concat(F.lit("description "), F.hex(F.xxhash64("n"))).alias("description"),
        first.alias("initial_bid"), (first + _price(6, cfg)).alias("reserve"), F.col("date_time"), (F.col("date_time") + 1 + F.floor(_u(7, cfg) * 20_000)).cast("bigint").alias("expires"),
        (hot(F.col("last_person"), 8, 0) + FIRST_ID).cast("bigint").alias("seller"), (F.lit(FIRST_CATEGORY) + F.floor(_u(10, cfg) * CATEGORIES)).cast("bigint").alias("category"), F.lit("").alias("extra"),
    ))
    number_of = F.floor(_u(11, cfg) * cfg.channels).cast("bigint")
    rare = _u(12, cfg) < 1.0 / cfg.hot
    channel = F.when(rare, F.concat(F.lit("channel-"), number_of)).otherwise(_pick(CHANNELS, 13, cfg))
    path = F.concat(F.lit("https://auctions.example/"), F.lower(F.substring(F.hex(F.xxhash64("n", F.lit(14))), 1, 5)), F.lit("/item.htm?query=1"))
    url = F.when(rare & (_u(15, cfg) < 0.9), F.concat(path, F.lit("&channel_id="), number_of)).otherwise(path)
    bid = F.when(F.col("kind") == "bid", F.struct(
        (hot(F.col("last_auction"), 16, 0) + FIRST_ID).cast("bigint").alias("auction"), (hot(F.col("last_person"), 18, 1) + FIRST_ID).cast("bigint").alias("bidder"), _price(20, cfg).alias("price"),
        channel.alias("channel"), url.alias("url"), F.col("date_time"), F.lower(F.hex(F.xxhash64("n", F.lit(21)))).alias("extra"),
    ))
    return n.select("n", "kind", "date_time", person.alias("person"), auction.alias("auction"), bid.alias("bid"))


def tables(df: DataFrame) -> dict[str, DataFrame]:
    """person, auction and bid as tables of their own."""
    return {k: df.where(F.col("kind") == k).select(f"{k}.*") for k in ("person", "auction", "bid")}
