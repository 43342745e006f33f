"""Feature queries over card transactions and taxi trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import scalar
from tidewheel.operators.timeseries import HOT_ROWS, rolling_features

DAY = 86_400
SECOND = 1_000_000


def transactions_with_demographics(transactions: DataFrame, demographics: DataFrame) -> DataFrame:
    """Inner join on the card number."""
    d = demographics.select("cc_num", "first", "city")
    return transactions.select("trans_num", "trans_date_trans_time", "cc_num").join(d, "cc_num")


def fraud_features(transactions: DataFrame, demographics: DataFrame, how: str = "left", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Spending averages of the week and month before, transactions of the day before, distance and demographics.

    ``how="inner"`` keeps only transactions of known cards.
    """
    keep = transactions.select("trans_num", "cc_num", "unix_time", "amt", "category", "merchant", "merch_lat", "merch_long", "is_fraud")
    d = demographics.select("cc_num", "state", "job", "city_pop", "lat", "long")
    spend = {f"avg_spend_{name}": (F.col("amt"), -days * DAY, -1) for name, days in (("pw", 7), ("pm", 30))}
    rolled = rolling_features(keep.join(d, "cc_num", how), ["cc_num"], "unix_time", "trans_num", spend, {"trans_freq_24": (-DAY, -1)}, hot_rows)
    return rolled.select(
        "trans_num", "cc_num", scalar.planar_distance(F.col("long"), F.col("lat"), F.col("merch_long"), F.col("merch_lat")).alias("distance"), "avg_spend_pw", "avg_spend_pm", "trans_freq_24", "category", "amt", "state", "job", "unix_time", "city_pop", "merchant", "is_fraud",
    )


def trip_features(trips: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Trips and fares of the hour before at the pickup place, trips of the half hour before at the dropoff place, weekend flag."""
    up, down = F.unix_micros(F.col("lpep_pickup_datetime").cast("timestamp")), F.unix_micros(F.col("lpep_dropoff_datetime").cast("timestamp"))
    t = trips.withColumns({"up_us": up, "down_us": down})
    hour, half = (-3600 * SECOND, -SECOND), (-1800 * SECOND, -SECOND)
    t = rolling_features(t, ["pickup_location_id"], "up_us", "trip_id", {"mean_fare_window_1h_pickup_zip": (F.col("fare_amount"), *hour)}, {"count_trips_window_1h_pickup_zip": hour}, hot_rows)
    t = rolling_features(t, ["dropoff_location_id"], "down_us", "trip_id", {}, {"count_trips_window_30m_dropoff_zip": half}, hot_rows)
    return t.select(
        "trip_id", "lpep_pickup_datetime", "lpep_dropoff_datetime", "pickup_location_id", "dropoff_location_id", "trip_distance", "fare_amount",
        "count_trips_window_1h_pickup_zip", "mean_fare_window_1h_pickup_zip", "count_trips_window_30m_dropoff_zip", F.when(scalar.iso_day_of_week(F.col("lpep_dropoff_datetime")) > 5, 1).otherwise(0).alias("dropoff_is_weekend"),
    )


def combine_messages(messages: DataFrame, records: DataFrame) -> DataFrame:
    """Texts of equal ids with a blank between them."""
    m, r = messages.select("id", F.col("message").alias("a")), records.select("id", F.col("message").alias("b"))
    return m.join(r, "id").select(F.concat("a", F.lit(" "), "b").alias("message"))


def personal_network(events: DataFrame, person: str, key: str = "id", people: str = "people") -> DataFrame:
    """Pairs of people named together with ``person``: (a, b, n), a before b."""
    with_person = events.where(F.array_contains(people, person)).select(F.array_sort(F.array_distinct(people)).alias("p"))
    pairs = F.flatten(F.transform("p", lambda a, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return with_person.select(F.explode(pairs).alias("x")).groupBy("x.a", "x.b").agg(F.count(F.lit(1)).alias("n"))


def org_chart(managers: DataFrame) -> DataFrame:
    """(manager, employee) to (grand-manager, manager, employee): a self-join."""
    up = managers.select(F.col("manager").alias("grand"), F.col("employee").alias("manager"))
    return managers.join(up, "manager").select("grand", "manager", "employee")


def degree_counts(edges: DataFrame) -> DataFrame:
    """How many vertices have which out-degree: a count of counts."""
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree")).groupBy("degree").agg(F.count(F.lit(1)).alias("vertices"))
