"""Queries of the general data problems (p1 to p5) over the project's tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators import bad_rows, control_charts, radius_join, references, rolling_totals
from tidewheel.session import table

LAST_DAY = date(2024, 6, 30)
RADIUS_KM = 2.0
MAX_MPH = 150.0


def _references(spark: SparkSession, d: str):
    child = references.References(table(spark, d, "transactions"), "trans_num", "cc_num", "trans_date_trans_time")
    log = references.ParentLog(table(spark, d, "demographics_log"), "cc_num", "changed_at", "seq", "weight")
    return {"transactions": child}, log


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphans(*_references(spark, d)).select(F.col("id").alias("trans_num"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(*_references(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    left = radius_join.Places(table(spark, d, "transactions"), "trans_num", "merch_lat", "merch_long")
    right = radius_join.Places(table(spark, d, "demographics").withColumn("cc_num", F.col("cc_num").cast("bigint")), "cc_num", "lat", "long")
    return radius_join.radius_join(left, right, RADIUS_KM).select(F.col("left_id").alias("trans_num"), F.col("right_id").alias("cc_num"))


def _readings(spark: SparkSession, d: str) -> control_charts.Readings:
    trips = table(spark, d, "green_tripdata")
    seconds = F.unix_micros(F.col("lpep_dropoff_datetime").cast("timestamp")) / 1e6 - F.unix_micros(F.col("lpep_pickup_datetime").cast("timestamp")) / 1e6
    miles = F.col("trip_distance")
    too_fast = (miles > 0) & ~F.isnan(miles) & (seconds >= 0) & (miles * 3600.0 > MAX_MPH * seconds)
    return control_charts.Readings(trips, "trip_id", "pickup_location_id", "lpep_pickup_datetime", ("trip_distance", "fare_amount"), (("trip_distance", too_fast),))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = control_charts.implausible(_readings(spark, d))
    return found.where("nan or ratio or stuck or limit").select(F.col("id").alias("trip_id"), "field")


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The same readings, counted per field and exact test that they fail."""
    found = control_charts.implausible(_readings(spark, d)).where("nan or ratio or stuck or limit")
    return found.groupBy("field").agg(*[F.sum(F.col(c).cast("bigint")).alias(c) for c in ("nan", "ratio", "stuck", "limit")])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return bad_rows.find_errors(table(spark, d, "raw_transactions")).select(F.col("row_id").alias("line_id"), "reason")


def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_transactions")
    return bad_rows.load_valid(raw, bad_rows.find_errors(raw)).withColumnRenamed("row_id", "line_id")


def _trailing(spark: SparkSession, d: str, of_demographics: bool) -> DataFrame:
    daily = rolling_totals.daily_totals(table(spark, d, "transactions"), "cc_num", "unix_time", "amt", "trans_num")
    only = table(spark, d, "demographics").select(F.col("cc_num").alias("entity")).where("entity is not null") if of_demographics else None
    return rolling_totals.trailing_totals(daily, LAST_DAY, (7, 30), only)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    t = _trailing(spark, d, True)
    total = lambda p: F.col(f"units_{p}") / 100 + F.col(f"beyond_{p}")
    exact = (F.col("units_7") >= 100_000) & (F.col("units_7") * 4 > F.col("units_30") * 3)
    vast = (total(7) >= 1000.0) & (total(7) * 4 > total(30) * 3)
    hit = (F.col("age") >= 30) & F.when((F.col("beyond_7") == 0) & (F.col("beyond_30") == 0), exact).otherwise(vast)
    return t.where(hit).select(F.col("entity").cast("bigint").alias("cc_num"), F.date_from_unix_date("day").cast("string").alias("spend_day"))


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    t = rolling_totals.with_amounts(_trailing(spark, d, False))
    avg = [F.round(f"avg_{p}", 6).alias(f"avg_{p}") for p in (7, 30)]
    return t.select(F.col("entity").cast("bigint").alias("cc_num"), F.date_from_unix_date("day").cast("string").alias("spend_day"), "total_7", "total_30", *avg)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_report, p2_found, p3_found, p3_reasons, p4_found, p4_loaded, p5_found, p5_totals)
}

_ORPHANS = """
    SELECT DISTINCT t.trans_num, t.cc_num, t.trans_date_trans_time AS moment,
      CASE WHEN f.first_at IS NULL THEN 'missing' WHEN t.trans_date_trans_time < f.first_at THEN 'late' ELSE 'deleted' END AS reason
    FROM transactions t
    LEFT JOIN (SELECT cc_num, min(changed_at) FILTER (WHERE weight > 0) AS first_at FROM demographics_log GROUP BY 1) f USING (cc_num)
    ASOF LEFT JOIN (SELECT DISTINCT cc_num, changed_at, last_value(weight) OVER (PARTITION BY cc_num, changed_at ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS weight FROM demographics_log) l
      ON t.cc_num = l.cc_num AND t.trans_date_trans_time >= l.changed_at
    WHERE l.weight IS NULL OR l.weight <= 0"""

_PLACE = "{lat} BETWEEN -90 AND 90 AND {lon} BETWEEN -180 AND 180 AND NOT ({lat} = 0 AND {lon} = 0)"

_TRIPS = """
    trips AS (SELECT DISTINCT trip_id, pickup_location_id AS loc, lpep_pickup_datetime AS moment,
      epoch_us(lpep_dropoff_datetime) / 1e6 - epoch_us(lpep_pickup_datetime) / 1e6 AS secs, trip_distance, fare_amount FROM green_tripdata),
    readings AS (
      SELECT trip_id, loc, moment, 'trip_distance' AS field, trip_distance AS v, trip_distance > 0 AND NOT isnan(trip_distance) AND secs >= 0 AND trip_distance * 3600.0 > 150.0 * secs AS fast FROM trips
      UNION ALL SELECT trip_id, loc, moment, 'fare_amount', fare_amount, false FROM trips),
    med AS (SELECT loc, field, median(v) AS m FROM readings WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY 1, 2),
    marked AS (SELECT *, CASE WHEN v IS NOT NULL AND v IS NOT DISTINCT FROM lag(v) OVER w THEN 0 ELSE 1 END AS fresh FROM readings WINDOW w AS (PARTITION BY loc, field ORDER BY moment NULLS FIRST, trip_id)),
    runs AS (SELECT *, sum(fresh) OVER (PARTITION BY loc, field ORDER BY moment NULLS FIRST, trip_id) AS run FROM marked),
    flags AS (SELECT r.trip_id, r.field, isnan(v) AS nan, NOT isnan(v) AND (v > 6 * m OR v < m / 6) AS ratio,
      count(*) OVER (PARTITION BY r.loc, r.field, run) >= 8 AS stuck, coalesce(fast, false) AS lim
      FROM runs r LEFT JOIN med ON med.loc IS NOT DISTINCT FROM r.loc AND med.field = r.field WHERE v IS NOT NULL)"""

# Records with sound quoting, cut into fields by one regular expression.
_RAW = r"""
    raw AS (SELECT DISTINCT line_id, CASE WHEN right(line, 1) = chr(13) THEN left(line, length(line) - 1) ELSE line END AS body FROM raw_transactions),
    laid AS (SELECT line_id, body, regexp_full_match(body, '([^",]*|"([^"]|"")*")(,([^",]*|"([^"]|"")*"))*', 's') AS sound,
      regexp_extract_all(',' || body, ',("(?:[^"]|"")*"|[^",]*)', 1, 's') AS quoted FROM raw),
    cut AS (SELECT line_id, sound, list_transform(quoted, lambda f: CASE WHEN f LIKE '"%' THEN replace(f[2:-2], '""', '"') ELSE f END) AS f FROM laid),
    ok AS (SELECT line_id, f, trim(f[5], chr(32) || chr(9) || chr(10) || chr(13) || chr(160) || chr(8199) || chr(8239) || chr(12288)) AS a, f[1] AS t FROM cut WHERE sound AND len(f) = 10),
    checked AS (SELECT line_id, f, a, t,
      regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2} ([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]') AND t NOT LIKE '0000%' AND try_cast(t[1:10] AS date) IS NOT NULL AS good_t,
      a = '' OR lower(a) = 'null' OR (regexp_full_match(a, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') AND coalesce(isfinite(try_cast(a AS double)), false)) AS good_a FROM ok)"""

_DAILY = """
    daily AS (SELECT cc_num, CAST(floor(unix_time / 86400) AS int) AS day, sum(coalesce(CAST(round(amt * 100) AS bigint), 0)) AS units
      FROM (SELECT DISTINCT trans_num, cc_num, unix_time, amt FROM transactions) GROUP BY 1, 2),
    cards AS (SELECT cc_num, min(day) AS first FROM daily GROUP BY 1),
    days AS (SELECT cc_num, first, unnest(range(first, 19905)) AS day FROM cards),
    dense AS (SELECT d.cc_num, d.first, d.day, coalesce(units, 0) AS units FROM days d LEFT JOIN daily USING (cc_num, day)),
    rolled AS (SELECT cc_num, day, day - first + 1 AS age,
      CAST(sum(units) OVER (PARTITION BY cc_num ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS bigint) AS u7,
      CAST(sum(units) OVER (PARTITION BY cc_num ORDER BY day RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) AS bigint) AS u30 FROM dense)"""

_DAY = "strftime(DATE '1970-01-01' + CAST(day AS int), '%Y-%m-%d') AS spend_day"

SQL: dict[str, str] = {
    "p1_found": f"SELECT DISTINCT trans_num FROM ({_ORPHANS})",
    "p1_report": f"SELECT 'transactions' AS table_name, strftime(moment, '%Y-%m') AS period, reason, count(DISTINCT trans_num) AS n FROM ({_ORPHANS}) GROUP BY 2, 3",
    "p2_found": f"""
      WITH t AS (SELECT DISTINCT trans_num, radians(merch_lat) AS y, radians(merch_long) AS x FROM transactions WHERE {_PLACE.format(lat="merch_lat", lon="merch_long")}),
      c AS (SELECT DISTINCT CAST(cc_num AS bigint) AS cc_num, radians(lat) AS y, radians(long) AS x FROM demographics WHERE {_PLACE.format(lat="lat", lon="long")})
      SELECT DISTINCT trans_num, cc_num FROM t JOIN c ON abs(t.y - c.y) <= 0.0004
      WHERE 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((c.y - t.y) / 2), 2) + cos(t.y) * cos(c.y) * pow(sin((c.x - t.x) / 2), 2)))) <= 2.0""",
    "p3_found": f"WITH {_TRIPS} SELECT DISTINCT trip_id, field FROM flags WHERE nan OR ratio OR stuck OR lim",
    "p3_reasons": f"WITH {_TRIPS} SELECT field, " + ", ".join(f"CAST(sum(CAST({a} AS int)) AS bigint) AS \"{b}\"" for a, b in (("nan", "nan"), ("ratio", "ratio"), ("stuck", "stuck"), ("lim", "limit"))) + " FROM flags WHERE nan OR ratio OR stuck OR lim GROUP BY field",
    "p4_found": f"""WITH {_RAW}
      SELECT line_id, 'quoting' AS reason FROM cut WHERE NOT sound
      UNION ALL SELECT line_id, 'columns' FROM cut WHERE sound AND len(f) <> 10
      UNION ALL SELECT line_id, 'timestamp' FROM checked WHERE NOT good_t
      UNION ALL SELECT line_id, 'amount' FROM checked WHERE NOT good_a""",
    "p4_loaded": f"""WITH {_RAW}, v AS (SELECT line_id, list_transform(f, lambda x: CASE WHEN lower(trim(x)) IN ('', 'null') THEN NULL ELSE trim(x) END) AS n, f, a FROM checked WHERE good_t AND good_a)
      SELECT line_id, CAST(f[1] AS timestamp) AS trans_date_trans_time, try_cast(n[2] AS double) AS cc_num, f[3] AS merchant, f[4] AS category,
        CASE WHEN lower(a) IN ('', 'null') THEN NULL ELSE try_cast(a AS double) END AS amt, f[6] AS trans_num, try_cast(n[7] AS int) AS unix_time, try_cast(n[8] AS double) AS merch_lat,
        try_cast(n[9] AS double) AS merch_long, try_cast(n[10] AS int) AS is_fraud FROM v""",
    "p5_found": f"WITH {_DAILY} SELECT CAST(cc_num AS bigint) AS cc_num, {_DAY} FROM rolled WHERE age >= 30 AND u7 >= 100000 AND u7 * 4 > u30 * 3 AND cc_num IN (SELECT cc_num FROM demographics)",
    "p5_totals": f"WITH {_DAILY} SELECT CAST(cc_num AS bigint) AS cc_num, {_DAY}, u7 / 100.0 AS total_7, u30 / 100.0 AS total_30, round(u7 / 700.0, 6) AS avg_7, round(u30 / 3000.0, 6) AS avg_30 FROM rolled",
}
