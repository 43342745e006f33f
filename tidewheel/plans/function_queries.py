"""Queries that show every scalar function and the surfaces for functions of one's own, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions import scalar
from tidewheel.operators import aggregates, linear
from tidewheel.plans import sql_script
from tidewheel.session import table
from tidewheel.zset import W, consolidate, weighted

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _long(c):
    return c.cast("bigint")


_MATH = {
    "cos_x": ("cos(x)", lambda x: F.cos(x)), "cosh_x": ("cosh(x / 10)", lambda x: F.cosh(x / 10)), "acos_x": ("acos(u)", lambda x: F.acos((x - 25) / 30)), "acosh_x": ("acosh(x + 1)", lambda x: F.acosh(x + 1)),
    "sin_x": ("sin(x)", lambda x: F.sin(x)), "sinh_x": ("sinh(x / 10)", lambda x: F.sinh(x / 10)), "asin_x": ("asin(u)", lambda x: F.asin((x - 25) / 30)), "asinh_x": ("asinh(x)", lambda x: F.asinh(x)),
    "tan_x": ("tan(u)", lambda x: F.tan((x - 25) / 30)), "tanh_x": ("tanh(u)", lambda x: F.tanh((x - 25) / 30)), "atan_x": ("atan(x)", lambda x: F.atan(x)), "atanh_x": ("atanh(u)", lambda x: F.atanh((x - 25) / 30)),
    "ln_x": ("ln(x)", lambda x: scalar.ln(x)), "log2_x": ("log2(x)", lambda x: F.log2(x)), "log10_x": ("log10(x)", lambda x: F.log10(x)), "log1p_x": ("ln(1 + x)", lambda x: F.log1p(x)),
    "sqrt_x": ("sqrt(x)", lambda x: F.sqrt(x)), "cbrt_x": ("cbrt(x)", lambda x: F.cbrt(x)), "tgamma_x": ("gamma(x / 8 + 1)", lambda x: scalar.tgamma(x / 8 + 1)), "lgamma_x": ("lgamma(x)", lambda x: scalar.lgamma(x)),
    "exp_x": ("exp(u)", lambda x: F.exp((x - 25) / 30)), "exp2_x": ("pow(2.0, u)", lambda x: scalar.exp2((x - 25) / 30)), "exp10_x": ("pow(10.0, u)", lambda x: scalar.exp10((x - 25) / 30)), "expm1_x": ("exp(u) - 1", lambda x: F.expm1((x - 25) / 30)),
    "cot_x": ("cot(x)", lambda x: F.cot(x)), "fdim_x": ("greatest(x - 25, 0.0)", lambda x: scalar.fdim(x, F.lit(25.0))), "degrees_x": ("degrees(x)", lambda x: F.degrees(x)), "radians_x": ("radians(x)", lambda x: F.radians(x)),
}


@query("SELECT p_partkey, " + ", ".join(f"round(CAST({s} AS double), 6) AS {n}" for n, (s, _) in _MATH.items()) + " FROM (SELECT p_partkey, CAST(p_size AS double) AS x, (CAST(p_size AS double) - 25) / 30 AS u FROM part)")
def math_all_fns(spark, d):
    x = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", *[F.round(f(x), 6).alias(n) for n, (_, f) in _MATH.items()])


@query("""SELECT k, a, CAST(64 - length(ltrim(b, '1')) AS bigint) AS leading_ones, CAST(64 - length(ltrim(b, '0')) AS bigint) AS leading_zeroes, CAST(64 - length(rtrim(b, '1')) AS bigint) AS trailing_ones, CAST(64 - length(rtrim(b, '0')) AS bigint) AS trailing_zeroes,
  CAST(bit_count(a) AS bigint) AS ones, CAST(64 - bit_count(a) AS bigint) AS zeroes, CAST(CAST(reverse(b) AS bit) AS bigint) AS reversed,
  CAST(CAST(b[57:64] || b[49:56] || b[41:48] || b[33:40] || b[25:32] || b[17:24] || b[9:16] || b[1:8] AS bit) AS bigint) AS bytes_reversed, a > 0 AND bit_count(a) = 1 AS pow2
  FROM (SELECT *, CAST(CAST(a AS bit) AS varchar) AS b FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN -o_orderkey ELSE o_orderkey * 123456789 END AS a FROM orders))""")
def bit_all_fns(spark, d):
    k, a = F.col("o_orderkey"), F.col("a")
    rows = table(spark, d, "orders").select(k.alias("k"), F.when(k % 3 == 0, -k).otherwise(k * 123456789).alias("a"))
    return rows.select(
        "k", "a", _long(scalar.leading_ones(a)).alias("leading_ones"), _long(scalar.leading_zeroes(a)).alias("leading_zeroes"), _long(scalar.trailing_ones(a)).alias("trailing_ones"), _long(scalar.trailing_zeroes(a)).alias("trailing_zeroes"),
        _long(scalar.count_ones(a)).alias("ones"), _long(scalar.count_zeroes(a)).alias("zeroes"), scalar.bit_reverse(a).alias("reversed"), scalar.byte_reverse(a).alias("bytes_reversed"), scalar.is_power_of_two(a).alias("pow2"),
    )


@query("""SELECT o_orderkey, a < b AS lt, a <= b AS le, a > b AS gt, a >= b AS ge, a = b AS eq, a <> b AS ne, CAST('nan' AS double) > a AS nan_is_largest, a > 0 AND b > 0 AS both, a > 0 OR b > 0 AS either, (a > 0) <> (b > 0) AS one_of,
  i & 12 AS bit_and, i | 12 AS bit_or, xor(i, 12) AS bit_xor, least(a, b) AS least, greatest(a, b) AS greatest, abs(a) AS abs_a, -a AS neg_a, NOT a > 0 AS not_pos, CAST(ceil(a) AS bigint) AS ceil_a, CAST(floor(a) AS bigint) AS floor_a,
  trunc(a) AS trunc_a, round(sqrt(abs(a)), 9) AS sqrt_a, signbit(a * 0.0) AS zero_negative, NOT signbit(a) AS positive, a + b AS plus, a - b AS minus, i * 3 AS times, round(a / 7.0, 9) AS over, i % 7 AS rest
  FROM (SELECT o_orderkey, o_totalprice - 100000 AS a, CAST(o_custkey % 1000 AS double) AS b, o_orderkey - 50 AS i FROM orders)""")
def operator_fns(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") - 100000).alias("a"), (F.col("o_custkey") % 1000).cast("double").alias("b"), (F.col("o_orderkey") - 50).alias("i"))
    a, b, i = F.col("a"), F.col("b"), F.col("i")
    return o.select(
        "o_orderkey", (a < b).alias("lt"), (a <= b).alias("le"), (a > b).alias("gt"), (a >= b).alias("ge"), (a == b).alias("eq"), (a != b).alias("ne"), (F.lit(float("nan")) > a).alias("nan_is_largest"),
        ((a > 0) & (b > 0)).alias("both"), ((a > 0) | (b > 0)).alias("either"), scalar.xor(a > 0, b > 0).alias("one_of"), i.bitwiseAND(F.lit(12)).alias("bit_and"), i.bitwiseOR(F.lit(12)).alias("bit_or"), i.bitwiseXOR(F.lit(12)).alias("bit_xor"),
        F.least(a, b).alias("least"), F.greatest(a, b).alias("greatest"), F.abs(a).alias("abs_a"), (-a).alias("neg_a"), (~(a > 0)).alias("not_pos"), F.ceil(a).alias("ceil_a"), F.floor(a).alias("floor_a"), scalar.trunc(a).alias("trunc_a"),
        F.round(F.sqrt(F.abs(a)), 9).alias("sqrt_a"), scalar.is_sign_negative(a * 0.0).alias("zero_negative"), scalar.is_sign_positive(a).alias("positive"), (a + b).alias("plus"), (a - b).alias("minus"), (i * 3).alias("times"), F.round(a / 7.0, 9).alias("over"), (i % 7).alias("rest"),
    )


@query("""SELECT o_orderkey, CAST(o_orderkey AS int) AS to_int, CAST(o_custkey % 100 AS smallint) AS to_small, CAST(o_orderkey AS double) AS to_double, CAST(CAST(o_totalprice AS float) AS double) AS through_float, CAST(trunc(o_totalprice) AS bigint) AS cut,
  CAST(o_orderstatus = 'F' AS int) AS from_bool, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS date)) AS int) AS days, DATE '1970-01-01' + CAST(o_custkey AS int) AS from_days, epoch_ms(o_orderdate) AS millis, CAST(make_timestamp(o_orderkey * 1000) AS timestamp) AS from_millis FROM orders""")
def cast_fns(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    cast = scalar.cast_checked
    return o.select(
        "o_orderkey", cast(k, "bigint", "int").alias("to_int"), cast(F.col("o_custkey") % 100, "bigint", "smallint").alias("to_small"), cast(k, "bigint", "double").alias("to_double"), cast(cast(F.col("o_totalprice"), "double", "float"), "float", "double").alias("through_float"),
        cast(F.col("o_totalprice"), "double", "bigint").alias("cut"), cast(F.col("o_orderstatus") == "F", "boolean", "int").alias("from_bool"), cast(F.to_date("o_orderdate"), "date", "int").alias("days"), cast(F.col("o_custkey").cast("int"), "int", "date").alias("from_days"),
        cast(F.col("o_orderdate").cast("timestamp"), "timestamp", "bigint").alias("millis"), cast(k, "bigint", "timestamp").cast("timestamp_ntz").alias("from_millis"),
    )


@query("""SELECT doc_id, strlen(title) AS bytes, length(title) AS chars, 8 * strlen(title) AS bits, title || '/' || source || '/' || lang AS joined, '' AS cleared, strlen(title) = length(title) AS ascii, nfc_normalize(title) = title AS nfc,
  regexp_full_match(lower(lang), '\\p{Ll}*') AS low, regexp_full_match(upper(lang), '\\p{Lu}*') AS up, regexp_full_match(title, '\\p{Ll}*') AS title_low FROM documents""")
def text_all_fns(spark, d):
    t = F.col("title")
    return table(spark, d, "documents").select(
        "doc_id", _long(scalar.byte_length(t)).alias("bytes"), _long(scalar.char_length(t)).alias("chars"), _long(F.bit_length(t)).alias("bits"), scalar.concat(t, F.lit("/"), F.col("source"), F.lit("/"), F.col("lang")).alias("joined"), scalar.clear(t).alias("cleared"),
        scalar.is_ascii(t).alias("ascii"), scalar.is_nfc(t).alias("nfc"), scalar.is_lowercase(F.lower("lang")).alias("low"), scalar.is_uppercase(F.upper("lang")).alias("up"), scalar.is_lowercase(t).alias("title_low"),
    )


@query(None)
def normal_forms(spark, d):
    """Whole texts by the normal forms they are in (no SQL: three of the forms are unknown to it)."""
    t = F.col("text")
    forms = table(spark, d, "documents").select(scalar.is_nfc(t).alias("nfc"), scalar.is_nfd(t).alias("nfd"), scalar.is_nfkc(t).alias("nfkc"), scalar.is_nfkd(t).alias("nfkd"))
    return forms.groupBy("nfc", "nfd", "nfkc", "nfkd").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, millisecond(ts) AS ms, microsecond(ts) AS us, CAST(floor(epoch(ts)) AS bigint) AS ep, CAST(ts AS date) AS day,
  CAST(CAST(ts AS date) AS timestamp) AS midnight, CAST(epoch(CAST(ts AS date)) AS bigint) AS day_epoch, 0 AS day_hour, 0 AS day_minute, 0 AS day_second, 0 AS day_ms, 0 AS day_us FROM (SELECT event_id, date_trunc('milliseconds', ts) AS ts FROM events)""")
def time_fns(spark, d):
    t = F.date_trunc("millisecond", F.col("ts").cast("timestamp"))
    day = scalar.to_date(t)
    zero = scalar.date_clock_part(day)
    return table(spark, d, "events").select(
        "event_id", _long(F.hour(t)).alias("h"), _long(F.minute(t)).alias("mi"), _long(F.second(t)).alias("s"), scalar.millisecond(t).alias("ms"), scalar.microsecond(t).alias("us"), scalar.epoch(t).alias("ep"), day.alias("day"),
        day.cast("timestamp_ntz").alias("midnight"), scalar.date_epoch(day).alias("day_epoch"), *[zero.alias(n) for n in ("day_hour", "day_minute", "day_second", "day_ms", "day_us")],
    )


@query("""SELECT o_orderkey, year(x) AS y, month(x) AS m, day(x) AS dd, quarter(x) AS q, year(x) // 10 AS decade, (year(x) + 99) // 100 AS century, (year(x) + 999) // 1000 AS millennium, isoyear(x) AS iso_year, week(x) AS w,
  dayofweek(x) + 1 AS dow, isodow(x) AS isodow, dayofyear(x) AS doy FROM (SELECT o_orderkey, CAST(o_orderdate AS date) AS x FROM orders)""")
def date_part_fns(spark, d):
    x = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", _long(F.year(x)).alias("y"), _long(F.month(x)).alias("m"), _long(F.day(x)).alias("dd"), _long(F.quarter(x)).alias("q"), _long(scalar.decade(x)).alias("decade"), _long(scalar.century(x)).alias("century"), _long(scalar.millennium(x)).alias("millennium"),
        _long(scalar.iso_year(x)).alias("iso_year"), _long(F.weekofyear(x)).alias("w"), _long(F.dayofweek(x)).alias("dow"), _long(scalar.iso_day_of_week(x)).alias("isodow"), _long(F.dayofyear(x)).alias("doy"),
    )


@query("SELECT event_id, value FROM events")
def abort_guard(spark, d):
    """Fails where a value is negative; none is."""
    return table(spark, d, "events").select("event_id", F.when(F.col("value") < 0, scalar.abort("negative value").cast("double")).otherwise(F.col("value")).alias("value"))


# functions of one's own


@query("SELECT event_id, round(value * 1.07 + length(event_type), 6) AS adjusted FROM events")
def udf_map(spark, d):
    """A Python function of whole Arrow batches inside a map."""

    @F.pandas_udf("double")
    def adjusted(value: pd.Series, kind: pd.Series) -> pd.Series:
        return value * 1.07 + kind.str.len()

    e = weighted(table(spark, d, "events").select("event_id", "value", "event_type"))
    return linear.map_rows(e, "event_id", F.round(adjusted("value", "event_type"), 6).alias("adjusted")).drop(W)


@query("SELECT o_custkey AS k, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS spread FROM orders GROUP BY 1")
def udaf_contract(spark, d):
    """An aggregator by its contract: partial sums that add up, and a finish."""
    v = F.col("o_totalprice")
    mean = F.col("s") / F.col("n")
    spread = aggregates.Aggregator({"n": F.lit(1), "s": v, "q": v * v}, {"mean": F.round(mean, 4), "spread": F.round(F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))), 4)})
    return aggregates.by(weighted(table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_totalprice")), ["k"], spread).drop(W)


@query("SELECT p_partkey, i AS position, word FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word, generate_subscripts(string_split(p_type, ' '), 1) AS i FROM part)")
def udtf_words(spark, d):
    """A table function of one's own: a row per word with its position."""

    @F.udtf(returnType="position bigint, word string")
    class Words:
        def eval(self, text: str):
            yield from ((i + 1, w) for i, w in enumerate(text.split(" ")))

    spark.udtf.register("words_of", Words)
    table(spark, d, "part").select("p_partkey", "p_type").createOrReplaceTempView("udtf_part")
    return spark.sql("SELECT p_partkey, w.position, w.word FROM udtf_part, LATERAL words_of(p_type) AS w")


@query("SELECT p_partkey, p_size * 2 + 1 AS odd, round(sqrt(pow(p_size - 3, 2) + pow(p_retailprice - 4, 2)), 6) AS far FROM part")
def sql_udfs(spark, d):
    """Functions written in SQL, and the planar points that scripts use."""
    sql_script.register_functions(spark, {"odd_of": ("x BIGINT", "BIGINT", "x * 2 + 1")})
    table(spark, d, "part").createOrReplaceTempView("sql_udfs_part")
    return spark.sql("SELECT p_partkey, odd_of(CAST(p_size AS BIGINT)) AS odd, round(ST_DISTANCE(ST_POINT(p_size, p_retailprice), ST_POINT(3, 4)), 6) AS far FROM sql_udfs_part")


@query("SELECT s_nationkey AS k, s_suppkey AS supplier, word FROM (SELECT s_nationkey, s_suppkey, unnest([s_name, CAST(s_suppkey % 3 AS varchar)]) AS word FROM supplier)")
def flat_map_index(spark, d):
    s = weighted(table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_name"))
    return linear.flat_map_index(s, F.array("s_name", (F.col("s_suppkey") % 3).cast("string")), "word", [F.col("s_nationkey").alias("k")], F.col("s_suppkey").alias("supplier")).drop(W)


@query("SELECT o_custkey AS k, count(*) AS n, 1 AS places FROM orders GROUP BY 1")
def exchange_by_key(spark, d):
    """After an exchange by key every key is in one place."""
    moved = linear.exchange(weighted(table(spark, d, "orders").select(F.col("o_custkey").alias("k"))), F.col("k"), 6)
    return moved.withColumn("p", F.spark_partition_id()).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p").cast("int").alias("places"))


# SQL scripts


@query("SELECT s_nationkey, count(*) AS suppliers, round(avg(s_acctbal), 4) AS mean FROM supplier WHERE s_acctbal > 0 GROUP BY 1 HAVING count(*) > 1")
def sql_select(spark, d):
    script = """CREATE TABLE supplier (s_suppkey BIGINT, s_nationkey INTEGER, s_acctbal DOUBLE PRECISION);
      /* two views, the second on the first */
      CREATE VIEW in_credit AS SELECT s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 0;
      CREATE VIEW of_nation AS SELECT s_nationkey, count(*) AS suppliers, round(avg(s_acctbal), 4) AS mean FROM in_credit GROUP BY s_nationkey HAVING count(*) > 1;"""
    return sql_script.run_script(spark, script, {"supplier": table(spark, d, "supplier")})["of_nation"]


_TX, _DEMO = "(SELECT DISTINCT * FROM transactions)", "(SELECT DISTINCT * FROM demographics)"
_CENTS = "CAST(sum(CAST(amt AS decimal(18,2))) OVER ({w}) AS double) / count(amt) OVER ({w})"


def _card_window(days: int) -> str:
    return f"PARTITION BY t.cc_num ORDER BY t.unix_time RANGE BETWEEN {days * 86400} PRECEDING AND 1 PRECEDING"


@query(f"""SELECT t.trans_num, round(sqrt(pow(d.long - t.merch_long, 2) + pow(d.lat - t.merch_lat, 2)), 6) AS away, round({_CENTS.format(w=_card_window(7))}, 6) AS week_mean,
  count(*) OVER ({_card_window(1)}) AS day_count, d.state FROM {_TX} t LEFT JOIN {_DEMO} d ON t.cc_num = d.cc_num""")
def sql_card_features(spark, d):
    """Features of card payments from a script: distances, windows and an outer join."""
    script = f"""CREATE TABLE payment (trans_num STRING, cc_num FLOAT64, unix_time BIGINT, amt FLOAT64, merch_lat FLOAT64, merch_long FLOAT64);
      CREATE TABLE holder (cc_num FLOAT64 NOT NULL, state VARCHAR, lat FLOAT64, long FLOAT64);
      CREATE VIEW placed AS SELECT t.trans_num, ST_DISTANCE(ST_POINT(d.long, d.lat), ST_POINT(t.merch_long, t.merch_lat)) AS away, t.cc_num, t.unix_time, t.amt, d.state
        FROM payment t LEFT JOIN holder d ON t.cc_num = d.cc_num;
      CREATE VIEW card_features AS SELECT trans_num, round(away, 6) AS away, round({_CENTS.format(w=_card_window(7))}, 6) AS week_mean, count(*) OVER ({_card_window(1)}) AS day_count, state FROM placed t;"""
    tables = {"payment": table(spark, d, "transactions").distinct(), "holder": table(spark, d, "demographics").distinct()}
    return sql_script.run_script(spark, script, tables)["card_features"]


_HOUR = "PARTITION BY pickup_location_id ORDER BY {s} RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING"


@query(f"""SELECT trip_id, count(*) OVER ({_HOUR.format(s="CAST(floor(epoch(lpep_pickup_datetime)) AS bigint)")}) AS trips_before, max(trip_distance) OVER ({_HOUR.format(s="CAST(floor(epoch(lpep_pickup_datetime)) AS bigint)")}) AS longest_before,
  CASE WHEN isodow(lpep_dropoff_datetime) > 5 THEN 1 ELSE 0 END AS weekend FROM (SELECT DISTINCT * FROM green_tripdata) WHERE trip_distance < 500""")
def sql_trip_features(spark, d):
    script = f"""CREATE TABLE trip (trip_id BIGINT, pickup_location_id BIGINT, lpep_pickup_datetime TIMESTAMP, lpep_dropoff_datetime TIMESTAMP, trip_distance FLOAT64);
      CREATE VIEW sane AS SELECT *, unix_seconds(CAST(lpep_pickup_datetime AS TIMESTAMP_LTZ)) AS s FROM trip WHERE trip_distance < 500;
      CREATE VIEW trip_counts AS SELECT trip_id, count(*) OVER ({_HOUR.format(s="s")}) AS trips_before, max(trip_distance) OVER ({_HOUR.format(s="s")}) AS longest_before,
        CASE WHEN EXTRACT(DAYOFWEEK_ISO FROM lpep_dropoff_datetime) > 5 THEN 1 ELSE 0 END AS weekend FROM sane;"""
    return sql_script.run_script(spark, script, {"trip": table(spark, d, "green_tripdata").distinct()})["trip_counts"]


@query("SELECT n_name || ' / ' || r_name AS line FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_name <> r_name")
def sql_combine(spark, d):
    script = """CREATE TABLE nation (n_name VARCHAR, n_regionkey INTEGER); CREATE TABLE region (r_regionkey INTEGER, r_name VARCHAR);
      CREATE VIEW line AS SELECT n_name || ' / ' || r_name AS line FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_name <> r_name -- a ; in a comment"""
    return sql_script.run_script(spark, script, {t: table(spark, d, t) for t in ("nation", "region")})["line"]
