"""Cast rules, the gamma functions and aborts: what queries with SQL cannot show."""

import math

import pytest
from pyspark.sql import functions as F

from tidewheel.functions import scalar
from tidewheel.plans import sql_script
from tidewheel.sources import connectors
from tidewheel.zset import W


@pytest.mark.parametrize("source,target", [("string", "int"), ("int", "string"), ("double", "date"), ("float", "timestamp"), ("int", "boolean"), ("double", "boolean"), ("boolean", "double")])
def test_refused_casts(spark, source, target):
    with pytest.raises(TypeError):
        scalar.cast_checked(F.col("x"), source, target)


def test_casts_cut_towards_zero(spark):
    df = spark.createDataFrame([(-1.9, -1500)], "x double, ms bigint").select(scalar.cast_checked(F.col("x"), "double", "int").alias("i"), F.unix_millis(scalar.cast_checked(F.col("ms"), "bigint", "timestamp")).alias("ms"))
    assert tuple(df.first()) == (-1, -1500)


def test_abort_fails_only_where_it_is_evaluated(spark):
    df = spark.range(3).select(F.when(F.col("id") > 5, scalar.abort("too large").cast("bigint")).otherwise(F.col("id")).alias("v"))
    assert df.count() == 3 and [r.v for r in df.collect()] == [0, 1, 2]
    with pytest.raises(Exception, match="too large"):
        spark.range(9).select(F.when(F.col("id") > 5, scalar.abort("too large").cast("bigint")).otherwise(F.col("id")).alias("v")).collect()


def test_gamma_against_the_math_library(spark):
    xs = [1e-9, 0.1, 0.5, 1.0, 1.5, 2.0, 3.7, 10.0, 20.5, 100.0, 171.0, 1e6, 1e17, -0.5, -1.5, -2.25, -10.1]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", scalar.lgamma(F.col("x")).alias("l"), scalar.tgamma(F.col("x")).alias("t")).collect()
    for x, low, t in rows:
        assert low == pytest.approx(math.lgamma(x), rel=1e-10, abs=1e-10)
        assert t == (math.inf if x > 171.7 else pytest.approx(math.gamma(x), rel=1e-9))
    odd = spark.createDataFrame([(0.0,), (-3.0,), (float("nan"),), (float("inf"),), (None,)], "x double").select(scalar.lgamma(F.col("x")).alias("l"), scalar.tgamma(F.col("x")).alias("t")).collect()
    assert [odd[0].l, odd[1].l, odd[3].l, odd[3].t, odd[4].l] == [math.inf, math.inf, math.inf, math.inf, None]
    assert math.isnan(odd[1].t) and math.isnan(odd[2].l) and math.isnan(odd[2].t)


def test_texts_and_script_functions(spark):
    df = spark.createDataFrame([("a",), (None,)], "s string").select(scalar.clear(F.col("s")).alias("c"))
    assert [r.c for r in df.collect()] == ["", None]
    sql_script.register_functions(spark)
    assert spark.sql("SELECT ST_DISTANCE(ST_POINT(0, 0), ST_POINT(3, 4)) AS d, ST_DISTANCE(ST_POINT(0, NULL), ST_POINT(3, 4)) AS n").first() == (5.0, None)


def test_transports_by_name(spark):
    kept = {}
    connectors.register_transport("memory", lambda s, config, schema, format: kept[config["name"]], lambda df, config, format: kept.update({config["name"]: df}))
    connectors.write_sink(spark.range(3).withColumn(W, F.lit(1)), "memory", {"name": "x"})
    assert connectors.open_source(spark, "memory", {"name": "x"}, "id bigint").count() == 3
    with pytest.raises(KeyError):
        connectors.open_source(spark, "memory", {"name": "x"}, "id bigint", "no such format")
