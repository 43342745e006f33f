"""CSV, connectors, SQL scripts and scalar functions."""

import math
import urllib.request

import pytest
from pyspark.sql import functions as F

from tidewheel.functions import scalar
from tidewheel.plans import sql_script
from tidewheel.sources import connectors, csv_format
from tidewheel.sources.csv_format import TypedColumn
from tidewheel.zset import W, weighted


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, True, 5, "a,b"), (2, False, None, 'q"x'), (3, True, -1, "")]
    df = weighted(spark.createDataFrame(rows, "id int, b boolean, i bigint, s string"))
    connectors.write_sink(df, "file", {"path": str(tmp_path / "x")})
    back = connectors.open_source(spark, "file", {"path": str(tmp_path / "x")}, "id int, b boolean, i bigint, s string, w bigint")
    assert {(r.id, r.b, r.i, r.s or "", r.w, r[W]) for r in back.collect()} == {(*r, 1, 1) for r in rows}
    with pytest.raises(KeyError):
        connectors.open_source(spark, "file", {}, "x int", "avro")


def test_typed_columns(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1,2024-03-01,null,x\nbad,01/02/2024,NULL,null\n")
    cols = [TypedColumn("n", 0, "int"), TypedColumn("day", 1, "date", True, "yyyy-MM-dd"), TypedColumn("f", 2, "double", True), TypedColumn("s", 3, "string"), TypedColumn("z", 2, "bigint")]
    got = csv_format.read_csv_typed(spark, str(tmp_path / "x.csv"), cols).collect()
    assert [(r.n, str(r.day), r.f, r.s, r.z) for r in got] == [(1, "2024-03-01", None, "x", 0), (0, "None", None, "null", 0)]


def test_followed_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("1,x\n2,y\n")
    stream = connectors.open_source(spark, "file", {"path": str(tmp_path / "in"), "follow": True}, "id int, s string")
    q = stream.writeStream.format("memory").queryName("followed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("followed").count() == 2


def test_kafka_options():
    o = connectors.kafka_options({"bootstrap.servers": "h:1", "topics": ["a", "b"], "group.id": "g"}, True)
    assert o == {"kafka.bootstrap.servers": "h:1", "kafka.group.id": "g", "subscribe": "a,b"}
    o = connectors.kafka_options({"bootstrap.servers": "h:1", "topic": "t"}, False)
    assert o["topic"] == "t" and o["kafka.max.in.flight.requests.per.connection"] == "1000"
    for bad in ({"topics": ["a"]}, {"bootstrap.servers": "h"}, {"bootstrap.servers": "h", "topics": ["a"], "enable.auto.commit": "true"}):
        with pytest.raises(ValueError):
            connectors.kafka_options(bad, True)


def test_http_inbox(spark):
    box = connectors.HttpInbox()
    post = urllib.request.Request(f"http://127.0.0.1:{box.port}/input/t", data=b"1,a\n2,b\n", method="POST")
    assert urllib.request.urlopen(post).status == 200
    rows = box.drain(spark, "t", "id int, s string")
    assert {(r.id, r.s, r[W]) for r in rows.collect()} == {(1, "a", 1), (2, "b", 1)}
    box.publish("v", rows)
    assert b'"s": "a"' in urllib.request.urlopen(f"http://127.0.0.1:{box.port}/output/v").read()
    box.close()


def test_sql_script(spark):
    script = """-- a; comment
    CREATE TABLE t (a INTEGER NOT NULL, b VARCHAR(10), c DOUBLE PRECISION, PRIMARY KEY (a));
    CREATE VIEW v AS SELECT a, b || ';' AS b FROM t /* x; */ WHERE c > 1;
    CREATE VIEW w AS SELECT count(*) AS n FROM v"""
    views = sql_script.run_script(spark, script, {"T": spark.createDataFrame([("1", "x", "2.5"), ("2", "y", "0")], "a string, b string, c string")})
    assert [tuple(r) for r in views["v"].collect()] == [(1, "x;")] and views["w"].first().n == 1


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "value,kind,f,want",
    [
        (-1, "bigint", lambda x: scalar.count_ones(x, 8), 8), (5, "bigint", lambda x: scalar.bit_reverse(x, 8), -96), (1, "bigint", lambda x: scalar.byte_reverse(x, 32), 16777216), (0, "bigint", lambda x: scalar.leading_zeroes(x, 16), 16), (-2, "int", lambda x: scalar.leading_ones(x, 32), 31),
        (7, "int", lambda x: scalar.trailing_ones(x, 32), 3), (-1, "bigint", lambda x: scalar.bit_reverse(x), -1), (8, "bigint", scalar.is_power_of_two, True), (-8, "bigint", scalar.is_power_of_two, False),
        (-0.0, "double", scalar.is_sign_negative, True), (0.0, "double", scalar.is_sign_positive, True), (0.0, "double", scalar.ln, float("-inf")), (5.0, "double", scalar.tgamma, 24.0), (0.0, "double", scalar.lgamma, float("inf")), (-2.5, "double", scalar.trunc, -2.0),
        ("héllo", "string", lambda x: scalar.truncate_bytes(x, 2), "h"), ("héllo", "string", lambda x: scalar.truncate_bytes(x, 3), "hé"), ("é", "string", scalar.is_nfc, False), ("é", "string", scalar.is_nfd, True), ("é", "string", scalar.is_nfkc, True), (None, "string", scalar.is_nfc, None),
        ("abc", "string", scalar.is_lowercase, True), ("a1", "string", scalar.is_lowercase, False), ("AB", "string", scalar.is_uppercase, True), ("é", "string", scalar.is_ascii, False),
        (-1, "bigint", lambda x: scalar.epoch(F.timestamp_millis(x)), 0), (-1500, "bigint", lambda x: scalar.epoch(F.timestamp_millis(x)), -1), (-1, "bigint", lambda x: scalar.to_date(F.timestamp_millis(x)).cast("string"), "1970-01-01"), (61_500, "bigint", lambda x: scalar.millisecond(F.timestamp_millis(x)), 1500),
        (-7, "bigint", lambda x: scalar.div_floor(x, F.lit(3)), -3), (-7, "bigint", lambda x: scalar.mod_floor(x, F.lit(-3)), -1), (-7, "bigint", lambda x: scalar.mod_euclid(x, F.lit(-3)), 2), (2**62 + 1, "bigint", lambda x: scalar.div_floor(x, F.lit(2)), 2**61),
    ],
)
def test_scalars(spark, value, kind, f, want):
    got = one(spark, value, kind, f)
    assert got == want or (isinstance(want, float) and math.isclose(got, want))


def test_sliding_windows_of_scripts_grow_only(spark):
    """A dense key: sliding frames would add up the rows of the range for every row; nulls, ties, empty ranges and gaps as in SQL."""
    from decimal import Decimal

    n = 60_000
    rows = spark.range(n).selectExpr("1 AS k", "CAST(id div 2 AS bigint) AS t", "CASE WHEN id % 5 > 0 THEN CAST(id % 97 AS double) / 100 END AS v", "id")
    odd = spark.createDataFrame([(2, None, 1.25, -1), (2, None, None, -2), (2, -5, None, -3), (2, -4, 2.5, -4), (2, 9, 1.0, -5)], "k int, t bigint, v double, id bigint")
    over = lambda a, at="t": f"OVER (PARTITION BY k ORDER BY {at} RANGE BETWEEN {a})"
    wide, here = over("50000 PRECEDING AND 1 PRECEDING"), over("1 PRECEDING AND 2 FOLLOWING")
    script = f"""CREATE TABLE pay (k INTEGER, t BIGINT, v DOUBLE PRECISION, id BIGINT);
      CREATE VIEW sums AS SELECT id, sum(CAST(v AS decimal(18,2))) {wide} AS s, count(v) {wide} AS c, count(*) {here} AS n, 'count(v) {wide}' AS said FROM pay;
      CREATE VIEW parts AS SELECT id, count(*) {over("1 PRECEDING AND CURRENT ROW", "f")} AS n FROM (SELECT k, id, CAST(t AS double) / 4 AS f FROM pay WHERE k = 2);"""
    views = sql_script.run_script(spark, script, {"pay": rows.unionByName(odd)})
    plan = views["sums"]._jdf.queryExecution().optimizedPlan().toString()
    assert "-50000, -1" not in plan and "unboundedpreceding$(), -50001" in plan
    assert views["sums"].schema["s"].dataType.simpleString() == "decimal(28,2)"
    got = {r["id"]: tuple(r)[1:4] for r in views["sums"].collect()}
    assert {k: got[k] for k in range(-5, 0)} == {-1: (Decimal("1.25"), 1, 2), -2: (Decimal("1.25"), 1, 2), -3: (None, 0, 2), -4: (None, 0, 2), -5: (Decimal("2.50"), 1, 1)}
    cents = [i % 97 if i % 5 else None for i in range(n)]
    some = [c for c in cents[: n - 2] if c is not None]
    assert got[n - 1] == (Decimal(sum(some)) / 100, len(some), 4) and got[0] == (None, 0, 6) and got[2] == (Decimal("0.01"), 1, 8)
    assert views["sums"].where("id = 5").first()["said"] == f"count(v) {wide}"
    assert {r["id"]: r["n"] for r in views["parts"].collect()} == {-1: 2, -2: 2, -3: 1, -4: 2, -5: 1}  # no whole numbers: as written
