"""Queries that run circuits, sources, sinks and graphs over whole tables, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators import aggregates, inputs, joins, recursion
from tidewheel.operators import timeseries as ts
from tidewheel.plans import graph_plan
from tidewheel.session import ensure_checkpoint_dir, table
from tidewheel.sources import auctions, connectors, csv_format
from tidewheel.streaming import host
from tidewheel.streaming.circuit import Circuit, Operator
from tidewheel.zset import W, consolidate, expanded, neg, sum_of, weighted

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


def _total(parts: list[DataFrame]) -> DataFrame:
    return expanded(consolidate(sum_of(parts)))


def _orders(spark, d, *cols):
    return weighted(table(spark, d, "orders").select(*cols))


_S = "CAST(floor(epoch_us(ts) / 1000000) AS bigint)"


def _seconds(spark, d, *cols):
    return table(spark, d, "events").select(*cols, F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))


# inputs and sources


@query(f"SELECT event_id, {_S} AS s FROM events WHERE {_S} >= 1704153600 AND {_S} < 1706745600")
def scalar_input(spark, d):
    """A scalar per tick (a clock) moves the bounds of a window over events."""
    c = Circuit(spark)
    clock, e = c.add_scalar("clock", 0), c.add_input("e", "event_id bigint, s bigint")
    e.window("s", clock.apply_scalar(lambda n: (n - 2_592_000, n))).output("out")
    rows = weighted(_seconds(spark, d, "event_id"))
    parts = [c.step(clock=1_705_000_000, e=rows.where("event_id % 2 = 0"))["out"], c.step(clock=1_706_745_600, e=rows.where("event_id % 2 = 1"))["out"]]
    return _total(parts)


@query("SELECT n_name AS name, count(*) AS n FROM (SELECT n_name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT 'ATLANTIS' UNION ALL SELECT 'ATLANTIS') GROUP BY 1")
def pushed_input(spark, d):
    """Rows pushed one by one and as tables before a step, and more given to it."""
    c = Circuit(spark)
    c.add_input("names", "name string").output("out")
    c.push("names", [("ATLANTIS",), ("LEMURIA", 1)])
    c.push("names", table(spark, d, "nation").select(F.col("n_name").alias("name")))
    c.push("names", [("ATLANTIS",), ("LEMURIA", -1)])
    out = c.step(names=weighted(table(spark, d, "region").select(F.col("r_name").alias("name"))))["out"]
    return consolidate(out).withColumnRenamed(W, "n")


@query("SELECT i * 10 + j AS v, i AS tick FROM range(4) a(i), range(3) b(j)")
def generator_input(spark, d):
    c = Circuit(spark)
    c.add_generator(lambda t: spark.range(3).select((F.lit(t) * 10 + F.col("id")).alias("v"), F.lit(t).cast("bigint").alias("tick")), "v bigint, tick bigint").output("out")
    return _total([c.step()["out"] for _ in range(4)])


@query("SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'none', 2")
def constant_input(spark, d):
    c = Circuit(spark)
    o = c.add_input("o", "p string")
    o.plus(c.add_constant(weighted(spark.createDataFrame([("none",)], "p string"), 2))).output("out")
    rows = _orders(spark, d, F.col("o_orderpriority").alias("p"), "o_orderkey")
    parts = [c.step(o=rows.where(f"o_orderkey % 2 = {i}").drop("o_orderkey"))["out"] for i in (0, 1)]
    return consolidate(sum_of(parts)).withColumnRenamed(W, "n")


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4()}"


@query("SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price, CAST(1 AS bigint) AS weight FROM orders")
def file_connector(spark, d):
    """Written with weights through the file sink and read again through the file source."""
    path = _folder(spark)
    connectors.write_sink(_orders(spark, d, F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")), "file", {"path": path})
    return connectors.open_source(spark, "file", {"path": path}, "k bigint, status string, price double, weight bigint").drop(W)


@query("SELECT o_orderkey AS k, o_custkey % 7 AS n, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS maybe, CAST(o_orderdate AS date) AS day, o_orderpriority AS text FROM orders")
def typed_csv_file(spark, d):
    """Text cells typed by column: a bad value is the type's default, or null where that is allowed."""
    path = _folder(spark)
    o = table(spark, d, "orders")
    bad = F.when(F.col("o_orderkey") % 5 == 0, F.lit("Null")).otherwise(F.col("o_custkey").cast("string"))
    n = F.when(F.col("o_custkey") % 7 == 0, F.lit("x")).otherwise((F.col("o_custkey") % 7).cast("string"))
    o.select("o_orderkey", n, bad, F.date_format("o_orderdate", "dd/MM/yyyy"), "o_orderpriority").write.csv(path)
    cols = [csv_format.TypedColumn("k", 0, "bigint"), csv_format.TypedColumn("n", 1, "bigint"), csv_format.TypedColumn("maybe", 2, "bigint", True), csv_format.TypedColumn("day", 3, "date", False, "dd/MM/yyyy"), csv_format.TypedColumn("text", 4, "string")]
    return csv_format.read_csv_typed(spark, path, cols).drop(W)


@query("SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def streamed_files(spark, d):
    """A file source that is followed as a stream, through a circuit that writes with the sink after each batch."""
    src, out, check = _folder(spark), _folder(spark), _folder(spark)
    for t, k, n in (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name")):
        table(spark, d, t).select(F.col(k).cast("bigint").alias("k"), F.col(n).alias("name")).coalesce(1).write.mode("append").csv(src)
    c = Circuit(spark)
    c.add_input("x", "k bigint, name string").distinct().output("out")
    stream = connectors.open_source(spark, "file", {"path": src, "follow": True}, "k bigint, name string").drop(W)
    host.drive(c, stream, "x", lambda got, _: connectors.write_sink(got["out"], "file", {"path": out}), check).awaitTermination()
    read = csv_format.read_csv(spark, out, "k bigint, name string, weight bigint").drop(W)
    return expanded(consolidate(read.withColumnRenamed("weight", W)))


@query("SELECT n_nationkey AS k, n_name AS name, CAST(1 AS bigint) AS weight FROM nation")
def json_format(spark, d):
    """A format of one's own, registered by name and used by the file transport."""
    connectors.register_format("json-lines", lambda lines, column, schema: weighted(lines.select(F.from_json(column, schema).alias("r")).select("r.*")), lambda df: df.select(F.to_json(F.struct("k", "name", F.col(W).alias("weight"))).alias("value")))
    path = _folder(spark)
    connectors.write_sink(weighted(table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))), "file", {"path": path}, "json-lines")
    return connectors.open_source(spark, "file", {"path": path}, "k int, name string, weight bigint", "json-lines").drop(W)


@query("SELECT CASE WHEN i % 50 < 1 THEN 'person' WHEN i % 50 < 4 THEN 'auction' ELSE 'bid' END AS kind, count(*) AS n FROM range(100000) t(i) GROUP BY 1")
def generated_auctions(spark, d):
    """The kinds of the generated events, and that bids name what was opened before."""
    made = auctions.tables(auctions.events(spark, auctions.AuctionConfig(events=100_000)))
    counted = [t.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n")) for k, t in made.items()]
    return sum_of(counted)


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table followed as a stream; times are instants."""
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def _emitted(stream: DataFrame) -> DataFrame:
    """What a stream appends to a file sink until its source is exhausted."""
    spark, out, check = stream.sparkSession, _folder(stream.sparkSession), _folder(stream.sparkSession)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, CAST(count(*) FILTER (WHERE value > 10) AS bigint) AS large FROM events
  WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(date_trunc('milliseconds', ts)) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2""")
def native_windows(spark, d):
    """Event-time windows of Structured Streaming with a watermark, each emitted once when it is closed."""
    counted = host.windowed_counts(_event_stream(spark, d), "ts", "10 minutes", "1 hour", None, ["event_type"], n=F.count(F.lit(1)), large=F.count_if(F.col("value") > 10))
    return _emitted(counted).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "large")


@query("SELECT DISTINCT user_id, event_type FROM events")
def native_first_seen(spark, d):
    """Distinct records of a stream, state bounded by the watermark."""
    return _emitted(host.first_seen(_event_stream(spark, d), ["user_id", "event_type"], "ts", "100 days").select("user_id", "event_type"))


# delays, integrals, feedback and nested circuits


def _thirds(df: DataFrame, key: str) -> list[DataFrame]:
    return [df.where(f"pmod({key}, 3) = {i}") for i in range(3)]


@query("SELECT o_custkey % 3 AS tick, o_custkey AS k, count(*) AS n FROM orders WHERE o_custkey % 3 < 2 GROUP BY 1, 2")
def delayed(spark, d):
    """The value of the tick before: the last tick's rows are not seen."""
    c = Circuit(spark)
    c.add_input("o", "tick bigint, k bigint").delay().output("out")
    rows = _orders(spark, d, (F.col("o_custkey") % 3).alias("tick"), F.col("o_custkey").alias("k"))
    return consolidate(sum_of([c.step(o=x)["out"] for x in _thirds(rows, "k")])).withColumnRenamed(W, "n")


@query("SELECT o_orderpriority AS p, sum(3 - o_custkey % 3) AS n FROM orders GROUP BY 1")
def integrated(spark, d):
    """The sum over three ticks of the whole collection: what came first counts three times."""
    c = Circuit(spark)
    c.add_input("o", "k bigint, p string").integrate().map("p").output("out")
    rows = _orders(spark, d, F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("p"))
    return consolidate(sum_of([c.step(o=x)["out"] for x in _thirds(rows, "k")])).select("p", F.col(W).cast("decimal(38,0)").alias("n"))


@query("SELECT o_custkey AS k, max(o_totalprice) AS top FROM orders GROUP BY 1")
def differentiated(spark, d):
    """An aggregate of the whole collection at every tick, turned into changes, which add up to the last one."""
    c = Circuit(spark)
    whole = c.add_input("o", "k bigint, price double").integrate()
    whole.apply(lambda df: aggregates.maximum(df, ["k"], F.col("price"), "top")).differentiate().output("out")
    rows = _orders(spark, d, F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("price"), "o_orderkey")
    return _total([c.step(o=x.drop("o_orderkey"))["out"] for x in _thirds(rows, "o_orderkey")])


@query("SELECT r_regionkey + i AS k, r_name AS name FROM region, range(4) t(i)")
def fed_back(spark, d):
    """A cycle through the next tick: what came in once comes back, one higher, at every tick."""
    c = Circuit(spark)
    x = c.add_input("x", "k bigint, name string")
    back, connect = c.feedback("k bigint, name string")
    out = x.plus(back.map((F.col("k") + 1).alias("k"), "name"))
    connect(out)
    out.output("out")
    rows = weighted(table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("k"), F.col("r_name").alias("name")))
    return _total([c.step(x=rows)["out"], *[c.step()["out"] for _ in range(3)]])


_TREE = "SELECT s_suppkey AS src, s_suppkey // 2 AS dst FROM supplier WHERE s_suppkey > 0"


def _tree(spark, d):
    return table(spark, d, "supplier").where("s_suppkey > 0").select(F.col("s_suppkey").alias("src"), F.expr("s_suppkey div 2").alias("dst"))


def _onward(x: DataFrame, e: DataFrame) -> DataFrame:
    return x.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")


_PATHS = "SELECT src, dst FROM e UNION SELECT p.src, e.dst FROM p JOIN e ON p.dst = e.src"


@query(f"WITH RECURSIVE e AS ({_TREE}), p AS ({_PATHS}) SELECT src, dst FROM p")
def nested_closure(spark, d):
    """Paths of a tree by the rounds of a circuit inside a tick, whose integrals start anew at each tick."""
    c = Circuit(spark)
    e = c.add_input("e", "src bigint, dst bigint")

    def rounds(n, given):
        back, connect = n.feedback("src bigint, dst bigint")
        whole = given["e"].integrate()
        found = given["e"].plus(whole.apply2(back, lambda a, b: weighted(_onward(b.drop(W), a.drop(W))))).distinct()
        connect(found)
        return found

    c.nested({"e": e}, rounds).output("out")
    return expanded(consolidate(c.step(e=weighted(_tree(spark, d)))["out"]))


@query("SELECT k, round, sum(w) AS n FROM (SELECT o_custkey % 5 AS k, i AS round, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS w FROM orders, range(3) t(i)) GROUP BY 1, 2")
def nested_integral(spark, d):
    """Values of one round, added up over two ticks of the outer circuit: the first tick's rows are counted at both."""
    c = Circuit(spark)
    x = c.add_input("x", "k bigint, round bigint")

    def rounds(n, given):
        back, connect = n.feedback("k bigint, round bigint")
        now = given["x"].plus(back.map("k", (F.col("round") + 1).alias("round")).filter("round < 3"))
        connect(now)
        # the round's own value, and what the same round summed up to at the outer tick before
        before = n.delay_nested(n.integrate_nested(now))
        return now.plus(before)

    c.nested({"x": x}, rounds, 10).output("out")
    rows = _orders(spark, d, (F.col("o_custkey") % 5).alias("k"), F.lit(0).cast("bigint").alias("round"), "o_orderkey")
    parts = [c.step(x=rows.where(f"o_orderkey % 2 = {i}").drop("o_orderkey"))["out"] for i in (0, 1)]
    return consolidate(sum_of(parts)).select("k", "round", F.col(W).cast("decimal(38,0)").alias("n"))


@query(f"WITH RECURSIVE e AS ({_TREE}), l AS (SELECT s_suppkey AS id, s_suppkey AS label FROM supplier UNION SELECT e.src, l.label FROM l JOIN e ON l.id = e.dst) SELECT id, min(label) AS label FROM l GROUP BY 1")
def iterated_labels(spark, d):
    """Every supplier takes the least label of itself and its parent until none changes."""
    e = _tree(spark, d)

    def step(now: DataFrame, _: int) -> DataFrame:
        offered = e.join(now.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "label")
        return now.unionByName(offered).groupBy("id").agg(F.min("label").alias("label"))

    start = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("label"))
    return recursion.iterate(start, step, lambda old, new: new.exceptAll(old).isEmpty())


# incremental operators


@query("SELECT o_custkey % 50 AS k, CAST(sum(o_orderkey % 100) AS bigint) AS total FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1 HAVING sum(o_orderkey % 100) <> 0")
def incremental_aggregate_linear(spark, d):
    """Sums per key from the changes alone; finished orders are inserted first and deleted last."""
    c = Circuit(spark)
    c.add_input("o", "k bigint, v bigint").aggregate_linear(["k"], F.col("v"), "total").output("out")
    o = _orders(spark, d, (F.col("o_custkey") % 50).alias("k"), (F.col("o_orderkey") % 100).alias("v"), "o_orderstatus", "o_orderkey")
    parts = [c.step(o=x.drop("o_orderstatus", "o_orderkey"))["out"] for x in _thirds(o, "o_orderkey")]
    parts.append(c.step(o=neg(o.where("o_orderstatus = 'F'").drop("o_orderstatus", "o_orderkey")))["out"])
    return _total(parts)


@query("SELECT tick, CAST(max(top) OVER (ORDER BY tick) AS double) AS top FROM (SELECT o_orderkey % 3 AS tick, max(o_totalprice) AS top FROM orders GROUP BY 1)")
def running_fold(spark, d):
    """A scalar folded over the ticks: the highest price so far."""
    c = Circuit(spark)
    o = c.add_input("o", "price double")
    o.apply_scalar(lambda df: df.agg(F.max("price")).first()[0]).stream_fold(0.0, max).output("top")
    o = _orders(spark, d, F.col("o_totalprice").alias("price"), "o_orderkey")
    tops = [(i, float(c.step(o=x.drop("o_orderkey"))["top"])) for i, x in enumerate(_thirds(o, "o_orderkey"))]
    return spark.createDataFrame(tops, "tick bigint, top double")


@query("SELECT count(*) AS seen, CAST(sum(o_custkey) AS bigint) AS keys FROM orders")
def inspected(spark, d):
    """A look at every value on the way; the stream goes on unchanged."""
    c, seen = Circuit(spark), []
    c.add_input("o", "k bigint").inspect(lambda df: seen.append(df.agg(F.sum(W)).first()[0])).output("out")
    rows = _orders(spark, d, F.col("o_custkey").alias("k"))
    out = sum_of([c.step(o=x)["out"] for x in _thirds(rows, "k")])
    return out.agg(F.lit(sum(seen)).cast("bigint").alias("seen"), F.sum(F.col("k") * F.col(W)).alias("keys"))


class RunningTop(Operator):
    """An operator of one's own: per key the highest value so far; the tables of both inputs count."""

    def __init__(self) -> None:
        super().__init__()
        self.held["tops"] = None

    def evaluate(self, a: DataFrame, b: DataFrame) -> DataFrame:
        tops = lambda df: df.groupBy("k").agg(F.max("v").alias("v"))
        new = tops(a.drop(W).unionByName(b.drop(W)))
        old = self.held["tops"]
        self.next = self.cut(tops(new.unionByName(old)) if old is not None else new)
        gone = weighted(old, -1) if old is not None else weighted(new.where("false"))
        return consolidate(weighted(self.next).unionByName(gone))

    def commit(self) -> None:
        self.held["tops"] = self.next


@query("SELECT k, max(v) AS v FROM (SELECT o_custkey % 40 AS k, o_totalprice AS v FROM orders UNION ALL SELECT c_custkey % 40, c_acctbal FROM customer) GROUP BY 1")
def custom_operator(spark, d):
    c = Circuit(spark)
    a, b = c.add_input("a", "k bigint, v double"), c.add_input("b", "k bigint, v double")
    c.operator(RunningTop(), [a, b], a.empty).output("out")
    o = _orders(spark, d, (F.col("o_custkey") % 40).alias("k"), F.col("o_totalprice").alias("v"), "o_orderkey")
    cu = weighted(table(spark, d, "customer").select((F.col("c_custkey") % 40).alias("k"), F.col("c_acctbal").alias("v")))
    return _total([c.step(a=x.drop("o_orderkey"), b=cu if i == 0 else None)["out"] for i, x in enumerate(_thirds(o, "o_orderkey"))])


@query("SELECT c_custkey, p_partkey FROM customer JOIN part ON p_retailprice >= c_acctbal AND p_retailprice < c_acctbal + 5")
def incremental_range_join(spark, d):
    """Ranges and keys arrive in ticks; a row meets only the buckets that its range touches."""
    c = Circuit(spark)
    a, b = c.add_input("a", "c_custkey bigint, lo double"), c.add_input("b", "p_partkey bigint, price double")
    a.range_join(b, F.col("lo"), F.col("lo") + 5, "price", 5.0).map("c_custkey", "p_partkey").output("out")
    cu = weighted(table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("lo")))
    p = weighted(table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("price")))
    return _total([c.step(a=x, b=y)["out"] for x, y in zip(_thirds(cu, "c_custkey"), _thirds(p, "p_partkey"), strict=True)])


@query("SELECT o_orderkey, l_linenumber, c_mktsegment FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_quantity > 40")
def monotonic_join(spark, d):
    """Joins whose output keeps the order of the key, by merging."""
    li = weighted(table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"))
    cu = weighted(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"))
    o = _orders(spark, d, "o_orderkey", "o_custkey")
    return joins.monotonic_join(joins.monotonic_join(o, li, ["o_orderkey"]), cu, ["o_custkey"]).select("o_orderkey", "l_linenumber", "c_mktsegment")


@query(f"SELECT user_id, round(sum(value), 4) AS total, count(*) AS n FROM events WHERE {_S} >= 1704100000 AND {_S} < 1705555555 GROUP BY 1")
def rollup_range(spark, d):
    """A range added up from the partial sums of a rollup tree: few large ranges and small ones at the ends."""
    levels = [1, 60, 3600, 86_400]
    tree = ts.rollup_tree(_seconds(spark, d, "user_id", "value"), ["user_id"], "s", "value", levels)
    got = ts.rollup_total(tree, ["user_id"], levels, 1_704_100_000, 1_705_555_555)
    return got.select("user_id", F.round("total", 4).alias("total"), F.col("n").cast("bigint").alias("n"))


@query("SELECT a.s_suppkey AS manager, b.s_suppkey AS employee, a.s_suppkey // 2 AS grand FROM supplier a JOIN supplier b ON b.s_suppkey // 2 = a.s_suppkey WHERE a.s_suppkey % 4 <> 1 AND b.s_suppkey % 4 <> 1")
def incremental_org_chart(spark, d):
    """Managers' managers, kept while a quarter of the people leave."""
    c = Circuit(spark)
    m = c.add_input("m", "manager bigint, employee bigint")
    up = m.map(F.col("manager").alias("grand"), F.col("employee").alias("manager"))
    m.join(up, ["manager"]).map("manager", "employee", "grand").output("out")
    rows = weighted(table(spark, d, "supplier").select(F.expr("s_suppkey div 2").alias("manager"), F.col("s_suppkey").alias("employee")))
    return _total([c.step(m=rows)["out"], c.step(m=neg(rows.where("employee % 4 = 1")))["out"]])


@query("SELECT degree, count(*) AS vertices FROM (SELECT o_custkey, CAST(count(*) AS bigint) AS degree FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) GROUP BY 1")
def incremental_degrees(spark, d):
    """How many vertices have which degree, kept while edges go."""
    c = Circuit(spark)
    e = c.add_input("e", "src bigint, status string")
    degree = e.aggregate_linear(["src"], F.lit(1), "degree")
    degree.map("degree").aggregate_linear(["degree"], F.lit(1), "vertices").output("out")
    o = _orders(spark, d, F.col("o_custkey").alias("src"), F.col("o_orderstatus").alias("status"))
    return _total([c.step(e=x)["out"] for x in _thirds(o, "src")] + [c.step(e=neg(o.where("status = 'P'")))["out"]])


@query("""WITH u AS (SELECT DISTINCT l_orderkey AS id, 's' || CAST(l_suppkey % 40 AS varchar) AS p FROM lineitem), k AS (SELECT id FROM u WHERE p = 's7')
  SELECT a.p AS a, b.p AS b, CAST(count(*) AS bigint) AS n FROM u a JOIN u b ON a.id = b.id AND a.p < b.p WHERE a.id IN (SELECT id FROM k) GROUP BY 1, 2""")
def incremental_personal_network(spark, d):
    """People named together with one person, summed over ticks of events."""
    c = Circuit(spark)
    e = c.add_input("e", "id bigint, people array<string>")
    named = e.filter(F.array_contains("people", "s7")).map(F.array_sort("people").alias("p"))
    pairs = F.flatten(F.transform("p", lambda a, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    named.flat_map(pairs, "x").map("x.a", "x.b").aggregate_linear(["a", "b"], F.lit(1), "n").output("out")
    rows = weighted(table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.concat(F.lit("s"), F.col("l_suppkey") % 40)).alias("people")))
    return _total([c.step(e=x)["out"] for x in _thirds(rows, "id")])


@query("SELECT o_custkey AS k, last(o_totalprice ORDER BY o_orderkey) AS price FROM orders GROUP BY 1")
def upsert_operator(spark, d):
    """Upserts of a keyed table against its state, sorted and one per key."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("price"), F.lit(False).alias("delete"), F.col("o_orderkey").alias("seq"))
    state = weighted(spark.createDataFrame([(0, -1.0)], "k bigint, price double"))
    return expanded(consolidate(state.unionByName(inputs.map_delta(state, o, ["k"], ["price"]))))


# graphs of nodes


def _graph(spark, nodes: dict[str, Any], **tables: list[DataFrame]) -> DataFrame:
    c = graph_plan.build(spark, {"nodes": nodes})
    n = max(len(t) for t in tables.values())
    parts = [c.step(**{name: t[i] for name, t in tables.items() if i < len(t)})["out"] for i in range(n)]
    return _total(parts)


@query("SELECT o_custkey AS k, min(o_totalprice) AS least FROM orders GROUP BY 1")
def graph_min(spark, d):
    nodes = {"1": {"source": {"table": "o", "schema": "k bigint, v double"}}, "2": {"min": {"input": 1, "keys": ["k"], "value": "v", "alias": "least"}}, "3": {"export": {"input": 2, "name": "out"}}}
    return _graph(spark, nodes, o=_thirds(_orders(spark, d, F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v")), "k"))


@query("SELECT s_nationkey AS k, string_agg(s_name, '|' ORDER BY s_name) AS names FROM supplier GROUP BY 1")
def graph_fold(spark, d):
    nodes = {
        "1": {"source": {"table": "s", "schema": "k int, v string"}}, "2": {"fold": {"input": 1, "keys": ["k"], "value": "v", "zero": "''", "step": "concat($acc, if($acc = '', '', '|'), $value)", "alias": "names"}}, "3": {"sink": {"input": 2, "name": "out"}},
    }
    s = weighted(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("v"), "s_suppkey"))
    return _graph(spark, nodes, s=[x.drop("s_suppkey") for x in _thirds(s, "s_suppkey")])


@query(f"SELECT DISTINCT user_id, {_S} AS s, count(*) OVER (PARTITION BY user_id ORDER BY {_S} RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM events")
def graph_rolling(spark, d):
    nodes = {
        "1": {"source": {"table": "e", "schema": "user_id bigint, event_id bigint, s bigint"}}, "2": {"rolling": {"input": 1, "partition": ["user_id"], "ts": "s", "aggs": {"n": "sum(__w)"}, "from": -3600, "to": 0}}, "3": {"sink": {"input": 2, "name": "out"}},
    }
    e = weighted(_seconds(spark, d, "user_id", "event_id")).select("user_id", "event_id", "s", W)
    return _graph(spark, nodes, e=[e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")])


@query("SELECT k FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer UNION ALL SELECT 7) EXCEPT ALL SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def graph_sum_minus(spark, d):
    """Sums, differences and a constant; index nodes on the way change nothing."""
    nodes = {
        "1": {"source": {"table": "o", "schema": "k bigint"}}, "2": {"source": {"table": "c", "schema": "k bigint"}}, "3": {"source": {"table": "rich", "schema": "k bigint"}}, "4": {"constant": {"schema": "k bigint", "rows": [[7]]}},
        "5": {"sum": {"inputs": [1, 2, 4]}}, "6": {"index_by_column": {"input": 5, "column": "k"}}, "7": {"unit_map_to_set": {"input": 6}}, "8": {"minus": {"left": 7, "right": 3}}, "9": {"sink": {"input": 8, "name": "out"}},
    }
    cu = weighted(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal"))
    return _graph(spark, nodes, o=_thirds(_orders(spark, d, F.col("o_custkey").alias("k")), "k"), c=[cu.drop("c_acctbal")], rich=[cu.where("c_acctbal > 0").drop("c_acctbal")])


@query("SELECT o_orderkey AS k, o_orderpriority || ' ' || c_mktsegment AS label FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < o_totalprice / 20")
def graph_joins(spark, d):
    """Joins with a condition and mapped output, in both of their kinds."""
    nodes = {
        "1": {"source": {"table": "o", "schema": "k bigint, cust bigint, p string, price double"}}, "2": {"source": {"table": "c", "schema": "cust bigint, seg string, bal double"}}, "3": {"index_with": {"input": 1, "keys": ["cust"]}},
        "4": {"monotonic_join": {"left": 3, "right": 2, "on": ["cust"], "where": "bal < price / 20", "columns": {"k": "k", "label": "concat(p, ' ', seg)"}}}, "5": {"sink": {"input": 4, "name": "out"}},
    }
    o = _orders(spark, d, F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("p"), F.col("o_totalprice").alias("price"))
    cu = weighted(table(spark, d, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal")))
    return _graph(spark, nodes, o=_thirds(o, "k"), c=_thirds(cu, "cust"))


@query(f"WITH RECURSIVE e AS ({_TREE}), p AS ({_PATHS}) SELECT src, dst FROM p")
def graph_subgraph(spark, d):
    """Paths by a graph inside a node: its inputs at the first round, a feedback, a join and a distinct."""
    inner = {
        "e": {"delta0": {"input": "edges"}}, "all": {"integrate": {"input": "e"}}, "back": {"delayed_feedback": {"schema": "src bigint, dst bigint", "from": "found"}},
        "step": {"stream_join": {"left": "back", "right": "all", "left_on": "dst", "right_on": "src", "columns": {"src": "l.src", "dst": "r.dst"}}}, "both": {"sum": {"inputs": ["e", "step"]}}, "found": {"distinct": {"input": "both"}},
    }
    nodes = {"1": {"source": {"table": "e", "schema": "src bigint, dst bigint"}}, "2": {"subgraph": {"inputs": {"edges": 1}, "nodes": inner, "output": "found"}}, "3": {"sink": {"input": 2, "name": "out"}}}
    return _graph(spark, nodes, e=[weighted(_tree(spark, d))])
