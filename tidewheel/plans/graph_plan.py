"""Data-flow graphs as JSON, built into an incremental circuit.

A graph is ``{"nodes": {id: {kind: fields}}}``; ids sort by the order of their
inputs.  Expressions are Spark SQL texts.  Kinds:

    source(table, schema)            source_map(table, schema, keys)
    constant(schema, rows)           map(input, columns)
    filter(input, where)             filter_map(input, where, columns)
    flat_map(input, items, alias, columns)
    join(left, right, on[, where])   antijoin(left, right, on)
    semijoin(left, right, on)        outer_join_default(left, right, on)
    min/max(input, keys, value, alias)
    fold(input, keys, value, zero, step, finish, alias)
    aggregate_linear(input, keys, value, alias)
    rolling(input, partition, ts, aggs, from, to)
    sum(inputs) minus(left, right) neg(input) distinct(input)
    integrate(input) differentiate(input) delay(input)
    fixpoint(input, seed, step)      sink(input, name)
    export(input, name)              index_with(input, keys)
    index_by_column(input, column)   unit_map_to_set(input)
    monotonic_join(left, right, on[, where, columns])
    stream_join(left, right, left_on, right_on, columns)
    subgraph(inputs, nodes, output)  and inside of one:
    delta0(input)                    delayed_feedback(schema, from)

A join's ``columns`` map its output; those of a stream_join, which joins the ticks'
values only, name the sides ``l`` and ``r``.  The nodes of a subgraph name its inputs
by the keys of ``inputs``.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators import aggregates, recursion
from tidewheel.streaming.circuit import Circuit, Stream
from tidewheel.zset import W, distinct, weighted


def _exprs(columns: dict[str, str]) -> list:
    return [F.expr(e).alias(n) for n, e in columns.items()]


def _constant(circuit: Circuit, f: dict[str, Any]) -> Stream:
    return circuit.add_constant(circuit.spark.createDataFrame([tuple(r) for r in f["rows"]], f["schema"]))


def _stream_join(f: dict[str, Any]):
    def run(a: DataFrame, b: DataFrame) -> DataFrame:
        out = a.alias("l").join(b.alias("r"), F.col(f"l.{f['left_on']}") == F.col(f"r.{f['right_on']}"))
        return out.select(*_exprs(f["columns"]), (F.col(f"l.{W}") * F.col(f"r.{W}")).alias(W))

    return run


def _fixpoint(f: dict[str, Any]):
    """Closure of SQL texts over the views ``input`` (and ``new`` in the step): columns as the seed's."""

    def run(df: DataFrame) -> DataFrame:
        edges = distinct(df).drop(W)
        seed = edges.sparkSession.sql(f["seed"], input=edges)
        step = lambda known, new: {"x": edges.sparkSession.sql(f["step"], input=edges, new=new["x"])}
        return weighted(recursion.fixpoint({"x": seed}, step)["x"])

    return run


def _fold(f: dict[str, Any]):
    names = ("acc", "value", "weight")

    def run(df: DataFrame) -> DataFrame:
        rows = aggregates.consolidated_values(df, f["keys"], F.expr(f["value"])).groupBy(*f["keys"]).agg(F.array_sort(F.collect_list(F.struct("__v", W))).alias("__all"))
        step = f["step"].replace("$acc", names[0]).replace("$value", "x.__v").replace("$weight", f"x.{W}")
        finish = f.get("finish", "$acc").replace("$acc", names[0])
        return rows.select(*f["keys"], F.expr(f"aggregate(__all, {f['zero']}, (acc, x) -> {step}, acc -> {finish})").alias(f["alias"]), F.lit(1).cast("bigint").alias(W))

    return run


def build(spark: SparkSession, graph: str | dict[str, Any]) -> Circuit:
    """The circuit of a graph; inputs are named by tables, outputs by sinks."""
    circuit = Circuit(spark)
    _add(circuit, (json.loads(graph) if isinstance(graph, str) else graph)["nodes"], {})
    return circuit


def _add(circuit: Circuit, nodes: dict[str, Any], made: dict[str, Stream]) -> dict[str, Stream]:
    """Adds the nodes to a circuit; ``made`` are streams that are there already."""
    connections: list[tuple[Any, Any]] = []

    def get(i: Any) -> Stream:
        return made[str(i)] if str(i) in made else make(str(i))

    def make(i: str) -> Stream:
        ((kind, f),) = nodes[i].items()
        made[i] = stream(kind, f)
        return made[i]

    def stream(kind: str, f: dict[str, Any]) -> Stream:
        if kind == "source":
            return circuit.add_input(f["table"], f["schema"])
        if kind == "source_map":
            return circuit.add_input_map(f["table"], f["schema"], f["keys"])
        if kind == "constant":
            return _constant(circuit, f)
        if kind == "delayed_feedback":
            back, connect = circuit.feedback(f["schema"])
            connections.append((connect, f["from"]))
            return back
        if kind == "subgraph":
            given = {name: get(i) for name, i in f["inputs"].items()}
            return circuit.nested(given, lambda child, streams: _add(child, f["nodes"], dict(streams))[f["output"]])
        if kind == "stream_join":
            return get(f["left"]).apply2(get(f["right"]), _stream_join(f))
        if kind == "monotonic_join":
            kind = "join"
        if kind in ("sum", "minus", "join", "antijoin", "semijoin", "outer_join_default"):
            if kind == "sum":
                first, *rest = [get(x) for x in f["inputs"]]
                return first.sum(rest)
            a, b = get(f["left"]), get(f["right"])
            if kind == "minus":
                return a.minus(b)
            if kind == "join":
                joined = a.join(b, f["on"], f.get("where"))
                return joined.map(*_exprs(f["columns"])) if "columns" in f else joined
            return getattr(a, kind)(b, f["on"])
        x = get(f["input"])
        if kind == "map":
            return x.map(*_exprs(f["columns"]))
        if kind == "filter":
            return x.filter(f["where"])
        if kind == "filter_map":
            return x.filter(f["where"]).map(*_exprs(f["columns"]))
        if kind == "flat_map":
            return x.flat_map(F.expr(f["items"]), f["alias"], *_exprs(f.get("columns", {})))
        if kind in ("min", "max"):
            of = aggregates.minimum if kind == "min" else aggregates.maximum
            return x.aggregate(f["keys"], lambda d: of(d, f["keys"], F.expr(f["value"]), f["alias"]))
        if kind == "fold":
            return x.aggregate(f["keys"], _fold(f))
        if kind == "aggregate_linear":
            return x.aggregate_linear(f["keys"], F.expr(f["value"]), f["alias"])
        if kind == "rolling":
            return x.rolling(f["partition"], f["ts"], {n: F.expr(e) for n, e in f["aggs"].items()}, f["from"], f["to"])
        if kind == "fixpoint":
            return x.recursive(_fixpoint(f))
        if kind in ("neg", "distinct", "integrate", "differentiate", "delay"):
            return getattr(x, kind)()
        if kind in ("sink", "export"):
            return x.output(f["name"])
        if kind in ("index_with", "index_by_column"):
            keys = f["keys"] if kind == "index_with" else [f["column"]]
            return x.apply(lambda d: d.repartition(*keys))
        if kind in ("unit_map_to_set", "delta0"):  # a map without values is its keys; a circuit's inputs come in the first round
            return x
        raise KeyError(f"unknown kind of node: {kind}")

    for i in nodes:
        get(i)
    for connect, i in connections:
        connect(get(i))
    return made
