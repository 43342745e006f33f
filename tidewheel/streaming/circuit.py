"""Incremental view maintenance: a graph of operators stepped with changes.

``Circuit`` builds streams; ``step`` takes the changes of the inputs at a tick and
returns the changes of the outputs, which added up give what the batch operator
gives on the added-up inputs.  Linear operators work on the change alone; joins
use Δ(A ⋈ B) = ΔA ⋈ (B + ΔB) + A ⋈ ΔB; linear aggregates keep one sum per key;
distinct, other aggregates and rolling aggregates recompute touched keys only;
``closure`` maintains a recursion by semi-naive rounds from what was inserted and
by deleting and deriving again, or the paths of a graph by its condensed form;
``recursive`` recomputes and differences.  Streams
of scalars (watermarks, bounds) live on the driver.

State is written (see :mod:`tidewheel.streaming.state`).  Whatever a stream keeps
from one tick to the next is saved and restored by ``save`` and ``load``: a circuit
that is built again and loaded goes on as if it had not stopped.

``nested`` runs a circuit of its own inside a tick, round by round, until nothing
changes; a feedback closes a cycle through the next tick or round.

A circuit runs in a plain loop or in Structured Streaming's foreachBatch (see
:mod:`tidewheel.streaming.host`).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.operators import inputs, joins, paths, recursion
from tidewheel.operators import timeseries as ts_ops
from tidewheel.session import is_empty
from tidewheel.streaming.state import Parts, StateTable, few_values, keys_match, part_of
from tidewheel.zset import W, consolidate, data_columns, neg, plus, sum_of, weighted


class Operator:
    """An operator of one's own: ``evaluate`` gets the values of its inputs at a tick.

    What it must remember goes into ``held`` (numbers, texts, tuples of them, or
    DataFrames): it is saved and restored with the circuit.  ``cut`` writes a
    DataFrame that is kept over the tick.
    """

    def __init__(self) -> None:
        self.held: dict[str, Any] = {}
        self.cut: Callable[[DataFrame], DataFrame] = lambda df: df

    def evaluate(self, *values: Any) -> Any:
        raise NotImplementedError

    def commit(self) -> None:
        """After all streams of the tick have their values."""


class Stream:
    """One value per tick: the change of a collection, or a scalar."""

    def __init__(self, circuit: Circuit, evaluate: Callable[[], Any], empty: DataFrame | None, after: Callable[[], None] | None = None, held: dict[str, Any] | None = None, kind: str = ""):
        self.circuit, self._evaluate, self.empty, self._after = circuit, evaluate, empty, after
        self.value: Any = None
        self.held = {} if held is None else held  # what is kept from tick to tick
        self.kind = kind or next(iter(self.held), "")  # by which it is found again
        self._state: StateTable | None = None
        circuit.nodes.append(self)

    # state

    def trace(self, keys: Sequence[str] = ()) -> StateTable:
        """The integral of the stream before this tick, shared by all that need it."""
        if self._state is None:
            self._state = StateTable(self.empty, self.circuit.parts, self.circuit.compact_every)
        if keys and not self._state.keys:
            self._state.keys = list(keys)
        return self._state

    def _cut(self, df: DataFrame) -> DataFrame:
        return self.circuit.parts.cut(df)

    def _tick(self) -> None:
        self.value = self._evaluate()
        if self._state is not None:
            self.value = self._cut(self.value)

    def _commit(self) -> None:
        if self._state is not None:
            self._state.add(self.value)
        if self._after:
            self._after()

    def _stream(self, evaluate: Callable[[], Any], empty: DataFrame | None, after: Callable[[], None] | None = None, held: dict[str, Any] | None = None) -> Stream:
        return Stream(self.circuit, evaluate, empty, after, held)

    # linear operators

    def apply(self, f: Callable[[DataFrame], DataFrame]) -> Stream:
        """A function of the tick's value; on changes it must be linear."""
        return self._stream(lambda: f(self.value), f(self.empty) if self.empty is not None else None)

    def apply_scalar(self, f: Callable[[Any], Any]) -> Stream:
        return self._stream(lambda: f(self.value), None)

    def stream_fold(self, init: Any, f: Callable[[Any, Any], Any]) -> Stream:
        """The running fold of a stream of scalars."""
        held = {"acc": init}

        def evaluate() -> Any:
            held["acc"] = f(held["acc"], self.value)
            return held["acc"]

        return self._stream(evaluate, None, None, held)

    def apply2(self, other: Stream, f: Callable[[DataFrame, DataFrame], DataFrame]) -> Stream:
        return self._stream(lambda: f(self.value, other.value), f(self.empty, other.empty))

    def filter(self, keep: Column | str) -> Stream:
        return self.apply(lambda d: d.where(keep))

    def map(self, *columns: Column | str) -> Stream:
        return self.apply(lambda d: d.select(*columns, W))

    def flat_map(self, items: Column, alias: str, *columns: Column | str) -> Stream:
        return self.apply(lambda d: d.select(*columns, F.explode(items).alias(alias), W))

    def neg(self) -> Stream:
        return self.apply(neg)

    def plus(self, other: Stream) -> Stream:
        return self.apply2(other, plus)

    def minus(self, other: Stream) -> Stream:
        return self.apply2(other, lambda a, b: plus(a, neg(b)))

    def sum(self, others: Sequence[Stream]) -> Stream:
        return self._stream(lambda: sum_of([self.value, *[o.value for o in others]]), self.empty)

    def consolidate(self) -> Stream:
        return self.apply(consolidate)

    # stateful operators

    def join(self, other: Stream, on: Sequence[str], residual: Column | str | None = None) -> Stream:
        a, b = self.trace(on), other.trace(on)
        pair = lambda x, y: joins.equi_join(x, y, on, residual)
        empty = pair(self.empty, other.empty)

        def evaluate() -> DataFrame:
            # What a side's change meets is read from the other side's state, as far as it shares keys.
            now = [pair(self.value, other.value)]
            if b.needed() and not is_empty(self.value):
                now.append(pair(self.value, b.touching(self.value, on, few_values(self.value, on[0]))))
            if a.needed() and not is_empty(other.value):
                now.append(pair(a.touching(other.value, on, few_values(other.value, on[0])), other.value))
            return sum_of([x.select(*empty.columns) for x in now])

        return self._stream(evaluate, empty)

    def range_join(self, other: Stream, lo: Column, hi: Column, key: str, width: float) -> Stream:
        """Pairs whose ``key`` (of the other side) lies in [lo, hi): joined by buckets of ``width``, see ``joins.range_join``."""
        bucket = lambda c: F.floor(c.cast("double") / width)
        a = self.apply(lambda d: d.withColumns({"__lo": lo.cast("double"), "__hi": hi.cast("double")}).where("__lo < __hi").withColumn("__b", F.explode(F.sequence(bucket(F.col("__lo")), bucket(F.col("__hi"))))))
        b = other.apply(lambda d: d.withColumn("__b", bucket(F.col(key))))
        return a.join(b, ["__b"], (F.col(key) >= F.col("__lo")) & (F.col(key) < F.col("__hi"))).apply(lambda d: d.drop("__b", "__lo", "__hi"))

    def distinct(self) -> Stream:
        state = self.trace(data_columns(self.empty))

        def evaluate() -> DataFrame:
            cols = data_columns(self.value)
            old = keys_match(state.touching(self.value, cols, few_values(self.value, cols[0])), self.value, cols).withColumn("__d", F.lit(0).cast("bigint"))
            new = self.value.withColumn("__d", F.col(W)).withColumn(W, F.lit(0).cast("bigint"))
            sums = old.unionByName(new).groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.sum(W).alias("__o"), F.sum("__d").alias("__d"))
            change = (F.col("__o") + F.col("__d") > 0).cast("bigint") - (F.col("__o") > 0).cast("bigint")
            return sums.withColumn(W, change).where(F.col(W) != 0).drop("__o", "__d")

        return self._stream(evaluate, self.empty)

    def antijoin(self, other: Stream, on: Sequence[str]) -> Stream:
        """A minus A joined with the distinct keys of B."""
        return self.minus(self.join(other.map(*on).distinct(), on).apply(lambda d: d.select(*self.empty.columns)))

    def semijoin(self, other: Stream, on: Sequence[str]) -> Stream:
        return self.join(other.map(*on), on).apply(lambda d: d.select(*self.empty.columns))

    def aggregate_linear(self, keys: Sequence[str], value: Column, alias: str, drop_zero: bool = True) -> Stream:
        """sum(value * weight) per key from the change alone: state is one sum and one weight per key.

        A key is there while the weights of its records do not add up to 0; with
        ``drop_zero`` it must also have a sum other than 0.
        """
        sums = lambda d: d.groupBy(*[F.col(k) for k in keys]).agg(F.sum(value * F.col(W)).alias(alias), F.sum(W).alias(W))
        partial = self.apply(sums)
        state = partial.trace(keys)
        state.merge = lambda d: d.groupBy(*[F.col(k) for k in keys]).agg(F.sum(alias).alias(alias), F.sum(W).alias(W))
        there = (F.col(W) != 0) & (F.col(alias) != 0) if drop_zero else F.col(W) != 0

        def evaluate() -> DataFrame:
            few = few_values(partial.value, keys[0]) if keys else None
            old = state.merge(keys_match(state.touching(partial.value, keys, few), partial.value, keys) if keys else state.read())
            new = state.merge(plus(old, partial.value))
            row = lambda d, w: d.where(there).select(*keys, alias, F.lit(w).cast("bigint").alias(W))
            return consolidate(plus(row(new, 1), row(old, -1)))

        return self._stream(evaluate, sums(self.empty).where("false"))

    def aggregate(self, keys: Sequence[str], f: Callable[[DataFrame], DataFrame]) -> Stream:
        """``f`` aggregates a consolidated collection per key; touched keys are done again and differenced."""
        state = self.trace(keys)

        def evaluate() -> DataFrame:
            few = few_values(self.value, keys[0]) if keys else None
            old = self._cut(consolidate(keys_match(state.touching(self.value, keys, few), self.value, keys)))
            new = consolidate(plus(old, self.value))
            return consolidate(plus(f(new), neg(f(old))))

        return self._stream(evaluate, f(self.empty))

    def outer_join_default(self, other: Stream, on: Sequence[str]) -> Stream:
        """Full outer join with defaults: both sides of touched keys are joined again."""
        a, b = self.trace(on), other.trace(on)
        f = joins.outer_join_default

        def evaluate() -> DataFrame:
            touched = self.value.select(*on).unionByName(other.value.select(*on))
            old_a, old_b = (consolidate(keys_match(s.read(), touched, on)) for s in (a, b))
            new_a, new_b = (consolidate(plus(s, d)) for s, d in ((old_a, self.value), (old_b, other.value)))
            return consolidate(plus(f(new_a, new_b, on), neg(f(old_a, old_b, on))))

        return self._stream(evaluate, f(self.empty, other.empty, on))

    def integrate(self) -> Stream:
        """The whole collection instead of its change."""
        state = self.trace()
        return self._stream(lambda: consolidate(plus(state.read(), self.value)), self.empty)

    def differentiate(self) -> Stream:
        """The change between the whole collections of two ticks."""
        held: dict[str, Any] = {"whole": None}

        def evaluate() -> DataFrame:
            held["next"] = self._cut(self.value)
            return consolidate(plus(held["next"], neg(held["whole"] if held["whole"] is not None else self.empty)))

        return self._stream(evaluate, self.empty, lambda: held.update(whole=held.pop("next")), held)

    def delay(self) -> Stream:
        """The value of the tick before; nothing at first."""
        held: dict[str, Any] = {"last": None}
        return self._stream(lambda: self.empty if held["last"] is None else held["last"], self.empty, lambda: held.update(last=self._cut(self.value)), held)

    # time series

    def watermark(self, ts: str, lag: int, start: int = 0) -> Stream:
        """Largest time seen less the lag; never falls."""
        held = {"mark": start}

        def evaluate() -> int:
            held["mark"] = ts_ops.watermark(self.value, ts, lag, held["mark"])
            return held["mark"]

        return self._stream(evaluate, None, None, held)

    def window(self, ts: str, bounds: Stream) -> Stream:
        """Changes of the contents of [lo, hi), whose ends never fall; rows below lo are too late."""
        state, held = self.trace(), {"at": (0, 0)}

        def evaluate() -> DataFrame:
            (lo0, hi0), (lo, hi) = held["at"], bounds.value
            old, t = state.read(), F.col(ts)
            leave = neg(old.where((t >= lo0) & (t < min(lo, hi0))))
            enter = old.where((t >= max(hi0, lo)) & (t < hi))
            return sum_of([leave, enter, self.value.where((t >= lo) & (t < hi))])

        def after() -> None:
            held["at"] = bounds.value
            state.keep_from(ts, bounds.value[0])

        return self._stream(evaluate, self.empty, after, held)

    def rolling(self, partition: Sequence[str], ts: str, aggs: Mapping[str, Column], from_: int, to: int, mark: Stream | None = None) -> Stream:
        """Rolling aggregates per (partition, ts); with a watermark late rows are ignored and state is bounded.

        Aggregates are expressions over rows with a weight column, such as
        sum(v * __w).  Only outputs whose range a changed row falls into are done
        again: times t with t + from_ <= changed <= t + to, and the changed time itself.
        """
        source = self
        if mark is not None:
            held = {"floor": None}

            def on_time() -> DataFrame:
                return self.value if held["floor"] is None else self.value.where(F.col(ts) >= held["floor"] - (to - from_))

            source = self._stream(on_time, self.empty, lambda: held.update(floor=mark.value), held)
        state = source.trace()
        span = to - from_

        def once(rows: DataFrame) -> DataFrame:
            return ts_ops.rolling(rows.where(F.col(W) > 0), partition, ts, aggs, from_, to)

        def evaluate() -> DataFrame:
            def touched(margin: int) -> DataFrame:
                """Disjoint ranges of time per partition: a changed row concerns the outputs whose range it falls into, and the one at its own time."""
                spans = source.value.select(*partition, (F.col(ts) - max(to, 0) - margin).alias("__lo"), (F.col(ts) - min(from_, 0) + margin).alias("__hi")).distinct()
                before = Window.partitionBy(*partition).orderBy("__lo").rowsBetween(Window.unboundedPreceding, -1)
                so_far = Window.partitionBy(*partition).orderBy("__lo").rowsBetween(Window.unboundedPreceding, 0)
                fresh = F.when(F.col("__lo") <= F.max("__hi").over(before), 0).otherwise(1)
                runs = spans.withColumn("__new", fresh).withColumn("__run", F.sum("__new").over(so_far))
                return runs.groupBy(*partition, "__run").agg(F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi")).drop("__run").withColumnsRenamed({p: f"__p_{p}" for p in partition})

            cond = [F.col(p).eqNullSafe(F.col(f"__p_{p}")) for p in partition]

            def cut(rows: DataFrame, margin: int) -> DataFrame:
                near = F.col(ts).between(F.col("__lo"), F.col("__hi"))
                return rows.join(touched(margin), [*cond, near]).drop("__lo", "__hi", *[f"__p_{p}" for p in partition])

            old = self._cut(consolidate(cut(state.read(), span + abs(from_) + abs(to))))
            new = consolidate(plus(old, source.value))
            change = consolidate(plus(weighted(once(new)), neg(weighted(once(old)))))
            return cut(change, 0)

        def after() -> None:
            if mark is not None:
                state.keep_from(ts, mark.value - 2 * span)

        return self._stream(evaluate, weighted(once(self.empty)), after)

    def recursive(self, f: Callable[[DataFrame], DataFrame]) -> Stream:
        """Change of f(whole collection), for any fixed point f: computed anew and differenced (see ``closure``)."""
        return self.integrate().apply(f).differentiate()

    def recursive2(self, other: Stream, f: Callable[[DataFrame, DataFrame], DataFrame]) -> Stream:
        """As ``recursive``, of two inputs."""
        return self.integrate().apply2(other.integrate(), f).differentiate()

    def closure(self, edges: Stream, step: Callable[[DataFrame, DataFrame], DataFrame], max_rounds: int = 1000, chain: tuple[str, str] | None = None, whole: bool = False) -> Stream:
        """Change of the least set X = self + step(X, edges), where ``step`` is linear in both (a join and a projection).

        Inserts go on from what is new.  Deletes first take out all that was derived
        through what is gone, then derive again what still has another derivation.
        Both inputs are taken as sets; ``step`` gets them without weights and must
        give the columns of ``self``.  For ``chain`` see ``recursion.maintain``.

        With ``chain`` the closure of a stream over itself is kept as its condensed
        graph for as long as its edges fit one task (``paths``): a tick condenses the
        edges anew, and the change is what one graph has and the other has not.

        ``whole`` gives all of X after each tick in place of its change.
        """
        seeds, links = self.distinct(), edges.distinct()
        seed_state, link_state = seeds.trace(), links.trace()
        cols = data_columns(self.empty)
        own = chain is not None and edges is self and tuple(cols) == tuple(chain)
        held: dict[str, Any] = {"known": None, "graph": None}

        def evaluate() -> DataFrame:
            known, graph = held["known"], held["graph"]
            if own and known is None:
                now = self._cut(consolidate(plus(link_state.read(), links.value))).drop(W)
                if paths.fits(now):
                    held["next"] = None, self._cut(paths.condensed(now))
                    return paths.change(None if whole else graph, held["next"][1], chain)
                if graph is not None:
                    known = self._cut(paths.change(None, graph, chain).select(*cols))
            known = known if known is not None else self.empty.drop(W)
            after, gained, lost = recursion.maintain(
                known, consolidate(seed_state.read()).drop(W), seeds.value, consolidate(link_state.read()).drop(W), links.value, step, self._cut, max_rounds, chain,
            )
            held["next"] = after, None
            return weighted(after) if whole else plus(weighted(gained), weighted(lost, -1))

        def after() -> None:
            held["known"], held["graph"] = held.pop("next")

        return self._stream(evaluate, self.empty, after, held)

    def inspect(self, f: Callable[[Any], None]) -> Stream:
        """Calls f with each value; the stream goes on unchanged."""

        def evaluate() -> Any:
            f(self.value)
            return self.value

        return self._stream(evaluate, self.empty)

    def output(self, name: str) -> Stream:
        self.circuit.outputs[name] = self
        return self


class Circuit:
    """Inputs, operators and outputs; stepped tick by tick."""

    def __init__(self, spark: SparkSession, compact_every: int = 8):
        self.spark, self.compact_every = spark, compact_every
        self.parts = Parts(spark)
        self.nodes: list[Stream] = []
        self.inputs: dict[str, dict[str, Any]] = {}
        self.outputs: dict[str, Stream] = {}
        self.ticks = 0

    def _empty(self, schema: str) -> DataFrame:
        return weighted(self.spark.createDataFrame([], schema))

    def add_input(self, name: str, schema: str) -> Stream:
        """Changes with weights (1 where none are given)."""
        slot = self.inputs[name] = {"empty": self._empty(schema), "rows": None}
        return Stream(self, lambda: slot["empty"] if slot["rows"] is None else weighted(slot["rows"]).select(*slot["empty"].columns), slot["empty"])

    def add_input_set(self, name: str, schema: str) -> Stream:
        """Commands (columns, insert boolean, seq): duplicate inserts and idle deletes do nothing."""
        slot = self.inputs[name] = {"empty": self._empty(schema), "rows": None}
        cols = data_columns(slot["empty"])
        return self._table(slot, lambda state, rows: inputs.set_delta(state, rows, cols))

    def add_input_map(self, name: str, schema: str, keys: Sequence[str]) -> Stream:
        """Commands (columns, delete boolean, seq): the last per key overwrites or deletes."""
        slot = self.inputs[name] = {"empty": self._empty(schema), "rows": None}
        values = [c for c in data_columns(slot["empty"]) if c not in keys]
        return self._table(slot, lambda state, rows: inputs.map_delta(state, rows, keys, values))

    def _table(self, slot: dict[str, Any], delta: Callable[[DataFrame, DataFrame], DataFrame]) -> Stream:
        stream = Stream(self, lambda: slot["empty"], slot["empty"])
        state = stream.trace()
        stream._evaluate = lambda: slot["empty"] if slot["rows"] is None else delta(state.read(), slot["rows"]).select(*slot["empty"].columns)
        return stream

    def add_scalar(self, name: str, default: Any = None) -> Stream:
        """A scalar per tick; the default where none is given."""
        slot = self.inputs[name] = {"rows": None}
        return Stream(self, lambda: default if slot["rows"] is None else slot["rows"], None)

    def add_generator(self, f: Callable[[int], DataFrame], schema: str) -> Stream:
        """A source that makes its change from the number of the tick."""
        empty = self._empty(schema)
        return Stream(self, lambda: weighted(f(self.ticks)).select(*empty.columns), empty)

    def add_constant(self, rows: DataFrame) -> Stream:
        """A collection that is there from the first tick on: its rows at the first tick, no change afterwards."""
        whole = consolidate(weighted(rows))
        empty = whole.where("false")
        return Stream(self, lambda: whole if self.ticks == 0 else empty, empty)

    def feedback(self, schema: str) -> tuple[Stream, Callable[[Stream], None]]:
        """A stream that repeats, a tick later, what is connected to it: the way to close a cycle."""
        empty = self._empty(schema)
        held: dict[str, Any] = {"fed": None}
        stream = Stream(self, lambda: empty if held["fed"] is None else held["fed"], empty, None, held)

        def connect(of: Stream) -> None:
            stream._after = lambda: held.update(fed=self.parts.cut(of.value.select(*empty.columns)))

        return stream, connect

    def operator(self, op: Operator, inputs: Sequence[Stream], empty: DataFrame | None) -> Stream:
        """A stream of an operator of one's own, of any number of inputs; ``empty`` has the columns of its changes."""
        op.cut = self.parts.cut
        return Stream(self, lambda: op.evaluate(*[i.value for i in inputs]), empty, op.commit, op.held, "operator")

    def nested(self, inputs: Mapping[str, Stream], build: Callable[[Nested, dict[str, Stream]], Stream], max_rounds: int = 1000) -> Stream:
        """A circuit inside a tick: its inputs bring the tick's values in the first round, and nothing afterwards.

        ``build`` makes it and returns its result.  Rounds go on until the result of a
        round is empty; the stream's value is the sum over the rounds.
        """
        child = Nested(self, inputs)
        result = build(child, {name: child.entries[name] for name in inputs})

        def evaluate() -> DataFrame:
            return child.run({name: s.value for name, s in inputs.items()}, result, max_rounds)

        stream = Stream(self, evaluate, result.empty, None, child.held, "nested")
        return stream

    def push(self, name: str, rows: DataFrame | Sequence[tuple]) -> None:
        """Puts rows into the buffer of an input; the next step takes all that was pushed.

        Tuples have the columns of the input, and its weight behind them if one is given.
        """
        slot = self.inputs[name]
        if not isinstance(rows, DataFrame):
            empty = slot["empty"]
            given = [tuple(r) if len(r) == len(empty.columns) else (*r, 1) for r in rows]
            rows = self.spark.createDataFrame(given, empty.schema)
        slot.setdefault("buffer", []).append(rows)

    def step(self, **changes: Any) -> dict[str, Any]:
        """One tick: changes of the inputs in, changes of the outputs out."""
        unknown = set(changes) - set(self.inputs)
        if unknown:
            raise KeyError(f"no such inputs: {sorted(unknown)}")
        for name, slot in self.inputs.items():
            pushed = slot.pop("buffer", [])
            given = changes.get(name)
            if pushed and given is not None:
                pushed.append(given)
            slot["rows"] = sum_of([weighted(d) for d in pushed]) if pushed and "empty" in slot and len(pushed) + (given is not None) > 1 else pushed[0] if pushed else given
        return self._run()

    def _run(self) -> dict[str, Any]:
        for node in self.nodes:
            node._tick()
        out = {name: self.parts.hand_out(s.value) if isinstance(s.value, DataFrame) else s.value for name, s in self.outputs.items()}
        for node in self.nodes:
            node._commit()
        self.parts.sweep(self._needed())
        self.ticks += 1
        return out

    def _needed(self) -> set[str]:
        parts = {part_of(v) for n in self.nodes for v in n.held.values()}
        return parts.union(*[s.needed() for s in self._states()]) - {""}

    def _states(self) -> list[StateTable]:
        return [n._state for n in self.nodes if n._state is not None]

    def save(self, folder: str) -> None:
        """Writes all that is kept between ticks; the list of it comes last, so a folder with one is complete."""
        for i, s in enumerate(self._states()):
            s.save(f"{folder}/state-{i}")
        held: dict[str, dict[str, Any]] = {}
        for label, n in self._keepers():
            kept = held[label] = {}
            for name, v in n.held.items():
                if isinstance(v, DataFrame):
                    v.write.mode("overwrite").parquet(f"{folder}/{label}-{name}")
                    kept[name] = {"frame": True}
                else:
                    kept[name] = {"tuple": isinstance(v, tuple), "value": v}
        note = json.dumps({"ticks": self.ticks, "held": held, "bounds": [s.bound for s in self._states()]})
        self.spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/kept")

    def load(self, folder: str) -> None:
        """Restores what ``save`` wrote into a circuit that was built in the same way.

        States are found by their order, kept values by the kind of operator and its
        order among those of the kind; one without a saved value is an error.
        """
        note = json.loads(self.spark.read.text(f"{folder}/kept").first()[0])
        self.ticks = note["ticks"]
        for i, (s, bound) in enumerate(zip(self._states(), note["bounds"], strict=True)):
            s.load(self.spark, f"{folder}/state-{i}")
            s.bound = tuple(bound) if bound else None
        for label, n in self._keepers():
            for name, v in note["held"][label].items():
                n.held[name] = self.spark.read.parquet(f"{folder}/{label}-{name}") if "frame" in v else tuple(v["value"]) if v["tuple"] else v["value"]

    def _keepers(self) -> list[tuple[str, Stream]]:
        """Streams that keep values, labelled."""
        seen: dict[str, int] = {}
        out = []
        for n in self.nodes:
            if n.kind:
                seen[n.kind] = seen.get(n.kind, 0) + 1
                out.append((f"{n.kind}-{seen[n.kind]}", n))
        return out


class Nested(Circuit):
    """A circuit whose ticks are the rounds inside a tick of another one.

    Its integrals, delays and feedbacks start anew at each tick of the outer circuit;
    ``delay_nested`` and ``integrate_nested`` go on from tick to tick, round by round.
    """

    def __init__(self, outer: Circuit, inputs: Mapping[str, Stream]):
        super().__init__(outer.spark, outer.compact_every)
        self.parts = outer.parts
        self.held: dict[str, Any] = {}  # saved with the outer circuit
        self.across: list[tuple[str, DataFrame]] = []
        self.entries: dict[str, Stream] = {}
        for name, s in inputs.items():
            slot = self.inputs[name] = {"empty": s.empty, "rows": None}
            self.entries[name] = Stream(self, (lambda slot: lambda: slot["empty"] if slot["rows"] is None else slot["rows"])(slot), s.empty)

    def _round_of(self, prefix: str, empty: DataFrame) -> DataFrame:
        got = self.held.get(f"{prefix}{self.ticks}")
        return empty if got is None else got

    def delay_nested(self, of: Stream) -> Stream:
        """The value of the same round in the outer tick before."""
        prefix = f"delay{len(self.across)}_"
        self.across.append((prefix, of.empty))

        def evaluate() -> DataFrame:
            return self._round_of(prefix, of.empty)

        return Stream(self, evaluate, of.empty, lambda: self.held.update({f"{prefix}{self.ticks}": self.parts.cut(of.value)}))

    def integrate_nested(self, of: Stream) -> Stream:
        """The sum of the values of the same round over all outer ticks."""
        prefix = f"sum{len(self.across)}_"
        self.across.append((prefix, of.empty))
        now: dict[str, DataFrame] = {}

        def evaluate() -> DataFrame:
            now["sum"] = self.parts.cut(consolidate(plus(self._round_of(prefix, of.empty), of.value)))
            return now["sum"]

        return Stream(self, evaluate, of.empty, lambda: self.held.update({f"{prefix}{self.ticks}": now["sum"]}))

    def run(self, values: Mapping[str, DataFrame], result: Stream, max_rounds: int) -> DataFrame:
        self.ticks = 0
        for n in self.nodes:
            if n._state is not None:
                n._state.reset()
            for k in n.held:
                n.held[k] = None
        found = []
        for i in range(max_rounds):
            for name, slot in self.inputs.items():
                slot["rows"] = values[name] if i == 0 else None
            for node in self.nodes:
                node._tick()
            out = self.parts.cut(result.value)
            for node in self.nodes:
                node._commit()
            self.ticks += 1
            if is_empty(out):
                return sum_of(found) if found else result.empty
            found.append(out)
        raise RuntimeError(f"a nested circuit did not come to rest in {max_rounds} rounds")
