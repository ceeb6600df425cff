"""Data flow over tables of facts: what reaches which definition, through kills, loops and calls.

A function's events lie at positions. A definition reads a class of variables at one position and gives a class a value at
another; a kill ends the values of a class. A state is a class and the position of the definition that gave it a value (or
ENTRY). A read sees a state if

- the read comes after it and no kill of the class lies between them, or
- both lie in one loop, no kill lies between the state and the loop's end, and none between the loop's head and the read,
- or the read is that of an initializer (a position below 0), which sees every state.

No state is paired with the reads that see it. States and reads of a class fall into segments between kills; within a
segment what a read sees from before is a running aggregate in the order of positions. What goes round a loop is one
aggregate a loop and class, which the reads at the loop's head take over. Which loops hold a position is found by a join of
buckets of positions, so large loops meet only what lies in them.

Values spread in one pass: all facts meet by function in one exchange, and a task follows one function after the other,
each to its end, with a small work list. A function of more than ``SMALL`` facts is not held in a task: those go by rounds
of joins, semi-naively. A round follows only what is new since the last one, and functions with nothing new are put aside,
so a round costs what its open functions have. Every table has a column ``fn``, so all functions of all programs are
followed at once.

Tables (further columns are ignored): defs (fn, cls, read, target, defined), kills (fn, cls, pos), loops (fn, head, end),
sinks (fn, cls, read, token), seeds (fn, cls, pos and the value). Null functions, classes or positions are no facts.
"""

from __future__ import annotations

import operator
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from trialweave.operators.graph import _kept

ENTRY, BEFORE, AFTER = -1, -(1 << 62), 1 << 62
BUCKET = 512
#: Facts of a function that one task follows by itself; larger functions go by rounds.
SMALL = 4096
DEF, KILL, LOOP, SEED = range(4)
#: Bits of one mask; seeds beyond have further masks, numbered by ``block``.
BITS = 62
AT, STATE = ["fn", "cls", "pos"], ["fn", "block", "cls", "pos"]


@dataclass(frozen=True)
class Values:
    """How values meet: their union, and what of a new value an old one lacks (null: nothing); ``join`` is the union of two in Python."""

    merge: Callable[[Column], Column]
    both: Callable[[Column, Column], Column]
    news: Callable[[Column, Column], Column]
    join: Callable[[int, int], int]


#: The least label that reaches a state.
LABELS = Values(F.min, F.least, lambda old, new: F.when(old.isNull() | (new < old), new), min)
#: The set of seeds that reach a state, as bits.
MASKS = Values(F.bit_or, lambda a, b: F.coalesce(a, F.lit(0)).bitwiseOR(F.coalesce(b, F.lit(0))), lambda old, new: F.nullif(new.bitwiseAND(F.bitwise_not(F.coalesce(old, F.lit(0)))), F.lit(0)), operator.or_)


def known(df: DataFrame, *cols: str) -> DataFrame:
    """The columns of the facts that hold no null."""
    return df.select(*cols).where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))


def between_kills(rows: DataFrame, kills: DataFrame, pos: str) -> DataFrame:
    """``rows`` (fn, cls and ``pos``) with the kills of the class around each position: columns since and until."""
    events = rows.withColumn("__kill", F.lit(None).cast("long")).unionByName(known(kills, *AT).select("fn", "cls", F.col("pos").cast("long").alias(pos), F.col("pos").cast("long").alias("__kill")), allowMissingColumns=True)
    w = Window.partitionBy("fn", "cls").orderBy(pos)
    since = F.last("__kill", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    until = F.first("__kill", ignorenulls=True).over(w.rangeBetween(1, Window.unboundedFollowing))
    out = events.withColumn("since", F.coalesce(since, F.lit(BEFORE))).withColumn("until", F.coalesce(until, F.lit(AFTER)))
    return out.where("__kill is null").drop("__kill")


def holding(rows: DataFrame, loops: DataFrame, pos: str) -> DataFrame:
    """``rows`` once for each loop that holds their position, with its head and end."""
    bucket = lambda c: F.floor(c / BUCKET)
    parts = known(loops, "fn", "head", "end").distinct().withColumn("__b", F.explode(F.sequence(bucket(F.col("head")), bucket(F.col("end")))))
    return rows.withColumn("__b", bucket(F.col(pos))).join(parts, ["fn", "__b"]).where((F.col(pos) >= F.col("head")) & (F.col(pos) <= F.col("end"))).drop("__b")


def followed(facts: list[tuple], join: Callable[[int, int], int]) -> dict[tuple, int]:
    """The values of all states of one function, {(block, cls, pos): value}, from its facts (kind, cls, p, q, target, block, value)."""
    defs, kills, loops, have = defaultdict(list), defaultdict(list), set(), {}
    for kind, cls, p, q, target, block, value in facts:
        if kind == DEF:
            defs[cls].append((p, target, q))
        elif kind == KILL:
            kills[cls].append(p)
        elif kind == LOOP:
            loops.add((p, q))
        else:
            have[block, cls, p] = join(have[block, cls, p], value) if (block, cls, p) in have else value
    for of in (*defs.values(), *kills.values()):
        of.sort()
    reads = {cls: [r for r, _, _ in ds] for cls, ds in defs.items()}
    onward = {}

    def nexts(cls, pos) -> set[tuple]:
        """The states that definitions give which see this one: its segment's reads after it, those at the head of a loop that it goes round, initializers."""
        rs, ds, ks = reads.get(cls), defs.get(cls), kills.get(cls, ())
        if rs is None:
            return set()
        k = bisect_right(ks, pos)
        until = ks[k] if k < len(ks) else AFTER
        seen = [*ds[: bisect_left(rs, 0)], *ds[bisect_right(rs, pos) : bisect_left(rs, until)]]
        if pos >= 0:
            for head, end in loops:
                if head <= pos <= end < until:
                    k = bisect_left(ks, head)
                    seen += ds[bisect_left(rs, max(head, 0)) : bisect_left(rs, min(end + 1, ks[k]) if k < len(ks) else end + 1)]
        return {(target, defined) for _, target, defined in seen}

    todo = list(have)
    while todo:
        at = block, cls, pos = todo.pop()
        value = have[at]
        if (cls, pos) not in onward:
            onward[cls, pos] = nexts(cls, pos)
        for to in onward[cls, pos]:
            to = (block, *to)
            old = have.get(to)
            new = value if old is None else join(old, value)
            if new != old:
                have[to] = new
                todo.append(to)
    return have


def _follow(join: Callable[[int, int], int], small: int, schema: pa.Schema):
    """The function of a task over facts sorted by ``fn``: states with their values, or a row without a block for a function of too many facts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, fn, mine, n = [], None, [], 0

        def close():
            if n > small:
                out.append((fn, None, None, None, None))
            elif n:
                out.extend((fn, *at, value) for at, value in followed(mine, join).items())

        def given():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for f, *fact in zip(*cols, strict=True):
                if f != fn:
                    close()
                    fn, mine, n = f, [], 0
                n += 1
                if n <= small:
                    mine.append(fact)
            if len(out) > 20_000:
                yield given()
                out.clear()
        close()
        if out:
            yield given()

    return run


@dataclass
class Flow:
    """The facts of all functions, prepared: reads and states with their segments, and the loops that they go round."""

    defs: DataFrame
    kills: DataFrame
    loops: DataFrame
    sinks: DataFrame

    @cached_property
    def reads(self) -> DataFrame:
        d = known(self.defs, "fn", "cls", "read", "target", "defined").withColumn("token", F.lit(None).cast("long"))
        s = known(self.sinks, "fn", "cls", "read", "token").select("fn", "cls", "read", F.lit(None).cast(d.schema["target"].dataType).alias("target"), F.lit(None).cast("long").alias("defined"), "token")
        both = d.unionByName(s).withColumn("read", F.col("read").cast("long")).withColumn("defined", F.col("defined").cast("long")).distinct()
        return _kept(between_kills(both, self.kills, "read"))

    @cached_property
    def front(self) -> DataFrame:
        """The reads that a loop's head reaches without a kill on the way."""
        return _kept(holding(self.reads.where("read >= 0"), self.loops, "read").where(F.col("since") < F.col("head")))

    def placed(self, states: DataFrame) -> DataFrame:
        """States with the kills around them."""
        return between_kills(states.withColumn("pos", F.col("pos").cast("long")), self.kills, "pos")

    def around(self, states: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All states that may be reached from ``states`` with the kills around them, and the loops that each goes round; once for all rounds."""
        given = self.reads.where("target is not null").select("fn", F.col("target").alias("cls"), F.col("defined").alias("pos"))
        places = _kept(self.placed(states.select(*AT).unionByName(given).distinct()))
        return places, _kept(holding(places.where("pos >= 0"), self.loops, "pos").where(F.col("until") > F.col("end")).select(*AT, "head", "end"))

    def seen(self, fresh: DataFrame, values: Values, sinks: bool, around: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        """Reads (all of ``sinks``, or else of definitions) with the union of the values of the ``fresh`` states that they see."""
        mine = lambda df: df.where(F.col("token").isNotNull() if sinks else F.col("target").isNotNull())
        what = ["fn", "cls", "read", "target", "defined", "token"]
        places, loops = around or self.around(fresh)
        now = fresh.join(places, AT)
        segment = ["fn", "cls", "since"]
        asked = mine(self.reads).join(now.select(*segment, "block").distinct(), segment).select(*what, "since", "block", F.lit(None).cast("long").alias("value"), F.col("read").alias("at"))
        told = now.select("fn", "cls", "since", "block", F.col("value").cast("long").alias("value"), F.col("pos").alias("at"))
        w = Window.partitionBy("fn", "block", "cls", "since").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
        after = asked.unionByName(told, allowMissingColumns=True).withColumn("value", values.merge(F.col("value")).over(w)).where("read is not null")
        back = fresh.join(loops, AT).groupBy("fn", "block", "cls", "head", "end").agg(values.merge(F.col("value")).alias("value"))
        again = mine(self.front).join(back, ["fn", "cls", "head", "end"])
        every = fresh.groupBy("fn", "block", "cls").agg(values.merge(F.col("value")).alias("value"))
        first = mine(self.reads).where("read < 0").join(every, ["fn", "cls"])
        out = [df.select(*what, "block", "value") for df in (after, again, first)]
        return reduce(DataFrame.unionByName, out).where("value is not null").groupBy(*what, "block").agg(values.merge(F.col("value")).alias("value"))

    def spread(self, seeds: DataFrame, values: Values, budget: int | None = None) -> DataFrame | None:
        """(fn, block, cls, pos, value) of every state that the seeds (same columns) reach; None where the budget of rounds ends first.

        A budget asks for rounds, so all functions go by them.
        """
        if budget is not None:
            return self._by_rounds(seeds, values, budget)
        long = lambda c: (F.col(c) if isinstance(c, str) else F.lit(c)).cast("long")
        cls = known(self.defs, "fn", "cls", "read", "target", "defined").schema["target"].dataType
        fact = lambda df, kind, c, p, q=None, target=None, block=None, value=None: df.select("fn", F.lit(kind).alias("kind"), (F.col(c) if c else F.lit(None)).cast(cls).alias("cls"), long(p).alias("p"), long(q).alias("q"), (F.col(target) if target else F.lit(None)).cast(cls).alias("target"), long(block).alias("block"), long(value).alias("value"))
        facts = [
            fact(known(self.defs, "fn", "cls", "read", "target", "defined"), DEF, "cls", "read", "defined", "target"), fact(known(self.kills, *AT), KILL, "cls", "pos"),
            fact(known(self.loops, "fn", "head", "end"), LOOP, None, "head", "end"), fact(seeds, SEED, "cls", "pos", block="block", value="value"),
        ]
        given = reduce(DataFrame.unionByName, facts).repartition("fn").sortWithinPartitions("fn")
        schema = seeds.sparkSession.createDataFrame([], seeds.select("fn").schema).select("fn", F.lit(None).cast("long").alias("block"), F.lit(None).cast(cls).alias("cls"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("long").alias("value")).schema
        out = _kept(given.mapInArrow(_follow(values.join, SMALL, to_arrow_schema(schema)), schema))
        large = out.where("block is null").select("fn")
        small = out.where("block is not null").withColumn("block", F.col("block").cast(seeds.schema["block"].dataType))
        if large.isEmpty():
            return small.select(*STATE, "value")
        only = lambda df: df.join(large, "fn", "left_semi")
        rest = Flow(only(self.defs), only(self.kills), only(self.loops), only(self.sinks))
        return small.select(*STATE, "value").unionByName(rest._by_rounds(only(seeds), values, None).select(*STATE, "value"))

    def _by_rounds(self, seeds: DataFrame, values: Values, budget: int | None) -> DataFrame | None:
        open_ = _kept(seeds.groupBy(*STATE).agg(values.merge(F.col("value")).alias("value")).withColumn("new", F.col("value")))
        done, rounds, around = [], 0, self.around(seeds)
        while True:
            fresh = open_.where("new is not null").select(*STATE, F.col("new").alias("value"))
            if fresh.isEmpty():
                return reduce(DataFrame.unionByName, [*done, open_.select(*STATE, "value")])
            if budget is not None and rounds >= budget:
                return None
            rounds += 1
            sent = self.seen(fresh, values, False, around).groupBy("fn", "block", F.col("target").alias("cls"), F.col("defined").alias("pos")).agg(values.merge(F.col("value")).alias("sent"))
            merged = open_.select(*STATE, "value").join(sent, STATE, "full")
            merged = merged.withColumn("new", F.when(F.col("sent").isNotNull(), values.news(F.col("value"), F.col("sent"))))
            merged = merged.withColumn("value", F.when(F.col("sent").isNull(), F.col("value")).otherwise(values.both(F.col("value"), F.col("sent"))))
            # A function with nothing new is done: it leaves the rounds with what it has.
            live = F.max(F.col("new").isNotNull()).over(Window.partitionBy("fn"))
            merged = _kept(merged.select(*STATE, "value", "new").withColumn("live", live))
            done.append(merged.where("not live").select(*STATE, "value"))
            open_ = merged.where("live").drop("live")


def reach_labels(flow: Flow, seeds: DataFrame, budget: int | None = None) -> DataFrame | None:
    """(fn, cls, pos, label): the least label of ``seeds`` (fn, cls, pos, label) that reaches each state."""
    start = known(seeds, *AT, "label").select("fn", F.lit(0).alias("block"), "cls", F.col("pos").cast("long").alias("pos"), F.col("label").cast("long").alias("value"))
    out = flow.spread(start, LABELS, budget)
    return None if out is None else out.select(*AT, F.col("value").alias("label"))


def reach_masks(flow: Flow, seeds: DataFrame, budget: int | None = None) -> DataFrame | None:
    """(fn, cls, pos, port): every port of ``seeds`` (fn, cls, pos, port from 0) with the states that it reaches, all ports at once."""
    masks = spread_masks(flow, seeds, budget)
    return None if masks is None else with_ports(masks).select(*AT, "port")


def spread_masks(flow: Flow, seeds: DataFrame, budget: int | None = None) -> DataFrame | None:
    start = known(seeds, *AT, "port").select("fn", F.floor(F.col("port") / BITS).cast("int").alias("block"), "cls", F.col("pos").cast("long").alias("pos"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("port", F.lit(BITS)).cast("int")).alias("value"))
    return flow.spread(start, MASKS, budget)


def with_ports(masks: DataFrame) -> DataFrame:
    """Rows with a mask (block, value) once for each port in it."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit("value", i) == 1)
    return masks.withColumn("__bit", F.explode(bits)).withColumn("port", (F.col("block") * BITS + F.col("__bit")).cast("long")).drop("__bit", "block", "value")


def violations(flow: Flow, labels: DataFrame) -> DataFrame:
    """(fn, read, label, token): the first sink of each function that sees a reached state, with the least label there."""
    states = labels.select("fn", F.lit(0).alias("block"), "cls", "pos", F.col("label").alias("value"))
    return flow.seen(states, LABELS, True).groupBy("fn").agg(F.min(F.struct("read", F.col("value").alias("label"), "token")).alias("v")).select("fn", "v.*")


# Calls. Ports have numbers: INPUT is 0, parameters and the like are 1 and up; RET and SINK are only ever flowed into.
INPUT, SINK, RET = 0, -1, -2


@dataclass(frozen=True)
class Calls:
    """The facts of calls.

    ports (fn, port, cls, out): a function's ports, out if what it gives them comes back; RET's has port -2.
    calls (fn, at, callee): at is the position of the call's reads; its kills are at + 1, its definitions at + 2.
    args (fn, at, callee, port, cls, read): a class that the caller gives to the callee's port, and where it is read.
    actuals (fn, at, callee, port, cls): the class that comes back through the callee's port.
    results (fn, at, target, defined): the definitions whose value is the call's result.
    """

    ports: DataFrame
    calls: DataFrame
    args: DataFrame
    actuals: DataFrame
    results: DataFrame


@dataclass(frozen=True)
class Summaries:
    """What functions do: kills (fn, port), flows (fn, source, sink); and how many functions each round looked at."""

    kills: DataFrame
    flows: DataFrame
    rounds: tuple[int, ...]


def _worklist(calls: Calls, step: Callable[[DataFrame, DataFrame], DataFrame], known_rows: DataFrame, budget: int | None) -> tuple[DataFrame, tuple[int, ...]]:
    """Rerun ``step`` for the callers of what changed until nothing does. ``step(todo, rows)`` gives the rows of the functions ``todo``."""
    edges = _kept(calls.calls.select("fn", "callee").distinct())
    todo, rows, looked = _kept(edges.select(F.col("callee").alias("fn")).distinct()), known_rows, []
    while n := todo.count():
        if budget is not None and len(looked) >= budget:
            raise TimeoutError(f"no fixpoint in {budget} rounds")
        looked.append(n)
        new = _kept(step(todo, rows).join(rows, rows.columns, "left_anti"))
        rows = _kept(rows.unionByName(new))
        called = edges.select(F.col("callee").alias("fn")).distinct()  # a summary is read only at a call
        todo = _kept(edges.join(new.select(F.col("fn").alias("callee")).distinct(), "callee", "left_semi").select("fn").distinct().join(called, "fn", "left_semi"))
    return rows, tuple(looked)


def summaries(defs: DataFrame, kills: DataFrame, loops: DataFrame, sinks: DataFrame, inputs: DataFrame, calls: Calls, budget: int | None = None) -> Summaries:
    """The summaries of all functions that are called, recursive ones included: kills first, then flows with kills fixed.

    ``inputs`` (fn, cls, pos) are the states that the input defines. In each round only functions of which a callee's
    summary grew are looked at, and one reach of masks gives the flows of all their ports.
    """
    spark = defs.sparkSession
    outs = calls.ports.where("out")

    def kill_step(todo: DataFrame, rows: DataFrame) -> DataFrame:
        own = known(kills, *AT).select("fn", "cls").unionByName(_at_calls(calls.actuals, rows).select("fn", "cls"))
        return outs.join(todo, "fn", "left_semi").join(own.distinct(), ["fn", "cls"], "left_semi").select("fn", "port")

    killed, first = _worklist(calls, kill_step, spark.createDataFrame([], outs.select("fn", "port").schema), budget)

    def flow_step(todo: DataFrame, rows: DataFrame) -> DataFrame:
        only = lambda df: df.join(todo, "fn", "left_semi")
        facts, ins = applied(only(defs), only(kills), only(loops), only(sinks), only(inputs), replace(calls, **{k: only(getattr(calls, k)) for k in ("calls", "args", "actuals", "results")}), killed, rows)
        return _flows(facts, ins, only(calls.ports), only(_direct(calls, rows)))

    key = outs.schema["fn"].dataType.simpleString()
    flows, second = _worklist(calls, flow_step, spark.createDataFrame([], f"fn {key}, source long, sink long"), budget)
    return Summaries(killed, flows, first + second)


def _at_calls(at: DataFrame, of_callee: DataFrame) -> DataFrame:
    """Facts of calls (fn, at, callee, port, ...) for the ports that the callees' rows (fn, port) name."""
    return at.join(of_callee.select(F.col("fn").alias("callee"), "port"), ["callee", "port"])


def _direct(calls: Calls, flows: DataFrame) -> DataFrame:
    """The functions that call one whose input reaches a sink."""
    bad = flows.where((F.col("source") == INPUT) & (F.col("sink") == SINK)).select(F.col("fn").alias("callee"))
    return calls.calls.join(bad, "callee", "left_semi").select("fn").distinct()


def applied(defs: DataFrame, kills: DataFrame, loops: DataFrame, sinks: DataFrame, inputs: DataFrame, calls: Calls, killed: DataFrame, flows: DataFrame) -> tuple[Flow, DataFrame]:
    """The facts of functions with their callees' summaries applied, and the states that the input defines."""
    through = flows.select(F.col("fn").alias("callee"), F.col("source").alias("port"), "sink")
    read = calls.args.join(through, ["callee", "port"])
    back = calls.actuals.select("fn", "at", "callee", F.col("port").alias("sink"), F.col("cls").alias("target"))
    defined = (F.col("at") + 2).alias("defined")
    by_ports = read.join(back, ["fn", "at", "callee", "sink"]).select("fn", "cls", "read", "target", defined)
    by_result = read.where(F.col("sink") == RET).join(calls.results, ["fn", "at"]).select("fn", "cls", "read", "target", "defined")
    at_sink = read.where(F.col("sink") == SINK).select("fn", "cls", "read", F.col("at").alias("token"))
    given = calls.calls.join(through.where(F.col("port") == INPUT), "callee")
    into_ports = given.join(back, ["fn", "at", "callee", "sink"]).select("fn", F.col("target").alias("cls"), defined.alias("pos"))
    into_result = given.where(F.col("sink") == RET).join(calls.results, ["fn", "at"]).select("fn", F.col("target").alias("cls"), F.col("defined").alias("pos"))
    ends = _at_calls(calls.actuals, killed).select("fn", "cls", (F.col("at") + 1).alias("pos"))
    cols = ("fn", "cls", "read", "target", "defined")
    facts = Flow(
        reduce(DataFrame.unionByName, [known(defs, *cols), by_ports, by_result]), known(kills, *AT).unionByName(ends),
        loops, known(sinks, "fn", "cls", "read", "token").unionByName(at_sink),
    )
    return facts, reduce(DataFrame.unionByName, [known(inputs, *AT), into_ports, into_result]).distinct()


def _flows(facts: Flow, inputs: DataFrame, ports: DataFrame, direct: DataFrame) -> DataFrame:
    """(fn, source, sink): which ports (and the input) reach which ports, the result and a sink."""
    own = ports.where(F.col("port") > 0).select("fn", "cls", F.lit(ENTRY).alias("pos"), F.col("port").cast("long").alias("port"))
    seeds = own.unionByName(inputs.select("fn", "cls", "pos", F.lit(INPUT).cast("long").alias("port")))
    masks = _kept(spread_masks(facts, seeds))
    to_sink = with_ports(facts.seen(masks, MASKS, True).select("fn", "block", "value")).select("fn", F.col("port").alias("source"), F.lit(SINK).cast("long").alias("sink"))
    last = with_ports(facts.placed(masks.where(F.col("pos") != ENTRY)).where((F.col("until") == AFTER))).select("fn", "cls", F.col("port").alias("source"))
    given = with_ports(masks.where(F.col("pos") != ENTRY)).select("fn", "cls", F.col("port").alias("source"))
    outs = ports.select("fn", "cls", F.col("port").cast("long").alias("sink"), "out")
    to_ports = last.join(outs.where(F.col("out") & (F.col("sink") > 0)).drop("out"), ["fn", "cls"]).where("source <> sink").select("fn", "source", "sink")
    to_result = given.join(outs.where(F.col("sink") == RET).drop("out"), ["fn", "cls"]).select("fn", "source", "sink")
    bad = direct.select("fn", F.lit(INPUT).cast("long").alias("source"), F.lit(SINK).cast("long").alias("sink"))
    return reduce(DataFrame.unionByName, [to_sink, to_ports, to_result, bad]).distinct()
