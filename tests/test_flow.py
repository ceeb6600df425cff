"""Data flow over facts against a walk through each function, state by state."""

from __future__ import annotations

import random

import pytest

from trialweave.operators import flow

DEFS, KILLS, LOOPS = "fn string, cls long, read long, target long, defined long", "fn string, cls long, pos long", "fn string, head long, end long"
SINKS = "fn string, cls long, read long, token long"


def sees(kills, loops, cls, pos, read):
    """Whether a read sees the state of a class at a position."""
    hit = lambda a, b: any(a <= k <= b for k in kills.get(cls, ()))
    if read < 0 or (read > pos and not hit(pos, read)):
        return True
    return any(h <= pos <= e and h <= read <= e and not hit(pos, e) and not hit(h, read) for h, e in loops)


def reached(defs, kills, loops, seeds):
    """{(cls, pos): set of seed values}."""
    have = {}
    todo = [(c, p, v) for c, p, v in seeds]
    while todo:
        c, p, v = todo.pop()
        if v in have.setdefault((c, p), set()):
            continue
        have[c, p].add(v)
        todo += [(t, d, v) for cls, r, t, d in defs if cls == c and sees(kills, loops, c, p, r)]
    return have


def a_function(rng, n=24, classes=4):
    events = list(range(n))
    defs = [(rng.randrange(classes), 3 * e, rng.randrange(classes), 3 * e + 2) for e in events for _ in range(rng.choice([0, 1, 1, 2]))]
    defs += [(rng.randrange(classes), -5, rng.randrange(classes), rng.choice([-4, 2]))] if rng.random() < 0.4 else []
    kills = {c: sorted({3 * e + 1 for e in events if rng.random() < 0.12}) for c in range(classes)}
    loops = []

    def nest(a, b, depth):
        while a < b - 2 and depth < 4:
            h = rng.randrange(a, b)
            e = rng.randrange(h, b)
            if rng.random() < 0.6:
                loops.append((3 * h, 3 * e + 2))
                nest(h + 1, e + 1, depth + 1)
            a = e + 1

    nest(0, n, 0)
    seeds = [(rng.randrange(classes), rng.choice([-1, 3 * rng.randrange(n) + 2]), v) for v in rng.sample(range(130), rng.randrange(1, 5))]
    sinks = [(rng.randrange(classes), 3 * rng.randrange(n), 100 + k) for k in range(rng.randrange(4))]
    return defs, kills, loops, seeds, sinks


@pytest.fixture(scope="module")
def programs(spark):
    rng = random.Random(5)
    fns = {f"f{i}": a_function(rng) for i in range(24)}
    rows = lambda pick: [(f, *r) for f, x in fns.items() for r in pick(x)]
    tables = {
        "defs": spark.createDataFrame([*rows(lambda x: x[0]), (None, 1, 1, 1, 1), ("f0", None, 3, 1, 5)], DEFS),
        "kills": spark.createDataFrame([*rows(lambda x: [(c, p) for c, ps in x[1].items() for p in ps]), ("f0", 1, None)], KILLS),
        "loops": spark.createDataFrame([*rows(lambda x: x[2]), ("f0", None, 9)], LOOPS),
        "sinks": spark.createDataFrame(rows(lambda x: x[4]), SINKS),
    }
    seeds = spark.createDataFrame(rows(lambda x: x[3]), "fn string, cls long, pos long, label long")
    return fns, flow.Flow(**tables), seeds


def test_masks(programs):
    fns, facts, seeds = programs
    got = {}
    for r in flow.reach_masks(facts, seeds.withColumnRenamed("label", "port")).collect():
        got.setdefault((r["fn"], r["cls"], r["pos"]), []).append(r["port"])
    want = {(f, *s): v for f, (d, k, l, q, _) in fns.items() for s, v in reached(d, k, l, q).items()}
    assert {s: sorted(v) for s, v in got.items()} == {s: sorted(v) for s, v in want.items()}
    assert any(len(v) > 1 for v in want.values()) and max(p for v in want.values() for p in v) > 62


def test_labels_and_first_violations(programs):
    fns, facts, seeds = programs
    labels = flow.reach_labels(facts, seeds)
    want = {(f, *s): min(v) for f, (d, k, l, q, _) in fns.items() for s, v in reached(d, k, l, q).items()}
    assert {(r["fn"], r["cls"], r["pos"]): r["label"] for r in labels.collect()} == want
    first = {}
    for (f, c, p), label in want.items():
        _, k, l, _, sinks = fns[f]
        for cls, read, token in sinks:
            if cls == c and sees(k, l, c, p, read):
                first[f] = min(first.get(f, (1 << 60, 0, 0)), (read, label, token))
    got = {r["fn"]: (r["read"], r["label"], r["token"]) for r in flow.violations(facts, labels).collect()}
    assert {f: v[:2] for f, v in got.items()} == {f: v[:2] for f, v in first.items()} and len(got) > 4
    assert flow.reach_labels(facts, seeds, budget=1) is None


# Calls: a function's flows, found by walking its body with its callees' flows, over and over.


def a_program(rng, n):
    """Functions over classes 0.. whose ports 1-3 are classes 1-3 and whose result is class 9; any may call any."""
    out = {}
    for i in range(n):
        defs, kills, loops, _, sinks = a_function(rng, 10, 4)
        kills = {c: [k for k in ks if rng.random() < 0.5] for c, ks in kills.items()}
        inputs = [(rng.randrange(4), 3 * rng.randrange(10) + 2)] if rng.random() < 0.3 else []
        defs += [(rng.randrange(4), 3 * e, 9, 3 * e + 2) for e in rng.sample(range(10), 1)]
        calls = [(3 * e, f"g{rng.randrange(n)}", {p: rng.randrange(4) for p in (1, 2, 3)}, {p: rng.randrange(4) for p in (1, 3)}, rng.randrange(4)) for e in rng.sample(range(10), rng.randrange(3))]
        out[f"g{i}"] = (defs, kills, loops, sinks if rng.random() < 0.4 else [], inputs, calls)
    return out


def summarised(program):
    called = {c[1] for f in program.values() for c in f[5]}
    killed, flows = {f: set() for f in program}, {f: set() for f in program}
    while True:
        before = {f: set(k) for f, k in killed.items()}
        for f, (_, kills, _, _, _, calls) in program.items():
            own = {c for c, ks in kills.items() if ks} | {back[p] for _, g, _, back, _ in calls for p in killed[g] if p in back}
            if f in called:
                killed[f] |= {p for p in (1, 3) if p in own}
        if before == killed:
            break
    while True:
        before = {f: set(k) for f, k in flows.items()}
        for f, (defs, kills, loops, sinks, inputs, calls) in program.items():
            if f not in called:
                continue
            k = {c: set(ks) for c, ks in kills.items()}
            d, s, seeds, bad = list(defs), list(sinks), [(p, -1, p) for p in (1, 2, 3)] + [(c, p, 0) for c, p in inputs], False
            for at, g, args, back, to in calls:
                for p in killed[g]:
                    if p in back:
                        k.setdefault(back[p], set()).add(at + 1)
                for x, y in flows[g]:
                    target = to if y == -2 else back.get(y)
                    if y == -1:
                        bad |= x == 0
                        s += [(args[x], at, at)] if x else []
                    elif target is not None:
                        if x:
                            d.append((args[x], at, target, at + 2))
                        else:
                            seeds.append((target, at + 2, 0))
            for (c, p), ports in reached(d, k, loops, seeds).items():
                if any(cls == c and sees(k, loops, c, p, r) for cls, r, _ in s):
                    flows[f] |= {(x, -1) for x in ports}
                if p != -1 and c == 9:
                    flows[f] |= {(x, -2) for x in ports}
                if p != -1 and c in (1, 3) and not any(q > p for q in k.get(c, ())):
                    flows[f] |= {(x, c) for x in ports if x != c}
            if bad:
                flows[f].add((0, -1))
        if before == flows:
            return killed, flows


def tables_of(spark, program):
    rows = lambda pick: [(f, *r) for f, x in program.items() for r in pick(x)]
    make = spark.createDataFrame
    calls = flow.Calls(
        make([(f, p, 9 if p == -2 else p, p in (1, 3)) for f in program for p in (1, 2, 3, -2)], "fn string, port long, cls long, out boolean"),
        make(rows(lambda x: [(at, g) for at, g, *_ in x[5]]), "fn string, at long, callee string"),
        make(rows(lambda x: [(at, g, p, c, at) for at, g, args, _, _ in x[5] for p, c in args.items()]), "fn string, at long, callee string, port long, cls long, read long"),
        make(rows(lambda x: [(at, g, p, c) for at, g, _, back, _ in x[5] for p, c in back.items()]), "fn string, at long, callee string, port long, cls long"),
        make(rows(lambda x: [(at, to, at + 2) for at, _, _, _, to in x[5]]), "fn string, at long, target long, defined long"),
    )
    return (
        make(rows(lambda x: x[0]), DEFS), make(rows(lambda x: [(c, p) for c, ps in x[1].items() for p in ps]), KILLS), make(rows(lambda x: x[2]), LOOPS),
        make(rows(lambda x: x[3]), SINKS), make(rows(lambda x: x[4]), "fn string, cls long, pos long"), calls,
    )


def test_summaries_of_recursive_functions(spark):
    program = a_program(random.Random(8), 9)
    got = flow.summaries(*tables_of(spark, program))
    killed, flows = summarised(program)
    assert {(r["fn"], r["port"]) for r in got.kills.collect()} == {(f, p) for f, ps in killed.items() for p in ps}
    assert {(r["fn"], r["source"], r["sink"]) for r in got.flows.collect()} == {(f, *x) for f, xs in flows.items() for x in xs} != set()


def test_only_callers_of_what_changed_are_looked_at(spark):
    """A chain of calls: g0 reads the input, each next hands on what the one before returns."""
    program = {"g0": ([(0, 3, 9, 5)], {}, [], [], [(0, 2)], [])}
    program |= {f"g{i}": ([(5, 6, 9, 8)], {}, [], [], [], [(3, f"g{i - 1}", {1: 1, 2: 1, 3: 1}, {1: 1, 3: 3}, 5)]) for i in range(1, 6)}
    program["main"] = ([], {}, [], [], [], [(3, "g5", {1: 1, 2: 1, 3: 1}, {1: 1, 3: 3}, 2), (9, "lone", {1: 2, 2: 2, 3: 2}, {}, 0)])
    program["lone"] = ([(1, 3, 9, 5)], {}, [], [], [], [])
    got = flow.summaries(*tables_of(spark, program))
    assert {(r["fn"], r["source"], r["sink"]) for r in got.flows.collect()} == {(f"g{i}", 0, -2) for i in range(6)} | {("lone", 1, -2)}
    assert got.rounds == (7, 7, 1, 1, 1, 1, 1)  # kills: all once; flows: all once, then one caller after the other


@pytest.mark.parametrize("small", [10, 45])
def test_large_functions_go_by_rounds(programs, monkeypatch, small):
    """With some or all functions too large for a task the states are the same."""
    fns, facts, seeds = programs
    monkeypatch.setattr(flow, "SMALL", small)
    got = {(r["fn"], r["cls"], r["pos"]): r["label"] for r in flow.reach_labels(flow.Flow(facts.defs, facts.kills, facts.loops, facts.sinks), seeds).collect()}
    assert got == {(f, *s): min(v) for f, (d, k, l, q, _) in fns.items() for s, v in reached(d, k, l, q).items()}


def test_a_long_chain_takes_one_pass(spark, monkeypatch):
    """Thirty definitions that each read the last one: one table is stored, not some a definition."""
    stored = []
    monkeypatch.setattr(flow, "_kept", lambda df, of=flow._kept: stored.append(1) or of(df))
    make = spark.createDataFrame
    facts = flow.Flow(make([("f", i, 3 * i + 3, i + 1, 3 * i + 5) for i in range(30)], DEFS), make([], KILLS), make([], LOOPS), make([], SINKS))
    assert flow.reach_labels(facts, make([("f", 0, 2, 7)], "fn string, cls long, pos long, label long")).count() == 31 and len(stored) == 1
