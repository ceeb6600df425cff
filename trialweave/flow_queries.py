"""Queries of data flow over facts made of the driver's tables, each with recursive SQL beside it.

A supplier's lineitems, by the last digit of their order, are one function's events in order: most of them define a
class of values from another, returned ones kill a class, every tenth opens a loop with one inside, dear ones write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.operators import flow
from trialweave.operators.graph import _kept as stored
from trialweave.trial_queries import ORACLE_SQL, QUERIES, query, table

_FACTS = """ev AS MATERIALIZED (SELECT l_suppkey * 10 + l_orderkey % 10 AS fn, (row_number() OVER (PARTITION BY l_suppkey, l_orderkey % 10 ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1)::BIGINT AS e, l_partkey % 6 AS c, (l_partkey // 6) % 6 AS t, (l_orderkey // 10) % 6 AS o,
l_returnflag = 'R' AS kill, l_tax = 0.08 AS writes, l_quantity > 48 AS input, l_discount = 0.05 AS calls, l_linenumber::BIGINT AS token FROM lineitem),
defs AS MATERIALIZED (SELECT fn, c AS cls, 3 * e AS read, t AS target, 3 * e + 2 AS defined FROM ev WHERE NOT kill UNION ALL SELECT fn, c, 3 * e, 9, 3 * e + 2 FROM ev WHERE e % 10 = 9),
kills AS MATERIALIZED (SELECT fn, c AS cls, 3 * e + 1 AS pos FROM ev WHERE kill), loops AS MATERIALIZED (SELECT fn, 3 * e AS head, 3 * e + 23 AS tail FROM ev WHERE e % 10 = 0 UNION ALL SELECT fn, 3 * e, 3 * e + 11 FROM ev WHERE e % 10 = 2),
sinks AS (SELECT fn, c AS cls, 3 * e AS read, token FROM ev WHERE writes), inputs AS (SELECT fn, c AS cls, 3 * e + 2 AS pos, e FROM ev WHERE input)"""

#: Which reads see which states: the pairs themselves, as the definition says it.
_SEES = """ks{k} AS MATERIALIZED (SELECT fn, cls, list(pos) AS ks FROM {kills} GROUP BY ALL),
pairs{k} AS MATERIALIZED (SELECT s.fn, s.cls, s.pos, r.read, coalesce(ks, []) AS ks FROM (SELECT DISTINCT fn, cls, pos FROM {states}) s JOIN (SELECT DISTINCT fn, cls, read FROM {reads}) r ON r.fn = s.fn AND r.cls = s.cls LEFT JOIN ks{k} k ON k.fn = s.fn AND k.cls = s.cls),
sees{k} AS MATERIALIZED (SELECT fn, cls, pos, read FROM pairs{k} WHERE read > pos AND len(list_filter(ks, lambda x: x BETWEEN pos AND read)) = 0
UNION SELECT p.fn, cls, pos, read FROM pairs{k} p JOIN loops l ON l.fn = p.fn AND pos BETWEEN head AND tail AND read BETWEEN head AND tail WHERE len(list_filter(ks, lambda x: x BETWEEN pos AND tail OR x BETWEEN head AND read)) = 0)"""
_STATES = "(SELECT fn, target AS cls, defined AS pos FROM {defs} UNION SELECT fn, cls, pos FROM {seeds})"
_READS = "(SELECT fn, cls, read FROM {defs} UNION SELECT fn, cls, read FROM {sinks})"


def _sees(k: str = "", defs: str = "defs", seeds: str = "seeds", sinks: str = "sinks", kills: str = "kills") -> str:
    return _SEES.format(k=k, kills=kills, states=_STATES.format(defs=defs, seeds=seeds), reads=_READS.format(defs=defs, sinks=sinks))


_REACH = "reach{k}(fn, cls, pos, label) AS (SELECT fn, cls, pos, label FROM seeds{k} UNION SELECT d.fn, d.target, d.defined, r.label FROM reach{k} r JOIN sees{k} s ON s.fn = r.fn AND s.cls = r.cls AND s.pos = r.pos JOIN defs{k} d ON d.fn = s.fn AND d.cls = s.cls AND d.read = s.read)"
_PORTS = "SELECT fn, p - 1 AS cls, -1::BIGINT AS pos, p AS label FROM (SELECT DISTINCT fn FROM ev), range(1, 4) r(p)"


def events(spark, d) -> DataFrame:
    w = Window.partitionBy("l_suppkey", F.col("l_orderkey") % 10).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    sixth = lambda c: F.floor(c) % 6
    return table(spark, d, "lineitem").select(
        (F.col("l_suppkey") * 10 + F.col("l_orderkey") % 10).alias("fn"), (F.row_number().over(w) - 1).cast("long").alias("e"), (F.col("l_partkey") % 6).alias("c"), sixth(F.col("l_partkey") / 6).alias("t"), sixth(F.col("l_orderkey") / 10).alias("o"),
        (F.col("l_returnflag") == "R").alias("kill"), (F.col("l_tax") == 0.08).alias("writes"), (F.col("l_quantity") > 48).alias("input"), (F.col("l_discount") == 0.05).alias("calls"), F.col("l_linenumber").cast("long").alias("token"),
    )


def tables(ev: DataFrame) -> dict[str, DataFrame]:
    read, defined = (F.col("e") * 3).alias("read"), (F.col("e") * 3 + 2).alias("defined")
    cls = F.col("c").alias("cls")
    loop = lambda k, n: ev.where(F.col("e") % 10 == k).select("fn", (F.col("e") * 3).alias("head"), (F.col("e") * 3 + n).alias("end"))
    return {
        "defs": ev.where("not kill").select("fn", cls, read, F.col("t").alias("target"), defined).unionByName(ev.where(F.col("e") % 10 == 9).select("fn", cls, read, F.lit(9).cast("long").alias("target"), defined)),
        "kills": ev.where("kill").select("fn", cls, (F.col("e") * 3 + 1).alias("pos")), "loops": loop(0, 23).unionByName(loop(2, 11)), "sinks": ev.where("writes").select("fn", cls, read, "token"),
    }


@query(f"WITH RECURSIVE {_FACTS}, seeds AS ({_PORTS} UNION ALL SELECT fn, cls, pos, 0 FROM inputs), {_sees()}, {_REACH.format(k='')} SELECT fn, cls, pos, label::BIGINT AS port FROM reach")
def reach_masks(spark, d):
    """What three ports and the input of every function reach, in one pass of bit masks, through loops and kills."""
    ev = stored(events(spark, d))
    ports = ev.select("fn").distinct().select("fn", F.explode(F.array(*[F.lit(p) for p in (1, 2, 3)])).alias("port"))
    seeds = ports.select("fn", (F.col("port") - 1).cast("long").alias("cls"), F.lit(-1).alias("pos"), "port").unionByName(ev.where("input").select("fn", F.col("c").alias("cls"), (F.col("e") * 3 + 2).alias("pos"), F.lit(0).alias("port")))
    return flow.reach_masks(flow.Flow(**tables(ev)), seeds)


@query(f"""WITH RECURSIVE {_FACTS}, seeds AS (SELECT fn, cls, pos, e AS label FROM inputs), {_sees()}, {_REACH.format(k='')}, least_ AS (SELECT fn, cls, pos, min(label) AS label FROM reach GROUP BY ALL),
hit AS (SELECT k.fn, k.read, l.label, k.token FROM least_ l JOIN sees s ON s.fn = l.fn AND s.cls = l.cls AND s.pos = l.pos JOIN sinks k ON k.fn = s.fn AND k.cls = s.cls AND k.read = s.read)
SELECT fn, read, label, token FROM hit QUALIFY row_number() OVER (PARTITION BY fn ORDER BY read, label, token) = 1""")
def first_violations(spark, d):
    """The first write of each function that an input reaches, with the earliest such input."""
    ev = stored(events(spark, d))
    facts = flow.Flow(**tables(ev))
    labels = flow.reach_labels(facts, ev.where("input").select("fn", F.col("c").alias("cls"), (F.col("e") * 3 + 2).alias("pos"), F.col("e").alias("label")))
    return flow.violations(facts, labels)


def _level(k: int) -> str:
    """The flows of the functions with fn % 3 = k, which call those of the level below."""
    mine = "fn % 3 = {k}".format(k=k)
    below = f"flow{k - 1}" if k else "(SELECT 0 AS fn, 0 AS source, 0 AS sink WHERE false)"
    gone = f"gone{k - 1}" if k else "(SELECT 0 AS fn, 0 AS port WHERE false)"
    arg, back = "(c + source) % 6", "(t + {p}) % 6"
    return f"""call{k} AS MATERIALIZED (SELECT ev.*, source, sink FROM ev JOIN {below} f ON f.fn = ev.fn - 1 WHERE calls AND ev.{mine}),
kills{k} AS MATERIALIZED (SELECT * FROM kills WHERE {mine} UNION SELECT ev.fn, {back.format(p='port')}, 3 * e + 1 FROM ev JOIN {gone} g ON g.fn = ev.fn - 1 WHERE calls AND ev.{mine}),
gone{k} AS MATERIALIZED (SELECT DISTINCT fn, cls + 1 AS port FROM kills{k} WHERE cls IN (0, 2) AND fn IN (SELECT fn - 1 FROM ev WHERE calls AND fn % 3 > 0)),
defs{k} AS MATERIALIZED (SELECT * FROM defs WHERE {mine} UNION SELECT fn, {arg}, 3 * e, {back.format(p='sink')}, 3 * e + 2 FROM call{k} WHERE source > 0 AND sink IN (1, 3) UNION SELECT fn, {arg}, 3 * e, o, 3 * e + 2 FROM call{k} WHERE source > 0 AND sink = -2),
sinks{k} AS MATERIALIZED (SELECT fn, cls, read FROM sinks WHERE {mine} UNION SELECT fn, {arg}, 3 * e FROM call{k} WHERE source > 0 AND sink = -1),
seeds{k} AS MATERIALIZED (SELECT * FROM ({_PORTS}) WHERE {mine} UNION SELECT fn, cls, pos, 0 FROM inputs WHERE {mine} UNION SELECT fn, {back.format(p='sink')}, 3 * e + 2, 0 FROM call{k} WHERE source = 0 AND sink IN (1, 3) UNION SELECT fn, o, 3 * e + 2, 0 FROM call{k} WHERE source = 0 AND sink = -2),
{_sees(str(k), f'defs{k}', f'seeds{k}', f'sinks{k}', f'kills{k}')}, {_REACH.format(k=k)},
last{k} AS (SELECT fn, cls, max(pos) AS pos FROM kills{k} GROUP BY ALL),
flow{k} AS MATERIALIZED (SELECT * FROM (SELECT r.fn, label AS source, -1 AS sink FROM reach{k} r JOIN sees{k} s ON s.fn = r.fn AND s.cls = r.cls AND s.pos = r.pos JOIN sinks{k} k ON k.fn = s.fn AND k.cls = s.cls AND k.read = s.read
UNION SELECT fn, label, -2 FROM reach{k} WHERE cls = 9 AND pos >= 0 UNION SELECT r.fn, label, r.cls + 1 FROM reach{k} r LEFT JOIN last{k} l ON l.fn = r.fn AND l.cls = r.cls WHERE r.cls IN (0, 2) AND r.pos >= 0 AND coalesce(l.pos < r.pos, true) AND label <> r.cls + 1
UNION SELECT fn, 0, -1 FROM call{k} WHERE source = 0 AND sink = -1) WHERE fn IN (SELECT fn - 1 FROM ev WHERE calls AND fn % 3 > 0))"""


@query(f"WITH RECURSIVE {_FACTS}, {_level(0)}, {_level(1)} SELECT fn, source::BIGINT AS source, sink::BIGINT AS sink FROM flow0 UNION ALL SELECT fn, source, sink FROM flow1")
def call_summaries(spark, d):
    """Which ports of each called function reach which others, its result and a write, with its callees' flows and kills applied."""
    ev = stored(events(spark, d))
    t = tables(ev)
    at, callee = (F.col("e") * 3).alias("at"), (F.col("fn") - 1).alias("callee")
    sites = ev.where("calls and fn % 3 > 0")
    each = lambda *ports: F.explode(F.array(*[F.lit(p).cast("long") for p in ports])).alias("port")
    calls = flow.Calls(
        ports=ev.select("fn").distinct().select("fn", each(1, 2, 3, flow.RET)).select("fn", "port", F.when(F.col("port") > 0, F.col("port") - 1).otherwise(9).alias("cls"), F.col("port").isin(1, 3).alias("out")),
        calls=sites.select("fn", at, callee),
        args=sites.select("fn", at, callee, "c", each(1, 2, 3)).select("fn", "at", "callee", "port", ((F.col("c") + F.col("port")) % 6).alias("cls"), F.col("at").alias("read")),
        actuals=sites.select("fn", at, callee, "t", each(1, 3)).select("fn", "at", "callee", "port", ((F.col("t") + F.col("port")) % 6).alias("cls")),
        results=sites.select("fn", at, F.col("o").alias("target"), (F.col("e") * 3 + 2).alias("defined")),
    )
    inputs = ev.where("input").select("fn", F.col("c").alias("cls"), (F.col("e") * 3 + 2).alias("pos"))
    return flow.summaries(t["defs"], t["kills"], t["loops"], t["sinks"], inputs, calls).flows


__all__ = ["ORACLE_SQL", "QUERIES"]
