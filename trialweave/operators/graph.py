"""Reachability and components over edge tables; a budget of rounds ends an open question with null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.session import shared_dir


def _kept(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that driver and executors share, and read back."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key is hot with more than one in HOT_SHARE of all rows, and HOT_ROWS at least: there are at most 1,000 such keys.
HOT_SHARE, HOT_ROWS = 1000, 512


def looked_up(rows: DataFrame, key: str, table: DataFrame, value: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """``rows`` (a stored table) with column ``value`` of ``table``, which has one row for each value of ``key``.

    Entries of hot keys, at most 1,000, are broadcast, so their rows stay where they are; the others meet by a shuffle,
    of which no key has more than a thousandth of the rows. ``hot`` names these keys where they are known.
    """
    if hot is None:
        most = max(HOT_ROWS, rows.count() // HOT_SHARE)
        hot = [r[0] for r in rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most).select(key).collect()]
    table = table.select(key, value)
    if not hot:
        return rows.join(table, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return rows.where(is_hot).join(F.broadcast(table.where(is_hot)), key, how).unionByName(rows.where(~is_hot).join(table.where(~is_hot), key, how))


def components(links: DataFrame) -> DataFrame:
    """(v, label) for every vertex of ``links`` (a, b): label is the least vertex that it is connected with.

    In each round every vertex goes over to the first of itself and its neighbours in an order: in the first round by
    value, which contracts stars around their least vertex at once, then by a hash of the round, so that no input makes
    long chains. Edges within a vertex go, equal edges become one, and a hub's neighbours are aggregated before the
    shuffle. Edges shrink by a share in each round, so all rounds together read a few times the links, and their
    number grows with the logarithm of the vertices. Vertices may be of any type that has an order.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").groupBy("a", "b").agg(F.lit(1).alias("x")).drop("x")
    edges = _kept(edges)
    alone = links.select(F.col("a").alias("v")).unionByName(links.select(F.col("b").alias("v"))).groupBy("v").agg(F.lit(1).alias("x"))
    labels = _kept(alone.select("v", F.col("v").alias("label")))
    turn = 0
    while n := edges.count():
        order = (lambda c: F.lit(0)) if turn == 0 else (lambda c, turn=turn: F.xxhash64(c, F.lit(turn)))
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
        first = both.groupBy("v").agg(F.min(F.struct(order(F.col("u")).alias("o"), F.col("u").alias("u"))).alias("n"), F.count("*").alias("degree"))
        mine = F.struct(order(F.col("v")).alias("o"), F.col("v").alias("u"))
        to = _kept(first.select(F.col("v").alias("from"), F.least(mine, F.col("n"))["u"].alias("to"), "degree"))
        hubs = [r[0] for r in to.where(F.col("degree") > max(HOT_ROWS, n // HOT_SHARE)).select("from").collect()]  # at most 2,000
        half = _kept(looked_up(edges, "a", to.select(F.col("from").alias("a"), F.col("to").alias("ta")), "ta", hot=hubs).select("ta", "b"))
        moved = looked_up(half, "b", to.select(F.col("from").alias("b"), F.col("to").alias("tb")), "tb", hot=hubs).where("ta <> tb")
        edges = _kept(moved.groupBy(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).agg(F.lit(1).alias("x")).drop("x"))
        step = looked_up(labels, "label", to.select(F.col("from").alias("label"), "to"), "to", "left", hot=None if turn else [])
        labels = _kept(step.select("v", F.coalesce("to", "label").alias("label")))
        turn += 1
    least = labels.groupBy("label").agg(F.min("v").alias("least"))
    return looked_up(labels, "label", least, "least").select("v", F.col("least").alias("label"))


def reach_labels(edges: DataFrame, sources: DataFrame, budget: int | None = None) -> DataFrame | None:
    """(v, label): the least source that reaches each vertex. Semi-naive: a round follows only what the last one changed.

    ``edges``: src, dst; ``sources``: v. None where the budget of rounds ends first.
    """
    reached = _kept(sources.select("v", F.col("v").alias("label")).distinct())
    fresh, rounds = reached, 0
    while not fresh.isEmpty():
        if budget is not None and rounds >= budget:
            return None
        rounds += 1
        step = fresh.join(edges, fresh["v"] == edges["src"]).groupBy(F.col("dst").alias("v")).agg(F.min("label").alias("new"))
        merged = _kept(reached.join(step, "v", "full").select("v", F.least("label", "new").alias("label"), (F.col("new").isNotNull() & (F.col("label").isNull() | (F.col("new") < F.col("label")))).alias("moved")))
        reached, fresh = merged.select("v", "label"), merged.where("moved").select("v", "label")
    return reached


def first_violation(reached: DataFrame, sinks: DataFrame) -> DataFrame:
    """The least (sink, label) that is reached; no row reaches the driver but this one."""
    return reached.join(sinks, "v").agg(F.min(F.struct(F.col("v").alias("sink"), "label")).alias("x")).select("x.*")


def visible_definitions(definitions: DataFrame, reads: DataFrame) -> DataFrame:
    """Each read with the definition of its variable that it sees: the last one before it (a definition ends the one before).

    A range join as a window over the union of both, so nothing is paired that does not match.
    """
    from pyspark.sql import Window

    d = definitions.select("var", "pos", F.lit(0).alias("kind"))
    r = reads.select("var", "pos", F.lit(1).alias("kind"))
    w = Window.partitionBy("var").orderBy("pos", F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = d.unionByName(r).withColumn("def_pos", F.last(F.when(F.col("kind") == 0, F.col("pos")), ignorenulls=True).over(w))
    return seen.where("kind = 1").select("var", F.col("pos").alias("read_pos"), "def_pos")


def alias_classes(pairs: DataFrame) -> DataFrame:
    """(v, label): the least member of each class of vertices that pairs (a, b) join."""
    return components(pairs)


def reach_closure(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """The vertices that sources reach, each once; ends on cycles too. A round follows only vertices that are new."""
    seen = _kept(sources.select("v").where("v is not null").distinct())
    fresh = seen
    while not fresh.isEmpty():
        fresh = _kept(fresh.join(edges, fresh["v"] == edges["src"]).select(F.col("dst").alias("v")).where("v is not null").distinct().join(seen, "v", "left_anti"))
        seen = seen.unionByName(fresh)
    return seen
