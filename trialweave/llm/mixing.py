"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents fall into blocks by a seeded hash. A source takes its target as whole passes over all its
blocks plus blocks in a seeded permuted order, and of the last block documents in hash order until the target is met.
The tree splits the exact block quotas of all sources among output shards: each node draws, without replacement, how
many blocks of each source go left. Each copy that a shard takes carries a hash as its place there: ``mixed_rows``
brings a shard's rows together and orders them by place, which is the local shuffle. Shards are cut into slices by
place, so that no task holds a whole shard.

Only block totals reach the driver: at most 65,536 blocks and one row a source. The splitting tree runs there, over
these quotas; all rows of documents stay in SQL functions.

Defined cases: null texts have size 0; a null source is a source of its own, last; sources of total size 0 have target
0 and take nothing; repeated rows are separate documents; equal hashes are broken by doc_id; an empty table gives no
rows. Only the columns named are used, so others may have any name.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm._common import WORD, groups_for, whole_row, written

MAX_BLOCKS = 1 << 16
BLOCK_WORDS = 1 << 16
FILLS = 4


def size_of(text: Column) -> Column:
    """The number of words: each becomes one letter and white space goes, so no array of words is built."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD, "x"), " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> dict[str | None, float]:
    """Share the total size by weight; stop at ``most`` times a source's size and reshare until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    left, total = names, float(sum(sizes.values()))
    while left:
        share = max(0.0, total - sum(out.values())) / sum(weight[s] for s in left)
        over = [s for s in left if share * weight[s] > most * sizes[s]]
        for s in over or left:
            out[s] = most * sizes[s] if over else share * weight[s]
        left = [s for s in left if s not in out]
    return out


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source (columns) in each shard (rows): halve the shards, draw the left side's blocks, recurse."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    total = int(quotas.sum())
    take = rng.multivariate_hypergeometric(quotas, round(total * left / shards), method="marginals") if total else quotas
    return np.concatenate([split_tree(take, left, rng), split_tree(quotas - take, shards - left, rng)])


def plan(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, shards: int = 8, seed: int = 7) -> DataFrame:
    """The mix of ``docs`` (doc_id, source, size) as a small table: a row for each source and block.

    A block's documents go whole to ``shards``. Of a source's last block, those up to ``upto`` in the order of
    (key, doc_id, size) go to ``part_shard`` besides, and those in ``fill``, which close most of what is then missing.
    """
    spark = docs.sparkSession
    d = written(docs.select("doc_id", "source", "size").withColumn("key", F.xxhash64("doc_id", F.lit(seed))))
    size = {r["source"]: r["n"] for r in d.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    target, total = targets(size, weights, most), sum(size.values())
    unit = max(BLOCK_WORDS, -(-2 * total // MAX_BLOCKS))
    blocks = {s: 1 + n // unit for s, n in size.items()}
    of = written(_table(spark, [{"s": s, "blocks": blocks[s]} for s in size], "s string, blocks int"))
    d = d.join(F.broadcast(of), d["source"].eqNullSafe(of["s"])).withColumn("block", _block(F.col("key"), F.col("blocks")))
    words = {(r["source"], r["block"]): r["n"] for r in d.groupBy("source", "block").agg(F.sum("size").alias("n")).collect()}
    rows = _plan(words, size, target, blocks, shards, seed)
    facts = {s: {"source_size": size[s], "target": target[s], "blocks": blocks[s]} for s in size}
    have = {(r["s"], r["k"]) for r in rows}
    rows += [{"s": s, "k": k, "shards": []} for s in size for k in range(blocks[s]) if (s, k) not in have]
    whole = written(_table(spark, [r | facts[r["s"]] for r in rows], "s string, k int, shards array<int>, part long, part_shard int, source_size long, target double, blocks int"))
    last = whole.where("part is not null").select(F.col("s").alias("ls"), F.col("k").alias("lk"), "part")
    d = d.select("source", "block", "key", "doc_id", "size").join(F.broadcast(last), d["source"].eqNullSafe(last["ls"]) & (d["block"] == last["lk"]))
    order, block = Window.partitionBy("source", "block").orderBy("key", "doc_id", "size"), Window.partitionBy("source", "block")
    place = F.struct("key", "doc_id", "size")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # In this order, documents are taken up to the first that crosses the target; then those that close most of the gap.
    d = d.withColumn("in", before + F.col("size") <= F.col("part")).withColumn("filled", F.lit(False))
    for _ in range(FILLS):
        gap = F.col("part") - F.coalesce(F.sum(F.when(F.col("in") | F.col("filled"), F.col("size"))).over(block), F.lit(0))
        d = d.withColumn("gap", gap).withColumn("off", F.abs(F.col("gap") - F.col("size")))
        best = F.min(F.when(~F.col("in") & ~F.col("filled"), F.struct("off", place.alias("place")))).over(block)
        d = d.withColumn("filled", F.col("filled") | (~F.col("in") & (F.col("off") < F.col("gap")) & (F.struct("off", place.alias("place")) == best)))
    upto = d.groupBy("ls", "lk").agg(F.max(F.when(F.col("in"), place)).alias("upto"), F.collect_list(F.when(F.col("filled"), place)).alias("fill"))
    return whole.join(F.broadcast(upto), whole["s"].eqNullSafe(upto["ls"]) & (whole["k"] == upto["lk"]), "left").drop("ls", "lk")


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.shiftright(key, 20), blocks).cast("int")


def decide(docs: DataFrame, mixture: DataFrame, size: Column, *, doc_id: str = "doc_id", source: str = "source", seed: int = 7) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``) and ``mix``: size, source_size, target, shards and places.

    ``shards`` and ``places`` have one entry for each time a document is taken. The plan has at most 65,536 blocks and one
    a source, so it is broadcast and no document moves.
    """
    p = written(mixture)
    of = p.groupBy(F.col("s").alias("of")).agg(F.first("blocks").alias("blocks"))
    d = docs.select(whole_row(docs).alias("row"), F.xxhash64(doc_id, F.lit(seed)).alias("key"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"))
    d = d.join(F.broadcast(of), F.col("source").eqNullSafe(F.col("of")))
    d = d.join(F.broadcast(p.drop("blocks")), F.col("source").eqNullSafe(F.col("s")) & (_block(F.col("key"), F.col("blocks")) == F.col("k")))
    place = F.struct("key", "doc_id", "size")
    drawn = F.coalesce((place <= F.col("upto")) | F.array_contains("fill", place), F.lit(False)) & F.col("part_shard").isNotNull()
    to = F.when(drawn, F.concat("shards", F.array("part_shard"))).otherwise(F.col("shards"))
    places = F.transform(to, lambda shard, i: F.xxhash64("key", i, F.lit(seed + 1)))
    return d.select("row", F.struct("size", "source_size", "target", to.alias("shards"), places.alias("places")).alias("mix"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, **options) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, shards and places (one entry for each time it is taken)."""
    d = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size")))
    return decide(d, plan(d, seed=seed, **options), F.col("size"), seed=seed).select("row.doc_id", "row.source", "mix.*")


def mixed_rows(docs: DataFrame, *, shards: int = 8, mb: int = 16, **options) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns, shard by shard in the order of their places.

    A shard is cut into slices of about ``mb`` MB by place, and a slice is sorted where it lies.
    """
    n = -(-groups_for(docs, mb, shards) // shards)
    d = written(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")))
    out = decide(docs, plan(d, shards=shards, **options), size_of(F.col("text")))
    out = out.select("row", F.explode(F.arrays_zip("mix.shards", "mix.places")).alias("copy"))
    out = out.withColumn("slice", F.col("copy.shards") * n + F.pmod(F.col("copy.places"), F.lit(n)).cast("int"))
    return out.repartition(shards * n, "slice").sortWithinPartitions("slice", "copy.places").select("row.*")


def _table(spark, rows: list[dict], schema: str) -> DataFrame:
    """A small table from values that the plan holds as text."""
    cell = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")
    return spark.range(1, numPartitions=1).select(F.explode(cell).alias("r")).select("r.*")


def _plan(words: dict, size: dict, target: dict, blocks: dict, shards: int, seed: int) -> list[dict]:
    """For each block: the shards it goes to as a whole, and how many words of it are drawn besides, for which shard."""
    names = sorted(size, key=lambda s: (s is None, s or ""))
    rng = np.random.default_rng(seed)
    order, part = {}, {}
    for s in names:
        if not size[s]:
            order[s] = []
            continue
        passes = int(target[s] // size[s])
        rest = target[s] - passes * size[s]
        order[s] = [int(b) for _ in range(passes) for b in rng.permutation(blocks[s])]
        for b in rng.permutation(blocks[s]):
            n = words.get((s, int(b)), 0)
            if n > rest:
                part[s] = (int(b), int(round(rest)))
                break
            order[s].append(int(b))
            rest -= n
    quotas = np.array([len(order[s]) + (s in part) for s in names], np.int64)
    cut = split_tree(quotas, shards, rng)
    out: dict = {}
    for j, s in enumerate(names):
        to = np.repeat(np.arange(shards), cut[:, j]).tolist()
        for b, shard in zip(order[s], to, strict=False):
            out.setdefault((s, b), {"s": s, "k": b, "shards": []})["shards"].append(shard)
        if s in part:
            b, n = part[s]
            out.setdefault((s, b), {"s": s, "k": b, "shards": []}).update(part=n, part_shard=to[-1])
    return list(out.values())


def taken(mixed_docs: DataFrame) -> DataFrame:
    """How many words the mix takes of each document, repeats counted, with the shards they go to and the places there."""
    return mixed_docs.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards", "places")
