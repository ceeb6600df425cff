"""Near-duplicate documents by BagMinHash over five-word shingles, verified by exact weighted Jaccard.

A shingle of multiplicity w covers [0, w) of a weight axis that is cut into [0,1), [1,2), [2,4), [4,8), ... Each piece
has a Poisson process of points (time, register, height) that depends on the shingle alone, at a rate of the piece's
width; a text takes the points whose height is below w. The first point of each register is the text's signature, and
two texts agree in a register with the probability of their weighted Jaccard similarity (sum of minima over sum of
maxima). Points are generated up to a time by which all registers are almost surely filled, and further where not.

Sixteen bands of four registers find pairs (at 0.8, all but 2 in 10,000). Documents of the same word sequence are one
class from the start. In each band bucket, the least class is compared with every other, so a bucket of n gives n - 1
pairs. What these connect needs no further pair. Classes that share buckets but are not connected yet meet in blocks of
two chunks of at most 128 classes each; a block goes through the pairs of different components, the likeliest by their
signatures first, verifies a pair only while the two are still apart, and gives the links it finds, never its pairs.
Two chunks of one component don't meet. Pairs whose signatures agree in fewer than 38 of 64 registers are passed over,
which befalls a pair at 0.8 once in about 10**4 times. So no link between components is lost to the star.

Defined cases: words are split at ASCII white space and A-Z lower-cased; texts of 1 to 4 words have one shingle; null,
empty and blank texts have none, link with nothing and are kept; a class's document is its least doc_id (null first);
of rows that repeat in all but their other columns, each is listed and ``kept`` marks all with the least doc_id, while
``dedup`` keeps one; an empty table gives no rows. Only the columns named are used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm._common import mixed, released, split_hashes, whole_row, written
from trialweave.llm.components import components, looked_up
from trialweave.llm.decontaminate import windows
from trialweave.llm.token_files import slices

K, THRESHOLD = 5, 0.8
REGISTERS, BANDS = 64, 16
AGREE, CHUNK = 38, 128
SIGN_ROWS = 1000  # a text has some 600 points, so this bounds what is held at once
SIGNED = "doc_id long, key long, cls binary, n_words int, bands array<long>, sig array<smallint>"


def shingle_hashes(column, k: int = K):
    """Word hashes of all texts with their offsets, and shingle hashes with theirs."""
    words, at, off = split_hashes(column, lower=True)
    h = words[at]
    return h, off, *windows(h, off, k)


def bags(h: np.ndarray, off: np.ndarray):
    """Distinct (text, shingle) with multiplicities."""
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    _, first, count = np.unique(mixed(h ^ mixed(text.astype(np.uint64), 11)), return_index=True, return_counts=True)
    return text[first], h[first], count


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(text: np.ndarray, h: np.ndarray, w: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """m 64-bit register values for each of n texts, from (text, shingle, multiplicity); all zero for an empty text."""
    out = np.zeros((n, m), np.uint64)
    total = np.bincount(text, w, n)
    todo, spread = np.flatnonzero(total > 0), 5.0
    while len(todo):
        pick = np.isin(text, todo) if len(todo) < n else slice(None)
        best, value = _first_points(text[pick], h[pick], w[pick], np.where(total > 0, m * (np.log(m) + spread) / np.maximum(total, 1), 0), n, m)
        full = np.isfinite(best).all(axis=1)
        done = todo[full[todo]]
        out[done] = value[done]
        todo, spread = todo[~full[todo]], 2 * spread + 10
    return out


def _first_points(text, h, w, until, n, m):
    best, value = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    where, times, ids = [], [], []
    low, width = 0, 1
    while len(text):
        key, t, alive, j = mixed(h, 101 + low), np.zeros(len(h)), np.arange(len(h)), 0
        while len(alive):
            r = mixed(key[alive], 2 * j + 1)
            t = t - np.log(_unit(r)) / width
            on = t < until[text[alive]]
            alive, t, r = alive[on], t[on], r[on]
            extra = mixed(r, 7)
            height = low + _unit(mixed(extra, 3)) * width
            ok = height < w[alive]
            where.append(text[alive[ok]] * m + (extra[ok] % np.uint64(m)).astype(np.int64))
            times.append(t[ok])
            ids.append(r[ok])
            j += 1
        low, width = low + width, max(1, low + width)
        more = w > low
        text, h, w = text[more], h[more], w[more]
    where, times, ids = (np.concatenate(x) if x else np.zeros(0) for x in (where, times, ids))
    where = where.astype(np.int64)
    np.minimum.at(best, where, times)
    won = times == best[where]
    value[where[won]] = ids[won]
    return best.reshape(n, m), value.reshape(n, m)


def signed(docs: DataFrame) -> DataFrame:
    """One row a document: its class (word sequence), band keys and signature."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text", SIGN_ROWS):
                words, off, h, new = shingle_hashes(piece["text"])
                n = piece.num_rows
                sig = signatures(*bags(h, new), n)
                bands = mixed(np.add.reduce(mixed(sig.reshape(n, BANDS, -1) + np.arange(REGISTERS // BANDS, dtype=np.uint64)), axis=2), 5) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                raw = words.tobytes()
                cls = [xxhash.xxh3_128_digest(raw[8 * i : 8 * j]) for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                lists = lambda x, kind: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel(), kind))
                yield pa.record_batch([piece["doc_id"].cast(pa.int64()), piece["key"], pa.array(cls, pa.binary()), pa.array(np.diff(off).astype(np.int32)), lists(bands.view(np.int64), pa.int64()), lists((sig & np.uint64(0xFFFF)).astype(np.uint16).view(np.int16), pa.int16())], names=["doc_id", "key", "cls", "n_words", "bands", "sig"])

    return docs.mapInArrow(run, SIGNED)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two multisets of hashes."""
    both, counts = np.concatenate([a, b]), np.concatenate([np.ones(len(a), np.int64), np.full(len(b), 1 << 32)])
    _, inv = np.unique(both, return_inverse=True)
    x = np.bincount(inv, counts).astype(np.int64)
    x, y = x & 0xFFFFFFFF, x >> 32
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are at least ``threshold`` similar."""
    ta, tb = (texts.select(F.col("cls").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text_a", SIGN_ROWS):
                (_, _, ha, oa), (_, _, hb, ob) = (shingle_hashes(piece[c]) for c in ("text_a", "text_b"))
                ok = [jaccard(ha[oa[i] : oa[i + 1]], hb[ob[i] : ob[i + 1]]) >= threshold for i in range(piece.num_rows)]
                yield pa.record_batch([x.filter(pa.array(ok, pa.bool_())) for x in (piece["a"], piece["b"])], names=["a", "b"])

    return pairs.select("a", "b").join(ta, "a").join(tb, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def _between(group: DataFrame, label: DataFrame, reps: DataFrame, texts: DataFrame, threshold: float, chunk: int = CHUNK) -> DataFrame | None:
    """Links between different components of classes that share buckets (``group``: cls, grp); None if there is nothing to ask."""
    member = written(group.join(label, F.col("cls") == F.col("v"), "left").select("cls", "grp", F.coalesce("label", "cls").alias("comp")))
    size = member.groupBy("grp", "comp").agg(F.count("*").alias("n"))
    # A component above ``chunk`` has chunks of its own, the others share chunks.
    size = size.withColumn("big", F.when(F.col("n") > chunk, F.col("comp")))
    open_ = size.groupBy("grp").agg(F.count("*").alias("comps"), F.sum(F.when(F.col("big").isNull(), F.col("n"))).alias("mixed")).where("comps > 1")
    size = written(size.join(open_, "grp").select("grp", "comp", "big", F.ceil(F.when(F.col("big").isNull(), F.col("mixed")).otherwise(F.col("n")) / chunk).cast("int").alias("parts")))
    if size.limit(1).count() == 0:
        return None
    part = lambda i: F.xxhash64("big", i)
    chunks = size.groupBy("grp", "big").agg(F.max("parts").alias("parts")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(F.col("grp").alias("g"), F.col("big").alias("of"), F.xxhash64("big", "i").alias("other"))
    mine = member.join(size, ["grp", "comp"]).select("grp", "cls", "comp", "big", part(F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")).alias("own"))
    met = mine.join(chunks, (F.col("grp") == F.col("g")) & ~F.coalesce(F.col("big") == F.col("of"), F.lit(False)))
    met = met.select("cls", "comp", "own", F.xxhash64("grp", F.least("own", "other"), F.greatest("own", "other")).alias("block"))
    signed = met.join(reps.select("cls", "sig"), "cls")
    # Signatures first: texts go only to the blocks where their class has someone to be compared with.
    asked = written(signed.groupBy("block").applyInArrow(_askers, signed.select("cls", "comp", "own", "block", "sig").schema))
    return written(asked.join(texts, "cls").groupBy("block").applyInArrow(lambda table: _block_links(table, threshold), "a binary, b binary"))


def _pairs_to_ask(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which classes of a block are to be compared (by signatures, of different components), and how far they agree."""
    own, comp = table["own"].to_numpy(), table["comp"].to_pylist()
    n = len(own)
    sig = np.array(table["sig"].to_pylist(), np.int16).reshape(n, -1)
    number = {c: k for k, c in enumerate(sorted(set(comp)))}
    kind = np.array([number[c] for c in comp], np.int64)
    agree = np.zeros((n, n), np.int16)
    for r in range(sig.shape[1]):
        agree += sig[:, r, None] == sig[None, :, r]
    ask = np.triu((agree >= AGREE) & (kind[:, None] != kind[None, :]), 1)
    if len(set(own.tolist())) > 1:  # within one chunk, another block asks
        ask &= own[:, None] != own[None, :]
    i, j = np.nonzero(ask)
    order = np.argsort(-agree[i, j], kind="stable")
    return kind, i[order], j[order]


def _askers(table: pa.Table) -> pa.Table:
    _, i, j = _pairs_to_ask(table)
    return table.take(pa.array(np.union1d(i, j))).select(["cls", "comp", "own", "block", "sig"])


def _block_links(table: pa.Table, threshold: float) -> pa.Table:
    cls = table["cls"].to_pylist()
    kind, i, j = _pairs_to_ask(table)
    _, _, h, off = shingle_hashes(table["text"])
    root, found = list(range(int(kind.max()) + 1)), []

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        p, q = top(kind[x]), top(kind[y])
        if p != q and jaccard(h[off[x] : off[x + 1]], h[off[y] : off[y + 1]]) >= threshold:
            root[p] = q
            found.append((cls[x], cls[y]))
    released()
    return pa.table({"a": pa.array([f[0] for f in found], pa.binary()), "b": pa.array([f[1] for f in found], pa.binary())})


def classes(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, key, class_id (least doc_id of its group), kept, n_words."""
    docs = docs.select("doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))
    s = written(signed(docs))
    reps = written(s.where("n_words > 0").groupBy("cls").agg(F.min(F.struct("doc_id", "key")).alias("r"), F.first("bands").alias("bands"), F.first("sig").alias("sig")).select("cls", "r.doc_id", "r.key", "bands", "sig"))
    band = written(reps.select("cls", F.explode("bands").alias("band")))
    led = band.groupBy("band").agg(F.min("cls").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    star = written(looked_up(band, "band", led, "a").where("cls != a").groupBy("a", F.col("cls").alias("b")).agg(F.lit(1).alias("x")).drop("x"))
    names = star.select(F.col("a").alias("cls")).unionByName(star.select(F.col("b").alias("cls"))).distinct()
    texts = written(reps.select("cls", "key").join(names, "cls").join(docs.select("key", "text"), "key").dropDuplicates(["cls"]).select("cls", "text"))
    links = written(verified(star, texts, threshold))
    label = written(components(links))
    group = components(star).select(F.col("v").alias("cls"), F.col("label").alias("grp"))
    more = _between(group, label, reps, texts, threshold)
    if more is not None:
        label = components(links.unionByName(more))
    named = written(reps.select("cls", "doc_id").join(label, F.col("cls") == F.col("v"), "left").select("cls", "doc_id", F.coalesce("label", "cls").alias("label")))
    least = named.groupBy("label").agg(F.min(F.struct("doc_id")).alias("least"))
    of = looked_up(named.select("cls", "label"), "label", least, "least").select("cls", F.col("least.doc_id").alias("class_id"))
    out = looked_up(s.select("doc_id", "key", "cls", "n_words"), "cls", of, "class_id", "left")
    out = out.withColumn("class_id", F.when(F.col("n_words") > 0, F.col("class_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "key", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "n_words")


def dedup(docs: DataFrame, **options) -> DataFrame:
    """The documents with one of each group left (that of the least doc_id), with all their columns, whatever their names."""
    out = written(classes(docs, **options))
    gone = out.where("not kept").select(F.col("key").alias("gone")).distinct()
    kept = out.where("kept and n_words > 0").select("class_id", "key")
    twice = kept.groupBy("class_id").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("class_id").alias("c"), "first")
    left = docs.select(whole_row(docs).alias("row"), F.xxhash64("doc_id", "text").alias("own")).join(gone, F.col("own") == F.col("gone"), "left_anti")
    if not twice.limit(1).count():
        return left.select("row.*")
    # Rows of one doc_id in one group: the least key stays, once.
    again = kept.join(twice, F.col("class_id").eqNullSafe(F.col("c"))).select("key", "first").distinct()
    rest, same = left.join(again, F.col("own") == F.col("key"), "left_anti"), left.join(again, (F.col("own") == F.col("key")) & (F.col("own") == F.col("first")))
    return rest.select("row.*").unionByName(same.dropDuplicates(["own"]).select("row.*"))
