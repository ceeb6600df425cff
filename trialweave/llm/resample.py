"""Target-distribution importance resampling with a dictionary of distinct features.

Features are runs of consecutive words; a feature's bucket is a hash of its string. Documents are read once, in slices of
some megabytes: a slice becomes the list of its distinct features with their counts, and for each document the counts of
its features, named by their place in that list. From the lists, one aggregate makes the dictionary, with one row for each
distinct feature of the corpus, where each is hashed once; it adds up to bucket totals. The gain of a bucket is the
logarithm of its share of the target's features over its share of the corpus', smoothed. Dictionary rows take the gains of
their buckets, slices take those of their features, and each slice adds up its documents' weights. A score is the weight
plus Gumbel noise from a hash of the document's id, so the documents of highest score are a sample without replacement.

A frequent word is one row a slice, so no key is hot, and texts are never shuffled. Gains are at most ``buckets`` rows and
are broadcast. Ranks come by ranges of the score: a document's place in its range, plus the rows of the ranges before.

Defined cases: a null text has no words; a document without features has weight 0; a null doc_id is hashed as an empty
text and comes last among equal scores; repeated rows are separate documents, each with a rank of its own; empty tables
give no rows, an empty target gives gains against no features. Only the columns named are used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm._common import _split, frame, one_array, pack, released, unframe, unpack, written

BUCKETS, MAX_ORDER, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
SLICE_BYTES = 16 << 20
#: Lower-cases A-Z; every other ASCII character but digits and letters becomes a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def features(column, max_order: int = MAX_ORDER) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features of all texts, the feature numbers in a row, the text of each, and the words of each text."""
    texts = pc.fill_null(one_array(column).cast(pa.string()), "")
    raw = texts.buffers()[2]
    clean = pa.Array.from_buffers(pa.string(), len(texts), [None, texts.buffers()[1], pa.py_buffer(raw.to_pybytes().translate(_WORD_BYTES)) if raw else pa.py_buffer(b"")], offset=texts.offset)
    coded, off = _split(clean, False)
    words, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    strings, numbers, of = [words], [at], [text]
    run, names, place, size = at, words, np.arange(len(at)), len(words)
    for _ in range(1, max_order):
        # A run of k words is a run of k - 1 words and the word after it, in the same text.
        on = np.flatnonzero(place + len(strings) < np.concatenate([off[1:], [0]])[text[place]]) if len(place) else place
        pair, run = np.unique(run[on] * max(1, len(words)) + at[place[on] + len(strings)], return_inverse=True)
        names = pc.binary_join_element_wise(names.take(pa.array(pair // max(1, len(words)))), words.take(pa.array(pair % max(1, len(words)))), " ")
        place = place[on]
        strings.append(names)
        numbers.append(run + size)
        of.append(text[place])
        size += len(names)
    return pa.concat_arrays(strings), np.concatenate(numbers), np.concatenate(of), np.diff(off)


def _slices(batches, limit: int):
    """Tables of about ``limit`` bytes of text, one row at least."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < batch.num_rows:
            before = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, before + limit - size, "right")))
            held.append(batch.slice(i, j - i))
            size += int(ends[j - 1] - before)
            i = j
            if size >= limit or i < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def sliced(docs: DataFrame, *, max_order: int = MAX_ORDER, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """A row for each slice of ``docs`` (doc_id, text): its features with their counts, and its documents' feature counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"slice long, features array<string>, counts array<long>, doc_ids array<{kind}>, n_words array<long>, n_features array<long>, bags binary"

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, table in enumerate(_slices(batches, slice_bytes)):
            names, numbers, text, n_words = features(table["text"], max_order)
            counts = np.bincount(numbers, minlength=len(names))
            bag, times = np.unique(text * max(1, len(names)) + numbers, return_counts=True)
            distinct = np.bincount(bag // max(1, len(names)), minlength=table.num_rows)
            packed = frame(pack(distinct.astype(np.uint64), 4), pack((bag % max(1, len(names))).astype(np.uint64), 4), pack(times.astype(np.uint64), 4))
            one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, t))
            yield pa.record_batch(
                [
                    pa.array([(part << 32) + k], pa.int64()), one(names, None), one(counts, pa.int64()), one(one_array(table["doc_id"]), None), one(n_words, pa.int64()),
                    one(np.bincount(text, minlength=table.num_rows), pa.int64()), pa.array([packed], pa.binary()),
                ],
                names=["slice", "features", "counts", "doc_ids", "n_words", "n_features", "bags"],
            )
            released()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def dictionary(slices: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row for each distinct feature: feature, n, bucket."""
    each = slices.select(F.explode(F.arrays_zip("features", "counts")).alias("x")).select(F.col("x.features").alias("feature"), F.col("x.counts").alias("n"))
    return each.groupBy("feature").agg(F.sum("n").alias("n")).withColumn("bucket", F.pmod(F.crc32(F.encode("feature", "UTF-8")), F.lit(buckets)).cast("int"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for the buckets of two dictionaries."""
    s = corpus.groupBy("bucket").agg(F.sum("n").alias("s"))
    t = target.groupBy("bucket").agg(F.sum("n").alias("t"))
    both = written(s.join(t, "bucket", "full").na.fill(0, ["s", "t"]))
    total = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    up = (F.col("t") + 1).cast("double") * F.lit(float(total[0] + buckets))
    down = (F.col("s") + 1).cast("double") * F.lit(float(total[1] + buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.ln(up / down)).cast("long").alias("gain"))


def weights(docs: DataFrame, target: DataFrame, *, buckets: int = BUCKETS, max_order: int = MAX_ORDER, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight) of all documents; ``target`` has a column text."""
    slices = written(sliced(docs, max_order=max_order, slice_bytes=slice_bytes))
    wanted = dictionary(sliced(target.select(F.lit(0).cast("long").alias("doc_id"), "text"), max_order=max_order, slice_bytes=slice_bytes), buckets)
    known = written(dictionary(slices, buckets))
    priced = known.join(F.broadcast(gains(known, wanted, buckets)), "bucket").select("feature", "gain")
    asked = slices.select("slice", F.posexplode("features").alias("at", "feature"))
    answers = asked.join(priced, "feature").select(F.col("slice").alias("of_slice"), "at", "gain")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(key, own, answers):
        if not own.num_rows:
            return pa.table({"doc_id": own["doc_ids"].combine_chunks().flatten(), "n_words": pa.array([], pa.int64()), "n_features": pa.array([], pa.int64()), "weight": pa.array([], pa.int64())})
        gain = np.zeros(answers.num_rows, np.int64)
        gain[answers["at"].to_numpy()] = answers["gain"].to_numpy()
        distinct, feature, times = (unpack(x, 4).astype(np.int64) for x in unframe(own["bags"][0].as_py()))
        total = np.concatenate([[0], np.cumsum(gain[feature] * times)])
        off = np.concatenate([[0], np.cumsum(distinct)])
        cells = [own[c].combine_chunks().flatten() for c in ("doc_ids", "n_words", "n_features")]
        released()
        return pa.table([*cells, pa.array(total[off[1:]] - total[off[:-1]], pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    own = slices.select("slice", "doc_ids", "n_words", "n_features", "bags")
    return own.groupBy("slice").cogroup(answers.groupBy("of_slice")).applyInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with column rank: their number in an order of all of them, from 1. No task holds more than a range."""
    ranges = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    sizes = ranges.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row a range
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    numbered = ranges.withColumn("_part", part).join(F.broadcast(before), "_part")
    return numbered.withColumn("rank", F.col("_before") + F.col("_place") - F.shiftleft("_part", 33) + 1).drop("_part", "_before", "_place")


def resample(docs: DataFrame, target: DataFrame, *, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED, **options) -> DataFrame:
    """Rows (doc_id, n_features, weight, score, rank) of all documents; rank is null for those that are not drawn."""
    scored = written(weights(docs.select("doc_id", "text"), target.select("text"), **options).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    out = ("doc_id", "n_features", "weight", "score")
    may = F.col("n_words") >= min_words
    n = scored.where(may).count()
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]
    places = ranked(scored.where(may).select(*out), order)
    drawn = places.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")).cast("long"))
    return drawn.select(*out, "rank").unionByName(scored.where(~may).select(*out, F.lit(None).cast("long").alias("rank")))
