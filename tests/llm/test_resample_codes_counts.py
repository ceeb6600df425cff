"""Importance resampling, vector codes and token counts against brute force, with their defined cases."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trialweave.llm import resample, token_counts, token_files, vector_codes
from trialweave.llm.queries import QUERIES
from trialweave.session import shared_dir

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD_11 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


# 11 importance resampling


def runs(text, n):
    w = WORD_11.findall((text or "").translate(LOWER))
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)], len(w)


def resampled(docs, target, n=1, buckets=10_000, min_words=20):
    s, t = Counter(), Counter()
    of = lambda f: zlib.crc32(f.encode()) % buckets
    for _, text in docs:
        s.update(map(of, runs(text, n)[0]))
    for text in target:
        t.update(map(of, runs(text, n)[0]))
    all_s, all_t, rows = sum(s.values()), sum(t.values()), []
    for i, text in docs:
        f, words = runs(text, n)
        weight = sum(math.floor(1000 * math.log((t[of(x)] + 1) * (all_s + buckets) / ((s[of(x)] + 1) * (all_t + buckets)))) for x in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    best = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = [r[:4] for r in best[: 10 * len(best) // 100]]
    ranked = [(*r, k + 1) for k, r in enumerate(drawn)]
    left = Counter(r[:4] for r in rows) - Counter(drawn)
    return sorted(ranked + [(*r, None) for r in left.elements()], key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("order", [1, 3])
def test_resample(spark, order):
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = rows_of(resample.resample(docs, target, max_order=order, slice_bytes=20_000))
    assert got == resampled([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], order)


def test_resample_of_messy_rows(spark, messy, empty):
    want = resampled([(r["doc_id"], r["text"]) for r in messy.collect()], [None, "hello W5"], 2, 50, 3)
    target = spark.createDataFrame([(None, 1), ("hello W5", 2)], "text string, feature long")
    assert rows_of(resample.resample(messy, target, max_order=2, buckets=50, min_words=3)) == want
    assert resample.resample(empty, target).collect() == []
    none = resample.resample(messy, target.where("false"), min_words=3).collect()
    assert len(none) == messy.count() and sum(r["rank"] is not None for r in none) == 0


def test_resample_draws_copies_apart(spark):
    """Repeated rows are documents of their own, and equal scores go by id."""
    docs = spark.createDataFrame([(i // 2, "word " * 25) for i in range(60)], "doc_id long, text string")
    got = resample.resample(docs, docs.select("text")).collect()
    assert len(got) == 60 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5, 6]
    best = sorted(got, key=lambda r: (-r["score"], r["doc_id"]))[:6]
    assert Counter((r["doc_id"], r["score"]) for r in best) == Counter((r["doc_id"], r["score"]) for r in got if r["rank"])


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1 -\x00\x7fé \U0001f600"))), st.integers(1, 3))
@settings(max_examples=80, deadline=None)
def test_features(texts, order):
    names, numbers, of, n_words = resample.features(pa.array([None, *texts], pa.string()).slice(1), order)
    names = names.to_pylist()
    assert len(set(names)) == len(names)
    got = [Counter(names[k] for k, d in zip(numbers, of, strict=True) if d == i) for i in range(len(texts))]
    assert got == [Counter(runs(t, order)[0]) for t in texts] and n_words.tolist() == [runs(t, 1)[1] for t in texts]


# 12 vector codes


def codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    """The whole contract in Python's integers."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in rows), default=0) // parts) * parts
    whole = [[int(x) * scale if abs(x) > 2**53 else math.floor(x * scale) for x in r[1]] + [0] * (width - len(r[1])) for r in rows]
    step = width // parts
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, list(rows[k][1])))
    cut = lambda k, p: whole[k][p * step : (p + 1) * step]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    books = [[cut(k, p) for k in order[:entries]] for p in range(parts)]
    near = lambda k, p: min((dist(cut(k, p), e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            at = [near(k, p)[1] for k in range(len(rows))]
            mine = {i: [cut(k, p) for k in range(len(rows)) if at[k] == i] for i in set(at)}
            new.append([[sum(c) // len(mine[i]) for c in zip(*mine[i], strict=True)] if i in mine else e for i, e in enumerate(books[p])])
        books = new
    out, label = [], Counter()
    for k, (i, _, of) in enumerate(rows):
        best = [near(k, p) for p in range(parts)]
        out.append((i, "".join(f"{b:02x}" for _, b in best), sum(d for d, _ in best), of))
        label[of] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    most = 2**63 - 1
    return sorted(((i, c, min(e, most), min(label[of], most), digest) for i, c, e, of in out), key=repr)


VECTORS = "vec_id long, embedding array<double>, label int, code string, error int"


def test_vector_codes_of_messy_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8).round(1) / 3], int(i % 3) if i % 4 else None) for i in range(40)]
    rows += [(7, rows[7][1], 1), (5, rows[8][1], 9), (None, rows[3][1], None), (90, None, 1), (91, [1.0, None, *[0.0] * 6], 1), (92, [float("nan")] * 8, 1), (93, [float("-inf")] * 8, 2), (94, [0.5, -0.5], 2), (95, [], 2), (-1, [0.0] * 8, 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(3)
    got = rows_of(vector_codes.compress(df, entries=12))
    assert got == codes(rows, entries=12)
    assert vector_codes.compress(df.where("false")).collect() == []


def test_vector_codes_of_large_components(spark):
    rows = [(i, [x * 10.0**e for x in (0.5, -1.25, 3.0, 7.5)], None) for i, e in enumerate((0, 3, 5, 7, 12, 20, 200, 5, 7))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(2)
    assert rows_of(vector_codes.compress(df, entries=3)) == codes(rows, entries=3)


@given(st.integers(1, 40), st.integers(1, 6), st.integers(0, 10_000), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_va_file_is_exact(n, d, seed, bits):
    rng = np.random.default_rng(seed)
    entries, queries = rng.integers(-20, 20, (n, d)), rng.integers(-30, 30, (50, d))
    best, dist = vector_codes.VaFile(entries, bits).nearest(queries)
    every = ((queries[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (dist == every.min(axis=1)).all()


def test_va_file_filters():
    """The bounds leave few of the entries to be refined."""
    rng = np.random.default_rng(0)
    entries, queries = (rng.normal(size=(n, 16)) * 128 for n in (256, 500))
    f = vector_codes.VaFile(np.floor(entries).astype(np.int64))
    assert f.candidates(np.floor(queries).astype(np.int64)).mean() < 0.25


# 13 token counts


def counted(texts, path=WORD_BPE):
    if path.endswith(".model"):
        import sentencepiece

        return [len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t or "")) for t in texts]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return [len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_op13_counts_as_the_library(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_token_counts"](spark, SF).collect()}
    n = dict(zip(docs, counted(docs.values()), strict=True))
    assert got == {i: (len((t or "").encode()), n[i], n[i] > 2048) for i, t in docs.items()}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_of_messy_rows(spark, messy, empty, name):
    path, cache = public_tokenizers.path(name), shared_dir(spark)
    rows = messy.select("doc_id", "text").collect()
    want = sorted(((r[0], len((r[1] or "").encode()), n, n > 5) for r, n in zip(rows, counted([r[1] for r in rows], path), strict=True)), key=repr)
    assert token_counts.count_tokens(empty, path, cache).collect() == []
    assert rows_of(token_counts.count_tokens(messy, path, cache, limit=5)) == want
    assert rows_of(token_counts.count_tokens(messy, path, cache, limit=5)) == want


def test_cache_holds_each_content_once_and_answers_alone(spark, monkeypatch):
    """A second run encodes what is new and takes the rest from the cache; another version has counts of its own."""
    cache = shared_dir(spark)
    docs = spark.createDataFrame([(i, ["Same  text\n", "same text", "same text <|startoftext|>", "other", None, ""][i % 6]) for i in range(300)], "doc_id long, text string").repartition(5)
    first = rows_of(token_counts.count_tokens(docs, WORD_BPE, cache))
    table = spark.read.parquet(cache)
    assert table.count() == 4 == table.select("content").distinct().count()
    # What the cache says is what is returned: the texts are not encoded again.
    other = shared_dir(spark)
    table.withColumn("n_tokens", table["n_tokens"] + 1000).write.parquet(other)
    more = docs.union(spark.createDataFrame([(1000, "quite new")], docs.schema))
    got = rows_of(token_counts.count_tokens(more, WORD_BPE, other))
    assert {r[0]: r[2] for r in got} == {r[0]: r[2] + 1000 for r in first} | {1000: counted(["quite new"])[0]}
    assert spark.read.parquet(other).count() == 5
    spark.read.parquet(cache).unionAll(spark.read.parquet(cache)).write.mode("append").parquet(other)  # rows that two runs added at once
    monkeypatch.setattr(token_counts, "version", lambda path: "another version")
    assert rows_of(token_counts.count_tokens(docs, WORD_BPE, other)) == first and spark.read.parquet(other).count() == 17


@given(st.text(alphabet=list("aA1 \t\n\x0b\x0c.,'<|s>é́İ\x1c ")))
@settings(max_examples=200, deadline=None)
def test_normalising_keeps_counts(text):
    plain = text.isascii() and "<|" not in text
    normal = re.sub("[ \t\n\x0b\f\r]+", " ", text.lower()).strip(" ") if plain else text
    assert token_counts.counts(pa.array([text]), WORD_BPE).tolist() == counted([normal]) == counted([text])


def test_normalised(spark):
    texts = ["A  b\t\n C", " x ", "É  A", "A <| B", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(token_counts.normalised(df["text"], True)).collect()] == ["a b c", "x", "É  A", "A <| B", "", ""]
    assert token_counts.folds_case(WORD_BPE) and not token_counts.folds_case(public_tokenizers.path("byte_bpe_50k.json")) and token_files.END_ID == 2
