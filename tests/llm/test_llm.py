"""Each operator against brute force, and over messy and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trialweave.llm import chat, components, decontaminate, lattice, lm, mixing, near_dup, quality, substrings, token_files, urls
from trialweave.llm._common import bucketed, frame, inside, pack, pack_sorted, rolling, split_words, unframe, unpack, unpack_sorted

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def split(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


# Shared pieces


@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x0c\rabAé\x1c\u00a0"))))
@settings(max_examples=60, deadline=None)
def test_split_words(texts):
    words, at, off = split_words(pa.array(texts, pa.string()))
    got = [[words[i].decode() for i in at[a:b]] for a, b in zip(off[:-1], off[1:], strict=True)]
    assert got == [split(t) for t in texts]


def test_rolling_and_packing():
    h = np.random.default_rng(0).integers(0, 2**63, 500).astype(np.uint64)
    h[300:340] = h[100:140]
    r = rolling(h, 25)
    same = {(i, j) for i in range(len(r)) for j in range(i) if (h[i : i + 25] == h[j : j + 25]).all()}
    assert {(i, j) for i in range(len(r)) for j in range(i) if r[i] == r[j]} == same and same
    assert inside(np.array([0, 3, 3, 8]), 3).tolist() == [True, False, False, True, True, True]
    k = np.sort(bucketed(h, 7)) & np.uint64((1 << 40) - 1)
    assert (unpack(pack(k, 5), 5) == k).all() and (unpack_sorted(pack_sorted(np.sort(k))) == np.sort(k)).all() and unframe(frame(b"a", b"")) == [b"a", b""]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {v: v for e in links for v in e}
    for _ in root:
        new = dict(root)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b], root[a], root[b])
        if new == root:
            break
        root = new
    assert {r["v"]: r["label"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()} == root


# 1 language model


def walk_scores(rows):
    """A walk through the automaton, token by token, with the state carried and failure arcs followed."""
    toks = [(i, held, [*split(t, True), None]) for i, t, held in rows]
    n1, n2, n3, arcs = Counter(), Counter(), Counter(), {}
    for _, held, w in toks:
        if not held:
            w = ["\n", *w]
            n1.update(w[1:])
            n2.update(zip(w, w[1:], strict=False))
            n3.update(zip(w, w[1:], w[2:], strict=False))
    def d(n):
        ones, twos = (sum(k == j for k in n.values()) for j in (1, 2))
        return ones / (ones + 2 * twos) if ones and twos else 0.5

    total, kinds = sum(n1.values()), len(n1)
    unigram = lambda x: math.log10((n1[x] + 0.5) / (total + 0.5 * (kinds + 1)))
    for n in (n2, n3):
        context, follow, disc = Counter(), Counter(k[:-1] for k in n), d(n)
        for k, c in n.items():
            context[k[:-1]] += c
        for s in context:
            arcs[s] = [math.log10(disc * follow[s] / context[s]), {}]
        for k, c in n.items():
            lower = k[1:-1]
            arcs[k[:-1]][1][k[-1]] = math.log10((c - disc) / context[k[:-1]] + 10 ** (arcs[k[:-1]][0] + weight(arcs, lower, k[-1], unigram)[0]))
    out = []
    for i, held, w in toks:
        state, base, score = ("\n",), 0.0, 0.0
        for x in w:
            base += unigram(x)
            got, state = weight(arcs, state, x, unigram)
            score += got
        out.append((i, held, len(w), sum(n1[x] > 0 for x in w), total, base, score))
    return out


def weight(arcs, state, x, unigram):
    """The weight of the arcs taken from a state for a word, and the state they lead to."""
    got, at = 0.0, state
    while at and x not in arcs.get(at, (0, {}))[1]:
        got += arcs[at][0] if at in arcs else 0.0
        at = at[1:]
    got += arcs[at][1][x] if at else unigram(x)
    to = (*state, x)[-2:] if at else (x,)
    return got, to if to in arcs else to[1:]


def test_lm_messy(spark, messy, empty):
    held = F.coalesce(lm.held_out_by_crc(F.col("doc_id")), F.lit(False))
    got = sorted(map(tuple, lm.score(messy, held).collect()), key=repr)
    rows = [(r["doc_id"], r["text"], r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in messy.collect()]
    want = sorted(walk_scores(rows), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)
    assert lm.score(empty, held).count() == 0


def test_lm_repeats(spark):
    """Few words, so that pairs and trigrams come often, in training and beside it; also over several groups."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefg") * rng.choice([1, 1, 2]) for _ in range(rng.randrange(30)))) for i in range(120)] + [(500 + i, "p q r s t u v") for i in range(3)]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    got = sorted(map(tuple, lm.score(spark.createDataFrame(rows, "doc_id long, text string"), lm.held_out_by_crc(F.col("doc_id"))).collect()))
    want = sorted(walk_scores([(i, t, held(i)) for i, t in rows]))
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_automaton_is_a_distribution():
    """From every state the probabilities of all words and the unknown one sum to 1."""
    c, tokens, kinds = np.array([5.0, 3.0, 2.0]), 10, 3
    a = lm.Automaton(c, tokens, kinds)
    # bigrams of word 0: to word 0 twice, to word 1 once, to word 2 never
    a.add_words(np.array([0, 0, 0]), np.array([0, 1, 2]), np.array([2, 1, 0]), np.array([2, 0, 0]), np.array([3, 0, 0]), 0.6)
    # trigrams of the pair (0, 0): to word 1 once, to word 0 once, to word 2 never
    a.add_pairs(np.array([0, 0, 0]), np.array([0, 1, 2]), np.array([1, 1, 0]), np.array([2.0, 0, 0]), np.array([2, 1, 0]), 0.7)
    unknown = 0.5 / (tokens + 0.5 * (kinds + 1))
    assert (10**a.root).sum() + unknown == pytest.approx(1)
    assert (10**a.word_arc).sum() + 10 ** a.word_failure[0] * unknown == pytest.approx(1)
    assert (10**a.pair_arc).sum() + 10 ** (a.pair_failure[0] + a.word_failure[0]) * unknown == pytest.approx(1)


def test_lm_held_out_beats_base(spark):
    rows = lm.score(spark.read.parquet(f"{SF}/documents.parquet"), lm.held_out_by_crc(F.col("doc_id"))).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert rows[1] > rows[0]


# 2 mixing


def test_targets():
    t = mixing.targets({"a": 10, "b": 1000, "c": 10, None: 0})
    assert t["a"] == pytest.approx(30) and t["c"] == pytest.approx(30) and t[None] == 0 and t["b"] == pytest.approx(960)
    assert mixing.targets({}) == {}


def test_split_tree():
    q = np.array([100, 7, 0, 33])
    cut = mixing.split_tree(q, 8, np.random.default_rng(1))
    assert cut.shape == (8, 4) and (cut.sum(axis=0) == q).all() and (cut >= 0).all()
    assert max(cut.sum(axis=1)) - min(cut.sum(axis=1)) <= 3


def test_mix(spark, messy, empty):
    for docs in (messy, spark.read.parquet(f"{SF}/documents.parquet")):
        got = mixing.taken(mixing.mix(docs)).join(docs.select("doc_id", "source").distinct(), "doc_id", "left").collect()
        again = mixing.taken(mixing.mix(docs.repartition(3))).collect()
        assert sorted((repr(r["doc_id"]), r["size"], r["taken"]) for r in again) == sorted({(repr(r["doc_id"]), r["size"], r["taken"]): 0 for r in got} and [(repr(r["doc_id"]), r["size"], r["taken"]) for r in mixing.taken(mixing.mix(docs)).collect()])
        assert all(r["taken"] <= 3 * r["size"] for r in got)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by = mixing.mix(docs).groupBy("source").agg(F.sum(F.col("size") * F.size("shards")).alias("t"), F.first("target").alias("g"), F.max("size").alias("most")).collect()
    sizes = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum(mixing.size_of(F.col("text"))).alias("n")).collect()}
    want = mixing.targets(sizes)
    for r in by:
        assert r["g"] == pytest.approx(want[r["source"]]) and abs(r["t"] - r["g"]) <= r["most"]
    assert mixing.mix(empty).count() == 0
    clash = messy.withColumns({c: F.lit("x") for c in ("row", "mix", "copy", "slice", "blocks", "of", "s", "k", "upto", "fill", "own", "gone", "first", "c", "class_id")})
    assert mixing.mixed_rows(clash).columns == clash.columns and mixing.mixed_rows(clash).count() == mixing.mixed_rows(messy).count()
    assert near_dup.dedup(clash).columns == clash.columns and near_dup.dedup(clash).count() == 7
    out = mixing.mixed_rows(messy)
    assert out.columns == messy.columns and out.count() == mixing.mix(messy).select(F.sum(F.size("shards"))).first()[0]


# 3 substrings


def kept_by_brute_force(rows):
    words = {k: split(t) for k, t in enumerate(t for _, t in rows)}
    ids = [i if i is not None else 2**63 - 1 for i, _ in rows]
    first: dict = {}
    for k, w in words.items():
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            first[key] = min(first.get(key, ids[k]), ids[k])
    out = []
    for k, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < ids[k]:
                gone[i : i + 50] = [True] * 50
        out.append((rows[k][0], len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substrings(spark, empty):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(80)]
    rows = [(None, None), (3, ""), (9, "a b c"), (9, "a b c")]
    for i in range(20, 60):
        w = [f"t{rng.randrange(10**6)}" for _ in range(rng.randrange(10, 120))]
        at = rng.randrange(len(w))
        w[at:at] = passage[rng.randrange(0, 20) : rng.randrange(40, 81)]
        rows.append((None if i == 30 else i, " ".join(w)))
    rows += [(70, " ".join(passage * 3)), (71, " ".join(passage * 2)), (71, " ".join(passage * 2))]
    got = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == kept_by_brute_force(rows)
    assert substrings.dedup_substrings(empty).count() == 0
    with pytest.raises(ValueError):
        substrings.dedup_substrings(empty, window=40)


def test_substrings_messy(messy):
    got = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substrings.dedup_substrings(messy).collect()}
    assert got[3, 60_000] == 0 and got[4, 60_000] == 60_000 and got[None, 0] == 0


# 4 decontamination


def found_by_brute_force(docs, items):
    def sh(text):
        w = [x for x in (re.sub(r"^[\W_]+|[\W_]+$", "", y.lower()) for y in split(text)) if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    out = []
    for d, t in docs:
        for i, q in items:
            a, b = sh(t), sh(q)
            if b and len(a & b) >= 0.8 * len(b):
                out.append((d, i, len(b), len(a & b)))
    return sorted(out, key=repr)


def test_decontaminate(spark, messy, empty):
    rng = random.Random(2)
    items = [(i, " ".join(f"q{rng.randrange(500)}" for _ in range(rng.choice([1, 3, 5, 20, 60])))) for i in range(30)] + [(50, None), (51, ""), (None, "one two three four five six seven eight")]
    docs = [(r["doc_id"], r["text"]) for r in messy.collect()]
    for i in range(100, 130):
        w = [f"z{rng.randrange(10**6)}" for _ in range(rng.choice([5, 300]))]
        q = split(items[i - 100][1])
        for _ in range(rng.choice([0, 0, 1, 2])):
            q[rng.randrange(len(q))] = "changed"
        docs.append((i, " ".join(w + [x.upper() + "," for x in q] + w)))
    schema = "doc_id long, text string"
    for block in (10**6, 40):
        got = decontaminate.find_items(spark.createDataFrame(docs, schema), spark.createDataFrame(items, "item_id long, text string"), block_shingles=block)
        assert sorted(((r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in got.collect()), key=repr) == found_by_brute_force(docs, items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    left = decontaminate.clean(messy, bench)
    assert left.columns == messy.columns and 6 not in {r["doc_id"] for r in left.collect()} and 3 in {r["doc_id"] for r in left.collect()}
    assert decontaminate.find_items(empty, bench).count() == 0 and decontaminate.find_items(messy, bench.where("false")).count() == 0


# 5 near-duplicates


def classes_by_brute_force(rows):
    bags = []
    for _, t in rows:
        w = split(t, True)
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            m = sum((bags[i] & bags[j]).values())
            if m and m / sum((bags[i] | bags[j]).values()) >= 0.8:
                root[top(i)] = top(j)
    key = lambda i: -1 if rows[i][0] is None else rows[i][0]
    least: dict = {}
    for i in range(len(rows)):
        least[top(i)] = min(least.get(top(i), key(i)), key(i))
    return sorted(((rows[i][0], None if least[top(i)] == -1 else least[top(i)]) for i in range(len(rows))), key=repr)


def test_near_dup_chain(spark):
    """Near copies whose links form no star: members are rarely 0.8 similar to the least class."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.choice([0, 2, 3, 4, 5, 6])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(900 + i, " ".join(f"r{rng.randrange(10**5)}" for _ in range(60))) for i in range(30)]
    got = near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["class_id"]) for r in got), key=repr) == classes_by_brute_force(rows)


def test_near_dup_recall(spark):
    """Pairs at similarities of 0.80 to 0.86: how many of those that exact weighted Jaccard links are found."""
    rng = random.Random(8)
    rows, linked = [], 0
    for i in range(400):
        w = [f"a{i}x{rng.randrange(10**6)}" for _ in range(300)]
        v = list(w)
        for at in rng.sample(range(10, 290), rng.choice([5, 6])):
            v[at] = f"b{rng.randrange(10**9)}"
        bags = [Counter(tuple(x[j : j + 5]) for j in range(len(x) - 4)) for x in (w, v)]
        linked += (bags[0] & bags[1]).total() / (bags[0] | bags[1]).total() >= 0.8
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    got = near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id <> class_id").count()
    assert linked > 200 and 0.99 * linked <= got <= linked


def test_near_dup_messy(messy, empty):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    got = near_dup.classes(messy).collect()
    assert sorted(((r["doc_id"], r["class_id"]) for r in got), key=repr) == classes_by_brute_force(rows)
    left = near_dup.dedup(messy)
    assert left.columns == messy.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=repr) == sorted([None, 1, 2, 3, 5, None, 8], key=repr)
    assert near_dup.classes(empty).count() == 0 and near_dup.dedup(empty).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**63, 400).astype(np.uint64)
    wa, wb = rng.integers(1, 40, 300), rng.integers(1, 40, 300)
    a, b = dict(zip(h[:300].tolist(), wa.tolist(), strict=True)), dict(zip(h[100:].tolist(), wb.tolist(), strict=True))
    true = sum(min(a.get(k, 0), b.get(k, 0)) for k in h.tolist()) / sum(max(a.get(k, 0), b.get(k, 0)) for k in h.tolist())
    s = near_dup.signatures(np.repeat([0, 1], 300), np.concatenate([h[:300], h[100:]]), np.concatenate([wa, wb]), 2, m=4096)
    assert abs((s[0] == s[1]).mean() - true) < 0.03
    assert (near_dup.signatures(np.zeros(1, int), h[:1], np.array([1]), 2)[1] == 0).all()


# 6 embeddings


def links_by_brute_force(rows):
    unit = []
    for _, e in rows:
        x = np.array(e, float) if e is not None and None not in e else np.zeros(1)
        n = np.linalg.norm(x)
        unit.append(x / n if n and np.isfinite(x).all() else None)
    n, root = [0] * len(rows), list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9:
                n[i] += 1
                n[j] += 1
                root[top(i)] = top(j)
    least: dict = {}
    for i, (v, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), v), v)
    return sorted((rows[i][0], n[i], least[top(i)]) for i in range(len(rows)))


def test_lattice(spark):
    rng = np.random.default_rng(6)
    rows = []
    for c in range(6):
        centre = rng.normal(size=64)
        rows += [(len(rows) + i, (centre + 0.15 * rng.normal(size=64)).tolist()) for i in range(40)]
    rows += [(1000 + i, rng.normal(size=64).tolist()) for i in range(50)] + [(2000 + i, rows[3][1]) for i in range(5)]
    rows += [(3000, None), (3001, [0.0] * 64), (3002, [float("nan")] * 64), (3003, [None] * 64), (3004, [1.0, 0.0]), (3005, [2.0, 0.0]), (3006, [])]
    for chunk in (2048, 16):
        for kind in ("float", "double"):
            got = lattice.link(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), chunk=chunk)
            assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()) == links_by_brute_force(rows)
    assert lattice.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    clash = spark.createDataFrame(rows + [(5, rows[50][1]), (5, rows[90][1]), (6, None)], "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("m", "unit", "keys", "each", "key", "place", "side", "label", "parts", "e", "n")})
    got = lattice.link(clash).collect()
    assert len(got) == len(rows) + 3 and got[0].asDict().keys() == {"vec_id", "n_links", "component_id", "kept"} and sum(r["vec_id"] == 5 for r in got) == 3
    odd = lattice.link(spark.createDataFrame([(None, [1.0, 2.0]), (7, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert {(r["vec_id"], r["n_links"]) for r in odd} == {(None, 1), (7, 1)}


def test_lattice_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1, keepdims=True)
    a, b = lattice.keys(x), lattice.keys(y)
    assert (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3)).mean() > 0.97


def test_lattice_decodes_to_the_nearest_point():
    r = lattice.roots()
    assert len(r) == 240 and np.allclose((r**2).sum(axis=1), 2)
    x = np.random.default_rng(2).normal(size=(200, 8)) * 2
    p = lattice.decode(x)
    d = ((x - p) ** 2).sum(axis=1)
    assert all(d[i] <= ((x[i] - (p[i] + r)) ** 2).sum(axis=1).min() + 1e-9 for i in range(len(x)))


# 7 chat


@given(st.lists(st.tuples(st.text(alphabet="asn\\<>[]/ITNT\n", max_size=12), st.text(alphabet="s\\<>[]/INST\né🙂 a", max_size=30)), max_size=4))
@settings(max_examples=200, deadline=None)
def test_chat_round_trip(turns):
    text, _ = chat.render(turns)
    assert chat.parse(text) == turns


def test_chat(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "  é🙂 \\ <s> x "), (2, None, None, None), (2, 0, "assistant", ""), (2, 1, "assistant", said), (2, 1, "assistant", said), (None, 0, "assistant", "alone"), (3, 1, "assistant", "b" * 5000), (3, 0, "system", "a"), (4, 0, "user", "x y " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit(1), "t": F.lit(2)})
    made = chat.format_conversations(df, public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted([(-1 if t is None else t, r or "", x or "") for i, t, r, x in rows if i == c])
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert got[c]["n_turns"] == len(mine) and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_conversations(df.where("false"), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    for r in made.collect():  # a token is under the mask where it overlaps an assistant text
        spans = chat.render(chat.parse(r["formatted"]))[1]
        assert r["loss_mask"] == [any(s < b and e > a for a, b in spans) for s, e in zip(r["token_starts"], r["token_ends"], strict=True)]
    # A mask that lacks one of its tokens reads back as less text.
    less = F.transform("loss_mask", lambda x, i: x & (i + 1 != F.array_position("loss_mask", True)))
    damaged = {r["conv_id"]: r["loss_chars"] for r in chat.read_back(made.withColumn("loss_mask", less)).collect()}
    assert all(damaged[c] < got[c]["loss_chars"] for c in (1, 2, None, 3)) and got[4]["loss_chars"] == 0


def test_covered():
    starts, ends = np.array([0, 3, 3, 6]), np.array([3, 4, 6, 9])
    for drop, want in ((None, "cdefg"), (0, "defg"), (1, "cdefg"), (2, "cdg"), (3, "cdef")):
        on = np.arange(4) != drop
        assert chat.covered("abcdefghi", starts[on], ends[on], 2, 7) == want
    assert chat.covered("abc", starts[:0], ends[:0], 0, 3) == ""


# 8 urls


def test_urls(spark):
    rows = [
        (1, "HTTP://Foo.Example.NET/en/x?q#f"), (2, "http://example.com/de/"), (3, "https://a.org/fr/x"), (4, "x://net"), (5, "no scheme"), (6, None), (7, "http://casinowin.example.com/a"), (8, "http://cheap-pills.example.com/"),
        (9, "http://thewater.example.com/en/1"), (10, "a://b://c/d"), (11, "http://h?x://y/z"), (12, "http://notnet/x"), (13, "http://x.net/y"), (13, "http://x.net/y"), (14, "http://" + "q" * 3000 + ".com/"),
    ] + [(100 + i, f"http://the-water{i}.example.com/en/{i}") for i in range(40)] + [(200 + i, f"http://{w}{i}.example.com/{i}") for i, w in enumerate(["casino", "pills"] * 8)]
    df = spark.createDataFrame([(i, u, "<html><script>var casino</script><p>the water win the</p></html>" if i != 3 else None) for i, u in rows], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    for i, u in rows:
        rest = u.partition("://")[2] if u and "://" in u else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = host.translate(LOWER)
        fits = [r for r in urls.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        rule = max(fits, key=len, default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        if rule:
            assert got[i]["verdict"] == urls.RULES[rule]
    assert [got[i]["verdict"] for i in (7, 8, 9, 5, 6, 110)] == ["block", "block", "allow", "allow", "allow", "allow"]
    assert urls.judge(df.where("false")).count() == 0
    assert urls.judge(df.withColumn("url", F.lit(None).cast("string"))).where("verdict = 'allow'").count() == len(rows)


def test_no_word_is_left_out(spark):
    """60,000 words of one frequency are all words, and so is a rare one beside frequent ones."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    flat = [f"qz{letters[i // 676 % 26]}{letters[i // 26 % 26]}{letters[i % 26]}{letters[i // 17576]}" for i in range(60_000)]
    rows = [(0, "http://qzabcabet.example.com/", " ".join(flat)), (1, "http://aiqubet.example.com/", "aiqu " + "the " * 50), (2, "http://a.example.com/", None)]
    got = {r["page_id"]: r["tokens"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert "qzabca" in flat and got[0][:2] == ["h:qzabca", "h:bet"] and got[1][:2] == ["h:aiqu", "h:bet"]


def test_long_runs_are_split():
    s = urls.Segmenter({"the": 50, "casino": 5})
    assert s.tokens("the" * 200 + "casino.com", "")[:201] == ["h:the"] * 200 + ["h:casino"]


def test_segmenter_is_the_best_split():
    s = urls.Segmenter({"free": 50, "bets": 5, "be": 90, "ts": 2, "fr": 1, "ee": 1})
    assert s.split("freebets") == ("free", "bets")

    def best(t):
        return max([(s._cost(t), (t,))] + [(s._cost(t[:i]) + best(t[i:])[0], (t[:i], *best(t[i:])[1])) for i in range(1, len(t))])

    for t in ("freebets", "beets", "xyfree", "a"):
        got = s.split(t)
        assert sum(map(s._cost, got)) == pytest.approx(best(t)[0])


def test_bayes_is_the_textbook_formula(spark):
    """Log-odds of all pages against counts of their tokens by hand."""
    rows = [(i, f"http://{h}.example.com/{p}", None) for i, (h, p) in enumerate([("casino", "win"), ("casino", "play"), ("news", "win"), ("news", "read"), ("bets", "play/now"), ("water", "read"), ("water", "now")])]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    tokens = {i: r["tokens"] for i, r in got.items()}
    block = {i for i, t in tokens.items() if {"h:casino", "h:bets"} & set(t)}
    counts = [Counter(x for i, t in tokens.items() if (i in block) == side for x in t) for side in (True, False)]
    seen, sums = len(counts[0] | counts[1]) + 1, [sum(c.values()) for c in counts]
    weight = lambda x: math.log((counts[0][x] + 1) / (sums[0] + seen)) - math.log((counts[1][x] + 1) / (sums[1] + seen))
    for i, t in tokens.items():
        odds = math.log((len(block) + 1) / (len(rows) - len(block) + 1)) + sum(map(weight, t))
        assert got[i]["log_odds"] == pytest.approx(odds) and got[i]["verdict"] == ("block" if odds > 0 else "allow")


def test_url_verdicts_of_held_out_pages(spark):
    """Pages that the model did not learn from are judged as their seeds say."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    out = F.pmod(F.xxhash64("host", "path"), F.lit(4)) == 0
    got = urls.judge(pages, {}, held_out=out).where(out)
    bad = F.exists("tokens", lambda x: F.substring(x, 3, 100).isin(*urls.SEEDS))
    r = got.agg(F.avg((bad == (F.col("verdict") == "block")).cast("int")), F.sum(bad.cast("int")), F.count("*")).first()
    assert r[0] > 0.97 and r[1] > 10


# 9 token files


def test_encode_equals_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = token_files._tokenizer(path)[0]

    @given(st.lists(st.text(alphabet="aB'sreàßÿ÷×Ñ& \t\n\x0b\x0c\x1c\x85\u00a0\u2028ée\u0301Σς<|>endoftext1三🙂.,;_-!EX", max_size=25), max_size=5))
    @settings(max_examples=150, deadline=None)
    def check(texts):
        ids, n = token_files.encode(pa.array(texts, pa.string()), path)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)] if texts else not len(ids)

    check()
    marks = [chr(c) for c in range(0x300, 0x370)]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    texts = [f"{a}{m} x{a}{m}. {a}{m}{a}, ={m}" for a in letters for m in marks]
    rng = random.Random(4)
    texts += ["".join(rng.choice(letters) + rng.choice([*marks, "", "", ""]) for _ in range(8)) + rng.choice([".", "'s", "<|endoftext|>", "<|ENDOFTEXT|>"]) for _ in range(4000)]
    ids, n = token_files.encode(pa.array(texts), path)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_token_files(spark, messy, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = token_files._tokenizer(path)[0]
    rows = sorted([(r["doc_id"], r["text"] or "") for r in messy.collect()], key=lambda r: (r[0] is not None, r[0] or 0))
    index = token_files.write_shards(messy, f"file://{tmp_path}/shards", path, seq_len=64)
    got = token_files.read_shards(index).orderBy("start").collect()
    at, real = 0, []
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(i, []).append([*tok.encode(t, add_special_tokens=False).ids, 2])
    for r in got:
        own = [x for x in groups[r["doc_id"]] if zlib.crc32(np.array(x, "<u4").tobytes()) == r["ids_crc32"]]
        assert own and len(own[0]) == r["n_tokens"] and r["start"] == at
        at += r["n_tokens"]
        real += own[0]
    assert [r["doc_id"] for r in got] == [i for i, _ in rows]
    back = []
    for f in sorted({r["file"] for r in index.collect()}):
        reader = token_files.ShardReader(f)
        for b in range(reader.file.num_record_batches):
            for k in range(reader.file.get_batch(b).num_rows):
                ids, mask = reader.sequence(b * token_files.BATCH_ROWS + k)
                assert len(ids) == 64
                back += ids[mask].tolist()
    assert back == real
    assert token_files.tokenized(empty, path).count() == 0


# 10 quality


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where("doc_id % 4 <> 0")
    got = quality.classify(docs.join(labels, "doc_id", "left_semi"), seen).join(labels.where("doc_id % 4 = 0"), "doc_id")
    good = got.where("quality = 1 and toxic = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    bad = got.where("quality = 0 or toxic = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good > 0.97 and bad < 0.2


def test_quality_messy(spark, messy, empty):
    labels = spark.createDataFrame([(1, 0, 0), (3, 1, 0), (3, 1, None), (5, 1, 1), (6, 1, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    assert quality.classify(messy, labels.drop("text")).count() == messy.count()
    kept = quality.keep(messy, labels.drop("text"))
    assert kept.columns == messy.columns and kept.count() <= messy.count()
    assert quality.classify(messy, labels.where("false").drop("text")).where("kept and score = 0.5").count() == messy.count()
    assert quality.keep(messy, labels.where("false").drop("text")).count() == messy.count()
    assert quality.classify(empty, labels.drop("text")).count() == 0


def test_quality_combines_both_views_at_every_size(spark):
    """Here only the source tells good from bad; and two bad labels are too few for folds."""
    docs = spark.createDataFrame([(i, f"the same words {i % 7}", "en", "spam" if i % 3 == 0 else "news", 16) for i in range(90)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 3 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    got = quality.classify(docs, labels).collect()
    assert all(r["kept"] == (r["doc_id"] % 3 != 0) for r in got)
    few = quality.train(docs, labels.where("doc_id % 3 <> 0 or doc_id < 6"))
    assert few.calibration.tolist() == [0, 0.5, 0.5]
    small = quality.train(*(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")))
    assert small.calibration[1] != 0 and small.calibration[2] != 0


def test_quality_folds():
    ids, known = [*range(40), 3, 3], np.arange(42) < 60
    good = np.array([i % 4 != 0 for i in ids])
    known[[1, 2]] = False
    got = quality.folds(ids, good, known)
    assert got[[1, 2]].tolist() == [-1, -1] and got[3] == got[40] == got[41]
    for k in (True, False):  # each kind in each fold
        assert set(got[known & (good == k)]) == set(range(quality.FOLDS))
    assert set(quality.folds(ids[:16], good[:16], known[:16])) == {0, -1}


def test_quality_pool_is_of_unlabelled_documents(spark, monkeypatch):
    monkeypatch.setattr(quality, "CoTrained", lambda docs, shape, meta, good, fold, rounds: fold)
    docs = spark.createDataFrame([(i, f"some words {i}", "en", "a", 12) for i in range(100)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 3 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    assert [int((quality.train(docs, labels, max_pool=n) < 0).sum()) for n in (30, 50)] == [30, 40]
