"""Decontamination where shingles, words and items repeat: memory and time stay in proportion to the input."""

from __future__ import annotations

import time
import tracemalloc

import numpy as np
import pyarrow as pa

from tests.llm.test_llm import found_by_brute_force
from trialweave.llm import decontaminate


def test_repeated_words_and_items():
    text = "a b " * 100_000
    h, off = decontaminate.shingles(pa.array([text, "x", text]))
    sets = [np.unique(decontaminate.shingles(pa.array([f"a b a b a b {i}"]))[0]) for i in range(5000)]
    index = decontaminate.ItemIndex([[i] for i in range(5000)], sets, 0.5)
    tracemalloc.start()
    began = time.time()
    got = index.hits(h, off)
    assert time.time() - began < 20 and tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert len(got) == 2 * 5000 and {g for _, _, g in got} == {2}


def test_equal_items_are_one_in_the_index(spark):
    items = [(i, "a b a b a b a b") for i in range(400)] + [(None, "A b, a b a b"), (900, "one two three four five six"), (901, None)]
    docs = [(1, "a b " * 5000), (2, "so one two three four five six it is"), (2, "a b a b a b"), (None, "b a b a b a"), (4, "a")]
    it = spark.createDataFrame(items, "item_id long, text string")
    blocks = list(decontaminate.item_blocks(it, 1 << 20, 0.8))
    assert len(blocks) == 1 and len(blocks[0].sizes) == 2
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in decontaminate.find_items(df, it).collect()), key=repr)
    want = sorted(((d, i, n, f) for d, i, n, f, *_ in found_by_brute_force(docs, items)), key=repr)
    assert got == want and len(got) == 1 + 3 * 401
    assert [r["doc_id"] for r in decontaminate.clean(df, it).collect()] == [4]
