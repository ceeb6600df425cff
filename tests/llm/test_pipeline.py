"""The pipeline's stages, each judged on its own input."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers

from tests.llm.test_llm import SF, classes_by_brute_force, found_by_brute_force
from trialweave.llm import mixing, quality, token_files
from trialweave.llm._common import written


def test_pipeline(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "tokens"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stage = docs.columns, dict(p.STAGES)
    good = written(stage["quality"](spark, docs, SF))
    assert good.columns == columns
    want = quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(r["doc_id"] for r in want)

    one = written(stage["near_duplicates"](spark, good, SF))
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert one.columns == columns and sorted(r["doc_id"] for r in one.collect()) == sorted(i for i, c in classes_by_brute_force(rows) if i == c)

    clean = written(stage["decontaminate"](spark, one, SF))
    rows = [(r["doc_id"], r["text"]) for r in one.collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, *_ in found_by_brute_force(rows, items)}
    assert clean.columns == columns and sorted(r["doc_id"] for r in clean.collect()) == sorted(i for i, _ in rows if i not in bad)

    mixed = written(stage["mix"](spark, clean, SF))
    times = {r["doc_id"]: len(r["shards"]) for r in mixing.mix(clean).collect()}
    got: dict = {}
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert mixed.columns == columns and got == {i: n for i, n in times.items() if n}

    # The files hold the mix in its order: shard by shard, each by place.
    out = stage["tokens"](spark, mixed, SF).orderBy("start").collect()
    tok = token_files._tokenizer(public_tokenizers.path("word_bpe_49k.json"))[0]
    at = 0
    in_order = [(r["doc_id"], r["text"]) for r in mixed.collect()]
    assert [i for i, _ in in_order] != sorted(i for i, _ in in_order)
    for r, (i, text) in zip(out, in_order, strict=True):
        ids = [*tok.encode(text, add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_stages_on_messy_and_empty_tables(spark, messy, empty):
    """Every stage takes nulls, blanks, repeated rows, extra columns and no rows at all."""
    import corpus_pipeline as p

    for name, stage in p.STAGES:
        for docs in (messy, empty):
            out = stage(spark, docs, SF)
            assert name == "tokens" or out.columns == docs.columns
            n = out.count()
            assert (n == 0) if docs is empty else (0 < n <= 3 * docs.count())
