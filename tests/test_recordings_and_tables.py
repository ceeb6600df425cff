"""Recordings and their replay, and tables laid out by spaces."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from trialweave.operators import recordings as rec
from trialweave.operators import text_tables


def message(role, content):
    return {"role": role, "content": content}


def test_strict_recordings(spark, tmp_path):
    good = {"synthetic": True, "completions": [{"text": "hi"}, {"text": "you", "messages": [message("user", "a")]}]}
    entry = lambda **e: json.dumps(good | {"completions": [e]}).encode()
    assert rec.completions(json.dumps(good).encode()) == [("hi", None), ("you", [message("user", "a")])]
    bad = [
        ("é".encode(), "ASCII"), (b"{", "JSON"), (b"[]", "exactly"), (json.dumps(good | {"x": 1}).encode(), "exactly"), (json.dumps(good | {"synthetic": 1}).encode(), "synthetic"), (json.dumps(good | {"completions": {}}).encode(), "no list"),
        (entry(text=1), "no text"), (entry(text="", more=1), "other keys"), (entry(text="", messages=None), "messages is no list"), (entry(text="", messages=[{"role": "u"}]), "exactly the keys role"), (entry(text="", messages=[message("u", 1)]), "strings"),
    ]
    for raw, what in bad:
        with pytest.raises(rec.BadRecording, match=what):
            rec.completions(raw)
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text("[]")
    got = sorted(((r["recording"][-6:], r["call"], r["text"], r["problem"]) for r in rec.read_recordings(spark, f"file://{tmp_path}").collect()), key=repr)
    assert [g[:3] for g in got] == [("a.json", 1, "hi"), ("a.json", 2, "you"), ("b.json", None, None)] and "exactly" in got[2][3]


def test_replay(spark):
    m = message
    known = [("r", 1, "one two", [m("user", "abc"), m("system", "x y")], None), ("r", 2, "two", None, None), ("r", 3, "three", [m("user", "abcdef")], None), ("bad", None, None, None, "no list")]
    asked = [
        (1, "r", 1, [m("user", "abc"), m("system", "x y")]), (1, "r", 2, [m("any", "thing")]), (1, "r", 3, [m("user", "abcxef")]), (1, "r", 4, []), (2, "r", 1, [m("user", "abc"), m("user", "x y")]), (3, "r", 1, [m("user", "abc")]),
        (None, "bad", 1, []), (4, "r", 4, []), (5, "r", 3, [m("user", "abc")]), (6, "r", 1, [m("user", "abc"), m(None, "x y")]),
    ]
    got = rec.replayed(spark.createDataFrame(asked, f"run long, recording string, call long, messages {rec.MESSAGES}"), spark.createDataFrame(known, rec.RECORDINGS), ["run"])
    rows = {(r["run"], r["call"]): (r["text"], r["prompt_tokens"], r["completion_tokens"], r["problem"]) for r in got.collect()}
    assert rows[1, 1] == ("one two", 3, 2, None) and rows[1, 2] == ("two", 1, 1, None)
    assert rows[1, 3] == (None, None, None, "message 1 (user) differs at character 3 (length 6, expected 6)") and rows[1, 4][3] == "the run has ended"
    assert rows[2, 1][3] == "message 2 has role 'user', expected 'system'" and rows[3, 1][3] == "1 message(s) sent, 2 expected"
    assert rows[None, 1][3] == "bad recording: no list" and rows[4, 4][3] == "the recording is used up" and rows[5, 3][3] == "message 1 (user) differs at character 3 (length 3, expected 6)"
    assert len(rows) == len(asked) and rows[6, 1][3] == "message 2 has role '', expected 'system'"


def test_common_prefix(spark):
    pairs = [("", ""), ("a", ""), ("abc", "abd"), ("abc", "abc"), ("é\U0001f600x", "é\U0001f600y"), ("a" * 70000, "a" * 69999 + "b"), ("x", "y")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(rec.common_prefix(F.col("a"), F.col("b"))).collect()] == [len(os.path.commonprefix(p)) for p in pairs]


def test_wrapped_and_empty_cells(spark):
    text = "Title of it\n\n  name  value    n\n  a b   one      1\n        two th\n  c             22\n\n\none two\n"
    rows = text_tables.cells(spark.createDataFrame([(None, text), (1, None), (2, "k  v\r\n\r\nk\tv\r\nx\tw y")], "id long, text string"), ["id"]).collect()
    tables: dict = {}
    for r in rows:
        tables.setdefault((r["id"], r["block"]), {})[r["row"], r["column"]] = r["cell"]
    in_order = [tables[k] for k in sorted(tables, key=repr)]
    assert in_order == [
        {(0, 0): "k", (0, 1): "v"}, {(0, 0): "k", (0, 1): "v", (1, 0): "x", (1, 1): "w y"}, {(0, 0): "Title of it"},
        {(0, 0): "name", (0, 1): "value", (0, 2): "n", (1, 0): "a b", (1, 1): "one two th", (1, 2): "1", (2, 0): "c", (2, 1): None, (2, 2): "22"}, {(0, 0): "one two"},
    ]
