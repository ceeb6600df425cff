"""Matching blocks against the sequence matcher that defines them."""

from __future__ import annotations

import difflib
import platform
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trialweave.functions import matching, text


def by_definition(a, b, popular):
    return sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=popular).get_matching_blocks())


@given(st.lists(st.integers(0, 3), max_size=90), st.lists(st.integers(0, 3), max_size=90))
@settings(max_examples=300, deadline=None)
def test_short_sequences(a, b):
    assert matching.matched(a, b) == by_definition(a, b, False)
    i, j, n = matching.Automaton(b, 0, len(b), set()).longest(a, 0, len(a), set())
    m = difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
    assert n == m.size and (not n or (i, j) == (m.a, m.b))


@pytest.mark.parametrize("popular", [False, True])
def test_long_sequences(popular):
    rng = random.Random(4)
    for k in range(60):
        letters = rng.choice([2, 5, 40, 400])
        a = [int(rng.paretovariate(0.8)) % letters for _ in range(rng.randrange(150, 700))]
        b = a[:]
        for _ in range(rng.choice([3, 40, 400])):
            at = rng.randrange(len(b))
            b[at : at + rng.randrange(4)] = [rng.randrange(letters) for _ in range(rng.randrange(4))]
        if k % 3 == 0:
            rng.shuffle(b)
        assert matching.matched(a, b, popular) == by_definition(a, b, popular), k


def test_a_hundred_thousand_tokens():
    """Tokens that repeat all the time, as brackets do in code."""
    rng = random.Random(1)
    a = [rng.randrange(60) if rng.random() < 0.7 else rng.randrange(5000) for _ in range(100_000)]
    b = a[:]
    for _ in range(300):
        at = rng.randrange(len(b))
        b[at : at + rng.randrange(40)] = [rng.randrange(60) for _ in range(rng.randrange(40))]
    began = time.time()
    got = matching.matched(a, b)
    assert time.time() - began < 60 and 0.8 * len(a) < got <= len(a)


def test_measure(spark):
    rows = [("int a = 1; // x\n", "int a=1;\n"), ("f(x)\n", None), (None, "x"), ("", ""), ("a\nb\nb\n", "b\na\nc\nd\n")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(text.measure(F.col("a"), F.col("b"))).collect()]
    assert got[1] is None and got[2] is None
    for i in (0, 3, 4):
        a, b = rows[i]
        t = lambda f, x, y, p: difflib.SequenceMatcher(None, f(x), f(y), autojunk=p).ratio()
        assert (got[i]["sim_t"], got[i]["sim_t_c"]) == (t(text.python_tokens, a, b, True), t(text.c_tokens, a, b, False))
        assert got[i]["python"] == platform.python_version()
    assert got[4]["sim_l"] == 0.5 and got[3]["sim_l"] == 0.0


def test_blocks_without_automata(monkeypatch):
    """Tokens with their places, and prose, in which few pairs of places begin the same two tokens."""
    monkeypatch.setattr(matching, "Automaton", None)
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(4000)]
    for cut in (0, 7, 300):
        a, b = " ".join(words[:2000]), "\n".join([" ".join(words[:cut]), " ".join(words[2000 - cut :])])
        for f, popular in ((text.python_tokens, True), (text.c_tokens, False)):
            assert matching.matched(f(a), f(b), popular) == by_definition(f(a), f(b), popular)


def test_c_tokens_of_any_text():
    rng = random.Random(3)
    pieces = ["a", "_", "9", "٣", "é", ".", "e", "E+", "-", '"', "'", "\\", "\n", "\r\n", "\\\r\n", "/", "*", "//", "/*", "*/", "<<", "=", " ", "\x1c", " ", "@"]
    for _ in range(300):
        t = "".join(rng.choices(pieces, k=rng.randrange(40)))
        got, at = text.c_tokens(t), 0
        for token in got:  # tokens stand in the text, in order
            at = t.index(token, at) + len(token)
    assert text.c_tokens("/*/ a */ b /*/") == ["b"] and text.c_tokens("a/b\\\nc \\ \n'x\\'y' 'z\n'") == ["a", "/", "b", "c", "\\", "'x\\'y'", "'z", "'"]


def test_measures_in_one_pass(spark):
    """One Arrow UDF takes all similarities, and no exchange carries a reference beside a text."""
    from trialweave import queries

    plan = queries.similarity_measures(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "_measured(" in plan and "sim_t_c(" not in plan
    assert "Sort [of" in plan[plan.index("ArrowEvalPython") :].split("Exchange", 1)[0]
