from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trialweave.functions import text
from trialweave.operators import tasks
from trialweave.plans import config


def test_recipes():
    files = {"a": {"extends": "b", "x": {"p": 1}, "l": [1]}, "b": {"x": {"p": 0, "q": 2}, "l": [1, 2], "e": {"kind": "k", "old": 1}}, "c": {"extends": "c"}, "d": {"extends": "b", "e": {"kind": "n"}}}
    assert config.inherit("a", files.__getitem__) == {"x": {"p": 1, "q": 2}, "l": [1], "e": {"kind": "k", "old": 1}}
    assert config.inherit("d", files.__getitem__, replaced=("e",))["e"] == {"kind": "n"}
    with pytest.raises(ValueError, match="extend each other"):
        config.inherit("c", files.__getitem__)
    assert config.providers(["m", "p.n"], {"p": ("m", "n"), "q": ("n",)}) == {"m": "p", "p.n": "p"}
    for bad in (["n"], ["z"], ["m", "m"]):
        with pytest.raises(ValueError):
            config.providers(bad, {"p": ("m", "n"), "q": ("n",)})
    assert config.select_items({"a": "dev", "b": "test"}, "dev", None) == ["a"]
    with pytest.raises(ValueError):
        config.select_items({"a": "dev"}, "dev", ["b"])
    with pytest.raises(ValueError):
        config.select_items({"a": "test"}, "test", None, frozenset({"test"}), "train")
    assert config.render("{A}{B}", {"A": "{B}", "B": "x"}) == "{B}x"
    assert [bool(config.tolerance_problem(m, t)) for m, t in (("pcc", 0.9), ("pcc", 2), ("ulp", 1.5), ("max_abs", -1), ("x", 1), ("ulp", 3))] == [False, True, True, True, True, False]


def test_tasks(spark):
    md = ["| task | state | deps |", "|---|---|---|", "| A | DONE | - |", "| B | READY | A |", "| C \\| D | READY | B, Z |", "text"]
    t = tasks.pipe_table(spark.createDataFrame(list(enumerate(md)), "pos long, line string"), ["task", "state", "deps"])
    assert [r["task"] for r in t.orderBy("pos").collect()] == ["A", "B", "C | D"]
    assert {r["dep"] for r in tasks.unknown_dependencies(t).collect()} == {"Z"}
    assert tasks.next_task(t).first()["task"] == "B" and {r["state"]: r["n"] for r in tasks.by_state(t).collect()} == {"DONE": 1, "READY": 2}


def test_small_functions(spark):
    d = spark.createDataFrame([("/w/src/a.cu", ["a.cu", "src/a.cu", "b"]), ("x", ["y"])], "p string, k array<string>")
    assert [r[0] for r in d.select(tasks.longest_suffix(F.col("p"), F.col("k"))).collect()] == ["src/a.cu", None]
    files = spark.createDataFrame([("m.c", '#include "a.h"\n#include <x>'), ("a.h", '# include "b.h"'), ("b.h", ""), ("z.h", "")], "name string, text string")
    assert [r["name"] for r in tasks.include_closure(files, spark.createDataFrame([("m.c",)], "name string")).collect()] == ["a.h", "b.h", "m.c"]
    j = spark.createDataFrame([('{"a":[{"b":"}]"}]}',), (None,)], "t string").select(text.json_depth("t")).collect()
    assert [r[0] for r in j] == [3, None]
    a = spark.createDataFrame([([1, 2], [1, 3]), ([1], [1]), ([1], [1, 2]), ([], [])], "a array<int>, b array<int>")
    assert [r[0] for r in a.select(text.first_difference(F.col("a"), F.col("b"))).collect()] == [1, None, 1, None]
    s = spark.createDataFrame([("abc", "abd"), ("x", None)], "a string, b string").select(text.sim_ids(lambda t: list(map(ord, t)), lambda i: "".join(map(chr, i)))("a", "b")).collect()
    assert s[0][0] == pytest.approx(2 / 3) and s[1][0] is None


def test_suites(spark, tmp_path):
    import copy

    import yaml

    from trialweave.plans import suites

    good = {
        "suite": "s1", "repo": "https://example.com/x", "commit": "a" * 40,
        "items": {
            "one": {"split": "eval", "languages": {"cuda": {"dir": "src/one", "files": ["a.cu"], "sha256": {"a.cu": "b" * 64}, "support": {"h.h": {"upstream": "h.h", "sha256": "c" * 64}}}, "omp": {"dir": "assets/x", "files": ["a.cpp"], "tracked": True}}, "passfail": ["omp"], "run_args": ["3"]},
            "two": {"split": "train", "languages": {"cuda": {"dir": "src/two", "files": ["b.cu"]}}, "inputs": [{"name": "x", "dtype": "f32", "shape": [4, 4], "dist": "uniform"}], "outputs": ["y"], "seed": 7, "tolerance": {"metric": "pcc", "threshold": 0.9}},
        },
    }
    path = tmp_path / "s1.yaml"
    path.write_text(yaml.safe_dump(good))
    suite = suites.load_suite(path)
    assert suite.splits() == {"one": "eval", "two": "train"} and suites.program_args(suite.items["two"]) == ["@inputs/x.lassiio", "y.lassiio"] and suites.program_args(suite.items["one"]) == ["3"]
    tables = suites.suite_tables(spark, [suite])
    assert {(r["item"], r["path"], r["tracked"]) for r in tables["files"].collect()} == {("one", "src/one/a.cu", False), ("one", "assets/x/a.cpp", True), ("two", "src/two/b.cu", False)}
    assert tables["items"].where("item = 'two'").first()["threshold"] == 0.9

    def bad(change):
        x = copy.deepcopy(good)
        change(x, x["items"]["one"], x["items"]["two"])
        return {k for k, _ in suites.problems(x, "s1")}

    assert bad(lambda s, a, b: None) == set()
    for change, key in (
        (lambda s, a, b: s.update(commit="abc"), "suite.commit"), (lambda s, a, b: s.update(more=1), "suite.more"), (lambda s, a, b: a.pop("split"), "items.one.split"), (lambda s, a, b: a.update(split="x"), "items.one.split"),
        (lambda s, a, b: a.update(passfail=["rust"]), "items.one.passfail"), (lambda s, a, b: a.update(support={"h.h": "h.h"}), "items.one.support"), (lambda s, a, b: b.pop("seed"), "items.two"), (lambda s, a, b: b.update(run_args=[]), "items.two.run_args"),
        (lambda s, a, b: b["inputs"][0].update(shape=[1 << 11, 1 << 10]), "items.two.inputs.0.shape"), (lambda s, a, b: b["tolerance"].update(threshold=2), "items.two.tolerance"), (lambda s, a, b: a["languages"]["omp"].update(dir="src"), "items.one.languages.omp.dir"),
        (lambda s, a, b: a["languages"]["cuda"].update(sha256={}), "items.one.languages.cuda.sha256"), (lambda s, a, b: a["languages"]["cuda"].update(files=["../x"]), "items.one.languages.cuda.files"), (lambda s, a, b: s.update(repo="PLACEHOLDER x"), "repo"),
        (lambda s, a, b: b.update(seed=True), "items.two.seed"), (lambda s, a, b: a["languages"]["cuda"]["support"].update(x={"tracked": "src"}), "items.one.languages.cuda.support.x.tracked"),
    ):
        assert key in bad(change), key
    path.write_text(yaml.safe_dump({**good, "suite": "other"}))
    with pytest.raises(ValueError, match="suite.suite"):
        suites.load_suite(path)
