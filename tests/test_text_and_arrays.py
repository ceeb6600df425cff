from __future__ import annotations

import posixpath

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trialweave.functions import text
from trialweave.operators import compare, graph, lists, parsers, store
from trialweave.sources import array_codec as ac


def cells(spark, rows, *columns, schema="a string, b string"):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_lines_and_sim_l(spark):
    texts = ["", "a", "a\n", "a\r\nb\rc", "x\x0by\x1cz\x85w v", "\n\n", " a \n b　"]
    got = cells(spark, [(t, t) for t in texts], text.lines(F.col("a")))
    assert [r[0] for r in got] == [t.splitlines() for t in texts]

    def want(a, b):
        x, y = a.splitlines(), [s.strip() for s in b.splitlines()]
        n = 0
        for s in x:
            if s.strip() in y:
                y.remove(s.strip())
                n += 1
        m = max(len(x), len(b.splitlines()))
        return n / m if m else 0.0

    pairs = [(a, b) for a in texts for b in texts]
    assert [r[0] for r in cells(spark, pairs, text.sim_l(F.col("a"), F.col("b")))] == [want(a, b) for a, b in pairs]


def test_masks_fences_places(spark):
    assert cells(spark, [("t 12\nx", "t 34\nx"), ("a", "b")], text.mask_score(F.col("a"), F.col("b"), ["^t [0-9]+"])) == [(1.0,), (0.0,)]
    f = [r[0] for r in cells(spark, [("x```cpp\nint a;\n```y", ""), ("```c++ int b;```", ""), ("none", "")], text.first_fence(F.col("a")))]
    assert [(x["found"], x["text"], x["quirk"]) for x in f] == [(True, "\nint a;\n", False), (True, " int b;", True), (False, "", False)]
    p = cells(spark, [("f", 1, 2), ("f", None, 2), (None, 1, 2), ("f", 1, None)], text.place(F.col("a"), F.col("l"), F.col("c")), schema="a string, l long, c long")
    assert [r[0] for r in p] == ["f:1:2", "f", None, "f:1"]
    assert cells(spark, [("PASS ok", ""), ("PASS FAIL", ""), ("PASSED", "")], text.pass_fail(F.col("a"))) == [(1.0,), (0.0,), (0.0,)]


def test_similarity_udfs(spark):
    got = cells(spark, [("int a = 1; // x", "int a=1;"), ("a", None)], text.sim_t_c("a", "b"), text.sim_t("a", "b"))
    assert got[0][0] == 1.0 and got[1] == (None, None)
    assert text.c_tokens('a->b "s\\"t" <<<1.5e-3f>>> /* x */ c') == ["a", "->", "b", '"s\\"t"', "<<<", "1.5e-3f", ">>>", "c"]
    d = cells(spark, [('{"a":"x\\n"}', '{"a":"y","b":"z\\n"}')], text.unified_diff("a", "b"))[0][0]
    assert "--- a/a" in d and "--- /dev/null" in d and "No newline at end of file" in d


def reported(spark, tool, log, files=None):
    df = spark.createDataFrame([(1, log, files or {})], "id long, stderr string, files map<string,string>")
    return [tuple(r)[2:] for r in parsers.diagnostics(df, tool, ["id"], files="files").orderBy("ordinal").collect()]


def test_gcc_and_linker_lines(spark):
    log = (
        "a.cu:3:4: error: bad thing [-Wx]\n   16| int x:1:2: error: echoed\n  |  ^~~\nsys.h:1:0: fatal error: gone  \n/tmp/x.o: /w/src/main.cpp:2: undefined reference to `f'\n"
        "main.cpp:9: undefined reference to `g'\nmain.cpp:(.text+0x2c): undefined reference to `h'\nundefined reference to alone\ncollect2: error: ld returned 1 exit status\nx86_64-linux-gnu-g++-13: fatal error: no input files\nnothing"
    )
    assert reported(spark, "g++", log, {"a.cu": "x", "main.cpp": "1\n2\n3", "src/main.cpp": "1\n2"}) == [
        ("error", "-Wx", "a.cu", 3, 4, "bad thing"), ("error", None, "sys.h", 1, None, "gone"), ("error", None, "src/main.cpp", 2, None, "undefined reference to `f'"),
        ("error", None, None, None, None, "undefined reference to `g'"), ("error", None, None, None, None, "undefined reference to `h'"), ("error", None, None, None, None, "undefined reference to alone"),
        ("error", None, None, None, None, "ld returned 1 exit status"), ("error", None, None, None, None, "no input files"),
    ]
    assert reported(spark, "clang", "./k.cpp:1:2: note: see\nld.lld: error: undefined symbol: f\ncollect2: error: no", {"k.cpp": "xy"}) == [("note", None, "k.cpp", 1, 2, "see"), ("error", None, None, None, None, "undefined symbol: f")]
    assert reported(spark, "g++", None) == []


def test_edg_folds(spark):
    files = {"m.cu": "int a;\n  call(x);\nlast", "n.cpp": "#include <k>\n"}
    log = (
        "m.cu(2): error: no instance of call\n            argument types are: (int)\n\tobject type is: T\n    call(x);\n         ^\n\n"
        "m.cu(1): warning #177-D: unused\n  goes on\nm.cu(3): remark: alone\nm.cu(9): catastrophic error: m.cu(3): error: as echo\nm.cu(3): error: shown\n ^\n   ^\n"
        "nvcc fatal   : Value 'x'\nptxas error   : too much\nptxas /t/a.ptx, line 28; error   : Unknown\nptxas info    : nothing\nhost.cu:4:5: warning: odd [-Wodd]"
    )
    assert reported(spark, "nvcc", log, files) == [
        ("error", None, "m.cu", 2, 8, "no instance of call; argument types are: (int); object type is: T"), ("warning", "177-D", "m.cu", 1, None, "unused; goes on"), ("note", None, "m.cu", 3, None, "alone"),
        ("error", None, "m.cu", 9, None, "m.cu(3): error: as echo"), ("error", None, None, None, None, "Value 'x'"), ("error", None, None, None, None, "too much"),
        ("error", None, None, None, None, "/t/a.ptx, line 28: Unknown"), ("warning", "-Wodd", "host.cu", 4, None, "odd"),
    ]
    log = (
        '"n.cpp", line 1: catastrophic error: cannot open source file "k" [no_such]\n  #include <k>\n              ^\nNVC++-S-1101-Too large  (main.cpp: 4)\nNVC++-W-0155-Invalid region (n.cpp)\nNVC++-F-0000-Odd (other.cpp)\n'
        "nvc++-Fatal-pcfe TERMINATED\nnvlink error   : Undefined reference to 'x' in 'a:1.o'\n<inline asm>:1:2: error: invalid\nn.cpp:1:3: note: here"
    )
    assert reported(spark, "nvc++", log, files) == [
        ("error", "no_such", "n.cpp", 1, 13, 'cannot open source file "k"'), ("error", "S-1101", "main.cpp", 4, None, "Too large"), ("warning", "W-0155", "n.cpp", None, None, "Invalid region"), ("error", "F-0000", None, None, None, "Odd (other.cpp)"),
        ("error", None, None, None, None, "pcfe TERMINATED"), ("error", None, None, None, None, "Undefined reference to 'x' in 'a:1.o'"), ("error", None, None, None, None, "<inline asm>:1:2: invalid"), ("note", None, "n.cpp", 1, 3, "here"),
    ]


def test_file_blocks(spark):
    reply = "```cpp\n// FILE: ./src//a.cu\nint x;\n```\n````\n// FILE: ../bad\n````\n```\n// FILE: src/a.cu\n```\n```\nno file\n```\n````x\n// FILE: e.h\n```\n`````\n```\n//FILE: no\n```\n  ```\n// FILE: open\n"
    got = parsers.file_blocks(reply, ("src/a.cu", "./b.cu", "open", "b.cu"))
    assert [r[:3] for r in got] == [("file", "src/a.cu", 2), ("bad-path", "../bad", 6), ("duplicate-file", "src/a.cu", 9), ("file", "e.h", 15), ("unclosed-block", "open", 22), ("missing-file", "b.cu", None)]
    assert got[3][3] == "```\n" and parsers.file_blocks("```\n// FILE: x\n```") == [("file", "x", 2, "\n")]
    with pytest.raises(ValueError, match="expected"):
        parsers.file_blocks("", ("../x",))
    for bad in ("", "/a", "a\\b", "-o", "@x", "a/../b", "C:x", " a", "a\u2028b", "a\x85b", "x" * 256, "\ud800"):
        assert parsers.bad_path(bad)
    assert not parsers.bad_path("1:x") and not parsers.bad_path("é" * 127)
    files = {"b.h": "", "a.cu": "x ``` y\n"}
    back = {p: c for k, p, _, c in parsers.file_blocks(parsers.render_blocks(files))}
    assert back == {"a.cu": "x ``` y\n", "b.h": "\n"} and list(back) == ["a.cu", "b.h"]
    df = spark.createDataFrame([(reply, ["q.cu"])], "t string, e array<string>").lateralJoin(parsers.FileBlocks(F.col("t").outer(), F.col("e").outer()))
    assert df.where("kind = 'missing-file'").first()["path"] == "q.cu"


def test_findings(spark):
    log = "[12] ERROR: UndefinedBehavior: tt::noc_read: bad: m\r\nx [13] ERROR: System_Error2: g: n\n[14] ERROR: NoMessage: alone\n[15] ERROR: 9x: f: g"
    out = spark.createDataFrame([(log,)], "s string").select(parsers.findings(F.col("s")).alias("f")).select("f", parsers.undefined_behaviour(F.col("f")), parsers.first_gap(F.col("f"))).first()
    assert [tuple(x) for x in out[0]] == [("UndefinedBehavior", "tt::noc_read", "bad: m"), ("System_Error2", "g", "n")] and out[1] and out[2] == "System_Error2"


def test_array_codec(spark, tmp_path):
    a = ac.NamedArray("x.1", "f32", (2, 2), np.array([1, 2, 3, 4], "<f4").tobytes())
    raw = ac.encode(a)
    assert ac.decode(raw) == a and len(raw) % 8 == 0 and ac.decode(ac.encode(a, b"OTHERS!\0"), b"OTHERS!\0") == a
    for bad in (raw[:-1], raw + b"\0", b"X" + raw[1:], raw[:10]):
        with pytest.raises(ValueError):
            ac.decode(bad)
    (tmp_path / "a.bin").write_bytes(raw)
    (tmp_path / "b.bin").write_bytes(b"junk")
    got = {r["path"][-5:]: r for r in ac.read_arrays(spark, str(tmp_path)).collect()}
    assert got["a.bin"]["name"] == "x.1" and got["b.bin"]["problem"]


def test_compare(spark):
    f = lambda *x: np.array(x, "<f4").tobytes()
    assert compare.compare("f32", f(1, 2, 3), f(1, 2, 3), "pcc", 0.9)[:4] == (1.0, 0.0, 0, True)
    assert compare.compare("f32", f(0.0), f(-0.0), "ulp", 0)[2] == 0
    assert compare.compare("f32", f(1, np.nan), f(1, np.nan), "max_abs", 0.0)[3] and not compare.compare("f32", f(1, np.nan), f(1, 2), "max_abs", 9.0)[3]
    assert compare.compare("f32", f(1.0), np.nextafter(np.float32(1), np.float32(2)).tobytes(), "ulp", 1)[2:4] == (1, True)
    i = lambda *x: np.array(x, "<i8").tobytes()
    assert compare.compare("i64", i(-(2**63)), i(2**63 - 1), None, None)[1] == float(2**64 - 1)
    s = "t long, name string, path string, dtype string, shape array<long>, data binary"
    ref = spark.createDataFrame([(1, "a", "p", "f32", [1], f(1)), (1, "b", "p", "f32", [1], f(1))], s)
    cand = spark.createDataFrame([(1, "a", "p", "f32", [1], f(1)), (1, "c", "p", "f32", [1], f(1))], s)
    got = compare.compare_outputs(ref, cand, spark.createDataFrame([("a", "pcc", 0.9)], "name string, metric string, threshold double"), ["t"])
    assert {r["name"]: r["passed"] for r in got.collect()} == {"a": True, "b": False, "c": False}
    d = lambda x: np.array([x], "<f8").tobytes()
    far = [spark.createDataFrame([(1, "a", "p", "f64", [1], d(x))], s) for x in (-1e308, 1e308)]
    assert int(compare.compare_outputs(*far, spark.createDataFrame([], "name string, metric string, threshold double"), ["t"]).first()["max_ulp"]) == 18429743317745373504
    x, y = np.random.default_rng(0).normal(size=(2, 500))
    assert compare.pearson(x, y) == pytest.approx(np.corrcoef(x, y)[0, 1]) and compare.pearson(x * 1e300, y * 1e-300) == pytest.approx(np.corrcoef(x, y)[0, 1]) and compare.pearson(x, x * 0 + 3) == 0.0
    assert compare.alignment(got, ["t"]).first()["alignment"] == 0.0


def test_graph_lists_store(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    got = graph.reach_labels(e, spark.createDataFrame([(2,), (4,)], "v long"))
    assert {r["v"]: r["label"] for r in got.collect()} == {1: 2, 2: 2, 3: 2, 4: 4, 5: 4}
    assert graph.first_violation(got, spark.createDataFrame([(5,), (3,)], "v long")).first()["sink"] == 3
    chain = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r["v"] for r in graph.reach_closure(e, spark.createDataFrame([(2,)], "v long")).collect()} == {1, 2, 3} and graph.reach_closure(chain, spark.createDataFrame([(40,)], "v long")).count() == 21
    assert graph.reach_labels(e, spark.createDataFrame([(2,)], "v long"), budget=1) is None
    assert {r["label"] for r in graph.alias_classes(spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "a string, b string")).collect()} == {"a", "x"}
    ls = spark.createDataFrame([(1, i, x) for i, x in enumerate(["dump 1", "x", "end 1", "dump 2", "y", "end 3", "dump 4"])], "k long, pos long, line string")
    number = lambda w: F.when(F.col("line").startswith(w), F.split("line", " ")[1])
    assert tuple(lists.last_complete(ls, ["k"], "pos", number("dump"), number("end")).first()) == (1, "1", 0, 2)
    s = store.put(spark.createDataFrame([("a",), ("a",), (None,)], "text string"))
    assert s.count() == 1 and store.corrupt(s).count() == 0 and store.corrupt(s.withColumn("payload", F.lit("b"))).count() == 1
    with pytest.raises(Exception, match="no text of"):
        store.resolve(spark.createDataFrame([("z",)], "h string"), s, "h", "t").collect()


def test_simulator_logs(spark):
    from trialweave.operators import simulator as sim

    out = "x\nbrisc build failed. Log: In file included\n/w/k.cpp:3:0: fatal error: no [-Wz]\n 3 | code\n\nignored.cpp:1:1: error: outside\nncrisc build failed. Log:\nk.cpp:3:0: fatal error: no [-Wz]\n"
    df = spark.createDataFrame([(1, out, out, "/w")], "id long, stdout string, stderr string, dir string")
    assert [tuple(r) for r in sim.kernel_diagnostics(df, ["id"], workdir="dir").collect()] == [(1, 0, "error", "-Wz", "k.cpp", 3, None, "no")]
    log = "Dump #1 at 1s\nDevice core(1) k_ids: 0| 07| 0\r\nk_id[ 7]: kernels/a\nk_id[ 8]: b\nDump #1 completed at 2s\nDump #2 at 3s\n core(2) k_ids: 8\nDump #3 completed at 4s\n"
    big = "Dump #5 at \n" + "".join(f"c core({i}) k_ids: {i}\n" for i in range(1, 400)) + "Dump #5 completed at 9\n"
    fits = "Dump #6 at \n" + "x core(1) k_ids: 1\n" * 50 + "Dump #6 completed at 9\n"
    logs = spark.createDataFrame([(1, log), (2, "none"), (3, big), (4, "Dump #1 at \nDump #1 completed at \n"), (5, fits), (6, None)], "id long, log string")
    notes = {r["id"]: r["note"] for r in sim.watchdog_notes(logs, ["id"]).collect()}
    assert notes[1] == "Watcher dump #1: Device core(1) k_ids: 0| 07| 0; k_id[ 7]: kernels/a" and set(notes) == {1, 3, 4, 5}
    shown = [f"c core({i}) k_ids: {i}" for i in range(1, 400)]
    n = max(n for n in range(400) if len("Watcher dump #5: " + "; ".join([*shown[:n], f"... {399 - n} more lines left out"])) <= 4096)
    assert notes[3] == "Watcher dump #5: " + "; ".join([*shown[:n], f"... {399 - n} more lines left out"])
    assert notes[4] == "Watcher dump #1: no core held a kernel" and notes[5].count("; ") == 49


def test_diff_of_empty_files(spark):
    d = cells(spark, [('{"a":""}', '{"b":""}')], text.unified_diff("a", "b"))[0][0]
    assert d == "--- a/a\n+++ /dev/null\n--- /dev/null\n+++ b/b\n"


def test_logs_of_a_null_key(spark):
    rows = [(None, "a.cu:3:4: error: bad", {"a.cu": "x\n"}), (1, "a.cu:3:4: error: bad", None), (2, None, {})]
    df = spark.createDataFrame(rows, "id long, stderr string, files map<string,string>")
    got = sorted(map(tuple, parsers.diagnostics(df, "g++", ["id"], files="files").collect()), key=repr)
    assert got == [(1, 0, "error", None, "a.cu", 3, None, "bad"), (None, 0, "error", None, "a.cu", 3, 4, "bad")]


def test_no_file_text_is_shuffled(spark):
    """The only exchange of a log's lines carries neither the map of files nor a file's text."""
    df = spark.createDataFrame([(1, 'm.cu(1): error: x\n  int\n   ^', {"m.cu": "int"})], "id long, stderr string, files map<string,string>").repartition(2)
    got = parsers.diagnostics(df, "nvcc", ["id"], files="files")
    plan = got._jdf.queryExecution().executedPlan().toString()
    exchanges = plan.count("Exchange hashpartitioning(id")
    assert exchanges == 1 and "Join" not in plan
    below = plan[plan.index("Exchange hashpartitioning(id") :].split("\n")[1]
    assert "built" not in below.split("AS d#")[-1]
    assert [tuple(r)[2:] for r in got.collect()] == [("error", None, "m.cu", 1, 2, "x")]


def test_paths_inside_a_workdir(spark):
    from trialweave.operators import simulator as sim

    paths = ["/w//k.cpp", "/w/x/../m.cpp", "/w/./a/b.cpp", "/w", "/w/..", "/v/k.cpp", "k.cpp", "../w/k.cpp", "//w/k.cpp", "///w/q.cpp", "/w/a/../../w/z.cpp", "/../w/up.cpp"]
    log = "brisc build failed. Log:\n" + "\n".join(f"{p}:1:1: error: m" for p in paths)
    df = spark.createDataFrame([(None, log, "", "/w/")], "id long, stdout string, stderr string, dir string")
    got = [r["file"] for r in sim.kernel_diagnostics(df, ["id"], workdir="dir").orderBy("ordinal").collect()]
    base = "/w/"
    want = [n[len(base) :] if (n := posixpath.normpath(p)).startswith(base) else p for p in paths]
    assert got == list(dict.fromkeys(want))


@given(st.lists(st.text(alphabet="/./a"), min_size=1, max_size=40))
@settings(max_examples=15, deadline=None)
def test_normal_path(spark, paths):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string")
    assert [r[1] for r in df.select("i", text.normal_path(F.col("p"))).orderBy("i").collect()] == [posixpath.normpath(p) for p in paths]


def test_findings_as_diagnostics(spark):
    log = "[12] ERROR: UndefinedBehavior: tt::r\u00e9ad: bad: m\r\nx\n[13] ERROR: Other: g: n\t1"
    df = spark.createDataFrame([(None, log), (1, "none"), (2, None)], "id long, stdout string")
    got = [tuple(r) for r in parsers.finding_diagnostics(df, ["id"]).orderBy("ordinal").collect()]
    assert got == [
        (None, 0, "run", "error", "UndefinedBehavior", None, None, None, "UndefinedBehavior: tt::r?ad: bad: m"), (None, 1, "run", "error", "Other", None, None, None, "Other: g: n?1"),
    ]


def test_last_bytes_cuts_bytes(spark):
    said = "a\u00e9\u20ac\U0001f600z"
    for n in range(1, 13):
        got = spark.createDataFrame([(said,)], "s string").select(text.last_bytes(F.col("s"), n)).first()[0]
        assert got == said.encode()[-n:].decode(errors="replace"), n


def test_c_tokens_by_first_character():
    t = text.c_tokens
    assert t("a<<<b>>>c<<=d...e->f##g::h") == ["a", "<<<", "b", ">>>", "c", "<<=", "d", "...", "e", "->", "f", "##", "g", "::", "h"]
    assert t("x // y\nz /* w */ v /* open") == ["x", "z", "v"] and t("a\\\nb\\\r\nc\\d") == ["a", "b", "c", "\\", "d"]
    assert t('"a\\"b" \'c\' "open\nx') == ['"a\\"b"', "'c'", '"open', "x"] and t('"a\\') == ['"a', "\\"] and t('"a\\\nb"') == ['"a\\\nb"']
    assert t("1.5e-3f .5 1..2 0x1Fp+2 .a \u00e9\u0663 \u0663x") == ["1.5e-3f", ".5", "1..2", "0x1Fp+2", ".", "a", "\u00e9\u0663", "\u0663", "x"]
    assert t("a+++b-->=") == ["a", "++", "+", "b", "--", ">="] and t("") == [] and t("@$`") == ["@", "$", "`"]


def test_fields_of_a_line_by_one_expression(spark):
    """A line that fits is read once, and what parts its fields may stand in the line itself."""
    odd = "a\x03b\x01c\x01\x04d\x01\x05e"
    assert reported(spark, "nvcc", f"{odd}(7): error: {odd}\n\x01\x03:1:2: note: \x03") == [("error", None, odd, 7, None, odd), ("note", None, "\x01\x03", 1, None, "\x03")]
    assert reported(spark, "nvc++", f"NVC++-S-1-{odd} ({odd}: 3)\n{odd}: undefined reference to") == [("error", "S-1", odd, 3, None, odd), ("error", None, None, None, None, "undefined reference to")]
    df = spark.createDataFrame([(1, "x", {})], "id long, stderr string, files map<string,string>")
    assert "regexp_extract(" not in parsers.diagnostics(df, "nvcc", ["id"], files="files")._jdf.queryExecution().optimizedPlan().toString()


def test_logs_are_made_by_all_tasks(spark):
    """Parts are exchanged before their logs are made and cut into lines, and no line after that."""
    from trialweave import trial_queries

    plan = trial_queries.toolchain_logs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate ") == 4 and all("Exchange" in part for part in plan.split("Generate ")[1:])
    assert all("Exchange" not in part[part.rindex("Window") :] for part in plan.split("Generate ")[:-1])
