"""Operators on rows written out here: the cases that generated tables lack."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelens.functions import complexity, costs, pysource
from tracelens.functions import text as T
from tracelens.operators import code, edits, matching, registry, rules, stats, windows
from tracelens.sources import files, generator, sinks

from .test_pairing import pair_findings


def values(spark, items, column, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in rows.select("i", column).orderBy("i").select(F.col(rows.select(column).columns[0])).collect()]


TEXTS = ["", "a", "a\n", "a\r\nb", "a\rb\n", "\n\n", "x\x0by\x0cz", "p\x85q", "u\u2028v\u2029w", "a\x1cb\x1db\x1ec\n", "é\r\n\r\n", None, "  lead\n\ttail  "]


def test_lines_are_splitlines(spark):
    assert values(spark, TEXTS, T.lines("x").alias("l")) == [(t or "").splitlines() for t in TEXTS]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \r\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029é", max_size=12), min_size=1, max_size=40))
def test_lines_of_random_text(spark, texts):
    assert values(spark, texts, T.lines("x").alias("l")) == [t.splitlines() for t in texts]
    want = ["mixed" if (n := t.count("\r\n")) < t.count("\r") or n and t.count("\n") > n else "\r\n" if n else "\n" for t in texts]
    assert values(spark, texts, T.newline_style("x").alias("s")) == want


def test_token_counts(spark):
    import math

    texts = ["x" * n for n in range(0, 60)]
    assert values(spark, texts, T.estimate_tokens("x").alias("n")) == [max(1, math.ceil(len(t) / 3.5 * 1.15)) if t else 0 for t in texts]
    assert values(spark, texts, T.count_tokens("x").alias("n")) == [max(1, int(len(t) / 3.5 + 0.5)) if t else 0 for t in texts]


def test_sanitize(spark):
    dirty = ["\x1b[31mred\x1b[0m", "\x1b]0;t\x07a", "\x1bP1;2q\x1b\\b", "a\x00\x08b\x7f", "x\r\ny\rz", "\x1bMup", None, "tab\tstays"]
    assert values(spark, dirty, T.sanitize("x").alias("c")) == ["red", "a", "b", "ab", "x\ny\nz", "up", "", "tab\tstays"]


def test_json_depth(spark):
    assert values(spark, ["1", "{}", "[]", '{"a": {}}', '[[1], {"b": [2]}]', '"[[["', "nope", '{"k\\"[": [ ]}'], T.json_depth("x").alias("d")) == [1, 1, 1, 2, 4, 1, None, 2]


EDITS = [("replace", 2, 3, "b\nc", "B"), ("insert", 5, 4, "", "new\nlines"), ("delete", 6, 6, "f", "")]


def mapped(line, es):
    if line < 1 or any(o != "insert" and a <= line <= b for o, a, b, _, _ in es):
        return None
    shift = 0
    for o, a, b, _, new in es:
        n = len(new.splitlines())
        shift += (n if line >= a else 0) if o == "insert" else (n - (b - a + 1) if line > b else 0)
    return line + shift


def test_edits(spark):
    text = "a\nb\nc\nd\ne\nf\ng"
    rows = spark.createDataFrame([(text, EDITS), (text, [("replace", 1, 1, "wrong", "x")]), ("", [("insert", 1, 0, "", "one")]), (text, [("insert", 8, 7, "", "h\n")]), (text, [])], f"t string, e array<{edits.EDIT}>")
    got = [r[0] for r in rows.select(edits.apply_edits(F.col("t"), F.col("e"))).collect()]
    assert got == [["a", "B", "d", "new", "lines", "e", "g"], None, ["one"], list("abcdefgh"), list("abcdefg")]
    lines = rows.limit(1).select(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda n: edits.map_line(n.cast("long"), edits.measured(F.col("e"))))).head()[0]
    assert lines == [mapped(n, EDITS) for n in range(10)]
    new = rows.limit(1).select(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda n: edits.is_new_line(n.cast("long"), edits.measured(F.col("e"))))).head()[0]
    assert [n for n, x in enumerate(new) if x] == [2, 4, 5]


def test_proposal_errors(spark):
    rows = [("a.py", EDITS), ("../a.py", EDITS), ("a.py", [EDITS[1], EDITS[0]]), ("a.py", [("replace", 3, 2, "", "x")]), ("a;b", []), ("a.py", [("insert", 1, 0, "", "l\n" * 81)])]
    got = spark.createDataFrame(rows, f"p string, e array<{edits.EDIT}>").select(edits.proposal_errors(F.col("p"), F.col("e"))).collect()
    assert [r[0] for r in got] == [[], ["unsafe path"], ["out of order"], ["reversed range"], ["unsafe path", "no edits"], ["too many lines"]]


def test_diff_pairs_and_counts_agree(spark):
    rng = random.Random(1)
    make = lambda n: [{"id": i, "code": rng.choice("AB"), "line": rng.choice([1, 2, None] if n else [1, 2]), "col": rng.randint(1, 2), "message": rng.choice("xy")} for i in range(rng.randint(0, 6))]
    for _ in range(300):
        b, c = make(1), make(0)
        found = pair_findings(b, c)
        kept = sum(o == "pre_existing" for _, _, o in found)
        keys = {(x["code"], x["line"]) for x in b + c if x["line"]}
        assert kept == sum(min(sum((x["code"], x["line"]) == k for x in b), sum((x["code"], x["line"]) == k for x in c)) for k in keys)
        assert sorted(x for x, _, _ in found if x is not None) == [x["id"] for x in b] and sorted(y for _, y, _ in found if y is not None) == [x["id"] for x in c]
    two = [{"id": 0, "code": "F", "line": 4, "col": 1, "message": "m"}, {"id": 1, "code": "F", "line": 4, "col": 9, "message": "m"}]
    assert pair_findings(two, [{"id": 7, "code": "F", "line": 4, "col": 9, "message": "m"}]) == [(1, 7, "pre_existing"), (0, None, "eliminated")]


def test_cost_algebra(spark):
    from itertools import product

    assert all(costs.add(a, b) == costs.add(b, a) for a, b in product(costs.CLASSES, repeat=2))
    odd = [t for t in product(costs.CLASSES, repeat=3) if costs.add(costs.add(t[0], t[1]), t[2]) != costs.add(t[0], costs.add(t[1], t[2]))]
    assert len(odd) == 12 and all({costs.N_LOG_N, costs.NM} <= set(t) for t in odd)
    assert costs.add(costs.NM, costs.N) == costs.NM and costs.add(costs.NM, costs.N2) == costs.N2 and costs.multiply(costs.N, costs.N, True) == costs.NM
    rows = spark.createDataFrame([([costs.NM, costs.N_LOG_N, costs.N2],), ([],), ([costs.LOG, costs.N],)], "c array<string>")
    assert [r[0] for r in rows.select(costs.sum_column(F.col("c"))).collect()] == ["UNKNOWN", "O(1)", "O(n)"]
    assert len(costs.cost_rows()) == len(costs.BUILTINS) + len(costs.METHODS) == 38 + 17


PROGRAMS = {
    "def f(a, b):\n    for x in a:\n        for y in b:\n            print(x, y)\n": ("O(nm)", "O(1)", "O(1)", None),
    "def f(a):\n    seen = set()\n    for x in a:\n        if x in seen:\n            return True\n        seen.add(x)\n    return False\n": ("O(n)", "O(n)", "O(1)", None),
    "def f(a):\n    out = []\n    for x in a:\n        out.append(x)\n    return out\n": ("O(n)", "O(1)", "O(n)", None),
    "def f(n):\n    if n < 2:\n        return n\n    return f(n - 1) + f(n - 2)\n": ("O(2^n)", "O(n)", "O(1)", None),
    "def f(n):\n    if n <= 1:\n        return 0\n    return 1 + f(n // 2)\n": ("O(log n)", "O(log n)", "O(1)", None),
    "def f(a, t):\n    lo, hi = 0, len(a) - 1\n    while lo <= hi:\n        mid = (lo + hi) // 2\n        if a[mid] < t:\n            lo = mid + 1\n        else:\n            hi = mid - 1\n    return -1\n": ("O(log n)", "O(1)", "O(1)", None),
    "def f(a):\n    while a:\n        a.pop()\n": ("UNKNOWN", "UNKNOWN", "UNKNOWN", "DYNAMIC_BOUNDS"),
    "import math\ndef f(x):\n    return math.sqrt(x)\n": ("UNKNOWN", "UNKNOWN", "UNKNOWN", "EXTERNAL_DEPENDENCY"),
    "def f(n):\n    return g(n)\ndef g(n):\n    return f(n)\n": ("UNKNOWN", "UNKNOWN", "UNKNOWN", "DYNAMIC_RECURSION"),
    "def f(a):\n    return sorted(a)\n": ("O(n log n)", "O(n)", "O(n)", None),
    "def f(a):\n    return [x for x in a]\n": ("O(n)", "O(1)", "O(n)", None),
    "def f(a):\n    for i in range(3):\n        a[i] = 0\n": ("O(1)", "O(1)", "O(1)", None),
    "def f(a):\n    for w in a:\n        for x in a:\n            for y in a:\n                for z in a:\n                    pass\n": ("UNKNOWN", "UNKNOWN", "UNKNOWN", "DYNAMIC_BOUNDS"),
    "def f(a, b):\n    for x in a:\n        if x in b:\n            return x\n": ("O(nm)", "O(1)", "O(1)", None),
    "def f(:\n": ("UNKNOWN", "UNKNOWN", "UNKNOWN", "UNSUPPORTED_SYNTAX"),
    "": ("O(1)", "O(1)", "O(1)", None),
}


@pytest.mark.parametrize("source", PROGRAMS)
def test_complexity(source):
    r = complexity.analyse_source(source)[0]
    assert (r.time, r.aux_space, r.output_space, r.reason) == PROGRAMS[source]


def test_traceback():
    one = 'Traceback (most recent call last):\n  File "/tmp/s/app.py", line 12, in compute\n    return a / b\n           ~~^~~\nZeroDivisionError: division by zero\n'
    got = pysource.parse_traceback(one, "app.py")
    assert got["frames"] == [{"file": "app.py", "line": 12, "function": "compute", "code": "return a / b", "is_target": True}]
    assert (got["type"], got["message"], got["line"]) == ("ZeroDivisionError", "division by zero", 12)
    chain = one + '\nDuring handling of the above exception, another exception occurred:\n\n  File "app.py", line 7, in <module>\n    main()\nRuntimeError: boom\n  more\n'
    got = pysource.parse_traceback(chain, "app.py")
    assert len(got["frames"]) == 2 and (got["type"], got["message"], got["line"]) == ("RuntimeError", "boom more", 7)
    assert pysource.parse_traceback("", "app.py")["type"] is None and pysource.parse_traceback("   MyError: x", "a.py")["type"] == "MyError"


def test_definitions_and_structure():
    source = "@deco\ndef a(x, /, y, *r, k=1, **kw):\n    'doc'\n    def inner():\n        pass\nclass B:\n    async def m(self):\n        for i in range(3):\n            while i:\n                self.m()\n    class C:\n        def n(self): return 1\n"
    d = pysource.definitions(source)
    assert [(x["kind"], x["qualified_name"], x["start"], x["end"]) for x in d] == [("function", "a", 1, 5), ("function", "B.m", 7, 10), ("function", "B.C.n", 12, 12), ("class", "B.C", 11, 12), ("class", "B", 6, 12)]
    assert d[0]["parameters"] == ["x", "y", "*r", "k", "**kw"] and d[0]["docstring"] == "doc" and d[1]["is_async"] and d[4]["methods"] == ["m"]
    rows = pysource.structure(source)
    assert [(r["function"], r["kind"], r["label"], r["depth"]) for r in rows] == [("a", "nested", "inner", 0), ("B.m", "loop", "for", 1), ("B.m", "call", "range", 0), ("B.m", "loop", "while", 2), ("B.m", "call", "self.m", 0)]
    assert rows[-1]["flag"] and rows[1]["pre"] < rows[-1]["pre"] <= rows[1]["post"]


def test_selectors(spark):
    f = spark.createDataFrame([("a.py", 0, "run", "run", False), ("a.py", 1, "run", "A.run", True), ("a.py", 2, "go", "A.go", True), ("a.py", 3, "go", "B.go", True), ("a.py", 4, "only", "B.only", True)], "file string, ordinal long, name string, qualified_name string, is_method boolean")
    s = spark.createDataFrame([(1, "a.py", None, "run"), (2, "a.py", "A", "run"), (3, "a.py", None, "go"), (4, "a.py", None, "only"), (5, "a.py", "A", "only"), (6, "b.py", None, "run"), (7, "a.py", "run", "inner")], "id long, file string, class_name string, function string")
    got = {r.id: (r.matched, r.problem) for r in matching.resolve_selectors(s, f).collect()}
    assert got == {1: ("run", None), 2: ("A.run", None), 3: (None, "ambiguous"), 4: ("B.only", None), 5: (None, "not found"), 6: (None, "not found"), 7: (None, "not found")}
    assert [r.id for r in matching.nested_prefixes(s, f).collect()] == [7]


def test_splits_match_the_published_counts(spark):
    rows = spark.range(3800).withColumn("task", F.when(F.col("id") < 1558, "d").when(F.col("id") < 3116, "e").otherwise("a"))
    got = {r.split: r["count"] for r in windows.stratified_split(rows, "task", "id").groupBy("split").count().collect()}
    assert got == {"train": 3040, "val": 380, "test": 380} and generator.counts(3800) == (1558, 1558, 684)
    small = windows.stratified_split(spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y"), (5, "y"), (6, None)], "id long, s string"), "s", "id")
    assert sorted((r.s or "", r.split) for r in small.collect()) == [("", "train"), ("x", "train"), ("x", "train"), ("y", "test"), ("y", "train"), ("y", "val")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, v double, i long")
    assert stats.timing(none, ["k"], "v").collect() == [] and windows.stride(none, "i", 3).collect() == [] and windows.stratified_split(none, "k", "i").collect() == []
    total = stats.grand_total(stats.summarize(none, ["k"], F.lit(True), F.lit(True), F.col("v"), F.col("i")), F.lit(True)).head()
    assert total.accuracy_pct == 0.0


def test_scan_and_sinks(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"x = 1\r\n")
    (tmp_path / "b.py").write_bytes(b"\xef\xbb\xbfprint('\xc3\xa9')")
    (tmp_path / "c.py").write_bytes(b"# coding: utf-8\n\xff")
    (tmp_path / "big.py").write_bytes(b"#" * 300_000)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.texts(files.scan(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.py", "b.py"} and got["a.py"].newline_style == "\r\n" and got["b.py"].has_bom and got["b.py"].text == "print('é')"
    pairs = windows.stratified_split(generator.pairs(spark, 100), "task_type", "id")
    sinks.write_splits(pairs, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 100
    for task, kind in (("diagnosis", "diagnosis"), ("edit_proposal", "edit_proposal"), ("abstention", "abstention")):
        made = pairs.filter(F.col("task_type") == task).select(code.schema_errors(F.col("completion"), kind).alias("e"))
        assert made.count() > 0 and made.filter("size(e) > 0").count() == 0
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in files.json_lines(spark, f"{tmp_path}/x.jsonl", "a long").collect()) == [1, 2]
    (tmp_path / "m.json").write_text('{"samples": [{"id": "p"},\n {"id": "q"}]}')
    assert sorted(r.id for r in files.json_items(spark, f"{tmp_path}/m.json", "struct<id:string>", "samples").collect()) == ["p", "q"]


def test_registry():
    own = registry.default()
    assert own.names() == ["python"] and own.for_path("X.PY").name == "python" and own.for_path("x.c") is None
    with pytest.raises(ValueError):
        own.register(registry.Python())


def test_validation(spark):
    rows = spark.createDataFrame([(0, False, "out\r\n", None, "out", None, True), (1, False, "x", 1, None, None, True), (0, True, "x", None, "x", None, False), (0, False, "abc", None, None, "b", True), (0, False, "abc", None, None, "z", False), (0, False, "", None, None, None, None)], "code int, late boolean, out string, we int, ws string, wp string, want boolean")
    got = rows.select("want", rules.oracle_met(F.col("code"), F.col("late"), F.col("out"), F.col("we"), F.col("ws"), F.col("wp")).alias("met")).collect()
    assert [r.met for r in got] == [r.want for r in got]


def test_budgeted_context(spark):
    from tracelens.operators import context

    source = "\n".join(f"line number {i} of this file" for i in range(1, 81))
    findings = [("E1", 38, "near"), ("E2", 5, "far"), ("E3", 41, "near too")]
    functions = [("outer", 20, 70), ("inner", 30, 50), ("other", 1, 10)]
    budgets = [1200, 400, 390, 380, 300, 240, 200, 180, 150, 124, 10]
    rows = spark.createDataFrame(
        [(b, "a.py", source.split("\n"), "ValueError: bad", ["runtime:ValueError"], 40, [(40, "run", "x = 1", True), (3, "lib", "", False)], findings, functions, [("C", 18, 72)]) for b in budgets],
        "budget int, path string, lines array<string>, error string, error_ids array<string>, line long, frames array<struct<line:bigint,function:string,code:string,is_target:boolean>>, "
        "findings array<struct<code:string,line:bigint,message:string>>, functions array<struct<name:string,start:bigint,end:bigint>>, classes array<struct<name:string,start:bigint,end:bigint>>",
    )
    got = {r.budget: r.context for r in context.diagnosis(rows, F.col("budget")).collect()}
    assert got[1200].omitted == [] and (got[1200].start, got[1200].end) == (30, 50) and "ruff:E2:line_5" in got[1200].manifest and "[external]" in got[1200].prompt
    assert all(c is None or c.tokens <= b for b, c in got.items()) and got[10] is None
    steps = [len(got[b].omitted) for b in budgets if got[b]]
    assert steps == sorted(steps) and 0 in steps and 1 in steps and 4 in steps and 7 in steps
    narrow = next(c for c in got.values() if c and len(c.omitted) == 4)
    assert narrow.start > 30 and f"[{narrow.start - 30} earlier lines omitted]" in narrow.prompt and "ruff:E2:line_5" not in narrow.manifest
    single = next(c for c in got.values() if c and len(c.omitted) == 7)
    assert (single.start, single.end) == (40, 40) and "### Traceback" not in single.prompt
    lines = F.col("lines")
    edits_ = rows.select("budget", context.edit(F.lit(""), lines, F.col("line"), F.col("findings"), F.col("budget")).alias("c")).collect()
    assert {r.budget: r.c and tuple(r.c.omitted) for r in edits_}[1200] == () and {r.budget: r.c for r in edits_}[10] is None


def test_schemas(spark):
    from tracelens import schemas

    for table in schemas.TABLES:
        assert spark.createDataFrame([], schemas.schema(table)).filter(schemas.holds(table)).count() == 0
    rows = spark.createDataFrame([("p", "s", "c", "m", "error", 3, 2, 3, 1, False), ("p", "s", "c", "m", "error", 3, 2, 3, 2, False), ("p", "s", "c", "m", "error", 0, 2, 3, 2, False), ("p", "s", "c", "m", "error", None, 2, 3, 2, False)], schemas.schema("diagnostics"))
    assert [r[0] for r in rows.select(schemas.holds("diagnostics")).collect()] == [False, True, False, False]


def test_strict_schema_rejects_wrong_types():
    bad = '{"bug_description": 1, "root_cause": "r", "confidence": "MAYBE", "cited_evidence_ids": "x", "rationale": true}'
    assert pysource.schema_errors(bad, "diagnosis") == ["type of bug_description", "value of confidence", "type of cited_evidence_ids", "type of rationale"]
    edit = '{"target_file": "a.py", "edits": [{"operation": "replace", "start_line": 1, "end_line": 1, "extra": 0}], "explanation": "e"}'
    assert pysource.schema_errors(edit, "edit_proposal") == ["type of edits"] and pysource.schema_errors(edit.replace(', "extra": 0', ""), "edit_proposal") == []
    assert pysource.schema_errors("[]", "diagnosis") == ["not an object"] and pysource.schema_errors('{"target": "t", "reason": "EMPTY_RESPONSE", "details": "d", "raw_payload": null}', "abstention") == []


def test_tokenizer_counter(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tracelens.operators import context

    path = public_tokenizers.path("byte_bpe_50k.json")
    ref, texts = Tokenizer.from_file(path), ["", "a", "def f(x):\n    return x + 1\n", "naïve 日本語", None]
    count = code.tokenizer_counter(path)
    assert values(spark, texts, count(F.col("x")).alias("n")) == [len(ref.encode(t or "").ids) for t in texts]
    rows = spark.createDataFrame([("x = 1\n" * n,) for n in (1, 40, 90)], "t string").withColumn("l", T.lines("t"))
    none = F.expr("cast(array() as array<struct<code:string,line:bigint>>)")
    got = [r.c for r in rows.select(context.edit(F.col("t"), F.col("l"), F.lit(20).cast("long"), none, F.lit(300), count).alias("c")).collect()]
    assert [c and (len(c.omitted), c.tokens == len(ref.encode(c.prompt).ids)) for c in got] == [(0, True), (0, True), (1, True)]


def test_measured_invocations(spark):
    rows = spark.createDataFrame([("a", 1, 9.0), ("a", 3, 1.0), ("a", 2, 8.0), ("b", 1, 5.0), (None, 1, 1.0), (None, 2, 2.0), (None, 3, 3.0)], "t string, k int, v double")
    assert sorted(map(tuple, windows.measured(rows, ["t"], "k", 2).collect()), key=str) == [("a", 3, 1.0), (None, 3, 3.0)]
