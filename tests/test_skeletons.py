"""Symbols by line and by parsing, block ends, and the assembly of what is shown."""

import random
import re
import time

from pyspark.sql import functions as F

from evalweave.operators import skeletons


def braces(lines, start):
    """Where the first brace from a line on closes, character by character."""
    depth, seen = 0, False
    for i in range(start - 1, len(lines)):
        for ch in lines[i]:
            if ch == "{":
                depth, seen = depth + 1, True
            elif ch == "}" and seen:
                depth -= 1
                if depth <= 0:
                    return i + 1
    return start


def test_block_ends_against_brute_force(spark):
    r = random.Random(3)
    pieces = ["{", "}", "class A{n} {{", "fn f{n}() {{ }}", "struct S{n}", "", "x }} y {{ z", "}} }}", "func g{n}() {{ if (a) {{", "def h{n}(a):"]
    files = [(f"f{i}.js", "\n".join(r.choice(pieces).replace("{n}", str(j)).replace("{{", "{").replace("}}", "}") for j in range(r.randrange(0, 60)))) for i in range(40)]
    files += [("none.js", None), ("empty.js", ""), ("crlf.js", "class A {\r\n}\x0b class B\x85{ }")]
    symbols, _ = skeletons.line_symbols(spark.createDataFrame(files, "path string, content string"))
    got = {(x.path, x.start): x.stop for x in symbols.collect()}
    assert len(got) > 100
    for path, content in files:
        lines = (content or "").splitlines()
        for i, line in enumerate(lines, 1):
            assert ((path, i) in got) == bool(re.match(r"\s*(class|struct|fn|func|def)\s", line))
            if (path, i) in got:
                assert got[path, i] == braces(lines, i), (path, i)


def test_long_file_is_linear(spark):
    def seconds(n):
        content = "\n".join(["class A {"] + [f"function f{i}() {{" if i % 3 else "x" for i in range(n)])
        began = time.time()
        symbols, _ = skeletons.line_symbols(spark.createDataFrame([("a.js", content)], "path string, content string"))
        assert symbols.agg(F.sum("stop")).first()[0] > 0
        return time.time() - began

    seconds(1000)
    assert seconds(100_000) < 12 * max(seconds(10_000), 0.5)


PYTHON = '''from ..a import b, c
import os, sys

class A(B, metaclass=M):
    """First. Second."""

    class Inner:
        async def go(self, x=1):
            def hidden(): pass

    def run(self):
        """ Long
        text without a stop

        more."""

def top(a, *b):
    import inside
'''


def test_parsed_and_failed_files(spark):
    files = spark.createDataFrame([("a.py", PYTHON), ("b.py", "class X {\n}\nimport q\ndef bad(:"), ("c.PY", None)], "path string, content string")
    symbols, imports = skeletons.skeletons(files)
    got = [(x.path, x.name, x.kind, x.start, x.stop, x.signature, x.doc) for x in symbols.orderBy("path", "place").collect()]
    by = {(x[0], x[1]): x for x in got}
    assert by["a.py", "A"][2:] == ("class", 4, 15, "class A(B)", "First.")
    assert by["a.py", "A.Inner.go"][2] == "method" and by["a.py", "A.run"][6] == "Long text without a stop"
    assert ("a.py", "hidden") not in by and by["a.py", "top"][2] == "function"
    assert by["b.py", "X"][3:5] == (1, 2) and ("b.py", "bad") in by
    assert [(x.path, x.line, x.text) for x in imports.orderBy("path", "place").collect()] == [("a.py", 1, "from ..a import b, c"), ("a.py", 2, "import os, sys"), ("b.py", 3, "import q")]
    few, none = skeletons.skeletons(files, max_symbols=1, max_imports=0)
    assert few.count() == 2 and none.count() == 0


def test_assembly(spark):
    kinds = [("alpha", "class", 1, 50), ("alpha.run", "method", 2, 9), ("alpha.go", "method", 10, 40), ("helper", "function", 60, 61), ("run_all", "function", 62, 99), ("X", "enum", 100, 101)]
    rows = [("a.py", n, k, s, e, None, "Says so." if n == "helper" else None, i) for i, (n, k, s, e) in enumerate(kinds, 1)]
    symbols = spark.createDataFrame([*rows, ("b.py", "other", "class", 1, 2, None, None, 1)], "path string, name string, kind string, start int, stop int, signature string, doc string, place int")
    imports = spark.createDataFrame([("a.py", 1, "import x", 1)], "path string, line int, text string, place int")
    files = spark.createDataFrame([("a.py",), ("b.py",), ("c.py",)], "path string")
    asked = [(1, "run 7x", 1, "a.py"), (1, "run 7x", 2, "b.py"), (2, "", 1, "a.py"), (2, "", 2, "gone.py"), (2, "", 3, " "), (3, "zz", 1, "c.py")]
    ranked = spark.createDataFrame([(q, t, r, p, 0.5, 2) for q, t, r, p in asked], "query_id int, query string, rank int, path string, score double, evidence_count int")
    got = {(x.query_id, x.rank): x for x in skeletons.assembled(ranked, symbols, imports, files, budget_chars=200).collect()}
    a = got[1, 1]
    assert a.anchors_preview == "run_all(function)[L62-L99], alpha.run(method)[L2-L9]"
    assert a.glimpse_preview == "alpha(class)[L1-L50], helper(function)[L60-L61]: Says so., alpha.go(method)[L10-L40]"
    assert (a.primary_anchor.name, a.anchor_count, a.glimpse_count, a.folded_symbols, a.import_count, a.symbol_count) == ("run_all", 2, 3, 1, 1, 6)
    assert a.scope == "classes=1, methods=2, functions=2, top_method_classes=alpha(2)"
    assert (a.budget_chars, got[1, 2].budget_chars, a.truncated) == (120, 80, True)
    assert a.preview == "run_all(function)[L62-L99], alpha.run(method)[L2-L9], alpha(class)[L1-L50], helper(function)[L60-L61]: Says so."[: len(a.preview)]
    assert len(a.preview) <= 120
    b = got[2, 1]
    assert b.anchor_count == 0 and b.glimpse_count == 5 and b.primary_anchor is None
    assert b.glimpse_preview.startswith("alpha(class)[L1-L50], run_all(function)[L62-L99], alpha.go(method)[L10-L40], X(enum)[L100-L101], helper(function)")
    assert [got[k].error for k in ((1, 1), (2, 2), (2, 3), (3, 1))] == ["", "not_found", "empty_path", ""]
    assert got[3, 1].scope == "" and got[3, 1].preview == ""
    assert skeletons.assembled(ranked, symbols, imports, files, topn=1).count() == 3
    assert skeletons.assembled(ranked.limit(0), symbols, imports, files).count() == 0


def test_budgets(spark):
    for n, want in ((1, [4000]), (2, [2400, 1600]), (3, [2000, 1200, 800]), (4, [2000, 1200, 600, 200]), (7, [2000, 1200, 600, 50, 50, 50, 50]), (6, [2000, 1200, 600, 66, 66, 68])):
        df = spark.range(1, n + 1).select(skeletons.budgets(F.lit(n), F.col("id"), 4000).alias("b"))
        assert [r.b for r in df.collect()] == want
