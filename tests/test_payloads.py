"""Submissions, registry, limits and gates on small cases with expected values."""

import pytest
from pyspark.sql import functions as F

from evalweave.functions import payloads, text
from evalweave.operators import matching, ranking, summary
from evalweave.operators.registry import CommandError, Registry, UnknownOperator
from evalweave.operators.sessions import Gate


def test_outputs_with_mapped_entities(spark):
    said = '{"functions": [{"func": "C.m", "path": "a.py"}, {"function": "g", "file": "b.py"}], "files": ["gone.py"]}'
    rows = [(1, said, ["a.py:C.m"]), (2, None, None), (3, "", []), (4, "{broken", ["a.py:x"])]
    got = {r.id: r for r in payloads.assembled(spark.createDataFrame(rows, "id int, text string, hit array<string>"), mapped="hit").collect()}
    assert (got[1].found_files, got[1].found_entities, got[1].found_modules) == (["a.py", "b.py"], ["a.py:C.m", "b.py:g"], ["a.py:C", "b.py:g"])
    assert (got[1].submitted_function_count, got[1].submitted_qualified_function_ratio) == (2, 0.5)
    assert got[2].found_files == got[3].found_files == got[4].found_files == [] and got[2].raw_output == [] and got[4].raw_output == ["{broken"]
    assert got[2].submitted_function_count is None


def test_output_paths(spark):
    c = F.lit("a.py:1:x\nbinary file b.bin matches\nplain\n: y\na.py:2")
    r = spark.range(1).select(text.output_paths(c).alias("a"), text.output_paths(c, whole_lines=True).alias("b")).first()
    assert r.a == ["a.py", "b.bin"] and r.b == ["a.py", "binary file b.bin matches", "plain"]


def test_gate_counts_all_inspected_files():
    g = Gate()
    g.step("read", ["b"])
    g.step("search", ["a", "b"])
    g.step("read", ["a"])
    assert not g.fixated
    g = Gate()
    g.step("search", ["src/a.py", "b"])
    g.step("read", ["src/a.py"])
    assert g.fixated and g.was_read("a.py") and not g.was_read("b")
    g.step("read", ["b"])
    assert not g.fixated and g.step("submit", ["a.py"]) == "accepted"


def test_registry(spark):
    r = Registry()
    r.register("first", lambda df, n: df.limit(n) if n >= 0 else (_ for _ in ()).throw(ValueError("negative")))
    assert r.run("first", spark.range(5), n=2).count() == 2 and r.names() == ["first"]
    with pytest.raises(UnknownOperator):
        r.run("second")
    with pytest.raises(CommandError):
        r.run("first", spark.range(5), n=-1)
    with pytest.raises(ValueError):
        r.register("first", print)


def test_limits(spark):
    calls = spark.createDataFrame([(1.0,), (0.5,)], "cost double")
    assert tuple(summary.spent(calls).first()) == (1.5, 2, False) and tuple(summary.spent(calls.limit(0)).first()) == (0.0, 0, False)
    summary.within_limits(calls, cost_limit=1.5, call_limit=3)
    for limits in ({"cost_limit": 1.4}, {"call_limit": 2}):
        with pytest.raises(RuntimeError):
            summary.within_limits(calls, **limits)


def test_existing_and_dependencies(spark):
    files = spark.createDataFrame([("a/b.py",)], "path string")
    asked = spark.createDataFrame([("./a/b.py",), ("a//b.py",), ("/a/b.py",), ("a/../a/b.py",), ("",), (None,)], "path string")
    assert sorted(r.path for r in matching.existing(asked, files).collect()) == ["./a/b.py", "a/../a/b.py", "a//b.py"]
    edges = spark.createDataFrame([("s", f"t{i}") for i in range(8)] + [("r", "t1"), ("r", "t1")], "source string, target string")
    assert [(r.source, len(r.shown), r.more) for r in ranking.dependencies(edges).collect()] == [("s", 6, 2), ("r", 1, 0)]


def test_gate_hints_lists_and_scope():
    g = Gate()
    g.step("search", ["src/ba.py", "src/c.py"])
    g.step("read", ["src/ba.py"])
    assert g.fixated and g.ever and not g.was_read("a.py") and g.was_read("c/ba.py") and g.was_read("rc/ba.py")
    assert g.step("submit", ["src/ba.py"]) == "one_candidate"
    g.step("list", ["src/c.py"])  # listing inspects, but verifies nothing
    assert not g.fixated and g.ever
    assert g.step("submit", ["a.py"]) == "unread_hint" and g.step("submit", ["src/c.py"], ["lib/x.py"]) == "out_of_scope"
    assert g.step("submit", ["src/c.py"], ["c.py", "lib/x.py"]) == "accepted"


def test_lists_keep_strings_only(spark):
    given = ['{"found_files": ["x.py", 3, null, {"a": 1}, ["n"], " x.py ", ""]}', '{"found_files": "[x].py"}', '{"found_files": [], "files": ["y.py"]}', '{"found_files": 0, "files": "0"}', '{"found_files": 7, "files": ["y.py"]}', "{}", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").select("i", payloads.listed(F.col("t"), "found_files", "files").alias("l"))
    assert [r.l for r in df.orderBy("i").collect()] == [["x.py"], ["[x].py"], ["y.py"], ["0"], [], [], []]
