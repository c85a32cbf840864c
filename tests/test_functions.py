"""Column functions against literal expectations."""

from pyspark.sql import functions as F

from evalweave.functions import measures, paths, text
from evalweave.operators import commands, matching


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def arr(*xs):
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")


def metrics(spark, edit, added, files, entities):
    return one(spark, *measures.metric_columns(arr(*edit), arr(*added), arr(*files), arr(*entities)))


def test_metric_vector_of_edits(spark):
    m = metrics(spark, ["pkg/a.py:foo", "pkg/a.py:bar"], [], ["pkg/a.py"], ["pkg/a.py:foo"])
    assert (m.file_recall_all, m.file_acc_all, m.gt_file_count_all, m.gt_function_count_all, m.gt_single_file) == (1.0, True, 1, 2, True)
    assert m.edit_function_recall_at_1 == m.edit_function_recall_all == 0.5 and m.edit_function_acc_all is False
    assert m.added_function_recall_all is m.added_function_hit_any is m.added_function_recall_at_1 is None


def test_metric_vector_of_additions(spark):
    m = metrics(spark, ["pkg/a.py:foo"], ["pkg/a.py:bar"], ["pkg/a.py"], ["pkg/a.py:foo"])
    assert m.function_recall_all == 0.5
    assert (m.edit_function_recall_all, m.edit_function_acc_all) == (1.0, True)
    assert (m.added_function_recall_all, m.added_function_acc_all) == (0.0, False)
    assert m.gt_has_added_functions and m.gt_added_function_count == 1


def test_metric_vector_without_truth(spark):
    m = metrics(spark, [], ["no colon"], ["a"], ["b"])
    assert (m.file_recall_all, m.entity_recall_all, m.correct, m.file_acc_all) == (0.0, 0.0, False, False)
    assert m.edit_function_recall_all is None


def test_diff_files_and_fallback(spark):
    diff = "diff --git a/src/core/api.py b/src/core/api.py\n+x\ndiff --git a/tests/test_api.py b/tests/test_api.py\n"
    kept = lambda d: one(spark, paths.without_tests(text.diff_files(F.lit(d))).alias("k")).k
    assert kept(diff) == (["src/core/api.py"], False)
    only = "diff --git a/tests/a.py b/tests/a.py\ndiff --git a/test_b.py b/test_b.py\n"
    assert kept(only) == (["tests/a.py", "test_b.py"], True)


def test_actions(spark):
    block = "```bash\nls\r\n```"
    row = one(spark, text.single_action(F.lit(f"{block}\nand\n{block}")).alias("a"), text.single_action(F.lit("none")).alias("b"))
    assert row == ("ls", None)


def test_tool_commands():
    name, args = commands.parse_tool('@tool radar --queries "a b" "c" --topk-files 20 --fast')
    assert name == "radar" and args == {"queries": ["a b", "c"], "topk-files": ["20"], "fast": ["true"]}
    for bad in ("@tool radar --queries", "tool radar", "@tool radar loose", "@tool radar --queries --k 1"):
        try:
            commands.parse_tool(bad)
            raise AssertionError(bad)
        except ValueError:
            pass


def test_balanced_object():
    assert commands.first_object('x {not json} {"a": {"b": 1}} y') == '{"a": {"b": 1}}'
    assert commands.first_object("no { braces") is None


def test_files_read():
    assert commands.files_read("cat src/a.py | grep -n foo src/b.py && head -3 src/a.py; ls src/c.py") == ["src/a.py", "src/b.py"]
    assert commands.files_read('cat "unclosed') == []


def test_json_object(spark):
    row = one(spark, text.json_object(F.lit('say\n```json\n{"a": 1}\n```')).alias("a"), text.json_object(F.lit("[1]")).alias("b"))
    assert row.a == '{"a": 1}' and row.b is None


def test_scores(spark):
    good = '```json\n{"correctness": 7.9, "completeness": 0, "relevance": 10, "clarity": 1, "reasoning": 2}\n```'
    row = one(spark, measures.parsed_scores(F.lit(good)).alias("g"), measures.parsed_scores(F.lit(good.replace("10", "11"))).alias("b"))
    assert tuple(row.g) == (7, 0, 10, 1, 2) and row.b is None
    assert measures.weights({"clarity": 3, "reasoning": 1}) == {"correctness": 0, "completeness": 0, "relevance": 0, "clarity": 0.75, "reasoning": 0.25}
    assert set(measures.weights({"clarity": -1}).values()) == {0.2}


def test_answers(spark):
    row = one(spark, measures.answer_text(F.lit('{"answer": "x"}')).alias("a"), measures.answer_text(F.lit(' {"answer": 1} ')).alias("b"), measures.joined_answer(arr("a", "", "b")).alias("c"), measures.joined_answer(F.lit(None).cast("array<string>")).alias("d"))
    assert row == ("x", '{"answer": 1}', "a\nb", "")


def test_truth_and_lists(spark):
    row = one(spark, text.truth(F.lit(" YES ")).alias("a"), text.truth(F.lit("0")).alias("b"), text.truth(F.lit("2")).alias("c"), text.tidy_list(arr(" a ", "", "b", "a")).alias("d"), text.capped(arr("a", "b", "c"), 2).alias("e"))
    assert row == (True, False, None, ["a", "b"], ["a", "b", "<<TRUNCATED>>"])


def test_first_sentence(spark):
    doc = "Compute the rank of data\nalong an array axis.\n\nMore text."
    row = one(spark, text.first_sentence(F.lit(doc)).alias("a"), text.first_sentence(F.lit("word " * 60)).alias("b"))
    assert row.a == "Compute the rank of data along an array axis."
    assert len(row.b) <= 100 and row.b.endswith("...") and "\n" not in row.b


def test_resolved_paths(spark):
    allowed = arr("src/pkg/auth.py")
    got = one(spark, *[matching.resolved(F.lit(p), allowed).alias(f"c{i}") for i, p in enumerate(("auth.py", "src/b.py", "../outside.py", "pkg/auth.py"))])
    assert got == ("src/pkg/auth.py", None, None, "src/pkg/auth.py")


def test_path_hits(spark):
    gt = arr("src/a.py", "lib/b.py", "x/b.py")
    got = one(spark, *[matching.path_hits(F.lit(p), gt).alias(f"c{i}") for i, p in enumerate(("./src/a.py", "a.py", "repo/lib/b.py", "b.py", "q/b.py", "q/a.py", ""))])
    assert got == (True, True, True, True, False, True, False)


def test_names(spark):
    row = one(spark, paths.repo_of_instance(F.lit("org__repo-123")).alias("a"), paths.modules(arr("f.py:C.m", "f.py:C.n", "x", "g.py:h")).alias("b"), paths.parent(F.lit("a")).alias("c"), paths.language(F.lit("x/Y.PY")).alias("d"), paths.cleaned(F.lit("/tmp/org/repo/src/a.py"), F.lit("org_repo")).alias("e"), paths.tool_path(F.lit("*.py")).alias("f"))
    assert row == ("org_repo", ["f.py:C", "g.py:h"], ".", "python", "src/a.py", None)


def test_query_expansion(spark):
    v = one(spark, text.expand_query(F.lit("Where is the getUser in src/core_api.py")).alias("v")).v
    assert v[0] == "Where is the getUser in src/core_api.py" and v[1] == "getUser src/core_api.py"
    assert v[2].startswith("Where getUser") and v[3] == "getUser src core api"


def test_usage(spark):
    row = one(spark, measures.reconciled_usage(F.lit(None).cast("int"), F.lit(3), F.lit(10)).alias("u")).u
    assert tuple(row) == (7, 3, 10)
