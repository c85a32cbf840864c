"""Operators on small tables with expected values."""

import json

import pytest
from pyspark.sql import functions as F

from evalweave.operators import chunking, indexes, matching, ranking, sampling, sessions, summary
from evalweave.plans.queries import QUERIES
from evalweave.sources import files
from evalweave.streaming import sessions as streams


def test_run_summary_recalls(spark):
    rows = [(1.0, 1.0, True), (0.5, 0.0, False), (1.0, 1.0, True)]
    df = spark.createDataFrame(rows, "file_recall_at_1 double, function_recall_at_1 double, function_hit_any boolean")
    s = summary.overall(df).first()
    assert s.file_acc_at_1 == pytest.approx(2 / 3) and s.file_recall_at_1 == pytest.approx(2.5 / 3)
    assert s.function_acc_at_1 == pytest.approx(2 / 3) and s.function_hit_rate == pytest.approx(2 / 3)
    assert s.pass_rate is None and s.p50_steps == 0


def test_run_summary_submissions(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (3, 2, 0.5), (2, 1, 0.0)], "submitted_function_count int, submitted_file_hint_count int, submitted_qualified_function_ratio double")
    s = summary.overall(df).first()
    assert (s.avg_submitted_function_count, s.p50_submitted_function_count, s.p90_submitted_function_count) == (2.0, 2, 3)
    assert s.single_function_submission_rate == pytest.approx(1 / 3) and s.under_two_functions_submission_rate == pytest.approx(2 / 3)
    assert s.avg_submitted_file_hint_count == pytest.approx(4 / 3) and s.avg_submitted_qualified_function_ratio == 0.5


def test_buckets(spark):
    df = spark.createDataFrame([(1, 1, 0, None, 0.5), (1, 2, 1, 0.0, 1.0), (2, 4, 1, 1.0, 1.0)], "gt_file_count_all int, gt_function_count_all int, gt_added_function_count int, added_function_recall_all double, function_recall_all double")
    got = {r.bucket: r for r in summary.buckets(df).collect()}
    assert {k: r["count"] for k, r in got.items()} == {"single_file": 2, "multi_file": 1, "func_count_1": 1, "func_count_2": 1, "func_count_4_plus": 1, "has_added_functions": 2, "no_added_functions": 1}
    assert got["single_file"].function_recall_all == 0.75 and got["has_added_functions"].added_function_recall_all == 0.5


def test_oracle(spark):
    rows = [(True, True, True, 1, True, 6), (True, True, False, 2, False, 10), (True, False, None, 0, False, 4)]
    df = spark.createDataFrame(rows, "oracle_sniper_mode boolean, oracle_file_provided boolean, oracle_verification_satisfied boolean, blocked_submission_count int, correct boolean, steps int")
    s = summary.oracle(df).first()
    assert s.oracle_file_provided_rate == pytest.approx(2 / 3) and s.oracle_verification_compliance_rate == 0.5
    assert (s.oracle_blocked_submission_count, s.steps_to_success_in_oracle_count, s.steps_to_success_in_oracle_mean, s.steps_to_success_in_oracle_p50) == (3, 1, 6.0, 6)


def test_radar(spark):
    rows = [(True, 1, False, False, True), (True, 2, True, True, False), (True, 1, True, True, False)]
    df = spark.createDataFrame(rows, "radar_called boolean, radar_tool_calls int, correct boolean, radar_cross_dir_inspected boolean, radar_first_candidate_fixated boolean")
    s = summary.radar(df).first()
    assert (s.single_radar_call_count, s.cross_dir_inspected_count, s.first_candidate_fixation_count) == (2, 2, 1)
    assert (s.single_radar_call_success_rate, s.second_radar_call_success_rate, s.second_radar_call_success_delta) == (0.5, 1.0, 0.5)


def test_uplift(spark):
    rows = [(True, True, True, 1, 1), (True, True, False, 1, 0), (False, True, False, 0, 0)]
    s = summary.uplift(spark.createDataFrame(rows, "used boolean, offered boolean, correct boolean, calls int, call_hits int")).first()
    assert (s.total, s.used, s.calls, s.call_hit_rate, s.instance_hit_rate, s.accuracy_used, s.accuracy_not_used, s.uplift_points, s.uplift_percent) == (3, 2, 2, 0.5, 0.5, 0.5, 0.0, 50.0, None)


def test_fusion(spark):
    rows = [(0, "src/a.py", 0.80, 2), (0, "src/b.py", 0.99, 1), (1, "src/a.py", 0.76, 2), (1, "src/c.py", 0.9, 1), (2, "src/a.py", 0.72, 2), (2, "src/d.py", 0.99, 1)]
    got = ranking.fused(spark.createDataFrame(rows, "query_no int, path string, score double, evidence_count int"), 3).orderBy(*ranking.fused_order()).collect()
    top = got[0]
    assert (top.path, top.support, top.query_count, top.evidence_count) == ("src/a.py", 3, 3, 6) and top.score == pytest.approx(0.904)
    assert next(r for r in got if r.path == "src/d.py").score == pytest.approx(0.596)


def test_display(spark):
    rows = [("src/core/x.py", 0.5, 1), ("src/auth/session.py", 0.4, 1), ("tests/t.py", 0.9, 1), ("src/auth/login.py", 0.6, 1)]
    df = spark.createDataFrame(rows, "path string, score double, evidence_count int")
    clustered = [r.path for r in ranking.displayed(df, "clustered").orderBy("place").collect()]
    assert clustered == ["tests/t.py", "src/auth/login.py", "src/auth/session.py", "src/core/x.py"]
    blind = ranking.displayed(df, "blind")
    assert "score" not in blind.columns and [r.path for r in blind.orderBy("place").collect()] == sorted(p for p, *_ in rows)


def test_display_and_diverse_pick_of_every_query(spark, tmp_path):
    rows = [(i, [float((i * 7 + j * 3) % 11 - 5 + i / 100) for j in range(4)], i % 6) for i in range(45)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    shown, picked = QUERIES["o10_a24_clustered_display"](spark, str(tmp_path)).collect(), QUERIES["w8_diverse_pick"](spark, str(tmp_path)).collect()
    hits = QUERIES["o1_w1_vector_top_k"](spark, str(tmp_path)).collect()
    assert {r.query_no for r in shown} == {r.query_no for r in picked} == {0, 20, 40}
    for q in (0, 20, 40):
        mine = sorted((r.rank, r.vec_id, r.vec_id % 6) for r in hits if r.query_no == q)
        first = [min(m for m in mine if m[2] == kind) for kind in range(6)]
        assert sorted((r.rank, r.vec_id, r.label) for r in picked if r.query_no == q) == sorted(first + [m for m in mine if m not in first][:9])
        places = sorted((r.place, r.dir) for r in shown if r.query_no == q)
        assert [p for p, _ in places] == [1, 2, 3, 4, 5, 6] and [d for _, d in places[::2]] == [d for _, d in places[1::2]]


def test_name_matching(spark):
    defs = spark.createDataFrame([("pkg/mod.py", "foo", "A.foo", "method"), ("pkg/mod.py", "foo", "B.foo", "method"), ("pkg/target.py", "shift", "shift", "function"), ("pkg/other.py", "shift", "shift", "function")], "path string, name string, qualname string, kind string")
    index = chunking.function_index(defs)
    asked = spark.createDataFrame([(1, "A.foo", "pkg/mod.py"), (2, "shift", "pkg/target.py"), (3, "none", "x.py")], "query_id int, function string, file_hint string")
    got = {(r.query_id, r.file, r.qualname) for r in matching.best_matches(matching.candidates(asked, index)).collect()}
    assert got == {(1, "pkg/mod.py", "A.foo"), (2, "pkg/target.py", "shift")}


def test_hint_join(spark):
    paths = ["src/A9.py", "9", "x/14", "a", "ab", "", "x\\14/b", "docs/é/22", "src/a14b.py"]
    hints = ["9", "14", "a", "b", "ab", "22", "é", "/", "py", ".py", "a9.PY", "x/14", "src", "zz", "q", " ", ""]
    low = lambda s: s.replace("\\", "/").strip(" ").lower()
    rank = lambda h, p: 0 if h == p else 1 if p.endswith("/" + h) else 2 if p.split("/")[-1] == h else 3
    want = {(h, p, rank(low(h), low(p))) for h in hints for p in paths if low(h) and low(h) in low(p)}
    got = matching.hint_join(spark.createDataFrame([(h,) for h in hints], "hint string"), spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_hint_join_pieces(spark):
    """Long hints with one head, base names that all share, and pieces that outnumber both tables."""
    paths = [f"repository/package{i}/module{i % 7}/index.html" for i in range(300)] + [f"x/{i}" for i in range(99990, 100010)]
    hints = [f"repository/package{i}/module{i % 7}" for i in range(300)] + [f"other{i}/index.html" for i in range(300)] + ["index.html", "package12", "99999", "100000", "100001/", "repository/none1"]
    want = {(h, p, 1 if p.endswith("/" + h) else 3) for h in hints for p in paths if h in p}
    h, p = spark.createDataFrame([(h,) for h in hints], "hint string"), spark.createDataFrame([(p,) for p in paths], "path string")
    joined = matching.hint_join(h, p)
    got = joined.collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    tree = joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Generate" in tree and "BroadcastExchange" not in tree


def test_names_are_matched_once_for_all_that_ask_alike(spark):
    index = spark.createDataFrame([(f"f{i}", f"src/{j}.py", f"f{i}", f"C{j}.f{i}") for i in range(3) for j in range(9)], "key string, file string, name string, qualname string")
    asked = [(q, f"C{q % 9}.f{q % 3}" if q % 5 else f"f{q % 3}", ("", "src", "3", None, "zz")[q % 7 % 5]) for q in range(400)] + [(1, "f2", "3"), (2, "C2.f2", "3"), (7, "", "x"), (7, None, "x"), (None, "f1", "")]
    queries = spark.createDataFrame(asked, "query_id int, function string, file_hint string")
    columns = ("query_id", "function", "file_hint", "file", "qualname", "place")
    plain = matching.best_matches(matching.candidates(queries, index)).select(*columns).collect()
    assert sorted(map(str, matching.answered(queries, index).select(*columns).collect())) == sorted(map(str, plain))


def test_rows_that_name_matching_joins(spark, tmp_path, monkeypatch):
    """Many parts ask the same: the candidates must not grow with them."""
    spark.createDataFrame([(i, "Brand#1", "SMALL TIN", i % 14) for i in range(5000)], "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    seen = []
    plain = matching.best_matches
    monkeypatch.setattr(matching, "best_matches", lambda found, *a: seen.append(found.count()) or plain(found, *a))
    assert QUERIES["j9_o6_name_matching"](spark, str(tmp_path)).count() == 5000 // 2 * 7 + 5000 // 2
    assert seen and seen[0] <= 7 * 7 * 2


def test_recall_of_whole_texts(spark, tmp_path):
    texts = [" ".join(f"w{(i * i + t) % (40 + t)}" for i in range(n)) for t, n in enumerate((0, 1, 2, 3, 11, 12, 13, 300, 3001))] + ["x " * 20 + "same " * 20 + "y " * 20]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["u1_u2_recall"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        words = t.split(" ")
        third = len(words) // 3
        gt, found = set(words[: len(words) - third]), words[third:]
        want = [len(gt & set(found)), *[round(len(gt & set(f)) / len(gt), 6) for f in (found[:1], found[:3], found)], bool(gt & set(found))]
        assert [got[i].hits, got[i].r1, got[i].r3, got[i].rall, got[i].hit] == pytest.approx(want, abs=1e-6)


def test_line_windows(spark):
    df = spark.createDataFrame([("a", "\n".join(f"l{i}" for i in range(700))), ("b", ""), ("c", " \n\t\n")], "path string, content string")
    got = [(r.path, r.start_line, r.end_line) for r in chunking.windows(df).collect()]
    assert got == [("a", 0, 699), ("a", 600, 699)]


def test_symbols(spark):
    source = "import os\nfrom x import y\n\nclass AuthService:\n    def login(self):\n        return helper()\n\ndef helper():\n    pass\n"
    df = spark.createDataFrame([("a.py", source), ("b.py", "def broken("), ("c.go", "func Run() {\n  x()\n}\n")], "path string, content string")
    got = {(r.path, r.qualname, r.kind, r.start, r.stop) for r in chunking.symbols(df).collect()}
    assert got == {("a.py", "AuthService", "class", 4, 6), ("a.py", "AuthService.login", "method", 5, 6), ("a.py", "helper", "function", 8, 9), ("c.go", "Run", "function", 1, 3)}
    edges = {(r.kind, r.source, r.target) for r in chunking.calls_and_imports(df).collect()}
    assert edges == {("import", "1", "os"), ("import", "2", "x"), ("call", "login", "helper")}


def test_import_edges(spark):
    df = spark.createDataFrame([(0, "src/pkg/a.py", ["pkg.b", "os"]), (1, "src/pkg/b.py", []), (2, "lib/pkg/b.py", [])], "file_no int, path string, imports array<string>")
    assert [tuple(r) for r in matching.import_edges(df).collect()] == [("src/pkg/a.py", "src/pkg/b.py")]


@pytest.mark.parametrize("spec", ["2:5", "-3:", ":-2", "1::3", "::-2", "8:2:-3", ""])
def test_slices(spark, spec):
    ids = list(range(10))
    want = ids[slice(*[int(x) if x else None for x in spec.split(":")])] if spec else ids
    got = [r.id for r in sampling.sliced(spark.range(10), "id", spec).collect()]
    assert sorted(got) == sorted(want)


def test_shuffle(spark):
    import random

    keys = [f"k{i}" for i in range(30)]
    want = sorted(keys)
    random.Random(42).shuffle(want)
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r.k for r in sampling.shuffled(df, "k").orderBy("position").collect()] == want


def test_filters():
    assert sampling.parse_filters("lang:Py path:Src/a junk x: other:1") == {"lang": ["py"], "path": ["Src/a"]}
    assert sampling.checked_int("7", "topk", 1, 100, 15) == 7 and sampling.checked_int(None, "topk", 1, 100, 15) == 15
    with pytest.raises(ValueError):
        sampling.checked_int(0, "topk", 1, 100, 15)
    with pytest.raises(ValueError):
        sampling.checked_name("a/b")


def test_upsert_and_resume(spark, tmp_path):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    changes = spark.createDataFrame([("b", 3, False, 1), ("c", 4, False, 2), ("a", 0, True, 3), ("z", 0, True, 4)], "id string, v int, deleted boolean, seq long")
    assert {tuple(r) for r in sampling.upserted(table, changes, "id").collect()} == {("b", 3), ("c", 4)}
    out = str(tmp_path / "out")
    assert files.resume_jsonl(table, out, "id").count() == 2
    more = table.unionByName(spark.createDataFrame([("c", 5)], "id string, v int"))
    assert [r.id for r in files.resume_jsonl(more, out, "id").collect()] == ["c"]


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "a"}\n\n{"id": "b"}\n')
    (tmp_path / "b.jsonl").write_text('{"id": "c"}\n{bad\n{worse\n')
    assert files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string").count() == 2
    assert [r.id for r in files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "id string", strict=False).collect()] == ["c"]
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "id string").collect()
    assert [(r.line, r.text) for r in files.bad_records(spark, str(tmp_path)).collect()] == [(2, "{bad")]


def test_trees_and_trajectories(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/x.traj.json").write_text(json.dumps([{"role": "user", "content": "hi"}]))
    (tmp_path / "t/y.traj.json").write_text(json.dumps({"instance_id": "Y", "messages": [{"role": "assistant", "content": "```bash\n@tool list_symbols --file a.py\n```"}, {"role": "user", "content": "<tool_result>ok"}]}))
    said = files.trajectories(spark, str(tmp_path / "t"))
    assert {(r.instance_id, r.pos, r.role) for r in said.collect()} == {("x", 0, "user"), ("Y", 0, "assistant"), ("Y", 1, "user")}
    assert [(r.instance_id, r.action) for r in sessions.tool_calls(said).collect()] == [("Y", "@tool list_symbols --file a.py")]
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1")
    (tmp_path / "src/big.py").write_text("x" * 100)
    assert [tuple(r) for r in files.source_tree(spark, str(tmp_path / "src"), 50).collect()] == [("a.py", "x = 1")]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x"], 1)], "instance_id string, l array<string>, b int")
    assert files.write_wide_csv(df, str(tmp_path / "c"), ["instance_id"])
    text = "".join(p.read_text() for p in (tmp_path / "c").glob("part*"))
    assert text.splitlines()[0] == "instance_id,b,l"
    assert not files.write_wide_csv(df.limit(0), str(tmp_path / "d"), [])
    report = files.markdown_report("T", {"n": 1, "pass": 0.5}, [], {"clarity": 1.0})
    assert "| (none) |" in report and "| pass | 0.5000 |" in report
    assert files.merged_config({"a": {"b": 1, "c": 2}}, {"a": {"b": None}}) == {"a": {"b": None, "c": 2}}


def test_index_policy(spark, tmp_path):
    wanted = {"repo_dir": "r", "base_commit": "c1", "embedding_model": "m"}
    build = lambda: spark.range(3)
    store = indexes.IndexStore(spark, str(tmp_path))
    with pytest.raises(LookupError, match="meta_missing"):
        store.get("i", wanted, build, policy="read_only")
    assert store.get("i", wanted, build)[1] == "rebuilt" and store.get("i", wanted, build)[1] == "cache_hit"
    fresh = indexes.IndexStore(spark, str(tmp_path))
    assert fresh.get("i", wanted, build)[1] == "disk_hit"
    changed = wanted | {"base_commit": "c2"}
    with pytest.raises(LookupError, match="base_commit_mismatch"):
        fresh.get("i", changed, build, policy="read_only")
    assert fresh.get("i", changed, build, policy="read_only", strict=False)[1] == "disk_hit"
    assert fresh.get("i", changed, build)[1:] == ("rebuilt", "base_commit_mismatch")


def test_gates():
    g = sessions.Gate()
    assert g.step("submit", []) == "no_search"
    g.step("search", ["a", "b"])
    assert g.step("list", ["a"]) == "listed" and g.step("submit", []) == "not_verified"
    assert g.step("read", ["a"]) == "opened" and g.fixated
    assert g.step("submit", ["a"]) == "one_candidate" and (g.blocked, g.strict) == (3, True)
    g.step("read", ["b"])
    assert g.step("submit", ["c"]) == "unread_hint" and g.step("submit", ["a"]) == "accepted"


def test_streaming_agrees_with_batch(spark, tmp_path):
    events = [(i % 5, i, i % 3 == 0, "abc"[(i // 7) % 3], i % 4) for i in range(120)]
    df = spark.createDataFrame(events, "user long, at long, bad boolean, cmd string, tokens long")
    df.coalesce(1).sortWithinPartitions("at").write.parquet(str(tmp_path / "in"))
    stream = streams.arrivals(spark, str(tmp_path / "in"), df.schema)
    out = streams.session_signals(stream, "user", "at", "bad", "cmd", "tokens")
    streams.drained(out, str(tmp_path / "ck"), str(tmp_path / "out"))
    got = {(r.user, r.at): (r.streak, r.repeat, r.total_tokens) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = sessions.repeats(sessions.streaks(df, "user", ["at"], F.col("bad")), "user", ["at"], "cmd").withColumn("actual", F.col("tokens")).withColumn("estimate", F.lit(0))
    want = {(r.user, r.at): (r.streak, r.repeat, float(r.total_tokens)) for r in sessions.running_tokens(batch, "user", ["at"]).collect()}
    assert got == want
    counts = streams.status_counts(streams.arrivals(spark, str(tmp_path / "in"), df.schema), "cmd")
    streams.drained(counts, str(tmp_path / "ck2"), str(tmp_path / "out2"), "complete")
    assert sum(r["count"] for r in spark.read.parquet(str(tmp_path / "out2")).collect()) == 120
