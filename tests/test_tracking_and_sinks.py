"""Read tracker (batch and stream), bad records over splits, bulk builds, trajectory files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from evalweave.functions import paths
from evalweave.operators import builds, commands, tracking
from evalweave.sources import files as sources
from evalweave.sources import records, trajectory_sink
from evalweave.streaming import sessions as streams
from evalweave.streaming import tracking as live


def test_arguments_read():
    read = commands.arguments_read
    assert read("cat a.py | grep -n -e foo b.py && head -n 3 c.py ; ls d.py") == (["a.py", "b.py", "c.py"], True)
    assert read("sed -i.bak -e s/a/b/ x.py x.py - ") == (["x.py"], False)
    assert read("cat a.py|wc") == (["a.py|wc"], False)
    assert read('cat "unclosed') == ([], False) and read("") == ([], False) and read("ls | rg") == ([], True)


def test_inside(spark):
    given = ["a/b.py", "./a//b.py", "a/../b.py", "../b.py", "a/../../a/b.py", "/repo/x.py", "/work/d/y.py", "/repo2/x.py", "/repo", "-", " ", None, "..", "src/../src/f.py "]
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, p string").select("i", paths.inside(F.col("p"), "/repo", "/work/").alias("q"))
    assert [r.q for r in rows.orderBy("i").collect()] == ["a/b.py", "a/b.py", "b.py", None, None, "x.py", "d/y.py", None, None, None, None, None, None, "src/f.py"]


def reads(spark, n=90):
    return spark.createDataFrame([(s, i, p, f"f{(i * 7 + s * p) % (60 if s else 20)}") for s in range(3) for i in range(n) for p in range(2)], "session int, seq int, pos int, path string")


def by_hand(rows, most):
    out, seen = [], {}
    for r in sorted(rows, key=lambda r: (r.session, r.seq, r.pos)):
        have = seen.setdefault(r.session, [])
        if r.path not in have and len(have) <= most:
            have.append(r.path)
            out.append((r.session, r.seq, len(have), r.path if len(have) <= most else "<<TRUNCATED>>"))
    return sorted(out)


def test_tracked_batch_and_stream_with_restart(spark, tmp_path):
    found = reads(spark)
    want = by_hand(found.collect(), 50)
    assert sum(x[3] == "<<TRUNCATED>>" for x in want) == 2
    assert sorted(map(tuple, tracking.tracked(found, "session", "seq").collect())) == want
    for i, part in enumerate(("seq < 30", "seq between 30 and 44", "seq > 44")):
        found.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = streams.arrivals(spark, f"{tmp_path}/in", found.schema)
        streams.drained(live.tracked(stream, "session", "seq"), f"{tmp_path}/checkpoint", f"{tmp_path}/out")
        done = spark.read.parquet(f"{tmp_path}/out")
        assert sorted(map(tuple, done.collect())) == [x for x in want if x[1] < (30, 45, 1000)[i]]


def test_tracker_reads_and_merges(spark):
    events = [(1, 1, "cat a.py ../b.py", "c.py:1"), (1, 2, "rg x", "c.py:1:x\n\nb.py\n d.py :2"), (1, 3, None, None), (2, 1, "grep foo a.py", None)]
    e = spark.createDataFrame([(*x, "r", "clash") for x in events], "session int, seq int, command string, output string, repo string, path string")
    files = spark.createDataFrame([("a.py", "r"), ("b.py", "r"), ("c.py", "r"), ("d.py", "other"), ("a.py", "r")], "path string, repo string")
    found = tracking.reads(e, files, "session", "seq", "command", "output", on=("repo",))
    assert sorted((r.session, r.seq, r.path) for r in found.collect()) == [(1, 1, "a.py"), (1, 2, "b.py"), (1, 2, "c.py"), (2, 1, "a.py")]
    read = tracking.tracked(found, "session", "seq", most=2)
    assert [r.path for r in read.where("session = 1").orderBy("place").collect()] == ["a.py", "c.py", "<<TRUNCATED>>"]
    candidates = spark.createDataFrame([(1, 1, "z.py"), (1, 2, ""), (1, 3, "c.py"), (3, 1, None)], "session int, place int, path string")
    assert [tuple(r) for r in tracking.merged(candidates, read, "session", most=3).orderBy("session").collect()] == [(1, ["z.py", "c.py", "a.py"]), (2, ["a.py"])]
    assert tracking.merged(candidates, read, "session", most=2).where("session = 1").first().paths == ["z.py", "c.py", "<<TRUNCATED>>"]
    assert tracking.tracked(found.limit(0), "session", "seq").count() == 0


def single_pass(path):
    with open(path, "rb") as f:
        if not path.endswith(".jsonl"):
            try:
                json.loads(f.read().decode())
            except UnicodeDecodeError as e:
                return "decode", None, str(e)
            except json.JSONDecodeError as e:
                return "json", e.lineno, e.msg
            return None
        for no, raw in enumerate(f, 1):
            try:
                line = raw.decode()
                if line.strip():
                    json.loads(line)
            except UnicodeDecodeError as e:
                return "decode", no, str(e)
            except json.JSONDecodeError as e:
                return "json", no, e.msg
    return None


def test_bad_records_over_splits(spark, tmp_path):
    good = b'{"a": "' + b"x" * 400 + b'"}\n'
    made = {
        "a/large.jsonl": good * 900 + b'{"a": 1,}\n' + good * 300 + b"nope\n", "late.jsonl": good * 1500 + b"\n" + b'{"a": "\xff"}\n' + good, "fine.jsonl": good * 3 + b'{"n": NaN, "n": -Infinity}\r\n \t\x1c\n[1, "\xc3\xa9"]',
        "empty.jsonl": b"", "b/c/first.jsonl": b'{"a"\n', "doc.json": b'{\n"a": [1,\n2,,]\n}', "good.json": b'[1,\n2]', "bytes.json": b'"\xfe"', "other.txt": b"{", "cut.jsonl": good + b'{"a": "x',
    }
    for name, content in made.items():
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        with open(f"{tmp_path}/{name}", "wb") as f:
            f.write(content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        found = records.bad_records(spark, str(tmp_path))
        got = {r.path.removeprefix(f"file://{tmp_path}/").removeprefix(f"file:{tmp_path}/"): (r.error_type, r.line, r.error) for r in found.collect()}
        text, total, bad = records.bad_report(spark, str(tmp_path))
        first = json.loads(records.bad_report(spark, str(tmp_path), "json", stop_at_first=True)[0])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {n: w for n in made if not n.endswith(".txt") and (w := single_pass(f"{tmp_path}/{n}"))}
    assert got == want and got["a/large.jsonl"][1] == 901 and got["late.jsonl"][:2] == ("decode", 1502)
    assert (total, bad, len(first)) == (8, 6, 1) and text.count("BAD ") == 6 and "a/large.jsonl:901 " in text


SPEC = {"index_version": "v1", "embedding_provider": "hash", "embedding_model": "m/8", "chunker": "lines", "chunk_size": "3", "overlap": "1"}


def test_bulk_builds(spark, tmp_path):
    files = spark.createDataFrame([(r, f"{p}.py", "a\nb\nc\nd\ne") for r in ("one", "two") for p in "xy"] + [("two", "blank.py", " \n"), ("two", "none.py", None)], "repo string, path string, content string")
    commits = lambda *xs: spark.createDataFrame(xs, "repo string, base_commit string")
    table = builds.IndexTable(spark, str(tmp_path / "ix"), SPEC, lambda c: F.array(F.length(c).cast("double")))
    state = lambda df: {r.repo: (r.status, r.reason, r.chunks) for r in df.collect()}
    written = lambda: {p: os.stat(p).st_mtime_ns for d, _, fs in os.walk(tmp_path / "ix" / "chunks") for f in fs if f.startswith("part-") for p in [f"{d}/{f}"]}

    assert state(table.build(commits(("one", "1" * 40), ("two", "2" * 40), ("gone", "3"), ("odd", None)), files)) == {
        "one": ("rebuilt", "meta_missing", 6), "two": ("rebuilt", "meta_missing", 6), "gone": ("failed", "no_files", None), "odd": ("failed", "commit_missing", None),
    }
    before = written()
    assert state(table.build(commits(("one", "1" * 40), ("two", "2" * 40)), files)) == {"one": ("disk_hit", None, 6), "two": ("disk_hit", None, 6)}
    assert written() == before
    assert state(table.build(commits(("one", "9" * 40), ("two", "2" * 40)), files)) == {"one": ("rebuilt", "meta_missing", 6), "two": ("disk_hit", None, 6)}
    after = written()
    assert all(after[p] == t for p, t in before.items()) and {p.split("commit=")[1][:8] for p in set(after) - set(before)} == {"99999999"}
    other = builds.IndexTable(spark, str(tmp_path / "ix"), SPEC | {"chunk_size": "5"}, table.embed)
    assert state(other.build(commits(("two", "2" * 40)), files, "read_only")) == {"two": ("failed", "chunk_params_mismatch", None)}
    assert state(other.build(commits(("two", "2" * 40)), files)) == {"two": ("rebuilt", "chunk_params_mismatch", 4)}
    assert other.chunks().where("repo = 'two'").count() == 4 and other.chunks().where("repo = 'one'").count() == 12
    assert other.build(commits(), files).count() == 0


def test_trajectory_files(spark, tmp_path):
    said = spark.createDataFrame([("a/1", 2, "assistant", "é\n"), ("a/1", 1, "user", None), ("b", 1, "user", "x" * 100_000)], "id string, turn int, role string, text string")
    infos = spark.createDataFrame([("a/1", "Submitted", 1.5, '{"exit_status": "late", "more": [1]}'), ("c", None, None, None)], "id string, exit_status string, instance_cost double, extra string")
    out = str(tmp_path / "out")
    trajectory_sink.save(trajectory_sink.sessions(said, infos, "id", "turn", "role", "text"), out)
    assert sorted(os.listdir(out)) == ["a%2F1.traj.json", "b.traj.json", "c.traj.json"] and os.listdir(tmp_path) == ["out"]
    with open(f"{out}/a%2F1.traj.json") as f:
        one = json.load(f)
    assert one["info"] == {"exit_status": "late", "submission": None, "model_stats": {"instance_cost": 1.5, "api_calls": 0}, "more": [1]}
    back = sources.trajectories(spark, out)
    assert sorted((r.instance_id, r.pos, r.role, r.content) for r in back.collect()) == [("a/1", 0, "user", None), ("a/1", 1, "assistant", "é\n"), ("b", 0, "user", "x" * 100_000)]
    # A task that fails leaves no file, nor does a repeated id; what was there stays.
    bad = trajectory_sink.sessions(said, infos.withColumn("extra", F.lit("{no json")), "id", "turn", "role", "text")
    for rows in (bad, trajectory_sink.sessions(said.where("id = 'b'"), infos.unionByName(infos), "id", "turn", "role", "text")):
        with pytest.raises(Exception, match="Error|error|instance_id|JSON"):
            trajectory_sink.save(rows, out)
        assert os.listdir(tmp_path) == ["out"] and len(os.listdir(out)) == 3
    trajectory_sink.save(trajectory_sink.sessions(said.where("id = 'b'"), infos.limit(0), "id", "turn", "role", "text"), out, "append")
    assert len(os.listdir(out)) == 3 and os.listdir(tmp_path) == ["out"]
    trajectory_sink.save(trajectory_sink.sessions(said.limit(0), infos.where("id = 'c'"), "id", "turn", "role", "text"), out)
    assert os.listdir(out) == ["c.traj.json"]
