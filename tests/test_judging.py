"""Judge rounds with failures and restarts, and catalogs of a scope."""

import os

import pytest
from pyspark.sql import functions as F

from evalweave.operators import judging, summary
from evalweave.sources import files

NAMES = ("correctness", "completeness", "relevance", "clarity", "reasoning")


def test_rounds_failures_and_resume(spark, tmp_path):
    opened = str(tmp_path / "opened")

    def open_judge():
        with open(opened, "a") as f:
            f.write(f"{os.getpid()}\n")

        def judge(question, reference, candidate, no):
            if candidate == "down" or (candidate == "flaky" and no == 2):
                raise ConnectionError
            if candidate == "mute":
                return ""
            mark = 0 if candidate == "bad" else no * 3
            return "{" + ", ".join(f'"{d}": {mark}' for d in NAMES) + "}"

        return judge

    rows = [(h, "q", "r", h, "cat") for h in ("good", "bad", "flaky", "down", "mute", "done")] + [("n1", None, "r", "c", "cat"), ("n2", "q", " ", "c", "cat"), ("n3", "q", "r", None, "cat")]
    records = spark.createDataFrame(rows, "question_hash string, question string, reference string, candidate string, category string").coalesce(1)
    done = spark.createDataFrame([("done",)], "question_hash string")
    answered = judging.rounds(records, open_judge, 3, done)
    got = {(r.question_hash, r.round): (r.answer is None, None if r.scores is None else r.scores.clarity) for r in answered.collect()}
    assert len(got) == 15 and {h for h, _ in got} == {"good", "bad", "flaky", "down", "mute"}
    assert [got["good", i] for i in (1, 2, 3)] == [(False, 3), (False, 6), (False, 9)]
    assert got["bad", 1] == (False, 0) and got["down", 1] == (True, None) and got["mute", 1] == (False, None) and got["flaky", 2] == (True, None)
    assert len(open(opened).read().split()) == 1  # once for the task
    out = {r.question_hash: r for r in judging.scored(answered, keep=("category",)).collect()}
    assert set(out) == {"good", "bad", "flaky"}
    assert (out["good"].clarity, out["flaky"].clarity, out["flaky"].rounds_scored, out["bad"].total_score) == (6.0, 6.0, 2, 0.0)
    assert out["good"]["pass"] and not out["bad"]["pass"] and out["good"].category == "cat"
    assert {r.question_hash: r.clarity for r in judging.scored(answered, "mean").collect()}["flaky"] == 6.0
    flat = answered.where("scores is not null").select("question_hash", "scores.*")
    assert {r.question_hash: r.clarity for r in summary.judged(flat).collect()} == {k: v.clarity for k, v in out.items()}
    assert judging.rounds(records.limit(0), open_judge).count() == 0


def test_catalog_of_a_scope(spark, tmp_path):
    for d in ("m1/a/r1", "m1/a/r2", "m1/b/r1", "m2/a/r1", "m2/a/r1/deeper", "m3/a"):
        os.makedirs(tmp_path / "answers" / d, exist_ok=True)
        (tmp_path / "answers" / d / "org_repo.jsonl").write_text("{}\n")
    (tmp_path / "answers" / "m2/a/r1/notes.txt").write_text("x")
    scope = lambda *xs: sorted(tuple(r) for r in files.catalog(spark, *files.answers_scope("/".join([str(tmp_path), *xs]))).collect())
    every = [("m1", "a", "r1", "org_repo"), ("m1", "a", "r2", "org_repo"), ("m1", "b", "r1", "org_repo"), ("m2", "a", "r1", "org_repo")]
    assert scope() == scope("answers") == scope("answers", "") == every
    assert scope("answers", "m1") == every[:3] and scope("answers", "m1", "a") == every[:2] and scope("answers", "m2", "a", "r1") == every[3:]
    assert scope("answers", "m9") == scope("answers", "m1", "z") == []
    with pytest.raises(ValueError, match="too deep"):
        files.answers_scope("x/answers/a/b/c/d")
    assert files.answers_scope("a/answers/b/answers/m") == ("a/answers/b/answers", ("m",))
    root, only = files.answers_scope(f"{tmp_path}/answers/m1")
    listed = spark.read.format("binaryFile").load("/".join([root, *only, "*", "*", "*.jsonl"]))
    assert all("/m1/" in f for f in listed.inputFiles()) and len(listed.select(F.col("path")).collect()) == 3
