"""Texts with very many matches: spans and masks as by brute force, at a cost linear in the matches."""

import random
import re
import time

from pyspark.sql import functions as F

from evalweave.llm import secrets


def text_of(n, seed):
    r = random.Random(seed)
    parts = [r.choice(["é ", "x", "token=", "token = abcdef12345678901234567890", "AKIA" + "A" * 20, " "]) + r.choice(["", "%024x" % r.getrandbits(96), "password: " + "f" * 30]) + r.choice([" ", "\n", "zz "]) for _ in range(n)]
    return "".join(parts)


def masked(text, spans):
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], "[SECRET]"]
        at = max(at, s.stop)
    return "".join(out) + text[at:]


def test_spans_and_masks_over_many_blocks(spark):
    texts = [text_of(n, n) for n in (0, 1, 3, 200, 255, 256, 257, 700, 1500)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in secrets.findings(docs, spark).collect():
        t = texts[r.doc_id]
        assert [(s.start, s.stop) for s in r.spans if s.kind == "hex"] == [m.span() for m in re.finditer("[0-9a-f]{24,}", t)]
        found = re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A)
        assert [(s.start, s.stop) for s in r.spans if s.kind == "assign"] == [m.span() for m in found if len(m[2]) >= 6]
        assert [(s.start, s.rank) for s in r.spans] == sorted((s.start, s.rank) for s in r.spans)
    spans = {r.doc_id: r.spans for r in secrets.findings(docs, spark).collect()}
    for r in secrets.redacted(docs, spark).collect():
        assert r.text == masked(texts[r.doc_id], spans[r.doc_id])
    assert secrets.redacted(docs.limit(0), spark).count() == 0


def test_cost_is_linear_in_the_matches(spark):
    def seconds(n):
        df = spark.range(1).select(F.repeat(F.lit("0123456789abcdef01234567 "), n).alias("t")).repartition(1)
        began = time.time()
        assert df.select(F.size(secrets.find(F.col("t"), secrets.BASE[2])).alias("n")).first().n == n
        return time.time() - began

    seconds(100)
    few, many = seconds(40_000), seconds(400_000)
    assert many < 12 * max(few, 1.0), (few, many)
