"""Phrase mining, exact top-k and lexical search against brute force: nulls, empty and long texts, ties, repeats, clashes."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from evalweave.llm import lexical, phrases, vafile

LOREM = "the quick brown fox jumps over lazy dog and then runs far away".split()


def texts(seed: int = 4) -> list:
    r = random.Random(seed)
    made = []
    for _ in range(60):
        words = [r.choice(LOREM) if r.random() < 0.8 else "New York City"[: r.choice((8, 13))] for _ in range(r.randrange(0, 60))]
        made.append("".join(w + r.choice((" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\x0b")) for w in words))
    return [*made, None, "", " \t. \n", "fox", "é ü É 😀 fox", "the quick brown fox " * 4000, "z" * 9000, "\x01\x02 \x00 A_b c-d 12é34", made[0], made[0]]


SCHEMA = "doc_id long, text string, lang string, item long, term long, node int, words string, phrase string, n int, a int, v int, q int"


def rows():
    out = [(i, t, ["en", None, "fr"][i % 3], 1, 2, 3, "w", "p", 4, 5, 6, 7) for i, t in enumerate(texts())]
    return [*out, out[3], (None, *out[5][1:]), (7, *out[8][1:])]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def mined(rows, least, most, top):
    n, f = Counter(), Counter()
    for row in rows:
        lang = row[2] or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(row[1])):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    cands = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    kept = []
    for (lang, p), a in cands.items():
        if any(lg == lang and len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (lg, q), b in cands.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        kept.append((lang, -score, -a, " ".join(p).encode(), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out, seen = [], Counter()
    for x in sorted(kept):
        seen[x[0]] += 1
        if seen[x[0]] <= top:
            out.append((x[0], seen[x[0]], x[3].decode(), *x[4:]))
    return out


@pytest.mark.parametrize(("least", "top"), [(4, 2000), (9, 12), (1, 30)])
def test_phrases(spark, least, top):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(docs, spark, least=least, top=top).collect())
    assert got == mined(rows(), least, 5, top)
    assert len(got) > 10


def test_phrases_in_shards_and_slices(spark, monkeypatch):
    """Many small shards and slices give the same sums."""
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(2)
    maps = {}
    want = phrases.counts(docs, spark, least=3).collect()
    shard = phrases.Shard("en", np.frombuffer(b"A b. b b a\tb", np.uint8), np.array([0, 9, 12]))
    assert shard.text.tobytes() == b" \n a b \n b b \n a b "
    assert [list(shard.whole(n)) for n in (1, 2)] == [[True] * 6, [True, False, True, False, True, False]]
    assert not shard.may(maps, 3)[3].any()
    again = phrases.counts(docs.repartition(9), spark, least=3).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, want))


def test_phrases_exact_beyond_64_bits(spark):
    """1000 * a * n and l * r stand beyond 64 bits and divide exactly."""
    big = 3_000_000_019
    out = spark.createDataFrame([(big, 7 * big, big + 2, big + 4)], "a long, n long, l long, r long").selectExpr("(cast(a as decimal(19)) * cast(1000 * cast(n as decimal(16)) as decimal(19))) div (cast(l as decimal(19)) * cast(r as decimal(19))) x").first().x
    assert out == 1000 * big * 7 * big // ((big + 2) * (big + 4))


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA), spark).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string"), spark).collect() == []


def ranked(docs, items, k):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    d = [(i, Counter(w := find(t)), len(w)) for i, t in docs]
    n_docs, n_words = sum(1 for x in d if x[2]), sum(x[2] for x in d)
    df = Counter(t for x in d for t in x[1])
    out = []
    for item, text in items:
        q = Counter(find(text))
        found = []
        for i, tf, n in d:
            m = 75 + (25 * n * n_docs) // n_words
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t, c in q.items() if tf[t])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_lexical(spark, monkeypatch, small):
    if small:  # so that the tree has many levels and the search many batches
        for name, value in (("RANGE", 4), ("LEAF", 2), ("FAN", 2), ("FIRST", 1), ("GROWTH", 2), ("ITEMS", 2), ("COUNTS", 30)):
            monkeypatch.setattr(lexical, name, value)
    items = [(0, "quick fox, FOX jumps"), (1, None), (2, ""), (3, "nothing matches qqq"), (4, "the quick brown fox jumps over the lazy dog 12é34"), (5, "É é"), (5, "dog"), (6, "zzz " + "z" * 9000)]
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    asked = spark.createDataFrame([(*x, 1, "w") for x in items], "item_id long, text string, item long, doc_id string")
    got = sorted((tuple(r) for r in lexical.ranked(docs, asked, spark, k=20).collect()), key=str)
    assert got == ranked([(r[0], r[1]) for r in rows()], items, 20)
    assert len(got) > 60


def test_lexical_of_nothing(spark):
    docs, items = spark.createDataFrame(rows(), SCHEMA), spark.createDataFrame([(1, "fox")], "item_id long, text string")
    assert lexical.ranked(docs.limit(0), items, spark).collect() == []
    assert lexical.ranked(docs, items.limit(0), spark).collect() == []
    assert lexical.ranked(docs.where("text is null"), items, spark).collect() == []


def vectors(seed=5):
    r = np.random.default_rng(seed)
    base = r.normal(size=(40, 6)) / 3
    vecs = [list(map(float, x)) for x in np.concatenate([base, base[:5] + 1e-4, np.repeat(base[7:8], 30, axis=0), r.normal(size=(60, 6)) * 5])]
    odd = [None, [], [None, 1.0], [math.nan] * 6, [math.inf] * 6, [1e200] * 6, [1.0] * 3, [-1.0] * 3, [1e30, -1e30, 0.0, 0.0, 0.0, 0.5], [1e9, 2e9, 0.0, 0.0, 0.0, 0.5], [0.0] * 6, [-0.0] * 6, []]
    out = [(i, v, "x", 1, 2) for i, v in enumerate([*vecs, *odd])]
    return [*out, (0, vecs[0], "x", 1, 2), (10, vecs[12], "x", 1, 2), (None, vecs[1], "x", 1, 2), (-10, vecs[7], "x", 1, 2)]


def nearest(rows, every, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    top, out = (1 << 63) - 1, []
    for a, (q, x) in enumerate(good):
        if q % every == 0:
            found = sorted((-max(-top - 1, min(top, sum(s * t for s, t in zip(x, y, strict=True)))), c) for b, (c, y) in enumerate(good) if a != b and len(x) == len(y))
            out += [(q, r, c, -s) for r, (s, c) in enumerate(found[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_vectors(spark, monkeypatch, small):
    if small:
        for name, value in (("CELLS", 8), ("ASKED", 3), ("SEEDS", 3), ("FIRST", 2), ("GROWTH", 2)):
            monkeypatch.setattr(vafile, name, value)
    table = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, vec string, v int, q int").repartition(3)
    assert sorted(tuple(r) for r in vafile.top_k(table, spark, every=10).collect()) == nearest(vectors(), 10, 5)
    assert vafile.top_k(table.limit(0), spark).collect() == []


def test_bounds_hold():
    r = np.random.default_rng(1)
    for scale in (0.2, 40.0, 1e7):
        x, q = (np.floor(256 * scale * r.normal(size=(n, 16))) for n in (300, 20))
        low, width = x.min(axis=0), np.floor((x.max(axis=0) - x.min(axis=0)) / 256) + 1
        codes = np.clip(np.floor((x - low) / width), 0, 255).astype(np.uint8)
        upper, slack = vafile.product_bounds(q, low, width, codes)
        exact = q @ x.T
        assert (upper >= exact - np.abs(exact) * 1e-12).all() and (upper - slack[:, None] <= exact + np.abs(exact) * 1e-12).all()


def test_counts_leave_few_tasks(spark, monkeypatch):
    sent, plain = spark.sparkContext.accumulator(0), phrases._count

    def counted(maps, most):
        run = plain(maps, most)

        def go(batches):
            for batch in run(batches):
                sent.add(batch.num_rows)
                yield batch

        return go

    monkeypatch.setattr(phrases, "_count", counted)
    docs = spark.createDataFrame([(i, "a b c d", "en") for i in range(640)], "doc_id long, text string, lang string").repartition(64)
    known = {(r.words, r.phrase): r.n for r in phrases.counts(docs, spark).collect()}
    assert known == {(0, ""): 2560} | {(n, " ".join("abcd"[i : i + n])): 640 for n in range(1, 5) for i in range(5 - n)}
    assert sent.value <= 11 * 2 * spark.sparkContext.defaultParallelism
