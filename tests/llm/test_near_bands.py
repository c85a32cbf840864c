"""Bands that many texts share: no links lost, and no pairs of all leaders."""

import random

import numpy as np
import pytest

from evalweave.llm import links, minhash
from evalweave.llm.common import Scratch


def family(seed: int, count: int, words: int, edits: int) -> list[str]:
    """Copies of one text, each with words of its own in some places."""
    r = random.Random(seed)
    base = [f"b{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(count):
        w = list(base)
        for j in r.sample(range(words), edits):
            w[j] = f"e{seed}x{i}x{j}"
        out.append(" ".join(w))
    return out


def sets(texts):
    return [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]


def brute(texts):
    own, label = sets(texts), list(range(len(texts)))
    links_ = 0
    for i in range(len(own)):
        for j in range(i):
            same = len(own[i] & own[j])
            if 100 * same >= 80 * (len(own[i]) + len(own[j]) - same):
                links_ += 1
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label, links_


def near(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return [r.group for r in sorted(minhash.near_groups(df, spark).collect(), key=lambda r: r.key)]


@pytest.mark.parametrize("crowd", [1, 4])
def test_groups_equal_brute_force_at_crowded_bands(spark, monkeypatch, crowd):
    """Families below, about and above the threshold, a chain whose ends are far apart, and one long text."""
    monkeypatch.setattr(links, "CROWD", crowd)
    texts = family(1, 24, 200, 6) + family(2, 24, 200, 4) + family(3, 24, 200, 2)
    w = [f"c{i}" for i in range(300)]
    for i in range(20):
        w[12 * i : 12 * i + 3] = [f"d{i}a", f"d{i}b", f"d{i}c"]
        texts.append(" ".join(w))
    texts.append(" ".join(family(4, 1, 9000, 1)))
    want, linked = brute(texts)
    got = near(spark, texts)
    assert got == want and linked > 300 and len(set(want)) > 24


def test_texts_below_the_threshold_are_not_paired_out(spark, monkeypatch):
    """Twice the texts in the same bands make at most 2.5 times the pairs."""
    made, write = {}, Scratch.write

    def counted(self, name, df):
        out = write(self, name, df)
        if name.endswith("_pairs"):
            made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    pairs = []
    for count in (100, 200):
        made.clear()
        assert near(spark, family(5, count, 200, 6)) == list(range(count))
        pairs.append(sum(made.values()))
    assert pairs[1] <= 2.5 * pairs[0] and pairs[1] <= 8 * 200


def test_pairs_that_bits_tell_apart_do_not_leave_their_join(spark, monkeypatch):
    """Texts that choose between two words at 24 places share rare shingles with half of the others, and none is linked."""
    r = random.Random(8)
    texts = [" ".join(f"v{i}{r.randrange(2)}" if i % 8 == 0 else f"w{i}" for i in range(192)) for _ in range(80)]
    made, write = {}, Scratch.write

    def counted(self, name, df):
        out = write(self, name, df)
        if name in ("leaders_pairs", "inner_pairs"):
            made[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    want, _ = brute(texts)
    assert near(spark, texts) == want
    assert sum(made.values()) < 80


def test_folds_differ_no_more_than_their_sets():
    noise = np.random.default_rng(2)
    for n in (3, 60, 700, 5000):
        a, b = (np.unique(noise.integers(0, 1 << 63, n).astype(np.uint64) % np.uint64(2 * n) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        x, y = (np.frombuffer(links.folded(p), np.uint8) for p in links.parities(np.concatenate([a, b]), np.array([len(a), len(b)]), links.FOLD))
        assert len(x) == len(y) == links.FOLD // 8
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_few_bits_are_sent_as_places(spark, monkeypatch):
    sent, plain = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda sc, value: sent.append(value.nbytes) or plain(sc, value))
    every = spark.range(5000).select(links.bit_of("id"), "id")
    for few, count in ((links.FEW, 40), (0, 40), (links.FEW, 0)):
        monkeypatch.setattr(links, "FEW", few)
        keep = links.asked(every.where(f"id < {count}").select("bit"))
        kept = {row.id for row in every.mapInArrow(keep, every.schema).collect()}
        assert set(range(count)) <= kept and len(kept) < count + 10
    assert sent[0] <= 8 * 40 and sent[1] == 1 << 23 and sent[2] == 0


def test_few_rows_take_few_tasks(spark):
    """However many shuffle partitions there are."""
    own = {"spark.sql.shuffle.partitions": "90", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    edges = spark.createDataFrame([(i, i + 1) for i in range(300) if i % 3 < 2], "a long, b long")
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        found = links.components(Scratch(spark, "few", 1 << 14), edges, "few")
        assert {(r.id, r.component) for r in found.collect()} == {(i, i // 3 * 3) for i in range(300)}
        assert len(found.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_members_of_near_leaders_meet_once(spark, monkeypatch):
    """Not anew in each token that they share."""
    plans, write = {}, Scratch.write

    def seen(self, name, df):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(self, name, df)

    monkeypatch.setattr(Scratch, "write", seen)
    texts = family(2, 8, 200, 4) + family(3, 8, 200, 2)
    assert near(spark, texts) == brute(texts)[0]
    assert "token#" not in plans["inner_pairs"]
