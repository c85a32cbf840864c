"""Phrase collocation mining: candidates from sketch upper bounds, counted by guarded automata.

Three scans build count sketches of the phrases of one, of two, and of three to five words; a phrase is added
only if every shorter one in it may be frequent. With the third goes a map of the words that lie in such a pair:
no other word is part of a candidate. A sketch's counters are spread over slices that Spark sums; a
counter that reaches the least count sets a bit of a map of fixed size. A phrase whose bits are set, and those
of all phrases inside it, is a candidate: counters only over-estimate, so none is missed, and a full map merely
lets more through. In the last scan each shard of the texts compiles the candidates that occur in it into one
Aho-Corasick automaton for each language, a blank on either side of each phrase as a guard, and counts all
matches, overlapping ones included. Sums over shards are exact; thresholds and scores follow.

Defined cases: a null text is empty, a null lang is 'und', repeated rows count each, documents need no id. A
language without candidates has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalweave.llm.common import Scratch, shuffle_width, tune, utf8
from evalweave.llm.words import _LOWER, mix, span_hashes

U = np.uint64
#: Bits of the maps that the scans share: 8 MB each.
MAP = 26
#: Bytes of text that one automaton is made for, and counters that one slice of a sketch holds by expectation.
SHARD, SLICE = 8 << 20, 1 << 21
#: Phrases whose counts a task holds before it sends them.
HELD = 1 << 19
#: Bytes of text that a task counts, where that leaves WAVES tasks for each core.
COUNTED, WAVES = 64 << 20, 2

_BREAK = np.zeros(256, bool)
_BREAK[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, *range(0x0A, 0x0E)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True


class Shard:
    """The words of some texts of one language, and the hashes of their phrases.

    text: pieces as " word word ", a line feed between two (no word holds one, nor a blank).
    """

    def __init__(self, lang: str, data: np.ndarray, off: np.ndarray):
        data = _LOWER[data]
        off = off[(off > 0) & (off < len(data))]
        cut = _BREAK[data]
        inside = ~(cut | _BLANK[data])
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        begin, stop = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1 : len(data)]
        stop[:-1] &= ~inside[1:] | edge[1 : len(data)]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        # A word begins a piece if a break or the start of a text lies between it and the word before.
        breaks = np.cumsum(cut) + np.cumsum(edge[: len(data)])
        self.piece = np.cumsum(np.diff(breaks[starts], prepend=-1) != 0) if len(starts) else np.zeros(0, np.int64)
        salt = span_hashes(np.frombuffer(lang.encode(), np.uint8), np.array([0]), np.array([len(lang.encode())])) if lang else np.zeros(1, U)
        self.words = mix(span_hashes(data, starts, ends) + salt)
        new = np.diff(self.piece, prepend=0) != 0
        lens = ends - starts
        self.begin = np.cumsum(1 + 2 * new + np.concatenate([[0], lens[:-1]])) if len(starts) else starts
        self.end = self.begin + lens
        self.text = np.full(int(self.end[-1]) + 1 if len(starts) else 0, 0x20, np.uint8)
        at = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
        self.text[at + np.repeat(self.begin, lens)] = data[at + np.repeat(starts, lens)]
        self.text[self.begin[new] - 2] = 0x0A

    def hashes(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; of those that would leave their piece nothing is to be used."""
        out = self.words
        if n > 1:
            out = np.full(len(self.words), U(n), U)
            for j in range(min(n, len(out))):
                m = len(out) - j
                out[:m] = mix(out[:m] * U(0x9FB21C651E98DF25) + self.words[j:])
        return out

    def whole(self, n: int) -> np.ndarray:
        """Whether the n words from each word on lie in one piece."""
        good = np.zeros(len(self.words), bool)
        if len(good) >= n:
            good[: len(good) - n + 1] = self.piece[n - 1 :] == self.piece[: len(good) - n + 1]
        return good

    def may(self, maps: dict[int, np.ndarray], most: int) -> dict[int, np.ndarray]:
        """For 1 to `most` words: where a phrase starts whose bits, and those of all phrases inside it, are set."""
        found: dict[int, np.ndarray] = {}
        for n in range(1, most + 1):
            good = self.whole(n)
            if n > 1:
                good &= found[n - 1]
                good[:-1] &= found[n - 1][1:]
            if n in maps:
                at = np.flatnonzero(good)
                h = self.hashes(n)[at] >> U(64 - MAP)
                good[at] = (maps[n][h >> U(3)] >> (h & U(7)).astype(np.uint8)) & 1 == 1
            found[n] = good
        return found


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Shard]]:
    """All texts of a task by language, about SHARD bytes together at a time. A longer text is one shard."""
    held: dict[str, list] = {}
    size = 0

    def made():
        for lang, parts in held.items():
            off = np.cumsum([0, *(len(p) for p in parts)])
            yield lang, Shard(lang, np.concatenate(parts), off)

    for batch in batches:
        raw, off = utf8(batch.column(1))
        for i, lang in enumerate(batch.column(0).to_pylist()):
            held.setdefault(lang, []).append(raw[off[i] : off[i + 1]])
            size += int(off[i + 1] - off[i])
            if size >= SHARD:
                yield from made()
                held, size = {}, 0
    yield from made()


def _slices(h: np.ndarray, bits: int, first: int) -> Iterator[pa.RecordBatch]:
    """Rows (slice, keys, counts) of hashes: 2^bits slices, numbered from `first`, of 2^32 counters each."""
    h, counts = np.unique(h >> U(32 - bits), return_counts=True)
    cuts = np.searchsorted(h >> U(32), np.arange((1 << bits) + 1, dtype=U))
    full = np.flatnonzero(np.diff(cuts))
    keys, counts = (h & U(0xFFFFFFFF)).astype("<u4"), counts.astype("<u4")
    for a in range(0, len(full), 256):
        some = full[a : a + 256]
        parts = [[x[cuts[s] : cuts[s + 1]].tobytes() for s in some] for x in (keys, counts)]
        yield pa.record_batch([pa.array(some + first, pa.int32()), pa.array(parts[0], pa.binary()), pa.array(parts[1], pa.binary())], ["slice", "keys", "counts"])


def _sketch(sizes: tuple[int, ...], maps, bits: int):
    """The sketch of phrases of these sizes; the words of possible pairs go to slices of their own, above the others."""

    def run(batches):
        known = maps.value if maps else {}
        for _, shard in shards(batches):
            may = shard.may(known, sizes[-1])
            yield from _slices(np.concatenate([shard.hashes(n)[may[n]] for n in sizes]), bits, 0)
            if sizes[0] > 2:
                paired = may[2].copy()
                paired[1:] |= may[2][:-1]
                yield from _slices(shard.words[paired], bits, 1 << bits)

    return run


def _reaching(least: int, bits: int):
    """The part of the map that a slice covers: bits of counters that reach `least` (1 above the first 2^bits slices).

    Rows of a slice come together.
    """

    def bitmap(s: int, keys: list[bytes], counts: list[bytes]) -> pa.RecordBatch:
        k, at = np.unique(np.frombuffer(b"".join(keys), "<u4"), return_inverse=True)
        total = np.bincount(at, np.frombuffer(b"".join(counts), "<u4"), len(k))
        marks = np.zeros(1 << (MAP - bits), np.uint8)
        marks[k[total >= (least if s < 1 << bits else 1)] >> np.uint32(32 - (MAP - bits))] = 1
        return pa.record_batch([pa.array([s], pa.int32()), pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())], ["slice", "marks"])

    def run(batches):
        now, keys, counts = None, [], []
        for batch in batches:
            for s, k, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if now is not None and s != now:
                    yield bitmap(now, keys, counts)
                    keys, counts = [], []
                now = s
                keys.append(k)
                counts.append(c)
        if now is not None:
            yield bitmap(now, keys, counts)

    return run


def _frequent(texts: DataFrame, sizes: tuple[int, ...], maps, least: int, bits: int) -> dict[int, np.ndarray]:
    """The map of one sketch, by size, and of the words in possible pairs. The driver gets 2 * 2^MAP bits at most."""
    spread = texts.mapInArrow(_sketch(sizes, maps, bits), "slice int, keys binary, counts binary")
    parts = min(1 << bits, max(shuffle_width(texts.sparkSession), (1 << bits) // 4))
    summed = spread.repartition(parts, "slice").sortWithinPartitions("slice").mapInArrow(_reaching(least, bits), "slice int, marks binary")
    out = np.zeros((2, 1 << (MAP - 3)), np.uint8)
    width = out.shape[1] >> bits
    for s, marks in summed.collect():
        at = s % (1 << bits)
        out[s >> bits, at * width : (at + 1) * width] = np.frombuffer(marks, np.uint8)
    return {n: out[0] for n in sizes} | ({1: out[1]} if sizes[0] > 2 else {})


def _matches(shard: Shard, maps: dict[int, np.ndarray], most: int) -> Iterator[tuple[str, int, int]]:
    """(phrase, words, matches) of each candidate in a shard."""
    may, plain = shard.may(maps, most), shard.text.tobytes()
    machine, phrases = ahocorasick.Automaton(), []
    for n in range(1, most + 1):
        at = np.flatnonzero(may[n])
        at = at[np.unique(shard.hashes(n)[at], return_index=True)[1]]
        for a, b in zip(shard.begin[at].tolist(), shard.end[at + n - 1].tolist(), strict=True):
            phrase = plain[a:b].decode()
            machine.add_word(f" {phrase} ", len(phrases))
            phrases.append((phrase, n))
    if phrases:
        machine.make_automaton()
        counts = np.bincount(np.fromiter(map(itemgetter(1), machine.iter(plain.decode())), np.int64), minlength=len(phrases))
        for (phrase, n), c in zip(phrases, counts.tolist(), strict=True):
            yield phrase, n, c


def _count(maps, most: int):
    """(lang, words, phrase, n): matches of each candidate, and with 0 words the number of words, summed in the task."""

    def run(batches):
        held: dict[tuple[str, int, str], int] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            rows = list(held.items())
            for a in range(0, len(rows), 1 << 16):
                langs, words, phrases = zip(*(k for k, _ in rows[a : a + (1 << 16)]), strict=True)
                yield pa.record_batch([pa.array(langs), pa.array(words, pa.int32()), pa.array(phrases), pa.array([c for _, c in rows[a : a + (1 << 16)]], pa.int64())], ["lang", "words", "phrase", "n"])

        for lang, shard in shards(batches):
            held[lang, 0, ""] = held.get((lang, 0, ""), 0) + len(shard.words)
            for phrase, n, c in _matches(shard, maps.value, most):
                held[lang, n, phrase] = held.get((lang, n, phrase), 0) + c
            if len(held) >= HELD:
                yield from sent()
                held.clear()
        yield from sent()

    return run


def counts(docs: DataFrame, spark: SparkSession, least: int = 100, most: int = 5, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, words, phrase, n): every phrase of 1 to `most` words that occurs `least` times in its language.

    A row of 0 words has the number of all words of the language.
    """
    tune(spark)
    kept = Scratch(spark, "phrases")
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    # A sketch holds one or two phrases for each word, a word is some 6 bytes.
    bits = min(16, max(4, (size // 4 // SLICE).bit_length()))
    maps: dict[int, np.ndarray] = {}
    sent = None
    for sizes in ((1,), (2,), tuple(range(3, most + 1))):
        if sizes and sizes[-1] <= most:
            maps = maps | _frequent(texts, sizes, sent, least, bits)
            if sent:
                sent.unpersist()
            sent = spark.sparkContext.broadcast(maps)
    # Each task sends a row for each candidate in its texts: the more text it has read, the fewer rows for the same counts.
    tasks = max(WAVES * spark.sparkContext.defaultParallelism, size // COUNTED)
    counted = texts.coalesce(tasks).mapInArrow(_count(sent, most), "lang string, words int, phrase string, n long")
    summed = counted.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where((F.col("words") == 0) | (F.col("n") >= least))
    return kept.write("counts", summed.select("lang", "words", "phrase", "n"))


def _words(phrase: str = "phrase") -> Column:
    return F.split(phrase, " ", -1)


def _span(words: str, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(docs: DataFrame, spark: SparkSession, least: int = 100, most: int = 5, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases by the score of their weakest cut."""
    known = counts(docs, spark, least, most)
    phrases = known.where("words >= 1").select("lang", "words", "phrase", F.col("n").alias("a"))
    candidates = phrases.where("words >= 2").withColumn("w", _words())

    inside = candidates.where("words >= 3").select("lang", "a", "words", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inside = inside.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    longer = inside.select("lang", _span("w", F.col("at"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = candidates.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")

    cuts = left.select("lang", "phrase", "a", "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _span("w", F.lit(1), F.col("k")).alias("one"), _span("w", F.col("k") + 1, F.col("words") - F.col("k")).alias("two"))
    part = phrases.drop("words")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("one"), F.col("a").alias("l")), ["lang", "one"]).join(part.select("lang", F.col("phrase").alias("two"), F.col("a").alias("r")), ["lang", "two"])
    totals = known.where("words = 0").select("lang", "n")
    # 1000 * a * n and l * r as decimals of 38 digits: each factor may use 64 bits.
    wide = cuts.join(totals, "lang").withColumn("score", F.expr("(cast(a as decimal(19)) * cast(1000 * cast(n as decimal(16)) as decimal(19))) div (cast(l as decimal(19)) * cast(r as decimal(19)))"))
    weakest = wide.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    scored = weakest.select("lang", "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), "n", F.col("x.score").cast("long").alias("score"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
