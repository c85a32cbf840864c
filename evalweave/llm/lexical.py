"""Ranked lexical search over a hierarchical max tree of document ranges.

One scan of the texts writes ranges: up to RANGE documents that follow one another in a task, with the counts of
the terms that any item asks for. Each range gives each of its terms the highest impact that a document of it
has, and FAN ranges (nodes) give their parent the highest of theirs, up to few nodes. The sum of an item's
weights times these impacts bounds every document below a node from above. Each item opens its nodes best first,
a batch at a time; an opened range is searched by itself the same way, over blocks of LEAF documents, and gives
its best documents. The search of an item ends when no bound reaches its last place; equal bounds are opened,
since the document with the smaller id may be there.

A term travels as a 64-bit hash; equality is by it. Defined cases: a null text has no terms, an item without
terms has no rows. Documents with one doc_id are ranked each; those without a doc_id come last among equal
scores. Items that share an item_id are ranked each.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalweave.llm.common import Scratch, tune, utf8
from evalweave.llm.words import _LOWER, span_hashes

U = np.uint64
#: Documents of a range at most, and counts of asked terms after which a range ends early.
RANGE, COUNTS = 4096, 1 << 21
#: Documents of a block inside a range, children of a node above it.
LEAF, FAN = 64, 16
#: Nodes opened for each item in the first batch; each further batch is larger by GROWTH.
FIRST, GROWTH = 4, 4
#: Items that one task searches a range for at a time.
ITEMS = 512
#: Asked terms are looked up in so many bits before anything is sent; exact joins follow.
BITS = 20

_INSIDE = np.ones(256, bool)
_INSIDE[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_RANGES = "range long, docs long, words long, ids array<long>, lens binary, doc binary, term binary, tf binary"


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each term and the number of the text that it lies in."""
    if not len(data):
        return np.zeros(0, U), np.zeros(0, np.int64)
    data = _LOWER[data]
    inside = _INSIDE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return span_hashes(data, starts, ends), np.searchsorted(off, starts, "right") - 1


def counted(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, occurrences), by text and term."""
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])])) if len(h) else np.zeros(0, np.int64)
    return t[new], h[new], np.diff(np.append(new, len(h)))


def _split(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Ids, bytes and offsets of texts, about `most` bytes at a time."""
    for batch in batches:
        raw, off = utf8(batch.column(1))
        ids, a = batch.column(0).to_pylist(), 0
        while a < len(ids):
            b = min(len(ids), max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1))
            yield ids[a:b], raw[off[a] : off[b]], off[a : b + 1] - off[a]
            a = b


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, raw, off in _split(batches):
        t, h, n = counted(*terms(raw, off))
        yield pa.record_batch([pa.array(np.array(ids, np.int64)[t]), pa.array(h.view(np.int64)), pa.array(n)], ["item", "term", "times"])


def _bytes(x: np.ndarray, kind: str) -> pa.Array:
    return pa.array([np.ascontiguousarray(x, kind).tobytes()], pa.binary())


def _scan(asked: np.ndarray):
    """Ranges of documents: ids, numbers of terms, and the counts of asked terms by document and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        ids: list = []
        parts: list[tuple] = []
        words = held = 0

        def made() -> pa.RecordBatch:
            lens, doc, term, tf = (np.concatenate([p[i] for p in parts]) for i in range(4))
            row = [pa.array([task << 32 | n]), pa.array([int((lens > 0).sum())]), pa.array([words]), pa.array([ids], pa.list_(pa.int64()))]
            return pa.record_batch([*row, _bytes(lens, "<i8"), _bytes(doc, "<i4"), _bytes(term, "<u8"), _bytes(tf, "<i8")], ["range", "docs", "words", "ids", "lens", "doc", "term", "tf"])

        for keys, raw, off in _split(batches):
            hashes, text = terms(raw, off)
            lens = np.bincount(text, minlength=len(keys))
            wanted = asked[(hashes >> U(64 - BITS)).astype(np.int64)]
            t, h, tf = counted(hashes[wanted], text[wanted])
            a = 0
            while a < len(keys):
                b = min(len(keys), a + RANGE - len(ids))
                lo, hi = np.searchsorted(t, (a, b))
                parts.append((lens[a:b], t[lo:hi] - a + len(ids), h[lo:hi], tf[lo:hi]))
                ids += keys[a:b]
                words, held, a = words + int(lens[a:b].sum()), held + int(hi - lo), b
                if len(ids) >= RANGE or held >= COUNTS:
                    yield made()
                    n, ids, parts, words, held = n + 1, [], [], 0, 0
        if ids:
            yield made()

    return run


def _each_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each range that hold a term."""
    for batch in batches:
        for data in batch.column(0).to_pylist():
            term, n = np.unique(np.frombuffer(data, "<u8"), return_counts=True)
            yield pa.record_batch([pa.array(term.view(np.int64)), pa.array(n)], ["term", "df"])


def impacts(tf: np.ndarray, lens: np.ndarray, docs: int, words: int) -> np.ndarray:
    """(1e9 * tf) div (1000 * tf + 12 * m), m = 75 + (25 * n * N) div L, in whole numbers."""
    m = 75 + np.array([25 * int(n) * docs // words for n in np.unique(lens)], np.int64)[np.unique(lens, return_inverse=True)[1]] if len(lens) else np.zeros(0, np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _highest(docs: int, words: int):
    """The highest impact of each term in each range."""

    def run(batches):
        for batch in batches:
            for number, lens, doc, term, tf in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lens, doc, term, tf = (np.frombuffer(b, k) for b, k in ((lens, "<i8"), (doc, "<i4"), (term, "<u8"), (tf, "<i8")))
                if len(term):
                    order = np.argsort(term, kind="stable")
                    t, new = np.unique(term[order], return_index=True)
                    top = np.maximum.reduceat(impacts(tf, lens[doc], docs, words)[order], new)
                    yield pa.record_batch([pa.array(np.full(len(t), number, np.int64)), pa.array(t.view(np.int64)), pa.array(top)], ["node", "term", "top"])

    return run


class _Range:
    """One range with the max tree of its blocks, searched for one item after the other."""

    def __init__(self, ids: list, lens: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, docs: int, words: int):
        self.ids = np.array([(x is None, 0 if x is None else x) for x in ids], np.int64).reshape(-1, 2)
        impact = impacts(tf, lens[doc], docs, words)
        order = np.lexsort((doc, term))
        self.doc, self.impact = doc[order].astype(np.int64), impact[order]
        self.terms, self.first = np.unique(term[order], return_index=True)
        self.first = np.append(self.first, len(order))
        # Leaves of the tree: the highest impact of a term in a block; a term's blocks lie together.
        key = term[order]
        block = self.doc // LEAF
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])])) if len(key) else np.zeros(0, np.int64)
        self.block, self.top, self.begin = block[new], np.maximum.reduceat(self.impact, new) if len(new) else new, np.append(new, len(key))
        self.blocks = np.searchsorted(new, self.first)

    def best(self, terms: np.ndarray, weights: np.ndarray, least: int, k: int) -> list[tuple[int, bool, int]]:
        """The k best documents as (score, without id, id) that score `least` or more and above 0, best first."""
        at = np.searchsorted(self.terms, terms)
        hit = at < len(self.terms)
        hit[hit] = self.terms[at[hit]] == terms[hit]
        at, weights = at[hit], weights[hit]
        if not len(at):
            return []
        # Entries (term, block) of the item's terms, by block.
        lens = self.blocks[at + 1] - self.blocks[at]
        entry = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens - self.blocks[at], lens)
        weight = np.repeat(weights, lens)
        order = np.argsort(self.block[entry], kind="stable")
        entry, weight = entry[order], weight[order]
        block, new = np.unique(self.block[entry], return_index=True)
        bound = np.add.reduceat(self.top[entry] * weight, new)
        ends = np.append(new[1:], len(entry))
        heap = [(-int(b), i) for i, b in enumerate(bound)]
        heapq.heapify(heap)
        top: list[tuple[int, bool, int]] = []
        while heap and -heap[0][0] >= max(1, least, top[k - 1][0] if len(top) >= k else 0):
            i = heapq.heappop(heap)[1]
            e, w = entry[new[i] : ends[i]], weight[new[i] : ends[i]]
            n = self.begin[e + 1] - self.begin[e]
            post = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - self.begin[e], n)
            low = int(block[i]) * LEAF
            score = np.zeros(LEAF, np.int64)
            np.add.at(score, self.doc[post] - low, self.impact[post] * np.repeat(w, n))
            found = np.flatnonzero(score >= max(1, least))
            top += [(int(score[j]), bool(self.ids[low + j, 0]), int(self.ids[low + j, 1])) for j in found]
            top = sorted(top, key=lambda x: (-x[0], x[1], x[2]))[:k]
        return top


def _search(docs: int, words: int, k: int):
    """Rows: a range and the items that open it."""

    def run(batches):
        last, held = None, None
        for batch in batches:
            for number, ids, lens, doc, term, tf, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != last:
                    held = _Range(ids, *(np.frombuffer(b, t) for b, t in ((lens, "<i8"), (doc, "<i4"), (term, "<u8"), (tf, "<i8"))), docs, words)
                    last = number
                out = [(x["item"], *hit) for x in items for hit in held.best(np.array(x["terms"], np.int64).view(U), np.array(x["weights"], np.int64), x["least"] or 0, k)]
                item, score, none, doc_id = zip(*out, strict=True) if out else ([], [], [], [])
                ids_out = pa.array([None if n else d for n, d in zip(none, doc_id, strict=True)], pa.int64())
                yield pa.record_batch([pa.array(item, pa.int64()), ids_out, pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return run


def _tree(kept: Scratch, leaves: DataFrame) -> list[DataFrame]:
    """Levels of (node, term, top), from the ranges up; the last has FAN nodes at most."""
    levels, nodes = [leaves], leaves.select(F.max("node")).first()[0]
    while nodes is not None and nodes >= FAN:
        up = levels[-1].groupBy(F.shiftright("node", FAN.bit_length() - 1).alias("node"), "term").agg(F.max("top").alias("top"))
        levels.append(kept.write(f"level{len(levels)}", up))
        nodes >>= FAN.bit_length() - 1
    return levels


def ranked(docs: DataFrame, items: DataFrame, spark: SparkSession, k: int = 20, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    tune(spark)
    kept = Scratch(spark, "lexical")
    asking = kept.write("items", items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).withColumn("item", F.monotonically_increasing_id()))
    asks = kept.write("asks", asking.select("item", "text").mapInArrow(_item_terms, "item long, term long, times long"))
    # At most 2^BITS places come to the driver, whatever the number of terms.
    places = asks.select(F.shiftrightunsigned("term", 64 - BITS).cast("int").alias("place")).distinct().toArrow().column(0).to_numpy()
    wanted = np.zeros(1 << BITS, bool)
    wanted[places] = True
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    ranges = kept.write("ranges", rows.mapInArrow(_scan(wanted), _RANGES))
    n_docs, n_words = ranges.agg(F.sum("docs"), F.sum("words")).first()
    if not n_words:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    df = ranges.select("term").mapInArrow(_each_term, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = kept.write("weights", asks.join(df, "term").select("item", "term", (F.col("times") * weight).alias("weight")))
    bundles = kept.write("bundles", weights.groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("x")).select("item", F.col("x.term").alias("terms"), F.col("x.weight").alias("weights")))

    # Numbers that follow one another across tasks, but for gaps behind tasks of fewer ranges than the most.
    bits = int(ranges.agg(F.max(F.col("range").bitwiseAND(0xFFFFFFFF))).first()[0]).bit_length()
    pages = ranges.select((F.shiftleft(F.shiftright("range", 32), bits) + F.col("range").bitwiseAND(0xFFFFFFFF)).alias("number"), "ids", "lens", "doc", "term", "tf")
    leaves = pages.drop("ids").mapInArrow(_highest(n_docs, n_words), "node long, term long, top long").join(weights.select("term").distinct(), "term", "left_semi")
    levels = _tree(kept, kept.write("level0", leaves.select("node", "term", "top")))
    best = _best_first(kept, levels, weights, bundles, pages, _search(n_docs, n_words, k), -(-asking.count() // ITEMS), k)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    out = best.withColumn("rank", place).where(F.col("rank") <= k)
    return out.join(asking.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _best_first(kept: Scratch, levels: list[DataFrame], weights: DataFrame, bundles: DataFrame, pages: DataFrame, search, parts: int, k: int) -> DataFrame:
    """Opens each item's nodes by falling bound, a batch at a time, until none reaches the item's kth score."""

    def bounds(tops: DataFrame) -> DataFrame:
        """tops: item, node, term, weight, top."""
        return tops.groupBy("item", "node").agg(F.sum(F.col("weight") * F.col("top")).alias("bound")).where("bound > 0")

    last = len(levels) - 1
    rest = kept.write("open0", bounds(levels[last].join(weights, "term")).select("item", F.lit(last).alias("level"), "node", "bound"))
    by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "level", "node")
    best, least, take, n = None, None, FIRST, 0
    while not rest.isEmpty():
        placed = kept.write(f"placed{n}", rest.withColumn("opened", F.row_number().over(by_bound) <= take))
        batch = placed.where("opened").drop("opened", "bound")
        children = [
            bounds(batch.where(F.col("level") == i).withColumnRenamed("node", "parent").join(weights, "item").join(levels[i - 1].withColumn("parent", F.shiftright("node", FAN.bit_length() - 1)), ["parent", "term"]))
            .select("item", F.lit(i - 1).alias("level"), "node", "bound")
            for i in range(1, last + 1)
        ]
        asked = batch.where("level = 0").select("item", F.col("node").alias("number")).join(bundles, "item")
        asked = (asked.withColumn("least", F.lit(0).cast("long")) if least is None else asked.join(least, "item", "left")).withColumn("part", F.pmod(F.xxhash64("item"), F.lit(max(1, parts))))
        groups = asked.groupBy("number", "part").agg(F.collect_list(F.struct("item", "terms", "weights", "least")).alias("items"))
        found = pages.join(groups, "number").select("number", "ids", "lens", "doc", "term", "tf", "items").mapInArrow(search, "item long, doc_id long, score long")
        both = found if best is None else best.unionByName(found)
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = kept.write(f"best{n}", both.withColumn("place", place).where(F.col("place") <= k).drop("place"))
        least = kept.write(f"least{n}", best.groupBy("item").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).drop("n"))
        left = placed.where("not opened").drop("opened")
        for more in children:
            left = left.unionByName(more)
        left = left.join(least, "item", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).drop("least")
        n, take = n + 1, take * GROWTH
        rest = kept.write(f"open{n}", left.select("item", "level", "node", "bound"))
    return best if best is not None else kept.spark.createDataFrame([], "item long, doc_id long, score long")
