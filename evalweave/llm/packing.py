"""Packing by cutting-stock column generation.

A document's ids are cut into whole sequences and a rest. Rests are counted by length in units; a linear
program over packing patterns covers that histogram with the fewest sequences, its columns priced by a
knapsack dynamic program. Patterns are used whole times (rounded down), what is left is packed first-fit
decreasing, and the documents of each length, ranked, are dealt to the patterns' places by arithmetic.

Null or empty text is one end id. Repeated rows and ids are packed each. Texts of any length are cut. An
empty table gives an empty result. The driver holds the length histogram (at most `size` / `unit` numbers)
and the patterns, whatever the input. Only id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalweave.llm.bpe import encoder
from evalweave.llm.common import Scratch, blocks, shuffle_width, text_or_empty, tune, utf8

SIZE, UNIT, END = 2048, 8, 1
#: Columns are priced until the fractional packing is within this share of a lower bound.
EPS = 2e-3


def knapsack(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best multiset of items 1..capacity (value[i] for length i + 1) that fits: its value, and how many of each."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        gain = best[c - 1 :: -1][:c] + value[:c]
        i = int(np.argmax(gain))
        best[c], took[c] = (gain[i], i + 1) if gain[i] > best[c - 1] + 1e-15 else (best[c - 1], 0)
    pattern, c = np.zeros(capacity, np.int64), capacity
    while c > 0:
        if took[c]:
            pattern[took[c] - 1] += 1
            c -= took[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def fractional(demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, uses) of an optimal fractional packing, by revised simplex with priced columns."""
    kinds = np.flatnonzero(demand)
    m = len(kinds)
    columns = np.zeros((m, capacity), np.int64)
    columns[np.arange(m), kinds] = capacity // (kinds + 1)
    inverse = np.diag(1.0 / columns[np.arange(m), kinds])
    uses = inverse @ demand[kinds].astype(float)
    fewest = float((demand[kinds] * (kinds + 1)).sum()) / capacity
    for _ in range(40 * m + 100):
        price = np.zeros(capacity)
        price[kinds] = np.maximum(inverse.sum(axis=0), 0)
        worth, pattern = knapsack(price, capacity)
        fewest = max(fewest, uses.sum() / max(worth, 1.0))  # no packing can do with fewer
        if uses.sum() <= (1 + EPS) * fewest:
            break
        enter = inverse @ pattern[kinds].astype(float)
        able = enter > 1e-9
        if not able.any():
            break
        ratio = np.full(m, np.inf)
        ratio[able] = uses[able] / enter[able]
        out = int(np.argmin(ratio))
        step = ratio[out]
        uses = np.maximum(uses - step * enter, 0)
        uses[out] = step
        columns[out] = pattern
        row = inverse[out] / enter[out]
        inverse = inverse - np.outer(enter, row)
        inverse[out] = row
    return columns, uses


def patterns(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole uses of patterns that hold exactly this many items of each length."""
    out, left = [], demand.astype(np.int64).copy()
    if not left.any():
        return out
    for pattern, uses in sorted(zip(*fractional(left, capacity), strict=True), key=lambda x: -x[1]):
        held = pattern > 0
        n = int(min(np.floor(uses + 1e-9), (left[held] // pattern[held]).min())) if held.any() else 0
        if n > 0:
            out.append((pattern, n))
            left -= n * pattern
    # Less than one use of each pattern is left: first fit, longest first.
    bins: list[tuple[int, np.ndarray]] = []
    for i in range(capacity - 1, -1, -1):
        for _ in range(left[i]):
            for k, (room, pattern) in enumerate(bins):
                if room > i:
                    pattern[i] += 1
                    bins[k] = (room - i - 1, pattern)
                    break
            else:
                pattern = np.zeros(capacity, np.int64)
                pattern[i] = 1
                bins.append((capacity - i - 1, pattern))
    return out + [(p, 1) for _, p in bins]


def pieces(docs: DataFrame, spark: SparkSession, tokenizer: str, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens: whole sequences of ids and a rest, ended by END."""
    tune(spark)
    names = ["start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            _, off = utf8(batch.column(1))
            texts = [t or "" for t in batch.column(1).to_pylist()]
            source, rows = [], []
            for a, b in blocks(off, 2 << 20):
                ids, at = own.ids(texts[a:b])
                for i in range(b - a):
                    x = np.append(ids[at[i] : at[i + 1]], np.uint32(END)).astype("<u4")
                    for s in range(0, len(x), size):
                        part = x[s : s + size]
                        source.append(a + i)
                        rows.append((s, len(part), zlib.crc32(part.tobytes()), len(x)))
            columns = np.array(rows, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *map(pa.array, columns)], names=[key, *names])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), text_or_empty(text)).mapInArrow(run, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, spark: SparkSession, tokenizer: str, size: int = SIZE, unit: int = UNIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each piece with its sequence_id and its offset there."""
    cut = Scratch(spark, "packing").write("pieces", pieces(docs, spark, tokenizer, size, key, text))
    return place(cut, spark, size, unit, key)


def place(cut: DataFrame, spark: SparkSession, size: int = SIZE, unit: int = UNIT, key: str = "doc_id") -> DataFrame:
    capacity = size // unit
    salts = shuffle_width(spark)
    # A length may hold a third of all pieces: it is ranked in salted parts.
    cut = cut.withColumn("units", F.ceil(F.col("length") / unit).cast("int")).withColumn("salt", F.pmod(F.xxhash64(key, "start", "ids_crc32"), F.lit(salts)))
    counted = cut.groupBy("units", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("units").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = Scratch(spark, "packing").write("counted", counted.select("units", "salt", "n", before.alias("before")))
    demand = np.zeros(capacity, np.int64)
    for u, n in counted.groupBy("units").agg(F.sum("n")).collect():
        demand[u - 1] = n
    places, sequence, ranked = [], 0, np.zeros(capacity, np.int64)
    for pattern, uses in patterns(demand, capacity):
        for i in np.flatnonzero(pattern):
            lo, each = int(ranked[i]), int(pattern[i])
            places.append((int(i) + 1, lo, lo + each * uses, each, sequence))
            ranked[i] += each * uses
        sequence += uses
    # At most a row for each length of each pattern, both bounded by size / unit.
    dealt = F.broadcast(spark.createDataFrame(places, "u int, lo long, hi long, each long, base long"))
    within = F.row_number().over(Window.partitionBy("units", "salt").orderBy(key, "start", "ids_crc32"))
    rank = cut.withColumn("within", within).join(counted.select("units", "salt", "before"), ["units", "salt"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    hit = rank.join(dealt, (F.col("units") == F.col("u")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    hit = hit.withColumn("sequence_id", (F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))).cast("long"))
    # A sequence holds at most `size` pieces.
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("units"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long")
    return hit.select(key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))
