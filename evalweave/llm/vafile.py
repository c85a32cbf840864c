"""Exact top-k inner products by a vector-approximation file.

Equal vectors are stored once, with their k + 1 smallest ids. Vectors lie in blocks; a block has a grid of its
own, of 256 cells a component, and keeps a byte a component. Blocks of queries meet blocks of cells: a cell
gives a lower and an upper bound of the product, so most vectors are ruled out unread. The others' exact
vectors are read in order of their bounds, a batch of each query at a time, until its kth result is certain.

Defined cases: rows without an id, and vectors that are null or hold a null or non-finite component, take no
part (256 times a component must be finite too). Vectors of different length don't meet. Each repeated row is a
candidate, and each repeated query row a query; a query's own row is left out once. Scores beyond 64 bits are
held at the ends of that range and tie there.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalweave.llm.common import Scratch, shuffle_width, tune

#: Vectors of a block of cells, and of a block of queries.
CELLS, ASKED = 4096, 2048
#: One block in so many gives each query its first threshold.
SEEDS = 64
#: Exact vectors read of each query in the first batch; each further batch is larger by GROWTH.
FIRST, GROWTH = 16, 8

_ROWS = "vec_id long, digest binary, vec binary"
_CELLS = "block long, seed boolean, dims int, keys binary, low binary, width binary, codes binary"
_ASKED = "block long, dims int, keys binary, least binary, vecs binary"


def packed(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as hold them: equal vectors give equal bytes."""
    small = not len(values) or np.abs(values).max() < 1 << 15
    return b"h" + values.astype("<i2").tobytes() if small else b"d" + values.astype("<f8").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i2" if data[:1] == b"h" else "<f8", offset=1).astype(np.float64)


def scaled_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Id, digest and packed floor(256 * x) of each vector that takes part."""
    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        with np.errstate(over="ignore"):
            values = np.floor(256.0 * pc.fill_null(flat.cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)) + 0.0
        off = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        good = (bad[off[1:]] == bad[off[:-1]]) & pc.is_valid(lists).to_numpy(zero_copy_only=False) & pc.is_valid(ids).to_numpy(zero_copy_only=False)
        vecs = [packed(values[off[i] : off[i + 1]]) for i in np.flatnonzero(good)]
        digests = [hashlib.blake2b(x, digest_size=16).digest() for x in vecs]
        yield pa.record_batch([ids.filter(pa.array(good)).cast(pa.int64()), pa.array(digests, pa.binary()), pa.array(vecs, pa.binary())], ["vec_id", "digest", "vec"])


def _grouped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, list]]:
    """Rows (key, vec, ...) of equal length of vector, at most `most` together, with their number in the task."""
    held: dict[int, list] = {}
    n = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            dims = (len(row[1]) - 1) // (2 if row[1][:1] == b"h" else 8)
            rows = held.setdefault(dims, [])
            rows.append(row)
            if len(rows) >= most or len(rows) * dims >= most * 1024:
                yield n, held.pop(dims)
                n += 1
        if sum(map(len, held.values())) > 4 * most:  # many lengths: none may wait for long
            for rows in held.values():
                yield n, rows
                n += 1
            held = {}
    for rows in held.values():
        yield n, rows
        n += 1


def cell_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of cells: component d of a vector lies in [low + width * code, low + width * (code + 1) - 1]."""
    task = TaskContext.get().partitionId()
    for n, rows in _grouped(batches, CELLS):
        x = np.stack([unpacked(r[1]) for r in rows])
        low = x.min(axis=0) if x.shape[1] else np.zeros(0)
        width = np.floor((x.max(axis=0) - low) / 256) + 1 if x.shape[1] else np.zeros(0)
        codes = np.clip(np.floor((x - low) / width), 0, 255).astype(np.uint8)
        keys = np.array([r[0] for r in rows], "<i8").tobytes()
        yield pa.record_batch(
            [pa.array([task << 24 | n]), pa.array([(task + n) % SEEDS == 0]), pa.array([x.shape[1]], pa.int32())] + [pa.array([b], pa.binary()) for b in (keys, low.tobytes(), width.tobytes(), codes.tobytes())],
            ["block", "seed", "dims", "keys", "low", "width", "codes"],
        )


def asked_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for n, rows in _grouped(batches, ASKED):
        vecs = np.stack([unpacked(r[1]) for r in rows])
        least = np.array([-math.inf if r[2] is None else r[2] for r in rows], "<f8").tobytes()
        parts = (np.array([r[0] for r in rows], "<i8").tobytes(), least, vecs.tobytes())
        yield pa.record_batch([pa.array([task << 24 | n]), pa.array([vecs.shape[1]], pa.int32())] + [pa.array([b], pa.binary()) for b in parts], ["block", "dims", "keys", "least", "vecs"])


def product_bounds(q: np.ndarray, low: np.ndarray, width: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds of all products (a row a query), and how far each query's lower bounds lie below them.

    Whole numbers below 2^52 are exact in doubles; beyond that both give way by more than the rounding.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.abs(q) @ (np.abs(low) + 256 * width)
        give = np.where(size < 2.0**52, 0.0, size * 2.0**-40)
        upper = (q * width) @ codes.T.astype(np.float64) + (q @ low + np.maximum(q, 0) @ (width - 1) + give)[:, None]
        return upper, np.abs(q) @ (width - 1) + 2 * give


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for qk, least, vecs, keys, low, width, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            qk, least, keys, low, width = (np.frombuffer(b, t) for b, t in ((qk, "<i8"), (least, "<f8"), (keys, "<i8"), (low, "<f8"), (width, "<f8")))
            q, codes = np.frombuffer(vecs, "<f8").reshape(len(qk), -1), np.frombuffer(codes, np.uint8).reshape(len(keys), -1)
            for a in range(0, len(qk), 512):
                yield qk[a : a + 512], least[a : a + 512], keys, *product_bounds(q[a : a + 512], low, width, codes)


def lowest_of_best(k: int):
    """Each query's k highest lower bounds in a block."""

    def run(batches):
        for qk, _, keys, upper, slack in _pairs(batches):
            n = min(k, len(keys))
            best = np.sort(np.nan_to_num(np.partition(upper, len(keys) - n, axis=1)[:, len(keys) - n :] - slack[:, None], nan=-math.inf), axis=1)
            yield pa.record_batch([pa.array(np.repeat(qk, n)), pa.array(best.ravel())], ["q", "least"])

    return run


def not_ruled_out(k: int):
    """Vectors whose upper bound reaches the query's threshold and the kth lower bound of their own block."""

    def run(batches):
        for qk, least, keys, upper, slack in _pairs(batches):
            if len(keys) > k:
                least = np.fmax(least, _kth(upper, k) - slack)
            at, of = np.nonzero(~(upper < least[:, None]))
            yield pa.record_batch([pa.array(qk[at]), pa.array(keys[of]), pa.array(np.nan_to_num(upper[at, of], nan=math.inf))], ["q", "v", "upper"])

    return run


def exact_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """q, v and the exact product of two packed vectors."""
    top = (1 << 63) - 1
    for batch in batches:
        a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        out = np.zeros(len(a), np.int64)
        sizes = np.array([len(x) if x[:1] == y[:1] == b"h" else 0 for x, y in zip(a, b, strict=True)], np.int64)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            if size:
                x, y = (np.frombuffer(b"".join(s[i][1:] for i in at), "<i2").reshape(len(at), -1).astype(np.int64) for s in (a, b))
                out[at] = (x * y).sum(axis=1)
                continue
            for i in at:
                out[i] = max(-top - 1, min(top, sum(int(x) * int(y) for x, y in zip(unpacked(a[i]), unpacked(b[i]), strict=True))))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out)], ["q", "v", "score"])


def _meet(asked: DataFrame, cells: DataFrame, width: int) -> DataFrame:
    """Every block of queries with every block of cells of its length, dealt as a grid of about `width` fields."""
    across = max(1, math.isqrt(width // 16))
    down = max(1, width // across)
    a = asked.select("*", F.pmod(F.xxhash64("block"), F.lit(across)).alias("j"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("i")).drop("block")
    c = cells.select("*", F.pmod(F.xxhash64("block"), F.lit(down)).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("j")).drop("block", "seed")
    a, c = (x.withColumns({n: F.col(n).cast("int") for n in "ij"}) for x in (a, c))
    both = a.withColumnRenamed("keys", "q_keys").join(c, ["dims", "i", "j"])
    return both.select("q_keys", "least", "vecs", "keys", "low", "width", "codes")


def _without_one(ids: Column, own: Column) -> Column:
    at = F.array_position(ids, own)
    return F.when(at == 0, ids).otherwise(F.concat(F.slice(ids, F.lit(1), (at - 1).cast("int")), F.slice(ids, (at + 1).cast("int"), F.size(ids))))


def top_k(vectors: DataFrame, spark: SparkSession, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by `every`."""
    tune(spark)
    kept, more = Scratch(spark, "vectors"), k + 1
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = given.mapInArrow(scaled_rows, _ROWS)
    place = F.row_number().over(Window.partitionBy("digest").orderBy("vec_id"))
    firsts = rows.withColumn("place", place).where(F.col("place") <= more).groupBy("digest").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = kept.write("distinct", firsts.select(F.monotonically_increasing_id().alias("v"), "digest", "vec", "ids"))

    queries = given.where(F.col("vec_id") % every == 0).mapInArrow(scaled_rows, _ROWS)
    asked = kept.write("asked", queries.select("vec_id", "digest").join(distinct.select("v", "digest"), "digest").select(F.monotonically_increasing_id().alias("n"), F.col("vec_id").alias("query_id"), "v"))
    wanted = kept.write("wanted", asked.select("v").distinct().join(distinct.select("v", "vec"), "v"))
    cells = kept.write("cells", distinct.select("v", "vec").mapInArrow(cell_blocks, _CELLS))

    width = shuffle_width(spark)
    plain = wanted.select("v", "vec", F.lit(None).cast("double").alias("least")).mapInArrow(asked_blocks, _ASKED)
    low = _meet(plain, cells.where("seed"), width).mapInArrow(lowest_of_best(more), "q long, least double")
    best_low = low.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("least")))).where(F.col("place") <= more)
    least = best_low.groupBy("q").agg(F.min("least").alias("least"), F.count("*").alias("n")).where(F.col("n") == more).select(F.col("q").alias("v"), "least")
    blocks = kept.write("blocks", wanted.join(least, "v", "left").select("v", "vec", "least").mapInArrow(asked_blocks, _ASKED))
    rest = kept.write("rest0", _meet(blocks, cells, width).mapInArrow(not_ruled_out(more), "q long, v long, upper double"))
    best = _read_in_order(kept, rest, distinct, wanted, more)

    found = best.groupBy("q").agg(F.collect_list(F.struct("v", "score", "ids")).alias("found")).withColumnRenamed("q", "of")
    found = kept.write("found", found)
    own = asked.join(found, asked.v == found.of)
    each = F.flatten(
        F.transform("found", lambda x: F.transform(F.when(x.v == F.col("of"), _without_one(x.ids, F.col("query_id"))).otherwise(x.ids), lambda i: F.struct(x.score.alias("score"), i.alias("vec_id"))))
    )
    ordered = F.array_sort(each, lambda x, y: F.when(x.score != y.score, F.when(x.score > y.score, -1).otherwise(1)).when(x.vec_id < y.vec_id, -1).when(x.vec_id > y.vec_id, 1).otherwise(0))
    return own.select("query_id", F.posexplode(F.slice(ordered, 1, k)).alias("at", "hit")).select("query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", "hit.score")


def _read_in_order(kept: Scratch, rest: DataFrame, distinct: DataFrame, wanted: DataFrame, more: int) -> DataFrame:
    """The best `more` vectors of each query (q, v, score, ids), exact vectors read by falling bound until that is certain."""
    best, take, n = None, FIRST, 0
    by_bound = Window.partitionBy("q").orderBy(F.desc("upper"), "v")
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0], "v")
    while True:
        batch = kept.write(f"batch{n}", rest.withColumn("place", F.row_number().over(by_bound)).where(F.col("place") <= take).drop("place"))
        read = batch.join(distinct.select("v", "vec"), "v").join(wanted.select(F.col("v").alias("q"), F.col("vec").alias("q_vec")), "q")
        scored = read.select("q", "v", "vec", "q_vec").mapInArrow(exact_products, "q long, v long, score long").join(distinct.select("v", "ids"), "v").select("q", "v", "score", "ids")
        both = scored if best is None else best.unionByName(scored)
        best = kept.write(f"best{n}", both.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= more).drop("place"))
        last = batch.groupBy("q").agg(F.min(F.struct(F.col("upper").alias("upper"), (-F.col("v")).alias("v"))).alias("last"))
        kth = best.groupBy("q").agg(F.min("score").cast("double").alias("kth"), F.count("*").alias("n")).where(F.col("n") == more).drop("n")
        unread = F.struct(F.col("upper").alias("upper"), (-F.col("v")).alias("v")) < F.col("last")
        left = rest.join(last, "q").join(kth, "q", "left").where(unread & (F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))))
        rest, n, take = kept.write(f"rest{n + 1}", left.select("q", "v", "upper")), n + 1, take * GROWTH
        if rest.isEmpty():
            return best
