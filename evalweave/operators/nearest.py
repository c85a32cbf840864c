"""Exact vector top-k: Spark deals chunks to blocks of queries, each task keeps the best of its block.

A matrix product only rules rows out, by a bound on its rounding error; what it leaves is scored anew, in
doubles and in the order of the components, so scores and ties are those of `measures.dot`.

Defined cases, as in `measures.dot`: vectors that are null, hold a null or differ in length give a null score,
which ranks behind all others; NaN ranks before all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalweave.operators.ranking import top_k

#: Queries of a block at most, and at least where there are more blocks than needed; products held at a time.
BLOCK, LEAST, PRODUCTS = 4096, 512, 1 << 22
#: Rows and columns of a tile of products, candidates that are scored together.
ROWS, COLUMNS, TOGETHER = 512, 512, 1 << 13
#: Bytes of chunks that the first floors are taken from, chunks of a tile that keep one maximum.
FIRST, FOLD = 1 << 24, 32
#: Codes order scores as whole numbers.
NAN, NULL = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def codes(score: np.ndarray) -> np.ndarray:
    bits = (score + 0.0).view(np.int64)
    return np.where(np.isnan(score), NAN, bits ^ ((bits >> 63) & NAN))


def numbers(code: np.ndarray) -> np.ndarray:
    """The scores of codes: inf for NaN, -inf for null."""
    with np.errstate(invalid="ignore"):
        return np.where(code == NAN, np.inf, np.where(code == NULL, -np.inf, (code ^ ((code >> 63) & NAN)).view(np.float64)))


def kth(q: np.ndarray, code: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of n queries have k codes, and their k-th largest. Queries are taken in groups of like numbers of codes."""
    per = np.bincount(q, minlength=n)
    begin, code = np.cumsum(per) - per, code[np.argsort(q, kind="stable")]
    least = np.full(n, NULL)
    some = np.argsort(per, kind="stable")
    some = some[per[some] >= k]
    while len(some):
        end = max(1, int(np.searchsorted(per[some] * np.arange(1, len(some) + 1), PRODUCTS, "right")))
        now, some = some[:end], some[end:]
        wide = int(per[now[-1]])
        at = np.arange(wide)
        own = np.where(at < per[now][:, None], code[np.minimum(begin[now][:, None] + at, len(code) - 1)], NULL)
        least[now] = np.partition(own, wide - k, axis=1)[:, wide - k]
    return per >= k, least


def marked(mask: np.ndarray) -> np.ndarray:
    """Places of the few set values of a mask: 64 are looked at in one."""
    flat = mask.reshape(-1)
    whole = len(flat) // 64 * 64
    some = np.flatnonzero(np.packbits(flat[:whole]).view(np.uint64))
    at = np.flatnonzero(flat[:whole].reshape(-1, 64)[some])
    return np.concatenate([some[at >> 6] * 64 + (at & 63), whole + np.flatnonzero(flat[whole:])])


class Best:
    """The k best (query, score, code, key, row) of each query, in no order: NaN, numbers falling, null, ties by key."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.fresh, self.table = n, k, 0, None
        self.held = [np.zeros(0, t) for t in (np.uint16 if n <= 1 << 16 else np.int64, np.float64, np.int64, np.int64, np.int64)]
        self.new = [self.held]
        self.floor = np.full(n, -np.inf)  # a number below can't be among the best
        self.open = np.ones(n, bool)  # null scores may still count

    def add(self, q: np.ndarray, score: np.ndarray, key: np.ndarray, row: np.ndarray, null: bool = False) -> None:
        code = np.full(len(q), NULL) if null else codes(score)
        self.new.append([q.astype(self.held[0].dtype), score, code, key, row])
        self.fresh += len(q)
        if self.fresh >= max(1 << 16, self.n * self.k // 2):
            self.settle()

    def settle(self) -> None:
        """By the k-th best code of each query; only codes equal to it are ordered by key."""
        q, score, code, key, row = (np.concatenate(c) for c in zip(*self.new, strict=True))
        full, least = kth(q, code, self.n, self.k)
        keep = code > least[q]
        tied = np.flatnonzero((code == least[q]) & full[q])
        room = self.k - np.bincount(q[keep & full[q]], minlength=self.n)
        keep |= ~full[q]
        tight = np.bincount(q[tied], minlength=self.n) > room
        keep[tied] = True
        tied = tied[tight[q[tied]]]
        tied = tied[np.lexsort((key[tied], q[tied]))]
        keep[tied[np.arange(len(tied)) - np.searchsorted(q[tied], q[tied]) >= room[q[tied]]]] = False
        self.open = ~full | (least == NULL)
        last = np.flatnonzero(full)
        self.floor[last] = np.maximum(self.floor[last], numbers(least[last]))
        self.held = [c[keep] for c in (q, score, code, key, row)]
        self.new, self.fresh = [self.held], 0

    def order(self) -> None:
        """What is held, by query, best first."""
        self.settle()
        order = np.lexsort((self.held[3], ~self.held[2], self.held[0]))
        self.held[:] = [c[order] for c in self.held]

    def compact(self) -> None:
        """Drops the rows that no query holds."""
        self.order()
        rows, self.held[4] = np.unique(self.held[4], return_inverse=True)
        self.table = self.table.take(pa.array(rows)).combine_chunks()


def vectors(lists: pa.Array) -> list[tuple[int, bool, np.ndarray, np.ndarray]]:
    """(length, all finite, rows, matrix) of the vectors, alike ones together; length -1: null, or one that holds a null."""
    lens = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    off = np.concatenate([[0], np.cumsum(np.maximum(lens, 0))])
    run = lambda bad: np.concatenate([[0], np.cumsum(bad)])
    within = lambda bad: (s := run(bad))[off[1:]] > s[off[:-1]] if bad.any() else np.zeros(len(lens), bool)
    lens[within(pc.is_null(flat).to_numpy(zero_copy_only=False))] = -1
    small = pa.types.is_float32(flat.type)
    values = pc.fill_null(flat if small else flat.cast(pa.float64(), safe=False), 0).to_numpy(zero_copy_only=False)
    finite = ~within(~np.isfinite(values))
    out = []
    for dims in np.unique(lens):
        for good in (True, False):
            rows = np.flatnonzero((lens == dims) & (finite == good))
            if len(rows):
                alone = dims > 0 and len(rows) * dims == len(values)  # no others hold values
                out.append((int(dims), good, rows, values.reshape(-1, dims) if alone else values[off[rows][:, None] + np.arange(max(dims, 0))]))
    return out


def exact(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of vectors i of q and j of c (a row of doubles a component), summed in order."""
    out, left, right = np.zeros(len(i)), np.empty(len(i)), np.empty(len(i))
    for a, b in zip(q, c, strict=True):
        # Places are in range; with a mode, take writes to `out` without a copy.
        np.take(a, i, out=left, mode="clip")
        np.take(b, j, out=right, mode="clip")
        left *= right
        out += left
    return out


def error(q: np.ndarray, c: np.ndarray, finite: bool) -> tuple[bool, type, np.ndarray]:
    """Whether products bound the scores, the type to multiply in, and for each of q how far products may be off."""
    dims = q.shape[1]
    size = lambda x: np.sqrt(np.square(x, dtype=np.float64).sum(axis=1))
    with np.errstate(all="ignore"):
        most = size(q) * (size(c).max() if len(c) else 0.0)
        safe = finite and bool(most.max(initial=0) < 1e300)
        single = safe and q.dtype == c.dtype == np.float32 and bool(most.max(initial=0) < 1e37)
        give = (dims + 8) * most * (2.0**-23 if single else 2.0**-52) + dims * (2.0**-126 if single else 2.0**-1000)
    return safe, np.float32 if single else np.float64, give


def early(best: Best, at: np.ndarray, q: np.ndarray, c: np.ndarray) -> None:
    """Floors before any score: k groups of the finite vectors c hold a product of at least the k-th largest maximum."""
    safe, kind, give = error(q, c, True)
    tiles = len(c) // COLUMNS
    if not safe or tiles * (COLUMNS // FOLD) < 2 * best.k:
        return
    left, right = q.astype(kind, copy=False).T, c.astype(kind, copy=False)
    for a in range(0, len(q), ROWS):
        some, give_some, ids = left[:, a : a + ROWS], give[a : a + ROWS], at[a : a + ROWS]
        product, most = np.empty((COLUMNS, len(ids)), kind), np.empty((tiles, COLUMNS // FOLD, len(ids)), kind)
        for b in range(tiles):
            np.matmul(right[b * COLUMNS : (b + 1) * COLUMNS], some, out=product)
            half = COLUMNS // 2
            while half >= COLUMNS // FOLD:
                np.maximum(product[:half], product[half : 2 * half], out=product[:half])
                half //= 2
            most[b] = product[: COLUMNS // FOLD]
        flat = np.ascontiguousarray(most.reshape(-1, len(ids)).T)
        least = np.partition(flat, flat.shape[1] - best.k, axis=1)[:, flat.shape[1] - best.k]
        best.floor[ids] = np.maximum(best.floor[ids], least - give_some)


def first_floors(best: Best, asked: list, lists: list[pa.Array]) -> None:
    found = [(dims, c) for part in lists for dims, good, _, c in vectors(part) if good]
    for dims, finite, at, q in asked:
        alike = [c for length, c in found if length == dims > 0]
        if finite and alike:
            early(best, at, q, np.concatenate(alike))


def meet(best: Best, at: np.ndarray, q: np.ndarray, c: np.ndarray, key: np.ndarray, row: np.ndarray, finite: bool) -> None:
    """Adds what may be among the best of vectors q (queries `at`) and c, of equal length."""
    k = best.k
    safe, kind, give = error(q, c, finite)
    with np.errstate(all="ignore"):
        left, right = q.astype(kind, copy=False), c.astype(kind, copy=False).T
        by_q, by_c = (np.ascontiguousarray(x.T, dtype=np.float64) for x in (q, c))
        step = max(1, min(ROWS, PRODUCTS // max(1, len(c))))
        down = lambda x: np.nextafter(x.astype(kind), kind(-np.inf))
        held, n = [], 0
        for a in range(0, len(q), step):
            ids, some, less = at[a : a + step], left[a : a + step], give[a : a + step]
            least = best.floor[ids] - less
            if not safe:  # all are candidates
                i, j = (x.ravel() for x in np.indices((len(ids), len(c))))
            else:
                wide = np.isneginf(least)
                i, j = few(some, right, down(least)) if not wide.all() else np.zeros((2, 0), np.int64)
                wide = np.flatnonzero(wide | (np.bincount(i, minlength=len(ids)) > 4 * k))
                if len(wide):
                    near, room = some[wide] @ right, least[wide]
                    if len(c) > k:
                        room = np.maximum(room, np.partition(near, len(c) - k, axis=1)[:, len(c) - k] - 2 * less[wide])
                    x, y = np.nonzero(near >= down(room)[:, None])
                    rest = ~np.isin(i, wide)
                    i, j = np.concatenate([i[rest], wide[x]]), np.concatenate([j[rest], y])
            held.append((a + i, j))
            n += len(i)
            if n < TOGETHER and a + step < len(q):
                continue
            i, j = (np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
            score = exact(by_q, by_c, i, j)
            keep = ~(score < best.floor[at[i]])
            i, j, score = i[keep], j[keep], score[keep]
            best.add(at[i], score, key[j], row[j])


def few(some: np.ndarray, right: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the products that are not below their row's least, by tiles that stay in a core's cache."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    near, mask = np.empty(len(some) * COLUMNS, some.dtype), np.empty(len(some) * COLUMNS, bool)
    for b in range(0, right.shape[1], COLUMNS):
        tile = right[:, b : b + COLUMNS]
        wide = tile.shape[1]
        product, hit = (x[: len(some) * wide].reshape(-1, wide) for x in (near, mask))
        np.greater_equal(np.matmul(some, tile, out=product), least[:, None], out=hit)
        i, j = np.divmod(marked(hit), wide)
        out.append((i, b + j))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def add_block(best: Best, asked: list, lists: pa.Array, keep: pa.Table, key: str) -> None:
    """Chunks of a batch against all queries of the block. keep: the chunks' columns that are given back."""
    base = best.table.num_rows if best.table is not None else 0
    best.table = keep if best.table is None else pa.concat_tables([best.table, keep])
    keys = pc.fill_null(keep[key].cast(pa.int64()), -(1 << 63)).to_numpy()
    rows = base + np.arange(len(keys))
    found = vectors(lists)
    for dims, finite, at, q in asked:
        other = np.ones(len(keys), bool)
        for length, good, these, c in found:
            if length == dims >= 0:
                other[these] = False
                meet(best, at, q, c, keys[these], rows[these], finite and good)
        wait = at[best.open[at]]
        if len(wait) and other.any():
            first = np.flatnonzero(other)
            first = first[np.argsort(keys[first], kind="stable")[: best.k]]
            i, j = (x.ravel() for x in np.indices((len(wait), len(first))))
            best.add(wait[i], np.zeros(len(i)), keys[first[j]], rows[first[j]], null=True)
    if best.table.num_rows > 2 * best.n * best.k + (1 << 16):
        best.compact()


def ranks(held: list, same: np.ndarray, k: int) -> tuple[list, np.ndarray]:
    """What is held in order, with ranks from 1. same: a number of each query, falling nowhere; alike ones share their ranks."""
    group = same[held[0]]
    if len(same) and same[-1] + 1 < len(same):
        order = np.lexsort((held[3], ~held[2], group))
        held, group = [c[order] for c in held], group[order]
    rank = np.arange(1, len(group) + 1) - np.searchsorted(group, group)
    return [c[rank <= k] for c in held], rank[rank <= k]


def dealt_out(queries: int, cores: int) -> tuple[int, int]:
    """Blocks of queries and stripes of chunks, so that their tasks fill the cores in whole waves.

    Blocks come first: what a task gives is then final, and its rows are not ranked again.
    """
    blocks = max(1, -(-queries // BLOCK), min(cores, queries // LEAST))
    if blocks >= cores:
        return -(-blocks // cores) * cores, 1
    blocks = next(b for b in range(blocks, cores + 1) if cores % b == 0)
    return blocks, cores // blocks


def nearest(chunks: DataFrame, queries: DataFrame, k: int, key: str, keep: tuple[str, ...] = (), vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k best chunks of each query with score and rank, ties by key (a whole number).

    queries: query_no, query (vector). keep: columns of the chunks that are given back besides the key. Each task
    takes a block of queries and a stripe of the chunks, so that there are tasks enough where queries are few; its
    chunks pass by in batches. Where there is one stripe, a task ranks its rows, else a window does. A filter on
    chunk columns reaches the scan.
    """
    spark, names = chunks.sparkSession, [key, *[c for c in keep if c != key]]
    blocks, stripes = dealt_out(queries.count(), spark.sparkContext.defaultParallelism)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    asked = queries.select(dealt("query_no", blocks).alias("__block"), each(stripes).alias("__stripe"), F.lit(0).alias("__side"), "query_no", F.col("query").alias("__vector"), *[none(chunks, c).alias(c) for c in names])
    rows = (chunks if where is None else chunks.where(where)).select(
        each(blocks).alias("__block"), dealt(key, stripes).alias("__stripe"), F.lit(1).alias("__side"), none(queries, "query_no").alias("query_no"), F.col(vector).alias("__vector"), *names
    )
    met = asked.union(rows).withColumn("__unit", F.col("__block") * stripes + F.col("__stripe"))
    met = met.repartitionById(blocks * stripes, F.col("__unit")).sortWithinPartitions("__side").select("__side", "query_no", "__vector", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, best, asked, wait = [], None, [], []

        def pass_by(parts: list[pa.RecordBatch]) -> None:
            for part in parts:
                add_block(best, asked, part.column("__vector"), pa.Table.from_batches([part.select(names)]), key)

        for batch in batches:
            side = batch.column("__side").to_numpy()
            n = int(np.searchsorted(side, 1))
            if n:
                first.append(batch.slice(0, n).select(["query_no", "__vector"]))
            if n == len(side) or not first:
                continue
            if best is None:
                # By query: what the task gives is then sorted as top_k sorts it.
                table = pa.Table.from_batches(first).sort_by("query_no").combine_chunks()
                best, asked = Best(table.num_rows, k), vectors(table["__vector"].chunk(0))
            batch = batch.slice(n)
            if wait is None:
                pass_by([batch])
                continue
            wait.append(batch)
            if sum(part.column("__vector").flatten().nbytes for part in wait) >= FIRST:
                first_floors(best, asked, [part.column("__vector") for part in wait])
                pass_by(wait)
                wait = None
        if best is None:
            return
        if wait:
            first_floors(best, asked, [part.column("__vector") for part in wait])
            pass_by(wait)
        best.order()
        rank = None
        if stripes == 1:
            best.held, rank = ranks(best.held, pc.rank(table["query_no"], tiebreaker="dense").to_numpy().astype(np.int64) - 1, k)
        q, score, code, _, row = best.held
        for a in range(0, len(q), 1 << 16):
            part = slice(a, a + (1 << 16))
            out = best.table.take(pa.array(row[part])).append_column("query_no", table["query_no"].take(pa.array(q[part])))
            out = out.append_column("score", pa.array(score[part], pa.float64(), mask=code[part] == NULL))
            yield from (out if rank is None else out.append_column("rank", pa.array(rank[part], pa.int32()))).combine_chunks().to_batches()

    out = T.StructType([*[chunks.schema[c] for c in names], queries.schema["query_no"], T.StructField("score", T.DoubleType())])
    if stripes == 1:
        return met.mapInArrow(run, out.add("rank", T.IntegerType(), False))
    return top_k(met.mapInArrow(run, out), k, key)
