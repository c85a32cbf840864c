"""Shared plumbing: written tables in the cluster's shared folder, Arrow access."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these bytes (space, \t \n \v \f \r).
WORD = r"[^\x20\x09-\x0D]+"

#: Spark removes the shuffle files of a query when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or our own where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="evalweave-")
    return _own[app]


def tune(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes, so that long texts cannot pile up in one batch."""
    for key, value in (("maxBytesPerBatch", str(8 << 20)), ("maxRecordsPerBatch", "4096")):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", value)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, label: str, rows_a_task: int | None = None):
        self.spark, self.rows_a_task = spark, rows_a_task
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Shuffle files of the query that makes the table go when it has ended: nothing reads them again."""
        schema, before = df.schema, self.spark.conf.get(_CLEAN, None)
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.mode("errorifexists").parquet(self.path(name))
        finally:
            self.spark.conf.unset(_CLEAN) if before is None else self.spark.conf.set(_CLEAN, before)
        return self.spark.read.schema(schema).parquet(self.path(name))

    def gathered(self, df: DataFrame, rows: int) -> DataFrame:
        """df in no more tasks than about so many rows ask for, at least two for each core; as it is without rows_a_task."""
        if not self.rows_a_task:
            return df
        return df.coalesce(max(2 * self.spark.sparkContext.defaultParallelism, -(-rows // self.rows_a_task)))

    def _delete(self, path: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def remove(self) -> None:
        """Deletes every table: what is returned must not read them any more."""
        self._delete(self.base)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8(array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array and the offset of each value (nulls are empty)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = pc.fill_null(array, "")
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, most: int = 1 << 20):
    """Runs (a, b) of values of at most `most` bytes together; a longer value is a run of its own."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def range_of(cuts: list[int], key: str) -> Column:
    """Number of cuts at or below the key (0 for null), found in two steps of about sqrt(cuts) comparisons."""
    if not cuts:
        return F.lit(0)
    wide = math.isqrt(len(cuts) - 1) + 1
    rows = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    numbers = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    coarse = F.size(F.filter(numbers([r[0] for r in rows]), lambda c: c <= F.col(key)))
    fine = F.size(F.filter(F.get(F.array(*map(numbers, rows)), coarse - 1), lambda c: c <= F.col(key)))
    return F.when(coarse > 0, (coarse - 1) * wide + fine).otherwise(F.lit(0))


def even_ranges(rows: DataFrame, key: str, weight: Column, parts: int, fan: int = 64) -> list[int]:
    """Starts of about `parts` ranges of the whole-number key that weigh alike, all but the first.

    Exact sums, so equal tables give equal ranges. Ranges that weigh too much are split by `fan`, until
    none does or one key is left; the driver sees at most about parts * fan sums at a time.
    """
    few = rows.select(F.col(key).alias("k"), weight.cast("long").alias("w"))
    low, high, total = few.agg(F.min("k"), F.max("k"), F.sum("w")).first()
    if low is None or parts < 2:
        return []
    most = max(1, total // parts)
    leaves = [(low, high, total)]
    while heavy := [x for x in leaves if x[2] > most and x[1] > x[0]]:
        kept = [x for x in leaves if not (x[2] > most and x[1] > x[0])]
        plan = [(i, a, -(-(b - a + 1) // fan)) for i, (a, b, _) in enumerate(heavy)]
        edges = sorted({e for a, b, _ in heavy for e in (a, b + 1)})
        at = {e: i + 1 for i, e in enumerate(edges)}
        dealt = F.broadcast(few.sparkSession.createDataFrame([(at[a], a, step) for _, a, step in plan], "at int, a long, step long"))
        bins = few.withColumn("at", range_of(edges, "k")).join(dealt, "at").groupBy("a", "step", F.floor((F.col("k") - F.col("a")) / F.col("step")).alias("bin"))
        ends = {a: b for a, b, _ in heavy}
        for a, step, n, w in bins.agg(F.sum("w")).collect():
            kept.append((a + n * step, min(a + (n + 1) * step - 1, ends[a]), w))
        leaves = kept
    cuts, held = [], 0
    for a, _, w in sorted(leaves):
        if held and held + w > most:
            cuts.append(a)
            held = 0
        held += w
    return [c for c in cuts if c > low]
