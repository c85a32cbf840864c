"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket; cumulated sums give each source's budget threshold; only
the bucket at the boundary is refined, by the hash's next bits, until one hash value is left. A row is
then in or out by comparing its hash with its source's threshold: no sort, and thresholds of smaller
budgets are nested in those of larger ones.

A target of k whole source sizes and a part takes each document k times, and once more below the
threshold. Null source is a source of its own (last). Null text has size 0 and is never taken. Rows
equal in id and text share their hash and so their fate. The hash depends on id and text alone, so
reruns agree. An empty table gives an empty result. Extra columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalweave.llm.common import WORD, Scratch, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Bits of the hash that each histogram resolves; 48 bits in all.
BITS = 12
LEVELS = 4


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict:
    """Words wanted of each source: `share` of all, by weight, none above `most` times its size.

    sizes holds a row for each source, which is what a mixture is configured by, never for a document.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    left, open_, out = share * sum(n for _, n in order), dict(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s: n for s, n in open_.items() if unit * weight[s] > most * n}
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        for s, n in full.items():
            out[s] = most * n
            left -= out[s]
            del open_[s]
    return out


def _keys(text: str) -> list:
    t = text_or_empty(text)
    return [
        F.regexp_count(t, F.lit(WORD)).cast("long").alias("size"),
        F.shiftrightunsigned(F.xxhash64("doc_id", t), 64 - BITS * LEVELS).alias("hash"),
    ]


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, size in words, and a non-negative hash of 48 bits."""
    return docs.select("doc_id", "source", *_keys(text))


def thresholds(rows: DataFrame, parts: dict[str | None, float]) -> dict[str | None, int]:
    """For each source the hash below which sizes add up to its part, as near as whole rows allow.

    Each level is one aggregation over the bucket at the boundary of each source; the driver sees at
    most 2**BITS sums a source.
    """
    schema = T.StructType([T.StructField("s", T.StringType()), T.StructField("low", T.LongType())])
    state = {s: (0, want) for s, want in parts.items() if want > 0}
    out = {s: 0 for s in parts}
    for level in range(LEVELS):
        if not state:
            break
        shift = BITS * (LEVELS - 1 - level)
        edge = rows.sparkSession.createDataFrame([(s, low) for s, (low, _) in state.items()], schema)
        near = rows.join(F.broadcast(edge), F.col("source").eqNullSafe(F.col("s")))
        if level:
            near = near.where(F.shiftright("hash", shift + BITS) == F.shiftright("low", shift + BITS))
        sums: dict = {}
        for s, b, n in near.groupBy("s", F.shiftright("hash", shift).alias("b")).agg(F.sum("size")).collect():
            sums.setdefault(s, []).append((b, n))
        following = {}
        for s, (_, want) in state.items():
            cut, lower = None, 0
            for b, n in sorted(sums.get(s, [])):
                if n > want:
                    cut = b
                    break
                want -= n
                lower = b + 1
            if cut is None:
                out[s] = lower << shift
            elif shift:
                following[s] = (cut << shift, want)
            else:  # one hash value is left: it is in if that comes nearer
                (n,) = [n for b, n in sums[s] if b == cut]
                out[s] = cut + (2 * want >= n)
        state = following
    return out


def plan(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """One row a source: its size, target, whole copies and hash threshold. rows: from sized(), written."""
    sizes = {s: n for s, n in rows.groupBy("source").agg(F.sum("size")).collect()}
    want = targets(list(sizes.items()))
    whole = {s: int(want[s] // n) if n else 0 for s, n in sizes.items()}
    edge = thresholds(rows, {s: want[s] - whole[s] * n for s, n in sizes.items()})
    schema = "s string, source_size long, target double, whole int, edge long"
    return spark.createDataFrame([(s, n, float(want[s]), whole[s], edge[s]) for s, n in sizes.items()], schema)


def _copies(rows: DataFrame, sources: DataFrame) -> DataFrame:
    # sources has a row for each source only, so its broadcast does not grow with the documents.
    out = rows.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("s")))
    more = F.col("whole") + (F.col("hash") < F.col("edge")).cast("int")
    return out.withColumn("copies", F.when(F.col("size") > 0, more).otherwise(F.lit(0)))


def mix(docs: DataFrame, spark: SparkSession, text: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, copies and taken words of every row of docs."""
    rows = Scratch(spark, "mixing").write("sized", sized(docs, text))
    out = _copies(rows, plan(rows, spark))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, spark: SparkSession, text: str = "text") -> DataFrame:
    """docs as the mix takes them: a row for each copy, with the columns of docs."""
    sources = plan(Scratch(spark, "mixing").write("sized", sized(docs, text)), spark)
    rows = docs.select(F.struct("*").alias("row"), "source", *_keys(text))
    return _copies(rows, sources).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
