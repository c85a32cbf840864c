"""Exact vector top-k, group scores, rank fusion and display orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions import paths
from evalweave.functions.measures import dot, unit_vector

RRF = 60


BLOCK = 128


def scored(chunks: DataFrame, queries: DataFrame, vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """Every chunk scored against every query of a stated set, in blocks of queries.

    queries: query_no, query (vector). Queries are packed into blocks of about BLOCK, each chunk is dealt to every
    block once, and chunks and blocks meet on the block number. A filter on chunk columns reaches the scan.
    """
    blocks = max(1, -(-queries.count() // BLOCK))
    packed = queries.withColumn("__block", F.pmod(F.xxhash64("query_no"), F.lit(blocks)).cast("int"))
    packed = packed.groupBy("__block").agg(F.collect_list(F.struct("query_no", "query")).alias("__queries"))
    rows = (chunks if where is None else chunks.where(where)).withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    each = F.transform("__queries", lambda q: F.struct(q["query_no"].alias("query_no"), dot(F.col(vector), q["query"]).alias("score")))
    return rows.join(packed, "__block").select(*chunks.columns, F.inline(each))


def top_k(scores: DataFrame, k: int, key: str) -> DataFrame:
    """The k best of each query, ties by key; partial top-k runs before the shuffle."""
    best = Window.partitionBy("query_no").orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def group_scores(scores: DataFrame, group: list[str], mode: str = "hybrid") -> DataFrame:
    """Score of each group from its members' scores: 0.7 max + 0.3 mean of the best three, or max, or sum."""
    if mode == "hybrid":
        ranked = scores.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"))))
        score = 0.7 * F.max("score") + 0.3 * F.avg(F.when(F.col("__r") <= 3, F.col("score")))
    else:
        ranked, score = scores, {"max": F.max, "sum": F.sum}[mode]("score")
    return ranked.groupBy(*group).agg(score.alias("score"), F.count("*").alias("evidence_count"))


def fused(files: DataFrame, n_queries: int) -> DataFrame:
    """Rankings of several queries as one: support, dense mean, reciprocal ranks. files: query_no, path, score, evidence_count.

    One query's ranking stays as it is.
    """
    ranked = files.withColumn("rank", F.row_number().over(Window.partitionBy("query_no").orderBy(F.desc("score"), F.desc("evidence_count"), "path")))
    dense = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("score")))
    support = F.countDistinct("query_no")
    score = F.first("score") if n_queries == 1 else 0.6 * support / n_queries + 0.4 * dense
    out = ranked.groupBy("path").agg(
        support.alias("support"), F.sum("evidence_count").alias("evidence_count"), dense.alias("dense_mean"), F.sum(1.0 / (RRF + F.col("rank"))).alias("rrf"), score.alias("score")
    )
    return out.withColumn("query_count", F.lit(n_queries))


def fused_order() -> list[Column]:
    return [F.desc("support"), F.desc("score"), F.desc("rrf"), F.desc("evidence_count"), F.asc("path")]


def ranked_files(files: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """Adds `place`: by score, then evidence, both falling, then path."""
    return files.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), F.desc("evidence_count"), "path")))


def fused_places(files: DataFrame) -> DataFrame:
    """Adds `place` in the fused order. files: from fused(), a row for each file of the rankings."""
    return files.withColumn("place", F.row_number().over(Window.orderBy(*fused_order())))


#: Kinds of symbols by how telling they are; others count 1.
KIND_PRIORITY = {"class": 4, "function": 3, "method": 2}


def symbol_order(tokens: Column, name: Column, kind: Column, start: Column, stop: Column) -> Column:
    """struct(overlap, priority, span), to be sorted falling: query tokens in the name, the kind, the length."""
    overlap = F.size(F.filter(tokens, lambda t: F.contains(F.lower(F.coalesce(name, F.lit(""))), t)))
    priority = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in KIND_PRIORITY.items()], F.lit(1))
    span = F.greatest(F.lit(0), F.coalesce(stop, F.lit(0)) - F.coalesce(start, F.lit(0)))
    return F.struct(overlap.alias("overlap"), priority.alias("priority"), span.alias("span"))


def best_symbols(symbols: DataFrame, key: str, limit: int) -> DataFrame:
    """The first symbols of each key in symbol_order(), ties by start and name. symbols: tokens, name, kind, start, stop."""
    order = symbol_order(*[F.col(c) for c in ("tokens", "name", "kind", "start", "stop")])
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("order"), "start", "name"))
    return symbols.withColumn("order", order).withColumn("place", place).where(F.col("place") <= limit).drop("order")


def listed_symbols(symbols: DataFrame, key: str, limit: int) -> DataFrame:
    """The first symbols of each key by start, then name."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("start", "name"))
    return symbols.withColumn("place", place).where(F.col("place") <= limit)


def dependencies(edges: DataFrame, sources: int = 12, targets: int = 6) -> DataFrame:
    """Display rows of the sources with most targets: source, shown (the first targets), more (how many are left out).

    edges: source, target. One row a source meets in the order of the report, which has `sources` rows.
    """
    by = edges.distinct().groupBy("source").agg(F.sort_array(F.collect_list("target")).alias("t"))
    rows = by.select("source", F.slice("t", 1, targets).alias("shown"), F.greatest(F.lit(0), F.size("t") - targets).alias("more"), F.size("t").alias("fan_out"))
    return rows.orderBy(F.desc("fan_out"), F.lower("source"), "source").limit(sources)


def displayed(files: DataFrame, mode: str = "ranked", group: tuple[str, ...] = ()) -> DataFrame:
    """Adds `place` within each group: ranked by score, blind (alphabetical) or clustered (directories by their best score)."""
    low, per = F.lower("path"), Window.partitionBy(*group)
    if mode == "ranked":
        return files.withColumn("place", F.row_number().over(per.orderBy(F.desc("score"), F.desc("evidence_count"), "path")))
    if mode == "blind":
        return files.withColumn("place", F.row_number().over(per.orderBy(low, "path"))).drop("score")
    with_dir = files.withColumn("dir", paths.parent(F.col("path")))
    with_dir = with_dir.withColumn("best", F.max("score").over(Window.partitionBy(*group, "dir")))
    return with_dir.withColumn("place", F.row_number().over(per.orderBy(F.desc("best"), F.lower("dir"), low, "path"))).drop("score", "best")


def reordered(rows: DataFrame, key: str, order: list) -> DataFrame:
    """Rows in the order of a given key list, the others behind it in key order."""
    kind = rows.schema[key].dataType.simpleString()
    given = rows.sparkSession.createDataFrame([(k, i) for i, k in enumerate(order)], f"{key} {kind}, place int")
    return rows.join(F.broadcast(given), key, "left").orderBy(F.asc_nulls_last("place"), key)


def diverse(rows: DataFrame, kind: str, rank: str, limit: int, group: tuple[str, ...] = ()) -> DataFrame:
    """In each group the first of each kind by rank, then others by rank, up to the limit."""
    later = F.row_number().over(Window.partitionBy(*group, kind).orderBy(rank)) > 1
    place = F.row_number().over(Window.partitionBy(*group).orderBy("__later", rank))
    return rows.withColumn("__later", later).withColumn("__place", place).where(F.col("__place") <= limit).drop("__later", "__place")


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """A deterministic stand-in for an embedder: tokens hashed to signed dimensions, unit length. JVM-side."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[^\s]+"), F.lit(0))
    sign = lambda h: F.when(F.shiftright(h, 32) % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    at = lambda hashes, d: F.aggregate(F.filter(hashes, lambda h: F.pmod(h, F.lit(dims)) == d), F.lit(0.0), lambda acc, h: acc + sign(h))
    spread = lambda hashes: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: at(hashes, d))
    # An array of one element holds what is made once and used for every dimension.
    once = lambda made, use: F.get(F.transform(F.array(made), use), F.lit(0))
    return once(F.transform(found, lambda t: F.xxhash64(t)), lambda hashes: once(spread(hashes), unit_vector))
