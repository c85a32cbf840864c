"""Filters, slices, seeded shuffles and restarts over keyed tables."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions import paths


def matching(df: DataFrame, key: str, pattern: str, prefix: bool = False) -> DataFrame:
    """Rows whose key has the pattern somewhere (or, prefix, at its start). An empty pattern keeps all."""
    if not pattern:
        return df
    return df.where(F.col(key).rlike(f"^(?:{pattern})" if prefix else pattern))


def numbered(df: DataFrame, *order: str, name: str = "ordinal") -> DataFrame:
    """Adds the rank of each row in a global order, from 0: range partitions ranked each, offsets from their counts.

    The driver sees one count for each partition.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    marked = ranged.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id())
    marked = marked.withColumn("__row", F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))).persist()
    counts = {r["__part"]: r["count"] for r in marked.groupBy("__part").count().collect()}
    ahead, start = [], 0
    for p in sorted(counts):
        ahead.append((p, start))
        start += counts[p]
    offsets = F.broadcast(spark.createDataFrame(ahead, "__part int, __start long"))
    return marked.join(offsets, "__part").withColumn(name, F.col("__start") + F.col("__row")).drop("__part", "__row", "__start")


def sliced(df: DataFrame, order: str, spec: str) -> DataFrame:
    """start:stop[:step] of the rows in the order of a key, negatives and blanks as in Python."""
    fields = [int(x) if x.strip() else None for x in spec.split(":")] if spec else []
    if not fields:
        return df
    ranked = numbered(df, order)
    start, stop, step = slice(*fields).indices(ranked.count())
    low, high = (start, stop) if step > 0 else (stop + 1, start + 1)
    hit = (F.col("ordinal") >= low) & (F.col("ordinal") < high) & (F.pmod(F.col("ordinal") - start, F.lit(abs(step))) == 0)
    out = ranked.where(hit)
    return (out if step > 0 else out.orderBy(F.desc("ordinal"))).drop("ordinal")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Adds `position`: the row's place after sorting by key and a Mersenne-Twister shuffle.

    The keys of a task set go to the driver (they must, for this generator's order); for task sets, not corpora.
    """
    keys = sorted(r[0] for r in df.select(key).collect())
    random.Random(seed).shuffle(keys)
    place = df.sparkSession.createDataFrame(list(zip(keys, range(len(keys)), strict=True)), f"{key} {df.schema[key].dataType.simpleString()}, position long")
    return df.join(place, key)


def pick(df: DataFrame, key: str, spec: str) -> DataFrame:
    """The row of a key, or of an ordinal in key order if the spec is a number."""
    if spec.lstrip("-").isdigit() and not df.schema[key].dataType.simpleString().endswith("int"):
        return numbered(df, key).where(F.col("ordinal") == int(spec)).drop("ordinal")
    return df.where(F.col(key) == spec)


def undone(df: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys no finished row has."""
    return df.join(done.select(*keys), list(keys), "left_anti")


def parse_filters(text: str) -> dict[str, list[str]]:
    """lang:x path:y terms; languages in lower case; terms without colon, unknown or empty are ignored."""
    out: dict[str, list[str]] = {"lang": [], "path": []}
    for term in (text or "").split():
        name, colon, value = term.partition(":")
        if colon and value and name.lower() in out:
            out[name.lower()].append(value.lower() if name.lower() == "lang" else value)
    return out


def passes(spec: dict[str, list[str]], path: Column, language: Column) -> Column:
    """One of the languages (told by extension where not given), and all of the path parts."""
    own = F.coalesce(F.nullif(F.lower(language), F.lit("")), paths.language(path), F.lit(""))
    ok = own.isin(*spec["lang"]) if spec["lang"] else F.lit(True)
    for part in spec["path"]:
        ok = ok & F.contains(path, F.lit(part))
    return ok


def valid_instances(df: DataFrame, repos: DataFrame, skip_missing: bool = False) -> DataFrame:
    """Rows with an id and a repository that exists. Others are skipped, or named in an error, ten at most."""
    good = df.where(F.col("instance_id").isNotNull() & (F.col("instance_id") != "") & F.col("repo").isNotNull())
    kept = good.join(repos.select("repo"), "repo", "left_semi")
    if not skip_missing:
        lost = [r[0] for r in good.join(repos.select("repo"), "repo", "left_anti").select("instance_id").orderBy("instance_id").limit(10).collect()]
        if lost:
            raise ValueError(f"no repository for: {', '.join(lost)}")
    return kept


def checked_int(value, name: str, low: int, high: int, default: int) -> int:
    """A bounded whole-number argument."""
    if value is None or value == "":
        return default
    try:
        number = int(value)
    except (TypeError, ValueError):
        raise ValueError(f"{name} must be a whole number") from None
    if not low <= number <= high:
        raise ValueError(f"{name} must be within {low} and {high}")
    return number


def checked_name(value: str) -> str:
    if not value or "/" in value or "\\" in value or value in (".", ".."):
        raise ValueError("an output name must not have separators")
    return value


def last_by(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key: pre-aggregated on the map side, nothing is sorted."""
    row = F.struct(*df.columns)
    return df.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("r")).select("r.*")


def upserted(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with the rows of changes put in, later ones of a key winning; a change with deleted = true removes it."""
    old = table.withColumn("deleted", F.lit(False)).withColumn("seq", F.lit(-1).cast("long"))
    return last_by(old.unionByName(changes), key, "seq").where(~F.coalesce("deleted", F.lit(False))).drop("deleted", "seq")


def top_per_group(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)
