"""Index life cycle: compatibility reasons, and lookup in memory, on disk, or by a rebuild."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STRICT_ONLY = ("index_version", "repo_fingerprint", "base_commit", "aggregation")
CHECKS = ("index_version", "repo_dir", "repo_slug", "repo_fingerprint", "base_commit", "embedding_provider", "embedding_model", "chunker")


def mismatch(meta: str, wanted: str, strict: bool = True, columns: tuple[str, ...] = (*CHECKS, "chunk_size", "overlap", "aggregation")) -> Column:
    """The first reason, in a fixed order, why an index doesn't fit; null if it fits. meta, wanted: struct columns."""
    m, w = (lambda c: F.col(f"{meta}.{c}")), (lambda c: F.col(f"{wanted}.{c}"))
    arms = [(F.col(meta).isNull(), "meta_missing" if strict else "")]
    for c in CHECKS:
        if c not in columns or (c in STRICT_ONLY and not strict):
            continue
        if c == "base_commit":
            arms.append((F.coalesce(m(c), F.lit("")) == "", "base_commit_missing"))
        arms.append((~m(c).eqNullSafe(w(c)), f"{c}_mismatch"))
    if "chunk_size" in columns:
        size, over = m("chunk_size").try_cast("int"), m("overlap").try_cast("int")
        arms.append((size.isNull() | over.isNull(), "chunk_params_invalid"))
        arms.append(((size != w("chunk_size").try_cast("int")) | (over != w("overlap").try_cast("int")), "chunk_params_mismatch"))
    if "aggregation" in columns and strict:
        arms.append((~m("aggregation").eqNullSafe(w("aggregation")), "aggregation_mismatch"))
    out = F.when(F.lit(False), F.lit(""))
    for condition, reason in arms:
        out = out.when(F.coalesce(condition, F.lit(True)), F.lit(reason))
    return F.nullif(out, F.lit(""))


class IndexStore:
    """Indexes as Parquet folders with a one-row metadata table beside them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.memory = spark, root.rstrip("/"), {}

    def get(self, name: str, wanted: dict, build: Callable[[], DataFrame], policy: str = "auto", strict: bool = True) -> tuple[DataFrame, str, str | None]:
        """(index, status, reason): cache_hit, disk_hit or rebuilt; read_only raises instead of building."""
        key = (name, strict, tuple(sorted(wanted.items())))
        if key in self.memory:
            return self.memory[key], "cache_hit", None
        path, reason = f"{self.root}/{name}", "meta_missing"
        row = self.spark.createDataFrame([(wanted,)], "wanted map<string,string>")
        try:
            meta = self.spark.read.parquet(f"{path}/meta")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            meta = None
        if meta is not None:
            fields = tuple(wanted)
            one = row.select(F.struct(*[F.col("wanted")[c].alias(c) for c in fields]).alias("wanted")).join(meta.select(F.struct("*").alias("meta")))
            reason = one.select(mismatch("meta", "wanted", strict, fields)).first()[0]
            if reason is None:
                self.memory[key] = self.spark.read.parquet(f"{path}/data")
                return self.memory[key], "disk_hit", None
        if policy == "read_only":
            raise LookupError(reason)
        build().write.mode("overwrite").parquet(f"{path}/data")
        row.select(*[F.col("wanted")[c].alias(c) for c in wanted]).write.mode("overwrite").parquet(f"{path}/meta")
        self.memory[key] = self.spark.read.parquet(f"{path}/data")
        return self.memory[key], "rebuilt", reason
