"""Bulk build of chunk indexes: one job for all repositories, of which only those that don't fit are built.

An index is a partition (repo, commit, embedder) of one chunk table, and a partition of one table of metadata beside
it. Metadata is written after the chunks, so a build that breaks off is found stale by the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.functions.paths import language, sanitized
from evalweave.operators import chunking, indexes
from evalweave.operators.ranking import hash_embedding

#: The fields that an index is checked by, next to its repository and commit.
FIELDS = ("index_version", "embedding_provider", "embedding_model", "chunker", "chunk_size", "overlap")
_KEYS = ("repo", "commit", "embedder")
_META = "repo string, commit string, embedder string, repo_dir string, base_commit string, " + ", ".join(f"{f} string" for f in FIELDS) + ", chunks long"
_DATA = "repo string, commit string, embedder string, path string, start_line int, end_line int, language string, text string, embedding array<double>"


class IndexTable:
    """All indexes below a root. spec: the FIELDS as strings; embed: text column -> vector column."""

    def __init__(self, spark: SparkSession, root: str, spec: dict[str, str], embed: Callable[[Column], Column] = hash_embedding):
        self.spark, self.root, self.spec, self.embed = spark, root.rstrip("/"), spec, embed

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def chunks(self) -> DataFrame:
        return self._read("chunks", _DATA)

    def meta(self) -> DataFrame:
        return self._read("meta", _META)

    def embedder(self) -> str:
        return f"{self.spec['embedding_provider']}_{self.spec['embedding_model']}"

    def plan(self, commits: DataFrame, files: DataFrame) -> DataFrame:
        """repo, base_commit, commit, embedder, reason (null: it fits), known (it has files). commits: repo, base_commit; one row each."""
        wanted = commits.groupBy("repo").agg(F.max("base_commit").alias("base_commit")).where(F.coalesce("repo", F.lit("")) != "")
        wanted = wanted.withColumn("commit", F.substring(F.coalesce("base_commit", F.lit("")), 1, 8)).withColumn("embedder", sanitized(F.lit(self.embedder())))
        fields = [F.col("repo").alias("repo_dir"), F.col("base_commit"), *[F.lit(self.spec[f]).alias(f) for f in FIELDS]]
        asked = wanted.withColumn("wanted", F.struct(*fields))
        has = self.meta().select(*_KEYS, F.struct("repo_dir", "base_commit", *FIELDS).alias("meta"))
        reason = indexes.mismatch("meta", "wanted", True, ("repo_dir", "base_commit", *FIELDS))
        known = files.select("repo").distinct().withColumn("known", F.lit(True))
        out = asked.join(has, list(_KEYS), "left").withColumn("reason", reason).join(known, "repo", "left")
        return out.select("repo", "base_commit", "commit", "embedder", "reason", F.coalesce("known", F.lit(False)).alias("known"))

    def build(self, commits: DataFrame, files: DataFrame, policy: str = "auto") -> DataFrame:
        """Builds what doesn't fit; repo, commit, status (disk_hit, rebuilt, failed), reason, chunks.

        files: repo, path, content. A repository without files or commit fails, as does any stale one under the
        policy read_only; the others are built all the same. The report is a written table, its rows as of this build.
        """
        plan = self.plan(commits, files)
        gone = F.when(F.coalesce("base_commit", F.lit("")) == "", "commit_missing").when(~F.col("known"), "no_files").when(F.lit(policy == "read_only") & F.col("reason").isNotNull(), F.col("reason"))
        plan = plan.withColumn("failure", gone)
        plan = plan.withColumn("status", F.when(F.col("failure").isNotNull(), "failed").when(F.col("reason").isNull(), "disk_hit").otherwise("rebuilt"))
        runs = self._read("runs", "run long").agg(F.max("run")).first()[0]
        run = 0 if runs is None else runs + 1
        at = f"{self.root}/runs/run={run}"
        plan.select("repo", "base_commit", "commit", "embedder", "status", F.coalesce("failure", "reason").alias("reason")).write.mode("errorifexists").parquet(at)
        plan = self.spark.read.parquet(at)
        stale = plan.where("status = 'rebuilt'").select("repo", "base_commit", "commit", "embedder")
        if not stale.isEmpty():
            size, overlap = int(self.spec["chunk_size"]), int(self.spec["overlap"])
            cut = chunking.windows(files.join(stale.select("repo", "commit", "embedder"), "repo").select("repo", "commit", "embedder", "path", "content"), "content", size, overlap)
            rows = cut.select(*_KEYS, "path", "start_line", "end_line", F.coalesce(language(F.col("path")), F.lit("unknown")).alias("language"), "text", self.embed(F.col("text")).alias("embedding"))
            # Rows of an index come together where that is few files; a large repository is split again.
            rows.hint("rebalance", "repo").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_KEYS).parquet(f"{self.root}/chunks")
            counts = self.chunks().join(stale.select(*_KEYS), list(_KEYS), "left_semi").groupBy(*_KEYS).agg(F.count("*").alias("chunks"))
            meta = stale.join(counts, list(_KEYS), "left").select(*_KEYS, F.col("repo").alias("repo_dir"), "base_commit", *[F.lit(self.spec[f]).alias(f) for f in FIELDS], F.coalesce("chunks", F.lit(0)).alias("chunks"))
            meta.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_KEYS).parquet(f"{self.root}/meta")
        held = self.meta().select(*_KEYS, "chunks")
        return plan.join(held, list(_KEYS), "left").select("repo", "commit", "status", "reason", F.when(F.col("status") != "failed", F.col("chunks")).alias("chunks"))
