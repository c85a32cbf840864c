"""Readers and writers: JSON lines in three moods, bad records, catalogs by path, source trees, reports."""

from __future__ import annotations

import json
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalweave.operators.sampling import undone, upserted


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """Strict: any bad line is an error. Otherwise bad lines are dropped. Blank lines never count."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def bad_records(spark: SparkSession, path: str) -> DataFrame:
    """The first bad line of each JSON-lines file: path, line (from 1), text."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
    bad = rows.where((F.trim(F.regexp_replace("text", r"\s", " ")) != "") & F.try_parse_json("text").isNull())
    return bad.groupBy("path").agg(F.min(F.struct((F.col("line") + 1).alias("line"), "text")).alias("b")).select("path", "b.*")


def answers_scope(path: str) -> tuple[str, tuple[str, ...]]:
    """(answers root, scope) of a results root, its `answers` folder, or a folder up to three levels below that.

    A path that names `answers` is split there, at its last one; any other is taken for a results root.
    """
    parts = path.rstrip("/").split("/")
    if "answers" not in parts:
        return f"{path.rstrip('/')}/answers", ()
    at = len(parts) - 1 - parts[::-1].index("answers")
    scope = tuple(parts[at + 1 :])
    if len(scope) > 3:
        raise ValueError(f"too deep below answers/<model>/<method>/<run_id>: {path}")
    return "/".join(parts[: at + 1]), scope


def catalog(spark: SparkSession, root: str, scope: tuple[str, ...] = (), files: str = "*.jsonl") -> DataFrame:
    """Answer sets below root/<model>/<method>/<run_id>/*.jsonl, once each.

    scope: model, method and run_id, as far as they are given; only their folders are listed. A scope that isn't there
    has no rows. Files are never opened: their paths are in the listing.
    """
    at = "/".join([root.rstrip("/"), *scope, *["*"] * (3 - len(scope)), files])
    try:
        found = spark.read.format("binaryFile").load(at).select("path")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "model string, method string, run_id string, repo string")
    part = lambda i: F.element_at(F.split("path", "/"), i)
    return found.select(part(-4).alias("model"), part(-3).alias("method"), part(-2).alias("run_id"), F.regexp_replace(part(-1), r"\.jsonl$", "").alias("repo")).distinct()


def source_tree(spark: SparkSession, root: str, most: int = 512 << 10, tracked: DataFrame | None = None) -> DataFrame:
    """path (relative) and content of files up to a size; larger ones are skipped, broken UTF-8 is replaced."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= most)
    base = root.split("://")[-1].rstrip("/").removeprefix("file:")
    df = df.select(F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), f"^{base}/", "").alias("path"), F.decode("content", "UTF-8").alias("content"))
    return df if tracked is None else df.join(tracked.select("path"), "path", "left_semi")


TRAJECTORY = "instance_id string, messages array<struct<role:string,content:string,timestamp:double>>"


def trajectories(spark: SparkSession, path: str) -> DataFrame:
    """instance_id, pos, role, content of messages; a file holds an object with messages, or the bare list."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    kind = TRAJECTORY.split("messages ")[1]
    messages = F.coalesce(F.from_json("value", TRAJECTORY)["messages"], F.from_json("value", kind))
    own = F.coalesce(F.get_json_object("value", "$.instance_id"), F.regexp_replace("file", r"\.traj\.json$", ""))
    return raw.select(own.alias("instance_id"), F.posexplode(messages).alias("pos", "m")).select("instance_id", "pos", "m.*")


def summary_instances(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a run summary's `instances` that have an id."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"instances array<struct<{schema}>>").alias("s"))
    return raw.select(F.inline("s.instances")).where(F.coalesce("instance_id", F.lit("")) != "")


def merged_config(*layers: dict) -> dict:
    """Later layers win, key by key, nulls included."""
    out: dict[str, Any] = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_jsonl(df: DataFrame, path: str, resume: bool = False) -> None:
    df.write.mode("append" if resume else "overwrite").json(path)


def resume_jsonl(df: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows whose key the output doesn't have yet, and returns them as read from the files they went to."""
    spark = df.sparkSession
    try:
        done = spark.read.schema(df.schema).json(path)
        before, fresh = set(done.inputFiles()), undone(df, done, key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        before, fresh = set(), df
    append_jsonl(fresh, path)
    new = [f for f in spark.read.schema(df.schema).json(path).inputFiles() if f not in before]
    return spark.read.schema(df.schema).json(new) if new else df.limit(0)


def put(table: DataFrame, changes: DataFrame, key: str, path: str) -> None:
    """Keyed upserts and deletes, written as a new version of the table."""
    upserted(table, changes, key).write.mode("overwrite").parquet(path)


def write_wide_csv(df: DataFrame, path: str, base: list[str]) -> bool:
    """Base columns, then all others by name; arrays as JSON. Nothing is written for an empty table."""
    if df.isEmpty():
        return False
    order = [c for c in base if c in df.columns] + sorted(c for c in df.columns if c not in base)
    cells = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, T.ArrayType | T.StructType | T.MapType) else F.col(c) for c in order]
    df.select(*cells).write.mode("overwrite").option("header", True).csv(path)
    return True


def summary_json(meta: dict, stats: DataFrame, statuses: DataFrame) -> str:
    """A run summary from one-row statistics and counts by status."""
    row = json.loads(stats.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0])
    return json.dumps(meta | {"stats": row, "counts": {r[0]: r[1] for r in statuses.collect()}}, indent=2)


def markdown_report(title: str, overall: dict[str, Any], groups: list[tuple], dimensions: dict[str, float]) -> str:
    """Dashboard, a table by category in label order, and dimension means; four decimals."""
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", "| Measure | Value |", "| --- | --- |", *[f"| {k} | {show(v)} |" for k, v in overall.items()], ""]
    lines += ["| Category | Count | Pass rate | Mean score | Mean weighted |", "| --- | --- | --- | --- | --- |"]
    lines += ["| " + " | ".join(map(show, g)) + " |" for g in sorted(groups)] or ["| (none) | 0 | 0.0000 | 0.0000 | 0.0000 |"]
    return "\n".join([*lines, "", "| Dimension | Mean |", "| --- | --- |", *[f"| {k} | {show(v)} |" for k, v in dimensions.items()], ""])


def status_report(lists: DataFrame) -> str:
    """status -> ids as YAML."""
    out = []
    for status, ids in lists.orderBy(lists.columns[0]).collect():
        out += [f"{status}:", *[f"  - {i}" for i in ids]]
    return "\n".join(out) + "\n"
