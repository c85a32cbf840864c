"""A sink that writes a JSON file for each session: `df.write.format("trajectories").save(path)`.

Rows: instance_id, exit_status, submission, instance_cost, api_calls, extra (JSON object, put into info), messages.
Each task writes below a staging folder beside the path and moves whole files into place there; the driver's commit
moves them to the path (a single rename where the path is new), and an abort removes the staging folder. The path is
a folder that all executors share, given as a plain path or file:// URL.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Name and version of the format.
FORMAT = "trajectory-1"
SUFFIX = ".traj.json"
SCHEMA = "instance_id string, exit_status string, submission string, instance_cost double, api_calls long, extra string, messages array<struct<role:string,content:string>>"


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


def document(row: dict) -> dict:
    """The content of a session's file; keys of extra win over the others of info."""
    info = {"exit_status": row["exit_status"], "submission": row["submission"], "model_stats": {"instance_cost": row["instance_cost"] or 0.0, "api_calls": row["api_calls"] or 0}}
    return {"instance_id": row["instance_id"], "info": info | json.loads(row["extra"] or "{}"), "messages": row["messages"] or [], "trajectory_format": FORMAT}


def file_name(instance_id: str) -> str:
    """Letters, digits and ._- stay; any other byte is written in hex, so that different ids have different names."""
    return "".join(chr(b) if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "._-") else f"%{b:02X}" for b in instance_id.encode()) + SUFFIX


class TrajectoryWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path = path.removeprefix("file://").removeprefix("file:").rstrip("/")
        self.overwrite = overwrite
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        attempt, names = f"{self.staging}/attempt-{uuid.uuid4().hex}", []
        os.makedirs(attempt)
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if row["instance_id"] is None:
                        raise ValueError("a session without an instance_id can't be written")
                    name = file_name(row["instance_id"])
                    with open(f"{attempt}/{name}", "w", encoding="utf-8") as out:
                        json.dump(document(row), out, indent=2, ensure_ascii=False)
                    names.append(name)
            for name in names:
                os.replace(f"{attempt}/{name}", f"{self.staging}/{name}")
        finally:
            shutil.rmtree(attempt, ignore_errors=True)
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        names = [n for m in messages if m is not None for n in m.names]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("two sessions have the same instance_id")
        os.makedirs(self.staging, exist_ok=True)
        if self.overwrite and os.path.isdir(self.path):
            old = f"{self.staging}.old"
            os.rename(self.path, old)
            os.rename(self.staging, self.path)
            shutil.rmtree(old)
        elif not os.path.isdir(self.path):
            os.rename(self.staging, self.path)
        else:
            for name in names:
                os.replace(f"{self.staging}/{name}", f"{self.path}/{name}")
            shutil.rmtree(self.staging)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class TrajectorySink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trajectories"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> TrajectoryWriter:
        return TrajectoryWriter(self.options["path"], overwrite)


def sessions(messages: DataFrame, infos: DataFrame, key: str, pos: str, role: str, content: str) -> DataFrame:
    """The rows of the sink: messages in order, a session a row. infos: the key and any of the other columns, one row each."""
    said = F.transform(F.array_sort(F.collect_list(F.struct(pos, F.col(role).alias("role"), F.col(content).alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    grouped = messages.groupBy(F.col(key).cast("string").alias("instance_id")).agg(said.alias("messages"))
    known = infos.withColumn("instance_id", F.col(key).cast("string")).drop(key) if key != "instance_id" else infos
    both = grouped.join(known, "instance_id", "full").where("instance_id is not null")
    wanted = {f.name: f.dataType for f in StructType.fromDDL(SCHEMA).fields}
    return both.select(*[(F.col(c) if c in both.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()])


def save(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes sessions() to a file each."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(TrajectorySink)
    rows.write.format("trajectories").mode(mode).option("path", path).save()
