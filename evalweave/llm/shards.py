"""Immutable shards under versioned manifests, compacted by size tiers.

Arrivals are appended as small shards. Shards of one size tier are merged, once there are enough of them, into
files as large as the target allows; a merged file belongs to a higher tier, so nothing is rewritten more often
than there are tiers. A version is a manifest file that lists its shards; it is committed by one rename that
fails if the version exists, so readers see a whole version or the one before, and of two writers one must start
again. Compaction deletes nothing: versions before it stay readable until vacuum() is told to let them go.

Rows come back as they were, repeated ones as often, with nulls, texts of any length and all columns, whatever
their names. An arrival may bring new columns: the store has them from then on, null for older rows. A column of
another type is an error, and nothing is written. Appending an empty table commits a version without new shards.
All on DataFrame reads and writes; merging needs no shuffle.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BASE, FANOUT, TARGET = 4 << 20, 4, 128 << 20


def widened(known: T.StructType | None, new: T.StructType) -> T.StructType:
    """The known columns, all nullable, and the new ones after them."""
    fields = {f.name: f for f in (known.fields if known else [])}
    for f in new.fields:
        if f.name in fields and fields[f.name].dataType != f.dataType:
            raise ValueError(f"column {f.name} is {fields[f.name].dataType.simpleString()} in the store, not {f.dataType.simpleString()}")
        fields.setdefault(f.name, T.StructField(f.name, f.dataType, True))
    return T.StructType(list(fields.values()))


class ShardStore:
    """Shards and manifests under one root folder (a URI)."""

    def __init__(self, spark: SparkSession, root: str, base: int = BASE, fanout: int = FANOUT, target: int = TARGET):
        self.spark, self.root, self.base, self.fanout, self.target = spark, root.rstrip("/"), base, fanout, target
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(self.root).getFileSystem(self.conf)
        for folder in ("manifests", "pins", "shards"):
            self.fs.mkdirs(self._path(f"{self.root}/{folder}"))

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def _numbers(self, folder: str) -> list[int]:
        names = (s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.root}/{folder}")))
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def versions(self) -> list[int]:
        return self._numbers("manifests")

    def manifest(self, version: int | None = None) -> dict:
        """{version, time, schema, shards: [{path, bytes}]}; the latest by default."""
        known = self.versions()
        if not known:
            return {"version": 0, "time": 0, "schema": None, "shards": []}
        name = f"{self.root}/manifests/v{known[-1] if version is None else version:010d}.json"
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, before: dict, shards: list[dict], schema: str) -> dict:
        new = {"version": before["version"] + 1, "time": int(time.time()), "schema": schema, "shards": sorted(shards, key=lambda s: s["path"])}
        aside = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        stream = self.fs.create(aside, False)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else self.fs.getUri(), self.conf)
        files.rename(aside, self._path(f"{self.root}/manifests/v{new['version']:010d}.json"), options)
        return new

    def _write(self, df: DataFrame, rows: int = 0) -> list[dict]:
        """Writes a folder of shards of its own and lists them; files without rows are left out."""
        name = f"shards/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows).parquet(f"{self.root}/{name}")
        if not df.schema.fields:
            return []
        found = [s for s in self.fs.listStatus(self._path(f"{self.root}/{name}")) if s.getPath().getName().startswith("part-")]
        # A task without rows may leave a file that has a footer only; its size is that of the smallest such file.
        return [{"path": f"{name}/{s.getPath().getName()}", "bytes": s.getLen()} for s in found if s.getLen() > self._footer(df.schema)]

    def _footer(self, schema: T.StructType) -> int:
        """Bytes of a file of this schema without rows."""
        key = schema.json()
        if getattr(self, "_known", (None, 0))[0] != key:
            where = f"{self.root}/shards/.empty-{uuid.uuid4().hex}"
            self.spark.createDataFrame([], schema).coalesce(1).write.parquet(where)
            sizes = [s.getLen() for s in self.fs.listStatus(self._path(where)) if s.getPath().getName().startswith("part-")]
            self.fs.delete(self._path(where), True)
            self._known = (key, max(sizes, default=0))
        return self._known[1]

    def append(self, df: DataFrame, rows: int = 0) -> dict:
        """Adds an arrival; rows: the most in a shard (0: no limit)."""
        before = self.manifest()
        schema = widened(T.StructType.fromJson(json.loads(before["schema"])) if before["schema"] else None, df.schema)
        return self._commit(before, before["shards"] + self._write(df, rows), schema.json())

    def _scan(self, manifest: dict, shards: list[dict]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s['path']}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self._scan(m, m["shards"])

    def tier(self, size: int) -> int:
        """0 up to `base` bytes, one more for each factor of `fanout`."""
        return max(0, math.floor(math.log(size / self.base, self.fanout)) + 1) if size > self.base else 0

    def compact(self) -> dict:
        """Merges tier by tier, smallest first; a version for each merge."""
        for t in range(self.tier(self.target) + 1):
            now = self.manifest()
            alike = [s for s in now["shards"] if s["bytes"] < self.target and self.tier(s["bytes"]) == t]
            if len(alike) < self.fanout:
                continue
            # coalesce() puts neighbouring scan partitions into one task: a file each, without a shuffle.
            files = -(-sum(s["bytes"] for s in alike) // self.target)
            merged = self._write(self._scan(now, alike).coalesce(files))
            gone = {s["path"] for s in alike}
            self._commit(now, [s for s in now["shards"] if s["path"] not in gone] + merged, now["schema"])
        return self.manifest()

    def pin(self, version: int, held: bool = True) -> None:
        """A pinned version is kept by vacuum()."""
        at = self._path(f"{self.root}/pins/v{version:010d}.json")
        if held:
            self.fs.create(at, True).close()
        else:
            self.fs.delete(at, False)

    def vacuum(self, keep: int = 1, seconds: int = 0) -> None:
        """Deletes versions and the shards that only they list, but the last `keep`, those pinned and those
        committed within so many seconds. Then sweep() for as many seconds.

        Manifests go first: a reader never sees a version whose shards are gone, and what a crash leaves between
        the two steps is swept by the next call.
        """
        held, now = set(self._numbers("pins")), time.time()
        for v in self.versions()[:-keep]:
            if v not in held and self.manifest(v)["time"] <= now - seconds:
                self.fs.delete(self._path(f"{self.root}/manifests/v{v:010d}.json"), False)
        self.sweep(seconds)

    def sweep(self, seconds: int) -> None:
        """Deletes files that no version lists and that are older than so many seconds: what failed writes left.
        The age must be longer than any write takes, as a running one has not committed its files yet."""
        listed = {s["path"] for v in self.versions() for s in self.manifest(v)["shards"]}
        limit = (time.time() - seconds) * 1000
        for folder in self.fs.listStatus(self._path(f"{self.root}/shards")):
            name = folder.getPath().getName()
            files = [(f"shards/{name}/{s.getPath().getName()}", s) for s in self.fs.listStatus(folder.getPath())]
            if any(p in listed for p, _ in files):
                files = [(p, s) for p, s in files if p not in listed and s.getModificationTime() <= limit]
                for _, s in files:
                    self.fs.delete(s.getPath(), True)
            elif all(s.getModificationTime() <= limit for _, s in [("", folder), *files]):
                self.fs.delete(folder.getPath(), True)
