"""Finds the first bad record of each JSON file: kind, line, error, and a report.

Files of lines are read in splits, so a large file is read by many tasks. Each split gives one row, the number of its
lines and its first bad one; sums of the lines before a split, over these few rows, give the line in the file. Only
lines that Spark's parser refuses go to Python, whose parser has the last word (it takes NaN and repeated keys).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SPLIT = "path string, start long, lines long, at long, error_type string, error string"


def _fault(raw: bytes) -> tuple[str, str, int] | None:
    """(kind, message, line inside the text) of a text that is no JSON; None for JSON."""
    try:
        json.loads(raw.decode())
    except UnicodeDecodeError as e:
        return "decode", str(e), 0
    except json.JSONDecodeError as e:
        return "json", e.msg, e.lineno
    except RecursionError:
        return "json", "nested too deeply", 1
    return None


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of lines of one split: its lines and the first bad one, counted from 0."""

    def row(key, n, bad):
        return pa.record_batch([pa.array([x], t) for x, t in zip((*key, n, *(bad or (None, None, None))), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["path", "start", "lines", "at", "error_type", "error"])

    now, n, bad = None, 0, None
    for batch in batches:
        for path, start, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (path, start) != now:
                if now is not None:
                    yield row(now, n, bad)
                now, n, bad = (path, start), 0, None
            if raw is not None and bad is None and (found := _fault(raw)):
                bad = (n, found[0], found[1])
            n += 1
    if now is not None:
        yield row(now, n, bad)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(path, *found) for path, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (found := _fault(raw))]
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array([x or None for x in cols[3]], pa.int64()), pa.array(cols[2], pa.string())], ["path", "error_type", "line", "error"])


def _glob(extensions: tuple[str, ...]) -> str:
    return "*{" + ",".join(e if e.startswith(".") else f".{e}" for e in extensions) + "}"


def bad_records(spark: SparkSession, root: str, lines: tuple[str, ...] = (".jsonl",), whole: tuple[str, ...] = (".json",)) -> DataFrame:
    """path, error_type (decode or json), line, error: the first bad record of each file below root.

    Files with an extension of `lines` hold a record a line, blank lines aside; those of `whole` are one document, for
    which a decode error has no line. Files without a bad record have no row, nor have files without a byte, which Spark
    doesn't read.
    """
    parts = []
    if lines:
        rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", _glob(lines)).option("lineSep", "\n").text(root)
        blank = F.col("value").rlike(r"(?U)^[\s\x1c-\x1f]*$")
        fine = F.is_valid_utf8("value") & (blank | F.try_parse_json("value").isNotNull())
        suspect = F.when(~F.coalesce(fine, F.lit(False)), F.col("value").cast("binary"))
        each = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), suspect.alias("raw")).mapInArrow(_by_split, _SPLIT)
        before = F.coalesce(F.sum("lines").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = each.withColumn("line", before + F.col("at") + 1).where("at is not null")
        first = placed.groupBy("path").agg(F.min(F.struct("line", "error_type", "error")).alias("b"))
        parts.append(first.select("path", "b.error_type", "b.line", "b.error"))
    if whole:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _glob(whole)).load(root)
        parts.append(files.select("path", "content").mapInArrow(_whole, "path string, error_type string, line long, error string"))
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def bad_report(spark: SparkSession, root: str, kind: str = "text", stop_at_first: bool = False, **extensions: tuple[str, ...]) -> tuple[str, int, int]:
    """(report, files that hold a byte, bad files). text: a line for each bad file by path; json: a list. The driver holds bad files only."""
    asked = extensions.get("lines", (".jsonl",)) + extensions.get("whole", (".json",))
    total = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _glob(asked)).load(root).select("path").count()
    found = bad_records(spark, root, **extensions).orderBy("path")
    bad = [r.asDict() for r in (found.limit(1) if stop_at_first else found).collect()]
    if kind == "json":
        return json.dumps(bad, indent=2), total, len(bad)
    return "\n".join(f"BAD {b['error_type']} {b['path']}{':' + str(b['line']) if b['line'] else ''} {b['error']}" for b in bad), total, len(bad)
