"""Which files a session has read: from its commands, and from the output of those that search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions import paths, text
from evalweave.operators.commands import arguments_of

MOST = 50
#: Fixed value: stands for all that is beyond the most.
MARK = "<<TRUNCATED>>"


def reads(events: DataFrame, files: DataFrame, session: str, seq: str, command: str, output: str, roots: tuple[str, ...] = (), on: tuple[str, ...] = ()) -> DataFrame:
    """session, seq, pos, path: the existing files that each command reads, its arguments first, then its output's lines.

    Output counts if a command of the line searches; a line's path ends at its first colon. files: path and the `on`
    columns (such as the repository), which events have too. Works on streams. Null commands and outputs read nothing.
    """
    given = arguments_of(F.col(command))
    shown = F.when(F.col("c.searches"), text.output_paths(F.coalesce(F.col(output), F.lit("")), whole_lines=True)).otherwise(F.array().cast("array<string>"))
    parted = events.withColumn("c", given).select(session, seq, *on, F.posexplode(F.concat("c.paths", shown)).alias("pos", "raw"))
    named = parted.withColumn("path", paths.inside(F.col("raw"), *roots)).where("path is not null")
    return named.join(files.select("path", *on).distinct(), ["path", *on], "left_semi").select(session, seq, "pos", "path")


def tracked(found: DataFrame, session: str, seq: str, most: int = MOST) -> DataFrame:
    """session, seq, place, path: each file of a session where it was first read; beyond `most` a single mark.

    A session's rows are pre-aggregated to its distinct files, and no more than most + 1 of them are kept.
    """
    firsts = found.groupBy(session, "path").agg(F.min(F.struct(seq, "pos")).alias("at"))
    place = F.row_number().over(Window.partitionBy(session).orderBy("at"))
    kept = firsts.withColumn("place", place).where(F.col("place") <= most + 1)
    return kept.select(session, F.col(f"at.{seq}").alias(seq), "place", F.when(F.col("place") > most, MARK).otherwise(F.col("path")).alias("path"))


def merged(candidates: DataFrame, read: DataFrame, session: str, most: int = MOST) -> DataFrame:
    """session, paths: a session's tool candidates, then its files read, once each, capped with the mark.

    candidates: session, place, path. read: from tracked(); its mark is none of the paths.
    """
    both = candidates.select(session, F.lit(0).alias("kind"), "place", "path").unionByName(read.where(F.col("path") != MARK).select(session, F.lit(1).alias("kind"), "place", "path"))
    firsts = both.where(F.coalesce("path", F.lit("")) != "").groupBy(session, "path").agg(F.min(F.struct("kind", "place")).alias("at"))
    kept = firsts.withColumn("n", F.row_number().over(Window.partitionBy(session).orderBy("at", "path"))).where(F.col("n") <= most + 1)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "path"))), lambda x: x["path"])
    return kept.groupBy(session).agg(text.capped(listed, most, MARK).alias("paths"))
