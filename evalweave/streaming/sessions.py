"""Streaming forms of the session operators, on files that arrive in a folder."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evalweave.operators.sessions import Emission


def arrivals(spark: SparkSession, folder: str, schema: Any, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def status_counts(stream: DataFrame, status: str) -> DataFrame:
    """Live counts by status, for update or complete mode."""
    return stream.groupBy(F.coalesce(F.nullif(F.col(status), F.lit("")), F.lit("Unknown")).alias(status)).count()


def event_windows(stream: DataFrame, ts: str, late: str, width: str, *keys: str) -> DataFrame:
    """Counts by event-time window, late rows dropped beyond the watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n")).select("window.start", *keys, "n")


def session_signals(stream: DataFrame, key: str, order: str, failed: str, command: str, tokens: str, fires: int = 2) -> DataFrame:
    """For each event: failure streak, repeat of three, running tokens and emitted feedback, from state kept by session.

    State is a few numbers and the last two commands. Within a trigger a session's rows are put in order; across
    triggers they must arrive in order.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, total, one, two, count, last, rounds = state.get if state.exists else (0, 0.0, "", "", 0, 0, 0)
        emit = Emission()
        emit.count, emit.last, emit.rounds = count, last, rounds
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for o, bad, cmd, n in zip(rows[order], rows[failed], rows[command], rows[tokens], strict=True):
            streak = streak + 1 if bad else 0
            repeat = cmd == one == two
            one, two, total = cmd, one, total + float(n)
            out.append((k[0], o, streak, bool(repeat), total, emit.step(streak >= fires, repeat, False)))
        state.update((streak, total, one or "", two or "", emit.count, emit.last, emit.rounds))
        yield pd.DataFrame(out, columns=[key, order, "streak", "repeat", "total_tokens", "feedback"])

    kinds = {n: stream.schema[n].dataType.simpleString() for n in (key, order)}
    return stream.groupBy(key).applyInPandasWithState(
        run,
        f"{key} {kinds[key]}, {order} {kinds[order]}, streak long, repeat boolean, total_tokens double, feedback string",
        "streak long, total double, one string, two string, count long, last long, rounds long",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def drained(df: DataFrame, checkpoint: str, out: str, mode: str = "append") -> StreamingQuery:
    """Runs a stream over what has arrived and stops; a restart from the checkpoint goes on where it ended."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = q.format("parquet").start(out) if mode == "append" else q.foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return q
