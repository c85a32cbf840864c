"""The read tracker as a stream: what a session has read is kept as state, of a bounded size and for a limited time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evalweave.operators.tracking import MARK, MOST


def tracked(found: DataFrame, session: str, seq: str, most: int = MOST, keep_ms: int | None = None) -> DataFrame:
    """As operators.tracking.tracked(), row by row as files are first read. found: a stream from reads().

    State is a session's files, `most` at most, and whether the mark is out; a session that is silent for keep_ms is
    forgotten, and what it reads later counts as new. Within a trigger rows are put in order; across triggers they
    must arrive in order.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = [session, seq, "place", "path"]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=names)
            return
        seen, full = (list(state.get[0]), state.get[1]) if state.exists else ([], False)
        known, out = set(seen), []
        for frame in [] if full else [pd.concat(list(frames)).sort_values([seq, "pos"])]:
            for at, path in zip(frame[seq], frame["path"], strict=True):
                if path in known or full:
                    continue
                full = len(seen) >= most
                if not full:
                    seen.append(path)
                    known.add(path)
                out.append((key[0], at, len(seen) + full, MARK if full else path))
        state.update((seen, full))
        if keep_ms is not None:
            state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame(out, columns=names)

    kinds = {n: found.schema[n].dataType.simpleString() for n in (session, seq)}
    timeout = GroupStateTimeout.NoTimeout if keep_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return found.groupBy(session).applyInPandasWithState(run, f"{session} {kinds[session]}, {seq} {kinds[seq]}, place int, path string", "seen array<string>, full boolean", "append", timeout)
