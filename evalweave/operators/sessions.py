"""Ordered sessions as windows: steps, next rows, streaks, repeats, running sums, and the sequential gates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions.text import single_action


def next_of_role(role: str, value: str, key: str, pos: str, wanted: str = "user") -> Column:
    """The next value of a role after each row of its session."""
    ahead = Window.partitionBy(key).orderBy(pos).rowsBetween(1, Window.unboundedFollowing)
    return F.first(F.when(F.col(role) == wanted, F.col(value)), ignorenulls=True).over(ahead)


def last_of_role(messages: DataFrame, key: str, role: str, value: str, pos: str, wanted: str = "assistant") -> DataFrame:
    return messages.groupBy(key).agg(F.max_by(F.when(F.col(role) == wanted, F.col(value)), F.when(F.col(role) == wanted, F.col(pos))).alias("last"))


def steps(messages: DataFrame, key: str, pos: str, role: str, closing: str = "user") -> DataFrame:
    """Adds step: a step ends with each message of the closing role; what follows the last is a step of its own."""
    before = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("step", F.coalesce(F.sum((F.col(role) == closing).cast("int")).over(before), F.lit(0)))


def first_seen(df: DataFrame, value: str, key: str, pos: str) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key, value).orderBy(pos))).where("__n = 1").drop("__n")


def streaks(events: DataFrame, key: str, order: list[str], failed: Column, fires: int = 2) -> DataFrame:
    """Adds streak (failures in a row up to here) and fired (streak has reached `fires`)."""
    w = Window.partitionBy(key).orderBy(*order)
    island = F.sum((~failed).cast("int")).over(w)
    df = events.withColumn("__island", island).withColumn("__bad", failed.cast("int"))
    df = df.withColumn("streak", F.sum("__bad").over(Window.partitionBy(key, "__island").orderBy(*order)))
    return df.withColumn("fired", F.col("streak") >= fires).drop("__island", "__bad")


def repeats(events: DataFrame, key: str, order: list[str], command: str) -> DataFrame:
    """Adds repeat: this command and the two before it are the same."""
    w = Window.partitionBy(key).orderBy(*order)
    same = (F.col(command) == F.lag(command, 1).over(w)) & (F.col(command) == F.lag(command, 2).over(w))
    return events.withColumn("repeat", F.coalesce(same, F.lit(False)))


def no_progress(events: DataFrame, key: str, order: list[str], value: str, threshold: int = 4, every_n: int = 3) -> DataFrame:
    """Adds idle (rows since a value was first seen in the session) and stalled."""
    seen = events.withColumn("__new", (F.row_number().over(Window.partitionBy(key, value).orderBy(*order)) == 1) & F.col(value).isNotNull())
    w = Window.partitionBy(key).orderBy(*order)
    seen = seen.withColumn("__island", F.sum(F.col("__new").cast("int")).over(w))
    seen = seen.withColumn("idle", F.sum((~F.col("__new")).cast("int")).over(Window.partitionBy(key, "__island").orderBy(*order)))
    return seen.withColumn("stalled", F.col("idle") >= max(threshold, every_n + 1)).drop("__new", "__island")


def running_tokens(calls: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Running totals: an attempt's estimate counts until its actual usage is there. calls: estimate, actual."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumn("total_tokens", F.sum(F.coalesce("actual", "estimate", F.lit(0))).over(w)).withColumn("calls", F.count("*").over(w))


def tool_calls(messages: DataFrame, key: str = "instance_id", pos: str = "pos", role: str = "role", content: str = "content") -> DataFrame:
    """Executed tool calls: assistant messages of one action `@tool ...` whose next user message has a tool result."""
    df = messages.withColumn("answer", next_of_role(role, content, key, pos)).withColumn("action", single_action(F.col(content)))
    return df.where((F.col(role) == "assistant") & F.startswith("action", F.lit("@tool ")) & F.contains(F.coalesce("answer", F.lit("")), F.lit("<tool_result>"))).select(key, pos, "action")


class Emission:
    """Sequential limiter of feedback: errors before repeats before no progress, spaced, and capped in number."""

    def __init__(self, every_n: int = 3, most: int = 3):
        self.every_n, self.most, self.count, self.last, self.rounds = every_n, most, 0, 0, 0

    def step(self, error: bool, repeat: bool, idle: bool) -> str | None:
        self.count += 1
        reason = "error_streak" if error else "repeat_command" if repeat else "no_progress" if idle else None
        if reason is None or self.rounds >= self.most or self.count - self.last < self.every_n:
            return None
        self.rounds, self.last = self.rounds + 1, self.count
        return reason


def feedback(signals: DataFrame, key: str, order: str, every_n: int = 3, most: int = 3) -> DataFrame:
    """key, order, reason of each emitted feedback. What is emitted feeds back into what may be, so sessions run in
    order, streamed from sorted partitions: no session is gathered in memory. signals: fired, repeat, stalled."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), None
        for f in frames:
            out = []
            for k, o, fired, repeat, stalled in zip(f[key], f[order], f["fired"], f["repeat"], f["stalled"], strict=True):
                if k != at:
                    at, state = k, Emission(every_n, most)
                if reason := state.step(fired, repeat, stalled):
                    out.append((k, o, reason))
            yield pd.DataFrame(out, columns=[key, order, "reason"])

    types = {n: signals.schema[n].dataType.simpleString() for n in (key, order)}
    sorted_ = signals.select(key, order, "fired", "repeat", "stalled").repartition(key).sortWithinPartitions(key, order)
    return sorted_.mapInPandas(run, f"{key} {types[key]}, {order} {types[order]}, reason string")


class Gate:
    """Verification and submission gates of one session.

    A search sets the ranked candidates and forgets what was verified; a read of a candidate verifies it and opens
    the gate; listing symbols inspects a file but opens nothing. A submission is blocked, in this order, without a
    search, without a verified candidate, with fewer than two inspected of several candidates, with hints that were
    never observed, or with hints outside the scope. A session is fixated while the first is the only inspected one of
    several candidates, and stays `ever` fixated. Blocks are counted; three in a row switch strict mode on.
    """

    def __init__(self, strict_after: int = 3):
        self.candidates, self.verified, self.inspected = [], set(), set()
        self.searched = self.strict = self.fixated = self.ever = False
        self.blocked = self.in_a_row = 0
        self.strict_after = strict_after

    def was_read(self, hint: str) -> bool:
        """A hint names an inspected file: equal to it, its end if the hint has a slash, or a base name that only one of them has."""
        name = hint.rpartition("/")[2]
        same = hint in self.inspected or ("/" in hint and any(p.endswith(hint) for p in self.inspected))
        return same or (name != "" and sum(p.rpartition("/")[2] == name for p in self.inspected) == 1)

    def _refresh(self) -> None:
        seen = [c for c in dict.fromkeys(self.candidates) if self.was_read(c)]
        self.enough = len(self.candidates) < 2 or len(seen) >= 2
        self.fixated = len(self.candidates) > 1 and seen == self.candidates[:1]
        self.ever = self.ever or self.fixated

    def step(self, kind: str, paths: list[str], scope: list[str] | None = None) -> str:
        if kind == "search":
            self.searched, self.candidates, self.verified = True, list(paths), set()
            self._refresh()
            return "searched"
        if kind == "list":
            self.inspected.update(paths)
            self._refresh()
            return "listed"
        if kind == "read":
            self.inspected.update(paths)
            self.verified.update(p for p in paths if p in self.candidates)
            self._refresh()
            return "opened" if self.verified else "read"
        reason = None
        if not self.searched:
            reason = "no_search"
        elif not self.verified:
            reason = "not_verified"
        elif not self.enough:
            reason = "one_candidate"
        elif [p for p in paths if not self.was_read(p)]:
            reason = "unread_hint"
        elif scope and [p for p in paths if not in_scope(p, scope)]:
            reason = "out_of_scope"
        if reason is None:
            self.in_a_row = 0
            return "accepted"
        self.blocked, self.in_a_row = self.blocked + 1, self.in_a_row + 1
        self.strict = self.strict or self.in_a_row >= self.strict_after
        return reason


def in_scope(hint: str, scope: list[str]) -> bool:
    """Equal to a path of the scope, the end of one or the other way round, or a base name that the scope has once."""
    name = hint.rpartition("/")[2]
    near = any(s == hint or s.endswith(hint) or hint.endswith(s) for s in set(scope) if s)
    return hint != "" and (near or sum(s.rpartition("/")[2] == name for s in set(scope)) == 1)


def gated(events: DataFrame, key: str, order: str) -> DataFrame:
    """key, order, outcome, blocked, strict, fixated, ever_fixated for each event of each session.

    events: kind, paths, and scope where submissions have one (null or empty: any).
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, gate = object(), None
        for f in frames:
            out = []
            for k, o, kind, paths, scope in zip(f[key], f[order], f["kind"], f["paths"], f["scope"], strict=True):
                if k != at:
                    at, gate = k, Gate()
                outcome = gate.step(kind, [] if paths is None else list(paths), [] if scope is None else list(scope))
                out.append((k, o, outcome, gate.blocked, gate.strict, gate.fixated, gate.ever))
            yield pd.DataFrame(out, columns=[key, order, "outcome", "blocked", "strict", "fixated", "ever_fixated"])

    types = {n: events.schema[n].dataType.simpleString() for n in (key, order)}
    scope = F.col("scope") if "scope" in events.columns else F.lit(None).cast("array<string>").alias("scope")
    sorted_ = events.select(key, order, "kind", "paths", scope).repartition(key).sortWithinPartitions(key, order)
    return sorted_.mapInPandas(run, f"{key} {types[key]}, {order} {types[order]}, outcome string, blocked long, strict boolean, fixated boolean, ever_fixated boolean")
