"""Scoring of answers by a pluggable judge: several rounds a question, failures apart from zeros, resumable."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalweave.functions import measures, text
from evalweave.operators.sampling import undone

#: A judge takes question, reference, candidate and round, and answers with text; it may raise.
Judge = Callable[[str, str, str, int], str]


def rounds(records: DataFrame, open_judge: Callable[[], Judge], n: int = 1, done: DataFrame | None = None) -> DataFrame:
    """records and round, answer (null: the call failed), scores (null: it failed or its answer has none).

    records: question_hash, question, reference, candidate, and what is to be kept. Rows without one of these three
    texts, and those whose hash `done` has, are left out before any call. open_judge is called once in each task, so
    that its connection or model serves all rows of the task. A retried task calls again: judges must be repeatable,
    or their answers recorded.
    """

    @F.pandas_udf(T.StringType())
    def ask(frames: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        judge = open_judge()

        def one(question: str, reference: str, candidate: str, round_no: int) -> str | None:
            try:
                return judge(question, reference, candidate, int(round_no))
            except Exception:  # noqa: BLE001  a call that fails, for whatever reason, is a missing answer
                return None

        for columns in frames:
            yield pd.Series([one(*row) for row in zip(*columns, strict=True)], dtype=object)

    given = records
    for c in ("question", "reference", "candidate"):
        given = given.withColumn(c, text.strip(F.coalesce(F.col(c), F.lit("")))).where(F.col(c) != "")
    if done is not None:
        given = undone(given, done, "question_hash")
    asked = given.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(max(1, n)))))
    answered = asked.withColumn("answer", ask("question", "reference", "candidate", "round"))
    return answered.withColumn("scores", measures.parsed_scores(F.col("answer")))


def scored(answered: DataFrame, how: str = "median", weights: dict[str, float] | None = None, threshold: float = 6.0, metric: str = "weighted", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each question with a scored round: the dimensions by median or mean, their sums, and pass.

    answered: from rounds(). rounds_scored tells how many rounds had scores; questions without any have no row.
    """
    f = F.avg if how == "mean" else F.median
    good = answered.where("scores is not null")
    dims = [f(F.col(f"scores.{d}")).cast("double").alias(d) for d in measures.DIMENSIONS]
    out = good.groupBy("question_hash").agg(*dims, F.count("*").alias("rounds_scored"), *[F.max(c).alias(c) for c in keep])
    total = sum((F.col(d) for d in measures.DIMENSIONS[1:]), F.col(measures.DIMENSIONS[0]))
    out = out.withColumn("total_score", total).withColumn("score_avg", total / len(measures.DIMENSIONS)).withColumn("weighted_score", measures.weighted_score(weights))
    return out.withColumn("pass", F.col("weighted_score" if metric == "weighted" else "score_avg") >= threshold)
