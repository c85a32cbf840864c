"""Run-level and grouped statistics as single-pass conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.measures import DIMENSIONS, accuracy, mean_or_zero, number, percentile, ratio, share

COUNTED = ("steps", "trace_tokens", "billed_tokens")


def with_columns(runs: DataFrame, names: dict[str, str]) -> DataFrame:
    """runs, with nulls for measures that no row has."""
    missing = [F.lit(None).cast(t).alias(n) for n, t in names.items() if n not in runs.columns]
    return runs.select("*", *missing)


def _recall(prefix: str, k: str, alias: str | None = None) -> Column:
    at = "all" if k == "all" else f"at_{k}"
    keys = [F.col(f"{prefix}_recall_{at}")] + ([F.col(f"{alias}_recall_{at}")] if alias else [])
    return number(*keys)


def run_schema() -> dict[str, str]:
    out = {"exit_status": "string", "correct": "boolean", "cost_usd": "double", "submitted_function_count": "int", "submitted_file_hint_count": "int", "submitted_qualified_function_ratio": "double"}
    out |= dict.fromkeys(COUNTED, "long") | dict.fromkeys(("function_hit_any", "entity_hit_any"), "boolean")
    out |= {f"{p}_recall_{a}": "double" for p in ("file", "function", "entity", "edit_function", "added_function") for a in ("at_1", "at_5", "at_10", "all")}
    return out | dict.fromkeys(("gt_file_count_all", "gt_function_count_all", "gt_added_function_count"), "int")


def overall(runs: DataFrame) -> DataFrame:
    """One row for a run: totals, success, accuracy and recall at 1, 5, 10 and all, submission shape, steps, tokens, cost."""
    df = with_columns(runs, run_schema())
    df = df.select("*", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(f"{c}_0") for c in COUNTED], number(F.col("submitted_function_count")).cast("int").alias("n_sub"))
    out = [F.count("*").alias("total_instances"), F.count_if(F.col("correct")).alias("success_count"), share(F.col("correct")).alias("pass_rate")]
    hit = F.when(F.count("function_hit_any") > 0, share(F.col("function_hit_any"))).otherwise(share(F.col("entity_hit_any")))
    out.append(hit.alias("function_hit_rate"))
    for name, prefix, alias in (("file", "file", None), ("function", "function", "entity"), ("edit_function", "edit_function", None), ("added_function", "added_function", None)):
        for k in ("1", "5", "10", "all"):
            v, at = _recall(prefix, k, alias), "all" if k == "all" else f"at_{k}"
            out += [accuracy(v).alias(f"{name}_acc_{at}"), F.avg(v).alias(f"{name}_recall_{at}")]
    n = F.col("n_sub")
    out += [
        F.count_if(F.coalesce("gt_added_function_count", F.lit(0)) > 0).alias("added_eval_count"),
        ratio(F.count(n), F.count("*")).alias("submission_functions_payload_rate"),
        F.avg(n).alias("avg_submitted_function_count"),
        F.when(F.count(n) > 0, percentile("n_sub", 50)).alias("p50_submitted_function_count"),
        F.when(F.count(n) > 0, percentile("n_sub", 90)).alias("p90_submitted_function_count"),
        share(n == 1).alias("single_function_submission_rate"),
        share(n <= 2).alias("under_two_functions_submission_rate"),
        F.avg(number(F.col("submitted_file_hint_count"))).alias("avg_submitted_file_hint_count"),
        F.avg(number(F.col("submitted_qualified_function_ratio"))).alias("avg_submitted_qualified_function_ratio"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost"),
    ]
    for c in COUNTED:
        out += [mean_or_zero(F.col(f"{c}_0")).alias(f"avg_{c}"), percentile(f"{c}_0", 50).alias(f"p50_{c}"), percentile(f"{c}_0", 90).alias(f"p90_{c}")]
    return df.agg(*out)


def radar(runs: DataFrame) -> DataFrame:
    """Behaviour around the search tool; rates are over the rows that called it."""
    names = dict.fromkeys(("radar_called", "radar_verification_satisfied", "radar_anti_laziness_applicable", "radar_anti_laziness_satisfied", "radar_cross_dir_inspected", "radar_first_candidate_fixated", "correct"), "boolean")
    df = with_columns(runs, names | dict.fromkeys(("blocked_submission_count", "radar_tool_calls", "radar_tool_output_chars"), "long") | {"exit_status": "string"})
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    called, due = yes("radar_called"), yes("radar_called") & yes("radar_anti_laziness_applicable")
    once, more = called & (zero("radar_tool_calls") == 1), called & (zero("radar_tool_calls") >= 2)
    won = F.coalesce("correct", F.coalesce("exit_status", F.lit("")) == "Submitted")
    n = F.count_if
    single, multi = ratio(n(once & won), n(once)), ratio(n(more & won), n(more))
    return df.agg(
        n(called).alias("radar_called_count"),
        ratio(n(called & yes("radar_verification_satisfied")), n(called)).alias("verification_compliance_rate"),
        n(due).alias("anti_laziness_applicable_count"),
        n(due & yes("radar_anti_laziness_satisfied")).alias("anti_laziness_compliant_count"),
        n(due & ~yes("radar_anti_laziness_satisfied")).alias("anti_laziness_violation_count"),
        ratio(n(due & yes("radar_anti_laziness_satisfied")), n(due)).alias("anti_laziness_compliance_rate"),
        F.sum(zero("blocked_submission_count")).alias("blocked_submission_count"),
        F.coalesce(ratio(F.sum(zero("radar_tool_output_chars")), F.sum(zero("radar_tool_calls"))), F.lit(0.0)).alias("avg_tool_output_chars"),
        ratio(n(called & (zero("blocked_submission_count") > 0)), n(called)).alias("premature_submit_rate"),
        n(once).alias("single_radar_call_count"),
        ratio(n(once), n(called)).alias("single_radar_call_rate"),
        n(more).alias("multi_radar_call_count"),
        n(called & yes("radar_cross_dir_inspected")).alias("cross_dir_inspected_count"),
        ratio(n(called & yes("radar_cross_dir_inspected")), n(called)).alias("cross_dir_inspection_rate"),
        n(called & yes("radar_first_candidate_fixated")).alias("first_candidate_fixation_count"),
        ratio(n(called & yes("radar_first_candidate_fixated")), n(called)).alias("first_candidate_fixation_rate"),
        n(due).alias("first_candidate_fixation_applicable_count"),
        ratio(n(due & yes("radar_first_candidate_fixated")), n(due)).alias("first_candidate_fixation_applicable_rate"),
        single.alias("single_radar_call_success_rate"),
        multi.alias("second_radar_call_success_rate"),
        (multi - single).alias("second_radar_call_success_delta"),
    )


def oracle(runs: DataFrame) -> DataFrame:
    """Statistics of runs that were given the right file, with a fallback column and a fallback notion of success."""
    has_correct = "correct" in runs.columns
    names = dict.fromkeys(("oracle_sniper_mode", "oracle_file_provided", "oracle_verification_satisfied", "radar_verification_satisfied", "entity_hit_any", "correct"), "boolean")
    df = with_columns(runs, names | {"blocked_submission_count": "long", "steps": "long", "exit_status": "string"}).where("oracle_sniper_mode")
    won = F.col("correct") if has_correct else F.col("exit_status") == "Submitted"
    df = df.withColumn("won_steps", F.when(F.coalesce(won, F.lit(False)), F.coalesce("steps", F.lit(0))))
    given = F.coalesce("oracle_file_provided", F.lit(False))
    ok = F.coalesce("oracle_verification_satisfied", "radar_verification_satisfied", F.lit(False))
    return df.agg(
        F.count("*").alias("oracle_instance_count"),
        F.count_if(given).alias("oracle_file_provided_count"),
        ratio(F.count_if(given), F.count("*")).alias("oracle_file_provided_rate"),
        ratio(F.count_if(given & ok), F.count_if(given)).alias("oracle_verification_compliance_rate"),
        ratio(F.count_if(given & F.coalesce("entity_hit_any", F.lit(False))), F.count_if(given)).alias("entity_hit_rate_given_oracle_file"),
        F.coalesce(F.sum("blocked_submission_count"), F.lit(0)).alias("oracle_blocked_submission_count"),
        F.count("won_steps").alias("steps_to_success_in_oracle_count"),
        mean_or_zero(F.col("won_steps")).alias("steps_to_success_in_oracle_mean"),
        percentile("won_steps", 50).alias("steps_to_success_in_oracle_p50"),
        percentile("won_steps", 90).alias("steps_to_success_in_oracle_p90"),
    )


def bucket_labels(files: Column, functions: Column, added: Column) -> Column:
    """The overlapping buckets a row belongs to."""
    z = lambda c: F.coalesce(c, F.lit(0))
    return F.array_compact(F.array(
        F.when(z(files) == 1, "single_file"), F.when(z(files) >= 2, "multi_file"),
        F.when(z(functions) == 1, "func_count_1"), F.when(z(functions) == 2, "func_count_2"), F.when(z(functions) == 3, "func_count_3"), F.when(z(functions) >= 4, "func_count_4_plus"),
        F.when(z(added) > 0, "has_added_functions").otherwise("no_added_functions"),
    ))


def buckets(runs: DataFrame) -> DataFrame:
    """Fifteen measures for each bucket: a row counts in every bucket it belongs to, in one aggregation."""
    df = with_columns(runs, run_schema())
    df = df.withColumn("bucket", F.explode(bucket_labels(F.col("gt_file_count_all"), F.col("gt_function_count_all"), F.col("gt_added_function_count"))))
    n = number(F.col("submitted_function_count")).cast("int")
    fn1, fn = _recall("function", "1", "entity"), _recall("function", "all", "entity")
    e1, e, a = _recall("edit_function", "1"), _recall("edit_function", "all"), _recall("added_function", "all")
    return df.groupBy("bucket").agg(
        F.count("*").alias("count"), share(F.col("correct")).alias("pass_rate"),
        accuracy(fn1).alias("function_acc_at_1"), F.avg(fn1).alias("function_recall_at_1"), accuracy(fn).alias("function_acc_all"), F.avg(fn).alias("function_recall_all"),
        accuracy(e1).alias("edit_function_acc_at_1"), F.avg(e1).alias("edit_function_recall_at_1"), accuracy(e).alias("edit_function_acc_all"), F.avg(e).alias("edit_function_recall_all"),
        accuracy(a).alias("added_function_acc_all"), F.avg(a).alias("added_function_recall_all"),
        F.avg(n).alias("avg_submitted_function_count"), share(n <= 2).alias("under_two_functions_submission_rate"), mean_or_zero(F.coalesce("steps", F.lit(0))).alias("avg_steps"),
    )


def by_status(runs: DataFrame, status: str = "exit_status") -> DataFrame:
    """Rows by exit status, most frequent first; null and empty count as Unknown."""
    known = F.coalesce(F.nullif(F.col(status), F.lit("")), F.lit("Unknown"))
    return runs.groupBy(known.alias(status)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), status)


def status_lists(runs: DataFrame, status: str, key: str) -> DataFrame:
    return runs.groupBy(status).agg(F.sort_array(F.collect_list(key)).alias("ids"))


def judged(rounds: DataFrame, how: str = "median") -> DataFrame:
    """One row for each question from its judge rounds, by median (also for unknown modes) or mean."""
    f = F.avg if how == "mean" else F.median
    return rounds.groupBy("question_hash").agg(*[f(d).alias(d) for d in DIMENSIONS])


def qa_groups(scores: DataFrame) -> DataFrame:
    """Count, pass rate and mean scores by category and, separately, by difficulty; rows without a key are in neither."""
    scores.createOrReplaceTempView("__qa_scores")
    return scores.sparkSession.sql("""
        SELECT CASE WHEN grouping(category) = 0 THEN 'category' ELSE 'difficulty' END AS dimension,
               CASE WHEN grouping(category) = 0 THEN category ELSE difficulty END AS label,
               count(*) AS n, avg(CAST(pass AS double)) AS pass_rate, avg(score_avg) AS mean_score, avg(weighted_score) AS mean_weighted
        FROM __qa_scores GROUP BY GROUPING SETS ((category), (difficulty))
    """).where("label is not null")


def qa_overall(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count("*").alias("n"), mean_or_zero(F.col("pass").cast("double")).alias("pass_rate"), mean_or_zero(F.col("score_avg")).alias("mean_score"), mean_or_zero(F.col("weighted_score")).alias("mean_weighted"),
        *[mean_or_zero(F.col(d)).alias(f"mean_{d}") for d in DIMENSIONS],
    )


def uplift(rows: DataFrame) -> DataFrame:
    """Accuracy of rows that used a tool against those that had it and did not: in points, and relative in percent.

    rows: used, offered, correct, calls, call_hits.
    """
    used, idle = F.col("used"), F.col("offered") & ~F.col("used")
    a, b = ratio(F.count_if(used & F.col("correct")), F.count_if(used)), ratio(F.count_if(idle & F.col("correct")), F.count_if(idle))
    return rows.agg(
        F.count("*").alias("total"), F.count_if(used).alias("used"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"),
        ratio(F.count_if(used), F.count_if(F.col("offered"))).alias("usage_rate"),
        ratio(F.sum("call_hits"), F.sum("calls")).alias("call_hit_rate"),
        ratio(F.count_if(used & (F.col("call_hits") > 0)), F.count_if(used)).alias("instance_hit_rate"),
        a.alias("accuracy_used"), b.alias("accuracy_not_used"), ((a - b) * 100).alias("uplift_points"),
        F.when(b > 0, (a - b) / b * 100).alias("uplift_percent"),
    )


def symbol_scope(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols by kind, the two classes of most methods of each file). symbols: file, kind, name, class."""
    kinds = symbols.groupBy("file", "kind").agg(F.count("*").alias("n"))
    methods = symbols.where("kind = 'method'").groupBy("file", "class").agg(F.count("*").alias("n"))
    top = methods.groupBy("file").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), F.col("class").alias("class")))), 1, 2).alias("t"))
    return kinds, top.select("file", F.transform("t", lambda x: x["class"]).alias("classes"))


def spent(calls: DataFrame, cost: str = "cost", cost_limit: float = 0.0, call_limit: int = 0) -> DataFrame:
    """Cost and number of all calls, and whether that is over a limit (0: none): the cost, or one more call."""
    total, n = F.coalesce(F.sum(cost), F.lit(0.0)), F.count("*")
    over = (F.lit(0 < cost_limit) & (total > cost_limit)) | (F.lit(0 < call_limit) & (n + 1 > call_limit))
    return calls.agg(total.alias("cost"), n.alias("n_calls"), over.alias("over"))


def within_limits(calls: DataFrame, cost: str = "cost", cost_limit: float = 0.0, call_limit: int = 0) -> None:
    """Raises RuntimeError if the calls are over a limit."""
    row = spent(calls, cost, cost_limit, call_limit).first()
    if row.over:
        raise RuntimeError(f"limit exceeded: cost {row.cost:.4f}, {row.n_calls} calls")
