"""Registered queries over the driver's tables, named by the operators that they apply."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalweave.functions import measures, paths, payloads, text
from evalweave.operators import chunking, commands, indexes, matching, nearest, ranking, sampling, sessions, summary
from evalweave.streaming import sessions as streams

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the cluster's shared folder; a temporary one only for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="evalweave-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 best vectors for each query vector (every twentieth); labels play the files."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_no"), F.col("embedding").alias("query"))
    return _with_path(nearest.nearest(vectors, asked, 200, "vec_id", ("label",)))


def _with_path(rows: DataFrame) -> DataFrame:
    return rows.withColumn("path", F.concat(F.lit("src/"), (F.col("label") % 3).cast("string"), F.lit("/f"), F.col("label").cast("string"), F.lit(".py")))


@query
def o1_w1_vector_top_k(spark, sf_dir):
    return _hits(spark, sf_dir).select("query_no", "vec_id", "rank", F.round("score", 6).alias("score"))


@query
def a1_a2_w2_o2_hybrid_group_score(spark, sf_dir):
    groups = ranking.group_scores(_hits(spark, sf_dir), ["query_no", "path"]).withColumn("score", F.round("score", 6))
    return ranking.ranked_files(groups, ("query_no",)).select("query_no", "path", "score", "evidence_count", "place")


@query
def a3_o4_group_sum_top_files(spark, sf_dir):
    # A label has one path, which is made once a group.
    groups = _with_path(ranking.group_scores(_hits(spark, sf_dir), ["query_no", "label"], "sum"))
    top = sampling.top_per_group(groups, "query_no", 5, F.desc(F.round("score", 6)), F.asc("path"))
    return top.select("query_no", "path", F.round("score", 6).alias("score"), "rank")


@query
def a4_o3_rank_fusion(spark, sf_dir):
    groups = ranking.group_scores(_hits(spark, sf_dir), ["query_no", "path"])
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0")
    out = ranking.fused(groups, asked.select("vec_id").distinct().count())
    out = out.withColumns({c: F.round(c, 6) for c in ("dense_mean", "rrf", "score")})
    return ranking.fused_places(out).select("path", "support", "evidence_count", "dense_mean", "rrf", "score", "place")


@query
def o10_a24_clustered_display(spark, sf_dir):
    files = ranking.group_scores(_hits(spark, sf_dir), ["query_no", "path"])
    return ranking.displayed(files, "clustered", ("query_no",)).select("query_no", "path", "dir", "place", "evidence_count")


@query
def p5_p6_filtered_vector_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").withColumn("path", F.concat(F.lit("src/f"), F.col("label").cast("string"), F.when(F.col("label") % 2 == 0, ".py").otherwise(".go")))
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_no"), F.col("embedding").alias("query"))
    spec = sampling.parse_filters("lang:Python path:src junk")
    hits = nearest.nearest(vectors, asked, 20, "vec_id", ("path",), where=sampling.passes(spec, F.col("path"), F.lit(None).cast("string")))
    return hits.select("query_no", "vec_id", "path", "rank", F.round("score", 6).alias("score"))


@query
def w8_diverse_pick(spark, sf_dir):
    # Both windows use this exchange.
    return ranking.diverse(_hits(spark, sf_dir).repartition("query_no"), "label", "rank", 15, ("query_no",)).select("query_no", "vec_id", "label", "rank")


@query
def w4_steps(spark, sf_dir):
    said = table(spark, sf_dir, "conversations")
    return sessions.steps(said, "conv_id", "turn", "role").groupBy("conv_id", "step").agg(F.count("*").alias("n"), F.max("turn").alias("last_turn"))


@query
def w3_next_user_text(spark, sf_dir):
    said = table(spark, sf_dir, "conversations")
    return said.withColumn("next_user", text.short_hash(sessions.next_of_role("role", "text", "conv_id", "turn"))).select("conv_id", "turn", "next_user")


@query
def w11_last_assistant(spark, sf_dir):
    last = sessions.last_of_role(table(spark, sf_dir, "conversations"), "conv_id", "role", "text", "turn")
    return last.select("conv_id", text.short_hash(F.col("last")).alias("last_hash"))


@query
def w5_first_occurrence(spark, sf_dir):
    seen = sessions.first_seen(table(spark, sf_dir, "events"), "event_type", "user_id", "event_id")
    return seen.select("user_id", "event_type", "event_id")


def _signals(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = sessions.streaks(events, "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return sessions.repeats(rows, "user_id", ["ts", "event_id"], "event_type")


@query
def t1_t2_streaks_and_repeats(spark, sf_dir):
    return _signals(spark, sf_dir).select("event_id", "streak", "fired", "repeat")


@query
def t3_no_progress(spark, sf_dir):
    return sessions.no_progress(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "idle", "stalled")


@query
def t5_a26_running_tokens(spark, sf_dir):
    calls = table(spark, sf_dir, "events").withColumn("estimate", F.floor("value").cast("long")).withColumn("actual", F.when(F.col("event_type") != "error", F.ceil("value").cast("long")))
    return sessions.running_tokens(calls, "user_id", ["ts", "event_id"]).select("event_id", "total_tokens", "calls")


@query
def t4_feedback_limiter(spark, sf_dir):
    rows = sessions.no_progress(_signals(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type")
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return sessions.feedback(rows, "user_id", "at")


@query
def t6_t7_t8_gates(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "search").when(F.col("event_type") == "view", "read").when(F.col("event_type") == "click", "list").otherwise("submit")
    files = F.transform(F.sequence(F.lit(1), F.when(F.col("event_type") == "signup", 3).otherwise(1)), lambda i: F.concat(F.lit("f"), F.pmod(F.col("event_id") + i, F.lit(4)).cast("string")))
    return sessions.gated(table(spark, sf_dir, "events").select("user_id", "event_id", kind.alias("kind"), files.alias("paths")), "user_id", "event_id")


@query
def t11_stream_status_counts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    base = scratch(spark, "stream")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    streams.drained(streams.status_counts(stream, "event_type"), f"{base}/checkpoint", f"{base}/out", "complete")
    return spark.read.parquet(f"{base}/out").select("event_type", F.col("count").alias("n"))


@query
def a12_o13_counts_by_status(spark, sf_dir):
    return summary.by_status(table(spark, sf_dir, "events").withColumn("event_type", F.when(F.col("event_type") != "click", F.col("event_type")).otherwise("")), "event_type")


@query
def a25_k8_status_lists(spark, sf_dir):
    lists = summary.status_lists(table(spark, sf_dir, "nation"), "n_regionkey", "n_name")
    return lists.select("n_regionkey", F.array_join("ids", ",").alias("ids"))


@query
def a5_a8_a9_percentiles(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("v", F.floor("value").cast("long"))
    return events.groupBy("event_type").agg(
        measures.percentile("v", 50).alias("p50"), measures.percentile("v", 90).alias("p90"), F.round(measures.mean_or_zero(F.col("v")), 6).alias("mean"),
        F.round(measures.accuracy(F.col("value")), 6).alias("acc"), F.round(measures.ratio(F.sum("v"), F.count_if(F.col("value") > 1e12)), 6).alias("none"),
    )


@query
def w7_line_windows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.windows(docs, "text", 12, 4).select("doc_id", "start_line", "end_line", text.short_hash(F.col("text")).alias("hash"))


@query
def f2_f3_hashes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.short_hash(F.col("text")).alias("short"), text.path_hash(F.col("text")).alias("sha1"))


@query
def f30_f31_token_overlap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("found", text.tokens(F.col("text")))
    return docs.select("doc_id", F.size("found").alias("n_tokens"), text.overlap(F.col("found"), F.concat("lang", F.lit("_the_source_"), "source")).alias("overlap"))


@query
def f34_previews(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query
def f1_levenshtein_parts(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", F.levenshtein("p_type", "p_brand").alias("distance"))


@query
def f4_f5_p14_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("id", F.concat(F.lit("org__"), F.lower("c_mktsegment"), F.lit("-"), F.col("c_custkey").cast("string")))
    return c.select("c_custkey", paths.repo_of_instance(F.col("id")).alias("repo"), paths.sanitized(F.concat("c_name", F.lit(" / v1"))).alias("safe"), paths.repo_folder(F.lit("a/b")).alias("folder"))


@query
def f8_f11_url_paths(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", paths.normal(F.concat(F.lit("./"), F.regexp_replace("url", r"^https?://|[?#].*$", ""))).alias("path"))
    return pages.select("page_id", "path", paths.basename(F.col("path")).alias("name"), paths.parent(F.col("path")).alias("dir"))


@query
def f12_u5_modules(spark, sf_dir):
    entities = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.concat(F.lit("f"), (F.col("p_size") % i).cast("string"), F.lit(".py:C"), F.pmod(F.col("p_partkey"), i).cast("string"), F.lit(".m")))
    parts = table(spark, sf_dir, "part").withColumn("entities", entities)
    return parts.select("p_partkey", F.array_join(F.array_sort(paths.modules(F.col("entities"))), ",").alias("modules"))


@query
def f21_f42_json_fields(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    raw = F.try_parse_json("props")
    first = F.element_at(F.map_keys(F.from_json("props", "map<string,string>")), 1)
    return events.select("event_id", raw.isNotNull().alias("is_json"), first.alias("key"), text.truth(F.when(F.col("event_id") % 2 == 0, " Yes ").otherwise("maybe")).alias("truth"))


@query
def j1_last_wins(spark, sf_dir):
    last = sampling.last_by(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return last.join(customers, "user_id")


@query
def j2_j3_j5_left_lookups(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query
def j4_text_key_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    first = docs.groupBy(text.strip(F.col("text")).alias("question")).agg(F.max("doc_id").alias("reference"))
    asked = docs.select("doc_id", text.strip(F.concat(F.lit(" \n"), "text", F.lit("\t"))).alias("question")).where("question != ''")
    return asked.join(first, "question").select("doc_id", "reference")


@query
def j6_j8_u6_resume(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    done = docs.join(labels, "doc_id", "left_semi").withColumn("fresh", F.lit(False))
    return sampling.undone(docs, labels, "doc_id").withColumn("fresh", F.lit(True)).unionByName(done)


@query
def j9_o6_name_matching(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    names = F.concat(F.lit("C"), (F.col("p_size") % 7).cast("string"), F.lit("."), F.lower(F.regexp_replace("p_type", "[^A-Za-z]+", "_")))
    found = parts.select(F.concat(F.lit("src/"), F.lower("p_brand"), F.lit(".py")).alias("path"), names.alias("qualname"), F.lit("method").alias("kind")).distinct()
    index = chunking.function_index(found.withColumn("name", F.substring_index("qualname", ".", -1)))
    asked = parts.select(F.col("p_partkey").alias("query_id"), names.alias("function"), F.when(F.col("p_partkey") % 2 == 0, F.lower("p_brand")).otherwise("").alias("file_hint"))
    return matching.answered(asked, index).select("query_id", "file", "qualname")


@query
def j10_hint_join(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.regexp_replace("url", r"^https?://|[?#].*$", "").alias("path")).distinct()
    hints = pages.select(paths.basename(F.col("path")).alias("hint")).unionByName(pages.select(F.substring_index("path", "/", 1).alias("hint"))).where("hint != ''")
    return matching.hint_join(hints, pages)


@query
def j11_u7_path_hits(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"^https?://|[?#].*$", "").alias("path"))
    truth = F.array(F.substring_index("path", "/", -2), F.lit("en/7"), F.lit("a/b/7"))
    return pages.select("page_id", matching.path_hits(F.col("path"), truth).alias("hit"), matching.path_hits(F.lit("x/7"), truth).alias("ambiguous"))


@query
def j16_line_entities(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    blocks = chunking.windows(docs, "text", 10, 3).select(F.concat_ws(":", "path", "start_line").alias("block_id"), "path", "start_line", "end_line")
    inner = chunking.windows(docs, "text", 5, 2).select("path", F.concat(F.lit("in"), "start_line").alias("qualname"), F.col("start_line").alias("start"), F.col("end_line").alias("stop"))
    outer = chunking.windows(docs, "text", 40, 0).select("path", F.concat(F.lit("out"), "start_line").alias("qualname"), F.col("start_line").alias("start"), F.col("end_line").alias("stop"))
    return matching.line_entities(blocks, inner.unionByName(outer))


@query
def j19_j20_inverted_edges(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("callee"), (F.col("l_suppkey") % 20).alias("caller"))
    return matching.inverted(edges).select("callee", F.array_join("callers", ",").alias("callers"))


@query
def p1_p2_filters(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return sampling.matching(sampling.matching(c, "c_mktsegment", "^(AUTO|BUILD|MACH)|HOLD"), "c_name", "Customer.*[13579]", prefix=True)


@query
def p3_slice(spark, sf_dir):
    return sampling.sliced(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "10:-20:3")


@query
def p4_seeded_shuffle(spark, sf_dir):
    return sampling.shuffled(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")


@query
def p10_p11_without_tests(spark, sf_dir):
    files = F.array(F.concat(F.lit("src/a"), (F.col("p_size") % 3).cast("string"), F.lit(".py")), F.when(F.col("p_partkey") % 2 == 0, "tests/x.py").otherwise("pkg/tests/y.py"), F.lit("test_z.py"))
    only = F.when(F.col("p_partkey") % 5 == 0, F.slice(files, 2, 2)).otherwise(files)
    kept = table(spark, sf_dir, "part").select("p_partkey", paths.without_tests(only).alias("k"))
    return kept.select("p_partkey", F.array_join("k.files", ",").alias("files"), "k.fallback")


@query
def k3_upsert(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels")
    changes = labels.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("lang"), (F.col("toxic") == 1).alias("deleted"), F.lit(1).cast("long").alias("seq"))
    return sampling.upserted(docs, changes, "doc_id")


@query
def u1_u2_recall(spark, sf_dir):
    """Whole texts: the first two thirds of the words are the truth, the last two thirds are found."""
    words, third = F.col("words"), F.floor(F.size("words") / 3).cast("int")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("words"))
    docs = docs.select("doc_id", F.slice(words, 1, F.size(words) - third).alias("gt"), F.slice(words, third + 1, F.size(words) - third).alias("found"))
    gt, found = F.col("gt"), F.col("found")
    return docs.select("doc_id", measures.hits(gt, found).alias("hits"), *[F.round(measures.recall(gt, found, k), 6).alias(f"r{k or 'all'}") for k in (1, 3, None)], measures.hit_any(gt, found).alias("hit"))


def _runs(spark, sf_dir):
    """Orders as runs: their lines are ground truth, and predictions are made of neighbouring parts."""
    item = F.concat(F.lit("p"), (F.col("l_partkey") % 7).cast("string"), F.lit(".py:f"), (F.col("l_suppkey") % 5).cast("string"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", item.alias("item"), F.col("l_quantity"))
    pick = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("l_linenumber", "item")))), lambda x: x["item"])
    runs = lines.groupBy("l_orderkey").agg(pick(F.col("l_linenumber") <= 2).alias("edit"), pick(F.col("l_linenumber") == 3).alias("added"), pick(F.col("l_linenumber") >= 2).alias("entities"), F.sum("l_quantity").cast("long").alias("steps"))
    return runs.withColumn("files", F.array_distinct(F.transform("entities", lambda e: F.split_part(e, F.lit(":"), F.lit(1)))))


@query
def m1_m2_u3_metric_vector(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    out = runs.select("l_orderkey", *measures.metric_columns(F.col("edit"), F.col("added"), F.col("files"), F.col("entities")))
    return out.select("l_orderkey", "correct", "gt_file_count_all", "gt_function_count_all", F.round("entity_recall_at_3", 6).alias("entity_recall_at_3"), F.round("file_recall_all", 6).alias("file_recall_all"), F.round("added_function_recall_all", 6).alias("added_function_recall_all"), "edit_function_acc_all")


def _measured(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return runs.select("steps", (F.col("steps") % 4).cast("int").alias("submitted_function_count"), *measures.metric_columns(F.col("edit"), F.col("added"), F.col("files"), F.col("entities")))


@query
def a13_run_summary(spark, sf_dir):
    out = summary.overall(_measured(spark, sf_dir))
    keep = ["total_instances", "success_count", "p50_steps", "p90_steps", "added_eval_count"]
    return out.select(*keep, *[F.round(c, 6).alias(c) for c in ("pass_rate", "function_acc_at_1", "function_recall_at_5", "edit_function_recall_all", "added_function_acc_all", "avg_steps", "under_two_functions_submission_rate")])


@query
def a16_overlapping_buckets(spark, sf_dir):
    out = summary.buckets(_measured(spark, sf_dir))
    return out.select("bucket", "count", *[F.round(c, 6).alias(c) for c in ("pass_rate", "function_recall_all", "edit_function_acc_at_1", "added_function_recall_all", "avg_steps")])


@query
def a14_radar_statistics(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    odd = lambda n: (F.col("event_id") % n) == 0
    runs = e.select(odd(2).alias("radar_called"), odd(6).alias("radar_verification_satisfied"), odd(4).alias("radar_anti_laziness_applicable"), odd(8).alias("radar_anti_laziness_satisfied"), odd(10).alias("radar_cross_dir_inspected"), odd(12).alias("radar_first_candidate_fixated"), (F.col("event_type") == "purchase").alias("correct"), (F.col("event_id") % 3).alias("radar_tool_calls"), (F.col("event_id") % 5).alias("blocked_submission_count"), F.lit(10).cast("long").alias("radar_tool_output_chars"))
    out = summary.radar(runs)
    return out.select("radar_called_count", "anti_laziness_compliant_count", "blocked_submission_count", *[F.round(c, 6).alias(c) for c in ("verification_compliance_rate", "premature_submit_rate", "single_radar_call_rate", "second_radar_call_success_delta", "avg_tool_output_chars")])


@query
def a15_oracle_statistics(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    odd = lambda n: (F.col("event_id") % n) == 0
    runs = e.select(odd(3).alias("oracle_sniper_mode"), odd(2).alias("oracle_file_provided"), F.when(odd(5), odd(10)).alias("oracle_verification_satisfied"), odd(4).alias("radar_verification_satisfied"), odd(7).alias("entity_hit_any"), odd(9).alias("correct"), (F.col("event_id") % 11).alias("steps"), (F.col("event_id") % 3).alias("blocked_submission_count"))
    out = summary.oracle(runs)
    return out.select("oracle_instance_count", "oracle_file_provided_count", "steps_to_success_in_oracle_count", "steps_to_success_in_oracle_p90", F.round("oracle_verification_compliance_rate", 6).alias("oracle_verification_compliance_rate"), F.round("entity_hit_rate_given_oracle_file", 6).alias("entity_hit_rate_given_oracle_file"))


def _scores(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("category"), F.when(F.col("p_size") > 25, "hard").when(F.col("p_size") > 5, "easy").alias("difficulty"), *[(F.pmod(F.col("p_partkey") * (i + 3), F.lit(11))).cast("int").alias(d) for i, d in enumerate(measures.DIMENSIONS)]).select(
        "*", (sum((F.col(d) for d in measures.DIMENSIONS), F.lit(0)) / 5).alias("score_avg"), measures.weighted_score({"correctness": 2, "clarity": 1}).alias("weighted_score")
    ).withColumn("pass", F.col("score_avg") >= 5)


@query
def a17_f20_qa_groups(spark, sf_dir):
    out = summary.qa_groups(_scores(spark, sf_dir))
    return out.select("dimension", "label", "n", *[F.round(c, 6).alias(c) for c in ("pass_rate", "mean_score", "mean_weighted")])


@query
def a18_qa_overall(spark, sf_dir):
    out = summary.qa_overall(_scores(spark, sf_dir))
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("pass_rate", "mean_score", "mean_weighted", "mean_clarity")])


@query
def a10_judge_rounds(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("question_hash"), *[F.pmod(F.col("l_orderkey") * (i + 2) + F.col("l_linenumber"), F.lit(11)).cast("int").alias(d) for i, d in enumerate(measures.DIMENSIONS)])
    return summary.judged(p)


@query
def f17_parsed_scores(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    good = F.concat(F.lit('```json\n{"correctness": '), (F.col("p_size") % 13).cast("string"), F.lit(', "completeness": 5.7, "relevance": 3, "clarity": 2, "reasoning": 1}\n```'))
    raw = F.when(F.col("p_partkey") % 7 == 0, "no json").otherwise(good)
    s = p.select("p_partkey", measures.parsed_scores(raw).alias("s"))
    return s.select("p_partkey", "s.correctness", "s.completeness")


@query
def a20_a21_uplift(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = docs.select((F.col("n_chars") > 1500).alias("used"), F.lit(True).alias("offered"), (F.col("quality") == 1).alias("correct"), F.when(F.col("n_chars") > 1500, 2).otherwise(0).alias("calls"), F.when(F.col("n_chars") > 1500, F.col("toxic")).otherwise(0).alias("call_hits"))
    out = summary.uplift(rows)
    return out.select("total", "used", "calls", *[F.round(c, 6).alias(c) for c in ("usage_rate", "call_hit_rate", "instance_hit_rate", "accuracy_used", "accuracy_not_used", "uplift_points", "uplift_percent")])


@query
def a22_symbol_scope(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("file"), F.when(F.col("l_linenumber") > 2, "method").otherwise("function").alias("kind"), F.lit("x").alias("name"), F.concat(F.lit("C"), (F.col("l_partkey") % 9).cast("string")).alias("class"))
    kinds, top = summary.symbol_scope(li)
    return kinds.join(top, "file", "left").select("file", "kind", "n", F.array_join("classes", ",").alias("top"))


@query
def w9_f13_f36_lists(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.capped(text.tidy_list(F.split("text", "\n")), 3).alias("l"), text.shorten(F.col("source"), 12).alias("short"))
    return docs.select("doc_id", F.size("l").alias("n"), text.short_hash(F.array_join("l", "|")).alias("hash"), "short")


@query
def f25_f26_tool_commands(spark, sf_dir):
    ids = table(spark, sf_dir, "events").select("event_id")
    said = F.concat(F.lit("Look.\n```bash\n@tool radar --queries \"a "), F.col("event_id").cast("string"), F.lit("\" c --topk-files 20\n```\n"))
    rows = ids.select("event_id", text.single_action(said).alias("action")).withColumn("t", commands.tool_command("action"))
    return rows.select("event_id", "action", "t.name", "t.args")


@query
def f29_query_expansion(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.expand_query(F.concat(F.col("source"), F.lit(" "), F.col("lang"), F.lit(" see src/core_api.py getUser"))).alias("v"))
    return docs.select("doc_id", F.size("v").alias("n"), F.array_join("v", "\n").alias("variants"))


@query
def f38_f37_usage(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    p, c = F.col("l_partkey"), F.col("l_suppkey")
    u = measures.reconciled_usage(F.when(F.col("l_linenumber") != 1, p), F.when(F.col("l_linenumber") != 2, c), F.when(F.col("l_linenumber") != 3, p + c))
    return li.select("l_orderkey", "l_linenumber", u.alias("u")).select("l_orderkey", "l_linenumber", "u.prompt", "u.completion", "u.total")


@query
def f43_unit_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", measures.unit_vector(F.transform("embedding", lambda x: x * 3)).alias("u"))
    return v.select("vec_id", F.round(measures.dot(F.col("u"), F.col("u")), 6).alias("norm"), F.round(F.get("u", F.lit(0)), 5).alias("first"))


@query
def a19_macro_recall(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    gt = F.array_union("edit", "added")
    return runs.agg(F.round(measures.mean_or_zero(measures.recall(gt, F.col("entities"))), 6).alias("recall"), F.count("*").alias("n"))


@query
def a23_u4_distinct_and_remaining(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    left = F.array_sort(F.array_except(F.array_union("edit", "added"), F.col("entities")))
    return runs.select("l_orderkey", F.size(F.array_distinct("entities")).alias("distinct_names"), F.array_join(left, ",").alias("remaining"))


@query
def f32_f33_ranks(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("name", F.lower(F.regexp_replace("p_type", "[^A-Za-z]+", "_")))
    asked = F.when(F.col("p_partkey") % 4 == 0, F.col("name")).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("C."), "name")).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("D."), "name")).otherwise("other")
    rank = matching.match_rank(asked, F.concat(F.lit("C."), "name"), F.col("name"))
    hint = matching.hint_rank(F.when(F.col("p_partkey") % 3 == 0, "B.py").when(F.col("p_partkey") % 3 == 1, "a\\b.PY").otherwise("zz"), F.lit("src/a/b.py"))
    return p.select("p_partkey", rank["level"].alias("level"), rank["distance"].alias("distance"), hint.alias("hint"))


@query
def j12_j13_j15_hints(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"^https?://|[?#].*$", "").alias("path"))
    seen = F.array(F.col("path"), F.lit("src/pkg/auth.py"), F.lit("lib/auth.py"))
    asked = F.when(F.col("page_id") % 3 == 0, F.substring_index("path", "/", -2)).when(F.col("page_id") % 3 == 1, "auth.py").otherwise("nowhere.py")
    return pages.select("page_id", matching.hint_observed(asked, seen).alias("observed"), matching.hint_inspected(asked, seen).alias("inspected"), matching.resolved(asked, seen).alias("resolved"))


@query
def j17_graph_nodes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    spans = li.select(F.concat(F.lit("p"), (F.col("l_partkey") % 40).cast("string")).alias("path"), F.col("l_linenumber").cast("string").alias("span")).distinct()
    nodes = li.select(F.concat(F.lit("p"), (F.col("l_suppkey") % 30).cast("string"), F.lit(":"), (F.col("l_linenumber") % 4).cast("string")).alias("node_id")).distinct().withColumn("type", F.when(F.endswith("node_id", F.lit("1")), "class").otherwise("function"))
    return matching.graph_entities(spans, nodes).select("node_id", "type")


@query
def p9_valid_instances(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("instance_id"), F.col("source").alias("repo"))
    repos = docs.select("repo").distinct().where("repo not like '%1'")
    return sampling.valid_instances(docs, repos, skip_missing=True)


@query
def p7_p15_pick_by_ordinal(spark, sf_dir):
    return sampling.pick(table(spark, sf_dir, "nation").select("n_name", "n_regionkey"), "n_name", "3")


@query
def o5_o7_o12_ties_caps_and_order(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("file_no"), (F.col("p_partkey") % 3).alias("block_no"), F.col("p_type").alias("name"), F.concat_ws(":", "p_brand", "p_type").alias("entity"))
    return matching.capped_entities(p, 50)


@query
def v2_index_reasons(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    commit = F.when(F.col("p_partkey") % 5 == 0, "").when(F.col("p_partkey") % 5 == 1, "c2").otherwise("c1")
    meta = F.when(F.col("p_partkey") % 7 != 0, F.struct(F.lit("v1").alias("index_version"), F.when(F.col("p_partkey") % 11 == 0, "q").otherwise("r").alias("repo_dir"), commit.alias("base_commit"), F.when(F.col("p_size") % 2 == 0, "800").otherwise("x").alias("chunk_size"), F.lit("200").alias("overlap")))
    wanted = F.struct(F.lit("v1").alias("index_version"), F.lit("r").alias("repo_dir"), F.lit("c1").alias("base_commit"), F.lit("800").alias("chunk_size"), F.when(F.col("p_partkey") % 13 == 0, "100").otherwise("200").alias("overlap"))
    rows = p.select("p_partkey", meta.alias("meta"), wanted.alias("wanted"))
    columns = ("index_version", "repo_dir", "base_commit", "chunk_size", "overlap")
    return rows.select("p_partkey", indexes.mismatch("meta", "wanted", True, columns).alias("strict"), indexes.mismatch("meta", "wanted", False, columns).alias("static"))


@query
def f16_f18_f19_answers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('{"answer": "'), "p_brand", F.lit('"}'))).when(F.col("p_partkey") % 3 == 1, '{"answer": 5}').otherwise(F.concat(F.lit(" "), "p_name", F.lit("\n")))
    fenced = text.fence_stripped(F.concat(F.lit("```json\n"), "p_brand", F.lit("\n```")))
    return p.select("p_partkey", measures.answer_text(raw).alias("answer"), fenced.alias("fenced"), measures.joined_answer(F.array("p_brand", F.lit(""), F.lit(None).cast("string"), "p_type")).alias("joined"))


@query
def f23_f28_paths_in_output(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey").cast("string")
    diff = F.concat(F.lit("diff --git a/x b/src/f"), n, F.lit(".py\n+1\ndiff --git a/x b/src/g.py\ndiff --git a/y b/src/g.py\n"))
    grep = F.concat(F.lit("src/a"), n, F.lit(".py:1:x\nno colon\nBinary file bin/"), n, F.lit(" matches\nsrc/b.py:2\nsrc/b.py:3"))
    shown = {"diff": text.diff_files(diff), "grep": text.output_paths(grep), "tracked": text.output_paths(grep, whole_lines=True)}
    return p.select("p_partkey", *[F.array_join(c, ",").alias(k) for k, c in shown.items()])


def _submissions(spark, sf_dir):
    """Texts of submissions in five forms, by part."""
    n, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 5
    forms = [
        F.concat(F.lit('Done.\n```json\n{"functions": [{"function": "C.f'), n, F.lit('", "file_hint": "./src/a.py"}, {"name": "g", "file": "b'), n, F.lit('.py"}, {"func": ""}, "h"]}\n```')),
        F.concat(F.lit(' {"found_files": ["a.py", " b.py", "a.py"], "entities": ["x'), n, F.lit('.py:C.m", "x.py:f", "none"]} ')),
        F.concat(F.lit('see {not json} and {"files": "one'), n, F.lit('.py", "found_entities": []} there')),
        F.concat(F.lit("nothing "), n, F.lit(" \n")),
        F.concat(F.lit('{"functions": "'), n, F.lit('", "found_modules": ["m"], "found_entities": ["q.py:k"]}')),
    ]
    said = F.coalesce(*[F.when(k == i, f) for i, f in enumerate(forms)])
    return table(spark, sf_dir, "part").select("p_partkey", said.alias("text"))


@query
def m3_f14_f15_outputs(spark, sf_dir):
    out = payloads.assembled(_submissions(spark, sf_dir))
    lists = [F.array_join(c, ",").alias(c) for c in ("found_files", "found_entities", "found_modules", "raw_output")]
    counts = [f"submitted_{c}_count" for c in ("function", "unique_function", "file_hint", "qualified_function")]
    return out.select("p_partkey", *lists, *counts, F.round("submitted_qualified_function_ratio", 6).alias("ratio"), "has_functions")


@query
def f40_f44_hints_and_fallbacks(spark, sf_dir):
    rows = _submissions(spark, sf_dir).withColumn("status", F.when(F.col("p_partkey") % 3 == 0, "LimitsExceeded").when(F.col("p_partkey") % 3 == 1, "Submitted").otherwise("Failed"))
    hints = payloads.submission_hints(F.coalesce(payloads.payload(F.col("text")), F.lit("{}")))
    located = payloads.located_result(F.col("status"), F.lit("given"), F.when(F.col("p_partkey") % 2 == 0, F.col("text")))
    answer = payloads.answered_result(F.col("status"), F.lit(" given "), F.when(F.col("p_partkey") % 2 == 0, F.lit(" said ")), text.strip)
    return rows.select("p_partkey", F.array_join(hints, ",").alias("hints"), F.regexp_replace(located, r"\s", "").alias("located"), answer.alias("answer"))


def _symbols(spark, sf_dir):
    kind = F.when(F.col("p_size") % 4 == 0, "class").when(F.col("p_size") % 4 == 1, "function").when(F.col("p_size") % 4 == 2, "method").otherwise("constant")
    name = F.lower(F.regexp_replace("p_name", " ", "_"))
    return table(spark, sf_dir, "part").select("p_brand", F.concat(name, F.lit("_"), F.col("p_partkey").cast("string")).alias("name"), kind.alias("kind"), F.col("p_size").alias("start"), (F.col("p_size") + F.col("p_partkey") % 9 - 2).cast("int").alias("stop"))


@query
def o8_symbol_order(spark, sf_dir):
    asked = text.tokens(F.lit("find small PART in name_1 of them"))
    return ranking.best_symbols(_symbols(spark, sf_dir).withColumn("tokens", asked), "p_brand", 12).select("p_brand", "name", "place")


@query
def o9_listed_symbols(spark, sf_dir):
    return ranking.listed_symbols(_symbols(spark, sf_dir), "p_brand", 20).select("p_brand", "name", "start", "place")


@query
def o11_dependencies(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").where("l_linenumber <= 1 + l_suppkey % 3").select(F.concat(F.lit("S"), (F.col("l_suppkey") % 40).cast("string")).alias("source"), F.concat(F.lit("t"), (F.col("l_partkey") % 97).cast("string")).alias("target"))
    return ranking.dependencies(edges).select("source", F.array_join("shown", ",").alias("shown"), "more")


@query
def p8_record_meta(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo"), F.nullif(F.col("lang"), F.lit("en")).alias("patch"), "n_chars")
    return rows.select("doc_id", payloads.record_meta(rows).alias("meta"))


@query
def p12_existing_candidates(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    files = p.select(F.concat(F.lit("src/f"), (F.col("p_partkey") * 2).cast("string"), F.lit(".py")).alias("path"))
    asked = p.select("p_partkey", F.concat(F.when(F.col("p_partkey") % 7 == 0, "../src/f").when(F.col("p_partkey") % 3 == 0, "./src/f").when(F.col("p_partkey") % 3 == 1, "src//f").otherwise("src/../src/f"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"))
    return matching.existing(asked, files).select("p_partkey", "path")


@query
def a27_spent(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(F.floor("value").cast("double").alias("cost"))
    return summary.spent(calls, cost_limit=1.0, call_limit=10**9)


@query
def f39_token_estimate(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.when(F.col("turn") % 2 == 0, F.create_map(F.lit("role"), "role", F.lit("content"), "text")).otherwise(F.create_map(F.lit("name"), "role", F.lit("content"), "text"))).alias("m"), F.max("role").alias("last"))
    words = lambda c: F.regexp_count(c, F.lit(r"[^ \t\n]+"))
    return said.select("conv_id", payloads.estimated_tokens(F.col("m"), F.col("last"), words).alias("e")).select("conv_id", "e.*")


@query
def w6_w10_recent_ids(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    recent = F.reverse(F.array_sort(F.collect_list("event_id")))
    return e.groupBy("event_type").agg(text.shorten(F.array_join(F.transform(recent, lambda x: x.cast("string")), ", "), 55).alias("recent"))
