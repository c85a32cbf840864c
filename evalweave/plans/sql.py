"""DuckDB SQL with the same results as the registered queries."""

SQL: dict[str, str] = {}

_DOT = "list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_PATH = "'src/' || (label % 3) || '/f' || label || '.py'"
_HITS = f"""hits AS (SELECT q.vec_id AS query_no, v.vec_id, v.label, {_DOT} AS score, {_PATH.replace("label", "v.label")} AS path,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, v.vec_id) AS rank
  FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 QUALIFY rank <= 200)"""
_GROUPS = """groups AS (SELECT query_no, path, 0.7 * max(score) + 0.3 * avg(score) FILTER (r <= 3) AS score, count(*) AS evidence_count
  FROM (SELECT *, row_number() OVER (PARTITION BY query_no, path ORDER BY score DESC) AS r FROM hits) GROUP BY ALL)"""

SQL["o1_w1_vector_top_k"] = f"WITH {_HITS} SELECT query_no, vec_id, rank, round(score, 6) AS score FROM hits"
SQL["a1_a2_w2_o2_hybrid_group_score"] = f"""WITH {_HITS}, {_GROUPS}
SELECT query_no, path, round(score, 6) AS score, evidence_count, row_number() OVER (PARTITION BY query_no ORDER BY round(score, 6) DESC, evidence_count DESC, path) AS place FROM groups"""
SQL["a3_o4_group_sum_top_files"] = f"""WITH {_HITS}, s AS (SELECT query_no, path, round(sum(score), 6) AS score FROM hits GROUP BY query_no, path)
SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, path) AS rank FROM s QUALIFY rank <= 5"""
SQL["a4_o3_rank_fusion"] = f"""WITH {_HITS}, {_GROUPS},
r AS (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, evidence_count DESC, path) AS rank FROM groups)
SELECT *, row_number() OVER (ORDER BY support DESC, score DESC, rrf DESC, evidence_count DESC, path) AS place FROM (SELECT path, count(DISTINCT query_no) AS support, sum(evidence_count)::BIGINT AS evidence_count, round(greatest(0, least(1, avg(score))), 6) AS dense_mean,
  round(sum(1.0 / (60 + rank)), 6) AS rrf,
  round(0.6 * count(DISTINCT query_no) / (SELECT count(DISTINCT query_no) FROM groups) + 0.4 * greatest(0, least(1, avg(score))), 6) AS score
FROM r GROUP BY path)"""
SQL["o10_a24_clustered_display"] = f"""WITH {_HITS}, {_GROUPS},
f AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM groups)
SELECT query_no, path, dir, row_number() OVER (PARTITION BY query_no ORDER BY best DESC, lower(dir), lower(path), path) AS place, evidence_count FROM (SELECT *, max(score) OVER (PARTITION BY query_no, dir) AS best FROM f)"""
SQL["p5_p6_filtered_vector_search"] = f"""SELECT q.vec_id AS query_no, v.vec_id, 'src/f' || v.label || '.py' AS path,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, v.vec_id) AS rank, round({_DOT}, 6) AS score
FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 AND v.label % 2 = 0 QUALIFY rank <= 20"""
SQL["w8_diverse_pick"] = f"""WITH {_HITS} SELECT query_no, vec_id, label, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_no, label ORDER BY rank) > 1 AS later FROM hits) QUALIFY row_number() OVER (PARTITION BY query_no ORDER BY later, rank) <= 15"""

SQL["w4_steps"] = """SELECT conv_id, step, count(*) AS n, max(turn) AS last_turn FROM (
  SELECT *, coalesce(sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS step FROM conversations) GROUP BY ALL"""
SQL["w3_next_user_text"] = """SELECT conv_id, turn, substr(sha256(first(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), 1, 8) AS next_user FROM conversations"""
SQL["w11_last_assistant"] = "SELECT conv_id, substr(sha256(max_by(text, turn) FILTER (role = 'assistant')), 1, 8) AS last_hash FROM conversations GROUP BY conv_id"
SQL["w5_first_occurrence"] = "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL"
SQL["t1_t2_streaks_and_repeats"] = """WITH i AS (SELECT *, sum((event_type <> 'error')::INT) OVER w AS island,
    coalesce(event_type = lag(event_type, 1) OVER w AND event_type = lag(event_type, 2) OVER w, false) AS repeat FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, streak, streak >= 2 AS fired, repeat FROM (SELECT *, (sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id))::BIGINT AS streak FROM i)"""
SQL["t3_no_progress"] = """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS new FROM events),
i AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM n)
SELECT event_id, idle, idle >= 4 AS stalled FROM (SELECT *, (sum((NOT new)::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id))::BIGINT AS idle FROM i)"""
SQL["t5_a26_running_tokens"] = """SELECT event_id, (sum(CASE WHEN event_type <> 'error' THEN ceil(value) ELSE floor(value) END) OVER w)::BIGINT AS total_tokens, count(*) OVER w AS calls
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""
SQL["t11_stream_status_counts"] = "SELECT event_type, count(*) AS n FROM events GROUP BY ALL"
SQL["a12_o13_counts_by_status"] = "SELECT CASE WHEN event_type = 'click' THEN 'Unknown' ELSE event_type END AS event_type, count(*) AS n FROM events GROUP BY ALL"
SQL["a25_k8_status_lists"] = "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS ids FROM nation GROUP BY ALL"
SQL["a5_a8_a9_percentiles"] = """SELECT event_type, quantile_disc(floor(value)::BIGINT, 0.5) AS p50, quantile_disc(floor(value)::BIGINT, 0.9) AS p90, round(avg(floor(value)), 6) AS mean,
  round(avg((value >= 1)::INT), 6) AS acc, NULL::DOUBLE AS none FROM events GROUP BY ALL"""


def _windows(size: int, step: int, source: str = "documents") -> str:
    return f"""SELECT doc_id, s AS start_line, least(s + {size}, len(l)) - 1 AS end_line, array_to_string(l[s+1:s+{size}], chr(10)) AS text
  FROM (SELECT doc_id, l, unnest(range(0, len(l), {step})) AS s FROM (
    SELECT doc_id, CASE WHEN text = '' THEN [] WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM {source})))
  WHERE regexp_matches(array_to_string(l[s+1:s+{size}], chr(10)), '\\S')"""


SQL["w7_line_windows"] = f"SELECT doc_id, start_line::INT AS start_line, end_line::INT AS end_line, substr(sha256(text), 1, 8) AS hash FROM ({_windows(12, 8)})"
SQL["f2_f3_hashes"] = "SELECT doc_id, substr(sha256(text), 1, 8) AS short, sha1(text) AS sha1 FROM documents"
SQL["f30_f31_token_overlap"] = """SELECT doc_id, len(t)::INT AS n_tokens, len(list_filter(t, lambda x: contains(lower(lang || '_the_source_' || source), x)))::INT AS overlap
FROM (SELECT doc_id, lang, source, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]+'), lambda x: lower(x))) AS t FROM documents)"""
SQL["f34_previews"] = r"""SELECT doc_id, CASE WHEN length(t) <= 140 THEN t ELSE rtrim(substr(t, 1, 137)) || '...' END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)"""
SQL["f1_levenshtein_parts"] = "SELECT p_partkey, levenshtein(p_type, p_brand)::INT AS distance FROM part"
SQL["f4_f5_p14_names"] = "SELECT c_custkey, 'org_' || lower(c_mktsegment) AS repo, regexp_replace(c_name || ' / v1', '[^A-Za-z0-9._-]+', '_', 'g') AS safe, 'a_b' AS folder FROM customer"
SQL["f8_f11_url_paths"] = r"""SELECT page_id, p AS path, regexp_extract(p, '([^/]*)$', 1) AS name, CASE WHEN contains(p, '/') THEN regexp_extract(p, '^(.*)/[^/]*$', 1) ELSE '.' END AS dir
FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://|[?#].*$', '', 'g'), '/{2,}', '/', 'g') AS p FROM pages)"""
SQL["f12_u5_modules"] = """SELECT p_partkey, array_to_string(list_sort(list_distinct(m), 'ASC'), ',') AS modules FROM (
  SELECT p_partkey, list_transform(range(1, 5), lambda i: 'f' || (p_size % i) || '.py:C' || (p_partkey % i)) AS m FROM part)"""
SQL["f21_f42_json_fields"] = "SELECT event_id, json_valid(props) AS is_json, json_keys(props)[1] AS key, CASE WHEN event_id % 2 = 0 THEN true END AS truth FROM events"
SQL["j1_last_wins"] = "SELECT user_id, event_id, event_type, c_name FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) JOIN customer ON user_id = c_custkey"
SQL["j2_j3_j5_left_lookups"] = "SELECT d.doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
SQL["j4_text_key_join"] = r"""WITH q AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS question FROM documents)
SELECT q.doc_id, r.reference FROM q JOIN (SELECT question, max(doc_id) AS reference FROM q GROUP BY ALL) r ON q.question = r.question WHERE q.question <> ''"""
SQL["j6_j8_u6_resume"] = "SELECT doc_id, lang, doc_id NOT IN (SELECT doc_id FROM labels) AS fresh FROM documents"
_FN = "'C' || (p_size % 7) || '.' || lower(regexp_replace(p_type, '[^A-Za-z]+', '_', 'g'))"
SQL["j9_o6_name_matching"] = f"""
WITH i AS (SELECT DISTINCT 'src/' || lower(p_brand) || '.py' AS file, {_FN} AS qualname FROM part),
q AS (SELECT p_partkey AS query_id, {_FN} AS fn, CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) ELSE '' END AS hint FROM part),
c AS (SELECT q.*, i.*, CASE WHEN fn = qualname THEN 0 ELSE 3 END AS level, CASE WHEN hint <> '' AND contains(file, hint) THEN 3 END AS pr,
    CASE WHEN fn = qualname THEN 0 ELSE 2 END AS priority
  FROM q JOIN i ON split_part(fn, '.', 2) = split_part(qualname, '.', 2)),
k AS (SELECT *, bool_or(pr IS NOT NULL) OVER (PARTITION BY query_id) AS anyp, count(*) OVER (PARTITION BY query_id) AS n FROM c),
s AS (SELECT *, CASE WHEN hint = '' THEN 0 WHEN anyp THEN pr ELSE least(levenshtein(hint, file), levenshtein(hint, substr(file, 5))) END AS far FROM k WHERE hint = '' OR NOT anyp OR pr IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY level, far) AS rank, row_number() OVER (PARTITION BY query_id ORDER BY level, far, priority, file, qualname) AS place FROM s)
SELECT query_id, file, qualname FROM r WHERE (hint = '' OR rank = 1) AND place <= 10"""
_URL = "regexp_replace(url, '^https?://|[?#].*$', '', 'g')"
SQL["j10_hint_join"] = f"""WITH p AS (SELECT DISTINCT {_URL} AS path FROM pages),
h AS (SELECT DISTINCT hint FROM (SELECT regexp_extract(path, '([^/]*)$', 1) AS hint FROM p UNION ALL SELECT split_part(path, '/', 1) FROM p) WHERE hint <> ''),
m AS (SELECT hint, path, lower(trim(hint)) AS h, lower(trim(path)) AS p FROM h, p)
SELECT hint, path, CASE WHEN h = p THEN 0 WHEN ends_with(p, '/' || h) THEN 1 WHEN regexp_extract(p, '([^/]*)$', 1) = h THEN 2 ELSE 3 END AS rank
FROM m WHERE h = p OR regexp_extract(p, '([^/]*)$', 1) = h OR contains(p, h)"""
SQL["j11_u7_path_hits"] = f"""
WITH t AS (SELECT page_id, path, [array_to_string(string_split(path, '/')[-2:], '/'), 'en/7', 'a/b/7'] AS gt, regexp_extract(path, '([^/]*)$', 1) AS b FROM (SELECT page_id, {_URL} AS path FROM pages))
SELECT page_id, path <> '' AND (len(list_filter(gt, lambda g: g = path OR ends_with(g, '/' || path) OR ends_with(path, '/' || g))) > 0
    OR (b <> '' AND len(list_filter(gt, lambda g: regexp_extract(g, '([^/]*)$', 1) = b)) = 1)) AS hit,
  len(list_filter(gt, lambda g: g = 'x/7' OR ends_with(g, '/x/7') OR ends_with('x/7', '/' || g))) > 0
    OR len(list_filter(gt, lambda g: regexp_extract(g, '([^/]*)$', 1) = '7')) = 1 AS ambiguous FROM t"""
SQL["j16_line_entities"] = f"""
WITH b AS ({_windows(10, 7)}), i AS ({_windows(5, 3)}), o AS ({_windows(40, 40)}),
d AS (SELECT doc_id, 'in' || start_line AS qualname, start_line AS a, end_line AS z FROM i UNION ALL SELECT doc_id, 'out' || start_line, start_line, end_line FROM o),
l AS (SELECT doc_id || ':' || start_line AS block_id, doc_id AS path, unnest(range(start_line, end_line + 1)) AS line FROM b)
SELECT DISTINCT block_id, path, qualname FROM (
  SELECT block_id, path, line, qualname, row_number() OVER (PARTITION BY block_id, line ORDER BY a DESC, z ASC, qualname DESC) AS r FROM l JOIN d ON d.doc_id = l.path AND line BETWEEN a AND z) WHERE r = 1"""
SQL["j19_j20_inverted_edges"] = "SELECT callee, string_agg(caller::VARCHAR, ',' ORDER BY caller) AS callers FROM (SELECT DISTINCT l_partkey % 50 AS callee, l_suppkey % 20 AS caller FROM lineitem) GROUP BY ALL"
SQL["p1_p2_filters"] = "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE regexp_matches(c_mktsegment, '^(AUTO|BUILD|MACH)|HOLD') AND regexp_matches(c_name, '^(?:Customer.*[13579])')"
SQL["p3_slice"] = """SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) WHERE i >= 10 AND i < n - 20 AND (i - 10) % 3 = 0"""
SQL["p10_p11_without_tests"] = """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'tests/x.py' ELSE 'pkg/tests/y.py' END || ',test_z.py' ELSE 'src/a' || (p_size % 3) || '.py' END AS files, p_partkey % 5 = 0 AS fallback FROM part"""
SQL["k3_upsert"] = "SELECT doc_id, coalesce('q' || quality, lang) AS lang FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) <> 1"
SQL["u1_u2_recall"] = """WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), d AS (SELECT doc_id, w[1:len(w) - len(w) // 3] AS gt, w[len(w) // 3 + 1:] AS f FROM w)
SELECT doc_id, len(list_intersect(gt, f))::INT AS hits, round(len(list_intersect(gt, f[1:1])) / len(list_distinct(gt)), 6) AS r1, round(len(list_intersect(gt, f[1:3])) / len(list_distinct(gt)), 6) AS r3,
  round(len(list_intersect(gt, f)) / len(list_distinct(gt)), 6) AS rall, len(list_intersect(gt, f)) > 0 AS hit FROM d"""

_ITEM = "'p' || (l_partkey % 7) || '.py:f' || (l_suppkey % 5)"
_RUNS = f"""runs AS (SELECT l_orderkey, sum(l_quantity)::BIGINT AS steps,
    coalesce(list({_ITEM} ORDER BY l_linenumber) FILTER (l_linenumber <= 2), []) AS edit, coalesce(list({_ITEM} ORDER BY l_linenumber) FILTER (l_linenumber = 3), []) AS added,
    coalesce(list({_ITEM} ORDER BY l_linenumber, {_ITEM}) FILTER (l_linenumber >= 2), []) AS found FROM lineitem GROUP BY l_orderkey),
g AS (SELECT *, list_distinct(edit) AS e, list_distinct(added) AS a, list_distinct(edit || added) AS b, list_distinct(list_transform(edit || added, lambda x: split_part(x, ':', 1))) AS gf,
    list_distinct(list_transform(found, lambda x: split_part(x, ':', 1))) AS ff FROM runs),
m AS (SELECT *, len(gf) AS nf, len(b) AS nb, len(list_intersect(gf, ff)) AS hf, len(list_intersect(b, found)) AS hb,
    CASE WHEN len(b) > 0 THEN len(list_intersect(b, found[1:1])) / len(b) ELSE 0 END AS r1, CASE WHEN len(b) > 0 THEN len(list_intersect(b, found[1:3])) / len(b) ELSE 0 END AS r3,
    CASE WHEN len(b) > 0 THEN len(list_intersect(b, found[1:5])) / len(b) ELSE 0 END AS r5, CASE WHEN len(b) > 0 THEN len(list_intersect(b, found)) / len(b) ELSE 0 END AS rall,
    CASE WHEN len(gf) > 0 THEN len(list_intersect(gf, ff)) / len(gf) ELSE 0 END AS fall,
    CASE WHEN len(e) > 0 THEN len(list_intersect(e, found)) / len(e) END AS eall, CASE WHEN len(e) > 0 THEN len(list_intersect(e, found[1:1])) / len(e) END AS e1,
    CASE WHEN len(a) > 0 THEN len(list_intersect(a, found)) / len(a) END AS aall FROM g)"""
SQL["m1_m2_u3_metric_vector"] = f"""WITH {_RUNS} SELECT l_orderkey, hf > 0 OR hb > 0 AS correct, nf::INT AS gt_file_count_all, nb::INT AS gt_function_count_all, round(r3, 6) AS entity_recall_at_3,
  round(fall, 6) AS file_recall_all, round(aall, 6) AS added_function_recall_all, eall >= 1 AS edit_function_acc_all FROM m"""
SQL["a13_run_summary"] = f"""WITH {_RUNS} SELECT count(*) AS total_instances, count(*) FILTER (hf > 0 OR hb > 0) AS success_count, quantile_disc(steps, 0.5) AS p50_steps, quantile_disc(steps, 0.9) AS p90_steps,
  count(*) FILTER (len(a) > 0) AS added_eval_count, round(avg((hf > 0 OR hb > 0)::INT), 6) AS pass_rate, round(avg((r1 >= 1)::INT), 6) AS function_acc_at_1, round(avg(r5), 6) AS function_recall_at_5,
  round(avg(eall), 6) AS edit_function_recall_all, round(avg((aall >= 1)::INT), 6) AS added_function_acc_all, round(avg(steps), 6) AS avg_steps, round(avg((steps % 4 <= 2)::INT), 6) AS under_two_functions_submission_rate FROM m"""
SQL["a16_overlapping_buckets"] = f"""WITH {_RUNS},
x AS (SELECT *, unnest(list_filter([CASE WHEN nf = 1 THEN 'single_file' END, CASE WHEN nf >= 2 THEN 'multi_file' END, CASE WHEN nb = 1 THEN 'func_count_1' END, CASE WHEN nb = 2 THEN 'func_count_2' END,
  CASE WHEN nb = 3 THEN 'func_count_3' END, CASE WHEN nb >= 4 THEN 'func_count_4_plus' END, CASE WHEN len(a) > 0 THEN 'has_added_functions' ELSE 'no_added_functions' END], lambda v: v IS NOT NULL)) AS bucket FROM m)
SELECT bucket, count(*) AS count, round(avg((hf > 0 OR hb > 0)::INT), 6) AS pass_rate, round(avg(rall), 6) AS function_recall_all, round(avg((e1 >= 1)::INT), 6) AS edit_function_acc_at_1,
  round(avg(aall), 6) AS added_function_recall_all, round(avg(steps), 6) AS avg_steps FROM x GROUP BY bucket"""
SQL["a14_radar_statistics"] = """WITH e AS (SELECT event_id AS i, event_type = 'purchase' AS ok, event_id % 3 AS calls, event_id % 5 AS blocked FROM events)
SELECT count(*) FILTER (i % 2 = 0) AS radar_called_count, count(*) FILTER (i % 8 = 0) AS anti_laziness_compliant_count, sum(blocked)::BIGINT AS blocked_submission_count,
  round(count(*) FILTER (i % 6 = 0) / count(*) FILTER (i % 2 = 0), 6) AS verification_compliance_rate, round(count(*) FILTER (i % 2 = 0 AND blocked > 0) / count(*) FILTER (i % 2 = 0), 6) AS premature_submit_rate,
  round(count(*) FILTER (i % 2 = 0 AND calls = 1) / count(*) FILTER (i % 2 = 0), 6) AS single_radar_call_rate,
  round(avg(ok::INT) FILTER (i % 2 = 0 AND calls >= 2) - avg(ok::INT) FILTER (i % 2 = 0 AND calls = 1), 6) AS second_radar_call_success_delta, round(10 * count(*) / sum(calls), 6) AS avg_tool_output_chars FROM e"""
SQL["a15_oracle_statistics"] = """WITH e AS (SELECT event_id AS i FROM events WHERE event_id % 3 = 0)
SELECT count(*) AS oracle_instance_count, count(*) FILTER (i % 2 = 0) AS oracle_file_provided_count, count(*) FILTER (i % 9 = 0) AS steps_to_success_in_oracle_count,
  quantile_disc(i % 11, 0.9) FILTER (i % 9 = 0) AS steps_to_success_in_oracle_p90,
  round(count(*) FILTER (i % 2 = 0 AND CASE WHEN i % 5 = 0 THEN i % 10 = 0 ELSE i % 4 = 0 END) / count(*) FILTER (i % 2 = 0), 6) AS oracle_verification_compliance_rate,
  round(count(*) FILTER (i % 14 = 0) / count(*) FILTER (i % 2 = 0), 6) AS entity_hit_rate_given_oracle_file FROM e"""
_SCORES = """s AS (SELECT *, (d0 + d1 + d2 + d3 + d4) / 5 AS score_avg, d0 * (2.0::DOUBLE / 3) + d3 * (1.0::DOUBLE / 3) AS weighted_score FROM (
  SELECT p_brand AS category, CASE WHEN p_size > 25 THEN 'hard' WHEN p_size > 5 THEN 'easy' END AS difficulty, p_partkey * 3 % 11 AS d0, p_partkey * 4 % 11 AS d1, p_partkey * 5 % 11 AS d2, p_partkey * 6 % 11 AS d3, p_partkey * 7 % 11 AS d4 FROM part))"""
SQL["a17_f20_qa_groups"] = f"""WITH {_SCORES}, u AS (SELECT 'category' AS dimension, category AS label, * FROM s UNION ALL SELECT 'difficulty', difficulty, * FROM s)
SELECT dimension, label, count(*) AS n, round(avg((score_avg >= 5)::INT), 6) AS pass_rate, round(avg(score_avg), 6) AS mean_score, round(avg(weighted_score), 6) AS mean_weighted FROM u WHERE label IS NOT NULL GROUP BY ALL"""
SQL["a18_qa_overall"] = f"WITH {_SCORES} SELECT count(*) AS n, round(avg((score_avg >= 5)::INT), 6) AS pass_rate, round(avg(score_avg), 6) AS mean_score, round(avg(weighted_score), 6) AS mean_weighted, round(avg(d3), 6) AS mean_clarity FROM s"
SQL["a10_judge_rounds"] = "SELECT l_partkey::VARCHAR AS question_hash, " + ", ".join(f"median((l_orderkey * {i + 2} + l_linenumber) % 11)::DOUBLE AS {d}" for i, d in enumerate(("correctness", "completeness", "relevance", "clarity", "reasoning"))) + " FROM lineitem GROUP BY ALL"
SQL["f17_parsed_scores"] = "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 AND p_size % 13 <= 10 THEN p_size % 13 END::INT AS correctness, CASE WHEN p_partkey % 7 <> 0 AND p_size % 13 <= 10 THEN 5 END::INT AS completeness FROM part"
SQL["a20_a21_uplift"] = """WITH r AS (SELECT n_chars > 1500 AS used, quality = 1 AS ok, toxic AS t FROM documents JOIN labels USING (doc_id)),
x AS (SELECT count(*) AS total, count(*) FILTER (used) AS used, (2 * count(*) FILTER (used))::BIGINT AS calls, count(*) FILTER (used) / count(*) AS usage_rate, sum(t) FILTER (used) / (2 * count(*) FILTER (used)) AS call_hit_rate,
  count(*) FILTER (used AND t > 0) / count(*) FILTER (used) AS instance_hit_rate, avg(ok::INT) FILTER (used) AS a, avg(ok::INT) FILTER (NOT used) AS b FROM r)
SELECT total, used, calls, round(usage_rate, 6) AS usage_rate, round(call_hit_rate, 6) AS call_hit_rate, round(instance_hit_rate, 6) AS instance_hit_rate, round(a, 6) AS accuracy_used, round(b, 6) AS accuracy_not_used,
  round((a - b) * 100, 6) AS uplift_points, round((a - b) / b * 100, 6) AS uplift_percent FROM x"""
SQL["a22_symbol_scope"] = """WITH l AS (SELECT l_suppkey % 5 AS file, CASE WHEN l_linenumber > 2 THEN 'method' ELSE 'function' END AS kind, 'C' || (l_partkey % 9) AS c FROM lineitem),
t AS (SELECT file, string_agg(c, ',' ORDER BY n DESC, c) AS top FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, c) AS r FROM (SELECT file, c, count(*) AS n FROM l WHERE kind = 'method' GROUP BY file, c)) WHERE r <= 2 GROUP BY file)
SELECT file, kind, count(*) AS n, any_value(top) AS top FROM l LEFT JOIN t USING (file) GROUP BY file, kind"""
SQL["f38_f37_usage"] = """SELECT l_orderkey, l_linenumber, l_partkey AS prompt, l_suppkey AS completion, l_partkey + l_suppkey AS total FROM lineitem"""
SQL["f43_unit_vectors"] = "SELECT vec_id, 1.0::DOUBLE AS norm, round(e[1] / sqrt(list_dot_product(e, e)), 5) AS first FROM (SELECT vec_id, list_transform(embedding, lambda x: (x * 3::FLOAT)::FLOAT)::DOUBLE[] AS e FROM embeddings)"

SQL["a19_macro_recall"] = f"WITH {_RUNS} SELECT round(avg(rall), 6) AS recall, count(*) AS n FROM m"
SQL["a23_u4_distinct_and_remaining"] = f"WITH {_RUNS} SELECT l_orderkey, len(list_distinct(found))::INT AS distinct_names, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(found, x))), ',') AS remaining FROM m"
SQL["f32_f33_ranks"] = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 3 ELSE 4 END AS level, CASE p_partkey % 4 WHEN 0 THEN 2 ELSE 0 END AS distance,
  CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1 END AS hint FROM part"""
SQL["j12_j13_j15_hints"] = f"""
WITH t AS (SELECT page_id, path, CASE page_id % 3 WHEN 0 THEN array_to_string(string_split(path, '/')[-2:], '/') WHEN 1 THEN 'auth.py' ELSE 'nowhere.py' END AS h, regexp_extract(path, '([^/]*)$', 1) AS b FROM (SELECT page_id, {_URL} AS path FROM pages))
SELECT page_id, CASE page_id % 3 WHEN 0 THEN h <> '' WHEN 1 THEN true ELSE contains(path, 'nowhere.py') END AS observed,
  page_id % 3 = 0 AND h <> '' AS inspected,
  CASE WHEN page_id % 3 = 0 AND h <> '' AND NOT starts_with(h, '/') AND (h = path OR ends_with(path, '/' || h)) THEN path END AS resolved FROM t"""
SQL["j17_graph_nodes"] = """SELECT DISTINCT node_id, CASE WHEN ends_with(node_id, '1') THEN 'class' ELSE 'function' END AS type FROM
  (SELECT DISTINCT 'p' || (l_partkey % 40) || ':' || l_linenumber AS node_id FROM lineitem) JOIN (SELECT DISTINCT 'p' || (l_suppkey % 30) || ':' || (l_linenumber % 4) AS node_id FROM lineitem) USING (node_id)"""
SQL["p9_valid_instances"] = "SELECT doc_id::VARCHAR AS instance_id, source AS repo FROM documents WHERE source NOT LIKE '%1'"
SQL["p7_p15_pick_by_ordinal"] = "SELECT n_name, n_regionkey FROM nation ORDER BY n_name LIMIT 1 OFFSET 3"
SQL["o5_o7_o12_ties_caps_and_order"] = """SELECT entity FROM (SELECT p_brand || ':' || p_type AS entity, min((p_size, p_partkey % 3, p_type)) AS place FROM part GROUP BY ALL) ORDER BY place, entity LIMIT 50"""
SQL["v2_index_reasons"] = """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'meta_missing' WHEN p_partkey % 11 = 0 THEN 'repo_dir_mismatch' WHEN p_partkey % 5 = 0 THEN 'base_commit_missing' WHEN p_partkey % 5 = 1 THEN 'base_commit_mismatch'
    WHEN p_size % 2 <> 0 THEN 'chunk_params_invalid' WHEN p_partkey % 13 = 0 THEN 'chunk_params_mismatch' END AS strict,
  CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN 'repo_dir_mismatch' WHEN p_size % 2 <> 0 THEN 'chunk_params_invalid' WHEN p_partkey % 13 = 0 THEN 'chunk_params_mismatch' END AS static FROM part"""
SQL["f16_f18_f19_answers"] = """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN '{"answer": 5}' ELSE trim(p_name) END AS answer, p_brand AS fenced, p_brand || chr(10) || p_type AS joined FROM part"""
SQL["f23_f28_paths_in_output"] = """SELECT p_partkey, 'src/f' || p_partkey || '.py,src/g.py' AS diff, 'src/a' || p_partkey || '.py,bin/' || p_partkey || ',src/b.py' AS grep,
  'src/a' || p_partkey || '.py,no colon,Binary file bin/' || p_partkey || ' matches,src/b.py' AS tracked FROM part"""
SQL["w6_w10_recent_ids"] = "SELECT event_type, CASE WHEN length(l) > 55 THEN substr(l, 1, 52) || '...' ELSE rpad(l, 55, ' ') END AS recent FROM (SELECT event_type, string_agg(event_id::VARCHAR, ', ' ORDER BY event_id DESC) AS l FROM events GROUP BY ALL)"

SQL["m3_f14_f15_outputs"] = """WITH k AS (SELECT p_partkey, p_partkey % 5 AS k, p_partkey::VARCHAR AS n FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN './src/a.py,b' || n || '.py' WHEN 1 THEN 'a.py,b.py' WHEN 2 THEN 'one' || n || '.py' WHEN 3 THEN '' ELSE 'q.py' END AS found_files,
  CASE k WHEN 1 THEN 'x' || n || '.py:C.m,x.py:f,none' WHEN 4 THEN 'q.py:k' ELSE '' END AS found_entities, CASE k WHEN 1 THEN 'x' || n || '.py:C,x.py:f' WHEN 4 THEN 'm' ELSE '' END AS found_modules,
  CASE k WHEN 0 THEN '{"functions": [{"function": "C.f' || n || '", "file_hint": "./src/a.py"}, {"name": "g", "file": "b' || n || '.py"}, {"func": ""}, "h"]}'
    WHEN 1 THEN '{"found_files": ["a.py", " b.py", "a.py"], "entities": ["x' || n || '.py:C.m", "x.py:f", "none"]}' WHEN 2 THEN '{"files": "one' || n || '.py", "found_entities": []}'
    WHEN 3 THEN 'nothing ' || n ELSE '{"functions": "' || n || '", "found_modules": ["m"], "found_entities": ["q.py:k"]}' END AS raw_output,
  CASE k WHEN 0 THEN 3 WHEN 4 THEN 1 END::INT AS submitted_function_count, CASE k WHEN 0 THEN 3 WHEN 4 THEN 1 END::INT AS submitted_unique_function_count,
  CASE k WHEN 0 THEN 2 WHEN 4 THEN 0 END::INT AS submitted_file_hint_count, CASE k WHEN 0 THEN 1 WHEN 4 THEN 0 END::INT AS submitted_qualified_function_count,
  round(CASE k WHEN 0 THEN 1.0 / 3 WHEN 4 THEN 0 END, 6)::DOUBLE AS ratio, k IN (0, 4) AS has_functions FROM k"""
SQL["f40_f44_hints_and_fallbacks"] = """WITH k AS (SELECT p_partkey, p_partkey % 5 AS k, p_partkey::VARCHAR AS n FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'src/a.py' WHEN 1 THEN 'a.py,b.py,x' || n || '.py,x.py' WHEN 4 THEN 'q.py' ELSE '' END AS hints,
  CASE WHEN p_partkey % 6 <> 0 THEN 'given' WHEN k = 0 THEN '{"functions":[{"function":"C.f' || n || '","file_hint":"./src/a.py"},{"name":"g","file":"b' || n || '.py"},{"func":""},"h"]}'
    WHEN k = 1 THEN '{"found_files":["a.py","b.py","a.py"],"entities":["x' || n || '.py:C.m","x.py:f","none"]}' WHEN k = 2 THEN '{"files":"one' || n || '.py","found_entities":[]}'
    WHEN k = 3 THEN '{"found_files":[]}' ELSE '{"functions":"' || n || '","found_modules":["m"],"found_entities":["q.py:k"]}' END AS located,
  CASE WHEN p_partkey % 3 = 2 THEN '' WHEN p_partkey % 6 = 0 THEN 'said' ELSE 'given' END AS answer FROM k"""
_SYMBOLS = """s AS (SELECT p_brand, lower(replace(p_name, ' ', '_')) || '_' || p_partkey AS name, ['class', 'function', 'method', 'constant'][p_size % 4 + 1] AS kind, p_size AS start, (p_size + p_partkey % 9 - 2)::INT AS stop FROM part)"""
SQL["o8_symbol_order"] = f"""WITH {_SYMBOLS} SELECT p_brand, name, row_number() OVER (PARTITION BY p_brand ORDER BY
    len(list_filter(['find', 'small', 'part', 'in', 'name_1', 'of', 'them'], lambda t: contains(name, t))) DESC, CASE kind WHEN 'class' THEN 4 WHEN 'function' THEN 3 WHEN 'method' THEN 2 ELSE 1 END DESC,
    greatest(0, stop - start) DESC, start, name) AS place FROM s QUALIFY place <= 12"""
SQL["o9_listed_symbols"] = f"WITH {_SYMBOLS} SELECT p_brand, name, start, row_number() OVER (PARTITION BY p_brand ORDER BY start, name) AS place FROM s QUALIFY place <= 20"
SQL["o11_dependencies"] = """WITH e AS (SELECT DISTINCT 'S' || (l_suppkey % 40) AS source, 't' || (l_partkey % 97) AS target FROM lineitem WHERE l_linenumber <= 1 + l_suppkey % 3),
d AS (SELECT source, list(target ORDER BY target) AS t FROM e GROUP BY source)
SELECT source, array_to_string(t[1:6], ',') AS shown, greatest(0, len(t) - 6)::INT AS more FROM d ORDER BY len(t) DESC, lower(source), source LIMIT 12"""
SQL["p8_record_meta"] = """SELECT doc_id, '{"repo":' || coalesce('"' || source || '"', 'null') || ',"patch":' || CASE WHEN lang = 'en' OR lang IS NULL THEN 'null' ELSE '"' || lang || '"' END || '}' AS meta FROM documents"""
SQL["p12_existing_candidates"] = """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN './src/f' WHEN 1 THEN 'src//f' ELSE 'src/../src/f' END || p_partkey || '.py' AS path FROM part
WHERE p_partkey % 7 <> 0 AND p_partkey % 2 = 0 AND p_partkey // 2 IN (SELECT p_partkey FROM part)"""
SQL["a27_spent"] = "SELECT sum(floor(value)) AS cost, count(*) AS n_calls, sum(floor(value)) > 1 OR count(*) + 1 > 1000000000 AS over FROM events"
SQL["f39_token_estimate"] = r"""SELECT conv_id, (3 + sum(3 + len(regexp_extract_all(role, '[^ \t\n]+')) + len(regexp_extract_all(text, '[^ \t\n]+')) + CASE WHEN turn % 2 = 0 THEN 0 ELSE 1 END))::INT AS prompt,
  len(regexp_extract_all(max(role), '[^ \t\n]+'))::INT AS completion, (3 + sum(3 + len(regexp_extract_all(role, '[^ \t\n]+')) + len(regexp_extract_all(text, '[^ \t\n]+')) + CASE WHEN turn % 2 = 0 THEN 0 ELSE 1 END) + len(regexp_extract_all(max(role), '[^ \t\n]+')))::INT AS total
FROM conversations GROUP BY conv_id"""
