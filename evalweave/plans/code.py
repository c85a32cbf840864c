"""Queries over source files that are made from the tables, with their SQL.

A file holds a customer's orders as classes and their lines as functions, structs, imports and unbalanced braces,
so that its length follows the table. The SQL makes the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.functions import text
from evalweave.operators import builds, judging, ranking, skeletons, tracking
from evalweave.plans.queries import scratch
from evalweave.sources import files as sources
from evalweave.sources import records, trajectory_sink
from evalweave.streaming import sessions as streams
from evalweave.streaming import tracking as live

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Lines that an order line makes, by its number; NAME is put in.
FORMS = (
    ("  function NAME(a, b) {", "    if (a) { b(); }", "  }"),
    ("  struct NAME", "  {", "    int x; } y;"),
    ("  public static int NAME(int a) {", "    return a; }}"),
    ("  fn NAME() -> u8 { {", "  // open"),
    ("const NAME = require('NAME');", "from a.b import NAME"),
    ("async def NAME(self):", "", "  }"),
)


def query(f):
    QUERIES[f.__name__] = f
    return f


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a file for each customer with orders; every tenth is named .py and doesn't parse."""
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    name = F.concat(F.lower("l_returnflag"), F.lit("_"), F.col("l_partkey") % 50)
    form = F.element_at(F.array(*[F.lit("\n".join(f)) for f in FORMS]), ((F.col("l_orderkey") + F.col("l_linenumber")) % 6 + 1).cast("int"))
    made = lines.select("l_orderkey", F.struct("l_linenumber", F.replace(form, F.lit("NAME"), name).alias("text")).alias("x")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x"))
    body = orders.join(made, orders.o_orderkey == made.l_orderkey, "left")
    head = F.concat(F.lit("import o"), F.col("o_orderkey"), F.lit("\nexport class Order"), F.col("o_orderkey"), F.lit(" {"))
    whole = F.array_join(F.concat(F.array(head), F.coalesce(F.col("x.text"), F.array().cast("array<string>")), F.array(F.lit("}"))), "\n")
    per = body.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(F.struct("o_orderkey", whole.alias("text")))).text, "\n").alias("content"))
    path = F.concat(F.lit("src/c"), F.col("o_custkey"), F.when(F.col("o_custkey") % 10 == 0, ".py").otherwise(".js"))
    return per.select(path.alias("path"), "content")


def written(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """A table in the shared folder: what reads it several times makes it once."""
    out = scratch(spark, label)
    df.write.parquet(out)
    return spark.read.schema(df.schema).parquet(out)


@query
def x6_line_symbols(spark, sf_dir):
    """Symbols and imports of all files, by their lines."""
    symbols, imports = skeletons.line_symbols(code_files(spark, sf_dir))
    found = symbols.select("path", "kind", "name", "start", "stop", "signature")
    return found.unionByName(imports.select("path", F.lit("import").alias("kind"), F.lit("").alias("name"), F.col("line").alias("start"), F.col("line").alias("stop"), F.col("text").alias("signature")))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation asks for its customers, those with most orders first; 7 of 8 names are files, the others missing."""
    orders, customers = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    n = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_distinct("o_orderpriority").alias("evidence_count"))
    no, nation = F.col("c_custkey"), F.col("c_nationkey")
    path = F.when(no % 8 == 3, F.concat(F.lit("gone/c"), no)).otherwise(F.concat(F.lit("src/c"), no, F.when(no % 10 == 0, ".py").otherwise(".js")))
    asked = F.when(nation % 5 == 0, "zzz 42").otherwise(F.concat(F.lit("look at Order"), nation * 7, F.lit(" and n_"), nation, F.lit(" r_1 7up")))
    rows = customers.join(n, "c_custkey").select(nation.alias("query_id"), asked.alias("query"), path.alias("path"), (F.col("n") / 100).alias("score"), "evidence_count", (-1000000 * F.col("n") + no).alias("rank"))
    return rows


@query
def x8_skeletons(spark, sf_dir):
    """What is shown of each nation's first five files within 600 characters."""
    files = written(spark, code_files(spark, sf_dir), "files")
    ranked = _ranked(spark, sf_dir)
    wanted = files.join(ranked.select("path").distinct(), "path", "left_semi")
    symbols, imports = skeletons.skeletons(wanted)
    out = skeletons.assembled(ranked, symbols, imports, files, topn=5, budget_chars=600)
    anchor = F.concat_ws(":", "primary_anchor.name", "primary_anchor.kind", "primary_anchor.start", "primary_anchor.stop")
    return out.withColumn("primary_anchor", anchor)


def _reads(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    """Events as shell lines with outputs, and the files that they read: src/f0 to f96, and lib/ with even numbers."""
    no, few = F.col("event_id") % 97, F.col("event_id") % 5
    f = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    line = (
        F.when(F.col("event_type") == "view", f("cat src/f", no, ".py | grep -n -e foo ./src/../src/f", few, ".py"))
        .when(F.col("event_type") == "click", f("head -n 5 /work/src/f", no, ".py && ls src/f1.py ; tail - ../src/f2.py"))
        .when(F.col("event_type") == "error", 'cat "unclosed')
        .otherwise("rg -g *.py foo")
    )
    shown = f("src/f", no + 1, ".py:3:foo\nnothing here\n\n/repo/lib/f", few, ".py:1:x\nsrc/f", no, ".py")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey < 97").select((F.col("p_partkey")).alias("n"))
    files = part.select(f("src/f", F.col("n"), ".py").alias("path")).unionByName(part.where("n % 2 = 0").select(f("lib/f", F.col("n"), ".py").alias("path")))
    return tracking.reads(events.withColumn("line", line).withColumn("shown", shown), files, "user_id", "event_id", "line", "shown", ("/repo", "/work"))


@query
def t12_read_tracker(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return tracking.tracked(_reads(spark, sf_dir, events), "user_id", "event_id")


@query
def t12_read_tracker_stream(spark, sf_dir):
    """The same as a stream over the table, drained."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    base = scratch(spark, "stream")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    streams.drained(live.tracked(_reads(spark, sf_dir, stream), "user_id", "event_id"), f"{base}/checkpoint", f"{base}/out")
    return spark.read.parquet(f"{base}/out")


@query
def s4_bad_records(spark, sf_dir):
    """Documents written as lines, a file a source, some of them broken; the first bad line of each file."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("source is not null")
    no = F.col("doc_id")
    good = F.to_json(F.struct("doc_id", "lang", "n_chars", "text"))
    line = (
        F.when((no % 41 == 40) & (F.length("source") > 4), F.concat(F.lit('{"a": "'), F.unhex(F.lit("FF")).cast("string"), F.lit('"}')))
        .when((no % 37 == 36) & (F.col("source") != "src7"), F.substring(good, 1, 12)).when(no % 11 == 3, "  ").when(no % 11 == 4, '{"a": NaN, "a": 1}').otherwise(good)
    )
    out = scratch(spark, "lines")
    docs.select("source", "doc_id", line.alias("value")).repartition("source").sortWithinPartitions("source", "doc_id").drop("doc_id").write.partitionBy("source").text(out)
    found = records.bad_records(spark, out, lines=(".txt",), whole=())
    return found.select(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source"), "error_type", "line")


@query
def v3_k10_index_build(spark, sf_dir):
    """Two builds of the indexes of eight repositories: one has no files, one gets its commit late, one changes it."""
    files = written(spark, code_files(spark, sf_dir).withColumn("repo", F.concat(F.lit("r"), F.regexp_extract("path", "[0-9]+", 0).cast("long") % 7)), "files")
    no = F.col("id")
    repos = spark.range(8).select(F.concat(F.lit("r"), no).alias("repo"), F.when(no != 6, F.concat(F.lit("1234567-"), no)).alias("one"), F.concat(F.when(no == 2, "abcdefgh-").otherwise("1234567-"), no).alias("two"))
    spec = {"index_version": "v1", "embedding_provider": "hash", "embedding_model": "tokens/64", "chunker": "lines", "chunk_size": "20", "overlap": "5"}
    table = builds.IndexTable(spark, scratch(spark, "indexes"), spec, lambda c: ranking.hash_embedding(c, 8))
    first = table.build(repos.select("repo", F.col("one").alias("base_commit")), files).withColumn("run", F.lit(1))
    first = spark.createDataFrame(first.collect(), first.schema)  # eight rows, as of the first build
    second = table.build(repos.select("repo", F.col("two").alias("base_commit")), files).withColumn("run", F.lit(2))
    return first.unionByName(second)


@query
def k9_s11_trajectory_files(spark, sf_dir):
    """Conversations written as a file each and read back."""
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    infos = said.groupBy("conv_id").agg(F.count("*").alias("api_calls"), F.lit("Submitted").alias("exit_status"))
    out = scratch(spark, "trajectories")
    trajectory_sink.save(trajectory_sink.sessions(said, infos, "conv_id", "turn", "role", "text"), out)
    back = sources.trajectories(spark, out)
    return back.select(F.col("instance_id").cast("long").alias("conv_id"), "pos", "role", text.short_hash(F.col("content")).alias("content"))


def _recorded_judge():
    """A judge that answers from recorded numbers, fails on some calls and answers without scores on others."""

    def answer(question: str, reference: str, candidate: str, round_no: int) -> str:
        n = int(question.split()[1]) * 3 + round_no
        if n % 7 == 0:
            raise TimeoutError
        names = ("correctness", "completeness", "relevance", "clarity", "reasoning")
        marks = ", ".join(f'"{d}": {(n * (i + 2) + len(candidate)) % 11}' for i, d in enumerate(names))
        return "no scores" if n % 5 == 0 else "```json\n{" + marks + "}\n```"

    return answer


@query
def x9_a10_judge_rounds(spark, sf_dir):
    """Documents judged in three rounds, those with a label apart as done before."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    records = docs.select(F.col("doc_id").alias("question_hash"), F.concat(F.lit(" doc "), F.col("doc_id")).alias("question"), F.col("lang").alias("reference"), F.col("text").alias("candidate"))
    answered = judging.rounds(records, _recorded_judge, 3, labels.select(F.col("doc_id").alias("question_hash")))
    out = judging.scored(answered, weights={"correctness": 2.0, "clarity": 1.0})
    return out.withColumns({c: F.round(c, 6) for c in ("score_avg", "weighted_score")})


@query
def s7_scoped_catalog(spark, sf_dir):
    """Runs written below answers/<model>/<method>/<run>, the catalog of one method and that of all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("source is not null and lang is not null")
    out = scratch(spark, "results")
    for lang in ("en", "de"):
        rows = docs.where(F.col("lang") == lang).select("doc_id", F.concat(F.lit("run"), F.col("doc_id") % 3).alias("run"))
        for run in range(3):
            rows.where(F.col("run") == f"run{run}").select(F.to_json(F.struct("doc_id")).alias("value")).coalesce(1).write.text(f"{out}/answers/m-{lang}/tools/run{run}")
    found = []
    for given in (out, f"{out}/answers/m-en", f"{out}/answers/m-de/tools/run1", f"{out}/answers/m-fr"):
        root, scope = sources.answers_scope(given)
        rows = sources.catalog(spark, root, scope, "*.txt")
        found.append(rows.select(F.lit("/".join(scope)).alias("scope"), "model", "method", "run_id").distinct())
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


SQL["x9_a10_judge_rounds"] = """
WITH r AS (
  SELECT doc_id, doc_id * 3 + round AS n, length(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS c
  FROM documents CROSS JOIN (SELECT unnest([1, 2, 3]) AS round) x
  WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND coalesce(lang, '') <> '' AND trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
s AS (SELECT doc_id AS question_hash, count(*) AS rounds_scored, median((n * 2 + c) % 11)::DOUBLE AS correctness, median((n * 3 + c) % 11)::DOUBLE AS completeness, median((n * 4 + c) % 11)::DOUBLE AS relevance,
             median((n * 5 + c) % 11)::DOUBLE AS clarity, median((n * 6 + c) % 11)::DOUBLE AS reasoning FROM r WHERE n % 7 <> 0 AND n % 5 <> 0 GROUP BY doc_id)
SELECT *, correctness + completeness + relevance + clarity + reasoning AS total_score, round((correctness + completeness + relevance + clarity + reasoning) / 5, 6) AS score_avg,
       round(correctness * 2 / 3 + clarity / 3, 6) AS weighted_score, correctness * (2.0::DOUBLE / 3) + clarity * (1.0::DOUBLE / 3) >= 6 AS pass FROM s
"""
SQL["s7_scoped_catalog"] = """
WITH r AS (SELECT DISTINCT 'm-' || lang AS model, 'tools' AS method, 'run' || (doc_id % 3) AS run_id FROM documents WHERE lang IN ('en', 'de') AND source IS NOT NULL)
SELECT '' AS scope, * FROM r UNION ALL SELECT 'm-en', * FROM r WHERE model = 'm-en' UNION ALL SELECT 'm-de/tools/run1', * FROM r WHERE model = 'm-de' AND run_id = 'run1'
"""

SQL["t12_read_tracker"] = SQL["t12_read_tracker_stream"] = """
WITH e AS (SELECT user_id, event_id, event_type, event_id % 97 AS k, event_id % 5 AS u FROM events),
r AS (
  SELECT user_id, event_id, unnest(p) AS path, unnest(range(len(p))) AS pos
  FROM (SELECT *, CASE event_type WHEN 'view' THEN ['src/f' || k, 'src/f' || u, 'src/f' || (k + 1), 'lib/f' || u, 'src/f' || k] WHEN 'click' THEN ['src/f' || k] WHEN 'error' THEN []
                       ELSE ['src/f' || (k + 1), 'lib/f' || u, 'src/f' || k] END AS p FROM e)),
files AS (SELECT 'src/f' || p_partkey AS path FROM part WHERE p_partkey < 97 UNION SELECT 'lib/f' || p_partkey FROM part WHERE p_partkey < 97 AND p_partkey % 2 = 0),
f AS (SELECT user_id, path, min({'e': event_id, 'p': pos}) AS x FROM r SEMI JOIN files USING (path) GROUP BY user_id, path),
n AS (SELECT user_id, x.e AS event_id, path, row_number() OVER (PARTITION BY user_id ORDER BY x.e, x.p) AS place FROM f)
SELECT user_id, event_id, place::INTEGER AS place, CASE WHEN place > 50 THEN '<<TRUNCATED>>' ELSE path || '.py' END AS path FROM n WHERE place <= 51
"""
SQL["s4_bad_records"] = """
WITH d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS line FROM documents WHERE source IS NOT NULL),
b AS (SELECT source, line, CASE WHEN doc_id % 41 = 40 AND length(source) > 4 THEN 'decode' WHEN doc_id % 37 = 36 AND source <> 'src7' THEN 'json' END AS error_type FROM d)
SELECT source, min_by(error_type, line) AS error_type, min(line) AS line FROM b WHERE error_type IS NOT NULL GROUP BY source
"""

_FORMS = ", ".join("'" + "\n".join(f).replace("'", "''") + "'" for f in FORMS)
_CODE = rf"""
made AS (
  SELECT l_orderkey, list(text ORDER BY l_linenumber, text) AS x
  FROM (SELECT l_orderkey, l_linenumber, replace([{_FORMS}][(l_orderkey + l_linenumber) % 6 + 1], 'NAME', lower(l_returnflag) || '_' || (l_partkey % 50)) AS text FROM lineitem)
  GROUP BY l_orderkey),
files AS (
  SELECT 'src/c' || o_custkey || CASE WHEN o_custkey % 10 = 0 THEN '.py' ELSE '.js' END AS path,
         string_agg('import o' || o_orderkey || chr(10) || 'export class Order' || o_orderkey || ' {{' || chr(10)
                    || coalesce(array_to_string(x, chr(10)) || chr(10), '') || '}}', chr(10) ORDER BY o_orderkey) AS content
  FROM orders LEFT JOIN made ON o_orderkey = l_orderkey GROUP BY o_custkey),
lines AS (SELECT path, unnest(string_split(content, chr(10))) AS text, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM files),
named AS (
  SELECT *, coalesce(nullif(regexp_extract(text, '^\s*(?:export\s+)?class\s+([A-Za-z_]\w*)', 1), ''),
                     regexp_extract(text, '^\s*(?:class|struct|interface|enum)\s+([A-Za-z_]\w*)', 1)) AS c,
         coalesce(nullif(regexp_extract(text, '^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(', 1), ''),
                  nullif(regexp_extract(text, '^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_]\w*)\s*\(', 1), ''),
                  nullif(regexp_extract(text, '^\s*func\s+([A-Za-z_]\w*)\s*\(', 1), ''),
                  nullif(regexp_extract(text, '^\s*(?:pub\s+)?fn\s+([A-Za-z_]\w*)\s*\(', 1), ''),
                  regexp_extract(text, '^\s*(?:public|private|protected|static|final|virtual|inline|\s)+[A-Za-z_][\w:<>,\s*&\[\]]+\s+([A-Za-z_]\w*)\s*\([^;]*\)\s*(?:\{{|$)', 1)) AS f
  FROM lines),
heads AS (SELECT path, line, text, CASE WHEN c <> '' THEN c ELSE f END AS name, CASE WHEN c <> '' THEN 'class' ELSE 'function' END AS kind FROM named WHERE c <> '' OR f <> ''),
b AS (
  SELECT path, line, k, ch, sum(CASE ch WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY path ORDER BY line, k) AS d, row_number() OVER (PARTITION BY path ORDER BY line, k) AS i
  FROM (SELECT path, line, unnest(string_split(text, '')) AS ch, unnest(range(1, length(text) + 1)) AS k FROM lines WHERE text <> '') WHERE ch IN ('{{', '}}')),
o AS (
  SELECT o.path, o.line, o.i, (SELECT min(c.i) FROM b c WHERE c.path = o.path AND c.i > o.i AND c.d < o.d) AS j
  FROM b o WHERE o.ch = '{{'),
ends AS (
  SELECT h.*, coalesce((SELECT e.line FROM b e WHERE e.path = h.path AND e.i =
           (SELECT min_by(o.j, o.i) FROM o WHERE o.path = h.path AND o.line >= h.line AND o.j IS NOT NULL
              AND o.i = (SELECT min(p.i) FROM o p WHERE p.path = h.path AND p.line >= h.line))), h.line) AS stop
  FROM heads h),
imports AS (
  SELECT path, line, trim(text) AS text FROM lines
  WHERE regexp_matches(text, '^\s*#include\s+[<"].+[>"]\s*$|^\s*import\s+.+$|^\s*from\s+\S+\s+import\s+.+$|^\s*(?:const|let|var)\s+\w+\s*=\s*require\(.+\)\s*;?\s*$'))"""

SQL["v3_k10_index_build"] = rf"""
WITH {_CODE},
n AS (SELECT regexp_extract(path, '[0-9]+')::BIGINT % 7 AS no, sum(ceil(len(string_split(content, chr(10))) / 15.0))::BIGINT AS chunks FROM files GROUP BY 1),
a AS (SELECT r.no, run, chunks, CASE WHEN r.no = 2 AND run = 2 THEN 'abcdefgh' WHEN r.no = 6 AND run = 1 THEN '' ELSE '1234567-' END AS commit
      FROM (SELECT unnest(range(8)) AS no) r CROSS JOIN (SELECT unnest([1, 2]) AS run) LEFT JOIN n USING (no))
SELECT 'r' || no AS repo, run::INTEGER AS run, commit,
       CASE WHEN commit = '' OR chunks IS NULL THEN 'failed' WHEN run = 1 OR no IN (2, 6) THEN 'rebuilt' ELSE 'disk_hit' END AS status,
       CASE WHEN commit = '' THEN 'commit_missing' WHEN chunks IS NULL THEN 'no_files' WHEN run = 1 OR no IN (2, 6) THEN 'meta_missing' END AS reason,
       CASE WHEN commit <> '' THEN chunks END AS chunks FROM a
"""
SQL["k9_s11_trajectory_files"] = """
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS pos, role, substr(sha256(text), 1, 8) AS content FROM conversations
"""

SQL["x6_line_symbols"] = rf"""
WITH {_CODE}
SELECT path, kind, name, line::INTEGER AS start, stop::INTEGER AS stop, trim(rtrim(trim(text), '{{')) AS signature FROM ends
UNION ALL SELECT path, 'import', '', line::INTEGER, line::INTEGER, text FROM imports
"""

SQL["x8_skeletons"] = rf"""
WITH {_CODE},
asked AS (
  SELECT c_nationkey AS query_id, c_custkey AS no, n / 100 AS score, evidence_count,
         row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_custkey) AS rank,
         CASE WHEN c_custkey % 8 = 3 THEN 'gone/c' || c_custkey ELSE 'src/c' || c_custkey || CASE WHEN c_custkey % 10 = 0 THEN '.py' ELSE '.js' END END AS path,
         CASE WHEN c_nationkey % 5 = 0 THEN ['zzz'] ELSE ['look', 'at', 'order' || (c_nationkey * 7), 'and', 'n_' || c_nationkey, 'r_1', 'up'] END AS tokens
  FROM customer JOIN (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS evidence_count FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey),
top AS (
  SELECT *, CASE WHEN nf = 1 THEN 600 WHEN nf = 2 THEN [360, 240][rank] WHEN nf = 3 THEN [300, 180, 120][rank]
                 WHEN rank <= 3 THEN [300, 180, 90][rank] WHEN rank < nf THEN 30 // (nf - 3) ELSE 30 - (nf - 4) * (30 // (nf - 3)) END AS budget
  FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS nf FROM asked WHERE rank <= 5)),
s AS (
  SELECT t.query_id, t.rank, e.name, e.kind, e.line AS start, e.stop, e.place, len(list_filter(t.tokens, lambda x: contains(lower(e.name), x))) AS hits
  FROM top t JOIN (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line, name, kind, stop) AS place FROM ends) e ON e.path = t.path AND e.place <= 200),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY hits DESC, CASE kind WHEN 'class' THEN 4 ELSE 3 END DESC, stop - start DESC, place) AS ord FROM s),
a AS (SELECT *, hits > 0 AND ord <= 2 AS anchor FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, rank, anchor, kind ORDER BY ord) = 1 AND NOT anchor AS leads, count(*) FILTER (anchor) OVER (PARTITION BY query_id, rank) AS na FROM a),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id, rank, anchor ORDER BY leads DESC, ord) AS turn FROM k),
shown AS (
  SELECT *, name || '(' || kind || ')[L' || start || '-L' || stop || ']' AS t, CASE WHEN anchor THEN ord ELSE 1000 + turn END AS pos
  FROM g WHERE anchor OR turn <= CASE WHEN rank = 1 AND na = 0 THEN 5 ELSE 3 END),
fit AS (SELECT shown.*, sum(length(t) + 2) OVER (PARTITION BY query_id, rank ORDER BY pos) - 2 <= budget AS fits FROM shown JOIN (SELECT query_id, rank, budget FROM top) USING (query_id, rank)),
p AS (
  SELECT query_id, rank, string_agg(t, ', ' ORDER BY pos) FILTER (anchor) AS anchors, count(*) FILTER (anchor) AS n_a, string_agg(t, ', ' ORDER BY pos) FILTER (NOT anchor) AS glimpses,
         count(*) FILTER (NOT anchor) AS n_g, string_agg(t, ', ' ORDER BY pos) FILTER (fits) AS preview, bool_or(NOT fits) AS truncated,
         min_by(name || ':' || kind || ':' || start || ':' || stop, pos) FILTER (anchor) AS first_anchor
  FROM fit GROUP BY query_id, rank),
c AS (SELECT query_id, rank, count(*) AS n, count(*) FILTER (kind = 'class') AS nc, count(*) FILTER (kind = 'function') AS nf FROM s GROUP BY query_id, rank),
i AS (SELECT path, least(count(*), 200) AS n_imports FROM imports GROUP BY path)
SELECT top.query_id, top.rank::INTEGER AS rank, top.path, top.score, top.evidence_count, top.budget::BIGINT AS budget_chars, coalesce(anchors, '') AS anchors_preview, coalesce(n_a, 0)::BIGINT AS anchor_count,
       coalesce(first_anchor, '') AS primary_anchor, coalesce(glimpses, '') AS glimpse_preview, coalesce(n_g, 0)::BIGINT AS glimpse_count, coalesce(preview, '') AS preview, coalesce(truncated, false) AS truncated,
       coalesce(n_imports, 0)::BIGINT AS import_count, coalesce(n, 0)::BIGINT AS symbol_count, greatest(0, coalesce(n, 0) - coalesce(n_a, 0) - coalesce(n_g, 0))::BIGINT AS folded_symbols,
       CASE WHEN n IS NULL THEN '' ELSE 'classes=' || c.nc || ', methods=0, functions=' || c.nf END AS scope, CASE WHEN files.path IS NULL THEN 'not_found' ELSE '' END AS error
FROM top LEFT JOIN p USING (query_id, rank) LEFT JOIN c USING (query_id, rank) LEFT JOIN i ON i.path = top.path LEFT JOIN files ON files.path = top.path
"""
