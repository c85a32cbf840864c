"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its content. The ledger holds what each rule
version found in each blob; a scan reads only the blobs for which some rule version has no entry yet,
each once however many paths carry it, appends its findings, and joins them back to all paths. What the ledger
holds does not hang on the call: kind and rank of a span come from the rules that are asked for when it is read.

Null text counts as empty text. Rows may repeat and share ids: every input row comes back once. An
empty table gives an empty result. Only the id and text columns are read. All on DataFrame functions.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm.common import Scratch, text_or_empty


@dataclass(frozen=True)
class Rule:
    """kind: name in spans. A match counts if `group` has `least` characters. hint: a cheap test that every text with a match passes."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    hint: str | None = None

    @property
    def version(self) -> str:
        return hashlib.sha256(f"{self.kind}\n{self.pattern}\n{self.least}\n{self.group}".encode()).hexdigest()[:16]


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", "AKIA[A-Z0-9]+", 20, hint="AKIA"),
    Rule("hex", "[0-9a-f]{24,}"),  # a maximal run of 24 or more is a run that this finds, and the other way round
)
MORE = (
    # To its END line, or where that is missing to the end of the lines that may belong to a key.
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=,:\x20\x09-\x0D-]*?-----END [A-Z ]*PRIVATE KEY-----|-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*", hint="PRIVATE KEY-----"),
    Rule("git", "gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
)
RULES = BASE + MORE
_SPAN = "array<struct<start:int,rank:int,kind:string,stop:int>>"
_PLACE = "array<struct<start:int,stop:int>>"


#: Matches of a block: arrays and strings grow inside a block only, so that a text's cost is linear in its matches.
BLOCK = 256


def _once(made: Column, use) -> Column:
    """use(made), with made evaluated once however often use names it."""
    return F.get(F.transform(F.array(made), use), F.lit(0))


def _blocks(items: Column) -> Column:
    """Items in arrays of BLOCK; items are to be a column or bound by _once()."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(items, i, F.lit(BLOCK)))


def _before(values: Column, both) -> Column:
    """For each whole number what both() makes of 0 and all numbers before it."""
    step = lambda acc, x: F.struct(both(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(values, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])


def find(text: Column, rule: Rule) -> Column:
    """Spans (start, stop) in code points of the leftmost matches, without overlap.

    Matches have no positions in Spark SQL, but the pieces that split() leaves between them have
    lengths: a match begins where all pieces and matches before it end. Blocks of matches are placed
    by themselves, then moved to where the blocks before them end.
    """
    none = F.array().cast(_PLACE)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    parts = F.arrays_zip(
        F.transform(F.split(text, rule.pattern), lambda x: F.length(x)).alias("gap"),
        F.transform(whole, lambda x: F.length(x)).alias("size"),
        F.transform(counted, lambda x: F.length(x)).alias("counted"),
    )
    step = lambda acc, p: F.struct(
        (acc["at"] + p["gap"] + F.coalesce(p["size"], F.lit(0))).alias("at"),
        F.when(
            p["counted"] >= rule.least,
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + p["gap"]).alias("start"), (acc["at"] + p["gap"] + p["size"]).alias("stop"),
            ))),
        ).otherwise(acc["out"]).alias("out"),
    )
    placed = lambda ps: F.transform(_blocks(ps), lambda b: F.aggregate(b, F.struct(F.lit(0).alias("at"), none.alias("out")), step))
    move = lambda spans, by: F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), (s["stop"] + by).alias("stop")))
    joint = lambda made: F.flatten(F.zip_with(made, _before(F.transform(made, lambda m: m["at"]), lambda a, x: a + x), lambda m, by: move(m["out"], by)))
    likely = text.rlike(rule.pattern)
    if rule.hint:
        likely = F.contains(text, F.lit(rule.hint)) & likely
    return F.when(likely, _once(_once(parts, placed), joint)).otherwise(none)


def joined(spans: Column) -> Column:
    """kind:start:stop by start, then rule order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    schema = f"blob binary, version string, spans {_PLACE}"
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def address(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def scan(versions: DataFrame, spark: SparkSession, ledger: str, rules=RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scans what the ledger at this path lacks, appends it, and returns (blob, spans) of the ledger.

    versions: one row for each version of each path. Blobs without findings have no row.
    """
    rows = versions.select(F.col(key).alias("path"), text_or_empty(text).alias("text"))
    wanted = F.array(*[F.lit(r.version) for r in rules])
    # Content addresses first, without texts; a copied text is one blob, whatever its number of paths.
    blobs = rows.select("path", address(F.col("text")).alias("blob")).groupBy("blob").agg(F.min("path").alias("path"))
    known = _ledger(spark, ledger)
    seen = known.groupBy("blob").agg(F.collect_set("version").alias("seen"))
    unseen = blobs.join(seen, "blob", "left").select("blob", "path", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")).where(F.size("todo") > 0)
    texts = rows.withColumn("own", address(F.col("text")))
    # The path names one row of each unseen blob, or rows repeated whole, which give one entry below.
    todo = texts.join(unseen, (texts.path.eqNullSafe(unseen.path)) & (texts.own == unseen.blob)).select("blob", "todo", "text")
    found = todo.select("blob", F.explode(F.array(*[
        F.struct(F.lit(r.version).alias("version"), F.when(F.array_contains("todo", r.version), find(F.col("text"), r)).alias("spans"))
        for r in rules
    ])).alias("f")).select("blob", "f.*").where(F.col("spans").isNotNull())
    found.dropDuplicates(["blob", "version"]).write.mode("append").parquet(ledger)
    return entries(spark, ledger, rules)


def entries(spark: SparkSession, ledger: str, rules=RULES) -> DataFrame:
    """(blob, spans): what these rules found in each blob of the ledger, by start, then in the order of the rules.

    An executor lost while the ledger was appended to may leave an entry twice; it counts once.
    """
    known = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.version, i)])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    rank = F.element_at(known, F.col("version"))
    now = _ledger(spark, ledger).where(F.col("version").isin(*[r.version for r in rules]) & (F.size("spans") > 0)).withColumn("rank", rank)
    named = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("rank").alias("rank"), F.get(kinds, F.col("rank")).alias("kind"), s["stop"].alias("stop")))
    return now.select("blob", named.alias("spans")).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"))


def findings(versions: DataFrame, spark: SparkSession, ledger: str | None = None, rules=RULES, key: str = "doc_id", text: str = "text", increments: int = 1) -> DataFrame:
    """A row for each row of versions: its key and all spans found in its text.

    increments: the rows arrive in so many parts, each scanned over the ledger that those before have left.
    """
    ledger = ledger or Scratch(spark, "ledger").path("blobs")
    for i in range(increments):
        arrived = versions if increments == 1 else versions.where(F.pmod(F.xxhash64(key), F.lit(increments)) == i)
        scan(arrived, spark, ledger, rules, key, text)
    # Written, so that both sides of the join are plain exchanges, which AQE splits at a blob with many paths.
    found = Scratch(spark, "findings").write("found", entries(spark, ledger, rules))
    paths = versions.select(F.col(key), address(text_or_empty(text)).alias("blob"))
    return paths.join(found, "blob", "left").select(key, F.coalesce("spans", F.array().cast(_SPAN)).alias("spans"))


def counts(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans summed up: n_<kind> of the base kinds, the digest of the base spans, and all spans as a string."""
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    kinds = [F.expr(f"cast(size(filter(spans, s -> s.rank = {i})) as long)").alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return found.select(key, *kinds, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, spark: SparkSession, ledger: str | None = None, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every found span (overlaps merged) replaced by the mask, n_chars set anew; its columns stay."""
    ledger = ledger or Scratch(spark, "ledger").path("blobs")
    found = Scratch(spark, "findings").write("found", scan(docs, spark, ledger, text=text))
    rows = docs.select(F.struct("*").alias("row"), address(text_or_empty(text)).alias("blob")).join(found, "blob", "left")
    t = F.col("row").getField(text)
    merge = lambda piece, low: lambda acc, s: F.struct(
        F.when(s["start"] - low >= acc["at"], F.concat(acc["out"], F.substring(piece, acc["at"] + 1, s["start"] - low - acc["at"]), F.lit(mask))).otherwise(acc["out"]).alias("out"),
        F.greatest(acc["at"], s["stop"] - low).alias("at"),
    )
    end = lambda spans: F.array_max(F.transform(spans, lambda s: s["stop"]))
    # A block of spans masks the text from where the blocks before it end to where it ends itself.
    masked = lambda b, low: _once(F.substring(t, low + 1, F.greatest(end(b) - low, F.lit(0))), lambda piece: F.aggregate(b, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), merge(piece, low), lambda acc: acc["out"]))
    spans = F.col("spans")
    outs = _once(_blocks(spans), lambda bs: F.zip_with(bs, _before(F.transform(bs, end), F.greatest), masked))
    clean = F.concat(F.array_join(outs, ""), F.substring(t, F.coalesce(end(spans), F.lit(0)) + 1, F.length(t)))
    new = F.when(F.col("spans").isNull(), t).otherwise(clean)
    out = rows.select("row", new.alias("new"))
    columns = [F.col("new").alias(c) if c == text else F.coalesce(F.length("new").cast(docs.schema[c].dataType), F.col("row").getField(c)).alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return out.select(*columns)
