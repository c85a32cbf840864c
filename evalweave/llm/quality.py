"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Row-local: no shuffle, no Python. Null text counts as empty text. Empty text has no words and fails
the base rule. Repeated rows are judged alike, each on its own. Extra columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import WORD, text_or_empty

#: Characters counted as symbols.
SYMBOLS = "[#*$%&|<>]"
#: Frequent function words of the languages in the corpus; a long text with none of them is no prose.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "that", "is", "with",
    "le", "la", "de", "et", "les", "des", "un", "une",
    "der", "die", "und", "das", "den", "ein", "nicht", "mit",
    "el", "los", "las", "que", "y", "en", "por", "con",
)
WINDOW = 5

#: name, measure, comparison that rejects, threshold. Ratios are compared as products of whole numbers.
RULES = (
    ("few_words", "n_words", "<", 10),
    ("repeated_windows", "100 * n_repeat_words - 20 * n_words", ">", 0),
    ("symbol_heavy", "10 * n_symbols - 3 * n_words", ">", 0),
    ("long_words", "word_chars - 100 * n_words", ">", 0),
    ("repeated_lines", "100 * n_dup_lines - 50 * n_lines", ">", 0),
    ("no_stop_words", "n_words - 1000 * n_stop_words", ">", 200),
)
BASE_RULES = ("few_words", "repeated_windows")


def _spread(starts: Column) -> Column:
    """Words covered by windows that begin at these ascending word positions."""
    # The last start has no successor: least() skips the null and counts the whole window.
    steps = F.zip_with(F.slice(starts, F.lit(2), F.size(starts)), starts, lambda b, a: F.least(F.lit(WINDOW), b - a))
    return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)


def _repeated(windows: Column) -> Column:
    """Ascending positions of the windows whose hash occurs at least twice."""
    ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.transform(
        F.array(ranked), lambda s: F.array_sort(F.transform(F.filter(s, lambda x, k: (
            (F.get(s, k - 1).getField("h") == x.getField("h")) & (k > 0)
            | F.coalesce(F.get(s, k + 1).getField("h") == x.getField("h"), F.lit(False))
        )), lambda x: x.getField("i")))
    ).getItem(0)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs packed as `row`, beside the measures of its text."""
    df = docs.select(F.struct("*").alias("row"), text_or_empty(text).alias("text"))
    df = df.select("row", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w = F.col("words")
    at = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)])
    windows = F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), at)).otherwise(F.array().cast("array<bigint>"))
    df = df.select(
        "row",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        windows.alias("windows"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    d = F.col("windows")
    return df.select(
        "row", "n_words", "word_chars", "n_symbols", "n_stop_words",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct(d)) == F.size(d), F.array().cast("array<int>")).otherwise(_repeated(d)).alias("repeats"),
    ).withColumn("n_repeat_words", _spread(F.col("repeats")).cast("long")).drop("repeats")


def judge(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """`row` (all columns of docs) with measures, base_failed, kept and the names of the failed rules."""
    broken = {name: F.expr(f"({measure}) {op} {bound}") for name, measure, op, bound in rules}
    base = F.lit(False)
    for name in BASE_RULES:
        base = base | broken[name]
    failed = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in broken.items()]))
    df = measures(docs, text).withColumn("base_failed", base).withColumn("failed_rules", failed)
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def filter_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that pass every rule, with their columns as they were."""
    # A filter is pushed through deterministic projections, which would copy the measures into one another.
    judged = judge(docs, text).select("row", "kept", F.monotonically_increasing_id().alias("at"))
    return judged.where("kept and at >= 0").select("row.*")
