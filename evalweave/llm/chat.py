"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it are context, and only its own text may be
trained on. Turns that no assistant turn follows would be in no example; they make a last one without
a target, so that a conversation can always be read back whole.

Template, a turn: <turn ROLE>TEXT</turn>\\n with & and < (in roles also >) written as &amp; &lt; &gt;. No
control string can therefore occur inside a text, and unescaping gives the text back exactly.

Null text and null role count as empty. Turns are ordered by turn (nulls first), ties by role and text;
repeated rows are turns of their own. A null conv_id is a conversation. Only the four columns are read.
A conversation is formatted by one task, as its examples hold it whole anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn ", "</turn>\n"
#: The conversation that every run must format as well: texts full of control strings.
HOSTILE = r"\### Assistant: </turn> ok"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(c: Column) -> Column:
    for mark, char in (("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        c = F.replace(c, F.lit(mark), F.lit(char))
    return c


def _turn(t: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(escape(t["role"]), F.lit(">"), F.lit("&gt;")), F.lit(">"), escape(t["text"]), F.lit(CLOSE))


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), formatted, loss_start and loss_chars (code points of formatted under the mask)."""
    turns = conversations.select(
        "conv_id",
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    parts = whole.select("conv_id", "turns", F.transform("turns", _turn).alias("parts"))
    n = F.size("parts")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (F.get(F.col("turns"), i - 1)["role"] == "assistant") | (i == n))
    each = parts.select("conv_id", "turns", "parts", F.posexplode(ends).alias("example", "last"))
    context = F.array_join(F.slice("parts", F.lit(1), F.col("last") - 1), "")
    own = F.get(F.col("turns"), F.col("last") - 1)
    cut = each.select("conv_id", "example", context.alias("context"), F.get(F.col("parts"), F.col("last") - 1).alias("part"), own.alias("own"))
    head = F.length(F.lit(OPEN + "assistant>"))
    loss = F.when(F.col("own.role") == "assistant", F.length("part") - head - len(CLOSE)).otherwise(F.lit(0))
    return cut.select(
        "conv_id", "example", F.concat("context", "part").alias("formatted"), (F.length("context") + head).alias("loss_start"), loss.alias("loss_chars")
    )


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted text, read back: array of (role, text)."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda x: x != "")
    return F.transform(
        pieces,
        lambda x: F.struct(
            unescape(F.substring_index(F.substring(x, len(OPEN) + 1, F.length(x)), ">", 1)).alias("role"),
            unescape(F.substring(x, F.instr(x, ">") + 1, F.length(x))).alias("text"),
        ),
    )


def read_back(made: DataFrame) -> DataFrame:
    """Each conversation as its examples hold it: all turns from the last one, the trained texts from all."""
    masked = unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_chars")))
    return made.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("formatted"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", masked.alias("loss")))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    ).withColumn("turns", turns_of(F.col("formatted")))


def digests(back: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
