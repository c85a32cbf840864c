"""Column functions over text: trimming, tokens, previews, hashes, extraction. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a search query does without.
QUERY_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is", "it", "its",
    "of", "on", "or", "that", "the", "this", "to", "was", "were", "with",
)


_BLANK = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def strip(c: Column) -> Column:
    """Drops white space of any kind at both ends (trim() drops spaces only)."""
    return F.regexp_replace(c, f"^{_BLANK}|{_BLANK}$", "")


def or_else(c: Column, default: Column) -> Column:
    """c, or the default where c is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), default)


def short_hash(c: Column) -> Column:
    """First eight hex digits of the SHA-256."""
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 8)


def path_hash(c: Column) -> Column:
    return F.sha1(c.cast("binary"))


def tidy_list(c: Column) -> Column:
    """Trimmed, without empty strings, first occurrences in order."""
    return F.array_distinct(F.filter(F.transform(c, strip), lambda x: x != ""))


def tokens(c: Column) -> Column:
    """Distinct lower-case tokens of two or more characters; one begins with a letter or an underscore."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"[A-Za-z_][A-Za-z0-9_]+"), F.lit(0)), F.lower))


def overlap(found: Column, name: Column) -> Column:
    """How many of the tokens are substrings of the name."""
    return F.size(F.filter(found, lambda t: F.contains(F.lower(name), t)))


def preview(c: Column, most: int = 140) -> Column:
    """White space collapsed, cut to `most` characters, the last three of which are then dots."""
    one = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.rtrim(F.substring(one, 1, most - 3)), F.lit("...")))


def first_sentence(doc: Column, most: int = 100) -> Column:
    """Of the first paragraph, up to its first full stop, cut to `most` characters."""
    paragraph = F.trim(F.regexp_replace(F.get(F.split(strip(F.regexp_replace(doc, r"\r\n?", "\n")), r"\n\s*\n"), F.lit(0)), r"\s+", " "))
    stop = F.instr(paragraph, ".")
    sentence = F.when(stop > 0, F.substring(paragraph, F.lit(1), stop)).otherwise(paragraph)
    return F.when(F.length(sentence) <= most, sentence).otherwise(F.concat(F.rtrim(F.substring(sentence, 1, most - 3)), F.lit("...")))


def shorten(c: Column, width: int, keep_left: bool = True) -> Column:
    """Exactly `width` characters: padded with blanks, or cut with dots at the side that goes."""
    cut = F.concat(F.substring(c, 1, width - 3), F.lit("...")) if keep_left else F.concat(F.lit("..."), F.substring(c, -(width - 3), width))
    return F.rpad(F.when(F.length(c) > width, cut).otherwise(c), width, " ")


def fence_stripped(c: Column) -> Column:
    """The inside of a text that is one fenced block as a whole, else the text, trimmed."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```[A-Za-z0-9_-]*\s*\n?", ""), r"\n?```$", ""))


def actions(c: Column) -> Column:
    """Distinct fenced shell blocks, line ends normalised, trimmed, without empty ones."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?s)```bash\s*\n(.*?)\n```"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: strip(F.replace(x, F.lit("\r\n"), F.lit("\n")))), lambda x: x != ""))


def single_action(c: Column) -> Column:
    """The action of a message that holds exactly one, else null."""
    found = actions(c)
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def json_object(c: Column) -> Column:
    """The first fenced block, or the whole text, that parses to a JSON object; as text, else null."""
    blocks = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"(?is)```(?:json)?\s*(.*?)```"), F.lit(1)), strip), lambda x: x != "")
    tried = F.when(F.size(blocks) > 0, blocks).otherwise(F.array(strip(c)))
    return F.get(F.filter(tried, lambda x: F.startswith(x, F.lit("{")) & F.try_parse_json(x).isNotNull()), F.lit(0))


def truth(c: Column) -> Column:
    """true/1/yes/y and false/0/no/n in any case; null for anything else."""
    word = F.lower(strip(c))
    return F.when(word.isin("true", "1", "yes", "y"), F.lit(True)).when(word.isin("false", "0", "no", "n"), F.lit(False))


def strict_truth(c: Column) -> Column:
    return F.when(c.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(truth(c), F.raise_error(F.concat(F.lit("not a boolean: "), c)).cast("boolean")))


def bounded_int(c: Column, low: int, high: int) -> Column:
    n = F.try_to_number(c, F.lit("S9999999999")).cast("long")
    return F.when(c.isNull(), F.lit(None).cast("long")).when(n.between(low, high), n).otherwise(F.raise_error(F.concat(F.lit(f"not within {low} and {high}: "), c)).cast("long"))


def diff_files(c: Column) -> Column:
    """Right-hand paths of the headers of a unified diff, in order, distinct."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?m)^diff --git a/(.*?) b/(.*?)$"), F.lit(2)))


def mentioned_files(c: Column, enabled: bool = False) -> Column:
    """Paths with a source extension named in a text. Off by default: the observed behaviour is an empty list."""
    if not enabled:
        return F.array().cast("array<string>")
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9_./-]+\.(?:py|js|ts|java|go|rs|c|cpp|h)\b"), F.lit(0)))


def output_paths(c: Column, whole_lines: bool = False) -> Column:
    """Paths in search output, distinct in order: what stands before a line's first colon, or is named by a line
    `Binary file ... matches`. whole_lines: lines without a colon are paths themselves, and binary lines are no case."""
    before = lambda x: strip(F.split_part(x, F.lit(":"), F.lit(1)))
    lines = F.split(c, r"\r\n|\n|\r")
    if whole_lines:
        found = F.transform(lines, before)
    else:
        binary = lambda x: F.regexp_extract(x, r"(?i)^binary file (.*?) matches", 1)
        found = F.transform(lines, lambda x: F.when(x.rlike("(?i)^binary file .* matches"), strip(binary(x))).when(F.contains(x, F.lit(":")), before(x)).otherwise(F.lit("")))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def capped(c: Column, most: int = 50, mark: str = "<<TRUNCATED>>") -> Column:
    return F.when(F.size(c) > most, F.concat(F.slice(c, 1, most), F.array(F.lit(mark)))).otherwise(c)


def fold_distinct(c: Column) -> Column:
    """Distinct up to case, the first spelling kept."""
    return F.aggregate(c, F.array().cast("array<string>"), lambda acc, x: F.when(F.array_contains(F.transform(acc, F.lower), F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def expand_query(c: Column, most: int = 8) -> Column:
    """Variants of a query: itself, its code-like tokens (10), its concepts (12), the parts of its code (12)."""
    whole = strip(F.regexp_replace(c, r"\s+", " "))
    raw = F.transform(F.regexp_extract_all(whole, F.lit(r"[A-Za-z0-9_./:-]+"), F.lit(0)), lambda t: F.regexp_replace(t, r"^[.,;:]+|[.,;:]+$", ""))
    code = fold_distinct(F.filter(raw, lambda t: (F.length(t) >= 3) & t.rlike(r"[/._-]|^.+[A-Z]")))
    keep = lambda t: ~F.lower(t).isin(*QUERY_STOP_WORDS)
    concepts = fold_distinct(F.filter(F.regexp_extract_all(whole, F.lit(r"[A-Za-z_][A-Za-z0-9_]+"), F.lit(0)), keep))
    parts = fold_distinct(F.filter(F.flatten(F.transform(code, lambda t: F.split(t, r"[./:_-]+"))), lambda t: (F.length(t) >= 3) & keep(t)))
    made = F.array(whole, F.array_join(F.slice(code, 1, 10), " "), F.array_join(F.slice(concepts, 1, 12), " "), F.array_join(F.slice(parts, 1, 12), " "))
    return F.slice(fold_distinct(F.filter(made, lambda x: x != "")), 1, most)
