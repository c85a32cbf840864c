"""Submissions: JSON payloads out of texts, function items, assembled localisation output, hints and fallbacks.

All JVM-side but for the last arm of payload(), which balances braces in an Arrow-batched function and gets only
the texts that the native arms leave.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.paths import modules, normal
from evalweave.functions.text import json_object, mentioned_files, strip, tidy_list
from evalweave.operators.commands import balanced_object

_NONE = "array<string>"


def payload(c: Column) -> Column:
    """The JSON object in a text, as text: of its fenced blocks or of the whole, else its first balanced {...}."""
    native = json_object(c)
    return F.coalesce(native, balanced_object(F.when(native.isNull() & F.contains(c, F.lit("{")), c)))


def _field(p: Column, key: str) -> Column:
    """A field of a JSON object, null where it is empty in any of JSON's ways."""
    value = F.get_json_object(p, f"$.{key}")
    return F.when(~value.isin("", "[]", "{}", "0", "false"), value)


def _items(value: Column) -> Column:
    """The elements of a JSON array, or the one value that is no array; nested ones as JSON."""
    many = F.from_json(value, _NONE)
    return F.when(value.isNull(), F.array().cast(_NONE)).when(F.startswith(value, F.lit("[")), F.coalesce(many, F.array().cast(_NONE))).otherwise(F.array(value))


def _strings(p: Column, key: str) -> Column:
    """The strings of a field that is an array, or the one string that it is; null where the field is empty in any of JSON's ways."""
    v = F.try_variant_get(F.try_parse_json(p), f"$.{key}", "variant")
    kind = F.schema_of_variant(v)
    many = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    strings = F.when(F.startswith(kind, F.lit("ARRAY")), F.transform(many, lambda x: x.cast("string"))).when(kind == "STRING", F.array(F.try_variant_get(v, "$", "string"))).otherwise(F.array().cast(_NONE))
    return F.when(~F.to_json(v).isin("null", '""', "[]", "{}", "0", "0.0", "false"), strings)


def listed(p: Column, *keys: str) -> Column:
    """The strings of the first of these fields that is not empty, as a tidy list; anything else in it is left out."""
    return tidy_list(F.coalesce(*[_strings(p, k) for k in keys], F.array().cast(_NONE)))


def function_items(p: Column) -> Column:
    """array<struct<function, file_hint>> of the field `functions`: objects under any of their key names, or bare names."""

    def first(e: Column, *keys: str) -> Column:
        return strip(F.coalesce(*[_field(e, k) for k in keys], F.lit("")))

    def one(e: Column) -> Column:
        is_object = F.startswith(e, F.lit("{")) & F.try_parse_json(e).isNotNull()
        return F.struct(
            F.when(is_object, first(e, "function", "name", "func")).otherwise(strip(e)).alias("function"),
            F.when(is_object, first(e, "file_hint", "file", "path")).otherwise(F.lit("")).alias("file_hint"),
        )

    return F.filter(F.transform(_items(_field(p, "functions")), one), lambda x: x["function"] != "")


def _nonempty(a: Column) -> Column:
    return F.filter(a, lambda x: x != "")


def assembled(df: DataFrame, text: str = "text", mapped: str | None = None) -> DataFrame:
    """df with the localisation output of its text.

    found_files, found_entities and found_modules come from the payload under either of their key names; hints of
    function items count as files; what is missing is derived from the entities. mapped: a column of entities that
    the function items were matched to; it replaces what the payload found wherever there are items, and items with
    a hint that no mapped entity is in count as entities of their hint.
    """
    df = df.withColumn("payload", payload(F.col(text)))
    p = F.coalesce("payload", F.lit("{}"))
    df = df.select("*", function_items(p).alias("items"), F.array_contains(F.coalesce(F.json_object_keys(p), F.array().cast(_NONE)), "functions").alias("has_functions"))
    hints = _nonempty(F.transform("items", lambda x: x["file_hint"]))
    names = F.transform("items", lambda x: x["function"])
    files, entities, found = listed(p, "found_files", "files"), listed(p, "found_entities", "entities"), listed(p, "found_modules", "modules")
    before = lambda a: F.transform(F.filter(a, lambda x: F.contains(x, F.lit(":"))), lambda x: F.split_part(x, F.lit(":"), F.lit(1)))
    left = F.array().cast(_NONE)
    if mapped:
        use, m = F.size("items") > 0, F.coalesce(F.col(mapped), F.array().cast(_NONE))
        left = F.transform(F.filter("items", lambda x: (x["file_hint"] != "") & ~F.array_contains(before(m), x["file_hint"])), lambda x: F.concat(x["file_hint"], F.lit(":"), x["function"]))
        files, found = F.when(use, F.array_distinct(before(m))).otherwise(files), F.when(use, modules(m)).otherwise(found)
        entities = F.when(use, tidy_list(F.concat(m, left))).otherwise(entities)
        found = F.when(use, F.array_distinct(F.concat(found, modules(left)))).otherwise(found)
    df = df.select("*", tidy_list(F.concat(files, hints)).alias("f"), entities.alias("found_entities"), found.alias("m"))
    df = df.withColumn("found_files", F.when(F.size("f") > 0, F.col("f")).otherwise(tidy_list(before(F.col("found_entities")))))
    df = df.withColumn("found_modules", F.when(F.size("m") > 0, F.col("m")).otherwise(modules(F.col("found_entities")))).drop("f", "m")
    has, count = F.col("has_functions"), F.size("items")
    dotted = F.size(F.filter(names, lambda x: F.contains(x, F.lit("."))))
    raw = F.coalesce("payload", strip(F.coalesce(F.col(text), F.lit(""))))
    return df.select(
        "*",
        F.when(has, count).alias("submitted_function_count"),
        F.when(has, F.size(F.array_distinct(names))).alias("submitted_unique_function_count"),
        F.when(has, F.size(F.array_distinct(hints))).alias("submitted_file_hint_count"),
        F.when(has, dotted).alias("submitted_qualified_function_count"),
        F.when(has, F.when(count > 0, dotted / count).otherwise(F.lit(0.0))).alias("submitted_qualified_function_ratio"),
        _nonempty(F.array(raw)).alias("raw_output"),
    )


def submission_hints(p: Column) -> Column:
    """Files that a submission names: hints of its function items, its files, the files of its entities; distinct in order."""
    array = lambda k: F.when(F.startswith(F.get_json_object(p, f"$.{k}"), F.lit("[")), _items(_field(p, k))).otherwise(F.array().cast(_NONE))
    some = lambda a: F.coalesce(a, F.array().cast(_NONE))
    items = F.transform(F.filter(array("functions"), lambda e: F.startswith(e, F.lit("{"))), lambda e: F.coalesce(F.get_json_object(e, "$.file_hint"), F.lit("")))
    files = F.concat(some(array("found_files")), some(array("files")))
    entities = F.filter(F.concat(some(array("found_entities")), some(array("entities"))), lambda x: F.contains(x, F.lit(":")))
    every = F.concat(some(items), files, F.transform(entities, lambda x: F.split_part(x, F.lit(":"), F.lit(1))))
    return F.array_distinct(_nonempty(F.transform(every, lambda x: normal(x))))


def located_result(status: Column, result: Column, last: Column) -> Column:
    """The result, or where a limit ended the run what its last message holds: a payload, else the files it names."""
    named = F.to_json(F.struct(mentioned_files(last).alias("found_files")))
    return F.when((status == "LimitsExceeded") & (F.coalesce(last, F.lit("")) != ""), F.coalesce(payload(last), named)).otherwise(result)


def answered_result(status: Column, result: Column, last: Column, parse: Callable[[Column], Column]) -> Column:
    """The answer of a run that was submitted or that a limit ended (then its last message), else an empty text."""
    said = F.when((status == "LimitsExceeded") & (F.coalesce(last, F.lit("")) != ""), last).otherwise(result)
    return F.when(status.isin("Submitted", "LimitsExceeded"), parse(said)).otherwise(F.lit(""))


def record_meta(df: DataFrame, keys: tuple[str, ...] = ("repo", "base_commit", "problem_statement", "patch", "test_patch")) -> Column:
    """Those of the columns that the table has, as JSON, nulls kept."""
    return F.to_json(F.struct(*[k for k in keys if k in df.columns]), {"ignoreNullFields": "false"}) if set(keys) & set(df.columns) else F.lit("{}")


def estimated_tokens(messages: Column, completion: Column, count: Callable[[Column], Column], per_message: int = 3, per_name: int = 1, priming: int = 3) -> Column:
    """struct(prompt, completion, total): tokens of chat messages (array<map<string,string>>) with the format's overhead.

    count gives the tokens of a text: any column function, for example an Arrow-batched tokenizer.
    """
    one = lambda m: F.lit(per_message) + F.aggregate(F.transform(F.map_values(m), lambda v: count(F.coalesce(v, F.lit("")))), F.lit(0), lambda a, x: a + x) + F.when(F.map_contains_key(m, "name"), F.lit(per_name)).otherwise(F.lit(0))
    prompt = F.aggregate(F.transform(messages, one), F.lit(priming), lambda a, x: a + x)
    said = count(F.coalesce(completion, F.lit("")))
    return F.struct(prompt.alias("prompt"), said.alias("completion"), (prompt + said).alias("total"))
