"""Column functions and aggregates for measures: set recall, metric vectors, safe ratios, judge scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalweave.functions.paths import entity_parts
from evalweave.functions.text import fence_stripped, strip

KS = (1, 3, 5, 10)
DIMENSIONS = ("correctness", "completeness", "relevance", "clarity", "reasoning")


def hits(truth: Column, found: Column) -> Column:
    return F.size(F.array_intersect(truth, found))


def recall(truth: Column, found: Column, k: int | None = None) -> Column:
    """Share of the truth among the first k found; 0 for an empty truth or k of 0 or less."""
    if k is not None and k <= 0:
        return F.lit(0.0)
    ranked = found if k is None else F.slice(found, 1, k)
    return F.when(F.size(truth) > 0, hits(truth, ranked) / F.size(F.array_distinct(truth))).otherwise(F.lit(0.0))


def hit_any(truth: Column, found: Column) -> Column:
    return F.coalesce(F.arrays_overlap(truth, found), F.lit(False)) & (F.size(truth) > 0)


def metric_columns(edit: Column, added: Column, files: Column, entities: Column, ks=KS) -> list[Column]:
    """The metric vector of one prediction. edit, added: path:name items; empty scopes of them give nulls."""
    none = F.array().cast("array<string>")
    scope = lambda c: F.array_distinct(F.transform(F.filter(F.transform(F.coalesce(c, none), lambda e: entity_parts(e)), lambda p: p.isNotNull()), lambda p: F.concat(p["file"], F.lit(":"), p["name"])))
    edits, adds = scope(edit), scope(added)
    both = F.array_union(edits, adds)
    gt_files = F.array_distinct(F.transform(both, lambda e: entity_parts(e)["file"]))
    files, entities = F.coalesce(files, none), F.coalesce(entities, none)
    some = F.size(both) > 0
    file_hit, entity_hit = hit_any(gt_files, files), hit_any(both, entities)
    out = [(file_hit | entity_hit).alias("correct"), file_hit.alias("file_hit_any")]
    out += [F.size(gt_files).alias("gt_file_count_all"), F.size(both).alias("gt_function_count_all"), F.size(edits).alias("gt_edit_function_count"), F.size(adds).alias("gt_added_function_count")]
    out += [(F.size(adds) > 0).alias("gt_has_added_functions"), (F.size(gt_files) == 1).alias("gt_single_file")]
    out += [recall(gt_files, files).alias("file_recall_all"), (some & (recall(gt_files, files) >= 1)).alias("file_acc_all")]
    out += [recall(gt_files, files, k).alias(f"file_recall_at_{k}") for k in ks]
    for name in ("entity", "function"):
        out += [entity_hit.alias(f"{name}_hit_any"), recall(both, entities).alias(f"{name}_recall_all"), (some & (recall(both, entities) >= 1)).alias(f"{name}_acc_all")]
        out += [recall(both, entities, k).alias(f"{name}_recall_at_{k}") for k in ks]
    for name, own in (("edit", edits), ("added", adds)):
        when = lambda c, own=own: F.when(F.size(own) > 0, c)
        out += [when(hit_any(own, entities)).alias(f"{name}_function_hit_any"), when(recall(own, entities)).alias(f"{name}_function_recall_all"), when(recall(own, entities) >= 1).alias(f"{name}_function_acc_all")]
        out += [when(recall(own, entities, k)).alias(f"{name}_function_recall_at_{k}") for k in ks]
    return out


def number(*keys: Column) -> Column:
    """The first of the keys that isn't null, as a number; null if that one isn't a number."""
    return F.coalesce(*[k.cast("string") for k in keys]).try_cast("double")


def mean(c: Column) -> Column:
    return F.avg(c)


def accuracy(c: Column) -> Column:
    """Share of the values, nulls apart, that are 1 or more."""
    return F.avg(F.when(c.isNotNull(), (c >= 1).cast("double")))


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def mean_or_zero(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def percentile(name: str, percent: int) -> Column:
    """Nearest-rank percentile of a column, 0 for none."""
    return F.coalesce(F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY {name})").cast("long"), F.lit(0))


def share(condition: Column) -> Column:
    """Share of the rows for which the condition is true, nulls apart."""
    return F.avg(condition.cast("double"))


def parsed_scores(c: Column) -> Column:
    """struct of the five dimensions from a judge's answer; null unless all are there and within 0 and 10."""
    schema = ", ".join(f"{d} double" for d in DIMENSIONS)
    raw = F.from_json(fence_stripped(c), schema)
    good = F.lit(True)
    for d in DIMENSIONS:
        good = good & F.coalesce(raw[d].between(0, 10), F.lit(False))
    return F.when(good, F.struct(*[raw[d].cast("int").alias(d) for d in DIMENSIONS]))


def weights(given: dict[str, float] | None = None) -> dict[str, float]:
    """Weights that add up to 1; missing ones are 0; equal ones if nothing positive is given."""
    chosen = {d: float((given or {}).get(d, 0.0)) for d in DIMENSIONS}
    total = sum(chosen.values())
    return {d: w / total for d, w in chosen.items()} if total > 0 else dict.fromkeys(DIMENSIONS, 0.2)


def weighted_score(given: dict[str, float] | None = None, of=F.col) -> Column:
    out = F.lit(0.0)
    for d, w in weights(given).items():
        out = out + of(d) * F.lit(w)
    return out


def answer_text(c: Column) -> Column:
    """.answer of a JSON object if it is a string, else the text, trimmed."""
    parsed = F.try_parse_json(c)
    value = F.try_variant_get(parsed, "$.answer", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(parsed, "$.answer", "string")).otherwise(strip(c))


def joined_answer(c: Column) -> Column:
    """Parts of an answer joined by line feeds, empty ones dropped; null is empty."""
    return F.coalesce(F.array_join(F.filter(c, lambda x: x.isNotNull() & (x != "")), "\n"), F.lit(""))


def reconciled_usage(prompt: Column, completion: Column, total: Column) -> Column:
    """struct(prompt, completion, total): the one that is missing follows from the other two."""
    p = F.coalesce(prompt, total - completion, F.lit(0))
    c = F.coalesce(completion, total - prompt, F.lit(0))
    return F.struct(p.alias("prompt"), c.alias("completion"), F.coalesce(total, p + c).alias("total"))


def remaining_seconds(elapsed: Column, done: Column, total: Column) -> Column:
    return F.try_divide(elapsed, done) * (total - done)


def unit_vector(c: Column) -> Column:
    length = F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))
    return F.transform(c, lambda x: F.try_divide(x.cast("double"), length))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
