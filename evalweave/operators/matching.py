"""Joins by name, path and line interval. Every theta join is blocked on a derived equality key first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions.paths import basename, normal
from evalweave.functions.paths import resolved as resolved_path


def query_keys(name: Column) -> Column:
    """array of struct(priority, key): the full name, its last two parts, its last part."""
    parts = F.filter(F.split(name, r"\."), lambda p: p != "")
    last = F.element_at(parts, -1)
    keys = F.when(F.contains(name, F.lit(".")) & (F.size(parts) >= 2), F.array(name, F.array_join(F.slice(parts, -2, 2), "."), last)).when(F.contains(name, F.lit(".")), F.array(name, last)).otherwise(F.array(name))
    return F.transform(F.array_distinct(keys), lambda k, i: F.struct(i.alias("priority"), k.alias("key")))


def candidates(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Each query's candidates from a function index, once each, with the priority of the key that found them.

    queries: query_id, function, file_hint. index: key, file, name, qualname.
    """
    keyed = queries.where(F.col("function") != "").select("*", F.inline(query_keys(F.col("function"))))
    found = keyed.join(index, "key")
    return found.groupBy("query_id", "function", "file_hint", "file", "qualname", "name").agg(F.min("priority").alias("priority"))


def match_rank(query: Column, qualname: Column, name: Column) -> Column:
    """struct(level, distance): 0 equal, 1 suffix, 2 same last two parts, 3 same leaf, 4 none."""
    tail2 = lambda c: F.substring_index(c, ".", -2)
    dotted = F.contains(query, F.lit("."))
    rank = lambda level, far=F.lit(0): F.struct(F.lit(level).alias("level"), far.cast("int").alias("distance"))
    return (
        F.when(query == "", rank(4))
        .when(query == qualname, rank(0))
        .when(F.endswith(qualname, F.concat(F.lit("."), query)), rank(1, F.length(qualname) - F.length(query)))
        .when(dotted & F.contains(qualname, F.lit(".")) & (tail2(query) == tail2(qualname)), rank(2))
        .when(F.substring_index(query, ".", -1) == name, rank(3, F.when(dotted, F.lit(0)).otherwise(F.lit(1))))
        .otherwise(rank(4))
    )


def hint_rank(hint: Column, path: Column) -> Column:
    """0 equal, 1 suffix, 2 base name, 3 substring, null for no match; both in lower case with /."""
    h, p = F.lower(normal_hint(hint)), F.lower(normal_hint(path))
    some = (h != "") & (p != "")
    return F.when(some & (h == p), 0).when(some & F.endswith(p, F.concat(F.lit("/"), h)), 1).when(some & (basename(p) == h), 2).when(some & F.contains(p, h), 3)


def normal_hint(c: Column) -> Column:
    return F.trim(F.replace(c, F.lit("\\"), F.lit("/")))


def best_matches(found: DataFrame, top_k: int = 10) -> DataFrame:
    """Of each query's candidates the best: with a hint all that tie at the best rank, else the first by rank; top_k at most."""
    hinted = found.withColumn("fn", match_rank(F.col("function"), F.col("qualname"), F.col("name"))).withColumn("path_rank", hint_rank(F.col("file_hint"), F.col("file")))
    per = Window.partitionBy("query_id")
    hinted = hinted.withColumn("any_path", F.max(F.col("path_rank").isNotNull()).over(per)).withColumn("n", F.count("*").over(per))
    has_hint = F.coalesce(F.col("file_hint"), F.lit("")) != ""
    h, p = F.lower(normal_hint(F.col("file_hint"))), F.lower(normal_hint(F.col("file")))
    far = F.when(F.col("any_path"), F.col("path_rank")).otherwise(F.least(F.levenshtein(h, p), F.levenshtein(h, basename(p))))
    kept = hinted.where(~has_hint | ~F.col("any_path") | F.col("path_rank").isNotNull())
    key = F.when(has_hint, F.struct("fn.level", "fn.distance", far.alias("far"))).when(F.col("n") > 1, F.struct("fn.level", "fn.distance", F.lit(0).alias("far")))
    ranked = kept.withColumn("key", key).withColumn("rank", F.rank().over(per.orderBy("key"))).withColumn("place", F.row_number().over(per.orderBy("key", "priority", "file", "qualname")))
    return ranked.where((~has_hint | (F.col("rank") == 1)) & (F.col("place") <= top_k)).select("query_id", "function", "file_hint", "file", "qualname", "place")


def answered(queries: DataFrame, index: DataFrame, top_k: int = 10) -> DataFrame:
    """best_matches() of the candidates of each query; what several queries ask alike is matched once.

    queries: query_id, function, file_hint. index: key, file, name, qualname.
    """
    said = queries.where(F.col("function") != "").groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct("function", "file_hint"))).alias("asked"))
    once = said.select("asked").distinct().select(F.col("asked").alias("query_id"), F.inline("asked"))
    best = best_matches(candidates(once, index), top_k).withColumnRenamed("query_id", "asked")
    return said.join(best, "asked").select("query_id", "function", "file_hint", "file", "qualname", "place")


def path_hits(pred: Column, truth: Column) -> Column:
    """A path is in a set: equal, a suffix either way, or by a base name that the set has once."""
    p = normal(pred)
    slash = lambda x: F.concat(F.lit("/"), x)
    same = F.size(F.filter(truth, lambda g: basename(g) == basename(p))) == 1
    near = F.exists(truth, lambda g: (g == p) | F.endswith(g, slash(p)) | F.endswith(p, slash(g)))
    return (p != "") & (F.size(truth) > 0) & (near | ((basename(p) != "") & same))


def hint_observed(hint: Column, seen: Column) -> Column:
    """Equal, suffix, same base name or substring of something seen."""
    return (hint != "") & F.exists(seen, lambda s: (s == hint) | F.endswith(s, F.concat(F.lit("/"), hint)) | (basename(s) == basename(hint)) | F.contains(s, hint))


def hint_inspected(hint: Column, seen: Column) -> Column:
    """Equal, the end of an inspected file where the hint has a slash, or a base name that one inspected file has."""
    alone = F.size(F.filter(seen, lambda s: basename(s) == basename(hint))) == 1
    slash = F.contains(hint, F.lit("/"))
    return (hint != "") & (F.exists(seen, lambda s: (s == hint) | (slash & F.endswith(s, hint))) | alone)


def hint_in_scope(hint: Column, scope: Column) -> Column:
    """Equal, a suffix either way, or a base name that the scope has once."""
    return path_hits(hint, scope)


def resolved(requested: Column, allowed: Column) -> Column:
    """The allowed file that is meant: equal, else the only one of its base name, else the only suffix; null if none."""
    pick = lambda found: F.when(F.size(found) == 1, F.get(found, F.lit(0)))
    inside = ~requested.rlike(r"(^|/)\.\.(/|$)|^/")
    by_name = F.when(~F.contains(requested, F.lit("/")), pick(F.filter(allowed, lambda a: basename(a) == requested)))
    by_end = pick(F.filter(allowed, lambda a: F.endswith(a, F.concat(F.lit("/"), requested))))
    return F.when(inside, F.coalesce(F.when(F.array_contains(allowed, requested), requested), by_name, by_end))


#: Hints of up to so many characters meet the paths whole.
GRAM = 6


def hint_join(hints: DataFrame, files: DataFrame) -> DataFrame:
    """hints (hint) x files (path) where the hint matches the path, with its rank: whatever matches lies in the path.

    Hints and paths meet on pieces of the path of 1 to GRAM characters: a short hint on itself, a longer one on its
    piece that the fewest paths hold. Neither side is broadcast, as pieces outnumber what a plan expects of them.
    """
    h = hints.select("hint").distinct().withColumn("h", F.lower(normal_hint(F.col("hint")))).where("h != ''")
    f = files.select("path").distinct().withColumn("p", F.lower(normal_hint(F.col("path"))))
    starts = lambda c, n: F.filter(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: i <= F.length(c) - (n - 1))
    parts = lambda c, n: F.transform(starts(c, n), lambda i: F.substring(c, i, F.lit(n)))
    grams = lambda c, ns: F.explode(F.array_distinct(F.concat(*[parts(c, n) for n in ns])))
    long = h.where(F.length("h") > GRAM).select("hint", "h", grams(F.col("h"), [GRAM]).alias("gram"))
    held = f.select(grams(F.col("p"), [GRAM]).alias("gram")).groupBy("gram").count()
    rare = long.join(held.hint("merge"), "gram").groupBy("hint", "h").agg(F.min_by("gram", F.struct("count", "gram")).alias("gram"))
    asked = h.where(F.length("h") <= GRAM).select("hint", "h", F.col("h").alias("gram")).unionByName(rare)
    met = asked.join(f.select("path", grams(F.col("p"), range(1, GRAM + 1)).alias("gram")).hint("merge"), "gram")
    return met.select("hint", "path", hint_rank(F.col("hint"), F.col("path")).alias("rank")).where("rank is not null")


def line_entities(blocks: DataFrame, definitions: DataFrame) -> DataFrame:
    """Entities of each block: for every line, the innermost definition that covers it.

    blocks: block_id, path, start_line, end_line. definitions: path, qualname, start, stop. Intervals meet on the
    path and on a 64-line cell, so that a long file is no hot key; the lines of the overlap are then exploded.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 64), F.floor(F.col(b) / 64)))
    left = blocks.select("block_id", "path", "start_line", "end_line", cells("start_line", "end_line").alias("cell"))
    right = definitions.select("path", "qualname", "start", "stop", cells("start", "stop").alias("cell"))
    low = F.greatest("start_line", "start", F.col("cell") * 64)
    high = F.least("end_line", "stop", F.col("cell") * 64 + 63)
    met = left.join(right, ["path", "cell"]).withColumn("low", low).withColumn("high", high).where("low <= high")
    lines = met.select("block_id", "path", "qualname", "start", "stop", F.explode(F.sequence("low", "high")).alias("line"))
    inner = lines.groupBy("block_id", "path", "line").agg(F.max_by("qualname", F.struct(F.col("start"), -F.col("stop"), F.col("qualname"))).alias("qualname"))
    return inner.select("block_id", "path", "qualname").distinct()


def capped_entities(found: DataFrame, most: int = 50) -> DataFrame:
    """The first `most` entities in the order of file, block and name. found: file_no, block_no, name, entity."""
    first = found.groupBy("entity").agg(F.min(F.struct("file_no", "block_no", "name")).alias("at"))
    return first.orderBy("at", "entity").limit(most).select("entity")


def graph_entities(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """Spans that are nodes of the graph, with the node's type. spans: path, span. nodes: node_id, type."""
    return spans.withColumn("node_id", F.concat_ws(":", "path", "span")).join(nodes, "node_id")


def import_edges(files: DataFrame) -> DataFrame:
    """file -> file by import: the module equals another file's dotted path or a suffix of it; the first file per import.

    files: file_no, path, imports (modules).
    """
    dotted = F.replace(F.regexp_replace("path", r"(/__init__)?\.py$", ""), F.lit("/"), F.lit("."))
    parts = files.select(F.col("file_no").alias("to_no"), F.col("path").alias("target"), F.split(dotted, r"\.").alias("parts"))
    variants = parts.select("to_no", "target", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", -i, i), "."))).alias("module"))
    wanted = files.select("path", F.explode(F.array_distinct("imports")).alias("import"))
    tails = F.transform(F.sequence(F.lit(1), F.size(F.split("import", r"\."))), lambda i: F.array_join(F.slice(F.split("import", r"\."), -i, i), "."))
    keyed = wanted.select("path", "import", F.explode(tails).alias("module"))
    hit = keyed.join(variants, "module").where("path != target")
    return hit.groupBy("path", "import").agg(F.min_by("target", "to_no").alias("target")).select("path", "target").distinct()


def inverted(edges: DataFrame) -> DataFrame:
    """callee -> its callers in order."""
    return edges.groupBy("callee").agg(F.sort_array(F.collect_set("caller")).alias("callers"))


def existing(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates whose path is one of the files once its . and .. are resolved; those that leave the root never are. Both: path."""
    inside = candidates.withColumn("__p", resolved_path(normal(F.col("path"))))
    return inside.join(files.select(F.col("path").alias("__p")).distinct(), "__p", "left_semi").drop("__p")
