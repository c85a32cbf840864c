"""File skeletons: imports, symbols with the ends of their blocks, and what of them is shown for a query under a budget.

Symbols of files that aren't parsed are found line by line, and their blocks end where braces balance. Braces are
matched by running depth: an opening brace at some depth and the next closing one at that depth are a pair. One
shuffle by file serves all windows; each is linear in the file's lines and braces.

Defined cases: a null content is empty, blank lines hold nothing, a block that never closes ends on its first line.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions import text
from evalweave.operators.ranking import symbol_order

#: Lines that are imports, and lines that begin a class or a function, the first pattern that fits wins.
IMPORT_LINES = (
    r"^\s*#include\s+[<\"].+[>\"]\s*$",
    r"^\s*import\s+.+$",
    r"^\s*from\s+\S+\s+import\s+.+$",
    r"^\s*(?:const|let|var)\s+\w+\s*=\s*require\(.+\)\s*;?\s*$",
)
CLASS_LINES = (
    r"^\s*(?:export\s+)?class\s+([A-Za-z_]\w*)",
    r"^\s*(?:class|struct|interface|enum)\s+([A-Za-z_]\w*)",
)
FUNCTION_LINES = (
    r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(",
    r"^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_]\w*)\s*\(",
    r"^\s*func\s+([A-Za-z_]\w*)\s*\(",
    r"^\s*(?:pub\s+)?fn\s+([A-Za-z_]\w*)\s*\(",
    r"^\s*(?:public|private|protected|static|final|virtual|inline|\s)+[A-Za-z_][\w:<>,\s*&\[\]]+\s+([A-Za-z_]\w*)\s*\([^;]*\)\s*(?:\{|$)",
)
#: What ends a line.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

_SKELETON = "path string, part string, line int, name string, kind string, start int, stop int, signature string, doc string"


def source_lines(files: DataFrame) -> DataFrame:
    """files (path, content) -> path, line (from 1), text. The content goes no further than this."""
    parts = F.split(F.coalesce("content", F.lit("")), LINE_ENDS)
    return files.select("path", F.posexplode(parts).alias("line", "text")).select("path", (F.col("line") + 1).alias("line"), "text")


def _first_name(patterns: tuple[str, ...]) -> Column:
    found = [F.nullif(F.regexp_extract("text", "(?U)" + p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*found)


def import_lines(lines: DataFrame) -> DataFrame:
    """path, line, text (trimmed) of each import."""
    hit = F.lit(False)
    for p in IMPORT_LINES:
        hit = hit | F.col("text").rlike("(?U)" + p)
    return lines.where(hit).select("path", "line", text.strip(F.col("text")).alias("text"))


def block_ends(lines: DataFrame) -> DataFrame:
    """Adds stop to the lines that begin a block (name not null): the line where the first brace from there on closes.

    Closing braces before that opening one don't count. lines: path, line, text, name, and what is to be kept.
    """
    heads = lines.where("name is not null").withColumn("k", F.lit(-1))
    chars = lines.select("path", "line", F.posexplode(F.regexp_extract_all("text", F.lit("[{}]"), F.lit(0))).alias("k", "brace"))
    per = Window.partitionBy("path")
    after = F.sum(F.when(F.col("brace") == "{", 1).otherwise(-1)).over(per.orderBy("line", "k"))
    level = F.col("depth") + F.when(F.col("brace") == "{", 0).otherwise(1)
    pairs = chars.withColumn("depth", after).withColumn("level", level)
    pairs = pairs.withColumn("closes", F.lead("line").over(Window.partitionBy("path", "level").orderBy("line", "k")))
    opening = pairs.where("brace = '{'").select("path", "line", "k", F.struct(F.col("closes")).alias("open"))
    both = heads.unionByName(opening, allowMissingColumns=True)
    # From the last line up, so that the frame grows by a row at a time.
    nearest = F.last("open", ignorenulls=True).over(per.orderBy(F.desc("line"), F.desc("k")).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("stop", F.coalesce(nearest["closes"], F.col("line"))).where("name is not null").drop("k", "open")


def line_symbols(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, imports) of files found by their lines. symbols: path, name, kind, start, stop, signature, doc (null)."""
    lines = source_lines(files)
    cls, function = _first_name(CLASS_LINES), _first_name(FUNCTION_LINES)
    named = lines.withColumn("name", F.coalesce(cls, function)).withColumn("kind", F.when(cls.isNotNull(), "class").otherwise("function"))
    ends = block_ends(named)
    signature = text.strip(F.regexp_replace(text.strip(F.col("text")), r"\{+$", ""))
    found = ends.select("path", "name", "kind", F.col("line").alias("start"), "stop", signature.alias("signature"), F.lit(None).cast("string").alias("doc"))
    return found, import_lines(lines)


def _parsed(path: str, source: str) -> list[tuple]:
    """Rows of one Python file; a single row `failed` if it doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [(path, "failed", *[None] * 7)]
    rows: list[tuple] = []

    def add(node, name: str, kind: str) -> None:
        if kind == "class":
            bases = ", ".join(map(ast.unparse, node.bases))
            signature = f"class {node.name}({bases})" if bases else f"class {node.name}"
        else:
            signature = f"{'async ' if isinstance(node, ast.AsyncFunctionDef) else ''}def {node.name}{ast.unparse(node.args)}"
        rows.append((path, "symbol", node.lineno, name, kind, node.lineno, node.end_lineno, signature, ast.get_docstring(node)))

    todo: list[tuple] = [(node, "") for node in tree.body]
    while todo:
        node, outer = todo.pop()
        if isinstance(node, ast.ClassDef):
            name = f"{outer}.{node.name}" if outer else node.name
            add(node, name, "class")
            todo += [(child, name) for child in node.body if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef)]
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            add(node, f"{outer}.{node.name}" if outer else node.name, "method" if outer else "function")
        elif isinstance(node, ast.Import | ast.ImportFrom):
            names = ", ".join(a.name for a in node.names)
            words = f"import {names}" if isinstance(node, ast.Import) else f"from {'.' * node.level}{node.module or ''} import {names}"
            rows.append((path, "import", node.lineno, words, *[None] * 5))
    return rows


def skeletons(files: DataFrame, max_symbols: int = 500, max_imports: int = 200) -> tuple[DataFrame, DataFrame]:
    """(symbols, imports) of files (path, content): Python files are parsed, all others and those that fail go by line.

    Each file shows its first max_symbols symbols by start and name, and its first max_imports imports by line.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _SKELETON.split(", ")]
        for f in frames:
            rows = [r for path, content in zip(f["path"], f["content"], strict=True) for r in _parsed(path, content or "")]
            yield pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in ("line", "start", "stop")})

    python = F.lower("path").endswith(".py")
    parsed = files.where(python).select("path", "content").mapInPandas(run, _SKELETON)
    failed = files.join(parsed.where("part = 'failed'").select("path").distinct(), "path", "left_semi")
    by_line, lines = line_symbols(files.where(~python).select("path", "content").unionByName(failed.select("path", "content")))
    known = parsed.where("part = 'symbol'").select("path", "name", "kind", "start", "stop", "signature", text.first_sentence(F.col("doc")).alias("doc"))
    imports = parsed.where("part = 'import'").select("path", "line", F.col("name").alias("text")).unionByName(lines)
    place = F.row_number().over(Window.partitionBy("path").orderBy("start", "name", "kind", "stop"))
    at = F.row_number().over(Window.partitionBy("path").orderBy("line", "text"))
    symbols = known.unionByName(by_line).withColumn("place", place).where(F.col("place") <= max_symbols)
    return symbols, imports.withColumn("place", at).where(F.col("place") <= max_imports)


def budgets(n: Column, place: Column, total: int) -> Column:
    """A file's share of the characters: 60/40 for two, 50/30/20 for three, then 50/30/15 and the rest alike, the last with what is left."""
    part = lambda share: F.floor(F.lit(total * share)).cast("long")
    tail = F.lit(total) - part(0.5) - part(0.3) - part(0.15)
    two = F.when(place == 1, part(0.6)).otherwise(F.lit(total) - part(0.6))
    three = F.when(place == 1, part(0.5)).when(place == 2, part(0.3)).otherwise(F.lit(total) - part(0.5) - part(0.3))
    each = F.floor(tail / F.greatest(n - 3, F.lit(1))).cast("long")
    many = F.when(place == 1, part(0.5)).when(place == 2, part(0.3)).when(place == 3, part(0.15)).when(place < n, each).otherwise(tail - each * (n - 4))
    return F.when(n == 1, F.lit(total).cast("long")).when(n == 2, two).when(n == 3, three).otherwise(many)


def rendered(include_doc: Column, signature: bool = False) -> Column:
    """name(kind)[Lstart-Lstop], with the signature and the first sentence of its doc where asked for, cut with dots."""
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)\s+", " "))
    base = F.concat(clean("name"), F.lit("("), clean("kind"), F.lit(")[L"), F.col("start"), F.lit("-L"), F.col("stop"), F.lit("]"))
    if signature:
        base = F.concat(base, F.when(clean("signature") != "", F.concat(F.lit(":"), clean("signature"))).otherwise(F.lit("")))
    whole = F.when(include_doc & (clean("doc") != ""), F.concat(base, F.lit(": "), clean("doc"))).otherwise(base)
    most = F.when(include_doc, 180).otherwise(140)
    return F.when(F.length(whole) > most, F.concat(F.substring(whole, F.lit(1), most - 3), F.lit("..."))).otherwise(whole)


def assembled(
    ranked: DataFrame, symbols: DataFrame, imports: DataFrame, files: DataFrame, topn: int = 3, budget_chars: int = 4000, max_imports: int = 6, max_symbols: int = 14, signature: bool = False, query_aware: bool = True
) -> DataFrame:
    """What is shown of the `topn` first files of each query: anchors, glimpses, counts of what is folded, a scope line.

    ranked: query_id, query, rank, path, score, evidence_count. Symbols are put in order once (query tokens in the
    name, kind, length, then place). The first two that hold a token are anchors; glimpses are the first of each kind
    among the others, then the others by rank, three of them (five in a first file without anchors). `preview` holds
    anchors, then glimpses, as far as the file's share of the budget goes, by running sums of their lengths.
    """
    raw_symbols, raw_imports = min(2000, max(200, max(1, max_symbols) * 10)), min(1000, max(200, max_imports * 10)) if max_imports > 0 else 0
    limit, found = max(1, max_symbols), F.col("tokens")
    top = ranked.withColumn("place_of_file", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "path"))).where(F.col("place_of_file") <= topn)
    top = top.withColumn("n_files", F.count("*").over(Window.partitionBy("query_id")))
    top = top.withColumn("tokens", text.tokens(F.col("query")) if query_aware else F.array().cast("array<string>"))
    key = ["query_id", "place_of_file"]

    rows = top.select(*key, "path", "tokens").join(symbols.where(F.col("place") <= raw_symbols), "path")
    order = symbol_order(found, F.col("name"), F.col("kind"), F.col("start"), F.col("stop"))
    per = Window.partitionBy(*key)
    by_rank = per.orderBy(F.desc("order"), "place")
    same = ["name", "start", "stop", "kind"]
    rows = rows.withColumn("order", order).withColumn("hit", F.col("order.overlap") > 0).withColumn("at", F.row_number().over(by_rank))
    rows = rows.withColumn("anchor", F.col("hit") & (F.col("at") <= min(2, limit)))  # hits come first
    rows = rows.withColumn("as_anchor", F.max("anchor").over(Window.partitionBy(*key, *same))).withColumn("n_anchors", F.sum(F.col("anchor").cast("int")).over(per))
    rows = rows.withColumn("of_kind", F.row_number().over(Window.partitionBy(*key, "as_anchor", "kind").orderBy("at")))
    rows = rows.withColumn("leads", ~F.col("as_anchor") & (F.col("of_kind") == 1))
    rows = rows.withColumn("as_lead", F.max("leads").over(Window.partitionBy(*key, *same))).withColumn("free", ~F.col("as_anchor") & (F.col("leads") | ~F.col("as_lead")))
    turn = F.row_number().over(Window.partitionBy(*key, "free").orderBy(F.desc("leads"), "at"))
    most = F.least(F.lit(limit), F.when((F.col("place_of_file") == 1) & (F.col("n_anchors") == 0), 5).otherwise(3))
    rows = rows.withColumn("turn", turn).withColumn("glimpse", F.col("free") & (F.col("turn") <= most))
    rows = rows.withColumn("shown", F.col("anchor") | F.col("glimpse")).withColumn("text", rendered(F.col("glimpse"), signature))

    # Running length of what is shown, two characters between two; the first item beyond the share ends the preview.
    top = top.withColumn("budget", budgets(F.col("n_files"), F.col("place_of_file"), budget_chars))
    turn_of = F.when(F.col("anchor"), F.col("at")).otherwise(F.lit(1000) + F.col("turn"))
    shown = rows.where("shown").withColumn("turn_of", turn_of).join(top.select(*key, "budget"), key)
    run = F.sum(F.length("text") + 2).over(per.orderBy("turn_of")) - 2
    shown = shown.withColumn("fits", run <= F.col("budget")).select(*key, "turn_of", "anchor", "text", "fits", "name", "kind", "start", "stop")

    items = lambda c, v="text": F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("turn_of", v)))), lambda x: x[v])
    previews = shown.groupBy(*key).agg(
        items(F.col("anchor")).alias("anchors"), items(~F.col("anchor")).alias("glimpses"), F.array_join(items(F.col("fits")), ", ").alias("preview"), F.max(~F.col("fits")).alias("truncated"),
        F.min(F.when(F.col("anchor"), F.struct("turn_of", F.struct("name", "kind", "start", "stop").alias("a")))).alias("first"),
    )
    scope = scopes(rows, key)
    n_imports = imports.where(F.col("place") <= raw_imports).groupBy("path").agg(F.count("*").alias("import_count"))
    known = files.select("path", F.lit(True).alias("known")).distinct()
    out = top.join(known, "path", "left").join(n_imports, "path", "left").join(scope, key, "left").join(previews, key, "left")
    none, zero = F.array().cast("array<string>"), F.lit(0).cast("long")
    n = lambda c: F.size(F.coalesce(c, none)).cast("long")
    error = F.when(F.trim(F.coalesce("path", F.lit(""))) == "", "empty_path").when(F.col("known").isNull(), "not_found").otherwise("")
    return out.select(
        "query_id", F.col("place_of_file").alias("rank"), "path", "score", "evidence_count", F.col("budget").alias("budget_chars"),
        F.array_join(F.coalesce("anchors", none), ", ").alias("anchors_preview"), n("anchors").alias("anchor_count"), F.col("first.a").alias("primary_anchor"),
        F.array_join(F.coalesce("glimpses", none), ", ").alias("glimpse_preview"), n("glimpses").alias("glimpse_count"),
        F.coalesce("preview", F.lit("")).alias("preview"), F.coalesce("truncated", F.lit(False)).alias("truncated"),
        F.coalesce("import_count", zero).alias("import_count"), F.coalesce("symbol_count", zero).alias("symbol_count"),
        F.greatest(zero, F.coalesce("symbol_count", zero) - n("anchors") - n("glimpses")).alias("folded_symbols"), F.coalesce("scope", F.lit("")).alias("scope"), error.alias("error"),
    )


def scopes(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, symbol_count, scope: how many classes, methods and functions, and the two classes with most methods."""
    kind = F.lower(F.trim("kind"))
    counts = rows.groupBy(*key).agg(F.count("*").alias("symbol_count"), *[F.count(F.when(kind == k, 1)).alias(k) for k in ("class", "method", "function")])
    owner = F.trim(F.substring_index("name", ".", 1))
    owned = rows.where((kind == "method") & F.contains("name", F.lit(".")) & (owner != "")).groupBy(*key, owner.alias("owner")).agg(F.count("*").alias("n"), F.min("place").alias("place"))
    best = owned.withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), F.lower("owner"), "place"))).where("at <= 2")
    named = best.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "owner", "n"))), lambda x: F.concat(x.owner, F.lit("("), x.n, F.lit(")"))), ", ").alias("owners"))
    plain = F.concat(F.lit("classes="), F.col("class"), F.lit(", methods="), F.col("method"), F.lit(", functions="), F.col("function"))
    scope = F.when(F.col("owners").isNotNull(), F.concat(plain, F.lit(", top_method_classes="), F.col("owners"))).otherwise(plain)
    return counts.join(named, key, "left").select(*key, "symbol_count", scope.alias("scope"))
