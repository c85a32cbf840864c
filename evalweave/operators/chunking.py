"""Line-window chunks and symbol extraction from source files."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines_of(text: Column) -> Column:
    """Lines without their ends; a trailing line feed makes no empty last line."""
    parts = F.split(text, r"\r\n|\n|\r")
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def windows(files: DataFrame, text: str = "content", size: int = 800, overlap: int = 200) -> DataFrame:
    """One row for each window of lines: start_line and end_line (from 0, inclusive) and its text; blank ones are dropped.

    A window starts every size - overlap lines while lines are left, so the last may lie within the one before.
    """
    step = max(1, size - overlap)
    keep = [c for c in files.columns if c != text]
    df = files.select(*keep, lines_of(F.col(text)).alias("__lines"))
    n = F.size("__lines")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    df = df.select(*keep, "__lines", F.explode(starts).alias("start_line"))
    chunk = F.array_join(F.slice("__lines", F.col("start_line") + 1, F.lit(size)), "\n")
    out = df.select(*keep, "start_line", (F.least(F.col("start_line") + size, n) - 1).alias("end_line"), chunk.alias("text"))
    # The filter stays above the explode: the text of a window is made once.
    return out.where(F.col("text").rlike(r"\S"))


SYMBOLS = "path string, name string, qualname string, kind string, class string, start int, stop int, doc string"
#: How definitions look in languages that are not parsed.
PATTERNS = {
    "class": r"^\s*(?:export\s+)?(?:public\s+|abstract\s+|final\s+)*(?:class|interface|struct|trait|enum)\s+([A-Za-z_]\w*)",
    "function": r"^\s*(?:export\s+)?(?:async\s+)?(?:pub\s+)?(?:func|fn|function)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)",
}


def python_symbols(path: str, source: str) -> list[tuple]:
    """Classes, methods and functions of a Python file, with dotted names; none if it doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out, stack = [], [(tree, [], "")]
    while stack:
        node, outer, owner = stack.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                out.append((path, child.name, ".".join([*outer, child.name]), kind, owner if kind == "method" else None, child.lineno, child.end_lineno, ast.get_docstring(child)))
                stack.append((child, [*outer, child.name], child.name if kind == "class" else ""))
            else:
                stack.append((child, outer, owner))
    return sorted(out, key=lambda s: (s[5], s[1]))


def other_symbols(path: str, source: str) -> list[tuple]:
    """Definitions found by pattern; a block ends where its braces balance."""
    lines, out = source.splitlines(), []
    for i, line in enumerate(lines):
        for kind, pattern in PATTERNS.items():
            if found := re.match(pattern, line):
                depth, stop, seen = 0, i, False
                for j in range(i, len(lines)):
                    depth += lines[j].count("{") - lines[j].count("}")
                    seen = seen or "{" in lines[j]
                    stop = j
                    if seen and depth <= 0:
                        break
                out.append((path, found[1], found[1], kind, None, i + 1, (stop if seen else i) + 1, None))
                break
    return out


def symbols(files: DataFrame) -> DataFrame:
    """files (path, content) -> a row for each symbol; files that fail give none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SYMBOLS.split(", ")]
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                rows += (python_symbols if path.endswith(".py") else other_symbols)(path, content or "")
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, SYMBOLS)


def function_index(found: DataFrame) -> DataFrame:
    """key -> (file, name, qualname) by full name, last two parts and last part."""
    functions = found.where("kind != 'class'")
    q = F.col("qualname")
    keys = F.array_distinct(F.array(q, F.substring_index(q, ".", -2), F.substring_index(q, ".", -1)))
    return functions.select(F.explode(keys).alias("key"), F.col("path").alias("file"), "name", "qualname")


def calls_and_imports(files: DataFrame) -> DataFrame:
    """(path, kind, source, target): kind call (caller, callee) or import (line, module) of Python files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    tree = ast.parse(content or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
                for node in ast.walk(tree):
                    if isinstance(node, ast.Import):
                        rows += [(path, "import", str(node.lineno), a.name) for a in node.names]
                    elif isinstance(node, ast.ImportFrom) and node.module:
                        rows.append((path, "import", str(node.lineno), node.module))
                    elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                        called = {c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name | ast.Attribute)}
                        rows += [(path, "call", node.name, name) for name in sorted(called)]
            yield pd.DataFrame(rows, columns=["path", "kind", "source", "target"])

    return files.select("path", "content").mapInPandas(run, "path string, kind string, source string, target string")
