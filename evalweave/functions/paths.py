"""Column functions over paths, ids and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalweave.functions.text import strip

#: Language of a source file by extension, as the chunk index has it.
INDEX_LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".go": "go",
    ".rs": "rust", ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp",
}
#: The same for symbol listing, which tells fewer languages apart.
SYMBOL_LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go", ".rs": "rust"}


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def parent(c: Column) -> Column:
    """The directory of a path, . for a bare name."""
    return F.when(F.contains(c, F.lit("/")), F.regexp_extract(c, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def suffix(c: Column) -> Column:
    return F.lower(F.regexp_extract(basename(c), r"^.+(\.[^.]+)$", 1))


def language(c: Column, table: dict[str, str] = INDEX_LANGUAGES) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), suffix(c))


def normal(c: Column, every: bool = False) -> Column:
    """Trimmed, \\ as /, doubled slashes single, a leading ./ dropped (once, or every one)."""
    out = F.regexp_replace(F.replace(strip(c), F.lit("\\"), F.lit("/")), "/{2,}", "/")
    return F.regexp_replace(out, r"^(\./)+" if every else r"^\./", "")


def tool_path(c: Column) -> Column:
    """A path given to a command, or null for globs, flags, redirects and absolute paths."""
    p = normal(F.regexp_replace(c, r"^['\"]|['\"]$", ""), every=True)
    return F.when((p == "") | p.rlike(r"[*?\[\]<>|]|^-|^/|^[0-9]+>"), F.lit(None)).otherwise(p)


def relative(c: Column, root: Column) -> Column:
    return F.when(F.startswith(c, F.concat(root, F.lit("/"))), F.substring(c, F.length(root) + 2, F.length(c))).otherwise(c)


def repo_folder(c: Column) -> Column:
    return F.replace(c, F.lit("/"), F.lit("_"))


def repo_of_instance(c: Column) -> Column:
    """org__name-123 as org_name."""
    return F.replace(F.regexp_replace(c, r"-\d+$", ""), F.lit("__"), F.lit("_"))


def image_of_instance(c: Column, given: Column, prefix: str) -> Column:
    """The given image name, or one made from a registry prefix and the id, in lower case."""
    return F.coalesce(given, F.lower(F.concat(F.lit(prefix), F.replace(c, F.lit("__"), F.lit("_1776_")), F.lit(":latest"))))


def cleaned(path: Column, repo: Column) -> Column:
    """What follows the repository's name in a path (_ in the name matches _ or /), else what follows the last //."""
    pattern = F.concat(F.lit("(?i)^.*?"), F.regexp_replace(F.regexp_replace(repo, r"([.+*?^$(){}|\[\]\\])", r"\\$1"), "_", "[_/]"), F.lit("/(.*)$"))
    found = F.call_function("regexp_extract", path, pattern, F.lit(1))  # the pattern is a column
    return F.when(found != "", found).when(F.contains(path, F.lit("//")), F.substring_index(path, "//", -1)).otherwise(path)


def sanitized(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_")


def is_test(c: Column) -> Column:
    p = F.lower(normal(c))
    name = basename(p)
    return F.startswith(p, F.lit("tests/")) | F.contains(p, F.lit("/tests/")) | F.startswith(name, F.lit("test_")) | F.endswith(name, F.lit("_test.py"))


def without_tests(c: Column) -> Column:
    """struct(files, fallback): the files that are no tests, or all of them if nothing is left."""
    kept = F.filter(c, lambda x: ~is_test(x))
    return F.when(F.size(kept) > 0, F.struct(kept.alias("files"), F.lit(False).alias("fallback"))).otherwise(F.struct(c.alias("files"), (F.size(c) > 0).alias("fallback")))


def modules(entities: Column) -> Column:
    """file:Class.method as file:Class, distinct in order; entries without a colon are dropped."""
    with_colon = F.filter(entities, lambda e: F.contains(e, F.lit(":")))

    def one(e: Column) -> Column:
        at = F.instr(e, ":")
        head = F.split_part(F.substring(e, at + 1, F.length(e)), F.lit("."), F.lit(1))
        file = F.substring(e, F.lit(1), at - 1)
        return F.when(head == "", file).otherwise(F.concat(file, F.lit(":"), head))

    return F.array_distinct(F.transform(with_colon, one))


def entity_parts(item: Column, last: bool = True) -> Column:
    """struct(file, name) of path:name, cut at the last colon (or the first); null without colon or file."""
    at = F.length(item) - F.instr(F.reverse(item), ":") + 1 if last else F.instr(item, ":")
    file, name = strip(F.substring(item, F.lit(1), at - 1)), strip(F.substring(item, at + 1, F.length(item)))
    return F.when(F.contains(item, F.lit(":")) & (file != ""), F.struct(file.alias("file"), name.alias("name")))


def resolved(c: Column) -> Column:
    """A relative path without empty, . and .. parts; null if it leaves the root on its way, or is the root itself."""
    parts = F.filter(F.split(c, "/"), lambda x: (x != "") & (x != "."))
    none = F.array().cast("array<string>")
    step = lambda acc, x: F.when(x != "..", F.struct(F.concat(acc["s"], F.array(x)).alias("s"), acc["ok"].alias("ok"))).otherwise(
        F.struct(F.when(F.size(acc["s"]) > 1, F.slice(acc["s"], F.lit(1), F.size(acc["s"]) - 1)).otherwise(none).alias("s"), (acc["ok"] & (F.size(acc["s"]) > 0)).alias("ok"))
    )
    end = F.aggregate(parts, F.struct(none.alias("s"), F.lit(True).alias("ok")), step)
    return F.when(end["ok"] & (F.size(end["s"]) > 0) & ~F.startswith(c, F.lit("/")), F.array_join(end["s"], "/"))


def inside(c: Column, *roots: str) -> Column:
    """A path as seen from the repository: relative, or absolute below one of the roots; null for any other and for -."""
    p = strip(c)
    below = [F.when((p == r) | F.startswith(p, F.lit(r.rstrip("/") + "/")), F.substring(p, len(r.rstrip("/")) + 2, 1 << 30)) for r in roots]
    return resolved(F.when((p != "") & (p != "-"), F.coalesce(F.when(~F.startswith(p, F.lit("/")), p), *below)))
