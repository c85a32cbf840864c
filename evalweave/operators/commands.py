"""Functions without a native form: shell words, tool commands, balanced JSON. Arrow-batched."""

from __future__ import annotations

import json
import re
import shlex

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_tool(command: str) -> tuple[str, dict[str, list[str]]]:
    """(name, arguments) of `@tool name --key value --flag --queries a b`; raises ValueError if malformed."""
    head, _, rest = command.partition(" ")
    words = shlex.split(rest) if head == "@tool" else []
    if not words:
        raise ValueError("a tool command is '@tool NAME ...'")
    name, out, key = words[0], {}, None
    taken = 0
    for word in words[1:]:
        if word.startswith("--"):
            if key == "queries" and not taken:
                raise ValueError("queries needs a value")
            key, taken = word[2:], 0
            if not key:
                raise ValueError("an argument without a name")
            if key != "queries" or key not in out:
                out[key] = []
        elif key is None or (key != "queries" and taken):
            raise ValueError(f"unexpected: {word}")
        else:
            out[key].append(word)
            taken += 1
    if key == "queries" and not taken:
        raise ValueError("queries needs a value")
    return name, {k: v or ["true"] for k, v in out.items()}


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("name", "args", "error")]))
def tool_command(commands: pd.Series) -> pd.DataFrame:
    rows = []
    for c in commands:
        try:
            name, args = parse_tool(c or "")
            rows.append((name, json.dumps(args), None))
        except ValueError as e:
            rows.append((None, None, str(e)))
    return pd.DataFrame(rows, columns=["name", "args", "error"])


def first_object(text: str) -> str | None:
    """The first balanced {...} that parses to an object; braces are counted whatever the quoting."""
    for start in (m.start() for m in re.finditer(r"\{", text)):
        depth = 0
        for i in range(start, len(text)):
            depth += (text[i] == "{") - (text[i] == "}")
            if depth == 0:
                piece = text[start : i + 1]
                try:
                    if isinstance(json.loads(piece), dict):
                        return piece
                except ValueError:
                    pass
                break
    return None


@F.pandas_udf(T.StringType())
def balanced_object(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: first_object(t) if t else None)


#: Commands whose arguments a read tracker takes for files, those that print paths, options with a
#: value of their own, and words that part one command from the next.
TRACKED = ("cat", "sed", "head", "tail", "rg", "grep")
SEARCHERS = ("rg", "grep")
VALUED = {
    "rg": ("-e", "--regexp", "-f", "--file", "-g", "--glob", "--type", "--type-add", "--type-not", "--type-clear", "--path-separator", "--encoding"),
    "grep": ("-e", "-f", "--regexp", "--file"),
    "sed": ("-e", "-f", "--expression", "--file", "-i", "--in-place"),
    "head": ("-n", "--lines", "-c", "--bytes"),
    "tail": ("-n", "--lines", "-c", "--bytes"),
}
SEPARATORS = ("|", "||", "&&", ";")


def arguments_read(line: str) -> tuple[list[str], bool]:
    """(arguments that may be files, whether a command of the line searches); a line that doesn't parse has none."""
    try:
        words = shlex.split(line)
    except ValueError:
        return [], False
    found, searches, command, valued = [], False, None, False
    for word in words:
        if word in SEPARATORS:
            command, valued = None, False
        elif command is None:
            command, searches = word, searches or word in SEARCHERS
        elif valued or command not in TRACKED:
            valued = False
        elif word in VALUED.get(command, ()):
            valued = True
        elif not word.startswith("-"):
            found.append(word)
    return list(dict.fromkeys(found)), searches


@F.pandas_udf(T.StructType([T.StructField("paths", T.ArrayType(T.StringType())), T.StructField("searches", T.BooleanType())]))
def arguments_of(lines: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([arguments_read(x) if x else ([], False) for x in lines], columns=["paths", "searches"])


#: Commands that read the files they are given.
READERS = ("cat", "head", "tail", "less", "more", "nl", "sed", "awk", "grep", "rg", "wc", "bat")


def files_read(command: str) -> list[str]:
    """Files that a shell line reads: arguments of reading commands in each of its segments, in order, distinct."""
    out = []
    try:
        words = list(shlex.shlex(command, posix=True, punctuation_chars="();<>|&"))
    except ValueError:
        return []
    segment: list[str] = []
    for word in [*words, ";"]:
        if set(word) <= set("();<>|&"):
            if segment and segment[0] in READERS:
                given = [w for w in segment[1:] if not w.startswith("-")]
                given = given[1:] if segment[0] in ("sed", "awk", "grep", "rg") else given
                out += [w for w in given if re.search(r"[./]", w) and not re.search(r"[*?\[]", w)]
            segment = []
        else:
            segment.append(word)
    return list(dict.fromkeys(out))


@F.pandas_udf(T.ArrayType(T.StringType()))
def read_files(commands: pd.Series) -> pd.Series:
    return commands.map(lambda c: files_read(c) if c else [])
