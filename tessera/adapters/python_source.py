"""Symbols, imports, calls and data flow of Python source, by the standard library's syntax tree.

Each function is for mapInPandas over (file, source) and yields the rows of a batch of files at once; a file that doesn't parse yields none.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

SYMBOLS = "file string, qname string, kind string, start_line int, end_line int, signature string, doc string"
NAMES = "file string, qname string"
IMPORTS = "file string, local string, target string"
SITES = "file string, imports array<struct<local: string, target: string>>, calls array<struct<caller: string, callee: string, line: int>>"
ARGUMENTS = "file string, caller string, callee string, position int, argument string, line int"
MASKED = "file string, masked string"


def _trees(frame):
    for file, source in zip(frame["file"], frame["source"]):
        try:
            yield file, source, ast.parse(source or "")
        except (SyntaxError, ValueError):
            continue


def _module(file: str) -> str:
    return file.rsplit(".", 1)[0].replace("/", ".")


def _definitions(tree: ast.Module, prefix: str):
    """(qname, kind, node) of functions, methods and classes, outer before inner."""
    stack = [(child, prefix, False) for child in reversed(tree.body)]
    while stack:
        node, outer, in_class = stack.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            name = f"{outer}.{node.name}"
            is_class = isinstance(node, ast.ClassDef)
            yield name, "class" if is_class else "method" if in_class else "function", node
            stack += [(child, name, is_class) for child in reversed(node.body)]


def _rows(found: list[tuple], ddl: str) -> pd.DataFrame:
    return pd.DataFrame(found, columns=[c.split()[0] for c in ddl.split(", ")])


def symbols(files: DataFrame) -> DataFrame:
    def run(frames):
        for frame in frames:
            found = []
            for file, _, tree in _trees(frame):
                for name, kind, node in _definitions(tree, _module(file)):
                    signature = f"class {node.name}" if kind == "class" else f"def {node.name}({ast.unparse(node.args)})"
                    found.append((file, name, kind, node.lineno, node.end_lineno, signature, ast.get_docstring(node)))
            yield _rows(found, SYMBOLS)

    return files.select("file", "source").mapInPandas(run, SYMBOLS)


def _imported(file: str, tree: ast.Module):
    """(local, target) of a file's imports."""
    package = _module(file).split(".")
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            yield from ((a.asname or a.name.split(".")[0], a.name) for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            base = ".".join([*package[: len(package) - node.level], *filter(None, [node.module])]) if node.level else node.module or ""
            yield from ((a.asname or a.name, f"{base}.{a.name}") for a in node.names)


def imports(files: DataFrame) -> DataFrame:
    """Local names and what they stand for; relative imports are made absolute."""

    def run(frames):
        for frame in frames:
            yield _rows([(file, *x) for file, _, tree in _trees(frame) for x in _imported(file, tree)], IMPORTS)

    return files.select("file", "source").mapInPandas(run, IMPORTS)


def _called(node: ast.Call) -> str | None:
    inner, parts = node.func, []
    while isinstance(inner, ast.Attribute):
        parts.append(inner.attr)
        inner = inner.value
    if isinstance(inner, ast.Name):  # as unparse() writes it
        name = ".".join([inner.id, *reversed(parts)])
    elif isinstance(inner, ast.Constant):
        try:
            name = ast.unparse(node.func)
        except (ValueError, RecursionError):
            return None
    else:  # brackets, operators or blanks
        return None
    return name if name.replace(".", "").replace("_", "").isalnum() else None


def _sites(file: str, tree: ast.Module):
    """(caller, callee, line) of the calls in a file's functions."""
    for name, kind, node in _definitions(tree, _module(file)):
        if kind != "class":
            yield from ((name, c, n.lineno) for n in ast.walk(node) if isinstance(n, ast.Call) and (c := _called(n)))


def names(files: DataFrame) -> DataFrame:
    """(file, qname) of symbols, without what is read from their bodies."""

    def run(frames):
        for frame in frames:
            yield _rows([(file, name) for file, _, tree in _trees(frame) for name, _, _ in _definitions(tree, _module(file))], NAMES)

    return files.select("file", "source").mapInPandas(run, NAMES)


def sites(files: DataFrame) -> DataFrame:
    """The imports and the calls of a file, which is parsed once for both: a row for each that parses.  They are resolved by joins with symbols."""

    def run(batches):
        pairs, calls_ = (pa.list_(pa.struct([(c, pa.string()) for c in ("local", "target")])), pa.list_(pa.struct([("caller", pa.string()), ("callee", pa.string()), ("line", pa.int32())])))
        for batch in batches:
            files_, imports_, found = [], [], []
            for file, _, tree in _trees(batch.to_pydict()):
                files_.append(file)
                imports_.append([{"local": a, "target": b} for a, b in _imported(file, tree)])
                found.append([{"caller": a, "callee": b, "line": c} for a, b, c in _sites(file, tree)])
            yield pa.RecordBatch.from_arrays([pa.array(files_, pa.string()), pa.array(imports_, pairs), pa.array(found, calls_)], names=["file", "imports", "calls"])

    return files.select("file", "source").mapInArrow(run, SITES)


def arguments(files: DataFrame) -> DataFrame:
    """Arguments that are plain names, with their position."""

    def run(frames):
        for frame in frames:
            found = []
            for file, _, tree in _trees(frame):
                for name, kind, node in _definitions(tree, _module(file)):
                    if kind != "class":
                        for n in ast.walk(node):
                            if isinstance(n, ast.Call) and (c := _called(n)):
                                found += [(file, name, c, i, a.id, n.lineno) for i, a in enumerate(n.args) if isinstance(a, ast.Name)]
            yield _rows(found, ARGUMENTS)

    return files.select("file", "source").mapInPandas(run, ARGUMENTS)


def masked(files: DataFrame) -> DataFrame:
    """The source with comments and string bodies blanked, of the same length."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"file": frame["file"], "masked": [_mask(s or "") for s in frame["source"]]})

    return files.select("file", "source").mapInPandas(run, MASKED)


def _mask(source: str) -> str:
    out, i, n = [], 0, len(source)
    while i < n:
        c = source[i]
        if c == "#":
            end = source.find("\n", i)
            end = n if end < 0 else end
            out.append(" " * (end - i))
            i = end
        elif c in "'\"":
            quote = c * 3 if source.startswith(c * 3, i) else c
            j = i + len(quote)
            while j < n and not source.startswith(quote, j) and (len(quote) == 3 or source[j] != "\n"):
                j += 2 if source[j] == "\\" else 1
            j = min(j, n)
            body = source[i + len(quote) : j]
            out.append(quote + "".join("\n" if x == "\n" else " " for x in body))
            i = j
            if source.startswith(quote, i):
                out.append(quote)
                i += len(quote)
        else:
            out.append(c)
            i += 1
    return "".join(out)
