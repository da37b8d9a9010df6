"""Document files cut into searchable chunks: (path, kind, title, line, body).

Each adapter is a projection over (path, content): texts are split by regular
expressions and arrays of lines are filtered, so nothing is shuffled and a file
is explode-d to its chunks only.  A file without a chunk by its rules is one
chunk, cut to a fixed number of characters, where its adapter says so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File names and extensions that adapters know, and folders that a scan leaves out.
BUILD_SCRIPTS = ["makefile", "fastfile", "podfile", "gemfile"]
MANIFESTS = ["package.swift", "cargo.toml", "pubspec.yaml", "pubspec.yml", "package.json", "package-lock.json", "podfile", "gemfile", "makefile", "fastfile", "appfile", "deliverfile"]
OFFERED = ["package.swift", "cargo.toml", "pubspec.yaml", "pubspec.yml", "package.json", "makefile", "fastfile", "podfile", "gemfile"]
EXTENSIONS = {"md": "markdown", "markdown": "markdown", "json": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml", "html": "html", "htm": "html", "css": "css"}
SKIPPED = ["target", "node_modules", ".git", ".build", "DerivedData", "dist", ".cache"]

CHUNK = "struct<title: string, line: int, body: string>"


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/][.]([^./]*)$", 1))


def lines_of(content: Column) -> Column:
    return F.split(content, "\n")


def _joined(lines: Column, keep) -> Column:
    return F.array_join(F.filter(lines, keep), " ")


def _chunk(title: Column, line: Column, body: Column) -> Column:
    return F.struct(title.alias("title"), line.cast("int").alias("line"), body.alias("body"))


def _sections(content: Column, head: str) -> Column:
    """The content cut before each line that matches `head`, as (rows, line): the lines of each part and the number of its first."""

    def cut(rows: Column) -> Column:
        starts = F.array_compact(F.transform(rows, lambda x, i: F.when((i == 0) | x.rlike(head), i)))
        part = lambda at: F.transform(at, lambda s, k: F.struct(F.slice(rows, s + 1, F.coalesce(F.get(at, k + 1), F.size(rows)) - s).alias("rows"), (s + 1).alias("line")))
        return F.transform(F.array(starts), part)[0]  # the starts are found once

    return F.transform(F.array(lines_of(content)), cut)[0]


def markdown(path: Column, content: Column) -> Column:
    head = r"^[ \t]*#{1,3} [ \t]*\S"

    def chunk(s: Column) -> Column:
        rows = s["rows"]
        titled = rows[0].rlike(head)
        title = F.when(titled, F.trim(F.regexp_replace(F.trim(rows[0]), "^#+", ""))).otherwise(F.lit(""))
        rest = F.when(titled, F.slice(rows, F.lit(2), F.greatest(F.size(rows), F.lit(1)))).otherwise(rows)
        body = F.trim(_joined(rest, lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("```"))))
        return _chunk(title, s["line"], body)

    found = F.filter(F.transform(_sections(content, head), chunk), lambda c: (c["title"] != "") | (c["body"] != ""))
    whole = _chunk(F.regexp_replace(name_of(path), r"(.)[.][^.]*$", "$1"), F.lit(None), F.substring(content, 1, 2000))
    return F.when(F.size(found) > 0, found).otherwise(F.array(whole))


def toml(path: Column, content: Column) -> Column:
    name = name_of(path)

    def chunk(s: Column) -> Column:
        rows = s["rows"]
        first = F.trim(rows[0])
        section = F.startswith(first, F.lit("[")) & F.endswith(first, F.lit("]"))
        title = F.when(section, F.concat(name, F.lit(" "), F.regexp_replace(first, r"^[\[\]]+|[\[\]]+$", ""))).otherwise(name)
        rest = F.when(section, F.slice(rows, F.lit(2), F.greatest(F.size(rows), F.lit(1)))).otherwise(rows)
        body = _joined(rest, lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("#")))
        return _chunk(title, F.when(section, s["line"]).otherwise(0), body)

    found = F.filter(F.transform(_sections(content, r"^[ \t]*\[.*\][ \t]*$"), chunk), lambda c: F.trim(c["body"]) != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(_chunk(name, F.lit(None), F.substring(content, 1, 1000))))


def _one(path: Column, body: Column, some: Column) -> Column:
    return F.when(some, F.array(_chunk(name_of(path), F.lit(None), body))).otherwise(F.array().cast(f"array<{CHUNK}>"))


def flat_json(content: Column) -> Column:
    """The first 100 lines with a key or a string, without brackets at their ends, up to 2000 characters."""
    rows = F.slice(F.filter(F.transform(lines_of(content), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit(":")) | F.contains(x, F.lit('"'))), 1, 100)
    return F.substring(_joined(F.transform(rows, lambda x: F.regexp_replace(x, r"^[,{}\[\]]+|[,{}\[\]]+$", "")), lambda x: x != ""), 1, 2000)


def flat_yaml(content: Column) -> Column:
    """The first 80 lines that are neither blank nor comments, up to 2000 characters."""
    rows = F.filter(lines_of(content), lambda x: (F.trim(x) != "") & ~F.startswith(F.ltrim(x), F.lit("#")))
    return F.substring(F.array_join(F.slice(rows, 1, 80), " "), 1, 2000)


def html_text(content: Column) -> Column:
    """The text outside of tags and scripts; runs of white space and tags are one blank."""
    plain = F.regexp_replace(content, r"(?is)<script.*?(</script>|$)", "")
    return F.ltrim(F.regexp_replace(F.regexp_replace(plain, r"(?s)<[^>]*(>|$)|>", " "), r"\s+", " "))


def css_names(content: Column) -> Column:
    """Selectors, then custom properties, up to 2000 characters."""
    rows = F.transform(lines_of(content), lambda x: F.trim(x))
    opened = F.filter(rows, lambda x: F.endswith(x, F.lit("{")) & ~F.startswith(x, F.lit("/*")))
    selectors = _joined(F.transform(opened, lambda x: F.trim(F.regexp_replace(x, r"[{]+$", ""))), lambda x: x != "")
    own = F.filter(rows, lambda x: F.startswith(x, F.lit("--")))
    properties = _joined(F.transform(own, lambda x: F.trim(F.split_part(x, F.lit(":"), F.lit(1)))), lambda x: x != "")
    return F.substring(F.concat(selectors, F.lit(" "), properties), 1, 2000)


def targets(content: Column) -> Column:
    """Targets and lanes of a build script, 50 at most; null for other lines."""
    rows = F.transform(lines_of(content), lambda x: F.trim(x))
    target = lambda x: F.trim(F.regexp_replace(x, ":+$", ""))
    named = lambda x: F.endswith(x, F.lit(":")) & ~F.startswith(x, F.lit("#")) & (target(x) != "") & ~F.contains(target(x), F.lit(" "))
    lane = lambda x: F.startswith(x, F.lit("lane :")) | F.startswith(x, F.lit('desc "'))
    return F.array_join(F.slice(F.array_compact(F.transform(rows, lambda x: F.when(named(x), target(x)).when(lane(x), x))), 1, 50), " ")


def manifest(path: Column, content: Column) -> Column:
    script = F.lower(name_of(path)).isin(BUILD_SCRIPTS)
    own = targets(content)
    rows = F.filter(lines_of(content), lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("//")) & ~F.startswith(F.trim(x), F.lit("#")))
    plain = F.substring(F.array_join(F.slice(rows, 1, 60), " "), 1, 2000)
    body = F.when(script, F.when(own == "", F.substring(content, 1, 500)).otherwise(own)).otherwise(plain)
    return _one(path, body, script | (body != ""))


ADAPTERS = {
    "manifest": manifest,
    "markdown": markdown,
    "json": lambda p, c: _one(p, flat_json(c), flat_json(c) != ""),
    "toml": toml,
    "yaml": lambda p, c: _one(p, flat_yaml(c), flat_yaml(c) != ""),
    "html": lambda p, c: _one(p, F.substring(html_text(c), 1, 2000), F.trim(html_text(c)) != ""),
    "css": lambda p, c: _one(p, css_names(c), F.trim(css_names(c)) != ""),
}


def adapter(path: Column) -> Column:
    """The adapter of a path: by name first, then by extension; null for files that none knows."""
    by_extension = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    return F.when(F.lower(name_of(path)).isin(MANIFESTS), "manifest").otherwise(F.try_element_at(by_extension, extension_of(path)))


def offered(path: Column) -> Column:
    """Whether a path is worth reading as a document."""
    return F.lower(name_of(path)).isin(OFFERED) | extension_of(path).isin(list(EXTENSIONS))


def walked(path: Column) -> Column:
    """Whether a scan comes to a path: no hidden part, and none of the skipped folders above it."""
    parts = F.transform(F.split(path, "/"), F.lower)
    above = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return ~F.exists(parts, lambda x: F.startswith(x, F.lit("."))) & ~F.exists(above, lambda x: x.isin(SKIPPED))


def chunked(files: DataFrame, only: str | None = None) -> DataFrame:
    """(path, kind, title, line, body) of the files' chunks, by one adapter or each file's own."""
    known = files.withColumn("kind", adapter(F.col("path")))
    kinds = [only] if only else list(ADAPTERS)
    found = reduce(lambda c, k: c.when(F.col("kind") == k, ADAPTERS[k](F.col("path"), F.col("content")).cast(f"array<{CHUNK}>")), kinds, F.when(F.lit(False), F.array().cast(f"array<{CHUNK}>")))
    return known.select("path", "kind", F.explode(found).alias("c")).select("path", "kind", "c.title", "c.line", "c.body")
