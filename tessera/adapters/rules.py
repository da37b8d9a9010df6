"""Regular-expression rules for other languages: symbols, calls and endpoints, line by line.

No grammar is available for these languages, so nesting isn't known: a symbol's name has no outer names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Patterns of definitions, with the name as the only group.
DEFINITIONS = {
    "ts": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|interface)\s+(\w+)",
    "rs": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:fn|struct|enum|trait)\s+(\w+)",
    "go": r"^\s*(?:func(?:\s*\([^)]*\))?|type)\s+(\w+)",
    "java": r"^\s*(?:public|private|protected)[\w\s<>\[\],]*?(\w+)\s*[({]",
    "cs": r"^\s*(?:public|private|protected|internal)[\w\s<>\[\],]*?(\w+)\s*[({]",
    "rb": r"^\s*(?:def|class|module)\s+([\w.?!]+)",
    "kt": r"^\s*(?:\w+\s+)*(?:fun|class|object|interface)\s+(\w+)",
    "sw": r"^\s*(?:\w+\s+)*(?:func|class|struct|enum|protocol)\s+(\w+)",
}
# Patterns of inbound routes and outbound calls, with method and path as groups.
ENDPOINTS = {
    "": (r"@\w+\.(get|post|put|delete|patch)\(\s*[\"']([^\"']+)", r"requests\.(get|post|put|delete|patch)\(\s*[\"']([^\"']+)"),
    "ts": (r"\b(?:app|router)\.(get|post|put|delete|patch)\(\s*[\"'`]([^\"'`]+)", r"\baxios\.(get|post|put|delete|patch)\(\s*[\"'`]([^\"'`]+)"),
    "rs": (r"#\[(get|post|put|delete|patch)\(\s*\"([^\"]+)", r"\bclient\.(get|post|put|delete|patch)\(\s*\"([^\"]+)"),
    "go": (r"\.(GET|POST|PUT|DELETE|PATCH)\(\s*\"([^\"]+)", r"http\.(Get|Post|Put|Delete)\(\s*\"([^\"]+)"),
    "java": (r"@(Get|Post|Put|Delete|Patch)Mapping\(\s*\"([^\"]+)", r"restTemplate\.(get|post|put|delete|patch)\w*\(\s*\"([^\"]+)"),
    "cs": (r"\[Http(Get|Post|Put|Delete|Patch)\(\s*\"([^\"]+)", r"\.(Get|Post|Put|Delete|Patch)Async\(\s*\"([^\"]+)"),
    "rb": (r"^\s*(get|post|put|delete|patch)\s+[\"']([^\"']+)", r"HTTParty\.(get|post|put|delete|patch)\(\s*[\"']([^\"']+)"),
    "kt": (r"@(Get|Post|Put|Delete|Patch)Mapping\(\s*\"([^\"]+)", r"client\.(get|post|put|delete|patch)\(\s*\"([^\"]+)"),
    "sw": (r"\.(get|post|put|delete|patch)\(\s*\"([^\"]+)", r"(?!)()()"),
}


def lines(files: DataFrame) -> DataFrame:
    return files.select("file", F.posexplode(F.split("source", "\n")).alias("pos", "text")).select("file", (F.col("pos") + 1).cast("int").alias("line"), "text")


def symbols(files: DataFrame, language: str) -> DataFrame:
    """(file, name, line) of definitions."""
    return lines(files).select("file", F.regexp_extract("text", DEFINITIONS[language], 1).alias("name"), "line").where("name <> ''")


def calls(files: DataFrame, language: str) -> DataFrame:
    """(file, callee, line): words before an opening bracket that name a definition of some file."""
    known = symbols(files, language).select("name").distinct()
    sites = lines(files).select("file", "line", F.explode(F.regexp_extract_all("text", F.lit(r"(\w+)\s*\("), 1)).alias("callee"), F.regexp_extract("text", DEFINITIONS[language], 1).alias("own"))
    return sites.where("callee <> own").join(known, F.col("callee") == F.col("name"), "left_semi").select("file", "callee", "line")


def endpoints(files: DataFrame, language: str) -> DataFrame:
    """(file, line, direction, contract): HTTP routes and client calls; numbers and parameters in a path become {}."""
    found = []
    for direction, pattern in zip(("inbound", "outbound"), ENDPOINTS[language]):
        method, url = (F.regexp_extract("text", pattern, i) for i in (1, 2))
        path = F.regexp_replace(F.regexp_replace(F.lower(url), r"^https?://[^/]*", ""), r"/(\d+|:\w+|\{[^}]*\})", "/{}")
        found.append(lines(files).where(method != "").select("file", "line", F.lit(direction).alias("direction"), F.concat(F.lit("http:"), F.upper(method), F.lit(" "), path).alias("contract")))
    return found[0].unionByName(found[1])


def effects(files: DataFrame, needles: dict[str, str]) -> DataFrame:
    """(file, line, effect) where a line has a needle."""
    pairs = F.array(*(F.struct(F.lit(n).alias("needle"), F.lit(e).alias("effect")) for n, e in needles.items()))
    hits = lines(files).select("file", "line", F.explode(F.filter(pairs, lambda p: F.contains(F.col("text"), p["needle"]))).alias("hit"))
    return hits.select("file", "line", F.col("hit.effect").alias("effect")).distinct()
