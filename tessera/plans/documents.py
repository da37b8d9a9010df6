"""Chunking of documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks
from ..registry import query
from ..sources.crosswalk import frame, with_ctes

# The SQL below cuts files into numbered lines and sums up where headings begin; the operators split by patterns.
L = "SELECT path, content, @GROUP(path, '([^/]*)$') AS name, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM docfiles"
LOW = "lower(@GROUP(path, '([^/]*)$'))"
KIND = f"CASE WHEN {LOW} IN ({', '.join(repr(x) for x in chunks.MANIFESTS)}) THEN 'manifest' " + " ".join(f"WHEN regexp_matches({LOW}, '.[.]{x}$') THEN '{k}'" for x, k in chunks.EXTENSIONS.items()) + " END"
HTML = "ltrim(regexp_replace(regexp_replace(regexp_replace(content, '(?is)<script.*?(</script>|$)', '', 'g'), '(?s)<[^>]*(>|$)|>', ' ', 'g'), '\\s+', ' ', 'g'))"
DUCK = {
    "markdown": """SELECT path, 'markdown' AS kind, title, CAST(line AS INTEGER) AS line, body FROM (
  SELECT path, coalesce(max(CASE WHEN head THEN trim(regexp_replace(trim(line), '^#+', '')) END), '') AS title, min(n) AS line,
         trim(coalesce(string_agg(CASE WHEN NOT head AND trim(line) <> '' AND NOT starts_with(trim(line), '```') THEN line END, ' ' ORDER BY n), '')) AS body
  FROM (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY path ORDER BY n) AS part FROM (SELECT *, regexp_matches(trim(line), '^#{1,3} ') AS head FROM l WHERE kind = 'markdown') AS h) AS p GROUP BY path, part) AS c
WHERE title <> '' OR body <> ''""",
    "toml": """SELECT path, 'toml' AS kind, title, CAST(line AS INTEGER) AS line, body FROM (
  SELECT path, CASE WHEN bool_or(head) THEN concat(max(name), ' ', max(CASE WHEN head THEN regexp_replace(trim(line), '^[\\[\\]]+|[\\[\\]]+$', '', 'g') END)) ELSE max(name) END AS title, CASE WHEN bool_or(head) THEN min(n) ELSE 0 END AS line,
         coalesce(string_agg(CASE WHEN NOT head AND trim(line) <> '' AND NOT starts_with(trim(line), '#') THEN line END, ' ' ORDER BY n), '') AS body
  FROM (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY path ORDER BY n) AS part FROM (SELECT *, starts_with(trim(line), '[') AND ends_with(trim(line), ']') AS head FROM l WHERE kind = 'toml') AS h) AS p GROUP BY path, part) AS c
WHERE trim(body) <> ''""",
    "json": """SELECT path, 'json' AS kind, max(name) AS title, CAST(NULL AS INTEGER) AS line, substring(string_agg(t, ' ' ORDER BY n), 1, 2000) AS body FROM (
  SELECT path, name, n, regexp_replace(trim(line), '^[,{}\\[\\]]+|[,{}\\[\\]]+$', '', 'g') AS t, row_number() OVER (PARTITION BY path ORDER BY n) AS r FROM l WHERE kind = 'json' AND (contains(line, ':') OR contains(line, '"'))) AS j
WHERE r <= 100 AND t <> '' GROUP BY path""",
    "yaml": """SELECT path, 'yaml' AS kind, max(name) AS title, CAST(NULL AS INTEGER) AS line, substring(string_agg(line, ' ' ORDER BY n), 1, 2000) AS body FROM (
  SELECT path, name, n, line, row_number() OVER (PARTITION BY path ORDER BY n) AS r FROM l WHERE kind = 'yaml' AND trim(line) <> '' AND NOT starts_with(ltrim(line), '#')) AS y WHERE r <= 80 GROUP BY path""",
    "html": f"""SELECT path, 'html' AS kind, @GROUP(path, '([^/]*)$') AS title, CAST(NULL AS INTEGER) AS line, substring(body, 1, 2000) AS body FROM (SELECT path, {HTML} AS body FROM docfiles WHERE {KIND} = 'html') AS h WHERE trim(body) <> ''""",
    "css": """SELECT path, 'css' AS kind, title, CAST(NULL AS INTEGER) AS line, body FROM (
  SELECT path, max(name) AS title, substring(concat(coalesce(string_agg(CASE WHEN ends_with(t, '{') AND NOT starts_with(t, '/*') THEN nullif(trim(rtrim(t, '{')), '') END, ' ' ORDER BY n), ''), ' ',
         coalesce(string_agg(CASE WHEN starts_with(t, '--') THEN nullif(trim(split_part(t, ':', 1)), '') END, ' ' ORDER BY n), '')), 1, 2000) AS body
  FROM (SELECT *, trim(line) AS t FROM l WHERE kind = 'css') AS x GROUP BY path) AS c WHERE trim(body) <> ''""",
    "manifest": """SELECT path, 'manifest' AS kind, title, CAST(NULL AS INTEGER) AS line, body FROM (
  SELECT path, max(name) AS title, CASE WHEN lower(max(name)) IN ('makefile', 'fastfile', 'podfile', 'gemfile')
    THEN coalesce(string_agg(CASE WHEN ends_with(t, ':') AND NOT starts_with(t, '#') AND trim(rtrim(t, ':')) <> '' AND NOT contains(trim(rtrim(t, ':')), ' ') THEN trim(rtrim(t, ':')) WHEN starts_with(t, 'lane :') OR starts_with(t, 'desc "') THEN t END, ' ' ORDER BY n), substring(max(content), 1, 500))
    ELSE coalesce(substring(string_agg(CASE WHEN t <> '' AND NOT starts_with(t, '//') AND NOT starts_with(t, '#') THEN line END, ' ' ORDER BY n), 1, 2000), '') END AS body
  FROM (SELECT *, trim(line) AS t FROM l WHERE kind = 'manifest') AS x GROUP BY path) AS c WHERE body <> ''""",
}
CUT = f"WITH l AS (SELECT *, {KIND} AS kind FROM ({L}) AS x) "


def _chunks(name: str, kind: str):
    query(name, with_ctes(["docfiles"], CUT + DUCK[kind]))(lambda spark, sf_dir: chunks.chunked(frame(spark, sf_dir, "docfiles"), kind))


for _name, _kind in {"chunk_markdown": "markdown", "chunk_toml": "toml", "flatten_json_text": "json", "flatten_yaml": "yaml", "chunk_html": "html", "chunk_css": "css", "chunk_manifest": "manifest"}.items():
    _chunks(_name, _kind)
ALL = " UNION ALL ".join(f"({x})" for x in DUCK.values())


@query("doc_adapt", with_ctes(["docfiles"], CUT + ALL))
def doc_adapt(spark, sf_dir):
    """The chunks of all files, each by its own adapter."""
    return chunks.chunked(frame(spark, sf_dir, "docfiles"))


OFFERED = f"{LOW} IN ({', '.join(repr(x) for x in chunks.OFFERED)}) OR regexp_matches({LOW}, '.[.](md|markdown|json|toml|yaml|yml|html|htm|css)$')"
WALKED = "NOT regexp_matches(path, '(^|/)[.]') AND NOT regexp_matches(lower(path), '(^|/)(target|node_modules|dist)/')"


@query("scan_docs", with_ctes(["docfiles"], CUT + f"SELECT * FROM ({ALL}) AS a WHERE ({OFFERED}) AND {WALKED}"))
def scan_docs(spark, sf_dir):
    """The chunks of the files that a walk finds: no hidden or generated folders, document files only."""
    files = frame(spark, sf_dir, "docfiles")
    return chunks.chunked(files.where(chunks.walked(F.col("path")) & chunks.offered(F.col("path"))))


@query("is_doc_file", with_ctes(["docfiles"], f"SELECT path, {OFFERED} AS is_doc FROM docfiles"))
def is_doc_file(spark, sf_dir):
    return frame(spark, sf_dir, "docfiles").select("path", chunks.offered(F.col("path")).alias("is_doc"))


@query("html_to_text", with_ctes(["pages"], f"SELECT page_id, {HTML.replace('content', 'html')} AS text FROM pages"))
def html_to_text(spark, sf_dir):
    return frame(spark, sf_dir, "pages").select("page_id", chunks.html_text(F.col("html")).alias("text"))
