"""Queries over source text.  The driver's tables hold none, so each part's row is written out as files of source: its names, sizes and
neighbours differ from part to part.  Diffs come from line items, logs of test runs from orders, traces from parts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..adapters import python_source, rules
from ..registry import query
from ..shipping import ship
from ..sources.crosswalk import frame, over, run_sql

# What stands for a value of the row in the texts below.
VALUES = {
    "N": "p_partkey", "NEXT": "p_partkey + 1", "SIZE": "p_size", "ADJ": "split_part(p_name, ' ', 1)", "NOUN": "split_part(p_name, ' ', 2)", "TYPE": "lower(p_type)",
    "ORDER": "l_orderkey", "PART": "l_partkey", "FIRST": "CAST(l_quantity AS INT)", "LAST": "CAST(l_quantity AS INT) + l_linenumber", "RUN": "o_orderkey", "CUST": "o_custkey",
}
SHOP = """import requests
from .p<NEXT> import save_<TYPE> as keep


class <NOUN>Till<N>:
    '''Takes <ADJ> money. Slowly.'''

    def charge(self, card, amount: int = <SIZE>):
        '''Charges a card.'''
        keep(card, amount)  # writes
        return requests.post("https://bank.example.com/<NOUN>/<N>", json=amount)


@app.get("/<TYPE>/{id}")
def order(id):
    return <NOUN>Till<N>().charge(id, <SIZE>)


def save_<TYPE>(key, value):
    print('not a # <ADJ>', key)
    order(key)
    open(key).write(value)
"""
# one file in 31 doesn't parse
BROKEN = "def (:\n"
OTHERS = {
    "ts": 'export class <NOUN>Cart<N> {}\nexport async function total<N>(items) { return sum_<ADJ>(items) }\nfunction sum_<ADJ>(x) { return x }\napp.get("/<NOUN>/:id", total<N>)\naxios.post("https://api.example.com/<TYPE>/<SIZE>")\n',
    "rs": 'pub struct <NOUN>Cart<N>;\npub fn total<N>(c: <NOUN>Cart<N>) -> i64 { sum_<ADJ>(c) }\nfn sum_<ADJ>(c: <NOUN>Cart<N>) -> i64 { 1 }\n#[get("/<NOUN>/{id}")]\nclient.post("https://api.example.com/<TYPE>/<SIZE>")\n',
    "go": 'type <NOUN>Cart<N> struct{}\nfunc (c <NOUN>Cart<N>) Total<N>() int { return Sum_<ADJ>(c) }\nfunc Sum_<ADJ>(c <NOUN>Cart<N>) int { return 1 }\nr.GET("/<NOUN>/{id}", h)\nhttp.Post("https://api.example.com/<TYPE>/<SIZE>")\n',
    "java": 'public class <NOUN>Cart<N> {\npublic int total<N>(int x) { return sum_<ADJ>(x); }\nprivate int sum_<ADJ>(int x) { return x; }\n@GetMapping("/<NOUN>/{id}")\nrestTemplate.postForObject("https://api.example.com/<TYPE>/<SIZE>")\n',
    "cs": 'public class <NOUN>Cart<N> {\npublic int Total<N>(int x) { return Sum_<ADJ>(x); }\nprivate int Sum_<ADJ>(int x) { return x; }\n[HttpGet("/<NOUN>/{id}")]\nclient.PostAsync("https://api.example.com/<TYPE>/<SIZE>")\n',
    "rb": "class <NOUN>Cart<N>\ndef total<N>(x)\nsum_<ADJ>(x)\nend\ndef sum_<ADJ>(x)\nend\nget '/<NOUN>/<SIZE>'\nHTTParty.post('https://api.example.com/<TYPE>/<SIZE>')\n",
    "kt": 'class <NOUN>Cart<N>\nfun total<N>(x: Int) = sum_<ADJ>(x)\nfun sum_<ADJ>(x: Int) = x\n@GetMapping("/<NOUN>/{id}")\nclient.post("https://api.example.com/<TYPE>/<SIZE>")\n',
    "sw": 'class <NOUN>Cart<N> {}\nfunc total<N>(x: Int) -> Int { return sum_<ADJ>(x) }\nfunc sum_<ADJ>(x: Int) -> Int { return x }\napp.get("/<NOUN>/:id")\n',
}
LOG = "PASSED tests/c<CUST>.py::one\nFAILED tests/c<CUST>.py::two_<RUN> - boom\ntest result: ok. 5 passed; 1 failed; 2 ignored\nok 3 - three\n"
DIFF = "diff --git a/shop/p<PART>.py b/shop/p<PART>.py\n--- a/shop/p<PART>.py\n+++ b/shop/p<PART>.py\n@@ -3,0 +<FIRST>,2 @@\n+x\n@@ -10 +<LAST>,0 @@\n-y\ndiff --git a/old<ORDER>.py b/new<ORDER>.py\nrename from old<ORDER>.py\nrename to new<ORDER>.py\n+++ b/new<ORDER>.py\n@@ -1 +1,3 @@\n+z\n"
TRACE = '{"symbol": "shop.p<N>.<NOUN>Till<N>.charge", "calls": <SIZE>, "effects": ["net.out", "log"], "edges": [{"callee": "shop.p<NEXT>.save_<TYPE>", "count": <SIZE>}]}'
SWIFT = "class <NOUN>Till<N> {\n  let <ADJ>Store: Store\n  var names: [String] = []\n  func total() -> Int { <SIZE> }\n}\n"
NEEDLES = {"requests.": "net.out", "open(": "fs.read", ".write(": "fs.write", "print(": "log", "raise ": "throws"}


def written(template: str) -> str:
    """SQL: a text with the row's values in it."""
    literal = lambda t: "'" + t.replace("'", "', chr(39), '").replace("\n", "', chr(10), '") + "'"
    parts = re.split(r"<([A-Z]+)>", template)
    return f"concat({', '.join(VALUES[x] if i % 2 else literal(x) for i, x in enumerate(parts))})"


def files(spark, sf_dir, language: str = ""):
    """(file, source): a file for each part."""
    source = written(OTHERS[language]) if language else f"CASE WHEN p_partkey % 31 = 30 THEN {written(BROKEN)} ELSE {written(SHOP)} END"
    path = written(f"cart/p<N>.{language}" if language else "shop/p<N>.py")
    # the table is small for what is made of it: its rows are dealt out, so that all tasks parse
    dealt = frame(spark, sf_dir, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return over(spark, f"SELECT {path} AS file, {source} AS source FROM part", part=dealt)


def _python(name, fn):
    @query(name)
    def run(spark, sf_dir):
        ship(spark)
        return fn(files(spark, sf_dir))


_python("parse_symbols_py", python_source.symbols)
_python("import_bindings", python_source.imports)
_python("dataflow_py", python_source.arguments)
_python("mask_literals", python_source.masked)
_python("lang_adapter", lambda f: python_source.symbols(f).groupBy("file", "kind").count())


def resolved(f):
    """Calls in files resolved in order: an imported name, then a name of the same file, then self."""
    # by their sizes in the plan, which are those of the small table, parsed names would be broadcast
    names = python_source.names(f).select("qname").hint("merge")
    own_calls = python_source.sites(f).select("file", "imports", F.explode("calls").alias("c")).select("file", "imports", "c.*")
    local = F.split_part("callee", F.lit("."), F.lit(1))
    targets = F.filter("imports", lambda i: i["local"] == local)
    module = F.replace(F.regexp_replace("file", r"[.]\w+$", ""), F.lit("/"), F.lit("."))
    own = F.concat(module, F.lit("."), F.col("callee"))
    self_ = F.concat(F.regexp_replace("caller", r"[.]\w+$", ""), F.lit("."), F.regexp_replace("callee", r"^self[.]", ""))
    option = lambda rank, qname: F.struct(F.lit(rank).alias("rank"), qname.alias("qname"))
    imported = F.transform(targets, lambda i: option(0, F.concat(i["target"], F.substr("callee", F.length(local) + 1))))
    options = own_calls.select("file", "caller", "callee", "line", F.explode(F.concat(imported, F.array(option(1, own), option(2, self_)))).alias("o"))
    hit = options.select("file", "caller", "callee", "line", "o.rank", "o.qname").join(names, "qname", "left_semi")
    return hit.groupBy("file", "caller", "callee", "line").agg(F.min(F.struct("rank", "qname"))["qname"].alias("target"))


@query("call_extract")
def call_extract(spark, sf_dir):
    ship(spark)
    return resolved(files(spark, sf_dir))


@query("scan_source_tree")
def scan_source_tree(spark, sf_dir):
    known = F.regexp_extract("file", r"[.](py|ts|rs|go|java|cs|rb|kt|swift)$", 1)
    return files(spark, sf_dir).select("file", known.alias("adapter"), (known == "").alias("skipped"))


@query("index_pipeline")
def index_pipeline(spark, sf_dir):
    """Symbols, resolved calls and effects, counted by file."""
    ship(spark)
    f = files(spark, sf_dir)
    parts = [("symbols", python_source.names(f)), ("calls", call_extract(spark, sf_dir)), ("effects", rules.effects(f, NEEDLES))]
    counts = [df.groupBy("file").agg(F.count("*").alias("n")).withColumn("part", F.lit(name)) for name, df in parts]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("test_output_summary")
def test_output_summary(spark, sf_dir):
    log = run_sql(spark, sf_dir, ["orders"], f"SELECT o_orderkey AS run, {written(LOG)} AS text FROM orders").select("run", F.explode(F.split("text", "\n")).alias("line"))
    totals = [F.coalesce(F.try_to_number(F.regexp_extract("line", rf"(\d+) {word}", 1), F.lit("999")).cast("long"), F.lit(0)) for word in ("passed", "failed")]
    passed = F.col("line").rlike(r"^(PASSED |ok \d)").cast("long") + totals[0]
    failed = F.col("line").rlike(r"^(FAILED |not ok \d)").cast("long") + totals[1]
    return log.groupBy("run").agg(F.sum(passed).alias("passed"), F.sum(failed).alias("failed"), F.array_sort(F.collect_set(F.nullif(F.regexp_extract("line", r"^FAILED (\S+)", 1), F.lit("")))).alias("failures"))


@query("endpoint_inference")
def endpoint_inference(spark, sf_dir):
    return rules.endpoints(files(spark, sf_dir), "")


def _language(language: str) -> None:
    query(f"parse_symbols_{language}")(lambda spark, sf_dir: rules.symbols(files(spark, sf_dir, language), language))
    query(f"call_extract_{language}")(lambda spark, sf_dir: rules.calls(files(spark, sf_dir, language), language))
    query(f"endpoint_inference_{language}")(lambda spark, sf_dir: rules.endpoints(files(spark, sf_dir, language), language))


for _name in OTHERS:
    _language(_name)


@query("git_diff_hunks")
def git_diff_hunks(spark, sf_dir):
    """(file, first_line, last_line, renamed) of each hunk of a diff without context lines."""
    diff = run_sql(spark, sf_dir, ["lineitem"], f"SELECT l_orderkey AS commit, {written(DIFF)} AS text FROM lineitem")
    parts = diff.select("commit", F.explode(F.split("text", "diff --git ")).alias("part")).where("part <> ''")
    file = F.regexp_extract("part", r"(?m)^\+\+\+ b/(\S+)", 1)
    hunks = parts.select("commit", file.alias("file"), F.contains("part", F.lit("rename from")).alias("renamed"), F.explode(F.regexp_extract_all("part", F.lit(r"(?m)^(@@ [^@]* @@)"), 1)).alias("hunk"))
    first = F.regexp_extract("hunk", r"\+(\d+)", 1).cast("int")
    n = F.coalesce(F.nullif(F.regexp_extract("hunk", r"\+\d+,(\d+)", 1), F.lit("")).cast("int"), F.lit(1))
    return hunks.select("commit", "file", "renamed", first.alias("first_line"), (first + F.greatest(n, F.lit(1)) - 1).alias("last_line"))


@query("annotate_report")
def annotate_report(spark, sf_dir):
    """Symbols whose span meets a hunk of a diff."""
    ship(spark)
    spans = python_source.symbols(files(spark, sf_dir)).select("file", "qname", "start_line", "end_line")
    hunks = git_diff_hunks(spark, sf_dir).select("file", "first_line", "last_line")
    return spans.join(hunks, "file").where("start_line <= last_line AND end_line >= first_line").select("file", "qname").distinct()


@query("runtime_tracer")
def runtime_tracer(spark, sf_dir):
    """A trace report, read: observed effects and edges.  Tracing itself is not the engine's business."""
    kind = "symbol string, calls long, effects array<string>, edges array<struct<callee: string, count: bigint>>"
    read = run_sql(spark, sf_dir, ["part"], f"SELECT {written(TRACE)} AS text FROM part").select(F.from_json("text", kind).alias("t")).select("t.*")
    return read.select("symbol", "calls", F.explode("effects").alias("effect"), F.size("edges").alias("n_edges"))


@query("property_types_sw")
def property_types_sw(spark, sf_dir):
    stored = r"^\s*(?:let|var)\s+(\w+)\s*:\s*([\w\[\]?]+)"
    own = rules.lines(run_sql(spark, sf_dir, ["part"], f"SELECT {written('till/p<N>.swift')} AS file, {written(SWIFT)} AS source FROM part"))
    return own.select("file", F.regexp_extract("text", stored, 1).alias("property"), F.regexp_extract("text", stored, 2).alias("type")).where("property <> ''")
