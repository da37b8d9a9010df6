"""Queries over source text read the tables: a file for each part, a diff for each line item, a log for each order."""

import ast
import re

import pytest

from tessera import plans
from tessera.adapters import python_source
from tessera.plans import source_text
from tessera.registry import QUERIES

DATA = "/root/testdata/sf0.001"
plans.load()
LANGUAGES = [f"call_extract_{x}" for x in source_text.OTHERS]
NAMED = ["annotate_report", "call_extract", *LANGUAGES, "dataflow_py", "git_diff_hunks", "test_output_summary", "runtime_tracer", "property_types_sw", "endpoint_inference", "index_pipeline"]


@pytest.mark.parametrize("name", NAMED)
def test_a_table_is_read(spark, name):
    read = {f.rsplit("/", 1)[1] for f in QUERIES[name](spark, DATA).inputFiles()}
    assert read and read <= {"part.parquet", "lineitem.parquet", "orders.parquet"}


def shown(template, row):
    adj, noun = row.p_name.split(" ")
    values = {"N": row.p_partkey, "NEXT": row.p_partkey + 1, "SIZE": row.p_size, "ADJ": adj, "NOUN": noun, "TYPE": row.p_type.lower()}
    return re.sub("<([A-Z]+)>", lambda m: str(values[m[1]]), template)


def test_files_hold_their_row(spark):
    rows = spark.read.parquet(f"{DATA}/part.parquet").collect()
    want = {f"shop/p{r.p_partkey}.py": source_text.BROKEN if r.p_partkey % 31 == 30 else shown(source_text.SHOP, r) for r in rows}
    assert {r.file: r.source for r in source_text.files(spark, DATA).collect()} == want
    for language, text in source_text.OTHERS.items():
        assert {r.file: r.source for r in source_text.files(spark, DATA, language).collect()} == {f"cart/p{r.p_partkey}.{language}": shown(text, r) for r in rows}


@pytest.mark.parametrize("name", LANGUAGES)
def test_each_file_has_one_call(spark, name):
    rows = spark.read.parquet(f"{DATA}/part.parquet").collect()
    first = "Sum_" if name.endswith(("_go", "_cs")) else "sum_"
    calls = {(f"cart/p{r.p_partkey}.{name.rsplit('_', 1)[1]}", first + r.p_name.split(" ")[0]) for r in rows}
    found = QUERIES[name](spark, DATA).collect()
    assert len(found) == len(calls) and {(r.file, r.callee) for r in found} == calls


def test_python_calls_arguments_and_diffs(spark):
    parts = {r.p_partkey: r for r in spark.read.parquet(f"{DATA}/part.parquet").collect()}
    own = {n: r for n, r in parts.items() if n % 31 != 30}
    kind = lambda r: r.p_type.lower()
    want = set()
    for n, r in own.items():
        noun, at = r.p_name.split(" ")[1], f"shop.p{n}"
        want |= {(f"shop/p{n}.py", f"{at}.order", f"{at}.{noun}Till{n}"), (f"shop/p{n}.py", f"{at}.save_{kind(r)}", f"{at}.order")}
        if n + 1 in own and kind(own[n + 1]) == kind(r):
            want.add((f"shop/p{n}.py", f"{at}.{noun}Till{n}.charge", f"shop.p{n + 1}.save_{kind(r)}"))
    assert {(r.file, r.caller, r.target) for r in QUERIES["call_extract"](spark, DATA).collect()} == want
    assert {r.file for r in QUERIES["dataflow_py"](spark, DATA).collect()} == {f"shop/p{n}.py" for n in own}
    hunks = QUERIES["git_diff_hunks"](spark, DATA).collect()
    spans = {(r.file, r.qname): (r.start_line, r.end_line) for r in QUERIES["parse_symbols_py"](spark, DATA).collect()}
    by = {}
    for h in hunks:
        by.setdefault(h.file, set()).add((h.first_line, h.last_line))
    want = {k for k, (a, b) in spans.items() if any(a <= last and b >= first for first, last in by.get(k[0], ()))}
    got = [(r.file, r.qname) for r in QUERIES["annotate_report"](spark, DATA).collect()]
    assert set(got) == want and len(got) == len(want) and want


@pytest.mark.parametrize("name", ["call_extract", "index_pipeline"])
def test_parsed_names_are_not_broadcast(spark, name):
    assert "BroadcastExchange" not in QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_names_of_calls_are_those_that_unparse_gives():
    for text in ("f()", "a.b.c()", "a().b()", "x[0]()", "'s'.join(y)", "True()", "1 .real()", "(lambda: 1)()", "(a + b)()", "...()"):
        call = ast.parse(text, mode="eval").body
        name = ast.unparse(call.func)
        assert python_source._called(call) == (name if name.replace(".", "").replace("_", "").isalnum() else None)


def test_calls_are_resolved_by_imports_then_own_names_then_self(spark):
    sources = [("p/a.py", "from .b import f as g\nimport q\ndef h():\n    g()\n    q.r()\n    h()\nclass C:\n    def m(self):\n        self.m()\n        h()\n"), ("p/b.py", "def f():\n    f()\n"), ("p/c.py", "def (:")]
    files = spark.createDataFrame(sources, "file string, source string")
    found = {(r.caller, r.callee, r.line, r.target) for r in source_text.resolved(files).collect()}
    assert found == {("p.a.h", "g", 4, "p.b.f"), ("p.a.h", "h", 6, "p.a.h"), ("p.a.C.m", "self.m", 9, "p.a.C.m"), ("p.a.C.m", "h", 10, "p.a.h"), ("p.b.f", "f", 2, "p.b.f")}
