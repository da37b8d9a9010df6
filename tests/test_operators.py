"""Operators on small fixtures, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunks, graph, order
from tessera.plans import predicates
from tessera.sources.crosswalk import render


def edges(spark, pairs):
    return spark.createDataFrame(sorted(set(pairs)), "src string, dst string")


def some_edges(seed, nodes=40, n=70):
    r = random.Random(seed)
    return {(f"n{r.randrange(nodes)}", f"n{r.randrange(nodes)}") for _ in range(n)}


@pytest.mark.parametrize("depth", [1, 3])
def test_reach_is_breadth_first(spark, depth):
    pairs = some_edges(1)
    found = graph.reach(edges(spark, pairs), spark.createDataFrame([("n1", "n1"), ("n2", "n2")], "root string, node string"), depth)
    want = set()
    for root in ("n1", "n2"):
        seen = {root: 0}
        for hop in range(1, depth + 1):
            for a, b in pairs:
                if seen.get(a) == hop - 1 and b not in seen:
                    seen[b] = hop
        want |= {(root, n, d) for n, d in seen.items() if d}
    assert {tuple(r) for r in found.collect()} == want


def test_inherited_effects_are_the_least_fixpoint(spark):
    pairs = some_edges(2) | {(f"c{i}", f"c{i + 1}") for i in range(12)}  # a chain longer than any bound
    declared = {("c12", "db"), ("n3", "log"), ("n4", "log"), ("n5", "net")}
    have = set(declared)
    while new := {(a, e) for a, b in pairs for n, e in have if b == n} - have:
        have |= new
    want = {}
    for a, b in pairs:
        for n, e in have:
            if n == b and (a, e) not in declared:
                want[a, e] = min(want.get((a, e), b), b)
    found = graph.inherited(edges(spark, pairs), spark.createDataFrame(sorted(declared), "symbol_id string, effect string"))
    assert {(r.symbol_id, r.effect): r.via for r in found.collect()} == want and ("c0", "db") in want


def test_blast_radius_stops_at_other_declarers(spark):
    own = spark.createDataFrame([("c", "db"), ("b", "db"), ("c", "log")], "symbol_id string, effect string")
    found = graph.blast_radius(edges(spark, {("b", "c"), ("a", "b"), ("z", "c")}), own)
    assert {tuple(r) for r in found.collect()} == {("db", "c", 1), ("db", "b", 1), ("log", "c", 3)}


def test_neighbourhood_is_cut(spark):
    star = edges(spark, {("hub", f"x{i}") for i in range(9)} | {("x1", "x2")})
    rows = graph.neighbourhood(star, spark.createDataFrame([("hub", "hub")], "root string, node string"), 2, 4).collect()
    assert {(r.node, r.depth, r.truncated, r.n_links) for r in rows} == {("hub", 0, True, 3), ("x0", 1, True, 0), ("x1", 1, True, 1), ("x2", 1, True, 0)}


def test_chains_are_simple_and_few(spark):
    pairs = some_edges(3, 12, 30)
    rows = graph.chains(edges(spark, pairs), 5, 4).collect()
    want = {}
    paths = [[a, b] for a, b in pairs if a != b]
    for _ in range(4):
        for p in sorted(paths):
            if len(want.setdefault(p[-1], [])) < 5:
                want[p[-1]].append(p)
        paths = [[a, *p] for p in paths for a, b in pairs if b == p[0] and a not in p]
    got = {}
    for r in rows:
        got.setdefault(r.target, []).append(list(r.path))
    assert {t: sorted(p) for t, p in got.items()} == {t: sorted(p) for t, p in want.items()}


def test_total_orders_agree_with_sorting(spark):
    r = random.Random(4)
    values = [(r.choice([None, *range(5)]), i, f"v{i}") for i in range(500)]
    df = spark.createDataFrame(values, "a int, b int, c string").repartition(7)
    ranked = sorted(values, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    got = order.placed(df, [F.col("a").desc(), F.col("b").asc()])
    assert {x.b: x.place for x in got.collect()} == {x[1]: i + 1 for i, x in enumerate(ranked)}
    lagged = order.lagged(df, [F.col("b").asc()], "c", "before")
    assert {x.b: x.before for x in lagged.collect()} == {i: f"v{i - 1}" if i else None for i in range(500)}
    assert order.placed(df.limit(0), [F.col("b")]).collect() == []


def chunk(spark, path, content):
    return [(r.kind, r.title, r.line, r.body) for r in chunks.chunked(spark.createDataFrame([(path, content)], "path string, content string")).collect()]


def test_chunks_of_each_kind(spark):
    assert chunk(spark, "a/read.md", "intro\n\n# One\ntext\n```py\nx\n```\n## Two  \n#### no heading") == [("markdown", "", 1, "intro"), ("markdown", "One", 3, "text x"), ("markdown", "Two", 8, "#### no heading")]
    assert chunk(spark, "a/empty.md", "\n\n") == [("markdown", "empty", None, "\n\n")]
    assert chunk(spark, "x.toml", "a = 1\n# c\n[b.c]\nd = 2\n[e]\n") == [("toml", "x.toml", 0, "a = 1"), ("toml", "x.toml b.c", 3, "d = 2")]
    assert chunk(spark, "x.json", '{\n  "a": 1,\n  [2]\n}') == [("json", "x.json", None, '"a": 1')]
    assert chunk(spark, "x.yml", "# c\na: 1\n\n  b: 2") == [("yaml", "x.yml", None, "a: 1   b: 2")]
    assert chunk(spark, "x.html", "<p>a<b>b</b>\n c<script>var x='<p>'</script>d > e</p>") == [("html", "x.html", None, "a b cd e ")]
    assert chunk(spark, "x.css", "/* x {\n.a > b {\n--c: 1;\n}") == [("css", "x.css", None, ".a > b --c")]
    assert chunk(spark, "Makefile", "all: \n# no:\ntwo words:\nx: y") == [("manifest", "Makefile", None, "all")]
    assert chunk(spark, "Cargo.toml", "[a]\n# c\n// d\nb = 1") == [("manifest", "Cargo.toml", None, "[a] b = 1")]
    assert chunk(spark, "x.py", "a") == [] and chunk(spark, "x.css", "a") == []


def test_walks_leave_folders_out(spark):
    paths = ["a/b.md", "node_modules/a.md", ".git/x.md", "a/.hidden.md", "dist/x.css", "b/target.md", "a.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.path for r in df.where(chunks.walked(F.col("path")) & chunks.offered(F.col("path"))).collect()] == ["a/b.md", "b/target.md"]


GLOBS = ["src/*.py", "**/*.py", "src/**", "**", "a/**/b.ts", "a/**/b/**", "*", "x.y", "a+b/(c)*", "**/test_*"]
PATHS = ["src/a.py", "src/x/a.py", "src", "srcs/a.py", "a/b.ts", "a/x/y/b.ts", "a/b", "a/q/b/c", "xzy", "x.y", "a+b/(c)d", "test_a", "k/test_b/c"]


def test_globs_match_by_segment(spark):
    def parts(p, f):
        if not p:
            return not f
        if p[0] == "**":
            return parts(p[1:], f) or (bool(f) and parts(p, f[1:]))
        return bool(f) and re.fullmatch(".*".join(map(re.escape, p[0].split("*"))), f[0]) is not None and parts(p[1:], f[1:])

    df = spark.createDataFrame([(g, p) for g in GLOBS for p in PATHS], "pat string, file string")
    match = render(predicates._globbed("@MATCH(file, @PATTERN)", False), duck=False)
    assert {(r.pat, r.file): r.m for r in df.selectExpr("pat", "file", f"{match} AS m").collect()} == {(g, p): parts(g.split("/"), p.split("/")) for g in GLOBS for p in PATHS}
