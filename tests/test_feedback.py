"""Feedback with decay, siblings and recurring false positives; globs; penalties; tests of source files."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera import shared
from tessera.operators import feedback, globs
from tessera.plans import feedback as plans
from tessera.plans.predicates import STOPWORDS

NOW = datetime(2024, 2, 1)
SYMBOLS = [
    ("sym_fresh", "billing.calc.discount_fresh", "src/a.py", "function"), ("sym_old", "billing.calc.discount_old", "src/b.py", "function"), ("sym_n", "pkg.noisy", "src/n.py", "function"),
    ("s1", "m.refreshDrift", "src/x.py", "function"), ("s2", "m.driftLane", "src/x.py", "function"), ("s3", "m.other", "src/x.py", "function"), ("s4", "m.driftHost", "src/x.py", "class"),
    ("s5", "m.driftUseful", "src/x.py", "function"), ("s6", "m.lanePad", "src/x.py", "function"),
]


def judged(spark, query, entries):
    rows = [(f"f{i}", s, q, v, "alice", NOW - timedelta(days=d)) for i, (s, q, v, d) in enumerate(entries)]
    given = spark.createDataFrame(rows, "entry_id string, symbol_id string, query string, verdict string, author string, created_at timestamp")
    symbols = spark.createDataFrame(SYMBOLS, "symbol_id string, qname string, file string, kind string")
    scored = symbols.select(F.lit(query).alias("query"), "*", F.lit(10.0).alias("score"))
    found = feedback.judged(scored, given, symbols, F.lit(NOW), STOPWORDS)
    return {r.symbol_id: r for r in found.collect()}


def test_boosts_halve_and_suppression_does_not(spark):
    got = judged(spark, "discount", [("sym_fresh", "discount", "useful", 0), ("sym_old", "discount", "useful", 270), ("sym_n", "discount", "noisy", 365), ("s1", "unrelated words", "noisy", 0), ("s3", "discount", "missing", 0)])
    assert got["sym_fresh"].boost == pytest.approx(1.5, abs=0.01) and got["sym_old"].boost == pytest.approx(0.1875, abs=0.01)
    assert {k for k, r in got.items() if r.rule} == {"sym_n"} and got["sym_n"].rule == "exact_noisy"
    assert (got["s3"].verdict, got["s1"].verdict) == ("missing", None)


def test_siblings_follow_a_wrong_hit_by_name(spark):
    # the names of s2, s4 and s5 share a word with that of s1, which was wrong for this family
    got = judged(spark, "playhead position", [("s1", "position", "noisy", 5), ("s5", "playhead", "useful", 5)])
    assert {k: r.rule for k, r in got.items() if r.rule} == {"s1": "exact_noisy", "s2": "same_file_sibling_suppression"}
    assert (got["s2"].verdict, got["s2"].matched_query, got["s2"].author) == ("sibling_suppressed", "position", "alice")
    assert got["s4"].verdict is None and got["s3"].verdict is None and got["s5"].verdict == "useful"
    # s2's name has a word of this query and stays; nobody found s5 useful
    assert {k for k, r in judged(spark, "position lane", [("s1", "position", "noisy", 5)]).items() if r.rule} == {"s1", "s5"}


def test_recurring_false_positives_and_queries_without_words(spark):
    twice = [("s3", "audio mixer", "noisy", 1), ("s3", "mixer panel", "wrong-layer", 1), ("sym_n", "audio mixer", "noisy", 1)]
    assert {k: r.rule for k, r in judged(spark, "mixer", twice).items() if r.rule} == {"s3": "exact_noisy", "sym_n": "exact_noisy"}
    given = [("s3", "audio mixer", "noisy", 1), ("s3", "mixer panel", "noisy", 1), ("s6", "?!", "covered", 1)]
    got = judged(spark, "colour", given)
    assert {k: r.rule for k, r in got.items() if r.rule} == {"s6": "already_covered"}
    wrong = spark.createDataFrame([("a", "audio mixer", "noisy"), ("a", "mixer panel", "noisy"), ("b", "mixer", "noisy"), ("c", "mixer", "useful"), ("c", "mixer", "useful")], "symbol_id string, query string, verdict string")
    assert [tuple(r) for r in feedback.recurring(wrong, STOPWORDS).collect()] == [("a", "mixer")]


def test_hits_are_judged_where_they_stand(spark):
    """pairs of a query and a symbol were dealt out and joined seven times."""
    rows = [("f1", "s1", "position", "noisy", "al", NOW), ("f2", "s2", "playhead", "wrong-layer", "bo", NOW - timedelta(days=1)), ("f3", "s6", "?!", "useful", "cy", NOW), ("f4", "s6", "playhead", "useful", "di", NOW)]
    entries = spark.createDataFrame(rows, "entry_id string, symbol_id string, query string, verdict string, author string, created_at timestamp")
    symbols = spark.createDataFrame(SYMBOLS, "symbol_id string, qname string, file string, kind string")
    known = feedback.state(entries, F.lit(NOW))
    about = feedback.by_symbol(symbols, entries, known, symbols, STOPWORDS)
    queries = feedback.by_query(spark.createDataFrame([("playhead position",), ("position",), ("colour",)], "query string"), known, STOPWORDS)
    hits = shared.saved(symbols.join(about, "symbol_id", "left").crossJoin(queries), "hits")
    found = feedback.ruled(hits, STOPWORDS)
    assert "Exchange" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "Join" not in plan
    got = {(r.query, r.symbol_id): (r.rule, r.verdict, r.matched_query, r.author, r.boost) for r in found.collect()}
    assert got["playhead position", "s1"] == ("exact_noisy", "noisy", "position", "al", 0.0)
    assert got["playhead position", "s2"] == ("exact_noisy", "wrong-layer", "playhead", "bo", 0.0)
    # s5's name shares a word with both; the first of the file's wrong hits explains it
    assert got["playhead position", "s5"] == ("same_file_sibling_suppression", "sibling_suppressed", "playhead", "bo", 0.0)
    assert got["position", "s5"] == ("same_file_sibling_suppression", "sibling_suppressed", "position", "al", 0.0)
    # a name's own wrong hit makes no sibling of it: here s1 alone was wrong, and s2 shares its word
    assert got["position", "s1"][0] == "exact_noisy" and got["position", "s2"][0] == "same_file_sibling_suppression"
    assert got["playhead position", "s6"][:2] == (None, "useful") and got["playhead position", "s6"][4] == pytest.approx(3.0)
    assert got["colour", "s6"] == (None, "useful", "?!", "cy", pytest.approx(1.5)) and got["colour", "s5"] == (None, None, None, None, 0.0)


def plain_glob(glob, path):
    g, p = glob.split("/"), path.split("/")

    def match(i, j):
        if i == len(g):
            return j == len(p)
        if g[i] == "**":
            return match(i + 1, j) or j < len(p) and match(i, j + 1)
        return j < len(p) and re.fullmatch("[^/]*".join(map(re.escape, g[i].split("*"))), p[j]) is not None and match(i + 1, j + 1)

    return match(0, 0)


def test_globs_against_brute_force(spark):
    r = random.Random(6)
    part = lambda: r.choice(["a", "b", "ab", "a.py", "b+c", "x(1)"])
    paths = ["/".join(part() for _ in range(r.randint(1, 4))) for _ in range(120)] + [""]
    own = ["/".join(r.choice(["**", "*", "a*", "*.py", part(), part()]) for _ in range(r.randint(1, 4))) for _ in range(120)] + ["**", "*", "", "a/**", "**/a", "**/*.py"]
    got = {tuple(x) for x in globs.matches(spark.createDataFrame([(x,) for x in [*paths, None]], "f string"), spark.createDataFrame([(x,) for x in [*own, None]], "g string")).collect()}
    assert got == {(p, g) for p in paths for g in own if plain_glob(g, p)}


def test_penalties_by_scope(spark):
    symbols = spark.createDataFrame([("a", "models/x.py"), ("b", "views/y.py"), ("c", "src/z.py"), ("d", "src/z.py")], "symbol_id string, file string")
    entries = [("a", '{"scope": ["views/**"]}'), ("a", '{"scope": ["nowhere/*", "models/*.py"]}'), ("b", '{"scope": ["models/**"]}'), ("c", None), ("d", '{"scope": ["lib/**"]}'), ("ghost", None)]
    found = plans.penalised(symbols, spark.createDataFrame(entries, "symbol_id string, body string"))
    assert sorted(r.symbol_id for r in found.collect()) == ["a", "c"]
    for body in ("no json", "{}", '{"scope": []}', '{"scope": [""]}'):
        assert plans.penalised(symbols, spark.createDataFrame([("b", body)], "symbol_id string, body string")).count() == 1


def test_tests_of_sources_against_brute_force(spark):
    r = random.Random(8)
    stem = lambda: "".join(r.choice("ab") for _ in range(r.randint(1, 20)))
    bases = [stem() for _ in range(30)]
    rows = [(f"src/{i}", False, b) for i, b in enumerate(bases)] + [(f"t/{i}", True, r.choice(["test_", ""]) + r.choice(bases)[: r.randint(1, 20)] + r.choice(["tests", "test", "spec", "testtest", ""])) for i in range(40)] + [("t/x", True, "tests"), ("src/user", False, "user"), ("t/user", True, "test_user")]

    def short(s):
        for end in ("tests", "test", "spec"):
            while s.endswith(end):
                s = s[: -len(end)]
        return s

    found = plans.tests_of(spark.createDataFrame([(f, t, s, short(s)) for f, t, s in rows], "file string, is_test boolean, stem string, short string"))
    want = {(f, g) for f, t, s in rows if not t for g, u, x in rows if u and (s in x or short(x) in s)}
    assert {tuple(x) for x in found.collect()} == want and ("src/user", "t/user") in want
