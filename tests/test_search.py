"""Containment joins, the stored index, BM25 and the staged choice of candidates against brute force and fixed expectations."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tessera import plans
from tessera.operators import index
from tessera.operators.contain import contained
from tessera.plans import search
from tessera.registry import QUERIES

CODE = "symbol_id string, qname string, language string, kind string, file string, start_line int, signature string, doc string"
LEDGER = "entry_id string, symbol_id string, kind string, summary string"


def test_containment_is_exact(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("abc") for _ in range(r.randint(0, 20))) for _ in range(150)] + [None, "", "été", "é"]
    needles, hay = texts[:80] + ["été", "é", None, ""], texts[40:]
    got = sorted(map(tuple, contained(spark.createDataFrame([(x,) for x in needles], "n string"), spark.createDataFrame([(x,) for x in hay], "h string")).collect()))
    assert got == sorted({(a, b) for a in needles for b in hay if a and b is not None and a in b})


def test_bm25_and_phrases_of_a_stored_index(spark, tmp_path):
    r = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    docs = {f"d{i}": {"title": [r.choice(words) for _ in range(r.randint(0, 4))], "body": [r.choice(words) for _ in range(r.randint(0, 30))]} for i in range(60)}
    rows = [(d, f, w) for d, own in docs.items() for f, w in own.items()]
    bare = [("d1", "ledger", "w1"), ("d1", "ledger", "w1"), ("d2", "ledger", "zz")]
    built = index.build(spark.createDataFrame(rows, "doc string, field string, words array<string>"), ["title", "body"], str(tmp_path / "i"), spark.createDataFrame(bare, "doc string, field string, term string"), buckets=4)
    asked = {"q1": ["w1", "w2"], "q2": ["w3", "none"], "q3": ["w4", "w5", "w4"]}
    tokens = spark.createDataFrame([(q, i, t) for q, ts in asked.items() for i, t in enumerate(ts)], "query string, at int, term string")
    n, total = len(docs), sum(len(w) for _, _, w in rows)
    df = Counter(t for own in docs.values() for t in {*own["title"], *own["body"]})
    want = defaultdict(float)
    for q, ts in asked.items():
        for d, own in docs.items():
            for t in ts:
                tf = 5 * own["title"].count(t) + 3 * own["body"].count(t)
                if tf:
                    idf = math.log((n - df[t] + 0.5) / (df[t] + 0.5))
                    size = len(own["title"]) + len(own["body"])
                    want[q, d] += (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size * n / total))
    for found in (built, index.stored(spark, str(tmp_path / "i"), 4)):
        got = {(x.query, x.doc): x.score for x in index.bm25(found, tokens, {"title": 5, "body": 3}).collect()}
        assert got == pytest.approx(dict(want))
    assert {(x.doc, x.term) for x in index.looked_up(built, tokens, ["ledger"]).collect()} == {("d1", "w1")}
    longest = {(x.query, x.doc): x.longest for x in index.phrases(index.looked_up(built, tokens, ["body"])).collect()}
    for q, ts in asked.items():
        for d, own in docs.items():
            runs = [k for i in range(len(ts)) for k in range(1, len(ts) - i + 1) if any(own["body"][p : p + k] == ts[i : i + k] for p in range(len(own["body"])))]
            assert longest.get((q, d), 0) == max(runs, default=0)


def chosen(spark, tmp_path, code, ledger, queries):
    own = spark.createDataFrame([(i, q, "python", "function", f, 1, s, d) for i, q, f, s, d in code], CODE)
    notes = spark.createDataFrame(ledger, LEDGER)
    asked = search.tokens(spark.createDataFrame([(q,) for q in queries], "query string"))
    found = search.indexed(own, notes, str(tmp_path / f"i{random.random()}"))
    return search.candidates(found, asked, search.described(own, notes)).collect()


CHARGE = ("sym_charge", "billing.payment.charge", "src/billing/payment.py", "def charge()", "Charges the customer for an order.")
DECORATOR = ("sym_decorator", "utils.decorators.idempotent_decorator", "src/utils/decorators.py", "def idempotent_decorator()", "Decorator for idempotent operations.")
OTHER = ("sym_other", "unrelated.module.helper", "src/unrelated/helper.py", "def charge()", "Charges the customer for an order.")


def test_notes_bring_in_symbols_that_no_word_finds(spark, tmp_path):
    invariant = ("e1", "sym_charge", "invariant", "must be idempotent across retries")
    concept = ("e2", "sym_charge", "concept", "this concept also says idempotent but should not anchor")
    got = [(r.qname, r.score) for r in chosen(spark, tmp_path, [CHARGE, DECORATOR], [invariant, concept], ["idempotent"])]
    assert dict(got)["billing.payment.charge"] == 0.5 and sorted(dict(got)) == ["billing.payment.charge", "utils.decorators.idempotent_decorator"] and len(got) == 2
    # another kind of note does not
    assert [r.qname for r in chosen(spark, tmp_path, [CHARGE, OTHER], [concept], ["idempotent"])] == []
    # a hit is not added a second time
    both = chosen(spark, tmp_path, [CHARGE, DECORATOR], [invariant], ["idempotent charge"])
    assert Counter(r.qname for r in both)["billing.payment.charge"] == 1


def test_candidates_keep_noted_symbols_of_a_file(spark, tmp_path):
    code = [("a", "m.driftLane", "src/drift.py", "def driftLane()", "drift drift"), ("b", "m.other", "src/drift.py", "def other()", "a lane of drift"), ("t", "m.driftTest", "tests/drift.py", "def driftTest()", "drift")]
    got = [r.qname for r in chosen(spark, tmp_path, code, [("e", "b", "hazard", "keep the lane")], ["drift lane"])]
    assert got == ["m.other"]  # one of each file, with a note before a better score; no tests
    assert [r.qname for r in chosen(spark, tmp_path, code, [("e", "z", "hazard", "nothing")], ["drift lane"])] == ["m.driftLane"]


def test_boosts(spark, tmp_path):
    code = [("a", "m.refreshDriftPlayhead", "src/AcmeFlow/x.py", None, None), ("b", "m.isInPlayheadHandle", "src/y.py", None, None), ("c", "m.stateList", "src/z.py", None, None)]
    own = spark.createDataFrame([(i, q, "python", "function", f, 1, s, d) for i, q, f, s, d in code], CODE)
    found = search.indexed(own, spark.createDataFrame([], LEDGER), str(tmp_path / "i"))
    asked = search.tokens(spark.createDataFrame([("drift playhead",), ("acme",), ("state list",), ("state drift",)], "query string"))
    got = {(r.query, r.doc): r.boost for r in search.hybrid(found, asked).collect()}
    assert got == {
        ("drift playhead", "a"): 2 * 2.0 + 2 * 3.0, ("drift playhead", "b"): 2.0 - 2.5, ("acme", "a"): 2.5,
        ("state list", "c"): 2 * 2.0 + 2 * 3.0 - 2.5, ("state drift", "c"): 2.0 - 2.5, ("state drift", "a"): 2.0,
    }


def test_postings_and_scores_are_made_with_one_shuffle_of_postings(spark, tmp_path):
    """F8, F19: postings were shuffled twice when they were written, and dealt out anew for each query that asks for them."""
    r = random.Random(8)
    rows = [(f"d{i}", "body", [f"w{r.randint(0, 40)}" for _ in range(r.randint(0, 60))]) for i in range(300)] + [("none", "body", None), ("empty", "body", [])]
    built = index.build(spark.createDataFrame(rows, "doc string, field string, words array<string>"), ["body"], str(tmp_path / "i"))
    want = sorted((d, t, [i for i, w in enumerate(ws) if w == t]) for d, _, ws in rows if ws for t in set(ws))
    assert sorted((p.doc, p.term, p.positions) for p in built.postings.collect()) == want
    assert built.totals.first().docs == len(rows)
    asked = spark.createDataFrame([(f"q{i}", at, f"w{r.randint(0, 40)}") for i in range(9) for at in range(4)], "query string, at int, term string")
    plan = index.bm25(built, asked, {"body": 1.0})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc") == 1 and "hashpartitioning(query" not in plan, plan


def test_more_pairs_go_to_more_tasks(spark, tmp_path, monkeypatch):
    """the pairs that one task sums grew with the documents."""
    built = index.build(spark.createDataFrame([(f"d{i}", "body", ["w"]) for i in range(40)], "doc string, field string, words array<string>"), ["body"], str(tmp_path / "i"))
    asked = spark.createDataFrame([("q", 0, "w"), ("p", 0, "w")], "query string, at int, term string")
    monkeypatch.setattr(index, "PAIRS", 8)
    found = index.bm25(built, asked, {"body": 1.0})
    assert "hashpartitioning(doc" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 10), REPARTITION_BY_NUM" in plan
    assert found.count() == 80


def test_boosts_of_given_pairs_alone(spark, tmp_path):
    """boosts were made for all pairs of a query and a symbol with one of its words, not for those that are asked for."""
    own = spark.createDataFrame([(f"s{i}", f"m{i}.driftLane", "python", "function", f"src/drift/x{i}.py", 1, None, None) for i in range(30)], CODE)
    found = search.indexed(own, spark.createDataFrame([], LEDGER), str(tmp_path / "i"))
    asked = search.tokens(spark.createDataFrame([("drift lane",), ("drift",), ("lane pad",)], "query string"))
    every = {(r.query, r.doc): r.boost for r in search.hybrid(found, asked).collect()}
    pairs = spark.createDataFrame([("drift lane", "s3"), ("drift", "s4"), ("drift", "s4"), ("drift", "none"), ("nothing", "s5")], "query string, doc string")
    got = [(r.query, r.doc, r.boost) for r in search.hybrid(found, asked, pairs).collect()]
    assert len(every) == 90 and sorted(got) == sorted((*k, every[k]) for k in [("drift lane", "s3"), ("drift", "s4")])
    posts = index.looked_up(found, asked, ["name"], pairs.select("doc").distinct())
    assert {r.doc for r in posts.collect()} == {"s3", "s4", "s5"}


def test_the_best_are_cut_before_they_meet_what_else_is_known(spark, tmp_path, monkeypatch):
    """all scored pairs were dealt out and sorted with the names, files and notes of their symbols."""
    own = spark.createDataFrame([("a", "m.drift", "python", "function", "src/x.py", 1, None, "drift"), ("t", "m.drift", "python", "function", "tests/x.py", 1, None, "drift"), ("b", "m.lane", "python", "function", "src/x.py", 1, None, "lane drift")], CODE)
    notes = spark.createDataFrame([("e", "a", "hazard", "drift")], LEDGER)
    found, asked = search.indexed(own, notes, str(tmp_path / "i")), search.tokens(spark.createDataFrame([("drift",)], "query string"))
    seen, best = [], index.best
    monkeypatch.setattr(index, "best", lambda rows, *rest: seen.append(sorted(rows.columns)) or best(rows, *rest))
    got = search.searched(found, asked, search.described(own, notes), 20).collect()
    assert seen == [["doc", "query", "score"]]
    assert {(r.doc, r.qname, r.file, r.haz) for r in got} == {("a", "m.drift", "src/x.py", 1), ("b", "m.lane", "src/x.py", 0)}


def test_anchors_need_no_index(spark, monkeypatch):
    """the index of all symbols was written to read the ledger's words from it."""
    monkeypatch.setattr(search, "symbol_index", lambda *_: pytest.fail("the index was asked for"))
    plans.load()
    assert QUERIES["anchor_filter"](spark, "/root/testdata/sf0.001").columns == ["query", "qname"]
