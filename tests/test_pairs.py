"""Joins of few keys with large groups, and what is made of them without their pairs."""

import random
from collections import Counter

from tessera import plans
from tessera.operators import pairs
from tessera.plans import graphs, reports
from tessera.registry import QUERIES

plans.load()


def test_pairs_in_blocks_are_those_of_a_join(spark):
    r = random.Random(2)
    left = [(r.choice("aaab") if i % 9 else None, i % 40) for i in range(90)]
    right = [(r.choice("aaac") if i % 9 else None, i % 30) for i in range(100)]
    found = pairs.paired(spark.createDataFrame(left, "k string, l int"), spark.createDataFrame(right, "k string, r int"), "k", block=7)
    assert found.columns == ["k", "l", "r"]
    assert Counter(map(tuple, found.collect())) == Counter((a, x, y) for a, x in left for b, y in right if a is not None and a == b)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_blocks_of_pairs_are_dealt_out(spark):
    for name in ("contract_match_join", "federated_join", "covering_tests"):
        assert "Aggregate [qname" not in plan(QUERIES[name](spark, "/root/testdata/sf0.001")) and "__held" in plan(QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_impact_makes_no_pairs(spark):
    assert "LeftSemi" in plan(QUERIES["federated_impact"](spark, "/root/testdata/sf0.001"))


def test_a_context_takes_the_first_tests_only(spark):
    data = "/root/testdata/sf0.01"
    best = {}
    for q, t in sorted(map(tuple, graphs.covering_tests(spark, data).collect())):
        best.setdefault(q, []).append(t)
    assert max(map(len, best.values())) > 2
    assert Counter(map(tuple, graphs.first_covering(spark, data, 2).collect())) == Counter((q, t) for q, ts in best.items() for t in ts[:2])
    assert "__held" not in plan(reports._covering(spark, data)["covering"])


def test_every_file_is_judged_for_every_query(spark):
    found = QUERIES["query_names_file"](spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len({r.file for r in found}) * len({r.query for r in found}) and {r.named for r in found} == {True, False}
