import random
from itertools import pairwise

import pytest

from tessera.operators import graph


def effects(spark, edges, declared):
    found = graph.inherited(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(declared, "symbol_id string, effect string"))
    return {tuple(r) for r in found.collect()}


def test_effects_travel_from_callee_to_caller(spark):
    edges = [("A", "B"), ("C", "A"), ("C", "B")]
    assert effects(spark, edges, [("A", "fs-read"), ("B", "net-out")]) == {("A", "net-out", "B"), ("C", "fs-read", "A"), ("C", "net-out", "A")}


def test_a_cycle_ends(spark):
    assert effects(spark, [("A", "B"), ("B", "A")], [("A", "fs-read"), ("B", "net-out")]) == {("A", "net-out", "B"), ("B", "fs-read", "A")}


def test_reach_gives_least_depth_and_respects_the_filter(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a", "a")], "root string, node string")
    assert {tuple(r) for r in graph.reach(edges, seeds, 3).collect()} == {("a", "b", 1), ("a", "c", 1), ("a", "d", 2)}
    through = spark.createDataFrame([("b",)], "node string")
    assert {tuple(r) for r in graph.reach(edges, seeds, 3, through).collect()} == {("a", "b", 1), ("a", "c", 1)}


def dig(seed, n, m):
    r = random.Random(seed)
    return sorted({(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(m)})


@pytest.mark.parametrize("hops, kinds", [(1, 3), (2, 70), (6, 5)])
def test_inherited_effects_are_the_least_fixpoint(spark, hops, kinds):
    edges, r = dig(hops, 40, 55), random.Random(kinds)
    own = {(f"n{r.randrange(40)}", f"e{i}") for i in range(kinds)} | {("ghost", "e0")}
    have = set(own)
    while True:
        more = {(a, e) for a, b in edges for x, e in have if x == b} - have
        if not more:
            break
        have |= more
    want = {}
    for a, b in edges:
        for x, e in have:
            if x == b and (a, e) not in own:
                want[a, e] = min(want.get((a, e), b), b)
    found = graph.inherited(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(sorted(own), "symbol_id string, effect string"), hops)
    assert {(x.symbol_id, x.effect): x.via for x in found.collect()} == want


def test_inherited_of_empty_tables(spark):
    edges, declared = spark.createDataFrame([], "src string, dst string"), spark.createDataFrame([], "symbol_id string, effect string")
    assert graph.inherited(edges, declared).collect() == [] and graph.communities(edges).collect() == []
    assert graph.inherited(edges, spark.createDataFrame([("a", "e")], "symbol_id string, effect string")).collect() == []


@pytest.mark.parametrize("hops", [1, 3, 6])
def test_spread_enters_no_stop(spark, hops):
    edges = dig(9, 30, 45)
    start, stop = [("r1", "n1"), ("r2", "n2"), ("r1", "n3")], [("r1", "n4"), ("r2", "n5"), ("r1", "n1")]
    want, frontier = set(start), set(start)
    while frontier:
        frontier = {(c, b) for c, n in frontier for a, b in edges if a == n} - want - set(stop)
        want |= frontier
    found = graph.spread(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(start, "root string, node string"), ["root"], spark.createDataFrame(stop, "root string, node string"), ["root", "node"], hops)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def groups(spark, edges, rounds=200):
    found = graph.communities(spark.createDataFrame(edges, "src string, dst string"), rounds)
    out = {}
    for r in found.collect():
        out.setdefault(r.community, set()).add(r.node)
    assert all(min(v) == k for k, v in out.items())
    return sorted(map(sorted, out.values()))


def test_communities(spark):
    bridged = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d"), ("d", "c"), ("e", "e")]
    assert groups(spark, bridged) == [["a", "b", "c"], ["d", "e", "f"]]
    assert groups(spark, [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")]) == [["a", "b", "c", "d"]]
    assert groups(spark, [("a", "a"), ("a", "b")]) == [["a", "b"]]
    star = [("hub", f"x{i}") for i in range(60)]
    assert groups(spark, star) == [sorted({"hub", *(b for _, b in star)})]


def test_modularity_never_falls_and_planted_groups_are_found(spark):
    r = random.Random(4)
    edges = [(f"g{g}n{a}", f"g{g}n{b}") for g in range(6) for a in range(12) for b in range(a) if r.random() < 0.5]
    edges += [(f"g{r.randrange(6)}n{r.randrange(12)}", f"g{r.randrange(6)}n{r.randrange(12)}") for _ in range(25)]
    frame = spark.createDataFrame(edges, "src string, dst string")
    score = [graph.modularity(frame, graph.communities(frame, n)) for n in (0, 1, 2, 4, 8, 200)]
    assert all(a <= b + 1e-9 for a, b in pairwise(score)) and score[-1] > score[1]
    planted = spark.createDataFrame(sorted({(n, n.split("n")[0]) for e in edges for n in e}), "node string, community string")
    one = planted.selectExpr("node", "'all' AS community")  # the graph is connected
    assert score[-1] >= 0.9 * graph.modularity(frame, planted) and score[-1] > graph.modularity(frame, one) + 0.3
