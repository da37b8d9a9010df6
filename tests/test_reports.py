"""Nested registries with broken levels, and reports whose blocks are cut."""

from tessera import plans
from tessera.operators import report, trees
from tessera.plans import reports
from tessera.registry import QUERIES

WHOLE = '{"symbol_id": "s", "contract": "c", "direction": "inbound", "confidence": 0.5}'


def test_broken_levels_of_a_registry_are_passed_over(spark):
    bodies = [
        None, "", "no json", "[]", "7", "null", '{"h": 1}', '{"h": null}', '{"h": [{"r": 1}]}', '{"h": {"r": "x"}}', '{"h": {"r": {"s": 3, "t": null}}}',
        '{"h": {"r": {"s": {"symbol_id": "s"}}}}', WHOLE, f'{{"h": {WHOLE}}}', f'{{"h1": 4, "h2": {{"r1": 5, "r2": {{"a": 6, "b": {WHOLE}}}}}}}',
        f'{{"h": {{"r": {{"a": {WHOLE}, "b": {WHOLE.replace("inbound", "sideways")}, "c": {WHOLE.replace("0.5", chr(34) + "high" + chr(34))}}}}}}}',
    ]
    found = trees.endpoints(spark.createDataFrame([(b, 1) for b in bodies], "body string, key int"))
    assert sorted(tuple(r) for r in found.collect()) == [("h", "r", "a", "s", "c", "inbound", 0.5), ("h2", "r2", "b", "s", "c", "inbound", 0.5)]


def test_broken_lists_of_data_flow_are_passed_over(spark):
    bodies = ['{"a": {"to_symbol_id": "x", "param": "p"}}', '{"a": [{"to_symbol_id": "x", "param": "p"}, 3, null, {"param": "p"}, [1]], "b": "n", "c": [{"to_symbol_id": "y", "param": "q", "arg": "z"}]}', None, "{"]
    found = trees.flows(spark.createDataFrame([(b,) for b in bodies], "body string"))
    assert sorted((tuple(r) for r in found.collect()), key=str) == [("a", "x", "p", None), ("c", "y", "q", "z")]


def test_blocks_are_cut_and_keys_without_rows_stay(spark):
    keys = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "key string, n int")
    one = spark.createDataFrame([("a", i % 5, f"i{i}") for i in range(40)] + [("b", 0, "x")], "key string, ord int, item string")
    two = spark.createDataFrame([("a", 1, "t"), ("z", 1, "u")], "key string, ord int, item string")
    got = {r.key: (r.n, list(r.one), list(r.two)) for r in report.assembled(keys, {"one": (one, 3), "two": (two, 9)}).collect()}
    assert got == {"a": (1, ["i0", "i10", "i15"], ["t"]), "b": (2, ["x"], []), "c": (3, [], [])}


def test_a_search_is_ranked_judged_and_doubted(spark):
    plans.load()
    rows = QUERIES["search_report"](spark, "/root/testdata/sf0.001").collect()
    own = {tuple(r) for r in QUERIES["uncertainty"](spark, "/root/testdata/sf0.001").select("query").collect()}
    assert {(r.key,) for r in rows} == own and all(len(r.uncertainty) == 1 for r in rows)
    names = {r.key: [s.removesuffix(" noted") for s in r.symbols_] for r in rows}
    assert any(r.feedback_suppressed for r in rows) and any(r.ambiguous_terms for r in rows) and any(r.boosted_outranked for r in rows)
    for r in rows:
        assert not set(r.feedback_suppressed) & set(names[r.key]) and not set(r.boosted_outranked) & set(names[r.key][:5])
        assert {f"ambiguous_term {t}" for t in r.ambiguous_terms} <= set(r.confidence_warnings)


def test_a_hit_counts_by_name_and_ledger(spark):
    shape = "score double, boost double, tier int, said int, owned int, inv int, overlap int, kind string, asks_state boolean"
    given = [(1.0, 2.0, 0, 1, 1, 0, 2, "class", False), (1.0, 0.0, 1, 0, 1, 0, 1, "method", False), (1.0, 0.0, 0, 0, 1, 0, 0, "class", False), (1.0, 0.0, 0, 0, 0, 1, 1, "class", False), (1.0, 0.0, 0, 0, 0, 0, 2, "class", False), (1.0, 0.0, 0, 0, 0, 0, 2, "class", True)]
    found = spark.createDataFrame(given, shape).selectExpr(f"{reports.TOTAL.replace('@D', 'D')} AS total")
    assert [r.total for r in found.collect()] == [9.0, 2.5, 3.0, 2.5, 0.2, 1.0]
