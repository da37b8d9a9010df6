"""Words within texts and the queries that they answer, row by row, against plain Python."""

import random

from pyspark.sql import functions as F

from tessera import plans
from tessera.operators import answers, contain
from tessera.registry import QUERIES

plans.load()


def test_needles_in_rows_are_exact(spark):
    r = random.Random(9)
    text = lambda: r.choice([None, "", "é"]) if r.random() < 0.1 else "".join(r.choice("abc") for _ in range(r.randint(0, 12)))
    rows = [(i, text(), text()) for i in range(120)]
    needles = ["a", "bc", "abc", "caba", "é", "zzz", "z", None, ""]
    found = contain.needles_in(spark.createDataFrame(rows, "id int, x string, y string"), [F.col("x"), F.col("y")], spark.createDataFrame([(n,) for n in needles], "n string"))
    want = sorted((i, n, (n in (x or "")) + 2 * (n in (y or ""))) for i, x, y in rows for n in needles if n and (n in (x or "") or n in (y or "")))
    assert sorted((r.id, r.needle, r.mask) for r in found.collect()) == want
    assert contain.needles_in(spark.createDataFrame(rows, "id int, x string, y string"), [F.col("x")], spark.createDataFrame([], "n string")).count() == 0


def test_each_query_is_answered_once(spark):
    held = {"s1": {"a": 1, "b": 2}, "s2": {"c": 4}, "s3": {"z": 1}}
    words = spark.createDataFrame([(s, w, m) for s, own in held.items() for w, m in own.items()] + [("s1", "b", 4)], "symbol_id string, needle string, mask int")
    asked = spark.createDataFrame([("q1", 0, "x"), ("q1", 1, "b"), ("q1", 2, "a"), ("q1", 3, "b"), ("q2", 0, "c"), ("q3", 0, "none")], "query string, at int, term string")
    found = answers.answered(answers.gathered(words, "symbol_id"), answers.worded(asked))
    assert sorted((r.symbol_id, r.query, list(r.masks)) for r in found.collect()) == [("s1", "q1", [0, 6, 1, 6]), ("s2", "q2", [4])]


def test_pairs_are_not_dealt_out(spark):
    """The rows that go to the result are made after the last exchange of symbols, by a join with queries that are broadcast."""
    for name in ("explain_match", "confidence_reason", "result_bucket", "constraint_penalty", "file_feedback"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        made = plan[: plan.index("Generate explode(map_keys")]
        assert "Aggregate" not in made and "Distinct" not in made, name
