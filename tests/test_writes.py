"""Replayed appends, verified logs, chains of moves and values carried over ranges."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.operators import append, moves, order

POLICY = "pos int, match_action string, deny boolean, require_approval string, agent_id string"
START = datetime(2024, 1, 1)


def proposals(spark, rows):
    return spark.createDataFrame([(f"led_{i}", f"sym_{i % 3}", "decision", "s", a, w) for i, a, w in rows], "entry_id string, symbol_id string, kind string, summary string, action string, actor string")


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    base = str(tmp_path)
    rules = spark.createDataFrame([(1, "ledger.deny.*", True, None, None), (2, "ledger.*", False, None, "ann"), (3, "ledger.ask", False, "human", None)], POLICY)
    rows = [(i, ["ledger.deny", "ledger.deny.x", "ledger.denying", "ledger.ask", "other"][i % 5], ["ann", "bob"][i % 2]) for i in range(60)]
    for some in (rows[:25], rows[:25], rows[10:40], rows[25:], rows):
        append.append(proposals(spark, some), base, rules)
    ledger = [r.entry_id for r in append.stored(spark, base, "ledger", append.LEDGER).collect()]
    assert sorted(ledger) == sorted(f"led_{i}" for i, a, _ in rows if not a.startswith("ledger.deny") or a == "ledger.denying")
    log = append.stored(spark, base, "log", append.LOG)
    found = {r.entry_id: r.decision for r in log.collect()}
    assert len(found) == log.count() == 60 and sorted(r.seq for r in log.collect()) == list(range(1, 61))
    want = lambda a, w: "deny" if a in ("ledger.deny", "ledger.deny.x") else "allow" if a.startswith("ledger.") and w == "ann" else "require-approval" if a == "ledger.ask" else "no-match"
    assert found == {f"led_{i}": want(a, w) for i, a, w in rows}
    assert all(r.intact for r in append.verified(log).collect())


def test_a_batch_that_broke_off_is_finished_by_its_replay(spark, tmp_path):
    base = str(tmp_path)
    rows = proposals(spark, [(i, "a", "w") for i in range(6)])
    rows.where("entry_id < 'led_3'").select("entry_id", "symbol_id", "kind", "summary").write.parquet(f"{base}/ledger")  # written, but not in the log
    append.append(rows, base, spark.createDataFrame([], POLICY))
    assert sorted(r.entry_id for r in append.stored(spark, base, "ledger", append.LEDGER).collect()) == [f"led_{i}" for i in range(6)]


def test_faults_of_a_log_are_found(spark, tmp_path):
    append.append(proposals(spark, [(i, "a", "w") for i in range(30)]), str(tmp_path), spark.createDataFrame([], POLICY))
    log = append.stored(spark, str(tmp_path), "log", append.LOG)
    bad = lambda df: [r.seq for r in append.verified(df).orderBy("seq").collect() if not r.intact]
    assert bad(log) == []
    assert bad(log.withColumn("actor", F.when(F.col("seq") == 7, "mallory").otherwise(F.col("actor")))) == [7]
    assert bad(log.where("seq <> 9")) == [10]
    assert bad(log.withColumn("prev_event_hash", F.when(F.col("seq") == 1, "x").otherwise(F.col("prev_event_hash")))) == [1]


def follow(entries, log):
    out = {}
    for name, place, at, seq in entries:
        hops, key, here = 0, (at, seq), place
        while later := [m for m in log if m[1] == here and (m[3], m[0]) > key]:
            m = min(later, key=lambda m: (m[3], m[0]))
            hops, key, here = hops + 1, (m[3], m[0]), m[2]
        out[name] = (place, here, hops)
    return out


def test_moves_are_followed_to_their_end(spark):
    day = lambda n: START + timedelta(days=n)
    log = [(i, f"p{i}", f"p{i + 1}", day(i)) for i in range(10)]  # a chain of ten
    log += [(20, "a", "b", day(1)), (21, "b", "a", day(2)), (22, "a", "b", day(3)), (30, "x", "y", day(40)), (31, "q", "q", day(4)), (32, "q", "r", day(4))]
    r = random.Random(2)
    log += [(100 + i, f"z{r.randrange(6)}", f"z{r.randrange(6)}", day(r.randrange(9))) for i in range(40)]
    entries = [("e1", "p0", day(-1), 0), ("e2", "p5", day(2), 0), ("e3", "p5", day(6), 0), ("e4", "a", day(0), 0), ("e5", "x", day(0), 0), ("e6", "none", day(0), 0), ("e7", "q", day(4), 31)]
    entries += [(f"r{i}", f"z{r.randrange(6)}", day(r.randrange(9)), r.randrange(200)) for i in range(60)]
    found = moves.rebound(spark.createDataFrame(entries, "entry_id string, symbol_id string, at timestamp, seq long"), spark.createDataFrame(log, "seq long, src string, dst string, at timestamp"), F.lit(day(30)))
    got = {x.entry_id: (x.moved_from, x.symbol_id, x.hops) for x in found.collect()}
    known = [m for m in log if m[3] <= day(30)]
    want = follow(entries, known)
    ends = follow([(f"rebind_{s}", dst, at, s) for s, _, dst, at in known], known)
    want |= {name: (src, ends[name][1], ends[name][2] + 1) for name, src in ((f"rebind_{s}", src) for s, src, _, _ in known)}
    assert got == want and got["e1"] == ("p0", "p10", 10) and got["e4"] == ("a", "b", 3) and got["e5"] == ("x", "x", 0)
    none = moves.rebound(spark.createDataFrame(entries[:1], "entry_id string, symbol_id string, at timestamp, seq long"), spark.createDataFrame([], "seq long, src string, dst string, at timestamp"), F.lit(day(30)))
    assert [tuple(x) for x in none.collect()] == [("e1", "p0", "p0", 0)]


def test_values_are_carried_over_ranges(spark):
    r = random.Random(5)
    rows = [("big" if r.random() < 0.7 else r.choice("abc"), i, r.choice([None, None, None, i])) for i in range(300)]
    found = order.carried(spark.createDataFrame(rows, "g string, n int, v int").repartition(7), "g", [F.col("n").asc()], F.col("v"), "before")
    held, want = {}, {}
    for g, n, v in rows:
        want[n] = held.get(g)
        held[g] = v if v is not None else held.get(g)
    assert {x.n: x.before for x in found.collect()} == want
