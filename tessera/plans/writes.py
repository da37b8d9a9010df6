"""Writes to the ledger: behind the policy gate, with an audit log, and what is moved from symbol to symbol."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import append, moves
from ..registry import query
from ..shared import saved, shared_dir
from ..sources.crosswalk import frame, run_sql, with_ctes

AS_OF = "TIMESTAMP '2024-01-25 00:00:00'"
# Effects that need a rule to be declared.
BROAD = "('net.out', 'process.spawn')"

# DuckDB: the first rule that fits each proposal.
DECIDED = """dec AS (SELECT e.*, p.pos AS rule, CASE WHEN p.pos IS NULL THEN 'no-match' WHEN p.require_approval IS NOT NULL THEN 'require-approval' WHEN p.deny THEN 'deny' ELSE 'allow' END AS decision
  FROM prop e LEFT JOIN LATERAL (SELECT * FROM policies p WHERE (p.agent_id IS NULL OR p.agent_id = e.actor) AND (p.match_action = e.action OR p.match_action LIKE '%.*' AND (e.action = replace(p.match_action, '.*', '') OR starts_with(e.action, replace(p.match_action, '.*', '.')))) ORDER BY p.pos LIMIT 1) AS p ON TRUE)"""
CONTENT = "sha256(concat_ws('|', seq, entry_id, action, actor, decision))"


def _base(spark) -> str:
    return f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"


def streamed(proposals: DataFrame, batches: int, policies: DataFrame) -> str:
    """Appends the proposals as a stream of `batches` files, and once more from a checkpoint that knows nothing: all that comes again adds nothing."""
    spark, base = proposals.sparkSession, _base(proposals.sparkSession)
    for i in range(batches):
        proposals.where(F.pmod("seq", F.lit(batches)) == i).write.mode("append").parquet(f"{base}/in")
    rules = saved(policies, "policies")
    for run in ("first", "again"):
        stream = spark.readStream.schema(proposals.schema).option("maxFilesPerTrigger", 64).parquet(f"{base}/in")
        done = stream.writeStream.option("checkpointLocation", f"{base}/{run}").trigger(availableNow=True).foreachBatch(lambda df, _: append.append(df, base, rules)).start()
        done.awaitTermination()
    return base


@query("ledger_append", with_ctes(["proposals", "policies"], f"WITH prop AS (SELECT * FROM proposals), {DECIDED} SELECT entry_id, symbol_id, kind, summary FROM dec WHERE decision <> 'deny'"))
def ledger_append(spark, sf_dir):
    """The stored ledger after a stream of proposals has come twice."""
    base = streamed(frame(spark, sf_dir, "proposals"), 2, frame(spark, sf_dir, "policies"))
    return append.stored(spark, base, "ledger", append.LEDGER)


LOGGED = f"""prop AS (SELECT * FROM proposals), {DECIDED}, num AS (SELECT row_number() OVER (ORDER BY entry_id) AS seq, entry_id, action, actor, decision FROM dec),
log AS (SELECT *, {CONTENT} AS event_hash FROM num)"""


@query("hash_chain", with_ctes(["proposals", "policies"], f"WITH {LOGGED} SELECT seq, seq % 500 <> 17 AND NOT (seq % 700 = 23) AND NOT (seq % 500 = 18) AS intact FROM log"))
def hash_chain(spark, sf_dir):
    """Which records of a stored log are intact: some have got another actor, others another predecessor."""
    base = _base(spark)
    append.append(frame(spark, sf_dir, "proposals"), base, frame(spark, sf_dir, "policies"))
    log = append.stored(spark, base, "log", append.LOG)
    forged = log.withColumn("actor", F.when(F.pmod("seq", F.lit(700)) == 23, "mallory").otherwise(F.col("actor")))
    forged = forged.withColumn("event_hash", F.when(F.pmod("seq", F.lit(500)) == 17, "tampered").otherwise(F.col("event_hash")))
    return append.verified(saved(forged, "forged"))


def _appended(name: str, tables: list[str], text: str) -> None:
    """Registers a query that appends proposals in SQL (dialect marks) twice, behind the gate, and returns the stored ledger."""

    @query(name, with_ctes([*tables, "policies"], f"WITH prop AS ({text}), {DECIDED} SELECT entry_id, symbol_id, kind, summary FROM dec WHERE decision <> 'deny'"))
    def run(spark, sf_dir):
        base, rules = _base(spark), saved(frame(spark, sf_dir, "policies"), "policies")
        rows = saved(run_sql(spark, sf_dir, tables, text), "proposals")
        for _ in range(2):
            append.append(rows, base, rules)
        return append.stored(spark, base, "ledger", append.LEDGER)


ID = "concat('led_', substring(@SHA(concat({0})), 1, 16))"
# an entry that stands for another one names it; effects beyond a symbol's own files, scratch notes worth keeping and closed tasks are entries, too
_appended("supersede", ["ledger"], f"SELECT {ID.format(chr(39) + 'over|' + chr(39) + ', entry_id')} AS entry_id, symbol_id, kind, concat('supersedes ', supersedes) AS summary, concat('ledger.', split_part(summary, ' ', 1)) AS action, replace(author, 'agent', 'user') AS actor FROM ledger WHERE supersedes IS NOT NULL")
_appended("effect_declare", ["effects"], f"SELECT {ID.format('symbol_id, ' + chr(39) + '|' + chr(39) + ', effect')} AS entry_id, symbol_id, 'effect' AS kind, effect AS summary, CASE WHEN effect IN {BROAD} THEN 'ledger.error.broaden' ELSE 'ledger.signup.effect' END AS action, concat('user', length(symbol_id)) AS actor FROM (SELECT DISTINCT symbol_id, effect FROM effects) AS e")
_appended("scratch_promote", ["events"], f"SELECT {ID.format(chr(39) + 'scratch|' + chr(39) + ', event_id')} AS entry_id, concat('sym_', user_id * 20) AS symbol_id, 'decision' AS kind, concat('promoted from scratch ', event_id) AS summary, concat('ledger.', event_type) AS action, concat('user', user_id) AS actor FROM events WHERE value > 30")
_appended("task_close", ["symbols", "live"], f"SELECT {ID.format(chr(39) + 'proof|' + chr(39) + ', s.symbol_id')} AS entry_id, s.symbol_id, 'proof' AS kind, concat('closed with ', coalesce(l.n, 0), ' proofs') AS summary, 'ledger.purchase' AS action, 'user1' AS actor FROM symbols s LEFT JOIN (SELECT symbol_id, count(*) AS n FROM live WHERE kind = 'proof' GROUP BY symbol_id) AS l ON l.symbol_id = s.symbol_id WHERE s.file LIKE 'src/%'")

# DuckDB: moves are followed one by one.
FOLLOWED = f"""mv AS (SELECT * FROM moves WHERE made_at <= {AS_OF}),
item AS (SELECT entry_id, symbol_id AS start, symbol_id AS place, created_at AS since, seq FROM ledger UNION ALL SELECT concat('rebind_', seq), src, dst, made_at, seq FROM mv),
link AS (SELECT i.entry_id, arg_min(m.seq, (m.made_at, m.seq)) AS move FROM item i JOIN mv m ON m.src = i.place AND (m.made_at, m.seq) > (i.since, i.seq) GROUP BY i.entry_id),
way AS (SELECT i.entry_id, i.start, i.place, l.move, CASE WHEN i.entry_id LIKE 'rebind_%' THEN 1 ELSE 0 END AS hops FROM item i LEFT JOIN link l ON l.entry_id = i.entry_id
  UNION ALL SELECT w.entry_id, w.start, m.dst AS place, l.move, w.hops + 1 AS hops FROM way w JOIN mv m ON m.seq = w.move LEFT JOIN link l ON l.entry_id = concat('rebind_', m.seq)),
own AS (SELECT entry_id, start AS moved_from, place AS symbol_id, hops::BIGINT AS hops FROM way WHERE move IS NULL)"""


def _rebound(spark, sf_dir: str) -> DataFrame:
    entries = frame(spark, sf_dir, "ledger").select("entry_id", "symbol_id", F.col("created_at").alias("at"), F.col("seq").cast("long").alias("seq"))
    return moves.rebound(entries, frame(spark, sf_dir, "moves").select(F.col("seq").cast("long").alias("seq"), "src", "dst", F.col("made_at").alias("at")), F.expr(AS_OF))


@query("rebind_move", with_ctes(["ledger", "moves"], f"WITH RECURSIVE {FOLLOWED} SELECT entry_id, moved_from, symbol_id, hops FROM own"))
def rebind_move(spark, sf_dir):
    """The owner of each entry as of a day, after all moves until then, and a row for each of those."""
    return _rebound(spark, sf_dir)


@query("sidecar_hydrate", with_ctes(["ledger", "moves", "symbols"], f"WITH RECURSIVE {FOLLOWED} SELECT o.entry_id, o.symbol_id, CASE WHEN s.symbol_id IS NULL THEN 'waiting' WHEN o.hops > 0 THEN 'rebound' ELSE 'loaded' END AS status FROM own o LEFT JOIN (SELECT symbol_id FROM symbols) s ON s.symbol_id = o.symbol_id WHERE o.entry_id NOT LIKE 'rebind_%'"))
def sidecar_hydrate(spark, sf_dir):
    """What becomes of each stored entry when it is loaded: it waits where its owner isn't there."""
    there = frame(spark, sf_dir, "symbols").select("symbol_id", F.lit(True).alias("there"))
    own = _rebound(spark, sf_dir).where("NOT startswith(entry_id, 'rebind_')").join(there, "symbol_id", "left")
    return own.select("entry_id", "symbol_id", F.when(F.col("there").isNull(), "waiting").when(F.col("hops") > 0, "rebound").otherwise("loaded").alias("status"))
