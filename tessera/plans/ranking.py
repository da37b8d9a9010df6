"""Windows, cuts, ranked search, feedback, policies and the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.contain import contained
from ..registry import query
from ..shared import saved
from ..sources.crosswalk import frame, run_sql, with_ctes
from .base import placed, sql

SYM = "SELECT symbol_id, qname, file, language, CASE WHEN qname LIKE '%ring%' THEN 4 ELSE 0 END + CASE WHEN qname LIKE '%red%' THEN 4 ELSE 0 END + CASE WHEN signature LIKE '%ring%' THEN 3 ELSE 0 END + CASE WHEN signature LIKE '%red%' THEN 3 ELSE 0 END + CASE WHEN coalesce(doc, '') LIKE '%ring%' THEN 3 ELSE 0 END + CASE WHEN coalesce(doc, '') LIKE '%red%' THEN 3 ELSE 0 END + CASE WHEN file LIKE '%red%' THEN 1 ELSE 0 END AS score FROM symbols"
SCORED = f"SELECT symbol_id, qname, file, language, score FROM ({SYM}) AS s WHERE score > 0"
HITS = f"SELECT symbol_id, qname, file, language, score, row_number() OVER (ORDER BY score DESC, qname) AS place FROM ({SCORED}) AS s"
sql("fallback_search", "symbols", f"SELECT qname, score, place FROM ({HITS}) AS h WHERE place <= 30")
sql("topk_score", "symbols", f"SELECT qname, score, place FROM ({HITS}) AS h WHERE place <= 10")
sql("overfetch", "symbols", f"SELECT qname, score, row_number() OVER (ORDER BY score + CASE WHEN file LIKE 'models/%' THEN 2 ELSE 0 END DESC, qname) AS place FROM ({HITS}) AS h WHERE place <= 80")
sql("truncate_depth", "symbols", f"SELECT qname, place FROM ({HITS}) AS h WHERE place <= 40 AND file LIKE 'models/%'")
sql("task_bias", "symbols", f"SELECT qname, score + CASE WHEN file LIKE 'storage/%' THEN 1 ELSE 0 END AS score FROM ({SCORED}) AS h")
sql("confidence_norm", "symbols", f"SELECT h.qname, round(CASE WHEN r.high = r.low THEN 1.0@D ELSE 0.1@D + 0.9@D * (h.score - r.low) / (r.high - r.low) END, 6) AS confidence FROM ({SCORED}) AS h CROSS JOIN (SELECT min(score) AS low, max(score) AS high FROM ({SCORED}) AS h) AS r")
# equal scores are no cliff, so the different scores tell where the first one is
LEVELS = f"SELECT score, before, before <= 0 OR score * 1.0@D / before < 0.7@D AS cliff FROM (SELECT score, lag(score) OVER (ORDER BY score DESC) AS before FROM (SELECT DISTINCT score FROM ({SCORED}) AS h) AS d) AS l"
placed("cliff_cut", "symbols", f"SELECT h.qname, h.score FROM ({SCORED}) AS h CROSS JOIN (SELECT coalesce(max(CASE WHEN cliff THEN score END), -1) AS edge FROM ({LEVELS}) AS l) AS e WHERE h.score > e.edge", "score DESC, qname")
sql("score_floor", "symbols", f"SELECT round(greatest(0.4@D * max(score), coalesce(max(CASE WHEN cliff THEN before END), 0)), 6) AS score_floor FROM ({LEVELS}) AS l")
sql("dedup_by_file", "symbols live", f"SELECT file, qname FROM (SELECT h.file, h.qname, row_number() OVER (PARTITION BY h.file ORDER BY CASE WHEN l.symbol_id IS NULL THEN 1 ELSE 0 END, h.score DESC, h.qname) AS r FROM ({SCORED}) AS h LEFT JOIN (SELECT DISTINCT symbol_id FROM live) l ON l.symbol_id = h.symbol_id) AS t WHERE r = 1")
placed("finalize_files", "symbols", f"SELECT file, max(score) AS best, CASE WHEN file LIKE 'models/%' THEN 0 ELSE 1 END AS _rank FROM ({SCORED}) AS h GROUP BY file", "_rank, best DESC, file")
sql("score_file_push", "symbols", f"SELECT file, qname FROM (SELECT file, qname, row_number() OVER (PARTITION BY file ORDER BY score DESC, qname) AS r FROM ({SCORED}) AS h WHERE score >= 4) AS t WHERE r = 1")
sql("first_row_per_group", "symbols", "SELECT file, qname, start_line FROM (SELECT file, qname, start_line, row_number() OVER (PARTITION BY file ORDER BY start_line, qname) AS r FROM symbols) AS t WHERE r = 1")
sql("front_door", "symbols", "SELECT package, qname FROM (SELECT @GROUP(file, '^(.*)/[^/]*$') AS package, qname, row_number() OVER (PARTITION BY @GROUP(file, '^(.*)/[^/]*$') ORDER BY length(qname), qname) AS r FROM symbols) AS t WHERE r = 1")
sql("latest_first", "ledger", "SELECT entry_id, place FROM (SELECT entry_id, row_number() OVER (ORDER BY created_at DESC, entry_id) AS place FROM ledger WHERE kind IN ('decision', 'hazard')) AS t WHERE place <= 50")
sql("cap_history", "events", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id DESC) AS r FROM events) AS t WHERE r <= 500")
sql("history_window", "events", "SELECT event_id, place FROM (SELECT event_id, row_number() OVER (ORDER BY event_id DESC) AS place FROM events WHERE event_type = 'signup') AS t WHERE place <= 25")
sql("trust_history", "events", "SELECT event_id, row_number() OVER (ORDER BY event_id) AS place FROM (SELECT event_id, row_number() OVER (ORDER BY event_id DESC) AS r FROM events) AS t WHERE r <= 40")
sql("cursor_tail", "audit", "SELECT seq, event_type, outcome FROM audit WHERE seq > coalesce((SELECT max(seq) FROM audit WHERE seq = 9000), -1) AND event_type LIKE '%purch%' AND outcome = 'allow'")

ACTION = "CASE role WHEN 'stale-api' THEN 'delete' WHEN 'diagnostic-test' THEN 'gate' WHEN 'fast-test' THEN 'run' ELSE 'review' END"
placed("recipe_order", "live", f"SELECT entry_id, action, CASE action WHEN 'delete' THEN 0 WHEN 'move' THEN 1 WHEN 'gate' THEN 2 WHEN 'run' THEN 3 WHEN 'keep' THEN 4 ELSE 5 END AS _rank, _seq FROM (SELECT entry_id, seq AS _seq, {ACTION} AS action FROM live) AS t", "_rank, _seq")
RULES = "CASE WHEN kind = 'mapping' THEN 1 WHEN kind IN ('constraint', 'decision') AND role = 'stale-api' THEN 2 WHEN kind IN ('ownership', 'concept') AND role = 'diagnostic-test' THEN 3 WHEN kind IN ('ownership', 'concept') AND role = 'fast-test' AND command IS NOT NULL THEN 4 ELSE 5 END"
PICK = f"SELECT symbol_id, min({RULES}) AS rule FROM live GROUP BY symbol_id"
sql("pick_action", "live", f"SELECT symbol_id, CASE rule WHEN 1 THEN 'keep-as-covered' WHEN 2 THEN 'delete' WHEN 3 THEN 'gate' WHEN 4 THEN 'run' ELSE 'review' END AS action FROM ({PICK}) AS p")
sql("classify_test_migration", "live symbols", f"SELECT s.qname, CASE p.rule WHEN 1 THEN 'keep-as-covered' WHEN 2 THEN 'delete' WHEN 3 THEN 'gate' WHEN 4 THEN 'run' ELSE 'review' END AS action FROM symbols s LEFT JOIN ({PICK}) AS p ON p.symbol_id = s.symbol_id WHERE s.file LIKE 'tests/%'")
sql("migrate_stale_tests", "live symbols", f"SELECT s.qname, CASE WHEN m.symbol_id IS NOT NULL THEN 'move' WHEN p.rule = 2 THEN 'delete' WHEN p.rule = 3 THEN 'gate' ELSE 'review' END AS action FROM symbols s LEFT JOIN ({PICK}) AS p ON p.symbol_id = s.symbol_id LEFT JOIN (SELECT DISTINCT symbol_id FROM live WHERE kind = 'mapping' AND role = 'audit-pending') m ON m.symbol_id = s.symbol_id WHERE s.file LIKE 'tests/%'")
DECIDE = "SELECT a.seq, a.event_type, a.actor_id, min(p.pos) AS pos FROM audit a LEFT JOIN policies p ON (p.agent_id IS NULL OR concat('user', replace(p.agent_id, 'user', '')) = a.actor_id) AND (p.match_action = a.event_type OR (p.match_action LIKE '%.*' AND (a.event_type = replace(p.match_action, '.*', '') OR a.event_type LIKE replace(p.match_action, '.*', '.%')))) GROUP BY a.seq, a.event_type, a.actor_id"
VERDICT = "CASE WHEN d.pos IS NULL THEN 'no-match' WHEN p.require_approval IS NOT NULL THEN 'require-approval' WHEN p.deny THEN 'deny' ELSE 'allow' END"
sql("policy_match", "audit policies", f"SELECT seq, pos FROM ({DECIDE}) AS d")
sql("policy_eval", "audit policies", f"SELECT d.seq, d.event_type, {VERDICT} AS decision FROM ({DECIDE}) AS d LEFT JOIN policies p ON p.pos = d.pos")
sql("policy_gate_write", "audit policies", f"SELECT decision, count(*) AS n, decision <> 'deny' AS written FROM (SELECT {VERDICT} AS decision FROM ({DECIDE}) AS d LEFT JOIN policies p ON p.pos = d.pos) AS t GROUP BY decision")
sql("supersede_anti_join", "live", "SELECT entry_id, symbol_id, kind FROM live")
sql("ledger_list", "live", "SELECT symbol_id, entry_id, row_number() OVER (PARTITION BY symbol_id ORDER BY created_at DESC, entry_id) AS place FROM live")
sql("conclusions_list", "live symbols", "SELECT s.qname, l.entry_id, l.kind, row_number() OVER (PARTITION BY s.qname ORDER BY l.created_at DESC, l.entry_id) AS place FROM live l JOIN symbols s ON s.symbol_id = l.symbol_id WHERE l.kind IN ('hazard', 'known_bug')")
# a workspace's list has superseded entries too; that of one symbol has live ones
sql("invariant_list", "ledger live symbols", "SELECT 'workspace' AS scope, s.qname, l.entry_id, l.summary FROM ledger l JOIN symbols s ON s.symbol_id = l.symbol_id WHERE l.kind = 'invariant' UNION ALL SELECT 'symbol' AS scope, s.qname, l.entry_id, l.summary FROM live l JOIN symbols s ON s.symbol_id = l.symbol_id WHERE l.kind = 'invariant' AND s.symbol_id = 'sym_100'")
sql("feedback_mark", "feedback", "SELECT entry_id, created_at + INTERVAL 30 DAY AS expires_at FROM feedback WHERE verdict = 'noisy'")
sql("feedback_promote", "feedback", "SELECT concat('own_', entry_id) AS entry_id, symbol_id, 'ownership' AS kind, 'truth' AS tag FROM feedback WHERE verdict = 'useful'")
sql("orphan_anti_join", "ledger symbols", "SELECT l.entry_id, l.symbol_id, 'orphaned' AS tag FROM ledger l LEFT JOIN (SELECT symbol_id FROM symbols) s ON s.symbol_id = l.symbol_id WHERE s.symbol_id IS NULL")
sql("repair_scan", "ledger symbols effects edges", "SELECT 'orphan-ledger' AS issue, count(*) AS n FROM ledger WHERE symbol_id NOT IN (SELECT symbol_id FROM symbols) UNION ALL SELECT 'orphan-effect' AS issue, count(*) AS n FROM effects WHERE symbol_id NOT IN (SELECT symbol_id FROM symbols) UNION ALL SELECT 'dangling-edge' AS issue, count(*) AS n FROM edges WHERE dst NOT IN (SELECT symbol_id FROM symbols) UNION ALL SELECT 'dangling-supersede' AS issue, count(*) AS n FROM ledger WHERE supersedes IS NOT NULL AND supersedes NOT IN (SELECT entry_id FROM ledger)")
sql("repair_fix", "edges symbols", "SELECT src, dst FROM edges WHERE src IN (SELECT symbol_id FROM symbols) AND dst IN (SELECT symbol_id FROM symbols)")
sql("anchor_topup", "live symbols", f"SELECT qname, score FROM (SELECT qname, score * 1.0@D AS score FROM ({HITS}) AS h WHERE place <= 10 UNION ALL SELECT qname, 0.5@D AS score FROM (SELECT s.qname, row_number() OVER (ORDER BY s.qname) AS r FROM symbols s JOIN (SELECT DISTINCT symbol_id FROM live WHERE kind IN ('invariant', 'hazard')) l ON l.symbol_id = s.symbol_id WHERE s.qname NOT LIKE '%ring%' AND s.qname NOT LIKE '%red%') AS a WHERE r <= 5) AS t")
sql("feedback_state", "feedback", "SELECT count(*) AS total, count(CASE WHEN query LIKE '%ring%' THEN 1 END) AS matched, count(CASE WHEN query LIKE '%ring%' AND verdict <> 'missing' THEN 1 END) AS applied FROM feedback")
sql("intersect_tokens", "feedback", "SELECT DISTINCT query, split_part(query, ' ', 1) IN ('red', 'ring') OR split_part(query, ' ', 2) IN ('red', 'ring') AS matches FROM feedback")
sql("union_all_tokens", "symbols", "SELECT 'ring' AS token, qname FROM symbols WHERE qname LIKE '%ring%' UNION ALL SELECT 'bolt' AS token, qname FROM symbols WHERE qname LIKE '%bolt%'")
# search hits, and symbols of files whose stem is asked for, if no hit covers the file
sql("union_candidates", "symbols", f"SELECT qname, 'search' AS source FROM ({HITS}) AS h WHERE place <= 20 UNION ALL SELECT s.qname, 'stem' AS source FROM symbols s LEFT JOIN (SELECT DISTINCT file FROM ({HITS}) AS h WHERE place <= 20) c ON c.file = s.file WHERE c.file IS NULL AND @GROUP(s.file, '([^/]*)[.][a-z]+$') = 'brand7'")
# where the filtered search has fewer than 100 hits, the search without filters adds those that it left out
FILTERED = "language = 'python' AND file LIKE 'views/%'"
sql("broadened_search", "symbols", f"SELECT h.qname, h.score FROM ({SCORED}) AS h LEFT JOIN (SELECT qname FROM ({SCORED}) AS p WHERE {FILTERED}) AS p ON p.qname = h.qname CROSS JOIN (SELECT count(*) AS n FROM ({SCORED}) AS p WHERE {FILTERED}) AS c WHERE p.qname IS NULL AND c.n < 100")
sql("distinct_summary", "live", "SELECT kind, summary, min(entry_id) AS entry_id FROM live WHERE kind = 'invariant' GROUP BY kind, summary UNION ALL SELECT kind, summary, entry_id FROM live WHERE kind = 'hazard'")
sql("df_per_token", "symbols", "SELECT token, count(DISTINCT file) AS n FROM (SELECT split_part(split_part(qname, '.', 3), '_', 1) AS token, file FROM symbols UNION ALL SELECT split_part(split_part(qname, '.', 3), '_', 2) AS token, file FROM symbols) AS t GROUP BY token")
sql("ambiguous_tokens", "symbols", "SELECT token FROM (SELECT split_part(split_part(qname, '.', 3), '_', 1) AS token, file FROM symbols UNION ALL SELECT split_part(split_part(qname, '.', 3), '_', 2) AS token, file FROM symbols) AS t GROUP BY token HAVING count(DISTINCT file) > 25")
sql("first_row_batch", "symbols", "SELECT token, file, qname FROM (SELECT split_part(split_part(qname, '.', 3), '_', 2) AS token, file, qname, row_number() OVER (PARTITION BY split_part(split_part(qname, '.', 3), '_', 2), file ORDER BY start_line, qname) AS r FROM symbols) AS t WHERE r = 1")
sql("cooccurrence", "symbols", f"SELECT word, n, place FROM (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS place FROM (SELECT split_part(split_part(qname, '.', 3), '_', 1) AS word, count(*) AS n FROM ({HITS}) AS h WHERE place <= 100 GROUP BY 1) AS c WHERE word NOT IN ('red', 'ring')) AS t WHERE place <= 3")
sql("better_queries", "symbols", f"SELECT package, CASE WHEN n > 30 THEN 'add a second word' WHEN n = 1 THEN 'drop a word' ELSE 'fine' END AS advice FROM (SELECT split_part(file, '/', 2) AS package, count(*) AS n FROM ({SCORED}) AS h GROUP BY 1) AS p")
sql("confidence_warnings", "symbols", "SELECT 'ambiguous_term' AS warning, token AS subject FROM (SELECT split_part(split_part(qname, '.', 3), '_', 1) AS token, file FROM symbols) AS t GROUP BY token HAVING count(DISTINCT file) > 100 UNION ALL SELECT 'sparse_index' AS warning, language AS subject FROM symbols GROUP BY language HAVING count(*) < 100")
sql("search_cli_boosts", "symbols live", f"SELECT h.qname, round(h.score + CASE WHEN l.owned = 1 THEN 5.0@D ELSE 0.0@D END + CASE WHEN l.inv = 1 THEN 1.5@D ELSE 0.0@D END, 6) AS score FROM ({SCORED}) AS h LEFT JOIN (SELECT symbol_id, max(CASE WHEN kind = 'ownership' THEN 1 ELSE 0 END) AS owned, max(CASE WHEN kind = 'invariant' THEN 1 ELSE 0 END) AS inv FROM live GROUP BY symbol_id) l ON l.symbol_id = h.symbol_id")


def _holding(spark, sf_dir: str, text: str) -> DataFrame:
    """(item_id, query, doc_id): documents that contain an item's text, found by the hash of a run of its inner words.

    Items of one or two words have no inner ones: they are looked for by their longest word among the different words of all
    documents.  Only (document, key) moves; the texts are met again by the documents that a key has found.
    """
    words = lambda c: F.split(c, r"\s+")
    items = frame(spark, sf_dir, "benchmark").select("item_id", F.expr(text).alias("query")).withColumn("words", words("query"))
    n = F.greatest(F.lit(1), F.least(F.lit(5), F.size("words") - 2))
    items = saved(items.withColumns({"n": n, "key": F.xxhash64(F.concat_ws(" ", F.slice("words", F.lit(2), n))), "short": F.size("words") < 3}), "items")
    long = items.where("NOT short")
    sizes = sorted(r[0] for r in long.select("n").distinct().collect())  # at most 5
    docs = frame(spark, sf_dir, "documents").select("doc_id", "text")
    run = lambda w, k: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.xxhash64(F.concat_ws(" ", F.slice(w, i, F.lit(k)))))
    runs = F.transform(F.array(words("text")), lambda w: F.array_distinct(F.concat(*(run(w, k) for k in sizes))))[0] if sizes else F.array().cast("array<bigint>")
    found = docs.select("doc_id", F.explode(runs).alias("key")).join(long.select("key", "item_id"), "key").select("doc_id", "item_id")
    if not (short := items.where("short")).isEmpty():
        longest = F.element_at(F.array_sort(F.transform("words", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]
        short = short.select("item_id", longest.alias("needle"))
        every = docs.select("doc_id", F.explode(F.array_distinct(words("text"))).alias("hay"))
        pairs = contained(short.select("needle"), every.select("hay")).join(short, "needle")
        found = found.unionByName(every.join(pairs, "hay").select("doc_id", "item_id"))
    found = saved(found.distinct(), "found").join(items.select("item_id", "query").distinct(), "item_id")
    return docs.join(found, "doc_id").where(F.contains("text", F.col("query"))).select("item_id", "query", "doc_id")


@query("golden_probe", "SELECT b.item_id, count(*) AS n_docs, min(d.doc_id) AS first_doc FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def golden_probe(spark, sf_dir):
    return _holding(spark, sf_dir, "text").groupBy("item_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))

placed("probe_rank_lte", "symbols", f"SELECT qname, score FROM ({SCORED}) AS h", "score DESC, qname", "qname LIKE '%red_ring%'")
sql("edit_precision", "lineitem", "SELECT l_orderkey, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 0.0@D ELSE tp * 1.0@D / (tp + fp) END, 3) AS prec, round(CASE WHEN tp + fn = 0 THEN 0.0@D ELSE tp * 1.0@D / (tp + fn) END, 3) AS recall FROM (SELECT l_orderkey, count(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 1 END) AS tp, count(CASE WHEN l_returnflag = 'A' AND l_linestatus <> 'F' THEN 1 END) AS fp, count(CASE WHEN l_returnflag <> 'A' AND l_linestatus = 'F' THEN 1 END) AS fn FROM lineitem GROUP BY l_orderkey) AS t")
sql("verify_window", "events", "SELECT a.event_id, count(b.event_id) AS n_near FROM events a LEFT JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view') b ON b.user_id = a.user_id AND b.ts BETWEEN a.ts - INTERVAL 10 SECOND AND a.ts + INTERVAL 10 SECOND WHERE a.event_type = 'error' GROUP BY a.event_id")
SESSION = "SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS opens FROM events"
sql("debounce_watch", "events", f"SELECT user_id, session, count(*) AS n, max(ts) AS last_ts FROM (SELECT user_id, ts, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session FROM ({SESSION}) AS s) AS t GROUP BY user_id, session")
CHECKS = "SELECT b.item_id, b.text AS query, min(d.doc_id) AS expected, count(d.doc_id) AS n FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id, b.text"


def _checks(spark, sf_dir):
    found = _holding(spark, sf_dir, "text").groupBy("item_id").agg(F.min("doc_id").alias("expected"), F.count("*").alias("hits"))
    items = frame(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    return items.join(found, "item_id", "left").select("item_id", "query", "expected", F.coalesce("hits", F.lit(0)).alias("n"))


@query("probe_bootstrap", f"SELECT item_id, query, expected FROM ({CHECKS}) AS c WHERE n > 0")
def probe_bootstrap(spark, sf_dir):
    return _checks(spark, sf_dir).where("n > 0").select("item_id", "query", "expected")


@query("probe_assert", f"SELECT item_id, n >= 1 AS present, n <= 5 AS few FROM ({CHECKS}) AS c")
def probe_assert(spark, sf_dir):
    return _checks(spark, sf_dir).selectExpr("item_id", "n >= 1 AS present", "n <= 5 AS few")


@query("probe_run", f"SELECT count(*) AS n_checks, count(CASE WHEN n >= 1 THEN 1 END) AS n_passed FROM ({CHECKS}) AS c")
def probe_run(spark, sf_dir):
    return _checks(spark, sf_dir).selectExpr("count(*) AS n_checks", "count(CASE WHEN n >= 1 THEN 1 END) AS n_passed")
