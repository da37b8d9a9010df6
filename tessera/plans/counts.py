"""Scans, look-ups, counts and metrics over the logical tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pairs
from ..registry import query
from ..sources.crosswalk import NOW, frame, with_ctes
from .base import placed, sql

CLASS = """CASE WHEN kind IN ('decision', 'assumption', 'constraint', 'rationale', 'tradeoff', 'invariant') THEN 'decisions'
 WHEN kind IN ('ownership', 'concept') THEN 'classifications' WHEN kind = 'mapping' THEN 'mappings' WHEN kind IN ('hazard', 'known_bug') THEN 'hazards'
 WHEN kind IN ('validation_scenario', 'proof') THEN 'recipes' WHEN kind = 'follow_up' THEN 'followups' ELSE 'thinking' END"""
THINKING = "('hypothesis', 'mental_model', 'failed_attempt', 'open_question')"
DIRECTORY = "@GROUP(file, '^(.*)/[^/]*$')"

sql("scan_id_map", "symbols", "SELECT symbol_id, qname, file FROM symbols")
# a symbol's callees and its callers, each as a list in order
sql("scan_edge_maps", "edges", "SELECT 'callees' AS direction, src AS node, array_join(array_sort(collect_set(dst)), ',') AS others FROM edges GROUP BY src UNION ALL SELECT 'callers' AS direction, dst AS node, array_join(array_sort(collect_set(src)), ',') AS others FROM edges GROUP BY dst",
    "SELECT 'callees' AS direction, src AS node, string_agg(DISTINCT dst, ',' ORDER BY dst) AS others FROM edges GROUP BY src UNION ALL SELECT 'callers' AS direction, dst AS node, string_agg(DISTINCT src, ',' ORDER BY src) AS others FROM edges GROUP BY dst")
sql("cache_sync_edges", "edges", "SELECT src AS symbol_id, dst AS neighbor_id, 'callee' AS direction FROM edges UNION ALL SELECT dst AS symbol_id, src AS neighbor_id, 'caller' AS direction FROM edges")
sql("point_lookup", "symbols", "SELECT symbol_id, qname, kind, file, start_line FROM symbols WHERE qname = 'economy.Brand2.small_ring_0'")
sql("neighbors_lookup", "edges", "SELECT src, dst FROM edges WHERE src IN ('sym_1', 'sym_5', 'sym_10', 'sym_25', 'sym_100')")
sql("files_for_qnames", "symbols edges", "SELECT qname, file FROM symbols WHERE symbol_id IN (SELECT dst FROM edges)")
sql("meta_bulk", "symbols edges", "SELECT qname, symbol_id, file, kind FROM symbols WHERE symbol_id IN (SELECT src FROM edges)")
sql("resolve_bulk", "symbols", "SELECT w.qname, s.symbol_id, s.file, s.language FROM (SELECT concat(qname, CASE WHEN part % 2 = 0 THEN '' ELSE 'x' END) AS qname FROM symbols) AS w JOIN symbols s ON s.qname = w.qname")
sql("resolve_ids_bulk", "symbols ledger", "SELECT DISTINCT l.symbol_id, s.qname, s.file FROM ledger l JOIN symbols s ON s.symbol_id = l.symbol_id")
placed("feedback_scan", "feedback", "SELECT entry_id, symbol_id, query, verdict, created_at FROM feedback", "created_at DESC, entry_id")
placed("ledger_scan_symbol", "ledger", "SELECT entry_id, kind, summary, created_at AS _at FROM ledger WHERE symbol_id = 'sym_100'", "_at DESC, entry_id")
sql("effects_scan", "effects", "SELECT symbol_id, effect FROM effects")
placed("list_symbols", "symbols", "SELECT qname, kind, file FROM symbols WHERE language = 'python' AND kind = 'function' AND file LIKE '%economy%'", "qname")
placed("list_ledger", "ledger", "SELECT entry_id, kind, created_at FROM ledger WHERE kind = 'hazard'", "created_at DESC, entry_id")
sql("feedback_export", "feedback", "SELECT verdict, count(*) AS n, count(DISTINCT symbol_id) AS n_symbols FROM feedback GROUP BY verdict")
sql("feedback_import", "feedback symbols", "SELECT count(*) AS n_read, count(s.symbol_id) AS imported, count(*) - count(s.symbol_id) AS skipped_unknown FROM feedback f LEFT JOIN symbols s ON s.symbol_id = f.symbol_id")
# an entry that supersedes another is written under its name too: the last write of a name wins
sql("upsert_ledger", "ledger", "SELECT entry_id, symbol_id, kind, summary FROM (SELECT entry_id, symbol_id, kind, summary, row_number() OVER (PARTITION BY entry_id ORDER BY seq DESC) AS r FROM (SELECT entry_id, symbol_id, kind, summary, seq FROM ledger UNION ALL SELECT supersedes AS entry_id, symbol_id, kind, summary, seq FROM ledger WHERE supersedes IS NOT NULL) AS w) AS t WHERE r = 1")
# runs that the store has already, here those whose effects the ledger holds under a later entry, aren't loaded again
sql("analytics_reload", "events ledger", "SELECT e.event_id, e.event_type FROM events e LEFT JOIN (SELECT DISTINCT supersedes FROM ledger WHERE supersedes IS NOT NULL) x ON x.supersedes = concat('e', e.event_id) WHERE x.supersedes IS NULL")
sql("export_by_class", "live symbols", f"SELECT {CLASS} AS class, l.entry_id, s.qname FROM live l JOIN (SELECT symbol_id, qname FROM symbols) s ON s.symbol_id = l.symbol_id WHERE NOT (l.kind = 'hypothesis' AND l.confidence < 0.3@D)")
sql("export_by_package", "live symbols", f"SELECT {CLASS} AS class, CASE WHEN {DIRECTORY} = '' THEN '_root' ELSE replace({DIRECTORY}, '/', '--') END AS package, count(*) AS n FROM live l JOIN (SELECT symbol_id, file FROM symbols) s ON s.symbol_id = l.symbol_id GROUP BY 1, 2")
sql("shard_key", "symbols", f"SELECT DISTINCT {DIRECTORY} AS dir, CASE WHEN {DIRECTORY} = '' THEN '_root' ELSE replace({DIRECTORY}, '/', '--') END AS shard FROM symbols")
# Bytes a shard and all shards together may take.
PER_SHARD, TOTAL = 204800, 1048576
SHARDS = f"SELECT {CLASS} AS shard, CAST(sum(OCTETS + 1) AS BIGINT) AS bytes FROM ledger GROUP BY 1"
BUDGET = f"SELECT shard, bytes, bytes > {PER_SHARD} AS over_budget FROM ({SHARDS}) AS s UNION ALL SELECT '*' AS shard, CAST(sum(bytes) AS BIGINT) AS bytes, sum(bytes) > {TOTAL} OR max(bytes) > {PER_SHARD} AS over_budget FROM ({SHARDS}) AS s"
LINE = "concat(entry_id, symbol_id, kind, summary, body, author)"
sql("check_budget", "ledger", BUDGET.replace("OCTETS", f"octet_length({LINE})"), BUDGET.replace("OCTETS", f"strlen({LINE})"))
sql("sidecar_prune", "ledger symbols", "SELECT DISTINCT symbol_id FROM ledger WHERE symbol_id NOT IN (SELECT symbol_id FROM symbols)")
# entries of symbols that moved are bound to where they went, those of unknown symbols wait
sql("hydrate_verify", "ledger live", "SELECT coalesce(a.entry_id, b.entry_id) AS entry_id, CASE WHEN b.entry_id IS NULL THEN 'missing' WHEN a.entry_id IS NULL THEN 'extra' ELSE 'differs' END AS problem FROM ledger a FULL OUTER JOIN (SELECT entry_id, CASE WHEN seq % 90 = 0 THEN 'changed' ELSE summary END AS summary FROM live) b ON a.entry_id = b.entry_id WHERE a.entry_id IS NULL OR b.entry_id IS NULL OR a.summary <> b.summary")
sql("count_rows", "symbols", "SELECT count(*) AS n FROM symbols")
sql("annotated_count", "live", "SELECT count(DISTINCT symbol_id) AS n FROM live")
sql("top_counts", "symbols", f"SELECT dim, name, n, row_number() OVER (PARTITION BY dim ORDER BY n DESC, name) AS place FROM (SELECT 'language' AS dim, language AS name, count(*) AS n FROM symbols GROUP BY language UNION ALL SELECT 'package' AS dim, {DIRECTORY} AS name, count(*) AS n FROM symbols GROUP BY 2) AS t")
sql("list_stats", "symbols effects", "SELECT 'language' AS dim, language AS name, count(*) AS n FROM symbols GROUP BY language UNION ALL SELECT 'kind' AS dim, kind AS name, count(*) AS n FROM symbols GROUP BY kind UNION ALL SELECT 'effect' AS dim, effect AS name, count(*) AS n FROM effects GROUP BY effect UNION ALL SELECT 'files' AS dim, '' AS name, count(DISTINCT file) AS n FROM symbols")
sql("degree", "adjacent", "SELECT node AS symbol_id, count(*) AS degree FROM adjacent GROUP BY node")
sql("hotspots", "adjacent", "SELECT symbol_id, degree, place FROM (SELECT node AS symbol_id, count(*) AS degree, row_number() OVER (ORDER BY count(*) DESC, node) AS place FROM adjacent GROUP BY node) AS t WHERE place <= 20")
sql("modal_value", "symbols", f"SELECT language, package, n FROM (SELECT language, {DIRECTORY} AS package, count(*) AS n, row_number() OVER (PARTITION BY language ORDER BY count(*) DESC, {DIRECTORY}) AS r FROM symbols GROUP BY language, {DIRECTORY}) AS t WHERE r = 1")
CALIB = "SELECT CASE user_id % 9 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'critical' WHEN 4 THEN 'core' WHEN 5 THEN 'partial' WHEN 6 THEN 'weak' WHEN 7 THEN 'noisy' ELSE 'other' END AS bucket, value < 15 AS passed FROM events"
EXPECTED = "CASE bucket WHEN 'low' THEN 0.95@D WHEN 'medium' THEN 0.7@D WHEN 'high' THEN 0.45@D WHEN 'critical' THEN 0.2@D WHEN 'core' THEN 0.9@D WHEN 'strong' THEN 0.9@D WHEN 'relevant' THEN 0.9@D WHEN 'partial' THEN 0.65@D WHEN 'peripheral' THEN 0.65@D WHEN 'weak' THEN 0.25@D WHEN 'noisy' THEN 0.25@D END"
RATES = f"SELECT bucket, count(*) AS n, CAST(sum(CASE WHEN passed THEN 1 ELSE 0 END) AS BIGINT) AS n_passed, round(avg(CASE WHEN passed THEN 1.0@D ELSE 0.0@D END), 4) AS rate FROM ({CALIB}) AS c GROUP BY bucket"
sql("calibration", "events", RATES)
sql("calibration_advice", "events", f"SELECT bucket, n, rate, CASE WHEN n < 5 THEN 'sample-too-small' WHEN {EXPECTED} IS NULL THEN 'unknown-label' WHEN rate - {EXPECTED} > 0.15@D THEN 'exceeds' WHEN rate - {EXPECTED} < -0.15@D THEN 'trails' ELSE 'well-calibrated' END AS advice FROM ({RATES}) AS r")
sql("calibration_signal", "events", "SELECT event_id, coalesce(@JSON(props, level), CASE WHEN CAST(@JSON(props, k) AS INT) < 50 THEN 'low' ELSE 'high' END) AS bucket FROM events")
DENSITY = "SELECT (SELECT count(*) FROM symbols) AS n_symbols, (SELECT count(*) FROM live) AS n_entries, (SELECT count(DISTINCT symbol_id) FROM live WHERE kind = 'ownership' AND symbol_id NOT IN (SELECT symbol_id FROM live WHERE kind = 'concept')) AS gaps"
sql("ledger_density", "symbols live", f"SELECT round(n_entries * 1.0@D / n_symbols, 6) AS density, gaps FROM ({DENSITY}) AS d")
TRUST = "least(1.0@D, greatest(0.0@D, 1.0@D - CASE WHEN age_h < 0 THEN 0.1@D WHEN age_h < 1 THEN 0.0@D WHEN age_h < 24 THEN 0.15@D ELSE 0.3@D END - 0.1@D - CASE WHEN dirty > 0 THEN 0.05@D ELSE 0.0@D END - CASE WHEN density < 0.05@D THEN 0.15@D WHEN density < 0.5@D THEN 0.05@D ELSE 0.0@D END - CASE WHEN gaps > 0.1@D * n_symbols THEN 0.05@D ELSE 0.0@D END))"
SIGNALS = f"SELECT source, n_symbols, age_h, dirty, density, gaps, round({TRUST}, 2) AS score FROM (SELECT source, count(*) AS n_symbols, CAST(min(doc_id) % 30 AS INT) AS age_h, CAST(sum(CASE WHEN doc_id % 97 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS dirty, avg(CASE WHEN doc_id % 5 < 2 THEN 1.0@D ELSE 0.0@D END) AS density, CAST(sum(CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS gaps FROM documents GROUP BY source) AS s"
sql("trust_inputs", "documents", f"SELECT source, n_symbols, age_h, dirty, round(density, 6) AS density, gaps FROM ({SIGNALS}) AS t")
sql("trust_score", "documents", f"SELECT source, score, CASE WHEN n_symbols = 0 OR score < 0.4@D THEN 'blocked' WHEN score >= 0.85@D THEN 'high' WHEN score >= 0.65@D THEN 'medium' ELSE 'low' END AS level FROM ({SIGNALS}) AS t")
sql("data_quality", "documents", "SELECT source, CASE WHEN n = 0 THEN 'empty' WHEN density = 0 AND active = 0 THEN 'clean_room' WHEN density = 0 THEN 'unannotated' WHEN density < 0.05@D THEN 'degraded' WHEN density < 0.5@D THEN 'sparse_but_active' ELSE 'populated' END AS state FROM (SELECT source, count(*) AS n, avg(CASE WHEN doc_id % 11 = 0 THEN 1.0@D ELSE 0.0@D END) AS density, max(doc_id % 2) AS active FROM documents GROUP BY source) AS d")
sql("index_consistency", "ledger live", "SELECT a.n AS in_store, b.n AS in_cache, a.n - b.n AS delta, CASE WHEN a.n = b.n THEN 'consistent' ELSE 'run index again' END AS advice FROM (SELECT count(*) AS n FROM ledger) AS a CROSS JOIN (SELECT count(*) AS n FROM live) AS b")
sql("evidence_quality", "live", "SELECT symbol_id, round((max(CASE WHEN kind = 'invariant' THEN 1 ELSE 0 END) + max(CASE WHEN kind = 'hazard' THEN 1 ELSE 0 END) + max(CASE WHEN kind = 'proof' THEN 1 ELSE 0 END) + max(CASE WHEN kind = 'ownership' THEN 1 ELSE 0 END) + max(CASE WHEN kind = 'concept' THEN 1 ELSE 0 END) + max(CASE WHEN kind = 'decision' THEN 1 ELSE 0 END)) / 6.0@D, 2) AS quality FROM live GROUP BY symbol_id")
sql("workflow_type", "live", "SELECT symbol_id, CASE WHEN planned = 1 AND proven = 1 THEN 'planned-verified' WHEN planned = 1 THEN 'planned' WHEN proven = 1 THEN 'verified' ELSE 'ad-hoc' END AS workflow FROM (SELECT symbol_id, max(CASE WHEN kind = 'decision' THEN 1 ELSE 0 END) AS planned, max(CASE WHEN kind = 'proof' THEN 1 ELSE 0 END) AS proven FROM live GROUP BY symbol_id) AS w")
sql("scorecard", "live symbols", "SELECT round(least(100.0@D, 100.0@D * count(DISTINCT l.symbol_id) / max(n)), 2) AS coverage, round(100.0@D * avg(CASE WHEN kind = 'proof' THEN 1.0@D ELSE 0.0@D END), 2) AS proof, round(100.0@D * avg(confidence), 2) AS confidence FROM live l CROSS JOIN (SELECT count(*) AS n FROM symbols) AS s")
sql("thinking_summary", "live", f"SELECT kind, CAST(sum(CASE WHEN confidence >= 0.3@D THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN confidence < 0.3@D THEN 1 ELSE 0 END) AS BIGINT) AS dropped FROM live WHERE kind IN {THINKING} AND symbol_id IN ('sym_20', 'sym_40', 'sym_60', 'sym_80') GROUP BY kind")
sql("thinking_all", "live", f"SELECT symbol_id, kind, CAST(sum(CASE WHEN confidence >= 0.3@D THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN confidence < 0.3@D THEN 1 ELSE 0 END) AS BIGINT) AS dropped FROM live WHERE kind IN {THINKING} GROUP BY symbol_id, kind")
sql("workspace_thinking", "live", f"SELECT count(*) AS n FROM live WHERE kind IN {THINKING}")
sql("inheritance_counts", "live", "SELECT author = 'agent1' AS mine, symbol_id, count(CASE WHEN kind = 'mental_model' THEN 1 END) AS models, count(CASE WHEN kind = 'hypothesis' THEN 1 END) AS hypotheses, count(CASE WHEN kind = 'mental_model' THEN 1 END) >= 1 OR count(CASE WHEN kind = 'hypothesis' THEN 1 END) >= 3 AS inherits FROM live GROUP BY 1, 2")
sql("all_symbol_entries", "live symbols", "SELECT s.qname, l.entry_id, row_number() OVER (PARTITION BY s.qname ORDER BY l.created_at DESC, l.entry_id) AS place FROM live l JOIN symbols s ON s.symbol_id = l.symbol_id")
sql("feedback_breakdown", "feedback", "SELECT symbol_id, count(CASE WHEN verdict = 'useful' THEN 1 END) AS useful, count(CASE WHEN verdict = 'noisy' THEN 1 END) AS noisy, count(CASE WHEN verdict = 'missing' THEN 1 END) AS missing, count(CASE WHEN verdict = 'wrong-layer' THEN 1 END) AS wrong_layer FROM feedback GROUP BY symbol_id")
WORDS = "SELECT symbol_id, entry_id, split_part(query, ' ', 1) AS token FROM feedback WHERE verdict IN ('noisy', 'wrong-layer') UNION ALL SELECT symbol_id, entry_id, split_part(query, ' ', 2) AS token FROM feedback WHERE verdict IN ('noisy', 'wrong-layer')"
sql("recurring_fp", "feedback", f"SELECT symbol_id, token, count(DISTINCT entry_id) AS n FROM ({WORDS}) AS w GROUP BY symbol_id, token HAVING count(DISTINCT entry_id) >= 2")
sql("beta_confidence", "events", "SELECT user_id, n_yes, n_no, round((0.5@D * 2 + n_yes) / (2.0@D + n_yes + n_no), 6) AS confidence FROM (SELECT user_id, count(CASE WHEN value < 10 THEN 1 END) AS n_yes, count(CASE WHEN value > 40 THEN 1 END) AS n_no FROM events GROUP BY user_id) AS t")
# a contradiction goes before a confirmation; the first observation that is neither neutral freezes the prior
OUTCOME = "CASE WHEN value > 40 THEN 'contradiction' WHEN value < 10 THEN 'confirmation' ELSE 'neutral' END"
sql("trace_fold", "events", f"SELECT user_id, count(CASE WHEN outcome = 'contradiction' THEN 1 END) AS contradictions, count(CASE WHEN outcome = 'confirmation' THEN 1 END) AS confirmations, count(CASE WHEN outcome = 'neutral' THEN 1 END) AS neutral, min(CASE WHEN outcome <> 'neutral' THEN event_id END) AS first_observed, max(event_id) AS last_trace, min_by(round(value / 100.0@D, 6), CASE WHEN outcome <> 'neutral' THEN event_id END) AS prior FROM (SELECT user_id, event_id, value, {OUTCOME} AS outcome FROM events) AS o GROUP BY user_id")
# a static edge that was observed is raised to 0.7 at least, others keep what they had
sql("edge_confirm", "edges events", "SELECT src, dst, confirmations, last_seen, round(CASE WHEN confirmations > 0 AND source = 'static' THEN greatest(prior, 0.7@D) ELSE prior END, 6) AS prior FROM (SELECT e.src, e.dst, CASE WHEN length(e.dst) % 2 = 0 THEN 'static' ELSE 'runtime' END AS source, 0.4@D + 0.1@D * (length(e.src) % 5) AS prior, count(v.event_id) AS confirmations, max(v.ts) AS last_seen FROM edges e LEFT JOIN (SELECT event_id, ts, concat('sym_', user_id) AS s FROM events WHERE event_type = 'view') v ON v.s = e.src GROUP BY e.src, e.dst) AS c")
# observed calls are the pairs of events of a user that follow each other; those that no static edge has are listed apart
OBSERVED = "SELECT src, dst, count(*) AS n FROM (SELECT concat('sym_', user_id) AS src, concat('sym_', event_id % 50) AS dst FROM events) AS v GROUP BY src, dst"
sql("edge_evidence_left_join", "edges events", f"SELECT e.src, e.dst, coalesce(v.n, 0) AS confirmations, 'static' AS source FROM edges e LEFT JOIN ({OBSERVED}) v ON v.src = e.src AND v.dst = e.dst UNION ALL SELECT v.src, v.dst, v.n AS confirmations, 'runtime-only' AS source FROM ({OBSERVED}) v LEFT JOIN edges e ON e.src = v.src AND e.dst = v.dst WHERE e.src IS NULL")
sql("verify_mismatch", "effects lineitem", "SELECT coalesce(d.symbol_id, i.symbol_id) AS symbol_id, coalesce(d.effect, i.effect) AS effect, CASE WHEN i.effect IS NULL THEN 'declared-only' ELSE 'inferred-only' END AS mismatch FROM effects d FULL OUTER JOIN (SELECT DISTINCT concat('sym_', l_partkey) AS symbol_id, CASE l_linenumber % 3 WHEN 0 THEN 'fs.read' WHEN 1 THEN 'net.out' ELSE 'log' END AS effect FROM lineitem WHERE l_quantity > 48) i ON i.symbol_id = d.symbol_id AND i.effect = d.effect WHERE d.effect IS NULL OR i.effect IS NULL")
sql("set_difference", "effects", "SELECT symbol_id, effect FROM effects EXCEPT SELECT symbol_id, effect FROM effects WHERE effect = 'log'")
sql("conclusion_class", "ledger", f"SELECT kind, {CLASS} AS class, count(*) AS n FROM ledger GROUP BY 1, 2")
sql("map_ownership", "symbols", f"SELECT package, concat('own_', substring(@SHA(package), 1, 12)) AS entry_id, n FROM (SELECT {DIRECTORY} AS package, count(*) AS n FROM symbols GROUP BY 1) AS p")
sql("det_id", "ledger", "SELECT entry_id, concat('L', substring(@SHA(concat(kind, '|', symbol_id, '|', summary)), 1, 16)) AS id FROM ledger")
sql("canonical_id", "symbols", "SELECT qname, concat('sym_', substring(@SHA(concat(qname, '|', kind, '|', file)), 1, 16)) AS id FROM symbols")
sql("format_age", "events", f"SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN concat(CAST(floor(s / 60) AS BIGINT), 'm') WHEN s < 86400 THEN concat(CAST(floor(s / 3600) AS BIGINT), 'h') ELSE concat(CAST(floor(s / 86400) AS BIGINT), 'd') END AS age FROM (SELECT event_id, unix_timestamp(CAST(TIMESTAMP '2024-02-01 00:00:00' AS TIMESTAMP)) - unix_timestamp(CAST(date_trunc('second', ts) AS TIMESTAMP)) AS s FROM events) AS t",
    "SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN concat(CAST(floor(s / 60) AS BIGINT), 'm') WHEN s < 86400 THEN concat(CAST(floor(s / 3600) AS BIGINT), 'h') ELSE concat(CAST(floor(s / 86400) AS BIGINT), 'd') END AS age FROM (SELECT event_id, epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(date_trunc('second', ts)) AS s FROM events) AS t")
DAYS_S, DAYS_D = "(unix_micros(CAST(TIMESTAMP '2024-02-01 00:00:00' AS TIMESTAMP)) - unix_micros(CAST(created_at AS TIMESTAMP))) / 86400000000.0D", "(epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(created_at)) / 86400000000.0::DOUBLE"
sql("feedback_decay", "feedback", f"SELECT entry_id, round(CASE WHEN {DAYS_S} <= 0 THEN 1.0D ELSE power(0.5D, {DAYS_S} / 90.0D) END, 6) AS weight FROM feedback", f"SELECT entry_id, round(CASE WHEN {DAYS_D} <= 0 THEN 1.0 ELSE power(0.5::DOUBLE, {DAYS_D} / 90.0) END, 6) AS weight FROM feedback")
sql("decay_for_entry", "feedback", f"SELECT entry_id, round({DAYS_S}, 6) AS age_days FROM feedback", f"SELECT entry_id, round({DAYS_D}, 6) AS age_days FROM feedback")
sql("expiry", "feedback", f"SELECT entry_id, expires_at IS NOT NULL AND expires_at < {NOW} AS expired FROM feedback")
sql("ttl_parse", "events", "SELECT event_id, ttl, CASE WHEN ttl LIKE '%d' THEN CAST(replace(ttl, 'd', '') AS INT) * 24 WHEN ttl LIKE '%h' THEN CAST(replace(ttl, 'h', '') AS INT) END AS hours FROM (SELECT event_id, concat(user_id, CASE event_id % 3 WHEN 0 THEN 'd' WHEN 1 THEN 'h' ELSE 'x' END) AS ttl FROM events) AS t")
sql("json_extract", "events", "SELECT event_id, CAST(@JSON(props, k) AS BIGINT) AS k, @JSON(props, role) AS role FROM events")
sql("mapping_move_to", "ledger", "SELECT entry_id, @JSON(body, move_to) AS move_to, @JSON(body, k) AS k FROM ledger WHERE kind = 'mapping'")
sql("token_estimate", "documents", "SELECT doc_id, CAST(floor((octet_length(text) + 3) / 4) AS BIGINT) AS tokens FROM documents", "SELECT doc_id, CAST(floor((octet_length(encode(text)) + 3) / 4) AS BIGINT) AS tokens FROM documents")
# the index of a source is as old as its last event; a source without events was never rebuilt
sql("stale_severity", "customer events", f"SELECT c_custkey AS index_id, CASE WHEN e.n IS NULL THEN 'critical' WHEN e.failed THEN 'critical' WHEN e.last_ts < {NOW} - INTERVAL 40 HOUR THEN 'soft' ELSE 'none' END AS severity FROM (SELECT c_custkey FROM customer) AS c LEFT JOIN (SELECT user_id, count(*) AS n, max(ts) AS last_ts, max_by(event_type, event_id) = 'error' AS failed FROM events GROUP BY user_id) e ON e.user_id = c.c_custkey")
sql("git_log_scan", "orders", f"SELECT o_custkey AS file, max(o_orderdate) AS last_touch, max(o_orderdate) >= TIMESTAMP '2001-06-01 00:00:00' AS hot FROM orders GROUP BY o_custkey")
sql("git_recent_touches", "orders", "SELECT o_custkey AS file, o_orderkey AS touch, r AS place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) AS t WHERE r <= 3")
sql("contract_drift", "endpoints", "SELECT symbol_id, repo_id, contract FROM endpoints WHERE direction = 'outbound' AND contract NOT IN (SELECT contract FROM endpoints WHERE direction = 'inbound')")
MATCH = "SELECT o.symbol_id AS from_symbol, i.symbol_id AS to_symbol, o.contract, o.repo_id <> i.repo_id AS cross_repo, least(o.confidence, i.confidence) AS confidence FROM (SELECT * FROM endpoints WHERE direction = 'outbound') AS o JOIN (SELECT * FROM endpoints WHERE direction = 'inbound') AS i ON o.contract = i.contract"

def _matched(spark, sf_dir):
    """Each call with each endpoint of its contract: contracts are few, so calls meet their endpoints in blocks."""
    ends = frame(spark, sf_dir, "endpoints")
    calls = ends.where("direction = 'outbound'").select(F.col("symbol_id").alias("from_symbol"), "contract", F.col("repo_id").alias("o_repo"), F.col("confidence").alias("o_confidence"))
    served = ends.where("direction = 'inbound'").select(F.col("symbol_id").alias("to_symbol"), "contract", "repo_id", "confidence")
    cross = (F.col("o_repo") != F.col("repo_id")).alias("cross_repo")
    return pairs.paired(calls, served, "contract").select("from_symbol", "to_symbol", "contract", cross, F.least("o_confidence", "confidence").alias("confidence"))


query("contract_match_join", with_ctes(["endpoints"], MATCH))(_matched)
query("federated_join", with_ctes(["endpoints"], f"SELECT * FROM ({MATCH}) AS m WHERE cross_repo"))(lambda spark, sf_dir: _matched(spark, sf_dir).where("cross_repo"))
HAZARDS = "SELECT replace(symbol_id, 'sym_', 'page.') AS s, count(*) AS n FROM live WHERE kind IN ('hazard', 'invariant') GROUP BY 1"
# of the endpoints that a call meets only their being there counts
sql("federated_impact", "endpoints live", f"SELECT DISTINCT o.contract, o.symbol_id AS from_symbol, coalesce(h.n, 0) AS n_hazards FROM (SELECT * FROM endpoints WHERE direction = 'outbound') AS o LEFT SEMI JOIN (SELECT DISTINCT contract FROM endpoints WHERE direction = 'inbound') AS i ON i.contract = o.contract LEFT JOIN ({HAZARDS}) AS h ON h.s = o.symbol_id",
    f"SELECT DISTINCT m.contract, m.from_symbol, coalesce(h.n, 0) AS n_hazards FROM ({MATCH}) AS m LEFT JOIN ({HAZARDS}) AS h ON h.s = m.from_symbol")
METHOD = "CASE page_id % 4 WHEN 0 THEN ' get ' WHEN 1 THEN 'Post' WHEN 2 THEN ' PUT' ELSE 'delete' END"
sql("http_contract", "pages", f"SELECT page_id, concat('http:', upper(trim({METHOD})), ' ', coalesce(nullif(@SUB(@SUB(lower(@GROUP(url, '^https?://[^/?#]+([^?#]*)')), '/([0-9]+|[{{][^/]*[}}]|:[a-z_]+)', '/{{}}'), '/+$', ''), ''), '/')) AS contract FROM pages")
sql("normalize_http", "pages", "SELECT page_id, @SUB(@SUB(lower(@GROUP(url, '^https?://[^/?#]+([^?#]*)')), '/[0-9]+', '/{}'), '/+$', '') AS path FROM pages")
sql("pubsub_contract", "events", "SELECT DISTINCT concat('topic:', lower(trim(concat('  ', upper(event_type), ' ')))) AS topic FROM events")
sql("normalize_repo", "pages", "SELECT page_id, lower(@SUB(@SUB(concat('git@', @GROUP(url, '^https?://([^/?#]+)'), ':team/repo', page_id, '.git'), '^[a-z]+@([^:]+):', '@1/'), '[.]git$', '')) AS repo FROM pages".replace("@1", "$1"), "SELECT page_id, lower(@SUB(@SUB(concat('git@', @GROUP(url, '^https?://([^/?#]+)'), ':team/repo', page_id, '.git'), '^[a-z]+@([^:]+):', '\\1/'), '[.]git$', '')) AS repo FROM pages")
sql("url_host", "pages", "SELECT page_id, @GROUP(url, '^https?://([^/?#]+)') AS host FROM pages")
sql("judgment_for", "live symbols", "SELECT s.qname, count(CASE WHEN l.kind = 'invariant' THEN 1 END) AS invariants, count(CASE WHEN l.kind = 'hazard' THEN 1 END) AS hazards FROM symbols s LEFT JOIN live l ON l.symbol_id = s.symbol_id GROUP BY s.qname")
