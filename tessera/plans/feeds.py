"""Streams and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..registry import query
from ..shared import shared_dir
from ..shipping import ship
from ..sources.crosswalk import frame, run_sql, with_ctes
from ..streaming import feeds, polls
from .base import sql


@query("trace_fold_stream", "SELECT user_id, count(CASE WHEN value > 40 THEN 1 END) AS contradictions, count(CASE WHEN value < 10 THEN 1 END) AS confirmations FROM events GROUP BY user_id")
def trace_fold_stream(spark, sf_dir):
    return feeds.run_to_end(feeds.folded(feeds.events(spark, sf_dir)), "complete")


@query("subscribe_baseline", "SELECT event_id, event_type FROM events WHERE event_id > 500")
def subscribe_baseline(spark, sf_dir):
    return feeds.run_to_end(feeds.events(spark, sf_dir, after=500).select("event_id", "event_type"), "append")


SPAN_MS = 3 * 86_400_000
# DuckDB: polls that have ended by the last commit
POLLED = f"""WITH c AS (SELECT *, epoch_ms(committed_at) // {SPAN_MS} AS poll FROM commits), n AS (SELECT source, poll, count(*) AS n FROM c GROUP BY source, poll HAVING (poll + 1) * {SPAN_MS} <= (SELECT max(epoch_ms(committed_at)) FROM commits))
SELECT c.source, c.poll, c.kind, c.commit_id, c.summary FROM c JOIN n ON n.source = c.source AND n.poll = c.poll WHERE n.n <= {polls.LIMIT} AND c.kind NOT IN ('index', 'paired')
UNION ALL SELECT c.source, c.poll, 'index_run' AS kind, NULL AS commit_id, concat(coalesce(arg_max(c.summary, c.commit_id) FILTER (c.informative), arg_min(c.summary, c.commit_id)), ' (', count(*), ' commits)') AS summary
  FROM c JOIN n ON n.source = c.source AND n.poll = c.poll WHERE n.n <= {polls.LIMIT} AND c.kind = 'index' GROUP BY c.source, c.poll
UNION ALL SELECT source, poll, 'resync' AS kind, NULL AS commit_id, 'more than {polls.LIMIT} commits since last poll' AS summary FROM n WHERE n > {polls.LIMIT}"""


@query("live_events", with_ctes(["commits"], POLLED))
def live_events(spark, sf_dir):
    """What each poll of each source tells, from a stream of commits."""
    ship(spark)
    commits = frame(spark, sf_dir, "commits").withColumnRenamed("committed_at", "at").withColumn("at", F.col("at").cast("timestamp"))
    path = _written(spark, commits, lambda w, p: w.parquet(p))
    with polls.provider(spark):
        return feeds.run_to_end(polls.told(spark.readStream.schema(commits.schema).parquet(path), SPAN_MS), "append")


def _written(spark, df, how):
    path = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
    how(df.write, path)
    return path


@query("sink_jsonl", with_ctes(["live"], "SELECT entry_id, kind, summary FROM live"))
def sink_jsonl(spark, sf_dir):
    """Written as JSON lines, each partition sorted by id, and read back."""
    own = frame(spark, sf_dir, "live").select("entry_id", "kind", "summary").repartitionByRange("entry_id").sortWithinPartitions("entry_id")
    return spark.read.schema(own.schema).json(_written(spark, own, lambda w, p: w.json(p)))


@query("sidecar_sync", with_ctes(["symbols"], "SELECT language, count(*) AS n FROM symbols GROUP BY language"))
def sidecar_sync(spark, sf_dir):
    path = _written(spark, frame(spark, sf_dir, "symbols").select("language", "symbol_id", "qname"), lambda w, p: w.partitionBy("language").json(p))
    return spark.read.schema("symbol_id string, qname string, language string").json(path).groupBy("language").agg(F.count("*").alias("n"))


@query("cache_sync_symbols", with_ctes(["symbols"], "SELECT symbol_id, language FROM symbols "))
def cache_sync_symbols(spark, sf_dir):
    """A partition is replaced as a whole: the second write leaves the other languages alone."""
    own = frame(spark, sf_dir, "symbols").select("symbol_id", "language")
    path = _written(spark, own, lambda w, p: w.partitionBy("language").parquet(p))
    own.where("language = 'python'").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("language").parquet(path)
    return spark.read.parquet(path).select("symbol_id", "language")


@query("import_all", with_ctes(["live"], "SELECT kind AS class, count(*) AS n FROM live GROUP BY kind"))
def import_all(spark, sf_dir):
    path = _written(spark, frame(spark, sf_dir, "live").select(F.col("kind").alias("class"), "entry_id"), lambda w, p: w.partitionBy("class").json(p))
    return spark.read.schema("entry_id string, class string").json(path).groupBy("class").agg(F.count("*").alias("n"))


@query("read_jsonl_audit", with_ctes(["audit"], "SELECT seq, event_type, actor_id, outcome FROM audit"))
def read_jsonl_audit(spark, sf_dir):
    """An audit file of JSON lines, read back: blank lines are passed over, a malformed one fails the read."""
    own = frame(spark, sf_dir, "audit").select("seq", "event_type", "actor_id", "outcome")
    lines = own.select(F.explode(F.when(F.col("seq") % 50 == 3, F.array(F.lit(" "), F.to_json(F.struct("*")))).otherwise(F.array(F.to_json(F.struct("*"))))).alias("value"))
    text = spark.read.text(_written(spark, lines, lambda w, p: w.text(p))).where(F.trim("value") != "")
    return text.select(F.from_json("value", own.schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


CONCLUSIONS = "SELECT l.kind, l.entry_id, l.seq, coalesce(s.qname, concat('gone.', l.symbol_id)) AS qname FROM ledger l LEFT JOIN symbols s ON s.symbol_id = l.symbol_id"


@query("read_jsonl_conclusions", with_ctes(["ledger", "symbols"], f"SELECT kind AS class, count(*) AS n_read, count(CASE WHEN NOT bad AND qname NOT LIKE 'gone.%' THEN 1 END) AS imported, count(CASE WHEN NOT bad AND qname LIKE 'gone.%' THEN 1 END) AS skipped_unknown, count(CASE WHEN bad THEN 1 END) AS skipped_parse FROM (SELECT *, seq % 97 = 5 AS bad FROM ({CONCLUSIONS}) AS c) AS l GROUP BY kind"))
def read_jsonl_conclusions(spark, sf_dir):
    """Files of JSON lines, one for each class, read back: malformed lines and unknown names are counted and left out."""
    own = run_sql(spark, sf_dir, ["ledger", "symbols"], CONCLUSIONS)
    record = F.to_json(F.struct("entry_id", "qname"))
    lines = own.select("kind", F.when(F.col("seq") % 97 == 5, F.substring(record, 1, 15)).otherwise(record).alias("value"))
    text = spark.read.schema("value string, kind string").text(_written(spark, lines, lambda w, p: w.partitionBy("kind").text(p))).where(F.trim("value") != "")
    parsed = text.select("kind", F.from_json("value", "entry_id string, qname string, bad string", {"columnNameOfCorruptRecord": "bad"}).alias("r"))
    known = frame(spark, sf_dir, "symbols").select("qname", F.lit(True).alias("known"))
    bad = F.col("r.bad").isNotNull()
    joined = parsed.select("kind", bad.alias("bad"), F.col("r.qname").alias("qname")).join(known, "qname", "left")
    return joined.groupBy(F.col("kind").alias("class")).agg(F.count("*").alias("n_read"), F.count_if(~F.col("bad") & F.col("known").isNotNull()).alias("imported"), F.count_if(~F.col("bad") & F.col("known").isNull()).alias("skipped_unknown"), F.count_if("bad").alias("skipped_parse"))


# orders are commits, their items the symbols that they touch; a pending order is not committed yet
TOUCHED = "SELECT DISTINCT s.file FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN symbols s ON s.part = l.l_partkey WHERE"
sql("registry_prune", "symbols lineitem", "SELECT r.file FROM (SELECT DISTINCT file FROM symbols) AS r LEFT JOIN (SELECT DISTINCT s.file FROM symbols s JOIN lineitem l ON l.l_partkey = s.part WHERE l.l_linestatus = 'O' AND l.l_quantity > 48) AS d ON d.file = r.file WHERE d.file IS NULL")
sql("git_changed_files", "orders lineitem symbols", f"{TOUCHED} o.o_orderdate >= DATE '2001-06-01'")
sql("git_dirty", "orders lineitem symbols", f"{TOUCHED} o.o_orderstatus = 'P'")
FIRST = "SELECT symbol_id, entry_id, row_number() OVER (PARTITION BY symbol_id ORDER BY entry_id) AS r, count(*) OVER (PARTITION BY symbol_id) AS n FROM live"
sql("trim_for_agent", "live", f"SELECT symbol_id, concat(array_join(array_sort(collect_list(entry_id)), ','), CASE WHEN max(n) > 3 THEN concat(',... ', max(n) - 3, ' more') ELSE '' END) AS entries FROM ({FIRST}) AS f WHERE r <= 3 GROUP BY symbol_id",
    f"SELECT symbol_id, concat(string_agg(entry_id, ',' ORDER BY entry_id), CASE WHEN max(n) > 3 THEN concat(',... ', max(n) - 3, ' more') ELSE '' END) AS entries FROM ({FIRST}) AS f WHERE r <= 3 GROUP BY symbol_id")
sql("drop_empty", "symbols", "SELECT symbol_id, concat(CASE WHEN doc IS NULL THEN '' ELSE 'doc ' END, CASE WHEN signature = '' THEN '' ELSE 'signature ' END) AS members FROM symbols")
sql("brief_search", "symbols", "SELECT qname, concat(file, ':', start_line) AS at, signature FROM symbols WHERE qname LIKE '%widget%'")
sql("brief_impact_family", "symbols edges", "SELECT s.qname, count(e.src) AS n_callers FROM symbols s JOIN edges e ON e.dst = s.symbol_id GROUP BY s.qname")
sql("deterministic_first", "live", "SELECT symbol_id, min(entry_id) AS first_entry FROM live GROUP BY symbol_id")
sql("grouping_sets", "symbols", "SELECT coalesce(language, '*') AS language, coalesce(kind, '*') AS kind, count(*) AS n FROM symbols GROUP BY GROUPING SETS ((language, kind), (language), ())")
sql("lag_lead_sql", "ledger", "SELECT entry_id, lag(entry_id) OVER (PARTITION BY symbol_id ORDER BY seq) AS before, lead(entry_id) OVER (PARTITION BY symbol_id ORDER BY seq) AS after FROM ledger")
sql("sidecar_lint", "symbols", "SELECT DISTINCT file, 'unknown extension' AS issue FROM symbols WHERE file NOT LIKE '%.py' AND file NOT LIKE '%.ts'")
sql("ownership_signal", "orders", "SELECT file, author FROM (SELECT o_custkey AS file, o_orderpriority AS author, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY o_custkey, o_orderpriority) AS t WHERE r = 1")
sql("doc_and_symbol", "symbols docs", "SELECT 'symbol' AS what, count(*) AS n FROM symbols WHERE qname LIKE '%ring%' UNION ALL SELECT 'doc' AS what, count(*) AS n FROM docs WHERE lower(body) LIKE '%ring%'")
