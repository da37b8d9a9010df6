"""Appends that can be replayed: a ledger and its audit log, written by batches behind a policy gate.

A proposal (entry_id, symbol_id, kind, summary, action, actor) is decided by the first rule that fits.  Identifiers follow from
the content, so a batch that comes again finds its rows in the log and adds nothing; the log is written last, and a batch
that broke off before is finished by its replay.  Log records are numbered on from those stored and each names the hash of
the one before, handed from range to range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import saved
from . import order

LEDGER = "entry_id string, symbol_id string, kind string, summary string"
LOG = "seq long, entry_id string, action string, actor string, decision string, event_hash string, prev_event_hash string"
FIRST = ""


def entry_id(*parts: str) -> Column:
    """An identifier that follows from the content."""
    return F.concat(F.lit("led_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))


def record_hash() -> Column:
    return F.sha2(F.concat_ws("|", "seq", "entry_id", "action", "actor", "decision"), 256)


def decided(proposals: DataFrame, policies: DataFrame) -> DataFrame:
    """proposals with `decision`: policies (pos, match_action, deny, require_approval, agent_id) are a short list of rules, the first that fits counts."""
    p = policies.select(*(F.col(c).alias(f"p_{c}") for c in ("pos", "match_action", "deny", "require_approval", "agent_id")))
    stem = F.regexp_replace("p_match_action", r"\.\*$", "")
    below = F.endswith("p_match_action", F.lit(".*")) & ((F.col("action") == stem) | F.startswith("action", F.concat(stem, F.lit("."))))
    fits = (F.col("p_agent_id").isNull() | (F.col("p_agent_id") == F.col("actor"))) & ((F.col("p_match_action") == F.col("action")) | below)
    asked = proposals.select("action", "actor").distinct()
    rule = asked.join(F.broadcast(p), fits).groupBy("action", "actor").agg(F.min(F.struct("p_pos", "p_deny", "p_require_approval")).alias("rule"))
    verdict = F.when(F.col("rule").isNull(), "no-match").when(F.col("rule.p_require_approval").isNotNull(), "require-approval").when(F.col("rule.p_deny"), "deny").otherwise("allow")
    return proposals.join(rule, ["action", "actor"], "left").withColumn("decision", verdict).drop("rule")


def stored(spark: SparkSession, base: str, name: str, schema: str) -> DataFrame:
    """What is stored of the ledger or the log; nothing before the first batch."""
    kind = StructType.fromDDL(schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(kind).parquet(f"{base}/{name}") if there else spark.createDataFrame([], kind)


def append(batch: DataFrame, base: str, policies: DataFrame) -> None:
    """Adds the rows of a batch that the log doesn't hold."""
    spark = batch.sparkSession
    log, ledger = stored(spark, base, "log", LOG), stored(spark, base, "ledger", LEDGER)
    fresh = batch.dropDuplicates(["entry_id"]).join(log.select("entry_id"), "entry_id", "left_anti")
    fresh = saved(decided(fresh, policies), "fresh")
    if fresh.isEmpty():
        return
    columns = [c.split()[0] for c in LEDGER.split(", ")]
    allowed = fresh.where("decision <> 'deny'").join(ledger.select("entry_id"), "entry_id", "left_anti")
    allowed.select(*columns).write.mode("append").parquet(f"{base}/ledger")
    tail = log.agg(F.max(F.struct("seq", "event_hash")).alias("t")).select(F.coalesce("t.seq", F.lit(0)), F.coalesce("t.event_hash", F.lit(FIRST))).first()
    numbered = order.placed(fresh, [F.col("entry_id").asc()], "place").withColumn("seq", F.col("place") + F.lit(tail[0]).cast("long"))
    chained = order.lagged(numbered.withColumn("event_hash", record_hash()).select("seq", "entry_id", "action", "actor", "decision", "event_hash"), [F.col("seq").asc()], "event_hash", "before")
    chained.select("seq", "entry_id", "action", "actor", "decision", "event_hash", F.coalesce("before", F.lit(tail[1])).alias("prev_event_hash")).write.mode("append").parquet(f"{base}/log")


def verified(log: DataFrame) -> DataFrame:
    """(seq, intact): whether each record of a stored log has the hash of its content and names that of the record before."""
    before = order.lagged(log, [F.col("seq").asc()], "event_hash", "before")
    return before.select("seq", ((F.col("event_hash") == record_hash()) & (F.col("prev_event_hash") == F.coalesce("before", F.lit(FIRST)))).alias("intact"))
