"""Structured Streaming twins of the feeds: each reads a folder of files as a stream and leaves what the batch query gives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir


def events(spark: SparkSession, sf_dir: str, after: int | None = None, glob: str = "events.parquet") -> DataFrame:
    """The events as a stream; `after` leaves out the backlog up to an event, as a subscriber that starts at the head does."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    out = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/[e]vents.parquet")
    return out if after is None else out.where(F.col("event_id") > after)


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Processes all there is now, with a checkpoint, and returns the sink's rows."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{base}/out")
    else:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def folded(stream: DataFrame) -> DataFrame:
    """Confirmations and contradictions of each user so far."""
    return stream.groupBy("user_id").agg(F.count_if(F.col("value") > 40).alias("contradictions"), F.count_if(F.col("value") < 10).alias("confirmations"))
