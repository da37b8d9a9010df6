"""From raw documents to training shards, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of `documents`; the last returns them with the shard of each row.

Null and empty texts fail the base of the quality rules and go there; null
languages, sources and identifiers are values like others.  Of repeated rows and
of ties in a group of near duplicates one row stays.  An empty table gives an
empty result in every stage.  Columns beyond those of `documents` are dropped by
the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import decontaminate, mix_sources, near_dedup, quality_rules, shard
from .common import DOCUMENT, documents, saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's thresholds."""
    return quality_rules.quality_rules(docs, DOCUMENT).where("__kept").select(DOCUMENT)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least identifier."""
    return near_dedup.kept(docs.select(DOCUMENT))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs.select(DOCUMENT), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix_sources.mixed(docs.select(DOCUMENT))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard, its bytes and rows: what shard.write_shards() writes by folder."""
    found = shard.assigned(docs.select(DOCUMENT))
    return found.select(*DOCUMENT, F.col("__n_bytes").alias("n_bytes"), F.col("__shard").alias("shard"), F.col("__shard_bytes").alias("shard_bytes"), F.col("__shard_rows").alias("shard_rows"))


def _shipped(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(name, _shipped(stage)) for name, stage in (("quality", quality), ("near_dedup", dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding))]

#: Samplings of consistent weights have no equal in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
