"""Sharding by extendible hashing.

A document's bits are a hash of its identifier.  A shard is all documents whose
bits begin with the shard's prefix; the directory maps prefixes to shards.  A
shard above `limit` bytes, and only such a one, is split on one more bit, until
each fits.  Sizes are summed by prefix in rounds of `step` bits: a round looks
only at documents whose shard is still too large.

A single document above the limit is a shard of its own.  Documents with equal
identifiers share their first 60 bits; further bits hash the text too, and the
last ones a row number, so repeated identifiers and even repeated rows can be
split.  Null texts have no bytes; null identifiers hash as the empty string.  An
empty table has no shards.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, saved

LONGEST = 150


@dataclass(frozen=True)
class Settings:
    limit: int = 64 << 20
    step: int = 8


def _sixty(digest: Column) -> Column:
    return F.lpad(F.conv(F.substring(digest, 1, 15), 16, 2), 60, "0")


def bits(ident: Column, text: Column) -> Column:
    """A text of LONGEST zeros and ones."""
    name = F.coalesce(ident.cast("string"), F.lit(""))
    row = F.md5(F.monotonically_increasing_id().cast("string").cast("binary"))
    body = F.md5(F.concat(name, F.lit("/"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return F.concat(_sixty(F.md5(name.cast("binary"))), _sixty(body), F.substring(_sixty(row), 1, LONGEST - 120))


def _leaves(fine: DataFrame, depth: int, settings: Settings) -> DataFrame:
    """For each prefix of depth + step bits (prefix, n, bytes): the shortest prefix that fits, as shard, shard_bytes, shard_rows; null if none does."""
    found, size, rows = F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("long")
    for k in range(settings.step, -1, -1):
        own = F.substring("prefix", 1, depth + k)
        w = Window.partitionBy(own)
        total, n = F.sum("bytes").over(w), F.sum("n").over(w)
        fits = (total <= settings.limit) | (n == 1) | F.lit(depth + k >= LONGEST)
        found, size, rows = (F.when(fits, new).otherwise(old) for new, old in ((own, found), (total, size), (n, rows)))
    return fine.select("prefix", found.alias("shard"), size.alias("shard_bytes"), rows.alias("shard_rows"))


def _split(rows: DataFrame, settings: Settings) -> DataFrame:
    """rows (with __n_bytes and __bits) with __shard (the prefix), __shard_bytes and __shard_rows in place of __bits."""
    rows = saved(rows, "bits")
    columns, parts, depth = rows.columns, [], 0
    while True:
        prefix = F.substring("__bits", 1, depth + settings.step)
        fine = rows.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n"), F.sum("__n_bytes").alias("bytes"))
        leaves = saved(_leaves(fine, depth, settings).toDF("__prefix", "__shard", "__shard_bytes", "__shard_rows"), "directory")
        joined = rows.join(leaves, prefix == F.col("__prefix")).drop("__prefix")
        parts.append(joined.where(F.col("__shard").isNotNull()).drop("__bits"))
        if leaves.where(F.col("__shard").isNull()).isEmpty():
            return reduce(DataFrame.unionByName, parts)
        rows = saved(joined.where(F.col("__shard").isNull()).select(columns), "bits")
        depth += settings.step


def assigned(docs: DataFrame, settings: Settings = Settings(), ident: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with __n_bytes, __shard, __shard_bytes and __shard_rows."""
    own = {"__n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "__bits": bits(F.col(ident), F.col(text))}
    return _split(docs.withColumns(own), settings)


def shard(docs: DataFrame, settings: Settings = Settings(), ident: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, n_bytes, shard (the prefix), depth (its length), shard_bytes, shard_rows."""
    own = docs.select(F.col(ident).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("__n_bytes"), bits(F.col(ident), F.col(text)).alias("__bits"))
    return _split(own, settings).select("doc_id", F.col("__n_bytes").alias("n_bytes"), F.col("__shard").alias("shard"), F.length("__shard").cast("int").alias("depth"), F.col("__shard_bytes").alias("shard_bytes"), F.col("__shard_rows").alias("shard_rows"))


def directory(sharded: DataFrame) -> DataFrame:
    """The directory of what shard() gives: a row per shard."""
    return sharded.groupBy("shard").agg(F.first("depth").alias("depth"), F.first("shard_bytes").alias("shard_bytes"), F.first("shard_rows").alias("shard_rows"))


def write_shards(docs: DataFrame, path: str, settings: Settings = Settings(), ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes docs to `path` as Parquet, a folder per shard, and returns the directory.  Rows may repeat."""
    found = saved(assigned(docs, settings, ident, text), "shards")
    # a shard is bounded, so one task writes it whole; the empty prefix names a folder too
    own = found.withColumn("shard", F.concat(F.lit("p"), "__shard"))
    own.drop("__shard", "__n_bytes", "__shard_bytes", "__shard_rows").repartition("shard").write.partitionBy("shard").parquet(path)
    return found.groupBy(F.col("__shard").alias("shard")).agg(F.length(F.first("__shard")).alias("depth"), F.first("__shard_bytes").alias("shard_bytes"), F.first("__shard_rows").alias("shard_rows"))


def op2_extendible_shards(spark, sf_dir):
    return shard(documents(spark, sf_dir))


OP2_SQL = """
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n_bytes,
             lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)), 60, '0') AS bits FROM documents),
s AS (SELECT depth, substr(bits, 1, depth) AS shard, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows
      FROM d, range(0, 61) AS r(depth) GROUP BY ALL),
f AS (SELECT * FROM s WHERE shard_bytes <= 67108864 OR shard_rows = 1)
SELECT d.doc_id, CAST(d.n_bytes AS BIGINT) AS n_bytes, f.shard, CAST(f.depth AS INTEGER) AS depth, f.shard_bytes, f.shard_rows
FROM d JOIN f ON f.shard = substr(d.bits, 1, f.depth)
QUALIFY row_number() OVER (PARTITION BY d.doc_id ORDER BY f.depth) = 1
"""
