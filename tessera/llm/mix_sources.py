"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document has a quality weight and the key -ln(u) / weight, u being a hash of
its identifier.  In the order of these keys every prefix of a source is a
weighted sample without replacement.  A source whose target exceeds its size is
taken whole as often as that goes (complete epochs); the rest of the target is
filled in key order, the last document in part.

Prefix sums need no source in one task: keys are dealt to buckets by their
logarithm, `buckets` an octave, whose sums are added up first (at most 64 times
`buckets` rows a source), and exact sums follow within one bucket of one source.
The logarithm of an exponential key has nowhere a density above 1/e, whatever its
weight, so no bucket has more than 0.26 / `buckets` of its source, about.

Targets: sources in the order of code points, null last, weigh `weights` in
turn and share all words; a target stops at `most` times its source's size, and
the excess is shared anew by weight until none is above.  That is one water
level, found with a running sum over the sources in the order of size / weight.

Null texts have size 0; a document of size 0 is never taken.  Null sources are
one source.  Null identifiers hash as the empty string.  Repeated rows are
further documents.  An empty table gives no rows.  All of it is DataFrame
operations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, saved


@dataclass(frozen=True)
class Settings:
    weights: tuple[int, ...] = (1, 2, 3)
    most: int = 3
    seed: str = "mix"
    buckets: int = 2048


SYMBOLS = "#*$%&|<>!"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """A weight from 0.05 to 1 that falls with the share of symbols in the text."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    return F.coalesce(F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(5.0) * (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))) / n), F.lit(1.0))


def keyed(docs: DataFrame, settings: Settings, ident: str, text: str, source: str) -> DataFrame:
    """docs with size, key and order (all that ranks a document in its source), as columns that start with __."""
    digest = F.md5(F.concat(F.lit(settings.seed), F.coalesce(F.col(ident).cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    key = -F.log(u) / quality(F.col(text))
    return docs.withColumns({
        "__source": F.col(source), "__size": words_in(F.col(text)),
        "__order": F.struct(key.alias("key"), F.col(ident).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h")),
    })


def targets(sizes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(source, source_size) with target, epochs and rest, for a table with a row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(settings.weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in settings.weights)), (place + 1).cast("int")))
    cap = F.col("source_size") * float(settings.most)
    by_ratio = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything).cast("double")
    before = F.coalesce(F.sum(cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = weighed.withColumns({"cap": cap, "level": (total - before) / rest})
    first = F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct(F.col("cap") / F.col("weight"), "source", "level"))).over(everything)
    done = level.withColumn("target", F.least("cap", F.col("weight") * first["level"]))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return done.select("source", "source_size", "target", epochs.alias("epochs"), (F.floor("target") - epochs * F.col("source_size")).cast("long").alias("rest"))


def bucketed(docs: DataFrame, settings: Settings = Settings(), ident: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(source, size, order, bucket): the bucket's number grows with the key."""
    own = keyed(docs.select(ident, text, source), settings, ident, text, source)
    bucket = F.floor(F.log2(F.col("__order.key")) * settings.buckets).cast("int")
    return own.select(F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__order").alias("order"), bucket.alias("bucket"))


def plan(docs: DataFrame, settings: Settings = Settings(), ident: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A row per document: id, source, order, size, source_size, target, epochs, rest, and `before`, the words that precede it."""
    rows = saved(bucketed(docs, settings, ident, text, source), "sizes")
    sums = saved(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), settings)
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begun = sums.select("source", "bucket", F.coalesce(F.sum("words").over(running), F.lit(0)).alias("begin"))
    begun = begun.join(goal.withColumnRenamed("source", "g_source"), F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source")
    begun = begun.withColumnsRenamed({"source": "b_source", "bucket": "b_bucket"})
    placed = rows.join(begun, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    within = Window.partitionBy("source", "bucket").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("before", F.col("begin") + F.coalesce(F.sum("size").over(within), F.lit(0))).drop("b_source", "b_bucket", "begin")


def mix_sources(docs: DataFrame, settings: Settings = Settings(), ident: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return plan(docs, settings, ident, text, source).select(F.col("order.id").alias("doc_id"), "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def mixed(docs: DataFrame, settings: Settings = Settings(), ident: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix takes it; a document taken in part comes whole."""
    chosen = F.when((F.col("before") < F.col("rest")) & (F.col("size") > 0), F.col("order"))
    cuts = plan(docs, settings, ident, text, source).groupBy("source").agg(F.first("epochs").alias("__epochs"), F.max(chosen).alias("__cut")).withColumnRenamed("source", "__cut_source")
    own = keyed(docs, settings, ident, text, source).join(saved(cuts, "cuts"), F.col("__source").eqNullSafe(F.col("__cut_source")))
    times = F.when(F.col("__size") > 0, F.col("__epochs") + F.coalesce(F.col("__order") <= F.col("__cut"), F.lit(False)).cast("long")).otherwise(0).cast("int")
    return own.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), times)).alias("__copy")).drop("__copy")


def op5_mix_sources(spark, sf_dir):
    return mix_sources(documents(spark, sf_dir))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text,
         CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
         -ln((CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
         / CASE WHEN text IS NULL THEN 1::DOUBLE ELSE greatest(0.05::DOUBLE, 1::DOUBLE - 5::DOUBLE * (length(text) - length(translate(text, '#*$%&|<>!', ''))) / greatest(length(text), 1)) END AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight, 3::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio,
        ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM w),
f AS (SELECT lvl FROM l WHERE ratio >= lvl ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(cap, weight * (SELECT lvl FROM f)) AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
p AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.epochs, CAST(floor(g.target) AS BIGINT) - g.epochs * g.source_size AS rest,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM p
"""
