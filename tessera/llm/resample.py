"""Importance resampling of documents towards a target distribution.

Runs of 1 to `order` consecutive words are hashed to `buckets`.  How much more often
a bucket is met in the target than in the documents is its gain; a document's weight
is the sum over its runs, and Gumbel noise from a hash of its identifier turns the
order of the scores into a draw without replacement in proportion to exp(weight).

Words stand in a position table: a document is cut into chunks of `chunk` words that
overlap by order - 1, each chunk is exploded with its positions, and lead() over the
chunk puts the following words behind each one, once for each order.  So no window
takes a whole document, and with order 1 there is no window and no shuffle of words.
Counts of buckets are added up within each task before they are shuffled, and the
table of gains has `buckets` rows at most: that bounds the broadcast.

The draw takes floor(percent * N / 100) of the N documents with at least `least`
words; ranks come from ranges of the order, so no task holds all of them.

Null texts have no words and score by their noise alone.  Null identifiers hash as
the empty string and come last among equal scores.  Repeated rows are further
documents with ranks of their own.  An empty table gives no rows; an empty target
gives gains by the documents alone.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.order import placed
from .common import documents, saved
from .turns import CRC_TABLE, crc_sql


@dataclass(frozen=True)
class Settings:
    order: int = 1
    buckets: int = 10_000
    percent: int = 10
    least: int = 20
    seed: str = "2024"
    chunk: int = 2048


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The runs of what is no separator, A-Z lower-cased; an empty array for null."""
    own = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(own, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def positions(docs: DataFrame, settings: Settings, text: str, keep: list[str]) -> DataFrame:
    """(keep, chunk, at, word): every word of every text, and a null for a text without; a chunk's last order - 1 words begin the next one, too."""
    own = docs.select(*keep, words_of(F.col(text)).alias("words"))
    steps = F.sequence(F.lit(0), F.floor(F.greatest(F.size("words") - 1, F.lit(0)) / settings.chunk).cast("int"))
    cut = own.select(*keep, F.posexplode(F.transform(steps, lambda i: F.slice("words", i * settings.chunk + 1, F.lit(settings.chunk + settings.order - 1)))).alias("chunk", "part"))
    if settings.order > 1:  # whole chunks are shuffled, so that the windows need not shuffle words
        cut = cut.repartition(*keep, "chunk")
    return cut.select(*keep, "chunk", F.posexplode_outer("part").alias("at", "word"))


def features(docs: DataFrame, settings: Settings, text: str, keep: list[str]) -> DataFrame:
    """(keep, more, bucket): a row for each run of 1 to `order` words, of which `more` follow the first; nulls for a text without words.

    `keep` names columns that tell the documents apart.
    """
    table = positions(docs, settings, text, keep)
    bucket = lambda run: F.pmod(F.crc32(run.cast("binary")), F.lit(settings.buckets)).cast("int").alias("bucket")
    if settings.order == 1:
        return table.select(*keep, F.when(F.col("word").isNotNull(), 0).alias("more"), bucket(F.col("word")))
    following = W.partitionBy(*keep, "chunk").orderBy("at")
    table = table.withColumns({f"__{k}": F.lead("word", k).over(following) for k in range(1, settings.order)})
    longer = [F.when(F.col(f"__{k}").isNotNull(), F.concat_ws(" ", "word", *(f"__{j}" for j in range(1, k + 1)))) for k in range(1, settings.order)]
    own = table.where((F.col("at") < settings.chunk) | F.col("at").isNull())
    return own.select(*keep, F.posexplode_outer(F.array_compact(F.array("word", *longer))).alias("more", "run")).select(*keep, "more", bucket(F.col("run")))


def gains(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), text: str = "text", target_text: str = "text") -> DataFrame:
    """(bucket, gain) of every bucket that the documents meet; at most `buckets` rows, written."""
    numbered = lambda d: d.withColumn("__row", F.monotonically_increasing_id())
    count = lambda d, c, name: saved(features(numbered(d), settings, c, ["__row"]).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias(name)), name)
    own, other = count(docs, text, "s"), count(target, target_text, "t")
    sums = own.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s")).crossJoin(other.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("all_t")))  # one row each
    both = own.join(F.broadcast(other), "bucket", "left").crossJoin(F.broadcast(sums))
    wide = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    odds = (wide(F.col("t")) + 1) * (F.col("all_s").cast("double") + settings.buckets) / ((F.col("s").cast("double") + 1) * (F.col("all_t").cast("double") + settings.buckets))
    return saved(both.select("bucket", F.floor(1000 * F.log(odds)).cast("long").alias("gain")), "gains")


def noise(ident: Column, settings: Settings) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), ident: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """A row per document: doc_id, n_features, weight, score, rank (null where it isn't drawn), n_words."""
    own = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(ident).alias("doc_id"), F.col(text).alias("text"))
    table = gains(docs.select(text), target.select(target_text), settings, text, target_text)
    run = features(own, settings, "text", ["__row", "doc_id"]).join(F.broadcast(table), "bucket", "left")
    words = F.count(F.when(F.col("more") == 0, 1)).alias("n_words")
    summed = run.groupBy("__row", "doc_id").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"), words)
    scored = saved(summed.select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), settings)).alias("score"), "n_words"), "scores")
    eligible = scored.where(F.col("n_words") >= settings.least)
    drawn = eligible.count() * settings.percent // 100
    ranked = placed(eligible, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "place")
    rank = F.when(F.col("place") <= drawn, F.col("place")).cast("long")
    out = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    return ranked.withColumn("rank", rank).select(*out).unionByName(scored.where(F.col("n_words") < settings.least).withColumn("rank", F.lit(None).cast("long")).select(*out))


def op11_target_resampling(spark, sf_dir):
    found = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")



OP11_SQL = rf"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
dw AS (SELECT r, unnest(w) AS w FROM d),
h AS (SELECT w, {crc_sql("w")} % 10000 AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM b) AS u, crc_table),
s AS (SELECT bucket, count(*)::DOUBLE AS s FROM dw JOIN h USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*)::DOUBLE AS t FROM b JOIN h USING (w) GROUP BY bucket),
a AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS all_s, (SELECT count(*) FROM b)::DOUBLE AS all_t),
g AS (SELECT bucket, floor(1000::DOUBLE * ln((coalesce(t, 0::DOUBLE) + 1::DOUBLE) * (all_s + 10000::DOUBLE) / ((s + 1::DOUBLE) * (all_t + 10000::DOUBLE))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), a),
k AS (SELECT r, sum(gain)::BIGINT AS weight FROM dw JOIN h USING (w) JOIN g USING (bucket) GROUP BY r),
f AS (SELECT d.doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM d LEFT JOIN k USING (r)),
n AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS many FROM f)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * many // 100 THEN place END AS rank FROM n
"""


__all__ = ["OP11_SQL", "Settings", "features", "gains", "noise", "op11_target_resampling", "positions", "resample"]
