"""A stored positional index by field, BM25 over it, and what positions tell of phrases.

Postings (bucket, term, doc, field, positions) are written once, in folders by the hash of the term and sorted by term within:
a search reads the buckets of its terms alone.  A document's postings are made where its words are, and dealt out once, by bucket
and a hash of the document, so a term that a third of all documents hold is spread over many files.  Beside them stand the documents' lengths, the terms' frequencies and one row
of totals.  A search is a table of queries: all of them are answered by one join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import saved
from ..shipping import ship

K1, B = 1.2, 0.75
BUCKETS = 64
#: Words that are looked at together, and cells for a shuffle partition into which postings are dealt.
WORDS, CELLS = 1 << 20, 8
#: Pairs of a query and a document that one task sums, at most, and tasks at most.
PAIRS, TASKS = 1 << 19, 1 << 14


def runs_of(text: Column) -> Column:
    """The words of a text: its runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def placed(batches):
    """For mapInArrow: (doc, field, term, positions) of rows (doc, field, words)."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column(2)).fill_null(0).to_numpy().astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + WORDS, "right")))
            some, n = batch.slice(at, to - at), sizes[at:to]
            at = to
            terms = some.column(2).flatten().dictionary_encode()
            if not len(terms):
                continue
            row, codes = np.repeat(np.arange(len(n)), n), terms.indices.to_numpy()
            pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            key = row * len(terms.dictionary) + codes
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) > 0]))
            own = order[first]
            positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(pos[order], pa.int32()))
            owner = pa.array(row[own])
            yield pa.RecordBatch.from_arrays([some.column(0).take(owner), some.column(1).take(owner), terms.dictionary.take(pa.array(codes[own])), positions], names=["doc", "field", "term", "positions"])


@dataclass(frozen=True)
class Index:
    path: str
    buckets: int
    postings: DataFrame  # bucket, term, doc, field, positions
    terms: DataFrame  # term, df, cf: documents and places that hold it in a weighted field
    lengths: DataFrame  # doc, length: words in the weighted fields
    totals: DataFrame  # one row: docs, words


def build(fields: DataFrame, weighted: list[str], path: str, bare: DataFrame | None = None, buckets: int = BUCKETS) -> Index:
    """Writes the index of fields (doc, field, words), one row for each document and field.

    `weighted` fields count for lengths and frequencies; others, and the terms of `bare` (doc, field, term), which have no
    positions, are only looked up.
    """
    spark = fields.sparkSession
    ship(spark)
    kind = fields.schema["doc"].dataType.simpleString()
    found = fields.select("doc", "field", "words").mapInArrow(placed, f"doc {kind}, field string, term string, positions array<int>")
    if bare is not None:
        found = found.unionByName(bare.select("doc", "field", "term").distinct().withColumn("positions", F.array().cast("array<int>")))
    cells = max(1, CELLS * int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
    dealt = found.withColumn("bucket", bucket_of(F.col("term"), buckets)).repartition("bucket", F.pmod(F.xxhash64("doc"), F.lit(cells)))
    dealt.sortWithinPartitions("bucket", "term", "doc").write.partitionBy("bucket").parquet(f"{path}/postings")
    own = fields.where(F.col("field").isin(weighted))
    own.groupBy("doc").agg(F.sum(F.size("words")).alias("length")).write.parquet(f"{path}/lengths")
    held = spark.read.parquet(f"{path}/postings").where(F.col("field").isin(weighted)).groupBy("term", "doc").agg(F.sum(F.size("positions")).alias("tf"))
    held.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).write.parquet(f"{path}/terms")
    spark.read.parquet(f"{path}/lengths").agg(F.count("*").alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).write.parquet(f"{path}/totals")
    return stored(spark, path, buckets)


def stored(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Index:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Index(path, buckets, read("postings").select("bucket", "term", "doc", "field", "positions"), read("terms"), read("lengths"), read("totals"))


def looked_up(index: Index, asked: DataFrame, fields: list[str], docs: DataFrame | None = None) -> DataFrame:
    """asked (query, at, term, …) with the postings (doc, field, positions) of its terms in the fields, of all documents or of the different ones in `docs`.
    The driver sees the buckets' numbers only."""
    wanted = [r[0] for r in asked.select(bucket_of(F.col("term"), index.buckets)).distinct().collect()]
    posts = index.postings.where(F.col("bucket").isin(wanted) & F.col("field").isin(fields)).drop("bucket")
    if docs is not None:
        posts = posts.join(docs, "doc", "left_semi")
    return posts.join(asked, "term")


def bm25(index: Index, asked: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(query, doc, score) for queries given as rows (query, at, term).  A field's occurrences count by its weight; frequencies are those of rows."""
    weight = F.lit(0.0)
    for field, w in weights.items():
        weight = F.when(F.col("field") == field, float(w)).otherwise(weight)
    # what a term counts in a document is the same for all queries and made once; documents are dealt out once, so that their queries' sums need no shuffle
    words = asked.groupBy("query", "at", "term").agg(F.count("*").alias("m")).groupBy("query", "term", "m").agg(F.count("*").alias("times"))
    words = saved(words.join(index.terms.select("term", "df"), "term").crossJoin(F.broadcast(index.totals)), "words")  # one row
    wanted = [r[0] for r in words.select(bucket_of(F.col("term"), index.buckets)).distinct().collect()]
    pairs = words.select("query").distinct().count() * index.totals.first().docs
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-pairs // PAIRS), TASKS))
    posts = index.postings.where(F.col("bucket").isin(wanted) & F.col("field").isin(list(weights))).join(words.select("term").distinct(), "term", "left_semi")
    held = posts.select("doc", "term", (weight * F.size("positions")).alias("tf")).repartition(tasks, "doc").groupBy("doc", "term").agg(F.sum("tf").alias("own"))
    scored = held.join(index.lengths, "doc").join(words, "term")
    tf = F.col("own") * F.col("m")
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = K1 * ((1 - B) + B * F.col("length") / (F.col("words") / F.col("docs")))
    part = F.col("times") * F.when(idf > 0, idf).otherwise(1e-6) * tf * (K1 + 1) / (tf + norm)
    return scored.groupBy("query", "doc").agg(F.sum(part).alias("score"))


def phrases(hits: DataFrame) -> DataFrame:
    """(query, doc, longest): the longest run of a query's words that stand in a row in a field's positions, for hits (query, at, doc, positions)."""
    places = hits.select("query", "doc", "at", F.explode("positions").alias("pos")).select("query", "doc", "at", (F.col("pos") - F.col("at")).alias("diagonal")).distinct()
    row = F.row_number().over(Window.partitionBy("query", "doc", "diagonal").orderBy("at"))
    islands = places.withColumn("island", F.col("at") - row).groupBy("query", "doc", "diagonal", "island").agg(F.count("*").alias("n"))
    return islands.groupBy("query", "doc").agg(F.max("n").alias("longest"))


def best(rows: DataFrame, most: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first rows of each group; Spark cuts each task's groups before it shuffles them."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")
