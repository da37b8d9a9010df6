"""Full-text search: BM25, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bm25(docs: DataFrame, ident: str, text: str, terms: list[str]) -> DataFrame:
    """(ident, score) of the documents with any term.  Only the terms' occurrences are shuffled; lengths come from the texts."""
    own = docs.select(ident, words_of(F.col(text)).alias("words"))
    held = own.select(ident, F.size("words").alias("dl"), F.filter("words", lambda w: w.isin(terms)).alias("hits"))
    stats = held.agg(F.count("*").alias("n"), F.sum("dl").alias("words"))
    hits = held.where(F.size("hits") > 0).select(ident, "dl", F.explode("hits").alias("term")).groupBy(ident, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    length = (1 - B) + B * F.col("dl") / (F.col("words") / F.col("n"))
    scored = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # a row for each term, and one row
    return scored.groupBy(ident).agg(F.sum(idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * length)).alias("score"))
