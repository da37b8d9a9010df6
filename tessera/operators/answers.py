"""Queries of words answered symbol by symbol: no pair of a query and a symbol is dealt out, grouped or compared with another.

A symbol carries the words that its texts hold, each with a mask of the texts.  It meets the queries by one of these words, and
the row of a query comes from the first of its words that the symbol has.  All that a pair needs stands in that row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import saved


def gathered(words: DataFrame, key: str, extra: list[str] = ()) -> DataFrame:
    """(key, held, …): of words (key, needle, mask, …) a map of each key's words to their masks together, and of each extra column one to its least value."""
    one = words.groupBy(key, "needle").agg(F.bit_or("mask").alias("mask"), *(F.min(c).alias(c) for c in extra))
    listed = lambda c: F.map_from_entries(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("needle", c))))
    return one.groupBy(key).agg(listed("mask").alias("held"), *(listed(c).alias(c) for c in extra))


def worded(asked: DataFrame) -> DataFrame:
    """(query, words) of asked (query, at, term): the words of each query in order, repeated ones too."""
    return asked.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda w: w["term"]).alias("words"))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df over all tasks: what is made of a row is many times its size, so small tables must not end up in a few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def answered(symbols: DataFrame, queries: DataFrame, key: str = "symbol_id") -> DataFrame:
    """symbols (key, …, held) with each of the queries (query, words, …) that has a word which they hold; `masks` are those of the query's words, 0 where there is none."""
    by = saved(queries.withColumn("term", F.explode(F.array_distinct("words"))), "queries")
    met = dealt(symbols, key).withColumn("term", F.explode(F.map_keys("held"))).join(by, "term")
    masks = F.transform("words", lambda w: F.coalesce(F.try_element_at("held", w), F.lit(0)))
    first = F.element_at(F.filter("words", lambda w: F.map_contains_key("held", w)), 1)
    return met.where(F.col("term") == first).drop("term").withColumn("masks", masks)
