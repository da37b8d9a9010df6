"""Exact containment joins: which texts occur within which others, without a nested loop.

A text of at least `GRAM` characters is looked for by its rarest run of GRAM characters, a shorter one by itself among all
runs of its length.  What meets by equality is verified, so the result is exact whatever the texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import saved

GRAM = 3


def grams(text: Column, size: int) -> Column:
    """The different runs of `size` characters of a text."""
    n = F.length(text) - (size - 1)
    return F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def contained(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """(needle, hay): all pairs of different values of the two one-column tables in which the second contains the first.

    Nulls and empty needles have no pairs.
    """
    small = needles.toDF("needle").where("needle <> ''").distinct()
    large = hay.toDF("hay").where("hay IS NOT NULL").distinct()
    runs = large.select("hay", F.explode(grams(F.col("hay"), GRAM)).alias("gram"))
    found = runs.groupBy("gram").agg(F.count("*").alias("n"))
    long = small.where(F.length("needle") >= GRAM).select("needle", F.explode(grams(F.col("needle"), GRAM)).alias("gram"))
    rarest = long.join(found, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    pairs = rarest.where("r.n > 0").select("needle", F.col("r.gram").alias("gram")).join(runs, "gram").where(F.contains("hay", F.col("needle"))).select("needle", "hay")
    for size in range(1, GRAM):
        short = small.where(F.length("needle") == size)
        every = large.select("hay", F.explode(grams(F.col("hay"), size)).alias("needle"))
        pairs = pairs.unionByName(every.join(short, "needle").select("needle", "hay"))
    return pairs


def needles_in(rows: DataFrame, texts: list[Column], needles: DataFrame) -> DataFrame:
    """rows with each `needle` of the one-column table that one of their texts contains, and `mask`, a bit for each text that does.

    Rows are not dealt out anew where the needles fit a broadcast join: each is looked for by the rarest of its runs.
    """
    small = needles.toDF("needle").where("needle <> ''").distinct()
    every = lambda size: F.explode(F.array_distinct(F.flatten(F.array(*(grams(F.coalesce(t, F.lit("")), size) for t in texts)))))
    long = small.where(F.length("needle") >= GRAM).select("needle", F.explode(grams(F.col("needle"), GRAM)).alias("gram"))
    found = rows.select(every(GRAM).alias("gram")).join(long.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = long.join(found, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    keys = rarest.where("r.n > 0").select("needle", F.col("r.gram").alias("gram")).unionByName(small.where(F.length("needle") < GRAM).select("needle", F.col("needle").alias("gram")))
    keys = saved(keys, "needles")
    sizes = [r[0] for r in keys.select(F.length("gram")).distinct().collect()]  # at most GRAM
    bits = [F.when(F.coalesce(F.contains(t, F.col("needle")), F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(texts)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask + b
    met = [rows.withColumn("gram", every(n)).join(keys.where(F.length("gram") == n), "gram") for n in sizes] or [rows.withColumns({"gram": F.lit(""), "needle": F.lit("")}).limit(0)]
    return reduce(DataFrame.unionByName, met).withColumn("mask", mask).where("mask > 0").select(*rows.columns, "needle", "mask")
