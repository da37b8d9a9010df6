"""Total orders without a task that holds all rows: ranges of the order, numbered by what comes before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import saved


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """df, written in ranges of the order; `__part` numbers them."""
    return saved(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with each row's place in the order, from 1.  The driver sees one number for each range."""
    own = ranged(df, order)
    counts = sorted(own.groupBy("__part").count().collect())
    begin, at = [], 0
    for part, n in counts:
        begin.append((part, at))
        at += n
    begun = df.sparkSession.createDataFrame(begin, "__p int, __begin long")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return own.join(F.broadcast(begun), F.col("__part") == F.col("__p")).withColumn(name, F.col("__begin") + within).drop("__part", "__p", "__begin")


def lagged(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """df with the value of the row before, in the order.  Each range hands its last row's value on."""
    own = ranged(df, order)
    w = Window.partitionBy("__part").orderBy(*order)
    turned = own.withColumn("__r", F.row_number().over(w))
    lasts = turned.groupBy("__part").agg(F.max_by(value, "__r").alias("last")).collect()  # one row for each range
    before = sorted((r["__part"], r["last"]) for r in lasts)
    handed = [(part, before[i - 1][1] if i else None) for i, (part, _) in enumerate(before)]
    kind = df.schema[value].dataType.simpleString()
    border = df.sparkSession.createDataFrame(handed, f"__p int, __last {kind}")
    inner = F.lag(value).over(w)
    first = F.row_number().over(w) == 1
    joined = own.join(F.broadcast(border), F.col("__part") == F.col("__p"))
    return joined.withColumn(name, F.when(first, F.col("__last")).otherwise(inner)).drop("__part", "__p", "__last")


def carried(df: DataFrame, group: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """df with the latest value that is not null in the rows before, in the order and of the same group (not null).

    No task holds a group: ranges of (group, order) hand on what their last group has come to, one row for each range.
    """
    own = ranged(df.withColumn("__value", F.struct(value.alias("v"))), [F.col(group), *order])
    within = Window.partitionBy("__part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    held = F.when(F.col("__value.v").isNotNull(), F.col("__value"))
    ends = own.groupBy("__part").agg(F.min(group).alias("low"), F.max(group).alias("high"))
    ends = own.join(F.broadcast(ends.withColumnRenamed("__part", "__p")), F.col("__part") == F.col("__p"))  # one row for each range
    last = ends.where(F.col(group) == F.col("high")).withColumn("__r", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    border = last.groupBy("__part", "low", "high").agg(F.max_by("__value", F.when(F.col("__value.v").isNotNull(), F.col("__r"))).alias("last")).collect()
    handed, at, reached = [], None, None
    for part, low, high, found in sorted(border, key=lambda r: r[0]):
        handed.append((part, low, reached if low == at else None))
        reached = found if found is not None and found["v"] is not None else reached if low == high == at else None
        at = high
    schema = df.sparkSession.createDataFrame([], own.select(F.col("__part").alias("__p"), F.col(group).alias("__low"), F.col("__value").alias("__before")).schema).schema
    borders = df.sparkSession.createDataFrame(handed, schema)
    joined = own.join(F.broadcast(borders), F.col("__part") == F.col("__p"))
    first = F.coalesce(F.last(held, ignorenulls=True).over(within), F.when(F.col(group) == F.col("__low"), F.col("__before")))
    return joined.withColumn(name, first["v"]).drop("__part", "__p", "__low", "__before", "__value")
