"""What the operators of this subpackage share: tables, written intermediate results, row numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import saved, shared_dir

#: The columns that every stage of the pipeline keeps.
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(ident: Column, n: int = 5) -> Column:
    """crc32 of the identifier's text modulo n; null for a null identifier."""
    return F.crc32(ident.cast("string").cast("binary")) % F.lit(n)


def numbered(fn: Callable[[Iterator[pa.RecordBatch], int], Iterator[pa.RecordBatch]]):
    """For mapInArrow: passes fn the first of 2**33 row numbers that no other task uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(batches, TaskContext.get().partitionId() << 33)

    return run


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


#: Numbers that a thinning broadcast holds at most.
THIN_SLOTS = 1 << 20


def _slot(columns: list[str]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(THIN_SLOTS)).cast("int").alias("__slot")


def thinned(df: DataFrame, on: list[str], keys: DataFrame, their: list[str]) -> DataFrame:
    """The rows of df whose hash slot in the columns `on` is that of a row of keys; at most THIN_SLOTS numbers are broadcast."""
    slots = F.broadcast(keys.select(_slot(their)).distinct())
    return df.select("*", _slot(on)).join(slots, "__slot", "left_semi").drop("__slot")


def parts_for(df: DataFrame, part_bytes: int) -> int:
    """The number of parts of about so many bytes, by the size that Spark knows of the input; by the shuffle's where it knows none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(16, size // part_bytes), 1 << 30)


def without(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of df for which no row of `keys` has the same values (nulls equal) in the columns of `keys`.

    Rows whose hash slot no key has, which at most THIN_SLOTS broadcast numbers tell, pass without a shuffle.
    """
    on = keys.columns
    slots = F.broadcast(keys.select(_slot(on)).distinct())
    placed = df.select("*", _slot(on))
    clear = placed.join(slots, "__slot", "left_anti")
    other = keys.distinct().toDF(*(f"__k{i}" for i in range(len(on))))
    same = F.lit(True)
    for i, c in enumerate(on):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    unclear = placed.join(slots, "__slot", "left_semi").join(other, same, "left_anti")
    return clear.unionByName(unclear).drop("__slot")


__all__ = ["DOCUMENT", "documents", "numbered", "parts_for", "record", "remainder", "saved", "shared_dir", "thinned", "without"]
