"""Rows of conversations in order, cut into blocks of bounded size.

A conversation can hold any share of all rows, so no task takes one whole: rows are
dealt to ranges of the order (conversation, turn, ...), numbered in a stream within
each range, and ranges hand on how far their last conversation has come.  Only one
row for each range reaches the driver.  A block is `size` consecutive rows of one
conversation; what needs rows together takes a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import saved

_PLACE = ["__part", "__run", "__n"]


def conversations(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def key_of(ident: Column) -> Column:
    """The identifier as text that is never null, for joins: null identifiers are one conversation."""
    return F.coalesce(F.concat(F.lit("="), ident.cast("string")), F.lit(""))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Appends the range's number, the number of the run of equal keys, and the place in that run."""
    part, last, run, at = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key")
        codes = np.asarray(keys.dictionary_encode().indices)
        fresh = np.concatenate([[last is None or keys[0].as_py() != last], codes[1:] != codes[:-1]])
        runs = run + np.cumsum(fresh) - (last is None)
        begins = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), -1))
        place = np.arange(len(fresh)) - begins + np.where(begins < 0, at - 1, 0)
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in (np.full(len(fresh), part), runs, place))], names=[*batch.schema.names, *_PLACE])
        last, run, at = keys[-1].as_py(), int(runs[-1]), int(place[-1]) + 1


def placed(rows: DataFrame, order: list[Column], size: int) -> DataFrame:
    """rows (with a column `key`), written with `pos`, the place from 0 in their conversation, and `block`, pos divided by size.

    `order` ranks the rows of one key.  Equal rows are told apart by where they were read, so that any number of them
    can be dealt to several ranges.
    """
    kind = StructType([*rows.schema.fields, StructField("__tie", LongType()), *(StructField(c, LongType()) for c in _PLACE)])
    by = [F.col("key"), *order, F.col("__tie")]
    counted = saved(rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_count, kind), "turns")
    row = F.struct("__run", "__n")
    borders = counted.groupBy("__part").agg(F.min_by("key", row), F.max_by("key", row), F.max(row)).collect()  # one row for each range
    begins, before, reached = [], None, 0
    for part, first, last, (run, n) in sorted(borders):
        begin = reached if first == before else 0
        if begin:
            begins.append((part, 0, begin))
        before, reached = last, n + 1 + (begin if run == 0 else 0)
    begun = rows.sparkSession.createDataFrame(begins, "__part long, __run long, __begin long")
    pos = F.col("__n") + F.coalesce(F.col("__begin"), F.lit(0))
    found = counted.join(F.broadcast(begun), ["__part", "__run"], "left").withColumn("pos", pos)
    return found.withColumn("block", F.floor(F.col("pos") / size).cast("long")).drop("__tie", "__begin", *_PLACE)


def folded(rows: DataFrame, key: str, order: list[str], state: Callable[[], object], kind: str) -> DataFrame:
    """One row for each key: what state() has to tell after it was shown the key's rows (as dicts) in order.

    The rows pass as a stream, so a key of any size takes the memory of one batch.  state() gives an object with
    add(row) and end(), which returns the columns that `kind` names after the key.
    """
    names = [part.split()[0] for part in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, done = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if own is None or row[key] != own:
                    if own is not None:
                        done.append({key: own, **dict(zip(names, held.end()))})
                    own, held = row[key], state()
                held.add(row)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if own is not None:
            done.append({key: own, **dict(zip(names, held.end()))})
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    arrow = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(key, pa.string()), *((n, arrow[part.split()[1]]) for n, part in zip(names, kind.split(", ")))])
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, f"{key} string, {kind}")


#: For DuckDB, which has no CRC-32: a table of the remainders of one byte, and the CRC-32 of a text by it.
CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i)) AS crc_t)"


def crc_sql(text: str) -> str:
    octets = f"list_transform(range(length(hex(encode({text}))) // 2), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(4294967295::BIGINT, list_reduce({octets}, lambda a, b: xor(crc_t[(xor(a, b) & 255) + 1], a // 256), 4294967295::BIGINT))"
