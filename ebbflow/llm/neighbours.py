"""Neighbours in a global sort, without one task seeing a whole group.

Rows are range-partitioned and sorted; a task walks its sorted rows, and only the last row of
each partition crosses a border (as many rows as there are partitions). A group of any size is
thus spread over tasks, and each row still meets the row before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written


def _walk(batches: Iterator[pa.RecordBatch], carried: list[str]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    last: dict[str, pa.Array] = {}
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        before = []
        for c in carried:
            col = batch.column(c)
            before.append(pa.concat_arrays([last.get(c, pa.nulls(1, col.type)), col.slice(0, n - 1)]))
            last[c] = col.slice(n - 1, 1)
        yield pa.RecordBatch.from_arrays([*batch.columns, *before, pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], [*batch.schema.names, *(f"prev_{c}" for c in carried), "__part", "__pos"])
        at += n


def with_previous(df: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """Adds ``prev_<c>`` for each carried column: its value in the row before in the order of
    ``keys``, null for the first row. Rows that tie in all keys may stand in any order.
    """
    fields = df.schema.fields + [T.StructField(f"prev_{c}", df.schema[c].dataType) for c in carried] + [T.StructField("__part", T.IntegerType()), T.StructField("__pos", T.LongType())]
    ordered = df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    placed = written(ordered.mapInArrow(lambda it: _walk(it, carried), T.StructType(fields)), "ordered")
    ends = placed.groupBy("__part").agg(F.max("__pos").alias("__pos"))
    last = placed.select("__part", "__pos", *carried).join(F.broadcast(ends), ["__part", "__pos"])
    moved = ends.select("__part", F.lag("__part").over(Window.orderBy("__part")).alias("__from"))  # one row per partition
    edge = moved.join(last.select(F.col("__part").alias("__from"), *[F.col(c).alias(f"__edge_{c}") for c in carried]), "__from").select("__part", F.lit(0).cast("long").alias("__pos"), *[f"__edge_{c}" for c in carried])
    joined = placed.join(F.broadcast(edge), ["__part", "__pos"], "left")
    return joined.select(*df.columns, *[F.when(F.col("__pos") == 0, F.col(f"__edge_{c}")).otherwise(F.col(f"prev_{c}")).alias(f"prev_{c}") for c in carried])
