"""Places of rows in an order over the whole table, without one task for it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, staged


def _local_places(group: str, place: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            coded = batch.column(batch.schema.get_field_index(group)).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.diff(codes, prepend=codes[0] - 1))
            lengths = np.diff(np.append(starts, len(codes)))
            places = np.arange(len(codes)) - np.repeat(starts, lengths)
            names = coded.dictionary
            if names[int(codes[0])].as_py() == last:
                places[: lengths[0]] += seen
            last, seen = names[int(codes[-1])].as_py(), int(places[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=[*batch.schema.names, place])

    return count


def numbered(rows: DataFrame, group: str, order: list[Column], into: str = "position") -> DataFrame:
    """Add each row's place, from 0, in its group under ``order``. ``group`` is a text column without nulls.

    Rows are dealt to tasks by ranges of (group, order) and sorted there, so that a group of any size is
    spread. A task counts its own rows; only its first group can have begun in an earlier task, so one row a
    task (its first group, that group's rows there, its last group and rows) is enough to shift the counts.
    Rows equal in group and order take their places in any way.
    """
    part = free_name(rows.columns, "part")
    spread = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    schema = rows.select("*", F.lit(0).cast("long").alias(into)).schema
    schema[into].nullable = True
    sorted_rows = staged(spread.mapInArrow(_local_places(group, into), schema).withColumn(part, F.spark_partition_id()), "numbered")
    ends = sorted_rows.groupBy(part, F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n")).groupBy(part)
    ends = ends.agg(F.min_by(F.struct("g", "n"), "g").alias("first"), F.max_by(F.struct("g", "n"), "g").alias("last"))
    # One row a task of the sort, whatever the rows.
    shifts, running = [], (None, 0)
    for row in ends.orderBy(part).collect():
        before = running[1] if row["first"]["g"] == running[0] else 0
        if before:
            shifts.append((row[part], row["first"]["g"], before))
        running = (row["last"]["g"], row["last"]["n"] + (before if row["first"]["g"] == row["last"]["g"] else 0))
    if not shifts:
        return sorted_rows.drop(part)
    moved = rows.sparkSession.createDataFrame(shifts, f"{part} int, _first string, _shift long")
    joined = sorted_rows.join(F.broadcast(moved), part, "left")
    shift = F.when(F.col(group) == F.col("_first"), F.col("_shift")).otherwise(0)
    return joined.withColumn(into, F.col(into) + F.coalesce(shift, F.lit(0))).drop(part, "_first", "_shift")
