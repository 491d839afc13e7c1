"""Incremental ingestion of landing files into an append-only table, and a streaming hourly view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.landing import with_file_columns
from tidemark.sources.tables import FORMAT


def stream_landing(spark: SparkSession, root: str, schema: str | T.StructType, max_files: int | None = None) -> DataFrame:
    """New files of a landing tree. A file stream needs a declared schema; to add columns, restart with a wider one."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(root)


def landed_schema(spark: SparkSession, root: str) -> T.StructType:
    """The merged schema of all files of a landing tree: given at each start, it widens the stream by new columns."""
    return spark.read.option("mergeSchema", "true").parquet(root).schema


def ingest(spark: SparkSession, root: str, schema: str | T.StructType | None, target: str, checkpoint: str, fmt: str = FORMAT) -> int:
    """Append all files not seen before, each once, and stop. Gives the rows added, counted from the table.

    Without a schema, that of the landed files at this start is taken; the checkpoint stays valid, and
    earlier rows read NULL in columns that came later (``tables.read`` merges the schemas).
    """
    schema = landed_schema(spark, root) if schema is None else schema
    before = _rows(spark, target, fmt)
    query = with_file_columns(stream_landing(spark, root, schema)).writeStream.format(fmt).option("checkpointLocation", checkpoint).option("path", target).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return _rows(spark, target, fmt) - before


def _rows(spark: SparkSession, target: str, fmt: str) -> int:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return 0
    return spark.read.format(fmt).load(target).count()


def assert_idempotent(spark: SparkSession, root: str, schema: str, target: str, checkpoint: str) -> None:
    """A second run over the same files adds nothing."""
    added = ingest(spark, root, schema, target, checkpoint)
    if added:
        raise AssertionError(f"ingesting the same files again added {added} rows")


def hourly_counts(events: DataFrame, time: str = "ts", delay: str = "2 hours", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Tumbling hours of an event stream or table: count and sum in cents, exact in any order. On a stream, rows later than ``delay`` are dropped by the watermark."""
    stamped = events.withWatermark(time, delay) if events.isStreaming else events
    cents = F.round(F.col("value") * 100).cast("long")
    hours = stamped.groupBy(F.window(time, "1 hour"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(cents).alias("cents"))
    return hours.select(F.col("window.start").alias("hour"), *keys, "n", "cents")
