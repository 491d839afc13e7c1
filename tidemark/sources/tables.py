"""Loading and storing tables. The format is a setting: Parquet here, Delta where its jar is present."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import require_utc

FORMAT = "parquet"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of a directory; zone-less timestamps become instants, read as UTC."""
    require_utc(spark)
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    naive = [f.name for f in rows.schema if isinstance(f.dataType, T.TimestampNTZType)]
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else rows


def use_namespace(spark: SparkSession, database: str, catalog: str | None = None) -> None:
    if catalog:
        spark.catalog.setCurrentCatalog(catalog)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    spark.catalog.setCurrentDatabase(database)


def rebuild(rows: DataFrame, table: str, fmt: str = FORMAT) -> None:
    """Replace a table, schema included."""
    rows.write.format(fmt).mode("overwrite").option("overwriteSchema", "true").saveAsTable(table)


def append(rows: DataFrame, path: str, fmt: str = FORMAT) -> None:
    rows.write.format(fmt).mode("append").option("mergeSchema", "true").save(path)


def read(spark: SparkSession, path: str, fmt: str = FORMAT) -> DataFrame:
    return spark.read.format(fmt).option("mergeSchema", "true").load(path)


def export_single(rows: DataFrame, path: str) -> None:
    """One file, for small results only: all rows pass through one task."""
    rows.coalesce(1).write.mode("overwrite").parquet(path)


def scratch(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: ``spark.checkpoint.dir``, or the warehouse where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (found or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new folder in the scratch folder, removed when the driver's JVM ends."""
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def staged(rows: DataFrame, name: str) -> DataFrame:
    """Write ``rows`` to the scratch folder and read them back: they are worked out once, and a lost executor costs only reading."""
    path = place(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def replace(rows: DataFrame, path: str) -> None:
    """Write a table beside the one at ``path`` and swap the two: a task that dies leaves the old table or the new one, and may read the old one itself."""
    spark = rows.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    rows.write.parquet(fresh)
    files = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(hadoop(path)) and not files.rename(hadoop(path), hadoop(old)):
        raise OSError(f"{path} cannot be moved")
    if not files.rename(hadoop(fresh), hadoop(path)):
        raise OSError(f"{fresh} cannot be moved to {path}")
    files.delete(hadoop(old), True)
