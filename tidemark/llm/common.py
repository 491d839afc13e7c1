"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = 512
#: Spark removes the shuffle files of a finished query at once, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key(id_column: str = "doc_id", text_column: str = "text") -> Column:
    """A row's identity in any scan: a 64-bit digest of its id and text, whatever the files' splits.

    Rows that agree in both share a key. Two others share one with probability n^2/2^65.
    """
    return F.xxhash64(F.col(id_column).cast("long"), F.col(text_column).cast("binary"))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that a Python worker can hold twice. Spark bounds the bytes of what it sends."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only a local session without that setting, as in tests, gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
        folder = getattr(spark, "_tidemark_shared", None)
        if folder is None:
            folder = spark._tidemark_shared = tempfile.mkdtemp(prefix="tidemark-")
    return folder


class Scope:
    """The staged tables that were made while it was open. Whoever opened it may remove them, and no others."""

    _open: list[Scope] = []

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __enter__(self) -> Scope:
        Scope._open.append(self)
        return self

    def __exit__(self, *_: object) -> None:
        Scope._open.remove(self)

    def release(self, spark: SparkSession) -> None:
        """Remove the tables. Only for callers who have written all that reads them."""
        for path in self.paths:
            removed(spark, path)
        self.paths.clear()


def removed(spark: SparkSession, path: str) -> None:
    files, place = file_system(spark, path)
    files.delete(place, True)


def file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and the path as it knows it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def stage_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder. What is still there when the driver's JVM ends goes with it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if Scope._open:
        Scope._open[-1].paths.append(path)
    files, place = file_system(spark, path)
    files.deleteOnExit(place)
    return path


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files; the setting is put back."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or stage_path(spark, name)
    with tidy_shuffles(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_path = path
    return back


def drop_staged(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove tables as ``staged`` gave them, for callers who made them and read them no more."""
    for frame in frames:
        path = getattr(frame, "_staged_path", None)
        if path is None:
            raise ValueError("only what staged() returned can be dropped")
        removed(spark, path)


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """An object that lives as long as its Python worker, so that later tasks find it."""
    kept = sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker"))
    if not hasattr(kept, name):
        setattr(kept, name, make())
    return getattr(kept, name)


def free_name(columns: list[str], stem: str) -> str:
    """``stem``, made longer until no column is called so (Spark's names do not tell cases apart)."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
